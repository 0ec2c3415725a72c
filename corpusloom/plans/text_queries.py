"""Text, uploads, parsing and chunking over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import chunking, embedding, parsing, uploads
from .mapping import DOCUMENTS_SQL, MESSAGES_SQL, documents, messages, table
from .registry import query

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _cjk():
    return F.translate(F.lower("text"), "aeiou", "一二三四五")


_CJK_SQL = "translate(lower(text), 'aeiou', '一二三四五')"


def _messy():
    return F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n \t\n\n")), F.lit(". "), F.lit(".\u00a0  \u200b"))


_CLEAN_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'),
  '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]|\\p{{Cf}}', '', 'g'), '[\\t \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"""
_MESSY_SQL = "replace(replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(9) || chr(10) || chr(10)), '. ', '.' || chr(160) || '  ' || chr(8203))"


@query(f"select doc_id, {_CLEAN_SQL.format(c=_MESSY_SQL)} as cleaned from documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(_messy()).alias("cleaned"))


@query(
    f"""with c as (select doc_id, list_filter(string_split({_CLEAN_SQL.format(c=_MESSY_SQL)}, chr(10) || chr(10)), lambda p: p <> '') as ps from documents)
  select doc_id, len(ps)::int as n_paragraphs, ps[1] as first_paragraph, ps[len(ps)] as last_paragraph from c"""
)
def split_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.split_paragraphs(_messy()).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_paragraphs"), F.get("p", F.lit(0))["content"].alias("first_paragraph"), F.element_at("p", -1)["content"].alias("last_paragraph"))


@query(
    """with l as (select doc_id, i, repeat('#', ((doc_id + i) % 8)::int) || case when doc_id % 3 = 0 then '' else ' ' end || ls[i] as line
    from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents)))
  select doc_id, (i - 1)::int as line_no, length(regexp_extract(trim(line), '^(#{1,6}) (.*)$', 1))::int as level, trim(regexp_extract(trim(line), '^(#{1,6}) (.*)$', 2)) as title
  from l where regexp_matches(trim(line), '^#{1,6} .*$')"""
)
def markdown_heading(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    marks = F.repeat(F.lit("#"), ((F.col("doc_id") + F.col("line_no") + 1) % 8).cast("int"))
    line = F.concat(marks, F.when(F.col("doc_id") % 3 == 0, "").otherwise(" "), F.col("line"))
    h = text.markdown_heading(line)
    return d.select("doc_id", "line_no", h["level"].alias("level"), h["title"].alias("title")).filter("level is not null")


@query(
    f"""with t as (select doc_id, {_CJK_SQL} as t from documents), g as (select doc_id, regexp_extract_all(t, '[a-z0-9]+|[一-龥]') as w,
    list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda x: regexp_full_match(x, '[一-龥][一-龥]')) as b from t)
  select doc_id, (len(w) + len(b))::int as n_terms, len(list_distinct(list_concat(w, b)))::int as n_distinct,
    (len(list_filter(w, lambda x: regexp_matches(x, '[a-z0-9]'))) + len(b))::int as n_primary, len(list_filter(w, lambda x: regexp_full_match(x, '[一-龥]')))::int as n_fallback,
    sha256(array_to_string(list_concat(w, b), ' ')) as terms_sha from g"""
)
def search_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", _cjk()).withColumn("t", text.search_terms(F.col("text")))
    return d.select(
        "doc_id",
        F.size("t").alias("n_terms"),
        F.size(text.sparse_query_terms(F.col("text"))).alias("n_distinct"),
        F.size(text.primary_terms(F.col("text"))).alias("n_primary"),
        F.size(text.fallback_terms(F.col("text"))).alias("n_fallback"),
        F.sha2(F.array_join("t", " "), 256).alias("terms_sha"),
    )


@query(
    """with t as (select doc_id, list_distinct(regexp_extract_all(lower(d.text), '[\\p{L}\\p{Nd}]+')) as a, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[\\p{L}\\p{Nd}]+')) as q
    from documents d left join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))
  select doc_id, len(a)::int as n_tokens, round(case when len(q) > 0 then len(list_intersect(q, a)) / len(q)::double else 0 end, 9) as overlap from t"""
)
def lexical_tokens(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", text.lexical_tokens(F.col("text")).alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", text.lexical_tokens(F.col("text")).alias("a"), (F.col("doc_id") % b.count()).alias("item_id"))
    d = d.join(b, "item_id", "left").withColumn("q", F.coalesce("q", F.array().cast("array<string>")))
    return d.select("doc_id", F.size("a").alias("n_tokens"), F.round(text.token_overlap(F.col("q"), F.col("a")), 9).alias("overlap"))


@query(
    """select conv_id, turn, greatest(1, ceil(length(text) / 4.0))::int as ingest, greatest(1, length(text) // 4)::int as usage,
  case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end::int as chat from conversations"""
)
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *(text.estimate_tokens(F.col("text"), r).alias(r) for r in ("ingest", "usage", "chat")))


@query(
    f"""with h as (select doc_id, text, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode('doc-' || doc_id)) as h from documents)
  select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1))::int, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as stable_id,
    sha256(text) as content_hash, substr(sha256(text), 1, 24) as key_digest, 'raw/me/kb/' || doc_id as object_key, doc_id || ':1' as idempotency_key from h"""
)
def ids_and_hashes(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        ids.stable_id(F.concat(F.lit("doc-"), i), NAMESPACE).alias("stable_id"),
        ids.content_hash(F.col("text")).alias("content_hash"),
        ids.key_digest(F.col("text")).alias("key_digest"),
        ids.object_key(F.lit("me"), F.lit("kb"), i).alias("object_key"),
        ids.idempotency_key(i, F.lit("1")).alias("idempotency_key"),
    )


@query(
    """select doc_id, case when doc_id % 4 = 0 then 'page ' || (doc_id % 10) when doc_id % 4 = 1 then 'pages ' || (doc_id % 10) || '-' || (doc_id % 10 + 2)
  when doc_id % 4 = 2 then 'A > B' else 'paragraph/chunk ' || (doc_id % 7 + 1) end as location from documents"""
)
def location(spark, sf_dir):
    i = F.col("doc_id").cast("int")
    start = F.when(i % 4 < 2, i % 10)
    end = F.when(i % 4 == 0, i % 10).when(i % 4 == 1, i % 10 + 2)
    return table(spark, sf_dir, "documents").select("doc_id", text.location(start, end, F.when(i % 4 == 2, "A > B").otherwise(""), i % 7).alias("location"))


_CITED = "left(text, 40) || '[1]' || substr(text, 41, 30) || '[' || (turn + 1) || '][x][9] [2' || substr(text, 71) || ']'"


@query(
    f"""with c as (select conv_id, turn, {_CITED} as t from conversations),
  p as (select conv_id, turn, regexp_extract_all(t, '(\\[[^\\]]*\\])|([^\\[]+|\\[)') as ps from c),
  k as (select conv_id, turn, list_filter(ps, lambda x: not regexp_full_match(x, '\\[[0-9]+\\]') or try_cast(regexp_extract(x, '[0-9]+') as int) between 1 and 3) as ks from p)
  select conv_id, turn, array_to_string(ks, '') as filtered, (select string_agg(n, ',' order by i) from (select n, min(i) as i from (select unnest(range(1, len(ks) + 1)) as i, regexp_extract(ks[i], '^\\[([0-9]+)\\]$', 1) as n) where n <> '' group by n)) as numbers from k"""
)
def filter_citations(spark, sf_dir):
    cited = F.expr(_CITED.replace("left(text, 40)", "substr(text, 1, 40)").replace("(turn + 1)", "cast(turn + 1 as string)"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.filter_citations(cited, F.lit(3)).alias("f"))
    return c.select("conv_id", "turn", "f.text", F.nullif(F.array_join("f.numbers", ","), F.lit("")).alias("numbers")).withColumnRenamed("text", "filtered")


@query(
    """select doc_id, i::int as piece_no, substr(text, i * 32 + 1, 32) as piece from (select doc_id, text, unnest(range(0, (length(text) + 31) // 32)) as i from documents)"""
)
def split_fixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_fixed(F.col("text"))).alias("piece_no", "piece"))


@query("select conv_id, turn, regexp_matches(' ' || lower(text) || ' ', ' it | this | that | they | those | these ') as follow_up from conversations where text is not null")
def looks_like_follow_up(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", text.looks_like_follow_up(F.col("text")).alias("follow_up"))


@query("select doc_id, sha256(replace(replace(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(13), ''), chr(9), ''), '`', '')) as normal_sha from documents")
def normalize_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_evidence(F.col("text")), 256).alias("normal_sha"))


_UPLOADS_SQL = """
up as (select doc_id as id, case doc_id % 9 when 0 then '../x.txt' when 1 then 'run.exe' when 2 then ' pad.txt' when 3 then 'a.pdf' when 4 then 'b.txt' when 5 then 'c.MD' when 6 then 'e.markdown' when 7 then 'x' || chr(92) || 'y.txt' else 'f.txt' end as filename,
  case doc_id % 4 when 0 then null when 1 then 'text/plain' when 2 then 'text/markdown; charset=utf-8' else 'application/octet-stream' end as declared_mime, text as body from documents
  union all select 10000000 + page_id, 'page.txt', 'text/plain', html from pages),
ex as (select *, lower(regexp_extract(filename, '(\\.[^./\\\\]*)$', 1)) as extension, lower(trim(string_split(declared_mime, ';')[1])) as kind from up),
v as (select id, case when filename <> trim(filename) or regexp_matches(filename, '[/\\\\]') then 'INVALID_FILENAME'
  when extension not in ('.pdf', '.docx', '.md', '.markdown', '.txt') then 'UNSUPPORTED_FILE_EXTENSION'
  when not (kind is null or kind = 'application/octet-stream' or (extension = '.txt' and kind = 'text/plain') or (extension in ('.md', '.markdown') and kind in ('text/plain', 'text/markdown'))) then 'INVALID_FILE_MIME'
  when strlen(body) > 20000 then 'FILE_TOO_LARGE' when strlen(body) = 0 then 'EMPTY_FILE'
  when extension = '.pdf' or upper(left(body, 14)) = '<!DOCTYPE HTML' or upper(left(body, 5)) = '<HTML' then 'INVALID_FILE_CONTENT' end as reject_code from ex)"""


@query(f"with {_UPLOADS_SQL} select id, reject_code from v")
def validate_uploads(spark, sf_dir):
    i = F.col("doc_id")
    names = ("../x.txt", "run.exe", " pad.txt", "a.pdf", "b.txt", "c.MD", "e.markdown", "x\\y.txt", "f.txt")
    kinds = (None, "text/plain", "text/markdown; charset=utf-8", "application/octet-stream")
    docs = table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.get(F.array(*map(F.lit, names)), (i % 9).cast("int")).alias("filename"),
        F.get(F.array(*map(F.lit, kinds)), (i % 4).cast("int")).alias("declared_mime"),
        F.encode("text", "UTF-8").alias("content"),
    )
    pages = table(spark, sf_dir, "pages").select((F.lit(10_000_000) + F.col("page_id")).alias("id"), F.lit("page.txt").alias("filename"), F.lit("text/plain").alias("declared_mime"), F.encode("html", "UTF-8").alias("content"))
    return uploads.validate_uploads(docs.unionByName(pages), max_bytes=20_000).select("id", "reject_code")


@query(
    f"""with {DOCUMENTS_SQL}, a as (select id, knowledge_base_id, sha256 from docs where doc_id % 2 = 0), b as (select knowledge_base_id, sha256, min(id) as old from docs where doc_id % 2 = 1 and deleted_at is null group by 1, 2),
  f as (select knowledge_base_id, sha256, min(id) as first from a group by 1, 2)
  select a.id as document_id, coalesce(old, case when first <> a.id then first end) as duplicate_of from a join f using (knowledge_base_id, sha256) left join b using (knowledge_base_id, sha256)"""
)
def dedupe_uploads(spark, sf_dir):
    d = documents(spark, sf_dir)
    incoming = d.filter("doc_id % 2 = 0").select(F.col("id").alias("document_id"), "knowledge_base_id", "sha256")
    existing = d.filter("doc_id % 2 = 1").select("id", "knowledge_base_id", "sha256", "deleted_at")
    return uploads.dedupe_uploads(incoming, existing).select("document_id", "duplicate_of")


@query(
    """with k as (select c_custkey::varchar as id, 'owner-' || (c_custkey % 7) as owner_id, case when c_custkey % 11 = 0 then ' ' else 'KB ' || (c_custkey % 40) end as name, c_custkey % 13 = 0 as deleted from customer),
  n as (select *, row_number() over (partition by owner_id, lower(trim(name)), deleted order by id) as rn from k)
  select id, case when trim(name) = '' then 'VALIDATION_FAILED' when not deleted and rn > 1 then 'KNOWLEDGE_BASE_NAME_EXISTS' end as error_code from n"""
)
def validate_kbs(spark, sf_dir):
    c = F.col("c_custkey")
    kbs = table(spark, sf_dir, "customer").select(
        c.cast("string").alias("id"),
        F.concat(F.lit("owner-"), (c % 7).cast("string")).alias("owner_id"),
        F.when(c % 11 == 0, " ").otherwise(F.concat(F.lit("KB "), (c % 40).cast("string"))).alias("name"),
        F.lit("").alias("description"),
        F.lit("model").alias("embedding_model"),
        F.when(c % 13 == 0, F.timestamp_seconds(F.lit(0))).alias("deleted_at"),
    )
    return uploads.validate_kbs(kbs).select("id", "error_code")


@query(f"with {MESSAGES_SQL} select conversation_id, ord, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as content from messages where length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) between 1 and 20000")
def valid_messages(spark, sf_dir):
    from ..operators.chat import valid_messages as operator

    return operator(messages(spark, sf_dir)).select("conversation_id", "ord", "content")


def _files(spark, sf_dir):
    """Documents as Markdown files: every 5th line a heading, blank lines between lines; as text for odd ids."""
    lines = F.split("text", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    d = documents(spark, sf_dir)
    body = F.when(d.doc_id % 2 == 0, F.array_join(marked, "\n\n")).otherwise(F.array_join(lines, "\n\n"))
    name = F.when(d.doc_id % 2 == 0, "a.md").otherwise("a.txt")
    return d.select(d.id.alias("document_id"), "knowledge_base_id", "index_version", name.alias("filename"), F.encode(body, "UTF-8").alias("content"))


@query()
def parse_documents(spark, sf_dir):
    p = parsing.parse_documents(_files(spark, sf_dir))
    return p.select("document_id", F.size("blocks").alias("n_blocks"), F.try_element_at("blocks", F.lit(-1))["heading_path"].alias("last_path"), F.sha2(F.array_join(F.transform("blocks", lambda b: b["content"]), "|"), 256).alias("content_sha"), "error_code")


@query()
def chunk_documents(spark, sf_dir):
    p = parsing.parse_documents(_files(spark, sf_dir)).filter("error_code is null")
    c = chunking.chunk_documents(p)
    return c.select("document_id", "chunk_index", "token_count", "content_hash", "heading_path", F.element_at("metadata", "source_block_start").alias("source_block_start"), F.element_at("metadata", "paragraph_end").alias("paragraph_end"))


@query()
def index_corpus(spark, sf_dir):
    chunks, outcomes = chunking.index_corpus(_files(spark, sf_dir), dimension=64)
    n = chunks.groupBy("document_id").agg(F.sum(F.size("embedding")).alias("numbers"), F.min("id").alias("first_id"))
    return outcomes.join(n, "document_id", "left")


@query(
    """with low as (select doc_id, lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as t from documents), chars as (select *, string_split(t, '') as cs from low),
  x as (select doc_id, unnest(case when t = '' then ['empty'] else list_concat(regexp_extract_all(t, '[\\p{L}\\p{N}]+'), cs, list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) end) as f from chars),
  c as (select doc_id, f, count(*) as n from x group by 1, 2), h as (select f, ('0x' || substr(sha256(f), 1, 4))::int % 64 as bucket from (select distinct f from c)),
  b as (select doc_id, bucket, sum(n)::double as n from c join h using (f) group by 1, 2)
  select doc_id, bucket::int as bucket, round((n / sqrt(sum(n * n) over (partition by doc_id)))::float::double, 4) as weight from b"""
)
def embed_text(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(embedding.embed_text(F.col("text"), 64)).alias("bucket", "weight")).filter("weight > 0")
    return e.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query("select vec_id, case when len(embedding) <> 64 then 'EMBEDDING_INVALID_RESPONSE' end as error_code from embeddings")
def validate_vectors(spark, sf_dir):
    return embedding.validate_vectors(table(spark, sf_dir, "embeddings"), 64).select("vec_id", "error_code")


@query(
    """with l as (select doc_id, len(string_split(text, chr(10))) as n from documents) select doc_id::varchar as document_id, i::int as chunk_index, (i // 4)::int as batch, (55 + least((i // 4 + 1) * 4, n) * 35 // n)::int as progress from (select doc_id, n, unnest(range(0, n)) as i from l)"""
)
def embedding_progress(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "line"))
    return embedding.embedding_progress(c, 4).select("document_id", "chunk_index", "batch", "progress")


@query(
    f"""with {DOCUMENTS_SQL}, a as (select *, case when doc_id % 9 = 1 then 'UNSUPPORTED_FILE_EXTENSION' when length(text) = 0 then 'EMPTY_FILE' end as code from docs where doc_id % 3 <> 0),
  b as (select knowledge_base_id, sha256, min(id) as old from docs where doc_id % 3 = 0 and deleted_at is null group by 1, 2), f as (select knowledge_base_id, sha256, min(id) as first from a where code is null group by 1, 2),
  d as (select a.id, a.code, coalesce(old, case when first <> a.id then first end) as dup from a left join f using (knowledge_base_id, sha256) left join b using (knowledge_base_id, sha256))
  select id as document_id, case when code is not null then 'failed' when dup is not null then 'duplicate' else 'ready' end as status, code as error_code, case when code is null then dup end as duplicate_of from d"""
)
def index_uploads(spark, sf_dir):
    """Two thirds of the documents come as uploads beside the others."""
    d = documents(spark, sf_dir)
    name = F.when(d.doc_id % 9 == 1, "run.exe").otherwise("a.txt")
    new = d.filter("doc_id % 3 <> 0").select(d.id.alias("document_id"), "knowledge_base_id", "index_version", name.alias("filename"), F.lit("text/plain").alias("declared_mime"), F.encode("text", "UTF-8").alias("content"))
    return chunking.index_uploads(new, d.filter("doc_id % 3 = 0").select("id", "knowledge_base_id", "sha256", "deleted_at"), dimension=64)[1].select("document_id", "status", "error_code", "duplicate_of")


@query(
    f"""with c as (select doc_id, list_filter(string_split({_CLEAN_SQL.format(c=f"coalesce({_MESSY_SQL}, '')")}, chr(10) || chr(10)), lambda p: p <> '') as ps from documents)
  select doc_id::varchar as document_id, len(ps)::int as n_blocks, sha256(array_to_string(ps, '|')) as content_sha, case when len(ps) > 0 then len(ps) end::int as last_paragraph, case when len(ps) = 0 then 'EMPTY_DOCUMENT' end as error_code from c"""
)
def parse_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), _messy().alias("content"))
    last = F.when(F.size("blocks") > 0, F.element_at("blocks", -1)["para_to"])
    return parsing.parse_text(d).select("document_id", F.size("blocks").alias("n_blocks"), F.sha2(F.array_join(F.transform("blocks", lambda b: b["content"]), "|"), 256).alias("content_sha"), last.alias("last_paragraph"), "error_code")

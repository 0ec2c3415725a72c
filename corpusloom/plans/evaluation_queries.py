"""Question sets, relevance, costs and traces over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.costs import Pricing
from ..operators import chat, embedding, evaluation, lifecycle, providers, retrieval
from .mapping import table
from .registry import query
from .service_queries import SPARSE_SQL, questions
from .text_queries import NAMESPACE

PRICES = Pricing(0.15, 0.6, 0.02, 0.05)


def _expected(spark, sf_dir):
    """Each question expects ten documents by id and two chunks; the files of these ten are its sources."""
    i = F.col("item_id")
    tens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (i + 40 * k).cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"),
        F.array(i * 3, i * 3 + 1).alias("expected_chunk_ids"),
        tens.alias("expected_document_ids"),
        F.transform(tens, lambda d: F.concat(F.lit("doc-"), d)).alias("expected_sources"),
    )


def _hits(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    return retrieval.few_hits(retrieval.sparse_topk(q, retrieval.over_all_cores(d), 20)).join(d.select("chunk_id", "document_id", "filename"), "chunk_id")


_RELEVANT = f"""{SPARSE_SQL}, rel as (select query_id, chunk_id, rank, chunk_id in (query_id * 3, query_id * 3 + 1) or (chunk_id % 40 = query_id % 40 and chunk_id between query_id and query_id + 360) as relevant,
  chunk_id % 40 = query_id % 40 and chunk_id between query_id and query_id + 360 as source_relevant from sparse)"""


@query(f"with {_RELEVANT} select * from rel")
def relevance(spark, sf_dir):
    hits, q = _hits(spark, sf_dir), _expected(spark, sf_dir)
    by_source = evaluation.mark_source_relevant(hits, q).select("query_id", "chunk_id", F.col("relevant").alias("source_relevant"))
    return evaluation.mark_relevant(hits, q).join(by_source, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rank", "relevant", "source_relevant")


@query(f"with {_RELEVANT} select query_id, coalesce(min(rank) filter (relevant), 0)::int as first_relevant_rank from rel group by 1")
def first_relevant_rank(spark, sf_dir):
    return evaluation.first_relevant_rank(evaluation.mark_relevant(_hits(spark, sf_dir), _expected(spark, sf_dir)))


@query(f"with {_RELEVANT}, c as (select query_id, bool_or(source_relevant) as hit from rel where rank <= 3 group by 1) select item_id as query_id, coalesce(hit, false) as citation_hit from benchmark left join c on query_id = item_id")
def citation_hits(spark, sf_dir):
    return evaluation.citation_hits(_hits(spark, sf_dir).filter("rank <= 3"), _expected(spark, sf_dir))


_QUESTIONS = """q as (select (case when doc_id % 10 = 9 then doc_id - 1 else doc_id end)::varchar as id, case when doc_id % 11 = 3 then ' ' else source end as kb, text as question, case when doc_id % 13 = 5 then null else 'answer' end as answer,
  doc_id % 7 = 2 as no_docs, doc_id % 5 = 2 as no_chunks, doc_id % 4 = 1 as unanswerable from documents)"""
_BLANK = "trim(coalesce({}, '')) = ''"


def _question_set(spark, sf_dir):
    i = F.col("doc_id")
    some = lambda c, flag: F.when(flag, F.array().cast("array<string>")).otherwise(F.array(F.lit(c)))
    return table(spark, sf_dir, "documents").select(
        F.when(i % 10 == 9, i - 1).otherwise(i).cast("string").alias("id"),
        F.when(i % 11 == 3, " ").otherwise(F.col("source")).alias("knowledge_base"),
        F.col("text").alias("question"),
        F.when(i % 13 != 5, "answer").alias("reference_answer"),
        some("d", i % 7 == 2).alias("expected_document_ids"),
        some("c", i % 5 == 2).alias("expected_chunk_ids"),
        some("s", i % 7 == 2).alias("expected_sources"),
        some("e", i % 5 == 2).alias("expected_evidence"),
        (i % 4 == 1).alias("unanswerable"),
    )


def _errors_sql(blank: str, none: str) -> str:
    return f"""with {_QUESTIONS}, e as (select id, case when {blank} then 'BLANK_FIELD' when {none} then 'NO_EXPECTATION' when count(*) over (partition by id) > 1 then 'DUPLICATE_ID' end as error from q)
  select id, error from e where error is not null"""


@query(_errors_sql(" or ".join(_BLANK.format(c) for c in ("id", "kb", "question", "answer")), "no_docs and no_chunks"))
def question_errors(spark, sf_dir):
    return evaluation.question_errors(_question_set(spark, sf_dir))


@query(_errors_sql(" or ".join(_BLANK.format(c) for c in ("id", "question", "answer")), "not unanswerable and (no_docs or no_chunks)"))
def answer_question_errors(spark, sf_dir):
    return evaluation.answer_question_errors(_question_set(spark, sf_dir))


_SIZE = "greatest(1, length({}) // 4)"


@query(
    f"""with c as (select doc_id as id, case when doc_id % 2 = 0 then {_SIZE.format('text')} else 0 end as e, case when doc_id % 3 = 0 then {_SIZE.format('text')} + {_SIZE.format('source')} + {_SIZE.format('lang')} else 0 end as r from documents where text is not null)
  select id, (id % 50 + e + r)::int as tokens, round(0.001::double + e * 0.02::double / 1e6 + r * 0.05::double / 1e6, 12) as estimated_cost_usd from c"""
)
def case_costs(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").filter("text is not null")  # a case has a question
    cases = d.select(i.alias("id"), F.col("text").alias("question"), F.array("source", "lang").alias("contents"), (i % 2 == 0).alias("dense"), (i % 3 == 0).alias("rerank"), (i % 50).cast("int").alias("chat_tokens"), F.lit(0.001).alias("chat_cost"))
    return evaluation.case_costs(cases, PRICES).select("id", "tokens", F.round("estimated_cost_usd", 12).alias("estimated_cost_usd"))


def _uuid(name: str) -> str:
    h = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1))::int, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(
    f"""with b as (select item_id, 'Question: ' || text || chr(10) || 'Answer: ' || 'a' || item_id || chr(10) || 'Tags: x, y' as content from benchmark)
  select {_uuid("'d' || item_id")} as document_id, {_uuid("'c' || item_id")} as chunk_id, 'kb' as knowledge_base, content, sha256(content) as content_hash, {_SIZE.format('content')}::int as token_count from b"""
)
def seed_corpus(spark, sf_dir):
    i = F.col("item_id").cast("string")
    name = lambda p: F.array(F.concat(F.lit(p), i))
    q = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.concat(F.lit("a"), i).alias("reference_answer"), F.lit("kb").alias("knowledge_base"), F.array(F.lit("x"), F.lit("y")).alias("tags"), name("d").alias("expected_document_ids"), name("c").alias("expected_chunk_ids"))
    return evaluation.seed_corpus(q, NAMESPACE)


@query("with d as (select item_id, unnest(['a', 'b']) as strategy from benchmark) select strategy from d where strategy = 'a' or item_id % 2 = 0 group by 1 having count(*) = (select count(*) from benchmark)")
def complete_strategies(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    done = b.withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("strategy = 'a' or id % 2 = 0")
    return evaluation.complete_strategies(done, b)


@query(
    f"""with {SPARSE_SQL}, h as (select query_id, count(*) as n, string_agg('{{"rank":' || rank || ',"chunk_id":' || chunk_id || ',"score":' || sparse_score || '}}', ',' order by rank) as hits from sparse group by 1)
  select item_id as query_id, '{{"strategy":"sparse","n_dense":0,"n_sparse":' || coalesce(n, 0) || ',"rerank_fallback":false' || coalesce(',"hits":[' || hits || ']', '') || '}}' as trace from benchmark left join h on query_id = item_id"""
)
def retrieval_trace(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    return chat.retrieval_trace(*retrieval.retrieve(q, retrieval.over_all_cores(d), retrieval.RetrievalConfig(dense_top_k=0, final_top_k=20)))


@query(
    """with e as (select event_id as id, case event_id % 5 when 0 then 'EMPTY_DOCUMENT' when 1 then 'EMBEDDING_TIMEOUT' when 2 then 'DOCUMENT_PARSE_FAILED' when 3 then 'EMBEDDING_INVALID_RESPONSE' end as code from events)
  select id, case when code is not null then case when code = 'EMBEDDING_TIMEOUT' then 'transient' else 'permanent' end end as kind from e"""
)
def classify_errors(spark, sf_dir):
    i = F.col("event_id")
    code = F.when(i % 5 == 0, "EMPTY_DOCUMENT").when(i % 5 == 1, "EMBEDDING_TIMEOUT").when(i % 5 == 2, "DOCUMENT_PARSE_FAILED").when(i % 5 == 3, "EMBEDDING_INVALID_RESPONSE")
    return table(spark, sf_dir, "events").select(i.alias("id"), lifecycle.classify_error(code).alias("kind"))


def _two_numbers(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@query("select doc_id, length(coalesce(text, ''))::double as size, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::double as n_a from documents")
def embed_with(spark, sf_dir):
    """A user's embedder, called for batches of whole texts."""
    v = table(spark, sf_dir, "documents").select("doc_id", embedding.embed_with(F.col("text"), _two_numbers).alias("v"))
    return v.select("doc_id", F.element_at("v", 1).cast("double").alias("size"), F.element_at("v", 2).cast("double").alias("n_a"))


def _echo(request: dict) -> dict:
    text = request.get("content") or ""
    return {"text": "re: " + text, "prompt_tokens": max(1, len(text) // 4), "completion_tokens": len(text.split(" "))}


@query("select conv_id, turn, 're: ' || coalesce(text, '') as answer, greatest(1, length(coalesce(text, '')) // 4)::int as prompt_tokens, len(string_split(coalesce(text, ''), ' '))::int as completion_tokens from conversations")
def chat_answers(spark, sf_dir):
    """A user's chat model, called for every turn."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", providers.chat_answers(F.struct(F.col("role"), F.col("text").alias("content")), _echo).alias("a"))
    return a.select("conv_id", "turn", F.col("a.text").alias("answer"), "a.prompt_tokens", "a.completion_tokens")


def _judge(case: dict) -> dict:
    good, toxic = case.get("quality") == 1, case.get("toxic") == 1
    return {"answer_correct": good, "evidence_supported": good and not toxic, "correct_refusal": not good, "hallucination": toxic, "rationale": f"quality {case.get('quality', 0)}"}


@query(
    """select doc_id, coalesce(quality, 0) = 1 as answer_correct, coalesce(quality, 0) = 1 and coalesce(toxic, 0) <> 1 as evidence_supported, coalesce(quality, 0) <> 1 as correct_refusal, coalesce(toxic, 0) = 1 as hallucination,
  'quality ' || coalesce(quality, 0) as rationale from labels"""
)
def judged(spark, sf_dir):
    """A user's judge, called for every labelled document."""
    v = table(spark, sf_dir, "labels").select("doc_id", providers.judged(F.struct("quality", "toxic"), _judge).alias("v"))
    return v.select("doc_id", "v.*")


def _shorten(history: list[dict], question: str) -> str:
    return " ".join(question.split(" ")[:3])


@query("select item_id as query_id, case when trim(q) = '' then text else trim(q) end as query, trim(q) <> '' and trim(q) <> text as rewrite_applied, trim(q) = '' as rewrite_fallback from (select *, array_to_string(string_split(text, ' ')[1:3], ' ') as q from benchmark where text is not null)")
def rewrite_by_model(spark, sf_dir):
    """A user's rewriter, which falls back to the question where it gives nothing."""
    b = table(spark, sf_dir, "benchmark").filter("text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.array().cast("array<struct<role:string,status:string,content:string>>").alias("history"))
    return chat.rewrite_queries(b, _shorten).select("query_id", "query", "rewrite_applied", "rewrite_fallback")

"""Functions that no other query runs, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as text_functions
from ..operators import embedding, lifecycle, parsing
from .mapping import table
from .registry import query
from .text_queries import _CLEAN_SQL

_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"with w as (select conv_id, turn, {_TOKENS} as ws from conversations) select conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') as words from w")
def distinct_in_order(spark, sf_dir):
    """The words of each turn in the order of their first use."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text_functions.distinct_in_order(words), " ").alias("words"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, sf_dir):
    """Each vector beside the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(embedding.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    """select doc_id, case when doc_id % 7 <> 0 then coalesce(quality, 0) = 1 end as answer_correct, case when doc_id % 7 <> 0 then doc_id % 5 <> 0 end as evidence_supported,
  case when doc_id % 7 <> 0 then doc_id % 3 = 0 end as correct_refusal, case when doc_id % 7 <> 0 then coalesce(toxic, 0) = 1 end as hallucination from labels"""
)
def extract_verdict(spark, sf_dir):
    """Verdicts inside a judge's prose; every 7th answer holds none."""
    i = F.col("doc_id")
    verdict = F.to_json(
        F.struct((F.coalesce("quality", F.lit(0)) == 1).alias("answer_correct"), (i % 5 != 0).alias("evidence_supported"), (i % 3 == 0).alias("correct_refusal"), (F.coalesce("toxic", F.lit(0)) == 1).alias("hallucination"))
    )
    said = F.concat(F.lit("After some thought:\n"), F.when(i % 7 != 0, verdict).otherwise(F.lit("no verdict")), F.lit("\nThat is all."))
    v = table(spark, sf_dir, "labels").select("doc_id", text_functions.extract_verdict(said).alias("v"))
    return v.select("doc_id", *(F.col(f"v.{c}").alias(c) for c in ("answer_correct", "evidence_supported", "correct_refusal", "hallucination")))


@query(
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as page from documents where text is not null),
  c as (select doc_id, page, {_CLEAN_SQL.format(c="line")} as content from l),
  g as (select doc_id, count(*) filter (content <> '') as n, string_agg(content, '|' order by page) filter (content <> '') as body, max(page) filter (content <> '') as last from c group by 1)
  select doc_id::varchar as document_id, n::int as n_blocks, sha256(coalesce(body, '')) as content_sha, last::int as last_page, case when n = 0 then 'EMPTY_DOCUMENT' end as error_code from g"""
)
def page_blocks(spark, sf_dir):
    """Lines as the pages that an extractor read."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    pages = d.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).withColumn("page", F.col("at") + 1)
    last = F.when(F.size("blocks") > 0, F.element_at("blocks", -1)["page_end"])
    return parsing.page_blocks(pages).select("document_id", F.size("blocks").alias("n_blocks"), F.sha2(F.array_join(F.transform("blocks", lambda b: b["content"]), "|"), 256).alias("content_sha"), last.alias("last_page"), "error_code")


@query("select doc_id, sha256(left(text, 1000)) as message_sha, length(left(text, 1000)) as n from documents where text is not null")
def error_message(spark, sf_dir):
    """Texts as the messages of errors, of which 1,000 characters are kept."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", lifecycle.error_message(F.col("text")).alias("m"))
    return d.select("doc_id", F.sha2("m", 256).alias("message_sha"), F.length("m").cast("long").alias("n"))

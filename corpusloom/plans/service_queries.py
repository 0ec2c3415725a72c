"""Retrieval, chat, evaluation, governance, lifecycle and limits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.costs import Pricing
from ..operators import chat, embedding, evaluation, evidence, governance, inverted, lifecycle, limits, quantised, retrieval
from ..sources.checkpoints import checkpointed, written
from .mapping import DOCUMENTS_SQL, JOBS_SQL, KBS_SQL, MESSAGES_SQL, PIECES_SQL, USAGE_SQL, documents, jobs, knowledge_bases, messages, pieces, table, usage
from .registry import query

PRICES = Pricing(0.15, 0.6, 0.02, 0.05)


def _now():
    return F.timestamp_seconds(F.lit(1_800_000_000))


# scope and configuration


@query(
    """with c as (select event_id as id, (user_id % 120)::int as d, (event_id % 110)::int as s, (event_id % 13)::int as f, (user_id % 1100)::int as k from events)
  select id, d as dense_top_k, case when id % 3 = 0 then 20 else s end as sparse_top_k, f as final_top_k, k as rrf_k,
  case when not (d <= 100 and case when id % 3 = 0 then 20 else s end <= 100 and (d > 0 or case when id % 3 = 0 then 20 else s end > 0) and f between 1 and 10 and k between 1 and 1000) then 'INVALID_RETRIEVAL_CONFIG' end as error_code from c"""
)
def validate_config(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 110)
    raw = F.to_json(F.struct((F.col("user_id") % 120).alias("dense_top_k"), s.alias("sparse_top_k"), (F.col("event_id") % 13).alias("final_top_k"), (F.col("user_id") % 1100).alias("rrf_k")))
    df = retrieval.validate_config(retrieval.resolve_config(e.select(F.col("event_id").alias("id"), raw.alias("retrieval_config"))))
    return df.select("id", "dense_top_k", "sparse_top_k", "final_top_k", "rrf_k", "error_code")


_SCOPE = f"""{DOCUMENTS_SQL}, {KBS_SQL}, {PIECES_SQL}, vis as (select p.*, d.filename, k.owner_id from pieces p join docs d on p.document_id = d.id and p.knowledge_base_id = d.knowledge_base_id and p.index_version = d.index_version
  join kbs k on k.id = p.knowledge_base_id where d.deleted_at is null and d.status = 'ready' and k.deleted_at is null)"""


@query(f"with {_SCOPE} select knowledge_base_id, owner_id, count(*) as n, count(distinct document_id) as documents from vis group by 1, 2")
def visible_chunks(spark, sf_dir):
    v = retrieval.visible_chunks(pieces(spark, sf_dir), documents(spark, sf_dir), knowledge_bases(spark, sf_dir))
    return v.groupBy("knowledge_base_id", "owner_id").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query(
    f"""with {DOCUMENTS_SQL}, {KBS_SQL}, r as (select knowledge_base_id, count(*) as n from docs where deleted_at is null and status = 'ready' and knowledge_base_id <> 'src3' group by 1)
  select id as knowledge_base_id, coalesce(n, 0) as ready_documents, case when deleted_at is not null then 'KNOWLEDGE_BASE_NOT_FOUND' when n is null then 'KNOWLEDGE_BASE_NOT_READY' end as error_code from kbs left join r on id = knowledge_base_id"""
)
def kb_readiness(spark, sf_dir):
    return retrieval.kb_readiness(knowledge_bases(spark, sf_dir), documents(spark, sf_dir).filter("knowledge_base_id <> 'src3'"))


# search


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    kb = F.col("label").cast("string").alias("knowledge_base_id")
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), kb, "embedding"), e.select(F.col("vec_id").alias("chunk_id"), kb, "embedding")


_DENSE = """s as (select q.vec_id as query_id, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as similarity from embeddings q join embeddings c using (label) where q.vec_id % 50 = 0)"""


@query(f"with {_DENSE}, r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id)::int as rank from s) select * from r where rank <= 10")
def dense_topk(spark, sf_dir):
    return retrieval.dense_topk(*_vectors(spark, sf_dir), 10)


@query(f"with {_DENSE}, r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id)::int as rank from s) select * from r where rank <= 10")
def pruned_dense_topk(spark, sf_dir):
    """The same rows by a first pass in eight bits."""
    return quantised.pruned_dense_topk(*_vectors(spark, sf_dir), 10)


def questions(spark, sf_dir):
    """Benchmark items as queries against all documents in one knowledge base."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("knowledge_base_id"), F.col("text").alias("question"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("all").alias("knowledge_base_id"), F.col("text").alias("content"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"))
    return b, d


SPARSE_SQL = """q as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as ts from benchmark), qt as (select query_id, unnest(ts) as term, len(ts) as n from q),
  ct as (select doc_id as chunk_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) where term in (select term from qt) group by 1, 2),
  sc as (select query_id, chunk_id, round(count(*) / n::double, 9) as sparse_coverage, round(sum(tf)::double / (sum(tf)::double + 1), 9) as sparse_score from ct join qt using (term) group by query_id, chunk_id, n),
  sparse as (select * from (select *, row_number() over (partition by query_id order by sparse_coverage desc, sparse_score desc, chunk_id)::int as rank from sc) where rank <= 20)"""


@query(f"with {SPARSE_SQL} select query_id, chunk_id, sparse_coverage, sparse_score, rank from sparse")
def sparse_topk(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    return retrieval.sparse_topk(q, retrieval.over_all_cores(d), 20).select("query_id", "chunk_id", "sparse_coverage", "sparse_score", "rank")


@query(f"with {SPARSE_SQL} select query_id, chunk_id, sparse_coverage, sparse_score, rank from sparse")
def indexed_topk(spark, sf_dir):
    """The search by an inverted index of all documents, built first."""
    q, d = questions(spark, sf_dir)
    index = inverted.build_index(d)
    index = inverted.InvertedIndex(written(index.postings, "index"), index.blocks)
    return inverted.topk(q, index, 20).select("query_id", "chunk_id", "sparse_coverage", "sparse_score", "rank")


# offline embeddings of all questions and documents, and the 20 nearest documents of each question
_SECOND = """texts as (select 0 as side, item_id as id, text from benchmark union all select 1, doc_id, text from documents),
  low as (select side, id, lower(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as t from texts), chars as (select *, string_split(t, '') as cs from low),
  fe as (select side, id, unnest(case when t = '' then ['empty'] else list_concat(regexp_extract_all(t, '[\\p{L}\\p{N}]+'), cs, list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) end) as f from chars),
  fc as (select side, id, f, count(*) as n from fe group by 1, 2, 3), hb as (select f, ('0x' || substr(sha256(f), 1, 4))::int % 1024 as bucket from (select distinct f from fc)),
  bk as (select side, id, bucket, sum(n)::double as n from fc join hb using (f) group by 1, 2, 3), vec as (select side, id, bucket, (n / sqrt(sum(n * n) over (partition by side, id)))::float::double as v from bk),
  nv as (select side, id, sqrt(sum(v * v)) as z from vec group by 1, 2),
  near as (select q.id as query_id, c.id as chunk_id, sum(q.v * c.v) as dot from vec q join vec c on q.bucket = c.bucket where q.side = 0 and c.side = 1 group by 1, 2),
  sims as (select query_id, chunk_id, round(dot / (a.z * b.z), 6) as similarity from near join nv a on a.side = 0 and a.id = query_id join nv b on b.side = 1 and b.id = chunk_id),
  dense as (select * from (select *, row_number() over (partition by query_id order by similarity desc, chunk_id)::int as rank from sims) where rank <= 20),
  both_lists as (select query_id, chunk_id, rank, 1.0::double as w, similarity, null::double as sparse_score, null::double as sparse_coverage from dense
    union all select query_id, chunk_id, rank, greatest(0.1, least(1, 2 * sparse_coverage))::double, null, sparse_score, sparse_coverage from sparse),
  f as (select query_id, chunk_id, max(similarity) as similarity, max(sparse_score) as sparse_score, max(sparse_coverage) as sparse_coverage, round(sum(w / (60 + rank)), 12) as rrf_score from both_lists group by 1, 2),
  fused as (select *, row_number() over (partition by query_id order by rrf_score desc, chunk_id)::int as rank from f)"""


def _lists(spark, sf_dir):
    """The 20 best of all documents for each question by vectors and by terms; both are read several times and so computed once."""
    q, d = questions(spark, sf_dir)
    asked = embedding.with_embeddings(q, "question").select("query_id", "knowledge_base_id", "embedding")
    return checkpointed(retrieval.dense_text_topk(asked, d, 20)), checkpointed(retrieval.sparse_topk(q, retrieval.over_all_cores(d), 20))


@query(f"with {SPARSE_SQL}, {_SECOND} select query_id, chunk_id, similarity, sparse_score, sparse_coverage, rrf_score, rank from fused")
def rrf(spark, sf_dir):
    return retrieval.rrf(*_lists(spark, sf_dir)).drop("score")


_RERANK = """txt as (select fused.*, d.text as content, b.text as question from fused join documents d on chunk_id = doc_id join benchmark b on query_id = item_id),
  tok as (select *, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}]+')) as ct, list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{Nd}]+')) as qt from txt),
  rs as (select *, case when rank <= 10 then case when len(qt) > 0 then len(list_intersect(qt, ct)) / len(qt)::double else 0 end end as rr from tok),
  reranked as (select query_id, chunk_id, rank as prior, rr, content, question, row_number() over (partition by query_id order by rr is null, rr desc, rank)::int as rank from rs)"""


def _with_texts(hits, q, d):
    return retrieval.few_hits(hits).join(d.select("chunk_id", "content"), "chunk_id").join(q.select("query_id", "question"), "query_id")


@query(f"with {SPARSE_SQL}, {_SECOND}, {_RERANK} select query_id, chunk_id, round(rr, 9) as rerank_score, rank from reranked where rank <= 15")
def rerank(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    fused = _with_texts(retrieval.rrf(*_lists(spark, sf_dir)), q, d)
    out = retrieval.final_topk(retrieval.rerank(fused, retrieval.lexical_rerank_scores(fused, 10), 10), 15)
    return out.select("query_id", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), "rank")


@query(f"with {SPARSE_SQL}, {_SECOND} select query_id, chunk_id, rank, query_id % 2 = 0 as rerank_fallback from fused where query_id % 2 = 0 union all select query_id, chunk_id, row_number() over (partition by query_id order by rank > 10, case when rank <= 10 then chunk_id end desc, rank)::int, false from fused where query_id % 2 = 1")
def rerank_fallback(spark, sf_dir):
    fused = retrieval.rrf(*_lists(spark, sf_dir))
    scores = fused.filter("rank <= 10").select("query_id", "chunk_id", F.when((F.col("query_id") % 2 == 0) & (F.col("rank") == 3), float("nan")).otherwise(F.col("chunk_id").cast("double")).alias("rerank_score"))
    few = fused.filter("rank <= 2 and query_id % 2 = 0").select("query_id", (F.col("chunk_id") + 10_000_000).alias("chunk_id"), F.lit(1.0).alias("rerank_score"))  # rows outside the candidates
    return retrieval.rerank_with_fallback(fused, scores.union(few), 10).select("query_id", "chunk_id", "rank", "rerank_fallback")


@query(
    f"""with {SPARSE_SQL}, {_SECOND}, n as (select query_id, count(*) filter (rank <= 5) as r from fused group by 1), nd as (select query_id, count(*) as d from dense group by 1), ns as (select query_id, count(*) as s from sparse group by 1)
  select item_id as query_id, coalesce(r, 0) as n_results, coalesce(d, 0) as n_dense, coalesce(s, 0) as n_sparse, false as rerank_fallback, 'hybrid_rrf' as strategy
  from benchmark left join n on n.query_id = item_id left join nd on nd.query_id = item_id left join ns on ns.query_id = item_id"""
)
def retrieve_responses(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    return retrieval.retrieve(embedding.with_embeddings(q, "question"), retrieval.over_all_cores(d), retrieval.RetrievalConfig())[1]


@query(f"with {SPARSE_SQL}, {_SECOND} select query_id, chunk_id, rrf_score as score from fused where rrf_score >= 0.02")
def min_score(spark, sf_dir):
    """Fused hits with a score of 0.02 at least."""
    return retrieval.min_score(retrieval.rrf(*_lists(spark, sf_dir)), 0.02).select("query_id", "chunk_id", "score")


@query(f"with {SPARSE_SQL}, {_SECOND} select query_id, chunk_id, similarity as score, rank from dense where similarity >= 0.5")
def dense_strategy(spark, sf_dir):
    """Hits of the dense strategy alone, scored by similarity, 0.5 at least."""
    dense, sparse = _lists(spark, sf_dir)
    found = retrieval.strategy_results(dense, sparse, retrieval.RetrievalConfig(sparse_top_k=0))
    return retrieval.min_score(found, 0.5).select("query_id", "chunk_id", "score", "rank")


@query(
    f"""with {SPARSE_SQL}, {_SECOND}, {_RERANK}, n as (select query_id, count(*) as r from reranked where rank <= 5 group by 1), nd as (select query_id, count(*) as d from dense group by 1), ns as (select query_id, count(*) as s from sparse group by 1)
  select item_id as query_id, coalesce(r, 0) as n_results, coalesce(d, 0) as n_dense, coalesce(s, 0) as n_sparse, false as rerank_fallback, 'hybrid_rrf+rerank' as strategy
  from benchmark left join n on n.query_id = item_id left join nd on nd.query_id = item_id left join ns on ns.query_id = item_id"""
)
def retrieve_reranked(spark, sf_dir):
    """retrieve() with the reranker on."""
    q, d = questions(spark, sf_dir)
    config = retrieval.RetrievalConfig(rerank_enabled=True)
    return retrieval.retrieve(embedding.with_embeddings(q, "question"), retrieval.over_all_cores(d), config)[1]


# evaluation

_CASES = f"""{SPARSE_SQL}, {_SECOND}, {_RERANK}, lists as (select 0 as ord, 'sparse' as strategy, query_id, chunk_id, rank from sparse union all select 1, 'dense', query_id, chunk_id, rank from dense union all select 2, 'hybrid_rrf', query_id, chunk_id, rank from fused
    union all select 3, 'hybrid_rrf+rerank', query_id, chunk_id, rank from reranked),
  marked as (select l.*, contains(d.text, b.text) as relevant from lists l join documents d on chunk_id = doc_id join benchmark b on query_id = item_id),
  cases as (select ord, strategy, query_id, coalesce(min(rank) filter (relevant), 0) as first_relevant_rank, coalesce(bool_or(relevant) filter (rank = 1), false) as citation_hit,
    ((query_id * 37 + ord * 11) % 97)::double as retrieval_latency_ms, ((query_id * 53 + ord * 7) % 199)::double as end_to_end_latency_ms, (query_id * 13 % 50)::int as tokens, (query_id % 7)::double / 1000 as estimated_cost_usd, '' as error from marked group by 1, 2, 3)"""


def _cases(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    dense, sparse = _lists(spark, sf_dir)
    fused = checkpointed(_with_texts(retrieval.rrf(dense, sparse), q, d))
    reranked = retrieval.rerank(fused, retrieval.lexical_rerank_scores(fused, 10), 10)
    lists = None
    for ord_, (name, df) in enumerate((("sparse", _with_texts(sparse, q, d)), ("dense", _with_texts(dense, q, d)), ("hybrid_rrf", fused), ("hybrid_rrf+rerank", reranked))):
        own = df.select(F.lit(ord_).alias("ord"), F.lit(name).alias("strategy"), "query_id", "chunk_id", "rank", F.contains("content", "question").alias("relevant"))
        lists = own if lists is None else lists.unionByName(own)
    marked = lists
    i, o = F.col("query_id"), F.col("ord")
    return marked.groupBy("ord", "strategy", "query_id").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0)).alias("first_relevant_rank"), F.coalesce(F.bool_or(F.when(F.col("rank") == 1, F.col("relevant"))), F.lit(False)).alias("citation_hit")).withColumns(
        {
            "retrieval_latency_ms": ((i * 37 + o * 11) % 97).cast("double"),
            "end_to_end_latency_ms": ((i * 53 + o * 7) % 199).cast("double"),
            "tokens": (i * 13 % 50).cast("int"),
            "estimated_cost_usd": (i % 7).cast("double") / 1000,
            "error": F.lit(""),
        }
    )


_METRICS_SQL = """count(*) as n_cases, round(avg((first_relevant_rank = 1)::int), 9) as recall_at_1, round(avg((first_relevant_rank between 1 and 5)::int), 9) as recall_at_5, round(avg((first_relevant_rank between 1 and 10)::int), 9) as recall_at_10,
  round(avg(case when first_relevant_rank > 0 then 1.0::double / first_relevant_rank else 0 end), 9) as mrr, round(avg(citation_hit::int), 9) as citation_hit_rate, round(avg(retrieval_latency_ms), 6) as avg_retrieval_latency_ms, round(avg(end_to_end_latency_ms), 6) as avg_end_to_end_latency_ms,
  round(avg(tokens), 6) as avg_tokens, round(avg(estimated_cost_usd), 9) as avg_estimated_cost_usd, quantile_disc(retrieval_latency_ms, 0.95) as p95_retrieval_latency_ms, quantile_disc(end_to_end_latency_ms, 0.95) as p95_end_to_end_latency_ms"""


@query(f"with {_CASES} select strategy, {_METRICS_SQL} from cases group by 1")
def retrieval_metrics(spark, sf_dir):
    m = evaluation.retrieval_metrics(_cases(spark, sf_dir))
    return m.select(*(F.round(c, 6 if c.startswith("avg_") and "cost" not in c else 9).alias(c) if kind == "double" and not c.startswith("p95") else c for c, kind in m.dtypes))


@query(f"with {_CASES} select strategy, query_id, first_relevant_rank from cases where first_relevant_rank = 0 or first_relevant_rank > 10 or not citation_hit")
def failure_cases(spark, sf_dir):
    return evaluation.failure_cases(_cases(spark, sf_dir)).select("strategy", "query_id", "first_relevant_rank")


@query(f"with {_CASES}, m as (select ord, strategy, {_METRICS_SQL} from cases group by 1, 2) select strategy, recall_at_10, mrr from m order by recall_at_10 desc, mrr desc, ord limit 1")
def best_strategy(spark, sf_dir):
    c = _cases(spark, sf_dir)
    m = evaluation.retrieval_metrics(c).join(c.select("strategy", "ord").distinct(), "strategy")
    m = m.withColumns({k: F.round(k, 9) for k in ("recall_at_10", "mrr")})
    return evaluation.best_strategy(m).select("strategy", "recall_at_10", "mrr")


_JUDGED = """j as (select doc_id::varchar as id, case when doc_id % 2 = 0 then 'a' else 'b' end as strategy, (doc_id % 12)::int as first_relevant_rank, doc_id % 3 = 0 as citation_hit, coalesce(quality, 0) = 1 as answer_correct, doc_id % 5 <> 0 as evidence_supported,
  doc_id % 3 <> 0 as correct_refusal, coalesce(toxic, 0) = 1 as hallucination, case when doc_id % 29 = 0 then 'timeout' else '' end as error, (doc_id % 100)::int as tokens, (doc_id % 8)::double / 100 as estimated_cost_usd,
  (doc_id % 71)::double as retrieval_latency_ms, (doc_id % 113)::double as end_to_end_latency_ms, doc_id % 4 = 0 as unanswerable, case doc_id % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'markdown' else 'html' end as format from labels)"""


def _judged(spark, sf_dir):
    i, c = F.col("doc_id"), F.col
    rows = table(spark, sf_dir, "labels").select(
        i.cast("string").alias("id"),
        F.when(i % 2 == 0, "a").otherwise("b").alias("strategy"),
        (i % 12).cast("int").alias("first_relevant_rank"),
        (i % 3 == 0).alias("citation_hit"),
        (F.coalesce(c("quality"), F.lit(0)) == 1).alias("answer_correct"),
        (i % 5 != 0).alias("evidence_supported"),
        (i % 3 != 0).alias("correct_refusal"),
        (F.coalesce(c("toxic"), F.lit(0)) == 1).alias("hallucination"),
        F.when(i % 29 == 0, "timeout").otherwise("").alias("error"),
        (i % 100).cast("int").alias("tokens"),
        ((i % 8).cast("double") / 100).alias("estimated_cost_usd"),
        (i % 71).cast("double").alias("retrieval_latency_ms"),
        (i % 113).cast("double").alias("end_to_end_latency_ms"),
        (i % 4 == 0).alias("unanswerable"),
        F.array(F.when(i % 4 == 0, "pdf").when(i % 4 == 1, "docx").when(i % 4 == 2, "markdown").otherwise("html"), F.lit("direct_fact")).alias("tags"),
    )
    return rows.drop("unanswerable", "tags"), rows.select("id", "unanswerable", "tags")


def _rate_sql(flag: str, of: str) -> str:
    return f"round(coalesce(count(*) filter ({flag} and {of}) / nullif(count(*) filter ({of}), 0)::double, 0), 9)"


@query(
    f"""with {_JUDGED} select strategy, {_rate_sql('first_relevant_rank = 1', 'not unanswerable')} as recall_at_1, {_rate_sql('first_relevant_rank between 1 and 5', 'not unanswerable')} as recall_at_5, {_rate_sql('first_relevant_rank between 1 and 10', 'not unanswerable')} as recall_at_10,
  round(coalesce(sum(1.0::double / first_relevant_rank) filter (not unanswerable and first_relevant_rank > 0) / nullif(count(*) filter (not unanswerable), 0), 0), 9) as mrr, {_rate_sql('citation_hit', 'not unanswerable')} as citation_hit_rate, {_rate_sql('answer_correct', 'not unanswerable')} as answer_accuracy,
  {_rate_sql('evidence_supported', 'not unanswerable')} as evidence_support_rate, {_rate_sql('correct_refusal', 'unanswerable')} as correct_refusal_rate, {_rate_sql('hallucination', 'true')} as hallucination_rate, sum(tokens)::bigint as total_tokens, round(avg(tokens), 9) as avg_tokens,
  round(sum(estimated_cost_usd), 6) as total_cost_usd, round(avg(retrieval_latency_ms), 9) as avg_retrieval_latency_ms, quantile_disc(retrieval_latency_ms, 0.95) as p95_retrieval_latency_ms, quantile_disc(end_to_end_latency_ms, 0.95) as p95_end_to_end_latency_ms from j group by 1"""
)
def answer_metrics(spark, sf_dir):
    m = evaluation.answer_metrics(*_judged(spark, sf_dir))
    return m.select(*(F.round(c, 6 if c == "total_cost_usd" else 9).alias(c) if kind == "double" else c for c, kind in m.dtypes))


@query(
    f"""with {_JUDGED}, s as (select *, error = '' and not hallucination and case when unanswerable then correct_refusal else answer_correct and evidence_supported end as success from j),
  g as (select format, count(*) as cases, count(*) filter (success) as succeeded, {_rate_sql('success', 'true')} as success_rate, {_rate_sql('answer_correct', 'not unanswerable')} as answer_accuracy, {_rate_sql('correct_refusal', 'unanswerable')} as correct_refusal_rate, {_rate_sql('hallucination', 'true')} as hallucination_rate from s group by 1)
  select ord, f.format, coalesce(cases, 0) as cases, coalesce(succeeded, 0) as succeeded, coalesce(success_rate, 0) as success_rate, coalesce(answer_accuracy, 0) as answer_accuracy, coalesce(correct_refusal_rate, 0) as correct_refusal_rate, coalesce(hallucination_rate, 0) as hallucination_rate
  from (values (0, 'pdf'), (1, 'docx'), (2, 'markdown'), (3, 'txt')) f(ord, format) left join g using (format)"""
)
def format_metrics(spark, sf_dir):
    m = evaluation.format_metrics(*_judged(spark, sf_dir)).drop("evidence_support_rate")
    return m.select(*(F.round(c, 9).alias(c) if kind == "double" else c for c, kind in m.dtypes))


@query(
    f"""with {_JUDGED}, s as (select *, error = '' and not hallucination and case when unanswerable then correct_refusal else answer_correct and evidence_supported end as success from j)
  select format, strategy, id, concat_ws('；', case when error <> '' then error end, case when unanswerable and not correct_refusal then '未正确拒答' end, case when not unanswerable and not answer_correct then '答案不正确' end, case when not unanswerable and not evidence_supported then '引用证据不支持' end, case when hallucination then '幻觉' end) as failure_reason
  from s where not success and format in ('pdf', 'docx', 'markdown', 'txt')"""
)
def format_failures(spark, sf_dir):
    return evaluation.format_failures(*_judged(spark, sf_dir))


_SQUEEZED = "translate({}, ' ' || chr(9) || chr(10) || chr(13) || '`', '')"


@query(
    f"""with e as (select doc_id as query_id, b.text as item, string_split(d.text, chr(10)) as ls from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark) where b.text is not null and d.text is not null),
  w as (select query_id, unnest([item, ls[len(ls)]]) as evidence, array_to_string(ls[1:100], '') as body from e)
  select distinct query_id, evidence from w where not contains({_SQUEEZED.format('body')}, {_SQUEEZED.format('evidence')})"""
)
def missing_evidence(spark, sf_dir):
    """A question for each document: whether it holds the whole benchmark item of its turn, and its own last line. A document is a source, its lines are the chunks."""
    d, b = table(spark, sf_dir, "documents").filter("text is not null"), table(spark, sf_dir, "benchmark")
    asked = d.select("doc_id", F.element_at(F.split("text", "\n", -1), -1).alias("last"), (F.col("doc_id") % b.count()).alias("item_id")).join(b.filter("text is not null").select("item_id", "text"), "item_id")
    q = asked.select(F.col("doc_id").alias("query_id"), F.array(F.col("doc_id").cast("string")).alias("expected_sources"), F.array("text", "last").alias("expected_evidence"))
    chunks = d.select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    return evidence.missing_evidence(q, chunks, 100)


@query("select distinct e.item_id as id, s.strategy from benchmark e, (values ('a'), ('b')) s(strategy) where not (e.item_id % 3 = 0 and s.strategy = 'a') ")
def pending_cases(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    wanted = b.withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    done = b.filter("id % 3 = 0").withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return evaluation.pending_cases(wanted, done, forced=("b",))


# conversations


@query(
    f"""with {MESSAGES_SQL}, h as (select *, list(struct_pack(role := role, status := status, content := content)) over (partition by conversation_id order by ord rows between 20 preceding and 1 preceding) as hist from messages),
  k as (select *, list_filter(coalesce(hist, []), lambda m: m.status = 'completed' and m.role in ('user', 'assistant')) as kept from h)
  select conversation_id, ord, len(coalesce(hist, []))::int as n_history, least(len(kept), 6)::int as n_recent, coalesce(kept[greatest(len(kept) - 5, 1)].content, '') as oldest, coalesce(kept[len(kept)].content, '') as newest from k"""
)
def conversation_history(spark, sf_dir):
    m = chat.with_history(messages(spark, sf_dir)).withColumn("recent", chat.recent_completed(F.col("history")))
    end = lambda i: F.coalesce(F.get("recent", i)["content"], F.lit(""))
    return m.select("conversation_id", "ord", F.size("history").alias("n_history"), F.size("recent").alias("n_recent"), end(F.lit(0)).alias("oldest"), end(F.size("recent") - 1).alias("newest"))


@query(
    f"""with {MESSAGES_SQL}, h as (select *, list(struct_pack(role := role, status := status, content := content)) over (partition by conversation_id order by ord rows between 20 preceding and 1 preceding) as hist from messages),
  k as (select *, list_filter(coalesce(hist, []), lambda m: m.status = 'completed' and m.role in ('user', 'assistant')) as kept from h),
  r as (select *, list_filter(kept[greatest(len(kept) - 5, 1):], lambda m: m.role = 'user' and trim(m.content) <> '') as users from k where role = 'user')
  select conversation_id, ord, case when regexp_matches(' ' || lower(content) || ' ', ' it | this | that | they | those | these ') and len(users) > 0 then trim(users[len(users)].content) || '；后续问题：' || content else content end as query,
    regexp_matches(' ' || lower(content) || ' ', ' it | this | that | they | those | these ') and len(users) > 0 as rewrite_applied, false as rewrite_fallback from r"""
)
def rewrite_queries(spark, sf_dir):
    m = chat.with_history(messages(spark, sf_dir)).filter("role = 'user'").withColumnRenamed("content", "question")
    return chat.rewrite_queries(m).select("conversation_id", "ord", "query", "rewrite_applied", "rewrite_fallback")


@query(
    f"""with {SPARSE_SQL}, t as (select s.query_id, s.chunk_id, s.rank, ceil(length(d.text) / 4.0) as tok from sparse s join documents d on chunk_id = doc_id),
  c as (select *, sum(tok) over (partition by query_id order by rank) as cum from t) select query_id, chunk_id, rank, row_number() over (partition by query_id order by rank)::int as number from c where rank = 1 or cum <= 2000"""
)
def limit_context(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    r = retrieval.few_hits(retrieval.sparse_topk(q, retrieval.over_all_cores(d), 20)).join(d.select("chunk_id", "content"), "chunk_id").withColumn("token_count", F.ceil(F.length("content") / 4))
    return chat.number_evidence(chat.limit_context(r, 2000)).select("query_id", "chunk_id", "rank", "number")


def _evidence(spark, sf_dir):
    q, d = questions(spark, sf_dir)
    none = F.lit(None).cast("int")
    r = retrieval.few_hits(retrieval.final_topk(retrieval.sparse_topk(q, retrieval.over_all_cores(d), 20), 5)).join(d.select("chunk_id", "document_id", "filename", "content"), "chunk_id")
    return q, chat.number_evidence(r).withColumns({"page_start": none, "page_end": none, "heading_path": F.lit(""), "chunk_index": F.col("rank") - 1})


@query(
    f"""with {SPARSE_SQL}, e as (select query_id, rank as number, doc_id, text as content from sparse join documents on chunk_id = doc_id where rank <= 5)
  select item_id as query_id, coalesce(n, 0) as n_evidence, coalesce(ev, '') || text as prompt, case when trim(coalesce(first, '')) <> '' then '根据知识库证据，' || trim(first) || ' [1]' else '当前知识库中没有足够信息。' end as answer from benchmark left join
  (select query_id, count(*) as n, string_agg('[' || number || '] file=doc-' || doc_id || ' location=paragraph/chunk ' || number || chr(10) || content || chr(10) || chr(10), '' order by number) as ev, max(content) filter (number = 1) as first from e group by 1) on item_id = query_id"""
)
def prompts_and_answers(spark, sf_dir):
    q, e = _evidence(spark, sf_dir)
    q = q.withColumn("history", F.array().cast("array<struct<role:string,status:string,content:string>>"))
    first = e.filter("number = 1").select("query_id", F.col("content").alias("first_evidence"))
    return chat.offline_answers(chat.build_prompts(q, e).join(first, "query_id", "left")).select("query_id", "n_evidence", "prompt", "answer")


@query(
    f"""with {SPARSE_SQL}, e as (select query_id, rank as number, chunk_id from sparse where rank <= 5), m as (select query_id, max(number) as most from e group by 1),
  a as (select query_id, unnest([query_id % 5 + 1, 2, 9]) as number, unnest([1, 2, 3]) as pos from m), u as (select query_id, number, min(pos) as pos from a join m using (query_id) where number <= most group by 1, 2)
  select query_id, (row_number() over (partition by query_id order by pos) - 1)::int as ord, number::int as number, chunk_id, 'doc-' || chunk_id as filename, 'paragraph/chunk ' || number as location from u join e using (query_id, number)"""
)
def resolve_citations(spark, sf_dir):
    q, e = _evidence(spark, sf_dir)
    answer = F.concat(F.lit("see ["), (F.col("query_id") % 5 + 1).cast("string"), F.lit("] and [2], not [9] or [x]"))
    return chat.resolve_citations(q.select("query_id", answer.alias("answer")), e).select("query_id", "ord", "number", "chunk_id", "filename", "location")


# governance


@query(
    f"""with {DOCUMENTS_SQL}, {KBS_SQL}, {JOBS_SQL}, {USAGE_SQL} select (select count(distinct user_id) from events) as users, (select count(*) from kbs where deleted_at is null) as active_kbs, (select count(*) from docs where deleted_at is null and status = 'ready') as ready_documents,
  (select count(*) from jobs where status = 'failed') as failed_jobs, count(*) as calls, round(count(*) filter (status = 'succeeded') / count(*)::double, 9) as success_rate, round(avg(latency_ms), 6) as avg_latency_ms, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(estimated_cost_usd)::double as cost_usd from usage"""
)
def governance_summary(spark, sf_dir):
    u = governance.usage_entries(usage(spark, sf_dir), PRICES)
    users = u.select("user_id").distinct()
    s = governance.governance_summary(users, knowledge_bases(spark, sf_dir), documents(spark, sf_dir), jobs(spark, sf_dir), u)
    return s.withColumns({"success_rate": F.round("success_rate", 9), "avg_latency_ms": F.round("avg_latency_ms", 6), "cost_usd": F.col("cost_usd").cast("double")})


@query(f"with {USAGE_SQL} select id, status, error_code, estimated_cost_usd::double as cost from usage")
def usage_entries(spark, sf_dir):
    return governance.usage_entries(usage(spark, sf_dir), PRICES).select("id", "status", "error_code", F.col("estimated_cost_usd").cast("double").alias("cost"))


@query(f"with {USAGE_SQL} select request_type, model, count(*) as calls, sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(text_count)::bigint as text_count, sum(estimated_cost_usd)::double as cost_usd, count(*) filter (status <> 'succeeded') as failed from usage group by 1, 2")
def provider_usage(spark, sf_dir):
    p = governance.provider_usage(governance.usage_entries(usage(spark, sf_dir), PRICES))
    return p.withColumn("cost_usd", F.col("cost_usd").cast("double"))


@query(
    f"""with {DOCUMENTS_SQL}, {KBS_SQL}, {PIECES_SQL}, c as (select document_id, index_version, count(*) as n from pieces group by 1, 2)
  select k.id as knowledge_base_id, count(d.id) as documents, coalesce(sum(case when d.status = 'ready' then c.n end), 0)::bigint as chunks from kbs k left join docs d on d.knowledge_base_id = k.id and d.deleted_at is null left join c on c.document_id = d.id and c.index_version = d.index_version where k.deleted_at is null group by 1"""
)
def kb_counts(spark, sf_dir):
    return governance.kb_counts(knowledge_bases(spark, sf_dir), documents(spark, sf_dir), pieces(spark, sf_dir))


@query(f"with {JOBS_SQL} select s.status, count(j.id) as n from (values ('pending'), ('running'), ('succeeded'), ('failed')) s(status) left join jobs j on j.status = s.status group by 1")
def job_status_counts(spark, sf_dir):
    return governance.job_status_counts(jobs(spark, sf_dir))


@query(
    f"""with {DOCUMENTS_SQL}, {JOBS_SQL}, a as (select knowledge_base_id, count(*) as documents, count(*) filter (status = 'ready') as ready, sum(chunk_count)::bigint as chunk_sum from docs where deleted_at is null group by 1),
  b as (select d.knowledge_base_id, count(*) as jobs_succeeded from docs d join jobs j on j.document_id = d.id and j.index_version = d.index_version and j.status = 'succeeded' where d.deleted_at is null group by 1),
  c as (select 'src' || label as knowledge_base_id, count(*) filter (len(embedding) = 64) as vectors from embeddings group by 1)
  select knowledge_base_id, documents, ready, chunk_sum, coalesce(jobs_succeeded, 0) as jobs_succeeded, coalesce(vectors, 0) as vectors, documents = ready and documents = coalesce(jobs_succeeded, 0) and chunk_sum = coalesce(vectors, 0) as consistent from a left join b using (knowledge_base_id) left join c using (knowledge_base_id)"""
)
def audit_index(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("knowledge_base_id"), "embedding")
    return governance.audit_index(documents(spark, sf_dir), jobs(spark, sf_dir), chunks, 64)


@query(
    f"""with {USAGE_SQL} select 'requests' as metric, request_type, model, status as label, count(*) as n from usage group by 2, 3, 4 union all select 'errors', request_type, model, error_code, count(*) from usage where status <> 'succeeded' group by 2, 3, 4
  union all select 'texts', request_type, model, null, sum(text_count)::bigint from usage where request_type = 'embedding' group by 2, 3"""
)
def model_counters(spark, sf_dir):
    return governance.model_counters(governance.usage_entries(usage(spark, sf_dir), PRICES))


@query("select event_type as method, 'route-' || (user_id % 5) as route, case when event_type = 'error' then 500 else 200 end as status, count(*) as n from events group by 1, 2, 3")
def http_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.concat(F.lit("route-"), (F.col("user_id") % 5).cast("string")).alias("route"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return governance.http_counters(e)


@query(
    f"""with {USAGE_SQL}, b as (select unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, null]::double[]) as le), t as (select request_type, latency_ms / 1000.0::double as s from usage)
  select request_type, le, count(*) filter (le is null or s <= le) as n, count(*) as total, round(sum(s), 6) as sum from t, b group by 1, 2"""
)
def latency_histogram(spark, sf_dir):
    h = governance.latency_histogram(usage(spark, sf_dir), ["request_type"], F.col("latency_ms") / 1000.0)
    return h.withColumn("sum", F.round("sum", 6))


@query(f"with {USAGE_SQL} select id, request_type, model, (select count(*) from usage where status = 'failed') as total from usage where status = 'failed' order by created_at desc, id limit 20 offset 40")
def page_of_usage(spark, sf_dir):
    u = governance.usage_entries(usage(spark, sf_dir), PRICES).filter("status = 'failed'")
    return governance.page_with_total(u, [F.desc("created_at"), "id"], 3).select("id", "request_type", "model", "total")


@query(
    """with u as (select distinct user_id from events) select 'user' as kind, user_id::varchar as id, case when user_id % 10 = 3 then 'disabled' else 'active' end as state from u
  union all select 'token', event_id::varchar, case when event_type = 'error' then 'old' when user_id % 10 = 3 then 'new' else 'open' end from events"""
)
def disable_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stamp = F.lit(None).cast("timestamp")
    users = e.select(F.col("user_id").cast("string").alias("id")).distinct().withColumns({"status": F.lit("active"), "updated_at": stamp})
    tokens = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.when(F.col("event_type") == "error", F.timestamp_seconds(F.lit(0))).alias("revoked_at"))
    u, t = governance.disable_users(users, tokens, users.filter("cast(id as int) % 10 = 3").select("id"), _now())
    state = F.when(F.col("revoked_at").isNull(), "open").when(F.col("revoked_at") == _now(), "new").otherwise("old")
    return u.select(F.lit("user").alias("kind"), "id", F.col("status").alias("state")).union(t.select(F.lit("token"), "id", state))


# lifecycle


@query(f"with {DOCUMENTS_SQL}, {JOBS_SQL}, l as (select document_id, max(struct_pack(a := created_at, b := id, c := status)) as j from jobs group by 1) select d.id, l.j.b as job_id, l.j.c as job_status from docs d left join l on l.document_id = d.id")
def documents_with_latest_job(spark, sf_dir):
    return lifecycle.documents_with_latest_job(documents(spark, sf_dir), jobs(spark, sf_dir)).select("id", "job_id", "job_status")


def _index_messages(spark, sf_dir):
    """A message for each job, owners wrong for every 8th, and every message twice."""
    j = jobs(spark, sf_dir)
    d = documents(spark, sf_dir).select(F.col("id").alias("document_id"), (F.length("knowledge_base_id") % 3).alias("o"))
    owner = F.concat(F.lit("owner-"), F.when(F.col("id").cast("int") % 8 == 0, 9).otherwise(F.col("o")).cast("string"))
    m = j.join(d, "document_id").select(F.lit("document.index").alias("type"), F.col("id").alias("job_id"), "document_id", owner.alias("owner_id"), "index_version")
    return m.union(m)


@query(
    f"""with {DOCUMENTS_SQL}, {KBS_SQL}, {JOBS_SQL} select j.id as job_id, j.document_id, j.index_version, case when j.id::int % 8 <> 0 and d.index_version = j.index_version and d.deleted_at is null and k.deleted_at is null then case when j.status = 'pending' and d.status = 'queued' then 'claimed' else 'duplicate' end else 'not_claimable' end as outcome
  from jobs j join docs d on d.id = j.document_id join kbs k on k.id = d.knowledge_base_id"""
)
def claim_jobs(spark, sf_dir):
    return lifecycle.claim_jobs(_index_messages(spark, sf_dir), jobs(spark, sf_dir), documents(spark, sf_dir), knowledge_bases(spark, sf_dir))


def _deletes(spark, sf_dir, kind: str):
    d = documents(spark, sf_dir)
    owner = F.concat(F.lit("owner-"), (F.length("knowledge_base_id") % 3).cast("string"))
    if kind == "document.delete":
        m = d.filter("doc_id % 10 < 2").select(F.col("id").alias("document_id"), F.when(d.doc_id % 10 == 1, "owner-9").otherwise(owner).alias("owner_id"), F.lit(None).cast("string").alias("knowledge_base_id"))
    else:
        m = d.filter("knowledge_base_id in ('src2', 'src11')").select(F.lit(None).cast("string").alias("document_id"), owner.alias("owner_id"), "knowledge_base_id").distinct()
    return m.withColumn("type", F.lit(kind))


def _summary(out: dict):
    d = out["documents"].groupBy("status").agg(F.count("*").alias("n"), F.sum("chunk_count").cast("long").alias("s")).select(F.lit("documents").alias("kind"), F.col("status").alias("k"), "n", "s")
    c = out["chunks"].groupBy("knowledge_base_id").agg(F.count("*").alias("n")).select(F.lit("chunks"), "knowledge_base_id", "n", F.lit(0).cast("long"))
    j = out["jobs"].groupBy("status", F.coalesce("error_code", F.lit("")).alias("e")).agg(F.count("*").alias("n")).select(F.lit("jobs"), F.concat_ws("/", "status", "e"), "n", F.lit(0).cast("long"))
    return d.union(c).union(j)


def _full_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).withColumns({"stage": F.lit("queued"), "error_code": F.lit(None).cast("string")})


def _delete_sql(gone: str, code: str) -> str:
    return f"""with {DOCUMENTS_SQL}, {PIECES_SQL}, {JOBS_SQL}, gone as (select id from docs where {gone})
  select 'documents' as kind, case when id in (from gone) then 'deleting' else status end as k, count(*) as n, sum(case when id in (from gone) then 0 else chunk_count end)::bigint as s from docs group by 2
  union all select 'chunks', knowledge_base_id, count(*), 0 from pieces where document_id not in (from gone) group by 2
  union all select 'jobs', case when document_id in (from gone) and status in ('pending', 'running') then 'failed/{code}' else status || '/' end, count(*), 0 from jobs group by 2"""


@query(_delete_sql("doc_id % 10 = 0", "DOCUMENT_DELETED"))
def apply_document_deletes(spark, sf_dir):
    d, k = documents(spark, sf_dir), knowledge_bases(spark, sf_dir)
    return _summary(lifecycle.apply_document_deletes(_deletes(spark, sf_dir, "document.delete"), d, k, pieces(spark, sf_dir), _full_jobs(spark, sf_dir), _now()))


@query(_delete_sql("knowledge_base_id in ('src2', 'src11')", "KNOWLEDGE_BASE_DELETED"))
def apply_kb_deletes(spark, sf_dir):
    d, k = documents(spark, sf_dir), knowledge_bases(spark, sf_dir)
    return _summary(lifecycle.apply_kb_deletes(_deletes(spark, sf_dir, "knowledge_base.delete"), d, k, pieces(spark, sf_dir), _full_jobs(spark, sf_dir), _now()))


@query(f"with {DOCUMENTS_SQL} select id, object_key from docs where knowledge_base_id in ('src2', 'src11')")
def deletion_object_keys(spark, sf_dir):
    kbs = _deletes(spark, sf_dir, "knowledge_base.delete").select(F.col("knowledge_base_id").alias("id"))
    return lifecycle.deletion_object_keys(documents(spark, sf_dir), kb_ids=kbs)



@query(
    """select event_id as id, case when event_type = 'signup' or (event_type in ('click', 'view') and (event_id % 6 = 0 or user_id % 6 = 0)) then 'INVALID_MESSAGE' end as error_code from events"""
)
def validate_messages(spark, sf_dir):
    h = F.sha2(F.col("event_id").cast("string"), 256)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    kind = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") == "click", "document.delete").when(F.col("event_type") == "view", "knowledge_base.delete").otherwise("other")
    target = F.when(F.col("user_id") % 6 == 0, "42").otherwise(uuid)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("type"), F.when(F.col("event_id") % 6 == 0, "me").otherwise(uuid).alias("owner_id"), target.alias("document_id"), target.alias("knowledge_base_id"))
    return lifecycle.validate_messages(e).select("id", "error_code")


@query(
    f"""with {DOCUMENTS_SQL}, c as (select doc_id, len(string_split(text, chr(10))) as n from documents where doc_id % 6 <> 0)
  select d.id as document_id, case when d.doc_id % 6 = 0 or d.doc_id % 8 = 1 then 0 else n end::int as chunk_count, case when d.doc_id % 6 = 0 or d.doc_id % 8 = 1 then 'failed' else 'ready' end as status,
  case when d.doc_id % 8 = 1 then case when d.doc_id % 3 = 0 then 'EMPTY_DOCUMENT' else 'EMBEDDING_TIMEOUT' end end as error_code, case when d.doc_id % 8 = 1 then d.doc_id % 3 <> 0 end as retryable from docs d left join c using (doc_id)"""
)
def document_outcomes(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("document_id", F.col("id"))
    chunks = d.filter("doc_id % 6 <> 0").select("document_id", F.explode(F.split("text", "\n", -1)))
    errors = d.filter("doc_id % 8 = 1").select("document_id", F.when(F.col("doc_id") % 3 == 0, "EMPTY_DOCUMENT").otherwise("EMBEDDING_TIMEOUT").alias("error_code"))
    return lifecycle.document_outcomes(d, chunks, errors)


@query(
    f"""with {DOCUMENTS_SQL} select id, status = 'failed' and doc_id % 2 = 0 as retryable, case when status = 'failed' and doc_id % 2 = 0 then 'queued' else status end as new_document_status, case when status = 'failed' and doc_id % 2 = 0 then 'pending' when doc_id % 2 = 0 then 'failed' else 'running' end as new_job_status
  from docs"""
)
def prepare_retries(spark, sf_dir):
    d = documents(spark, sf_dir)
    j = d.select(F.col("id").alias("document_id"), "index_version", F.when(d.doc_id % 2 == 0, "failed").otherwise("running").alias("status"))
    return lifecycle.prepare_retries(d, j, d.select("id")).select("id", "retryable", "new_document_status", "new_job_status")


@query(
    """with n as (select count(*) as n from documents), e as (select (event_id % n)::varchar as job_id, event_id as seq, case event_id // n % 4 when 0 then 'parsing' when 1 then 'chunking' when 2 then 'embedding' else 'completed' end as stage, case when event_type = 'error' then 'E' end as error_code from events, n),
  f as (select job_id, max_by(coalesce(error_code, ''), seq) as err, max_by(stage, seq) filter (error_code is null) as stage from e where job_id::int % 3 <> 0 group by 1)
  select job_id, case when err <> '' then 'failed' when coalesce(stage, 'parsing') = 'completed' then 'succeeded' else 'running' end as status, coalesce(stage, 'parsing') as stage, case coalesce(stage, 'parsing') when 'parsing' then 10 when 'chunking' then 35 when 'embedding' then 55 else 100 end as progress, nullif(err, '') as error_code from f"""
)
def fold_job_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i, n = F.col("event_id"), table(spark, sf_dir, "documents").count()
    turn = F.floor(i / n) % 4
    events = e.select((i % n).cast("string").alias("job_id"), F.lit(1).alias("index_version"), i.alias("seq"), F.when(turn == 0, "parsing").when(turn == 1, "chunking").when(turn == 2, "embedding").otherwise("completed").alias("stage"), F.when(F.col("event_type") == "error", "E").alias("error_code"))
    js = events.select(F.col("job_id").alias("id"), "index_version", F.lit("parsing").alias("stage"), F.when(F.col("job_id").cast("int") % 3 == 0, "pending").otherwise("running").alias("status")).distinct()
    return lifecycle.fold_job_events(events, js)


# limits


_RATE_SQL = """with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f as (select event_id, user_id, rn, us, us as opened, 1 as n from e where rn = 1 union all select e.event_id, e.user_id, e.rn, e.us, case when e.us >= f.opened + 86400000000 then e.us else f.opened end, case when e.us >= f.opened + 86400000000 then 1 else f.n + 1 end from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
  select event_id, n as hit_no, n <= 3 as allowed, ((opened + 86400000000 - us) // 1000)::bigint as retry_after_ms from f"""


@query(_RATE_SQL)
def rate_limit_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.rate_limit_replay(e, "user_id", "ts", 3, 86_400).select("event_id", "hit_no", "allowed", "retry_after_ms")


@query(_RATE_SQL)
def rate_limit_replay_spread(spark, sf_dir):
    """As rate_limit_replay, with every key as if it were hot."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.rate_limit_replay(e, "user_id", "ts", 3, 86_400, hot_rows=0).select("event_id", "hit_no", "allowed", "retry_after_ms")


_LOCK_SQL = """with recursive e as (select event_id, user_id, epoch_us(ts) as us, event_type = 'purchase' as ok, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  f as (select event_id, user_id, rn, us, ok, 0 as before, false as blocked, case when ok then 0 else 1 end as n, us as opened from e where rn = 1
  union all select e.event_id, e.user_id, e.rn, e.us, e.ok, case when f.n > 0 and e.us >= f.opened + 345600000000 then 0 else f.n end, case when f.n > 0 and e.us >= f.opened + 345600000000 then 0 else f.n end >= 4,
    case when case when f.n > 0 and e.us >= f.opened + 345600000000 then 0 else f.n end >= 4 then f.n when e.ok then 0 else case when f.n > 0 and e.us >= f.opened + 345600000000 then 0 else f.n end + 1 end,
    case when case when f.n > 0 and e.us >= f.opened + 345600000000 then 0 else f.n end = 0 then e.us else f.opened end from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
  select event_id, before as failures, blocked from f"""


@query(_LOCK_SQL)
def login_lock_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("success"))
    return limits.login_lock_replay(e, limit=4, window_s=345_600).select("event_id", "failures", "blocked")


@query(_LOCK_SQL)
def login_lock_replay_spread(spark, sf_dir):
    """As login_lock_replay, with every key as if it were hot."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("success"))
    return limits.login_lock_replay(e, limit=4, window_s=345_600, hot_rows=0).select("event_id", "failures", "blocked")


@query("select user_id from events group by 1 having count(*) > 60")
def denied_keys(spark, sf_dir):
    return limits.denied_keys(table(spark, sf_dir, "events"), "user_id", 60)

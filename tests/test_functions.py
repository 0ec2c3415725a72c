import uuid

from pyspark.sql import functions as F

from corpusloom import functions as fn


def one(spark, column, value=""):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_clean_and_split(spark):
    messy = " one\t  two\x00\r\n\n\n three ​\n"
    assert one(spark, fn.clean_text, messy) == "one two\n\nthree"
    assert [tuple(p) for p in one(spark, fn.split_paragraphs, messy)] == [(1, "one two"), (2, "three")]
    assert one(spark, fn.clean_text, "\x00\n\t") == "" and one(spark, fn.clean_text, None) is None


def test_headings(spark):
    assert tuple(one(spark, fn.markdown_heading, "  ## Title ")) == (2, "Title")
    assert one(spark, fn.markdown_heading, "#nope") is None and one(spark, fn.markdown_heading, "####### x") is None


def test_terms(spark):
    assert one(spark, fn.search_terms, "Abc 数据库 é1") == ["abc", "数", "据", "库", "1", "数据", "据库"]
    assert one(spark, fn.primary_terms, "a 数据") == ["a", "数据"] and one(spark, fn.fallback_terms, "a 数据") == ["数", "据"]
    assert one(spark, fn.sparse_query_terms, "?!") == [] and one(spark, fn.lexical_tokens, "Été 数据x Été") == ["été", "数", "据", "x"]


def test_token_estimates(spark):
    for text, want in (("", (1, 1, 0)), ("abc", (1, 1, 1)), ("abcde", (2, 1, 1)), ("x" * 9, (3, 2, 2))):
        assert tuple(one(spark, lambda c, r=r: fn.estimate_tokens(c, r), text) for r in ("ingest", "usage", "chat")) == want


def test_citations(spark):
    found = one(spark, lambda c: fn.filter_citations(c, F.lit(2)), "a [1] b [9] c [x] [2] [1] [99999999999] [open")
    assert tuple(found) == ("a [1] b  c [x] [2] [1]  [open", [1, 2])


def test_stable_id(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, lambda c: fn.stable_id(c, ns), "naïve name") == str(uuid.uuid5(uuid.UUID(ns), "naïve name"))


def test_small_functions(spark):
    assert one(spark, lambda c: fn.split_fixed(c, 3), "abcde\nfg") == ["abc", "de\n", "fg"]
    assert one(spark, fn.looks_like_follow_up, "what about it ") and not one(spark, fn.looks_like_follow_up, "what about items")
    assert one(spark, fn.normalize_evidence, "a `b`\n\tc") == "abc" and len(one(spark, fn.key_digest, "x")) == 24
    verdict = one(spark, fn.extract_verdict, 'so: {"answer_correct": true, "hallucination": false} ok')
    assert verdict.answer_correct is True and one(spark, fn.extract_verdict, "no json") is None and one(spark, fn.extract_verdict, "{broken}") is None
    assert one(spark, lambda c: fn.location(F.lit(3), F.lit(4), c, F.lit(0))) == "pages 3-4" and one(spark, lambda c: fn.location(F.lit(None).cast("int"), F.lit(None).cast("int"), c, F.lit(0))) == "paragraph/chunk 1"


def test_costs(spark):
    p = fn.costs.Pricing(2, 4, 1, 3)
    row = spark.range(1).select(fn.chat_cost(F.lit(1_000_000), F.lit(500_000), p).alias("a"), fn.embedding_cost(F.lit(2_000_000), p).alias("b"), fn.rerank_cost(F.lit(1_000_000), p).alias("c")).first()
    assert tuple(row) == (4, 2, 3)

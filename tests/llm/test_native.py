"""Quality rules, line dedup and URL filters: small cases, and plans without Python."""

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linededup, quality, urlfilter


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_counts(spark):
    good = "the cat and the dog of a house " * 2
    rows = [(1, None), (2, ""), (3, "a b\na b\n\n \nb $|"), (4, " ".join(["x1 x2 x3 x4 x5 x6 x7 x8 y"] * 2)), (5, good + " ".join(f"word{i} and" for i in range(20))), (6, "a b c d e f g h " * 3)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, kept string")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert (out[1].n_words, out[1].base_failed, out[1].kept) == (0, True, False) and out[2].n_words == 0
    assert (out[3].n_words, out[3].word_chars, out[3].n_symbols, out[3].n_dup_lines) == (6, 7, 2, 1)
    assert out[4].n_repeat_words == 18 and out[6].n_repeat_words == 24
    assert out[5].kept and not out[5].base_failed
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [5]
    assert "Python" not in plan(kept) and "Exchange" not in plan(kept)


def test_rules_of_an_empty_table(spark):
    assert quality.keep_good(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boilerplate_lines(spark):
    rows = [(i, "s", f"menu\nline {i}\n\nmenu\nend") for i in range(9)] + [(9, "s", None), (10, None, "menu"), (11, None, "menu\nother"), (11, None, "menu\nother"), (None, "s", "menu\nx")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, source string, text string, _key string")
    out = linededup.drop_boilerplate(df, ratio=0.5)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == df.columns and out.count() == len(rows)
    assert got == {(i, f"line {i}\n") for i in range(9)} | {(9, None), (10, ""), (11, "other"), (None, "x")}
    assert "Python" not in plan(out)
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://a.example.net/de/x", "a.example.net", "/de/x", "net/", "block"),
        ("HTTPS://EXAMPLE.net/en/", "example.net", "/en/", "example.net/en/", "allow"),
        ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://b.example.com/de/?q", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.org/fr/a#b", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://x.net?y/z", "x.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "own"), (2, url, "own")], "page_id long, url string, rule string")
    out = urlfilter.url_verdicts(df, urlfilter.rules_table(spark)).collect()
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in sorted(out, key=lambda r: r.page_id)] == [(i, host, path, rule, verdict) for i in (1, 2)]


def test_rule_order(spark):
    rules = urlfilter.rules_table(spark, [("a.b", "/x", "allow"), ("b", "/xyz", "block"), ("c", "/", "allow"), ("c", "/", "block"), ("", "/", "block"), ("d", None, "block")])
    df = spark.createDataFrame([(1, "http://a.b/xyz"), (2, "http://c/"), (3, "http:///"), (4, "http://d")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_verdicts(df, rules).collect()}
    assert out == {1: ("a.b/x", "allow"), 2: ("c/", "block"), 3: (None, "allow"), 4: ("d", "block")}
    assert urlfilter.url_verdicts(df, rules.limit(0)).count() == 4


@pytest.mark.parametrize("few,hot", [(100_000, 100_000), (0, 100_000), (0, 3)])
def test_urls_with_broadcast_and_shuffled_rules(spark, few, hot):
    """All three ways of the join give the same, for hosts and paths of any length."""
    long_host, long_path = ".".join(["label"] * 200) + ".example.net", "/en/" + "x" * 50_000
    urls = [f"http://h{i}.example.net/en/{i}" for i in range(40)] + [f"http://h{i}.com/de/" for i in range(40)] + [f"http://{long_host}{long_path}", "http://" + "a" * 50_000, None, "", "http://example.com/de/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = urlfilter.rules_table(spark, [*urlfilter.DEFAULT_RULES, *((f"h{i}.com", "/de/", "block") for i in range(20))])
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.url_verdicts(df, rules, broadcast_rules=few, hot=hot).collect()}
    assert [got[i] for i in range(40)] == [("example.net/en/", "allow")] * 40
    assert [got[40 + i] for i in range(40)] == [(f"h{i}.com/de/", "block") if i < 20 else (None, "allow") for i in range(40)]
    assert [got[i] for i in range(80, 85)] == [("example.net/en/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block")]


def test_urls_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.url_verdicts(df, urlfilter.rules_table(spark)).collect() == []


def test_urls_meet_rules_by_the_short_prefix_alone(spark):
    """The join's only key is the number of 32 bits; the digests are compared after it."""
    asked = spark.createDataFrame([("h", "/p", "aa", 7), ("h", "/p", "bb", 7)], "host string, path string, digest string, short long")
    known = spark.createDataFrame([(7, "aa", "rule")], "short long, full string, found string")
    met = urlfilter._met(asked, known, 10, 10)
    best = met.groupBy("host", "path").agg(F.max(F.when(F.col("digest") == F.col("full"), F.col("found"))).alias("best"))
    join = next(line for line in plan(best).splitlines() if "Join" in line)
    assert "short" in join and "digest" not in join and "full" not in join
    assert met.count() == 2 and best.first().best == "rule"

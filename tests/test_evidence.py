"""An automaton finds the evidences that a search of each one finds."""

import random

import pytest

from corpusloom.operators import evidence

QUESTIONS = "query_id long, expected_sources array<string>, expected_evidence array<string>"
CHUNKS = "source string, chunk_index int, content string, block int"


def squeezed(s):
    return "".join(ch for ch in s if ch not in " \n\r\t`")


def by_search(questions, chunks, most_chunks):
    out = set()
    for i, sources, wanted in questions:
        for e in wanted or []:
            bodies = ["".join(squeezed(t or "") for _, t in sorted((n, t or "") for s, n, t, _ in chunks if s == source and n < most_chunks)) for source in sources or [] if any(s == source and n < most_chunks for s, n, *_ in chunks)]
            if e is None or not any(squeezed(e) in b for b in bodies):
                out.add((i, e))
    return out


@pytest.mark.parametrize("seed,most", [(1, 200_000), (2, 12), (3, 1)])
def test_same_rows_as_a_search_of_each(spark, seed, most):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("aab b`\n数") for _ in range(n))
    chunks = [(f"s{rng.randrange(6)}", i % 9, text(rng.randrange(12)) if i % 11 else None, 7) for i in range(60)]
    chunks += [("hot", i, text(30), 7) for i in range(60)]
    questions = [(i, rng.sample(["s0", "s1", "s2", "s3", "hot", "none", None], rng.randrange(1, 4)), [text(rng.randrange(1, 9)) for _ in range(4)]) for i in range(60)]
    questions += [(100, ["s0"], [None, "", " `"]), (101, [], ["a"]), (102, None, ["a"]), (103, ["s0"], None), (104, ["none"], [" "]), (105, [None], ["a"])]
    df = evidence.missing_evidence(spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(chunks, CHUNKS), 5, most)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_search(questions, chunks, 5)


def test_evidence_across_chunks_and_overlaps():
    assert evidence.occurring(["abab", "bab", "cd", "x"], ["ab", "", "a", "bc", "d"]) == {"abab", "bab", "cd"}


def test_empty_tables(spark):
    q, c = spark.createDataFrame([(1, ["s"], ["a"])], QUESTIONS), spark.createDataFrame([("s", 0, "a", 1)], CHUNKS)
    assert evidence.missing_evidence(q.limit(0), c).collect() == []
    assert [tuple(r) for r in evidence.missing_evidence(q, c.limit(0)).collect()] == [(1, "a")]


def test_evidences_of_one_source_are_dealt_over_blocks(spark):
    patterns = spark.range(1000).selectExpr("'hot' as source", "concat('evidence ', id) as pattern")
    sizes = [r["count"] for r in evidence.in_blocks(patterns, 1000).groupBy("block").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 200

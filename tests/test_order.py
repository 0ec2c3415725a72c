"""Row numbers and ranks without a task that holds all rows."""

import random

from pyspark.sql import functions as F

from corpusloom.operators.order import nearest_ranks, numbered
from corpusloom.sources import answer_report_markdown, report_json


def test_numbers_follow_the_order_over_many_tasks(spark):
    rng = random.Random(1)
    values = [(rng.randrange(300), f"r{i}") for i in range(5000)]
    df = spark.createDataFrame(values, "k int, name string").repartition(7)
    out = numbered(df, ["k", F.desc("name")], "line_no")
    assert [(r.k, r.name) for r in out.orderBy("line_no").collect()] == sorted(sorted(values, key=lambda r: r[1], reverse=True), key=lambda r: r[0])
    assert sorted(r.line_no for r in out.collect()) == list(range(1, 5001))
    assert numbered(df.limit(0), ["k"], "line_no").collect() == []


def test_ranks_are_those_of_percentile_disc(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 60), float(rng.randrange(3)), None]), rng.randrange(10)) for _ in range(4000)]
    rows += [("one", 5.0, 1), ("none", None, 2), ("same", 7.5, 3), ("same", 7.5, 3), ("wide", -1.7e308, 0), ("wide", 1.7e308, 0), ("wide", 0.0, 0), ("near", 1.0, 0), ("near", 1.0000000000000002, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(5)
    for p in (0.5, 0.95, 0.01, 1.0):
        want = df.groupBy("g").agg(*(F.expr(f"percentile_disc({p}) within group (order by {c})").cast("double").alias(c) for c in ("v", "w")))
        got = nearest_ranks(df, ["g"], ["v", "w"], p)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert nearest_ranks(df, [], ["w"], 0.5).first().w == sorted(r[2] for r in rows)[(len(rows) + 1) // 2 - 1]
    assert nearest_ranks(df.limit(0), ["g"], ["v"], 0.5).collect() == []


def test_answer_report_with_many_failures(spark):
    names = "strategy recall_at_10 mrr answer_accuracy correct_refusal_rate hallucination_rate avg_tokens total_cost_usd".split()
    metrics = spark.createDataFrame([(0, "dense", *[0.5] * 7)], ["ord", *names])
    formats = spark.createDataFrame([(0, "pdf", 2, 1, *[0.5] * 3)], "ord int, format string, cases long, succeeded long, success_rate double, answer_accuracy double, hallucination_rate double")
    failures = spark.createDataFrame([("dense", f"q{i:05d}", "wrong") for i in range(3000)], "strategy string, id string, failure_reason string").repartition(6)
    usage = spark.createDataFrame([("chat", "m", 1, 2, 3, 4, 0)], "request_type string, model string, calls long, prompt_tokens long, completion_tokens long, text_count long, failed long")
    report = answer_report_markdown(metrics, formats, failures, usage)
    lines = [r.line for r in report.orderBy("line_no").collect()]
    at = lines.index("- dense, q00000: wrong")
    assert lines[at : at + 3000] == [f"- dense, q{i:05d}: wrong" for i in range(3000)] and lines[0].startswith("# ") and lines[-1] == "| chat | m | 1 | 2 | 3 | 4 | 0 |"
    assert "SinglePartition" not in report._jdf.queryExecution().executedPlan().toString()
    assert report_json(metrics).first().value.startswith('{"answer_accuracy":0.5')

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs without white space.  All counts come from the whole text; no
user function and no shuffle is involved.  Repeated 8-word windows are found by
64-bit hashes within one text, sorted there, and only in texts whose window hashes aren't all distinct.

Defined cases: a very long text is taken whole, as one row of a task; null and empty texts have no words, fail the base rule and are
not kept; ratios of an empty text are 0; repeated rows are judged row by row;
other columns pass through, and one that has the name of a result column is replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with by on are this he at be or an"
    " der die das und den von zu mit im ein eine ist des auf für als dem sich nicht"
    " le la les de des et un une du en est que qui pour par dans sur au ne pas plus se il elle"
    " el los las y con del al lo por su no es como más para"
).split()


class Rule(NamedTuple):
    """numerator / denominator must lie in [least, most]; None leaves a side open."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: Calibrated on labelled documents: prose has no symbols and over 0.1 stop words a word.
RULES = (
    Rule("words", "n_words", None, 20, None),
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_counts(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with the counts that rules refer to, as long."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: _without(x, SPACES + " ") != "")
    df = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    hashes = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice("_words", i, window)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_hashes", hashes)
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform(
        F.filter("_sorted", lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    )
    covered = F.aggregate(
        F.array_sort(at),
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    counts = {
        "n_words": n,
        "word_chars": F.length(_without(text, SPACES + " ")),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size(F.split(text, "\n", -1)),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_words", "_lines", "_hashes", "_sorted")


def passes(rules=RULES) -> Column:
    """One boolean expression for a table of rules over the counts."""
    out = F.lit(True)
    for r in rules:
        value = F.col(r.numerator).cast("double")
        if r.denominator:
            value = F.coalesce(value / F.nullif(F.col(r.denominator).cast("double"), F.lit(0.0)), F.lit(0.0))
        if r.least is not None:
            out &= value >= r.least
        if r.most is not None:
            out &= value <= r.most
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with counts, base_failed and kept."""
    return with_counts(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes(rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep; columns as given."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    # a row number holds the filter above the counts; pushed below, it would repeat their expressions in itself many times over
    judged = judge(docs.withColumnsRenamed(names), names[text_col], rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_row") >= 0)).select(*(F.col(v).alias(k) for k, v in names.items()))


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
COUNTS_SQL = rf"""
w0 as (select *, row_number() over () as rn, coalesce(text, '') as t from {{docs}}),
w1 as (select *, list_filter(string_split(translate(t, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') as ws,
  string_split(t, chr(10)) as ls from w0),
w2 as (select *, list_filter(ls, lambda x: translate(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ', '') <> '') as wl from w1),
wins as (select rn, i, array_to_string(list_slice(ws, i, i + 7), ' ') as x from (select rn, ws, unnest(range(1, len(ws) - 6)) as i from w1 where len(ws) >= 8)),
rep as (select rn, i from (select rn, i, count(*) over (partition by rn, x) as c from wins) where c > 1),
cov as (select rn, count(distinct p) as n from (select rn, unnest(range(i, i + 8)) as p from rep) group by rn),
counts as (select w2.* exclude (t, ws, ls, wl), len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(wl) - len(list_distinct(wl)))::bigint as n_dup_lines,
  coalesce(cov.n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: lower(x) in ({_LIST})))::bigint as n_stop_words, len(ls)::bigint as n_lines
  from w2 left join cov using (rn)),
judged as (select * exclude (rn), n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and word_chars / n_words::double between 2.5 and 12.0
  and n_symbols / n_words::double <= 0.25 and n_stop_words / n_words::double >= 0.05 and n_dup_lines / n_lines::double <= 0.5 as kept from counts)"""

REPORT_SQL = "with " + COUNTS_SQL.format(docs="documents") + " select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, false) as kept from judged"

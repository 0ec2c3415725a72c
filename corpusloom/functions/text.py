"""Text functions, Column to Column, of built-in expressions only. Null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space apart from the line feed.
SPACE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000&&[^\n]]"
#: Words that mark a question as following up on an earlier one (fixed values).
FOLLOW_UP = ("它", "这个", "这项", "这些", "上述", "其中", "该", " it ", " this ", " that ", " they ", " those ", " these ")
VERDICT = "answer_correct boolean, evidence_supported boolean, correct_refusal boolean, hallucination boolean, rationale string"


def clean_text(c: Column) -> Column:
    """Line ends as \\n, no control or format characters, single spaces, trimmed lines, at most one blank line in a row."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    c = F.regexp_replace(c, f"{SPACE}+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return F.regexp_replace(c, r"\A[ \n]+|[ \n]+\z", "")


def split_paragraphs(c: Column) -> Column:
    """array<struct<number, content>> of cleaned text, split at blank lines and numbered from 1."""
    parts = F.filter(F.split(clean_text(c), "\n\n"), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct((i + 1).alias("number"), p.alias("content")))


def markdown_heading(c: Column) -> Column:
    """struct<level, title> of a line of one to six # and a space; else null."""
    line = F.trim(c)
    marks = F.regexp_extract(line, r"^(#{1,6}) (.*)$", 1)
    return F.when(marks != "", F.struct(F.length(marks).alias("level"), F.trim(F.regexp_extract(line, r"^(#{1,6}) (.*)$", 2)).alias("title")))


def search_terms(c: Column) -> Column:
    """Lower-case ASCII words, single CJK characters and bigrams of neighbours, with repeats."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # the search for bigrams stops at every character: only for texts that have one
    bigrams = F.when(low.rlike("[一-龥]{2}"), F.regexp_extract_all(low, F.lit("(?=([一-龥]{2}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+|[一-龥]"), F.lit(0)), bigrams)


def primary_terms(c: Column) -> Column:
    """Words and CJK bigrams."""
    return F.filter(search_terms(c), lambda t: (F.length(t) > 1) | t.rlike("^[a-z0-9]$"))


def fallback_terms(c: Column) -> Column:
    """Single CJK characters."""
    return F.filter(search_terms(c), lambda t: t.rlike("^[一-龥]$"))


def sparse_query_terms(c: Column) -> Column:
    """The distinct terms that a lexical query is the OR of; empty matches nothing."""
    return F.array_distinct(search_terms(c))


def lexical_tokens(c: Column) -> Column:
    """Distinct tokens: each Han character, and runs of other letters or digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0)))


def token_overlap(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document has; 0 for an empty query. Both sides are distinct token arrays."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, document)) / F.size(query)).otherwise(0.0)


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def estimate_tokens(c: Column, rule: str = "ingest") -> Column:
    """ingest: characters / 4 rounded up; usage: rounded down; both 1 at least. chat: as usage, but 0 for the empty text."""
    n = F.length(c)
    if rule == "ingest":
        return F.greatest(F.ceil(n / 4), F.lit(1)).cast("int")
    down = F.greatest(F.floor(n / 4), F.lit(1)).cast("int")
    if rule == "usage":
        return down
    if rule == "chat":
        return F.when(n == 0, 0).otherwise(down)
    raise ValueError(f"unknown rule {rule!r}")


def location(page_start: Column, page_end: Column, heading_path: Column, chunk_index: Column) -> Column:
    """Where a chunk is, for people."""
    return (
        F.when(page_start.isNotNull() & (page_end.isNull() | (page_end == page_start)), F.format_string("page %d", page_start))
        .when(page_start.isNotNull(), F.format_string("pages %d-%d", page_start, page_end))
        .when(F.coalesce(heading_path, F.lit("")) != "", heading_path)
        .otherwise(F.format_string("paragraph/chunk %d", chunk_index + 1))
    )


def filter_citations(text: Column, most: Column) -> Column:
    """struct<text, numbers>: markers [n] outside 1..most removed, and the numbers kept in order of first use."""
    parts = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\])|([^\[]+|\[)"), F.lit(0))
    number = lambda p: F.regexp_extract(p, r"^\[([0-9]+)\]$", 1)
    inside = lambda p: F.coalesce(number(p).try_cast("int").between(1, most), F.lit(False))
    kept = F.filter(parts, lambda p: (number(p) == "") | inside(p))
    numbers = F.transform(F.filter(kept, lambda p: number(p) != ""), lambda p: number(p).cast("int"))
    return F.when(text.isNotNull(), F.struct(F.array_join(kept, "").alias("text"), F.array_distinct(numbers).alias("numbers")))


def split_fixed(c: Column, width: int = 32) -> Column:
    """Pieces of `width` characters."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{int(width)}}}"), F.lit(0))


def looks_like_follow_up(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(c), F.lit(" ")).rlike("|".join(FOLLOW_UP))


def normalize_evidence(c: Column) -> Column:
    return F.translate(c, " \n\r\t`", "")


def extract_verdict(c: Column) -> Column:
    """The struct in the text from the first { to the last }; null where there is none or it doesn't parse."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    found = F.from_json(body, VERDICT)
    return F.when((body != "") & F.coalesce(found["answer_correct"], found["evidence_supported"], found["correct_refusal"], found["hallucination"]).isNotNull(), found)

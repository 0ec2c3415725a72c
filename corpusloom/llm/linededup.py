"""Line dedup by site-relative frequency.

For each host (or source) the share of its pages that hold a line is the number
of pages with the line over the number of pages.  Lines above the ratio are
boilerplate of the site and dropped from its pages.

Pages are counted by a map-side aggregation keyed on (host, line hash), so a hot
host or line costs one partial row for each task.  The boilerplate lines of a
host number at most its lines a page over the ratio; they go back to the pages
by a join on (host, line) that is salted on the page's side.

Defined cases: a very long text is taken whole, as one row of a task; a null host is a host of its own; null texts stay null and count as
pages; lines without a word are never dropped; lines are compared whole; repeats
of a line in a page count once but all go; every row is a page, and rows that repeat a doc_id lose the lines that any of them loses;
a line on fewer than `min_holders` pages of its host stays, whatever the size of the host; columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import SPACES
from .storage import NO_ID, with_marks, written

SALTS = 16
#: Over a tenth of a site's pages, and three pages at least: two copies of a page make no boilerplate.
RATIO, MIN_HOLDERS = 0.1, 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _has_word(line: Column) -> Column:
    return F.translate(line, SPACES + " ", "") != ""


def boilerplate_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, ratio: float, min_holders: int) -> tuple[DataFrame, DataFrame]:
    """((key, host, lines) of all pages, (host, line) of the boilerplate); lines as 64-bit hashes, hosts never null."""
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("none"))
    hashed = F.array_distinct(F.transform(F.filter(_lines(text_col), _has_word), lambda x: F.xxhash64(x)))
    pages = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), host.alias("host"), hashed.alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    found = lines.filter(F.col("n") >= min_holders).join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return pages, found.select("host", "line")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_holders: int = MIN_HOLDERS) -> DataFrame:
    """docs without the boilerplate lines of their site; columns as given."""
    pages, found = boilerplate_lines(docs, id_col, text_col, host_col, ratio, min_holders)
    spread = written(found, "boilerplate").withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    own = pages.select("key", "host", F.explode("lines").alias("line")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    marks = own.join(spread, ["host", "line", "salt"], "left_semi").groupBy("key").agg(F.collect_set("line").alias("_gone"))
    marks = written(marks.withColumnRenamed("key", "_key"), "marks")
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.withColumnsRenamed(names).withColumn("_key", F.coalesce(F.col(names[id_col]).cast("long"), F.lit(NO_ID)))
    text = names[text_col]
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(x)) | ~_has_word(x))
    cleaned = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    marked = with_marks(named, marks, "_key", marks.count()).withColumn(text, cleaned)
    return marked.select(*(F.col(v).alias(k) for k, v in names.items()))


def line_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines_kept and the SHA-256 of the text that is left (null for null)."""
    out = drop_boilerplate(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", F.size(_lines("text")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


_BLANK = "translate(x, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ', '') = ''"
CLEAN_SQL = f"""
p as (select *, row_number() over () as rn, coalesce('h' || source, 'none') as host, string_split(text, chr(10)) as ls from {{docs}}),
tot as (select host, count(*) as pages from p group by host),
ln as (select host, x, count(*) as n from (select host, unnest(list_distinct(ls)) as x from p) where not ({_BLANK}) group by host, x),
bp as (select host, list(x) as xs from ln join tot using (host) where n >= {MIN_HOLDERS} and n > {RATIO} * pages group by host),
clean as (select p.* exclude (rn, host, ls, text), case when xs is null then text else array_to_string(list_filter(ls, lambda x: not list_contains(xs, x)), chr(10)) end as text
  from p left join bp using (host))"""

REPORT_SQL = (
    "with "
    + CLEAN_SQL.format(docs="documents")
    + " select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, length(text)::bigint as n_chars_kept, sha256(text) as kept_sha256 from clean"
)

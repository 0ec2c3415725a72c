"""Documents to source blocks: plain text by built-in functions, Markdown and DOCX by small helpers per document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_paragraphs
from ..schemas import BLOCK

BLOCKS = f"array<{BLOCK}>"
#: Documents that a task parses before it hands their blocks on.
DOCUMENTS = 128
PARSED = f"document_id string, blocks {BLOCKS}, error_code string"
_SPACES = re.compile("[^\\S\n]+")
_CONTROL = regex.compile(r"[\p{Cc}\p{Cf}--[\n\t]]", regex.V1)


def clean(text: str) -> str:
    """The same as functions.text.clean_text, for helpers that hold a document."""
    text = re.sub("\r\n?", "\n", text)
    text = _CONTROL.sub("", text)
    text = re.sub(" ?\n ?", "\n", _SPACES.sub(" ", text))
    return re.sub("\n{3,}", "\n\n", text).strip(" \n")


def _block(content: str, number: int, path: str, **metadata) -> dict:
    return {"content": content, "page_start": None, "page_end": None, "para_from": number, "para_to": number, "heading_path": path, "metadata": {"paragraph_start": str(number), "paragraph_end": str(number)} | {k: str(v) for k, v in metadata.items()}}


class _Headings:
    def __init__(self):
        self.titles: list[str] = []

    def put(self, level: int, title: str) -> None:
        self.titles = (self.titles + [""] * level)[: level - 1] + [title]

    def path(self, all_levels: bool = False) -> str:
        return " > ".join(t for t in self.titles if t or all_levels)


def markdown_blocks(text: str) -> list[dict]:
    """Headings and blank-line paragraphs, numbered together; a paragraph's path joins all heading levels, a heading's only named ones."""
    blocks, headings, open_ = [], _Headings(), []

    def close():
        content = clean("\n".join(open_))
        open_.clear()
        if content:
            blocks.append(_block(content, len(blocks) + 1, headings.path(all_levels=True), source_type="markdown"))

    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        if found := re.match(r"(#{1,6}) (.*)$", line):
            close()
            level, title = len(found[1]), found[2].strip()
            headings.put(level, title)
            blocks.append(_block(title, len(blocks) + 1, headings.path(), heading_level=level, source_type="markdown"))
        elif not line:
            close()
        else:
            open_.append(raw)
    close()
    return blocks


def _heading_level(style: str) -> int:
    style = style.strip().lower().replace(" ", "")
    if style == "title":
        return 1
    found = re.fullmatch(r"(?:heading)?([1-6])", style)
    return int(found[1]) if found else 0


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs with heading paths by style, and each table as one block of tab-separated lines. Raises ValueError on a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("word/document.xml") as f:
            events = list(ElementTree.iterparse(f, ("start", "end")))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("not a DOCX document") from e
    blocks, headings, number = [], _Headings(), 0
    paragraph, table, style, tables, paragraphs = [], [], "", 0, 0
    for event, node in events:
        tag = node.tag.rpartition("}")[2]
        if event == "start":
            if tag == "tbl":
                tables += 1
            elif tag == "p":
                paragraphs, style = paragraphs + 1, ""
                paragraph.clear()
            elif tag in ("tab", "br") and (tables or paragraphs):
                (table if tables else paragraph).append(" ")
            continue
        if tag == "pStyle":
            style = next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == "val"), "")
        elif tag == "t" and (tables or paragraphs):
            (table if tables else paragraph).append(node.text or "")
        elif tag in ("tc", "tr") and tables:
            table.append("\t" if tag == "tc" else "\n")
        elif tag == "p":
            paragraphs, number = paragraphs - 1, number + 1
            text = "" if tables else clean("".join(paragraph))
            if text:
                level = _heading_level(style)
                if level:
                    headings.put(level, text)
                blocks.append(_block(text, number, headings.path(), source_type="docx", **({"heading_level": level} if level else {})))
        elif tag == "tbl":
            tables -= 1
            if not tables:
                text = clean("".join(table))
                table.clear()
                if text:
                    blocks.append(_block(text, number, headings.path(), source_type="docx", content_type="table"))
    return blocks


def _helper(one):
    text, number = pa.string(), pa.int32()
    kinds = {"page_start": number, "page_end": number, "para_from": number, "para_to": number, "metadata": pa.map_(text, text)}
    block = pa.struct([(c, kinds.get(c, text)) for c in ("content", "page_start", "page_end", "para_from", "para_to", "heading_path", "metadata")])
    schema = pa.schema([("document_id", text), ("blocks", pa.list_(block)), ("error_code", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), DOCUMENTS):  # few documents are objects at a time
                rows = []
                for x in batch.slice(a, DOCUMENTS).to_pylist():
                    try:
                        blocks = one(x["content"]) if x["content"] is not None else []
                        rows.append({"document_id": x["document_id"], "blocks": [b | {"metadata": list(b["metadata"].items())} for b in blocks], "error_code": None if blocks else "EMPTY_DOCUMENT"})
                    except ValueError:
                        rows.append({"document_id": x["document_id"], "blocks": None, "error_code": "DOCUMENT_PARSE_FAILED"})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def parse_text(df: DataFrame) -> DataFrame:
    """(document_id, content string) -> (document_id, blocks, error_code)."""
    blocks = F.transform(
        split_paragraphs(F.coalesce("content", F.lit(""))),
        lambda p: F.struct(
            p["content"].alias("content"),
            F.lit(None).cast("int").alias("page_start"),
            F.lit(None).cast("int").alias("page_end"),
            p["number"].alias("para_from"),
            p["number"].alias("para_to"),
            F.lit("").alias("heading_path"),
            F.create_map(F.lit("paragraph_start"), p["number"].cast("string"), F.lit("paragraph_end"), p["number"].cast("string")).alias("metadata"),
        ),
    )
    return df.select(F.col("document_id").cast("string").alias("document_id"), blocks.alias("blocks")).withColumn("error_code", F.when(F.size("blocks") == 0, "EMPTY_DOCUMENT"))


def parse_markdown(df: DataFrame) -> DataFrame:
    """(document_id, content string) -> (document_id, blocks, error_code)."""
    return df.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(_helper(markdown_blocks), PARSED)


def parse_docx(df: DataFrame) -> DataFrame:
    """(document_id, content binary) -> (document_id, blocks, error_code)."""
    return df.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(_helper(docx_blocks), PARSED)


def parse_documents(df: DataFrame) -> DataFrame:
    """(document_id, filename, content binary) -> (document_id, blocks, error_code), by the extension of the filename."""
    extension = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    df = df.withColumn("_extension", extension)
    as_text = lambda d: d.withColumn("content", F.decode("content", "UTF-8"))
    known = (".txt", ".md", ".markdown", ".docx")
    other = df.filter(~F.col("_extension").isin(*known)).select(F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast(BLOCKS).alias("blocks"), F.lit("UNSUPPORTED_DOCUMENT_TYPE").alias("error_code"))
    return (
        parse_text(as_text(df.filter("_extension = '.txt'")))
        .unionByName(parse_markdown(as_text(df.filter("_extension in ('.md', '.markdown')"))))
        .unionByName(parse_docx(df.filter("_extension = '.docx'")))
        .unionByName(other)
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """(document_id, page, text) of text that an extractor read from PDF pages -> (document_id, blocks, error_code)."""
    from ..functions.text import clean_text

    none = F.lit(None).cast("int")
    text = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), clean_text(F.col("text")).alias("content"))
    found = F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("page", "content"))))
    # blocks are made of sorted rows: their maps have no order

    def block(p):
        number = p["page"].cast("string")
        return F.struct(
            p["content"].alias("content"),
            p["page"].alias("page_start"),
            p["page"].alias("page_end"),
            none.alias("para_from"),
            none.alias("para_to"),
            F.lit("").alias("heading_path"),
            F.create_map(F.lit("page_start"), number, F.lit("page_end"), number).alias("metadata"),
        )

    grouped = text.groupBy("document_id").agg(found.alias("found"))
    return grouped.select("document_id", F.transform("found", block).alias("blocks")).withColumn("error_code", F.when(F.size("blocks") == 0, "EMPTY_DOCUMENT"))

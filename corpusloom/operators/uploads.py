"""Validation and exact de-duplication of uploads."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE

MAX_BYTES = 30 * 1024 * 1024
# Canonical MIME types by extension, and what may be declared besides.
CANONICAL = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
}
ALSO_DECLARED = {".docx": ("application/zip",), ".md": ("text/plain",), ".markdown": ("text/plain",)}


def extension_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]*)$", 1))


def canonical_mime(extension: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv)), extension)


def mime_allowed(extension: Column, declared: Column) -> Column:
    """Whether a declared type fits; nothing declared fits, parameters after ; don't count."""
    kind = F.lower(F.trim(F.split(declared, ";", 2)[0]))
    out = F.coalesce(declared, F.lit("")).eqNullSafe("") | (kind == "application/octet-stream")
    for e, own in CANONICAL.items():
        out |= (extension == e) & kind.isin(own, *ALSO_DECLARED.get(e, ()))
    return F.coalesce(out, F.lit(False))


def invalid_filename(c: Column) -> Column:
    trimmed = F.regexp_replace(c, rf"\A(?:\n|{SPACE})+|(?:\n|{SPACE})+\z", "")
    return c.isNull() | (c == "") | (c != trimmed) | (F.length(c) > 255) | c.rlike(r"[/\\\p{Cc}]") | c.isin(".", "..")


def _is_docx(content: Column) -> Column:
    """Whether the bytes are an archive with the entries of a DOCX document."""

    def one(b):
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                return {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist())
        except zipfile.BadZipFile:
            return False

    @F.pandas_udf("boolean")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: b is not None and one(b)).astype(bool)

    return run(content)


def looks_like_text(content: Column) -> Column:
    """Judged by the first 512 bytes: no control bytes of binary files, and no start of HTML, XML, PDF, PostScript or an archive."""
    head = F.substring(content, 1, 512)
    code = F.hex(head)
    text = F.upper(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^[\t\n\f\r ]+", ""))
    markup = text.rlike(r"^<(!DOCTYPE HTML|HTML|HEAD|SCRIPT|IFRAME|H1|DIV|FONT|TABLE|A|STYLE|TITLE|B|BODY|BR|P|!--)[ >]") | text.startswith("<?XML")
    binary = code.rlike("^(..)*(0[0-8BEF]|1[0-9A]|1[C-F])") & ~code.rlike("^(FEFF|FFFE|EFBBBF)")
    # whole signatures: %PDF-, PK\3\4, %!PS-Adobe-, gzip, Rar!\x1a\7, GIF87a and GIF89a, PNG, JPEG; words may begin like them
    magic = code.rlike("^(255044462D|504B0304|252150532D41646F62652D|1F8B08|526172211A07|474946383[79]61|89504E470D0A1A0A|FFD8FF)")
    return ~(markup | binary | magic)


def validate_uploads(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(filename, declared_mime, content, ...) + extension, mime_type, sha256, reject_code (null: accepted). The first rule that fails names the code."""
    e = F.col("extension")
    df = df.withColumn("extension", extension_of(F.col("filename"))).withColumn("mime_type", canonical_mime(F.col("extension")))
    # only DOCX rows reach the helper
    docx = F.when(e == ".docx", _is_docx(F.when(e == ".docx", F.col("content")))).otherwise(False)
    fits = F.when(e == ".pdf", F.hex(F.substring("content", 1, 5)) == "255044462D").when(e == ".docx", docx).otherwise(looks_like_text(F.col("content")))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    code = (
        F.when(invalid_filename(F.col("filename")), "INVALID_FILENAME")
        .when(F.col("mime_type").isNull(), "UNSUPPORTED_FILE_EXTENSION")
        .when(~mime_allowed(e, F.col("declared_mime")), "INVALID_FILE_MIME")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(size == 0, "EMPTY_FILE")
        .when(~fits, "INVALID_FILE_CONTENT")
    )
    return df.withColumn("reject_code", code).withColumn("sha256", F.sha2("content", 256))


def dedupe_uploads(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming (document_id, knowledge_base_id, sha256, ...) + duplicate_of: an active document of the same content in existing
    (id, knowledge_base_id, sha256, deleted_at), else the first of the batch, else null.

    Only ids and hashes are shuffled for the search; popular contents are pre-aggregated.
    """
    key = ["knowledge_base_id", "sha256"]
    old = existing.filter("deleted_at is null").groupBy(*key).agg(F.min("id").alias("old_id"))
    first = incoming.groupBy(*key).agg(F.min("document_id").alias("first_id"))
    found = incoming.join(first.join(old, key, "left"), key, "left")
    out = F.coalesce("old_id", F.when(F.col("first_id") != F.col("document_id"), F.col("first_id")))
    return found.withColumn("duplicate_of", out).select(*incoming.columns, "duplicate_of")


def validate_kbs(df: DataFrame) -> DataFrame:
    """(id, owner_id, name, description, embedding_model, deleted_at) + error_code: blank or long fields, then a name taken by an earlier active row of the owner."""
    name, text, model = (F.trim(F.coalesce(c, F.lit(""))) for c in ("name", "description", "embedding_model"))
    active = F.col("deleted_at").isNull()
    at = F.row_number().over(Window.partitionBy("owner_id", F.lower(name), active).orderBy("id"))
    bad = ~F.length(name).between(1, 255) | (F.length(text) > 5000) | ~F.length(model).between(1, 255)
    return df.withColumn("error_code", F.when(bad, "VALIDATION_FAILED").when(active & (at > 1), "KNOWLEDGE_BASE_NAME_EXISTS"))

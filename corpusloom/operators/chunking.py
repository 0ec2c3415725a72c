"""Overlapping chunks that end at natural boundaries, and the indexing job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..sources.checkpoints import checkpointed
from .parsing import parse_documents

# Boundaries by preference.
BOUNDARIES = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Documents whose blocks a task holds as Python objects at a time.
DOCUMENTS = 128
CHUNK = "document_id string, chunk_index int, content string, token_count int, content_hash string, page_start int, page_end int, heading_path string, metadata map<string,string>, error_code string"


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks. A chunk that isn't the last ends after the best boundary in its second half."""
    out, start, n = [], 0, len(text)
    while True:
        while start < n and text[start] in SPACES:
            start += 1
        if start >= n:
            return out
        end = min(start + size, n)
        # the last chunk ends with the text; one that is exactly full looks for a boundary like the others
        if start + size <= n:
            low = start + size // 2
            for b in BOUNDARIES:
                at = text.rfind(b, low, end)
                if at >= 0:
                    end = at + len(b)
                    break
        stop = end
        while stop > start and text[stop - 1] in SPACES:
            stop -= 1
        out.append((start, stop if stop > start else end))
        if end >= n:
            return out
        again = end - overlap if end - overlap > start else end
        while again < end and text[again] in SPACES:
            again += 1
        start = again


def _chunks(document: str, blocks, size: int, overlap: int) -> list[dict]:
    parts, owners, kept = [], [], []
    for i, b in enumerate(blocks if blocks is not None else ()):
        text = (b["content"] or "").strip(SPACES)
        if not text:
            continue
        own = ("\n\n" if parts else "") + text  # the separator belongs to the block that follows
        parts.append(own)
        owners.append((sum(map(len, parts[-1:])) + (owners[-1][0] if owners else 0), i))
        kept.append(i)
    text = "".join(parts)
    rows, first = [], 0
    for number, (start, end) in enumerate(cuts(text, size, overlap)):
        while owners[first][0] <= start:
            first += 1
        last = first
        while owners[last][0] <= end - 1:
            last += 1
        span = [blocks[i] for i in range(owners[first][1], owners[last][1] + 1)]

        def least(key, how, span=span):
            found = [int(b[key]) for b in span if b[key] is not None and b[key] == b[key]]
            return how(found) if found else None

        pages, paragraphs = (least("page_start", min), least("page_end", max)), (least("para_from", min), least("para_to", max))
        metadata = {"source_block_start": owners[first][1], "source_block_end": owners[last][1]}
        metadata |= {"page_start": pages[0], "page_end": pages[1]} if pages[0] is not None else {}
        metadata |= {"paragraph_start": paragraphs[0], "paragraph_end": paragraphs[1]} if paragraphs[0] is not None else {}
        content = text[start:end]
        rows.append(
            {
                "document_id": document,
                "chunk_index": number,
                "content": content,
                "token_count": max(1, (len(content) + 3) // 4),
                "content_hash": hashlib.sha256(content.encode()).hexdigest(),
                "page_start": pages[0],
                "page_end": pages[1],
                "heading_path": next((b["heading_path"] for b in span if b["heading_path"]), ""),
                "metadata": {k: str(v) for k, v in metadata.items()},
                "error_code": None,
            }
        )
    return rows or [{"document_id": document, "error_code": "EMPTY_DOCUMENT"}]


def chunk_documents(df: DataFrame, chunk_size: int = 800, overlap: int = 120) -> DataFrame:
    """(document_id, blocks) -> chunks; a document without text gives one row with an error_code.

    Narrow: a document's chunks come from its own row, without a shuffle. Rows that come with an error_code keep it and have no chunks.
    """
    if chunk_size <= 0 or overlap < 0 or overlap >= chunk_size:
        raise ValueError(f"invalid chunk settings: size={chunk_size} overlap={overlap}")
    text, number = pa.string(), pa.int32()
    kinds = {"chunk_index": number, "token_count": number, "page_start": number, "page_end": number, "metadata": pa.map_(text, text)}
    schema = pa.schema([(c, kinds.get(c, text)) for c in (x.split()[0] for x in CHUNK.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), DOCUMENTS):  # Arrow's batch is compact, the objects made of it are not
                own = batch.slice(a, DOCUMENTS).to_pylist()
                rows = [r for x in own for r in ([{"document_id": x["document_id"], "error_code": x["error_code"]}] if x["error_code"] else _chunks(x["document_id"], x["blocks"], chunk_size, overlap))]
                yield pa.RecordBatch.from_pylist([r | {"metadata": list(r["metadata"].items()) if r.get("metadata") is not None else None} for r in rows], schema)

    error = F.col("error_code") if "error_code" in df.columns else F.lit(None)
    return df.select(F.col("document_id").cast("string").alias("document_id"), "blocks", error.cast("string").alias("error_code")).mapInArrow(run, CHUNK)


def index_corpus(files: DataFrame, chunk_size: int = 800, overlap: int = 120, dimension: int = 1024, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8", embedder=None) -> tuple[DataFrame, DataFrame]:
    """files (document_id, knowledge_base_id, filename, content, index_version) -> (chunks with embeddings, one outcome row per document).

    Parses and chunks once, by a job of its own; both tables go on from its rows in the checkpoint folder.
    """
    from .embedding import with_embeddings
    from .lifecycle import document_outcomes

    chunks = checkpointed(chunk_documents(parse_documents(files.select("document_id", "filename", "content")), chunk_size, overlap))
    good = chunks.filter("error_code is null").drop("error_code")
    keys = files.select(F.col("document_id").cast("string").alias("document_id"), "knowledge_base_id", "index_version")
    good = good.join(keys, "document_id").withColumn("id", stable_id(F.concat_ws(":", "document_id", "index_version", "chunk_index"), namespace))
    errors = chunks.filter("error_code is not null").select("document_id", "error_code")
    return with_embeddings(good, "content", dimension, embedder), document_outcomes(keys, good, errors)


def index_uploads(files: DataFrame, existing: DataFrame, max_bytes: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """files (document_id, knowledge_base_id, filename, declared_mime, content, index_version) and the documents there are (id, knowledge_base_id, sha256, deleted_at)
    -> (chunks, outcomes) as index_corpus, which gets the uploads that are valid and new.

    Rejected uploads have failed outcomes with their code; copies of an active document, or of an upload before them, have the status duplicate and duplicate_of.
    """
    from .uploads import MAX_BYTES, dedupe_uploads, validate_uploads

    checked = validate_uploads(files.withColumn("document_id", F.col("document_id").cast("string")), MAX_BYTES if max_bytes is None else max_bytes)
    accepted = checked.filter("reject_code is null")
    seen = checkpointed(dedupe_uploads(accepted.select("document_id", "knowledge_base_id", "sha256"), existing).select("document_id", "duplicate_of"))
    fresh = accepted.join(seen.filter("duplicate_of is null"), "document_id", "left_semi")
    chunks, outcomes = index_corpus(fresh.select("document_id", "knowledge_base_id", "filename", "content", "index_version"), **options)
    none = F.lit(None).cast("string")
    rejected = checked.filter("reject_code is not null").select("document_id", F.lit(0).alias("chunk_count"), F.lit("failed").alias("status"), F.col("reject_code").alias("error_code"), F.lit(False).alias("retryable"), none.alias("duplicate_of"))
    copies = seen.filter("duplicate_of is not null").select("document_id", F.lit(0).alias("chunk_count"), F.lit("duplicate").alias("status"), none.alias("error_code"), F.lit(None).cast("boolean").alias("retryable"), "duplicate_of")
    return chunks, outcomes.withColumn("duplicate_of", none).unionByName(rejected).unionByName(copies)

"""Hashes, keys and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def key_digest(c: Column) -> Column:
    """The first 12 bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(c, 256), 1, 24)


def stable_id(c: Column, namespace: str) -> Column:
    """UUID version 5 of a name under a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def object_key(owner: Column, kb: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), owner, kb, document)


def idempotency_key(document: Column, version: Column) -> Column:
    return F.concat_ws(":", document, version)

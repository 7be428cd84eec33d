"""Keys: page ids, object keys, content ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_id(document_id: Column, page_num: Column) -> Column:
    return F.concat_ws(":", document_id, page_num.cast("string"))


def filename_from_key(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def page_key(document_id: Column, page_num: Column) -> Column:
    return F.format_string("documents/%s/pages/page_%03d.png", document_id, page_num.cast("int"))


_PAGE_KEY = r"^documents/([^/]+)/pages/page_(\d+)\.png$"


def parse_page_key(key: Column) -> Column:
    """Struct (document_id, page_num); both null when the key has another layout."""
    hit = key.rlike(_PAGE_KEY)
    return F.struct(
        F.when(hit, F.regexp_extract(key, _PAGE_KEY, 1)).alias("document_id"),
        F.when(hit, F.regexp_extract(key, _PAGE_KEY, 2).try_cast("int")).alias("page_num"),
    )


def content_id(content: Column) -> Column:
    """sha256 hex of bytes or text."""
    return F.sha2(content, 256)


def surrogate_id(*key: Column) -> Column:
    """Stable 64-bit id of a natural key: the same on every run and every partitioning."""
    return F.xxhash64(*key)

"""Capture metadata: JSON, response headers, content ids, gzip."""

from __future__ import annotations

import gzip

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from webstrata.functions.rows import row_udf

DEFAULT_TYPE = "text/html; charset=utf-8"


def metadata_json(url: Column, html: Column, markdown_bytes: Column, crawled_at: Column, status: Column | None = None,
                  content_type: Column | None = None, etag: Column | None = None, last_modified: Column | None = None,
                  server: Column | None = None, asset_count: Column | None = None) -> Column:
    """One JSON object a capture, keys in a fixed order."""
    empty = F.lit("")
    return F.to_json(F.struct(
        url.alias("url"), (F.lit(200) if status is None else status).alias("status_code"),
        F.date_format(crawled_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("crawled_at"),
        (F.lit(DEFAULT_TYPE) if content_type is None else content_type).alias("content_type"),
        (empty if etag is None else etag).alias("etag"), (empty if last_modified is None else last_modified).alias("last_modified"),
        (empty if server is None else server).alias("server"), F.octet_length(html).alias("raw_bytes"),
        markdown_bytes.alias("markdown_bytes"), (F.lit(0) if asset_count is None else asset_count).alias("asset_count"),
    ))


def stored_etag(json: Column) -> Column:
    return F.get_json_object(json, "$.etag")


def response_parts(raw: Column) -> Column:
    """Struct of status, headers and body of a raw HTTP response (of the last one after redirects)."""
    head_end = r"(?s)\A((?:HTTP/.*?\r?\n\r?\n)+?)(?!HTTP/)"
    head = F.regexp_extract(raw, head_end, 1)
    last = F.regexp_extract(head, r"(?s)((?:.*\n\r?\n)?)(HTTP/.*?)\r?\n\r?\n\z", 2)
    last = F.when(last == "", head).otherwise(last)
    field = lambda name: F.substring(F.regexp_extract(last, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), 1, 127)
    return F.struct(
        F.coalesce(F.regexp_extract(last, r"HTTP/[0-9.]+ +([0-9]{3})", 1).try_cast("int"), F.lit(200)).alias("status_code"),
        field("content-type").alias("content_type"), field("etag").alias("etag"),
        field("last-modified").alias("last_modified"), field("server").alias("server"),
        F.substring(raw, F.length(head) + 1, F.length(raw) + 1).alias("body"),
    )


def blob_sha(data: Column, bits: int = 160) -> Column:
    """Content id of a blob: the hash of `blob <bytes>\\0` and the data."""
    header = F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.lit("\0"))
    framed = F.concat(header.cast("binary"), data.cast("binary"))
    return F.sha1(framed) if bits == 160 else F.sha2(framed, bits)


def compressed(text: str | bytes | None) -> bytes | None:
    return None if text is None else gzip.compress(text.encode() if isinstance(text, str) else text, 9, mtime=0)


def decompressed(data: bytes | None) -> bytes | None:
    return None if data is None else gzip.decompress(data)


gzip_bytes = row_udf(compressed, BinaryType())
gunzip_bytes = row_udf(decompressed, BinaryType())


def commit_message(url: Column, markdown_bytes: Column) -> Column:
    return F.format_string("archive: %s (%s bytes md)", url, markdown_bytes.cast("string"))

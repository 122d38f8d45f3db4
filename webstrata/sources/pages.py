"""Page and asset sources: tables, whole text files, binary files, and HTTP through a Python data source."""

from __future__ import annotations

import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

USER_AGENT = "webstrata/1.0"
STDIN_URL = "https://stdin.pipe/input.html"


def pages_from_text(spark: SparkSession, path: str, url: str = STDIN_URL) -> DataFrame:
    """One page a file, all under one URL, as when a document is piped in."""
    return spark.read.text(path, wholetext=True).select(F.lit(url).alias("url"), F.col("value").alias("html"))


def assets_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, data, len); empty files count as failed downloads."""
    files = spark.read.format("binaryFile").load(path)
    return files.where("length > 0").select(
        F.substring_index("path", "/", -1).alias("rel_path"), F.col("content").alias("data"), F.col("length").alias("len")
    )


class HttpPages(DataSource):
    """spark.read.format("http_pages").option("urls", "u1\\nu2"): one row a URL; a failed fetch has status_code 0."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, status_code int, content_type string, etag string, last_modified string, server string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.timeout = float(options.get("timeout", 60))
        self.etag = options.get("if_none_match")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        headers = {"User-Agent": USER_AGENT} | ({"If-None-Match": self.etag} if self.etag else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(partition.value, headers=headers), timeout=self.timeout) as r:
                h = r.headers
                fields = [h.get(k, "") for k in ("Content-Type", "ETag", "Last-Modified", "Server")]
                yield (partition.value, r.status, *fields, r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            yield (partition.value, e.code, "", "", "", "", e.read().decode("utf-8", "replace"))
        except OSError:
            yield (partition.value, 0, "", "", "", "", None)


class HttpRobots(DataSource):
    """spark.read.format("http_robots").option("sites", "https://a\\nhttp://b:81"): (host, body) of each site's robots.txt, whatever the
    status; a failed fetch has an empty body, which allows all."""

    @classmethod
    def name(cls) -> str:
        return "http_robots"

    def schema(self) -> str:
        return "host string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RobotsReader({"timeout": 30} | dict(self.options) | {"urls": self.options.get("sites", "")})


class _RobotsReader(_HttpReader):
    def read(self, partition: InputPartition):
        site = partition.value.rstrip("/")
        for row in super().read(InputPartition(f"{site}/robots.txt")):
            yield (site.split("://", 1)[-1].rsplit("@", 1)[-1].lower(), row[-1] or "")

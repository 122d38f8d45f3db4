import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_functions import MARKDOWN
from webstrata.functions.markdown import html_to_markdown, to_markdown
from webstrata.functions.metadata import compressed, decompressed, gunzip_bytes, gzip_bytes
from webstrata.functions.rows import PART_BYTES
from webstrata.operators import history, store

TEXTS = [f"<p>{n} {'word ' * 8_000}</p>" for n in range(200)] + [None]
PAIRS = [{"before": t, "after": (t or "").replace("word", "other", 1)} for t in TEXTS]


@pytest.mark.parametrize(("udf", "one", "values"), [
    (html_to_markdown, to_markdown, TEXTS), (gzip_bytes, compressed, TEXTS), (gunzip_bytes, decompressed, [compressed(t) for t in TEXTS]),
    (history._hunks, history.hunks, PAIRS), (store._texts, store.texts, [{"sanitized": t, "html": t} for t in TEXTS]),
])
def test_worker_holds_no_whole_batch(udf, one, values):
    batch, want = pa.array(values), [one(v) for v in values]
    tracemalloc.start()
    done = 0
    for part in udf.func(iter([batch, batch.slice(0, 3)])):
        assert part.to_pylist() == (want + want[:3])[done : done + len(part)]
        done += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == len(values) + 3 and peak < 6 * PART_BYTES, peak


def test_row_udfs_in_spark(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [*MARKDOWN, ("<p>😀 ж</p>", "😀 ж\n\n")]
        df = spark.createDataFrame(rows, "h string, w string").coalesce(1)
        got = df.select(html_to_markdown("h"), "w", F.decode(gunzip_bytes(gzip_bytes("h")), "utf-8"), "h", history.unified_hunks("h", "w")).collect()
        assert len(got) == len(rows) and all(r[0] == r[1] and r[2] == r[3] and r[4] is not None for r in got)
        assert df.where("false").select(html_to_markdown("h")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_archive_has_one_worker_a_task(spark):
    pages = spark.createDataFrame([("https://h/a", "<p>x</p><script>y</script>", 1), ("https://h/b", None, 2)], "url string, html string, commit_seq long")
    pages = pages.withColumn("committed_at", F.lit("2024-01-01").cast("timestamp"))
    apart, together = store.ingest(pages), store.ingest(pages, together=True)
    assert [df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") for df in (apart, together)] == [2, 1]
    assert together.schema == apart.schema and sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))

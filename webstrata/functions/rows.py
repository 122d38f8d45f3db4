"""Arrow UDFs that take values one by one and hand results on in small parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Results that a worker holds; the last of a part may exceed this.
PART_BYTES = 1 << 20


def _size(value: str | bytes | dict | None) -> int:
    return sum(map(_size, value.values())) if isinstance(value, dict) else len(value or "") + 8


def parts(batches: Iterator[pa.Array], f: Callable, kind: pa.DataType, size: int = PART_BYTES) -> Iterator[pa.Array]:
    """f of each value, in arrays of about `size` bytes. Of a batch, only the value at hand and one part's results are Python objects."""
    for batch in batches:
        held, n = [], 0
        for value in batch:
            held.append(f(value.as_py()))
            n += _size(held[-1])
            if n >= size:
                yield pa.array(held, kind)
                held, n = [], 0
        if held:
            yield pa.array(held, kind)


def row_udf(f: Callable, kind: DataType) -> Callable:
    """Arrow UDF of a function from one value to text or bytes, both may be None; structs of them are dicts.

    A worker holds Arrow batches as they come (Spark ends one at spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), but never
    a whole batch as Python objects or as results."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parts(batches, f, to_arrow_type(kind))

    run.__name__ = f.__name__
    return F.arrow_udf(run, kind)

"""Typo-tolerant similarity: best substring (or whole-string) edit distance with adjacent swaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pattern's bits must leave the sum of two masks inside a signed 64-bit number.
MAX_BITS = 62
SEARCH_THRESHOLD = 0.30


def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def similarity_span(pattern: str, text: str, swaps: bool = True, exact: bool = False) -> tuple[float, int, int]:
    """(score, first, last): dynamic programme over all cells, each with where its match began."""
    p, t = _fold(pattern), _fold(text)
    m = len(p)
    if not p or not t:
        return (1.0 if (not p if not exact else not p and not t) else 0.0), 0, max(len(t) - 1, 0) if exact else 0
    older: list[tuple[int, int]] = []
    prev = [(i, 0) for i in range(m + 1)]
    best, span = m, (0, 0)
    for j, c in enumerate(t):
        row = [((j + 1) if exact else 0, j)]
        for i in range(1, m + 1):
            diagonal, left, up = prev[i - 1][0] + (p[i - 1] != c), row[i - 1][0] + 1, prev[i][0] + 1
            d = min(diagonal, left, up)
            if d == diagonal:
                start = j if i == 1 else prev[i - 1][1]
            elif d == left:
                start = j if i == 1 else row[i - 1][1]
            else:
                start = prev[i][1]
            if swaps and j and i > 1 and p[i - 1] == t[j - 1] and p[i - 2] == c and older[i - 2][0] + 1 < d:
                d, start = older[i - 2][0] + 1, (j - 1 if i == 2 else older[i - 2][1])
            row.append((d, start))
        if row[m][0] < best or row[m][0] == best < m:
            best, span = row[m][0], (row[m][1], j)
        older, prev = prev, row
    if exact:
        longest = max(m, len(t))
        return 1.0 - prev[m][0] / longest if prev[m][0] < longest else 0.0, 0, len(t) - 1
    return (1.0 - best / m if best < m else 0.0), *span


def similarity(pattern: str, text: Column, swaps: bool = True, exact: bool = False) -> Column:
    """Score in the JVM by bit-parallel columns of the distance matrix; long patterns go to the Arrow UDF."""
    p = _fold(pattern)
    m = len(p)
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if m == 0:
        return F.when(text.isNull(), None).when(F.lit(exact) & (t != ""), 0.0).otherwise(1.0)
    if m > MAX_BITS:
        return similarity_udf(pattern, swaps, exact)(text)["score"]
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks = F.create_map(*(F.lit(x) for c in sorted(set(p)) for x in (c, sum(1 << k for k in range(m) if p[k] == c))))
    long = lambda v: F.lit(v).cast("long")
    low = lambda c: c.bitwiseAND(long(full))
    no = lambda c: low(F.bitwise_not(c))
    up = lambda c: low(F.shiftleft(c, 1))

    def step(s: Column, c: Column) -> Column:
        # Each stage is bound once by a one-element transform, so no expression is repeated.
        pm = F.coalesce(F.try_element_at(masks, c).cast("long"), long(0))
        swap = (lambda s, pm: up(no(s["d0"]).bitwiseAND(pm)).bitwiseAND(s["old"])) if swaps else (lambda s, pm: long(0))

        def with_pm(pm: Column) -> Column:
            d0 = low((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseOR(swap(s, pm)))
            return F.transform(F.array(d0), lambda d0: with_d0(pm, d0))[0]

        def with_d0(pm: Column, d0: Column) -> Column:
            hp = s["vn"].bitwiseOR(no(d0.bitwiseOR(s["vp"])))
            hn = d0.bitwiseAND(s["vp"])
            d = s["d"] + F.when(hp.bitwiseAND(long(top)) != 0, 1).when(hn.bitwiseAND(long(top)) != 0, -1).otherwise(0)
            hp1 = up(hp).bitwiseOR(long(1)) if exact else up(hp)
            return F.struct(
                up(hn).bitwiseOR(no(d0.bitwiseOR(hp1))).alias("vp"), hp1.bitwiseAND(d0).alias("vn"), d0.alias("d0"),
                pm.alias("old"), d.cast("int").alias("d"), F.least(s["best"], d).cast("int").alias("best"),
            )

        return F.transform(F.array(pm), with_pm)[0]

    start = F.struct(
        long(full).alias("vp"), long(0).alias("vn"), long(0).alias("d0"), long(0).alias("old"),
        F.lit(m).alias("d"), F.lit(m).alias("best"),
    )
    folded = F.aggregate(F.split(t, ""), start, step)
    if exact:
        longest = F.greatest(F.lit(m), F.length(t))
        score = F.when((t == "") | (folded["d"] >= longest), 0.0).otherwise(1 - folded["d"] / longest)
    else:
        score = F.when((t == "") | (folded["best"] >= m), 0.0).otherwise(1 - folded["best"] / m)
    return F.when(text.isNotNull(), score)


def match_score(pattern: str, text: Column) -> Column:
    """0 to 100, half rounded up."""
    return F.floor(similarity(pattern, text) * 100 + 0.5).cast("int")


def similarity_udf(pattern: str, swaps: bool = True, exact: bool = False):
    """Arrow UDF for spans and for patterns of any length: struct (score, mstart, mend)."""

    @F.pandas_udf("score double, mstart int, mend int")
    def run(text: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else similarity_span(pattern, t, swaps, exact) for t in text]
        return pd.DataFrame(rows, columns=["score", "mstart", "mend"])

    return run


def extract_field(text: Column, delimiter: str | None, k: int) -> Column:
    """k-th field, 1-based; None splits at runs of space and tab; k <= 0 gives all; a missing field is empty."""
    if k <= 0:
        return text
    if delimiter is None:
        parts = F.split(F.regexp_replace(text, "^[ \t]+|[ \t]+$", ""), "[ \t]+")
        return F.coalesce(F.try_element_at(parts, F.lit(k)), F.when(text.isNotNull(), ""))
    return F.split_part(text, F.lit(delimiter), F.lit(k))

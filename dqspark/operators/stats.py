"""Exact order statistics without gathering a column into one task.

``F.median`` / ``percentile`` keep every value of a group in one buffer: a global
median over a 100 TB column would sit in one task. Here two scans find each quantile:

1. one aggregate gives, per column, the count of present values, the finite minimum
   and maximum, the counts of -inf / +inf and, from a KLL sketch of fixed size, two values
   that enclose each wanted quantile (``WINDOW`` of the ranks to either side);
2. one exact scan counts the values below that window and groups those inside by value
   (``groupBy`` with map-side combine; about ``2 * WINDOW`` of the distinct values), kept as
   ``(target, value, count)``. Histogram refinement on the kept counts then finds the rank:
   per round at most ``buckets`` groups per target, the bucket holding the rank becomes the
   next range, a range that holds a single value settles it; no value is fetched.

The sketch only narrows: counts are exact, and a rank that its window misses is refined
over the whole column in the same way. Bucketing is monotone in the value, so ranges are
exact; no floating tolerance.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.scalar import is_float

POS_INF = float("inf")
NEG_INF = float("-inf")
SKETCH_K = 1024        # about 25 KB a column; rank error about 0.3 %
WINDOW = 0.01          # share of the ranks kept on either side of a wanted quantile


def value_of(df: DataFrame, name: str):
    f = df.schema[name]
    c = F.col(f"`{name}`").cast("double")
    if is_float(f.dataType):
        c = F.when(~F.isnan(c), c)
    return c


def range_aggs(v: Column, i: int | str, probs: list[float] = ()) -> list[Column]:
    """Aggregates of one column for ``range_of``: counts, finite range, infinities, sketch windows."""
    fin = F.when(~v.isin(POS_INF, NEG_INF), v)
    aggs = [F.count(v).alias(f"n{i}"), F.min(fin).alias(f"lo{i}"), F.max(fin).alias(f"hi{i}"),
            F.count_if(v == F.lit(NEG_INF)).alias(f"neg{i}"), F.count_if(v == F.lit(POS_INF)).alias(f"pos{i}")]
    for j, p in enumerate(probs):
        for side, rank in (("a", max(0.0, p - WINDOW)), ("b", min(1.0, p + WINDOW))):
            at = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v, SKETCH_K), F.lit(rank))
            aggs.append(F.when(F.count(v) > 0, at).alias(f"w{side}{j}_{i}"))
    return aggs


def range_of(row, i: int | str, probs: list[float] = ()) -> dict:
    """``n`` present values, finite ``lo``/``hi``, ``neg``/``pos`` infinities, ``windows`` by quantile."""
    return {"n": row[f"n{i}"], "lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "neg": row[f"neg{i}"], "pos": row[f"pos{i}"],
            "windows": {p: (row[f"wa{j}_{i}"], row[f"wb{j}_{i}"]) for j, p in enumerate(probs)}}


def column_ranges(df: DataFrame, probs: dict[str, list[float]]) -> dict[str, dict]:
    """``range_of`` every column of ``probs`` (column -> wanted quantiles) from one aggregate."""
    if not probs:
        return {}
    aggs = [a for i, (c, ps) in enumerate(probs.items()) for a in range_aggs(value_of(df, c), i, ps)]
    row = df.agg(*aggs).first()
    return {c: range_of(row, i, ps) for i, (c, ps) in enumerate(probs.items())}


def _refine(df: DataFrame, active: list[list], value, weight: Column, buckets: int) -> dict:
    """Settle ``[target, k, lo, hi, below]`` lists: the k-th smallest (0-based) of ``value(target)``,
    which lies in ``lo..hi`` with ``below`` values under ``lo``. A row counts ``weight`` times."""
    out = {}
    while True:
        for target, k, lo, hi, _ in active:
            if lo == hi:
                out[(target, k)] = lo
        active = [t for t in active if t[2] != t[3]]
        if not active:
            return out
        # one histogram job for every remaining target
        entries = []
        for ti, (target, _, lo, hi, _) in enumerate(active):
            v = value(target)
            half_lo, span = lo / 2.0, hi / 2.0 - lo / 2.0
            if span > 0:
                b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0),
                            F.floor((v / 2.0 - F.lit(half_lo)) / F.lit(span) * buckets).cast("int")))
            else:                     # neighbouring denormal numbers: halves are equal
                b = (v > lo).cast("int")
            entries.append(F.when((v >= lo) & (v <= hi),
                                  F.struct(F.lit(ti).alias("t"), b.alias("b"), v.alias("v"))))
        hist = (df.select(weight.alias("w"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
                .groupBy(F.col("e.t").alias("t"), F.col("e.b").alias("b"))
                .agg(F.sum("w").alias("c"), F.min("e.v").alias("mn"), F.max("e.v").alias("mx"))
                .collect())
        by_target: dict[int, list] = {}
        for r in hist:
            by_target.setdefault(r["t"], []).append((r["b"], r["c"], r["mn"], r["mx"]))
        for ti, t in enumerate(active):
            k, acc = t[1], t[4]
            for _, c, mn, mx in sorted(by_target.get(ti, [])):
                if k < acc + c:
                    t[2], t[3], t[4] = mn, mx, acc
                    break
                acc += c
            else:  # pragma: no cover - counts are consistent by construction
                raise RuntimeError("rank not found in histogram")


def _window_counts(df: DataFrame, windows: list[tuple[str, float, float]]) -> DataFrame:
    """``(t, v, c)``: copies of each value inside window ``t``, one row without value for those below it."""
    entries = []
    for i, (c, lo, hi) in enumerate(windows):
        v = value_of(df, c)
        below = F.struct(F.lit(i).alias("t"), F.lit(None).cast("double").alias("v"))
        entries.append(F.when(v < lo, below).when(v <= hi, F.struct(F.lit(i).alias("t"), v.alias("v"))))
    counts = (df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
              .groupBy(F.col("e.t").alias("t"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    return counts.persist(StorageLevel.MEMORY_AND_DISK)


def kth_values(df: DataFrame, targets: list[tuple], ranges: dict[str, dict],
               buckets: int = 4096) -> dict[tuple[str, int], float]:
    """Exact k-th smallest (0-based) present value for each ``(column, k)`` or ``(column, k, quantile)``;
    with the quantile, the search starts from its sketch window."""
    out: dict[tuple[str, int], float] = {}
    wide, narrow = [], {}
    for col, k, *p in dict.fromkeys(targets):
        r = ranges[col]
        if not 0 <= k < r["n"]:
            raise ValueError(f"rank {k} out of range for {col}")
        if k < r["neg"]:
            out[(col, k)] = NEG_INF
        elif k >= r["n"] - r["pos"]:
            out[(col, k)] = POS_INF
        elif r["lo"] == r["hi"]:
            out[(col, k)] = r["lo"]
        elif p and p[0] in r.get("windows", {}):
            lo, hi = r["windows"][p[0]]
            narrow.setdefault((col, max(lo, r["lo"]), min(hi, r["hi"])), []).append(k)
        else:
            wide.append([col, k, r["lo"], r["hi"], r["neg"]])
    if narrow:
        windows = list(narrow)
        counts = _window_counts(df, windows)
        found = {r["t"]: r for r in counts.groupBy("t").agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("inside"),
            F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        inside = []
        for t, window in enumerate(windows):
            col, w = window[0], found.get(t)
            for k in narrow[window]:
                if w and w["below"] <= k < w["below"] + w["inside"]:
                    inside.append([t, k, w["lo"], w["hi"], w["below"]])
                else:
                    wide.append([col, k, ranges[col]["lo"], ranges[col]["hi"], ranges[col]["neg"]])
        values = _refine(counts, inside, lambda t: F.when(F.col("t") == t, F.col("v")), F.col("c"), buckets)
        counts.unpersist()
        out.update({(windows[t][0], k): v for (t, k), v in values.items()})
    out.update(_refine(df, wide, lambda c: value_of(df, c), F.lit(1), buckets))
    return out


def quantiles(df: DataFrame, probs: dict[str, list[float]], ranges: dict[str, dict] | None = None,
              median_mean: bool = True, **kw) -> dict[tuple[str, float], float | None]:
    """Exact linearly interpolated quantiles (missing values ignored); None if no values.

    With ``median_mean`` the 0.5 quantile is the mean of the two middle values
    (``(a + b) / 2``), as a median is usually computed.
    """
    cols = list(probs)
    ranges = ranges if ranges is not None else column_ranges(df, probs)
    targets, plan = [], {}
    for c in cols:
        n = ranges[c]["n"]
        for p in probs[c]:
            if n == 0:
                plan[(c, p)] = None
                continue
            pos = p * (n - 1)
            k0, k1 = math.floor(pos), math.ceil(pos)
            plan[(c, p)] = (k0, k1, pos - k0)
            targets += [(c, k0, p), (c, k1, p)]
    vals = kth_values(df, targets, ranges, **kw) if targets else {}
    res = {}
    for (c, p), spec in plan.items():
        if spec is None:
            res[(c, p)] = None
            continue
        k0, k1, frac = spec
        a, b = vals[(c, k0)], vals[(c, k1)]
        if k0 == k1 or a == b:
            res[(c, p)] = a
        elif median_mean and p == 0.5:
            res[(c, p)] = (a + b) / 2.0
        else:
            res[(c, p)] = a + (b - a) * frac
    return res


def medians(df: DataFrame, columns: list[str], ranges: dict[str, dict] | None = None, **kw) -> dict[str, float | None]:
    q = quantiles(df, {c: [0.5] for c in columns}, ranges, **kw)
    return {c: q[(c, 0.5)] for c in columns}


def approx_quantiles(df: DataFrame, probs: dict[str, list[float]], accuracy: int = 10_000) -> dict:
    """``percentile_approx`` for every (column, p) in one aggregate (fixed-size sketches).

    Returns an actual value of the column within rank error ``n / accuracy``; the
    0.5 quantile is not the mean of the two middle values.
    """
    aggs, keys = [], []
    for c, ps in probs.items():
        for p in ps:
            aggs.append(F.percentile_approx(value_of(df, c), F.lit(p), accuracy).alias(f"q{len(keys)}"))
            keys.append((c, p))
    if not aggs:
        return {}
    row = df.agg(*aggs).first()
    return {k: row[f"q{i}"] for i, k in enumerate(keys)}

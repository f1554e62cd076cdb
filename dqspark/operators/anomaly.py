"""Anomaly flags with an isolation forest (M1-M7); MLlib has none.

Fit (M1), at most ``n_trees * max_samples`` rows ever leave the scan:

* every row gets a seeded 64-bit hash of its values; rows under a hash cut are
  the pool, and the ``n_trees * psi`` smallest hashes are kept (``orderBy.limit``
  on the pre-cut rows, a bounded top-k). Identical rows share a hash;
* the pool is repeated once per tree number (bounded) and each tree keeps the
  ``psi`` rows with the smallest ``xxhash64(tree, row)`` (a window group limit);
* ``groupBy(tree).applyInPandas`` grows the trees in parallel (random feature
  among the non-constant ones, uniform split, depth limit ``ceil(log2 psi)``),
  each tree seeded with ``seed + tree``. The result is a forest table
  ``(tree, node, feature, split, left, right, size, depth)``.

Score (M3): an Arrow scalar UDF gets only the feature array (the rest of the row
stays in the JVM) and walks all trees with numpy; score = ``2^(-E[h] / c(psi))``.
Flag (M4): a row is an anomaly when its negated score is strictly below the
exact interpolated ``contamination`` quantile of the negated scores (stats.py),
as the reference's library does on its training rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.scalar import is_inf, is_numeric
from dqspark.operators import stats
from dqspark.operators.quality import ANOMALY, FLAG_COLUMN, NORMAL
from dqspark.session import spread_for_cpu, staged

# Fixed values of the detector.
CONTAMINATION = 0.1
SEED = 42
N_TREES = 100
MAX_SAMPLES = 256
MIN_ROWS = 5                 # fewer rows: everything is Normal
EULER_GAMMA = 0.5772156649015329

FOREST_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType(), False), T.StructField("node", T.IntegerType(), False),
    T.StructField("feature", T.IntegerType(), False), T.StructField("split", T.DoubleType(), False),
    T.StructField("left", T.IntegerType(), False), T.StructField("right", T.IntegerType(), False),
    T.StructField("size", T.LongType(), False), T.StructField("depth", T.IntegerType(), False)])


def average_path_length(n):
    """c(n): mean path length of an unsuccessful search in a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = (FLAG_COLUMN,)) -> list[str]:
    """P1 (Q12): every numeric column, keys included."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def feature_values(cols: list[str]) -> list[Column]:
    """M2: numeric values as doubles, missing and +-inf as 0."""
    parts = []
    for c in cols:
        v = F.col(f"`{c}`").cast("double")
        parts.append(F.when(v.isNull() | F.isnan(v) | is_inf(v), F.lit(0.0)).otherwise(v))
    return parts


#: Copies of one row that are numbered by one task.
CHUNK = 65_536


# --------------------------------------------------------------------------- M1

def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, split, left, right, size, depth = [], [], [], [], [], []

    def node(idx, d):
        me = len(feat)
        feat.append(-1); split.append(0.0); left.append(-1); right.append(-1)
        size.append(len(idx)); depth.append(d)
        if d >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:
            return me
        f = int(candidates[rng.integers(candidates.size)])
        t = rng.uniform(lo[f], hi[f])
        if t >= hi[f]:
            t = lo[f]
        go_left = sub[:, f] <= t
        feat[me], split[me] = f, float(t)
        left[me] = node(idx[go_left], d + 1)
        right[me] = node(idx[~go_left], d + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, split, left, right, size, depth


def _grow_group(seed: int, max_depth: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["h", "u"], kind="mergesort")
        x = np.array(pdf["x"].tolist(), dtype=float)
        feat, split, left, right, size, depth = _grow(x, np.random.default_rng(seed + tree), max_depth)
        n = len(feat)
        return pd.DataFrame({"tree": np.full(n, tree, dtype="int32"), "node": np.arange(n, dtype="int32"),
                             "feature": np.array(feat, dtype="int32"), "split": np.array(split, dtype=float),
                             "left": np.array(left, dtype="int32"), "right": np.array(right, dtype="int32"),
                             "size": np.array(size, dtype="int64"), "depth": np.array(depth, dtype="int32")})
    return grow


def _draws(counted: DataFrame, seed: int) -> DataFrame:
    """(d1, d2, k, u): every copy of every row with its own uniform number.

    The copies of rows that repeat more than ``CHUNK`` times are dealt out in chunks.
    """
    numbered = lambda at, last: F.explode(F.sequence(at, last)).alias("k")
    few = counted.where(F.col("m") <= CHUNK).select("d1", "d2", numbered(F.lit(0).cast("long"), F.col("m") - 1))
    many = counted.where(F.col("m") > CHUNK).select(
        "d1", "d2", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    many = many.repartition("d1", "d2", "at").select("d1", "d2", numbered(F.col("at"), F.least(F.col("at") + (CHUNK - 1), F.col("m") - 1)))
    u = F.pmod(F.xxhash64(F.lit(seed), "d1", "d2", "k"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return few.unionByName(many).withColumn("u", u)


def fit_forest(df: DataFrame, cols: list[str], n_rows: int | None = None, n_trees: int = N_TREES,
               max_samples: int = MAX_SAMPLES, seed: int = SEED) -> tuple[DataFrame, int]:
    """M1: returns (forest table, psi).

    Every row draws its own number: equal rows are counted first, and each copy hashes its
    occurrence with the row's digest. So a row held by a third of the table makes up about a
    third of the sample, whatever its values, and the sample does not depend on the layout.
    Only digests are shuffled; the values of the drawn rows are read afterwards.
    """
    n = n_rows if n_rows is not None else df.count()
    psi = min(max_samples, n)
    want = min(n, n_trees * psi)
    x = F.array(*feature_values(cols))
    rows = df.select(x.alias("x")).select("x", F.xxhash64(F.lit(seed), "x").alias("d1"), F.xxhash64(F.lit(seed + 1), "x").alias("d2"))
    counted = staged(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("m")), "forest-rows")
    q = 1.0 if want >= n else min(1.0, (want + 8.0 * math.sqrt(want) + 64.0) / n)
    while True:
        pool = staged(_draws(counted, seed).where(F.col("u") < q).orderBy("u", "d1", "d2", "k").limit(want)
                      .select("d1", "d2", "u"), "forest-draws")
        if q >= 1.0 or pool.count() >= want:
            break
        q = min(1.0, q * 2.0)
    drawn = pool.select("d1", "d2").distinct()                      # at most trees x samples short rows
    values = rows.join(F.broadcast(drawn), ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(F.min("x").alias("x"))
    pool = staged(pool.join(values, ["d1", "d2"]).select("x", "u"), "forest-sample")
    # an explicit partition count: AQE would merge the small tree groups into one task
    parts = max(1, min(n_trees, 2 * df.sparkSession.sparkContext.defaultParallelism))
    per_tree = (pool.repartition(parts)
                .select("x", "u", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
                .withColumn("h", F.xxhash64(F.col("tree"), F.lit(seed), F.col("u"), F.col("x")))
                .repartition(parts, "tree")
                .withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("h", "u")))
                .where(F.col("k") <= psi)
                .select("tree", "h", "u", "x"))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    forest = per_tree.groupBy("tree").applyInPandas(_grow_group(seed, max_depth), FOREST_SCHEMA)
    return forest, psi


# --------------------------------------------------------------------------- M3

class Forest:
    """Forest arrays on the driver (bounded: trees x (2 psi - 1) nodes).

    Nodes are numbered level by level, so the right child stands next to the left one and a step
    is one number plus one comparison; a leaf is its own left child under an infinite split. Each
    node keeps its leaf value ``depth + c(size)`` ready. Rows are walked ``BLOCK`` at a time, feature by
    feature in one flat array, so that all a step touches stays in the cache.
    """

    BLOCK = 8192

    def __init__(self, forest: DataFrame | pd.DataFrame, psi: int):
        pdf = forest.toPandas() if isinstance(forest, DataFrame) else forest
        pdf = pdf.sort_values(["tree", "node"])
        self.psi = psi
        self.trees = []
        for _, g in pdf.groupby("tree", sort=True):
            leaf = g["depth"].to_numpy() + average_path_length(g["size"].to_numpy())
            self.trees.append((g["feature"].to_numpy().astype(np.int64), g["split"].to_numpy(),
                               g["left"].to_numpy().astype(np.int64), g["right"].to_numpy().astype(np.int64), leaf))
        self.max_depth = int(pdf["depth"].max()) if len(pdf) else 0
        self.walks = [self._by_level(*tree) for tree in self.trees]

    @staticmethod
    def _by_level(feat, split, left, right, leaf):
        """``(feature, split, left child, leaf value, steps)`` with siblings side by side."""
        order, at, ends = [0], 0, []
        first = np.zeros(len(feat), np.int64)
        while at < len(order):
            ends.append(len(order))
            for k in range(at, len(order)):
                node = order[k]
                if feat[node] >= 0:
                    first[k] = len(order)
                    order += [left[node], right[node]]
                else:
                    first[k] = k
            at = ends[-1]
        f = feat[order]
        return np.maximum(f, 0), np.where(f >= 0, split[order], np.inf), first, leaf[order], len(ends) - 1

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), self.BLOCK):
            out[at:at + self.BLOCK] = self._block_lengths(x[at:at + self.BLOCK])
        return out / max(len(self.trees), 1)

    def _block_lengths(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        flat = np.ascontiguousarray(x.T, dtype=float).ravel()
        rows = np.arange(n, dtype=np.int64)
        node, place, value, limit = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n)
        further, total = np.empty(n, bool), np.zeros(n)
        for feat, split, first, leaf, steps in self.walks:
            begin = feat * n
            node[:] = 0
            for _ in range(steps):
                np.take(begin, node, out=place, mode="clip")
                place += rows
                np.take(flat, place, out=value, mode="clip")
                np.take(split, node, out=limit, mode="clip")
                np.greater(value, limit, out=further)
                np.take(first, node, out=place, mode="clip")
                np.add(place, further, out=node)
            np.take(leaf, node, out=value, mode="clip")
            total += value
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        c = float(average_path_length([self.psi])[0]) or 1.0
        return np.power(2.0, -self.path_lengths(x) / c)


def score_column(forest: Forest, cols: list[str]) -> Column:
    """M3: anomaly score in (0, 1], higher is odder (Arrow UDF over one double column per feature)."""
    @F.pandas_udf(T.DoubleType())
    def _score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(x.to_numpy(float)) if len(x) else [], dtype="float64")
    return _score(F.struct(*[v.alias(f"f{i}") for i, v in enumerate(feature_values(cols))]))


def _tree_sql(tree: tuple, names: list[str]) -> str:
    """A tree as nested conditions over double columns, with its leaf values."""
    feat, split, left, right, leaf = tree

    def node(k: int) -> str:
        if feat[k] < 0:
            return f"{float(leaf[k])!r}D"
        return f"if({names[feat[k]]} <= {float(split[k])!r}D, {node(left[k])}, {node(right[k])})"
    return node(0)


def score_native(forest: Forest, cols: list[str], made: bool = False) -> Column:
    """M3 without Python workers: every tree as compiled conditions, leaf values added in tree order as
    ``Forest`` adds them.

    ``made``: the columns hold feature values already, as in ``with_native_score``, which large tables should use;
    else every condition makes its own. A row with a NaN among made values has no score (Spark orders NaN last, numpy
    does not). That check is a higher-order function, which also keeps the projection out of whole-stage
    code generation: Spark generates the trees in many methods on the executors, not in one that cannot be compiled.
    """
    def value(col: str) -> str:
        v = f"CAST(`{col}` AS DOUBLE)"
        return f"`{col}`" if made else f"(CASE WHEN {v} IS NULL OR isnan({v}) OR abs({v}) = double('Infinity') THEN 0D ELSE {v} END)"

    features = [value(c) for c in cols]
    total = F.lit(0.0)
    for tree in forest.trees:
        total = total + F.expr(_tree_sql(tree, features))
    c = float(average_path_length([forest.psi])[0]) or 1.0
    score = F.pow(F.lit(2.0), -(total / float(max(len(forest.trees), 1))) / c)
    return F.when(~F.exists(F.array(*[F.expr(f) for f in features]), F.isnan), score)


def with_native_score(df: DataFrame, forest: Forest, cols: list[str], name: str) -> DataFrame:
    """``df`` with its native score; the features are columns of their own below it, made once a row."""
    marks = [f"__feature{i}" for i in range(len(cols))]
    made = df.withColumns(dict(zip(marks, feature_values(cols), strict=True)))
    return made.withColumn(name, score_native(forest, marks, made=True)).drop(*marks)


# --------------------------------------------------------------------------- M4-M6

def detect_anomalies(df: DataFrame, contamination: float = CONTAMINATION, seed: int = SEED,
                     feature_cols: list[str] | None = None, n_trees: int = N_TREES,
                     max_samples: int = MAX_SAMPLES, approx: bool = False,
                     n_rows: int | None = None, native: bool = False) -> tuple[DataFrame, int]:
    """M6: returns (table with ``anomaly_flag``, anomaly count).

    ``native=True`` scores in the JVM (``score_native``) instead of an Arrow UDF.
    ``approx=True`` takes the cut from ``percentile_approx`` (A16) in one pass.
    ``n_rows`` saves the counting pass when the caller knows the row count.
    Every row is scored once: the scored table is staged, and the cut, the count and the
    returned table read it. The returned table is thus cut from its lineage.
    """
    cols = feature_cols if feature_cols is not None else feature_columns(df)
    base = df.drop(FLAG_COLUMN) if FLAG_COLUMN in df.columns else df
    n = n_rows if n_rows is not None else base.count()
    if not cols or n < MIN_ROWS:              # M5
        return staged(base.withColumn(FLAG_COLUMN, F.lit(NORMAL)), "anomaly-flags"), 0
    forest_df, psi = fit_forest(base, cols, n, n_trees, max_samples, seed)
    forest = Forest(forest_df, psi)
    spread = spread_for_cpu(base)
    scored = staged(with_native_score(spread, forest, cols, "__score") if native
                    else spread.withColumn("__score", score_column(forest, cols)), "anomaly-scores")
    neg = scored.select((-F.col("__score")).alias("s"))
    if approx:
        cut = stats.approx_quantiles(neg, {"s": [contamination]})[("s", contamination)]
    else:
        cut = stats.quantiles(neg, {"s": [contamination]}, median_mean=False)[("s", contamination)]
    count = neg.where(F.col("s") < F.lit(cut)).count()
    flagged = (scored.withColumn(FLAG_COLUMN, F.when(-F.col("__score") < F.lit(cut), F.lit(ANOMALY))
                                 .otherwise(F.lit(NORMAL)))
               .drop("__score"))
    return flagged, count


def forest_table(df: DataFrame, feature_cols: list[str] | None = None, seed: int = SEED,
                 n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES) -> tuple[DataFrame | None, int]:
    """Fit on a cleaned table (missing -> 0) and return the forest table."""
    cols = feature_cols if feature_cols is not None else feature_columns(df)
    if not cols:
        return None, 0
    return fit_forest(df, cols, None, n_trees, max_samples, seed)


def save_forest(forest: DataFrame, path: str, psi: int) -> None:
    forest.withColumn("psi", F.lit(psi)).write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> Forest:
    pdf = spark.read.parquet(path).toPandas()
    return Forest(pdf.drop(columns=["psi"]), int(pdf["psi"].iloc[0]) if len(pdf) else 1)

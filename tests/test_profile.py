import math

import pytest

from dqspark.operators import profile
from dqspark.operators.profile import profile_columns, profile_table


def test_profile_people(people):
    t = profile_table(people).first()
    assert t.total_records == 39 and t.total_columns == 4 and t.total_nulls == 9
    assert t.null_rate == 5.77                                 # 9 of 156 cells
    cols = {r.column: r for r in profile_columns(people).collect()}
    assert len(cols) == 4
    assert cols["town"].null_count == 9 and cols["town"].null_rate == 23.08
    assert cols["code"].unique_count == 30 and cols["share"].unique_count == 5
    assert cols["id"].dtype == "int"


def test_nan_is_missing_and_not_distinct(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (1.0,)], "x double")
    r = profile_columns(df).first()
    assert r.null_count == 2 and r.unique_count == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    t = profile_table(df).first()
    assert t.total_records == 0 and t.null_rate == 0.0


EDGES = [-(2**63), -(2**63) + 1, -32769, -32768, -32767, -1, 0, 1, 32767, 32768, 32769, 2**63 - 1]


@pytest.mark.parametrize("bitmaps", [[], ["k"], ["k", "g"]])
def test_counts_by_digest_and_by_bitmap_agree_with_brute_force(spark, bitmaps):
    nan = float("nan")
    rows = [(EDGES[i % 12] if i % 5 else None, i % 3 if i % 2 else None, [0.0, -0.0, nan, 1.5, None][i % 5],
             None if i % 7 == 0 else "long text " * 9 + str(i % 11), [i % 2, None] if i % 3 else [None, i % 2], {"a": i % 4, "b": 1}) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, g int, x double, s string, l array<int>, m map<string,int>").repartition(5)
    got = {r["i"]: (r["n"], r["m"], r["u"]) for r in profile.column_counts(df, bitmaps).collect()}
    for i in range(6):
        there = [r[i] for r in rows if r[i] is not None and not (isinstance(r[i], float) and math.isnan(r[i]))]
        distinct = {repr(v if v != 0 or not isinstance(v, float) else 0.0) for v in there}
        assert got[i] == (600, 600 - len(there), len(distinct)), i


def test_bitmaps_are_taken_for_dense_integers_only(spark):
    df = spark.range(0, 60_000, 1, 3).selectExpr("id", "id * 1000003 AS wide", "id % 4 AS code", "cast(null AS int) AS none")
    assert profile.bitmap_columns(df) == ["id"]
    counts = {r.column: (r.null_count, r.unique_count) for r in profile_columns(df, rescan=True).collect()}
    assert counts == {"id": (0, 60_000), "wide": (0, 60_000), "code": (0, 4), "none": (60_000, 0)}
    plan = profile.profile_stats(df, rescan=True)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "bitmap_construct_agg" in plan


def test_no_rows_and_no_columns(spark):
    none = profile.profile_stats(spark.createDataFrame([], "a int, b string")).first()
    assert none.asDict() == {"n": 0, "m0": 0, "u0": 0, "m1": 0, "u1": 0}
    assert profile.profile_stats(spark.range(3).select()).first().n == 3

import random

import numpy as np

from dqspark.operators import stats
from dqspark.operators.repair import repair


def test_null_repair(spark):
    df = spark.createDataFrame([("A", 25.0), (None, None), ("C", 35.0)], "name string, age double")
    out, count, log = repair(df)
    rows = out.collect()
    assert [r.age for r in rows] == [25.0, 30.0, 35.0]
    assert [r.name for r in rows] == ["A", "Unknown", "C"]
    assert count == 2
    assert all(set(r.asDict()) >= {"column", "type", "count"} for r in log.collect())


def test_sample_repair_log(spark, sample_csv):
    from dqspark.operators.dedup import fuzzy_dedup
    from dqspark.sources.csv import read_csv
    df = read_csv(spark, sample_csv)
    table = fuzzy_dedup(df, "name", 85).table
    out, count, log = repair(table)
    entries = [(r.column, r.type, r["count"]) for r in log.orderBy("step").collect()]
    assert entries == [("age", "invalid_age_fixed", 2), ("name", "null_filled_text", 1),
                       ("email", "null_filled_text", 1), ("email", "invalid_email_flagged", 2)]
    assert count == 6
    ages = {r.id: r.age for r in out.collect()}
    assert ages[5] == 29.0 and ages[9] == 29.0
    emails = {r.id: r.email for r in out.collect()}
    assert emails[6] is None and emails[11] is None


def test_all_null_double_filled_with_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    out, count, log = repair(df)
    assert [r.x for r in out.collect()] == [0.0, 0.0] and count == 2


def test_infinities_become_null_last(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (None,)], "v double")
    out, _, log = repair(df)
    vals = [r.v for r in out.collect()]
    # median of [1, inf, -inf] is 1 -> the null becomes 1; infinities end null
    assert vals == [1.0, None, None, 1.0]


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(5)
    data = [rnd.choice([rnd.gauss(0, 1e6), float(rnd.randint(-5, 5)), 1e300, -1e-300, -1e300]) for _ in range(3001)]
    data += [None] * 7
    df = spark.createDataFrame([(x,) for x in data], "x double").repartition(7)
    present = np.array([x for x in data if x is not None])
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = stats.quantiles(df, {"x": [p]}, median_mean=False, buckets=16)[("x", p)]
        want = np.percentile(present, p * 100)
        assert got == want or abs(got - want) <= 1e-9 * max(1.0, abs(want)), (p, got, want)
    med = stats.medians(df, ["x"])["x"]
    assert med == np.median(present)


def test_two_scans_whatever_the_size_of_the_window(spark, monkeypatch):
    """Windows from the sketch, windows that miss every rank, and infinities: the same exact quantiles."""
    rnd = random.Random(9)
    data = [rnd.gauss(0, 1) if rnd.random() < 0.6 else 7.0 for _ in range(20_000)]
    data += [float("inf")] * 3000 + [float("-inf")] * 2500 + [float("nan"), None]
    df = spark.createDataFrame([(x, i % 9) for i, x in enumerate(data)], "x double, g int").repartition(5)
    want = sorted(x for x in data if x is not None and x == x)
    probs = {"x": [0.0, 0.05, 0.1, 0.5, 0.77, 1.0], "g": [0.5]}
    sources = []
    refine = stats._refine
    monkeypatch.setattr(stats, "_refine", lambda d, active, *a: sources.append((d is df, len(active))) or refine(d, active, *a))
    for shift in (0.0, 1e9):
        ranges = stats.column_ranges(df, probs)
        for r in ranges.values():
            r["windows"] = {p: (a + shift, b + shift) for p, (a, b) in r["windows"].items()}
        sources.clear()
        got = stats.quantiles(df, probs, ranges, median_mean=False)
        assert (sum(n for on_df, n in sources if on_df) == 0) == (shift == 0.0)       # the source is not refined again
        for p in probs["x"]:
            pos = p * (len(want) - 1)
            a, b = want[int(pos)], want[min(int(pos) + 1, len(want) - 1)]
            assert got[("x", p)] == (a if a == b or pos == int(pos) else a + (b - a) * (pos - int(pos)))
        assert got[("g", 0.5)] == 4.0


def test_median_even_count_is_mean_of_middle(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "x long")
    assert stats.medians(df, ["x"])["x"] == 2.5


def test_approx_median_close(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)] + [(None,)], "x double")
    out, count, log = repair(df, approx=True)
    assert count == 1
    filled = [r.x for r in out.collect()][-1]
    assert abs(filled - 500.0) <= 1.0

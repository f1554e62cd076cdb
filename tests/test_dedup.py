import random

import pytest
from pyspark.sql import functions as F

from dqspark.functions.similarity import ratio
from dqspark.operators import blocking, dedup
from dqspark.operators.survivors import greedy_survivors


def brute_force_edges(values, threshold):
    """All pairs in rank order (list position)."""
    scored = ((i, j, ratio(values[i], values[j])) for i in range(len(values)) for j in range(i + 1, len(values)))
    return [x for x in scored if x[2] >= threshold]


def _vals(df, col):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda v: (v is None, v))


@pytest.mark.parametrize("limit", [dedup.BROADCAST_BYTES, 0])
def test_exact_dedup_rows_and_clashing_names(spark, monkeypatch, limit):
    """Both paths: nulls, NaN, signed zeros, columns named like the digests, no rows."""
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", limit)
    rows = [(i % 50, None if i % 3 else "x" * (i % 5), [0.0, -0.0, float("nan"), None][i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "D1 int, `d.2` string, x double").repartition(6)
    want = {(a, b, repr(c if c != 0 else 0.0)) for a, b, c in rows}
    out, removed = dedup.exact_dedup(df)
    got = [(r[0], r[1], repr(r[2] if r[2] != 0 else 0.0)) for r in out.collect()]
    assert out.columns == df.columns and set(got) == want and len(got) == len(want) and removed == 900 - len(want)
    none, gone = dedup.exact_dedup(df.where("D1 < 0"))
    assert none.count() == 0 and gone == 0


def test_equal_digests_of_different_rows_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(dedup, "digest_pair", lambda *c: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    out, removed = dedup.exact_dedup(spark.createDataFrame([(1,), (2,), (2,), (3,)], "a int"))
    assert sorted(r.a for r in out.collect()) == [1, 2, 3] and removed == 1


def test_exact_dedup(people):
    out, removed = dedup.exact_dedup(people)
    assert removed == 9 and out.count() == 30
    assert out.count() == out.distinct().count()


def test_fuzzy_people(people):
    deduped, _ = dedup.exact_dedup(people)
    codes = {r.id: r.code for r in deduped.collect()}
    for t in (80, 85):
        r = dedup.fuzzy_dedup(deduped, "code", t)
        assert r.removed == 5
        m = r.first_matches().collect()
        assert {(x.original, x.duplicate) for x in m} == {(codes[i], codes[i] + "x") for i in (1, 6, 11, 16, 21)}
        assert all(abs(x.similarity - 100 * 28 / 29) < 1e-9 for x in m)       # one letter of 14 + 15 is extra
        assert not [c for c in _vals(r.table, "code") if c.endswith("x")]


def test_fuzzy_sample(spark, sample_csv):
    from dqspark.sources.csv import read_csv
    df = read_csv(spark, sample_csv)
    r = dedup.fuzzy_dedup(df, "name", 85)
    assert r.removed == 3
    assert sorted(x.id for x in r.table.collect()) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 13, 14, 15]
    sims = [round(x.similarity, 3) for x in r.first_matches().collect()]
    assert sims == [96.296, 96.0, 95.238]


def test_missing_column_unchanged(people):
    r = dedup.fuzzy_dedup(people, "nonexistent", 85)
    assert r.removed == 0 and r.table.count() == 39 and r.matches.count() == 0


def test_survivor_chain_is_greedy_not_components(spark):
    # a~b, b~c, a!~c: a kept, b dropped, c kept
    df = spark.createDataFrame([("abcdefghij",), ("abcdefghiX",), ("abcdefghXY",)], "v string")
    # counts tie -> rank by value: 'abcdefghXY' < 'abcdefghiX' < 'abcdefghij'
    r = dedup.fuzzy_dedup(df, "v", 90)
    left = _vals(r.table, "v")
    assert left == ["abcdefghXY", "abcdefghij"]


def test_shared_values(spark):
    rows = [("Alice",), ("Alice",), ("Alicee",), ("Alicee",), (None,), ("Zed",)]
    df = spark.createDataFrame(rows, "name string")
    r = dedup.fuzzy_dedup(df, "name", 85)
    assert r.removed == 2
    assert _vals(r.table, "name") == ["Alice", "Alice", "Zed", None]


def test_dedup_twice_is_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    once = dedup.fuzzy_dedup(df, "p_name", 70).table
    twice = dedup.fuzzy_dedup(once, "p_name", 70)
    assert twice.removed == 0


def _greedy(values, edges):
    drop, kept = set(), []
    adj = {}
    for i, j, _ in edges:
        adj.setdefault(i, []).append(j)
    for i in range(len(values)):
        if i in drop:
            continue
        kept.append(i)
        for j in adj.get(i, []):
            drop.add(j)
    return kept, drop


def test_blocking_equals_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 14))) for _ in range(60)]
    vals = sorted(set(base + [b + rnd.choice("xyz") for b in base[:30]] + [b[1:] for b in base[:20]]))
    nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
    for t in (60, 75, 85, 95, 100):
        want = sorted((i, j) for i, j, _ in brute_force_edges(vals, t))
        for strategy in ("band", "prefix"):
            got = sorted((r.rank_i, r.rank_j) for r in blocking.similarity_edges(nodes, t, strategy).collect())
            assert got == want, (t, strategy)


def test_both_kinds_of_tokens_lose_no_match(spark, monkeypatch):
    # numbered characters and adjacent pairs: every match is a candidate once, whatever must be shared
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 60))) for _ in range(40)] + ["a" * 30, "a" * 33, "ab" * 20]
    edited = []
    for b in base:
        x = list(b)
        for _ in range(rnd.randint(0, 4)):
            x[rnd.randrange(len(x))] = rnd.choice("abcdé😀")
        edited.append("".join(x)[rnd.randint(0, 2):])
    vals = sorted({*base, *edited, ""})
    nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
    for t in (60, 70, 85, 100):
        want = {(i, j) for i, j, _ in brute_force_edges(vals, t)} - {(0, j) for j in range(len(vals))}
        for tokens, shared in (("pairs", 1), ("pairs", 8), ("chars", 8)) if t == 85 else (("pairs", 8),):
            monkeypatch.setattr(blocking, "PAIRS_SHARED", shared)
            info = {}
            pairs, n = blocking.candidate_pairs(nodes, t, tokens=tokens, info=info)
            got = [(r.rank_i, r.rank_j) for r in pairs.collect()]
            assert len(got) == n == len(set(got)) and want <= set(got), (t, tokens, shared)
            if tokens != "chars" and t > 67:
                assert info["join_rows"] >= n


def test_pairs_tokens_across_old_and_new(spark, monkeypatch):
    rnd = random.Random(12)
    base = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(8, 40))) for _ in range(30)]
    vals = sorted({*base, *(b + "x" for b in base), *(b[1:] for b in base)})
    nodes = spark.createDataFrame([(i, v, i % 3 == 0) for i, v in enumerate(vals)], "rank long, value string, old boolean")
    want = {(i, j) for i, j, _ in brute_force_edges(vals, 85) if (i % 3 == 0) != (j % 3 == 0)}
    for tokens in ("chars", "pairs", "auto"):
        got = {(r.rank_i, r.rank_j) for r in blocking.candidate_pairs(nodes, 85, tokens=tokens)[0].collect()}
        assert want <= got and all((i % 3 == 0) != (j % 3 == 0) for i, j in got), tokens


def test_band_pairs_cover_length_bound(spark):
    # every pair passing the length bound appears exactly once, for any threshold
    rnd = random.Random(5)
    vals = sorted({"x" * rnd.randint(1, 300) + str(i) for i in range(150)})
    nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
    for t in (60, 85, 99, 100):
        banded = blocking._banded(nodes, t)
        got = [(r.rank_i, r.rank_j) for r in blocking.band_pairs(banded, t, salts=3).collect()]
        assert len(got) == len(set(got))
        hi = (200.0 - t) / t
        want = {(i, j) for i in range(len(vals)) for j in range(i + 1, len(vals))
                if max(len(vals[i]), len(vals[j])) <= min(len(vals[i]), len(vals[j])) * hi + 1e-9}
        assert set(got) == want, t
        assert blocking.band_stats(banded)[2] >= len(got)


def test_blocking_customer_names_brute_force(spark):
    names = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_name").collect())
    nodes = spark.createDataFrame(list(enumerate(names)), "rank long, value string")
    got = sorted((r.rank_i, r.rank_j) for r in blocking.similarity_edges(nodes, 85).collect())
    want = brute_force_edges(names, 85)
    assert got == sorted((i, j) for i, j, _ in want)
    got = sorted((r.rank_i, r.rank_j) for r in blocking.similarity_edges(nodes, 85, "prefix").collect())
    assert got == sorted((i, j) for i, j, _ in want)
    # survivors of the uncapped dedup equal the sequential walk
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    r = dedup.fuzzy_dedup(df, "c_name", 85, max_values=None)
    kept, drop = _greedy(names, want)
    assert r.removed == len(drop)
    assert sorted(x.c_name for x in r.table.collect()) == [names[i] for i in kept]


def test_survivor_rounds_equal_walk(spark):
    rnd = random.Random(11)
    for trial in range(3):
        n = 200
        edges = sorted({(i, j) for i in range(n) for j in range(i + 1, min(n, i + 6)) if rnd.random() < 0.5})
        df = spark.createDataFrame(edges, "rank_i long, rank_j long")
        s = greedy_survivors(df)
        got = {r.rank: r.keep for r in s.states.collect()}
        kept, drop = _greedy(list(range(n)), [(i, j, 0) for i, j in edges])
        nodes = {i for e in edges for i in e}
        assert {k for k, v in got.items() if v} == set(kept) & nodes
        assert {k for k, v in got.items() if not v} == drop
        assert s.rounds >= 1


def test_auto_cost_choice_equals_brute_force(spark, monkeypatch):
    # force the auto path through the counted prefix-join size; either outcome is exact
    monkeypatch.setattr(blocking, "BAND_PAIRS_MAX", 0)
    rnd = random.Random(9)
    short = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 12))) for _ in range(40)]
    prose = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(80, 120))) for _ in range(25)]
    for vals in (sorted(set(short)), sorted(set(prose))):
        nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
        for t in (70, 85):
            got = sorted((r.rank_i, r.rank_j) for r in blocking.similarity_edges(nodes, t).collect())
            assert got == sorted((i, j) for i, j, _ in brute_force_edges(vals, t)), t


def test_ranks_by_where_first_seen(spark):
    """Both rank paths: equal counts in the order of ``order_col``, then by value; unknown places last."""
    rows = [("b", 3), ("a", 5), ("b", 9), ("a", 7), ("c", None), ("d", 1), ("e", 1), ("f", 8), (None, 0)]
    df = spark.createDataFrame(rows, "v string, t int").repartition(3)
    for k in (None, 6, 3):
        got = [r.value for r in dedup.ranked_values(df, "v", k, order_col="t").orderBy("rank").collect()]
        assert got == ["b", "a", "d", "e", "f", "c"][:k]


def test_top_values_exact_on_ties(spark):
    # many ties at the cut
    rnd = random.Random(4)
    rows = [(f"v{rnd.randint(0, 400):03d}{'x' * rnd.randint(0, 3)}",) for _ in range(3000)]
    df = spark.createDataFrame(rows, "name string").repartition(7)
    freq = dedup.value_frequencies(df, "name")
    plain = [(r.value, r["count"]) for r in freq.orderBy(F.desc("count"), F.asc("value")).collect()]
    for k in (1, 10, 57, len(plain), len(plain) + 5):
        want = [(v, c, i + 1) for i, (v, c) in enumerate(plain[:k])]
        got = [(r.value, r["count"], r.rank) for r in dedup.top_values(freq, k).orderBy("rank").collect()]
        assert got == want, k


def test_survivor_chain_rounds_and_guard(spark):
    # the walk along a rank-ordered chain keeps every other node
    n = 12
    edges = [(i, i + 1) for i in range(n - 1)]
    df = spark.createDataFrame(edges, "rank_i long, rank_j long")
    s = greedy_survivors(df)
    got = {r.rank: r.keep for r in s.states.collect()}
    assert got == {i: i % 2 == 0 for i in range(n)}
    with pytest.raises(RuntimeError):
        greedy_survivors(df, max_rounds=0).states.collect()


def test_open_partitions_wait_for_earlier_ones(spark, monkeypatch):
    # two edges a partition: verdicts cross partitions, and chains are settled by pointers
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = sorted({(i, i + 1) for i in range(40)} | {(i, i + 2) for i in range(0, 40, 5)})
        s = greedy_survivors(spark.createDataFrame(edges, "rank_i long, rank_j long"))
        kept, drop = _greedy(list(range(42)), [(i, j, 0) for i, j in edges])
        assert {r.rank for r in s.dropped.collect()} == drop and s.rounds > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_chain_settles_by_pointer_jumping(spark):
    n = 10_000
    df = spark.range(n - 1).selectExpr("id AS rank_i", "id + 1 AS rank_j")
    s = greedy_survivors(df)
    assert s.rounds <= 4 and s.jumps <= 16
    wrong = s.states.where("keep <> (rank % 2 = 0)").count()
    assert wrong == 0 and s.states.count() == n


def test_trees_below_shared_values_equal_the_walk(spark):
    # chains that hang on values with several earlier neighbours, some of them chains themselves
    rnd = random.Random(21)
    n = 400
    edges = {(i, i + 1) for i in range(n - 1) if i % 37} | {(rnd.randrange(j), j) for j in range(60, n, 7)}
    s = greedy_survivors(spark.createDataFrame(sorted(edges), "rank_i long, rank_j long"))
    kept, drop = _greedy(list(range(n)), [(i, j, 0) for i, j in edges])
    nodes = {i for e in edges for i in e}
    assert {r.rank for r in s.states.where("keep").collect()} == set(kept) & nodes
    assert {r.rank for r in s.dropped.collect()} == drop


def test_decided_walk_stores_one_round(spark, monkeypatch):
    # names that fall to one kept value: no second round, no second copy of what is dropped
    from dqspark.operators import survivors
    stored = []
    monkeypatch.setattr(survivors, "staged", lambda df, name, f=survivors.staged: stored.append(name) or f(df, name))
    s = survivors.greedy_survivors(spark.createDataFrame([(1, k) for k in range(2, 200)], "rank_i long, rank_j long"))
    assert stored == ["survivor-round", "survivor-walk"] and s.rounds == 1
    assert {r.rank for r in s.dropped.collect()} == set(range(2, 200))


def test_survivors_without_edges(spark):
    s = greedy_survivors(spark.createDataFrame([], "rank_i long, rank_j long"))
    assert s.states.count() == 0 and s.dropped.count() == 0 and s.rounds == 0


def test_joined_text_verifier_equals_brute_force(spark, monkeypatch):
    # texts above the broadcast bound travel with the pairs instead of a broadcast map
    monkeypatch.setattr(blocking, "BROADCAST_TEXT_BYTES", 0)
    rnd = random.Random(21)
    base = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(5, 16))) for _ in range(40)]
    vals = sorted(set(base + [b[:-1] + "z" for b in base[:20]]))
    nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
    want = sorted((i, j) for i, j, _ in brute_force_edges(vals, 80))
    for strategy in ("band", "prefix"):
        rows = blocking.similarity_edges(nodes, 80, strategy).collect()
        assert sorted((r.rank_i, r.rank_j) for r in rows) == want, strategy
        assert all(r.value_i == vals[r.rank_i] and r.value_j == vals[r.rank_j] for r in rows)


def test_survivor_properties_on_part_names(spark):
    from dqspark.functions.similarity import ratio
    df = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    for t in (70, 85):
        r = dedup.fuzzy_dedup(df, "p_name", t)
        kept = sorted({x.p_name for x in r.table.select("p_name").collect()})
        # no two survivors reach the threshold
        assert not [(a, b) for i, a in enumerate(kept) for b in kept[i + 1:] if ratio(a, b) >= t]
        # every dropped value has an earlier kept match that reaches it
        m = {x.duplicate: x for x in r.matches.collect()}
        dropped = {x.value for x in r.dropped.collect()}
        assert set(m) == dropped
        for d, x in m.items():
            assert x.original in kept and x.rank_i < x.rank_j and ratio(x.original, d) >= t
            assert abs(x.similarity - ratio(x.original, d)) < 1e-9


def test_walk_in_blocks_equals_sequential_walk(spark):
    # small first blocks force several blocks; both generators meet the kept values
    rnd = random.Random(17)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(6, 14))) for _ in range(30)]
    vals = sorted(set(base + [b[:-1] + "z" for b in base] + [f"item {i:03d}" for i in range(40)]))
    df = spark.createDataFrame([(v,) for v in vals], "name string")
    for t, first in ((75, 30), (88, 12)):
        edges = brute_force_edges(vals, t)
        kept, drop = _greedy(vals, edges)
        r = dedup.fuzzy_dedup(df, "name", t, first_block=first)
        assert sorted(x.name for x in r.table.collect()) == [vals[i] for i in kept], t
        first_match = {}
        for i, j, s in edges:
            if i in set(kept) and j in drop and j not in first_match:
                first_match[j] = (vals[i], s)
        got = {x.duplicate: (x.original, x.similarity) for x in r.matches.collect()}
        assert got == {vals[j]: m for j, m in first_match.items()}


def test_pairs_against_earlier_values(spark):
    rnd = random.Random(23)
    vals = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 9))) for _ in range(60)})
    old = spark.createDataFrame(list(enumerate(vals))[:25], "rank long, value string")
    new = spark.createDataFrame(list(enumerate(vals))[25:], "rank long, value string")
    want = sorted((i, j) for i, j, _ in brute_force_edges(vals, 70) if i < 25 <= j)
    for strategy in ("band", "prefix"):
        got = sorted((r.rank_i, r.rank_j) for r in blocking.similarity_edges(new, 70, strategy, against=old).collect())
        assert got == want and want, strategy


def test_deletion_join_equals_brute_force(spark):
    # short values of several lengths, runs of equal characters, characters beyond 16 bits, no character
    rnd = random.Random(31)
    base = ["".join(rnd.choice("ab01😀") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    vals = sorted({*base, *(b + "0" for b in base[:30]), *(b[1:] for b in base[:30]), "", "aaaaaaa", "aaaaaab"})
    nodes = spark.createDataFrame(list(enumerate(vals)), "rank long, value string")
    old = nodes.where("rank % 3 = 0")
    for t in (60, 80, 90, 100):
        edges = [(i, j) for i, j, _ in brute_force_edges(vals, t)]
        rows = blocking.similarity_edges(nodes, t, "deletions").collect()
        assert sorted((r.rank_i, r.rank_j) for r in rows) == edges, t
        rows = blocking.similarity_edges(nodes.where("rank % 3 <> 0"), t, "deletions", against=old).collect()
        assert sorted((r.rank_i, r.rank_j) for r in rows) == [(i, j) for i, j in edges if (i % 3 == 0) != (j % 3 == 0)], t


def test_templated_names_make_few_candidates(spark):
    # names that share nearly all their characters: their number of candidates follows the matches, not all pairs
    info = {}
    nodes = spark.range(4000).selectExpr("id AS rank", "concat('Supplier#', lpad(id, 9, '0')) AS value")
    matches = blocking.similarity_edges(nodes, 90, info=info).count()
    assert info["candidates"] <= 1.01 * matches < 4000 * 200


def test_split_blocks_equal_sequential_walk(spark, monkeypatch):
    # a block that matches itself too often is walked in parts, with the same result
    monkeypatch.setattr(dedup, "EDGE_ROWS_MAX", 20)
    monkeypatch.setattr(blocking, "DELETIONS_FROM", 0)
    rnd = random.Random(37)
    vals = sorted({f"{rnd.randint(0, 9999):05d}" for _ in range(220)})
    edges = brute_force_edges(vals, 80)
    kept, drop = _greedy(list(range(len(vals))), edges)
    r = dedup.fuzzy_dedup(spark.createDataFrame([(v,) for v in vals], "name string"), "name", 80, first_block=40)
    assert sorted(x.name for x in r.table.collect()) == [vals[i] for i in kept]
    first = {}
    for i, j, s in edges:
        if i in set(kept) and j in drop:
            first.setdefault(vals[j], (vals[i], s))
    assert {x.duplicate: (x.original, x.similarity) for x in r.matches.collect()} == first


def test_pairs_of_long_texts_are_dealt_out_one_by_one(spark, monkeypatch):
    # few long texts: the partners of the first value do not share a task
    words = [f"{k:04d}" for k in range(2000)]
    rows = [(i + 1, " ".join(words[: 1500 + i])) for i in range(8)]
    seen = []
    monkeypatch.setattr(blocking, "similarity", lambda a, b, t: seen.append(1) or F.spark_partition_id().cast("double") + 1000)
    edges = blocking.similarity_edges(spark.createDataFrame(rows, "rank long, value string"), 60)
    tasks = {r.similarity for r in edges.where("rank_i = 1").collect()}
    assert seen and len(tasks) > 3


@pytest.mark.parametrize("alike", [True, False])
def test_walk_in_windows_equals_sequential_walk(spark, monkeypatch, alike):
    # a large set of short values: alike ones are walked in windows, varied ones joined after the first window
    monkeypatch.setattr(dedup, "WALK_WINDOW", 30)
    monkeypatch.setattr(blocking, "DELETIONS_FROM", 0)
    rnd = random.Random(41)
    if alike:
        vals = sorted({f"No {rnd.randint(0, 9999):04d}" for _ in range(230)} | {"", "😀", "aa"})
    else:
        base = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
        vals = sorted({*base, *(b[:-1] + "z" for b in base)})
    edges = brute_force_edges(vals, 80)
    kept, drop = _greedy(list(range(len(vals))), edges)
    r = dedup.fuzzy_dedup(spark.createDataFrame([(v,) for v in vals], "name string"), "name", 80, first_block=30)
    assert sorted(x.name for x in r.table.collect()) == [vals[i] for i in kept]
    first = {}
    for i, j, s in edges:
        if i in set(kept) and j in drop:
            first.setdefault(vals[j], (vals[i], s))
    assert {x.duplicate: (x.original, x.similarity) for x in r.matches.collect()} == first
    assert "window" in r.strategy and ("deletions" in r.strategy)


def test_alike_values_store_no_edges(spark, monkeypatch):
    # 6,000 templated names match one another millions of times; the walk stores no such pairs, and few tables
    stored = []
    for module in (dedup, blocking):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: stored.append(name) or f(df, name))
        monkeypatch.setattr(module, "staged_counted", lambda df, name, f=module.staged_counted: stored.append(name) or f(df, name))
    nodes = spark.range(1, 6001).selectExpr("id AS rank", "concat('Customer#', lpad(id, 9, '0')) AS value")
    walk = dedup.greedy_walk(nodes, 6000, 85)
    gone = {x.rank_j for x in walk.matches.collect()}
    assert len(gone) == walk.pairs and walk.candidates < 60_000
    assert "deletion-keys" not in stored and "survivor-round" not in stored and len(stored) < 12


def test_refused_hash_clash_scores_all_pairs(spark, monkeypatch):
    # hashes that clash for all values: the first partners are those that the score accepts
    monkeypatch.setattr(blocking, "DELETIONS_FROM", 0)
    monkeypatch.setattr(blocking, "HASHES_A_PAIR", 1000)
    values = ["abcdefghij", "0123456789", "012345678x", "zzzzzzzzzz"]
    old = spark.createDataFrame([(1, values[0]), (2, values[1])], "rank long, value string")
    new = spark.createDataFrame([(3, values[2]), (4, values[3])], "rank long, value string")
    monkeypatch.setattr(blocking, "_joined_across", lambda nodes, counts, plan: nodes.where("old").select(F.col("rank").alias("rank_x"))
                        .crossJoin(nodes.where("not old").select(F.col("rank").alias("rank_y"))))
    hits, n = blocking.first_partners(new, 85, old, {})
    assert n == 1 and [(r.rank_i, r.rank_j, r.similarity) for r in hits.collect()] == [(2, 3, ratio(values[1], values[2]))]

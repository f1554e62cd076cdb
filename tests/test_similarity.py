import random

from hypothesis import given, settings
from hypothesis import strategies as st

from dqspark.functions.similarity import _score_batch, lcs_length, ratio, similarity, similarity_native


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def test_known_scores():
    # D2 goldens: indel ratio, not Levenshtein
    assert abs(ratio("Charlie Brown", "Charlie Brownn") - 96.2962962962963) < 1e-9
    assert ratio("Frank Castle", "Frank Castlle") == 96.0
    assert abs(ratio("Henry Ford", "Henry Forde") - 95.23809523809523) < 1e-9
    assert abs(ratio("Alice", "Alicee") - 90.9090909090909) < 1e-9
    assert ratio("", "") == 100.0
    assert ratio("abc", "") == 0.0
    assert ratio("abc", "ABC") == 0.0          # case-sensitive


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdé😀 ", max_size=40), st.text(alphabet="abcdé😀 ", max_size=40))
def test_lcs_matches_dp(a, b):
    assert lcs_length(a, b) == lcs_dp(a, b)


def test_lcs_long_and_early_exit():
    rnd = random.Random(7)
    for _ in range(20):
        a = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(100, 400)))
        b = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(100, 400)))
        exact = lcs_dp(a, b)
        assert lcs_length(a, b) == exact
        need = exact + 1
        assert lcs_length(a, b, need) < need      # early exit never reports a false pass
        assert lcs_length(a, b, exact) == exact


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd", min_size=60, max_size=300), st.text(alphabet="abcd", min_size=60, max_size=300),
       st.integers(min_value=0, max_value=40))
def test_stop_rule_is_exact(a, b, slack):
    # with a bound, a result >= need is the exact LCS and a miss is a true miss
    exact = lcs_dp(a, b)
    for need in (exact - slack, exact, exact + 1, exact + slack + 1):
        if need <= 0:
            continue
        got = lcs_length(a, b, need)
        assert (got >= need) == (exact >= need)
        if got >= need:
            assert got == exact


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé😀 \n", max_size=60))
def test_numbered_characters(v):
    from collections import Counter

    from dqspark.operators.blocking import _numbered
    seen, want = Counter(), []
    for ch in v:
        seen[ch] += 1
        want.append((ord(ch) << 32) | seen[ch])
    assert _numbered(v).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=12))
def test_common_ends(a, b):
    from dqspark.functions.similarity import _common_ends
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    assert _common_ends(a, b) == (p, q)


def test_common_ends_long_runs():
    from dqspark.functions.similarity import _common_ends
    rnd = random.Random(2)
    for _ in range(200):
        core = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 300)))
        a = core[:rnd.randint(0, len(core))] + "x" + core
        b = core[:rnd.randint(0, len(core))] + "y" + core
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        q = 0
        while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
            q += 1
        assert _common_ends(a, b) == (p, q)


_TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é😀語", max_size=70), st.text(alphabet="ab", min_size=60, max_size=70)),
                  min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(_TEXTS, st.sampled_from([0.0, 40.0, 70.0, 85.0, 100.0]))
def test_batch_scores_equal_single_ones(texts, threshold):
    pairs = [(x, y) for x in texts for y in texts]
    got = _score_batch([x for x, _ in pairs], [y for _, y in pairs], threshold).tolist()
    for (x, y), s in zip(pairs, got, strict=True):
        if x is None or y is None:
            assert s != s
            continue
        exact = ratio(x, y)
        if exact >= threshold:
            assert s == exact
        else:
            assert s < threshold


def test_batch_steps_are_halved(monkeypatch):
    from dqspark.functions import similarity
    monkeypatch.setattr(similarity, "MAX_CELLS", 50)
    rnd = random.Random(3)
    a = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 64))) for _ in range(40)]
    assert _score_batch(a, a[::-1], 0.0).tolist() == [ratio(x, y) for x, y in zip(a, a[::-1])]


def _edited(rnd, alphabet, n, edits):
    x = [rnd.choice(alphabet) for _ in range(n)]
    y = list(x)
    for _ in range(edits):
        y[rnd.randrange(len(y))] = rnd.choice(alphabet)
    return "".join(x), "".join(y[rnd.randint(0, 9):])


def test_many_long_pairs_equal_single_ones(monkeypatch):
    # pairs of several words are stepped together; both ways to the LCS agree with the scalar form
    from dqspark.functions import similarity as sim
    rnd = random.Random(8)
    for alphabet in ("ab", "abcdefgh", "aé😀語b"):
        texts = [t for _ in range(25) for t in _edited(rnd, alphabet, rnd.randint(60, 260), rnd.randint(0, 50))]
        pairs = [(x, y) for x in texts for y in texts]
        exact = [ratio(x, y) for x, y in pairs]
        for threshold in (0.0, 40.0, 85.0, 100.0):
            for pays in (lambda *a: True, lambda *a: False, sim._numpy_pays):
                with monkeypatch.context() as m:
                    m.setattr(sim, "_numpy_pays", pays)
                    got = _score_batch([x for x, _ in pairs], [y for _, y in pairs], threshold).tolist()
                assert all(g == e if e >= threshold else g < threshold for g, e in zip(got, exact, strict=True))


def test_long_groups_are_halved(monkeypatch):
    from dqspark.functions import similarity as sim
    monkeypatch.setattr(sim, "LONG_CELLS", 200)
    monkeypatch.setattr(sim, "_numpy_pays", lambda pairs, words, band: pairs > 1)
    rnd = random.Random(9)
    pairs = [_edited(rnd, "abcdef", rnd.randint(65, 200), 5) for _ in range(30)]
    got = _score_batch([x for x, _ in pairs], [y for _, y in pairs], 0.0).tolist()
    assert got == [ratio(x, y) for x, y in pairs]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abc", max_size=40))
def test_adjacent_pairs_bound_the_lcs(a, b):
    import numpy as np

    from dqspark.functions.similarity import _pair_overlaps, _points
    shared = _pair_overlaps([_points(a), _points(b)], np.array([0]), np.array([1]))[0]
    assert shared >= 3 * lcs_dp(a, b) - 1 - len(a) - len(b)


def test_native_form_equals_kernel(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(4)
    texts = [None, "", "a", "aé😀語b", " "] + [
        "".join(rnd.choice("abé😀 ") for _ in range(n)) for n in (3, 61, 62, 63, 64, 124, 125, 150) for _ in range(2)]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    for r in df.select(similarity_native(F.col("a"), F.col("b")).alias("native"),
                       similarity(F.col("a"), F.col("b")).alias("kernel")).collect():
        assert r.native == r.kernel or (r.native is None and (r.kernel is None or r.kernel != r.kernel))


def test_native_form_of_long_texts_copies_no_state(spark):
    # many words against many blocks; the letters of a are looked for once, not once for each character of b
    from pyspark.sql import functions as F
    a, b = "ab" * 700 + "c", "ba" * 650 + "xa"
    df = spark.createDataFrame([(a, b), (b, a), (a, a), ("", a), ("é" * 63, "é" * 62)], "a string, b string")
    col = similarity_native(F.col("a"), F.col("b"))
    for r in df.select("a", "b", col.alias("s")).collect():
        assert abs(r.s - ratio(r.a, r.b)) < 1e-12
    assert df.select(col.alias("s"))._jdf.queryExecution().analyzed().toString().count("array_distinct") == 1


def test_native_form_leaves_out_blocks_exactly(spark, monkeypatch):
    # short words, so that short texts have many blocks: both walks, with blocks left out at either side
    from pyspark.sql import functions as F

    from dqspark.functions import similarity as sim
    monkeypatch.setattr(sim, "NATIVE_BITS", 6)
    monkeypatch.setattr(sim, "NARROW_BLOCKS", 1)
    rnd = random.Random(11)
    pairs = []
    for n in (0, 6, 60, 200, 400):
        x = "".join(rnd.choice("abcé😀 ") for _ in range(n))
        few = "".join(c for c in x if rnd.random() > 0.05)
        pairs += [(x, x), (x, few), (x, x[n // 3:] + x[:n // 3]), (x, x[:n // 4] + "b" * n + x[n // 4:]), (x, x[n // 2:]),
                  (x, "".join(rnd.choice("abc") for _ in range(n))), (x, "z" * n)]
    pairs += [(y, x) for x, y in pairs]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    for r in df.select("a", "b", similarity_native(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == ratio(r.a, r.b)


def test_native_form_of_like_texts_takes_few_blocks(spark):
    import time

    from pyspark.sql import functions as F
    rnd = random.Random(12)
    x = "".join(rnd.choice("abcdefgh") for _ in range(16000))
    y = "".join(c for c in x if rnd.random() > 0.02)
    took = {}
    for name, a, b in (("warm", x[:4000], y[:4000]), ("like", x, y), ("unlike", x, "z" * 16000)):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        began = time.perf_counter()
        assert df.select(similarity_native(F.col("a"), F.col("b")).alias("s")).first().s == ratio(a, b)
        took[name] = time.perf_counter() - began
    assert took["like"] < took["unlike"] / 2      # both took the same 4 million steps

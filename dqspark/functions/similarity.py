"""Indel similarity of two texts, 0-100, case-sensitive, by character.

``ratio(a, b) = (1 - indel / (len a + len b)) * 100`` with
``indel = len a + len b - 2 * LCS(a, b)``; two empty texts score 100. The float
expression is evaluated in this order so equal inputs give equal doubles.

The LCS uses the bit-parallel recurrence over Python integers (one bit per
character of the longer text): per character ``c`` of the shorter text,
``u = S & M[c]; S = (S + u) | (S - u)``; LCS = zero bits of ``S``. Python's
big-integer kernels run it in C, ~0.1 us per machine word per step.

The Spark entry point is an Arrow ``pandas_udf`` working on whole batches: the bounds
(lengths, character counts, adjacent-character counts) and the LCS are numpy steps over
all pairs of a batch. Texts up to 64 characters take one machine word a pair
(``lcs_short``), longer ones several words with a carry between them, of which only those
are fed that an alignment good enough can meet (``lcs_words``). ``similarity_native`` is
the same recurrence as a Spark expression without Python. The batch kernel
It
takes the score threshold so hopeless pairs stop early. The stop rule is exact:
after ``k`` characters of ``b``, ``LCS(a, b) <= max_i LCS(a[:i], b[:k]) + min(m - i,
rest)`` (split an optimal alignment where it leaves ``b[:k]``). The row values
``LCS(a[:i], b[:k])`` are the zero bits of ``S`` below ``i``; they grow with ``i``,
so checking block ends against block starts bounds every ``i`` of a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pattern(a: str) -> dict:
    pm: dict = {}
    bit = 1
    for ch in a:
        pm[ch] = pm.get(ch, 0) | bit
        bit <<= 1
    return pm


BOUND_BLOCKS = 16     # block ends checked by the stop rule
CHECK_EVERY = 64      # characters of the shorter text between two checks


def _blocks(m: int) -> list[tuple[int, int, int]]:
    """``(mask of the low e bits, e, block start)`` for the stop rule."""
    width = max(64, -(-m // BOUND_BLOCKS))
    ends = list(range(width, m, width)) + [m]
    return [((1 << e) - 1, e, start) for e, start in zip(ends, [0] + ends[:-1])]


def lcs_length(a: str, b: str, need: int = 0, pm: dict | None = None) -> int:
    """Length of the longest common subsequence (by code point).

    With ``need`` > 0 the scan may stop early and return a value below ``need``
    once ``need`` is out of reach; any value >= ``need`` returned is exact.
    """
    if len(a) < len(b):
        a, b = b, a
        pm = None
    m = len(a)
    if m == 0 or not b:
        return 0
    if pm is None:
        pm = _pattern(a)
    mask = (1 << m) - 1
    s = mask
    rest = len(b)
    blocks = _blocks(m) if need and len(b) >= CHECK_EVERY else ()
    step = 0
    for ch in b:
        match = pm.get(ch)
        rest -= 1
        if match:
            u = s & match
            s = (s + u) | (s - u)
        step += 1
        if need and step == CHECK_EVERY:
            step = 0
            for low, end, start in blocks:
                if end - (s & low).bit_count() + min(m - start, rest) >= need:
                    break
            else:                       # no split point can still reach need
                return m - (s & mask).bit_count()
    return m - (s & mask).bit_count()


def ratio_from_lcs(la: int, lb: int, lcs: int) -> float:
    total = la + lb
    if total == 0:
        return 100.0
    dist = total - 2 * lcs
    return (1.0 - dist / total) * 100.0


def ratio(a: str, b: str) -> float:
    """Python scalar form (tests, small fixtures)."""
    return ratio_from_lcs(len(a), len(b), lcs_length(a, b))


def min_lcs(la: int, lb: int, threshold: float) -> int:
    """Smallest LCS that can reach ``threshold`` (exact rational bound)."""
    return max(0, math.ceil(threshold * (la + lb) / 200.0 - 1e-9))


def _shared_run(a: str, b: str, n: int, backwards: bool) -> int:
    """Length of the common prefix (or suffix) of ``a`` and ``b``, at most ``n``.

    Unrelated texts differ within a few characters: those are compared one by one.
    A longer shared run (near copies) is found by binary search over slice
    comparisons, done in C, instead of a Python loop over its length.
    """
    la, lb = len(a), len(b)
    k = 0
    while k < n and k < 32:
        if (a[la - 1 - k] != b[lb - 1 - k]) if backwards else (a[k] != b[k]):
            return k
        k += 1
    lo, hi = k, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if (a[la - mid:] == b[lb - mid:]) if backwards else (a[:mid] == b[:mid]):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _common_ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common prefix and of the common suffix of what is left."""
    n = min(len(a), len(b))
    p = _shared_run(a, b, n, False)
    return p, _shared_run(a, b, n - p, True)


class _Caches:
    """Bit patterns of recently seen texts, bounded.

    Candidates arrive sorted by their first value, so one value meets many
    partners in a row. Patterns take about ``len x distinct characters`` bits
    each, so they are bounded by the characters they cover.
    """

    def __init__(self, max_pattern_chars: int = 4_000_000):
        self.patterns: dict = {}
        self.pattern_chars = 0
        self.max_pattern_chars = max_pattern_chars

    def pattern(self, x: str) -> dict:
        pm = self.patterns.get(x)
        if pm is None:
            if self.pattern_chars + len(x) > self.max_pattern_chars:
                self.patterns.clear()
                self.pattern_chars = 0
            pm = self.patterns[x] = _pattern(x)
            self.pattern_chars += len(x)
        return pm


BINS = 128                # character bins of the bag bound; ASCII characters have one each
BAG_FROM = 32             # up to this length the LCS itself costs less than the bag bound
WORD_BITS = 64            # texts up to this length have their LCS computed many pairs at a time
MAX_CELLS = 2_000_000     # bit patterns of one step; a step with more is halved
STEP = 4096               # pairs whose count vectors are compared at a time


def _points(v: str) -> np.ndarray:
    return np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bag_overlaps(points: list[np.ndarray], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Upper bound of each pair's LCS: the overlap of its character counts in bins."""
    counts = np.stack([np.bincount(p & np.uint32(BINS - 1), minlength=BINS) for p in points]).astype(np.int32)
    out = np.empty(len(ia), np.int64)
    for at in range(0, len(ia), STEP):
        out[at:at + STEP] = np.minimum(counts[ia[at:at + STEP]], counts[ib[at:at + STEP]]).sum(1)
    return out


def lcs_short(points: list[np.ndarray], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Exact LCS lengths of many pairs of texts of at most ``WORD_BITS`` characters.

    The recurrence of ``lcs_length`` on one machine word per pair: step ``k`` feeds the
    ``k``-th character of every second text at once.
    """
    used, at = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    own = [points[i] for i in used]
    a, b = at[:len(ia)], at[len(ia):]
    lens = np.array([len(p) for p in own], np.int64)
    alphabet, codes = np.unique(np.concatenate(own), return_inverse=True)
    if len(own) * (len(alphabet) + 1) > MAX_CELLS and len(ia) > 1:
        half = len(ia) // 2
        return np.concatenate([lcs_short(points, ia[:half], ib[:half]), lcs_short(points, ia[half:], ib[half:])])
    owner = np.repeat(np.arange(len(own)), lens)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
    grid = np.full((len(own), WORD_BITS), len(alphabet))          # the code past a text's end has no pattern bits
    grid[owner, place] = codes
    pattern = np.zeros((len(own), len(alphabet) + 1), np.uint64)
    np.bitwise_or.at(pattern, (owner, codes), np.uint64(1) << place.astype(np.uint64))
    s = np.full(len(a), np.uint64(2**64 - 1))
    for k in range(int(lens[b].max(initial=0))):
        u = s & pattern[a, grid[b, k]]
        s = (s + u) | (s - u)
    unused = (WORD_BITS - lens[a]).astype(np.uint64)
    low = np.where(lens[a] > 0, np.uint64(2**64 - 1) >> np.minimum(unused, np.uint64(WORD_BITS - 1)), np.uint64(0))
    return lens[a] - np.bitwise_count(s & low).astype(np.int64)


PAYLOAD = 63              # bits used of each word of a long text: the top bit catches the carry
LOW = np.uint64((1 << PAYLOAD) - 1)
TOP = np.uint64(PAYLOAD)
GROUP_GROWTH = 1.25       # lengths of the pairs that are stepped together differ by this factor at most
LONG_CELLS = 8_000_000    # pattern words of one group of long pairs; a group with more is halved
PAIR_BINS = 1024          # bins of the adjacent-character bound


def _pair_overlaps(points: list[np.ndarray], ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Upper bound of the adjacent character pairs that two texts share, each as often as in both."""
    used, at = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    counts = np.zeros((len(used), PAIR_BINS), np.uint16)
    for row, i in enumerate(used):
        p = points[i].astype(np.uint32)
        bins = (p[:-1] * np.uint32(31) + p[1:]) & np.uint32(PAIR_BINS - 1)
        counts[row] = np.minimum(np.bincount(bins, minlength=PAIR_BINS), 65535)
    # a count cut at 65,535 is raised again below: the bound may only be too high
    over = np.array([len(points[i]) > 65535 for i in used])
    a, b = at[:len(ia)], at[len(ia):]
    out = np.empty(len(ia), np.int64)
    for k in range(0, len(ia), STEP // 4):
        part = slice(k, k + STEP // 4)
        out[part] = np.minimum(counts[a[part]], counts[b[part]]).sum(1, dtype=np.int64)
    return np.where(over[a] & over[b], np.iinfo(np.int64).max // 4, out)


def lcs_words(values: list[str], points: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, need: np.ndarray,
              caches: _Caches | None = None) -> np.ndarray:
    """LCS lengths of many pairs of texts of any length.

    The recurrence of ``lcs_length`` over arrays ``(words, pairs)``: step ``k`` feeds the
    ``k``-th character of every second text at once, word by word; bit 63 of a word's sum is
    the carry into the next one. Results of at least ``need`` are exact, others are
    below it:

    * a match of ``a[i]`` with ``b[j]`` in an alignment of ``need`` matches has
      ``i - j <= len a - need`` and ``j - i <= len b - need``. Words with no such place at step ``k`` are
      left out, which only forgets matches outside that band;
    * every ``CHECK_EVERY`` steps the stop rule (module docstring) is taken at word ends
      and pairs that cannot reach ``need`` any more leave the arrays.

    Pairs of like lengths are stepped together. Where these are, or become, too few to pay
    for numpy's fixed cost a step, each goes through ``lcs_length``, whose integers hold all its words.
    """
    out = np.zeros(len(ia), np.int64)
    lens = np.array([len(p) for p in points], np.int64)
    ia, ib = np.where(lens[ia] >= lens[ib], ia, ib), np.where(lens[ia] >= lens[ib], ib, ia)
    caches = caches or _Caches()
    order = np.lexsort((lens[ib], lens[ia]))
    distinct = np.zeros(len(points), np.int64)
    for i in np.unique(ia):
        distinct[i] = len(np.unique(points[i]))
    at = 0
    while at < len(order):
        limit = lens[ia[order[at]]] * GROUP_GROWTH + PAYLOAD
        group = order[at:at + int(np.searchsorted(lens[ia[order[at:]]], limit, "right"))]
        while True:
            words = -(-int(lens[ia[group]].max()) // PAYLOAD)
            band = min(words, int((lens[ia] + lens[ib] - 2 * need)[group].max()) // PAYLOAD + 2)
            pays = _numpy_pays(len(group), words, band)
            if not pays or words * distinct[np.unique(ia[group])].sum() <= LONG_CELLS:
                break
            group = group[:len(group) // 2]
        out[group] = _lcs_group(points, ia[group], ib[group], need[group], band) if pays else -1
        for k in group[out[group] < 0].tolist():
            out[k] = _lcs_one(values[ia[k]], values[ib[k]], int(need[k]), caches)
        at += len(group)
    return out


def _numpy_pays(pairs: int, words: int, band: int) -> bool:
    """Whether a step of all pairs by ``band`` numpy words is cheaper than one by Python integers
    for each pair (measured, in units of 6 ns: 25 + a word each, against 900 a word and 1.5 a pair)."""
    return pairs * (25 + words) > band * (900 + 1.5 * pairs)


def _lcs_one(x: str, y: str, need: int, caches: _Caches) -> int:
    p, q = _common_ends(x, y)                             # shared ends are part of an LCS
    xm, ym = x[p:len(x) - q], y[p:len(y) - q]
    longer, shorter = (xm, ym) if len(xm) >= len(ym) else (ym, xm)
    pm = caches.pattern(longer) if p == 0 and q == 0 else None
    return p + q + lcs_length(longer, shorter, max(0, need - p - q), pm)


def _lcs_group(points: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, need: np.ndarray,
               band: int) -> np.ndarray:
    """``lcs_words`` for pairs of like lengths, ``ia`` holding the longer texts.

    When only few pairs are left they get -1: the caller takes them one by one.
    """
    la = np.array([len(points[i]) for i in ia], np.int64)
    lb = np.array([len(points[i]) for i in ib], np.int64)
    words = max(1, -(-int(la.max()) // PAYLOAD))
    below, above = int((lb - need).max()), int((la - need).max())
    # pattern words of the longer texts: one row for each (text, character of it)
    used, a = np.unique(ia, return_inverse=True)
    own = [points[i] for i in used]
    alphabet, codes = np.unique(np.concatenate(own), return_inverse=True)
    own_lens = np.array([len(p) for p in own], np.int64)
    owner = np.repeat(np.arange(len(own)), own_lens)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(own_lens) - own_lens, own_lens)
    keys, row = np.unique(owner * len(alphabet) + codes, return_inverse=True)
    pattern = np.zeros((words, len(keys) + 1), np.uint64)             # the last row matches nothing
    np.bitwise_or.at(pattern, (place // PAYLOAD, row), np.uint64(1) << (place % PAYLOAD).astype(np.uint64))
    row_of = np.full(len(own) * (len(alphabet) + 1), len(keys), np.int32)
    row_of[keys + keys // len(alphabet)] = np.arange(len(keys))       # one more code a text: unknown characters
    # second texts as codes, one column a pair
    fed, b = np.unique(ib, return_inverse=True)
    steps = int(lb.max())
    feed = np.full((len(fed), steps), len(alphabet), np.int32)
    for r, i in enumerate(fed):
        p = points[i]
        hit = np.minimum(np.searchsorted(alphabet, p), len(alphabet) - 1)
        feed[r, :len(p)] = np.where(alphabet[hit] == p, hit, len(alphabet))
    feed = np.ascontiguousarray(feed.T)
    base = a * (len(alphabet) + 1)
    pairs = np.arange(len(ia))
    s = np.full((words, len(ia)), LOW)
    out = np.zeros(len(ia), np.int64)

    def zeros(w: int) -> np.ndarray:
        """Zero bits of word ``w`` that stand for characters of the pair's longer text."""
        size = np.clip(la - w * PAYLOAD, 0, PAYLOAD).astype(np.uint64)
        mask = (np.uint64(1) << size) - np.uint64(1)
        return size.astype(np.int64) - np.bitwise_count(s[w] & mask).astype(np.int64)

    for k in range(steps):
        first = max(0, (k - below) // PAYLOAD)
        last = min(words - 1, (k + above) // PAYLOAD)
        rows = row_of[base + feed[k, b]]
        carry = np.zeros(len(pairs), np.uint64)
        for w in range(first, last + 1):
            word = s[w]
            u = word & pattern[w].take(rows)
            carry += word
            carry += u
            np.bitwise_xor(word, u, out=u)
            np.bitwise_or(carry & LOW, u, out=word)
            carry >>= TOP
        if k % CHECK_EVERY == CHECK_EVERY - 1 and k + 1 < steps:
            rest = np.maximum(lb - k - 1, 0)
            seen = np.zeros(len(pairs), np.int64)
            best = np.minimum(la, rest)                # nothing of the longer text used yet
            for w in range(words):
                seen += zeros(w)
                np.maximum(best, seen + np.minimum(np.maximum(la - w * PAYLOAD, 0), rest), out=best)
            gone = best < need
            if gone.mean() > 0.1 or gone.all():        # narrower arrays pay for the copy
                out[pairs[gone]] = seen[gone]
                keep = ~gone
                pairs, la, lb, need, b, base, s = (pairs[keep], la[keep], lb[keep], need[keep], b[keep], base[keep],
                                                   np.ascontiguousarray(s[:, keep]))
                left = -(-steps // max(1, steps - k))  # a pair handed over starts anew
                if not len(pairs) or not _numpy_pays(len(pairs) * left, words, band):
                    out[pairs] = -1
                    return out
                below = int((lb - need).max())         # ``above`` stays: a word once fed must be fed on
    total = np.zeros(len(pairs), np.int64)
    for w in range(words):
        total += zeros(w)
    out[pairs] = total
    return out


def _score_batch(a, b, threshold: float, caches: _Caches | None = None) -> pd.Series:
    """Scores; with a threshold, a pair that provably misses it gets some value below it.

    The bounds and the LCS are computed for the whole batch at once.
    """
    caches = caches or _Caches()
    a, b = list(a), list(b)
    scores = np.full(len(a), np.nan)
    places = {v: k for k, v in enumerate(dict.fromkeys(v for v in a + b if v is not None))}
    ia = np.fromiter((places.get(v, -1) for v in a), np.int64, len(a))
    ib = np.fromiter((places.get(v, -1) for v in b), np.int64, len(b))
    present = np.flatnonzero((ia >= 0) & (ib >= 0))
    if not len(present):
        return pd.Series(scores)
    ia, ib = ia[present], ib[present]
    values = list(places)
    lens = np.array([len(v) for v in values], np.int64)
    flat, ends = _points("".join(values)), np.cumsum(lens).tolist()
    points = [flat[start:end] for start, end in zip([0] + ends[:-1], ends)]
    la, lb = lens[ia], lens[ib]
    total = la + lb
    need = np.zeros(len(ia), np.int64)
    lcs = np.minimum(la, lb)
    if threshold > 0:
        need = np.maximum(0, np.ceil(threshold * total / 200.0 - 1e-9)).astype(np.int64)
        fits = np.flatnonzero((lcs >= need) & (np.maximum(la, lb) > BAG_FROM))
        if len(fits):
            lcs[fits] = np.minimum(lcs[fits], _bag_overlaps(points, ia[fits], ib[fits]))
    open_ = lcs >= need                                   # what fails keeps its bound, below the threshold
    short = np.flatnonzero(open_ & (np.maximum(la, lb) <= WORD_BITS))
    if len(short):
        lcs[short] = lcs_short(points, ia[short], ib[short])
    long_ = np.flatnonzero(open_ & (np.maximum(la, lb) > WORD_BITS))
    if threshold > 0 and len(long_):
        shared = _pair_overlaps(points, ia[long_], ib[long_])
        most = (shared + 1 + total[long_]) // 3           # shared pairs >= 3 LCS - 1 - la - lb
        lcs[long_] = np.minimum(lcs[long_], most)
        long_ = long_[lcs[long_] >= need[long_]]
    if len(long_):
        lcs[long_] = lcs_words(values, points, ia[long_], ib[long_], need[long_], caches)
    scores[present] = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / np.maximum(total, 1)) * 100.0)
    return pd.Series(scores)


def similarity(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Column of scores. Scores below ``threshold`` may be lower bounds only."""
    thr = float(threshold)
    state: dict = {}

    @F.pandas_udf(T.DoubleType())
    def _similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return _score_batch(x, y, thr, state.setdefault("caches", _Caches()))

    # nondeterministic only to the optimizer: a filter on the score must not be
    # pushed below the projection, which would run the UDF twice
    return _similarity.asNondeterministic()(a, b)


NATIVE_BITS = 62          # bits of a word of the native form: its sums stay within a signed long
NARROW_BLOCKS = 4         # blocks beside the diagonal in the native form's first walk


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: expressions inside lambdas are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarity_native(a: Column, b: Column) -> Column:
    """The exact score as one Spark expression (no Python worker), for texts of any length.

    The words of ``a`` are taken one after the other; each goes over ``b`` in blocks of as many characters, with
    the carries of a block in one long, so no state is copied for each character. The carries that leave a word are the
    columns where ``LCS(a[:i], b[:j])`` grows, so their counts give that length at every block's end.

    Long texts are walked twice. The first walk takes the blocks beside the diagonal only: leaving out matches can
    only lower the result, so it is a lower bound ``need`` of the LCS. The second leaves out just the blocks where
    ``LCS(a[:i], b[:j]) + min(len a - i, len b - j) < need``, which no alignment of ``need`` matches enters: its result is exact
    whatever the first gave. Where nothing can be left out (unlike texts) it is all ``len a * len b / 62`` interpreted
    steps, for like texts about as many as ``(len a + len b - 2 LCS) * len / 62``. Two empty texts score 100; null if a
    text is null. For checks; joins use ``similarity``.
    """
    zero, one, low = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit((1 << NATIVE_BITS) - 1).cast("long")
    top = F.lit(1 << NATIVE_BITS).cast("long")
    bit_of = F.transform(F.sequence(F.lit(0), F.lit(NATIVE_BITS - 1)), lambda i: F.call_function("shiftleft", one, i))
    no_longs = F.array().cast("array<bigint>")

    def chars(x: Column) -> Column:
        return F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))

    def blocks(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / NATIVE_BITS)).cast("int")

    def ones(carries: Column) -> Column:
        return F.bit_count(carries).cast("long")

    def pattern(letters: Column, part: Column, bits: Column) -> Column:
        """For no letter (0) and each letter: its places in a word of ``a``."""
        def places(letter: Column) -> Column:
            hits = F.zip_with(part, bits, lambda c, bit: F.when(c == letter, bit).otherwise(zero))
            return F.when(F.array_contains(part, letter), F.aggregate(hits, zero, lambda n, bit: n + bit)).otherwise(zero)
        return F.concat(F.array(zero), F.transform(letters, places))

    def feed(done: Column, match: Column) -> Column:
        """One character: bit 62 of ``s`` is the carry of the character before, ``io`` gives a carry and takes one."""
        s, io = done["s"], done["io"]
        total = s.bitwiseAND(low) + s.bitwiseAND(match) + io.bitwiseAND(one)
        return F.struct(total.bitwiseOR(s.bitwiseAND(match.bitwiseXOR(low))).alias("s"),
                        F.shiftright(io.bitwiseOR(s.bitwiseAND(top)), 1).alias("io"))

    def fed_all(done: Column) -> Column:
        return F.struct(done["s"].bitwiseAND(low).alias("s"),
                        F.shiftright(done["io"].bitwiseOR(done["s"].bitwiseAND(top)), 1).alias("out"))

    def word_over_blocks(bits: Column, blocks_at: Column, codes_at, into_at, base: Column, most: Column) -> Column:
        """The carries of one word over blocks that follow each other; ``base`` is the length before them, ``most`` the
        characters of ``b`` that an alignment of ``need`` matches can leave out."""
        def block(done: Column, k: Column) -> Column:
            start = F.struct(done["s"].alias("s"), F.coalesce(into_at(k), zero).alias("io"))
            end = F.aggregate(F.transform(codes_at(k), lambda c: F.get(bits, c)), start, feed, fed_all)
            taken = _let(end, lambda r: F.struct(r["s"].alias("s"), (done["common"] + ones(r["out"])).alias("common"),
                                                 F.concat(done["carries"], F.array(r["out"])).alias("carries")))
            # neither this block nor one to its right can still reach ``need``
            return F.when(k.cast("long") * NATIVE_BITS - done["common"] > most, done).otherwise(taken)
        start = F.struct(low.alias("s"), base.alias("common"), no_longs.alias("carries"))
        return F.aggregate(blocks_at, start, block, lambda done: done["carries"])

    def lcs(in_a: Column, letters: Column, bits_of_word: Column) -> Column:
        def over_words(codes: Column, fed: Column) -> Column:
            # sizes of arrays at hand: ``length`` would count a text's characters anew each time
            size_a, size_b = F.size(in_a).cast("long"), F.size(codes).cast("long")
            words_a, blocks_b = blocks(size_a).cast("long"), F.size(fed).cast("long")

            def walk(need: Column, narrow: Column) -> Column:
                def word(done: Column, w: Column) -> Column:
                    row = w.cast("long")
                    above, below = row * NATIVE_BITS, F.least((row + 1) * NATIVE_BITS, size_a)
                    lead = F.when(narrow, F.floor(row * blocks_b / words_a) - NARROW_BLOCKS).otherwise(zero)
                    last = F.least(blocks_b - 1, F.when(narrow, F.floor((row + 1) * blocks_b / words_a) + NARROW_BLOCKS)
                                   .otherwise(F.floor((below + size_b - need) / NATIVE_BITS)))

                    def pass_by(left: Column, carries: Column) -> Column:
                        """Blocks at the front, up to whose ends nothing can reach ``need`` any more."""
                        common = left["seen"] + ones(carries)
                        gone = (left["first"] < lead) | (common + size_a - above < need)
                        return F.struct((left["first"] + gone.cast("long")).alias("first"),
                                        F.when(gone, common).otherwise(left["base"]).alias("base"), common.alias("seen"))

                    def along(left: Column) -> Column:
                        first, base = left["first"], left["base"]
                        here = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
                        part = F.slice(in_a, w * NATIVE_BITS + 1, F.lit(NATIVE_BITS))
                        carried = _let(_let(part, lambda p: pattern(letters, p, bits_of_word)), lambda bits: word_over_blocks(
                            bits, here, lambda k: F.get(fed, k),
                            lambda k: F.get(done["carries"], (k - done["first"]).cast("int")), base, size_b - need))
                        return F.struct(first.alias("first"), base.alias("base"), carried.alias("carries"))

                    start = F.struct(done["first"].alias("first"), done["base"].alias("base"), done["base"].alias("seen"))
                    return _let(F.aggregate(done["carries"], start, pass_by), along)

                start = F.struct(zero.alias("first"), zero.alias("base"), no_longs.alias("carries"))
                return F.aggregate(F.sequence(F.lit(0), (words_a - 1).cast("int")), start, word, lambda done: F.aggregate(
                    done["carries"], done["base"], lambda n, carries: n + ones(carries)))

            long_ = F.least(words_a, blocks_b) > 4 * NARROW_BLOCKS
            return F.aggregate(F.when(long_, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))), zero, walk)

        def in_blocks(codes: Column) -> Column:
            n = blocks(F.size(codes))
            padded = F.concat(codes, F.array_repeat(F.lit(0), n * NATIVE_BITS - F.size(codes)))
            return _let(padded, lambda all_: F.transform(
                F.sequence(F.lit(0), n - 1), lambda i: F.slice(all_, i * NATIVE_BITS + 1, F.lit(NATIVE_BITS))))

        codes = F.transform(chars(b), lambda c: F.array_position(letters, c).cast("int"))
        return _let(codes, lambda all_: _let(in_blocks(all_), lambda fed: over_words(all_, fed)))

    common = _let(chars(a), lambda in_a: _let(F.array_distinct(in_a), lambda letters: _let(
        bit_of, lambda bits: lcs(in_a, letters, bits))))
    total = F.length(a) + F.length(b)
    score = (F.lit(1.0) - (total - 2 * common) / total) * 100.0
    return F.when(a.isNull() | b.isNull(), None).when(total == 0, 100.0).otherwise(score)

"""Operators 11 to 13 against brute-force versions, with the cases their docstrings define."""

import html as html_lib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import inf, nan

import numpy as np
import pytest

from dqspark.llm import filter_audit, hard_negatives, html_extract, queries
from tests.llm.conftest import prose

# 11 filter interaction audit

LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def fails(rows):
    """Letters of the filters each row fails, by the words of the contract."""
    out = []
    for d, t, _ in rows:
        t = t or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        out.append({f for f, x in zip("ABCDE", (
            len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t),
            any(e is not None and d is not None and e < d and (u or "") == t for e, u, _ in rows)), strict=True) if x})
    return out


def brute_audit(rows, good, toxic):
    masks = fails(rows)
    out, shapley = {}, defaultdict(int)
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(d, m) for (d, _, lang), m in zip(rows, masks, strict=True) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [(d, m) for d, m in left if f in m]
                left = [(d, m) for d, m in left if f not in m]
                shapley[part, f] += len(gone)
                out[part, "".join(order), i + 1] = (
                    len(left), len(gone), sum(f in m for _, m in mine) - len(gone), sum(m == {f} for _, m in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f)
    return {(*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def audit_rows(df):
    return [tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                        "good_lost", "toxic_lost", "shapley").collect()]


def test_audit_matches_brute_force(spark, edge_repeated):
    copies = [(100 + i, "Many Copies Of # This text", ("de", None, "en")[i % 3], *["x"] * 2, 1, "k", "r", 1, 2, "d", "x")[:11]
              for i in range(60)]
    docs = edge_repeated.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([c[:3] for c in copies], "doc_id long, text string, lang string"))
    docs = docs.selectExpr("*", "'x' AS mask", "1 AS part", "'n' AS n", "0 AS step")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0, "p", 1) for i in range(0, 140, 2)]
                                   + [(5, 1, None, "p", 1), (5, None, 1, "p", 1), (None, 1, 1, "p", 1), (7, None, None, "p", 1)], LABELS)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    marks = labels.collect()
    good = {r["doc_id"] for r in marks if r["quality"] == 1} - {None}
    toxic = {r["doc_id"] for r in marks if r["toxic"] == 1} - {None}
    got = audit_rows(filter_audit.audit(docs, labels))
    assert len(got) == len(set(got)) == 3 * 600
    assert set(got) == brute_audit(rows, good, toxic)


def test_audit_of_nothing(spark, nothing):
    assert filter_audit.audit(nothing, spark.createDataFrame([], LABELS)).count() == 0


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        cover = Counter()
        for step, f, lo, hi in filter_audit.intervals(mask):
            for rank in range(lo, hi):
                cover[rank] += 1
                order = sorted(permutations(range(5)))[rank]
                assert order[step - 1] == f and [mask >> i & 1 for i in order].index(1) == step - 1
        assert cover == {r: 1 for r in range(120)}


# 12 hard negatives

EMB = "vec_id long, embedding array<float>, label int, key string, norm string, rank int"


def brute_negatives(rows, every, k, low):
    """Contract results by scoring everything; rows are (vec_id, vector, label) after the label change."""
    use = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows
           if i is not None and v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (a, va, ca) in enumerate(use):
        if a % every:
            continue
        scored = [(dot(va, v), i, c) for m, (i, v, c) in enumerate(use) if m != n]
        for ps, p, _ in sorted((x for x in scored if x[2] == ca), key=lambda x: (-x[0], x[1]))[:k]:
            hard = sorted((x for x in scored if x[2] != ca and low * ps <= 100 * x[0] <= 100 * ps), key=lambda x: (-x[0], x[1]))
            out += [(a, p, r + 1, i, ps, s) for r, (s, i, _) in enumerate(hard[:k])]
    return Counter(out)


def mined(df, **kw):
    return Counter(tuple(r) for r in hard_negatives.mine(df, **kw).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("bucket, block", [(8192, 512), (50, 7)])
def test_negatives_match_brute_force(spark, bucket, block):
    r = random.Random(5)
    centre = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.7) for c in centre[i % 6]], r.randrange(4)) for i in range(600)]
    rows += [(700 + i, list(rows[3][1]), i % 2) for i in range(150)]                  # one vector many times: ties
    rows += [(900 + i, [x * 40 for x in rows[i][1]], i % 4) for i in range(5)]        # very long ones
    rows += [(None, [1.0] * 12, 1), (1000, None, 1), (1001, [1.0, None] + [0.0] * 10, 1), (1002, [nan] * 12, 1), (1003, [inf] * 12, 1),
             (1004, [1.0] * 12, None), (1010, [], 2), (1020, [0.0] * 12, 2), (1030, [0.5] * 5, 2)]
    rows += rows[:3]                                                                  # repeated rows
    df = spark.createDataFrame([(*x, "k", "n", 1) for x in rows], EMB)
    assert mined(df, every=10, bucket=bucket, block=block) == brute_negatives(rows, 10, 5, 80)


def test_pruning_leaves_rows_out_and_loses_none():
    r = np.random.default_rng(0)
    vecs = np.floor(256 * r.normal(size=(3000, 8))).astype(np.int64)          # a bucket holds rows of like length
    vecs = vecs[np.argsort(-np.linalg.norm(vecs, axis=1))]
    row = {"bucket": 0, "dims": 8, "longest": float(np.linalg.norm(vecs, axis=1).max()),
           "ids": np.concatenate([np.arange(3000), np.arange(3000)]).tobytes(), "labels": np.zeros(3000, np.int64).tobytes(),
           "vecs": hard_negatives._small(vecs)}
    bucket, kept = hard_negatives.Bucket(row), 0
    for a in vecs[:200]:
        scores = vecs @ a
        wanted = int(np.sort(scores)[-6])
        rows = bucket.feasible(a, float(np.linalg.norm(a)), wanted)
        assert set(np.flatnonzero(scores >= wanted)) <= set(rows.tolist())
        kept += len(rows)
    assert kept < 0.5 * 200 * 3000


def test_scores_beyond_doubles_stay_exact(spark):
    big = 2.0 ** 22
    rows = [(0, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [big, 2.0], 0), (3, [big, 1.0], 1), (4, [big - 1, 2.0], 1)]
    df = spark.createDataFrame([(*x, "k", "n", 1) for x in rows], EMB)
    assert mined(df) == brute_negatives(rows, 100, 5, 80)


def test_negatives_of_nothing(spark):
    assert mined(spark.createDataFrame([], EMB)) == {}
    assert mined(spark.createDataFrame([(1, [1.0], 0, "k", "n", 1)], EMB)) == {}


# 13 main text of pages

PAGES = "/root/testdata/sf0.1/pages.parquet"
SENTENCES = ["The council met on Tuesday to discuss the new bridge, and several members spoke against it.",
             "It was late. Nobody had eaten anything since noon, which did not help.",
             "A vote is planned for the spring; the mayor said she was hopeful."]


@pytest.fixture(scope="module")
def chain(spark):
    return html_extract.fit(spark.read.parquet(PAGES))


def text_of(chain, page):
    return html_extract.main_text(chain, page, {})


def test_blocks_follow_the_markup():
    page = ("<!DOCTYPE html><title>no</title><p>a<b>b</b>\n c<br>d<p>e &amp;lt; &eacute;&nbsp;f<!-- <p>g --><script>var t='<p>h</p>';</script>"
            "<div hidden>i</div><ul><li>j<li>k <a href='x'>l</a></ul>m<table><tr><td>n<td>o<tr><td>p</table><div style='display: none'>q</div>r")
    assert [b.text for b in html_extract.blocks_of(page)] == ["ab c d", "e &lt; é f", "j", "k l", "m", "n", "o", "p", "r"]


@pytest.mark.parametrize("page", ["", "<", "<!--", "<a href=\"x", "<p", "</p></div>", "<script>x", "&", "<![CDATA[x]]>"])
def test_broken_pages_are_read(chain, page):
    assert isinstance(text_of(chain, page), str)


def test_deep_and_long_pages_are_read_whole(chain):
    deep = "<main><div>" * 20_000 + "<p>" + SENTENCES[0] + "</p>"
    assert text_of(chain, deep) == SENTENCES[0]
    many = "<article>" + "".join(f"<p>{i} {SENTENCES[i % 3]}</p>" for i in range(5_000)) + "</article><footer>x</footer>"
    assert text_of(chain, many) == " ".join(f"{i} {SENTENCES[i % 3]}" for i in range(5_000))
    for page in ("<a \"'" * 30_000, "<" * 100_000, "<b><div>x</b>" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000):
        text_of(chain, page)


ARTICLE = "".join(f"<p>{s}</p>" for s in SENTENCES)
WANT = "Bridge vote " + " ".join(SENTENCES)


@pytest.mark.parametrize("page", [
    f"<header><h1>My Site</h1></header><nav><a href=/>Home</a> <a href=/a>About</a></nav><main><article><h1>Bridge vote</h1>{ARTICLE}"
    "</article><section id=comments><h3>Comments</h3><div class=comment><p>I disagree, the bridge is fine.</p></div></section></main>"
    "<aside class=sidebar><h4>Related</h4><ul><li><a href=x>Ten bridges</a></li></ul></aside><footer>Copyright 2020</footer>",
    "<div class='cookie-banner'><p>We use cookies to give you the best experience.</p><button>OK</button></div><div id=header>Daily News</div>"
    f"<ul class=menu><li><a href=1>Politics</a><li><a href=2>Sport</a></ul><div class=content><h2>Bridge vote</h2>{ARTICLE}</div>"
    "<div class='sidebar'><p>Most read stories of the week are listed here.</p></div><div class=comments><p>Great article, thanks!</p>"
    "<p>First</p></div><form><label>Name</label><input></form><div class=footer>All rights reserved</div>",
    f"<article><h1>Bridge vote</h1><p>{SENTENCES[0]}</p><aside>Sponsored: buy this thing now</aside><p>{SENTENCES[1]}</p>"
    f"<p>{SENTENCES[2]}</p><form>Subscribe to our list<input></form><section class='comments'><h2>3 comments</h2><p>Nice one.</p></section></article>"])
def test_other_layouts_keep_the_article_only(chain, page):
    assert text_of(chain, page) == WANT


def test_held_out_layouts(chain):
    """Labelled blocks in layouts drawn anew: at least 98 of 100 blocks get their label."""
    r = random.Random(99)
    right = total = 0
    for _ in range(300):
        main = [f"{r.choice(SENTENCES)} {prose(r.randrange(10**6), r.randint(1, 60))}." for _ in range(r.randint(1, 9))]
        page, labels = html_extract._clothe(r, main, ["Home", "About us", "All rights reserved 2024", "Buy now, 20% off", "More news here"])
        blocks = html_extract.blocks_of(page)
        assert len(blocks) == len(labels)
        got = chain.viterbi(chain.page_scores(blocks, {}))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right >= 0.98 * total


def test_given_pages_give_their_articles(spark):
    """Whole table: the text inside ``article``, by a plain regular expression."""
    got = {r["page_id"]: r for r in queries.op13_html(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = " ".join(html_lib.unescape(re.sub("<[^>]*>", "", re.sub(r"<br>|</?p>|</h1>", " ", inner))).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_pages_with_nulls_and_clashing_columns(spark, chain):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, None, None, "t", 1), (1, "u", "", "t", 1), (None, "u", "<p>" + SENTENCES[0], "t", 1), (2, "u", f"<main>{ARTICLE}</main>", "t", 1)]
    got = html_extract.extract(spark.createDataFrame(rows + rows[3:], schema), chain).collect()
    full = " ".join(SENTENCES)
    assert Counter(map(tuple, got)) == Counter({(1, None, "", 0): 1, (1, "u", "", 0): 1, (None, "u", SENTENCES[0], len(SENTENCES[0])): 1,
                                                (2, "u", full, len(full)): 2})
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_gradient_is_the_slope_of_the_likelihood():
    r = np.random.default_rng(1)
    chain = html_extract.Chain()
    chain.steps = r.normal(size=(2, 2))
    pages = [([r.integers(0, 20, 3) for _ in range(n)], r.integers(0, 2, n).tolist()) for n in (1, 4, 4, 4)]

    def loss():
        """By listing all labellings."""
        total = 0.0
        for feats, labels in pages:
            s = np.array([chain.weights[f].sum(axis=0) for f in feats])
            value = lambda ys, s=s: sum(s[i, y] for i, y in enumerate(ys)) + sum(chain.steps[a, b] for a, b in zip(ys, ys[1:]))
            every = [[n >> i & 1 for i in range(len(s))] for n in range(2 ** len(s))]
            total += np.logaddexp.reduce([value(ys) for ys in every]) - value(labels)
        return total

    chain.weights[:20] = r.normal(size=(20, 2))
    assert chain.gradients(pages)[2] == pytest.approx(loss())
    pages = pages[1:]                           # equal lengths: one weight for all
    grad_w, grad_s, _ = chain.gradients(pages)
    for target, grad, at in ((chain.weights, grad_w, (3, 1)), (chain.weights, grad_w, (7, 0)), (chain.steps, grad_s, (0, 1))):
        target[at] += 1e-5
        up = loss()
        target[at] -= 2e-5
        down = loss()
        target[at] += 1e-5
        assert (up - down) / 2e-5 / 2 == pytest.approx(grad[at], abs=1e-5)       # sqrt(4) blocks
    best = max(([n >> i & 1 for i in range(4)] for n in range(16)), key=lambda ys: sum(
        chain.weights[f].sum(axis=0)[y] for f, y in zip(pages[0][0], ys, strict=True)) + sum(chain.steps[a, b] for a, b in zip(ys, ys[1:])))
    assert chain.viterbi([tuple(chain.weights[f].sum(axis=0)) for f in pages[0][0]]) == best

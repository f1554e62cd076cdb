"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word has two hashed ids, one of the whole word and one of its first four letters; its
embedding is the sum of both rows. Filters of width 1 to 3 slide over the embeddings, each
keeps its largest response over the text (max pooling), and a linear layer with a sigmoid
gives the score. Training runs on the driver over a bounded sample of labelled rows
(``max_per_class`` documents of each label, whole texts); max pooling sends gradient to one
place per filter and text, so a pass costs little more than the forward step. Scores are
calibrated by Platt scaling, and a decision threshold per language is chosen on rows held
back from the fit. Scoring never sees labels, language, source or ids.

Defined cases: null and empty texts score like a text without any telling word; documents
without a label or with a null label are never learnt from; repeated rows are scored each
by itself; with no usable labels of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import CACHE_ENTRIES, shared, slices

WORD_ROWS, STEM_ROWS = 1 << 17, 1 << 15
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
STEM = 4
#: Most documents of each label that the fit reads, and their most characters (longer ones are only scored).
MAX_PER_CLASS, MAX_FIT_CHARS = 4000, 40_000
EPOCHS, BATCH, RATE = 8, 32, 0.2
#: A small sample gets more epochs, up to so many steps.
LEAST_STEPS = 1500
TOXIC_AT = 0.7


class WordIds(dict):
    """Word bytes -> word row * STEM_ROWS + stem row; rows 0 are kept for padding."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        w = word.strip(b".,;:!?\"'()[]{}*#$%&|<>-_").lower()
        stem = w.decode("utf-8", "replace")[:STEM].encode()
        v = self[word] = ((1 + xxhash.xxh64_intdigest(w) % (WORD_ROWS - 1)) * STEM_ROWS
                          + 1 + xxhash.xxh64_intdigest(stem, 1) % (STEM_ROWS - 1))
        return v

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "replace").split()
        return np.fromiter(map(self.__getitem__, words), np.int64, count=len(words))


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in one array, each text followed by padding, and each text's start."""
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    flat = np.concatenate([x for t in texts for x in (t, pad)])
    lens = np.array([len(t) + len(pad) for t in texts])
    return flat, np.cumsum(lens) - lens


@dataclass
class Network:
    word: np.ndarray
    stem: np.ndarray
    conv: list[np.ndarray]            # per width: (width * DIM, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    trained: bool = False
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        word = r.normal(0, 0.1, (WORD_ROWS, DIM)).astype(np.float32)
        stem = r.normal(0, 0.1, (STEM_ROWS, DIM)).astype(np.float32)
        word[0] = stem[0] = 0
        conv = [r.normal(0, 0.4, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(word, stem, conv, np.zeros(n, np.float32), np.abs(r.normal(0, 0.4, n)).astype(np.float32))

    def _responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter responses at every place, (places, filters of all widths)."""
        x = self.word[ids // STEM_ROWS] + self.stem[ids % STEM_ROWS]
        x = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIM), np.float32)])
        out = []
        for w, kernel in zip(WIDTHS, self.conv, strict=True):
            y = x[:len(ids)] @ kernel[:DIM]
            for j in range(1, w):
                y += x[j:j + len(ids)] @ kernel[j * DIM:(j + 1) * DIM]
            out.append(y)
        return np.concatenate(out, axis=1)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        ids, starts = padded(texts)
        pooled = np.maximum(np.maximum.reduceat(self._responses(ids), starts, axis=0) + self.bias, 0)
        return pooled @ self.dense + self.offset

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        a, b = self.scale
        p = 1 / (1 + np.exp(-np.clip(a * self.logits(texts).astype(float) + b, -40, 40)))
        return np.round(p, 5)         # equal texts score alike, whatever batch they are in

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        """Adagrad over mini-batches; only the winning place of each filter gets gradient."""
        r = np.random.default_rng(seed)
        params = [self.word, self.stem, *self.conv, self.bias, self.dense]
        grown = [np.full(p.shape, 1e-2, np.float32) for p in params]
        seen = np.float32(1e-2)

        def descend(k: int, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
            p, g = params[k], grown[k]
            if rows is None:
                g += grad * grad
                p -= RATE * grad / np.sqrt(g)
            else:
                unique, at = np.unique(rows, return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, at, grad)
                total[unique == 0] = 0
                g[unique] += total * total
                p[unique] -= RATE * total / np.sqrt(g[unique])

        for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(texts))))):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                ids, starts = padded([texts[i] for i in pick])
                ends = np.append(starts[1:], len(ids))
                y = self._responses(ids)
                best = np.stack([y[a:b].argmax(0) + a for a, b in zip(starts, ends, strict=True)])
                top = np.take_along_axis(y, best, 0) + self.bias
                pooled = np.maximum(top, 0)
                z = pooled @ self.dense + self.offset
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[pick]).astype(np.float32) / len(pick)
                d_top = err[:, None] * self.dense[None, :] * (top > 0)
                d_dense = pooled.T @ err
                long_ids = np.concatenate([ids, np.zeros(max(WIDTHS) - 1, np.int64)])
                rows, grads, d_conv, f0 = [], [], [], 0
                for w, kernel in zip(WIDTHS, self.conv, strict=True):
                    d = d_top[:, f0:f0 + FILTERS]
                    places = best[:, f0:f0 + FILTERS]
                    dk = np.zeros_like(kernel)
                    for j in range(w):
                        at_ids = long_ids[places + j]                               # (texts, filters)
                        x = self.word[at_ids // STEM_ROWS] + self.stem[at_ids % STEM_ROWS]
                        dk[j * DIM:(j + 1) * DIM] = np.einsum("tf,tfd->df", d, x)
                        rows.append(at_ids.ravel())
                        grads.append((d[:, :, None] * kernel[j * DIM:(j + 1) * DIM].T[None]).reshape(-1, DIM))
                    d_conv.append(dk)
                    f0 += FILTERS
                all_rows, all_grads = np.concatenate(rows), np.concatenate(grads)
                descend(0, all_grads, all_rows // STEM_ROWS)
                descend(1, all_grads, all_rows % STEM_ROWS)
                for k, dk in enumerate(d_conv):
                    descend(2 + k, dk)
                descend(2 + len(WIDTHS), d_top.sum(0))
                descend(3 + len(WIDTHS), d_dense)
                g = float(err.sum())
                seen += g * g
                self.offset -= RATE * g / float(np.sqrt(seen))
        self.trained = True

    def calibrate(self, texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> None:
        """Platt scaling by Newton steps, then per language the threshold of the best F1."""
        z = np.concatenate([self.logits(texts[i:i + 256]) for i in range(0, len(texts), 256)]).astype(float)
        n1, n0 = labels.sum(), len(labels) - labels.sum()
        target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
        self.scale = (max(a, 1e-3), b)
        p = 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))
        for lang in {x for x in langs if x is not None}:
            mine = np.array([x == lang for x in langs])
            q, t = p[mine], labels[mine]
            if not t.sum():
                continue
            cuts = np.linspace(0.05, 0.95, 19)
            f1 = [2 * (t[q >= c].sum()) / max(1, (q >= c).sum() + t.sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
            self.thresholds[lang] = float(cuts[best[len(best) // 2]])


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learnt from: the crc32 remainder is not 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, seed: int = 0) -> Network:
    """Train on at most ``max_per_class`` documents of each label, a fifth of them for calibration."""
    pool = learnable(labels)
    order = F.xxhash64("doc_id", F.lit(seed))
    sample = pool.where("toxic = 1").orderBy(order).limit(max_per_class).unionByName(
        pool.where("toxic = 0").orderBy(order).limit(max_per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        F.col("lang").cast("string").alias("lang"))

    def run(batches):
        ids = WordIds()
        for big in batches:
            for b in slices(big, 256):
                rows = pa.array([ids.of(t).astype(np.uint32).view(np.int32) for t in b["text"].to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["toxic"], rows],
                                                 names=["doc_id", "lang", "toxic", "ids"])

    texts = texts.where(F.char_length("text") <= MAX_FIT_CHARS)
    rows = (texts.join(F.broadcast(sample), "doc_id").select("doc_id", "lang", "toxic", "text")   # 2 * max_per_class ids
            .mapInArrow(run, "doc_id long, lang string, toxic int, ids array<int>").toArrow())
    net = Network.fresh(seed)
    if not rows.num_rows:
        return net
    rows = rows.sort_by([("doc_id", "ascending")])
    ids = [x.values.to_numpy().view(np.uint32) for x in rows["ids"]]
    y = rows["toxic"].to_numpy().astype(np.float32)
    langs = rows["lang"].to_pylist()
    if y.min() == y.max():
        return net
    aside = np.array([xxhash.xxh64_intdigest(str(d), seed) % 5 == 0 for d in rows["doc_id"].to_pylist()])
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    if not len(learn) or not len(check) or y[check].min() == y[check].max():
        learn = check = np.arange(len(y))
    net.train([ids[i] for i in learn], y[learn], seed=seed)
    net.calibrate([ids[i] for i in check], y[check], [langs[i] for i in check])
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang, score) of every whole text; ``lang`` is passed through and never scored."""
    net_of = shared(docs.sparkSession, net)

    def run(batches):
        ids, own = WordIds(), net_of()
        for big in batches:
            for b in slices(big, 64):
                s = own.scores([ids.of(t) for t in b["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], pa.array(s, pa.float64())], names=["doc_id", "lang", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double")


def flagged(scored: DataFrame, net: Network) -> DataFrame:
    """``scored`` with the threshold of each document's language, and whether its score reaches it."""
    cut = F.lit(TOXIC_AT)
    for lang, at in sorted(net.thresholds.items()):
        cut = F.when(F.col("lang") == lang, F.lit(float(at))).otherwise(cut)
    return scored.withColumn("threshold", cut).withColumn("flagged", F.col("score") >= F.col("threshold"))


def classify(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """The contract's columns doc_id, held_out, score and predicted; then the language's threshold and its verdict."""
    net = fit(docs, labels, max_per_class)
    return flagged(score(docs, net), net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        "threshold", "flagged")

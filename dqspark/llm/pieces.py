"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The vocabulary comes from a public ``.model`` file (a path, never copied). Its file lists
pieces by rank; the log score of rank r is the Zipf log probability ``-ln(r + 1) - ln(H)``.
Encoding picks the segmentation of the highest total score; a character that no piece
covers falls back to its UTF-8 bytes. Blanks are written as the marker U+2581, with one
marker before the text (dummy prefix); decoding reverses that.

No piece holds a marker after another character, so a text splits exactly before each run
of markers (and around a line feed no piece holds): chunks are segmented once per task
and reused. All new chunks of a batch go through the trie together, as numpy arrays.

Defined cases: null and empty texts have no ids and decode to the empty text; a marker
that stands in the text itself decodes to a blank (``restored`` is then false); very long
chunks are segmented whole; repeated rows are encoded each by itself.
"""

from __future__ import annotations

import math
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dqspark.llm.common import CACHE_ENTRIES, doc_texts, gather, shared, slices

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6          # piece types of the model file
#: An unknown character scores this much under the lowest piece, as the public library does.
UNKNOWN_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes):
    """(number, value) of a protobuf message; a value is an int or bytes."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            v, i = b[i:i + n], i + n
        yield tag >> 3, v


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, file score, type) in id order."""
    out = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                d = dict(_fields(value))
                score = struct.unpack("<f", d[2])[0] if 2 in d else 0.0
                out.append((d.get(1, b"").decode("utf-8"), score, d.get(3, _NORMAL)))
    return out


class DoubleArray:
    """A double-array trie over character codes: child = base[node] + code, check[child] = node."""

    def __init__(self, words: dict[str, int]):
        chars = sorted({c for w in words for c in w})
        self.codes = {c: i + 1 for i, c in enumerate(chars)}
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for w, v in words.items():
            at = 0
            for c in w:
                nxt = tree[at].get(self.codes[c])
                if nxt is None:
                    nxt = tree[at][self.codes[c]] = len(tree)
                    tree.append({})
                    value.append(-1)
                at = nxt
            value[at] = v
        size = len(tree) + len(chars) + 2
        base = np.zeros(size * 2, np.int32)
        check = np.full(size * 2, -1, np.int32)
        leaf = np.full(size * 2, -1, np.int32)
        check[0] = 0
        place, free, stack = {0: 0}, 1, [0]
        while stack:
            node = stack.pop()
            kids = sorted(tree[node])
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            slot = free
            while True:
                b = slot - kids[0]
                if b >= 0 and check[slot] < 0 and all(check[b + k] < 0 for k in kids[1:]):
                    break
                slot += 1
                if slot + len(chars) + 2 >= len(check):
                    grow = len(check)
                    base = np.concatenate([base, np.zeros(grow, np.int32)])
                    check = np.concatenate([check, np.full(grow, -1, np.int32)])
                    leaf = np.concatenate([leaf, np.full(grow, -1, np.int32)])
            here = place[node]
            base[here] = b
            for k in kids:
                child = tree[node][k]
                place[child] = b + k
                check[b + k] = here
                leaf[b + k] = value[child]
                stack.append(child)
        last = int(np.flatnonzero(check >= 0)[-1]) + len(chars) + 2
        pad = max(0, last - len(check))
        self.base = np.pad(base, (0, pad))[:last]
        self.check = np.pad(check, (0, pad), constant_values=-1)[:last]
        self.leaf = np.pad(leaf, (0, pad), constant_values=-1)[:last]


class Model:
    """Pieces, scores and trie; small (a few MB), shipped to the tasks."""

    def __init__(self, path: str = DEFAULT_MODEL):
        pieces = read_pieces(path)
        normal = [i for i, (_, _, kind) in enumerate(pieces) if kind == _NORMAL]
        ranked = sorted(normal, key=lambda i: -pieces[i][1])
        harmonic = sum(1 / (r + 1) for r in range(len(ranked)))
        self.scores = np.full(len(pieces), -np.inf)
        for r, i in enumerate(ranked):
            self.scores[i] = -math.log(r + 1) - math.log(harmonic)
        self.unknown = float(self.scores[normal].min()) - UNKNOWN_PENALTY
        self.pieces = [p for p, _, _ in pieces]
        words = {self.pieces[i]: i for i in normal if self.pieces[i]}
        self.trie = DoubleArray(words)
        self.longest = max(map(len, words))
        self.byte_ids = np.zeros(256, np.int64)
        raw: list[bytes] = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(p.replace(MARK, " ").encode() if kind == _NORMAL else b"")
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.piece_lens = np.array([len(x) for x in raw], np.int64)
        self.piece_starts = np.cumsum(self.piece_lens) - self.piece_lens
        if any(MARK in p.lstrip(MARK) for p in words):
            split = r"(?s).+"                                  # a piece spans words: no split
        elif any("\n" in p for p in words):
            split = f"{MARK}*[^{MARK}]+|{MARK}+"
        else:
            split = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
        self.split = split

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of each chunk; all chunks advance through the trie together."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        at = 0
        while at < len(order):
            longest = len(words[order[at]])
            end = at
            while end < len(order) and len(words[order[end]]) <= max(8, 2 * longest) and (end - at) < 65536:
                end += 1
            group = order[at:end]
            for i, ids in zip(group, self._viterbi([words[i] for i in group]), strict=True):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, words: list[str]) -> list[np.ndarray]:
        n, lens = len(words), np.array([len(w) for w in words])
        width = int(lens.max())
        codes = np.zeros((n, width), np.int32)
        code = self.trie.codes
        flat = np.fromiter((code.get(c, 0) for w in words for c in w), np.int32, count=int(lens.sum()))
        codes[np.arange(width) < lens[:, None]] = flat
        base, check, leaf = self.trie.base, self.trie.check, self.trie.leaf
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((n, width + 1), -1, np.int32)
        step = np.ones((n, width + 1), np.int32)
        every = np.arange(n)
        for i in range(width):
            rows = every[lens > i]
            state = np.zeros(len(rows), np.int32)
            lone = rows
            for size in range(1, min(self.longest, width - i) + 1):
                c = codes[rows, i + size - 1]
                nxt = base[state] + c
                ok = (c > 0) & (check[nxt] == state)
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                v = leaf[state]
                has = v >= 0
                r, v = rows[has], v[has]
                if size == 1:
                    lone = np.setdiff1d(lone, r, assume_unique=True)
                score = best[r, i] + self.scores[v]
                better = score > best[r, i + size]
                r, v = r[better], v[better]
                best[r, i + size] = score[better]
                piece[r, i + size] = v
                step[r, i + size] = size
                alive = i + size < lens[rows]
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
            if len(lone):
                score = best[lone, i] + self.unknown
                r = lone[score > best[lone, i + 1]]
                best[r, i + 1] = best[r, i] + self.unknown
                piece[r, i + 1] = -1
                step[r, i + 1] = 1
        ids = np.full((n, width), -2, np.int32)
        pos, k, rows = lens.copy(), width - 1, every
        while len(rows):
            ids[rows, k] = piece[rows, pos[rows]]
            pos[rows] -= step[rows, pos[rows]]
            rows, k = rows[pos[rows] > 0], k - 1
        keep = ids != -2
        counts = keep.sum(1)
        flat_ids = ids[keep].astype(np.int64)
        parts = np.split(flat_ids, np.cumsum(counts)[:-1])
        for w in np.flatnonzero((ids == -1).any(1)):
            parts[w] = self._bytes(words[w], parts[w])
        return parts

    def _bytes(self, word: str, ids: np.ndarray) -> np.ndarray:
        """Replace each unknown character by the pieces of its UTF-8 bytes."""
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.pieces[i])
            else:
                out.extend(self.byte_ids[list(word[at].encode("utf-8", "replace"))].tolist())
                at += 1
        return np.array(out, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        text = gather(self.piece_bytes, self.piece_starts[ids], self.piece_lens[ids]).tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """A task's encoder: segmented chunks are kept in one flat array, up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.find = model, re.compile(model.split).findall
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int64), 0
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        chunks = [self.find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.index) > CACHE_ENTRIES:
            self._empty()
        fresh = list(set().union(*chunks).difference(self.index))
        if fresh:
            parts = self.model.viterbi(fresh)
            lens = np.array([len(p) for p in parts], np.int64)
            need = self.used + int(lens.sum())
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[:self.used], np.zeros(2 * need - self.used, np.int64)])
            self.flat[self.used:need] = np.concatenate(parts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.used = need
        per = np.array([len(c) for c in chunks], np.int64)
        at = np.fromiter((self.index[c] for row in chunks for c in row), np.int64, count=int(per.sum()))
        ln = self.lens[at]
        ends = np.concatenate([[0], np.cumsum(ln)])
        stops = np.cumsum(per)
        return gather(self.flat, self.starts[at], ln), ends[stops] - ends[stops - per]


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, restored boolean, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()),
                    ("restored", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back.

    The model file is read once, by the driver; tasks get the parsed model (bounded by the
    vocabulary) as a broadcast.
    """
    if not os.path.exists(model_path):
        raise FileNotFoundError(model_path)
    model_of = shared(docs.sparkSession, Model(model_path))

    def run(batches):
        model = model_of()
        encoder = Encoder(model)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[model.byte_ids] = True
        for big in batches:
            for batch in slices(big, 256):
                texts = batch["text"].to_pylist()
                ids, per = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(per)])
                from_bytes = np.concatenate([[0], np.cumsum(is_byte[ids])])
                same = [model.decode(ids[a:b]) == t
                        for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(per, pa.int64()),
                     pa.array(from_bytes[ends[1:]] - from_bytes[ends[:-1]], pa.int64()), pa.array(same, pa.bool_()), lists],
                    schema=_ARROW)

    return doc_texts(docs).mapInArrow(run, SCHEMA)


def decode(ids: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    model_of = shared(ids.sparkSession, Model(model_path))

    def run(batches):
        model = model_of()
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

"""Secret scan: base formats plus a randomness test battery with false-discovery control.

Candidates are runs of token characters. For each, the encoding is inferred from its
characters and three tests ask whether it looks like random symbols of that encoding:
chi-squared uniformity over the alphabet, a runs test around the median symbol, and the
lag-1 serial correlation. Fisher's method combines the three p-values.

Which results count is learnt from the corpus: symbol pairs of its texts, tokens left out, make
a chain of natural text, and the likelihood of a token under it over that under random symbols
is a p-value at any length (Markov's inequality); it is 1 where the three tests refute
randomness. The p-values are counted in bins per length stratum over all documents, and
Benjamini-Hochberg picks the lowest bin whose expected natural tokens are within ``max_fdr`` of
the candidates at or above it. The rule is the same at every size, and words and plain numbers
never enter it. The counts are tables of strata times bins and of symbol pairs, so only these
reach the driver.

Defined cases: null and empty texts hold nothing; repeated rows are scanned each by itself;
spans of the base formats always stay, and a candidate that overlaps one is not reported
again; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import doc_texts, slices, span_text, stored
from dqspark.llm.license_scan import NOTICES

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Lower bounds of the length strata, the false-discovery rate and the score bins (one per 0.1).
STRATA = (16, 24, 40, 64)
MAX_FDR = 0.01
MAX_BIN = 120
#: Bins per power of ten of a natural p-value, and the tests' p-value below which a token is not random.
PER_TEN = 4
MIN_RANDOM = 1e-3

_SYMBOLS = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-=")}
# Symbols of the encodings in code order; "any" holds tokens that mix them.
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_CODES = {name: {c: i for i, c in enumerate(symbols)} for name, symbols in {
    "hex": _DIGITS + "abcdef", "base32": _LETTERS + "234567", "lower36": _DIGITS + _LETTERS.lower(),
    "base64": _LETTERS + _LETTERS.lower() + _DIGITS + "+/", "base64url": _LETTERS + _LETTERS.lower() + _DIGITS + "-_",
    "any": "".join(_SYMBOLS)}.items()}
_ALPHABET = {name: len(codes) for name, codes in _CODES.items()}


def infer_encoding(token: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+=*", token):
        return "base32"
    if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", token):
        return "lower36"
    if re.fullmatch(r"[A-Za-z0-9+/]+=*", token):
        return "base64"
    return "base64url" if re.fullmatch(r"[A-Za-z0-9_-]+=*", token) else "any"


def _normal_tail(z: float) -> float:
    return max(1e-12, math.erfc(abs(z) / math.sqrt(2)))


def random_tests(token: str) -> tuple[str, float, float]:
    """(encoding, Fisher's combined p-value of the three tests, share of distinct symbols)."""
    encoding = infer_encoding(token)
    k = _ALPHABET[encoding]
    body = token.rstrip("=")
    x = np.fromiter(map(_CODES[encoding].__getitem__, body.lower() if encoding in ("hex", "lower36") else body), np.int64)
    n = len(x)
    if n < 8:
        return encoding, 0.0, 0.0
    counts = np.bincount(x, minlength=k)
    expected = n / k
    chi = float(((counts - expected) ** 2).sum() / expected)
    df = k - 1                                   # Wilson-Hilferty: chi-squared to normal
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    p_chi = max(1e-12, 0.5 * math.erfc(z_chi / math.sqrt(2)))
    above = x > np.median(x)
    a = int(above.sum())
    b = n - a
    if a and b:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _normal_tail((runs - mean) / math.sqrt(var))
    else:
        p_runs = 1e-12
    d = x - x.mean()
    spread = float((d * d).sum())
    p_serial = _normal_tail(float((d[1:] * d[:-1]).sum()) / spread * math.sqrt(n)) if spread else 1e-12
    fisher = -(math.log(p_chi) + math.log(p_runs) + math.log(p_serial))
    p = math.exp(-fisher) * (1 + fisher + fisher * fisher / 2)       # chi-squared tail with 6 degrees
    return encoding, p, len(np.unique(x)) / min(n, k)


def battery(token: str) -> tuple[str, float]:
    """(encoding, score): higher is more random.

    The score adds the fourth root of Fisher's combined p-value (how well the token fits
    random symbols) and the share of distinct symbols times the mix of character kinds.
    """
    encoding, p, distinct = random_tests(token)
    return encoding, score(token, p, distinct)


def score(token: str, p: float, distinct: float) -> float:
    mixed = (any(c.isdigit() for c in token) + any(c.islower() for c in token) + any(c.isupper() for c in token)) / 3
    return p ** 0.25 * 6 + 3 * distinct * mixed


#: Symbol pairs are counted over the token characters and one class for all others.
_CLASSES = len(_SYMBOLS) + 1
_CLASS_OF = np.full(256, len(_SYMBOLS), np.int64)
_CLASS_OF[[ord(c) for c in _SYMBOLS]] = list(_SYMBOLS.values())


def pair_counts(text: str) -> np.ndarray:
    x = _CLASS_OF[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return np.bincount(x[:-1] * _CLASSES + x[1:], minlength=_CLASSES * _CLASSES)


def _prior() -> np.ndarray:
    """Pairs of plain English, slugs and numbers, so that small corpora have a chain too."""
    notices = [text for text, _ in NOTICES]
    texts = [*notices, *map(str.title, notices), *map(str.upper, notices), *(str(n) for n in range(0, 2100, 3)),
             *(text.replace(" ", by) for text in notices for by in "-_/"),
             *(f"{y}{by}{m:02}{by}{y % 28 + 1:02}" for y in range(1990, 2030) for m in range(1, 13) for by in "-/")]
    return pair_counts("\n".join(texts))


def natural_chain(docs: DataFrame) -> np.ndarray:
    """Log probabilities of each symbol after each class, of two chains from the texts without their tokens.

    The first has the pairs of the corpus. The second knows only the kinds of characters,
    which mostly stay, so that words the corpus lacks are not random because their pairs are rare.
    """
    def run(batches):
        counts = np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch):
                counts += pair_counts("\n" + TOKEN.sub("\n", "\n".join(part["text"].to_pylist())) + "\n")
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["pair", "n"])

    rows = doc_texts(docs).select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = _prior().astype(float)
    for r in rows:
        counts[r["pair"]] += r["n"]
    counts = counts.reshape(_CLASSES, _CLASSES)[:, :-1]
    single = (counts.sum(axis=0) + 1) / (counts.sum() + _CLASSES - 1)
    chain = (counts + 20 * single) / (counts.sum(axis=1, keepdims=True) + 20)
    kinds = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in _SYMBOLS])
    own = 0.5 * single / np.bincount(kinds, single)[kinds] + 0.5 / np.bincount(kinds)[kinds]
    stay = np.where(np.append(kinds, -1)[:, None] == kinds, 0.8, 0.2 / 3)
    return np.log(np.stack([chain, stay * own]))


def natural_p(token: str, encoding: str, chain: np.ndarray) -> float:
    """log10 of a p-value of the token under natural text, against random symbols of its encoding."""
    body = token.rstrip("=")
    x = _CLASS_OF[np.frombuffer(body.encode(), np.uint8)]
    natural = np.logaddexp(*(chain[:, len(_SYMBOLS), x[0]] + chain[:, x[:-1], x[1:]].sum(axis=1))) - math.log(2)
    random = -len(x) * math.log(_ALPHABET[encoding]) - math.log(len(_ALPHABET))    # any of the encodings
    return min(0.0, (natural - random) / math.log(10))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = "struct<kind:string,start:long,end:long>"
_CAND = "struct<start:long,end:long,encoding:string,stratum:int,rare:int>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("candidates", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()),
                                       ("stratum", pa.int32()), ("rare", pa.int32())])))])


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: base spans, and the scored token candidates that overlap none of them."""
    chain = natural_chain(docs)

    def run(batches):
        for batch in batches:
            base, cands = [], []
            for text in batch["text"].to_pylist():
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                row = []
                for m in TOKEN.finditer(text):
                    s, e = m.span()
                    token = m.group()
                    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
                        continue                                  # words, joined words, plain numbers
                    if any(a < e and s < b for a, b, _ in spans):
                        continue
                    encoding, p, _ = random_tests(token)
                    rare = 0.0 if p < MIN_RANDOM else -natural_p(token, encoding, chain)
                    row.append({"start": s, "end": e, "encoding": encoding,
                                "stratum": sum(len(token) >= x for x in STRATA) - 1,
                                "rare": min(MAX_BIN, int(rare * PER_TEN))})
                cands.append(row)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(base, _ARROW.field(1).type), pa.array(cands, _ARROW.field(2).type)], schema=_ARROW)

    return doc_texts(docs).mapInArrow(run, f"doc_id long, base array<{_SPAN}>, candidates array<{_CAND}>")


def thresholds(found: DataFrame, max_fdr: float = MAX_FDR) -> dict[int, int]:
    """Per length stratum the lowest accepted p-value bin, from counts over all documents.

    Benjamini-Hochberg: with n candidates in the stratum, a bin whose p-values are at most p may hold
    n * p natural tokens, and is accepted while that is within ``max_fdr`` of the candidates at or beyond it.
    """
    rows = (found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.rare")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    out: dict[int, int] = {}
    for stratum in range(len(STRATA)):
        own = {r["rare"]: r["n"] for r in rows if r["stratum"] == stratum}
        beyond = 0
        for b in sorted(own, reverse=True):
            beyond += own[b]
            if sum(own.values()) * 10 ** (-b / PER_TEN) <= max_fdr * beyond:
                out[stratum] = b
    return out


def scan(docs: DataFrame, max_fdr: float = MAX_FDR) -> DataFrame:
    """(doc_id, base, spans): base spans, and base plus accepted random tokens, sorted by start and kind."""
    found = stored(candidates(docs), "secret-spans")
    cut = thresholds(found, max_fdr)

    def accepted(c: Column) -> Column:
        test = F.lit(False)
        for stratum, rare in cut.items():
            test = test | ((c["stratum"] == stratum) & (c["rare"] >= rare))
        return test

    extra = F.transform(F.filter("candidates", accepted),
                        lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    both = F.array_sort(F.transform(F.concat("base", extra), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.lit(list(KINDS)), s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", "base", both.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.encode(span_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))

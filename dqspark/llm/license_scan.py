"""Fuzzy short-notice search over licence notices.

Texts become lower-case word sequences. Base phrases are found at word boundaries. Each
notice of the table may differ by up to k edits (k = length * rate): cut into k + 1
pieces, at least one piece of any such occurrence is unchanged (pigeonhole), so one
Aho-Corasick pass over all pieces names the candidate places, and only windows around
them go through the regex library's bounded-error matching, which verifies the edits and
reports the span.

Defined cases: null and empty texts have no words, no places, empty labels, score 0;
repeated rows are scanned each by itself; spans are taken from the left, each improved in its
place, so an edited notice is reported beside a better one that follows; an empty table gives an
empty result; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dqspark.llm.common import doc_texts

# Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of common short notices, as normalised words.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Edits allowed per character of a notice.
ERROR_RATE = 0.12
#: Lower-cases A-Z and turns every separator of the word rule into a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    seeds: tuple[tuple[str, int], ...]


def split_notice(text: str, label: str, rate: float = ERROR_RATE) -> Notice:
    k = int(len(text) * rate)
    cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
    return Notice(text, label, k, tuple((text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)))


def words_of(text: str) -> list[str]:
    return text.encode("utf-8", "replace").translate(_TABLE).decode("utf-8", "replace").split(" ")


class Scanner:
    """Finds base places and fuzzy notices in one text."""

    def __init__(self, notices=NOTICES, rate: float = ERROR_RATE):
        self.notices = [split_notice(t, lab, rate) for t, lab in notices]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}")
                         for n in self.notices]
        seeds: dict[str, list] = {}
        for i, n in enumerate(self.notices):
            for piece, at in n.seeds:
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def base(self, line: str) -> list[tuple[int, str]]:
        """(word index, label) of every place; ``line`` is the words with blanks around."""
        found = []
        for phrase, label in PHRASES:
            needle, at = f" {phrase} ", line.find(f" {phrase} ")
            while at >= 0:
                found.append((line.count(" ", 0, at), label))
                at = line.find(needle, at + 1)
        return found

    def fuzzy(self, line: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) of verified notices, as characters of ``line``.

        Windows of one notice that touch are merged before the matching, so a repeated
        seed costs its neighbourhood once.
        """
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(line):
            start = end - size + 1
            for i, at in where:
                n = self.notices[i]
                lo, hi = max(0, start - at - n.edits), min(len(line), start - at + len(n.text) + n.edits)
                windows.setdefault(i, []).append([lo, hi])
        out = []
        for i, spans in windows.items():
            n, pat = self.notices[i], self.patterns[i]
            spans.sort()
            merged = [spans[0]]
            for lo, hi in spans[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                if not self._plausible(n, line, lo, hi):
                    continue
                for m in pat.finditer(line, lo, hi):
                    errors = sum(m.fuzzy_counts)
                    out.append((m.start(), m.end(), n.label, 1.0 - errors / len(n.text)))
        return sorted(out)

    @staticmethod
    def _plausible(n: Notice, line: str, lo: int, hi: int) -> bool:
        """Enough of the notice's letters are there: each missing one costs an edit."""
        window = line[lo:hi]
        missing = sum(max(0, n.text.count(c) - window.count(c)) for c in set(n.text))
        return missing <= n.edits


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:long,end:long,score:double>>")


def scan(docs: DataFrame, notices=NOTICES, rate: float = ERROR_RATE) -> DataFrame:
    """One row per document; ``spans`` are the fuzzy matches as word ranges (end exclusive)."""
    def run(batches):
        scanner = Scanner(notices, rate)
        fields = [f.split(" ")[0] for f in SCHEMA.split(", ")[:8]] + ["spans"]
        for batch in batches:
            cols: dict[str, list] = {f: [] for f in fields}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = [w for w in words_of(text) if w]
                line = f" {' '.join(words)} "
                base, fuzzy = scanner.base(line), scanner.fuzzy(line)
                places = [p for p, _ in base]
                labels = {lab for _, lab in base}
                row = (doc_id, len(words), len(base), min(places, default=None), max(places, default=None),
                       ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in fuzzy})),
                       1.0 if base else max((f[3] for f in fuzzy), default=0.0),
                       [{"label": lab, "start": max(0, line.count(" ", 0, s + 1) - 1),
                         "end": line.count(" ", 0, e), "score": sc} for s, e, lab, sc in fuzzy])
                for f, v in zip(fields, row, strict=True):
                    cols[f].append(v)
            yield pa.RecordBatch.from_pydict(cols, schema=_ARROW)

    return doc_texts(docs).mapInArrow(run, SCHEMA)


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                    ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                    ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])

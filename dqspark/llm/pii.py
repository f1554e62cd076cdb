"""Personal data: candidate spans scored by gradient boosting, all in DataFrame functions.

High-recall generators propose overlapping spans (mail-like runs, digit groups, coded ids).
Each gets small integer features of its format and context. Boosted trees, compiled into
one SQL expression, score them, and a calibrated threshold per generator selects what is
redacted beside the base formats. The text is never seen by Python: finding, offsets,
features, scores and redaction are built-in expressions, row by row, without a shuffle.

The trees are fitted on ``fit_docs`` documents at most (chosen by a hash), and only on
candidates that overlap no base span, since only these may be added. Positive are verified
structures (mod-97 codes, social security numbers) and verified base spans written anew in
their place: mails with obscured marks, phones without the plus sign or with other
separators, cards with other separators, cards as account numbers of a code with its check
digits. Negative is what a rule refutes: copies broken on purpose, failed checksums, dates,
years, thousands, digit counts that no format has, bare digit runs. What can be neither
verified nor refuted is left out. Equal feature vectors are counted by Spark, and only these
counts reach the driver, where the trees are grown. A fifth of the documents is held back to
calibrate the threshold of each generator for ``MIN_PRECISION`` on the same examples.

Offsets come from the text between the matches (split by the same pattern) and the matches;
possessive quantifiers keep the patterns linear and free of recursion on long runs.

Defined cases: null and empty texts hold nothing (redacting leaves a null null); repeated
rows are judged each by itself; overlapping spans are merged before they are redacted, the
first kind names them; without training candidates no spans are added to the base ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import span_text, stored

#: Base formats in the contract's order, then the generators.
BASE = ("email", "ip", "card", "phone")
GENERATED = ("contact", "number", "code")
_LOCAL = "A-Za-z0-9._%+-"
# The look-behinds start a run where it begins; \\G allows one right after a match.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "contact": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++"
               r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){5,}+",
    "code": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}+(?:\x20?[0-9])?+(?![A-Za-z0-9])",
}
_AT, _DOT = r"^.*?(?:@|[\[(](?:at|AT)[\])])", r"[.]|[\[(](?:dot|DOT)[\])]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]",
         "contact": "[EMAIL]", "number": "[NUMBER]", "code": "[ID]"}

FIT_DOCS = 20_000
TREES, DEPTH, SHRINK, MIN_ROWS = 20, 3, 0.3, 5.0
MIN_PRECISION = 0.98
FEATURES = ("gen", "digits", "length", "blanks", "dots", "dashes", "parens", "plus", "letters", "obscured",
            "distinct", "before", "after", "cue", "luhn", "quad")
_STEP = 128


def _sql(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(digits: str) -> str:
    """SQL: the digit string passes the Luhn sum."""
    x = f"try_cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    return (f"(aggregate(sequence(1, greatest(length({digits}), 1)), 0, (a, i) -> a + if(i % 2 = 1, coalesce({x}, 0),"
            f" coalesce(2 * {x} - if({x} > 4, 9, 0), 0))) % 10 = 0)")


def _mod97(chars: str) -> str:
    """SQL: a string of digits and capital letters (A = 10 ... Z = 35) modulo 97."""
    return (f"aggregate(transform(sequence(1, greatest(length({chars}), 1)), i -> substring({chars}, i, 1)), 0,"
            " (a, x) -> if(x rlike '[0-9]', a * 10 + coalesce(try_cast(x as int), 0), a * 100 + ascii(x) - 55) % 97)")


def _iban(code: str) -> str:
    """SQL: a code of two letters, two check digits and a number has the right check digits."""
    c = f"regexp_replace({code}, ' ', '')"
    return f"(length({c}) between 15 and 34 and {_mod97(f'concat(substring({c}, 5), left({c}, 4))')} = 1)"


def _occurrences(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``kind``: array of (start, end, text), code points from 0, of all leftmost matches."""
    pattern = _sql(PATTERNS[kind])
    guard = {"email": "contains(text, '@')", "contact": "(contains(text, '@') or contains(lower(text), 'at'))",
             "phone": "contains(text, '+')", "code": "digits"}.get(kind, "digits")
    if kind == "contact":
        guard = "(contains(text, '@') or contains(text, 'at)') or contains(text, 'at]') or contains(text, 'AT)') or contains(text, 'AT]'))"
    h, g = f"{kind}_hits", f"{kind}_gaps"
    df = df.withColumn(h, F.expr(f"case when {guard} then regexp_extract_all(text, {pattern}, 0) else array() end"))
    df = df.withColumn(g, F.expr(f"case when size({h}) > 0 then split(text, {pattern}, -1) else array() end"))
    df = df.withColumn(f"{kind}_sums", F.expr(f"zip_with(slice({g}, 1, size({h})), {h}, (a, b) -> length(a) + length(b))"))
    # Exclusive running sums in blocks, so that many matches do not cost their square.
    blocks = f"sequence(0, (size({h}) - 1) div {_STEP})"
    run = "array(0), (a, x) -> concat(a, array(element_at(a, -1) + x))"
    df = df.withColumn(f"{kind}_in", F.expr(
        f"case when size({h}) > 0 then transform({blocks}, b -> aggregate(slice({kind}_sums, int(b * {_STEP} + 1), {_STEP}), {run}))"
        " else array() end"))
    df = df.withColumn(f"{kind}_out", F.expr(f"aggregate(transform({kind}_in, a -> element_at(a, -1)), {run})"))
    at = f"{kind}_out[i div {_STEP}] + {kind}_in[i div {_STEP}][i % {_STEP}] + length({g}[i])"
    df = df.withColumn(kind, F.expr(f"transform({h}, (m, i) -> struct(int({at}) as start, int({at}) + length(m) as end, m as text))"))
    return df.drop(h, g, f"{kind}_sums", f"{kind}_in", f"{kind}_out")


_CHECK = {
    "email": "true",
    "ip": f"m.text rlike {_sql(f'^{_OCTET}([.]{_OCTET}){{3}}$')}",
    "card": "length(regexp_replace(m.text, '[^0-9]', '')) between 12 and 19 and "
            + _luhn("regexp_replace(m.text, '[^0-9]', '')"),
    "phone": "length(regexp_replace(m.text, '[^0-9]', '')) between 9 and 15",
}


def _around(where: str) -> str:
    """SQL: 0 at an edge or white space, 1 punctuation, 2 a letter, 3 a digit, 4 anything else."""
    return (f"case when {where} = '' or {where} rlike '\\\\s' then 0 when {where} rlike '[\\\\p{{L}}]' then 2"
            f" when {where} rlike '[0-9]' then 3 when {where} rlike '\\\\p{{Punct}}' then 1 else 4 end")


def _features(kind: str) -> str:
    """SQL: a struct of span and features per candidate of a generator."""
    digits = "regexp_replace(m.text, '[^0-9]', '')"
    near = "lower(substring(text, greatest(m.start - 19, 1), least(m.start, 20)))"
    dots, check = "regexp_count(m.text, '[.]')", _luhn(digits)
    if kind == "contact":                        # the marks of the domain, obscured ones too
        domain = f"regexp_replace(m.text, {_sql(_AT)}, '')"
        dots = f"regexp_count({domain}, {_sql(_DOT)})"
    elif kind == "code":
        check = _iban("m.text")
    return f"""transform({kind}, m -> struct(m.start as start, m.end as end, '{kind}' as kind,
        exists(base, b -> b.start < m.end and m.start < b.end) as hit,
        {GENERATED.index(kind)} as gen,
        least(length({digits}), 25) as digits,
        least(length(m.text), 60) as length,
        least(regexp_count(m.text, ' '), 5) as blanks,
        least({dots}, 5) as dots,
        least(regexp_count(m.text, '-'), 5) as dashes,
        least(regexp_count(m.text, '[()]'), 3) as parens,
        int(startswith(m.text, '+')) as plus,
        least(regexp_count(m.text, '[A-Za-z]'), 30) as letters,
        int(m.text rlike '(?i)[(\\\\[](at|dot)[)\\\\]]') as obscured,
        least(size(array_distinct(split({digits}, ''))), 10) as distinct,
        {_around("substring(text, m.start, if(m.start > 0, 1, 0))")} as before,
        {_around("substring(text, m.end + 1, 1)")} as after,
        case when {near} rlike 'phone|tel|call|fax|mobil|cell' then 1 when {near} rlike 'mail|contact' then 2
             when {near} rlike 'card|visa|iban|account|konto' then 3 when {near} rlike 'host|server|addr' then 4
             when {near} rlike '(ssn|passport|nr|no|id)[ .:#]*$' then 5 else 0 end as cue,
        int({check}) as luhn,
        int(m.text rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') as quad))"""


def find(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, text, ``base`` (verified spans in the contract's order) and ``candidates`` with features."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id")) if row is None else row
    df = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("digits", F.expr("text rlike '[0-9]'"))
    for kind in (*BASE, *GENERATED):
        df = _occurrences(df, kind)
    base = ", ".join(f"transform(filter({k}, m -> {_CHECK[k]}), m -> struct(m.start as start, {i} as rank, m.end as end, '{k}' as kind))"
                     for i, k in enumerate(BASE))
    df = df.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    df = df.withColumn("candidates", F.expr("concat(" + ", ".join(_features(k) for k in GENERATED) + ")"))
    return df.select("row", "text", "base", "candidates")


@dataclass
class Boosted:
    """Additive trees as SQL text over a candidate ``c``, and a threshold per generator."""

    start: float = 0.0
    trees: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin_sql(self) -> str:
        return " + ".join([f"{self.start!r}D", *self.trees])

    def accepts_sql(self) -> str:
        if not self.thresholds:
            return "false"
        cut = " ".join(f"when '{k}' then {v!r}D" for k, v in self.thresholds.items())
        return f"({self.margin_sql()}) >= (case c.kind {cut} else 1e9D end)"


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[Boosted, np.ndarray]:
    """Logistic gradient boosting over weighted distinct feature vectors."""
    mean = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4))
    model = Boosted(start=round(float(np.log(mean / (1 - mean))), 6))
    margin = np.full(len(y), model.start)

    def node(rows: np.ndarray, left: int, g: np.ndarray, h: np.ndarray, out: np.ndarray) -> str:
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if left:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    low = rows[x[rows, f] <= cut]
                    if w[low].sum() < MIN_ROWS or w[rows].sum() - w[low].sum() < MIN_ROWS:
                        continue
                    gl, hl = g[low].sum(), h[low].sum()
                    gain = gl * gl / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g ** 2 / (total_h + 1)
                    if gain > best[0]:
                        best = (gain, f, int(cut))
        if best[1] is None:
            value = round(float(-SHRINK * total_g / (total_h + 1)), 6)
            out[rows] = value
            return f"{value!r}D"
        under = x[rows, best[1]] <= best[2]
        return (f"if(c.{FEATURES[best[1]]} <= {best[2]}, {node(rows[under], left - 1, g, h, out)},"
                f" {node(rows[~under], left - 1, g, h, out)})")

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        model.trees.append(node(np.arange(len(y)), depth, w * (p - y), w * np.maximum(p * (1 - p), 1e-6), out))
        margin = margin + out
    return model, margin


_SSN = r"^(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}$"
_YEAR = r"(?:1[5-9]|20)[0-9]{2}"
_MONTH, _DAY = r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12][0-9]|3[01])"
#: Numbers that are something else: dates, runs of years, thousands.
_OTHER = (rf"^(?:{_YEAR}[.\x20-]{{1,2}}{_MONTH}[.\x20-]{{1,2}}{_DAY}|{_DAY}[.\x20-]{{1,2}}{_MONTH}[.\x20-]{{1,2}}{_YEAR}"
          rf"|{_MONTH}[.\x20-]{{1,2}}{_DAY}[.\x20-]{{1,2}}{_YEAR}|{_YEAR}(?:[.\x20-]{{1,2}}{_YEAR})+|[0-9]{{1,3}}(?:[.][0-9]{{3}})+)$")
#: SQL: 1 for a verified candidate ``c`` with text ``m``, 0 for a refuted one, null for neither.
_TRUTH = f"""case c.kind when 'code' then c.luhn when 'contact' then if(c.dots = 0, 0, null) else
    case when m rlike {_sql(_SSN)} then 1
         when c.digits < 9 or c.digits > 19 or c.quad = 1 or m rlike {_sql(_OTHER)} or (c.digits > 15 and c.luhn = 0)
              or (m rlike '^[0-9]+$' and c.cue = 0) then 0 end end"""
#: Weight of an example; the copies of one span share it.
_UNIT = 60


def _copies(found: DataFrame) -> DataFrame:
    """Verified spans written anew between the characters around them, true and broken: aside, y, w, at, to and text."""
    b = found.select("row.aside", "text", F.explode("base").alias("b")).where("b.kind <> 'ip'").selectExpr(
        "aside", "b.kind as kind", "substring(text, greatest(b.start - 23, 1), least(b.start, 24)) as front",
        "substring(text, b.start + 1, b.end - b.start) as p", "substring(text, b.end + 1, 24) as back")
    b = b.selectExpr("*", "regexp_replace(p, '[^0-9]', '') as d", "substring_index(p, '@', 1) as name",
                     "substring_index(p, '@', -1) as domain", "substring(p, 2) as q")
    b = b.withColumn("q", F.expr("if(q rlike '[^0-9]', q, regexp_replace(q, '([0-9]{3})(?=[0-9]{3})', '$1 '))"))
    b = b.withColumn("q", F.expr("if(q rlike '[^0-9]', q, null)"))
    b = b.withColumn("broken", F.expr(
        "if(length(d) > 15, concat(left(d, length(d) - 1), (int(right(d, 1)) + 1) % 10), null)"))
    for at, (land, number) in enumerate((("DE", "d"), ("GB", "if(length(d) > 13, concat('NWBK', left(d, 14)), null)"))):
        b = b.withColumn(f"n{at}", F.expr(f"if(kind = 'card', {number}, null)"))
        b = b.withColumn(f"c{at}", F.expr(f"98 - {_mod97(f'concat(n{at}, {_sql(land)}, {_sql("00")})')}"))
        for name, digits in (("good", f"c{at}"), ("bad", f"(c{at} - 1) % 97 + 2")):
            b = b.withColumn(f"{name}{at}", F.expr(f"concat('{land}', lpad(string({digits}), 2, '0'), n{at})"))
    joined = lambda x, by: f"regexp_replace({x}, '([0-9]{{4}})(?=[0-9])', '$1{by}')"
    fours = lambda x: f"regexp_replace({x}, '(.{{4}})(?=.)', '$1 ')"
    again = lambda by: f"regexp_replace(regexp_replace(q, '[()]', ''), '[ .-]+', '{by}')"
    local = "regexp_replace(q, '^[0-9]{1,3}[ .-]*', '')"
    label = "substring_index(domain, '.', 1)"
    codes = lambda name: [x for i in (0, 1) for x in (f"{name}{i}", fours(f"{name}{i}"))]
    groups = {
        "email": [(1, ["concat(name, ' [at] ', replace(domain, '.', ' [dot] '))", "concat(name, '(at)', replace(domain, '.', '(dot)'))",
                       "concat(name, ' (AT) ', replace(domain, '.', ' (DOT) '))", "concat(name, ' [at] ', domain)",
                       "concat(name, '@', replace(domain, '.', ' [dot] '))"]),
                  (0, [f"concat(name, ' [at] ', {label})", f"concat(name, '(at)', {label})", f"concat(name, '@', {label})"])],
        "phone": [(1, ["q", again("."), again("-"),
                       f"if(q rlike '^[0-9]{{1,3}}[ .(-]' and length(regexp_replace({local}, '[^0-9]', '')) > 8"
                       f" and {local} rlike '[^0-9]', {local}, null)"]), (0, ["left(d, 7)"])],
        "card": [(1, [joined("d", "."), joined("d", "  ")]), (0, [joined("broken", "."), joined("broken", "  ")]),
                 (1, codes("good")), (0, codes("bad"))],
    }
    whole = " ".join(f"when '{kind}' then concat(" + ", ".join(
        f"transform(array({', '.join(texts)}), x -> struct(x as x, {y} as y, {_UNIT // len(texts)} as w))" for y, texts in parts) + ")"
        for kind, parts in groups.items())
    b = b.select("aside", "front", "back", F.explode(F.expr(f"case kind {whole} end")).alias("e")).where("e.x is not null")
    return b.selectExpr("aside", "e.y as y", "e.w as w", "length(front) as at", "length(front) + length(e.x) as to",
                        "concat(front, e.x, back) as text")


def _examples(sample: DataFrame) -> DataFrame:
    """Labelled candidates that could be added: aside, y, w, c."""
    aside = (F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(12)), F.lit(5)) == 0).alias("aside")
    found = find(sample, F.struct(aside))
    own = found.select("row.aside", "text", F.explode("candidates").alias("c")).where("not c.hit").selectExpr(
        "aside", "c", "substring(text, c.start + 1, c.end - c.start) as m").selectExpr(
        "aside", f"{_TRUTH} as y", f"{_UNIT} as w", "c").where("y is not null")
    copies = find(stored(_copies(found), "pii-copies"), F.struct("aside", "y", "w", "at", "to"))
    copies = copies.select("row", F.explode("candidates").alias("c")).where(
        "not c.hit and c.start = row.at and c.end = row.to").select("row.aside", "row.y", "row.w", "c")
    return own.unionByName(copies)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Boosted:
    """Boosted trees and thresholds from at most about ``fit_docs`` documents."""
    total = docs.count()
    if not total:
        return Boosted()
    scale = 1 << 20
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(11)), F.lit(scale))
    sample = docs.select("doc_id", "text").where(place < int(min(1.0, fit_docs / total) * scale))
    counts = _examples(sample).groupBy("aside", "y", *[f"c.{f}" for f in FEATURES]).agg(F.sum("w").alias("n")).collect()
    if not counts:
        return Boosted()
    x = np.array([[r[f] for f in FEATURES] for r in counts], np.int64)
    y = np.array([float(r["y"]) for r in counts])
    n = np.array([r["n"] / _UNIT for r in counts])
    aside = np.array([r["aside"] for r in counts])
    keep = ~aside if (~aside).any() else np.ones(len(y), bool)
    order = np.lexsort(np.concatenate([x[keep], y[keep, None]], axis=1).T)       # an order that reruns share
    model, _ = grow(x[keep][order], y[keep][order], n[keep][order])
    margin = _margins(model, x)
    check = aside if aside.any() else np.ones(len(y), bool)
    for g, kind in enumerate(GENERATED):
        mine = check & (x[:, 0] == g)
        hits = 0.0
        rows = 0.0
        for m in sorted(set(margin[mine]), reverse=True):
            at = mine & (margin == m)
            rows, hits = rows + n[at].sum(), hits + (n[at] * y[at]).sum()
            if rows >= MIN_ROWS and hits / rows >= MIN_PRECISION:
                model.thresholds[kind] = float(m) - 1e-6
    return model


def _margins(model: Boosted, x: np.ndarray) -> np.ndarray:
    """The trees' sum for feature rows on the driver (only the counted vectors of the fit)."""
    out = np.full(len(x), model.start)
    for tree in model.trees:
        code = compile(_as_python(tree), "tree", "eval")
        out += [eval(code, {"c": row.tolist()}) for row in x]  # noqa: S307 - text made by grow() itself
    return out


def _as_python(tree: str) -> str:
    """``if(c.f <= k, a, b)`` as a Python expression over a list."""
    if not tree.startswith("if("):
        return tree.rstrip("D")
    depth, cuts = 0, []
    for i, ch in enumerate(tree):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 1:
            cuts.append(i)
    test, a, b = tree[3:cuts[0]], tree[cuts[0] + 1:cuts[1]].strip(), tree[cuts[1] + 1:-1].strip()
    name, value = test[2:].split(" <= ")
    return f"(({_as_python(a)}) if c[{FEATURES.index(name)}] <= {value} else ({_as_python(b)}))"


def spans(docs: DataFrame, model: Boosted | None = None, row: Column | None = None) -> DataFrame:
    """row, text, base and ``spans``: base spans plus selected candidates that overlap no base span."""
    model = fit(docs) if model is None else model
    df = find(docs, row)
    rank = " ".join(f"when '{k}' then {len(BASE) + i}" for i, k in enumerate(GENERATED))
    extra = (f"transform(filter(candidates, c -> not c.hit and {model.accepts_sql()}),"
             f" c -> struct(c.start as start, case c.kind {rank} end as rank, c.end as end, c.kind as kind))")
    return df.select("row", "text", "base", F.expr(f"array_sort(concat(base, {extra}))").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("row.doc_id", *[count(k) for k in BASE],
                        F.sha2(F.encode(span_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's mask; ``n_chars`` follows the text."""
    df = spans(docs, model, F.struct("*"))
    df = df.withColumn("merged", F.expr("""
        aggregate(spans, slice(spans, 1, 0), (a, s) -> case
            when size(a) > 0 and s.start < element_at(a, -1).end then
                concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'rank', element_at(a, -1).rank,
                    'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind)))
            else concat(a, array(s)) end)"""))
    mask = " ".join(f"when '{k}' then '{v}'" for k, v in _MASK.items())
    end = "coalesce(get(merged, int(i - 1)).end, 0)"
    df = df.withColumn("clean", F.expr(f"""
        case when size(merged) = 0 then row.text else concat(
            array_join(transform(merged, (s, i) -> concat(substring(text, {end} + 1, s.start - {end}), case s.kind {mask} end)), ''),
            substring(text, element_at(merged, -1).end + 1)) end"""))
    cells = []
    for name, kind in docs.dtypes:
        if name == "text":
            cells.append(F.col("clean").alias("text"))
        elif name == "n_chars":
            cells.append(F.when(F.size("merged") > 0, F.char_length("clean").cast(kind)).otherwise(F.col("row.n_chars")).alias(name))
        else:
            cells.append(F.col(f"row.`{name}`"))
    return df.select(*cells)

"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the text (no user functions). The rule
table names a metric with a lower and an upper bound; ``compile_rules`` turns it into
one boolean column plus the list of failed rules.

Defined cases: a null or empty text has no words, so all counts are 0 and it fails;
repeated rows are judged each by itself; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import SPACE

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for with this from are was on by be as it he at or an a not have which "
    "der die das und von mit den dem nicht ein eine zu im für auf ist des sich auch als "
    "le la les de des et un une du que qui pour par sur dans pas est en avec au "
    "el los las y en una por con para es se no su al lo como del"
).split()
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """The metric must lie in [low, high]; a bound of None does not hold."""

    metric: str
    low: float | None
    high: float | None


#: Lenient on purpose: a clean document must stay.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
    Rule("caps_ratio", None, 0.6),
)
MIN_WORDS = 50


def _counts(docs: DataFrame, row: Column) -> DataFrame:
    """Per document: words, lines and the base counts. All expressions are built in.

    ``row`` carries what the caller wants back, in one struct, so names never clash.
    """
    d = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "row", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    d = d.select(
        "row", "w", "lines", F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_caps"),
        F.regexp_count("text", F.lit("[a-z]")).cast("long").alias("n_lower"))
    # Repeated 3-word windows: sort (window hash, place) packed into one long, then
    # compare neighbours; equal hashes are confirmed on the words themselves.
    d = d.withColumn("packed", F.expr("""
        case when n_words >= 3 then sort_array(transform(sequence(0L, n_words - 3L),
            i -> pmod(xxhash64(w[i], w[i + 1], w[i + 2]), 4611686018427387904L div n_words) * n_words + i))
        else array() end"""))
    same = ("get(packed, int(k {d})) div n_words = x div n_words"
            " and w[x % n_words] = w[get(packed, int(k {d})) % n_words]"
            " and w[x % n_words + 1] = w[get(packed, int(k {d})) % n_words + 1]"
            " and w[x % n_words + 2] = w[get(packed, int(k {d})) % n_words + 2]")
    d = d.withColumn("starts", F.expr(
        f"sort_array(transform(filter(packed, (x, k) -> ({same.format(d='- 1')}) or ({same.format(d='+ 1')})),"
        " x -> x % n_words))"))
    d = d.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(starts, (p, k) -> least(3L, coalesce(get(starts, int(k + 1)) - p, 3L))),"
        " 0L, (a, x) -> a + x)"))
    stop = F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)))
    return d.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_caps", "n_lower", "n_repeat_words",
                    (F.col("n_lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                    stop.cast("long").alias("n_stop_words"))


def _ratio(top: str | Column, bottom: str | Column) -> Column:
    """A quotient that is 0 over nothing."""
    bottom = F.col(bottom) if isinstance(bottom, str) else bottom
    top = F.col(top) if isinstance(top, str) else top
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


METRICS = {
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_ratio": lambda: _ratio("n_repeat_words", "n_words"),
    "caps_ratio": lambda: _ratio("n_caps", F.col("n_caps") + F.col("n_lower")),
}


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules a row fails, as one array expression."""
    failed = []
    for r in rules:
        m, bad = METRICS[r.metric](), F.lit(False)
        if r.low is not None:
            bad = bad | (m < r.low)
        if r.high is not None:
            bad = bad | (m > r.high)
        failed.append(F.when(bad, F.lit(r.metric)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, row: Column | None = None) -> DataFrame:
    """Counts, base verdict, failed rules and ``kept`` for every document, beside ``row``."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id")) if row is None else row
    d = _counts(docs, row).withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                 | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("failed_rules", compile_rules(rules))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their own columns (one projection and a filter, no shuffle).

    The partition id in the filter keeps the optimizer from moving it under the projections,
    where each use of a word array would be written out again.
    """
    judged = judge(docs, rules, F.struct("*")).select("row", "kept", F.spark_partition_id().alias("part"))
    return judged.where(F.col("kept") & (F.col("part") >= 0)).select("row.*")

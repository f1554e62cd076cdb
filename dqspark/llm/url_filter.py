"""URL filters: host and path rules, then trust and distrust over the host graph.

Rules decide first (the longest that fits). Every other page is judged by its host: trust
is personalised PageRank from hosts with allowed pages along links, distrust is the same
walk from hosts with blocked pages against the links (who links to a bad host is suspect).
A host is blocked when its distrust outweighs its own trust by ``ratio``.

Edges are distinct host pairs: hyperlinks between hosts, and from each host to its nearest
ancestor domain that has pages itself. The pages are reduced to hosts and host pairs before
anything iterates, so a host with a third of all pages is one row.

Rank that a host without outgoing edges holds goes back to the seeds, as the jumps do. So the
ranks are, up to their sum, the series ``seed + d P seed + (d P)^2 seed + ...``: each round
sends on only what the last one moved (a join and an aggregate with the edge table, stored),
and the rounds end when less than ``tolerance`` of the rank moves, or nothing at all, as in a
graph without cycles, whatever its depth.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and
are judged by the empty host, which has no edges; repeated rows are judged each by itself;
null html has no links; an empty table gives an empty result; ties go to allow; other columns
than ``page_id``, ``url`` and ``html`` are never read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import stored


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rule list of the contract.
RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("example.org", "/en/1", "block"),
         UrlRule("com", "/fr/", "allow"), UrlRule("com", "/de/", "block"))
DAMPING, TOLERANCE, RATIO = 0.85, 1e-7, 1.0
#: Rounds whose tables are added up into one.
FOLD = 16
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, *LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none; one CASE, longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of hyperlinks."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""), F.lit(1))
    return (pages.where(F.col("html").isNotNull()).select(url_host(F.col("url")).alias("src"), F.explode(links).alias("url"))
            .select("src", url_host(F.col("url")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct())


def propagate(edges: DataFrame, seeds: DataFrame, hosts: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank, each summing to 1 where it has seeds.

    ``seeds`` is (host, good, bad), each column a distribution. A host without outgoing
    edges in a walk's direction returns its rank to that walk's seeds.
    """
    both = edges.select(F.lit("good").alias("walk"), "src", "dst").unionByName(
        edges.select(F.lit("bad").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.groupBy("walk", "src").agg(F.count(F.lit(1)).alias("degree"))
    both = stored(both.join(degree, ["walk", "src"]).select("walk", "src", "dst", (F.lit(damping) / F.col("degree")).alias("share")),
                  "url-edges")
    moved = stored(seeds.select("host", F.explode(F.array(F.struct(F.lit("good").alias("walk"), F.col("good").alias("rank")),
                                                          F.struct(F.lit("bad").alias("walk"), F.col("bad").alias("rank")))))
                   .select("col.walk", "host", "col.rank").where("rank > 0"), "url-seeds")
    parts, left = [moved], 2.0
    while left > tolerance:
        sent = both.join(moved.withColumnRenamed("host", "src"), ["walk", "src"]).groupBy("walk", F.col("dst").alias("host")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("rank"))
        moved = stored(sent, f"url-round{len(parts)}")
        left = float(moved.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0])
        if left:
            parts.append(moved)
        if len(parts) > FOLD:                            # the series so far in one table: plans stay short
            parts = [stored(_series(parts), "url-series")]
    ranks = _series(parts)
    total = {r["walk"]: r["total"] for r in ranks.groupBy("walk").agg(F.sum("rank").alias("total")).collect()}     # two rows
    pick = lambda w: F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("rank"))) / F.lit(total.get(w, 1.0)), F.lit(0.0))
    found = ranks.groupBy("host").agg(pick("good").alias("trust"), pick("bad").alias("distrust"))
    return hosts.join(found, "host", "left").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")])


def _series(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("walk", "host").agg(F.sum("rank").alias("rank"))


def nearest_ancestors(hosts: DataFrame, with_pages: DataFrame) -> DataFrame:
    """(src, dst): each host and the longest proper parent domain that has pages itself."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = hosts.where("host <> ''").where(F.size(labels) > 1).select(F.col("host").alias("src"), F.explode(above).alias("dst"))
    return up.join(with_pages.where("host <> ''").select(F.col("host").alias("dst")), "dst", "left_semi").groupBy("src").agg(
        F.max_by("dst", F.length("dst")).alias("dst"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE,
          ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html"))
    judged = p.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn(
        "hit", matched_rule(rules))
    per_host = stored(judged.groupBy("host").agg(
        F.sum((F.col("hit.verdict") == "allow").cast("double")).alias("good"),
        F.sum((F.col("hit.verdict") == "block").cast("double")).alias("bad")), "url-hosts")
    total = per_host.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = per_host.select("host", *[(F.coalesce(F.col(c), F.lit(0.0)) / F.lit(float(total[c] or 1.0))).alias(c)
                                      for c in ("good", "bad")])
    links = host_edges(p)
    hosts = stored(per_host.select("host").union(links.select("src")).union(links.select("dst")).distinct(), "url-all-hosts")
    parents = nearest_ancestors(hosts, per_host)
    edges = links.unionByName(parents).distinct()
    ranks = propagate(edges, seeds, hosts, damping, tolerance).select(
        "host", "trust", "distrust", (F.col("distrust") > F.lit(ratio) * F.col("trust")).alias("bad_host"))
    out = judged.join(stored(ranks, "url-ranks"), "host", "left")
    by_host = F.when(F.coalesce("bad_host", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce(F.col("hit.verdict"), by_host).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

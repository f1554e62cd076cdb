"""Driver queries of the corpus operators: one per operator, over whole tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import filter_audit, hard_negatives, html_extract, license_scan, mixing, ngram_join, pieces, pii, quality_rules, secret_scan, simhash, toxicity, url_filter
from dqspark.llm.common import stored
from dqspark.sources.tables import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(simhash.edit_and_fingerprint(table(spark, sf_dir, "documents")), "simhash-rows")
    return simhash.near_counts(rows).drop("hi", "lo")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn(
        "spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ","))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), moved=F.col("vec_id") % 7 == 0)



def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_toxicity, op4_quality_rules, op5_pii, op6_secrets,
                                   op7_ngram_join, op8_url_filter, op9_mixing, op10_licenses, op11_filter_audit,
                                   op12_hard_negatives, op13_html)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)),
                                  lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    tok AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
    win AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tok
            WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
                                     FROM win WHERE c IS NOT NULL) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY 1),
    m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
                 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lows,
                 len(list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{w}'" for w in quality_rules.STOP_WORDS)}))) AS stops
          FROM d LEFT JOIN rep USING (doc_id)),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND n_symbols <= 0.2 * n_words
           AND stops >= 0.03 * n_words AND n_dup_lines <= 0.5 * n_lines AND n_repeat_words <= 0.5 * n_words
           AND caps <= 0.6 * (caps + lows) AS kept FROM j"""

OP7_SQL = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.t)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(t) AS component_id
    FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2"""

OP11_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    m AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
              || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
              || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
              || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
              || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM t),
    l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
    g AS (SELECT part, fails, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i:i] AS x, filter_order[1:i] AS done
          FROM o, range(1, 6) r(i)),
    c AS (SELECT part, filter_order, step, any_value(x) AS x, sum(n) AS total,
                 sum(CASE WHEN translate(fails, done, '') = fails THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, done[1:step - 1], '') = fails THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN contains(fails, x) THEN n ELSE 0 END) AS failing,
                 sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, done[1:step - 1], '') = fails THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN contains(fails, x) AND translate(fails, done[1:step - 1], '') = fails THEN bad ELSE 0 END) AS toxic_lost
          FROM g, s GROUP BY 1, 2, 3)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(failing - removed AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c"""

OP12_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score,
           n.score AS negative_score
    FROM pos JOIN p n USING (anchor_id)
    WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op7_ngram_join": OP7_SQL, "op11_filter_audit": OP11_SQL,
                           "op12_hard_negatives": OP12_SQL}

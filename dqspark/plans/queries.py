"""Driver queries: each reads the given tables at ``sf_dir`` and runs one operator.

``QUERIES[name] = (spark_fn, oracle_sql_or_None)``. The oracle is DuckDB SQL over
the pre-registered table views; it must produce the same column names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dqspark.operators import profile as prof
from dqspark.sources.tables import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared derived views (same expression in Spark and in the oracle)

def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left join labels: natural nulls in ``quality`` and ``toxic``."""
    return (table(spark, sf_dir, "documents")
            .join(table(spark, sf_dir, "labels"), "doc_id", "left")
            .select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))


LABELLED_DOCUMENTS_SQL = """
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

LABELLED_DOCUMENTS_TYPES = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                            ("source", "string"), ("n_chars", "bigint"), ("quality", "int"),
                            ("toxic", "int")]

EVENTS_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                ("event_type", "string"), ("value", "double"), ("props", "string")]


def _profile_columns_sql(source_sql: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, dtype) in enumerate(cols):
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{dtype}' AS dtype, "
            f"count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) / greatest(count(*), 1) * 100, 2) AS null_rate, "
            f"count(DISTINCT {c}) AS unique_count FROM t")
    return f"WITH t AS ({source_sql}) " + " UNION ALL ".join(parts)


def _profile_table_sql(source_sql: str, cols: list[tuple[str, str]]) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c, _ in cols)
    n = len(cols)
    return (f"WITH t AS ({source_sql}) SELECT count(*) AS total_records, {n} AS total_columns, "
            f"CAST({nulls} AS BIGINT) AS total_nulls, "
            f"round(({nulls}) / greatest(count(*) * {n}, 1) * 100, 2) AS null_rate FROM t")


# ---------------------------------------------------------------------------
# A1-A7, A19 profile

@register("profile_columns", _profile_columns_sql(LABELLED_DOCUMENTS_SQL, LABELLED_DOCUMENTS_TYPES))
def q_profile_columns(spark, sf_dir):
    return prof.profile_columns(labelled_documents(spark, sf_dir))


@register("profile_table", _profile_table_sql(LABELLED_DOCUMENTS_SQL, LABELLED_DOCUMENTS_TYPES))
def q_profile_table(spark, sf_dir):
    return prof.profile_table(labelled_documents(spark, sf_dir))


@register("profile_events_columns", _profile_columns_sql("SELECT * FROM events", EVENTS_TYPES))
def q_profile_events_columns(spark, sf_dir):
    return prof.profile_columns(table(spark, sf_dir, "events"))


LINEITEM_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                  ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                  ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("profile_lineitem_columns", _profile_columns_sql("SELECT * FROM lineitem", LINEITEM_TYPES))
def q_profile_lineitem_columns(spark, sf_dir):
    """A2-A6 on a scanned table: keys by bitmaps, other columns by digests."""
    return prof.profile_columns(table(spark, sf_dir, "lineitem"), rescan=True)


# ---------------------------------------------------------------------------
# D1, A13 exact duplicates; A8, T1, W1 frequencies and ranks

from pyspark.sql import functions as F  # noqa: E402

from dqspark.operators import dedup  # noqa: E402
from dqspark.operators import repair as rep  # noqa: E402
from dqspark.functions import scalar  # noqa: E402


def exact_counts(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows (missing equals missing), rows removed."""
    removed = F.lit(dedup.exact_dedup(df)[1]).cast("long")
    return df.agg(F.count(F.lit(1)).alias("raw_count")).withColumn("clean_count", F.col("raw_count") - removed).withColumn("removed", removed)


@register("exact_dedup", "SELECT DISTINCT text, lang FROM documents")
def q_exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "documents").select("text", "lang"))[0]


@register("exact_removed", """
    SELECT count(*) AS raw_count, (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS clean_count,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS removed
    FROM documents""")
def q_exact_removed(spark, sf_dir):
    return exact_counts(table(spark, sf_dir, "documents").select("text", "lang"))


@register("exact_dedup_orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_exact_dedup_orders(spark, sf_dir):
    return dedup.exact_dedup(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))[0]


_ORDERS_TWICE_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0"


def orders_twice(spark, sf_dir):
    """Orders, every third of them repeated."""
    o = table(spark, sf_dir, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 3 == 0))


@register("exact_dedup_rows", f"SELECT DISTINCT * FROM ({_ORDERS_TWICE_SQL})")
def q_exact_dedup_rows(spark, sf_dir):
    """D1 by the operator, all columns."""
    return dedup.exact_dedup(orders_twice(spark, sf_dir))[0]


@register("exact_dedup_rows_removed", f"""
    SELECT (SELECT count(*) FROM ({_ORDERS_TWICE_SQL})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_ORDERS_TWICE_SQL}))) AS removed""")
def q_exact_dedup_rows_removed(spark, sf_dir):
    """A13 by the operator."""
    return spark.createDataFrame([(dedup.exact_dedup(orders_twice(spark, sf_dir))[1],)], "removed long")


@register("default_column_frequency", """
    SELECT c_name AS value, count(*) AS count FROM customer WHERE c_name IS NOT NULL GROUP BY 1""")
def q_default_column_frequency(spark, sf_dir):
    """P4 + A8: the frequencies of the column matched by default."""
    c = table(spark, sf_dir, "customer")
    return dedup.value_frequencies(c, scalar.default_match_column(c.columns))


@register("value_frequency", """
    SELECT CAST(p_name AS VARCHAR) AS value, count(*) AS count FROM part
    WHERE p_name IS NOT NULL GROUP BY 1""")
def q_value_frequency(spark, sf_dir):
    return dedup.value_frequencies(table(spark, sf_dir, "part"), "p_name")


@register("top_values", """
    SELECT value, count, row_number() OVER (ORDER BY count DESC, value) AS rank FROM (
      SELECT text AS value, count(*) AS count FROM documents WHERE text IS NOT NULL
      GROUP BY 1 ORDER BY count DESC, value LIMIT 100)""")
def q_top_values(spark, sf_dir):
    return dedup.top_values(dedup.value_frequencies(table(spark, sf_dir, "documents"), "text"), 100)


# ---------------------------------------------------------------------------
# D2, J1, D3-D5 near duplicates on part.p_name

def _fuzzy_sql(threshold: float, column: str = "p_name", source: str = "part", k: int = 10**12,
               materialized: bool = False) -> str:
    """Nodes, LCS by a row-fold recursion, edges, and the greedy walk over ranks.

    ``materialized`` asks DuckDB to compute the edges and the walk once (it may
    otherwise inline them into each use)."""
    sql = f"""
    WITH RECURSIVE
    nodes AS (
      SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM (
        SELECT CAST({column} AS VARCHAR) AS value, count(*) AS cnt FROM {source}
        WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value LIMIT {k})),
    pairs AS (
      SELECT a.rank AS rank_i, b.rank AS rank_j, a.value AS va, b.value AS vb
      FROM nodes a JOIN nodes b ON a.rank < b.rank),
    dp(rank_i, rank_j, va, vb, k, r) AS (
      SELECT rank_i, rank_j, va, vb, 0, list_transform(range(length(va) + 1), lambda x: 0) FROM pairs
      UNION ALL
      SELECT rank_i, rank_j, va, vb, k + 1,
             list_reduce(range(1, length(va) + 1),
                lambda acc, j: list_append(acc, CASE WHEN substr(va, j::INTEGER, 1) = substr(vb, k + 1, 1)
                                                THEN r[j] + 1 ELSE greatest(r[j + 1], acc[j]) END), [0])
      FROM dp WHERE k < length(vb)),
    scored AS (
      SELECT rank_i, rank_j, va AS original, vb AS duplicate,
             CASE WHEN length(va) + length(vb) = 0 THEN 100.0 ELSE
               (1.0 - (length(va) + length(vb) - 2 * r[length(va) + 1]) / (length(va) + length(vb))::DOUBLE) * 100
             END AS similarity
      FROM dp WHERE k = length(vb)),
    edges AS (SELECT * FROM scored WHERE similarity >= {float(threshold)}),
    walk(r, kept) AS (
      SELECT 0::BIGINT, []::BIGINT[]
      UNION ALL
      SELECT r + 1, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.rank_j = r + 1 AND list_contains(kept, e.rank_i))
                         THEN kept ELSE list_append(kept, r + 1) END
      FROM walk WHERE r < (SELECT count(*) FROM nodes)),
    kept AS (SELECT unnest(kept) AS rank FROM walk WHERE r = (SELECT count(*) FROM nodes)),
    dropped AS (SELECT n.value, n.cnt, n.rank FROM nodes n WHERE n.rank NOT IN (SELECT rank FROM kept)),
    matches AS (
      SELECT e.rank_j, min(e.rank_i) AS rank_i FROM edges e
      WHERE e.rank_i IN (SELECT rank FROM kept) AND e.rank_j IN (SELECT rank FROM dropped) GROUP BY e.rank_j)
    """
    if materialized:
        sql = sql.replace("edges AS (", "edges AS MATERIALIZED (").replace("kept AS (", "kept AS MATERIALIZED (")
    return sql


@register("fuzzy_pairs", _fuzzy_sql(70) + "SELECT rank_i, rank_j, original, duplicate, similarity FROM edges")
def q_fuzzy_pairs(spark, sf_dir):
    from dqspark.operators.blocking import similarity_edges
    nodes = dedup.ranked_values(table(spark, sf_dir, "part"), "p_name")
    return similarity_edges(nodes.select("rank", "value"), 70).select(
        "rank_i", "rank_j", F.col("value_i").alias("original"), F.col("value_j").alias("duplicate"), "similarity")


_NATION_TEXTS = """(SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS names
                     FROM supplier GROUP BY s_nationkey)"""


@register("similarity_native", _fuzzy_sql(60, "names", _NATION_TEXTS, materialized=True) + """
    SELECT rank_i, rank_j, similarity, similarity AS native FROM edges""")
def q_similarity_native(spark, sf_dir):
    """D2 twice: the batch kernel and the native expression, on the joined supplier names of each nation
    (more than one machine word long)."""
    from dqspark.functions.similarity import similarity_native
    from dqspark.operators.blocking import similarity_edges
    texts = (table(spark, sf_dir, "supplier").groupBy("s_nationkey")
             .agg(F.array_join(F.sort_array(F.collect_list("s_name")), ", ").alias("names")))
    nodes = dedup.ranked_values(texts, "names")
    return similarity_edges(nodes.select("rank", "value"), 60).select(
        "rank_i", "rank_j", "similarity", similarity_native(F.col("value_i"), F.col("value_j")).alias("native"))


@register("fuzzy_dedup", _fuzzy_sql(85) + """
    SELECT * FROM part WHERE p_name IS NULL OR CAST(p_name AS VARCHAR) NOT IN (SELECT value FROM dropped)""")
def q_fuzzy_dedup(spark, sf_dir):
    return dedup.fuzzy_dedup(table(spark, sf_dir, "part"), "p_name", 85).table


@register("fuzzy_dedup_lenient", _fuzzy_sql(70) + """
    SELECT * FROM part WHERE p_name IS NULL OR CAST(p_name AS VARCHAR) NOT IN (SELECT value FROM dropped)""")
def q_fuzzy_dedup_lenient(spark, sf_dir):
    return dedup.fuzzy_dedup(table(spark, sf_dir, "part"), "p_name", 70).table


@register("fuzzy_matches", _fuzzy_sql(70) + """
    SELECT e.original, e.duplicate, e.similarity, e.rank_i, e.rank_j FROM matches m
    JOIN edges e ON e.rank_i = m.rank_i AND e.rank_j = m.rank_j""")
def q_fuzzy_matches(spark, sf_dir):
    return dedup.fuzzy_dedup(table(spark, sf_dir, "part"), "p_name", 70).matches


@register("fuzzy_dedup_numbers", _fuzzy_sql(60, "p_size", materialized=True) + """
    SELECT * FROM part WHERE p_size IS NULL OR CAST(p_size AS VARCHAR) NOT IN (SELECT value FROM dropped)""")
def q_fuzzy_dedup_numbers(spark, sf_dir):
    """A numeric match column, compared as text."""
    return dedup.fuzzy_dedup(table(spark, sf_dir, "part"), "p_size", 60).table


@register("fuzzy_missing_column", "SELECT * FROM supplier")
def q_fuzzy_missing_column(spark, sf_dir):
    """P5: without the match column the table stays as it is."""
    return dedup.fuzzy_dedup(table(spark, sf_dir, "supplier"), "no_such_column", 85).table


@register("fuzzy_removed", _fuzzy_sql(70) + """
    SELECT (SELECT count(*) FROM nodes) AS "values", (SELECT count(*) FROM edges) AS pairs,
           CAST((SELECT coalesce(sum(cnt), 0) FROM dropped) AS BIGINT) AS removed""")
def q_fuzzy_removed(spark, sf_dir):
    from dqspark.operators.blocking import similarity_edges
    part = table(spark, sf_dir, "part")
    r = dedup.fuzzy_dedup(part, "p_name", 70)
    pairs = similarity_edges(dedup.ranked_values(part, "p_name"), 70).count()
    return spark.createDataFrame([(r.values, pairs, r.removed)], '`values` long, pairs long, removed long')


# uncapped on supplier names: every value takes part (the LIMIT is above any count)
UNCAPPED = 1_000_000_000


@register("fuzzy_dedup_suppliers", _fuzzy_sql(90, "s_name", "supplier", UNCAPPED, True) + """
    SELECT * FROM supplier WHERE s_name IS NULL OR CAST(s_name AS VARCHAR) NOT IN (SELECT value FROM dropped)""")
def q_fuzzy_dedup_suppliers(spark, sf_dir):
    """Uncapped near-duplicate removal: full ranking, band candidates, survivor rounds."""
    return dedup.fuzzy_dedup(table(spark, sf_dir, "supplier"), "s_name", 90, max_values=None).table


@register("fuzzy_matches_suppliers", _fuzzy_sql(90, "s_name", "supplier", UNCAPPED, True) + """
    SELECT e.original, e.duplicate, e.similarity FROM matches m
    JOIN edges e ON e.rank_i = m.rank_i AND e.rank_j = m.rank_j""")
def q_fuzzy_matches_suppliers(spark, sf_dir):
    """D5 uncapped: each dropped name with its first kept match (ranks differ in form, so omitted)."""
    r = dedup.fuzzy_dedup(table(spark, sf_dir, "supplier"), "s_name", 90, max_values=None)
    return r.matches.select("original", "duplicate", "similarity")


@register("fuzzy_dedup_rounds", _fuzzy_sql(90, "s_name", "supplier", UNCAPPED, True) + """
    SELECT * FROM supplier WHERE s_name IS NULL OR CAST(s_name AS VARCHAR) NOT IN (SELECT value FROM dropped)""")
def q_fuzzy_dedup_rounds(spark, sf_dir):
    """D3 in blocks of 16 ranks and up, so that several blocks meet the values kept so far."""
    return dedup.fuzzy_dedup(table(spark, sf_dir, "supplier"), "s_name", 90, first_block=16).table


#: The greedy walk over all customer names, each compared with the kept names alone.
CUSTOMER_WALK_SQL = """
    WITH RECURSIVE
    nodes AS (
      SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM (
        SELECT c_name AS value, count(*) AS cnt FROM customer WHERE c_name IS NOT NULL GROUP BY 1)),
    walk(r, kept, gone) AS (
      SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR
      UNION ALL
      SELECT r + 1, CASE WHEN hit THEN kept ELSE list_append(kept, value) END, CASE WHEN hit THEN value END
      FROM (SELECT w.r, w.kept, n.value,
                   len(list_filter(w.kept, lambda a:
                     (1.0 - (length(a) + length(n.value) - 2 * list_reduce(
                        range(1, length(n.value) + 1),
                        lambda row, k: list_reduce(range(1, length(a) + 1),
                           lambda acc, j: list_append(acc,
                              CASE WHEN substr(a, j::INTEGER, 1) = substr(n.value, k::INTEGER, 1)
                                   THEN row[j] + 1 ELSE greatest(row[j + 1], acc[j]) END), [0::BIGINT]),
                        list_transform(range(length(a) + 1), lambda x: 0::BIGINT))[length(a) + 1])
                      / (length(a) + length(n.value))::DOUBLE) * 100 >= 85.0)) > 0 AS hit
            FROM walk w JOIN nodes n ON n.rank = w.r + 1)),
    left_over AS MATERIALIZED (
      SELECT * FROM customer WHERE c_name IS NULL OR c_name NOT IN (SELECT gone FROM walk WHERE gone IS NOT NULL))
    """


@register("fuzzy_dedup_customers", CUSTOMER_WALK_SQL + "SELECT * FROM left_over")
def q_fuzzy_dedup_customers(spark, sf_dir):
    """Uncapped near-duplicate removal over all customer names."""
    return dedup.fuzzy_dedup(table(spark, sf_dir, "customer"), "c_name", 85, max_values=None).table


# ---------------------------------------------------------------------------
# R1-R6 repairs on a dirty view derived from customer

def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment"))
         .otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("@"))), F.lit(".example")))
         .alias("email"),
        (F.col("c_nationkey") * 6 - 20).alias("age"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_mktsegment")).alias("segment"))


PEOPLE_SQL = """
    SELECT c_custkey AS id, c_name AS name,
           CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment
                ELSE lower(replace(c_name, '#', '@')) || '.example' END AS email,
           c_nationkey * 6 - 20 AS age,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
           CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_mktsegment END AS segment
    FROM customer"""


@register("repair_full", f"""
    WITH p AS ({PEOPLE_SQL}), m AS (SELECT median(balance) AS mb, median(age) AS ma FROM p)
    SELECT id, name,
           CASE WHEN contains(coalesce(email, 'Unknown'), '@') THEN coalesce(email, 'Unknown') END AS email,
           CAST(CASE WHEN age < 0 OR age > 120 THEN coalesce(m.ma, 30) ELSE age END AS DOUBLE) AS age,
           CASE WHEN isinf(coalesce(balance, coalesce(m.mb, 0))) THEN NULL ELSE coalesce(balance, coalesce(m.mb, 0)) END AS balance,
           coalesce(segment, 'Unknown') AS segment
    FROM p, m""")
def q_repair_full(spark, sf_dir):
    return rep.repair(people(spark, sf_dir))[0]


@register("repair_log", f"""
    WITH p AS ({PEOPLE_SQL}),
    c AS (
      SELECT 0 AS ord, 'age' AS "column", 'invalid_age_fixed' AS type, count(*) FILTER (WHERE age < 0 OR age > 120) AS count FROM p
      UNION ALL SELECT 1, 'balance', 'null_filled_numeric', count(*) - count(balance) FROM p
      UNION ALL SELECT 2, 'name', 'null_filled_text', count(*) - count(name) FROM p
      UNION ALL SELECT 3, 'email', 'null_filled_text', count(*) - count(email) FROM p
      UNION ALL SELECT 4, 'email', 'invalid_email_flagged', count(*) FILTER (WHERE NOT coalesce(contains(email, '@'), false)) FROM p
      UNION ALL SELECT 5, 'segment', 'null_filled_text', count(*) - count(segment) FROM p)
    SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS step, "column", type, count
    FROM c WHERE count > 0""")
def q_repair_log(spark, sf_dir):
    return rep.repair(people(spark, sf_dir))[2]


@register("repair_labels", QUERIES["repair_log"][1].replace(
    'SELECT CAST(row_number()', 'SELECT "column", replace(type, \'_\', \' \') AS label, CAST(row_number()').replace(
    'AS step, "column", type, count', 'AS step, count'))
def q_repair_labels(spark, sf_dir):
    """C16 on the repair log."""
    log = rep.repair(people(spark, sf_dir))[2]
    return log.select("step", "column", scalar.repair_label(F.col("type")).alias("label"), "count")


@register("repair_numeric", f"""
    WITH t AS ({LABELLED_DOCUMENTS_SQL}), m AS (SELECT median(quality) AS mq, median(toxic) AS mt FROM t)
    SELECT doc_id, text, lang, source, n_chars,
           coalesce(quality, coalesce(m.mq, 0))::DOUBLE AS quality, coalesce(toxic, coalesce(m.mt, 0))::DOUBLE AS toxic
    FROM t, m""")
def q_repair_numeric(spark, sf_dir):
    return rep.repair(labelled_documents(spark, sf_dir))[0]


@register("repair_age", """
    WITH p AS (SELECT p_partkey, p_size * 3 - 20 AS age FROM part), m AS (SELECT median(age) AS ma FROM p)
    SELECT p_partkey, CAST(CASE WHEN age < 0 OR age > 120 THEN coalesce(m.ma, 30) ELSE age END AS DOUBLE) AS age FROM p, m""")
def q_repair_age(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3 - 20).alias("age"))
    return rep.repair(p)[0]


@register("repair_text", """
    SELECT o_orderkey, o_orderstatus,
           coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, 'Unknown') AS o_orderpriority
    FROM orders""")
def q_repair_text(spark, sf_dir):
    """Text nulls (priorities of pending orders) become ``Unknown``."""
    o = table(spark, sf_dir, "orders")
    return rep.repair(o.select("o_orderkey", "o_orderstatus",
                               F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
                               .alias("o_orderpriority")))[0]


SUPPLIER_EMAIL_SQL = """
    SELECT s_suppkey, s_name,
           CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 1000 THEN s_name
                ELSE lower(replace(s_name, '#', '@')) || '.example' END AS email
    FROM supplier"""


def supplier_emails(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", "s_name",
                    F.when(F.col("s_acctbal") < 0, F.lit(None).cast("string"))
                     .when(F.col("s_acctbal") < 1000, F.col("s_name"))
                     .otherwise(F.concat(F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("@"))),
                                         F.lit(".example"))).alias("email"))


@register("repair_email", f"""
    SELECT s_suppkey, s_name,
           CASE WHEN contains(coalesce(email, 'Unknown'), '@') THEN coalesce(email, 'Unknown') END AS email
    FROM ({SUPPLIER_EMAIL_SQL})""")
def q_repair_email(spark, sf_dir):
    """R3 then R4: a missing email is filled, found without ``@`` and nulled."""
    return rep.repair(supplier_emails(spark, sf_dir))[0]


@register("repair_email_log", f"""
    WITH p AS ({SUPPLIER_EMAIL_SQL}),
    c AS (SELECT 0 AS ord, 'email' AS "column", 'null_filled_text' AS type, count(*) - count(email) AS count FROM p
          UNION ALL SELECT 1, 'email', 'invalid_email_flagged',
                           count(*) FILTER (WHERE NOT coalesce(contains(email, '@'), false)) FROM p)
    SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS step, "column", type, count
    FROM c WHERE count > 0""")
def q_repair_email_log(spark, sf_dir):
    """A11 + R4 log: nulls are counted as filled and again as invalid."""
    return rep.repair(supplier_emails(spark, sf_dir))[2]


# ---------------------------------------------------------------------------
# C1 / R5 sanitise

EVENTS_DIRTY_SQL = """
    SELECT event_id, event_type,
           CASE WHEN event_type = 'error' THEN 'inf'::DOUBLE WHEN event_type = 'purchase' THEN '-inf'::DOUBLE
                WHEN value > 90 THEN 'nan'::DOUBLE ELSE value END AS value
    FROM events"""


def events_dirty(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type",
                    F.when(F.col("event_type") == "error", F.lit(float("inf")))
                     .when(F.col("event_type") == "purchase", F.lit(float("-inf")))
                     .when(F.col("value") > 90, F.lit(float("nan")))
                     .otherwise(F.col("value")).alias("value"))


@register("sanitise", f"""
    SELECT event_id, event_type, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value
    FROM ({EVENTS_DIRTY_SQL})""")
def q_sanitise(spark, sf_dir):
    return scalar.sanitize(events_dirty(spark, sf_dir))


@register("repair_infinite", f"""
    WITH d AS ({EVENTS_DIRTY_SQL}), m AS (SELECT median(value) AS mv FROM d WHERE NOT isnan(value)),
    f AS (SELECT event_id, event_type, CASE WHEN value IS NULL OR isnan(value) THEN coalesce(m.mv, 0) ELSE value END AS value FROM d, m)
    SELECT event_id, coalesce(event_type, 'Unknown') AS event_type, CASE WHEN isinf(value) THEN NULL ELSE value END AS value FROM f""")
def q_repair_infinite(spark, sf_dir):
    """R1 then R5: NaN is filled with the median (infinities count in it), infinities end as null."""
    return rep.repair(events_dirty(spark, sf_dir))[0]


def embeddings_dirty(spark, sf_dir):
    """Embeddings with +inf above 0.2 and NaN below -0.2, element by element."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.2, F.lit(float("inf")).cast("float"))
                    .when(x.cast("double") < -0.2, F.lit(float("nan")).cast("float")).otherwise(x))
    return e.select("vec_id", "label", v.alias("embedding"))


@register("sanitise_nested", """
    WITH d AS (
      SELECT vec_id, label,
             list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > 0.2 THEN 'inf'::FLOAT
                                                 WHEN CAST(x AS DOUBLE) < -0.2 THEN 'nan'::FLOAT ELSE x END) AS embedding
      FROM embeddings),
    c AS (SELECT vec_id, label,
                 list_transform(embedding, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END) AS embedding
          FROM d)
    SELECT vec_id, label, len(list_filter(embedding, lambda x: x IS NULL)) AS nulled,
           len(list_filter(embedding, lambda x: x IS NOT NULL)) AS kept, CAST(list_max(embedding) AS DOUBLE) AS top
    FROM c""")
def q_sanitise_nested(spark, sf_dir):
    """C1 inside arrays: NaN and +-inf elements become null, the rest stay."""
    v = F.col("embedding")
    return scalar.sanitize(embeddings_dirty(spark, sf_dir)).select(
        "vec_id", "label",
        F.size(F.filter(v, lambda x: x.isNull())).cast("long").alias("nulled"),
        F.size(F.filter(v, lambda x: x.isNotNull())).cast("long").alias("kept"),
        F.array_max(v).cast("double").alias("top"))


# ---------------------------------------------------------------------------
# K1-K6 quality index, C11-C13 report words

from dqspark.operators import quality as qual  # noqa: E402
from dqspark.operators import anomaly as anom  # noqa: E402
from dqspark.plans import runs as runs_mod  # noqa: E402
from dqspark.sources import csv as csv_source  # noqa: E402
from dqspark.plans import cleaning  # noqa: E402
from dqspark.session import ensure_checkpoint_dir, staged  # noqa: E402
from dqspark.sources import sinks  # noqa: E402

_QCOLS = ["text", "lang", "source", "quality", "toxic", "anomaly_flag"]


def _quality_inputs(spark, sf_dir):
    raw = labelled_documents(spark, sf_dir).select("text", "lang", "source", "quality", "toxic")
    clean = raw.dropDuplicates().withColumn(
        "anomaly_flag", F.when(F.col("toxic") == 1, F.lit(qual.ANOMALY)).otherwise(F.lit(qual.NORMAL)))
    return raw, clean


_QUALITY_SQL = f"""
    WITH raw AS (SELECT d.text, d.lang, d.source, l.quality, l.toxic
                 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    c AS (SELECT *, CASE WHEN toxic = 1 THEN 'Anomaly' ELSE 'Normal' END AS anomaly_flag
          FROM (SELECT DISTINCT * FROM raw)),
    s AS (SELECT greatest(count(*), 1) AS n, (SELECT count(*) FROM raw) AS raw_n,
                 {" + ".join(f"(count(*) - count({c}))" for c in _QCOLS)} AS nulls,
                 count(*) FILTER (WHERE anomaly_flag = 'Anomaly') AS anomalies,
                 {", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in _QCOLS)}
          FROM c),
    k AS (SELECT round(1 - nulls / greatest(n * {len(_QCOLS)}, 1), 4) AS c,
                 round(n / greatest(raw_n, 1), 4) AS u,
                 round(1 - anomalies / n, 4) AS v,
                 round(({" + ".join(f"d_{c} / n" for c in _QCOLS)}) / {len(_QCOLS)}, 4) AS s
          FROM s),
    q AS (SELECT greatest(0, least(100, round(c * 100, 1))) AS completeness,
                 greatest(0, least(100, round(u * 100, 1))) AS uniqueness,
                 greatest(0, least(100, round(v * 100, 1))) AS validity,
                 greatest(0, least(100, round(s * 100, 1))) AS consistency,
                 greatest(0, least(100, round(round(least(c, v), 4) * 100, 1))) AS accuracy,
                 greatest(0, least(100, round((c + u + v + s + round(least(c, v), 4)) / 5 * 100, 2))) AS cqi_score
          FROM k)
    """


@register("quality_index", _QUALITY_SQL + "SELECT * FROM q")
def q_quality_index(spark, sf_dir):
    raw, clean = _quality_inputs(spark, sf_dir)
    return qual.quality_index(clean, raw.count())


@register("quality_verdict", _QUALITY_SQL + """
    SELECT cqi_score, CASE WHEN cqi_score >= 80 THEN 'Excellent' WHEN cqi_score >= 60 THEN 'Acceptable'
                           ELSE 'Poor' END AS verdict FROM q""")
def q_quality_verdict(spark, sf_dir):
    raw, clean = _quality_inputs(spark, sf_dir)
    return qual.with_verdict(qual.quality_index(clean, raw.count())).select("cqi_score", "verdict")


@register("column_status", _profile_columns_sql(LABELLED_DOCUMENTS_SQL, LABELLED_DOCUMENTS_TYPES).replace(
    "WITH t AS", "WITH p AS (WITH t AS", 1) + """)
    SELECT "column", null_count, CASE WHEN null_count = 0 THEN 'Clean' ELSE 'Has Nulls' END AS status FROM p""")
def q_column_status(spark, sf_dir):
    cols = prof.profile_columns(labelled_documents(spark, sf_dir))
    return cols.select("column", "null_count", scalar.column_status(F.col("null_count")).alias("status"))


@register("match_severity", _fuzzy_sql(70) + """
    SELECT rank_i, rank_j, similarity, CASE WHEN similarity >= 90 THEN 'High' ELSE 'Medium' END AS severity
    FROM edges""")
def q_match_severity(spark, sf_dir):
    return q_fuzzy_pairs(spark, sf_dir).select(
        "rank_i", "rank_j", "similarity", scalar.match_severity(F.col("similarity")).alias("severity"))


# ---------------------------------------------------------------------------
# U2, J3, P10, A17, C14 run records (a runs table derived from orders, outputs from lineitem)

def runs_from_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("complete"))
         .when(F.col("o_orderstatus") == "O", F.lit("running")).otherwise(F.lit("error")).alias("status"),
        F.col("o_totalprice").alias("cqi_score"),
        (F.length("o_orderpriority") * 10 + 40).cast("double").alias("threshold"),
        F.col("o_orderdate").alias("updated_at"))


def run_rows(spark, sf_dir):
    """Two status rows per job: it ran, and a day later it had its present state."""
    now = runs_from_orders(spark, sf_dir)
    then = now.withColumns({"status": F.lit("running"), "cqi_score": F.lit(None).cast("double"),
                            "updated_at": F.col("updated_at") - F.expr("interval 1 day")})
    return then.unionByName(now)


def outputs_from_lineitem(spark, sf_dir):
    """Outputs of suppliers; those with even keys carry the id of a recorded job."""
    li = table(spark, sf_dir, "lineitem")
    prefix = F.when(F.col("l_suppkey") % 2 == 0, F.lit("j")).otherwise(F.lit("s"))
    return (li.groupBy(F.concat(prefix, F.col("l_suppkey").cast("string")).alias("job_id"))
            .agg(F.count(F.lit(1)).alias("clean_records")))


RUNS_SQL = """
    WITH r AS (SELECT 'j' || CAST(o_orderkey AS VARCHAR) AS job_id,
                      CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
                      o_totalprice AS cqi_score, CAST(length(o_orderpriority) * 10 + 40 AS DOUBLE) AS threshold
               FROM orders),
    o AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'j' ELSE 's' END || CAST(l_suppkey AS VARCHAR) AS job_id, count(*) AS clean_records FROM lineitem GROUP BY 1)
    """


@register("run_history", RUNS_SQL + """
    SELECT job_id, status, cqi_score, CAST(NULL AS DOUBLE) AS clean_records FROM r WHERE status IN ('complete', 'error')
    UNION ALL
    SELECT job_id, 'complete', CAST(NULL AS DOUBLE), CAST(clean_records AS DOUBLE) FROM o
    WHERE job_id NOT IN (SELECT job_id FROM r)""")
def q_run_history(spark, sf_dir):
    runs = run_rows(spark, sf_dir)
    return runs_mod.run_history(runs_mod.latest_runs(runs), outputs_from_lineitem(spark, sf_dir), runs).select(
        "job_id", "status", "cqi_score", F.col("clean_records").cast("double").alias("clean_records"))


@register("run_counters", RUNS_SQL + """
    SELECT count(*) FILTER (WHERE status = 'running') AS active_jobs, count(*) AS total_jobs FROM r""")
def q_run_counters(spark, sf_dir):
    return runs_mod.run_counters(runs_mod.latest_runs(run_rows(spark, sf_dir)))


@register("threshold_band", RUNS_SQL + """
    SELECT job_id, threshold, CASE WHEN threshold >= 90 THEN 'Strict' WHEN threshold >= 80 THEN 'Balanced'
                                   ELSE 'Lenient' END AS band FROM r""")
def q_threshold_band(spark, sf_dir):
    return runs_mod.with_band(runs_from_orders(spark, sf_dir)).select("job_id", "threshold", "band")


# ---------------------------------------------------------------------------
# C8-C10, C15 report texts; S3, S4 inference over dirty text

@register("output_job_ids", """
    SELECT file, split_part(split_part(file, '/', 2), '_', 1) AS job_id
    FROM (SELECT 'outputs/' || o_orderkey || '_' || o_orderstatus || '_clean.csv' AS file FROM orders)""")
def q_output_job_ids(spark, sf_dir):
    """Job ids from output file names."""
    file = F.concat_ws("", F.lit("outputs/"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_orderstatus"),
                       F.lit("_clean.csv"))
    return table(spark, sf_dir, "orders").select(file.alias("file")).withColumn("job_id", scalar.job_id_of(F.col("file")))


@register("event_times", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM events""")
def q_event_times(spark, sf_dir):
    """ISO-8601 text of every event's time."""
    return table(spark, sf_dir, "events").select("event_id", scalar.utc_iso(F.col("ts")).alias("time"))


@register("user_durations", """
    WITH e AS (SELECT user_id, round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0, 2) AS elapsed
               FROM events GROUP BY user_id),
    s AS (SELECT *, CAST(floor(elapsed) AS BIGINT) AS n FROM e)
    SELECT user_id, elapsed, (n // 3600) || 'h ' || ((n % 3600) // 60) || 'm ' || (n % 60) || 's' AS duration FROM s""")
def q_user_durations(spark, sf_dir):
    """C10 + C15: time between a user's first and last event."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        scalar.elapsed(F.min("ts"), F.max("ts")).alias("elapsed"))
    return e.withColumn("duration", scalar.duration_text(F.col("elapsed")))


@register("csv_types", """
    SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS nation,
           CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance, c_acctbal >= 0 AS flag,
           CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_acctbal >= 0 THEN 'True' ELSE 'False' END AS some_flag,
           CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, CAST(NULL AS DOUBLE) AS nothing
    FROM customer""")
def q_csv_types(spark, sf_dir):
    """S3 + S4: customers as a CSV scan hands them over (text, missing-value words, leading blanks), typed again."""
    key, rich = F.col("c_custkey"), F.col("c_acctbal") >= 0
    raw = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(key % 7 == 0, "N/A").when(key % 5 == 0, "nan").otherwise(F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(rich, "True").otherwise("false").alias("flag"),
        F.when(key % 3 == 0, "NULL").when(rich, "True").otherwise("False").alias("some_flag"),
        F.when(F.col("c_mktsegment") == "BUILDING", "null").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.lit("").alias("nothing"))
    clean = csv_source.na_to_null(raw)
    return csv_source.cast_types(clean, csv_source.infer_types(clean))


# ---------------------------------------------------------------------------
# M1-M6 anomaly flags (the flagged rows have no SQL twin; the count rule has one)

@register("anomaly_flags", None)
def q_anomaly_flags(spark, sf_dir):
    return anom.detect_anomalies(table(spark, sf_dir, "lineitem"))[0]


@register("anomaly_count", """
    SELECT CAST(ceil(0.1 * (count(*) - 1)) AS BIGINT) AS anomaly_count, count(*) AS rows FROM lineitem""")
def q_anomaly_count(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flagged, n = anom.detect_anomalies(li)
    return flagged.agg(F.count_if(F.col("anomaly_flag") == qual.ANOMALY).alias("anomaly_count"),
                       F.count(F.lit(1)).alias("rows"))


@register("anomaly_far_rows", """
    SELECT l_orderkey, l_linenumber, 'Anomaly' AS anomaly_flag FROM lineitem WHERE l_orderkey % 100 = 7""")
def q_anomaly_far_rows(spark, sf_dir):
    """M1-M4: line items moved far off in quantity, price, discount and tax must all be flagged."""
    far = F.col("l_orderkey") % 100 == 7
    li = table(spark, sf_dir, "lineitem").withColumns(
        {c: F.when(far, F.col(c) * 1000 + 1000).otherwise(F.col(c))
         for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")})
    return anom.detect_anomalies(li)[0].where(far).select("l_orderkey", "l_linenumber", "anomaly_flag")


@register("anomaly_repeated_rows", """
    SELECT v.size AS size, count(*) AS rows, count(*) FILTER (WHERE l_orderkey % 3 = 0) AS repeated,
           CAST(0 AS BIGINT) AS repeated_flagged, CAST(ceil(0.1 * (count(*) - 1)) AS BIGINT) AS flagged
    FROM lineitem, (VALUES (10), (25), (40)) v(size) GROUP BY 1""")
def q_anomaly_repeated_rows(spark, sf_dir):
    """M1: a third of the line items replaced by one repeated row. The sample holds it by its share,
    so it is ordinary, whichever values it has."""
    li = table(spark, sf_dir, "lineitem")
    cols, out = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], None
    same = F.col("l_orderkey") % 3 == 0
    for size in (10, 25, 40):
        typical = dict(zip(cols, (float(size), 1500.0 * size, 0.05, 0.04), strict=True))
        rows = li.select("l_orderkey", *[F.when(same, F.lit(typical[c])).otherwise(F.col(c).cast("double")).alias(c) for c in cols])
        flagged, _ = anom.detect_anomalies(rows, feature_cols=cols)
        odd = F.col("anomaly_flag") == qual.ANOMALY
        one = flagged.agg(F.lit(size).alias("size"), F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("repeated"),
                          F.count_if(same & odd).alias("repeated_flagged"), F.count_if(odd).alias("flagged"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------------------
# K8 the whole job, K7 its issue summary; S9 checksums

@register("clean_part", None)
def q_clean_part(spark, sf_dir):
    from dqspark.plans.cleaning import clean_table
    return clean_table(spark, table(spark, sf_dir, "part"), "p_name", 85).table


@register("issue_summary", None)
def q_issue_summary(spark, sf_dir):
    from dqspark.plans.cleaning import clean_table
    return clean_table(spark, table(spark, sf_dir, "part"), "p_name", 85).issues(spark)


_CLEAN_PEOPLE_SQL = CUSTOMER_WALK_SQL + f""",
    p AS ({PEOPLE_SQL.replace("FROM customer", "FROM left_over")}),
    m AS (SELECT median(balance) AS mb, median(age) AS ma FROM p)"""


@register("clean_people", _CLEAN_PEOPLE_SQL + """
    SELECT id, name,
           CASE WHEN contains(coalesce(email, 'Unknown'), '@') THEN coalesce(email, 'Unknown') END AS email,
           CAST(CASE WHEN age < 0 OR age > 120 THEN coalesce(m.ma, 30) ELSE age END AS DOUBLE) AS age,
           coalesce(balance, coalesce(m.mb, 0)) AS balance, coalesce(segment, 'Unknown') AS segment
    FROM p, m""")
def q_clean_people(spark, sf_dir):
    """K8 on the dirty customer view: near copies of names go, the rest is repaired (flags left out)."""
    from dqspark.plans.cleaning import clean_table
    return clean_table(spark, people(spark, sf_dir), "name", 85).table.drop(qual.FLAG_COLUMN)


@register("people_issues", _CLEAN_PEOPLE_SQL + """,
    c AS (SELECT count(*) AS n, (SELECT count(*) FROM customer) AS raw,
                 count(*) FILTER (WHERE age < 0 OR age > 120) + count(*) FILTER (WHERE balance IS NULL)
                 + count(*) FILTER (WHERE name IS NULL) + count(*) FILTER (WHERE email IS NULL)
                 + count(*) FILTER (WHERE NOT coalesce(contains(email, '@'), false))
                 + count(*) FILTER (WHERE segment IS NULL) AS fixed FROM p)
    SELECT 'exact_duplicates' AS issue, CAST(0 AS BIGINT) AS count FROM c
    UNION ALL SELECT 'fuzzy_duplicates', raw - n FROM c
    UNION ALL SELECT 'repairs', fixed FROM c
    UNION ALL SELECT 'raw_records', raw FROM c
    UNION ALL SELECT 'clean_records', n FROM c
    UNION ALL SELECT 'removed_records', raw - n FROM c""")
def q_people_issues(spark, sf_dir):
    """K7 on the same job (anomalies have their own queries)."""
    from dqspark.plans.cleaning import clean_table
    issues = clean_table(spark, people(spark, sf_dir), "name", 85).issues(spark)
    return issues.where(F.col("issue") != "anomalies")


@register("file_checksum", """
    SELECT parse_filename(filename) AS file, size AS length, substr(sha256(content), 1, 12) AS checksum
    FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def q_file_checksum(spark, sf_dir):
    c = sinks.checksums(spark, sf_dir, "*.parquet")
    return c.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "checksum")


# ---------------------------------------------------------------------------
# sinks, records and models written and read again

def scratch(spark, name: str) -> str:
    """A new folder under the session's checkpoint folder, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_TRICKY_SQL = """
    SELECT CAST(c_custkey AS BIGINT) AS id, '"' || c_name || '", ' || chr(10) || c_mktsegment AS note,
           CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer"""


@register("csv_round_trip", _TRICKY_SQL)
def q_csv_round_trip(spark, sf_dir):
    """S7 + S1-S4: customers with quotes, commas and line breaks in a text, written as CSV and read again."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit('"'), "c_name", F.lit('", \n'), "c_mktsegment").alias("note"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")), path)
    return csv_source.read_csv(spark, path)


@register("report_round_trip", """
    SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1""")
def q_report_round_trip(spark, sf_dir):
    """A frequency report as JSON, read again."""
    path = scratch(spark, "report")
    sinks.write_report(dedup.value_frequencies(table(spark, sf_dir, "orders"), "o_orderpriority"), path, only_if_rows=True)
    return spark.read.schema("value string, count long").json(path)


@register("input_facts", """
    SELECT 'job' AS job_id, 'orders.parquet' AS filename, count(*) AS rows, 'o_orderkey' AS first_column, 'uploaded' AS status,
           true AS has_checksum FROM orders""")
def q_input_facts(spark, sf_dir):
    """S10 + S9: the metadata row of the orders file."""
    df = table(spark, sf_dir, "orders")
    meta = sinks.input_metadata(spark, "job", "orders.parquet", df, f"{sf_dir}/orders.parquet")
    return meta.select("job_id", "filename", "rows", F.col("columns")[0].alias("first_column"), "status",
                       ((F.length("input_checksum") == 12) & (F.col("file_size_bytes") > 0)).alias("has_checksum"))


@register("run_metrics", """
    SELECT 'orders' AS run_id, 'total_records' AS key, CAST(count(*) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'orders', 'total_nulls', 0.0
    UNION ALL SELECT 'lineitem', 'total_records', CAST(count(*) AS DOUBLE) FROM lineitem
    UNION ALL SELECT 'lineitem', 'total_nulls', 0.0""")
def q_run_metrics(spark, sf_dir):
    """The profiles of two tables logged as run metrics, merged into one file, read again."""
    store = runs_mod.RunStore(spark, scratch(spark, "store"))
    for name in ("orders", "lineitem"):
        row = prof.profile_table(table(spark, sf_dir, name)).first()
        store.log_metrics(name, {"total_records": row["total_records"], "total_nulls": row["total_nulls"]})
    store.compact("metrics", before="9999-12-31")
    return store.metrics().select("run_id", "key", "value")


@register("run_history_compacted", QUERIES["run_history"][1])
def q_run_history_compacted(spark, sf_dir):
    """S11 + K10: the status rows of all jobs stored by month, half of the months merged; the same history."""
    store = runs_mod.RunStore(spark, scratch(spark, "store"), period="yyyy-MM")
    rows = run_rows(spark, sf_dir)
    absent = [f for f in runs_mod.RUN_SCHEMA.fields if f.name not in rows.columns]
    full = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
    store.append("runs", full.select(*runs_mod.RUN_SCHEMA.names), F.col("updated_at"))
    first, last = rows.agg(F.min("updated_at"), F.max("updated_at")).first()
    store.compact("runs", before=(first + (last - first) / 2).strftime("%Y-%m"))
    stored = store.runs()
    return runs_mod.run_history(runs_mod.latest_runs(stored), outputs_from_lineitem(spark, sf_dir), stored).select(
        "job_id", "status", "cqi_score", F.col("clean_records").cast("double").alias("clean_records"))


@register("stored_outputs", """
    SELECT o_orderstatus AS job_id, count(*) AS clean_records, o_orderstatus || '_clean.csv' AS file FROM orders GROUP BY 1, 3""")
def q_stored_outputs(spark, sf_dir):
    """A18 + S7: the orders of each status stored as the output of a job; rows counted over all stored outputs."""
    store = runs_mod.RunStore(spark, scratch(spark, "store"))
    orders = table(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        sinks.write_csv(orders.where(F.col("o_orderstatus") == status), store.output_path(status))
    return store.outputs().select("job_id", "clean_records", "file")


@register("anomaly_model", """
    SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS native_differing, 100 AS trees, CAST(25600 AS BIGINT) AS sampled
    FROM lineitem""")
def q_anomaly_model(spark, sf_dir):
    """A forest fitted, saved and loaded scores every line item as the fitted one does, and so
    do the scores made in the JVM."""
    li, path = table(spark, sf_dir, "lineitem"), scratch(spark, "forest")
    cols = anom.feature_columns(li)
    forest, psi = anom.forest_table(li)
    forest = staged(forest, "forest")
    anom.save_forest(forest, path, psi)
    fitted, loaded = anom.Forest(forest, psi), anom.load_forest(spark, path)
    shape = forest.agg(F.count_distinct("tree").cast("int").alias("trees"),
                       F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("sampled")).first()
    scores = anom.with_native_score(li.select(*cols, anom.score_column(fitted, cols).alias("a"),
                                              anom.score_column(loaded, cols).alias("b")), loaded, cols, "c")
    return scores.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differing"),
                      F.count_if(F.abs(F.col("a") - F.col("c")) > 1e-12).alias("native_differing"),
                      F.lit(shape["trees"]).alias("trees"), F.lit(shape["sampled"]).alias("sampled"))


@register("matches_shown", _fuzzy_sql(90, "s_name", "supplier", UNCAPPED, True) + """
    SELECT e.original, e.duplicate, e.similarity FROM matches m
    JOIN edges e ON e.rank_i = m.rank_i AND e.rank_j = m.rank_j ORDER BY m.rank_i, m.rank_j LIMIT 20""")
def q_matches_shown(spark, sf_dir):
    """T2 + T3: the first matches by rank, for display."""
    r = dedup.fuzzy_dedup(table(spark, sf_dir, "supplier"), "s_name", 90, max_values=None)
    return r.first_matches(dedup.MATCHES_SHOWN).select("original", "duplicate", "similarity")


@register("preview_rows", """
    SELECT id, name, email, age, balance, segment FROM (""" + PEOPLE_SQL + """) p ORDER BY name, id LIMIT 50""")
def q_preview_rows(spark, sf_dir):
    """The first rows in a stated order, infinities as null."""
    return cleaning.first_rows(people(spark, sf_dir), cleaning.PREVIEW_ROWS, ["name", "id"])


@register("ranks_first_seen", """
    SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS count,
           row_number() OVER (ORDER BY count(*) DESC, min(l_orderkey), CAST(l_partkey AS VARCHAR)) AS rank
    FROM lineitem GROUP BY l_partkey""")
def q_ranks_first_seen(spark, sf_dir):
    """A8 + W1: parts by frequency, equally frequent ones by the first order that has them."""
    return dedup.ranked_values(table(spark, sf_dir, "lineitem"), "l_partkey", order_col="l_orderkey")


@register("tracked_run", _CLEAN_PEOPLE_SQL + """,
    c AS (SELECT count(*) AS n, (SELECT count(*) FROM customer) AS raw,
                 count(*) FILTER (WHERE age < 0 OR age > 120) + count(*) FILTER (WHERE balance IS NULL)
                 + count(*) FILTER (WHERE name IS NULL) + count(*) FILTER (WHERE email IS NULL)
                 + count(*) FILTER (WHERE NOT coalesce(contains(email, '@'), false))
                 + count(*) FILTER (WHERE segment IS NULL) AS fixed FROM p)
    SELECT 'exact_duplicates_removed' AS key, CAST(0 AS DOUBLE) AS value FROM c
    UNION ALL SELECT 'fuzzy_duplicates_removed', CAST(raw - n AS DOUBLE) FROM c
    UNION ALL SELECT 'total_repairs', CAST(fixed AS DOUBLE) FROM c
    UNION ALL SELECT 'clean_count', CAST(n AS DOUBLE) FROM c
    UNION ALL SELECT 'records_saved', CAST(raw AS DOUBLE) FROM c
    UNION ALL SELECT 'clean rows stored', CAST(n AS DOUBLE) FROM c""")
def q_tracked_run(spark, sf_dir):
    """K9: the tracked job on the dirty customer view; its stored metrics and the rows of its stored table."""
    out = scratch(spark, "tracked")
    store = runs_mod.RunStore(spark, f"{out}/runs")
    cleaning.run_tracked(spark, people(spark, sf_dir), out, "run", "name", 85, store)
    stored = csv_source.read_csv(spark, f"{out}/clean.csv").agg(
        F.lit("clean rows stored").alias("key"), F.count(F.lit(1)).cast("double").alias("value"))
    keys = ["exact_duplicates_removed", "fuzzy_duplicates_removed", "total_repairs", "clean_count", "records_saved"]
    return store.metrics().where(F.col("key").isin(keys)).select("key", "value").unionByName(stored)


@register("landing_ingest", """
    SELECT 'complete' AS status, count(*) AS rows, count(*) AS clean_records FROM customer GROUP BY c_acctbal < 0
    UNION ALL SELECT 'error', 0, 0""")
def q_landing_ingest(spark, sf_dir):
    """S14 + S1, S5: customers in debt and the others land as one CSV file each, beside a file with an overlong
    row. The stream runs each file's job once; the bad file has an error row (no counts: 0)."""
    from dqspark.streaming.ingest import ingest_landing
    base = scratch(spark, "ingest")
    customers = table(spark, sf_dir, "customer")
    for part in (F.col("c_acctbal") < 0, ~(F.col("c_acctbal") < 0)):
        (customers.where(part).select("c_custkey", "c_name", "c_mktsegment").coalesce(1)
         .write.mode("append").option("header", True).csv(f"{base}/landing"))
    # lines as they are: the separator does not occur in them
    spark.createDataFrame([("name,n",), ("x,1",), ("y,,3",)], "value string").coalesce(1) \
        .write.mode("append").option("sep", "\u0001").csv(f"{base}/landing")
    ingest_landing(spark, f"{base}/landing", f"{base}/store", f"{base}/progress", match_col="c_mktsegment",
                   files_per_batch=8).awaitTermination()
    return runs_mod.RunStore(spark, f"{base}/store").latest().select(
        "status", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows", "clean_records")])

"""Queries of tabular analysis over the star schema and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import analytics as A
from tesserae.sources.tables import table

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _one(name, spec):
    def query(spark, sf_dir):
        return A.run_spec({name: table(spark, sf_dir, name)}, {"from": name, **spec})

    return query


def _rounded(query, *columns):
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.round(F.col(c), 2) for c in columns})

    return run


def df_join_equi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    tables = {"orders": o, "customer": table(spark, sf_dir, "customer")}
    spec = {"from": "orders", "join": [{"table": "customer", "on": ["c_custkey"]}], "groupby": ["c_mktsegment"], "rollup": {"n_orders": ["count", "*"], "n_customers": ["distinct", "c_custkey"]}}
    return A.run_spec(tables, spec)


def df_objects(spark, sf_dir):
    """Result rows as JSON text, the form handed to a prompt."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row_json"))


def agg_table_counts(spark, sf_dir):
    return A.table_counts({n: table(spark, sf_dir, n) for n in TPCH})


def agg_time_bucket_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("DAY", "ts").cast("date").alias("day")).agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def agg_date_diff_avg(spark, sf_dir):
    o, l = (table(spark, sf_dir, n) for n in ("orders", "lineitem"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    joined = l.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.round(F.avg(days), 6).alias("avg_days"), F.count(F.lit(1)).alias("n"))


ASKED = ("Average order price by status", "How many customers per nation and segment?", "part type and size", "sum of orders", "zzz")


def _questions(spark):
    return spark.createDataFrame([(q,) for q in ASKED], "question string")


def relevant_datasets(spark, sf_dir):
    return A.relevant_datasets(A.catalog_of(spark, {n: table(spark, sf_dir, n) for n in TPCH}), _questions(spark))


def suggest_queries(spark, sf_dir):
    cases = {"orders": ["orders", "customer"], "part": ["part"], "region": ["region"], "labels": ["labels"]}
    out = None
    for first, names in cases.items():
        part = A.suggest_queries(A.catalog_of(spark, {n: table(spark, sf_dir, n) for n in names})).withColumn("dataset", F.lit(first))
        out = part if out is None else out.unionByName(part)
    return out


def suggest_doc_queries(spark, sf_dir):
    files = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("seq")).select("seq", F.concat("source", F.lit(".txt")).alias("file_name"))
    return A.suggest_document_queries(files)


def chart_detect(spark, sf_dir):
    rows = []
    for n in TPCH:
        df = table(spark, sf_dir, n)
        c = A.chart_spec(df)
        rows.append((n, A.result_shape(df), c["type"], c["x_key"], c["y_keys"]))
    return spark.createDataFrame(rows, "dataset string, shape string, type string, x_key string, y_keys array<string>").withColumn("y_keys", F.array_join("y_keys", ","))


def result_shape(spark, sf_dir):
    values = [("rows", [{"a": "x", "b": 1}]), ("text_rows", [{"a": "x"}]), ("totals", {"a": 1, "b": 2.5}), ("one_number", {"a": 1}), ("lists", {"a": [1, 2], "b": "x"}), ("mixed", {"a": "x", "b": 1}), ("number", 7), ("text", "x"), ("none", [])]
    return spark.createDataFrame([(n, A.result_shape(v)) for n, v in values], "name string, shape string")


def chart_topn(spark, sf_dir):
    return A.chart_rows(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"])


QUERIES = {
    "df_filter": _one("orders", {"filter": [["o_orderstatus", "==", "F"], ["o_totalprice", ">", 200000]], "select": ["o_orderkey", "o_totalprice"]}),
    "df_filter_count": _one("orders", {"filter": [["o_orderpriority", "==", "1-URGENT"]], "rollup": {"n": ["count", "*"]}}),
    "df_scan_head": _one("customer", {"select": ["c_custkey", "c_name", "c_mktsegment"], "orderby": [["c_custkey", "asc"]], "limit": 10}),
    "df_objects": df_objects,
    "df_join_equi": df_join_equi,
    "df_sort_desc_limit": _one("orders", {"select": ["o_orderkey", "o_totalprice"], "orderby": [["o_totalprice", "desc"], ["o_orderkey", "asc"]], "limit": 5}),
    "agg_group_count": _one("orders", {"groupby": ["o_orderstatus"], "rollup": {"n": ["count", "*"]}}),
    "agg_sum": _rounded(_one("lineitem", {"rollup": {"total": ["sum", "l_quantity"]}}), "total"),
    "agg_group_sum": _rounded(_one("lineitem", {"groupby": ["l_returnflag", "l_linestatus"], "rollup": {"total": ["sum", "l_quantity"], "price": ["sum", "l_extendedprice"]}}), "total", "price"),
    "agg_avg": _rounded(_one("customer", {"rollup": {"mean_balance": ["mean", "c_acctbal"]}}), "mean_balance"),
    "agg_group_avg": _rounded(_one("part", {"groupby": ["p_brand"], "rollup": {"mean_price": ["mean", "p_retailprice"], "largest": ["max", "p_size"]}}), "mean_price"),
    "agg_distribution": _one("events", {"groupby": ["event_type"], "rollup": {"n": ["count", "*"], "users": ["distinct", "user_id"]}}),
    "agg_table_counts": agg_table_counts,
    "agg_time_bucket_sum": agg_time_bucket_sum,
    "agg_date_diff_avg": agg_date_diff_avg,
    "relevant_datasets": relevant_datasets,
    "suggest_queries": suggest_queries,
    "suggest_doc_queries": suggest_doc_queries,
    "chart_detect": chart_detect,
    "chart_topn": chart_topn,
    "result_shape": result_shape,
}

_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS row_count FROM {n}" for n in TPCH)
_ASKED = "[" + ", ".join(f"'{q}'" for q in ASKED) + "]"

ORACLES = {
    "relevant_datasets": f"""
        WITH q AS (SELECT question, list_distinct(list_filter(string_split_regex(regexp_replace(lower(question), '[^a-z0-9_ ]', ' ', 'g'), ' +'), lambda w: length(w) >= 3)) AS asked FROM (SELECT unnest({_ASKED}) AS question)),
        n AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(TPCH))}) t(seq, name)),
        t AS (SELECT seq, name, unnest(string_split(name, '_')) AS tok, 4 AS points FROM n
              UNION ALL SELECT seq, name, unnest(string_split(lower(column_name), '_')), 2 FROM n JOIN duckdb_columns() ON table_name = name),
        s AS (SELECT question, name, seq, sum(points) AS score FROM t, q WHERE length(tok) >= 3 AND list_contains(asked, tok) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, seq) AS rank FROM s)
        SELECT question, name, score, rank FROM r WHERE rank <= 4""",
    "chart_detect": """
        WITH c AS (SELECT table_name AS dataset, column_index AS i, column_name AS c, data_type IN ('INTEGER', 'BIGINT', 'DOUBLE') AS num, data_type = 'VARCHAR' AS str
                   FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')),
        y AS (SELECT dataset, string_agg(c, ',' ORDER BY i) AS y_keys FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY i) AS k FROM c WHERE num) WHERE k <= 2 GROUP BY 1)
        SELECT dataset, 'chart' AS shape, 'bar' AS type, arg_min(c, i) FILTER (str) AS x_key, any_value(y_keys) AS y_keys FROM c JOIN y USING (dataset) GROUP BY 1""",
    "df_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
    "df_filter_count": "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'",
    "df_scan_head": "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10",
    "df_objects": """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS row_json FROM nation""",
    "df_join_equi": "SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "df_sort_desc_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "agg_group_count": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "agg_sum": "SELECT round(sum(l_quantity), 2) AS total FROM lineitem",
    "agg_group_sum": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2",
    "agg_avg": "SELECT round(avg(c_acctbal), 2) AS mean_balance FROM customer",
    "agg_group_avg": "SELECT p_brand, round(avg(p_retailprice), 2) AS mean_price, max(p_size) AS largest FROM part GROUP BY 1",
    "agg_distribution": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "agg_table_counts": _COUNTS,
    "agg_time_bucket_sum": "SELECT ts::DATE AS day, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1",
    "agg_date_diff_avg": "SELECT o_orderpriority, round(avg(datediff('day', o_orderdate::DATE, l_shipdate::DATE)), 6) AS avg_days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "suggest_queries": """
        SELECT * FROM (VALUES
            ('orders', 0, 'Average o_totalprice by o_orderstatus'), ('orders', 1, 'Total o_totalprice'), ('orders', 2, 'Join these datasets'),
            ('part', 0, 'Average p_retailprice by p_type'), ('part', 1, 'Total p_retailprice'),
            ('region', 0, 'Count by r_regionkey'),
            ('labels', 0, 'Summarize labels'), ('labels', 1, 'Show the first rows of labels')) t(dataset, seq, query)""",
    "suggest_doc_queries": """
        WITH f AS (SELECT source || '.txt' AS name, row_number() OVER (ORDER BY min(doc_id), source) AS i FROM documents GROUP BY source)
        SELECT 0 AS seq, 'Summarize ' || count(*) || ' uploaded documents' AS query FROM f
        UNION ALL SELECT 1, 'Find action items across ' || string_agg(name, ', ' ORDER BY i) FROM f WHERE i <= 3
        UNION ALL SELECT 2, 'Key themes in the uploaded files'""",
    "chart_topn": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 12",
    "result_shape": """
        SELECT * FROM (VALUES ('rows', 'chart'), ('text_rows', 'table'), ('totals', 'chart'), ('one_number', 'chart'), ('lists', 'table'),
            ('mixed', 'scalar'), ('number', 'scalar'), ('text', 'scalar'), ('none', 'table')) t(name, shape)""",
}

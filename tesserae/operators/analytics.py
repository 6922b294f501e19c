"""Tabular analysis: the declarative query spec and what chooses tables, shapes results and suggests questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_COMPARE = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "like": lambda c, v: c.like(v),
}
_AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "distinct": F.count_distinct}


def run_spec(tables: dict[str, DataFrame], spec: dict) -> DataFrame:
    """Compiles a query spec to DataFrame operations; no generated code is ever executed.

    Keys, all but `from` optional and applied in this order: join ([{table, on, how}]), filter
    ([[column, operator, value]]), groupby ([columns]), rollup ({name: [function, column]}), select
    ([columns]), orderby ([[column, asc|desc]]), limit. Unknown tables, operators and functions raise.
    """
    df = tables[spec["from"]]
    for j in spec.get("join", []):
        df = df.join(tables[j["table"]], j["on"], j.get("how", "inner"))
    for column, operator, value in spec.get("filter", []):
        df = df.filter(_COMPARE[operator](F.col(column), value))
    if "rollup" in spec or "groupby" in spec:
        aggs = [_AGGREGATES[fn](F.lit(1) if fn == "count" and c in (None, "*") else F.col(c)).alias(name) for name, (fn, c) in spec.get("rollup", {"count": ["count", "*"]}).items()]
        df = df.groupBy(*spec.get("groupby", [])).agg(*aggs)
    if "select" in spec:
        df = df.select(*spec["select"])
    if "orderby" in spec:
        df = df.orderBy(*[F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in spec["orderby"]])
    return df.limit(spec["limit"]) if "limit" in spec else df


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, row_count) of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The dataset catalog: position, name, columns."""
    rows = [(i, name, df.columns) for i, (name, df) in enumerate(tables.items())]
    return spark.createDataFrame(rows, "seq int, name string, columns array<string>")


def question_tokens(q: Column) -> Column:
    """Distinct lower-case tokens of three characters or more."""
    words = F.split(F.regexp_replace(F.lower(q), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def identifier_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[_\s]+"), lambda w: F.length(w) >= 3)


def relevant_datasets(catalog: DataFrame, questions: DataFrame, limit: int = 4) -> DataFrame:
    """(question, name, score, rank): 4 points for a token of the name, 2 for each token of a column; scores above 0, the best `limit`.

    Datasets and different questions meet by the tokens that both have.
    """
    worth = lambda words, points: F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(points).alias("points")))
    columns = F.flatten(F.transform("columns", identifier_tokens))
    words = catalog.select("seq", "name", F.inline(F.concat(worth(identifier_tokens(F.col("name")), 4), worth(columns, 2))))
    asked = questions.select("question").distinct().select("question", F.explode(question_tokens(F.col("question"))).alias("token"))
    scored = words.join(asked, "token").groupBy("question", "seq", "name").agg(F.sum("points").cast("int").alias("score"))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("question", "name", "score", "rank")


# Column-name patterns by which questions are suggested.
NUMERIC_NAME = "price|amount|revenue|salary|count|total|budget|qty|quantity|score|rating|units|sales|spent|cost|fees"
CATEGORY_NAME = "category|type|status|department|region|product|country|state|group|owner|priority|severity"


def suggest_queries(catalog: DataFrame) -> DataFrame:
    """(seq, query): up to three questions about the first dataset of the catalog."""
    first = catalog.agg(F.min_by(F.struct("name", "columns"), "seq").alias("d"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    pick = lambda pattern: F.try_element_at(F.filter("d.columns", lambda c: F.lower(c).rlike(pattern)), F.lit(1))
    named = first.select("n", F.col("d.name").alias("name"), pick(NUMERIC_NAME).alias("num"), pick(CATEGORY_NAME).alias("cat"))
    lead = F.when(F.col("num").isNotNull() & F.col("cat").isNotNull(), F.concat(F.lit("Average "), "num", F.lit(" by "), "cat"))
    lead = lead.when(F.col("cat").isNotNull(), F.concat(F.lit("Count by "), "cat"))
    total = F.when(F.col("num").isNotNull(), F.concat(F.lit("Total "), "num"))
    join = F.when(F.col("n") > 1, F.lit("Join these datasets"))
    some = F.array_compact(F.array(lead, total, join))
    fallback = F.array(F.concat(F.lit("Summarize "), "name"), F.concat(F.lit("Show the first rows of "), "name"))
    chosen = named.select(F.slice(F.when(F.size(some) > 0, some).otherwise(fallback), 1, 3).alias("q"))
    return chosen.select(F.posexplode("q").alias("seq", "query"))


def suggest_document_queries(files: DataFrame) -> DataFrame:
    """(seq, query): three questions about the uploaded files (seq, file_name); none without files."""
    names = files.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "file_name"))), lambda s: s["file_name"]).alias("names")).filter("size(names) > 0")
    one, n = F.size("names") == 1, F.size("names").cast("string")
    first = F.element_at("names", 1)
    summary = F.concat(F.lit("Summarize "), F.when(one, first).otherwise(F.concat(n, F.lit(" uploaded documents"))))
    actions = F.concat(F.lit("Find action items"), F.when(one, "").otherwise(F.concat(F.lit(" across "), F.array_join(F.slice("names", 1, 3), ", "))))
    themes = F.concat(F.lit("Key themes in "), F.when(one, first).otherwise(F.lit("the uploaded files")))
    return names.select(F.posexplode(F.array(summary, actions, themes)).alias("seq", "query"))


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, _NUMERIC)


def chart_spec(df: DataFrame, title: str = "") -> dict:
    """A bar chart's keys: the first string column (else the first) and the first two numeric ones."""
    numeric = [f.name for f in df.schema if is_numeric(f)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return {"type": "bar", "title": title, "x_key": (text or df.columns or [None])[0], "y_keys": numeric[:2]}


def result_shape(value) -> str:
    """table, chart or scalar for a result: a DataFrame, a list of rows, a mapping or a single value."""
    if isinstance(value, DataFrame):
        return "chart" if any(is_numeric(f) for f in value.schema) else "table"
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(value, (list, tuple)):
        return "chart" if value and isinstance(value[0], dict) and any(map(number, value[0].values())) else "table"
    if isinstance(value, dict) and value:
        if all(map(number, value.values())):
            return "chart"
        if isinstance(next(iter(value.values())), (list, tuple)):
            return "table"
    return "scalar"


def chart_rows(df: DataFrame, order: list, limit: int = 12) -> DataFrame:
    """The first rows that a chart shows, in a stated order."""
    return df.orderBy(*order).limit(limit)

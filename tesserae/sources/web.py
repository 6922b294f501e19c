"""Web-search responses and model catalogs as rows; the transport is a callable that the caller injects."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as X

# What a result block looks like, and the row that stands for no results.
RESULT = r'<a[^>]*class="result__a"[^>]*href="([^"]*)"[^>]*>([^<]*)</a>[\s\S]*?<a[^>]*class="result__snippet"[^>]*>([\s\S]*?)</a>'
NO_TITLE, NO_URL = "No web search results found", "https://serper.dev"
NO_CONTENT = "Configure a Serper API key in Settings for live Google results, or try a different query with DuckDuckGo."


def parse_json_results(responses: DataFrame, k: int, json_col: str = "body") -> DataFrame:
    """The first k organic results; a missing title is Untitled, a missing snippet empty."""
    organic = F.from_json(F.get_json_object(json_col, "$.organic"), "array<struct<title:string,snippet:string,link:string>>")
    rest = [c for c in responses.columns if c != json_col]
    rows = responses.select(*rest, F.posexplode(F.slice(organic, 1, k)).alias("rank", "r"))
    return rows.select(*rest, "rank", F.coalesce(F.nullif("r.title", F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce("r.snippet", F.lit("")).alias("content"), F.col("r.link").alias("url"))


def parse_html_results(responses: DataFrame, k: int, html_col: str = "html", intended_entities: bool = True) -> DataFrame:
    """The first k results of a result page, tags stripped and redirects unwrapped; one stub row where there are none."""
    part = lambda n: F.regexp_extract_all(html_col, F.lit(RESULT), F.lit(n))
    rest = [c for c in responses.columns if c != html_col]
    hits = F.slice(F.arrays_zip(part(1).alias("url"), part(2).alias("title"), part(3).alias("content")), 1, k)
    stub = F.array(F.struct(F.lit(NO_URL).alias("url"), F.lit(NO_TITLE).alias("title"), F.lit(NO_CONTENT).alias("content")))
    rows = responses.select(*rest, F.posexplode(F.when(F.size(hits) > 0, hits).otherwise(stub)).alias("rank", "r"))
    clean = lambda c: X.decode_entities(F.trim(X.strip_tags(F.col(c))), intended_entities)
    return rows.select(*rest, "rank", clean("r.title").alias("title"), clean("r.content").alias("content"), X.unwrap_url(F.col("r.url")).alias("url"))


def search(query: str, provider: str, serper: Callable[[str], list], ddg: Callable[[str], list], retryable: Callable[[Exception], bool]) -> list:
    """The provider chain: none gives nothing, a final error of the first provider falls back to the second."""
    if provider == "none":
        return []
    if provider == "serper":
        try:
            return serper(query)
        except Exception as e:  # noqa: BLE001  the caller's transport names its errors
            if retryable(e):
                raise
    return ddg(query)


def parse_model_catalog(responses: DataFrame, json_col: str = "body") -> DataFrame:
    """Rows (seq, id, owned_by, created) of a model list; missing values become '' and 0."""
    rows = responses.select(F.posexplode(F.from_json(F.get_json_object(json_col, "$.data"), "array<struct<id:string,owned_by:string,created:long>>")).alias("seq", "m"))
    return rows.select("seq", F.coalesce("m.id", F.lit("")).alias("id"), F.coalesce("m.owned_by", F.lit("")).alias("owned_by"), F.coalesce("m.created", F.lit(0)).cast("long").alias("created"))


def concat_stream(lines: DataFrame, by: str, seq: str, line: str) -> DataFrame:
    """Deltas of a server-sent stream of chat chunks put together in order; [DONE] and foreign lines are skipped."""
    data = F.when(F.col(line).startswith("data: "), F.substring(F.col(line), 7, 1 << 30))
    rows = lines.withColumn("_d", data).filter("_d IS NOT NULL AND trim(_d) <> '[DONE]'")
    delta = F.coalesce(F.get_json_object("_d", "$.choices[0].delta.content"), F.lit(""))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), delta.alias("t")))).alias("l"))
    return lists.select(by, F.array_join(F.transform("l", lambda x: x["t"]), "").alias("text"))


def reassemble_lines(reads: DataFrame, by: str, seq: str, data: str) -> DataFrame:
    """(by, line_no, line): the lines of byte streams that come in reads cut anywhere, inside lines and characters too.

    A read's pieces between line feeds are numbered by the line feeds before them, so a line's pieces meet by
    number wherever they were cut, and a stream's lines are spread over all tasks; only the counts of line
    feeds pass a window in order. Bytes are handled as Latin-1 characters until a line is whole. The last line
    of a stream counts if it is not empty; carriage returns at ends of lines go; null reads hold nothing; bytes that are
    no UTF-8 become replacement characters.
    """
    rows = reads.select(F.col(by).alias("_by"), F.col(seq).alias("_seq"), F.decode(F.coalesce(F.col(data), F.lit(b"")), "ISO-8859-1").alias("_t"))
    split = rows.select("_by", "_seq", F.split("_t", "\n", -1).alias("_p"))
    order = Window.partitionBy("_by").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = split.select("_by", "_seq", (F.size("_p") - 1).cast("long").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    before = before.select(F.col("_by").alias("_of"), F.col("_seq").alias("_at"), "_before")
    pieces = split.join(before, F.expr("_by <=> _of AND _seq = _at")).select("_by", "_seq", "_before", F.posexplode("_p").alias("_k", "_piece"))
    whole = pieces.groupBy("_by", (F.col("_before") + F.col("_k")).alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("_seq", "_piece"))).alias("_l"))
    line = F.make_valid_utf8(F.encode(F.array_join(F.transform("_l", lambda x: x["_piece"]), ""), "ISO-8859-1").cast("string"))
    out = whole.select(F.col("_by").alias(by), "line_no", F.regexp_replace(line, "\r$", "").alias("line"), F.max("line_no").over(Window.partitionBy("_by")).alias("_last"))
    return out.filter("line_no < _last OR line <> ''").drop("_last")


def sample_response(rows: list[dict]) -> str:
    return json.dumps({"organic": rows})

"""Layout of positioned PDF items: modal height, heading marks, lines, pages. All relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Heights, as multiples of the page's modal height, from which an item is a heading.
SECOND_LEVEL, FIRST_LEVEL = 1.5, 3.0
ITEMS = "page int, seq int, str string, x double, y double, height double"


def modal_height(items: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent height of each page; of equals, the one that reached the count first."""
    counts = items.groupBy(*by, "height").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("reached"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "reached", "height")
    return counts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(*by, F.col("height").alias("modal"))


def heading_mark(text: Column, height: Column, modal: Column) -> Column:
    plain = (modal <= 0) | (height < modal * SECOND_LEVEL)
    return F.when(plain, text).when(height >= modal * FIRST_LEVEL, F.concat(F.lit("# "), text)).otherwise(F.concat(F.lit("## "), text))


def assemble_pages(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, text, heading): items by line from the top, within a line from the left; blank pages drop out."""
    by = by or ["page"]
    marked = items.join(modal_height(items, by), by).withColumn("m", heading_mark(F.col("str"), F.col("height"), F.col("modal")))
    row = F.struct("x", "seq", "m", (F.col("m") != F.col("str")).alias("is_heading"))
    lines = marked.groupBy(*by, F.floor(F.col("y") + 0.5).alias("line")).agg(F.array_sort(F.collect_list(row)).alias("items"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("items", lambda i: i["m"]), " "), r"\s+", " "))
    first = F.try_element_at(F.filter("items", lambda i: i["is_heading"]), F.lit(1))["m"]
    line = F.struct(F.negative("line").alias("o"), text.alias("t"), F.regexp_replace(first, r"^#{1,2}\s+", "").alias("h"))
    pages = lines.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["t"] != ""), lambda x: x["t"]), "\n")
    heading = F.try_element_at(F.filter(F.transform("lines", lambda x: x["h"]), lambda h: h.isNotNull()), F.lit(1))
    return pages.select(*by, body.alias("text"), heading.alias("heading")).filter("text <> ''")


def read_items(files: DataFrame, parse: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Items of binary files by an injected parser, which gives (page, seq, str, x, y, height) of one file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for path, content in zip(df["path"], df["content"]):
                got = pd.DataFrame(parse(bytes(content)), columns=["page", "seq", "str", "x", "y", "height"])
                got.insert(0, "path", path)
                yield got

    return files.select("path", "content").mapInPandas(run, f"path string, {ITEMS}")

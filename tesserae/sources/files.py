"""File kinds, names, sizes, CSV and text scans, and cell normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by kind and the largest file taken.
DATASET_EXTENSIONS = (".csv",)
DOCUMENT_EXTENSIONS = (".pdf", ".md", ".markdown", ".txt", ".text", ".json")
MAX_FILE_BYTES = 25 * 1024 * 1024

# Forms of cells, first match wins.
PLAIN_NUMBER, MONEY, PERCENT = r"^-?\d+(\.\d+)?$", r"^\$?-?[\d,]+\.?\d*$", r"^-?\d+(\.\d+)?%$"


def _ends(name: Column, extensions) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | name.endswith(e)
    return out


def detect_kind(name: Column, mime: Column) -> Column:
    """csv, pdf, text or unsupported, by extension or media type in this order."""
    n, m = F.lower(name), F.coalesce(mime, F.lit(""))
    kind = F.when(_ends(n, DATASET_EXTENSIONS) | (m == "text/csv"), "csv")
    kind = kind.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf")
    return kind.when(_ends(n, DOCUMENT_EXTENSIONS) | m.startswith("text/"), "text").otherwise("unsupported")


def derive_name(name: Column) -> Column:
    """File stem as an identifier; `dataset` if nothing is left."""
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("dataset"))


def size_gate(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.col("length") <= limit)


def cell_number(c: Column) -> Column:
    """The number that a cell holds: plain, money or percent; null if it holds none."""
    t = F.trim(c)
    plain = F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))
    money = plain.when(t.rlike(MONEY), F.regexp_replace(t, "[$,]", "").try_cast("double"))
    return money.when(t.rlike(PERCENT), F.replace(t, F.lit("%"), F.lit("")).try_cast("double") / 100)


def normalize_cells(df: DataFrame) -> DataFrame:
    """All-text columns to numbers where every non-empty cell is one; empty cells become null, other text stays as it is."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not text:
        return df
    blank = lambda c: F.nullif(F.col(f"`{c}`"), F.lit(""))
    bad = df.agg(*[F.count_if(blank(c).isNotNull() & cell_number(blank(c)).isNull()).alias(c) for c in text], *[F.count(blank(c)).alias(f"{c}\0n") for c in text]).first()
    return df.withColumns({c: cell_number(blank(c)) if bad[c] == 0 and bad[f"{c}\0n"] else blank(c) for c in text})


def read_csv(spark: SparkSession, paths) -> DataFrame:
    """CSV with a header; every column text. A record with more fields than the header keeps the first ones."""
    return spark.read.csv(paths, header=True, mode="PERMISSIVE", multiLine=True, escape='"')


def read_user_csv(spark: SparkSession, paths) -> DataFrame:
    """CSV with its cells normalised field by field, so a thousands separator never eats a delimiter."""
    return normalize_cells(read_csv(spark, paths))


def read_sample_index(spark: SparkSession, manifest: str, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by name, outcome of each file) of a JSON manifest (name, file); raises with both lists if a file fails."""
    tables, outcome = {}, []
    for r in spark.read.json(manifest, multiLine=True).select("name", "file").collect():
        try:
            tables[r["name"]] = read_user_csv(spark, f"{folder}/{r['file']}")
            outcome.append((r["name"], True, None))
        except Exception as e:  # noqa: BLE001  reported below with all others
            outcome.append((r["name"], False, str(e).split("\n")[0][:200]))
    failed = [name for name, ok, _ in outcome if not ok]
    if failed:
        raise ValueError(f"failed: {', '.join(failed)}; loaded: {', '.join(tables) or 'none'}")
    return tables, spark.createDataFrame(outcome, "name string, loaded boolean, reason string")


def read_texts(spark: SparkSession, paths) -> DataFrame:
    """(source, text) of text, markdown and JSON files, JSON as it stands."""
    return spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, paths) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)

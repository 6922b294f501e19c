"""Queries of sources: files, CSV cells, PDF layout, web results, catalogs, embeddings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tesserae.functions.embed import embed, hashed_vectors
from tesserae.functions.text import estimated_tokens
from tesserae.operators import state as S
from tesserae.operators import workflow as W
from tesserae.operators.vector_cache import VectorCache
from tesserae.sources import files, pdf, web
from tesserae.sources.tables import scratch, table
from tesserae.streaming import index

_EXTENSIONS = ("csv", "PDF", "md", "txt", "json", "png", "markdown", "text")
_MIMES = (None, "text/csv", "application/pdf", "text/html", "image/png")


def _named(spark, sf_dir):
    """Documents under file names of many kinds."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))
    name = F.concat(F.lit("My "), "source", F.lit(" Report ("), F.col("doc_id").cast("string"), F.lit(")."), pick(_EXTENSIONS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("file_name"), pick(_MIMES, F.floor(F.col("doc_id") / 8)).alias("mime"))


def src_detect_kind(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", files.detect_kind(F.col("file_name"), F.col("mime")).alias("kind"))


def src_derive_name(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", files.derive_name(F.col("file_name")).alias("dataset"))


def _priced(spark, sf_dir):
    """Customers as cells of a spreadsheet: plain numbers, money, percents, text and blanks."""
    c = table(spark, sf_dir, "customer")
    cents = F.format_string("%.2f", F.abs("c_acctbal"))
    money = F.concat(F.lit("$"), F.regexp_replace(cents, r"(\d)(\d{3}\.)", "$1,$2"))
    blank = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), money.alias("balance"), F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%")).alias("rate"), blank.alias("points"), F.concat("c_name", F.lit(", "), "c_mktsegment").alias("label"))


def _csv(spark, sf_dir):
    path = scratch(spark, "csv")
    _priced(spark, sf_dir).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def src_csv(spark, sf_dir):
    return files.read_csv(spark, _csv(spark, sf_dir))


def src_user_csv(spark, sf_dir):
    df = files.read_user_csv(spark, _csv(spark, sf_dir))
    return df.select(F.col("id").cast("long").alias("id"), "balance", F.round("rate", 4).alias("rate"), "points", "label")


def cell_normalize(spark, sf_dir):
    cells = _priced(spark, sf_dir)
    return cells.select("id", *[F.round(files.cell_number(F.col(c)), 4).alias(c) for c in ("balance", "rate", "points", "label")])


def src_sample_index(spark, sf_dir):
    path = scratch(spark, "samples")
    manifest = [{"name": n, "file": f"{n}.csv"} for n in ("region", "nation")]
    for n in ("region", "nation"):
        table(spark, sf_dir, n).write.option("header", True).csv(f"{path}/{n}.csv")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/index")
    tables, outcome = files.read_sample_index(spark, f"{path}/index", path)
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1]).join(outcome, "name").select("name", "rows", "loaded")


def src_text(spark, sf_dir):
    path = scratch(spark, "texts")
    table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return files.read_texts(spark, path).select(F.trim(F.regexp_replace("text", "\n", " ")).alias("text"))


def src_size_gate(spark, sf_dir):
    found = files.read_binaries(spark, f"{sf_dir}/nation.parquet").select("path", "length")
    return files.size_gate(found).agg(F.count(F.lit(1)).alias("accepted"))


def _items(spark, sf_dir):
    """Line items as positioned text: an order is a page."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").cast("int").alias("page"), F.col("l_linenumber").alias("seq"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("str"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") % 3 * 10.5).alias("y"), F.pow(F.lit(2.0), F.col("l_suppkey") % 3).alias("height"))


def pdf_mode_height(spark, sf_dir):
    return pdf.modal_height(_items(spark, sf_dir), ["page"])


def pdf_heading_mark(spark, sf_dir):
    i = _items(spark, sf_dir)
    return i.select("page", "seq", pdf.heading_mark(F.col("str"), F.col("height"), F.lit(1.0)).alias("marked"))


def pdf_line_assemble(spark, sf_dir):
    return pdf.assemble_pages(_items(spark, sf_dir))


def src_pdf(spark, sf_dir):
    """Files through an injected parser: here every line of a file is an item, 20 lines to a page."""
    path = scratch(spark, "pdf")
    table(spark, sf_dir, "nation").repartition(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)

    def parse(content):
        return [(i // 20 + 1, i, line, 10.0, 700.0 - i, 24.0 if i % 20 == 0 else 10.0) for i, line in enumerate(content.decode().splitlines())]

    items = pdf.read_items(files.read_binaries(spark, f"{path}/part-*"), parse)
    return pdf.assemble_pages(items, ["path", "page"]).select("page", F.regexp_replace("text", "\n", "|").alias("text"), "heading")


def _response():
    """The query whose response holds a page: 20 pages with numbers in a row each, so a response has 20 hits at most."""
    return F.floor(F.col("page_id") / 20).alias("query_id")


def src_web_serper(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hit = F.struct(F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("T"), F.col("page_id").cast("string"))).alias("title"), F.when(F.col("page_id") % 2 == 0, F.lit("snip")).alias("snippet"), F.col("url").alias("link"))
    groups = p.groupBy(_response()).agg(F.array_sort(F.collect_list(F.struct("page_id", hit.alias("h")))).alias("l"))
    bodies = groups.select("query_id", F.to_json(F.struct(F.transform("l", lambda x: x["h"]).alias("organic"))).alias("body"))
    return web.parse_json_results(bodies, 5)


def src_web_ddg_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    block = F.concat(F.lit('<div><a rel="x" class="result__a" href="https://d.example/l/?uddg='), F.url_encode("url"), F.lit('"> T'), F.col("page_id").cast("string"), F.lit(' </a><p><a class="result__snippet" href="y"> a <b>bold</b> &amp; word </a></div>'))
    groups = p.groupBy(_response()).agg(F.array_sort(F.collect_list(F.struct("page_id", block.alias("h")))).alias("l"))
    bodies = groups.select("query_id", F.when(F.col("query_id") % 20 == 7, "<html></html>").otherwise(F.array_join(F.transform("l", lambda x: x["h"]), "\n")).alias("html"))
    return web.parse_html_results(bodies, 3)


def web_fallback(spark, sf_dir):
    class Final(Exception):
        pass

    def down(query):
        raise Final("HTTP 500")

    outcome = []
    for provider in ("none", "serper", "ddg"):
        outcome.append((provider, len(web.search("q", provider, down, lambda q: [q, q], lambda e: not isinstance(e, Final)))))
    return spark.createDataFrame(outcome, "provider string, n int")


def src_model_catalog(spark, sf_dir):
    body = json.dumps({"data": [{"id": "a/b-8b", "owned_by": "x", "created": 5}, {"id": "c", "owned_by": None}, {"owned_by": "z", "created": None}]})
    return web.parse_model_catalog(spark.createDataFrame([(body,)], "body string"))


def snk_legacy_migrate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    listed = F.concat(F.lit("["), F.array_join(vec.cast("array<string>"), ","), F.lit("]"))
    keyed = F.concat(F.lit("{"), F.array_join(F.transform(vec, lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('":'), x.cast("string"))), ","), F.lit("}"))
    n = F.col("vec_id").cast("string")
    one = F.when(F.col("vec_id") % 5 == 4, F.lit('{"id":null,"text":"t","embedding":[1]}')).otherwise(F.concat(F.lit('{"id":"'), n, F.lit('","text":"t'), n, F.lit('","embedding":'), F.when(F.col("vec_id") % 2 == 0, listed).otherwise(keyed), F.lit("}")))
    raw = e.groupBy(F.floor(F.col("vec_id") / 100)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("json"))
    return S.migrate_legacy(raw, "m1").select(F.col("id").cast("long").alias("vec_id"), "text", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 64), 4).alias("last"))


def sse_concat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    done = c.select("conv_id").distinct().select("conv_id", F.lit(1 << 40).alias("turn"), F.lit("data: [DONE]").alias("line"))
    noise = c.select("conv_id", "turn", F.lit(": keep-alive").alias("line"))
    rows = c.select("conv_id", "turn", line.alias("line")).unionByName(done).unionByName(noise)
    return web.concat_stream(rows, "conv_id", "turn", "line").select("conv_id", F.md5("text").alias("text_md5"))


def sse_reads(spark, sf_dir):
    """Streams of conversations as they come over a network: cut at arbitrary bytes, inside lines, JSON and characters."""
    c = table(spark, sf_dir, "conversations")
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    line = F.struct("turn", F.concat(F.lit("data: "), event, F.lit("\r\n: keep-alive\n\n")).alias("t"))
    streams = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "").alias("t"))
    bytes_ = streams.select("conv_id", F.concat("t", F.lit("data: [DONE]")).cast("binary").alias("b"), (F.pmod(F.col("conv_id") * 7, F.lit(61)) + 3).cast("int").alias("w"))
    reads = bytes_.select("conv_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("b") - 1, F.col("w")), lambda i: F.substring(F.col("b"), i + 1, F.col("w")))).alias("nr", "data"))
    lines = web.reassemble_lines(reads, "conv_id", "nr", "data")
    return web.concat_stream(lines, "conv_id", "line_no", "line").select("conv_id", F.md5("text").alias("text_md5"))


def udf_embed(spark, sf_dir):
    d = embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.get("embedding", 0), 5).alias("first"))


def embed_cached(spark, sf_dir):
    """A first run embeds a quarter of the documents, a second one all: which texts were kept by then, and the vectors' lengths."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = VectorCache(spark, scratch(spark, "vector-cache"), "hashed-16", hashed_vectors)
    cache.fill(d.filter("doc_id % 4 = 0"))
    new = cache.missing(d)
    path = scratch(spark, "missing")
    new.select("text").write.parquet(path)
    asked = spark.read.parquet(path).select(F.md5("text").alias("_md5"), F.lit(1).alias("_new"))
    out = cache.embed(d).withColumn("_md5", F.md5("text")).join(asked, "_md5", "left")
    return out.select("doc_id", F.col("_new").isNull().alias("reused"), F.size("embedding").alias("dim"))


def _token_lists(spark, sf_dir):
    """The inputs of indexing calls: 256 documents of a source with numbers in a row each, so no call grows with the source."""
    d = table(spark, sf_dir, "documents")
    call = F.floor(F.col("doc_id") / 256).alias("call")
    lists = d.groupBy("source", call).agg(F.array_sort(F.collect_list(F.struct("doc_id", estimated_tokens(F.col("text")).alias("t")))).alias("l"))
    return lists.select("source", "call", F.transform("l", lambda x: x["t"]).alias("tokens"))


def embed_batch(spark, sf_dir):
    rows = _token_lists(spark, sf_dir).select("source", "call", F.explode(F.arrays_zip("tokens", W.embed_batches(F.col("tokens")).alias("b"))).alias("x"))
    return rows.groupBy("source", "call", F.col("x.b").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.tokens").alias("tokens"))


def embed_reject(spark, sf_dir):
    return _token_lists(spark, sf_dir).select("source", "call", W.embed_rejects(F.col("tokens")).alias("rejected"))


def stream_index(spark, sf_dir):
    """Postings kept by a stream over chunk files, read back."""
    path = scratch(spark, "stream")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.lit(1).cast("long").alias("seq"))
    d.write.parquet(f"{path}/in")
    d.filter("doc_id % 5 = 0").withColumn("text", F.lit("new words only")).withColumn("seq", F.lit(2).cast("long")).write.mode("append").parquet(f"{path}/in")
    index.maintain_postings(index.read_chunks(spark, f"{path}/in"), f"{path}/postings", f"{path}/log").awaitTermination()
    return index.current(spark, f"{path}/postings").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"))


def stream_windows(spark, sf_dir):
    w = index.windowed_counts(table(spark, sf_dir, "events"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


QUERIES = {
    "src_detect_kind": src_detect_kind,
    "src_derive_name": src_derive_name,
    "src_csv": src_csv,
    "src_csv_rehydrate": src_csv,
    "src_user_csv": src_user_csv,
    "cell_normalize": cell_normalize,
    "pct_parse": lambda spark, sf_dir: cell_normalize(spark, sf_dir).select("id", "rate"),
    "currency_parse": lambda spark, sf_dir: cell_normalize(spark, sf_dir).select("id", "balance"),
    "src_sample_index": src_sample_index,
    "src_text": src_text,
    "src_size_gate": src_size_gate,
    "src_pdf": src_pdf,
    "pdf_mode_height": pdf_mode_height,
    "pdf_heading_mark": pdf_heading_mark,
    "pdf_line_assemble": pdf_line_assemble,
    "src_web_serper": src_web_serper,
    "src_web_ddg_parse": src_web_ddg_parse,
    "web_fallback": web_fallback,
    "src_model_catalog": src_model_catalog,
    "snk_legacy_migrate": snk_legacy_migrate,
    "sse_concat": sse_concat,
    "sse_reads": sse_reads,
    "udf_embed": udf_embed,
    "embed_cached": embed_cached,
    "embed_batch": embed_batch,
    "embed_reject": embed_reject,
    "stream_index": stream_index,
    "stream_windows": stream_windows,
}

_EXT = "[" + ", ".join(f"'{e}'" for e in _EXTENSIONS) + "][doc_id % 8 + 1]"
_MIME = "[NULL, 'text/csv', 'application/pdf', 'text/html', 'image/png'][(doc_id // 8) % 5 + 1]"
_CELLS = """
    c AS (SELECT c_custkey, round(abs(c_acctbal), 2) AS b, c_custkey % 100 / 100.0::DOUBLE AS r, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey::DOUBLE END AS p, c_name || ', ' || c_mktsegment AS l FROM customer)"""
_MONEY = "'$' || regexp_replace(printf('%.2f', abs(c_acctbal)), '([0-9])([0-9]{3}[.])', '\\1,\\2')"
_ITEMS = "i AS (SELECT l_orderkey AS page, l_linenumber AS seq, l_returnflag || l_linenumber AS str, l_quantity AS x, l_linenumber % 3 * 10.5 AS y, pow(2, l_suppkey % 3) AS height FROM lineitem)"
_MODE = "m AS (SELECT page, arg_max(height, (n, -reached, -height)) AS modal FROM (SELECT page, height, count(*) AS n, max(seq) AS reached FROM i GROUP BY ALL) GROUP BY 1)"
_GROUPED = "SELECT page_id // 20 AS query_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS rank, page_id, url FROM pages"

ORACLES = {
    "src_detect_kind": f"""
        WITH f AS (SELECT doc_id, lower({_EXT}) AS e, {_MIME} AS m FROM documents)
        SELECT doc_id, CASE WHEN e = 'csv' OR m IS NOT DISTINCT FROM 'text/csv' THEN 'csv' WHEN e = 'pdf' OR m IS NOT DISTINCT FROM 'application/pdf' THEN 'pdf'
            WHEN e IN ('md', 'markdown', 'txt', 'text', 'json') OR coalesce(starts_with(m, 'text/'), false) THEN 'text' ELSE 'unsupported' END AS kind FROM f""",
    "src_derive_name": "SELECT doc_id, 'My_' || source || '_Report_' || doc_id AS dataset FROM documents",
    "src_csv": f"SELECT c_custkey::VARCHAR AS id, {_MONEY} AS balance, (c_custkey % 100) || '%' AS rate, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey::VARCHAR END AS points, c_name || ', ' || c_mktsegment AS label FROM customer",
    "src_user_csv": f"WITH {_CELLS} SELECT c_custkey AS id, b AS balance, round(r, 4) AS rate, p AS points, l AS label FROM c",
    "cell_normalize": f"WITH {_CELLS} SELECT c_custkey::VARCHAR AS id, b AS balance, round(r, 4) AS rate, p AS points, NULL::DOUBLE AS label FROM c",
    "pct_parse": f"WITH {_CELLS} SELECT c_custkey::VARCHAR AS id, round(r, 4) AS rate FROM c",
    "currency_parse": f"WITH {_CELLS} SELECT c_custkey::VARCHAR AS id, b AS balance FROM c",
    "src_sample_index": "SELECT 'region' AS name, count(*) AS rows, true AS loaded FROM region UNION ALL SELECT 'nation', count(*), true FROM nation",
    "src_text": "SELECT string_agg(n_name, ' ' ORDER BY n_nationkey) AS text FROM nation",
    "src_size_gate": "SELECT 1 AS accepted",
    "src_pdf": """
        WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
        SELECT i // 20 + 1 AS page, string_agg(CASE WHEN i % 20 = 0 THEN '## ' ELSE '' END || n_name, '|' ORDER BY i) AS text, max(n_name) FILTER (i % 20 = 0) AS heading FROM n GROUP BY 1""",
    "pdf_mode_height": f"WITH {_ITEMS}, {_MODE} SELECT * FROM m",
    "pdf_heading_mark": f"WITH {_ITEMS} SELECT page, seq, CASE WHEN height >= 3 THEN '# ' WHEN height >= 1.5 THEN '## ' ELSE '' END || str AS marked FROM i",
    "pdf_line_assemble": f"""
        WITH {_ITEMS}, {_MODE},
        k AS (SELECT page, seq, x, floor(y + 0.5) AS line, str, CASE WHEN height >= 3 * modal THEN '# ' WHEN height >= 1.5 * modal THEN '## ' ELSE '' END AS mark FROM i JOIN m USING (page)),
        l AS (SELECT page, line, string_agg(mark || str, ' ' ORDER BY x, seq, mark || str) AS t FROM k GROUP BY ALL)
        SELECT page, string_agg(t, chr(10) ORDER BY line DESC) AS text, any_value(h) AS heading
        FROM l LEFT JOIN (SELECT page, first(str ORDER BY line DESC, x, seq, mark || str) AS h FROM k WHERE mark <> '' GROUP BY 1) USING (page) GROUP BY 1""",
    "src_web_serper": f"SELECT query_id, rank, CASE WHEN page_id % 3 <> 0 THEN 'T' || page_id ELSE 'Untitled' END AS title, CASE WHEN page_id % 2 = 0 THEN 'snip' ELSE '' END AS content, url FROM ({_GROUPED}) WHERE rank < 5",
    "src_web_ddg_parse": f"""
        SELECT query_id, rank, 'T' || page_id AS title, 'a bold & word' AS content, url FROM ({_GROUPED}) WHERE rank < 3 AND query_id % 20 <> 7
        UNION ALL SELECT DISTINCT page_id // 20, 0, '{web.NO_TITLE}', '{web.NO_CONTENT}', '{web.NO_URL}' FROM pages WHERE page_id // 20 % 20 = 7""",
    "web_fallback": "SELECT * FROM (VALUES ('none', 0), ('serper', 2), ('ddg', 2)) t(provider, n)",
    "src_model_catalog": "SELECT * FROM (VALUES (0, 'a/b-8b', 'x', 5), (1, 'c', '', 0), (2, '', 'z', 0)) t(seq, id, owned_by, created)",
    "snk_legacy_migrate": "SELECT vec_id, 't' || vec_id AS text, len(embedding) AS dim, round(embedding[64]::DOUBLE, 4) AS last FROM embeddings WHERE vec_id % 5 <> 4",
    "sse_concat": "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
    "sse_reads": "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1",
    "udf_embed": """
        WITH w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)),
        v AS (SELECT doc_id, h % 16 AS k, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM w GROUP BY ALL),
        n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, coalesce(sum(x) FILTER (k = 0), 0) AS x FROM v GROUP BY 1)
        SELECT doc_id, 16 AS dim, CASE WHEN coalesce(n, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, round(CASE WHEN coalesce(n, 0) > 0 THEN x / n ELSE 0 END, 5) AS first FROM documents LEFT JOIN n USING (doc_id)""",
    "embed_cached": "SELECT doc_id, md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) AS reused, 16 AS dim FROM documents",
    "embed_reject": "SELECT source, doc_id // 256 AS call, max(ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)) > 8192 AS rejected FROM documents GROUP BY ALL",
    "embed_batch": """
        WITH RECURSIVE t AS (
            SELECT source, doc_id // 256 AS call, row_number() OVER (PARTITION BY source, doc_id // 256 ORDER BY doc_id) AS i,
                ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::BIGINT AS k FROM documents),
        r AS (
            SELECT source, call, i, 0 AS b, 1 AS n, k AS s, k FROM t WHERE i = 1
            UNION ALL
            SELECT source, call, t.i, CASE WHEN n >= 64 OR s + t.k > 8192 THEN b + 1 ELSE b END, CASE WHEN n >= 64 OR s + t.k > 8192 THEN 1 ELSE n + 1 END, CASE WHEN n >= 64 OR s + t.k > 8192 THEN t.k ELSE s + t.k END, t.k
            FROM r JOIN t USING (source, call) WHERE t.i = r.i + 1)
        SELECT source, call, b AS batch, count(*) AS n, sum(k) AS tokens FROM r GROUP BY ALL""",
    "stream_index": """
        WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new words only' ELSE text END AS text FROM documents),
        t AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 1)) AS w FROM d)
        SELECT doc_id, count(DISTINCT w) AS terms, count(*) AS words FROM t GROUP BY 1""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
ORACLES["src_csv_rehydrate"] = ORACLES["src_csv"]

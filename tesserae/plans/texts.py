"""Queries of text functions, chunking, retrieval glue and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import analytics as A
from tesserae.operators import chunking as C
from tesserae.operators import lru as L
from tesserae.operators import rag as G
from tesserae.operators import retrieval as R
from tesserae.operators import state as S
from tesserae.plans import packing_sql as P
from tesserae.plans.retrieval import BM25_SQL, questions
from tesserae.sources.snapshots import SnapshotTable
from tesserae.sources.tables import scratch, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _per_doc(**columns):
    """A query of columns made of the text by functions."""
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", *[make(F.col("text")).alias(n) for n, make in columns.items()])


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("hyp"))


def token_overlap(spark, sf_dir):
    """Overlap of every benchmark item with all documents: how many share a token, and the sum and best of the shares."""
    s = G.overlap_scores(_docs(spark, sf_dir), _items(spark, sf_dir), "item_id", "doc_id", "text", "hyp")
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("overlap").alias("best"), F.sum(F.round(F.col("overlap") * 1000000).cast("long")).alias("sum_millionths"))


def rerank_overlap(spark, sf_dir):
    return G.rerank_corpus(_docs(spark, sf_dir), _items(spark, sf_dir), "item_id", "doc_id", "text", "hyp").select("item_id", "doc_id", "overlap", "rank")


def _hits(spark, sf_dir):
    return R.bm25(_docs(spark, sf_dir), questions(spark, sf_dir), 20)


def fanout_union(spark, sf_dir):
    path = scratch(spark, "hits")
    _hits(spark, sf_dir).write.parquet(path)  # read twice, searched once
    hits = spark.read.parquet(path)
    return G.fanout_union(hits.filter("rank % 2 = 1"), hits.filter("rank % 3 = 1"), ["query_id", "doc_id"])


def dedup_first(spark, sf_dir):
    return G.dedup_first(_docs(spark, sf_dir), ["lang", "source"], "doc_id").select("lang", "source", "doc_id", "n_chars")


def grade_filter(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    outcome = F.when(F.col("doc_id") % 3 == 0, "irrelevant").when(F.col("doc_id") % 3 == 1, "relevant").otherwise("keep-on-error")
    return G.grade_filter(hits, "query_id", outcome, "rank", 3).select("query_id", "doc_id", "rank")


def udf_llm(spark, sf_dir):
    """Grading by an injected judge; here one that looks for a word and fails on long texts."""

    def ask(question, content):
        if len(content) >= 1500:
            raise ValueError("too long")
        return "yes" if question in content else "no"

    docs = _docs(spark, sf_dir).select("doc_id", F.lit("the").alias("question"), "text")
    return G.judge(docs, "question", "text", ask).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def prompt_context(spark, sf_dir):
    """The context of each question: its best four hits with their whole texts."""
    docs = _docs(spark, sf_dir).select("source", "doc_id", F.col("text").alias("content"), (F.col("doc_id") % 3).alias("page"))
    path = scratch(spark, "hits")
    _hits(spark, sf_dir).filter("rank <= 4").select("query_id", "doc_id", "rank").write.parquet(path)
    return G.prompt_context(docs.join(R.small(spark.read.parquet(path)), "doc_id"), "query_id", "rank").select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n"))


def citation_fmt(spark, sf_dir):
    return G.citations(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("heading"))).select("doc_id", "excerpt")


def display_trunc(spark, sf_dir):
    return _docs(spark, sf_dir).orderBy("doc_id").limit(20).select("doc_id", F.substring("text", 1, 400).alias("preview"), F.substring("text", 1, 200).alias("excerpt"))


def conv_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", X.conversation_title(F.col("t")).alias("title"))


def last_n_per_group(spark, sf_dir):
    return S.last_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def snk_state_persist(spark, sf_dir):
    return S.trim_log(table(spark, sf_dir, "conversations"), "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


def _puts(spark, sf_dir):
    """Documents as puts of their source under keys of language and a number."""
    return _docs(spark, sf_dir).select(F.concat("lang", F.lit("-"), (F.col("doc_id") % 50).cast("string")).alias("id"), "source", "n_chars", F.col("doc_id").alias("seq"))


def upsert_last(spark, sf_dir):
    return S.upsert_last(_puts(spark, sf_dir), "id", "seq")


def snk_vector_put(spark, sf_dir):
    """All embeddings put into a store, a tenth of them put again under another label, and read."""
    e, store = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), SnapshotTable(spark, scratch(spark, "vectors"), "vec_id")
    store.put(e)
    store.put(e.filter("vec_id % 10 = 0").withColumn("label", F.lit(-1)))
    return store.read().select("vec_id", "label")


def snk_vector_scan(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def snk_delete_by_index(spark, sf_dir):
    """Documents in a store, those of a source deleted from it: what is left, read again, and how many went."""
    store = SnapshotTable(spark, scratch(spark, "documents"), "doc_id")
    store.put(_docs(spark, sf_dir).select("doc_id", "source", "n_chars"))
    _, removed = store.delete("source", "src3")
    return store.read().agg(F.count(F.lit(1)).alias("n_left"), F.lit(removed).cast("long").alias("removed"))


def source_count(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _hashed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "source", F.when(F.col("doc_id") % 7 != 0, F.md5("text")).otherwise("").alias("source_hash"))


def source_hash_set(spark, sf_dir):
    return S.source_hashes(_hashed(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("source_hash").alias("first"))


def semi_hash_exists(spark, sf_dir):
    """Documents with odd ids whose hash one with an even id already has."""
    h = _hashed(spark, sf_dir).filter("source_hash <> ''")
    old = h.filter("doc_id % 2 = 0").select("source_hash").distinct()
    return h.filter("doc_id % 2 = 1").join(old, "source_hash", "left_semi").select("doc_id")


def cached_partition(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("text_hash"), F.lit("m1").alias("model_id"))
    have, lack = S.cached_parts(d, d.filter("doc_id % 4 = 0"), ["model_id", "text_hash"])
    return have.select("doc_id", F.lit("cached").alias("part")).unionByName(lack.select("doc_id", F.lit("missing").alias("part")))


def dataset_replace_union(spark, sf_dir):
    d = _docs(spark, sf_dir).select("source", "doc_id", "n_chars")
    new = d.filter("source IN ('src1', 'src2') AND doc_id % 3 = 0").withColumn("n_chars", F.lit(0).cast("long"))
    return S.replace_source(d, new)


def lru_evict(spark, sf_dir):
    return S.lru_survivors(table(spark, sf_dir, "events"), "user_id", "event_id", 64)


def _accesses(spark, sf_dir):
    """Events as a log of a cache: every third sets its user's entry, the others ask for it."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, "set").otherwise("get").alias("op"))


def lru_replay(spark, sf_dir):
    """Hit or miss of every get of that log in a cache of 64 entries."""
    return L.replay(_accesses(spark, sf_dir), "user_id", "event_id", "op", 64, segment_rows=20_000)[0]


def step_duration(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000")
    steps = e.groupBy("user_id").agg(F.min(ms).alias("started_ms"), F.max(ms).alias("finished_ms"))
    return S.step_durations(steps).select("user_id", "duration_ms")


def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.lower(F.get_json_object("props", "$.binary_score")) == "yes", F.lit(False)).alias("yes"))


def json_stringify(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


def hash_fnv1a32(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.fnv1a32(F.col("text")).alias("hash"))


def split_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(X.sentences(F.col("text"))).alias("n"))


def hard_split(spark, sf_dir):
    """Whole texts split as one sentence each."""
    pieces = C.hard_split(C.collapse(F.col("text")), 300, 75)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(pieces).alias("nr", "piece")).select("doc_id", "nr", F.length("piece").alias("n"), F.md5("piece").alias("piece_md5"))


def _sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.sentences(C.collapse(F.col("text")), True).alias("sentences"))


def pack_sentences(spark, sf_dir):
    packed = F.col("packed")
    d = _sentences(spark, sf_dir).select("doc_id", C.pack(F.col("sentences"), C.Sizing.chars(300, 75), True).alias("packed")).filter(F.size(packed) > 0)
    return d.select("doc_id", F.size(packed).cast("long").alias("n_chunks"), F.array_max(F.transform(packed, lambda p: F.length(p))).alias("longest"), F.md5(F.array_join(packed, "\n")).alias("texts_md5"))


def chunk_sentences(spark, sf_dir):
    return C.chunk_sentences(_sentences(spark, sf_dir), C.Sizing.tokens(128, 32), collapsed=True)


def _headed(spark, sf_dir):
    """Every line break of a document starts a headed section."""
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# Start\n"), F.regexp_replace("text", "\n", "\n## Part\n")).alias("text"))


def split_headings(spark, sf_dir):
    """Sections of such texts; documents with odd ids have a line before the first heading too."""
    before = F.when(F.col("doc_id") % 2 == 1, F.lit("before\n")).otherwise(F.lit(""))
    found = _headed(spark, sf_dir).select("doc_id", F.posexplode(C.sections(F.concat(before, F.col("text")))).alias("section", "s"))
    return found.select("doc_id", "section", "s.heading", F.md5("s.body").alias("body_md5"), "s.start")


def chunk_text(spark, sf_dir):
    return C.chunk_documents(_headed(spark, sf_dir), C.Sizing.tokens(), keep_small=False)


def chunk_index(spark, sf_dir):
    return C.chunk_documents(_docs(spark, sf_dir), C.Sizing.chars()).groupBy("doc_id").agg(F.max("chunk_index").alias("last_index"), F.count(F.lit(1)).alias("n"))


def chunk_id(spark, sf_dir):
    c = C.chunk_documents(_docs(spark, sf_dir), C.Sizing.chars()).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9)
    return c.select("doc_id", X.chunk_id(F.col("source"), F.col("chunk_index"), page).alias("chunk_id"))


def tok_ident(spark, sf_dir):
    cat = A.catalog_of(spark, {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "part")})
    return cat.select("name", F.array_join(F.flatten(F.transform("columns", lambda c: F.split(F.lower(c), r"[_\s]+"))), " ").alias("tokens"))


def html_strip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    t = X.strip_tags(F.col("html"))
    return p.select("page_id", F.length(t).alias("n"), F.md5(t).alias("text_md5"))


def html_decode(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("t", F.concat(F.lit("&lt;a&gt; &amp;amp; &quot;&#39;&apos; "), F.col("html")))
    return p.select("page_id", X.decode_entities(F.col("t")).alias("intended"), X.decode_entities(F.col("t"), False).alias("literal"))


def url_unwrap(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    wrapped = F.concat(F.lit("https://d.example/l/?x=1&uddg="), F.url_encode("url"))
    return p.select("page_id", X.unwrap_url(wrapped).alias("inner_url"), X.unwrap_url(F.col("url")).alias("same_url"))


QUERIES = {
    "tok_overlap": _per_doc(n=lambda t: F.size(X.overlap_tokens(t)), head=lambda t: F.array_join(F.slice(X.overlap_tokens(t), 1, 10), " ")),
    "tok_question": _per_doc(n=lambda t: F.size(A.question_tokens(t))),
    "tok_ident": tok_ident,
    "est_tokens": _per_doc(tokens=X.estimated_tokens),
    "est_tokens_chars": _per_doc(tokens=X.estimated_tokens_by_chars),
    "ws_collapse": _per_doc(text_md5=lambda t: F.md5(X.collapse(t))),
    "hash_fnv1a32": hash_fnv1a32,
    "split_sentence": split_sentence,
    "hard_split": hard_split,
    "pack_sentences": pack_sentences,
    "chunk_sentences": chunk_sentences,
    "split_headings": split_headings,
    "chunk_text": chunk_text,
    "chunk_index": chunk_index,
    "chunk_id": chunk_id,
    "token_overlap": token_overlap,
    "rerank_overlap": rerank_overlap,
    "fanout_union": fanout_union,
    "dedup_first": dedup_first,
    "grade_filter": grade_filter,
    "udf_llm": udf_llm,
    "prompt_context": prompt_context,
    "citation_fmt": citation_fmt,
    "display_trunc": display_trunc,
    "conv_title": conv_title,
    "last_n_per_group": last_n_per_group,
    "snk_state_persist": snk_state_persist,
    "upsert_last": upsert_last,
    "snk_vector_put": snk_vector_put,
    "snk_vector_scan": snk_vector_scan,
    "snk_delete_by_index": snk_delete_by_index,
    "source_count": source_count,
    "source_hash_set": source_hash_set,
    "semi_hash_exists": semi_hash_exists,
    "cached_partition": cached_partition,
    "dataset_replace_union": dataset_replace_union,
    "lru_evict": lru_evict,
    "lru_replay": lru_replay,
    "step_duration": step_duration,
    "json_extract": json_extract,
    "json_stringify": json_stringify,
    "html_strip": html_strip,
    "html_decode": html_decode,
    "url_unwrap": url_unwrap,
}

_OT = "list_filter(string_split_regex(lower({0}), '\\W+'), lambda w: w <> '')"
_OVERLAP = f"""
    WITH h AS (SELECT item_id, unnest(t) AS token, len(t) AS size FROM (SELECT item_id, {_OT.format('text')} AS t FROM benchmark)),
    d AS (SELECT DISTINCT doc_id, unnest({_OT.format('text')}) AS token FROM documents),
    s AS (SELECT item_id, doc_id, round(count(*) / max(size)::DOUBLE, 6) AS overlap FROM h JOIN d USING (token) GROUP BY ALL)"""

_SNT = f"WITH RECURSIVE snt AS (SELECT doc_id AS g, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, {P.SENTENCES.format(P.COLLAPSED.format('text'))} AS l FROM documents)),"

ORACLES = {
    "fanout_union": BM25_SQL
    + """,
        u AS (SELECT query_id, doc_id, score, 0 AS side, rank FROM r WHERE rank <= 20 AND rank % 2 = 1 UNION ALL SELECT query_id, doc_id, score, 1, rank FROM r WHERE rank <= 20 AND rank % 3 = 1),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY side, rank) AS n FROM u)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS rank FROM f WHERE n = 1""",
    "grade_filter": BM25_SQL
    + """,
        k AS (SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE rank <= 20 AND doc_id % 3 <> 0)
        SELECT query_id, doc_id, rank FROM k WHERE n <= 3""",
    "tok_ident": """
        SELECT table_name AS name, string_agg(replace(lower(column_name), '_', ' '), ' ' ORDER BY column_index) AS tokens
        FROM duckdb_columns() WHERE table_name IN ('orders', 'lineitem', 'part') GROUP BY 1""",
    "tok_overlap": f"SELECT doc_id, len(t) AS n, array_to_string(t[1:10], ' ') AS head FROM (SELECT doc_id, {_OT.format('text')} AS t FROM documents)",
    "tok_question": "SELECT doc_id, len(list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3))) AS n FROM documents",
    "est_tokens": "SELECT doc_id, ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE)::INT AS tokens FROM documents",
    "est_tokens_chars": "SELECT doc_id, greatest(1, ceil(length(text) / 4.0)::INT) AS tokens FROM documents",
    "ws_collapse": "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents",
    "hash_fnv1a32": """
        SELECT doc_id, printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
            lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS hash FROM documents""",
    "split_sentence": "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')) AS n FROM documents",
    "hard_split": f"""
        WITH RECURSIVE d AS (SELECT doc_id AS g, 0 AS i, {P.COLLAPSED.format("text")} AS t FROM documents), {P.hard_split("d", 300, 75)},
        p AS (SELECT g, nr + generate_subscripts(pieces, 1) - 1 AS nr, unnest(pieces) AS piece FROM walk)
        SELECT g AS doc_id, nr, length(piece) AS n, md5(piece) AS piece_md5 FROM p""",
    "split_headings": f"""
        WITH {P.HEADED}, o AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS odd FROM ln)
        SELECT doc_id, k + odd AS section, CASE WHEN k = 0 THEN 'Start' ELSE 'Part' END AS heading, md5(body) AS body_md5, (start + 7 * odd)::INT AS start FROM o
        UNION ALL SELECT doc_id, 0, NULL, md5('before' || chr(10)), 0 FROM documents WHERE doc_id % 2 = 1""",
    "pack_sentences": _SNT + P.packed(False, 300, 75) + " SELECT g AS doc_id, count(*) AS n_chunks, max(length(text)) AS longest, md5(string_agg(text, chr(10) ORDER BY nr)) AS texts_md5 FROM chk GROUP BY g",
    "chunk_sentences": _SNT + P.packed(True, 128, 32) + f" SELECT g AS doc_id, nr AS chunk_index, text, {P.estimate('text')} AS token_count FROM chk",
    "chunk_text": f"""
        WITH RECURSIVE {P.HEADED},
        bd AS (SELECT *, {P.COLLAPSED.format("body")} AS t FROM ln),
        snt AS (SELECT {{'d': doc_id, 'k': k}} AS g, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT doc_id, k, {P.SENTENCES.format("t")} AS l FROM bd)),
        {P.packed(True, 512, 64)},
        sized AS (SELECT g, nr, text, {P.estimate("text")} AS tokens, count(*) OVER (PARTITION BY g) AS n FROM chk),
        kept AS (SELECT bd.doc_id, k, nr, text, tokens, start + greatest(instr(t, text) - 1, 0) AS place, CASE WHEN k = 0 THEN 'Start' ELSE 'Part' END AS heading
            FROM sized JOIN bd ON g.d = doc_id AND g.k = bd.k WHERE NOT (sized.n = 1 AND tokens < 64 AND k < bd.n - 1)),
        al AS (SELECT doc_id, 0 AS k, 0 AS nr, {P.COLLAPSED.format("'# Start' || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10))")} AS text, 0 AS place, 'Start' AS heading
            FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
        done AS (SELECT doc_id, k, nr, text, tokens, place, heading FROM kept UNION ALL SELECT doc_id, k, nr, text, {P.estimate("text")}, place, heading FROM al)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, nr) - 1 AS chunk_index, text, heading, place::INT AS char_start, (place + length(text))::INT AS char_end, tokens AS token_count FROM done""",
    "chunk_index": _SNT + P.packed(False, 800, 200) + ", c AS (SELECT doc_id, greatest(count(nr), 1) AS n FROM documents LEFT JOIN chk ON g = doc_id GROUP BY 1) SELECT doc_id, n - 1 AS last_index, n FROM c",
    "chunk_id": _SNT + P.packed(False, 800, 200) + """, c AS (SELECT doc_id, source, coalesce(nr, 0) AS nr FROM documents LEFT JOIN chk ON g = doc_id)
        SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '-p' || (doc_id % 9) ELSE '' END || '-' || nr AS chunk_id FROM c""",
    "token_overlap": _OVERLAP + " SELECT item_id, count(*) AS n, max(overlap) AS best, sum(round(overlap * 1000000)::BIGINT)::BIGINT AS sum_millionths FROM s GROUP BY 1",
    "rerank_overlap": _OVERLAP + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 4",
    "dedup_first": "SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY ALL",
    "udf_llm": "SELECT CASE WHEN length(text) >= 1500 THEN 'keep-on-error' WHEN contains(text, 'the') THEN 'relevant' ELSE 'irrelevant' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "prompt_context": BM25_SQL
    + """,
        c AS (SELECT query_id, 'DOCUMENTS:' || chr(10) || string_agg('[' || source || CASE WHEN doc_id % 3 <> 0 THEN ' p.' || (doc_id % 3) ELSE '' END || ']' || chr(10) || text,
            chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS t FROM r JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY 1)
        SELECT query_id, md5(t) AS context_md5, length(t) AS n FROM c""",
    "citation_fmt": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '[' || lang || '] ' ELSE '' END || substr(text, 1, 200) AS excerpt FROM documents",
    "display_trunc": "SELECT doc_id, substr(text, 1, 400) AS preview, substr(text, 1, 200) AS excerpt FROM documents ORDER BY doc_id LIMIT 20",
    "conv_title": """
        WITH f AS (SELECT conv_id, regexp_replace(arg_min(text, turn), '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT conv_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '…' ELSE t END AS title FROM f""",
    "last_n_per_group": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "snk_state_persist": "SELECT conv_id, count(*) AS n, min(turn) AS first_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE length(coalesce(text, '')) > 0) WHERE k <= 50 GROUP BY 1",
    "upsert_last": "SELECT lang || '-' || (doc_id % 50) AS id, arg_max(source, doc_id) AS source, arg_max(n_chars, doc_id) AS n_chars, max(doc_id) AS seq, min(doc_id) AS position FROM documents GROUP BY 1",
    "snk_vector_put": "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings",
    "snk_vector_scan": "SELECT label, count(*) AS n FROM embeddings GROUP BY 1",
    "snk_delete_by_index": "SELECT count(*) FILTER (source <> 'src3') AS n_left, count(*) FILTER (source = 'src3') AS removed FROM documents",
    "source_count": "SELECT source, count(*) AS n FROM documents GROUP BY 1",
    "source_hash_set": "SELECT source, count(DISTINCT md5(text)) AS n, min(md5(text)) AS first FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1",
    "semi_hash_exists": "WITH h AS (SELECT doc_id, md5(text) AS m FROM documents WHERE doc_id % 7 <> 0) SELECT doc_id FROM h WHERE doc_id % 2 = 1 AND m IN (SELECT m FROM h WHERE doc_id % 2 = 0)",
    "cached_partition": "SELECT doc_id, CASE WHEN md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) THEN 'cached' ELSE 'missing' END AS part FROM documents",
    "dataset_replace_union": "SELECT source, doc_id, CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE n_chars END AS n_chars FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0",
    "lru_evict": "SELECT user_id, max(event_id) AS last_used FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 64",
    "lru_replay": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, event_id % 3 = 0 AS puts, row_number() OVER (ORDER BY event_id) AS i FROM events),
        walk AS (
            SELECT 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, true AS puts, NULL::BOOLEAN AS hit, []::BIGINT[] AS held
            UNION ALL
            SELECT e.i, e.event_id, e.user_id, e.puts, CASE WHEN e.puts THEN NULL ELSE list_contains(held, e.user_id) END,
                CASE WHEN e.puts OR list_contains(held, e.user_id) THEN (list_filter(held, lambda k: k <> e.user_id) || [e.user_id])[-64:] ELSE held END
            FROM walk JOIN e ON e.i = walk.i + 1)
        SELECT user_id, event_id, CASE WHEN puts THEN 'set' ELSE 'get' END AS op, hit FROM walk WHERE i > 0""",
    "step_duration": "SELECT user_id, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS duration_ms FROM events GROUP BY 1",
    "json_extract": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, false AS yes FROM events",
    "json_stringify": """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""",
    "html_strip": "SELECT page_id, length(t) AS n, md5(t) AS text_md5 FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages)",
    "html_decode": """
        SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS intended,
            replace(t, '&apos;', '''') AS literal FROM (SELECT page_id, '&lt;a&gt; &amp;amp; &quot;&#39;&apos; ' || html AS t FROM pages)""",
    "url_unwrap": "SELECT page_id, url AS inner_url, url AS same_url FROM pages",
}

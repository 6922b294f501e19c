"""Queries of model choice, evaluation, control flow and remaining rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import analytics as A
from tesserae.operators import evaluation as E
from tesserae.operators import picker as P
from tesserae.operators import retrieval as R
from tesserae.operators import workflow as W
from tesserae.plans.retrieval import BM25_SQL, questions
from tesserae.sources.tables import table

MODELS = (
    "meta/llama-3.3-70b-instruct",
    "meta/llama-3.1-8b-instruct",
    "nvidia/llama-3.1-nemotron-nano-8b-v1",
    "nvidia/nemotron-4-340b-instruct",
    "nvidia/nv-embedqa-e5-v5",
    "nvidia/nv-embedqa-mistral-7b-v2",
    "mistralai/codestral-22b-instruct-v0.1",
    "meta/codellama-70b",
    "google/gemma-3-4b-it",
    "mistralai/mistral-7b-instruct-v0.3",
    "nvidia/llama-guard-8b",
    "microsoft/phi-3-vision-128k-instruct",
    "ibm/granite-34b-code-instruct",
    "openai/gpt-oss-120b",
    "zyphra/zamba2-7b-instruct",
    "Snowflake/Arctic-Embed-L",
)


def _models(spark):
    return spark.createDataFrame([(i, m) for i, m in enumerate(MODELS)], "seq int, id string")


def model_classify(spark, sf_dir):
    flags = ("is_embedding", "is_code", "is_safety", "is_vision", "is_chat")
    return P.classify(_models(spark)).select("id", *[F.col(c).cast("int").alias(c) for c in flags])


def model_size_class(spark, sf_dir):
    return P.classify(_models(spark)).select("id", "size_class")


def rules_theta(spark, sf_dir):
    return P.matching_rules(_models(spark), P.rules_table(spark)).select("id", "task", "family", "points")


def model_rule_sum(spark, sf_dir):
    return P.rule_points(_models(spark), P.rules_table(spark))


def model_pick(spark, sf_dir):
    return P.pick(_models(spark), P.rules_table(spark))


def catalog_anti(spark, sf_dir):
    picked = spark.createDataFrame([("meta/codellama-70b",), ("gone/model",), ("",)], "id string")
    return P.missing_models(picked, _models(spark))


def asym_input_type(spark, sf_dir):
    both = _models(spark).crossJoin(spark.createDataFrame([(True,), (False,)], "is_query boolean"))
    return both.select("id", F.col("is_query").cast("int").alias("is_query"), P.input_type(F.col("id"), F.col("is_query")).alias("input_type"))


def local_models_migrate(spark, sf_dir):
    rows = [(1, None, None, "a", "r", None, None, "e"), (2, None, None, " ", "r", "c", None, None), (3, "chat", "emb", "a", None, None, None, "e"), (4, None, "kept", None, None, None, None, None), (5, "old", None, None, None, None, "v", None)]
    return P.migrate_local(spark.createDataFrame(rows, "id int, chat string, embeddings string, answer string, routing string, codeGen string, eval string, embedding string"))


def settings_validate(spark, sf_dir):
    schema = "id int, provider string, api_key string, embedding_api_key string, local_server_url string, chat string, embeddings string, catalog array<string>, web_search string, serper_key string"
    rows = [(1, "nim", "k", "e", None, None, None, None, "ddg", None), (2, "nim", " ", None, None, None, None, None, "serper", ""), (3, "local", None, None, "u", "m", "n", ["m"], "ddg", None), (4, "local", None, None, "", None, None, [], "serper", "k"), (5, "local", None, None, "u", "m", "n", ["m", "n"], "ddg", None)]
    v = P.validate_settings(spark.createDataFrame(rows, schema))
    return v.select("id", F.col("valid").cast("int").alias("valid"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


def _results(spark, sf_dir):
    """Labelled documents as answered questions; the scores of one come from its own ten events."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    scores = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 10).alias("slot")).agg(F.collect_list(F.col("value") / 100).alias("scores"))
    rows = lab.join(scores, lab["doc_id"] == scores["slot"], "left")
    source = lambda n: F.when(n % 3 == 0, "vectorstore").when(n % 3 == 1, "python").otherwise("websearch")
    return rows.select(
        F.col("doc_id").cast("string").alias("question_id"),
        F.col("lang").alias("category"),
        source(F.col("doc_id")).alias("expected_source"),
        F.when(F.col("doc_id") % 11 == 0, None).otherwise(source(F.col("doc_id") + F.col("toxic"))).alias("actual_source"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
        (F.col("doc_id") % 14).cast("int").alias("min_relevant_chunks"),
        F.when(F.col("doc_id") % 17 == 0, "failed").alias("error"),
        F.col("n_chars").alias("latency_ms"),
    )


def eval_row_metrics(spark, sf_dir):
    m = E.row_metrics(_results(spark, sf_dir))
    return m.select("question_id", "relevant_chunks", F.col("routing_correct").cast("int").alias("routing_correct"), F.round("recall_at_k", 6).alias("recall_at_k"), F.col("passed").cast("int").alias("passed"))


def eval_summary(spark, sf_dir):
    return E.summary(E.row_metrics(_results(spark, sf_dir)))


def eval_by_category(spark, sf_dir):
    return E.summary(E.row_metrics(_results(spark, sf_dir)), ["category"])


def eval_report(spark, sf_dir):
    r = E.report(E.row_metrics(_results(spark, sf_dir)), "Evaluation Report")
    return r.select(F.col("seq.part").alias("part"), F.col("seq.key").alias("key"), F.col("seq.n").alias("n"), "line")


def eval_ir_metrics(spark, sf_dir):
    """Ranking quality of BM25 where documents of quality 1 count as relevant to every query."""
    docs = table(spark, sf_dir, "documents")
    texts = questions(spark, sf_dir)
    hits = R.bm25(docs, texts, 20)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return E.ranking_metrics(hits, good.crossJoin(F.broadcast(texts.select("query_id"))), 20)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.get_json_object("props", "$.k").cast("int").alias("k"))


def wf_route(spark, sf_dir):
    answer = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"datasource":"'), "event_type", F.lit('"}'))).when(F.col("event_id") % 4 == 1, "not json").when(F.col("event_id") % 4 == 2, '{"datasource":""}').otherwise("{}")
    return _events(spark, sf_dir).select("event_id", W.route_of(answer).alias("route"))


def wf_fallback(spark, sf_dir):
    return _events(spark, sf_dir).select("event_type", W.fallback_of(F.when(F.col("event_id") % 2 == 0, "vectorstore").otherwise(F.col("event_type"))).alias("fallback")).groupBy("event_type", "fallback").agg(F.count(F.lit(1)).alias("n"))


def backoff(spark, sf_dir):
    attempt = (F.col("event_id") % 3 + 1).cast("int")
    after = F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 12).cast("int"))
    return _events(spark, sf_dir).select("event_id", W.embed_wait_ms(attempt, after).alias("wait_ms"))


def err_taxonomy(spark, sf_dir):
    status = (F.col("event_id") % 210 + 400).cast("int")
    code = W.classify_status(status)
    return _events(spark, sf_dir).select(code.alias("code"), W.is_retryable(code).cast("int").alias("retryable")).groupBy("code", "retryable").agg(F.count(F.lit(1)).alias("n"))


def _asked(questions, useful_after, broken=False):
    """Scripted runs of the loop: (question, source, retries, steps)."""
    rows = []
    for i, q in enumerate(questions):
        seen = []

        def judge(a, b, seen=seen, i=i):
            seen.append(1)
            if broken:
                raise ValueError
            return '{"binary_score":"yes"}' if len(seen) > useful_after[i] else '{"binary_score":"no"}'

        run = W.answer_question(q, lambda t: '{"datasource":"python"}' if "sum" in t else "oops", lambda s, t: "" if "nothing" in t else f"{s}: {t}", lambda c, t: c.upper(), (judge, lambda a, b: '{"binary_score":"Yes"}'))
        rows.append((q, run.source, run.retries, len(run.steps), run.answer))
    return rows


_RUN = "question string, source string, retries int, n_steps int, answer string"


def wf_generate_eval_loop(spark, sf_dir):
    return spark.createDataFrame(_asked(["sum it", "find it", "never", "nothing"], [0, 2, 99, 0]), _RUN)


def wf_trace(spark, sf_dir):
    run = W.answer_question("q", lambda t: "", lambda s, t: s, lambda c, t: c, (lambda a, b: '{"binary_score":"yes"}', lambda a, b: '{"binary_score":"no"}'), rounds=1)
    return spark.createDataFrame([(i, *s) for i, s in enumerate(run.steps)], "seq int, name string, detail string")


def wf_hyde(spark, sf_dir):
    def fails(q):
        raise TimeoutError

    rows = [(n, W.expand_question("q", call)) for n, call in (("passage", lambda q: " p "), ("empty", lambda q: ""), ("fails", fails))]
    return spark.createDataFrame(rows, "name string, expanded string")


def wf_retry(spark, sf_dir):
    rows = []
    for name, failures, again in (("first", 0, True), ("third", 2, True), ("final", 1, False), ("always", 9, True)):
        waits, left = [], [failures]

        def call(left=left):
            if left[0]:
                left[0] -= 1
                raise ConnectionError
            return "ok"

        try:
            result = W.with_retry(call, lambda e, again=again: again, waits.append)
        except ConnectionError:
            result = "raised"
        rows.append((name, result, float(sum(waits))))
    return spark.createDataFrame(rows, "name string, result string, waited double")


def wf_circuit(spark, sf_dir):
    rows = []
    for name, calls in (("mixed", [False, False, True, False, False]), ("open", [False, False, False, True])):
        circuit, state = W.Circuit(), "closed"
        try:
            for ok in calls:
                circuit.record(ok)
        except RuntimeError:
            state = "open"
        rows.append((name, state))
    return spark.createDataFrame(rows, "name string, state string")


def udf_codegen(spark, sf_dir):
    """What the original generates code for, as one declarative spec: filter, join, group, sort, limit."""
    tables = {"l": table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p": table(spark, sf_dir, "part")}
    spec = {"from": "l", "join": [{"table": "p", "on": ["p_partkey"]}], "filter": [["l_quantity", ">", 25], ["p_size", "<=", 20]], "groupby": ["p_type"], "rollup": {"n": ["count", "*"], "most": ["max", "l_quantity"]}, "orderby": [["n", "desc"], ["p_type", "asc"]], "limit": 10}
    return A.run_spec(tables, spec)


def date_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.datediff(F.to_date(F.lit("2000-01-01")), F.col("o_orderdate").cast("date")).alias("days"))


def date_trunc(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("MONTH", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "model_classify": model_classify,
    "model_size_class": model_size_class,
    "rules_theta": rules_theta,
    "model_rule_sum": model_rule_sum,
    "model_pick": model_pick,
    "catalog_anti": catalog_anti,
    "asym_input_type": asym_input_type,
    "local_models_migrate": local_models_migrate,
    "settings_validate": settings_validate,
    "eval_row_metrics": eval_row_metrics,
    "eval_summary": eval_summary,
    "eval_by_category": eval_by_category,
    "eval_report": eval_report,
    "eval_ir_metrics": eval_ir_metrics,
    "wf_route": wf_route,
    "wf_fallback": wf_fallback,
    "wf_generate_eval_loop": wf_generate_eval_loop,
    "wf_trace": wf_trace,
    "wf_hyde": wf_hyde,
    "wf_retry": wf_retry,
    "wf_circuit": wf_circuit,
    "backoff": backoff,
    "err_taxonomy": err_taxonomy,
    "udf_codegen": udf_codegen,
    "date_diff": date_diff,
    "date_trunc": date_trunc,
}


def _values(rows):
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


_M = f"m AS (SELECT * FROM {_values(list(enumerate(MODELS)))} t(seq, id))"
_RULES = f"r AS (SELECT * FROM {_values([(t, *x) for t, rules in (('chat', P.CHAT_RULES), ('code', P.CODE_RULES), ('embedding', P.EMBEDDING_RULES)) for x in rules])} t(task, family, pattern, points))"
_HIT = lambda p: f"regexp_matches(lower(id), '{p}')"
_FLAGS = f"{_HIT(P.EMBEDDING_CLASS)}::INT AS is_embedding, {_HIT(P.CODE_CLASS)}::INT AS is_code, {_HIT(P.SAFETY_CLASS)}::INT AS is_safety, {_HIT(P.VISION_CLASS)}::INT AS is_vision"
_SIZE = "CASE " + " ".join(f"WHEN {_HIT(p)} THEN '{n}'" for n, p in P.SIZES) + " ELSE 'medium' END"
_SRC = "CASE WHEN ({0}) % 3 = 0 THEN 'vectorstore' WHEN ({0}) % 3 = 1 THEN 'python' ELSE 'websearch' END"
_EVAL = f"""
    WITH s AS (SELECT event_id // 10 AS slot, count(*) FILTER (value / 100 > 0.3::DOUBLE) AS n FROM events GROUP BY 1),
    q AS (SELECT doc_id, lang, n_chars, coalesce(n, 0) AS rel, {_SRC.format('doc_id')} AS e, CASE WHEN doc_id % 11 <> 0 THEN {_SRC.format('doc_id + toxic')} END AS a, doc_id % 14 AS wanted
          FROM labels JOIN documents USING (doc_id) LEFT JOIN s ON slot = doc_id),
    r AS (SELECT *, coalesce(a = e, false) AS ok, CASE WHEN wanted = 0 THEN 1 ELSE least(1, rel / wanted::DOUBLE) END AS rec FROM q),
    g AS (SELECT *, doc_id % 17 <> 0 AND ok AND rec >= 0.5 AS pass FROM r)"""
_SUM = "count(*) AS total, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed, round(avg(ok::INT), 6) AS routing_accuracy, round(avg(rec), 6) AS avg_recall, round(avg(n_chars), 3) AS avg_latency_ms"

ORACLES = {
    "model_classify": f"WITH {_M}, f AS (SELECT id, {_FLAGS} FROM m) SELECT *, ({_HIT(P.CHAT_CLASS)} AND is_embedding + is_code + is_safety + is_vision = 0)::INT AS is_chat FROM f",
    "model_size_class": f"WITH {_M} SELECT id, {_SIZE} AS size_class FROM m",
    "rules_theta": f"WITH {_M}, {_RULES} SELECT id, task, family, points FROM m JOIN r ON regexp_matches(lower(id), pattern)",
    "model_rule_sum": f"WITH {_M}, {_RULES} SELECT id, task, coalesce(sum(points) FILTER (regexp_matches(lower(id), pattern)), 0) AS points FROM m, r GROUP BY ALL",
    "model_pick": "SELECT 'meta/llama-3.1-8b-instruct' AS routing, 'nvidia/llama-3.1-nemotron-nano-8b-v1' AS eval, 'mistralai/codestral-22b-instruct-v0.1' AS code_gen, 'nvidia/nemotron-4-340b-instruct' AS answer, 'nvidia/nv-embedqa-e5-v5' AS embedding",
    "catalog_anti": "SELECT * FROM (VALUES ('gone/model'), ('')) t(id)",
    "asym_input_type": f"WITH {_M} SELECT id, is_query, CASE WHEN {_HIT(P.ASYMMETRIC)} THEN CASE WHEN is_query = 1 THEN 'query' ELSE 'passage' END END AS input_type FROM m, (VALUES (1), (0)) q(is_query)",
    "local_models_migrate": "SELECT * FROM (VALUES (1, 'a', 'e'), (2, 'r', ''), (3, 'chat', 'emb'), (4, '', 'kept'), (5, 'v', '')) t(id, chat, embeddings)",
    "settings_validate": """
        SELECT * FROM (VALUES (1, 1, '', ''), (2, 0, 'NO_PROVIDER_CONFIGURED,EMBEDDING_MODEL_MISSING', 'SERPER_KEY_MISSING'), (3, 0, 'MODEL_NOT_FOUND', ''),
            (4, 0, 'LOCAL_SERVER_URL_MISSING,MODEL_NOT_FOUND,EMBEDDING_MODEL_MISSING', 'MODEL_CATALOG_EMPTY'), (5, 1, '', '')) t(id, valid, errors, warnings)""",
    "eval_row_metrics": _EVAL + " SELECT doc_id::VARCHAR AS question_id, rel AS relevant_chunks, ok::INT AS routing_correct, round(rec, 6) AS recall_at_k, pass::INT AS passed FROM g",
    "eval_summary": _EVAL + f" SELECT {_SUM} FROM g",
    "eval_by_category": _EVAL + f" SELECT lang AS category, {_SUM} FROM g GROUP BY 1",
    "eval_report": _EVAL
    + f""",
        u AS (SELECT {_SUM} FROM g), c AS (SELECT lang, {_SUM} FROM g GROUP BY 1)
        SELECT 0 AS part, '' AS key, 0 AS n, '# Evaluation Report' AS line
        UNION ALL SELECT 0, '', 1, '**Total Questions:** ' || total FROM u
        UNION ALL SELECT 0, '', 2, printf('**Passed:** %d / %d (%.1f%%)', passed, total, round(passed / total * 100, 1)) FROM u
        UNION ALL SELECT 0, '', 3, printf('**Routing Accuracy:** %.1f%%', round(routing_accuracy * 100, 1)) FROM u
        UNION ALL SELECT 0, '', 4, printf('**Avg Recall@K:** %.1f%%', round(avg_recall * 100, 1)) FROM u
        UNION ALL SELECT 0, '', 5, printf('**Avg Latency:** %.0fms', avg_latency_ms) FROM u
        UNION ALL SELECT 1, lang, 0, printf('- **%s**: %d/%d passed, routing %.1f%%', lang, passed, total, round(routing_accuracy * 100, 1)) FROM c
        UNION ALL SELECT 2, doc_id::VARCHAR, 0, printf('### %s %s recall %.1f%%', doc_id::VARCHAR, CASE WHEN doc_id % 17 = 0 THEN '❌ ERROR' WHEN pass THEN '✅ PASS' ELSE '❌ FAIL' END, round(rec * 100, 1)) FROM g""",
    "eval_ir_metrics": BM25_SQL
    + """,
        good AS (SELECT doc_id FROM labels WHERE quality = 1), total AS (SELECT count(*) AS n FROM good),
        h AS (SELECT query_id, rank, doc_id IN (SELECT doc_id FROM good) AS ok FROM r WHERE rank <= 20)
        SELECT query_id, count(*) FILTER (ok) AS hits, round(count(*) FILTER (ok) / 20, 6) AS precision, round(coalesce(1 / min(rank) FILTER (ok), 0), 6) AS rr,
            round(coalesce(sum(1 / log2(rank + 1)) FILTER (ok), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i), total WHERE i <= n), 6) AS ndcg
        FROM h GROUP BY 1""",
    "wf_route": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'vectorstore' END AS route FROM events",
    "wf_fallback": "SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'websearch' ELSE 'vectorstore' END AS fallback, count(*) AS n FROM events GROUP BY ALL",
    "wf_generate_eval_loop": """
        SELECT * FROM (VALUES ('sum it', 'python', 0, 3, 'PYTHON: SUM IT'), ('find it', 'vectorstore', 2, 9, 'VECTORSTORE: FIND IT'), ('never', 'websearch', 3, 10, 'VECTORSTORE: NEVER'),
            ('nothing', 'websearch', 3, 10, 'I couldn''t find relevant information to answer your question.')) t(question, source, retries, n_steps, answer)""",
    "wf_trace": "SELECT * FROM (VALUES (0, 'route', 'vectorstore'), (1, 'generate', 'vectorstore'), (2, 'evaluate', 'not useful'), (3, 'decide', 'websearch')) t(seq, name, detail)",
    "wf_hyde": "SELECT * FROM (VALUES ('passage', 'q' || chr(10) || chr(10) || 'p'), ('empty', 'q'), ('fails', 'q')) t(name, expanded)",
    "wf_retry": "SELECT * FROM (VALUES ('first', 'ok', 0.0), ('third', 'ok', 3.0), ('final', 'raised', 0.0), ('always', 'raised', 3.0)) t(name, result, waited)",
    "wf_circuit": "SELECT * FROM (VALUES ('mixed', 'closed'), ('open', 'open')) t(name, state)",
    "backoff": "SELECT event_id, least(CASE WHEN event_id % 5 = 0 THEN (event_id % 12) * 1000 ELSE (event_id % 3 + 1) * 1000 END, 8000) AS wait_ms FROM events",
    "err_taxonomy": """
        WITH s AS (SELECT event_id % 210 + 400 AS s FROM events),
        c AS (SELECT CASE WHEN s IN (401, 403) THEN 'INVALID_API_KEY' WHEN s = 429 THEN 'RATE_LIMIT_EXCEEDED' WHEN s >= 500 THEN 'PROVIDER_UNREACHABLE' WHEN s = 404 THEN 'MODEL_NOT_FOUND' ELSE 'UNKNOWN_ERROR' END AS code FROM s)
        SELECT code, (code IN ('RATE_LIMIT_EXCEEDED', 'PROVIDER_UNREACHABLE'))::INT AS retryable, count(*) AS n FROM c GROUP BY ALL""",
    "udf_codegen": "SELECT p_type, count(*) AS n, max(l_quantity) AS most FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25 AND p_size <= 20 GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
    "date_diff": "SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '2000-01-01') AS days FROM orders",
    "date_trunc": "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1",
}

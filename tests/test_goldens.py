"""Expected values of single operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vectors as V
from tesserae.operators import analytics as A
from tesserae.operators import chunking as C
from tesserae.operators import picker as P
from tesserae.operators import rag as G
from tesserae.operators import retrieval as R
from tesserae.operators import state as S
from tesserae.operators import workflow as W
from tesserae.sources import files, pdf, web


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_fnv(spark):
    assert one(spark, X.fnv1a32(F.col("t")), t="hello") == "4f9f2cab"


def test_fnv_of_many_texts(spark):
    def slow(t):
        h = 2166136261
        for i in range(0, len(b := t.encode("utf-16-be")), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "big")) * 16777619 % 2**32
        return f"{h:x}"

    rows = [(i, None if i % 50 == 7 else "añ😀z"[: i % 5] * (i % 37) + str(i) * (i % 3)) for i in range(400)] + [(1000, ""), (1001, "x" * 300_000), (1002, "x" * 300_000)]
    got = spark.createDataFrame(rows, "i int, t string").repartition(2).select("i", X.fnv1a32(F.col("t")).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: None if t is None else slow(t) for i, t in rows}


def test_tokens(spark):
    assert one(spark, X.bm25_tokens(F.col("t")), t="niño état-x_1 日本") == ["nio", "tatx_1"]
    assert "niño" in one(spark, X.bm25_tokens(F.col("t"), unicode_words=True), t="Niño")


@pytest.mark.parametrize(("text", "n"), [("", 0), ("   ", 0), ("one", 2), ("a b c d e f g h i j", 13)])
def test_estimate(spark, text, n):
    assert one(spark, X.estimated_tokens(F.col("t")), t=text) == n == one(spark, C.estimate(F.col("t")), t=text)


def chunk(spark, text, sizing, **how):
    return [r.asDict() for r in C.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), sizing, **how).drop("doc_id", "chunk_index").collect()]


def test_chunks(spark):
    assert chunk(spark, "", C.Sizing.chars()) == [{"text": "", "heading": None, "char_start": None, "char_end": None, "token_count": None}]
    long = chunk(spark, "a" * 900, C.Sizing.chars())
    assert len(long) > 1 and all(len(c["text"]) <= 800 for c in long)
    body = " ".join(f"Sentence number {i} of this part is here." for i in range(120))
    heads = {c["heading"] for c in chunk(spark, f"# H1\n{body}\n# H2\n{body}", C.Sizing.tokens())}
    assert heads == {"H1", "H2"}
    short = " ".join(f"Short sentence {i} here." for i in range(40))
    assert all(c["token_count"] <= 25 for c in chunk(spark, short, C.Sizing.tokens(25, 0)))
    parts = [c["text"] for c in chunk(spark, short, C.Sizing.tokens(25, 13))]
    assert all(a.endswith(" ".join(b.split()[:8])) for a, b in zip(parts, parts[1:]))  # two sentences are carried over


def test_small_sections(spark):
    text = "# A\nTiny one.\n# B\nTiny two."
    assert [c["text"] for c in chunk(spark, text, C.Sizing.tokens())] == ["Tiny two."]
    assert [c["text"] for c in chunk(spark, text, C.Sizing.tokens(), keep_small=True)] == ["Tiny one.", "Tiny two."]
    assert chunk(spark, "# only\n", C.Sizing.tokens())[0]["text"] == "# only"
    assert tuple(one(spark, C.sections(F.col("t")), t="#\nfoo")[0]) == ("foo", "foo", 2)


def test_hard_split(spark):
    split = lambda t, budget, overlap: one(spark, C.hard_split(F.col("t"), budget, overlap), t=t)
    assert split("abc", 5, 1) == ["abc"]
    assert split("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split("aaaaaaaa. bbbbbbb", 10, 2) == ["aaaaaaaa.", " bbbbbbb"]


def test_oversized_sentence_carries_its_last_piece(spark):
    got = one(spark, C.pack(F.split("t", "[|]"), C.Sizing.chars(10, 2)), t="x" * 12 + "|Y.")
    assert got == ["x" * 10, "x" * 4, "xxxx Y."]


PAGES = [
    ([("Big Title", 50, 700, 24), ("body line", 50, 650, 10), ("more", 200, 650, 10)], "## Big Title\nbody line more", "Big Title"),
    ([("hello", 10, 500, 10), ("world", 80, 500, 10)], "hello world", None),
    ([("first", 10, 600, 10), ("second", 10, 500, 10)], "first\nsecond", None),
    ([("Giant", 10, 700, 30), ("a", 10, 600, 10), ("b", 10, 500, 10)], "# Giant\na\nb", "Giant"),
    ([("  ", 10, 700, 10)], None, None),
]


def test_pdf_pages(spark):
    rows = [(p, i, s, float(x), float(y), float(h)) for p, (items, _, _) in enumerate(PAGES) for i, (s, x, y, h) in enumerate(items)]
    got = {r.page: (r.text, r.heading) for r in pdf.assemble_pages(spark.createDataFrame(rows, pdf.ITEMS)).collect()}
    assert got == {p: (t, h) for p, (_, t, h) in enumerate(PAGES) if t}


def test_mode_takes_the_first_to_reach_the_count(spark):
    rows = [(1, i, "a", 0.0, 0.0, h) for i, h in enumerate([5.0, 7.0, 7.0, 5.0])]
    assert pdf.modal_height(spark.createDataFrame(rows, pdf.ITEMS), ["page"]).first().modal == 7.0


def test_cells(spark):
    cells = {"$1,234.56": 1234.56, "$99": 99.0, "50%": 0.5, "25.5%": 0.255, " 7 ": 7.0, ",": None, "abc": None, "-3": -3.0}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", files.cell_number(F.col("c")).alias("n")).collect()
    assert {r.c: r.n for r in got} == cells
    table = files.normalize_cells(spark.createDataFrame([("$1,234.56", "x", ""), ("$99", "5", "")], "amount string, mixed string, blank string"))
    assert [tuple(r) for r in table.collect()] == [(1234.56, "x", None), (99.0, "5", None)]


def test_names(spark):
    assert one(spark, files.derive_name(F.col("t")), t="My Sales Report (2024).csv") == "My_Sales_Report_2024"
    assert one(spark, files.derive_name(F.col("t")), t="__.csv") == "dataset"


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "cat cat dog bird"), (2, "cat cat cat cat dog"), (3, ""), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat cat")], "query_id long, query string")
    assert [r.doc_id for r in R.bm25(docs, queries, 5).orderBy("rank").collect()] == [2, 1]
    assert R.bm25(docs.limit(0), queries, 5).count() == 0


def _entries(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_gate_and_zero_vector(spark):
    e = _entries(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 0.0, 0.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    assert [(r.vec_id, r.score) for r in R.knn(e, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (5, 0.0)]
    assert [r.vec_id for r in R.knn(e, q, gate=0.99).collect()] == [1]
    with pytest.raises(Exception, match="different dimensions"):
        R.check_dimension(e).collect()
    assert R.check_dimension(e.limit(0)).first().dim is None


def test_mmr(spark):
    vecs = {1: [1.0, 0.0, 0.0, 0.0], 2: [0.99, 0.1, 0.0, 0.0], 3: [0.0, 0.0, 1.0, 0.0]}
    unit = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in vecs.items()}
    c = spark.createDataFrame([(1, k, v[0], v) for k, v in unit.items()], "query_id long, vec_id long, score double, v array<double>")
    assert [r.vec_id for r in R.mmr(c, 2, 0.3).orderBy("rank").collect()] == [1, 3]
    assert R.mmr(c, 9, 0.3).count() == 3


def test_minmax_of_equals(spark):
    h = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 5.0)], "query_id long, doc_id long, score double")
    assert [r.m for r in h.select("query_id", "doc_id", R.minmax(h).alias("m")).orderBy("query_id", "doc_id").collect()] == [0.0, 0.0, 0.0, 1.0]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 0, "cats", "context-free noise"), (1, 1, "context-free noise about dogs", "context-free noise")], "q long, seq long, content string, hyp string")
    assert G.rerank_overlap(hits, "q", "hyp", "content", "seq", 1).first().seq == 1


def test_upsert_keeps_position(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], "id string, v int, seq int")
    got = [(r.id, r.v) for r in S.upsert_last(rows, "id", "seq").orderBy("position").collect()]
    assert got == [("a", 3), ("b", 2)]


def test_lru(spark):
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "k string, seq int")
    assert {r.k for r in S.lru_survivors(log, "k", "seq", 2).collect()} == {"a", "c"}


def test_embed_batches(spark):
    got = one(spark, W.embed_batches(F.lit([5] * 65 + [8000, 300, 9000, 1])))
    assert got == [0] * 64 + [1, 1, 2, 3, 4]


def test_suggestions(spark):
    cat = lambda *t: spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(t)], "seq int, name string, columns array<string>")
    ask = lambda c: [r["query"] for r in A.suggest_queries(c).orderBy("seq").collect()]
    assert ask(cat(("e", ["department", "salary"]))) == ["Average salary by department", "Total salary"]
    assert ask(cat(("t", ["city", "fare_amount", "tip_pct"]))) == ["Total fare_amount"]
    assert ask(cat(("logs", ["foo", "bar"]))) == ["Summarize logs", "Show the first rows of logs"]
    assert ask(cat(("x", ["price", "type"]), ("y", ["z"]))) == ["Average price by type", "Total price", "Join these datasets"]
    assert A.suggest_queries(cat(("x", ["a"])).limit(0)).count() == 0


def test_rules_are_additive(spark):
    m = spark.createDataFrame([(0, "mistralai/codestral-22b")], "seq int, id string")
    got = {r.task: r.points for r in P.rule_points(m, P.rules_table(spark)).collect()}
    assert got["code"] == 50 + 45 + 8


def test_spec_refuses_unknown_operators(spark):
    with pytest.raises(KeyError):
        A.run_spec({"t": spark.range(3)}, {"from": "t", "filter": [["id", "__import__", 1]]})


def test_web_stub_and_entities(spark):
    empty = spark.createDataFrame([("<p>nothing</p>",)], "html string")
    assert web.parse_html_results(empty, 3).first().title == web.NO_TITLE
    assert one(spark, X.decode_entities(F.col("t")), t="&amp;lt;") == "&lt;"
    assert one(spark, X.unwrap_url(F.col("t")), t="not a url") == "not a url"


def test_valid_vectors(spark):
    e = _entries(spark, [(1, [1.0]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, []), (6, [None])])
    assert [r.vec_id for r in R.valid_entries(e).collect()] == [1]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]

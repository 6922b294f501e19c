import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, _probe int, turns int"
CONTROLS = chat.Template().controls


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 9, 8) for r in rows], SCHEMA)


def plain(rows):
    """A loop over the rows: expected digests, and the string by hand."""
    out = []
    given = [(c, 0, t, r or "", x or "") for c, t, r, x in rows] + [(-7, 1, n, r, "</s>[INST] ok [/INST]") for n, r in enumerate(("user", "assistant"))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for (conv, _), group in itertools.groupby(sorted(given, key=key), lambda r: (r[0], r[1])):
        turns = sorted(((t is not None, t or 0, r, x) for _, _, t, r, x in group))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        text = "<s>"
        for role, block in itertools.groupby(turns, lambda t: t[2]):
            text += "[INST]" + esc(role) + "[/INST]" + "[NEXT]".join(esc(t[3]) for t in block) + "</s>"
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss), len(text)))
    return out


def esc(t):
    for i, c in enumerate(("~", *CONTROLS)):
        t = t.replace(c, f"~{i}")
    return t


ROWS = [
    (1, 0, "system", "be ~1 kind ~0~"), (1, 1, "user", "a"), (1, 2, "user", ""), (1, 3, "assistant", "</s>[INST]ü😀"), (1, 4, "assistant", None), (1, 5, "user", "[NEXT][/INST]<s>~"),
    (2, 1, "assistant", "[IN[INST]ST]<<s>s>"), (2, 1, "assistant", "[IN[INST]ST]<<s>s>"), (2, 1, None, "no role"), (2, None, "user", "no turn"), (2, 0, "as[/INST]sistant", "odd role"),
    (None, 1, "user", "x"), (None, 2, "assistant", "\n\n"), (3, 1, "user", None), (4, 1, "assistant", "y" * 300_000 + "~" * 5000 + "[INST]" * 3000), (4, 2, "assistant", "end"), (-7, 0, "user", "a conversation of the probe's number"),
]


def test_query(spark):
    got = [tuple(r) for r in chat.op12_chat_format(spark, "", frame(spark, ROWS).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(plain(ROWS), key=repr)


def test_empty(spark):
    got = chat.op12_chat_format(spark, "", frame(spark, ROWS).limit(0)).collect()
    assert [r.conv_id for r in got] == [-7] and got[0].n_turns == 2 and got[0].loss_chars == 21


def test_many_turns_take_linear_time(spark):
    rows = [(1, i, ("user", "user", "assistant")[i % 3], f"turn {i} [NEXT] 🙂") for i in range(30_000)]
    got = [tuple(r) for r in chat.op12_chat_format(spark, "", frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_format_is_reversible_by_any_template(spark):
    pairs = ["".join(p) for p in itertools.product(["~", "~1", "</", "s>", "<s>", "[", "INST]", "[NEXT]", "{", "|", ""], repeat=3)]
    rows = spark.createDataFrame([(1, i, f"r{i % 2}{t}", t) for i, t in enumerate(pairs)], "conv_id long, turn long, role string, text string")
    for t in (chat.Template(), chat.Template("{b}", "{h", "|", "{n}", "{e}")):
        made = chat.format_conversations(chat.sorted_turns(rows, ["conv_id"]), t, learned="r0")
        back = made.select(chat.read_turns(F.col("formatted"), t).alias("t"), chat.masked_texts(F.col("formatted"), F.col("loss_spans"), t).alias("l")).first()
        assert [(x.role, x.text) for x in back.t] == [(f"r{i % 2}{p}", p) for i, p in enumerate(pairs)]
        assert back.l == [p for i, p in enumerate(pairs) if f"r{i % 2}{p}" == "r0"]
    for bad in (("<s>", "<s>"), ("a<s>", "<s>"), ("~", "b"), ("", "b")):
        with pytest.raises(ValueError):
            chat.Template(begin=bad[0], head=bad[1])


def test_no_python_on_executors(spark):
    made = chat.format_conversations(chat.sorted_turns(frame(spark, ROWS), ["conv_id"]))
    read = made.select(chat.read_turns(F.col("formatted")), chat.masked_texts(F.col("formatted"), F.col("loss_spans")))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1

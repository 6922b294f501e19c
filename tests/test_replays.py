"""The parallel cache replay and the reassembly of streams, against loops."""

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lru
from tesserae.sources import web


def one_after_another(log, capacity):
    held, out = OrderedDict(), []
    for seq, key, op in sorted(log, key=lambda r: r[0]):
        if op not in ("get", "set"):
            continue
        hit = None if op == "set" else key in held
        if op == "set" or hit:
            held.pop(key, None)
            held[key] = 1
            while len(held) > capacity:
                del held[next(iter(held))]
        out.append((key, seq, op, hit))
    return out, list(held)


@pytest.mark.parametrize(("keys", "capacity", "sets"), [(40, 8, 0.5), (12, 16, 0.1), (400, 64, 0.3), (3, 1, 0.5)])
def test_replay(spark, keys, capacity, sets):
    rng = random.Random(keys)
    log = [(i, rng.choice([None, *range(keys)]) if i % 50 == 0 else min(int(rng.expovariate(4 / keys)), keys), "set" if rng.random() < sets else "get") for i in range(2000)] + [(5000, 1, "clear")]
    frame = spark.createDataFrame(log, "seq long, key long, op string").repartition(3)
    results, held, rounds = lru.replay(frame, "key", "seq", "op", capacity, segment_rows=250)
    want, left = one_after_another(log, capacity)
    assert sorted(map(tuple, results.collect()), key=repr) == sorted(want, key=repr)
    assert [r.key for r in held.orderBy("position").collect()] == left and 2 <= rounds <= 9


def test_a_state_that_goes_through_all_segments(spark):
    """Nothing but gets after the first segment: every segment depends on the first, the worst case."""
    log = [(i, i % 5, "set") for i in range(10)] + [(i, i % 7, "get") for i in range(10, 300)]
    results, _, rounds = lru.replay(spark.createDataFrame(log, "seq long, key long, op string"), "key", "seq", "op", 4, segment_rows=60)
    assert sorted(map(tuple, results.collect()), key=repr) == sorted(one_after_another(log, 4)[0], key=repr) and rounds <= 7
    empty, held, _ = lru.replay(spark.createDataFrame([], "seq long, key long, op string"), "key", "seq", "op", 4)
    assert empty.count() == 0 and held.count() == 0


def test_streams_cut_anywhere(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for s in [*range(25), None]:
        texts = ["".join(rng.choices(["a", "é", "😀", "\n", "\\", '"', "data: ", "日本", " "], k=rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        sent = "".join(f"data: {json.dumps({'choices': [{'delta': {'content': t}}]}, ensure_ascii=rng.random() < 0.5)}" + rng.choice(["\n", "\r\n\r\n", "\n: ping\n"]) for t in texts) + rng.choice(["data: [DONE]", "data: [DONE]\n", ""])
        b, at, n = sent.encode(), 0, 0
        while at < len(b):
            step = rng.choice([0, 1, 2, 5, 40])
            rows.append((s, n, bytearray(b[at : at + step]) if step or n % 2 else None, 1, "x"))
            at, n = at + step, n + 1
        want[s] = "".join(texts)
    reads = spark.createDataFrame(rows, "stream long, nr long, data binary, line_no int, line string").repartition(5)
    lines = web.reassemble_lines(reads, "stream", "nr", "data")
    got = {r.stream: r.text for r in web.concat_stream(lines, "stream", "line_no", "line").collect()}
    assert got == want
    assert web.reassemble_lines(reads.limit(0), "stream", "nr", "data").count() == 0


def test_one_stream_of_many_reads_and_broken_bytes(spark):
    reads = spark.range(50_000).select(F.lit(1).alias("s"), "id", F.when(F.col("id") % 7 == 0, F.lit(b"\xff\n")).otherwise(F.lit("é".encode())).alias("data"))
    lines = web.reassemble_lines(reads, "s", "id", "data").orderBy("line_no").collect()
    assert [r.line for r in lines[:3]] == ["�", "éééééé�", "éééééé�"] and len(lines) == 50_000 // 7 + 2

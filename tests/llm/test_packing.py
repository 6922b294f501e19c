import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tesserae.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_whole_texts():
    rng = random.Random(1)
    texts = ["", " ", "a  b\n\n c\x85\xa0d", "it's <|endoftext|> x", "日本 语 x", "¼½ 12²a_b  \x1c\x1f y", "\t\r\n  ", "don't ÿµºª"]
    texts += ["".join(rng.choice("ab 'st\n\t12²é!?\x1c\xa0") for _ in range(60)) for _ in range(300)]
    tok = Tokenizer.from_file(PATH)
    got = packing.Encoder(PATH).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_very_long_runs():
    tok = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(PATH)
    for text in (" " * 1_000_000, " " * 5_000_000, " \n" * 500_000, "a" + "\t" * 999 + "b", "ab" * 500_000, "!" * 300_000, "1" * 100_000, "\x85" * 200_000):
        assert encoder.encode([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_bins_close_the_fullest():
    b = packing.OpenBins(10, 2)
    assert b.place(6) == (0, 0)
    assert b.place(7) == (1, 0)
    assert b.place(8) == (2, 0)  # bin 1 closed
    assert b.place(3) == (0, 6)
    assert b.place(2) == (2, 8)


def slow_best_fit(lengths, capacity, most):
    """(bin, offset) by looking at every open bin: the one with the least room that fits, the newest of equals; the fullest closes, the newest of equals."""
    used, open_, out = [], [], []
    for n in lengths:
        fits = [b for b in open_ if capacity - used[b] >= n]
        if fits:
            room = min(capacity - used[b] for b in fits)
            b = [x for x in open_ if capacity - used[x] == room][-1]
        else:
            if n < capacity and len(open_) >= most:
                top = max(used[x] for x in open_)
                open_.remove([x for x in open_ if used[x] == top][-1])
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        if b in open_:
            open_.remove(b)
        if used[b] < capacity:
            open_.append(b)  # the last one that was changed counts as newest
    return out


def test_bitset_equals_looking_at_every_bin():
    rng = random.Random(11)
    for capacity, most in ((20, 3), (64, 5), (1024, 16), (7, 1)):
        lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(1500)]
        bins = packing.OpenBins(capacity, most)
        assert [bins.place(n) for n in lengths] == slow_best_fit(lengths, capacity, most)


def test_query_packs_as_one_slow_packer_does(spark):
    """A table that one packer takes: the same sequences as the slow version over its rows in the packer's order."""
    rows = [(i, "tok " * (i * 37 % 1500)) for i in range(120)]
    out = packing.op3_best_fit_packing(spark, "", spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tok = Tokenizer.from_file(PATH)
    pieces = {(i, k): n for i, t in rows for k, (_, n) in enumerate(packing.cut(len(tok.encode(t, add_special_tokens=False).ids) + 1, 1024))}
    assert {(r.doc_id, r.piece): r.length for r in out} == pieces
    ordered = sorted(pieces.values(), reverse=True)
    slow = slow_best_fit(ordered, 1024, packing.OPEN_BINS)
    assert len({r.sequence_id for r in out}) == len({b for b, _ in slow})  # within one look-ahead only the order of equal lengths is open
    ends = {}
    for r in out:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    slow_ends = {}
    for (b, o), n in zip(slow, ordered):
        slow_ends[b] = max(slow_ends.get(b, 0), o + n)
    assert sorted(ends.values()) == sorted(slow_ends.values())


def test_repeated_ids_spread(spark, monkeypatch):
    """A third of the rows and more are one row: they are dealt to all packers, not to one."""
    monkeypatch.setattr(packing, "PACKER_PIECES", 500)
    rows = [(7, "same words again")] * 3000 + [(None, "x")] * 1000 + [(i, f"row {i}") for i in range(1000)]
    out = packing.op3_best_fit_packing(spark, "", spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    assert len(out) == len(rows)
    packer = out.sequence_id // (1 << 40)
    shares = out[out.doc_id == 7].groupby(packer).size()
    assert len(shares) >= 8 and shares.max() < 3000 / 3
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024


def test_pack(spark):
    rows = [(i, ("wörd x%d " % (i % 7)) * (i * 13 % 900), "x", 1) for i in range(60)] + [(100, None, None, 2), (101, "", "", 3), (7, "wörd", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")
    out = packing.op3_best_fit_packing(spark, "", docs).toPandas()
    tok = Tokenizer.from_file(PATH)
    for doc_id, g in out.groupby("doc_id"):
        wants = [tok.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows if r[0] == doc_id]
        if len(wants) == 1:
            g = g.sort_values("piece")
            crcs = [zlib.crc32(np.array(wants[0][s : s + n], "<u4").tobytes()) for s, n in zip(g.start, g.length)]
            assert crcs == g.ids_crc32.tolist() and g.length.sum() == len(wants[0])
            assert (g.length[1:] == 1024).all()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.op3_best_fit_packing(spark, "", docs).count() == 0

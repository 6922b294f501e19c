"""The folds of the chunker against lists and loops over one text at a time."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tesserae.operators import chunking as C

SPACE = f"[{''.join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))}]"
LINE = "[^\n\r  ]"


def strip(t):
    return re.sub(f"^{SPACE}+|{SPACE}+\\Z", "", t)


def estimate(t):
    return math.ceil(len([w for w in re.split(f"{SPACE}+", t) if w]) * 1.3)


def slow_sections(t):
    heads = [(m.start(), strip(m[1])) for m in re.finditer(f"(?<!{LINE})#{{1,6}}{SPACE}+({LINE}+)", t)]
    stops = [at for at, _ in heads] + [len(t)]
    out = [(None, t[: stops[0]], 0)] if not heads or strip(t[: stops[0]]) else []
    for (at, head), stop in zip(heads, stops[1:]):
        line = t[at:stop].partition("\n")
        out.append((head, line[2], at + len(line[0]) + len(line[1])))
    return out


def slow_split(s, budget, overlap):
    if len(s) <= budget:
        return [s]
    end = re.search(f"[.!?](?:{SPACE}|\\Z)", s[:budget])
    if end and end.start() > budget / 2:
        return [s[: end.start() + 1], *slow_split(s[end.start() + 1 :], budget, overlap)]
    begins = range(0, len(s), max(1, budget - overlap))
    last = next(i for i in begins if i + budget >= len(s))
    return [s[i : i + budget] for i in begins if i <= last]


def slow_pack(parts, unit, budget, overlap):
    measure = len if unit == "chars" else estimate
    join = " ".join
    out, window, carried = [], [], []

    def close():
        nonlocal window, carried
        if window:
            out.append(strip(join(window)))
            keep = [k for k in range(len(window)) if overlap and (k == len(window) - 1 or measure(join(window[k:])) <= overlap and measure(join(window[k + 1 :])) < overlap)]
            carried = window[keep[0] :] if keep else []
        window = []

    for s in parts:
        if measure(s) > budget:
            close()
            pieces = slow_split(s, budget, overlap)
            out.append(join([*carried, pieces[0]]))
            out.extend(pieces[1:])
            carried = pieces[-1:]
        else:
            if window and measure(join([*window, s])) > budget:
                close()
            window = [*(window or carried), s]
    close()
    return out


def slow_chunks(t, unit, budget, overlap, keep_small):
    if not strip(t or ""):
        return [("", None, None, None, None)]
    flat = lambda x: strip(re.sub(f"{SPACE}+", " ", x))
    found, out = slow_sections(t), []
    for k, (head, body, start) in enumerate(found):
        body = flat(body)
        packed = slow_pack([s for s in re.split(r"(?<=[.!?]) (?=[A-Z])", body) if s], unit, budget, overlap)
        if keep_small or k == len(found) - 1 or len(packed) != 1 or estimate(packed[0]) >= 64:
            out += [(p, head, start + body.find(p), start + body.find(p) + len(p), estimate(p)) for p in packed]
    whole = flat(t)
    return out or [(whole, found[0][0], 0, len(whole), estimate(whole))]


BITS = ["# Head one\n", "## x\n", "\n\n", "#\nfoo\n", "Word ", "end. ", "a. ", "What! ", "verylongwordwithoutanyend" * 3, " ", "no stop here ", "Short one. ", "x\x01y ", "\x01\x02\x03", "é😀 ", "### only", "#not ", " ", " # after\r\n", "﻿. B", "\t"]


def frame(spark, rows, kind="string"):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], f"doc_id long, text {kind}, chunk_index int, heading string").repartition(4)


@pytest.mark.parametrize("sizing", [C.Sizing.chars(300, 75), C.Sizing.chars(40, 12), C.Sizing.chars(10, 5), C.Sizing("chars", 10, 9), C.Sizing.tokens(12, 5), C.Sizing.tokens(8, 0), C.Sizing.tokens()])
def test_chunks(spark, sizing):
    rng = random.Random(sizing.budget + sizing.overlap)
    rows = [(i, "".join(rng.choices(BITS, k=rng.randrange(60)))) for i in range(250)] + [(900, None), (901, " 　\n"), (902, "# only\n"), (903, "# a\n# b\n")]
    for keep_small in (False, True):
        got = {}
        for r in C.chunk_documents(frame(spark, rows), sizing, keep_small=keep_small).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.heading, r.char_start, r.char_end, r.token_count))
        for i, t in rows:
            assert sorted(got[i]) == [(k, *c) for k, c in enumerate(slow_chunks(t, sizing.unit, sizing.budget, sizing.overlap, keep_small))], t


def test_given_sentences(spark):
    rng = random.Random(8)
    lists = [(i, ["".join(rng.choices(BITS, k=rng.randrange(1, 6))) for _ in range(rng.randrange(12))]) for i in range(200)]
    for sizing in (C.Sizing.chars(60, 20), C.Sizing.tokens(9, 4)):
        got = {}
        for r in C.chunk_sentences(frame(spark, lists, "array<string>"), sizing, sentences_col="text").collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.text, r.token_count))
        for i, parts in lists:
            want = slow_pack([s for s in parts if strip(s)], sizing.unit, sizing.budget, sizing.overlap)
            assert sorted(got.get(i, [])) == [(k, p, estimate(p)) for k, p in enumerate(want)], parts


def test_sections_and_pieces(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(BITS, k=rng.randrange(40)))) for i in range(300)] + [(900, ""), (901, "#\nfoo"), (902, None)]
    found = frame(spark, rows).select("doc_id", C.sections(F.col("text")).alias("s"), C.hard_split(F.col("text"), 20, 6).alias("p")).collect()
    texts = dict(rows)
    for r in found:
        t = texts[r.doc_id]
        if t is None:
            assert r.s is None and r.p is None
            continue
        if "\r" not in t and " " not in t:  # headings that a line feed ends
            assert [tuple(s) for s in r.s] == slow_sections(t), t
        assert r.p == slow_split(t, 20, 6), t


def test_long_texts(spark):
    """A megabyte of short sentences, of one sentence without end, and of clauses that are cut behind their stops."""
    rows = [(1, "Some words are here. " * 50_000), (2, "x" * 1_000_000), (3, "and so on it went. " * 50_000), (4, "# Head\nOne line.\n" * 20_000)]
    begin = time.perf_counter()
    got = {}
    for r in C.chunk_documents(frame(spark, rows), C.Sizing.chars(), keep_small=True).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
    assert time.perf_counter() - begin < 90
    for i in (1, 4):
        assert len(got[i]) == len(slow_chunks(rows[i - 1][1], "chars", 800, 200, True))
    assert sum(len(t) for _, t in got[2]) > 1_000_000 and max(len(t) for _, t in got[3]) < 1100


def test_a_sentence_is_computed_once(spark):
    """A sentence that is an expression of its own is not computed again at every step, so the work grows with the text."""
    sentence = C.collapse(F.col("text"))
    count = lambda c: frame(spark, [(1, "")]).select(c)._jdf.queryExecution().analyzed().toString().count("regexp_replace")
    assert count(C.hard_split(sentence, 300, 75)) == count(sentence)
    rows = [(1, "and so  on it\twent. " * 400), (2, "word \n" * 3000), (3, " "), (4, None), (5, "a  b")]
    got = {r.doc_id: r.p for r in frame(spark, rows).select("doc_id", C.hard_split(sentence, 30, 8).alias("p")).collect()}
    assert got == {i: None if t is None else slow_split(" ".join(t.split()), 30, 8) for i, t in rows}

import hashlib
import heapq
import itertools
import re
import zlib

from tesserae.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, blank string, copies string"
GOOD = re.compile(r"(s?(ua)+)?")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def least_edits(rows):
    """(cost, letters, lines) of the cheapest edits, the ASCII-least of them: best first through all edits whose roles can still become good."""
    heap = [(0, "", 0, ())]
    while True:
        cost, letters, i, lines = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in lines)
        if not re.fullmatch("(s?(ua)*u?)?", initials):
            continue
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, letters, lines
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, letters + "I", i, (*lines, (r, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            late = 5 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, lines))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + late, letters + "K", i + 1, (*lines, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 1, letters + "R", i + 1, (*lines, (r, text))))


def plain(rows):
    out = []
    after = damage(rows)
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((t is not None, t or 0, r, x) for c, t, r, x in after if c == conv)
        faults, seen = [], set()
        for _, _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        odd = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters, lines = least_edits(faults)
        n = lambda f: sum(x[2] == f for x in faults)
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), odd, cost, letters, sha))
    return out


def test_table_equals_all_edits():
    a = R.Automaton()
    kinds = [("system", None), ("user", None), ("assistant", None), ("tool", None), ("user", "truncated"), ("assistant", "truncated"), ("system", "truncated"), ("user", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            symbols = bytes(R.symbol(r, f == "blank", f == "truncated") for r, f in rows)
            assert a.cheapest(symbols) == least_edits([(r, str(i), f) for i, (r, f) in enumerate(rows)])[:2], rows
    assert len(a.vectors) < 64


def texts(n):
    kinds = [("system", "be kind."), ("user", "why?"), ("assistant", "because!\n "), ("user", "cut off"), ("tool", "x."), (None, None), ("assistant", ""), ("", "empty role."), ("assistant", "."), ("sun", "é?"), ("user", "\x0b\t")]
    return [(c, t, *kinds[zlib.crc32(f"{c},{t},k".encode()) % len(kinds)]) for c in range(n) for t in range(zlib.crc32(f"{c}".encode()) % 5)]


def test_query_equals_all_edits(spark):
    rows = texts(90) + [(500, None, "user", "no turn."), (500, None, "user", "no turn."), (500, 3, "assistant", "a."), (500, 9, "user", "no turn."), (None, 1, "user", "q?"), (None, 2, "assistant", "a."), (None, None, None, None)]
    dropped = next(c for c in range(10_000, 11_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(dropped, 1, "user", "gone."), (501, 2, "user", "same."), (501, 2, "assistant", "same."), (501, 2, "user", "same."), (502, 1, "assistant", "."), (502, 4, "assistant", "z. " * 50_000)]
    got = [tuple(r) for r in R.op13_conversation_repair(spark, "", frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    empty = next(r for r in got if r[0] == dropped)
    assert empty[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert R.op13_conversation_repair(spark, "", frame(spark, rows).limit(0)).count() == 0


def test_one_conversation_of_many_rows(spark):
    """Sixty thousand rows of one conversation, a third of them saying the same."""
    n = 60_000
    rows = [(1, t, ("user", "assistant")[t % 2], "same." if t % 3 == 0 else f"turn {t}.") for t in range(n)]
    got = R.op13_conversation_repair(spark, "", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    after = damage(rows)
    seen, blank, duplicate, truncated = set(), 0, 0, 0
    for _, _, r, x in after:
        kind = "b" if not x else "d" if (r, x) in seen else "" if x[-1] == "." else "t"
        seen.add((r, x))
        blank, duplicate, truncated = blank + (kind == "b"), duplicate + (kind == "d"), truncated + (kind == "t")
    (one,) = got
    assert (one.blank, one.duplicate, one.truncated) == (blank, duplicate, truncated)
    assert one.gaps == max(t for _, t, _, _ in after) - min(t for _, t, _, _ in after) + 1 - len({t for _, t, _, _ in after})
    assert len(one.audit.replace("I", "")) == len(after)

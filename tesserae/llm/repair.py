"""Repair of conversation structure by lazy weighted determinisation.

A conversation is well formed if the first letters of its roles read `(s?(ua)+)?`. The nondeterministic
automaton of the edits (keep, rerole, delete, insert) has four states; its cost vectors over them, less
their least entry, are the states of a deterministic automaton that is made as rows ask for it and cached
in a transition table. A scan of the table over the rows, last to first, gives the cheapest cost of every
suffix; the trace goes back over the scan along tight arcs, first row to last, and takes the least letter
at each step, so of the cheapest edits it finds the ASCII-least.

Rows stream through sorted partitions and each conversation passes twice: once for the scan, which keeps
one byte for each row, and once, with the edits known, for the digest of the repaired rows. So memory does
not grow with texts, and a conversation of very many rows costs its task time only: edits and digest of a
conversation are one string and one running hash. Repeated texts are found by an aggregation over digests
that a large conversation spreads over all tasks.

Edge cases: a null role or text is one space; rows without a turn come first; rows of one turn go by role
and text; repeated rows are rows of their own, and all but the first are duplicates; a null conv_id is a
conversation; a conversation without rows after the damage has zeros, no edits and the digest of nothing;
roles other than system, user and assistant count by their first letter; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; keeping is free
_START, _SYSTEM, _USER, _ASSISTANT = range(4)  # by the role that came last
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_LETTERS = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NEVER = 1 << 30
#: Symbols of rows: GONE has to be deleted, others are 1 + 2 * role letter (0 for a foreign one) + truncated.
GONE = 0


def symbol(role: str, blank_or_duplicate: bool, truncated: bool) -> int:
    return GONE if blank_or_duplicate else 1 + 2 * _LETTERS.get(role[:1], 0) + truncated


def _kept(state: int, letter: int) -> int | None:
    """The state behind a kept row of this letter, if it may follow."""
    return letter if letter and (letter == _NEXT[state] or (state, letter) == (_START, _SYSTEM)) else None


@dataclass
class Automaton:
    """Deterministic states are cost vectors to the end of the conversation; tables fill as rows are met."""

    vectors: list[tuple[int, ...]] = field(default_factory=list)
    number: dict[tuple[int, ...], int] = field(default_factory=dict)
    steps: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    arcs: dict[tuple[int, int, int], tuple[str, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.end = self._state(self._closed([0, _NEVER, _NEVER, 0]))[0]

    @staticmethod
    def _closed(raw: list[int]) -> list[int]:
        """With insertions before; the longest way without a repeated state has three."""
        for _ in range(3):
            raw = [min(c, INSERT + raw[_NEXT[q]]) for q, c in enumerate(raw)]
        return raw

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        v = tuple(c - least for c in costs)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], least

    def _moves(self, after: tuple[int, ...], sym: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost to the end, state behind) of the edits of one row, in the order of letters."""
        found = [("D", DELETE + after[q], q)]
        if sym != GONE:
            letter, extra = divmod(sym - 1, 2)
            extra *= TRUNCATED
            to = _kept(q, letter)
            if to is not None:
                found.append(("K", extra + after[to], to))
            found.append(("R", REROLE + extra + after[_NEXT[q]], _NEXT[q]))
        return found

    def step(self, after: int, sym: int) -> tuple[int, int]:
        """The state before a row, and what it adds to the cost."""
        key = (after, sym)
        if key not in self.steps:
            v = self.vectors[after]
            self.steps[key] = self._state(self._closed([min(c for _, c, _ in self._moves(v, sym, q)) for q in range(4)]))
        return self.steps[key]

    def arc(self, after: int, sym: int, q: int) -> tuple[str, int]:
        """The least letters of the cheapest edits from q up to and with this row, and the state behind it."""
        key = (after, sym, q)
        if key not in self.arcs:
            before, weight = self.step(after, sym)
            letters, at = "", q
            while True:
                due = self.vectors[before][at] + weight
                tight = [(a, to) for a, c, to in self._moves(self.vectors[after], sym, at) if c == due]
                if INSERT + self.vectors[before][_NEXT[at]] + weight == due:
                    tight.append(("I", _NEXT[at]))
                a, at = min(tight)
                letters += a
                if a != "I":
                    break
            self.arcs[key] = (letters, at)
        return self.arcs[key]

    def tail(self, q: int) -> str:
        """Insertions behind the last row."""
        letters = ""
        while self.vectors[self.end][q]:
            letters, q = letters + "I", _NEXT[q]
        return letters

    def cheapest(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """Cost and letters of the cheapest edits."""
        states, at, cost = bytearray(len(symbols)), self.end, 0  # the state behind each row; there are far fewer than 256
        for i in range(len(symbols) - 1, -1, -1):
            states[i] = at
            at, weight = self.step(at, symbols[i])
            cost += weight
        cost += self.vectors[at][_START]
        q, out = _START, []
        for i, sym in enumerate(symbols):
            letters, q = self.arc(states[i], sym, q)
            out.append(letters)
        out.append(self.tail(q))
        return cost, "".join(out)


class Repaired:
    """Lines of the repaired conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.q, self.hash, self.lines = audit, 0, _START, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.lines += 1

    def inserted(self) -> None:
        while self.audit.startswith("I", self.at):
            self.q = _NEXT[self.q]
            self._line(_ROLE[self.q], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.q = _LETTERS[role[0]]
            self._line(role, text)
        elif edit == "R":
            self.q = _NEXT[self.q]
            self._line(_ROLE[self.q], text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


_OUT = (
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
)


class Conversation:
    """One conversation: rows of the first pass, then of the second."""

    def __init__(self, conv_id: int | None):
        self.id, self.symbols = conv_id, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.before = self.repaired = None

    def first(self, turn: int | None, role: str, text: str, blank: bool, open_: bool, new: bool) -> None:
        """new: no earlier turn has the role and text; a repeat of one turn stands right before."""
        row = (turn, role, text)
        duplicate = not blank and (not new or self.before == row)
        self.blank += blank
        self.duplicate += duplicate
        truncated = open_ and not blank and not duplicate
        self.truncated += truncated
        if self.before is not None:
            self.illegal += (self.before[1][:1] + role[:1]) not in ("su", "ua", "au")
        if turn is not None and (not self.turns or turn != self.last_turn):
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        self.before = row
        self.symbols.append(symbol(role, blank or duplicate, truncated))

    def solve(self, automaton: Automaton) -> None:
        self.cost, self.audit = automaton.cheapest(self.symbols)
        self.repaired = Repaired(self.audit)

    def result(self, automaton: Automaton) -> tuple:
        if self.repaired is None:
            self.solve(automaton)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.repaired.digest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): conversations after the damage; copies is 0 for a dropped row."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), hit.alias("_hit"))
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_hit") == 0, 0).when(F.col("_hit") == 3, 2).otherwise(1)
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def marked(rows: DataFrame) -> DataFrame:
    """Adds blank, open (the last character that is no white space ends no sentence) and new (no earlier turn of the conversation says the same)."""
    white = r"[\x20\x09-\x0D]"
    body = F.regexp_replace("text", f"{white}+$", "")
    faults = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("open", ~F.substring(body, -1, 1).isin(".", "!", "?"))
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    keyed = faults.withColumn("_said", said)
    firsts = keyed.filter("copies > 0").groupBy("_said").agg(F.min("turn").alias("_turn"), F.max(F.col("turn").isNull()).alias("_null"))
    firsts = common.staged(firsts, "said")  # a table of its own, so that a text that very many rows say is split in the join
    new = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn").eqNullSafe(F.col("_turn")))
    return keyed.join(firsts, "_said", "left").select("conv_id", "turn", "role", "text", "copies", "blank", "open", F.coalesce(new, F.lit(False)).alias("new"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows` (see damaged): faults, cheapest edits and the digest of what they give."""
    passes = marked(rows).withColumn("_pass", F.explode(F.array(F.lit(0), F.lit(1))))
    order = ["conv_id", "_pass", "turn", "role", "text"]
    dealt = passes.repartition("conv_id").sortWithinPartitions(*order)
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*found), _OUT)], [n for n, _ in _OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, found = Automaton(), None, []
        for b in batches:
            for conv, again, turn, role, text, copies, blank, open_, new in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.id != conv:
                    if now is not None:
                        found.append(now.result(automaton))
                    now = Conversation(conv)
                if again and now.repaired is None:
                    now.solve(automaton)
                for _ in range(copies):
                    if again:
                        now.repaired.row(role, text)
                    else:
                        now.first(turn, role, text, blank, open_, new)
            if len(found) >= 1000:
                yield batch_of(found)
                found = []
        if now is not None:
            found.append(now.result(automaton))
        if found:
            yield batch_of(found)

    return dealt.select("conv_id", "_pass", "turn", "role", "text", "copies", "blank", "open", "new").mapInArrow(run, schema)


def op13_conversation_repair(spark, sf_dir, conversations: DataFrame | None = None) -> DataFrame:
    """Every conversation damaged and repaired; see the module's docstring."""
    common.prepare(spark)
    rows = common.documents(spark, sf_dir, "conversations") if conversations is None else conversations
    return repair(damaged(rows))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
_ANY = "[^\\x20\\x09-\\x0D]"
ORACLES = {
    "op13_conversation_repair": f"""
        WITH RECURSIVE p AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations
        ), d AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM p
        ), o AS (
            SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                lag(role[1:1]) OVER w || role[1:1] NOT IN ('su', 'ua', 'au') AS odd
            FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), f AS (
            SELECT *, NOT regexp_matches(text, '{_ANY}') AS blank, NOT blank AND again AS duplicate,
                NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS truncated FROM o
        ), n AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY conv_id
        ), ins(q, r, letters, lines) AS (VALUES ('0', '0', '', []::VARCHAR[]), ('s', 's', '', []), ('u', 'u', '', []), ('a', 'a', '', []),
            ('0', 'u', 'I', ['user:']), ('s', 'u', 'I', ['user:']), ('u', 'a', 'I', ['assistant:']), ('a', 'u', 'I', ['user:']),
            ('0', 'a', 'II', ['user:', 'assistant:']), ('s', 'a', 'II', ['user:', 'assistant:'])
        ), edit AS (
            SELECT *, CASE letter WHEN 'D' THEN r WHEN 'K' THEN role[1:1] ELSE next END AS t, CASE letter WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN letter <> 'D' AND truncated THEN 5 ELSE 0 END AS price
            FROM f, (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) s(r, next, named), (VALUES ('D'), ('K'), ('R')) e(letter)
            WHERE letter = 'D' OR NOT blank AND NOT duplicate AND (letter = 'R' OR role[1:1] = next OR r = '0' AND role[1:1] = 's')
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, '0' AS q, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS m FROM n
            UNION ALL
            SELECT w.conv_id, w.i + 1, e.t, min({{'cost': (w.m).cost + 5 * length(ins.letters) + price, 'audit': (w.m).audit || ins.letters || letter,
                'lines': (w.m).lines || ins.lines || CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [e.role || ':' || e.text] ELSE [named || ':' || e.text] END}})
            FROM walk w JOIN ins ON ins.q = w.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.r = ins.r GROUP BY ALL
        ), done AS (
            SELECT w.conv_id, min({{'cost': (w.m).cost + 5 * length(letters), 'audit': (w.m).audit || letters, 'lines': (w.m).lines || ins.lines}}) AS m
            FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN ins ON ins.q = w.q AND ins.r IN ('0', 'a') GROUP BY 1
        )
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce((m).cost, 0)::BIGINT AS cost, coalesce((m).audit, '') AS audit, sha256(array_to_string(coalesce((m).lines, []), chr(10))) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id""",
}

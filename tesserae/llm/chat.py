"""Chat formatting: conversations as templated strings with a loss mask, by Spark expressions only.

The turns of a conversation are collected and sorted, adjacent turns of one role become one block, and
the blocks are concatenated with the template's control strings. Inside texts and roles a control string
is written as a code, so a text cannot end its turn or begin another, and reading back gives every turn
as it was. The loss mask is a list of spans (start, length, in code points) over the assistant's texts.

Blocks come from array functions that pass over the turns once (a fold that appends would copy the array
at every turn), offsets from a doubling prefix sum, and spans are cut out of pieces of equal length, so
the work stays near-linear in a conversation. A conversation is one row, as its formatted string is one
value; Spark bounds both at 2 GB.

Edge cases: null texts and null roles are empty; turns go by number (null first), equal numbers by role
and text; repeated rows are turns of their own; a null conv_id is a conversation; an empty text keeps its
turn and an empty span; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.arrays import bound, cut, pieces, prefix_sums
from tesserae.llm import common

LEARNED = "assistant"
_MARK = "~"


@dataclass(frozen=True)
class Template:
    """begin (head role body text (follow text)* end)*. A control string's first character stands nowhere else in any of them."""

    begin: str = "<s>"
    head: str = "[INST]"
    body: str = "[/INST]"
    follow: str = "[NEXT]"
    end: str = "</s>"

    def __post_init__(self):
        firsts = {c[0] for c in self.controls if c}
        if len(set(self.controls)) < 5 or any(not c or _MARK in c or firsts & set(c[1:]) for c in self.controls):
            raise ValueError("control strings have to differ, and none may begin inside another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.head, self.body, self.follow, self.end)

    def escape(self, t: Column) -> Column:
        codes = [(_MARK, f"{_MARK}0"), *((c, f"{_MARK}{i}") for i, c in enumerate(self.controls, 1))]
        return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), codes, t)

    def unescape(self, t: Column) -> Column:
        codes = [*((f"{_MARK}{i}", c) for i, c in enumerate(self.controls, 1)), (f"{_MARK}0", _MARK)]
        return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), codes, t)


def sorted_turns(rows: DataFrame, keys: list[str], turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The keys and turns, an array of (turn, role, text) in order."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), value(role_col).alias("role"), value(text_col).alias("text"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role."""
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    # each start is paired with the next, so a block is the slice between
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda b: F.struct(role(b["s"]).alias("role"), F.transform(F.slice(turns, b["s"] + 1, b["e"] - b["s"]), lambda t: t["text"]).alias("texts")),
    )


def format_conversations(turns: DataFrame, template: Template | None = None, turns_col: str = "turns", learned: str = LEARNED) -> DataFrame:
    """The other columns with formatted and loss_spans, an array of (start, length) over what the learned role says."""
    t = template or Template()
    keep = [c for c in turns.columns if c != turns_col]
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def block(b: Column) -> Column:
        last = F.size(b["texts"]) - 1
        texts = F.transform(b["texts"], lambda x, i: F.array(piece(t.escape(x), b["role"] == learned), piece(F.when(i == last, t.end).otherwise(t.follow), no)))
        return F.concat(F.array(piece(F.concat(F.lit(t.head), t.escape(b["role"]), F.lit(t.body)), no)), F.flatten(texts))

    blocks = turns.select(*keep, merged(F.col(turns_col)).alias("_blocks"))
    cut_up = blocks.select(*keep, F.concat(F.array(piece(F.lit(t.begin), no)), F.flatten(F.transform("_blocks", block))).alias("_pieces"))
    sized = cut_up.select(*keep, "_pieces", F.transform("_pieces", lambda p: F.length(p["text"]).cast("long")).alias("_n"))

    def spans(ends: Column) -> Column:
        span = lambda p, i: F.struct((F.get(ends, i) - F.get("_n", i)).alias("start"), F.get("_n", i).alias("length"), p["loss"].alias("loss"))
        return F.transform(F.filter(F.transform("_pieces", span), lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))

    return sized.select(*keep, F.array_join(F.transform("_pieces", lambda p: p["text"]), "").alias("formatted"), bound(prefix_sums(F.col("_n")), spans).alias("loss_spans"))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Turns (role, text) of a formatted conversation."""
    t = template or Template()
    split_at = lambda x, control: F.split(x, re.escape(control), -1)
    blocks = split_at(F.substring(formatted, len(t.begin) + 1, (1 << 31) - 1), t.end)

    def turns(b: Column) -> Column:
        sides = split_at(b, t.body)
        role = t.unescape(F.substring(F.get(sides, 0), len(t.head) + 1, (1 << 31) - 1))
        return F.transform(split_at(F.get(sides, 1), t.follow), lambda x: F.struct(role.alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def masked_texts(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """What stands under the mask, span by span, unescaped. The string is cut into pieces once, so a span costs its length."""
    t = template or Template()
    one = lambda parts, s: t.unescape(cut(parts, s["start"], s["length"]))
    return bound(pieces(formatted), lambda parts: F.transform(spans, lambda s: one(parts, s)))


#: The conversation that the query adds: both of its turns are made of control strings.
PROBE = (-7, "</s>[INST] ok [/INST]")


def op12_chat_format(spark, sf_dir, conversations: DataFrame | None = None) -> DataFrame:
    """Every conversation formatted, stored, and read back; see the module's docstring. A conversation of the probe's number stays apart from it."""
    rows = common.documents(spark, sf_dir, "conversations") if conversations is None else conversations
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("_probe"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turn = lambda n, role: F.struct(F.lit(PROBE[0]).cast("long").alias("conv_id"), F.lit(1).alias("_probe"), F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE[1]).alias("text"))
    probe = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    formatted = common.staged(format_conversations(sorted_turns(rows.unionByName(probe), ["conv_id", "_probe"])), "chat")
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("t"), F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("l"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _escaped(t: str) -> str:
    for i, c in enumerate((_MARK, *Template().controls)):
        t = f"replace({t}, '{c}', '{_MARK}{i}')"
    return t


QUERIES = {"op12_chat_format": op12_chat_format}
ORACLES = {
    "op12_chat_format": f"""
        WITH t AS (
            SELECT conv_id, 0 AS probe, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {PROBE[0]}, 1, * FROM (VALUES (0, 'user', '{PROBE[1]}'), (1, 'assistant', '{PROBE[1]}'))
        ), o AS (
            SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens, coalesce(lead(role) OVER w <> role, true) AS closes FROM t
            WINDOW w AS (PARTITION BY conv_id, probe ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
            (3 + sum(length({_escaped("text")}) + CASE WHEN opens THEN 13 + length({_escaped("role")}) ELSE 0 END + CASE WHEN closes THEN 4 ELSE 6 END))::BIGINT AS formatted_chars
        FROM o GROUP BY conv_id, probe""",
}

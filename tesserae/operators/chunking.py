"""Markdown sections, sentences and greedy packing into chunks, as folds over arrays inside the JVM.

A text stays one row: sections are an array with their places, sentences an array of each section, and the
packing is a fold that carries numbers only (where the open chunk and the carried overlap begin), reading
lengths from prefix sums. No shuffle and no Python; texts are cut once, at the end.

Edge cases: null and blank texts give one empty chunk without metadata; blank sentences count for nothing;
a text without chunks of its own (headings alone) is one chunk; places count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.arrays import bound, cut, pieces, prefix_sums

# Default sizes (characters, estimated tokens), tokens for a word, and the smallest section kept.
CHAR_SIZE, CHAR_OVERLAP = 800, 200
TOKEN_BUDGET, TOKEN_OVERLAP = 512, 64
TOKENS_PER_WORD = 1.3
SMALLEST_SECTION = 64

# Fixed patterns: white space, line ends, headings, ends of sentences.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_INLINE = r"[^\n\r\u2028\u2029]"
_HEADING = rf"(?<!{_INLINE})#{{1,6}}{SPACE}+({_INLINE}+)"
_SENTENCE_END = rf"(?<=[.!?]){SPACE}+(?=[A-Z])|\n\n+"
_TERMINATOR = rf"(?s)^(.*?)[.!?](?:{SPACE}|\z)"
_MARK, _ESCAPED = "\x01\x03", "\x01\x02"


# Byte sequences that every white space beyond ASCII contains; a text without them needs the short pattern only.
_WIDE_SPACE = ("E280", "E2819F", "C2A0", "E19A80", "E38080", "EFBBBF")


def trim(t: Column, collapsed: bool = False) -> Column:
    return F.trim(t) if collapsed else F.regexp_replace(t, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(t: Column) -> Column:
    """Every run of white space one space, none at the ends."""
    wide = F.lit(False)
    for b in _WIDE_SPACE:
        wide = wide | F.contains(t.cast("binary"), F.unhex(F.lit(b)))
    return F.trim(F.when(wide, F.regexp_replace(t, f"{SPACE}+", " ")).otherwise(F.regexp_replace(t, r"\s+", " ")))


def words(t: Column, collapsed: bool = False) -> Column:
    """Number of words. collapsed: all white space is single spaces, so they can be counted."""
    if not collapsed:
        return F.size(F.filter(F.split(t, f"{SPACE}+"), lambda w: w != ""))
    return bound(F.trim(t), lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))


def estimate(t: Column, collapsed: bool = False) -> Column:
    return F.ceil(words(t, collapsed) * F.lit(TOKENS_PER_WORD)).cast("int")


@dataclass(frozen=True)
class Sizing:
    """How chunks are measured, in characters or in estimated tokens, how large they get, and how much the next one repeats."""

    unit: str
    budget: int
    overlap: int

    @classmethod
    def chars(cls, size: int = CHAR_SIZE, overlap: int = CHAR_OVERLAP) -> Sizing:
        return cls("chars", size, min(overlap, max(0, size // 2)))

    @classmethod
    def tokens(cls, budget: int = TOKEN_BUDGET, overlap: int = TOKEN_OVERLAP) -> Sizing:
        return cls("tokens", budget, min(overlap, max(0, budget // 2)))

    def measure(self, t: Column, collapsed: bool = False) -> Column:
        return F.length(t) if self.unit == "chars" else estimate(t, collapsed)

    def share(self, t: Column, collapsed: bool = False) -> Column:
        """What an item adds to a sum from which `total` gives the measure of joined items."""
        return (F.length(t) + 1 if self.unit == "chars" else words(t, collapsed)).cast("long")

    def total(self, added: Column) -> Column:
        return added - 1 if self.unit == "chars" else F.ceil(added * F.lit(TOKENS_PER_WORD))


def sections(t: Column) -> Column:
    """Sections (heading, body, start) in order. What stands before the first heading is one if it is not blank; a text without headings is one.

    Headings get a mark in front (the text's own ones are escaped before), the text is split at the marks, and starts are sums of lengths.
    """
    marked = F.split(F.regexp_replace(F.replace(t, F.lit("\x01"), F.lit(_ESCAPED)), f"({_HEADING})", f"{_MARK}$1"), _MARK, -1)
    parts = F.transform(marked, lambda p: F.replace(p, F.lit(_ESCAPED), F.lit("\x01")))

    def placed(p: Column, i: Column, ends: Column) -> Column:
        line = F.when(i == 0, 0).otherwise(F.coalesce(F.nullif(F.locate("\n", p), F.lit(0)), F.length(p)))  # length of the heading's line
        heading = F.when(i > 0, trim(F.regexp_extract(p, _HEADING, 1)))
        start = F.get(ends, i) - F.length(p) + line
        return F.struct(heading.alias("heading"), p.substr(line + 1, F.length(p)).alias("body"), start.cast("int").alias("start"))

    def all_(p: Column) -> Column:
        ends = prefix_sums(F.transform(p, lambda x: F.length(x).cast("long")))
        found = bound(ends, lambda e: F.transform(p, lambda x, i: placed(x, i, e)))
        return F.filter(found, lambda s, i: (i > 0) | (F.size(p) == 1) | (trim(s["body"]) != ""))

    return bound(parts, all_)


def sentences(t: Column, collapsed: bool = False) -> Column:
    return F.filter(F.split(t, r"(?<=[.!?]) (?=[A-Z])" if collapsed else _SENTENCE_END), lambda s: trim(s, collapsed) != "")


def hard_split(sentence: Column, budget: int, overlap: int) -> Column:
    """Pieces of a sentence that is longer than the budget, in characters: behind the first terminator of the next `budget` characters while that lies in their back half, then windows."""
    stride = max(budget - overlap, 1)

    def all_(parts: Column, length: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            at, rest = acc["at"], length - acc["at"]
            first = F.length(F.regexp_extract(cut(parts, at, F.lit(budget)), _TERMINATOR, 1))
            state = lambda at, done, out: F.struct(at.alias("at"), F.lit(done).alias("done"), F.concat(acc["out"], out).alias("out"))
            last = at + F.ceil((rest - budget) / stride).cast("int") * stride
            windows = F.transform(F.sequence(at, last, F.lit(stride)), lambda s: cut(parts, s, F.least(F.lit(budget), length - s)))
            found = bound(first, lambda f: F.when(f > budget * 0.5, state(at + f + 1, False, F.array(cut(parts, at, f + 1)))).otherwise(state(length, True, windows)))
            return F.when(acc["done"], acc).when(rest <= budget, state(length, True, F.array(cut(parts, at, rest)))).otherwise(found)

        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(length / (budget * 0.5)).cast("int")), start, step, lambda acc: acc["out"])

    # a sentence may be an expression of its own, and its length is asked for at every step: both are computed once
    long = lambda s, length: bound(pieces(s), lambda parts: all_(parts, length))
    return bound(sentence, lambda s: bound(F.length(s), lambda n: F.when(n <= budget, F.array(s)).otherwise(long(s, n))))


_WHOLE, _FIRST, _LATER = 0, 1, 2  # sentences; pieces of one that is larger than a chunk


def pack(parts: Column, sizing: Sizing, collapsed: bool = False) -> Column:
    """Chunks of sentences: joined while they fit, each beginning with the last sentences of the one before as far as the overlap allows.

    collapsed: the sentences have no white space but single spaces, which is faster to measure.
    """
    item = lambda t, kind: F.struct(t.alias("t"), kind.cast("int").alias("kind"))
    split = lambda s: F.transform(hard_split(s, sizing.budget, sizing.overlap), lambda p, i: item(p, F.when(i == 0, _FIRST).otherwise(_LATER)))
    full = F.filter(parts, lambda s: trim(s, collapsed) != "")
    items = F.flatten(F.transform(full, lambda s: F.when(sizing.measure(s, collapsed) > sizing.budget, split(s)).otherwise(F.array(item(s, F.lit(_WHOLE))))))
    none, no_ranges = F.lit(-1), F.array().cast("array<struct<a:int,b:int,trimmed:boolean>>")

    def ranges(all_: Column, sums: Column) -> Column:
        upto = lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.get(sums, i))
        total = lambda a, b: sizing.total(upto(b) - upto(a - 1))
        span = lambda a, b, trimmed: F.array(F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(trimmed).alias("trimmed")))
        state = lambda i, open_, carried, out: F.struct(i.cast("int").alias("i"), open_.cast("int").alias("open"), carried.cast("int").alias("carried"), out.alias("out"))

        def tail(a: Column, b: Column) -> Column:
            """Where the overlap with a closed chunk a..b begins."""
            if not sizing.overlap:
                return none
            fits = lambda t: (t == b) | ((total(t, b) <= sizing.overlap) & (total(t + 1, b) < sizing.overlap))
            return F.array_min(F.filter(F.sequence(a, b), fits))

        def closed(acc: Column) -> Column:
            end = acc["i"] - 1
            return F.when(acc["open"] < 0, acc).otherwise(state(acc["i"], none, tail(acc["open"], end), F.concat(acc["out"], span(acc["open"], end, True))))

        def step(acc: Column, x: Column) -> Column:
            i = acc["i"]
            begun = lambda c: F.when(c["carried"] < 0, i).otherwise(c["carried"])
            first = bound(closed(acc), lambda c: state(i + 1, none, i, F.concat(c["out"], span(begun(c), i, False))))
            later = state(i + 1, none, i, F.concat(acc["out"], span(i, i, False)))
            opened = bound(closed(acc), lambda c: state(i + 1, begun(c), c["carried"], c["out"]))
            goes_on = (acc["open"] >= 0) & (total(acc["open"], i) <= sizing.budget)
            whole = F.when(goes_on, state(i + 1, acc["open"], acc["carried"], acc["out"])).otherwise(opened)
            return F.when(x["kind"] == _FIRST, first).when(x["kind"] == _LATER, later).otherwise(whole)

        return F.aggregate(all_, state(F.lit(0), none, none, no_ranges), step, lambda acc: closed(acc)["out"])

    def texts(all_: Column) -> Column:
        sums = prefix_sums(F.transform(all_, lambda x: sizing.share(x["t"], collapsed)))
        joined = lambda r: F.array_join(F.transform(F.slice(all_, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: x["t"]), " ")
        return F.transform(bound(sums, lambda s: ranges(all_, s)), lambda r: bound(joined(r), lambda j: F.when(r["trimmed"], trim(j, collapsed)).otherwise(j)))

    return bound(items, texts)


_CHUNK = "struct<text:string,heading:string,char_start:int,char_end:int,token_count:int>"


def chunks(t: Column, sizing: Sizing, keep_small: bool = False) -> Column:
    """Chunks (text, heading, char_start, char_end, token_count) of a text. A section of one small chunk is left out unless it is the last."""

    def chunk(piece: Column, heading: Column, start: Column) -> Column:
        return F.struct(piece.alias("text"), heading.alias("heading"), start.cast("int").alias("char_start"), (start + F.length(piece)).cast("int").alias("char_end"), estimate(piece, True).alias("token_count"))

    def of_section(s: Column, last: Column) -> Column:
        def of_body(body: Column) -> Column:
            def emitted(packed: Column) -> Column:
                small = (F.size(packed) == 1) & (estimate(F.get(packed, 0), True) < SMALLEST_SECTION) & ~last
                # the place is that of the first occurrence in the section
                all_ = F.transform(packed, lambda p: chunk(p, s["heading"], s["start"] + F.greatest(F.call_function("instr", body, p) - 1, F.lit(0))))
                return all_ if keep_small else F.when(small, F.array().cast(f"array<{_CHUNK}>")).otherwise(all_)

            return bound(pack(sentences(body, True), sizing, True), emitted)

        return bound(collapse(s["body"]), of_body)

    def of_text(found: Column) -> Column:
        made = F.flatten(F.transform(found, lambda s, i: of_section(s, i == F.size(found) - 1)))
        alone = F.array(chunk(collapse(t), F.get(found, 0)["heading"], F.lit(0)))
        return bound(made, lambda m: F.when(F.size(m) > 0, m).otherwise(alone))

    empty = F.array(F.struct(F.lit("").alias("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("heading", "string"), ("char_start", "int"), ("char_end", "int"), ("token_count", "int"))]))
    return F.when(trim(F.coalesce(t, F.lit(""))) == "", empty).otherwise(bound(sections(t), of_text))


def chunk_documents(docs: DataFrame, sizing: Sizing | None = None, id_col: str = "doc_id", text_col: str = "text", keep_small: bool = False) -> DataFrame:
    """id, chunk_index, text, heading, char_start, char_end, token_count; one row per chunk."""
    found = chunks(F.col(text_col).cast("string"), sizing or Sizing.tokens(), keep_small)
    return docs.select(id_col, F.posexplode(found).alias("chunk_index", "c")).select(id_col, "chunk_index", "c.*")


def chunk_sentences(docs: DataFrame, sizing: Sizing, id_col: str = "doc_id", sentences_col: str = "sentences", collapsed: bool = False) -> DataFrame:
    """Given sentences packed: id, chunk_index, text, token_count."""
    return docs.select(id_col, F.posexplode(pack(F.col(sentences_col), sizing, collapsed)).alias("chunk_index", "text")).withColumn("token_count", estimate(F.col("text")))

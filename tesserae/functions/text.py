"""Text functions as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The estimate's tokens for a word and characters for a token.
TOKENS_PER_WORD, CHARS_PER_TOKEN = 1.3, 4
# FNV-1a of 32 bits.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def bm25_tokens(t: Column, unicode_words: bool = False) -> Column:
    """Lower-cased words of more than one character, everything but word characters and white space deleted.

    By default word characters are ASCII, so accented letters vanish from words; unicode_words keeps them.
    """
    drop = r"[^\p{L}\p{N}_\s]" if unicode_words else r"[^\w\s]"
    return F.filter(F.split(F.regexp_replace(F.lower(t), drop, ""), r"\s+"), lambda w: F.length(w) > 1)


def overlap_tokens(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"\W+"), lambda w: w != "")


def token_overlap(hypothesis: Column, doc: Column) -> Column:
    """Share of the hypothesis' tokens (with repeats) that occur in the document; 0 if either has none."""
    h, d = overlap_tokens(hypothesis), F.array_distinct(overlap_tokens(doc))
    hits = F.size(F.filter(h, lambda w: F.array_contains(d, w)))
    return F.when((F.size(h) == 0) | (F.size(d) == 0), F.lit(0.0)).otherwise(hits / F.when(F.size(h) == 0, 1).otherwise(F.size(h)))


def collapse(t: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def word_count(t: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != ""))


def estimated_tokens(t: Column) -> Column:
    """ceil(1.3 * words)."""
    return F.ceil(word_count(t) * F.lit(TOKENS_PER_WORD)).cast("int")


def estimated_tokens_by_chars(t: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(t) / CHARS_PER_TOKEN)).cast("int")


def _fnv1a32(texts: list) -> list:
    """All texts step together, one UTF-16 code unit at a time, the longest first; the few that are left at the end go one by one."""
    import numpy as np

    units = [None if t is None else np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    order = sorted((i for i, u in enumerate(units) if u is not None), key=lambda i: -len(units[i]))
    sizes = np.array([len(units[i]) for i in order])
    flat = np.concatenate([units[i] for i in order]) if order else np.zeros(0, "<u2")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if order else np.zeros(0, int)
    h, t, live = np.full(len(order), FNV_BASIS, np.uint32), 0, len(order)
    prime = np.uint32(FNV_PRIME)
    while True:
        live = int(np.searchsorted(-sizes[:live], -t, "left"))  # texts with more than t units
        if live < 24:
            break
        h[:live] = (h[:live] ^ flat[starts[:live] + t]) * prime
        t += 1
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        v = int(h[k])
        if k < live:
            for u in units[i][t:].tolist():
                v = (v ^ u) * FNV_PRIME & 0xFFFFFFFF
        out[i] = f"{v:x}"
    return out


def fnv1a32(t: Column) -> Column:
    """FNV-1a over UTF-16 code units as unpadded lower-case hex, by batches in Arrow."""
    import pyarrow as pa

    return F.arrow_udf(lambda batch: pa.array(_fnv1a32(batch.to_pylist()), pa.string()), "string")(t)


def sentences(t: Column) -> Column:
    """Split behind . ! or ? before a capital, and at blank lines; blank pieces dropped."""
    return F.filter(F.split(t, r"(?<=[.!?])\s+(?=[A-Z])|\n\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def strip_tags(t: Column) -> Column:
    return F.regexp_replace(t, "<[^>]*>", "")


def decode_entities(t: Column, intended: bool = True) -> Column:
    """The five named entities; with intended=False only &apos;, as the original's bytes do."""
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")) if intended else (("&apos;", "'"),)
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unwrap_url(u: Column) -> Column:
    """The uddg query parameter, decoded, or the url as it is."""
    return F.coalesce(F.nullif(F.try_url_decode(F.try_parse_url(u, F.lit("QUERY"), F.lit("uddg"))), F.lit("")), u)


def citation(heading: Column, text: Column) -> Column:
    return F.concat(F.when(heading.isNotNull() & (heading != ""), F.concat(F.lit("["), heading, F.lit("] "))).otherwise(""), F.substring(text, 1, 200))


def conversation_title(t: Column) -> Column:
    """Trimmed; above 40 characters the first 37 and an ellipsis."""
    t = F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.when(F.length(t) > 40, F.concat(F.substring(t, 1, 37), F.lit("…"))).otherwise(t)


def chunk_id(base: Column, index: Column, page: Column | None = None) -> Column:
    stem = base if page is None else F.when(page.isNull(), base).otherwise(F.concat(base, F.lit("-p"), page.cast("string")))
    return F.concat(stem, F.lit("-"), index.cast("string"))

"""Media columns: storing text losslessly as audio samples, and signature sniffing of any bytes.

Sniffing finds magic bytes with an Aho-Corasick automaton, and a validator for each format confirms
structure and length, so that a chance match of a magic does not count. What starts at byte 0 corrects
the declared type; whatever is confirmed further inside is carved out with its place and length.

Edge cases: a null or empty text is stored as one block of spaces; null bytes sniff as null with
nothing carved; texts of any length are stored whole and sniffed in near-linear time, as every place is
walked from once (only packed gzip data that overlaps is unpacked from each of its beginnings); damaged
or cut-off media are not confirmed; repeated rows give equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

BLOCK = 192

# Magic bytes, how far into the file they stand, and the type they announce.
SIGNATURES = (
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
)


class Finder(bytes):
    """Bytes with what validators have learned about them. Where a walk goes from a place depends on the place alone, so each is walked from once."""

    def __new__(cls, b: bytes):
        own = super().__new__(cls, b)
        own.places, own.walks, own.sums = {}, {}, []
        return own

    def after(self, pattern: bytes, at: int) -> int:
        """The first place from `at` on where the pattern stands, or -1. All its places are looked up once."""
        if pattern not in self.places:
            found, p = [], self.find(pattern)
            while p >= 0:
                found.append(p)
                p = self.find(pattern, p + 1)
            self.places[pattern] = found
        found = self.places[pattern]
        k = bisect.bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def settled(self, kind: str, start, step: Callable, fold: Callable = lambda value, rest: rest):
        """The outcome of the walk from `start`. step(place) is (next place, value), or (None, outcome) where the walk ends; fold carries values back."""
        known, way, place = self.walks.setdefault(kind, {}), [], start
        while place not in known:
            onward, value = step(place)
            if onward is None:
                known[place] = value
                break
            way.append((place, value))
            place = onward
        out = known[place]
        for place, value in reversed(way):
            known[place] = out = fold(value, out)
        return out

    def crc(self, start: int, end: int) -> int:
        """crc32 of a range, from sums up to every 4096th byte."""
        if end - start <= _CRC_STEP:
            return zlib.crc32(memoryview(self)[start:end])
        if not self.sums:
            self.sums.append(0)
            for lo in range(0, len(self), _CRC_STEP):
                self.sums.append(zlib.crc32(memoryview(self)[lo : lo + _CRC_STEP], self.sums[-1]))

        def upto(p: int) -> int:
            k = p // _CRC_STEP
            return zlib.crc32(memoryview(self)[k * _CRC_STEP : p], self.sums[k])

        return upto(end) ^ _shifted(upto(start), end - start)


_CRC_STEP = 4096


@functools.cache
def _shift_tables(power: int) -> list[list[int]]:
    """What appending 2**power zero bytes does to a crc, by each of its four bytes."""
    if power == 0:
        images = []
        for bit in range(32):
            c = 1 << bit
            for _ in range(8):
                c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
            images.append(c)
    else:
        half = _shift_tables(power - 1)
        images = [_apply(half, _apply(half, 1 << bit)) for bit in range(32)]
    tables = []
    for byte in range(4):
        t = [0] * 256
        for v in range(1, 256):
            low = v & -v
            t[v] = t[v ^ low] ^ images[8 * byte + low.bit_length() - 1]
        tables.append(t)
    return tables


def _apply(t: list[list[int]], c: int) -> int:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


def _shifted(c: int, n: int) -> int:
    power = 0
    while n:
        if n & 1:
            c = _apply(_shift_tables(power), c)
        n, power = n >> 1, power + 1
    return c


def _riff(b: Finder, at: int) -> tuple[str, int] | None:
    if len(b) < at + 12:
        return None
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    form = b[at + 8 : at + 12]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if kind is None or at + n > len(b):
        return None
    return (kind, n) if _chunk_beyond(b, at + 12, at + n - 8) in (at + n, at + n + 1) else None  # chunks have to fill the form exactly


def _chunk_beyond(b: Finder, at: int, limit: int) -> int:
    """Where the walk over chunks from `at` first stands beyond `limit`. Chunks know their successor and one far ahead, so this takes logarithmic time."""

    def step(p: int):
        if p + 8 > len(b):
            return None, (0, p, p)
        size = struct.unpack_from("<I", b, p + 4)[0]
        return p + 8 + size + size % 2, p

    def fold(p: int, onward: tuple[int, int, int]) -> tuple[int, int, int]:
        size = struct.unpack_from("<I", b, p + 4)[0]
        q = p + 8 + size + size % 2
        depth, _, far = onward
        farther = known[far]
        return depth + 1, q, (farther[2] if depth - farther[0] == farther[0] - known[farther[2]][0] else q)

    known = b.walks.setdefault("riff", {})
    b.settled("riff", at, step, fold)
    while at <= limit:
        _, onward, far = known[at]
        at = far if far <= limit else onward
    return at


def _png(b: Finder, at: int) -> tuple[str, int] | None:
    def step(p: int):
        if p + 12 > len(b):
            return None, -1
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or b.crc(p + 4, p + 8 + n) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None, -1
        return (None, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)

    end = b.settled("png", at + 8, step)
    return ("image/png", end - at) if end >= 0 else None


def _gif(b: Finder, at: int) -> tuple[str, int] | None:
    def step(place: tuple[int, bool]):
        p, inside = place
        if p >= len(b):
            return None, -1
        if inside:  # a run of data blocks ends with an empty one
            return ((p + b[p] + 1, True) if b[p] else (p + 1, False)), None
        if b[p] == 0x3B:
            return None, p + 1
        if b[p] == 0x21:
            return (p + 2, True), None
        if b[p] == 0x2C and p + 10 < len(b):
            return (p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0), True), None
        return None, -1

    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    end = b.settled("gif", (at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), False), step)
    return ("image/gif", end - at) if end >= 0 else None


def _jpeg(b: Finder, at: int) -> tuple[str, int] | None:
    def step(p: int):
        if p + 4 > len(b) or b[p] != 0xFF:
            return None, -1
        onward = p + 2 + struct.unpack_from(">H", b, p + 2)[0]
        return (None, b.after(b"\xff\xd9", onward)) if b[p + 1] == 0xDA else (onward, None)

    end = b.settled("jpeg", at + 2, step)
    return ("image/jpeg", end + 2 - at) if end >= 0 else None


def _pdf(b: Finder, at: int) -> tuple[str, int] | None:
    end = b.after(b"%%EOF", at)
    return ("application/pdf", end + 5 - at) if end >= 0 and 0 <= b.after(b"startxref", at) <= end - 9 and b[at + 5 : at + 6].isdigit() else None


def _zip(b: Finder, at: int) -> tuple[str, int] | None:
    end = b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return ("application/zip", end + 22 + note - at) if at + offset + size == end and end + 22 + note <= len(b) else None


def _gzip(b: Finder, at: int) -> tuple[str, int] | None:
    """The header is read here, so that a name without end costs one look-up; the packed data is unpacked once for each place where it begins."""
    flags = b[at + 3] if len(b) >= at + 10 else 0xFF
    if flags & 0xE0:
        return None
    p = at + 10
    if flags & 4:
        p += 2 + struct.unpack_from("<H", b, p)[0] if p + 2 <= len(b) else len(b)
    for flag in (8, 16):  # name, comment
        if flags & flag:
            p = b.after(b"\0", p) + 1
            if p == 0:
                return None
    if flags & 2:
        if p + 2 > len(b) or b.crc(at, p) & 0xFFFF != struct.unpack_from("<H", b, p)[0]:
            return None
        p += 2
    end, crc, size = b.settled("gzip", p, lambda q: (None, _inflated(b, q)))
    if end < 0 or end + 8 > len(b) or struct.unpack_from("<II", b, end) != (crc, size & 0xFFFFFFFF):
        return None
    return "application/gzip", end + 8 - at


def _inflated(b: Finder, at: int) -> tuple[int, int, int]:
    """Where the packed data from `at` ends (-1: it does not), crc32 and length of what it unpacks to, which is not kept."""
    d, data, crc, size = zlib.decompressobj(-15), memoryview(b)[at:], 0, 0
    try:
        lo, step = 0, 256  # most that are none end at once
        while lo < len(data) and not d.eof:
            part = data[lo : lo + step]
            lo += len(part)
            step = min(step * 4, 1 << 16)
            while part and not d.eof:
                out = d.decompress(part, 1 << 20)
                crc, size = zlib.crc32(out, crc), size + len(out)
                part = d.unconsumed_tail
    except zlib.error:
        return -1, 0, 0
    return (at + lo - len(d.unused_data), crc, size) if d.eof else (-1, 0, 0)


def _flac(b: Finder, at: int) -> tuple[str, int] | None:
    return ("audio/flac", len(b) - at) if len(b) >= at + 42 and b[at + 4] & 0x7F == 0 and b[at + 5 : at + 8] == b"\0\0\x22" else None


def _ogg(b: Finder, at: int) -> tuple[str, int] | None:
    def step(p: int):
        if b[p : p + 5] != b"OggS\0" or p + 27 > len(b):
            return None, -1
        last, segments = b[p + 5] & 4, b[p + 26]
        onward = p + 27 + segments + sum(b[p + 27 : p + 27 + segments])
        if onward > len(b):
            return None, -1
        return (None, onward) if last else (onward, None)

    end = b.settled("ogg", at, step)
    return ("audio/ogg", end - at) if end >= 0 else None


def _mp4(b: Finder, at: int) -> tuple[str, int] | None:
    def step(p: int):
        if p + 8 > len(b):
            return None, (p, False)
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        return (p + n, kind == b"moov") if n >= 8 and p + n <= len(b) and kind.isalnum() else (None, (p, False))

    end, film = b.settled("mp4", at, step, lambda moov, rest: (rest[0], rest[1] or moov))
    return ("video/mp4", end - at) if film else None


VALIDATORS = {
    "riff": _riff,
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
    "audio/flac": _flac,
    "audio/ogg": _ogg,
    "video/mp4": _mp4,
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, before, kind in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic) + before - 1, kind))
    a.make_automaton()
    return a


def sniff(b: bytes | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The confirmed type at byte 0 (None if there is none) and (type, offset, length) of the media inside."""
    own, inside, reach = None, [], 0
    b = Finder(b or b"")
    for end, (back, kind) in _automaton().iter(b.decode("latin-1")):
        at = end - back
        if at < 0 or (inside and at < reach):
            continue
        found = VALIDATORS[kind](b, at)
        if not found:
            continue
        if at == 0:
            own = own or found[0]
        else:
            inside.append((found[0], at, found[1]))
            reach = at + found[1]
    return own, inside


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """Bytes as samples of an 8-bit mono PCM wave."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wav(b: bytes) -> bytes | None:
    """The samples of an 8-bit mono PCM wave; None if it is not one."""
    if _riff(Finder(b), 0) is None or b[8:12] != b"WAVE":
        return None
    p, plain = 12, False
    while p + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, p)
        if kind == b"fmt ":
            plain = struct.unpack_from("<HH", b, p + 8) == (1, 1) and struct.unpack_from("<H", b, p + 22)[0] == 8
        if kind == b"data":
            return b[p + 8 : p + 8 + n] if plain else None
        p += 8 + n + n % 2
    return None


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared (what the source says the column holds) and media, the stored wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            media = [to_wav(r.ljust(max(1, -(-len(r) // BLOCK)) * BLOCK, b" ")) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(["text/plain"] * len(raw)), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "declared", "media"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with detected_type, corrected (the declared type was wrong) and carved, an array of (type, offset, length)."""
    names = [*keep, "detected_type", "corrected", "carved"]
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", detected_type string, corrected boolean, carved array<struct<type:string,offset:long,length:long>>"
    carved_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, wrong, carved = [], [], []
            for b, said in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()):
                own, inside = sniff(b)
                kinds.append(own if own or b is None else said)
                wrong.append(bool(own) and own != said)
                carved.append([{"type": k, "offset": o, "length": n} for k, o, n in inside])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(kinds, pa.string()), pa.array(wrong, pa.bool_()), pa.array(carved, carved_type)], names)

    return df.select(*keep, media_col, declared_col).mapInArrow(run, schema)


def describe_media(stored: DataFrame) -> DataFrame:
    """Digests and features of stored waves, from the bytes read back; see op2_media_columns for the columns."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, n_carved int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for said, media in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, inside = sniff(media)
                payload = from_wav(media)
                x = np.frombuffer(payload, "u1")
                mean, crossings = x.mean(), np.count_nonzero(np.diff(x >= 128))
                loud = np.sqrt(np.mean((x - 128.0) ** 2))
                feature = f"{own};frames={len(x)};mean={mean:.4f};rms={loud:.4f};peak={int(x.max())};crossings={crossings}"
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, own or said, bool(own) and own != said, len(inside))
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
            names = [p.split()[0] for p in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, schema)


def op2_media_columns(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """Every document's text stored as a wave, read back, sniffed and described; see the module's docstring."""
    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    return describe_media(common.staged(encode_media(docs), "media"))


QUERIES = {"op2_media_columns": op2_media_columns}
ORACLES: dict[str, str] = {}

import gzip
import hashlib
import io
import math
import random
import struct
import time
import zipfile
import zlib

import pytest

from tesserae.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xda\x00\x02data\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"


def zipped():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a.txt", "hello")
    return b.getvalue()


def test_each_format_whole_and_carved():
    flac = b"fLaC\x80\x00\x00\x22" + b"\0" * 40
    ogg = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x05hello"
    mp4 = struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov"
    for kind, b in (("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", PDF), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"abc" * 100)), ("audio/ogg", ogg), ("video/mp4", mp4), ("audio/wav", media.to_wav(b"abcd"))):
        assert media.sniff(b)[0] == kind
        own, inside = media.sniff(b"junk" * 3 + b + b"tail")
        assert own is None and inside == [(kind, 12, len(b))], kind
    assert media.sniff(flac)[0] == "audio/flac"


def test_chance_magic_does_not_count():
    for text in (b"RIFF raff", b"%PDF- is a format", b"PK\x03\x04 nope", b"GIF89a!", b"", b"fLaC", b"x ftyp y", png()[:-3]):
        assert media.sniff(text) == (None, []), text
    assert media.sniff(None) == (None, [])


def test_wave_round_trip():
    for p in (b"", b"a", b"ab" * 500):
        assert media.from_wav(media.to_wav(p)) == p
    assert media.from_wav(b"text") is None


def test_query(spark):
    texts = [(1, None), (2, ""), (3, "é" * 100), (4, "x" * 192), (5, "y" * 500_001), (5, "y" * 500_001), (6, "say RIFFxxxxWAVE")]
    d = spark.createDataFrame([(*t, "m", 9) for t in texts], "doc_id long, text string, media string, n_bytes int")
    got = media.op2_media_columns(spark, "", d).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (dict(texts)[r.doc_id] or "").encode()
        pad = raw + b" " * (-len(raw) % 192 if raw else 192)
        wave = media.to_wav(pad)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(pad[-16:]), len(wave), hashlib.sha256(wave).hexdigest())
        mean = sum(pad) / len(pad)
        loud = math.sqrt(sum((x - 128) ** 2 for x in pad) / len(pad))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(pad, pad[1:]))
        assert r.media_type == "audio/wav" and r.corrected and r.feature == f"audio/wav;frames={len(pad)};mean={mean:.4f};rms={loud:.4f};peak={max(pad)};crossings={crossings}"
    assert media.op2_media_columns(spark, "", d.limit(0)).count() == 0


def test_sniff_frame(spark):
    rows = [(1, media.to_wav(b"ab" + png()), "text/plain"), (2, None, "image/png"), (3, b"plain", "text/plain"), (4, png(), "image/png")]
    d = spark.createDataFrame([(i, None if b is None else bytearray(b), s) for i, b, s in rows], "doc_id long, media binary, declared string")
    got = {r.doc_id: r for r in media.sniff_media(d).collect()}
    assert got[1].detected_type == "audio/wav" and got[1].corrected and [(c.type, c.offset) for c in got[1].carved] == [("image/png", 46)]
    assert got[2].detected_type is None and got[3].detected_type == "text/plain" and not got[4].corrected


MANY = (
    b"%PDF-1 x ", b"%PDF-1 %%EOF ", b"PK\x03\x04 y ", b"\xff\xd8\xff\xda\x00\x02 ", b"\xff\xd8\xff\xe0\x00\x09abcdefg", b"\0\0\0\x10ftypAAAAAAAA", b"OggS\0" + b"\0" * 22, b"OggS\0" + b"A" * 90,
    b"GIF89aAAAAAAA!AA", b"GIF89aAAAAAAA" + b"!A\x0bAAAAAAAAAAA", b"RIFF\xff\0\0\0WAVE", b"RIFFAA\0\0WAVEabcdAA\0\0", b"RIFFAAAAWAVE", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08abcdefg", b"\x1f\x8b\x08\x1f\x02\0", b"fLaC", b"\x89PNG\r\n\x1a\n\0\0\1\0",
    b"\x89PNG\r\n\x1a\n" + b"\0\x20\0\0", png()[:-12],
)


@pytest.mark.parametrize("piece", MANY)
def test_many_magic_bytes_take_linear_time(piece):
    took = []
    for n in (1_000_000, 5_000_000):
        begin = time.perf_counter()
        media.sniff(piece * (n // len(piece)))
        took.append(time.perf_counter() - begin)
    assert took[1] < 30, took


def test_nested_chunks_take_linear_time():
    """Ever shorter forms whose chunks join one long chain ever earlier."""
    b, n = bytearray(b"a" * 400_000), 10_000
    for k in range(n):
        at, first = 20 * k, 200_000 + 8 * (n - k)  # the first chunk of each form leads to the chain in the back half
        b[at : at + 20] = b"RIFF" + struct.pack("<I", 399_000 - at) + b"WAVEjunk" + struct.pack("<I", first - at - 20)
        b[first : first + 8] = b"next" + struct.pack("<I", 0)
    begin = time.perf_counter()
    assert media.sniff(bytes(b)) == (None, [])
    assert time.perf_counter() - begin < 10


class Plain:
    """Validators that read everything again for each candidate."""

    @staticmethod
    def riff(b, at):
        if len(b) < at + 12 or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
            return None
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        p = at + 12
        while p + 8 <= end <= len(b):
            size = int.from_bytes(b[p + 4 : p + 8], "little")
            p += 8 + size + size % 2
        return end - at if end <= len(b) and p in (end, end + 1) else None

    @staticmethod
    def png(b, at):
        p = at + 8
        while p + 12 <= len(b):
            n = int.from_bytes(b[p : p + 4], "big")
            if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
                return None
            p += 12 + n
            if b[p - n - 8 : p - n - 4] == b"IEND":
                return p - at
        return None

    @staticmethod
    def gzip(b, at):
        d = zlib.decompressobj(31)
        try:
            d.decompress(b[at:])
        except zlib.error:
            return None
        return len(b) - at - len(d.unused_data) if d.eof else None

    @staticmethod
    def ogg(b, at):
        p = at
        while b[p : p + 5] == b"OggS\0" and p + 27 <= len(b):
            last, k = b[p + 5] & 4, b[p + 26]
            p += 27 + k + sum(b[p + 27 : p + 27 + k])
            if p > len(b):
                return None
            if last:
                return p - at
        return None

    @staticmethod
    def mp4(b, at):
        p, seen = at, set()
        while p + 8 <= len(b):
            n = int.from_bytes(b[p : p + 4], "big")
            if n < 8 or p + n > len(b) or not b[p + 4 : p + 8].isalnum():
                break
            seen.add(b[p + 4 : p + 8])
            p += n
        return p - at if b"moov" in seen else None


def test_walks_agree_with_plain_ones():
    rng = random.Random(9)
    bits = [b"RIFF", b"WAVE", b"\x04\0\0\0", b"\x10\0\0\0", b"\x21\0\0\0", b"abcd", b"\0\0\0\x08moov", b"\0\0\0\x10ftypabcdabcd", b"OggS\0\0" + b"\0" * 20 + b"\x01\x05", b"OggS\0\4" + b"\0" * 21, b"hello", png(), png()[:-12], gzip.compress(b"xyz"), gzip.compress(b"q" * 9)[:-1], b"\0"]
    rounds = {"riff": (media._riff, b"RIFF", 0), "png": (media._png, b"\x89PNG", 0), "gzip": (media._gzip, b"\x1f\x8b\x08", 0), "ogg": (media._ogg, b"OggS", 0), "mp4": (media._mp4, b"ftyp", 4)}
    hits = dict.fromkeys(rounds, 0)
    for _ in range(1500):
        b = media.Finder(b"".join(rng.choice(bits) for _ in range(rng.randrange(1, 24))))
        for name, (validate, magic, back) in rounds.items():
            at = b.find(magic)
            while at >= 0:
                if at >= back:
                    found = validate(b, at - back)
                    assert (found and found[1]) == getattr(Plain, name)(bytes(b), at - back), (name, bytes(b), at)
                    hits[name] += bool(found)
                at = b.find(magic, at + 1)
    assert all(hits.values()), hits


def test_gzip_headers():
    body = gzip.compress(b"text" * 50, mtime=0)[10:]
    for flags, extra in ((0, b""), (8, b"name\0"), (16, b"note\0"), (28, b"\x03\0abcname\0note\0"), (4, b"\xff\xffab"), (8, b"name"), (32, b"")):
        b = b"\x1f\x8b\x08" + bytes([flags]) + b"\0" * 6 + extra + body
        assert (media._gzip(media.Finder(b), 0) or (0, None))[1] == Plain.gzip(b, 0), flags
    head = b"\x1f\x8b\x08\x02" + b"\0" * 6
    for crc in (zlib.crc32(head) & 0xFFFF, 1):
        b = head + struct.pack("<H", crc) + body
        assert (media._gzip(media.Finder(b), 0) or (0, None))[1] == Plain.gzip(b, 0)


def test_crc_of_ranges():
    rng = random.Random(4)
    b = media.Finder(rng.randbytes(50_000))
    for _ in range(300):
        lo, hi = sorted((rng.randrange(50_001), rng.randrange(50_001)))
        assert b.crc(lo, hi) == zlib.crc32(b[lo:hi])


def test_finder_agrees_with_find():
    rng = random.Random(2)
    b = bytes(rng.choice(b"ab") for _ in range(300))
    f = media.Finder(b)
    for _ in range(2000):
        p, at = rng.choice([b"ab", b"aab", b"bbbb", b"ababab", b"aaaaaaaaaaaaaa"]), rng.randrange(310)
        assert f.after(p, at) == b.find(p, at)

"""Best-fit packing of token sequences.

Documents become token ids, each ended by one extra id; documents longer than a sequence are cut into
full pieces, of which only the first may be shorter. Bounded-space best-fit then puts pieces into
sequences: a fixed number of bins is open, a bitset indexed by free space finds the tightest one that
fits, and when a new bin is needed while all are open, the fullest closes. A packer looks at LOOK_AHEAD
pieces together and takes the longest of them first, so it is online in blocks and not piece by piece.

Edge cases: a null text counts as empty (its document is the end id alone), repeated rows are packed as
often as they occur, texts of any length are encoded whole (also megabytes of white space or of one
letter), pieces of equal length are taken in a fixed order, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import common

#: Pieces that one packing task handles, bins it holds open, and pieces that it looks at together.
PACKER_PIECES, OPEN_BINS, LOOK_AHEAD = 131_072, 4096, 4096
_LONG_SPACE = re.compile(r"\s{1000}")  # the faster encoder's pattern runs out of stack on much longer runs
# The byte-level vocabulary's word pattern.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for what follows U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes; equal to what the tokenizer gives for each whole text.

    The tokenizer's own file is read as ranks for the faster encoder where its ids rise in the order of
    its merges, as byte-level vocabularies do. Texts with characters above U+00FF, on whose classes the
    two libraries might differ, texts with a special token, and texts with very long runs of white space
    go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task; Spark runs the tasks in parallel
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, byte_of = model["vocab"], _byte_of()
        merges = (m.split(" ") if isinstance(m, str) else m for m in model.get("merges", []))
        order = [vocabulary["".join(m)] for m in merges]
        if order and order == sorted(set(order)) and all(vocabulary.get(c, 1 << 31) < order[0] for c in byte_of):
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            plain = self.fast is not None and (t.isascii() or max(t) <= "\xff") and not any(s in t for s in self.special) and not _LONG_SPACE.search(t)
            if plain:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes())
            else:
                out.append(np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and a shorter one in front if there is a rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    ends = starts[1:] + [n]
    return [(s, e - s) for s, e in zip(starts, ends)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            coded = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            rows: list[list] = [[], [], [], [], []]
            arrays = []
            for doc, b in zip(ids, coded):
                b += end
                for k, (s, n) in enumerate(cut(len(b) // 4, capacity)):
                    part = b[4 * s : 4 * (s + n)]
                    for col, v in zip(rows, (doc, k, s, n, zlib.crc32(part))):
                        col.append(v)
                    if with_ids:
                        arrays.append(np.frombuffer(part, "<u4").astype("i4"))
            cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


class OpenBins:
    """Bounded-space best-fit. place(n) gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.made = capacity, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit f: some open bin has f tokens free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.count -= 1
        return got

    def _keep(self, which: int, free: int) -> None:
        if free:
            self.by_free[free].append(which)
            self.mask |= 1 << free
            self.count += 1

    def place(self, n: int) -> tuple[int, int]:
        fits = self.mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            if n < self.capacity and self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, which = self.capacity, self.made
            self.made += 1
        self._keep(which, free - n)
        return which, self.capacity - free


def pack_best_fit(pieces: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length <= capacity.

    Rows are dealt by a hash of what they hold and of their own number to packers of about PACKER_PIECES, so
    that repeated ids and equal pieces spread too; each packer takes them in a fixed order, look_ahead at a
    time with the longest first, so a repeated task gives the same sequences. `pieces` is a stored table.
    """
    spark = pieces.sparkSession
    packers = max(1, -(-pieces.count() // PACKER_PIECES))
    names = pieces.columns
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, open_bins)
        for batch in batches:
            for lo in range(0, batch.num_rows, look_ahead):
                part = batch.slice(lo, look_ahead)
                lengths = part.column(at).to_numpy(zero_copy_only=False)
                seq, off = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
                for i in np.argsort(-lengths, kind="stable").tolist():
                    seq[i], off[i] = bins.place(int(lengths[i]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(seq + base), pa.array(off)], [*names, "sequence_id", "offset"])

    numbered = pieces.withColumn("_deal", F.xxhash64("doc_id", "piece", "start", "length", F.monotonically_increasing_id()))
    dealt = numbered.repartition(packers, "_deal").sortWithinPartitions("_deal", "doc_id", "piece", "start", "length").select(*names)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(look_ahead))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def op3_best_fit_packing(spark, sf_dir, docs: DataFrame | None = None) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; see the module's docstring for edge cases."""
    import public_tokenizers

    common.prepare(spark)
    docs = common.documents(spark, sf_dir) if docs is None else docs
    pieces = common.staged(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return pack_best_fit(pieces)


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLES: dict[str, str] = {}

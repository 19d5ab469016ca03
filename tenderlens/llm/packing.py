"""Best-fit packing of tokenised documents into fixed-length training sequences (large-item matching).

Items of one length are interchangeable, so the packing is planned on the histogram of piece lengths, whose size is
bounded by the capacity and not by the data: pieces above a third of the capacity are matched at most two to a bin
(the longest with the longest that fits), smaller ones go, longest first, to the bin with the least room that holds them.
The plan names, for every length, runs of places; each piece takes the place of its rank among pieces of its length.

Edge cases: null and empty texts are the end token alone; texts longer than the capacity are cut into full pieces and a
remainder; repeated rows and null ids are packed row by row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, ship, tidy

CAPACITY = 2048
CACHE = 150_000  # words kept by a worker; more are encoded anew


class WordEncoder:
    """Token ids of a text as little-endian uint32 bytes, through a cache of blank-separated chunks.

    The vocabulary's pre-tokeniser never joins across white space, so chunk ids concatenate to the ids of the text. Chunks
    of plain Latin letters, digits and punctuation go through a byte-pair encoder of the same merges (the end-of-word mark
    is the byte 0xFF, which UTF-8 never holds); any other chunk goes to the tokenizers library itself."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
        end = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            tail = token.endswith(end)
            return bytes(back[c] for c in (token[: -len(end)] if tail else token)) + b"\xff" * tail

        ranks = {bytes([b]): b for b in range(256)}
        order = [bytes([b, 255]) for b in range(255)]
        order += [raw(m[0]) + raw(m[1]) for m in (x.split(" ") if isinstance(x, str) else x for x in model["merges"])]
        for b in order:
            ranks.setdefault(b, len(ranks))
        vocab = {raw(t): i for t, i in model["vocab"].items() if not (t.startswith("<|") and t.endswith("|>"))}
        self.bytes_of = [int(vocab[b]).to_bytes(4, "little") if b in vocab else None for b in ranks]
        self.mark = {b: self.full.encode(chr(b), add_special_tokens=False).ids[0].to_bytes(4, "little") for b in b".,"}
        self.plain = regex.compile(r"[!-~\xa1-\u0129\u0132-\u0148\u014a-\u017f]+").fullmatch  # stable under NFC
        self.bpe = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # the generation before

    def chunk(self, c: bytes) -> bytes:
        out = self.old.get(c)
        if out is None:
            out = self.word(c)
            if out is None and c[-1] in b".,":  # a mark after a word of letters is a piece of its own; after other marks it is not
                out = self.word(c[:-1])
                out = out and out + self.mark[c[-1]]
            out = out or self.mixed(c)
        if len(self.cache) >= CACHE:
            self.old, self.cache = self.cache, {}
        self.cache[c] = out
        return out

    def word(self, c: bytes) -> bytes | None:
        """Of a chunk that is one word of Latin letters, else None."""
        if not c.isalpha():
            text = c.decode("utf-8", "surrogatepass")
            if not text.isalpha() or max(text) > "\u017f" or "\u0130" in text or "\u0149" in text:
                return None
            c = text.lower().encode()
        of = self.bytes_of
        parts = [of[r] for r in self.bpe(c + b"\xff")]
        return None if None in parts else b"".join(parts)

    def mixed(self, c: bytes) -> bytes:
        text = c.decode("utf-8", "surrogatepass")
        if self.plain(text):
            of = self.bytes_of
            parts = [of[r] for w in self.words(text.lower()) for r in self.bpe(w.encode() + b"\xff")]
            if None not in parts:
                return b"".join(parts)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        get, chunk = self.cache.get, self.chunk
        if "<|" in text:  # special tokens are read before letters are lowered
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([get(c) or chunk(c) for c in text.encode("utf-8", "surrogatepass").lower().split()])


_encoders: dict[str, WordEncoder] = {}

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
)


def _pieces(batches, path: str, capacity: int):
    from pyspark import TaskContext

    from . import packing as here

    if path not in here._encoders:
        here._encoders[path] = WordEncoder(path)
    enc, task = here._encoders[path], TaskContext.get().partitionId()
    seen: dict[int, int] = defaultdict(int)
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = enc.encode(text.as_py() or "") + b"\0\0\0\0"
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                part = ids[4 * start : 4 * (start + capacity)]
                k = len(part) // 4
                out.append((doc, piece, start, k, zlib.crc32(part), task, seen[k]))
                seen[k] += 1
        if out:
            yield batch_of(PIECES, list(zip(*out)))


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Runs (lengths in a bin, number of such bins) and the number of bins, for ``histogram[length] = count``."""
    left = {k: v for k, v in histogram.items() if v}
    third = capacity / 3
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [[lengths, count], ...]
    large = sorted((k for k in left if k > third), reverse=True)
    for a in large:
        for b in (x for x in large if x <= capacity - a):  # the longest partner that fits, first
            while left[a] and left[b] and (a != b or left[a] > 1):
                m = left[a] // 2 if a == b else min(left[a], left[b])
                left[a] -= m
                left[b] -= m
                open_bins[capacity - a - b].append([(a, b), m])
            if not left[a]:
                break
        if left[a]:
            open_bins[capacity - a].append([(a,), left[a]])
            left[a] = 0
    small = sorted((k for k in left if k <= third), reverse=True)
    for length in small:
        c = left[length]
        while c:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                each = min(c, capacity // length)  # new bins hold this length alone, the longest left
                bins, rest = divmod(c, each)
                open_bins[capacity - each * length].append([(length,) * each, bins])
                if rest:
                    open_bins[capacity - rest * length].append([(length,) * rest, 1])
                break
            run = open_bins[room][-1]
            each = min(room // length, c)  # best fit keeps filling the same bin while it fits
            m = min(run[1], c // each)
            open_bins[room - each * length].append([run[0] + (length,) * each, m])
            run[1] -= m
            c -= m * each
            if not run[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
    runs = [(tuple(lengths), n) for room in sorted(open_bins) for lengths, n in open_bins[room] if n]
    return runs, sum(n for _, n in runs)


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first bin and offset of every run of places."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for lengths, n in runs:
        at = 0
        for k in lengths:
            out[k].append((used[k], first, at))
            used[k] += n
            at += k
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs(doc_id, text)``; one row per piece. ``tokenizer`` is the path of a word-piece vocabulary file.

    One pass tokenises and writes the pieces (a few numbers each); the driver sees the counts by (task, length) summed to
    ranks' offsets by Spark, and the histogram of at most ``capacity`` lengths."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(lambda it: tidy(_pieces(it, tokenizer, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    offsets = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    where = spark.sparkContext.broadcast(places(runs))

    def place(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    ranks, bins, at = where.value[int(length[part[0]])]
                    i = np.searchsorted(ranks, rank[part], "right") - 1
                    seq[part], off[part] = bins[i] + rank[part] - ranks[i], at[i]
            yield batch_of(schema, [*(b.column(i) for i in range(5)), seq, off])

    ranked = pieces.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)

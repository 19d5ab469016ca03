"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of whole documents of about ``SHARD_WORDS`` words. Its words are coded by the benchmark's vocabulary; any
other word, and the end of a document, is a boundary that no test phrase crosses. The shard's suffix array over coded
words is cut at boundaries, its Burrows-Wheeler transform is held in a wavelet matrix, and all test phrases are searched
backward at once, two ranks a step. Occurrences are located by walking back to sampled suffix positions (each position
after a boundary, and every eighth), and overlapping occurrences merge to removal spans.

Edge cases: null and empty texts have no words; items without words have no windows; items shorter than the window are one
window; items with a null id hit words but are not named or counted; repeated items and documents are reported each; extra
columns are not read; documents longer than a shard form a shard of their own; an empty
benchmark hits nothing. A benchmark above ``BLOCK_WORDS`` words is searched in blocks, one pass of the documents each, so
that what is broadcast stays bounded.
"""

from __future__ import annotations

from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, alnum_words, batch_of, ship, tidy

WINDOW, SHARD_WORDS, BLOCK_WORDS, SAMPLE = 13, 1 << 19, 500_000, 8


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a level, zeros before ones."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.counts, self.zeros = [], []
        for b in range(levels - 1, -1, -1):
            bits = (seq >> b) & 1
            self.counts.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]))
            one = bits.astype(bool)
            seq = np.concatenate([seq[~one], seq[one]])
            self.zeros.append(len(seq) - int(self.counts[-1][-1]))
        self.levels = levels

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        lo, hi = np.zeros_like(at), at
        for k, (count, zeros) in enumerate(zip(self.counts, self.zeros)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = count[lo], count[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position and its rank there."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for count, zeros in zip(self.counts, self.zeros):
            one = count[at + 1] > count[at]
            a, b = count[at], count[lo]
            at, lo = np.where(one, zeros + a, at - a), np.where(one, zeros + b, lo - b)
            symbol = symbol * 2 + one
        return symbol, at - lo


class FMIndex:
    """Over coded words; 0 is a boundary. Only suffixes that start with a word are kept: no phrase starts elsewhere."""

    def __init__(self, text: np.ndarray, sigma: int):
        pos = np.flatnonzero(text)
        n = len(pos)
        after = np.zeros(len(text) + 1, np.int64)
        after[pos] = np.arange(n)
        ends = np.append(np.flatnonzero(text == 0), len(text))
        edge = np.searchsorted(ends, pos)  # the boundary after each word; boundaries sort below words, by place
        left = ends[edge] - pos  # words until it
        key = text[pos].astype(np.int64) * (sigma + 1) + np.append(text, 0)[pos + 1]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head
        loose = np.flatnonzero(np.append(same, False) | np.append(False, same))  # places of the order not settled
        step, wide = 2, n + len(ends)
        while len(loose):  # prefix doubling over what is still tied
            part = order[loose]
            on = left[part] > step
            later = np.where(on, rank[after[np.minimum(pos[part] + step, len(text))]] + len(ends), edge[part])
            key = rank[part] * wide + later
            by = np.argsort(key)
            part, key = part[by], key[by]
            order[loose] = part
            same = key[1:] == key[:-1]
            first = np.append(True, ~same)
            rank[part] = loose[np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))]
            loose = loose[np.append(same, False) | np.append(False, same)]
            step *= 2
        self.suffix = pos[order]  # read at sampled rows only
        before = np.where(self.suffix > 0, text[self.suffix - 1], 0)
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(sigma).bit_length()))
        count = np.bincount(text[pos], minlength=sigma + 2)
        self.first = np.concatenate([[0], np.cumsum(count)])[: sigma + 2]
        cut = pos[left == 1]  # words before a boundary: their suffixes lead their symbol's rows
        self.cut = np.bincount(text[cut], minlength=sigma + 2)
        self.sampled = (before == 0) | (self.suffix % SAMPLE == 0)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; phrases are right-aligned rows of codes."""
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        live = np.flatnonzero(hi > lo)
        for k in range(2, phrases.shape[1] + 1):
            live = live[(hi[live] > lo[live])]
            go = live[lengths[live] >= k]
            if not len(go):
                continue
            c = phrases[go, -k]
            base = self.first[c] + self.cut[c]
            both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo[go], hi[go]]))
            lo[go], hi[go] = base + both[: len(go)], base + both[len(go) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            done = self.sampled[rows[todo]]
            d = todo[done]
            out[d] = self.suffix[rows[d]] + steps[d]
            todo = todo[~done]
            if len(todo):
                c, r = self.bwt.access(rows[todo])
                rows[todo] = self.first[c] + self.cut[c] + r
                steps[todo] += 1
        return out


class Phrases:
    """Windows of benchmark items: codes, lengths and the items that hold each, in arrays (56 bytes a window at most, beside
    the block's vocabulary; a block has ``BLOCK_WORDS`` words)."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.code: dict[bytes, int] = {}
        self.names = [None if item is None else str(item) for item, _ in items]
        rows, owner = [np.zeros((0, window), np.int32)], []
        for k, (_, text) in enumerate(items):
            ids = np.array([self.code.setdefault(w, len(self.code) + 1) for w in alnum_words(text)], np.int32)
            if len(ids):
                ids = ids if len(ids) >= window else np.append(np.zeros(window - len(ids), np.int32), ids)
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window))
                owner.append(np.full(len(rows[-1]), k, np.int32))
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        flat = np.ascontiguousarray(np.concatenate(rows))
        _, first, which = np.unique(flat.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.codes = flat[first].astype(np.int32)
        self.lengths = (self.codes > 0).sum(1)
        held = np.unique(which.astype(np.int64) << 32 | owner)  # each window's items, once
        self.held, self.at = (held & 0xFFFFFFFF).astype(np.int32), np.searchsorted(held >> 32, np.arange(len(first) + 1))

    def items(self, windows: set[int]) -> list[str]:
        """Sorted ids of the items that hold one of the windows; items without an id are not named."""
        own = {k for p in windows for k in self.held[self.at[p] : self.at[p + 1]].tolist()}
        return sorted({self.names[k] for k in own} - {None})

    def __len__(self):
        return len(self.lengths)


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("span_start", pa.list_(pa.int64())), ("span_end", pa.list_(pa.int64()))])
KEY = pa.struct([("row", pa.int64()), ("doc_id", pa.int64())])  # in place of the id when the benchmark is in blocks


def search_shard(docs: list[tuple], phrases: Phrases):
    """Rows of HITS for (id, words) of one shard."""
    codes = phrases.code
    parts, starts, at = [], [], 0
    for _, words in docs:
        starts.append(at)
        parts.append(np.fromiter(map(codes.get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
        at += len(words) + 1
    text = np.concatenate(parts)
    spans, items = {}, {}
    if len(phrases) and text.any():
        index = FMIndex(text, len(phrases.code))
        lo, hi = index.search(phrases.codes, phrases.lengths)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        place = index.locate(rows)
        doc = np.searchsorted(starts, place, "right") - 1
        order = np.lexsort((place, doc))
        for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else []:
            d = int(doc[part[0]])
            s = place[part] - starts[d]
            spans[d] = merge(s, s + phrases.lengths[which[part]])
            items[d] = phrases.items(set(which[part].tolist()))
    for d, (doc_id, words) in enumerate(docs):
        sp = spans.get(d, [])
        yield doc_id, len(words), items.get(d, []), [a for a, _ in sp], [b for _, b in sp]


def _search(batches, phrases: Phrases, schema: pa.Schema = HITS):
    shard, size = [], 0
    for b in batches:
        out = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = alnum_words(text.as_py())
            shard.append((doc_id, words))
            size += len(words)
            if size >= SHARD_WORDS:
                out += search_shard(shard, phrases)
                shard, size = [], 0
        if out:
            yield batch_of(schema, list(zip(*out)))
    if shard:
        yield batch_of(schema, list(zip(*search_shard(shard, phrases))))


def blocks_of(benchmark: DataFrame):
    """Blocks of items of at most BLOCK_WORDS words, streamed to the driver one at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1] or "") // 2 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, passthrough: tuple = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of ``docs(doc_id, text)``; spans are merged half-open word ranges
    to remove, items the sorted ids (as strings) of the benchmark items with an occurring window. One pass, no shuffle; a
benchmark of several blocks takes a pass for each and a shuffle of their hits."""
    spark = docs.sparkSession
    ship(spark)
    schema = "{} n_words long, items array<string>, span_start array<long>, span_end array<long>"
    blocks = blocks_of(benchmark)
    head = list(islice(blocks, 2))
    rows, types, out_schema = docs.select("doc_id", "text"), HITS, schema.format("doc_id long,")
    if len(head) > 1:
        # several blocks: the passes' spans of a row meet again by a number that is written once, so that all passes read the same
        rows = Scratch(spark).save(rows.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text"))
        types, out_schema = HITS.set(0, pa.field("doc_id", KEY)), schema.format("doc_id struct<row: long, doc_id: long>,")
    runs = []
    for block in chain(head or [[]], blocks):
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        runs.append(rows.mapInArrow(lambda it, s=shared: tidy(_search(it, s.value, types)), out_schema))
    out = runs[0]
    if len(runs) > 1:
        tagged = None
        for k, block_run in enumerate(runs):
            tagged = block_run if tagged is None else tagged.unionByName(block_run)
        out = tagged.groupBy("doc_id", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("span_start", "span_end")))).alias("z"),
        )
        merged = F.aggregate("z", F.array().cast("array<struct<a:bigint,b:bigint>>"), lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["span_start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["span_end"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["span_start"].alias("a"), x["span_end"].alias("b"))))))
        out = out.withColumn("z", merged).select("doc_id.doc_id", "n_words", "items", F.col("z.a").alias("span_start"), F.col("z.b").alias("span_end"))
    hit = F.aggregate(F.arrays_zip("span_start", "span_end"), F.lit(0).cast("long"), lambda a, x: a + x["span_end"] - x["span_start"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", F.arrays_zip("span_start", "span_end").alias("spans"))

"""Katz backoff language model over words, with Good-Turing discounts and exactly normalised backoff weights.

Documents are coded once into blocks (a block's sorted word hashes and its tokens as places in them), written to the shared
folder. Counts live in partitioned tables, three of them, and each block sends an owner its distinct keys once:

* words, by ranges of the word hash: an owner sums the training counts and answers with them and with a number for every
  word, in the order of the hashes;
* pairs, by a hash of (history, word), so that no history, however frequent, is one task's: an owner sums their counts,
  answers with those, and hands on what it holds of each history: how many of its words it has seen once, twice, ... and
  their unigram mass;
* histories, by ranges of their number: an owner adds up these parts and answers with the history's backoff weight.

Keys are ascending numbers sent as compressed differences, about three bytes each, and answers are mostly small counts; so
what is shuffled follows the distinct n-grams of the blocks, and no vocabulary is broadcast or collected.

A token's probability is evaluated recursively: the discounted bigram where it was seen in training, else the history's
backoff weight times the discounted unigram, else the mass that the unigram discounts leave to unknown words. The weight of a
history is its left mass over the unigram mass of the words not seen after it, so that a history's probabilities sum to one.
A history whose counts are all too high to be discounted keeps one count for the unseen.

Edge cases: null and empty texts are the end token alone; a null id counts as training; repeated rows are scored and counted
each; very long texts are read whole (a block holds whole documents); without training rows every token is unknown.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, batch_of, packed, packed_up, ship, space_words, tidy, unpacked, unpacked_up

BLOCK_TOKENS, BUCKET_TOKENS, K = 700_000, 3_000_000, 5
END = np.uint64(0xE0D)  # not a word: the end that is counted

BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("vocab", pa.binary()), ("tokens", pa.binary())])
#: What blocks and owners send. kind: 0 words, 1 pairs, 2 parts of histories, 3 weights; stat: sums for the driver.
SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("stat", pa.list_(pa.float64()))])
SENT_SQL = "kind int, bucket long, block long, a binary, b binary, c binary, stat array<double>"
WORDS, PAIRS, PARTS, WEIGHTS, STATS = range(5)


def sent(rows: list[tuple]):
    return batch_of(SENT, list(zip(*rows)))


def sent_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([sent(rows)]) if rows else SENT.empty_table()


_hashes = WordHashes()


def _encode(batches, part: int):
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    ids, lens, parts, size, n = [], [], [], 0, 0

    def block():
        vocab, tokens = np.unique(np.concatenate(parts), return_inverse=True)
        docs = np.zeros(len(ids), [("id", "i8"), ("null", "i1"), ("held", "i1"), ("n", "i4")])
        docs["id"] = [i or 0 for i in ids]
        docs["null"] = [i is None for i in ids]
        docs["held"] = [i is not None and zlib.crc32(str(i).encode()) % part == 0 for i in ids]
        docs["n"] = lens
        return batch_of(BLOCKS, [[base + n], [docs.tobytes()], [packed_up(vocab)], [packed(tokens.astype(np.uint32))]])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = space_words(text.as_py())
            h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
            parts += [h, END[None]] if len(words) else [END[None]]
            ids.append(doc)
            lens.append(len(words) + 1)
            size += len(words) + 1
            if size >= BLOCK_TOKENS:
                yield block()
                ids, lens, parts, size, n = [], [], [], 0, n + 1
    if ids:
        yield block()


class Block:
    def __init__(self, docs: bytes, vocab: bytes, tokens: bytes):
        self.docs = np.frombuffer(docs, [("id", "i8"), ("null", "i1"), ("held", "i1"), ("n", "i4")])
        self.vocab = unpacked_up(vocab)
        self.tokens = unpacked(tokens, np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.docs)), self.docs["n"])
        self.train = self.docs["held"][self.doc] == 0
        first = np.cumsum(self.docs["n"]) - self.docs["n"]
        history = np.roll(self.tokens, 1)
        history[first] = len(self.vocab)  # the start
        pairs, self.pair = np.unique(history << 32 | self.tokens, return_inverse=True)
        self.h, self.w = pairs >> 32, pairs & 0xFFFFFFFF

    def keys(self, number: np.ndarray, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the pairs, in the order of their buckets and ascending in each; that order; and the buckets' cuts.
        Words are numbered in the order of their hashes, so pairs ascend as they are; the start has the last number."""
        if words >= 1 << 32:
            raise ValueError("pairs of more than 2^32 words do not fit a long")
        number = np.append(number, np.uint64(words))
        key = number[self.h] * np.uint64(words) + number[self.w]
        mixed = key ^ (key >> np.uint64(29))
        bucket = (mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
        return key[order], order, np.append(0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _ask_words(batches, buckets: int):
    for b in batches:
        for block, docs, vocab, tokens in zip(*(b.column(i).to_pylist() for i in range(4))):
            x = Block(docs, vocab, tokens)
            n = np.bincount(x.tokens[x.train], minlength=len(x.vocab)).astype(np.uint64)
            at = cuts(x.vocab, buckets)
            yield sent([(WORDS, i, block, packed_up(x.vocab[s:e]), packed(n[s:e]), b"", None) for i, (s, e) in enumerate(zip(at, at[1:])) if e > s])


def frequencies(n: np.ndarray) -> np.ndarray:
    """[types, tokens, types seen once, twice, ... K + 1 times]."""
    n = n[n > 0]
    return np.array([len(n), n.sum(), *np.bincount(n[n <= K + 1].astype(np.int64), minlength=K + 2)[1 : K + 2]], np.int64)


def _own_words(table: pa.Table) -> pa.Table:
    """Answers to each block: its words' places among the bucket's words, and their training counts."""
    bucket = table.column("bucket")[0].as_py()
    keys = [unpacked_up(a) for a in table.column("a").to_pylist()]
    counts = [unpacked(a, np.uint64) for a in table.column("b").to_pylist()]
    names, code = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(names), np.uint64)
    np.add.at(total, code, np.concatenate(counts))
    ends = total[names == END].sum()
    out, at = [(STATS, bucket, -1, b"", b"", b"", [*frequencies(total).astype(float), float(ends), float(len(names))])], 0
    for block, k in zip(table.column("block").to_pylist(), keys):
        mine = code[at : at + len(k)]
        out.append((WORDS, bucket, block, packed_up(mine), packed(total[mine]), b"", None))
        at += len(k)
    return sent_table(out)


def discounts(f: np.ndarray) -> np.ndarray:
    """Good-Turing ratios d[r] of counts r (1 above K), from [types, tokens, n1, n2, ...]; 1 where they are not defined."""
    n = f[2:].astype(float)
    d = np.ones(K + 1)
    if n[0] > 0:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and common < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


class Unigrams:
    def __init__(self, f: np.ndarray):
        self.d, self.tokens, self.types = discounts(f), int(f[1]), int(f[0])
        seen = sum(self.d[r] * r * f[1 + r] for r in range(1, K + 1)) + f[1] - sum(r * f[1 + r] for r in range(1, K + 1))
        self.scale, self.unknown = (1.0 / f[1], 1 - seen / f[1]) if f[1] else (0.0, 1.0)
        if self.unknown <= 1e-12:
            self.scale, self.unknown = 1.0 / (f[1] + 1), 1.0 / (f[1] + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.where(c > K, 0, c)] * c * self.scale, self.unknown)


def answers(table: pa.Table, kind: int, column: str, load) -> dict[int, np.ndarray]:
    """What the owners sent a block, by bucket."""
    rows = zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column(column).to_pylist())
    return {b: load(a) for k, b, a in rows if k == kind}


def known(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of a block's words; ``first`` is each bucket's first number."""
    place = answers(table, WORDS, "a", unpacked_up)
    count = answers(table, WORDS, "b", lambda a: unpacked(a, np.uint64))
    return np.concatenate([place[b] + first[b] for b in sorted(place)]), np.concatenate([count[b] for b in sorted(count)]).astype(np.int64)


def _ask_pairs(left: pa.Table, right: pa.Table, first: np.ndarray, words: int, buckets: int) -> pa.Table:
    if not left.num_rows:
        return SENT.empty_table()
    block, x = left.column("block")[0].as_py(), Block(*(left.column(c)[0].as_py() for c in ("docs", "vocab", "tokens")))
    number, c = known(right, first)
    n = np.bincount(x.pair[x.train], minlength=len(x.h)).astype(np.uint32)
    key, order, at = x.keys(number, words, buckets)
    n, c = n[order], c[x.w[order]].astype(np.uint64)
    return sent_table([(PAIRS, i, block, packed_up(key[s:e]), packed(n[s:e]), packed(c[s:e]), None) for i, (s, e) in enumerate(zip(at, at[1:])) if e > s])


PART = np.dtype([("n", "u4", (K,)), ("s", "f8")])


def _own_pairs(table: pa.Table, uni: Unigrams, first: np.ndarray, words: int) -> pa.Table:
    """Answers to each block: its pairs' counts. To the histories' owners: counts of counts and unigram mass of seen words."""
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    keys = [unpacked_up(a) for a in table.column("a").to_pylist()]
    names, place, code = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.bincount(code, np.concatenate([unpacked(a, np.uint32) for a in table.column("b").to_pylist()]), len(names)).astype(np.int64)
    of_word = np.concatenate([unpacked(a, np.uint64) for a in table.column("c").to_pylist()])[place].astype(np.int64)
    out, at = [], 0
    for block, k in zip(blocks, keys):
        out.append((PAIRS, bucket, block, packed(np.minimum(total[code[at : at + len(k)]], 2**32 - 1).astype(np.uint32)), b"", b"", None))
        at += len(k)
    seen = total > 0
    history, count, mass = names[seen] // np.uint64(max(1, words)), total[seen], uni.p(of_word[seen])
    start = np.zeros(1, PART)
    if len(history):
        runs = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
        part = np.zeros(len(runs), PART)
        part["s"] = np.add.reduceat(mass, runs)
        for r in range(1, K + 1):
            part["n"][:, r - 1] = np.add.reduceat(count == r, runs, dtype=np.uint32)
        history = history[runs]
        if history[-1] == words:
            start, history, part = part[-1:], history[:-1], part[:-1]
        at = np.searchsorted(history, np.append(first, np.uint64(words)))
        for i, (s, e) in enumerate(zip(at, at[1:])):
            if e > s:
                out.append((PARTS, i, -1, packed_up(history[s:e]), packed(part[s:e]), b"", None))
    out.append((STATS, bucket, -1, b"", b"", b"", [*frequencies(total).astype(float), *start["n"][0].astype(float), float(start["s"][0])]))
    return sent_table(out)


def _own_histories(table: pa.Table, first: np.ndarray, d: np.ndarray) -> pa.Table:
    """Answers to each block: the backoff weights of its words as histories."""
    bucket = table.column("bucket")[0].as_py()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "block", "a", "b"))))
    asked = [(block, unpacked_up(a).astype(np.int64), unpacked(b, np.uint64).astype(np.int64)) for kind, block, a, b in rows if kind == WORDS]
    if not asked:
        return SENT.empty_table()
    size = 1 + max(int(place[-1]) for _, place, _ in asked)
    c, n, s = np.zeros(size, np.int64), np.zeros((size, K)), np.zeros(size)
    for _, place, count in asked:
        c[place] = count
    parts = sorted((a, b) for kind, _, a, b in rows if kind == PARTS)  # always added up in the same order
    for a, b in parts:
        at, part = (unpacked_up(a) - first[bucket]).astype(np.int64), unpacked(b, PART)
        n[at] += part["n"]
        s[at] += part["s"]
    alpha = weights(c, n, s, d)[1]
    return sent_table([(WEIGHTS, bucket, block, packed(alpha[place]), b"", b"", None) for block, place, _ in asked])


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def weights(c: np.ndarray, n: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of a history's discounted counts and its backoff weight, from its count, counts of counts and the unigram mass
    of the words seen after it; an unseen history backs off at weight one."""
    c = c.astype(float)
    kept = c - ((1 - d[1:]) * np.arange(1, K + 1) * n).sum(1)
    with np.errstate(all="ignore"):
        left = 1 - kept / c
        reserve = left <= 1e-12
        left = np.where(reserve, 1 / (c + 1), left)
        scale = np.where(reserve, 1 / (c + 1), 1 / c)
        alpha = left / np.maximum(1e-300, 1 - s)
    return np.where(c > 0, scale, 0), np.where(c > 0, np.where(reserve, -alpha, alpha), 1)


def _score(left: pa.Table, right: pa.Table, uni: Unigrams, d: np.ndarray, first: np.ndarray, words: int, buckets: int, start: tuple[int, float]) -> pa.Table:
    """A weight below zero tells of a history that keeps one count for the unseen."""
    if not left.num_rows:
        return SCORES.empty_table()
    x = Block(*(left.column(c)[0].as_py() for c in ("docs", "vocab", "tokens")))
    number, c = known(right, first)
    _, order, _ = x.keys(number, words, buckets)
    n = answers(right, PAIRS, "a", lambda a: unpacked(a, np.uint32))
    count = np.empty(len(order), np.int64)
    count[order] = np.concatenate([n[b] for b in sorted(n)])
    alpha = answers(right, WEIGHTS, "a", lambda a: unpacked(a, np.float64))
    alpha = np.append(np.concatenate([alpha[b] for b in sorted(alpha)]), start[1])
    of = np.append(c, start[0]).astype(float)
    with np.errstate(divide="ignore"):
        scale = 1 / (of + (alpha < 0))
        p = np.where(count > 0, d[np.where(count > K, 0, count)] * count * scale[x.h], np.abs(alpha)[x.h] * uni.p(c[x.w]))
    logp = np.log10(p)
    base = np.log10((c + 0.1) / (uni.tokens + 0.1 * (uni.types + 1)))  # and the unknown
    m = len(x.docs)
    ids = pa.array(x.docs["id"], mask=x.docs["null"].astype(bool))
    cols = [ids, x.docs["held"].astype(bool), x.docs["n"].astype(np.int64), np.bincount(x.doc, c[x.tokens] > 0, m).astype(np.int64), np.full(m, uni.tokens), np.bincount(x.doc, base[x.tokens], m), np.bincount(x.doc, logp[x.pair], m)]
    return pa.Table.from_batches([batch_of(SCORES, cols)])


def _sums(table: DataFrame, size: int) -> np.ndarray:
    """The owners' sums added up; as many numbers as one owner has."""
    rows = table.where(F.col("kind") == STATS).select(F.posexplode("stat").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def katz_scores(docs: DataFrame, held_out_part: int = 10) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: held_out, counts, the unigram base score and the model's log10
    probability. Rows whose crc32(doc_id) mod ``held_out_part`` is 0 are not learnt from."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    blocks = scratch.save(docs.select("doc_id", "text").mapInArrow(lambda it: tidy(_encode(it, held_out_part), _hashes), "block long, docs binary, vocab binary, tokens binary"), "uncompressed")
    tokens = max(1, blocks.count()) * BLOCK_TOKENS
    buckets, few = max(1, math.ceil(tokens / BUCKET_TOKENS)), max(1, math.ceil(tokens / BUCKET_TOKENS / 8))
    words = scratch.save(blocks.mapInArrow(lambda it: _ask_words(it, few), SENT_SQL).groupBy("bucket").applyInArrow(_own_words, SENT_SQL), "uncompressed")
    total = _sums(words, K + 5)
    uni = Unigrams(total[: K + 3].astype(np.int64))
    sizes = {r["bucket"]: int(r["stat"][-1]) for r in words.where(F.col("kind") == STATS).select("bucket", "stat").toLocalIterator()}  # one short row a bucket
    first = np.append(0, np.cumsum([sizes.get(b, 0) for b in range(few)])).astype(np.uint64)
    types, first = int(first[-1]), first[:-1]
    by_block = words.where(F.col("kind") == WORDS)
    asked = blocks.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(lambda a, b: _ask_pairs(a, b, first, types, buckets), SENT_SQL)
    pairs = scratch.save(asked.groupBy("bucket").applyInArrow(lambda t: _own_pairs(t, uni, first, types), SENT_SQL), "uncompressed")
    sums = _sums(pairs, 2 * K + 4)
    d = discounts(sums[: K + 3].astype(np.int64))
    starts = int(total[K + 3])  # as many as ends
    start = starts, float(weights(np.array([starts]), sums[None, K + 3 : 2 * K + 3], sums[2 * K + 3 :], d)[1][0])
    parts = pairs.where(F.col("kind") == PARTS).unionByName(by_block)
    alpha = scratch.save(parts.groupBy("bucket").applyInArrow(lambda t: _own_histories(t, first, d), SENT_SQL), "uncompressed")
    heard = by_block.unionByName(pairs.where(F.col("kind") == PAIRS)).unionByName(alpha)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, uni, d, first, types, buckets, start), schema)
    out = scratch.save(out)
    scratch.drop(blocks, words, pairs, alpha)
    return out

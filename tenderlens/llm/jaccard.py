"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

The Jaccard distance is a metric, but nearly all documents are at distance 1 from nearly all others, so cells around pivots
drawn at random would each hold everything. The method therefore works in three metric steps, each on what the one before
left, and every step keeps all linked pairs:

1. Pivots are elected where documents can be near at all. Two sets within the threshold share a shingle among the first
   n - ceil(t n) + 1 of each in any global order; of the documents that hold such a shingle, cut where sizes part by more
   than the threshold (the triangle inequality about the empty set), the first is the pivot of the others' region. The order
   puts frequent shingles last; they are counted over all documents by fingerprint, exactly up to colliding fingerprints,
   which only change the order.
2. Inside a region documents are compared by sketches: histograms of their shingles over hash cells. The L1 distance of two
   histograms is a metric and never more than the symmetric difference of the sets, which linked sets have at most
   (1 - t) / (1 + t) of their sizes' sum, so a pair beyond that is not linked. Regions yield a spanning forest of what is
   left, and its components are the candidate clusters; a document is in one cluster at most, so its set travels once.
3. Clusters join exactly and recursively: sub-pivots make Voronoi cells by the Jaccard distance, a set goes to its nearest
   sub-pivot's cell and, as a boundary document, to those whose distance is within twice the threshold's distance of the
   nearest (triangle inequality); small cells are compared by exact intersections.

A region or cluster above ``BLOCK`` documents is cut into blocks, each compared in itself and with the pivot; then documents
that are not in its largest component are compared with all its blocks. So a group of thousands of near copies costs one
comparison with the pivot each, no group is held by one task, and no pairs are emitted, only spanning links.

Edge cases: null and empty texts, or texts of blanks, have no shingles and no links; texts of fewer than five words are one
shingle; equal sets are linked by a 128-bit hash of the set, and only the one of least id goes on; rows with a null id are
linked with nothing (component null); repeated ids are one node; very long texts are read whole; an empty table gives none.
Extra columns are not read. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FINISH, Scratch, WordHashes, batch_of, components, forest, packed, packed_up, partitions_for, ship, space_words, tidy, unpacked, unpacked_up

WORDS, BLOCK, LEAF = 5, 512, 96
#: A shingle is put last in the order from so many documents on; at most so many, the most frequent, are sent to executors.
FREQUENT, MOST = 32, 2_000_000
#: Bits of the fingerprint by which shingles are counted; shingles of a task that are packed at once.
FINGERPRINT, CHUNK = 44, 8_000_000
#: Sketch cells for a set of n shingles: the power of two from n / 8 on, within these bounds.
CELLS = (32, 1 << 16)


_hashes = WordHashes()
_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    words = space_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64).view(np.int64)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = h[i : n - k + 1 + i] * _MIX[i % 5] + np.uint64(i)
        out = (out ^ (x ^ (x >> np.uint64(29)))) * _MIX[(i + 2) % 5]
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


COUNTED = pa.schema([("part", pa.int32()), ("prints", pa.binary()), ("counts", pa.binary())])


def _counts(batches, parts: int):
    """How many of a task's documents hold each fingerprint, packed for the parts of the fingerprint range."""

    def flush(sets):
        f, n = np.unique(np.concatenate(sets).view(np.uint64) >> np.uint64(64 - FINGERPRINT), return_counts=True)
        at = np.searchsorted(f, [(i << FINGERPRINT) // parts for i in range(parts + 1)])
        rows = [(i, packed_up(f[a:b]), packed(n[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return batch_of(COUNTED, list(zip(*rows)))

    sets, size = [], 0
    for b in batches:
        for t in b.column(0):
            s = shingles(t.as_py())
            if len(s):
                sets.append(s)
                size += len(s)
            if size > CHUNK:
                yield flush(sets)
                sets, size = [], 0
    if sets:
        yield flush(sets)


OFTEN = pa.schema([("f", pa.int64()), ("n", pa.int64())])


def _often(table: pa.Table) -> pa.Table:
    prints = np.concatenate([unpacked_up(x) for x in table.column("prints").to_pylist()])
    counts = np.concatenate([unpacked(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    n = np.add.reduceat(counts, first)
    often = n >= FREQUENT
    return pa.table([prints[first][often].astype(np.int64), n[often]], schema=OFTEN)


def cells_of(n: int) -> int:
    return min(max(CELLS[0], 1 << max(0, (n - 1) // 8).bit_length()), CELLS[1])


def histogram(s: np.ndarray) -> np.ndarray:
    """Shingles in each hash cell, at most 255 (a bound keeps the distance a lower one)."""
    k = cells_of(len(s))
    return np.minimum(np.bincount((s.view(np.uint64) >> np.uint64(65 - k.bit_length())).astype(np.int64), minlength=k), 255).astype(np.uint8)


SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketch(batches, frequent: np.ndarray, percent: int):
    """Of the rows of one task with equal sets, only the first has a prefix and a sketch."""
    seen: set[bytes] = set()
    for b in batches:
        for a in range(0, b.num_rows, 2048):
            part = b.slice(a, 2048)
            out = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                s = shingles(text.as_py())
                n, prefix, sketch = len(s), s[:0], None
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if n and doc is not None and digest not in seen:
                    seen.add(digest)
                    f = (s.view(np.uint64) >> np.uint64(64 - FINGERPRINT)).astype(np.int64)
                    often = frequent[np.minimum(np.searchsorted(frequent, f), len(frequent) - 1)] == f if len(frequent) else np.zeros(n, bool)
                    prefix = np.concatenate([s[~often], s[often]])[: n - -(-percent * n // 100) + 1]
                    sketch = histogram(s).tobytes()
                out.append((doc, n, *np.frombuffer(digest, np.int64).tolist(), prefix, sketch))
            if out:
                doc, n, d1, d2, prefix, sketch = zip(*out)
                offsets = np.cumsum([0] + [len(p) for p in prefix], dtype=np.int32)
                yield batch_of(SKETCH, [doc, n, d1, d2, pa.ListArray.from_arrays(offsets, np.concatenate(prefix)), sketch])


ATTACHED = pa.schema([("pivot", pa.int64()), ("doc_id", pa.int64())])


def _attach(batches, percent: int):
    """From (h, n, doc_id) sorted so: documents of one shingle attach to the first of each run of sizes within the
    threshold of the next. Rows stream; only the current run's pivot is kept."""
    h0 = n0 = pivot = None
    opened = False  # the current run's pivot was put out itself
    for b in batches:
        if not b.num_rows:
            continue
        h, n, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.append(True, (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:]))
        if pivot is not None and h[0] == h0 and 100 * n0 >= percent * n[0]:
            new[0] = False
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        pivots = np.append(doc[first], 0)  # the last place stands for the run that the batch before left open
        mine = pivots[run] if new[0] else np.where(run < 0, pivot, pivots[run])
        follows = ~new
        size = np.bincount(run[run >= 0], minlength=len(first))
        heads = first[size > 1]
        if not new[0] and not opened:
            extra = np.array([pivot])
        else:
            extra = np.zeros(0, np.int64)
        out_p = np.concatenate([mine[follows], doc[heads], extra])
        out_d = np.concatenate([doc[follows], doc[heads], extra])
        opened = bool(len(first) == 0 or size[-1] > 1)
        h0, n0, pivot = h[-1], n[-1], int(mine[-1])
        if len(out_p):
            pair = np.unique(np.stack([out_p, out_d], 1), axis=0)
            yield batch_of(ATTACHED, [pair[:, 0], pair[:, 1]])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b, by products of membership matrices."""
    flat = np.concatenate(a + b)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
    live = n[code] > 1
    code, owner = np.unique(code[live], return_inverse=True)[1], owner[live]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(1, 4_000_000 // (len(a) + len(b)))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        s = slice(*np.searchsorted(code, [lo, lo + width]))
        m = np.zeros((len(a) + len(b), min(width, int(code[-1]) + 1 - lo)), np.float32)
        m[owner[s], code[s] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component root of every set under the links among them, by recursive Voronoi cells."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = 2 * (1 - percent / 100) + 1e-9

    def compare(i: np.ndarray):
        inter = overlaps([sets[k] for k in i], [sets[k] for k in i])
        hit = 100 * inter >= percent * (sizes[i][:, None] + sizes[i][None, :] - inter)
        x, y = np.nonzero(np.triu(hit, 1))
        found.append((i[x], i[y]))

    def split(i: np.ndarray, depth: int):
        if len(i) <= LEAF or depth > 6:
            return compare(i)
        pivots = i[np.linspace(0, len(i) - 1, max(2, int(len(i) ** 0.5) // 2)).astype(int)]
        inter = overlaps([sets[k] for k in i], [sets[k] for k in pivots])
        d = 1 - inter / np.maximum(1, sizes[i][:, None] + sizes[pivots][None, :] - inter)
        near = d.min(1)
        cell = d.argmin(1)
        for q in range(len(pivots)):
            own = cell == q
            if own.any():
                inside = d[:, q] <= near + reach  # own documents and boundary documents of other cells
                if inside.sum() > 0.8 * len(i):  # the cells do not part these documents: compare them at once
                    return compare(i)
                split(i[inside], depth + 1)

    split(np.arange(m), 0)
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
    return forest(m, a, b)


def candidates(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Component root of every document under the pairs that the sketches allow. Documents are compared within windows of
    sizes that the threshold allows; a sketch of twice the cells is folded to its partner's."""
    m = len(sizes)
    order = np.argsort(sizes, kind="stable")
    n = sizes[order].astype(np.int64)
    raw = [np.frombuffer(sketches[i], np.uint8) for i in order]
    cells = np.array([len(x) for x in raw])
    until = np.searchsorted(100 * n, 10_000 * n // percent, "right")  # 100 n_j <= 100 / percent * 100 n_i
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.unique(cells):
        at = np.arange(*np.searchsorted(cells, [k, k + 1]))  # sizes ascend, and cells with them
        at = np.arange(at[0], until[at[-1]])
        grid = np.stack([raw[i].reshape(k, -1).sum(1, dtype=np.int16) for i in at])
        np.minimum(grid, 255, out=grid)
        last = np.searchsorted(at, until)
        for x in np.flatnonzero(cells[at] == k):
            near = grid[x + 1 : last[at[x]]]
            if len(near):
                apart = np.abs(near - grid[x]).sum(1, dtype=np.int64)
                hit = at[x + 1 + np.flatnonzero((100 + percent) * apart <= (100 - percent) * (n[at[x]] + n[at[x + 1 : last[at[x]]]]))]
                found.append((np.full(len(hit), at[x]), hit))
    root = forest(m, *(np.concatenate(x) for x in zip(*found))) if found else np.arange(m)
    out = np.arange(m)
    out[order] = order[root]
    return out


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _regions(batches, percent: int):
    """Rows sorted by (region, block): region, block, doc_id, n, data; yields spanning links. Data are sketches or, where n
    is null, sets."""

    def work(ids, sizes, data):
        ids = np.array(ids)
        if sizes[0] is None:
            root = links([unpacked_up(x).view(np.int64) for x in data], percent)
        else:
            root = candidates(np.array(sizes), data, percent)
        linked = ids[root] != ids
        return ids[root[linked]], ids[linked]

    key, ids, sizes, data, out = None, [], [], [], []
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for k, doc, n, s in zip(keys, *(b.column(i).to_pylist() for i in (2, 3, 4))):
            if k != key:
                if len(ids) > 1:
                    out.append(work(ids, sizes, data))
                key, ids, sizes, data = k, [], [], []
            ids.append(doc)
            sizes.append(n)
            data.append(s)
        if out:
            yield batch_of(EDGES, [np.concatenate(x) for x in zip(*out)])
            out = []
    if len(ids) > 1:
        yield batch_of(EDGES, list(work(ids, sizes, data)))


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _sets(batches):
    for b in batches:
        for a in range(0, b.num_rows, 512):
            part = b.slice(a, 512)
            sets = [packed_up(np.sort(shingles(t.as_py()).view(np.uint64))) for t in part.column(1)]
            yield batch_of(SETS, [part.column(0), [None] * len(sets), sets])


def _spanning(items: DataFrame, members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Spanning links (a, b) of the documents of each region of ``members(region, doc_id)``, whose pivot is the document of
    the region's number; ``items(doc_id, n, data)`` are sketches or sets."""

    def compare(routes: DataFrame) -> DataFrame:
        rows = items.join(routes, "doc_id").select("region", "block", "doc_id", "n", "data")
        rows = rows.repartition("region", "block").sortWithinPartitions("region", "block")
        return scratch.save(rows.mapInArrow(lambda it: tidy(_regions(it, percent)), "a long, b long"))

    sizes = members.groupBy("region").agg(F.count("*").alias("k")).where("k > 1")
    placed = members.join(sizes, "region").withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    placed = scratch.save(placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("long")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    to_all = placed.where("doc_id = region and blocks > 1").select("doc_id", "region", each)
    edges = compare(placed.where("doc_id <> region or blocks = 1").select("doc_id", "region", "block").union(to_all))
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return edges
    comp = components(edges, scratch, FINISH)
    large = large.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id"))
    weights = large.groupBy("region", "c").agg(F.count("*").alias("w"))
    main = weights.groupBy("region").agg(F.max_by("c", "w").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = large.join(main, "region")
    loose = scratch.save(rest.where("c <> main").select("region", "doc_id", "blocks"))
    if not loose.limit(1).count():
        return edges
    chunks = loose.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    # a route is (block, chunk): every block meets every chunk of the loose documents
    tag = lambda block, chunk: (block * 1_000_000 + chunk + 1).cast("long")
    whole = rest.join(chunks, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    whole = whole.select("doc_id", "region", tag(F.col("block"), F.col("chunk")).alias("block"))
    few = loose.join(chunks, "region").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    few = few.select("doc_id", "region", "chunk", each).select("doc_id", "region", tag(F.col("block"), F.col("chunk")).alias("block"))
    return scratch.save(edges.union(compare(whole.union(few).distinct())).distinct())


def near_documents(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``; two documents link when the intersection
    of their shingle sets is at least ``percent`` hundredths of the union, and components are those of the links."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    parts = 4 * partitions_for(spark)
    counted = docs.select("text").mapInArrow(lambda it: tidy(_counts(it, parts), _hashes), "part int, prints binary, counts binary")
    often = counted.groupBy("part").applyInArrow(_often, "f long, n long").orderBy(F.desc("n"), "f").limit(MOST).select("f").toPandas()
    frequent = spark.sparkContext.broadcast(np.sort(often["f"].to_numpy(np.int64)))
    rows = scratch.save(docs.mapInArrow(lambda it: tidy(_sketch(it, frequent.value, percent), _hashes), "doc_id long, n long, d1 long, d2 long, prefix array<long>, sketch binary"))
    # of equal sets the one of least id goes on; tasks have already left one each
    one = rows.where("sketch is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "prefix", "sketch")).alias("x"))
    reps = scratch.save(one.select("x.*", "d1", "d2"))
    same = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    equal = scratch.save(same.join(reps.select(F.col("doc_id").alias("a"), "d1", "d2"), ["d1", "d2"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b")))
    counts = scratch.save(rows.select("doc_id", "n"))
    scratch.drop(rows)
    held = reps.select(F.explode("prefix").alias("h"), "n", "doc_id").repartition("h").sortWithinPartitions("h", "n", "doc_id")
    attached = held.mapInArrow(lambda it: tidy(_attach(it, percent)), "pivot long, doc_id long")
    attached = scratch.save(attached.distinct().withColumnRenamed("pivot", "region"))
    near = _spanning(reps.select("doc_id", "n", F.col("sketch").alias("data")), attached, percent, scratch)
    clusters = scratch.save(components(near, scratch, FINISH).select(F.col("component_id").alias("region"), F.col("id").alias("doc_id")))
    scratch.drop(reps, attached)
    sets = docs.join(clusters.select("doc_id"), "doc_id", "left_semi").mapInArrow(lambda it: tidy(_sets(it), _hashes), "doc_id long, n long, data binary")
    links_ = _spanning(sets, clusters, percent, scratch)
    comp = components(links_.union(equal), scratch, FINISH)
    return counts.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )

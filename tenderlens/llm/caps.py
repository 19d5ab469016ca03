"""Near-duplicate vectors by spherical-cap filters (locality-sensitive filtering with random product codes).

A code direction is a concatenation of one unit codeword from each block of the rotated vector; a vector belongs to every
direction whose inner product with it exceeds the cap height. Directions are listed without enumerating the product: the
codewords of each block are sorted by inner product and partial sums that cannot reach the cap any more are cut (list
decoding). Vectors meet in the directions they share; pairs are verified in double precision.

Identical vectors are compared once. A direction of many members is joined in blocks, so no task holds an unbounded group.
Links are exact in precision (none below the threshold); recall is that of the caps and is measured in the tests.
Below ``LOW`` dimensions vectors meet in cells of a grid instead of caps; there the join is exact.
Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; lengths that differ from
the first length seen for the table are compared only with their own length; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FINISH, Scratch, batch_of, components, forest, ship

BLOCKS, SEED, LIST = 2, 9, 90  # code blocks, seed, mean number of directions of a vector
LOW, GRID = 16, 1 << 20  # dimensions from which on caps are used; steps of a rounded inner product


@functools.lru_cache(maxsize=64)
def _codes(dim: int, words: int, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    rng = np.random.default_rng(seed + dim)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    k = min(BLOCKS, dim)
    edges = np.linspace(0, dim, k + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
    books = []
    for p in parts:
        c = rng.standard_normal((words, p.stop - p.start))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(k))
    return rotation, books, parts


@functools.lru_cache(maxsize=64)
def cap_height(dim: int, words: int) -> float:
    """The height at which a random unit vector of this dimension has LIST directions on average."""
    x = np.random.default_rng(SEED).standard_normal((64, dim))
    rotation, books, parts = _codes(dim, words)
    turned = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation
    dots = [turned[:, p] @ b.T for p, b in zip(parts, books)]
    sums = np.concatenate([np.sort((d[:, None] + e[None, :]).ravel())[-16 * LIST :] for d, e in zip(*dots)]) if len(dots) == 2 else dots[0].ravel()
    k = min(len(sums), 64 * LIST)
    return float(np.partition(sums, -k)[-k])


def grid_cells(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells, as wide as two linked vectors may be apart, that half that width around a vector touches;
    the middle of a linked pair lies in a cell of both, so no link is missed. Over the first three axes at most."""
    width = max(1e-6, math.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9)
    x = unit[:, : min(3, unit.shape[1])]
    low, high = (np.floor((x + 1 + side * width / 2) / width).astype(np.int64) + 1 for side in (-1, 1))
    row, code = np.arange(len(x)), np.zeros(len(x), np.int64)
    base = int(2 / width) + 4
    for i in range(x.shape[1]):
        both = np.flatnonzero(high[row, i] > low[row, i])
        code = np.concatenate([code * base + low[row, i], code[both] * base + high[row[both], i]])
        row = np.concatenate([row, row[both]])
    return row, code


def directions(unit: np.ndarray, words: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction of the product code with inner product >= cap_height, by list decoding. Inner
    products are rounded to a fixed grid, so that a vector has the same directions whatever it is batched with. In few
    dimensions, where caps are too coarse, the directions are grid cells instead."""
    if unit.shape[1] < LOW:
        return grid_cells(unit, threshold)
    rotation, books, parts = _codes(unit.shape[1], words)
    height = cap_height(unit.shape[1], words)
    turned = unit @ rotation
    dots = [np.rint(turned[:, p] @ b.T * GRID) / GRID for p, b in zip(parts, books)]
    best = np.stack([d.max(1) for d in dots], 1)
    rest = np.concatenate([np.cumsum(best[:, ::-1], 1)[:, ::-1], np.zeros((len(unit), 1))], 1)
    row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
    for i, d in enumerate(dots):
        need = height - rest[:, i + 1]
        keep_row, keep_code, keep_total = [], [], []
        for a in range(0, len(row), 8192):  # bounded memory whatever the list's length
            r = row[a : a + 8192]
            t = total[a : a + 8192, None] + d[r]
            x, w = np.nonzero(t >= need[r, None])
            keep_row.append(r[x])
            keep_code.append(code[a : a + 8192][x] * words + w)
            keep_total.append(t[x, w])
        row, code, total = map(np.concatenate, (keep_row, keep_code, keep_total)) if keep_row else (row, code, total)
    return row, code


def _units(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a batch, by length: row numbers and unit vectors."""
    col = batch.column(1)
    flat = col.flatten()
    nulls = np.asarray(flat.is_null())
    values = np.array(flat.fill_null(np.nan), dtype=np.float64)
    values[nulls] = np.nan
    lengths = np.asarray(pa.compute.list_value_length(col).fill_null(0))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = {}
    for n in np.unique(lengths):
        if n:
            at = np.flatnonzero(lengths == n)
            m = values[starts[at][:, None] + np.arange(n)]
            with np.errstate(all="ignore"):
                m = m / np.abs(m).max(1, keepdims=True)
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
            good = np.isfinite(m).all(1)
            out[int(n)] = at[good], m[good]
    return out


BLOCK = 1024  # members of a direction compared at once

RECORDS = pa.schema([("vec_id", pa.int64()), ("direction", pa.int64())])
FOUND = pa.schema([("vec_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _decode(batches, words: int, threshold: float):
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for n, (at, unit) in _units(b).items():
            for a in range(0, len(at), 2048):
                row, code = directions(unit[a : a + 2048], words, threshold)
                # directions of different lengths never meet
                yield batch_of(RECORDS, [ids[at[a : a + 2048]][row], code * 4099 + n])


def _group(ids, mult, unit, side, direction: int, threshold: float, words: int):
    """Links of one direction's members, each pair only in the least direction that its vectors share."""
    hit = unit @ unit.T >= threshold
    np.fill_diagonal(hit, False)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    live = np.flatnonzero(hit.any(1))
    if not len(live):
        return None
    hit = hit[np.ix_(live, live)]
    root = forest(len(live), *np.nonzero(hit))
    row, code = directions(unit[live], words, threshold)
    less = code < direction // 4099
    codes, col = np.unique(code[less], return_inverse=True)
    for a in range(0, len(codes), 4096):
        part = (col >= a) & (col < a + 4096)
        m = np.zeros((len(live), min(4096, len(codes) - a)), np.float32)
        m[row[less][part], col[part] - a] = 1
        hit &= ~((m @ m.T) > 0.5)
    return ids[live], ids[live][root], (hit * mult[live][None, :]).sum(1)


def _verify(batches, threshold: float, words: int):
    """Batches sorted by (direction, bi, bj): vec_id, mult, direction, bi, bj, side, embedding."""

    def work(t: pa.Table):
        t = t.combine_chunks()
        ids, mult, d, bi, bj, side = (t.column(i).to_numpy() for i in range(6))
        m = np.asarray(t.column(6).combine_chunks().flatten(), np.float64).reshape(len(ids), -1) if len(set(np.asarray(pa.compute.list_value_length(t.column(6))))) == 1 else None
        if m is None:  # vectors of several lengths, which never share a direction
            for n in np.unique(d % 4099):
                yield from work(t.filter(pa.array(d % 4099 == n)))
            return
        m = m / np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        size = np.diff(np.r_[first, len(ids)])
        hot = size > 64
        group = np.repeat(np.arange(len(first)), size)
        for k in range(1, int(size[~hot].max(initial=1))):
            i = np.flatnonzero((group[k:] == group[:-k]) & ~hot[group[k:]])
            near = np.einsum("ij,ij->i", m[i], m[i + k]) >= threshold - 1e-9
            hot[group[i[near]]] = True
        out = []
        for g in np.flatnonzero(hot & (size > 1)):
            s = slice(first[g], first[g] + size[g])
            cross = side[s] if bi[first[g]] != bj[first[g]] else None
            r = _group(ids[s], mult[s], m[s], cross, int(d[first[g]]), threshold, words)
            if r is not None:
                out.append(r)
        if out:
            yield batch_of(FOUND, [np.concatenate(x) for x in zip(*out)])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        keys = [t.column(i).to_numpy() for i in (2, 3, 4)]
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from work(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield from work(held)


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``.

    Null ids keep their row, with no links of their own counted through the id (n_links 0, component_id null, kept true)."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    usable = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    reps = scratch.save(classes.select("rep", "mult", "embedding"))
    # about five directions a vector keep the lists short at any size; beyond 4M directions lists grow and are blocked
    words = 1 << min(11, max(6, math.ceil(math.log2(max(1, 5 * reps.count())) / 2)))
    records = scratch.save(reps.select("rep", "embedding").mapInArrow(lambda it: _decode(it, words, threshold), "vec_id long, direction long"))
    sizes = records.groupBy("direction").agg(F.count("*").alias("n")).where("n > 1")
    met = records.join(sizes, "direction").withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("vec_id", "direction", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.col("own").alias("side"))
    payload = met.join(reps.withColumnRenamed("rep", "vec_id"), "vec_id").select("vec_id", "mult", "direction", "bi", "bj", "side", "embedding")
    order = ["direction", "bi", "bj"]
    found = payload.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _verify(it, threshold, words), "vec_id long, root long, links long")
    found = scratch.save(found.groupBy("vec_id", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch, FINISH)
    perclass = reps.select(F.col("rep").alias("vec_id"), "mult", "embedding").join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    perclass = perclass.select(
        "embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    out = vectors.join(perclass, "embedding", "left")
    return out.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component_id")), "vec_id").alias("component_id"),
        (F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True))).alias("kept"),
    )

"""K-d tree sharding: leaves of near-equal bytes, by distributed weighted medians along the widest metadata dimension.

Every dimension is a 63-bit coordinate: the scaled metadata value first, then a hash of the text, so that equal texts of
equal metadata share a point and stay together; the row's own hash breaks ties only where a point outweighs the tolerance
(a hot group of copies spans several leaves). A split's median is found by rounds of weighted histograms: Spark sums bytes
by (node, bin), the driver sees at most nodes x bins sums a round, and the bin that holds the median is refined.

Edge cases: null text counts no bytes; repeated rows and null ids are placed row by row (a null id hashes as 0); an empty
table gives no rows; rows that agree in everything are told apart by a row number taken when the metadata is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions_for

BINS = 2048
TOP = 1 << 62


@dataclass
class Node:
    id: int
    first: int  # its leaves are first .. first + leaves - 1
    leaves: int
    dim: int = 0
    lo: int = 0
    hi: int = 0
    below: float = 0.0  # weight before lo
    want: float = 0.0
    cut: int | None = None
    kind: str = "point"


def _spread(df: DataFrame, dims: list[str], node: Column) -> dict[int, list]:
    out = {}
    for r in df.groupBy(node.alias("node")).agg(F.sum("size").alias("w"), *[F.struct(F.min(d), F.max(d)).alias(d) for d in dims]).collect():
        out[r["node"]] = [r["w"], *[tuple(r[d]) for d in dims]]
    return out


def _case(nodes: list[Node], value) -> Column:
    c = None
    for n in nodes:
        c = F.when(F.col("node") == n.id, value(n)) if c is None else c.when(F.col("node") == n.id, value(n))
    return c


def _median(df: DataFrame, todo: list[Node], coord: str, tolerance: float) -> None:
    """Set cut of every node of todo: the coordinate below which its wanted weight lies, to within the tolerance if possible."""
    live = list(todo)
    while live:
        bins = _case(live, lambda n: F.least(F.lit(BINS - 1), F.expr(f"({coord} - {n.lo}L) div {max(1, -(-(n.hi - n.lo) // BINS))}L").cast("int")))
        inside = _case(live, lambda n: (F.col(coord) >= F.lit(n.lo)) & (F.col(coord) < F.lit(n.hi)))
        sums = df.where(inside).groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("w")).collect()
        by: dict[int, dict[int, int]] = {}
        for r in sums:
            by.setdefault(r["node"], {})[r["bin"]] = r["w"]
        nxt = []
        for n in live:
            step = max(1, -(-(n.hi - n.lo) // BINS))
            at, total = 0, n.below
            for at in sorted(by.get(n.id, {0: 0})):
                w = by.get(n.id, {0: 0})[at]
                if total + w >= n.want:
                    break
                total += w
            lo, hi = n.lo + at * step, min(n.hi, n.lo + (at + 1) * step)
            before, after = n.want - total, total + w - n.want
            if min(before, after) <= tolerance or hi - lo <= 1:
                n.cut = lo if before <= after else hi
                n.lo, n.hi, n.below = lo, hi, total
            else:
                n.lo, n.hi, n.below = lo, hi, total
                nxt.append(n)
        live = nxt


def own_of(names: list[str]) -> Column:
    """The hash of the text, which is the lower half of every coordinate."""
    return F.col(names[0]).bitwiseAND(F.lit((1 << 32) - 1))


def kd_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, dims: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of ``docs(doc_id, text, ...)``; each shard holds 1/shards of the bytes.

    ``dims`` are numeric metadata columns in 0..1; by default text length (log scale), language and source (hashed), those
    present. The text is read once, into a table of a few numbers a row; tree rounds read that table."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw = F.col("text").cast("binary")
    if dims is None:
        dims = {"length": F.log1p(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double")) / 23.0}
        for c in ("lang", "source"):
            if c in docs.columns:
                dims[c] = F.pmod(F.xxhash64(F.col(c)), F.lit(4093)) / 4093.0
    own = F.pmod(F.xxhash64("text"), F.lit(1 << 32))
    names = [f"d{i}" for i in range(len(dims))]
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
        *[(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * float(1 << 29)).cast("long") * F.lit(1 << 32) + own).alias(n) for n, v in zip(names, dims.values())],
    )
    meta = scratch.save(meta.withColumns({"tie": F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 2), "own": own_of(names)}))
    # equal texts are one point of the tree: where their metadata differ, all take the least
    bounds = [f(n).alias(f"{n}_{f.__name__}") for n in names for f in (F.min, F.max)]
    mixed = meta.groupBy("own", "size", "text_crc32").agg(*bounds).where(" or ".join(f"{n}_min <> {n}_max" for n in names))
    one = meta.join(mixed.select("own", "size", "text_crc32", *[f"{n}_min" for n in names]), ["own", "size", "text_crc32"], "left")
    first = scratch.save(one.select(*[F.coalesce(f"{c}_min", c).alias(c) if c in names else c for c in meta.columns if c != "own"]))
    scratch.drop(meta)
    meta = first
    nodes = [Node(0, 0, shards)]
    node = F.lit(0)
    target = None
    while any(n.leaves > 1 for n in nodes):
        df = meta.withColumn("node", node)
        spread = _spread(df, names, F.col("node"))
        target = target or sum(v[0] for v in spread.values()) / shards
        split = [n for n in nodes if n.leaves > 1 and n.id in spread]
        for n in split:
            w, *ranges = spread[n.id]
            n.dim = max(range(len(names)), key=lambda i: ranges[i][1] - ranges[i][0])
            n.lo, n.hi = ranges[n.dim][0], ranges[n.dim][1] + 1
            n.below, n.want = 0.0, w * (n.leaves // 2) / n.leaves
        if not split:
            break
        df = df.withColumn("coord", _case(split, lambda n: F.col(names[n.dim])))
        _median(df, split, "coord", tolerance * target)
        heavy = []
        for n in split:  # a point too heavy to lie on one side is cut by the rows' own hashes
            n.kind = "point"
            if n.hi - n.lo <= 1:
                heavy.append(n)
        if heavy:
            points = {n.id: n.lo for n in heavy}
            at = df.where(_case(heavy, lambda n: F.col("coord") == points[n.id]))
            weights = {r["node"]: r["w"] for r in at.groupBy("node").agg(F.sum("size").alias("w")).collect()}
            cut = [n for n in heavy if min(n.want - n.below, n.below + weights.get(n.id, 0) - n.want) > tolerance * target]
            for n in cut:
                n.kind, n.lo, n.hi = "tie", 0, TOP
            if cut:
                _median(at, cut, "tie", tolerance * target / 8)
                for n in cut:
                    n.dim, n.cut = n.dim, (points[n.id], n.cut)
        nxt, steps = [n for n in nodes if n not in split], None
        for n in split:
            left = Node(2 * n.id + 1, n.first, n.leaves // 2)
            right = Node(2 * n.id + 2, n.first + n.leaves // 2, n.leaves - n.leaves // 2)
            nxt += [left, right]
            c = F.col(names[n.dim])
            if n.kind == "tie":
                goes = (c < F.lit(n.cut[0])) | ((c == F.lit(n.cut[0])) & (F.col("tie") < F.lit(n.cut[1])))
            else:
                goes = c < F.lit(n.cut)
            side = F.when(goes, F.lit(left.id)).otherwise(F.lit(right.id))
            steps = F.when(node == n.id, side) if steps is None else steps.when(node == n.id, side)
        flat = scratch.save(meta.withColumn("node", steps.otherwise(node)))
        scratch.drop(meta)
        meta, node, nodes = flat.drop("node").withColumnRenamed("row", "row"), F.col("node"), nxt
        meta = flat
        meta._scratch_path = flat._scratch_path
    leaf = {n.id: n.first for n in nodes}
    shard = None
    for k, v in leaf.items():
        shard = F.when(F.col("node") == k, F.lit(v)) if shard is None else shard.when(F.col("node") == k, F.lit(v))
    placed = meta.withColumn("node", node).withColumn("shard", shard.cast("int"))
    cells = max(8, partitions_for(spark))
    placed = placed.withColumn("cell", F.pmod(F.col("tie"), F.lit(cells)).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("tie", "row"))
    return placed.join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + number - 1).cast("long").alias("slot"))

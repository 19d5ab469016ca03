"""Shared plumbing of the training-data operators: shared scratch tables, code shipping,
byte-level word splitting, and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table: A-Z to a-z, bytes of letters, digits and of non-ASCII characters stay, the rest become blanks.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes.lower and bytes.split are ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for a task (boundedly)."""

    def __missing__(self, w):
        if len(self) > 150_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def tidy(batches, *caches: dict):
    """The batches, and as the task ends the worker's memory goes back: workers live on and run other operators."""
    try:
        yield from batches
    finally:
        for c in caches:
            c.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark context, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tenderlens_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="tenderlens"), "tenderlens_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.join("tenderlens", os.path.relpath(os.path.join(d, n), top)))
        sc.addPyFile(path)
    sc._tenderlens_shipped = True
    # batches to Python workers are bounded by bytes too: texts may be very long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_tenderlens_scratch", None)
    if root is None:
        root = sc._tenderlens_scratch = "file://" + tempfile.mkdtemp(prefix="tenderlens-scratch")
        atexit.register(__import__("shutil").rmtree, root[7:], True)
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() deletes those that are needed no longer."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/tenderlens-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, "false")
        conf.set(key, "true")  # the shuffle files of this write go as it ends: its result is read from the table alone
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in dfs:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle width, the knob by which a cluster scales."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes (columns of bytes compress better than rows of numbers)."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * width, codec="zstd") if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def packed_up(x: np.ndarray) -> bytes:
    """Ascending unsigned longs, by their differences."""
    return packed(np.diff(x.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def unpacked_up(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def rows_of(batch: pa.RecordBatch, *cols: str):
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in cols]


def batch_of(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component root (least index) of each of n nodes under the links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


NODES = pa.schema([("id", pa.int64()), ("component_id", pa.int64())])
#: So many edges at most (16 MB) are finished by one task.
FINISH = 1_000_000


def _stars(batches):
    """Every node of all edges (a, b) of one task with the smallest node that it is joined to."""
    parts = [np.stack([b.column(i).cast(pa.int64()).to_numpy() for i in (0, 1)]) for b in batches]
    ids, at = np.unique(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64), return_inverse=True)
    at = at.reshape(2, -1)
    least = ids[forest(len(ids), at[0], at[1])]
    for k in range(0, len(ids), 100_000):
        yield batch_of(NODES, [ids[k : k + 100_000], least[k : k + 100_000]])


def components(edges: DataFrame, scratch: Scratch, finish: int = 0) -> DataFrame:
    """(id, component_id = smallest id reachable) for every node of ``edges(a, b)``, by alternating large-star and
    small-star contraction; every round is a pair of aggregations and joins whose result is written, nothing is collected.
    Once at most ``finish`` edges are left, one task ends the work by union-find, which gives the same rows: the rounds'
    many small shuffles would each cost the driver a thread. 0 stays with DataFrame functions to the end.
    Nodes are integers or, where ``finish`` is 0, of any ordered type; nulls and self links are ignored."""
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        if finish and now[0] <= finish:
            ship(scratch.spark)
            out = scratch.save(e.coalesce(1).mapInArrow(lambda it: tidy(_stars(it)), "id long, component_id long"))
            scratch.drop(e)
            return out
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        nxt = scratch.save(nxt.where("a <> b").distinct())
        scratch.drop(e)
        e = nxt
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    )

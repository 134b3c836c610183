"""Shared pieces: scratch tables in the cluster's shared folder, bounded key filters, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes handed to Python at once. Texts are a few KB on average, so a batch is a few MB.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Edges that one union-find task may hold; beyond that the star rounds take over.
UNION_FIND_EDGES = 500_000
#: Bits of a key filter (1 MB), whatever the number of keys.
FILTER_BITS = 1 << 23

#: The scratch tables of whoever called owned(), if anyone did.
_owner: ContextVar[Scratch | None] = ContextVar("owner", default=None)


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepare(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, as whole documents travel in them, unless they are set already.

    Results are computed after an operator returns, so the bounds stay for as long as the session."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) in ("10000", "67108864b"):  # Spark's defaults
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session of one machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="planeprint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# --- scratch tables -------------------------------------------------------------------------------------


class Scratch:
    """Scratch tables of one owner, which says when nothing needs them any more."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def drop(self) -> None:
        while self.paths:
            delete(*self.paths.pop())


@contextmanager
def owned(scratch: Scratch) -> Iterator[Scratch]:
    """Tables stored meanwhile belong to scratch. Others stay in the shared folder for as long as results may need them."""
    token = _owner.set(scratch)
    try:
        yield scratch
    finally:
        _owner.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    path_.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = spark_of(df)
    path = f"{shared_folder(spark)}/planeprint-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (owner := _owner.get()) is not None:
        owner.paths.append((spark, path))
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession) -> None:
    """Lets shuffle files of finished jobs go, which they do when the driver's references to them are collected; a long
    chain of jobs would otherwise keep all of them on the executors' disks.

    Spark's listener threads hold the last query that ended, shuffles included, until another one does: an empty one."""
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned and that no result which is still to be computed reads."""
    for t in tables:
        delete(spark_of(t), t._stored_at)


# --- memory of Python workers ---------------------------------------------------------------------------


def give_back() -> None:
    """Memory that this process no longer uses goes back to the machine: workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run):
    """run, the function of a mapInArrow or applyInArrow, which gives memory back whenever it ends."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def out(batches):
            yield from run(batches)
            give_back()
    else:

        @functools.wraps(run)
        def out(t: pa.Table) -> pa.Table:
            made = run(t)
            give_back()
            return made

    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128 bits of the text's SHA-256, as binary(16)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


# --- a filter on keys, of a fixed size ------------------------------------------------------------------


def key_slot(key: Column, bits: int = FILTER_BITS) -> Column:
    """The slot of a binary key whose first bytes are those of a hash."""
    return F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long") % bits


def key_filter(keys: DataFrame, column: str = "key", bits: int = FILTER_BITS):
    """Broadcast bitset of the slots of the keys: no key is missed, others pass by chance. Its size is fixed."""
    spark = spark_of(keys)
    words = (
        keys.select(key_slot(F.col(column), bits).alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("b"))
        .collect()  # bits / 64 rows at most
    )
    bitset = np.zeros(bits // 64, np.uint64)
    for w, b in words:
        bitset[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return spark.sparkContext.broadcast(bitset)


def number_filter(numbers: DataFrame, column: str, bits: int = 4 * FILTER_BITS):
    """The same for a column of 64-bit hashes, for many keys (4 MB)."""
    rows = numbers.select(F.pmod(F.col(column), F.lit(bits)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("b")).collect()
    bitset = np.zeros(bits // 64, np.uint64)
    bitset[[r.w for r in rows]] = np.array([r.b for r in rows], np.int64).view(np.uint64)
    return spark_of(numbers).sparkContext.broadcast(bitset)


def keep_numbers(df: DataFrame, numbers, column: str) -> DataFrame:
    at = df.columns.index(column)

    def run(batches):
        bitset = numbers.value
        for batch in batches:
            slot = np.mod(batch.column(at).to_numpy(), len(bitset) * 64)
            yield batch.filter(pa.array((bitset[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return df.mapInArrow(lean(run), df.schema)


def in_filter(bitset: np.ndarray, key: bytes) -> bool:
    slot = int.from_bytes(key[:4], "big") % (len(bitset) * 64)
    return bool(int(bitset[slot >> 6]) >> (slot & 63) & 1)


def keep_filtered(df: DataFrame, keys, column: str = "key") -> DataFrame:
    """The rows of df whose key is in the filter; runs where the rows are, without a shuffle."""
    at = df.columns.index(column)

    def run(batches):
        bitset = keys.value
        for batch in batches:
            yield batch.filter(pa.array([k is not None and in_filter(bitset, k) for k in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


# --- connected components -------------------------------------------------------------------------------


class UnionFind:
    """Union-find on 0..n-1; the root of a class is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def _forest(batches):
    """Edges of one partition to stars around the smallest node of each class found here."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    both = pa.concat_tables(tables).combine_chunks()
    n = both.num_rows
    if not n:
        return
    nodes = pa.chunked_array([*both.column(0).chunks, *both.column(1).chunks]).combine_chunks()
    import pyarrow.compute as pc

    names = pc.unique(nodes)
    names = names.take(pc.sort_indices(names))
    at = pc.index_in(nodes, names).to_numpy(zero_copy_only=False)
    uf = UnionFind(len(names))
    for a, b in zip(at[:n].tolist(), at[n:].tolist()):
        uf.union(a, b)
    roots = uf.roots()
    at = np.flatnonzero(roots != np.arange(len(roots)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), names.take(pa.array(roots[at]))], names=["a", "b"])


def components(edges: DataFrame, most: int = UNION_FIND_EDGES) -> DataFrame:
    """Connected components of edges(a, b) as rows (node, component): component is the smallest node of its class.

    Every partition first shrinks its edges to a spanning star forest. If what is left fits one bounded task
    (most edges) that task ends it; otherwise rounds of large-star and small-star (Kiveris et al. 2014) run
    until nothing changes, each round written to the shared folder. Nothing goes to the driver but counts.
    Nodes of no edge are not returned; null nodes and loops are dropped. Any orderable type of node will do."""
    kind = edges.schema[0].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    names = ["node", "component"]
    edges = edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    stars = stored(edges.mapInArrow(lean(_forest), schema), "forest")
    if (n := stars.count()) <= most:
        return stars.repartition(1).mapInArrow(lean(_forest), schema).toDF(*names) if n else stars.toDF(*names)
    while True:
        # large star: the greater neighbours of a node go to the smallest of its neighbourhood
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(small.where("a <> b").distinct(), "small")
        if not new.exceptAll(stars).limit(1).count() and not stars.exceptAll(new).limit(1).count():
            return new.toDF(*names)
        stars = new

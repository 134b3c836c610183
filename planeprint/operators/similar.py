"""Pairs of similar hashes: exact, by sampled bits, and by sampled bits in the original's enumeration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, numeric

#: Beyond this threshold the chunks of the stream's join are too short to tell hashes apart.
CHUNKED = 24
#: The same for the exact join, where comparing all costs little a pair.
SELECTIVE = 8
#: Rows of a block, two of which are compared at once, and the least number of tasks that tiles are dealt to.
BLOCK, TILE_TASKS = 4096, 48
#: Edges of a pack, and bytes of its pieces, of which Spark hands over thousands at once.
PACK, PIECE = 1 << 18, 4096
PIECES = "pack long, seq int, edges long, data binary"
#: The original's least number of pairs that it enumerates of a bucket.
LEAST_CAP = 10_000


def _near(a: str, b: str, threshold: int):
    c = lambda x: F.col(x)
    return native.hamming(c(f"{a}.w0"), c(f"{b}.w0"), c(f"{a}.w1"), c(f"{b}.w1")) < threshold


def chunks(bits: int, count: int) -> list[tuple[int, int]]:
    """Even parts (first bit, number of bits) of the live bits."""
    cuts = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _chunk(first: int, n: int):
    """Bits first to first + n - 1 of (w0, w1) as a number."""
    out = F.lit(0).cast("long")
    at = 0
    while n:
        word, shift = ("w0", first) if first < 64 else ("w1", first - 64)
        k = min(n, 64 - shift)
        mask = -1 if k == 64 else (1 << k) - 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit(mask).cast("long")), at))
        first, n, at = first + k, n - k, at + k
    return out


def exact_pairs(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """i, j, dist of all pairs of hashes(id, w0, w1) with dist < threshold, i < j.

    Multi-index hashing (Norouzi et al. 2012): hashes that differ in fewer than threshold bits agree in one of threshold
    chunks, so only hashes with a common chunk are compared, in tiles; beyond SELECTIVE all are. Bits are dealt to chunks
    in turn, as neighbouring bits of a transform say much the same. A pair is kept by its first common chunk alone, so
    there is nothing to deduplicate."""
    if threshold <= 0:
        return hashes.sparkSession.createDataFrame([], "i long, j long, dist int")
    return tiles(*_buckets(hashes, threshold, bits))


def exact_degrees(hashes: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """id, degree: of exact_pairs() how many an id is in, where that is any; counted in the tiles, so pairs are not rows."""
    if threshold <= 0:
        return hashes.sparkSession.createDataFrame([], "id long, degree long")
    counts = tiles(*_buckets(hashes, threshold, bits), degrees=True)
    return counts.groupBy("id").agg(F.sum("degree").alias("degree"))


def classes(hashes: DataFrame) -> DataFrame:
    """id, rep, w0, w1 of the distinct rows of hashes(id, w0, w1) without nulls: rep is the smallest id with the same hash,
    so those with id = rep stand for their class. An id with several hashes has a class of its own, with all of them."""
    rows = hashes.select(F.col("id").cast("long").alias("id"), "w0", "w1").where("id IS NOT NULL AND w0 IS NOT NULL AND w1 IS NOT NULL")
    same_id, word = Window.partitionBy("id"), F.struct("w0", "w1")
    rows = rows.withColumn("own", F.when(F.min(word).over(same_id) != F.max(word).over(same_id), F.col("id")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "w0", "w1").orderBy("id"))).where("k = 1").drop("k")
    reps = rows.groupBy("w0", "w1", "own").agg(F.min("id").alias("rep")).select(F.col("w0").alias("v0"), F.col("w1").alias("v1"), F.col("own").alias("o"), "rep")
    same = (F.col("w0") == F.col("v0")) & (F.col("w1") == F.col("v1")) & F.col("own").eqNullSafe(F.col("o"))
    return rows.join(reps, same).select("id", "rep", "w0", "w1")


def class_pairs(members: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """exact_pairs() of the representatives of members(id, rep, w0, w1), as classes() gives them."""
    return exact_pairs(members.where("id = rep").select("id", "w0", "w1"), threshold, bits)


def class_packs(members: DataFrame, threshold: int, bits: int = 64) -> DataFrame:
    """The pairs of class_pairs(), in packs."""
    hashes = members.where("id = rep").select("id", "w0", "w1")
    if threshold <= 0:
        return hashes.sparkSession.createDataFrame([], PIECES)
    return tiles(*_buckets(hashes, threshold, bits), packs=True)


def pieces(packs: Iterable[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES for a task's packs, (number of edges, arrays): a pack's bytes in rows that follow each other."""
    for k, (edges, arrays) in enumerate(packs):
        data = numeric.to_bytes(arrays)
        own = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
        name, first = (TaskContext.get().partitionId() << 32) + k, [edges] + [0] * (len(own) - 1)
        columns = (pa.array([name] * len(own), pa.int64()), pa.array(range(len(own)), pa.int32()), pa.array(first, pa.int64()), pa.array(own, pa.binary()))
        yield pa.RecordBatch.from_arrays(list(columns), names=["pack", "seq", "edges", "data"])


def read_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The arrays of pieces(), whose rows must have kept their order."""
    name, own = None, []
    for batch in batches:
        for pack, seq, data in zip(*(batch.column(c).to_pylist() for c in ("pack", "seq", "data"))):
            if seq == 0:
                if own:
                    yield numeric.from_bytes(b"".join(own))
                name, own = pack, []
            if pack != name or seq != len(own):
                raise ValueError("pieces of a pack are out of order")
            own.append(data)
    if own:
        yield numeric.from_bytes(b"".join(own))


def pack_edges(found: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """pieces() of edges (i, j, dist), which come in arrays of any length."""

    def packs():
        held, n = [], 0
        for edges in found:
            held.append(edges)
            n += len(edges[0])
            if n >= PACK:
                yield n, numeric.packed(*(np.concatenate(z) for z in zip(*held)))
                held, n = [], 0
        if n:
            yield n, numeric.packed(*(np.concatenate(z) for z in zip(*held)))

    return pieces(packs())


def unpacked(packs: DataFrame) -> DataFrame:
    """i, j of the edges of packs, i < j."""

    def run(batches):
        for ids, _, count, near, _ in read_packs(batches):
            i, j = np.repeat(ids, count), ids[near]
            yield pa.RecordBatch.from_arrays([pa.array(i[i < j]), pa.array(j[i < j])], names=["i", "j"])

    return packs.mapInArrow(run, "i long, j long")


def nearest_packed(packs: DataFrame) -> DataFrame:
    """cover.nearest() of the edges of packs: each pack knows the nearest that it has of a node."""

    def run(batches):
        for ids, best, _, _, dist in read_packs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best), pa.array(dist)], names=["id", "n", "dist"])

    rows = packs.mapInArrow(run, "id long, n long, dist int")
    return rows.groupBy("id").agg(F.min(F.struct("dist", "n")).alias("m")).select("id", F.col("m.n").alias("neighbour"), "m.dist")


def _buckets(hashes: DataFrame, threshold: int, bits: int) -> tuple[DataFrame, int, list[list[int]] | None]:
    """What tiles() takes, for exact_pairs()."""
    rows = hashes.select(F.col("id").cast("long").alias("id"), "w0", "w1").where("id IS NOT NULL AND w0 IS NOT NULL AND w1 IS NOT NULL")
    count = min(max(threshold, -(-bits // 64)), bits)
    block = F.pmod(F.xxhash64("id", "w0"), F.col("n")).cast("int")
    if threshold > min(SELECTIVE, bits):
        n = max(1, -(-rows.count() // BLOCK))
        return rows.withColumns({"k": F.lit(0), "c": F.lit(0).cast("long"), "n": F.lit(n)}).withColumn("g", block), threshold, None
    parts = [list(range(k, bits, count)) for k in range(count)]
    rows = rows.select("*", F.posexplode(F.array(*(native.lsh_key(F.col("w0"), F.col("w1"), p) for p in parts))).alias("k", "c"))
    sizes = rows.groupBy("k", "c").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, ["k", "c"]).withColumn("n", F.ceil(F.col("size") / BLOCK).cast("int"))
    return rows.withColumn("g", block), threshold, parts


def tiles(rows: DataFrame, threshold: int, parts: list[list[int]] | None = None, degrees: bool = False, packs: bool = False) -> DataFrame:
    """i, j, dist of the pairs i < j within each bucket (k, c) of rows(k, c, g, n, id, w0, w1) with dist < threshold. A
    bucket is cut into n blocks g of about BLOCK rows; every two blocks, and each by itself, are a tile, compared at once
    in numpy. So no bucket is too large for a task, and a hash is sent once to each tile of its block.

    With parts, bit positions by k, a pair is left out that agrees in a part before k. With a column rank only pairs of
    ranks r < s <= 2 r + 1 count. With degrees the result is id, degree instead: in how many of a tile's pairs a row is.
    With packs it is packs of the pairs, which are never rows."""
    ranked = "rank" in rows.columns
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("h")
    out = rows.select("k", "c", "g", "id", "w0", "w1", (F.col("rank") if ranked else F.lit(0)).cast("long").alias("rank"), other)
    out = out.select("k", "c", F.least("g", "h").alias("x"), F.greatest("g", "h").alias("y"), (F.col("g") <= F.col("h")).alias("left"), "id", "w0", "w1", "rank")
    if ranked:  # a block has ranks from g * BLOCK
        out = out.where((F.col("y") * BLOCK) <= 2 * (F.col("x") * BLOCK + BLOCK - 1) + 1)
    masks = [[np.int64(sum(1 << (p % 64) for p in part if p // 64 == w) - (1 << 64 if 63 + 64 * w in part else 0)) for w in (0, 1)] for part in parts or []]

    def tile(k, x, y, left, ids, words, rank):
        a, b = (np.flatnonzero(left), np.flatnonzero(~left)) if x != y else (np.arange(len(ids)), None)
        number, ends = np.zeros(len(ids) if degrees else 0, np.int64), []
        for r, c, d in numeric.near_pairs(words[a], None if b is None else words[b], threshold):
            r, c = a[r], (a if b is None else b)[c]
            if ranked:
                low, high = np.minimum(rank[r], rank[c]), np.maximum(rank[r], rank[c])
                keep = high <= 2 * low + 1
            else:
                keep = ids[r] != ids[c]
            if k and masks:
                differ = words[r] ^ words[c]
                for m, n in masks[:k]:
                    keep &= ((differ[:, 0] & m) | (differ[:, 1] & n)) != 0
            if degrees:
                ends += [r[keep], c[keep]]
                if len(r) > BLOCK:
                    number, ends = number + np.bincount(np.concatenate(ends), minlength=len(ids)), []
            elif keep.any():
                r, c, d = ids[r[keep]], ids[c[keep]], d[keep].astype(np.int32)
                if packs:
                    yield r, c, d
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(r, c)), pa.array(np.maximum(r, c)), pa.array(d)], names=["i", "j", "dist"])
        if ends:
            number += np.bincount(np.concatenate(ends), minlength=len(ids))
        if number.any():
            own = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(number[own])], names=["id", "degree"])

    def run(batches):
        """Tiles come one after the other; the last of a batch may go on in the next."""
        held = None
        for batch in batches:
            new = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            held = new if held is None else [np.concatenate(z) for z in zip(held, new)]
            if not len(held[0]):
                continue
            cuts = np.flatnonzero(np.any([z[1:] != z[:-1] for z in held[:4]], axis=0)) + 1
            yield from each(held, [0, *cuts.tolist()])
            held = [z[cuts[-1] if len(cuts) else 0 :] for z in held]
        if held is not None and len(held[0]):
            yield from each(held, [0, len(held[0])])

    def each(held, cuts):
        k, _, x, y, left, ids, w0, w1, rank = held
        words = np.stack([w0, w1], axis=1)
        for s, e in zip(cuts, cuts[1:]):
            if e - s > 1:
                yield from tile(int(k[s]), x[s], y[s], left[s:e], ids[s:e], words[s:e], rank[s:e])

    keys = ["k", "c", "x", "y"]
    number = max(TILE_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = out.repartition(number, *keys).sortWithinPartitions(*keys)
    if packs:
        return out.mapInArrow(lambda batches: pack_edges(run(batches)), PIECES)
    return out.mapInArrow(run, "id long, degree long" if degrees else "i long, j long, dist int")


def lsh_keys(hashes: DataFrame, tables: int = 32, bits: int = 8) -> DataFrame:
    """id, w0, w1, tbl, key: the sampled bits of each hash, for each table."""
    keys = F.array(*(native.lsh_key(F.col("w0"), F.col("w1"), p) for p in numeric.bit_positions(tables, bits)))
    return hashes.select("id", "w0", "w1", F.posexplode(keys).alias("tbl", "key"))


def lsh_buckets(keys: DataFrame) -> DataFrame:
    """keys with the size of their bucket and their rank in it, by id from 0."""
    w = Window.partitionBy("tbl", "key")
    return keys.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy("id")) - 1)


def lsh_pairs(hashes: DataFrame, threshold: int, tables: int = 32, bits: int = 8) -> DataFrame:
    """All pairs that share a bucket: a part of exact_pairs()."""
    keys = lsh_keys(hashes, tables, bits)
    a, b = keys.alias("a"), keys.alias("b")
    near = a.join(b, (F.col("a.tbl") == F.col("b.tbl")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & _near("a", "b", threshold))
    dist = native.hamming(F.col("a.w0"), F.col("b.w0"), F.col("a.w1"), F.col("b.w1")).cast("int")
    return near.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), dist.alias("dist")).distinct()


def lsh_reference_pairs(hashes: DataFrame, threshold: int, tables: int = 32, bits: int = 8, cap: int | None = None) -> DataFrame:
    """The pairs that the original's enumeration reaches: of a bucket of s, index p = 0, step, 2 step ... below s(s-1)/2, with
    step the number of indexes by cap, is the pair of ranks (i, p - i(i+1)/2 + i + 1), i being the root of p.

    Of a bucket with no more pairs than cap these are the ranks i < j <= 2 i + 1, which are compared in tiles; of others
    the indexes are made, cap of them. cap, unless given, is the original's: a tenth of the number of hashes, LEAST_CAP at
    least."""
    if cap is None:
        cap = max(LEAST_CAP, hashes.count() // 10)
    hashes = hashes.where("id IS NOT NULL AND w0 IS NOT NULL AND w1 IS NOT NULL")
    keys = lsh_keys(hashes, tables, bits)
    total = (F.col("size") * (F.col("size") - 1) / 2).cast("long")
    ranked = lsh_buckets(keys).where("size > 1").withColumn("total", total)
    whole = ranked.where(F.col("total") <= cap).select(F.col("tbl").alias("k"), F.col("key").alias("c"), F.floor(F.col("rank") / BLOCK).cast("int").alias("g"), F.ceil(F.col("size") / BLOCK).cast("int").alias("n"), F.col("id").cast("long").alias("id"), "w0", "w1", "rank")
    found = tiles(whole, threshold)
    sizes = keys.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("size")).withColumn("total", total).where(F.col("total") > cap)
    if sizes.isEmpty():
        return found.distinct()
    sizes = sizes.withColumn("n", F.lit(cap).cast("long")).withColumn("step", F.floor(F.col("total") / F.col("n")))
    at = sizes.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("p", F.col("q") * F.col("step"))
    root = F.floor((F.sqrt(8.0 * F.col("p") + 1) - 1) / 2)
    root = root - F.when(root * (root + 1) / 2 > F.col("p"), 1).otherwise(0) + F.when((root + 1) * (root + 2) / 2 <= F.col("p"), 1).otherwise(0)
    at = at.withColumn("ri", root).withColumn("rj", (F.col("p") - F.col("ri") * (F.col("ri") + 1) / 2 + F.col("ri") + 1).cast("long")).where("rj < size")
    x = ranked.select("tbl", "key", F.col("rank").alias("ri"), F.col("id").alias("x"), F.col("w0").alias("x0"), F.col("w1").alias("x1"))
    y = ranked.select("tbl", "key", F.col("rank").alias("rj"), F.col("id").alias("y"), F.col("w0").alias("y0"), F.col("w1").alias("y1"))
    dist = native.hamming(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).cast("int")
    near = at.join(x, ["tbl", "key", "ri"]).join(y, ["tbl", "key", "rj"]).withColumn("dist", dist).where(F.col("dist") < threshold)
    return near.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "dist").unionByName(found).distinct()


def find_pairs(hashes: DataFrame, threshold: int = 5, pairs: str = "exact", bits: int = 64, tables: int = 32, bits_per_table: int = 8) -> DataFrame:
    if pairs == "exact":
        return exact_pairs(hashes, threshold, bits)
    return {"lsh": lsh_pairs, "lsh_reference": lsh_reference_pairs}[pairs](hashes, threshold, tables, bits_per_table)

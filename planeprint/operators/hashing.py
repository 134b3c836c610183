"""Planes to hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, numeric
from ..options import HashOptions


def compute_hashes(planes: DataFrame, options: HashOptions = HashOptions()) -> DataFrame:
    """planes(..., luma, width, height) with w0, w1, n_bits, hash_hex and reason in place of luma. Rows that can't be
    hashed stay, with null words and a reason. One narrow stage; batches go to numpy as Arrow."""
    keep = [f for f in planes.schema.fields if f.name != "luma"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", w0 long, w1 long"
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            found = numeric.hash_planes(list(zip(*(column[c].to_pylist() for c in ("luma", "width", "height")))), options)
            w = [pa.array([None if x is None else x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(column[n] for n in names), *w], names=[*names, "w0", "w1"])

    out = planes.mapInArrow(run, schema)
    given = F.col("reason") if "reason" in names else F.lit(None).cast("string")
    out = out.withColumn("reason", F.when(F.col("w0").isNull(), F.coalesce(given, F.lit("plane does not match its sides"))))
    return out.withColumn("n_bits", F.lit(options.bits)).withColumn("hash_hex", native.hash_hex(F.col("w0"), F.col("w1"), options.bits))


def compute_coefficients(planes: DataFrame, key: str, options: HashOptions = HashOptions()) -> DataFrame:
    """planes(key, luma, width, height) to key, t and c: of each row the coefficients of its whole plane, resampled and
    transformed. A row whose plane does not match its sides, or has none, has null coefficients."""
    kind = planes.schema[key].dataType.simpleString()
    n, h = options.bits, options.hash_size

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            items = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
            found = numeric.plane_coefficients(items, h, options.freq_factor, options.transform)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(items)), n)))
            c = [x for f in found for x in ([None] * n if f is None else f.tolist())]
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(range(n)) * len(items), pa.int32()), pa.array(c, pa.float64())], names=[key, "t", "c"])

    return planes.select(key, "luma", "width", "height").mapInArrow(run, f"`{key}` {kind}, t int, c double")


def coefficients_relational(cells: DataFrame, side: int, h: int, transform: str = "reference") -> DataFrame:
    """cells(id, y, x, v) of side x side planes to coefficients (id, t, c), by two joins with the basis and two sums.

    The basis has h * side rows, whatever the planes, and is broadcast."""
    spark = cells.sparkSession
    rows = numeric.low_rows(side, h, transform)
    basis = F.broadcast(spark.createDataFrame([(i, j, float(rows[i, j])) for i in range(h) for j in range(side)], "k int, p int, b double"))
    left = cells.join(basis, cells.y == basis.p).groupBy("id", "k", "x").agg(F.sum(F.col("v") * F.col("b")).alias("v")).withColumnRenamed("k", "row")
    both = left.join(basis, left.x == basis.p).groupBy("id", "row", "k").agg(F.sum(F.col("v") * F.col("b")).alias("c"))
    return both.select("id", (F.col("row") * h + F.col("k")).alias("t"), F.when((F.col("row") == 0) & (F.col("k") == 0), 0.0).otherwise(F.round("c", numeric.ROUND)).alias("c"))


def words_relational(coef: DataFrame) -> DataFrame:
    """coef(id, t, c) to (id, w0, w1): exact median and a bitwise sum of the bits above it."""
    mid = coef.groupBy("id").agg(F.expr("percentile(c, 0.5)").alias("m"))
    set_ = coef.join(mid, "id").where("c > m")
    one = F.expr("shiftleft(1L, t % 64)")
    bits = set_.groupBy("id").agg(F.bit_or(F.when(F.col("t") < 64, one).otherwise(F.lit(0).cast("long"))).alias("w0"), F.bit_or(F.when(F.col("t") >= 64, one).otherwise(F.lit(0).cast("long"))).alias("w1"))
    zero = F.lit(0).cast("long")
    return mid.select("id").join(bits, "id", "left").select("id", F.coalesce("w0", zero).alias("w0"), F.coalesce("w1", zero).alias("w1"))


def with_dense_ids(hashes: DataFrame, path: str = "path") -> DataFrame:
    """The hashed rows with id: the rank of their path from 0. Ranks are taken in ranges of the sorted paths, whose
    sizes are summed up before, so no task sorts everything."""
    good = hashes.where("w0 IS NOT NULL")
    parts = good.repartitionByRange(path).withColumn("__part", F.spark_partition_id())
    parts = parts.checkpoint() if good.sparkSession.sparkContext.getCheckpointDir() else parts.persist()
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # a row for each partition
    base, at = [], 0
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    starts = F.broadcast(good.sparkSession.createDataFrame(base or [(0, 0)], "__part int, __base long"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(path)) - 1
    return parts.withColumn("__r", rank).join(starts, "__part").withColumn("id", F.col("__base") + F.col("__r")).drop("__part", "__r", "__base")

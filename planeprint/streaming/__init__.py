"""Planes that arrive as files: hashed as a stream, and joined with the hashes stored so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators import similar
from ..operators.hashing import compute_hashes
from ..options import HashOptions


def hash_stream(spark: SparkSession, folder: str, schema: str, options: HashOptions = HashOptions()) -> DataFrame:
    """A stream of hashes from Parquet files of planes (luma, width, height and more). The projection has no state."""
    return compute_hashes(spark.readStream.schema(schema).parquet(folder), options)


def store_and_match(hashes: DataFrame, store: str, matches: str, checkpoint: str, threshold: int = 5, key: str = "path", bits: int = 64):
    """Starts a query that writes each batch's hashes to store and its pairs with stored ones, and within it, to matches.

    Pairs meet by chunks of the live bits alone: hashes of bits bits that differ in fewer than threshold agree in one."""
    if threshold > similar.CHUNKED:
        raise ValueError(f"the stream's join takes thresholds up to {similar.CHUNKED}")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df = df.where("w0 IS NOT NULL").select(key, "w0", "w1")
        df.write.mode("overwrite").parquet(f"{store}/batch={number}")
        try:
            old = spark.read.parquet(store).where(F.col("batch") <= number).select(F.col(key).alias("old"), F.col("w0").alias("o0"), F.col("w1").alias("o1"), "batch")
        except Exception as e:  # nothing but empty batches so far
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return
        new = spark.read.schema(df.schema).parquet(f"{store}/batch={number}")
        cut = F.posexplode(F.array(*(similar._chunk(a, n) for a, n in similar.chunks(bits, max(1, min(threshold, bits)))))).alias("k", "c")
        x = new.select("*", cut)
        y = old.select("old", F.col("o0").alias("w0"), F.col("o1").alias("w1"), "batch").select("*", cut).withColumnsRenamed({"w0": "o0", "w1": "o1"})
        dist = native.hamming(F.col("w0"), F.col("o0"), F.col("w1"), F.col("o1")).cast("int")
        pairs = x.join(y, ["k", "c"]).where((F.col("batch") < number) | (F.col("old") < F.col(key))).withColumn("dist", dist)
        pairs.where(F.col("dist") < threshold).select(key, "old", "dist").distinct().write.mode("overwrite").parquet(f"{matches}/batch={number}")

    return hashes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()

"""Image files as rows.

Spark's file sources skip empty files and names that begin with '.' or '_'. Both are listed here (by the file system, on
the driver, names only) and come out as rows with a reason, like files that can't be decoded.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of red, green and blue in luma.
RED, GREEN, BLUE = 0.299, 0.587, 0.114


def suffix(name: str) -> str:
    m = re.search(r"[^/]\.([^./]+)$", name)
    return m[1].lower() if m else ""


def list_files(spark: SparkSession, directory: str, extensions: list[str] | None = None, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of the regular files, sorted by path; folders that can't be read are passed over. No extensions: all.

    Raises FileNotFoundError if there is nothing."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(directory)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    out, folders, first = [], [top], True
    while folders:
        try:
            entries = fs.listStatus(folders.pop())
        except Exception as e:
            if first:
                raise FileNotFoundError(f"can't list {directory}: {e}") from e
            continue
        first = False
        for s in entries:
            if s.isDirectory():
                if recursive:
                    folders.append(s.getPath())
            elif s.isFile():
                path = s.getPath().toString()
                if not extensions or suffix(path) in extensions:
                    out.append((path, s.getLen()))
    if not out:
        raise FileNotFoundError(f"no images in {directory}")
    return sorted(out, key=lambda x: x[0].encode())


def luma(image: DataFrame) -> DataFrame:
    """image(path, image) of Spark's image source to path, luma, width, height; null luma where decoding failed."""

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                data = None
                if x and x["height"] > 0 and x["data"] is not None:
                    raw = np.frombuffer(x["data"], np.uint8)
                    if x["nChannels"] == 1:
                        data = raw.tobytes()
                    elif x["nChannels"] in (3, 4):
                        c = raw.reshape(-1, x["nChannels"]).astype(float)
                        data = np.clip(np.rint(BLUE * c[:, 0] + GREEN * c[:, 1] + RED * c[:, 2]), 0, 255).astype(np.uint8).tobytes()
                out.append((data, x["width"] if data is not None else None, x["height"] if data is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int32(), pa.int32())))], names=["path", "luma", "width", "height"])

    return image.mapInArrow(run, "path string, luma binary, width int, height int")


def read_images(spark: SparkSession, directory: str, extensions: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """path, file_size, luma, width, height, reason: a row for each listed file."""
    listed = list_files(spark, directory, extensions, recursive)
    files = spark.createDataFrame(listed, "path string, file_size long")
    readable = [p for p, n in listed if n > 0 and p.rsplit("/", 1)[-1][0] not in "._"]
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    if readable:
        images = spark.read.format("image").option("dropInvalid", False).load(readable)
        decoded = luma(images.select(F.url_decode(F.regexp_replace("image.origin", "\\+", "%2B")).alias("path"), "image"))
    else:
        decoded = spark.createDataFrame([], "path string, luma binary, width int, height int")
    decoded = decoded.withColumn("__p", plain).drop("path")
    out = files.withColumn("__p", plain).join(decoded, "__p", "left").drop("__p")
    reason = F.when(F.col("file_size") == 0, "empty file").when(F.col("luma").isNull(), "not decoded")
    return out.withColumn("reason", reason)

"""Planes from columns of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_planes(rows: DataFrame, key: str, text: str, width: int = 64, *also: str) -> DataFrame:
    """path, luma, width, height, and columns also of rows: the UTF-8 bytes of a text, width a row, the last row filled up with zeros."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(data)
    w = F.least(F.lit(width), n)
    h = F.when(n > 0, F.ceil(n / w)).otherwise(F.lit(0)).cast("int")
    full = F.rpad(data, F.when(n > 0, w * h).otherwise(F.lit(0)).cast("int"), F.lit(b"\0"))
    return rows.select(F.lpad(F.col(key).cast("string"), 12, "0").alias("path"), full.alias("luma"), w.cast("int").alias("width"), h.alias("height"), *also)

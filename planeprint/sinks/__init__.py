"""CSV files, console reports and deletion."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.native import size_label

PREVIEW, LISTED = 5, 20


def write_hashes(hashes: DataFrame, folder: str) -> None:
    """filepath, phash_hex by path, one file with a header; failed rows aren't in it."""
    rows = hashes.where("hash_hex IS NOT NULL").select(F.col("path").alias("filepath"), F.col("hash_hex").alias("phash_hex"))
    rows.orderBy("filepath").coalesce(1).write.mode("overwrite").option("quoteAll", True).csv(folder, header=True)


def write_similar(similar: DataFrame, folder: str) -> None:
    rows = similar.select(F.col("path").alias("image_file"), "similar_to", F.col("dist").alias("estimated_difference"))
    rows.orderBy("image_file").coalesce(1).write.mode("overwrite").option("quoteAll", True).csv(folder, header=True)


def preview(hashes: DataFrame, n: int = PREVIEW) -> list[str]:
    rows = hashes.where("hash_hex IS NOT NULL").orderBy("path").limit(n).select("path", "hash_hex").collect()
    return [f"{os.path.basename(r.path) or '<unnamed>'}: {r.hash_hex}" for r in rows]


def report(similar: DataFrame, everything: bool = False) -> list[str]:
    """The first 20 rows (or all), how many more there are, the total and its bytes."""
    total, size = similar.agg(F.count(F.lit(1)), F.sum("file_size")).first()
    rows = similar.orderBy("path")
    shown = (rows if everything else rows.limit(LISTED)).select("path", "similar_to", "dist").collect()
    lines = [f"{r.path} ~ {r.similar_to} ({r.dist})" for r in shown]
    if total > len(shown):
        lines.append(f"... and {total - len(shown):,} more")
    return [*lines, f"{total:,} similar images, {size_label(size or 0)}"]


def stage_counts(hashes: DataFrame) -> DataFrame:
    """stage, n: listed, hashed and failed files."""
    failed = F.count_if(F.col("w0").isNull())
    one = hashes.agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("w0").isNotNull()).alias("hashed"), failed.alias("failed"))
    return one.unpivot([], ["listed", "hashed", "failed"], "stage", "n")


def yes(answer: str | None) -> bool:
    """Whether a prompt was agreed to; no answer is no."""
    return bool(answer) and answer.strip()[:1] in ("y", "Y", "1")


def delete(similar: DataFrame, options, ask=input, remove=os.remove) -> tuple[int, int]:
    """(files, bytes) removed. Nothing goes without auto_delete or interactive, with print_only, or in a dry run."""
    if options.print_only or not (options.auto_delete or options.interactive):
        return 0, 0
    rows = similar.orderBy("path").select("path", "file_size").toLocalIterator()
    if options.auto_delete and not options.dry_run and not yes(ask("Delete all similar images? [y/N] ")):
        return 0, 0
    files = size = 0
    for r in rows:
        if options.interactive:
            answer = (ask(f"Delete {r.path}? [y/n/q] ") or "").strip().lower()[:1]
            if answer == "q":
                break
            if not yes(answer):
                continue
        if not options.dry_run:
            remove(r.path.removeprefix("file:"))
        files, size = files + 1, size + (r.file_size or 0)
    return files, size

"""python -m planeprint.cli hash|similar: the command line."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from . import sinks
from .operators.cover import find_similar
from .operators.hashing import compute_hashes, with_dense_ids
from .options import CommandOptions
from .sources.files import read_images

LEVELS = {1: logging.ERROR, 2: logging.WARNING, 3: logging.INFO, 4: logging.DEBUG}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="planeprint")
    commands = top.add_subparsers(dest="command")
    for name in ("hash", "similar"):
        p = commands.add_parser(name)
        p.add_argument("-d", "--directory", required=True)
        p.add_argument("-e", "--extensions", default="jpg,jpeg")
        p.add_argument("-r", "--recursive", action="store_true")
        for flags, default in ((("-b", "--batch-size"), 500), (("-T", "--threads"), -1), (("--prefetch-factor",), 8), (("-l", "--log-level"), 4), (("-hs", "--hash-size"), 8), (("-f", "--freq-factor"), 4)):
            p.add_argument(*flags, type=int, default=default)
        p.add_argument("-o", "--output", default="")
        if name == "similar":
            p.add_argument("-t", "--threshold", type=int, default=5)
            p.add_argument("--num-tables", type=int, default=32)
            p.add_argument("--bits-per-table", type=int, default=8)
            p.add_argument("--pairs", choices=("exact", "lsh", "lsh_reference"), default="exact")
            p.add_argument("-a", "--auto-delete", action="store_true")
            p.add_argument("-i", "--interactive", action="store_true")
            p.add_argument("-p", "--print-only", action="store_true")
            p.add_argument("--dry-run", action="store_true")
    return top


def run(spark: SparkSession, options: CommandOptions, ask=input, out=print) -> None:
    images = read_images(spark, options.directory, options.extension_list, options.recursive)
    hashes = compute_hashes(images, options.hashing()).persist()
    if options.command == "hash":
        for line in sinks.preview(hashes):
            out(line)
        for r in sinks.stage_counts(hashes).collect():
            out(f"{r.stage}: {r.n}")
        if options.output:
            sinks.write_hashes(hashes, options.output)
        return
    similar = find_similar(with_dense_ids(hashes), options.threshold, options.pairs, options.hash_size**2, options.num_tables, options.bits_per_table).persist()
    if not similar.limit(1).count():
        out("no similar images")
        return
    if options.output:
        sinks.write_similar(similar, options.output)
    for line in sinks.report(similar, options.print_only):
        out(line)
    files, size = sinks.delete(similar, options, ask)
    if files:
        out(f"{files} files, {sinks.size_label(size)} {'would go' if options.dry_run else 'deleted'}")


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if not args.command:
        return 1
    try:
        options = CommandOptions(**vars(args))
        logging.basicConfig(level=LEVELS[options.log_level])
        logging.getLogger("py4j").setLevel(logging.WARNING)
        run(SparkSession.builder.appName("planeprint").getOrCreate(), options)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

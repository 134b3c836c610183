"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A canonical URL here is host/path with the host in lower case, without scheme, query and fragment. A list entry (rule)
is a canonical URL cut short: it fits its host and all subdomains, and all paths that begin with its path. Every
URL is therefore looked up under each of its parent domains with each length of path that occurs in the list. The
Bloom filter has blocks of 64 bits and a size that is set, not
grown, so what is broadcast is bounded; what passes it is joined exactly, and of the rules that fit the longest wins.

A list that names one rule with several verdicts gives it the first in order, so allow goes before block. An entry without
a path means the host's root; null entries are left out.

Null, relative and malformed URLs have empty host and path and fit no rule. Equal URLs are judged once. Other
columns of the pages are ignored; ids may be null or repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the Bloom filter (4 MB) and bits that a key sets in its block of 64.
BLOOM_BITS, BLOOM_KEYS = 1 << 25, 6
#: The rules that come with the operator's contract; a rule's name is host + path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Listed hosts that are blocked where no rule fits; all else is allowed.
LISTED = ("cheap-pills.example.com/", "cheap-pills.example.net/", "cheap-pills.example.org/")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _mask(h: Column) -> Column:
    """BLOOM_KEYS bits of a word, chosen by the low 36 bits of the hash."""
    mask = F.lit(0).cast("long")
    for k in range(BLOOM_KEYS):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, int(shiftrightunsigned(__h, {6 * k}) & 63))"))
    return mask


def bloom(keys: DataFrame, column: str, bits: int = BLOOM_BITS):
    """Broadcast filter of the keys: bits / 64 words, whatever the number of keys."""
    spark = common.spark_of(keys)
    words = bits // 64
    rows = (
        keys.select(key_hash(F.col(column)).alias("__h"))
        .select(F.pmod(F.shiftrightunsigned("__h", 36), F.lit(words)).alias("w"), _mask(F.col("__h")).alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .collect()
    )
    out = np.zeros(words, np.uint64)
    for w, m in rows:
        out[w] = np.uint64(m & 0xFFFFFFFFFFFFFFFF)
    return spark.sparkContext.broadcast(out)


def _may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = h.view(np.uint64)
    mask = np.zeros(len(u), np.uint64)
    for k in range(BLOOM_KEYS):
        mask |= np.uint64(1) << ((u >> np.uint64(6 * k)) & np.uint64(63))
    return (table[(u >> np.uint64(36)) % np.uint64(len(table))] & mask) == mask


def best_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, name, verdict: of each distinct url of pages the longest rule of rules(name, verdict) that fits, if any."""
    name = F.when(F.instr("name", "/") == 0, F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    rules = rules.where("name IS NOT NULL").groupBy(name.alias("name")).agg(F.min("verdict").alias("verdict"))
    path_at = F.instr("name", "/")
    lengths = [r.n for r in rules.select((F.char_length("name") - path_at + 1).alias("n")).distinct().collect()]  # of paths in the list
    if not lengths:
        return pages.select("url", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("verdict")).where("false")
    table = bloom(rules, "name")
    urls = pages.select("url").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).where("host <> ''")
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)))
    keys = urls.select("url", F.explode(domains).alias("domain"), F.filter(starts, lambda x: x.isNotNull()).alias("starts"))
    keys = keys.select("url", F.explode("starts").alias("start"), "domain").select("url", F.concat("domain", "start").alias("key"))
    keys = keys.withColumn("h", key_hash(F.col("key")))

    def run(batches):
        held = table.value
        for batch in batches:
            keep = _may_hold(held, batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["url", "key"]).filter(pa.array(keep))

    hits = keys.mapInArrow(common.lean(run), "url string, key string")
    exact = hits.join(rules, hits.key == rules.name)
    return exact.groupBy("url").agg(F.max(F.struct(F.char_length("name").alias("n"), "name", "verdict")).alias("m")).select("url", "m.name", "m.verdict")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url).

    rules decide where one fits; else a page is blocked if listed(name, verdict) blocks it, and allowed otherwise."""
    both = rules.select("name", "verdict", F.lit(True).alias("own")).unionByName(listed.select("name", "verdict", F.lit(False).alias("own")))
    by_rule = best_rule(pages, both.where("own")).select(F.col("url").alias("u1"), F.col("name").alias("rule"), F.col("verdict").alias("v1"))
    by_list = best_rule(pages, both.where("NOT own")).select(F.col("url").alias("u2"), F.col("verdict").alias("v2"))
    out = pages.select("page_id", "url").join(by_rule, F.col("url") == F.col("u1"), "left").join(by_list, F.col("url") == F.col("u2"), "left")
    return out.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("v1", "v2", F.lit("allow")).alias("verdict"))

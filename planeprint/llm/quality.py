"""Quality rules by host: failures are summed by host, rates shrunk with an empirical beta prior, verdicts joined back.

All of it is SQL expressions on the JVM; no Python touches a row. A document is judged twice. By the base rules: too few
words, or too many of them in 8-word windows that come again in the text. By its host (the column source): the share
of the host's documents that fail any rule, drawn towards the corpus' share by a beta prior whose weight is fitted by
moments to the spread between hosts, so that a host of a few documents isn't judged by these alone.

Null or empty text has no words and fails. A null host is a host of its own. Ids aren't used and may be null or repeat.
Internal columns start with __q_, so columns of the input keep their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: White space between words.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A host whose shrunk rate of failing documents is above this is rejected as a whole.
HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR = (1.0, 1e6)


def _size(x) -> Column:
    return F.size(x).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __q_words (number), __q_word_chars, __q_symbols, __q_dup_lines, __q_repeat_words, __q_base, __q_fails.

    Each step's arrays are columns of their own, so that no expression is evaluated once per element."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns(
        {
            "__q_w": F.filter(F.split(t, SPLIT), lambda x: x != ""),
            "__q_lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
            "__q_word_chars": F.char_length(F.translate(t, SPACES, "")).cast("long"),
            "__q_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        }
    )
    # the windows' hashes; most texts have no two alike and end here
    windows = F.when(F.size("__q_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__q_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__q_w", i, WINDOW))))
    out = out.withColumns({"__q_words": _size("__q_w"), "__q_dup_lines": _size("__q_lines") - _size(F.array_distinct("__q_lines")), "__q_h": windows}).drop("__q_w", "__q_lines")
    # windows sorted by hash; those next to an equal one come again
    ordered = F.when(F.size(F.array_distinct("__q_h")) < F.size("__q_h"), F.sort_array(F.transform("__q_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn("__q_s", ordered).drop("__q_h")
    again = F.filter("__q_s", lambda x, i: (F.get("__q_s", i - 1)["h"] == x["h"]) | (F.get("__q_s", i + 1)["h"] == x["h"]))
    out = out.withColumn("__q_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("__q_s")
    # words covered: each window adds what the one before it doesn't cover
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("__q_at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    out = out.withColumn("__q_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__q_at")
    n = F.col("__q_words")
    out = out.withColumn("__q_base", (n < 20) | (100 * F.col("__q_repeat_words") > 30 * n))
    rules = F.col("__q_base") | (10 * F.col("__q_symbols") > n) | (F.col("__q_word_chars") < 2 * n) | (F.col("__q_word_chars") > 20 * n)
    return out.withColumn("__q_fails", rules)


def host_verdicts(judged: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """host, docs, failures, rate (shrunk) and rejected, of what features() returns."""
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.count_if("__q_fails").alias("failures"))
    f, n = F.col("failures").cast("double"), F.col("docs").cast("double")
    total, failed, squares = hosts.agg(F.sum(n), F.sum(f), F.sum(f * f / n)).first()
    mean = failed / total if total else 0.0
    spread = squares / total - mean * mean if total else 0.0
    weight = min(max(mean * (1 - mean) / spread - 1, PRIOR[0]), PRIOR[1]) if spread > 1e-12 else PRIOR[1]
    shrunk = (f + mean * weight) / (n + weight)
    return hosts.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """docs with the columns of features() and __q_kept. What is read is read once: features are stored."""
    judged = common.stored(features(docs, text), "quality")
    bad = host_verdicts(judged, host, rate).where("rejected").select(F.col("host").alias("__q_host"), F.lit(True).alias("__q_bad"))
    out = judged.join(bad, judged[host].eqNullSafe(F.col("__q_host")), "left")
    return out.withColumn("__q_kept", ~F.col("__q_base") & F.col("__q_bad").isNull()).drop("__q_host", "__q_bad")


def keep_good(docs: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """The rows of docs that neither the base rules nor their host's verdict reject, columns as before."""
    return judge(docs, rate=rate).where("__q_kept").select(*docs.columns)

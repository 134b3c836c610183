"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. A budget of tokens goes from the root to the leaves by weight. A child
that can't use its share (its documents, read at most max_epochs times, have fewer tokens) is filled, and the rest goes to
its siblings by weight; only what a whole subtree can't use has moved to the subtree's siblings, as a node's capacity is
the sum of its children's. At a leaf, whole epochs are taken first and then a prefix, in tokens, of the next
epoch's order, which a seed shuffles anew for each epoch. The last document of the prefix may be taken in part.

All of it is DataFrame functions. Sums along the order are taken in two steps, over 4096 ranges of the shuffling hash and
within a range, so a leaf with any share of all rows is spread over that many groups.

Null or empty text has no tokens and is never taken. Null languages and sources are nodes of their own. Rows that repeat
an id are shuffled alike. Weights of values that aren't listed are 1, weights of 0 or less take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Target weights in production, by level.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, "source": {}}


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo 4; sources without a number are in d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(number != "", number.cast("long") % 4), F.lit(0)).cast("string"))


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    value = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        value = F.when(F.col(level) == name, F.lit(float(w))).otherwise(value)
    return value


def leaves_of(rows: DataFrame, weights, max_epochs: int) -> DataFrame:
    """A row for each leaf: the levels, tokens, and for each level k the weight w<k> and capacity c<k> of its node."""
    out = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    dead = F.lit(False)
    for k, level in enumerate(LEVELS):
        out = out.withColumn(f"w{k}", weight_of(level, weights))
        dead = dead | (F.col(f"w{k}") <= 0)
    out = out.withColumn("c2", F.when(dead, 0.0).otherwise(F.col("tokens").cast("double") * max_epochs))
    out = out.withColumn("c1", F.sum("c2").over(Window.partitionBy(*LEVELS[:2])))
    return out.withColumn("c0", F.sum("c2").over(Window.partitionBy(LEVELS[0])))


def shared_out(nodes: DataFrame, parent: list[str], name: str, weight: str, capacity: str, budget: str, out: str) -> DataFrame:
    """nodes with column out: the share of each in its parent's budget. Nodes are filled in the order of capacity by
    weight for as long as the level that all others then reach is above theirs."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy("__ratio", name)
    nodes = nodes.withColumn("__ratio", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(0.0)))
    filled = F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1))
    open_weight = F.sum(F.greatest(F.col(weight), F.lit(0.0))).over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("__level", F.when(open_weight > 0, (F.col(budget) - F.coalesce(filled, F.lit(0.0))) / open_weight).otherwise(F.lit(0.0)))
    level = F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(family)
    share = F.when((F.col("__ratio") <= F.col("__level")) | level.isNull(), F.col(capacity)).otherwise(F.greatest(F.col(weight), F.lit(0.0)) * level)
    return nodes.withColumn(out, share).drop("__ratio", "__level")


def budgets(leaves: DataFrame, total: float) -> DataFrame:
    """leaves with their budget in whole tokens."""
    top = leaves.groupBy("domain").agg(F.first("w0").alias("w0"), F.first("c0").alias("c0")).withColumn("b", F.lit(float(total)))
    top = shared_out(top, [], "domain", "w0", "c0", "b", "b0").select(F.col("domain").alias("d"), "b0")
    mid = leaves.groupBy("domain", "lang").agg(F.first("w1").alias("w1"), F.first("c1").alias("c1"))
    mid = mid.join(top, mid.domain.eqNullSafe(F.col("d"))).drop("d")
    mid = shared_out(mid, ["domain"], "lang", "w1", "c1", "b0", "b1").select(F.col("domain").alias("d"), F.col("lang").alias("l"), "b1")
    low = leaves.join(mid, leaves.domain.eqNullSafe(F.col("d")) & leaves.lang.eqNullSafe(F.col("l"))).drop("d", "l")
    low = shared_out(low, ["domain", "lang"], "source", "w2", "c2", "b1", "b2")
    return low.select(*LEVELS, "tokens", F.floor(F.col("b2") + 1e-6).alias("budget"))


def select_mix(docs: DataFrame, share: float = 0.5, weights=WEIGHTS, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens, take_tokens: a row for each time a document is taken.

    The budget is the given share of all tokens of docs(doc_id, text, lang, source). A column row of docs goes through; it
    orders rows that the shuffle and their tokens leave equal."""
    own = ["row"] if "row" in docs.columns else []
    rows = docs.select(
        *own,
        F.col("doc_id").cast("long"),
        domain_of(F.col("source")).alias("domain"),
        "lang",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )
    rows = common.stored(rows, "mixing")
    leaves = common.stored(leaves_of(rows, weights, max_epochs), "leaves")
    tokens, usable = leaves.agg(F.sum("tokens"), F.sum("c2")).first()
    plan = budgets(leaves, min(float(int((tokens or 0) * share)), usable or 0.0))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = common.stored(plan.toDF(*(f"__{c}" for c in plan.columns)), "plan")
    same = F.lit(True)
    for level in LEVELS:
        same = same & F.col(level).eqNullSafe(F.col(f"__{level}"))
    taken = rows.where("n_tokens > 0").join(plan.where("__budget > 0"), same)
    names = ["doc_id", "epoch", *LEVELS, "n_tokens", "take_tokens", *own]
    whole = taken.where("__whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__whole") - 1)))
    whole = whole.withColumn("take_tokens", F.col("n_tokens")).select(*names)
    part = taken.where("__rest > 0").withColumn("epoch", F.col("__whole"))
    part = part.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    part = common.stored(part.withColumn("__range", F.substring("__h", 1, 3)), "epoch")
    ranges = part.groupBy(*LEVELS, "__range").agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("__range")) - F.col("sum")
    ranges = ranges.select(*(F.col(c).alias(f"r_{c}") for c in LEVELS), F.col("__range").alias("r_range"), before.alias("before"))
    at = F.col("__range") == F.col("r_range")
    for level in LEVELS:
        at = at & F.col(level).eqNullSafe(F.col(f"r_{level}"))
    order = Window.partitionBy(*LEVELS, "__range").orderBy("__h", "n_tokens", *own).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__own", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(ranges, at)
    part = part.withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("__rest") - F.col("before") - F.col("__own"))).where("take_tokens > 0")
    return whole.unionByName(part.select(*names))


def mixed(docs: DataFrame, share: float, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """The rows of docs that are taken, wholly or in part, within one epoch; whole texts, columns as before.

    Rows are told apart by id, text, language and source; of rows that repeat all of these as many stay as are taken."""
    number = F.col("doc_id").cast("long").alias("doc_id")
    row = common.text_key(F.to_json(F.struct(number, "lang", "source", F.hex(common.text_key(F.col("text"))).alias("text"))))
    taken = select_mix(docs.select("doc_id", "text", "lang", "source", row.alias("row")), share, weights, 1, seed)
    taken = taken.groupBy(F.col("row").alias("__row")).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("__row").orderBy(*([c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")] or ["__row"]))
    rows = docs.withColumn("__row", row).withColumn("__k", F.row_number().over(order))
    return rows.join(taken, "__row").where("__k <= __n").select(*docs.columns)

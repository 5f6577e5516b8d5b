"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Weights run down a tree (domain, language, source): a node's budget is shared among
its children in proportion to their weights.  A child cannot take more than its
subtree holds (tokens times ``max_epochs``); what it leaves is shared among its
siblings, and only if none of them can take more does the shortage show at the
parent's level, where the parent's siblings share it, since a node's own capacity
is the sum of its children's.  The share is found in closed form: in order of
capacity / weight the children fill up first to last, so windows over the small
table of nodes tell which are full and what the rest get.

A leaf with budget b of its a tokens gives floor(b / a) whole epochs and, of the
next one, the prefix of its documents in the order of a seeded hash whose tokens fit
into the rest.  The cut of that prefix is found by summing tokens in 256 hash ranges
of a leaf, then in 256 parts of the range that holds the cut, and ordering single
documents only within the part that holds it: one in 65,536 of a leaf's.  So a source
with a third of all rows is never one task.

Tokens are words (runs of other than ASCII white space), at least one a document.
Defined cases: a null text is an empty one; a null tree value is a value of its own;
documents of equal id and equal hash are taken together or not at all; a value that its
level's weights do not list has their ``REST`` weight (1 if that is not listed either); a
weight of 0 or less takes a subtree out; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import Scratch

DIGITS = 2  # of a hash that a step towards the cut tells apart: 256 ranges of a leaf, then 256 parts of one
STEPS = 2
REST = "*"  # in weights: the weight of all values that a level does not list


def words_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]++"))).cast("long")


def _fill(nodes: DataFrame, parent: list[str], own: str) -> DataFrame:
    """budget of each node, from its parent's ``given``: capacity for those that fill up, a share by weight for the rest."""
    up = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), own)
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent)
    took, rest = F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.sum("weight").over(after)
    full = took + F.col("capacity") / F.col("weight") * rest <= F.col("given") + 1e-6
    out = nodes.withColumn("__full", full)
    spent = F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0.0)).over(all_)
    open_ = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(all_)
    share = (F.col("given") - spent) * F.col("weight") / open_
    return out.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise(share)).drop("__full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: float | None, max_epochs: int) -> DataFrame:
    """leaves: the levels and ``tokens``; adds quota (whole tokens)."""

    def weight(level: str) -> Column:
        named = {k: float(v) for k, v in weights.get(level, {}).items() if k != REST}
        rest = F.lit(float(weights.get(level, {}).get(REST, 1.0)))
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col(level)), rest) if named else rest

    alive = leaves
    for level in levels:
        alive = alive.filter(weight(level) > 0)
    alive = alive.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    everything = alive.agg(F.sum("capacity").alias("capacity"), F.sum("tokens").cast("double").alias("tokens"))
    given = everything.select(F.least("capacity", F.lit(float(total)) if total is not None else F.col("tokens")).alias("given"))
    nodes, parent = given.withColumn("__root", F.lit(0)), ["__root"]
    for k, level in enumerate(levels):
        own = levels[: k + 1]
        held = alive.groupBy(*own).agg(F.sum("capacity").alias("capacity")).withColumn("__root", F.lit(0)).withColumn("weight", weight(level))
        met = held.join(nodes.select(*parent, "given"), parent)
        nodes = _fill(met, parent, level).select("__root", *own, F.col("budget").alias("given"))
        parent = ["__root", *own]
    return alive.join(nodes.drop("__root"), levels).select(*levels, "tokens", F.floor(F.round("given", 3)).cast("long").alias("quota"))


def selection(docs: DataFrame, levels: dict[str, Column], key: str, text: str, weights: dict, total: float | None, max_epochs: int, seed: int, scratch: Scratch) -> DataFrame:
    """For each leaf: the levels, quota, whole epochs and the last hash that is taken in the epoch after them (null: none)."""
    names = list(levels)
    rows = scratch.keep(docs.select(*[F.coalesce(c.cast("string"), F.lit("\0")).alias(n) for n, c in levels.items()], F.col(f"`{key}`").alias("id"), words_of(F.col(f"`{text}`")).alias("tokens")))
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    quotas = scratch.keep(budgets(leaves, names, weights, total, max_epochs).withColumn("epochs", F.expr("cast(quota div tokens as int)")).withColumn("rest", F.expr("quota % tokens")))
    open_ = rows.join(quotas.filter("rest > 0").select(*names, "epochs", "rest"), names).withColumn("h", order_of(F.col("id"), F.col("epochs"), seed)).withColumn("before", F.lit(0).cast("long"))
    for step in range(1, STEPS + 1):
        dealt = open_.withColumn("range", F.substring("h", 1, DIGITS * step))
        sums = dealt.groupBy(*names, "range").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        along = Window.partitionBy(*names).orderBy("range")
        sums = sums.withColumn("upto", F.col("before") + F.sum("tokens").over(along)).withColumn("before", F.col("upto") - F.col("tokens"))
        cut = scratch.keep(sums.filter("before <= rest AND upto > rest").select(*names, "range", "before"))
        open_ = dealt.drop("before").join(cut, [*names, "range"])
    inside = open_.groupBy(*names, "h").agg(F.sum("tokens").alias("tokens"), F.max("rest").alias("rest"), F.max("before").alias("before"))
    along = Window.partitionBy(*names).orderBy("h")
    last = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(along)).filter("upto <= rest").groupBy(*names).agg(F.max("h").alias("last"))
    # if nothing of the cut's range fits, the prefix ends with the range before it
    ends = cut.select(*names, F.col("range").alias("floor"))
    return quotas.join(last, names, "left").join(ends, names, "left").select(*names, "quota", "epochs", F.coalesce("last", "floor").alias("last"))


def order_of(key: Column, epoch: Column, seed: int) -> Column:
    """The place of a document in an epoch: a seeded hash, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], total: float | None = None, max_epochs: int = 4, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' columns and __epoch (from 0): each chosen document once for every epoch it is taken in.

    levels: the tree from its top, name to column; weights: by level, value to weight; total: tokens
    wanted (default: as many as there are). The table of leaves is joined without a hint: Spark
    broadcasts it only below its size threshold.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    names = [f"__l{k}" for k in range(len(levels))]
    renamed = dict(zip(names, levels.values(), strict=True))
    chosen = selection(docs, renamed, key, text, {n: weights.get(own, {}) for n, own in zip(names, levels, strict=True)}, total, max_epochs, seed, scratch)
    leaves = scratch.keep(chosen.select(*names, F.col("epochs").alias("__epochs"), F.col("last").alias("__last")))
    met = docs.select("*", *[F.coalesce(c.cast("string"), F.lit("\0")).alias(n) for n, c in renamed.items()]).join(leaves, names)
    in_next = F.coalesce(order_of(F.col(f"`{key}`"), F.col("__epochs"), seed) <= F.col("__last"), F.lit(False))
    copies = F.col("__epochs") + in_next.cast("int")
    return met.withColumn("__copies", copies).filter("__copies > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).select(*docs.columns, "__epoch")


#: The mixture of the registered query and the pipeline: weights at all three levels; what no level lists has a small one.
WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.3, "code": 0.25, REST: 0.05},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, REST: 0.02},
    "source": {"src0": 0.5, "src1": 2.0, REST: 1.0},
}


def tree() -> dict[str, Column]:
    """Domain (by a source's number: 0 to 6 are the web, 7 books, others code; a source without one is of no listed domain), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,9})$", 1)
    n = F.when(number != "", number.cast("int"))
    return {"domain": F.when(n < 7, "web").when(n == 7, "books").when(n > 7, "code").otherwise("other"), "lang": F.col("lang"), "source": F.col("source")}

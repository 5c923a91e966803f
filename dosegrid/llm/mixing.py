"""Mixing sources to target weights, by budgets that flow down a tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dosegrid.llm.common import small_side
from dosegrid.session import durable

WORD = "[^\\x20\\x09-\\x0D]+"
UNKNOWN = "unknown"

Weights = Sequence[Mapping[str, float]]


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _weight(level: str, weights: Mapping[str, float], default: float) -> Column:
    """Weight of a node among its siblings, looked up by its name."""
    if not weights:
        return F.lit(float(default))
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(float(default)))


def _share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Give each node its part of the parent's budget.

    ``nodes`` has parent, level, weight, capacity and the parent's ``budget``.
    A part is in proportion to the weight, but no more than the capacity; what
    a node cannot take goes to its siblings in proportion to theirs. In order
    of capacity per weight, a node is full if it is at the level that the rest
    of the budget reaches over the rest of the weights.
    """
    ratio = F.col("capacity") / F.col("weight")
    some = nodes.where("weight > 0").withColumn("ratio", ratio)
    order = Window.partitionBy(*parent).orderBy("ratio", level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    reached = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(after)
    ranked = some.withColumn("reached", reached)
    open_level = F.min(F.when(F.col("ratio") > F.col("reached"), F.struct("ratio", level, "reached")))
    found = ranked.withColumn("open", open_level.over(Window.partitionBy(*parent))["reached"])
    part = F.when(F.col("open").isNull(), F.col("capacity")).otherwise(
        F.least("capacity", F.floor(F.col("open") * F.col("weight")))
    )
    return found.select(*parent, level, F.greatest(part.cast("long"), F.lit(0)).alias("budget"))


def leaf_budgets(
    sizes: DataFrame, levels: list[str], weights: Weights, defaults: Sequence[float],
    budget: int, max_epochs: int,
) -> DataFrame:
    """Tokens for each leaf of (levels..., tokens), from the root downwards.

    The capacity of a node is what its leaves can give in ``max_epochs``
    rounds. As a budget is only passed to a node that can use it, a shortage
    stays with the siblings as long as they have room, and moves up after that.
    """
    leaves = sizes.withColumn("capacity", F.col("tokens") * max_epochs)
    given = None
    for depth, level in enumerate(levels):
        parent = levels[:depth]
        nodes = leaves.groupBy(*parent, level).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(level, weights[depth], defaults[depth]))
        nodes = nodes.withColumn("budget", F.lit(budget)) if given is None else nodes.join(given, parent)
        given = _share_out(nodes, parent, level)
    return leaves.join(given, levels).select(*levels, "tokens", "budget")


def _order(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in one epoch of its leaf: 60 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _cutoffs(rows: DataFrame, plan: DataFrame, levels: list[str], slice_rows: int) -> DataFrame:
    """Add to the plan the last place in the order that its last epoch still takes.

    Only totals per slice of the order are summed along it, and then the rows
    of the one slice in which the budget ends; no leaf is sorted as a whole.
    """
    sliced = rows.withColumn(
        "slice", F.floor(F.col("place") / F.lit(float(1 << 60)) * F.col("slices"))
    )
    totals = sliced.groupBy(*levels, "rest", "slice").agg(F.sum("n_tokens").alias("tokens"))
    along = Window.partitionBy(*levels).orderBy("slice")
    ends = totals.withColumn("end", F.sum("tokens").over(along))
    last = (
        ends.where("end > rest")
        .groupBy(*levels)
        .agg(F.min(F.struct("slice", (F.col("end") - F.col("tokens")).alias("start"))).alias("s"))
        .select(*levels, "s.slice", "s.start")
    )
    last = small_side(durable(last))
    inside = sliced.join(last, [*levels, "slice"]).groupBy(*levels, "rest", "start", "place")
    by_place = Window.partitionBy(*levels).orderBy("place")
    fitting = (
        inside.agg(F.sum("n_tokens").alias("tokens"))
        .withColumn("end", F.col("start") + F.sum("tokens").over(by_place))
        .where("end <= rest")
        .groupBy(*levels)
        .agg(F.max("place").alias("cutoff"))
    )
    # Without a fitting row in the last slice, all slices before it are taken.
    bound = F.ceil(F.col("slice") / F.col("slices") * F.lit(float(1 << 60))) - 1
    return (
        plan.join(last, levels, "left")
        .join(fitting, levels, "left")
        .withColumn("cutoff", F.when(F.col("rest") > 0, F.coalesce("cutoff", bound)))
        .withColumn("cutoff", F.coalesce("cutoff", F.lit(-1).cast("long")))
        .drop("slice", "start")
    )


def mix_to_targets(
    docs: DataFrame,
    domain: Column,
    weights: Weights,
    defaults: Sequence[float] = (1.0, 1.0, 1.0),
    share: float = 0.5,
    max_epochs: int = 4,
    seed: int = 11,
    slice_rows: int = 4096,
) -> DataFrame:
    """Documents of a mix that follows target weights, with the times each is read.

    ``domain`` names the domain of a row; below it come lang and source.
    ``weights`` has for each of the three levels the weight of a node among its
    siblings by name, ``defaults`` those of other names. The budget is ``share``
    of all words. It is passed down the tree in proportion to the weights;
    what a node cannot give, in at most ``max_epochs`` rounds over its
    documents, goes to its siblings and then to those of its ancestors. A leaf
    takes whole epochs, and of one more the longest run of documents, in the
    order of a hash seeded by ``seed`` and the epoch, that its budget holds.

    Returns the rows of ``docs`` that are taken, with all columns, and
    mix_domain, mix_tokens, mix_copies beside them (replacing columns of these
    names). A null lang or source is the node "unknown". A null or empty text
    has no words: it is taken with its neighbours in the order. Rows with equal
    ids are taken together; a row without an id goes by its text.
    """
    levels = ["mix_domain", "mix_lang", "mix_source"]
    leaf = {
        "mix_domain": F.coalesce(domain, F.lit(UNKNOWN)),
        "mix_lang": F.coalesce("lang", F.lit(UNKNOWN)),
        "mix_source": F.coalesce("source", F.lit(UNKNOWN)),
    }
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    counted = durable(
        docs.select(key.alias("key"), word_count().alias("n_tokens"), *(c.alias(n) for n, c in leaf.items()))
    )
    sizes = durable(
        counted.groupBy(*levels).agg(
            F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")
        )
    )
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(sizes, levels, weights, defaults, int(total * share), max_epochs)
    plan = durable(
        budgets.join(sizes.select(*levels, "n"), levels)
        .where("tokens > 0")
        .select(
            *levels,
            F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("epochs"),
            (F.col("budget") % F.col("tokens")).alias("rest"),
            F.ceil(F.col("n") / slice_rows).alias("slices"),
        )
    )
    placed = counted.join(small_side(plan), levels)
    placed = placed.withColumn("place", _order(seed, F.col("epochs"), F.col("key")))
    cut = durable(_cutoffs(placed, plan, levels, slice_rows).select(*levels, "epochs", "cutoff"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(
        row.alias("row"),
        *(c.alias(n) for n, c in leaf.items()),
        word_count().alias("mix_tokens"),
        key.alias("mix_key"),
    )
    copies = F.col("epochs") + (
        _order(seed, F.col("epochs"), F.col("mix_key")) <= F.col("cutoff")
    ).cast("long")
    added = ["mix_domain", "mix_tokens", "mix_copies"]
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return (
        named.join(small_side(cut), levels)
        .withColumn("mix_copies", copies)
        .where("mix_copies > 0")
        .select(*kept, *added)
    )

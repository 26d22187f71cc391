"""Connected components by minimum labels with shortcuts, each step a table in the shared folder."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch


def connect(spark: SparkSession, scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the components ``labels`` (node, label; a node without a row is its own) along ``links`` (left, right).

    Every step a component takes the smallest label among its neighbours, then
    the label of that label, until nothing changes.  Neighbours meet in
    aggregations only, so a component of any degree is never one group in one
    task.
    """
    if links.isEmpty():
        return labels

    def label_of(col: str) -> DataFrame:
        return labels.select(F.col("node").alias(col), F.col("label").alias(f"{col}_label"))

    edges = (links.join(label_of("left"), "left", "left").join(label_of("right"), "right", "left")
             .select(F.coalesce("left_label", "left").alias("x"), F.coalesce("right_label", "right").alias("y"))
             .filter("x <> y"))
    edges = scratch.write(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    now = scratch.write(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")))
    while True:
        near = (edges.join(now.select(F.col("x").alias("y"), F.col("to").alias("y_to")), "y")
                .groupBy("x").agg(F.min("y_to").alias("near")))
        step = now.join(near, "x").select("x", F.least("to", "near").alias("new"), F.col("to").alias("old"))
        jump = step.select(F.col("x").alias("new"), F.col("new").alias("far"))
        new = scratch.write(step.join(jump, "new", "left").select("x", F.least("new", "far").alias("to"), "old"))
        changed = not new.filter("to <> old").isEmpty()
        scratch.drop(now)
        now = new
        if not changed:
            break
    scratch.drop(edges)
    final = now.select(F.col("x").alias("label"), "to")
    old = (labels.join(final, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    fresh = (now.select(F.col("x").alias("node"), F.col("to").alias("label"))
             .join(labels.select("node"), "node", "left_anti"))
    return scratch.write(old.unionByName(fresh))


#: Groups up to this size are compared whole once their first pivot is done.
SMALL = 32
#: How many times more pivots a group gets in the next turn.
MORE_PIVOTS = 64
#: Rows of groups that are on disk at once with the columns of their nodes, if there are not more nodes than that.
SLICE_ROWS = 1 << 20


def slices(rows: int, most: int) -> int:
    return max(1, math.ceil(rows / most))


def dealt(df: DataFrame, n: int, k: int, *cols: str) -> DataFrame:
    """Slice ``k`` of ``n`` by a hash of ``cols``."""
    return df.filter(F.pmod(F.xxhash64(F.lit(3), *cols), F.lit(n)) == k) if n > 1 else df


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def link_groups(spark: SparkSession, scratch: Scratch, groups: DataFrame, about: DataFrame, may: Callable[[str, str], str],
                compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, label`` of all nodes with links, from groups (``key, node, members``) inside which links may be.

    ``may`` gives SQL that rules a pair out for certain by columns of ``about``
    (one row per node) with two prefixes; ``compare`` gets the pairs (``left,
    right``, a written table) that are left and returns those that are linked.

    First every node meets the node in most groups of its own largest one, which
    settles clusters of near copies.  Then, each turn, pivots of every group
    that still has two labels meet its members of other components and leave the
    group: they have met everyone in it.  A group gets one pivot first and
    ``MORE_PIVOTS`` times as many each turn, or all its pairs once it is small.  So every pair of
    a group is compared or lies in one component, and a group that has become
    one component is never expanded.

    Groups that agree by chance grow with the square of the nodes, so a turn
    takes its groups in slices: no more of their rows than there are nodes have
    columns of ``about`` at once, between slices a group is a list of numbers.
    """
    info = [c for c in about.columns if c != "node"]
    cols = ["weight", "node", *info]      # the order makes the node in most groups the largest
    largest = F.max_by("key", F.struct("members", "key"))
    per = groups.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), largest.alias("top"), F.collect_list("key").alias("keys"))
    per = scratch.write(per.join(about, "node"))
    most = max(per.count(), SLICE_ROWS)

    def met_by(here: DataFrame, part: Column) -> tuple[DataFrame, DataFrame]:
        """The heaviest node of every part of every group, and its pairs with the group's members of other components."""
        heavy = here.groupBy("key", part.alias("part")).agg(F.max(F.struct(*cols, "label")).alias("p"))
        heavy = scratch.write(heavy.select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in [*cols, "label"]]))
        pairs = here.join(heavy, "key").filter("label <> p_label and " + may("", "p_"))
        return heavy, pairs.select(F.least("node", "p_node").alias("left"), F.greatest("node", "p_node").alias("right")).distinct()

    here = per.select(F.col("top").alias("key"), *cols, F.col("node").alias("label"))
    heavy, pairs = met_by(here, F.lit(0))
    pairs = scratch.write(pairs)
    scratch.drop(heavy)
    labels = connect(spark, scratch, spark.createDataFrame([], "node long, label long"), compare(pairs))
    scratch.drop(pairs)
    lists, last, pivots = per.select("node", "keys"), [], 1
    while True:
        n = slices(lists.agg(F.sum(F.size("keys"))).first()[0] or 0, most)
        found, rest = [], []
        for k in range(n):
            # groups of one component end here, before their rows get columns; nodes, not places in groups, meet their labels
            named = lists.join(labels, "node", "left").select("node", F.explode("keys").alias("key"),
                                                              F.coalesce("label", "node").alias("label"))
            marked = dealt(named, n, k, "key")
            open_ = (marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
                     .filter("lo <> hi").select("key", "size"))
            still = marked.join(open_, "key").groupBy("node", "label").agg(F.collect_list(F.struct("key", "size")).alias("g"))
            here = scratch.write(still.join(per.select(*cols), "node").select(F.inline("g"), *cols, "label"))
            if here.isEmpty():
                scratch.drop(here)
                continue
            # every member of a small group is a pivot; of a larger one the heaviest of each of so many parts
            heavy, pairs = met_by(here, F.when(F.col("size") <= SMALL, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(pivots))))
            found.append(scratch.write(pairs))
            met = heavy.select("key", F.col("p_node").alias("node"))
            rest.append(scratch.write(here.select("key", "node").join(met, ["key", "node"], "left_anti")
                                      .groupBy("node").agg(F.collect_list("key").alias("keys"))))
            scratch.drop(here, heavy)
        scratch.drop(*last)
        if not found:
            scratch.drop(per)
            return labels
        pairs = found[0] if len(found) == 1 else scratch.write(union(found).distinct())
        lists, last = union(rest), rest          # a node may stand in several lists: each has other keys
        labels = connect(spark, scratch, labels, compare(pairs))
        scratch.drop(*{id(df): df for df in [*found, pairs]}.values())
        pivots *= MORE_PIVOTS

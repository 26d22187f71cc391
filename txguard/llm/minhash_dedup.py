"""Near copies by MinHash signatures and an inverted join over their coordinates.

Every distinct shingle set has a signature of ``COORDINATES`` minima.  A set is
posted under each of its (coordinate, value) pairs, and two sets with similarity
s agree in a binomially distributed number of coordinates.  The *match
threshold* is the largest m for which a pair at the wanted similarity falls
short of m with a probability of at most ``LOSS``, 10^-10 by default.

*Prefix*: pairs that one set alone has cannot match, so each set keeps the c
pairs it shares with others and leaves the search if c < m.  Two sets with m
agreements share one of the c - m + 1 rarest pairs of each, and only these
short posting lists are merged.  *Skip*: the long lists are never merged; how
often a candidate pair agrees over all coordinates is read off its two
signatures.  Pairs with m agreements, which sizes and parity sketches do not rule
out, are verified exactly on their full sets.

Equal sets are one node from the start, and posting lists with the same members
are merged once.  Inside a list members are compared with a few pivots at a
time until the list is one component or all its pairs were seen, so a list of
many near copies is not expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.candidates import likely, one_per_member_list, texts_of
from txguard.llm.components import link_groups
from txguard.llm.jaccard_join import SKETCH, linked, may_link, parity, shingle_sets
from txguard.llm.scratch import Scratch
from txguard.llm.text import mix, pieces

SHINGLE = 3
PERCENT = 85
COORDINATES = 48
#: Greatest probability that a pair at exactly ``PERCENT`` has too few agreements to be verified.
LOSS = 1e-10
#: Shingles whose minima are taken at once, and bytes of text in hand.
CHUNK, TEXT_BYTES = 1 << 16, 1 << 20


def match_threshold(coordinates: int, percent: int, loss: float) -> int:
    """Largest m with P(fewer than m of the coordinates agree) <= loss at a similarity of ``percent``."""
    p, short, m = percent / 100, 0.0, 0
    while m < coordinates:
        short += comb(coordinates, m) * p ** m * (1 - p) ** (coordinates - m)
        if short > loss:
            break
        m += 1
    return m


def least_linkable(percent: int) -> int:
    """Size of the smaller set of the smallest pair of different sets that can be linked."""
    smaller = 1
    while 100 * smaller < percent * (smaller + 1):
        smaller += 1
    return smaller


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of 64-bit minima per (non-empty) set; minimum k is over the shingles hashed with the k-th seed."""
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(sets), coordinates), np.uint64)
    lo = 0
    while lo < len(sets):                 # runs of sets with about CHUNK shingles; a larger set is a run of its own
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) <= CHUNK):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo:hi - 1]], dtype=np.int64)]).astype(np.int64)
        h, shifted = np.empty_like(flat), np.empty_like(flat)
        for k, seed in enumerate(seeds):
            np.bitwise_xor(flat, seed, out=h)
            np.multiply(h, np.uint64(0xD6E8FEB86659FD93), out=h)
            np.right_shift(h, np.uint64(32), out=shifted)
            np.bitwise_xor(h, shifted, out=h)
            np.multiply(h, np.uint64(0xBF58476D1CE4E5B9), out=h)
            out[lo:hi, k] = np.minimum.reduceat(h, starts)
        lo = hi
    return out


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, coordinates: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", TEXT_BYTES):
            sets = shingle_sets(part.column(1), shingle)
            n = np.array([len(s) for s in sets], np.int64)
            a = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            b = [int(mix(s ^ np.uint64(0xC0FFEE)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            big = np.flatnonzero(n >= least)
            sig = signatures([sets[k] for k in big], coordinates).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n >= least, coordinates, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()))
            yield pa.record_batch([part.column(0), pc.fill_null(part.column(2), 0), pc.fill_null(part.column(3), 0), pa.array(n),
                                   pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists,
                                   pa.array([parity(s) for s in sets], pa.list_(pa.int64()))],
                                  names=["id", "print", "check", "n", "a", "b", "sig", "sketch"])


def _verify(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "left_text", TEXT_BYTES):
            left, right = shingle_sets(part.column(2), shingle), shingle_sets(part.column(3), shingle)
            ok = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield part.select([0, 1]).filter(ok)


def _prefixes(spark: SparkSession, scratch: Scratch, nodes: DataFrame, m: int) -> DataFrame:
    """``key, node``: the rarest shared pairs of every set that shares m or more."""
    value = F.posexplode("sig").alias("k", "v")
    posted = nodes.select("node", value).select(F.xxhash64("k", "v").alias("key"), "node")
    often = scratch.write(posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    mine = likely(posted, "key", often.select("key")).join(often, "key")
    lists = mine.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("l"))     # one per coordinate
    short = lists.filter(F.size("l") >= m).select("node", F.explode(F.slice("l", F.lit(1), F.size("l") - (m - 1))).alias("p"))
    return short.select(F.col("p.key").alias("key"), "node")


def minhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT, coordinates: int = COORDINATES, loss: float = LOSS) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept`` (id = component_id).

    Shingles are ``shingle`` consecutive words, A-Z lower-cased; a text of fewer
    words is one shingle; a null text or one without words has none and is
    linked with nothing.  Sets with a similarity of ``percent`` or more are
    linked; links are confirmed on full sets, and a link at the bound is missed
    with a probability of at most ``loss``, others with less.  Null ids come
    last: they are the component's only if all its ids are null, and such rows
    are kept.  Repeated rows all give their row; equal ids of one component are
    all ``kept`` if theirs is the smallest.  Other columns are not read; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "minhash")
    m, least = match_threshold(coordinates, percent, loss), least_linkable(percent)
    if m < 1:
        raise ValueError(f"{coordinates} coordinates cannot keep the loss at {percent} % below {loss}")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"),
                       F.xxhash64(F.lit(1), text).alias("check"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, print long, check long, n long, a long, b long, sig array<long>, "
              "sketch array<long>")
    sets = scratch.write(rows.mapInArrow(lambda it: _sign(it, shingle, coordinates, least), schema)
                         .withColumn("row", F.monotonically_increasing_id()))
    # equal sets are one node
    owner = scratch.write(sets.filter("n > 0").groupBy("a", "b").agg(F.min("row").alias("node")))
    nodes = sets.filter(F.col("n") >= least).withColumnRenamed("row", "node").join(owner.select("node"), "node", "left_semi")
    groups = scratch.write(one_per_member_list(scratch.write(_prefixes(spark, scratch, nodes, m))))
    about = scratch.write(nodes.join(groups.select("node").distinct(), "node", "left_semi")
                          .select("node", "print", "check", "n", "sig", *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]))
    texts = texts_of(scratch, rows, about)

    def side(name: str) -> DataFrame:
        return about.select(F.col("node").alias(name), F.col("sig").alias(f"{name}_sig"))

    def compare(pairs: DataFrame) -> DataFrame:
        agree = F.size(F.filter(F.zip_with("left_sig", "right_sig", lambda x, y: x == y), lambda e: e))
        both = pairs.join(side("left"), "left").join(side("right"), "right")
        found = scratch.write(both.filter(agree >= m).select("left", "right"))
        if found.isEmpty():
            return found
        full = (found.join(texts.select(F.col("node").alias("left"), F.col("text").alias("left_text")), "left")
                .join(texts.select(F.col("node").alias("right"), F.col("text").alias("right_text")), "right")
                .select("left", "right", "left_text", "right_text"))
        return scratch.write(full.mapInArrow(lambda it: _verify(it, shingle, percent), "left long, right long"))

    # sizes and parity sketches rule out for certain, so that fewer pairs are looked up
    labels = link_groups(spark, scratch, groups, about.drop("print", "check", "sig"), lambda x, y: may_link(x, y, percent), compare)
    placed = scratch.write(sets.select("id", "n", "a", "b").join(owner, ["a", "b"], "left").join(labels, "node", "left")
                           .select("id", "n", F.coalesce("label", "node").alias("label")))
    best = placed.filter("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (placed.join(best, "label", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.col("id").eqNullSafe(component).alias("kept")))

"""N-gram Jaccard join by universe partition and pigeonhole.

Two shingle sets with Jaccard similarity of p % differ in at most
``(a + b) * (100 - p) // (100 + p)`` shingles, at 90 % ``(a + b) // 19``.  Hashing the shingle universe into more segments
than that leaves some segment in which both sets agree, so sets that share a
segment's content are all the candidates there are.

Segments follow *size bands*: sets are cut by the scheme of their band and, if
a partner may be in the next band, by that one's too.  A scheme has plain
segments (allowance 1: a difference breaks them) and segments with *one-deletion
neighbourhoods* (allowance 2: content and content less one shingle are both
indexed, so it takes two differences).  A *cost model* over the sizes of all
texts allots them: plain segments are few rows, neighbourhoods are many but
rarely agree by chance.  A set indexes a *subset* of its segments, the first
ones that are not empty, until allowances exceed the differences its size
permits; for two sets the shorter of the two subsets already holds more
allowance than they may differ, so the proof stands.

Equal sets are one node from the start.  Keys are counted, keys of single nodes
go by a filter before any node moves, and of keys with the same nodes one is
kept.  Nodes that share content are compared
with a few pivots of their group, more of them where a group stays apart, until
every group is one component or has no unseen pair left; links between
different sets are verified exactly on their shingles.  Before any text moves a
*parity sketch* tells most of the others apart: bit k is the parity of the
shingles that hash to k, a bit that differs takes a shingle that differs, so
more differing bits than permitted differences rule a pair out for certain.
Texts of more shingles than that sketch has bits have a second one with a bit
per shingle, which tells them apart before their text moves.

Pairs that agree by chance grow with the square of the texts, so what moves is
dealt out: keys are counted in classes, groups, sketches and texts come in
slices of bounded size, and a slice's files go before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.candidates import likely, one_per_member_list, texts_of, without
from txguard.llm.components import SLICE_ROWS, dealt, link_groups, slices, union
from txguard.llm.scratch import Scratch, own_name
from txguard.llm.text import Rolling, Words, mix, pieces

#: Words of a shingle and least similarity, as op8_ngram_jaccard has them.
SHINGLE = 3
PERCENT = 90
#: Each band's highest size over its lowest; above 100 / percent, so that a partner is at most one band away.
BAND = 1.5
#: For costs only: mean bytes of a word; bytes that an index row and a compared pair write; chance that two shingles of
#: different texts agree where no text says; counters of the sketch that counts it.
WORD_BYTES = 6
INDEX_BYTES, PAIR_BYTES = 12, 140
AGREE = 2e-6
COUNTERS = 1 << 14
#: Words of 64 bits in a parity sketch, and bytes of text in hand.
SKETCH, TEXT_BYTES = 16, 1 << 20
#: Classes of keys, at most, and keys from which more than one is counted at a time.
CLASSES, CLASS_KEYS = 4, 1 << 23
#: Shingles of the pairs whose texts are on disk at once, if they are more than a quarter of all nodes' shingles.
SLICE_SHINGLES = 1 << 25


def differences(a: int, b: int, percent: int = PERCENT) -> int:
    """Most shingles in which sets of these sizes differ at 100 * intersection >= percent * union."""
    return (a + b) * (100 - percent) // (100 + percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Scheme:
    """Sets of ``low`` to ``high`` shingles (and smaller partners) in ``plain`` and ``wide`` segments."""
    band: int
    low: int
    high: int
    plain: int
    wide: int
    percent: int = PERCENT

    def need(self, size: int) -> int:
        return differences(size, min(self.high, size * 100 // self.percent), self.percent) + 1

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        slots = self.plain + 2 * self.wide
        slot = (mix(shingles ^ np.uint64(self.band + 1)) % np.uint64(slots)).astype(np.int64)
        seg = np.where(slot < self.plain, slot, self.plain + (slot - self.plain) // 2)
        total = self.plain + self.wide
        n = np.bincount(seg, minlength=total)
        value = mix(shingles + np.uint64(0x51ED270B))
        content = np.zeros(total, np.uint64)
        np.add.at(content, seg, value)
        wide = np.arange(total) >= self.plain
        allowance = np.minimum(n, np.where(wide, 2, 1))
        sums = np.cumsum(allowance)
        enough = sums[-1] >= self.need(len(shingles))
        if enough:
            used = (np.arange(total) <= np.searchsorted(sums, self.need(len(shingles)))) & (n > 0)
        else:
            used = np.ones(total, bool)      # too few segments with content: the empty ones count as well
        place = mix(np.arange(total, dtype=np.uint64) + np.uint64(self.band << 32))
        out = [mix(content[used] ^ place[used])]
        # where empty segments count, the one shingle of a segment may be the difference from an empty one
        open_ = used[seg] & wide[seg] & ((n[seg] > 1) | (not enough))
        if open_.any():
            out.append(mix((content[seg[open_]] - value[open_]) ^ place[seg[open_]]))
        return np.unique(np.concatenate(out))


def _allot(size: int, slots: int, sets: float, agree: float) -> int:
    """Number of wide segments with the least bytes expected for ``sets`` sets of about this size.

    Only segments with as many shingles as they have allowance agree by chance
    at a rate that matters: a plain one with a single shingle, or a wide one
    with at most two, of which one is left out.
    """
    def cost(wide: int) -> float:
        plain, per = slots - 2 * wide, size / slots
        rows = plain + wide * (1 + 2 * per)
        chance = plain * per * math.exp(-per) + wide * 2 * per * math.exp(-2 * per)
        return INDEX_BYTES * rows + PAIR_BYTES * sets / 2 * chance * agree      # a pair belongs to two sets
    return min(sorted({slots * k // 16 for k in range(9)}), key=cost)


def schemes(sets_by_size: dict[int, int], largest: int, wide: int | None = None, percent: int = PERCENT,
            agree: float = AGREE) -> list[Scheme]:
    """Bands from 100 / (100 - percent) shingles on, at 90 % 10 (smaller sets link only if equal or across the border)."""
    if not 100 / BAND < percent < 100:
        raise ValueError(f"percent must lie between {100 / BAND:.0f} and 100, not at {percent}")
    first = low = -(-100 // (100 - percent))
    out = []
    while low <= max(largest, first) * 2:
        high = max(low, math.ceil(low * BAND) - 1)
        slots = math.ceil(1.1 * (differences(high, high * 100 // percent, percent) + 1)) + 2
        sets = sum(n for s, n in sets_by_size.items() if low <= s <= high)
        w = _allot(low, slots, sets, agree) if wide is None else min(wide, slots // 2)
        out.append(Scheme(len(out), low, high, slots - 2 * w, w, percent))
        low = high + 1
    return out


def agreement(scratch: Scratch, rows: DataFrame, shingle: int) -> float:
    """Chance that two shingles of different texts agree, counted over all rows ``print, text``; it only steers costs.

    Per task, signed counters sum up every shingle of every text; the squares of
    their sums over all tasks are the pairs that agree, to about 1 %.  Pairs
    within a text and its copies are taken off, as counted by ``print``.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", TEXT_BYTES):
                sets = shingle_sets(part.column(1), shingle)
                h = mix(np.concatenate(sets) ^ np.uint64(0xA9EE))
                at, sign = (h % np.uint64(2 * COUNTERS)).astype(np.int64) // 2, (h & np.uint64(1)).astype(np.int64) * 2 - 1
                sums += np.bincount(at, sign, COUNTERS).astype(np.int64)
                yield pa.record_batch([part.column(0), pa.array([len(u) for u in sets], pa.int64()),
                                       pa.nulls(len(sets), pa.list_(pa.int64()))], names=["print", "n", "sums"])
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([sums], pa.list_(pa.int64()))],
                              names=["print", "n", "sums"])

    found = scratch.write(rows.select("print", "text").mapInArrow(counted, "print long, n long, sums array<long>"))
    own = (found.filter("sums is null").groupBy("print").agg(F.count(F.lit(1)).cast("double").alias("c"), F.max("n").alias("n"))
           .agg(F.sum(F.col("c") * F.col("c") * F.col("n")).alias("own"), F.sum(F.col("c") * F.col("n")).alias("all")).first())
    same = (found.filter("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at")
            .agg(F.sum("x").cast("double").alias("x")).agg(F.sum(F.col("x") * F.col("x"))).first()[0])
    scratch.drop(found)
    return max((same - own["own"]) / own["all"] ** 2, AGREE / 100) if own["all"] else AGREE


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    w = Words(texts, lower=True)
    roll = Rolling(w.hashes())
    runs = roll.windows(shingle)
    out = []
    for first, n in zip(w.first[:-1].tolist(), w.count.tolist()):
        if n >= shingle:
            out.append(np.unique(runs[first:first + n - shingle + 1]))
        else:
            out.append(roll.windows(n, np.array([first])) + np.uint64(n) if n else runs[:0])
    return out


def _index(batches: Iterator[pa.RecordBatch], plan: list[Scheme], shingle: int) -> Iterator[pa.RecordBatch]:
    lows = np.array([s.low for s in plan])
    for batch in batches:
        for part in pieces(batch, "text", TEXT_BYTES):
            rows = []
            for u in shingle_sets(part.column(1), shingle):
                size = len(u)
                if not size:
                    rows.append((0, None, None, None, None, *[None] * CLASSES))
                    continue
                band = int(np.searchsorted(lows, size, side="right")) - 1
                keys = [plan[band].keys(u)] if band >= 0 else []
                if band + 1 < len(plan) and 100 * size >= plan[band + 1].percent * plan[band + 1].low:
                    keys.append(plan[band + 1].keys(u))
                keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
                cuts = np.searchsorted(keys, np.arange(1, CLASSES, dtype=np.uint64) * np.uint64((1 << 64) // CLASSES))
                a, b = mix(u).sum(dtype=np.uint64), mix(u ^ np.uint64(0xC0FFEE)).sum(dtype=np.uint64)
                rows.append((size, int(a.view(np.int64)), int(b.view(np.int64)), parity(u), long_parity(u),
                             *np.split(keys.view(np.int64), cuts)))
            size, a, b, sketch, bits, *keys = list(zip(*rows))
            yield pa.record_batch([part.column(0), pc.fill_null(part.column(2), 0), pc.fill_null(part.column(3), 0),
                                   pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                   pa.array(sketch, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                                   *[pa.array(k, pa.list_(pa.int64())) for k in keys]],
                                  names=["id", "print", "check", "n", "a", "b", "sketch", "bits",
                                         *[f"keys{k}" for k in range(CLASSES)]])


def parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_parity(shingles: np.ndarray) -> bytes | None:
    """Parity sketch with the power of two of bits that is no less than the shingles; none where ``parity`` has as many."""
    if len(shingles) <= 64 * SKETCH:
        return None
    bits = 1 << (len(shingles) - 1).bit_length()
    return np.packbits((np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketches_differ(left: bytes, right: bytes) -> int:
    """Bits in which two long sketches differ; halves of the longer are laid together, as one with half the bits would be."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def may_link(left: str, right: str, percent: int) -> str:
    """SQL: sizes and sketches of two rows, given by column prefixes, do not rule a link out."""
    bits = " + ".join(f"bit_count({left}s{k} ^ {right}s{k})" for k in range(SKETCH))
    size = f"100 * least({left}n, {right}n) >= {percent} * greatest({left}n, {right}n)"
    return f"{size} and {bits} <= ({left}n + {right}n) * {100 - percent} div {100 + percent}"


def _verify(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "left_text", TEXT_BYTES):
            left, right = shingle_sets(part.column(2), shingle), shingle_sets(part.column(3), shingle)
            ok = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
            yield part.select([0, 1]).filter(ok)


def _sift(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and long sketches (or none) those that may be linked, and how many shingles both have."""
    for batch in batches:
        left, right, m, n, x, y = batch.columns
        n = pc.add(m, n)
        most = differences(n.to_numpy(zero_copy_only=False), 0, percent)
        ok = [a is None or b is None or sketches_differ(a, b) <= d for a, b, d in zip(x.to_pylist(), y.to_pylist(), most.tolist())]
        yield pa.record_batch([left, right, n], names=["left", "right", "shingles"]).filter(pa.array(ok, pa.bool_()))


def _compare(scratch: Scratch, pairs: DataFrame, about: DataFrame, texts: DataFrame, shingle: int, percent: int,
             rows: int, shingles: int) -> DataFrame:
    """The pairs of nodes that are linked; about ``rows`` pairs have long sketches, and ``shingles`` have texts, at once.

    Only texts of pairs that the sketches leave are moved; without any pair none is.
    """
    if pairs.isEmpty():
        return pairs

    def sketch(name: str) -> DataFrame:
        return about.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))

    def text(name: str, nodes: DataFrame) -> DataFrame:
        return likely(texts, "node", nodes.select(name)).select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))

    n = slices(pairs.count(), rows)
    left = [scratch.write(dealt(pairs, n, k, "left", "right").join(sketch("left"), "left").join(sketch("right"), "right")
                          .select("left", "right", "left_n", "right_n", "left_bits", "right_bits")
                          .mapInArrow(lambda it: _sift(it, percent), "left long, right long, shingles long")) for k in range(n)]
    some = union(left)
    n = slices(some.agg(F.sum("shingles")).first()[0] or 0, shingles)
    links = []
    for k in range(n):
        now = dealt(some, n, k, "left", "right").select("left", "right")
        full = now.join(text("left", now), "left").join(text("right", now), "right").select("left", "right", "left_text", "right_text")
        links.append(scratch.write(full.mapInArrow(lambda it: _verify(it, shingle, percent), "left long, right long")))
    scratch.drop(*left)
    return union(links)


def _groups(scratch: Scratch, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node, members``: keys that several nodes have, one of those with the same nodes; counted by classes of keys."""
    gone = scratch.write(sets.filter("n > 0").select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti"))
    mine = without(scratch, sets.filter("n > 0"), "row", gone)
    keys = CLASSES * (mine.agg(F.sum(F.size("keys0"))).first()[0] or 0)
    at_once = CLASSES
    while at_once > 1 and keys * at_once > CLASS_KEYS * CLASSES:
        at_once //= 2
    found = []
    for k in range(0, CLASSES, at_once):
        some = mine.select(F.explode(F.concat(*[f"keys{i}" for i in range(k, k + at_once)])).alias("key"), F.col("row").alias("node"))
        often = scratch.write(some.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("key"))
        shared = scratch.write(likely(some, "key", often).join(often, "key", "left_semi"))
        found.append(scratch.write(one_per_member_list(shared)))
        scratch.drop(often, shared)
    if len(found) == 1:
        return found[0]
    groups = scratch.write(one_per_member_list(union(found)))
    scratch.drop(gone, *found)
    return groups


def _components(spark: SparkSession, scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, wide: int | None, shingle: int,
                percent: int) -> DataFrame:
    """Rows ``id, print, check, n, row, label``: ``label`` is equal within a component, null without words."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"),
                       F.xxhash64(F.lit(1), text).alias("check"))
    sizes = (rows.select(F.floor(4 * F.log2(F.greatest(F.octet_length("text"), F.lit(1)))).alias("b"), F.octet_length("text").alias("n"))
             .groupBy("b").agg(F.count(F.lit(1)).alias("sets"), F.max("n").alias("most")).collect())
    by_size: dict[int, int] = {}
    for r in sizes:
        if r["b"] is not None:
            size = int(2 ** (r["b"] / 4) / WORD_BYTES)
            by_size[size] = by_size.get(size, 0) + r["sets"]
    agree = agreement(scratch, rows, shingle) if wide is None else AGREE
    plan = schemes(by_size, max([r["most"] or 0 for r in sizes], default=0) // 2, wide, percent, agree)
    id_type = rows.schema["id"].dataType.simpleString()
    sets = rows.mapInArrow(lambda it: _index(it, plan, shingle), f"id {id_type}, print long, check long, n long, a long, b long, "
                           "sketch array<long>, bits binary, " + ", ".join(f"keys{k} array<long>" for k in range(CLASSES)))
    sets = scratch.write(sets.withColumn("row", F.monotonically_increasing_id()))
    nodes = scratch.write(sets.filter("n > 0").groupBy("a", "b").agg(F.min("row").alias("node")))
    groups = _groups(scratch, sets, nodes)
    sketch = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    about = scratch.write(sets.withColumnRenamed("row", "node").join(groups.select("node").distinct(), "node", "left_semi")
                          .select("node", "print", "check", "n", "bits", *sketch))
    every = scratch.write(sets.select("id", "print", "check", "n", "row", "a", "b"))
    scratch.drop(sets)                    # with the keys
    texts = texts_of(scratch, rows, about)
    size = about.agg(F.count(F.lit(1)), F.sum("n")).first()
    most, words = max(size[0], SLICE_ROWS), max((size[1] or 0) // 4, SLICE_SHINGLES)
    labels = link_groups(spark, scratch, groups, about.drop("print", "check", "bits"), lambda x, y: may_link(x, y, percent),
                         lambda pairs: _compare(scratch, pairs, about, texts, shingle, percent, most, words))
    scratch.drop(groups, about, texts)
    return (every.join(nodes, ["a", "b"], "left").join(labels, "node", "left")
            .select("id", "print", "check", "n", "row", F.coalesce("label", "node").alias("label")))


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       wide: int | None = None, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Set size and component of every document: id, ``n_shingles``, ``component_id``.

    Shingles are ``shingle`` consecutive words, A-Z lower-cased, and sets with a
    similarity of ``percent`` or more are linked; a text of fewer
    words is one shingle, a null text or one without words has none and is
    linked with nothing.  ``component_id`` is the smallest id reachable by
    links, null only if every id of the component is.  Every row gives one row,
    repeated and null ids included; other columns are not read; an empty table
    gives an empty result.  ``wide`` sets the number of wide segments instead
    of the cost model.
    """
    placed = _components(spark, Scratch(spark, "jaccard"), docs, id_col, text_col, wide, shingle, percent)
    least = placed.filter("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    return (placed.join(least, "label", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, null ids last.

    ``shingle`` and ``percent`` are those of ``jaccard_components``.  Rows
    without words are linked with nothing and all stay.  Of rows equal in id and
    text one stays.  All columns stay, whatever their names.
    """
    scratch = Scratch(spark, "jaccard")
    placed = scratch.write(_components(spark, scratch, docs, id_col, text_col, None, shingle, percent))
    linked_ = placed.filter("label is not null")
    best = (linked_.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("b")).select("b.row"))
    gone = linked_.join(best, "row", "left_anti")
    kept = linked_.join(best, "row", "left_semi").select("id", "print")
    # columns of documents may have any name: the ones added here have names that none of them has
    print_, gone_id, gone_print, twice_id, twice_print, twice = (
        own_name(docs, n) for n in ("print", "gone_id", "gone_print", "twice_id", "twice_print", "twice"))
    gone = gone.select(F.col("id").alias(gone_id), F.col("print").alias(gone_print)).distinct()
    # an id and text that a kept row shares with dropped ones is thinned out below instead
    only = gone.join(kept, gone[gone_id].eqNullSafe(kept["id"]) & (gone[gone_print] == kept["print"]), "left_anti")
    marked = docs.withColumn(print_, F.xxhash64(text_col))
    out = marked.join(only, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(print_) == F.col(gone_print)), "left_anti")
    again = linked_.groupBy("id", "print").count().filter("count > 1")
    if not again.isEmpty():
        more = again.select(F.col("id").alias(twice_id), F.col("print").alias(twice_print), F.lit(True).alias(twice))
        out = out.join(more, F.col(id_col).eqNullSafe(F.col(twice_id)) & (F.col(print_) == F.col(twice_print)), "left")
        single = out.filter(F.col(twice).isNull()).select(docs.columns)
        return single.unionByName(out.filter(F.col(twice)).dropDuplicates([id_col, print_]).select(docs.columns))
    return out.select(docs.columns)

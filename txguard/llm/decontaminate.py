"""Benchmark decontamination: SimHash windows the size of the benchmark items.

Every document is read through windows as long as an item.  A window of
candidates gets a 128-bit SimHash of its five-word shingles; a multi-index over
16 byte blocks returns every item fingerprint within the Hamming radius (two
fingerprints that differ in at most ``RADIUS`` bits differ in at most
``RADIUS // 16`` bits of some block, and the index lists all block values that
close); and an exact weighted-shingle similarity decides.

Weights: a shingle found in d distinct items counts 1/d, so text that items
share says less; other shingles count 1.  Spark counts d once over all items,
so a document and an item have one similarity however the items are dealt.  Similarity is the weighted sum of the smaller
counts over that of the larger ones.  At 0.8 a window has few shingles that no
item has, which a prefix sum finds without a fingerprint; that gate loses
nothing, and leaves windows only where a passage really is.

Items come to the workers in blocks of bounded size, one pass over the
documents for each block; the documents are never shuffled.  Items with the
same words are one entry with several ids.  The shingles of several items come
to every worker, 12 bytes each, as a window may hold those of other blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch, own_name
from txguard.llm.text import Rolling, Words, mix, pieces

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 19.4 bits on average, with a deviation of 4.1.
RADIUS = 40
BLOCKS = 16
ITEMS_PER_PASS = 5_000
BYTES_PER_PASS = 16 << 20
#: Windows fingerprinted at once start within so many words.
SPAN = 4096
_TABLE_BITS = 22

_NEAR = np.array([v for v in range(256) if bin(v).count("1") <= RADIUS // BLOCKS], dtype=np.uint8)
_SALT = np.uint64(0xA5A5F00D12345677)


def _bits(h: np.ndarray) -> np.ndarray:
    """128 signs (+1/-1) of each shingle hash."""
    two = np.stack([mix(h), mix(h ^ _SALT)], axis=1).astype("<u8")
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


@dataclass(frozen=True)
class Shared:
    """Shingles of several items, sorted, and in how many items each is."""
    shingles: np.ndarray
    holders: np.ndarray

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles))
        if len(self.shingles) and len(shingles):
            pos = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
            at = np.flatnonzero(self.shingles[pos] == shingles)
            out[at] = 1.0 / self.holders[pos[at]]
        return out


class Group:
    """Items of one size in words."""

    def __init__(self, size: int, items: list[tuple[list[int | None], np.ndarray]], shared: Shared):
        self.size, self.k = size, min(SHINGLE, size)
        self.ids = [i for i, _ in items]
        self.counts = [Counter(h.tolist()) for _, h in items]
        weights = [shared.weights(h) for _, h in items]
        self.most = max(w.sum() for w in weights)
        sums = np.array([(_bits(h) * w[:, None]).sum(axis=0) for (_, h), w in zip(items, weights)])
        self.prints = np.packbits(sums > 0, axis=1)
        # table[block][value]: items whose block lies within RADIUS // BLOCKS bits of the value
        self.table = np.zeros((BLOCKS, 256, len(items)), dtype=bool)
        for b in range(BLOCKS):
            for near in _NEAR:
                self.table[b, self.prints[:, b] ^ near, np.arange(len(items))] = True

    def close(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints within the radius."""
        some = np.zeros((len(prints), len(self.ids)), dtype=bool)
        for b in range(BLOCKS):
            some |= self.table[b, prints[:, b]]
        w, i = np.nonzero(some)
        far = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1)
        ok = far <= RADIUS
        return w[ok], i[ok], far[ok]


class Index:
    """One block of items, each the ids of a text; picklable, sent to the workers once per pass."""

    def __init__(self, items: list[tuple[list[int | None], str]], shared: Shared):
        by_size: dict[int, list] = {}
        w = Words(pa.array([t for _, t in items], pa.string()), lower=True)
        h = w.hashes()
        for d, (item, _) in enumerate(items):
            own = h[w.first[d]:w.first[d + 1]]
            if len(own):
                shingles = Rolling(own).windows(min(SHINGLE, len(own)))
                by_size.setdefault(len(own), []).append((item, shingles))
        self.groups = [Group(size, group, shared) for size, group in sorted(by_size.items())]
        self.known = {}
        self.table = {}
        for k in {g.k for g in self.groups}:
            known = np.unique(np.array([x for g in self.groups if g.k == k for c in g.counts for x in c], np.uint64))
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[known >> np.uint64(64 - _TABLE_BITS)] = True
            self.known[k], self.table[k] = known, table

    def inside(self, shingles: np.ndarray, k: int) -> np.ndarray:
        """Mask: some item has the shingle."""
        out = self.table[k][shingles >> np.uint64(64 - _TABLE_BITS)]
        at = np.flatnonzero(out)
        pos = np.searchsorted(self.known[k], shingles[at])
        out[at] = self.known[k][np.minimum(pos, len(self.known[k]) - 1)] == shingles[at]
        return out

    def similarity(self, window: np.ndarray, item: Counter, shared: Shared) -> float:
        mine = Counter(window.tolist())
        low = high = 0.0
        both = sorted(mine.keys() | item.keys())
        for x, w in zip(both, shared.weights(np.array(both, np.uint64)).tolist()):
            low += w * min(mine[x], item[x])
            high += w * max(mine[x], item[x])
        return low / high

    def hits(self, words: np.ndarray, shared: Shared) -> list[tuple]:
        """(item, similarity, first word, words) of one document given by its word hashes."""
        found, seen = [], {}
        roll = Rolling(words)
        for g in self.groups:
            size = min(g.size, len(words))
            n = size - g.k + 1
            if n < 1:
                continue
            if g.k not in seen:
                shingles = roll.windows(g.k)
                weight = shared.weights(shingles)
                outside = np.where(self.inside(shingles, g.k), 0.0, weight)
                seen[g.k] = shingles, weight, np.concatenate([[0], np.cumsum(outside)])
            shingles, weight, strange = seen[g.k]
            # U >= I + strange and I >= 0.8 U bound the weight of the shingles that no item of the block has
            start = np.flatnonzero(strange[n:] - strange[:-n] <= (1 / SIMILARITY - 1) * g.most + 1e-6)
            done = set()
            for near in np.split(start, np.flatnonzero(np.diff(start // SPAN)) + 1) if len(start) else ():
                found += self._verified(g, shingles, weight, near, n, size, done, shared)
        return found

    def _verified(self, g: Group, shingles: np.ndarray, weight: np.ndarray, start: np.ndarray, n: int, size: int, done: set,
                  shared: Shared) -> list[tuple]:
        """Windows of a span whose fingerprint is close to an item and whose similarity is high enough."""
        low = int(start[0])
        part, weight = shingles[low:int(start[-1]) + n], weight[low:int(start[-1]) + n]
        votes = np.concatenate([np.zeros((1, 128)), np.cumsum(_bits(part) * weight[:, None], axis=0, dtype=np.float64)])
        w, i, far = g.close(np.packbits(votes[start - low + n] - votes[start - low] > 0, axis=1))
        found = []
        for j in np.lexsort((start[w], far)):
            if int(i[j]) not in done:
                s = int(start[w[j]])
                sim = self.similarity(shingles[s:s + n], g.counts[i[j]], shared)
                if sim >= SIMILARITY:
                    done.add(int(i[j]))
                    found += [(item, sim, s, size) for item in g.ids[i[j]]]
        return found

    def scan(self, texts: pa.Array, shared: Shared) -> list[list[tuple]]:
        """Hits of every text of a batch."""
        w = Words(texts, lower=True)
        h = w.hashes()
        suspect = np.zeros(len(w.count), bool)
        doc = w.doc()
        roll = Rolling(h)
        for k in self.known:
            at = np.flatnonzero(w.fits(k))
            if len(at):
                suspect[doc[at[self.inside(roll.windows(k, at), k)]]] = True
        out: list[list[tuple]] = [[] for _ in range(len(w.count))]
        for d in np.flatnonzero(suspect):
            out[d] = self.hits(h[w.first[d]:w.first[d + 1]], shared)
        return out


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each item text."""
    for batch in batches:
        for part in pieces(batch, "t"):
            w = Words(part.column(0), lower=True)
            h = w.hashes()
            own = [np.unique(Rolling(h[a:b]).windows(min(SHINGLE, b - a)))
                   for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()) if b > a]
            if own:
                yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64))], names=["x"])


def _passes(spark: SparkSession, items: DataFrame, id_col: str, text_col: str) -> Iterator:
    """Indexes over blocks of the distinct items, each within ``ITEMS_PER_PASS`` and about ``BYTES_PER_PASS``, with the
    shingles that items of any block share."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))
    rows = items.select(F.struct(F.col(id_col).alias("i")).alias("i"), plain.alias("t")).filter("t <> ''")
    rows = Scratch(spark, "leaks").write(rows.groupBy("t").agg(F.collect_list("i").alias("ids")))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if not n:
        return
    often = rows.select("t").mapInArrow(_item_shingles, "x long").groupBy("x").agg(F.count(F.lit(1)).alias("d")).filter("d > 1")
    often = often.toArrow()
    x, d = often["x"].to_numpy().view(np.uint64), often["d"].to_numpy().astype(np.int32)
    order = np.argsort(x)
    shared = spark.sparkContext.broadcast(Shared(x[order], d[order]))
    blocks = max(-(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS), 1)
    if blocks > 1:
        blocks *= 2      # hashing fills blocks unevenly
    for b in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()
        index = Index([([i["i"] for i in r["ids"]], r["t"]) for r in mine], shared.value)
        if index.groups:
            yield spark.sparkContext.broadcast(index), shared


def _hits(batches: Iterator[pa.RecordBatch], index, shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            found = [(d, *hit) for d, hits in enumerate(index.value.scan(part.column(1), shared.value)) for hit in hits]
            doc, item, sim, first, size = list(zip(*found)) if found else [[]] * 5
            yield pa.record_batch([part.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()),
                                   pa.array(sim, pa.float64()), pa.array(first, pa.int64()), pa.array(size, pa.int64())],
                                  names=["id", "item_id", "similarity", "first_word", "n_words"])


def _clean(batches: Iterator[pa.RecordBatch], index, shared, text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for part in pieces(batch, text):
            clean = pa.array([not hits for hits in index.value.scan(part.column(at), shared.value)], pa.bool_())
            kept = part.filter(clean)
            yield pa.record_batch([c for k, c in enumerate(kept.columns) if k != at],
                                  names=[n for n in kept.schema.names if n != text])


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds.

    Columns: id, ``item_id``, ``similarity``, ``first_word`` and ``n_words`` of
    the window.  Words are split at ASCII white space, A-Z lower-cased; an item
    or text of fewer than five words is one shingle; one shorter than the item
    is one window.  Null texts and items, and those without words, match
    nothing.  Equal items are all reported; rows with equal or null ids are
    documents of their own.  Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, item_id long, similarity double, "
              "first_word long, n_words long")
    out = spark.createDataFrame([], schema)
    for index, shared in _passes(spark, items, item_col, item_text_col):
        out = out.unionByName(rows.mapInArrow(lambda it, x=index, s=shared: _hits(it, x, s), schema))
    return out.withColumnRenamed("id", id_col)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, whatever their names."""
    schema, text = docs.schema, own_name(docs, "text_to_scan")
    for index, shared in _passes(spark, items, item_col, item_text_col):
        docs = docs.select("*", F.col(text_col).alias(text)).mapInArrow(lambda it, x=index, s=shared: _clean(it, x, s, text), schema)
    return docs

"""Substring dedup: prefix-partitioned suffix trees over words.

A window of 35 words that starts at two places is a node of depth 35 with two
leaves in the tree of all suffixes.  Suffixes are split by prefixes of variable
length: first by their first 8 words, and where too many share those, by 16 and
at last by 35, until each group fits into memory.  A group's subtree is its
suffixes in the order of their path (hashes of the prefix and of 35 words);
neighbours that agree down to depth 35 hang under one deep node, and runs of
such places are the maximal repeats.

Two steps keep suffixes few.  Texts that are exact copies are one text from the
start.  And a sample chosen by content - the smallest hash of the 8-word grams
of each window - is counted first: equal windows have the same smallest gram,
so a window whose gram stands nowhere else cannot repeat, and only the others
become suffixes.  Within a block of texts equal suffixes are sent once, so a
passage that a third of all documents share is one suffix per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch
from txguard.llm.text import Rolling, Words, pieces, sliding_min

WINDOW = 35
GRAM = 8
PREFIXES = (8, 16, 35)
GROUP_SUFFIXES = 500_000
BLOCK_BYTES = 4 << 20


class Grams:
    """Smallest gram of each window of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        self.roll = Rolling(self.words.hashes())
        self.at = np.flatnonzero(self.words.fits(WINDOW))          # where windows start
        self.gram = self.roll.windows(GRAM)
        least = sliding_min(self.gram, WINDOW - GRAM + 1)
        self.least = least[self.at] if len(self.at) else np.empty(0, np.uint64)

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, gram, more than once) of the grams that are smallest in some window."""
        if not len(self.at):
            return self.at, self.gram[:0], np.zeros(0, bool)
        span = WINDOW - GRAM + 1
        least = np.zeros(len(self.gram) + span - 1, np.uint64)
        least[self.at + span - 1] = self.least
        most = ~sliding_min(~least, span)                          # largest minimum of the windows around a gram
        place = np.flatnonzero((most == self.gram) & (most > 0))
        doc = self.words.doc()[place]
        value = self.gram[place]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        return doc[first], value[first], np.diff(np.append(first, len(doc))) > 1


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            g = Grams(part.column(2))
            doc, gram, twice = g.chosen()
            edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
            grams = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(gram.view(np.int64)))
            again = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(twice))
            digest = [kept_digest(t, None) for t in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(g.words.count, pa.int64()), pa.array(digest),
                                   grams, again], names=["id", "copy", "n_words", "digest", "grams", "again"])


def kept_digest(text: str | None, gone: np.ndarray | None) -> str:
    """SHA-256 of the words that stay, joined by one space."""
    words = (text or "").encode().split()
    if gone is not None:
        words = [words[k] for k in np.flatnonzero(~gone)]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in blocks of a few megabytes with the grams that repeat: one row a block."""
    part_no, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in pieces(batch, "text", BLOCK_BYTES):
            grams = np.unique(part.column(2).flatten().to_numpy())
            yield pa.record_batch([pa.array([part_no << 32 | n], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                                   pa.array([part.column(1).to_pylist()], pa.list_(pa.string())),
                                   pa.array([grams], pa.list_(pa.int64()))], names=["block", "nodes", "texts", "grams"])
            n += 1


class Suffixes:
    """Suffixes of one block that may repeat, equal ones side by side."""

    def __init__(self, texts: pa.Array, grams: np.ndarray):
        self.grams = Grams(texts)
        some = np.isin(self.grams.least, grams.view(np.uint64))
        at = self.grams.at[some]
        path = [self.grams.roll.windows(n, at) for n in PREFIXES]
        order = np.lexsort((path[-1], path[0]))
        self.at = at[order]
        self.path = [p[order] for p in path]
        new = np.ones(len(at), bool)
        new[1:] = (self.path[0][1:] != self.path[0][:-1]) | (self.path[-1][1:] != self.path[-1][:-1])
        self.first = np.flatnonzero(new)                              # one of each equal run
        self.size = np.diff(np.append(self.first, len(at)))
        self.run = np.cumsum(new) - 1


class Router:
    """Group of a suffix: by its first words, and where a group was split, by more of them."""

    def __init__(self, groups: int):
        self.total = self.groups = groups
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []      # split groups, first new one, how many

    def route(self, s: Suffixes) -> np.ndarray:
        group = (s.path[0][s.first] % np.uint64(self.groups)).astype(np.int64)
        for path, (split, first, n) in zip(s.path[1:], self.levels):
            at = np.minimum(np.searchsorted(split, group), len(split) - 1)
            deep = split[at] == group
            at = at[deep]
            group[deep] = first[at] + (path[s.first[deep]] % n[at].astype(np.uint64)).astype(np.int64)
        return group

    def deepen(self, large: dict[int, int], most: int) -> None:
        """Split groups of the given sizes by longer prefixes, into parts of about half of ``most``."""
        split = np.array(sorted(large), dtype=np.int64)
        n = np.array([-(-2 * large[g] // most) for g in sorted(large)], dtype=np.int64)
        self.levels.append((split, self.total + np.cumsum(n) - n, n))
        self.total += int(n.sum())


def _count(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            s = _suffixes(batch, row)
            group, n = np.unique(router.route(s), return_counts=True)
            yield pa.record_batch([pa.array(group, pa.int64()), pa.array(n, pa.int64())], names=["group", "n"])


def _suffixes(batch: pa.RecordBatch, row: int) -> Suffixes:
    col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    return Suffixes(col["texts"][row].values, col["grams"][row].values.to_numpy())


def _send(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    """Each block's suffixes, one row for each group."""
    for batch in batches:
        block = batch.column(0).to_pylist()
        for row in range(batch.num_rows):
            s = _suffixes(batch, row)
            group = router.route(s)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            rows = []
            for mine in np.split(order, cuts) if len(order) else ():
                first = s.first[mine]
                rows.append((int(group[mine[0]]), s.path[0][first].tobytes(), s.path[-1][first].tobytes(),
                             s.at[first].astype("<u4").tobytes(), np.packbits(s.size[mine] > 1).tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array([block[row]] * len(rows), pa.int64()),
                                   *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                  names=["group", "block", "prefix", "path", "at", "twice"])


def _subtree(table: pa.Table) -> pa.Table:
    """Leaves under deep nodes of one group: places of each block that also occur elsewhere."""
    blocks = table.column("block").to_numpy()
    at = [np.frombuffer(x, "<u4") for x in table.column("at").to_pylist()]
    size = np.array([len(x) for x in at])
    prefix = np.frombuffer(b"".join(table.column("prefix").to_pylist()), "<u8")
    path = np.frombuffer(b"".join(table.column("path").to_pylist()), "<u8")
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
                            for x, n in zip(table.column("twice").to_pylist(), size)])
    order = np.lexsort((path, prefix))
    same = (prefix[order][1:] == prefix[order][:-1]) & (path[order][1:] == path[order][:-1])
    deep = np.zeros(len(order), bool)
    deep[1:] |= same
    deep[:-1] |= same
    hit = np.zeros(len(order), bool)
    hit[order] = deep
    hit &= ~twice                                                   # the block knows of those itself
    owner = np.repeat(np.arange(len(size)), size)
    at, owner = np.concatenate(at)[hit], owner[hit]
    edge = np.searchsorted(owner, np.arange(len(blocks) + 1))
    rows = [(int(b), at[i:j].tobytes()) for b, i, j in zip(blocks, edge, edge[1:]) if j > i]
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "at": pa.array([x for _, x in rows], pa.binary())})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of covered words and the digest of the rest, for each text of a block."""
    for batch in batches:
        col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        for row in range(batch.num_rows):
            s = _suffixes(batch, row)
            found = np.frombuffer(b"".join(col["found"][row].as_py() or []), "<u4").astype(np.int64)
            again = np.zeros(len(s.grams.words) + 1, bool)
            again[found] = True
            start = s.at[(s.size > 1)[s.run] | again[s.at]] if len(s.at) else s.at
            edge = np.zeros(len(s.grams.words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            w, texts = s.grams.words, col["texts"][row].as_py()
            n, spans, digest = [], [], []
            for d, text in enumerate(texts):
                mine = gone[w.first[d]:w.first[d + 1]]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                n.append(int(mine.sum()))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2])])
                digest.append(kept_digest(text, mine))
            yield pa.record_batch([col["nodes"][row].values, pa.array(n, pa.int64()),
                                   pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                                   pa.array(digest)], names=["node", "n_removed", "spans", "digest"])


def repeated_substrings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Words of every document that lie in a window that also starts elsewhere.

    Columns: id, ``n_words``, ``n_removed``, ``spans`` (first and last word of
    each removed run, words from 0) and ``kept_sha256`` (of the words that
    stay, joined by one space).  Windows are judged on the input.  A null or
    short text has no window and loses nothing.  Every row gives one row; rows
    that repeat, ids included, are copies of each other; other columns are not
    read; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("copy"),
                       F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    known = scratch.write(rows.mapInArrow(_sketch, f"id {id_type}, copy binary, n_words long, digest string, "
                                          "grams array<long>, again array<boolean>")
                          .withColumn("row", F.monotonically_increasing_id()))
    nodes = scratch.write(known.groupBy("copy").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")))
    grams = (known.select("row", "grams", "again").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
             .select(F.col("row").alias("node"), F.explode(F.arrays_zip("grams", "again")).alias("g"))
             .select("node", F.col("g.grams").alias("gram"), F.col("g.again").alias("again")))
    often = (grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
             .filter("n > 1 or again").select("gram"))
    some = grams.select("node", "gram").join(often, "gram").groupBy("node").agg(F.collect_list("gram").alias("grams"))
    some = some.join(known.select(F.col("row").alias("node"), F.col("id").alias("nid"), F.col("copy").alias("ncopy")), "node")
    texts = (rows.join(some, (F.col("copy") == F.col("ncopy")) & F.col("id").eqNullSafe(F.col("nid")))
             .select("node", "text", "grams"))
    if not known.groupBy("id", "copy").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    blocks = scratch.write(texts.mapInArrow(
        _blocks, "block long, nodes array<long>, texts array<string>, grams array<long>"))
    # suffixes in a block stand at most at its words; about one in 14 has a gram of its own
    n = known.agg(F.sum("n_words")).first()[0] or 0
    router = Router(max(64, -(-4 * n // group_suffixes)))
    for _ in PREFIXES[1:]:
        counts = (blocks.mapInArrow(lambda it, r=router: _count(it, r), "group long, n long")
                  .groupBy("group").agg(F.sum("n").alias("n")).filter(F.col("n") > group_suffixes).collect())
        if not counts:
            break
        router.deepen({r["group"]: r["n"] for r in counts}, group_suffixes)
    sent = blocks.mapInArrow(lambda it, r=router: _send(it, r),
                             "group long, block long, prefix binary, path binary, at binary, twice binary")
    found = (sent.groupBy("group").applyInArrow(_subtree, "block long, at binary")
             .groupBy("block").agg(F.collect_list("at").alias("found")))
    removed = scratch.write(blocks.join(found, "block", "left").mapInArrow(
        _remove, "node long, n_removed long, spans array<struct<first:long,last:long>>, digest string"))
    all_ = known.select("id", "copy", "n_words", "digest").join(nodes, "copy").join(
        removed.select("node", "n_removed", "spans", F.col("digest").alias("rest")), "node", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= WINDOW)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_words") - 1).alias("last")))
    return all_.select(
        F.col("id").alias(id_col), "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "digest")).alias("kept_sha256"))

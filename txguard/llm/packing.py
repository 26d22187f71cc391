"""Best-fit packing of documents into sequences of fixed capacity.

Bulk-synchronous best fit.  In each round every waiting document looks for its
successor among the open gaps, the smallest gap that holds it; where several
want one gap, the longest document ranks first; gaps shrink by what they took,
and the round repeats.  When nothing fits, sequences are opened for the longest
waiting documents.

Documents and gaps are range-sorted by length, and equal lengths are
interchangeable, so the sorted lists are runs: at most ``capacity`` classes of
documents and of gaps, whatever the data holds.  A round sweeps the two lists
of runs and matches rank ranges, not single documents: its cost and the plan it
writes follow the capacity.  What grows with the data stays in Spark: encoding,
the range sort, each document's rank within its length, and looking that rank
up in the plan.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch
from txguard.llm.text import pieces as byte_pieces
from txguard.llm.tokens import encoder

PLAN_LIMIT = 4_000_000


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each document: one, or whole sequences after a first piece that may be shorter."""
    encode = encoder(path)
    for batch in batches:
        for part in byte_pieces(batch, "text"):
            owner, rows = [], []
            for d, ids in enumerate(encode(part.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    owner.append(d)
                    rows.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([part.column(0).take(pa.array(owner, pa.int64())), pa.array(cols[0], pa.int32()),
                                   *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                  names=["id", "piece", "start", "length", "ids_crc32"])


def _take(runs: list, n: int) -> list:
    """Remove n sequences from the front of a list of runs [first, count]."""
    out = []
    while n:
        first, count = runs[0]
        k = min(n, count)
        out.append((first, k))
        if k == count:
            runs.pop(0)
        else:
            runs[0] = [first + k, count - k]
        n -= k
    return out


def sweep_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Match rank ranges of documents to sequences.

    ``counts``: documents per length.  Returns rows ``(length, rank, n, sequence,
    offset)`` - the n documents of that length from ``rank`` on go to as many
    sequences from ``sequence`` on, at ``offset`` - and the number of sequences.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = defaultdict(int)
    gaps: dict[int, list] = {}
    plan, opened = [], 0

    def place(length: int, runs: list, gap: int) -> None:
        for first, n in runs:
            plan.append((length, rank[length], n, first, capacity - gap))
            rank[length] += n
            left[length] -= n
            if gap > length:
                gaps.setdefault(gap - length, []).append([first, n])
        if not left[length]:
            del left[length]

    def open_for(length: int, n: int) -> None:
        nonlocal opened
        opened += n
        place(length, [(opened - n, n)], capacity)

    for length in sorted(left, reverse=True):      # no two of these fit together
        if 2 * length > capacity:
            open_for(length, left[length])
    while left:
        sizes = np.array(sorted(gaps))
        wants = defaultdict(list)
        for length in sorted(left, reverse=True):
            k = np.searchsorted(sizes, length)
            if k < len(sizes):
                wants[int(sizes[k])].append(length)
        if wants:
            taken = {g: gaps.pop(g) for g in wants}
            for g, lengths in wants.items():
                free = sum(n for _, n in taken[g])
                for length in lengths:
                    n = min(free, left[length])
                    if n:
                        place(length, _take(taken[g], n), g)
                        free -= n
            for g, runs in taken.items():
                if runs:
                    gaps.setdefault(g, []).extend(runs)
            continue
        need = -(-sum(n * c for n, c in left.items()) // capacity)
        for length in sorted(left, reverse=True):
            n = min(need, left[length])
            open_for(length, n)
            need -= n
            if not need:
                break
    return plan, opened


def _assign(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    """Look (length, rank) up in the plan, sorted by both."""
    length, rank, seq, offset = plan.value
    key = length.astype(np.int64) << 44 | rank
    for batch in batches:
        col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        mine = col["length"].to_numpy() << 44 | col["rank"].to_numpy()
        at = np.searchsorted(key, mine, side="right") - 1
        yield pa.record_batch([*[col[n] for n in ("id", "piece", "start", "length", "ids_crc32")],
                               pa.array(seq[at] + (mine - key[at])), pa.array(offset[at])],
                              names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document with their sequence and place.

    Columns: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.  A null text is empty: one piece with the end
    id alone.  Null and repeated ids are documents like others.  An empty table
    gives an empty result.  Other columns are not read.
    """
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    # written before the range sort, which reads its input twice
    cut = scratch.write(rows.mapInArrow(lambda it: _cut(it, tokenizer, end_id, capacity), schema))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "id", "ids_crc32"]
    ranged = scratch.write(cut.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    short = ranged.filter(F.col("length") < capacity)
    runs = short.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))     # at most parts + capacity rows
    before = runs.select("length", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, opened = sweep_plan(counts, capacity)
    if len(plan) > PLAN_LIMIT:
        raise ValueError(f"packing plan of {len(plan)} rows: raise PLAN_LIMIT or lower the capacity")
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0], table[:, 1], table[:, 3], table[:, 4]))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "ids_crc32", "piece"))
    ranked = (short.withColumn("place", place).join(before, ["length", "part"])
              .select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank")))
    out = schema + ", sequence_id long, offset long"
    packed = ranked.mapInArrow(lambda it: _assign(it, shared), out)
    full = (ranged.filter(F.col("length") == capacity)
            .select("id", "piece", "start", "length", "ids_crc32",
                    (F.lit(opened) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return packed.unionByName(full).withColumnRenamed("id", id_col)

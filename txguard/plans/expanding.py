"""Exact expanding (running) median per key; NULL and NaN values are skipped.

Keys that fit in one task keep their values so far in a sorted list, one
insertion a row.  For keys too large for one task the work is cut:

The median of rows 1..g of a key needs the whole prefix, so it cannot be
cut with a halo.  For a hot key with n rows:

1. number the rows by time (g) and by value (v, ties broken by g) — exact
   positions from plans.sequence.positions;
2. cut g into time blocks of C rows (tb) and v into value bins of C rows;
3. count rows per (tb, bin) and prefix-sum over blocks: C_b[q] = rows of
   the prefix S_b (blocks before b) in bin q — a grid of (n/C)^2 cells;
4. for block b the medians of rows bC+1..bC+c need prefix ranks in
   [lo_b, hi_b] = [floor((bC+c+1)/2) - c, floor((bC+c)/2) + 1]; the bins
   overlapping that rank range give the candidates (<= 1.5C + 2C rows), and
   the prefix rows in lower bins are only counted (offset);
5. per (key, block) the exact k-th values are read as the block's rows are
   added in time order, to a sorted list or, in large blocks, to a Fenwick tree
   over candidates + block rows.  Blocks are runs of sorted rows in the Arrow
   batches of a partition, so a small block costs no call of its own.

Every group in every step is bounded by about 2.5C + 2C rows or by the
grid side n/C, whatever the size of the key.  C adapts per key:
C = max(block_rows, ceil(n / MAX_SIDE)), so the grid never exceeds
MAX_SIDE^2 cells per key.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from txguard.operators.mutations import bounded_broadcast
from txguard.plans.sequence import positions

MAX_SIDE = 20_000


def running_medians(batches: Iterator[pa.RecordBatch], key: str, value: str, name: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and time, with the median of the key's values so far; None before the first value."""
    current, seen = None, []
    for batch in batches:
        out = []
        for k, v in zip(batch.column(batch.schema.get_field_index(key)).to_pylist(),
                        batch.column(batch.schema.get_field_index(value)).to_pylist()):
            if k != current:
                current, seen = k, []
            if v is not None and v == v:
                insort(seen, v)
            n = len(seen)
            out.append(0.5 * seen[(n - 1) // 2] + 0.5 * seen[n // 2] if n else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])


def expanding_median_light(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df``, already dealt out by key, with the running median: one pass over each partition's sorted rows.

    No group is built: a task holds one Arrow batch and the values of one key.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    return df.sortWithinPartitions(key, *order).mapInArrow(lambda it: running_medians(it, key, value, name), schema)


#: Rows of a (key, block) from which on a Fenwick tree is used, not a sorted list.
LISTED_ROWS = 20_000


def block_medians(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows _k, _b, _off, _g, _v, _x in order of _k, _b, _g, candidates at _g = 0: the medians at the other rows."""
    current, held = None, []

    def medians() -> tuple:
        off, g, v, x = (np.concatenate(c) if len(held) > 1 else c[0] for c in zip(*held))
        n = int(np.searchsorted(g, 0, side="right"))
        found = _listed_medians if len(x) < LISTED_ROWS else _kth_medians
        return current[0], g[n:], found(int(off[0]), n, g, v, x)

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        keys = [k for k, g, _ in done for _ in range(len(g))]
        return pa.record_batch([pa.array(keys, kind), pa.array(np.concatenate([g for _, g, _ in done]), pa.int64()),
                                pa.array(np.concatenate([m for _, _, m in done]), pa.float64())], names=["_k", "_c", "_med"])

    for batch in batches:
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
        done = []
        for i, j in zip(starts, [*starts[1:], len(ids)]):
            if held and ids[i] != current:
                done.append(medians())
                held = []
            current = ids[i]
            held.append([c[i:j] for c in numbers])
        if done:
            yield batch_of(done)
    if held:
        yield batch_of([medians()])


def _listed_medians(off: int, n: int, g: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    seen, out = sorted(x[:n].tolist()), []
    for value, place in zip(x[n:].tolist(), g[n:].tolist()):
        insort(seen, value)
        out.append(0.5 * seen[(place + 1) // 2 - off - 1] + 0.5 * seen[place // 2 - off])
    return np.asarray(out, float)


def _kth_medians(off: int, n: int, g: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
    order = np.argsort(v, kind="stable")
    rank = np.empty(len(v), dtype=np.int64)
    rank[order] = np.arange(len(v))
    xs = x[order]
    size = len(v)
    tree = np.zeros(size + 1, dtype=np.int64)
    # build the Fenwick tree of the candidates in O(size)
    cnt = np.zeros(size + 1, dtype=np.int64)
    cnt[rank[:n] + 1] = 1
    tree[1:] = cnt[1:]
    for i in range(1, size + 1):
        j = i + (i & -i)
        if j <= size:
            tree[j] += tree[i]
    top = 1 << (size.bit_length())

    def add(i):
        i += 1
        while i <= size:
            tree[i] += 1
            i += i & -i

    def kth(k):  # 1-based k-th smallest present element -> local index
        pos, step = 0, top
        while step:
            nxt = pos + step
            if nxt <= size and tree[nxt] < k:
                pos = nxt
                k -= tree[nxt]
            step >>= 1
        return pos

    out = np.empty(size - n)
    for i, (place, r) in enumerate(zip(g[n:].tolist(), rank[n:].tolist())):
        add(r)
        k1 = (place + 1) // 2 - off
        k2 = place // 2 + 1 - off
        out[i] = 0.5 * xs[kth(k1)] + 0.5 * xs[kth(k2)]
    return out


def expanding_median_hot(counted: DataFrame, key: str, value: str, block_rows: int) -> DataFrame:
    """(_k, _c, _med): the median of the first ``_c`` values of each hot key.

    ``counted`` has ``_c``, the number of values up to the row (positions).
    """
    x = F.col(value)
    g = counted.filter(x.isNotNull() & ~F.isnan(x)).select(key, x.alias("_x"), F.col("_c").alias("_g"))
    rows = positions(g, key, ["_x", "_g"], out="_v")
    # one row per hot key: its size and block size C (bounded by the hot-key count)
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_C", F.greatest(F.lit(int(block_rows)).cast("bigint"),
                                      F.ceil(F.col("_n") / MAX_SIDE).cast("bigint")))
    rows = rows.join(bounded_broadcast(n), key)
    rows = rows.select(key, "_x", "_g", "_v",
                       F.floor((F.col("_g") - 1) / F.col("_C")).cast("bigint").alias("_tb"),
                       F.floor((F.col("_v") - 1) / F.col("_C")).cast("bigint").alias("_bin"))
    C = F.col("_C")
    nb = F.ceil(F.col("_n") / C).cast("bigint")
    m = rows.groupBy(key, "_tb", "_bin").agg(F.count(F.lit(1)).alias("_m"))
    blocks = (n.select(key, "_n", "_C", F.explode(F.sequence(F.lit(1).cast("bigint"), nb - 1)).alias("_b"),
                       nb.alias("_nb"))
               .filter(F.col("_b") < F.col("_nb")))
    # spread the block rows before the second explode, so no single task
    # generates a whole key's grid (up to MAX_SIDE^2 cells)
    blocks = blocks.repartition(key, "_b")
    grid = blocks.select(key, "_n", "_C", "_b",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)).alias("_q"))
    grid = grid.join(m.select(key, (F.col("_tb") + 1).alias("_b"), F.col("_bin").alias("_q"), "_m"),
                     [key, "_b", "_q"], "left").fillna(0, ["_m"])
    wq = Window.partitionBy(key, "_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_cb", F.sum("_m").over(wq))                    # prefix rows of S_b in bin q
    wb = Window.partitionBy(key, "_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_le", F.sum("_cb").over(wb)).withColumn("_lt", F.col("_le") - F.col("_cb"))
    bc = F.col("_b") * C
    c = F.least(C, F.col("_n") - bc)
    lo = F.greatest(F.lit(1).cast("bigint"), F.floor((bc + c + 1) / 2) - c)
    hi = F.least(bc, F.floor((bc + c) / 2) + 1)
    sel = grid.filter((F.col("_le") >= lo) & (F.col("_lt") < hi)).select(key, "_b", "_q", "_lt")
    offs = sel.groupBy(key, "_b").agg(F.min("_lt").alias("_off"))
    cands = (rows.join(sel.select(key, "_b", F.col("_q").alias("_bin")), [key, "_bin"])
             .filter(F.col("_tb") < F.col("_b"))
             .select(key, "_b", F.lit(0).cast("bigint").alias("_g"), "_v", "_x"))
    blk = rows.select(key, F.col("_tb").alias("_b"), "_g", "_v", "_x")
    parts = (cands.unionByName(blk).join(offs, [key, "_b"], "left")
             .select(F.col(key).alias("_k"), "_b", F.coalesce("_off", F.lit(0)).cast("bigint").alias("_off"), "_g", "_v", "_x"))
    schema = T.StructType([T.StructField("_k", counted.schema[key].dataType), T.StructField("_c", T.LongType()),
                           T.StructField("_med", T.DoubleType())])
    kind = to_arrow_type(counted.schema[key].dataType)
    return parts.repartition("_k", "_b").sortWithinPartitions("_k", "_b", "_g").mapInArrow(lambda it: block_medians(it, kind), schema)

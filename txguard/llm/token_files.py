"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

Documents are range-partitioned by id, so each shard is a run of the ascending
id order, and encoded shard by shard into blocks of about a million ids.  A
block ranks its distinct ids by frequency and stores ranks: a control stream of
two bits per value (bytes used, less one), four values to a control byte, apart
from the data bytes.  Decoding looks each control byte up in a table of four
widths, masks four-byte loads by width, and maps ranks back through the block's
id table, all in numpy.

Blocks are rows of a table written by Spark into the shared folder: a lost task
is written again, a committed file is whole, and any store Spark reaches will
do.  Blocks stand alone, so readers decode them in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch
from txguard.llm.text import pieces
from txguard.llm.tokens import encoder

BLOCK_IDS = 1 << 20

#: Widths of the four values of each control byte, their sum, and the mask of each width.
WIDTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)

BLOCK_SCHEMA = ("shard int, block int, first long, n_ids long, doc_ids array<{id}>, lengths array<long>, "
                "ranked binary, control binary, data binary")


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, each id's place among them, and their counts."""
    if not len(ids) or ids.max() >= 1 << 24:
        return np.unique(ids, return_inverse=True, return_counts=True)
    n = np.bincount(ids)
    distinct = np.flatnonzero(n)
    place = np.zeros(len(n), np.uint32)
    place[distinct] = np.arange(len(distinct), dtype=np.uint32)
    return distinct, place[ids], n[distinct]


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``ranked`` (ids by falling frequency), control bytes and data bytes of a block."""
    distinct, back, n = _distinct(ids)
    order = np.lexsort((distinct, -n))
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    value = rank[back]
    width = 1 + (value > 0xFF) + (value > 0xFFFF).astype(np.int64) + (value > 0xFFFFFF)
    code = np.zeros(-(-len(value) // 4) * 4, np.uint8)
    code[:len(value)] = width - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    raw = value.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < width[:, None]]
    return distinct[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(n_ids: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    width = WIDTHS[np.frombuffer(control, np.uint8)].ravel()[:n_ids]
    start = np.cumsum(width) - width
    lanes = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + b"\0\0\0\0", np.uint8), 4)
    value = np.ascontiguousarray(lanes[start]).view("<u4").ravel() & MASKS[width]
    return np.frombuffer(ranked, "<u4")[value]


def _write_blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, schema: pa.Schema) -> Iterator:
    encode = encoder(path)
    shard = TaskContext.get().partitionId()
    doc_ids, parts, first, block = [], [], 0, 0

    def flush():
        ids = np.concatenate(parts)
        ranked, control, data = pack(ids)
        return pa.record_batch([[shard], [block], [first], [len(ids)], pa.array([doc_ids], schema.field("doc_ids").type),
                                [[len(p) for p in parts]], [ranked], [control], [data]], schema=schema)

    held = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1))):
                doc_ids.append(doc)
                parts.append(np.append(ids, np.uint32(end_id)))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    first, block, held = first + held, block + 1, 0
                    doc_ids, parts = [], []
    if parts:
        yield flush()


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names) if n != "doc_ids"}
            ids = unpack(one["n_ids"], one["ranked"], one["control"], one["data"]).astype("<u4")
            length = np.array(one["lengths"], dtype=np.int64)
            end = np.cumsum(length)
            crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(end, length)]
            k = len(length)
            docs = batch.column(batch.schema.get_field_index("doc_ids"))[row].values
            yield pa.record_batch([docs, pa.array(np.full(k, one["shard"], np.int32)),
                                   pa.array(one["first"] + end - length), pa.array(length), pa.array(crc, pa.int64())],
                                  names=["id", "shard", "at", "n_tokens", "ids_crc32"])


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode every document and write its blocks; returns the written table of blocks.

    Documents stand in ascending id order, null ids first, equal ids by a hash
    of the text.  A null text is empty and has the end id alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    schema = BLOCK_SCHEMA.format(id=rows.schema["id"].dataType.simpleString())
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    blocks = rows.mapInArrow(lambda it: _write_blocks(it, tokenizer, end_id, arrow), schema)
    return Scratch(spark, "token-files").write(blocks)


def read_tokens(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode blocks: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``.

    An empty table of blocks gives an empty result.
    """
    total = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard, that is per partition of the writer
    before = total.select("shard", F.coalesce(F.sum("n").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    docs = blocks.mapInArrow(_read_blocks, f"id {id_type}, shard int, at long, n_tokens long, ids_crc32 long")
    return (docs.join(before, "shard")
            .select(F.col("id").alias(id_col), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))

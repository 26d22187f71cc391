"""Fill-in-the-middle texts by rotating blocks of one buffer in place.

A text is cut in three by two token borders.  The sentinels are put into one
``bytearray`` in the order in which the text stands, prefix, middle, suffix;
then two neighbouring blocks change places by three reversals, which needs no
second text.  Undoing the rotation and taking the sentinels out gives the text
back byte for byte.

Which document is transformed, where it is cut and in which form follows from
``seed`` and its id alone, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from txguard.llm.text import Words, pieces

# The sentinels, the seed and the two rates in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
TRANSFORM_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80


def swap_blocks(buf: bytearray, start: int, border: int, end: int) -> None:
    """Exchange the blocks start..border and border..end of the buffer by three reversals, in place."""
    bytes_ = np.frombuffer(buf, np.uint8)
    for a, b in ((start, border), (border, end), (start, end)):
        half = (b - a) // 2
        left, right = bytes_[a:a + half], bytes_[b - half:b][::-1]
        keep = left.copy()
        left[:] = right
        right[:] = keep


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with sentinels, cut at two byte positions; form ``spm`` or ``psm``."""
    buf = bytearray(text)
    buf[second:second] = SUFFIX
    buf[first:first] = MIDDLE
    buf[0:0] = PREFIX
    middle, suffix = len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + second
    if form == "psm":
        swap_blocks(buf, middle, suffix, len(buf))       # <M>middle and <S>suffix change places
    else:
        swap_blocks(buf, 0, suffix, len(buf))            # <S>suffix goes before all the rest
    return buf


def restore(output: bytes, form: str) -> bytes:
    """The text that ``rearrange`` was given; a plain text is returned as it is."""
    if form == "plain":
        return bytes(output)
    buf = bytearray(output)
    if form == "psm":
        start, border = buf.index(SUFFIX), buf.index(MIDDLE)
    else:
        start, border = 0, buf.index(PREFIX)
    swap_blocks(buf, start, border, len(buf))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):            # from the back, so that places in front stay
        at = buf.index(sentinel)
        del buf[at:at + len(sentinel)]
    return bytes(buf)


@dataclass(frozen=True)
class Choice:
    """What the id decides: two draws for the cuts, the form unless the text itself must stay plain."""
    cut_a: int
    cut_b: int
    form: str

    @staticmethod
    def of(doc_id, seed: int) -> Choice:
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h1, h2, h3, h4 = np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], ">u4").tolist()
        if h3 % 100 >= TRANSFORM_PERCENT:
            return Choice(h1, h2, "plain")
        return Choice(h1, h2, "spm" if h4 % 100 < SUFFIX_FIRST_PERCENT else "psm")


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def _transform(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            texts = pc.fill_null(part.column(1), "")
            w = Words(texts)
            rows = []
            for d, doc_id in enumerate(part.column(0).to_pylist()):
                begin, stop = int(w.offsets[d]), int(w.offsets[d + 1])
                text = w.buf[begin:stop].tobytes()
                # a token is a word with the white space before it; white space after the last word is one more
                ends = w.end[w.first[d]:w.first[d + 1]] - begin
                n = len(ends) + int(len(text) > (ends[-1] if len(ends) else 0))
                choice = Choice.of(doc_id, seed)
                form = choice.form
                if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    form = "plain"
                if form == "plain":
                    rows.append((n, form, None, None, text))
                    continue
                low, high = sorted((choice.cut_a % (n + 1), choice.cut_b % (n + 1)))
                first, second = (0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(text) for k in (low, high))
                rows.append((n, form, _code_points(text[:first]), _code_points(text[first:second]),
                             bytes(rearrange(text, first, second, form))))
            n, form, pre, mid, out = zip(*rows)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                                   pa.array(pre, pa.int64()), pa.array(mid, pa.int64()),
                                   pa.array(out, pa.binary()).cast(pa.string())],
                                  names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches: Iterator[pa.RecordBatch], at: int, form_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, batch.schema.field(at).name):
            texts = [None if t is None else restore(t.encode(), f or "plain")
                     for t, f in zip(part.column(at).to_pylist(), part.column(form_at).to_pylist())]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                  names=[*part.schema.names, "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per document: id, ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A null text is empty.  Empty texts and texts that contain a sentinel stay
    plain, with null counts.  A null id draws as the empty string; equal ids
    draw alike, so repeated rows give repeated results.  Other columns are not
    read, whatever their names; an empty table gives an empty result.  The work
    is one pass without a shuffle; memory follows the longest text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, "
              "middle_chars long, output string")
    return rows.mapInArrow(lambda it: _transform(it, seed), schema).withColumnRenamed("id", id_col)


def restore_texts(transformed: DataFrame, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """``transformed`` with the column ``restored``, the exact texts rebuilt from output and form alone.

    A null output stays null, a null form counts as plain.  All other columns
    are carried along; one already called ``restored`` is replaced.
    """
    rows = transformed.drop("restored")
    at, form_at = rows.columns.index(output_col), rows.columns.index(form_col)
    schema = StructType([*rows.schema.fields, StructField("restored", StringType())])
    return rows.mapInArrow(lambda it: _restore(it, at, form_at), schema)

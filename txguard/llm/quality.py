"""Quality rules: clean lines first, then judge the document.

Each line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed, and a document that loses too much of its text that way
is rejected.  Before that, plain counts of the whole text reject documents that
are too short or repeat themselves.  One pass over the documents, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txguard.llm.text import Rolling, Words, mix, pieces, span_hashes, text_column

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
NAVIGATION_WORDS = 12

# Fixed values of the line rules.
END_MARKS = ".!?:;)\"'”’»…。！？"
NAVIGATION = re.compile(r"[|»›·•>]")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "click here", "sign up for", "log in to", "lorem ipsum", "read more")

_NOT_WORD = re.compile("[\x20\x09-\x0D]+")

SCHEMA = ("id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, clean_text string")


def line_fails(line: str) -> bool:
    """A line with words fails on punctuation, navigation or boilerplate.

    Punctuation: no end mark although it has more than ``NAVIGATION_WORDS``
    words, or more than a tenth of its non-blank characters are symbols.
    Navigation: at most ``NAVIGATION_WORDS`` words and two or more separators.
    Boilerplate: it holds one of the phrases (A-Z lower-cased or not).
    """
    solid = _NOT_WORD.sub("", line)
    if 10 * len(SYMBOLS.findall(solid)) > len(solid):
        return True
    words = sum(1 for w in _NOT_WORD.split(line) if w)
    if words > NAVIGATION_WORDS:
        if solid[-1] not in END_MARKS:
            return True
    elif len(NAVIGATION.findall(solid)) >= 2:
        return True
    low = line.lower()
    return any(p in low for p in BOILERPLATE)


def clean_lines(text: str) -> tuple[str, int]:
    """The text without failing lines, and the word characters lost; lines without a word stay."""
    kept, lost = [], 0
    for line in text.split("\n"):
        solid = _NOT_WORD.sub("", line)
        if solid and line_fails(line):
            lost += len(solid)
        else:
            kept.append(line)
    return "\n".join(kept), lost


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Mask: the key stands at two or more places."""
    if not len(keys):
        return np.zeros(0, bool)
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The plain counts of every text of the batch."""
    w = Words(texts)
    buf, docs = w.buf, len(w.count)
    chars = _per_text(w.inside & ((buf & 0xC0) != 0x80), w.offsets)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    # lines: equal hashes within one text, lines without a word aside
    cut = np.zeros(len(buf) + 1, bool)
    cut[w.offsets] = True
    newline = buf == 10
    begin = np.flatnonzero(cut[:-1] | np.concatenate([[True], newline[:-1]])[:len(buf)])
    stop = np.append(begin[1:], len(buf))[:len(begin)]
    stop = stop - newline[stop - 1]
    has = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop = begin[has], stop[has]
    owner = np.searchsorted(w.offsets, begin, side="right") - 1
    line_key = mix(span_hashes(buf, begin, stop) + mix(owner.astype(np.uint64)))
    first = np.ones(len(begin), bool)
    order = np.argsort(line_key, kind="stable")
    first[order[1:]] = line_key[order[1:]] != line_key[order[:-1]]
    dup_lines = np.bincount(owner[~first], minlength=docs)
    # three-word windows found twice in one text: mark all their words
    marked = np.zeros(len(w) + 3, np.int32)
    if len(w) >= 3:
        at = np.flatnonzero(w.fits(3))
        key = mix(Rolling(w.hashes()).windows(3, at) + mix(w.doc()[at].astype(np.uint64)))
        again = at[_repeats(key)]
        np.add.at(marked, again, 1)
        np.add.at(marked, again + 3, -1)
    inside = np.cumsum(marked[:len(w)]) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    return {"n_words": w.count.astype(np.int64), "word_chars": chars, "n_symbols": _per_text(symbol[buf], w.offsets),
            "n_dup_lines": dup_lines.astype(np.int64),
            "n_repeat_words": (total[w.first[1:]] - total[w.first[:-1]]).astype(np.int64)}


def _judge(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            c = base_counts(text_column(part))
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            cleaned = [clean_lines(t or "") for t in text_column(part).to_pylist()]
            lost = np.array([n for _, n in cleaned], dtype=np.int64)
            kept = ~failed & (100 * lost <= MAX_LOST_PERCENT * c["word_chars"])
            yield pa.record_batch(
                [part.column(0), *map(pa.array, c.values()), pa.array(failed), pa.array(kept),
                 pa.array([t for t, _ in cleaned] if with_text else [None] * len(cleaned), pa.string())],
                names=["id", *c, "base_failed", "kept", "clean_text"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  with_text: bool = True) -> DataFrame:
    """Counts and verdict per document, and the text without the failing lines.

    A null or empty text has no words, fails and is not kept.  Every row gives
    one row, repeated or null ids included; other columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = SCHEMA.format(id=rows.schema["id"].dataType.simpleString())
    out = rows.mapInArrow(lambda it: _judge(it, with_text), schema).withColumnRenamed("id", id_col)
    return out if with_text else out.drop("clean_text")

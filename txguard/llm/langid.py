"""Language ID by words first, then shorter and shorter character n-grams.

A word known from training votes with its log frequency per language.  An
unknown word backs off: to its known n-grams of the greatest length that has
any, from four characters down to one.  Votes are normalised over the
languages, so known and unknown words weigh alike.

How far a text is in its language at all, however many languages were learned,
is told by ``known``: the mean over its words of 1 for a word that the language
has, else of the share of the word's three-character n-grams that it has.

Training counts words and n-grams of a bounded sample of labelled documents in
Spark and keeps the most frequent ones, so that the model is as large at any
corpus size.  Prediction is one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch, own_name
from txguard.llm.text import pieces

SAMPLE_ROWS = 10_000
MODEL_WORDS = 50_000
MODEL_GRAMS = 50_000
LONGEST_GRAM = 4
KNOWN_GRAM = 3
#: Unknown words that a worker remembers, and bytes of text in hand.
CACHE_WORDS, TEXT_BYTES = 200_000, 1 << 20
#: Words whose votes count as independent evidence in the score.
SCORE_WORDS = 10

_WORD = re.compile(r"[^\W\d_]+")


class Model:
    """Votes per language of known words and n-grams; picklable, sent to the workers once."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: dict[str, list[int]]):
        self.langs = langs
        self.words, self.word_votes, self.word_seen = self._votes(words)
        self.grams, self.gram_votes, self.gram_seen = self._votes(grams)

    def _votes(self, counts: dict[str, list[int]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        c = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), len(self.langs))
        total = c.sum(axis=0) + 1.0
        logp = np.log((c + 0.1) / total)
        top = logp.max(axis=1, keepdims=True) if len(logp) else logp
        logp = logp - (top + np.log(np.exp(logp - top).sum(axis=1, keepdims=True)))
        return {w: k for k, w in enumerate(counts)}, logp.astype(np.float32), (c > 0).astype(np.float32)

    def back_off(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in range(LONGEST_GRAM, 0, -1):
            source = marked if n > 1 else word
            known = [k for i in range(len(source) - n + 1) if (k := self.grams.get(source[i:i + n])) is not None]
            if known:
                return self.gram_votes[known].mean(axis=0)
        return np.full(len(self.langs), -np.log(len(self.langs)), dtype=np.float32)

    def familiar(self, word: str) -> np.ndarray:
        """Share of an unknown word's n-grams of ``KNOWN_GRAM`` characters that each language has."""
        marked = f"^{word}$"
        at = [self.grams.get(marked[i:i + KNOWN_GRAM]) for i in range(len(marked) - KNOWN_GRAM + 1)]
        known = [k for k in at if k is not None]
        return self.gram_seen[known].sum(axis=0) / len(at) if known else np.zeros(len(self.langs), np.float32)


class Predictor:
    """One model in one Python worker; remembers the votes of some unknown words."""

    def __init__(self, model: Model):
        self.model = model
        self.index = dict(model.words)
        self.votes, self.seen = model.word_votes, model.word_seen
        self.n = len(self.index)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        langs = self.model.langs
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        index = self.index
        new = list({w for ws in words for w in ws if w not in index})
        if self.n + len(new) > CACHE_WORDS + len(self.model.words):
            index = self.index = dict(self.model.words)
            self.votes, self.seen, self.n = self.model.word_votes, self.model.word_seen, len(index)
            new = list({w for ws in words for w in ws if w not in index})
        if new:
            self.votes = np.concatenate([self.votes, np.array([self.model.back_off(w) for w in new], dtype=np.float32)])
            self.seen = np.concatenate([self.seen, np.array([self.model.familiar(w) for w in new], dtype=np.float32)])
            index.update((w, self.n + k) for k, w in enumerate(new))
            self.n += len(new)
        out, score, known = [], [], []
        for text, ws in zip(texts, words):
            if not ws or not (any(map(str.isalpha, ws)) or any(map(str.isalpha, text))):
                out.append("und")
                score.append(0.0)
                known.append(0.0)
                continue
            at = [index[w] for w in ws]
            mean = self.votes[at].mean(axis=0, dtype=np.float64)
            p = np.exp((mean - mean.max()) * min(len(ws), SCORE_WORDS))
            best = int(p.argmax())
            out.append(langs[best])
            score.append(float(p[best] / p.sum()))
            known.append(float(self.seen[at, best].mean(dtype=np.float64)))
        return out, score, known


def train(spark: SparkSession, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` labelled documents, chosen by a hash of id and text (all, if there are fewer)."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    n = rows.count()
    share = int(2**30 * min(1.0, sample_rows / max(n, 1)))
    chosen = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(2**30)) < share)
    words = (chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
             .filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    words = Scratch(spark, "langid").write(words)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = (words.select("lang", "n", F.explode(_grams(marked)).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    return Model(langs, _top(words, MODEL_WORDS, langs), _top(grams, MODEL_GRAMS, langs))


def _grams(marked):
    """All n-grams of a word; those longer than one character see the word's borders."""
    parts = [F.filter(F.split("word", ""), lambda c: c != "")]
    for size in range(2, LONGEST_GRAM + 1):
        last = F.length(marked) - (size - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        parts.append(_substrings(at, marked, size))
    return F.concat(*parts)


def _substrings(at, marked, size: int):
    return F.transform(at, lambda i: F.substring(marked, i, F.lit(size)))


def _top(counts: DataFrame, limit: int, langs: list[str]) -> dict[str, list[int]]:
    """Counts per language of the most frequent entries, at most ``limit`` of them."""
    best = (counts.groupBy("word").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
            .orderBy(F.desc("all"), "word").limit(limit))
    return {r["word"]: [r["by"].get(x, 0) for x in langs] for r in best.collect()}


def _predict(batches: Iterator[pa.RecordBatch], shared, text: str) -> Iterator[pa.RecordBatch]:
    predictor = Predictor(shared.value)
    for batch in batches:
        at = batch.schema.get_field_index(text)
        for part in pieces(batch, text, TEXT_BYTES):
            lang, score, known = predictor(part.column(at).to_pylist())
            yield pa.record_batch([*[c for k, c in enumerate(part.columns) if k != at], pa.array(lang, pa.string()),
                                   pa.array(score, pa.float64()), pa.array(known, pa.float64())],
                                  names=[*[n for n in part.schema.names if n != text], *PREDICTED])


PREDICTED = ("lang_pred", "score", "known")


def predict(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``known`` (both 0 to 1) from the text alone.

    ``und`` with 0 and 0 for a null text, one without a letter, or a model that
    saw no language.  All rows and columns stay, whatever their names; columns
    named as the three are replaced.  An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in PREDICTED]
    text = own_name(docs, "text_to_predict")
    rows = docs.select(*keep, F.col(text_col).alias(text))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]],
                        "lang_pred string", "score double", "known double"])
    shared = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda it: _predict(it, shared, text), schema)

"""License scans: a positional index of rare licence words, in DataFrame functions only.

Templates are licence texts with mandatory key phrases.  Document frequencies of
the licence words, counted over all documents, pick the words with the highest
IDF among those of each template's key phrases, so that a notice that has the
phrases is always found, whatever else of the text it has.  They are the index:
one literal table, word -> postings (template, position).  A file looks up its
words in it, each hit becomes the places where its templates would start (file
position less template position), and a start on which the template's other rare
words agree is a candidate.  It counts when the key phrases stand there word for
word.  Plan and work grow with the words that hit, not with the number of
templates.  Nothing but the word counts is shuffled: the scan is one projection
over the files.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.plans.fence import fence

#: What lies between words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``text`` of the licence; ``keys``: phrases of it that must stand at their place; ``base``: reported apart."""
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


# Phrases whose every place is reported, and licence texts.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and or distribute this software",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license", ("licensed under the apache license version 2 0",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("gpl-3", "is licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general "
             "public license", ("free software", "gnu general public license")),
    Template("lgpl", "it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "it under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
             ("creative commons attribution sharealike 4 0",)),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal",
             ("cc0 1 0 universal",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)


def file_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def word_idf(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each licence word over all documents (one row per vocabulary word reaches the driver)."""
    n = words.select(F.count(F.lit(1)).alias("word"), F.lit(None).cast("string").alias("w"))
    df = (words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))).alias("w"))
          .groupBy("w").agg(F.count(F.lit(1)).alias("word")))
    counts = {r["w"]: r["word"] for r in df.unionByName(n).collect()}
    total = counts.pop(None)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def _key_places(t: Template) -> dict[int, str]:
    """Position -> word of the template's key phrases; of the whole text for a base phrase."""
    words = t.text.split()
    out = {}
    for phrase in [t.text] if t.base else t.keys:
        part = phrase.split()
        at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        out |= {at + k: w for k, w in enumerate(part)}
    return out


def rare_positions(t: Template, idf: dict[str, float], rare: int) -> list[int]:
    """Positions of the key phrases' words with the highest IDF; the earlier one among equals."""
    places = _key_places(t)
    return sorted(places, key=lambda p: (-idf[places[p]], p))[:rare]


def _text(value: str) -> str:
    return "'" + value + "'"                 # licence words hold no quotes


def _postings(templates: tuple[Template, ...], rarest: list[list[int]]) -> tuple[Column, list[str]]:
    """Literal index, each template's rarest word -> array of (template, position), and its words."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, (t, at) in enumerate(zip(templates, rarest)):
        index.setdefault(t.text.split()[at[0]], []).append((k, at[0]))
    pairs = ", ".join(f"{_text(w)}, array({', '.join(f'struct({k} AS t, {p} AS p)' for k, p in at)})" for w, at in sorted(index.items()))
    return F.expr(f"map({pairs})"), sorted(index)


def _places(lists: list[dict[int, str]]) -> Column:
    """Literal array over the templates of their (position, word) pairs."""
    return F.expr("array(" + ", ".join("cast(array(" + ", ".join(f"struct({p} AS p, {_text(w)} AS w)" for p, w in sorted(at.items()))
                                       + ") AS array<struct<p: int, w: string>>)" for at in lists) + ")")


def _starts(index: Column) -> Column:
    """(template, start) pairs that the hits of a file give."""
    return F.flatten(F.transform("hits", lambda i: F.transform(
        F.element_at(index, F.get("words", i)), lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("s")))))


def _agreed(column: str, places: Column) -> Column:
    """Those pairs at whose relative positions the template's ``places`` have their words."""
    return F.filter(column, lambda c: (c["s"] >= 0) & F.forall(F.get(places, c["t"]), _stands(c)))


def _stands(c: Column):
    return lambda x: F.coalesce(F.get("words", c["s"] + x["p"]) == x["w"], F.lit(False))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES, rare: int = 2) -> DataFrame:
    """Licence labels per document.

    Columns: id, ``n_words``, ``n_base`` (places of the base phrases),
    ``first_word``/``last_word`` (smallest and largest start of one, else null),
    ``base_labels``, ``labels`` (distinct, sorted, comma-joined; empty without
    any), ``score`` (largest share of a found template's words that stand at
    their place: 1.0 for a base phrase, 0.0 without any).  A null or empty text
    has no words.  Every row gives one row, repeated or null ids included;
    other columns are not read; an empty table gives an empty result.
    """
    every = BASE + tuple(templates)
    vocabulary = sorted({w for t in every for w in t.text.split()})
    words = docs.select(F.col(id_col).alias("id"), file_words(F.col(text_col)).alias("words"))
    idf = word_idf(words, vocabulary)
    rarest = [rare_positions(t, idf, rare) for t in every]
    index, lookup = _postings(every, rarest)
    others = _places([{p: t.text.split()[p] for p in at[1:]} for t, at in zip(every, rarest)])
    keys, texts = _places([_key_places(t) for t in every]), _places([dict(enumerate(t.text.split())) for t in every])
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(lookup), i)), lambda i: i.isNotNull())
    found = fence(words, ["words"]).withColumn("hits", hits)
    found = fence(found, ["hits"]).withColumn("pairs", _starts(index))
    found = fence(found, ["pairs"]).withColumn("agreed", _agreed("pairs", others))
    found = fence(found, ["agreed"]).withColumn("found", _agreed("agreed", keys))
    found = fence(found, ["found"]).select("id", "words", "found")
    starts = F.transform(F.filter("found", lambda c: c["t"] < len(BASE)), lambda c: c["s"])
    names = F.expr(f"array({', '.join(_text(t.label) for t in every)})")

    def labels(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.get(names, x["t"])))), ",")

    def cover(c: Column) -> Column:
        own = F.get(texts, c["t"])
        return F.size(F.filter(own, _stands(c))) / F.size(own)

    return found.select(
        F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(F.filter("found", lambda c: c["t"] < len(BASE))).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", cover)), F.lit(0.0)).alias("score"))

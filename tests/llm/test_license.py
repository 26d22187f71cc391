import random
import re

from tests.llm.helpers import SF001, edge_docs, edge_rows, empty_docs
from txguard.llm.license_scan import BASE as BASE_TEMPLATES
from txguard.llm.license_scan import TEMPLATES, scan_licenses

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def base_of(df):
    return [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in df.collect()]


def test_base_places_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["under the MIT License", "Apache-License, version 2", "CC BY-NC", "cc by", "mit", "the", "under", "apache", "nc\n",
            "license", "version 2", "2.0", "é", "x_y", "\x00", "[", "Z"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert base_of(scan_licenses(docs).orderBy("doc_id")) == [brute(t) for t in texts]


def test_base_over_a_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert base_of(scan_licenses(docs).orderBy("doc_id")) == [brute(t) for t in texts]


def test_labels_of_the_method(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on"
    texts = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", mit,
             "All rights reserved. Licensed under CC BY-NC 4.0.", "the general license of public rights was granted", "gnu public"]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "gpl-3", "mit", "cc-by-nc,proprietary", "", ""]
    assert [r["score"] for r in got] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]


def test_edges(spark):
    assert sorted(base_of(scan_licenses(edge_docs(spark))), key=repr) == sorted((brute(r[1]) for r in edge_rows()), key=repr)
    assert scan_licenses(empty_docs(spark)).count() == 0


def test_main_path_has_no_python(spark):
    plan = scan_licenses(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def label_brute(text):
    """All labels and the score: templates whose key phrases stand at their place, by looking everywhere."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, best = set(), 0.0
    for t in (*BASE_TEMPLATES, *TEMPLATES):
        own = t.text.split()
        phrases = [p.split() for p in ([t.text] if t.base else t.keys)]
        at = [next(i for i in range(len(own)) if own[i:i + len(p)] == p) for p in phrases]
        for s in range(len(w)):
            if all(w[s + a:s + a + len(p)] == p for a, p in zip(at, phrases)):
                labels.add(t.label)
                best = max(best, sum(s + k < len(w) and w[s + k] == x for k, x in enumerate(own)) / len(own))
        # a template may begin in front of the file
    return ",".join(sorted(labels)), best


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(300):
        t = rng.choice([*BASE_TEMPLATES, *TEMPLATES]).text.split()
        lo = rng.randrange(len(t)) if rng.random() < 0.3 else 0
        part = [x for x in t[lo:] if rng.random() > 0.03]
        texts.append(" ".join([*rng.choices(["word", "license", "gnu", "public", "the"], k=rng.randrange(4)), *part, "and", *rng.choices(t, k=3)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["labels"], r["score"]) for r in scan_licenses(docs).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [label_brute(t)[0] for t in texts]
    assert max(abs(g[1] - label_brute(t)[1]) for g, t in zip(got, texts)) < 1e-12
    assert len({g[0] for g in got}) > 10


def test_a_notice_with_its_key_phrase_is_found_whatever_else_it_has(spark):
    texts = ["Distributed under GNU General Public License, version 3, by us", "See the Mozilla Public License, v. 2.0.",
             "under the GNU Lesser General Public License", "CC0 1.0 Universal",
             "Creative Commons Attribution-ShareAlike 4.0", "Licensed under the Apache License, Version 2.0"]
    filler = " ".join(["some words that come before the notice and are not of it"] * 3)
    docs = spark.createDataFrame([(k, f"{filler} {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    got = [r["labels"] for r in scan_licenses(docs).orderBy("doc_id").collect()]
    assert got == ["gpl-3", "mpl-2", "lgpl", "cc0", "cc-by-sa", "apache-2"]


def test_the_plan_does_not_grow_with_the_templates(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    steps = [scan_licenses(docs, templates=t)._jdf.queryExecution().optimizedPlan().toString().count("Project") for t in (TEMPLATES[:2], TEMPLATES)]
    assert steps[0] == steps[1]

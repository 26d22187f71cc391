import random

import pytest

from tests.llm.helpers import DOCS, SF01, edge_docs, edge_rows, empty_docs
from txguard.llm.langid import Model, Predictor, predict, train
from txguard.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    got = QUERIES["op9_language_id"](spark, SF01).alias("g")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").alias("d")
    rows = got.join(docs, "doc_id").filter("held_out").selectExpr("lang_pred", "lang", "score").collect()
    assert len(rows) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_before_grams():
    m = Model(["de", "en"], {"der": [90, 0], "the": [0, 90]}, {"the": [50, 1], "sch": [50, 1], "ing$": [1, 50], "x": [1, 1]})
    lang, score, known = Predictor(m)(["the", "schxyz", "zzing", "qqq", None, "12 --", ""])
    assert lang[:3] == ["en", "de", "en"] and lang[4:] == ["und"] * 3
    assert score[3] == pytest.approx(0.5) and score[4:] == [0.0] * 3
    # "the" is a word of English; of ^sc sch chx hxy xyz yz$ one is known; ing$ is no n-gram of three characters
    assert known == pytest.approx([1.0, 1 / 6, 0.0, 0.0, 0.0, 0.0, 0.0])


def test_edges(spark):
    rng = random.Random(1)
    text = {"en": "the house and the garden of my friend", "de": "das Haus und der Garten von meinem Freund"}
    rows = [(i, " ".join(rng.sample(text[x].split(), 6)), x, "s", 1) for i, x in enumerate(["en", "de"] * 30)]
    model = train(spark, spark.createDataFrame(rows + edge_rows(), DOCS))
    assert model.langs == ["de", "en"]
    docs = edge_docs(spark).withColumnRenamed("n_words", "score")
    got = predict(spark, docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "known"]
    assert got.count() == len(edge_rows())
    assert {r["lang_pred"] for r in got.collect() if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert predict(spark, empty_docs(spark), model).count() == 0
    untrained = train(spark, empty_docs(spark))
    assert {r["lang_pred"] for r in predict(spark, docs, untrained).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id % 50) AS text", "'en' AS lang")
    m = train(spark, docs, sample_rows=200)
    assert m.langs == ["en"] and 0 < len(m.words) <= 50


def brute(train_rows, texts):
    """Language, score and share of known words by plain Python; train_rows are (text, lang)."""
    import math
    import re
    from collections import Counter
    words = {}
    for t, lang in train_rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            words.setdefault(w, Counter())[lang] += 1
    langs = sorted({x for _, x in train_rows})
    grams = {}
    for w, by in words.items():
        m = f"^{w}$"
        parts = list(w) + [m[i:i + n] for n in (2, 3, 4) for i in range(len(m) - n + 1)]
        for g in parts:
            for lang, n in by.items():
                grams.setdefault(g, Counter())[lang] += n

    def votes(table, entry):
        total = {x: sum(c[x] for c in table.values()) + 1 for x in langs}
        v = [math.log((table[entry][x] + 0.1) / total[x]) for x in langs]
        norm = math.log(sum(math.exp(a) for a in v))
        return [a - norm for a in v]

    out = []
    for t in texts:
        ws = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not ws:
            out.append(("und", 0.0, 0.0))
            continue
        mean, shares = [0.0] * len(langs), [0.0] * len(langs)
        for w in ws:
            if w in words:
                v, s = votes(words, w), [float(words[w][x] > 0) for x in langs]
            else:
                m = f"^{w}$"
                v = [-math.log(len(langs))] * len(langs)
                for n in (4, 3, 2, 1):
                    src = m if n > 1 else w
                    have = [src[i:i + n] for i in range(len(src) - n + 1) if src[i:i + n] in grams]
                    if have:
                        v = [sum(votes(grams, g)[k] for g in have) / len(have) for k in range(len(langs))]
                        break
                three = [m[i:i + 3] for i in range(len(m) - 2)]
                s = [sum(g in grams and grams[g][x] > 0 for g in three) / len(three) for x in langs]
            mean = [a + b / len(ws) for a, b in zip(mean, v)]
            shares = [a + b / len(ws) for a, b in zip(shares, s)]
        p = [math.exp((a - max(mean)) * min(len(ws), 10)) for a in mean]
        best = p.index(max(p))
        out.append((langs[best], p[best] / sum(p), shares[best]))
    return out


ENGLISH = "the house and the garden of my friend are near the river where children play with their small boats"
GERMAN = "das Haus und der Garten von meinem Freund liegen nahe am Fluss wo Kinder mit ihren kleinen Booten spielen"
FRENCH = "la maison et le jardin de mon ami sont pres de la riviere ou les enfants jouent avec leurs petits bateaux"
SPANISH = "la casa y el jardin de mi amigo estan cerca del rio donde los ninos juegan con sus pequenos barcos"


def lines(rng, text, n, k):
    return [" ".join(rng.choices(text.split(), k=k)) for _ in range(n)]


@pytest.mark.parametrize("languages", [2, 4])
def test_predictions_against_brute_force(spark, languages):
    rng = random.Random(languages)
    sources = dict(list({"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH}.items())[:languages])
    rows = [(t, lang) for lang, text in sources.items() for t in lines(rng, text, 12, 8)]
    texts = [t for text in (ENGLISH, GERMAN, FRENCH, SPANISH) for t in lines(rng, text, 6, 5)]
    texts += ["xqz vkjw pfgh", "", None, "12 34", "housegarden boatsplay Freundin", "\u0434\u043e\u043c \u0438 \u0441\u0430\u0434", "the"]
    model = train(spark, spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = predict(spark, docs, model).orderBy("doc_id").collect()
    for r, (lang, score, known) in zip(got, brute(rows, texts)):
        assert r["lang_pred"] == lang, r
        assert (r["score"], r["known"]) == pytest.approx((score, known), abs=1e-5), r


@pytest.mark.parametrize("languages", [2, 4])
def test_the_pipeline_rejects_what_no_language_knows(spark, languages):
    """However many languages were learned: gibberish and another script go, learned languages stay."""
    import corpus_pipeline as p
    rng = random.Random(7)
    sources = list({"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH}.items())[:languages]
    rows = [(k * 100 + i, t, lang, "s", 1) for k, (lang, text) in enumerate(sources) for i, t in enumerate(lines(rng, text, 40, 9))]
    junk = ["xqzv kjwx pfgh zzkq wvvx", "qwrt plkj zxcv bnmq hgfd", "\u0434\u043e\u043c \u0438 \u0441\u0430\u0434", "\u03bf\u03b9\u03ba\u03bf\u03c2", "123 456", "", None]
    bad = [(9000 + i, t, None, "s", 1) for i, t in enumerate(junk)]
    kept = {r["doc_id"] for r in p.language_id(spark, spark.createDataFrame(rows + bad, DOCS), "").collect()}
    assert kept == {r[0] for r in rows}


def test_columns_of_any_name(spark):
    docs = edge_docs(spark)
    for name in ("__text", "text_to_predict", "_text_to_predict", "known"):
        docs = docs.withColumn(name, docs["source"])
    model = train(spark, spark.createDataFrame([(1, ENGLISH, "en"), (2, GERMAN, "de")], "doc_id long, text string, lang string"))
    got = predict(spark, docs, model)
    assert got.filter("text_to_predict <=> source and __text <=> source").count() == len(edge_rows())

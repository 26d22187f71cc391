"""Small inputs and brute-force versions for the text operators."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows(seed=0):
    """Nulls in every column, empty, blank, very long and repeated texts, ties and equal ids."""
    rng = random.Random(seed)
    long_ = prose(rng, 30_000, 50_000)
    same = prose(rng, 80) + ".\n" + prose(rng, 60) + "."
    return [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t \x0b", "en", None, 5), (None, same, "en", "a", None),
        (4, same, "en", "b", 1), (4, same, "en", "b", 1), (4, prose(rng, 70), "de", "c", 1), (None, None, None, None, None),
        (5, long_, "en", "a", 1), (6, long_ + " end", "en", "b", 1), (7, "one", "en", "c", 3), (8, "one two", "de", "c", 7),
        (9, "½ 12 34 --", "en", "c", 7), (10, "漢字 \U0001F600 é", "de", "c", 7), (11, "same " * 300, "en", "d", 7),
        (12, "\x00\x1f ctrl\x85 nbsp\xa0x", "en", "d", 7),
    ]


def edge_docs(spark, extra=True):
    """The rows above; ``extra`` adds columns named like the operators' own ones."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows(), DOCS)
    if extra:
        for name in ("id", "key", "row", "node", "label", "line", "site", "print", "n", "part", "rank", "block", "copy",
                     "kept", "n_words", "start", "piece"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)

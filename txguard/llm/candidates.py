"""Steps that candidate searches share: filters that need no shuffle, equal posting lists, texts of few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.llm.scratch import Scratch

#: Bits of a filter per value, and its most words of 64 bits; beyond that it lets more through, never less.
BITS_PER_VALUE = 12
MOST_WORDS = 1 << 20


def _word(value: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), value), F.lit(words))


def _pattern(value: Column) -> Column:
    """Three bits of a word."""
    h = F.xxhash64(F.lit(2), value)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * k), F.lit(64)).cast("int")) for k in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def likely(df: DataFrame, value: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose long column ``value`` may be in the one column of ``wanted``: all that are, and few others.

    With ``how="left_anti"`` the rest: rows that are not, but for few.

    A Bloom filter in words of 64 bits is built by aggregation and broadcast, at
    most ``MOST_WORDS`` rows of two longs (16 MB) however many values there are,
    so rows that are not wanted never leave their task.
    """
    words = 64
    while words < min(MOST_WORDS, BITS_PER_VALUE * wanted.count() // 64):
        words *= 2
    col = F.col(wanted.columns[0])
    masks = (wanted.select(_word(col, words).alias("__word"), _pattern(col).alias("__bits"))
             .groupBy("__word").agg(F.bit_or("__bits").alias("__mask")))
    mine = _pattern(df[value])
    return df.join(F.broadcast(masks), (_word(df[value], words) == masks["__word"]) & (masks["__mask"].bitwiseAND(mine) == mine),
                   how)


def without(scratch: Scratch, df: DataFrame, value: str, gone: DataFrame) -> DataFrame:
    """The rows of ``df`` whose long column ``value`` is not in the one column of ``gone``; few rows leave their task for it."""
    unsure = scratch.write(likely(df.select(value), value, gone).join(gone, df[value] == gone[gone.columns[0]], "left_anti"))
    return (likely(df, value, gone, "left_anti")
            .unionByName(likely(df, value, unsure).join(unsure.distinct(), value, "left_semi")))


def one_per_member_list(postings: DataFrame, key: str = "key", node: str = "node") -> DataFrame:
    """Of keys with exactly the same nodes one is kept, those of single nodes go; rows ``key, node, members``.

    Two lists are the same when their lengths and two 64-bit sums over hashed
    nodes are.  All three are sums, so a long list is never one group in one task.
    """
    sums = [F.sum(F.shiftright(F.xxhash64(F.lit(salt), node), 20)).alias(f"h{salt}") for salt in (1, 2, 3)]
    lists = postings.groupBy(key).agg(F.count(F.lit(1)).alias("members"), *sums).filter("members > 1")
    kept = lists.groupBy("members", "h1", "h2", "h3").agg(F.min(key).alias(key)).select(key, "members")
    return postings.select(key, node).join(kept, key).select(key, node, "members")


def texts_of(scratch: Scratch, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of ``nodes`` (node, print, check), from rows (text, print, check); prints are two hashes of the text.

    Only rows whose print may be a node's leave their task, and equal texts are
    one row before they do.
    """
    mine = likely(rows, "print", nodes.select("print")).select("print", "check", "text")
    mine = mine.groupBy("print", "check").agg(F.first("text").alias("text"))
    return scratch.write(mine.join(nodes.select("node", "print", "check"), ["print", "check"]).select("node", "text"))

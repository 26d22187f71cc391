"""The registered queries of these operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.conversation_repair import damage, repair_conversations, repair_report
from txguard.llm.decontaminate import find_leaks
from txguard.llm.jaccard_join import jaccard_components
from txguard.llm.langid import predict, train
from txguard.llm.license_scan import scan_licenses
from txguard.llm.line_dedup import line_dedup
from txguard.llm.middle import fill_in_middle, restore_texts
from txguard.llm.minhash_dedup import minhash_components
from txguard.llm.packing import pack_documents
from txguard.llm.quality import (BOILERPLATE, END_MARKS, MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NAVIGATION_WORDS,
                                 quality_rules)
from txguard.llm.substring_dedup import repeated_substrings
from txguard.llm.token_files import read_tokens, write_tokens
from txguard.llm.url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    """File of a public tokenizer, installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The rules of the query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query("op1_url_filters", rf"""
WITH rules(rhost, rpath, v) AS (VALUES {_RULE_ROWS}),
u AS (SELECT row_number() OVER () AS r, page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
hit AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
        arg_max(v, length(rhost || rpath)) AS v
        FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hit USING (r)
""")
def op1_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(spark, _table(spark, sf_dir, "pages"), rules)


@query("op5_license_scans")
def op5_license_scans(spark, sf_dir):
    return scan_licenses(_table(spark, sf_dir, "documents"))


_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
_MARKS = ", ".join("'" + c.replace("'", "''") + "'" for c in END_MARKS)


@query("op4_quality_rules", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN again USING (r, s), range(0, 3) AS x(k) GROUP BY r),
line AS (SELECT r, l, regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') AS s
         FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (SELECT r, l, s, 10 * len(regexp_extract_all(s, '[#*$%&|<>]')) > length(s)
           OR CASE WHEN len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > {NAVIGATION_WORDS} THEN right(s, 1) NOT IN ({_MARKS})
                   ELSE len(regexp_extract_all(s, '[|»›·•>]')) >= 2 END
           OR {_PHRASES} AS fails FROM line),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS dup, coalesce(sum(length(s)) FILTER (WHERE fails), 0) AS lost
          FROM judged GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN cover USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
           AND 100 * lost <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM c
""")
def op4_quality_rules(spark, sf_dir):
    return quality_rules(_table(spark, sf_dir, "documents"), with_text=False)


@query("op3_token_binary")
def op3_token_binary(spark, sf_dir):
    blocks = write_tokens(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(blocks)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


_SOLID = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: NOT regexp_matches(s, '^[\x20\x09-\x0D]*$'))"


@query("op7_line_dedup", rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS site, text, {_SOLID} AS solid FROM documents),
p AS (SELECT site, unnest(list_distinct(solid)) AS line, list_sort(list_distinct(solid)) AS own FROM d),
spread AS (SELECT line FROM p GROUP BY line HAVING count(DISTINCT site) >= 5 AND count(DISTINCT own) >= 5),
bad AS (SELECT coalesce(list(line), []) AS b FROM spread)
SELECT doc_id, CAST(len(solid) AS BIGINT) AS n_lines,
       CAST(len(list_filter(solid, lambda s: list_contains(b, s))) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(string_split(text, chr(10)),
            lambda s: NOT list_contains(b, s)), chr(10)) END AS text
FROM d, bad
""")
def op7_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(spark, docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    model = train(spark, docs.filter("doc_id is not null and not held_out"))
    return predict(spark, docs.select("doc_id", "held_out", "text"), model).drop("text")


@query("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    return find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op6_substring_dedup", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
        FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i FROM win JOIN again USING (s)),
cover AS (SELECT DISTINCT r, i + k AS p FROM hit, range(0, 35) AS t(k)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
left_ AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN cover USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)
""")
def op6_substring_dedup(spark, sf_dir):
    return repeated_substrings(spark, _table(spark, sf_dir, "documents")).drop("spans")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                     regexp_extract_all(@LOWER, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d),
flat AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
both_ AS (SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS c FROM flat a JOIN flat b USING (x)
          WHERE a.r <> b.r AND 100 * least(a.n, b.n) >= @PERCENT * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM both_ WHERE 100 * c >= @PERCENT * (an + bn - c)),
reach(r, m) AS (SELECT r, r FROM sets UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.m = link.a)
""".replace("@LOWER", _LOWER)

@query("op8_ngram_jaccard", COMPONENTS_SQL.replace("@PERCENT", "90") + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id
FROM sets s JOIN reach ON reach.r = s.r JOIN sets t ON t.r = reach.m GROUP BY s.r, s.doc_id, s.s
""")
def op8_ngram_jaccard(spark, sf_dir):
    return jaccard_components(spark, _table(spark, sf_dir, "documents"))


@query("op13_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
             ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                     OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
             array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op13_fill_in_middle(spark, sf_dir):
    done = restore_texts(fill_in_middle(_table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


# one row per place and state: (cost, edits, repaired text) of the cheapest edits so far, least string first
_TURN = """struct_pack(c := {s}.c + 3, a := {s}.a || 'I', m := {s}.m || chr(10) || '{role}:')"""
_USER_IN, _ASSISTANT_IN = (_TURN.format(s=s, role=r) for s, r in (("{s}", "user"), ("{s}", "assistant")))


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(state: str, letter: str, cost: str, text: str | None) -> str:
    said = f" || chr(10) || {text} || ':' || t" if text else ""
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', m := {state}.m{said})"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN k = '{initial}' THEN {_edit(state, 'K', '3 * late', 'role')} ELSE struct_pack(c := 1000000000, a := '', m := '') END"


def _rerole(state: str, role: str) -> str:
    return (f"CASE WHEN k <> 'X' THEN {_edit(state, 'R', '(3 + 3 * late)', repr(role))} "
            "ELSE struct_pack(c := 1000000000, a := '', m := '') END")


_NEW_N = _edit("n", "D", "4", None)
_NEW_S = _least(_edit("s", "D", "4", None), _kept("n", "s"))
_NEW_U = _least(_edit("u", "D", "4", None), *(x for f in "nsa" for x in (_kept(f, "u"), _rerole(f, "user"))))
_NEW_A = _least(_edit("a", "D", "4", None), _kept("u", "a"), _rerole("u", "assistant"))
_INS_U = _least("u", *(_USER_IN.format(s=f) for f in "nsa"))


@query("op12_conversation_repair", rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
bits AS (SELECT name, list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::UBIGINT),
         lambda h, b: list_reduce([xor(h, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS h FROM (SELECT DISTINCT name FROM src)),
kinds AS (SELECT src.*, xor(h, 4294967295::UBIGINT) % 20 AS kind FROM src JOIN bits USING (name)),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS t
         FROM kinds, range(0, 2) AS x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) AS i FROM hurt),
seen AS (SELECT *, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
                row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) > 1 AS again FROM placed),
fault AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate'
                         WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
                 left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
turns AS (SELECT conv_id, i, role, t, CASE WHEN f IN ('blank', 'duplicate') THEN 'X' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS k,
                 CASE WHEN f = 'truncated' THEN 1 ELSE 0 END AS late FROM fault),
convs AS (SELECT DISTINCT conv_id FROM conversations),
raw(conv_id, i, n, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, struct_pack(c := 0, a := '', m := ''), struct_pack(c := 1000000, a := '', m := ''),
         struct_pack(c := 1000000, a := '', m := ''), struct_pack(c := 1000000, a := '', m := '') FROM convs
  UNION ALL
  SELECT conv_id, i, {_NEW_N}, {_NEW_S}, {_NEW_U}, {_NEW_A}
  FROM (SELECT conv_id, i, role, t, k, late, n, s, u, {_least("a", _ASSISTANT_IN.format(s="u"))} AS a
        FROM (SELECT turns.conv_id, turns.i, role, t, k, late, n, s, a, {_INS_U} AS u
              FROM raw JOIN turns ON raw.conv_id IS NOT DISTINCT FROM turns.conv_id AND turns.i = raw.i + 1))),
ends AS (SELECT conv_id, {_least("n", "a", _ASSISTANT_IN.format(s="u"))} AS z FROM (
         SELECT conv_id, n, a, {_INS_U} AS u FROM raw QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank,
        count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY conv_id)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(z.c AS BIGINT) AS cost, z.a AS audit,
       sha256(z.m[2:]) AS repaired_sha256
FROM ends LEFT JOIN figures ON ends.conv_id IS NOT DISTINCT FROM figures.conv_id
""")
def op12_conversation_repair(spark, sf_dir):
    hurt = damage(_table(spark, sf_dir, "conversations"))
    return repair_report(repair_conversations(spark, hurt, dropped_col="dropped"))


@query("op11_minhash_dedup", COMPONENTS_SQL.replace("@PERCENT", "85") + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(t.doc_id) AS component_id, s.doc_id = min(t.doc_id) AS kept
FROM sets s JOIN reach ON reach.r = s.r JOIN sets t ON t.r = reach.m GROUP BY s.r, s.doc_id, s.s
""")
def op11_minhash_dedup(spark, sf_dir):
    return minhash_components(spark, _table(spark, sf_dir, "documents"))

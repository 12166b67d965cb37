"""The queries over ``documents`` of this subpackage's operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, kneser_ney, langid, near_dedup, packing, quality_cnn, quality_rules, secrets_crf, substring
from tessera.llm.common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(n: int, at: int):
    return F.coalesce(remainder(F.col("doc_id"), n) == at, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every document; learned from labelled rows that aren't held out."""
    docs = _table(spark, sf_dir)
    network = quality_cnn.learn(docs, _table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return quality_cnn.score(docs, network).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are at least 85 percent alike."""
    out = near_dedup.near_duplicates(_table(spark, sf_dir), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = _table(spark, sf_dir)
    return secrets_crf.scan(docs, secrets_crf.learn(docs))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside passages of 35 words that occur elsewhere."""
    return substring.repeated_passages(_table(spark, sf_dir), 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents; learned from those that aren't held out."""
    docs = _table(spark, sf_dir)
    model = kneser_ney.train(docs.filter(~_held_out(10, 0)))
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", _held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document."""
    return bpe.round_trip(_table(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint.edited_fingerprints(_table(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    out = quality_rules.quality_rules(_table(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from labelled rows that aren't held out."""
    docs = _table(spark, sf_dir)
    out = langid.identify(docs, langid.learn(docs, ~_held_out(3, 1)))
    return out.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_secret_scan`` that don't depend on the learned field."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op6_lm_score`` that need counts of words only."""
    return op6_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op8_fingerprints`` that don't depend on its hashes."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op9_quality_rules`` without the distances and the verdict on them."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_near_dedup, op3_secret_scan, op4_packing, op5_substring_dedup, op6_lm_score, op7_bpe_round_trip, op8_fingerprints, op9_quality_rules, op10_language_id, secret_base_spans, lm_base_scores, edited_texts, quality_counts)
}

ORACLE_SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op5_substring_dedup"] = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
v as (select doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) as i from w)),
t as (select g from v group by g having count(*) > 1),
c as (select distinct doc_id, j from (select doc_id, unnest(range(i, i + 35)) as j from v join t using (g))),
e as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as j from w),
k as (select e.doc_id, string_agg(x, ' ' order by e.j) as kept, count(*) as n from e left join c on c.doc_id = e.doc_id and c.j = e.j where c.j is null group by e.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""

_BITS = "list_transform(range(0, 8 * length(s)), lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)) & 1)"
_CRC = f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {_BITS}), lambda c, b: xor(c >> 1, 3988292384 * ((c + b) % 2))))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL["lm_base_scores"] = f"""
with d as (select doc_id, t, coalesce({_CRC} % 10 = 0, false) as held_out from (select doc_id, cast(doc_id as varchar) as s, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents)),
w as (select doc_id, held_out, unnest(list_append({_WORDS.format("t")}, '')) as x from d),
c as (select x, count(*) as n from w where not held_out group by x),
z as (select coalesce(sum(n), 0) as tokens, count(*) as types from c)
select doc_id, held_out, count(*) as n_tokens, count(n) as n_known, cast(any_value(tokens) as bigint) as train_tokens, round(sum(log10((coalesce(n, 0) + 0.1) / (tokens + 0.1 * (types + 1)))), 6) as base_score
from w left join c using (x) cross join z group by doc_id, held_out
"""

ORACLE_SQL["edited_texts"] = """
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as u, length(t) // 2 as h from d)
select doc_id, length(t) as n_chars, sha256(substring(t, 1, length(t) - h) || substring(u, 1, h)) as edited_sha256 from n
"""

ORACLE_SQL["quality_counts"] = f"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as ws from documents),
v as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 7, 0) + 1)) as i from d)),
r as (select doc_id, g from v group by doc_id, g having count(*) > 1),
p as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from v join r using (doc_id, g)) group by doc_id),
c as (select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(p.n, 0) as n_repeat_words from d left join p using (doc_id))
select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c
"""

_ASSIGN = secrets_crf.ASSIGN.pattern.replace("'", "''")
_KIND = "select doc_id, '{k}' as k, {o} as o, string_split_regex(t, '{p}') as pieces, regexp_extract_all(t, '{p}', 0) as found, regexp_extract_all(t, '{p}', {g}) as told, {least} as least from d"

ORACLE_SQL["secret_base_spans"] = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({_KIND.format(k="assign", o=0, p=_ASSIGN, g=2, least=12)} union all {_KIND.format(k="access", o=1, p="AKIA[A-Z0-9]+", g=0, least=18)} union all {_KIND.format(k="hex", o=2, p="[0-9a-f]+", g=0, least=16)}),
e as (select doc_id, k, o, least, unnest(range(1, len(found) + 1)) as i, pieces, found, told from s),
f as (select doc_id, k, o, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as a, length(found[i]) as n from e where length(told[i]) >= least),
g as (select doc_id, count(*) filter (where k = 'assign') as n_assign, count(*) filter (where k = 'access') as n_access, count(*) filter (where k = 'hex') as n_hex, string_agg(k || ':' || cast(a as bigint) || ':' || cast(a + n as bigint), ',' order by a, o) as spans from f group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join g using (doc_id)
"""

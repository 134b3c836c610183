"""The queries of this subpackage and their SQL, with production parameters, over whole tables.

Each takes (spark, sf_dir). SQL is DuckDB's and is given where it can say the same on whole tables in reasonable time;
the others are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hnsw, katz, licenses, mixing, ngram_join, packing, quality, suffix, urls
from .common import table

#: The tokenizer file of op9 and of the pipeline's packing.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select_mix(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    segments = chat.format_messages(chat.text_messages(rows.unionByName(probe)))
    return chat.digest(segments).drop("expanded_tokens")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest_removed(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "name string, verdict string")
    listed = spark.createDataFrame([(x, "block") for x in urls.LISTED], "name string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, listed)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    q = lambda c: F.col(f"__q_{c}")
    return judged.select(
        F.col("doc_id").cast("long"),
        q("words").alias("n_words"),
        q("word_chars").alias("word_chars"),
        q("symbols").alias("n_symbols"),
        q("dup_lines").alias("n_dup_lines"),
        q("repeat_words").alias("n_repeat_words"),
        q("base").alias("base_failed"),
        q("kept").alias("kept"),
    )


QUERIES = {f.__name__: f for f in (op1_mixing, op2_chat, op3_suffix_dedup, op4_licenses, op5_hnsw, op6_jaccard, op7_urls, op8_katz, op9_packing, op10_quality)}


# --- SQL ------------------------------------------------------------------------------------------------

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _weights_sql(level: str, weights) -> str:
    cases = "".join(f" WHEN '{n}' THEN {w!r}" for n, w in weights[level].items())
    return f"CASE {level}{cases} ELSE 1.0 END::DOUBLE" if cases else "1.0::DOUBLE"


def _shared_sql(nodes: str, name: str, parent: str, weight: str, capacity: str, budget: str, out: str, keep: str) -> str:
    """One level of mixing.shared_out()."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""(SELECT {keep}, CASE WHEN ratio <= lvl OR top IS NULL THEN {capacity} ELSE {weight} * top END AS {out} FROM (
      SELECT *, max(CASE WHEN ratio > lvl THEN lvl END) OVER ({part}) AS top FROM (
        SELECT *, ({budget} - coalesce(sum({capacity}) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum({weight}) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
        FROM (SELECT *, {capacity} / {weight} AS ratio FROM {nodes}) WINDOW o AS ({part} ORDER BY ratio, {name}))))"""


def _mixing_sql(share: float = 0.5, weights=mixing.WEIGHTS, epochs: int = 2, seed: int = 7) -> str:
    return f"""
WITH d AS (SELECT doc_id, concat('d', coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0)) AS domain,
    lang, source, len({_WORDS})::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, {_weights_sql("domain", weights)} AS w0, {_weights_sql("lang", weights)} AS w1, {_weights_sql("source", weights)} AS w2,
    sum(n_tokens)::DOUBLE * {epochs} AS c2 FROM d GROUP BY ALL),
tot AS (SELECT least(floor(sum(tokens) * {share}), sum(c2))::DOUBLE AS b FROM leaf),
n0 AS (SELECT domain, w0, sum(c2) AS c0, (SELECT b FROM tot) AS b FROM leaf GROUP BY domain, w0),
b0 AS (SELECT * FROM {_shared_sql("n0", "domain", "", "w0", "c0", "b", "b0", "domain")}),
n1 AS (SELECT domain, lang, w1, sum(c2) AS c1, any_value(b0) AS b0 FROM leaf JOIN b0 USING (domain) GROUP BY domain, lang, w1),
b1 AS (SELECT * FROM {_shared_sql("n1", "lang", "domain", "w1", "c1", "b0", "b1", "domain, lang")}),
n2 AS (SELECT leaf.*, b1 FROM leaf JOIN b1 ON leaf.domain = b1.domain AND leaf.lang IS NOT DISTINCT FROM b1.lang),
b2 AS (SELECT * FROM {_shared_sql("n2", "source", "domain, lang", "w2", "c2", "b1", "b2", "domain, lang, source, tokens")}),
plan AS (SELECT domain, lang, source, tokens, floor(b2 + 1e-6)::BIGINT AS budget, CASE WHEN tokens > 0 THEN floor(b2 + 1e-6)::BIGINT // tokens ELSE 0 END AS whole FROM b2),
t AS (SELECT d.*, budget, whole, budget - whole * tokens AS rest FROM d JOIN plan ON d.domain = plan.domain
    AND d.lang IS NOT DISTINCT FROM plan.lang AND d.source IS NOT DISTINCT FROM plan.source WHERE n_tokens > 0 AND budget > 0),
part AS (SELECT *, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5(concat('{seed}:', whole, ':', coalesce(doc_id::VARCHAR, ''))), n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS take_tokens FROM t WHERE rest > 0)
SELECT doc_id, unnest(range(whole))::BIGINT AS epoch, domain, lang, source, n_tokens, n_tokens AS take_tokens FROM t
UNION ALL SELECT doc_id, whole::BIGINT, domain, lang, source, n_tokens, take_tokens FROM part WHERE take_tokens > 0"""


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\.{c[1:]}')"
    return out


_CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(replace({_escaped_sql("role")}, chr(10), '\\n')) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_URLS_SQL = f"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(name, verdict) AS (VALUES {_values(urls.RULES)}), l(name, verdict) AS (VALUES {_values((x, "block") for x in urls.LISTED)}),
h AS (SELECT DISTINCT host, path FROM p WHERE host <> ''),
fit AS (SELECT host, path, max_by(name, length(name)) AS rule, max_by(verdict, length(name)) AS v FROM h JOIN r
    ON (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1))) AND starts_with(path, substr(name, instr(name, '/'))) GROUP BY ALL),
lst AS (SELECT host, path, max_by(verdict, length(name)) AS v2 FROM h JOIN l
    ON (host = split_part(name, '/', 1) OR ends_with(host, '.' || split_part(name, '/', 1))) AND starts_with(path, substr(name, instr(name, '/'))) GROUP BY ALL)
SELECT page_id::BIGINT AS page_id, p.host, p.path, rule, coalesce(v, v2, 'allow') AS verdict FROM p LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path
LEFT JOIN lst ON p.host = lst.host AND p.path = lst.path"""

_QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT id, i, w[i:i + 7] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT id, sum(n)::BIGINT AS n FROM (SELECT id, least(8, i - coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), -8)) AS n FROM rep) GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY id),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov ON d.id = cov.id LEFT JOIN lines ON d.id = lines.id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
r AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS fails FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(fails)::DOUBLE AS k FROM r GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2 AS spread FROM h),
q AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, {quality.PRIOR[0]}), {quality.PRIOR[1]}) ELSE {quality.PRIOR[1]} END AS weight FROM m),
v AS (SELECT source, (k + mean * weight) / (n + weight) > {quality.HOST_RATE} AS bad FROM h, q)
SELECT doc_id::BIGINT AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source"""

ORACLE_SQL = {"op1_mixing": _mixing_sql(), "op2_chat": _CHAT_SQL, "op7_urls": _URLS_SQL, "op10_quality": _QUALITY_SQL}

"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlab.llm import (ann, byte_bpe, decontamination, html_extract, periodic_runs, piece_bpe, sharding, simhash,
                         spelling_variants, substring_dedup, token_counts, toxicity, url_filters)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [f"shard-{i:02d}" for i in range(16)]
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=3)


def digests(rows: DataFrame) -> DataFrame:
    """What ``encode_and_decode`` gives, as counts and digests."""
    return rows.select("doc_id", byte_bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("doc_id", "lang"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         (F.col("score") >= toxicity.threshold_of(model)).alias("over_language_threshold"))


_SPAN_ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(regexp_replace(coalesce(text, ''),
    '([.!?][ \t\n\r\f\v]+|[^ \t\n\r\f\v][ \t\r\f\v]*\n[ \t\n\r\f\v]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS pieces
  FROM documents),
worded AS (
  SELECT *, list_transform(pieces, lambda p: regexp_extract_all(
    translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\r\f\v]+')) AS words FROM cut),
lines AS (
  SELECT doc_id, text, pieces, list_transform(words, lambda w: array_to_string(w, ' ')) AS line,
         list_transform(words, lambda w: len(w)) AS size FROM worded),
one AS (
  SELECT doc_id, i, sum(size[i]) OVER (PARTITION BY doc_id ORDER BY i) AS upto, size[i] AS n, len(size) AS total
  FROM (SELECT doc_id, size, unnest(generate_series(1, len(size))) AS i FROM lines)),
short3 AS (
  SELECT a.doc_id, a.i AS s, a.i + 2 AS e, c.upto - a.upto + a.n AS w
  FROM one a JOIN one c ON a.doc_id = c.doc_id AND c.i = a.i + 2),
spans AS (
  SELECT a.doc_id, a.i AS s, b.i AS e FROM one a JOIN one b ON a.doc_id = b.doc_id AND b.i IN (a.i, a.i + 1)
    WHERE b.upto - a.upto + a.n >= 40
  UNION SELECT doc_id, s, e FROM short3 WHERE w >= 20
  UNION SELECT t.doc_id, t.s, min(b.i) FROM short3 t JOIN one a ON a.doc_id = t.doc_id AND a.i = t.s
    JOIN one b ON b.doc_id = t.doc_id AND b.i > t.e AND b.upto - a.upto + a.n >= 20 WHERE t.w < 20 GROUP BY t.doc_id, t.s
  UNION SELECT t.doc_id, max(a.i), t.e FROM short3 t JOIN one b ON b.doc_id = t.doc_id AND b.i = t.e
    JOIN one a ON a.doc_id = t.doc_id AND a.i < t.s AND b.upto - a.upto + a.n >= 20 WHERE t.w < 20 GROUP BY t.doc_id, t.e),
named AS (
  SELECT doc_id, s, e, array_to_string(list_filter(line[s:e], lambda x: x <> ''), ' ') AS words
  FROM spans JOIN lines USING (doc_id)),
placed AS (SELECT *, min((doc_id, s)) OVER (PARTITION BY words) AS first FROM named),
gone AS (
  SELECT doc_id, list(DISTINCT i) AS places
  FROM (SELECT doc_id, unnest(generate_series(s, e)) AS i FROM placed WHERE (doc_id, s) <> first) GROUP BY doc_id)
SELECT doc_id, CASE WHEN places IS NULL THEN text ELSE regexp_replace(array_to_string(list_filter(
    list_transform(generate_series(1, len(pieces)), lambda i: CASE WHEN list_contains(places, i) THEN '' ELSE pieces[i] END),
    lambda x: x <> ''), ''), '\s+$', '') END AS text,
  CAST(len(pieces) AS INTEGER) AS n_sentences, CAST(coalesce(len(places), 0) AS INTEGER) AS n_removed
FROM lines LEFT JOIN gone USING (doc_id)
"""


@query("op4_substring_dedup", _SPAN_ORACLE)
def op4(spark, sf_dir):
    return substring_dedup.remove_repeated(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_sentences", "n_removed")


_URL_ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('net','/','block'), ('example.net','/en/','allow'),
                                           ('example.com','/de/','block'), ('org','/fr/','allow')),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
judged AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE n = 1
"""


@query("op5_url_filters", _URL_ORACLE)
def op5(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), rules)


@query("op6_html_extract")
def op6(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.PATTERN, limit=1024)


TABLE_SIZE = 2_039  # a prime above 100 slots for each of the 16 shards

# the twin fills the table turn by turn, with the free slots in a bit string
_SHARD_ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT i, shard, CAST('0x' || substr(md5(shard), 1, 12) AS BIGINT) % {TABLE_SIZE} AS start,
         CAST('0x' || substr(md5(shard), 13, 12) AS BIGINT) % {TABLE_SIZE - 1} + 1 AS skip
  FROM (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 2, '0') AS shard FROM range({len(SHARDS)}) t(i))),
fill AS (
  SELECT CAST(0 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS slot, bitstring('0', {TABLE_SIZE}) AS taken
  UNION ALL
  SELECT turn + 1, slot, set_bit(taken, CAST(slot AS INTEGER), 1) FROM (
    SELECT f.turn, f.taken, min_by((p.start + k * p.skip) % {TABLE_SIZE}, k) AS slot
    FROM fill f JOIN pref p ON p.i = f.turn % {len(SHARDS)} CROSS JOIN range({TABLE_SIZE}) s(k)
    WHERE f.turn < {TABLE_SIZE} AND get_bit(f.taken, CAST((p.start + k * p.skip) % {TABLE_SIZE} AS INTEGER)) = 0
    GROUP BY f.turn, f.taken)),
owner AS (SELECT slot, shard FROM fill JOIN pref ON i = (turn - 1) % {len(SHARDS)} WHERE turn > 0),
placed AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) % {TABLE_SIZE} AS slot
           FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, shard FROM placed JOIN owner USING (slot)
"""


@query("op8_sharding", _SHARD_ORACLE)
def op8(spark, sf_dir):
    return sharding.place(_table(spark, sf_dir, "documents"), SHARDS, size=TABLE_SIZE)


@query("op10_decontamination")
def op10(spark, sf_dir):
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))


@query("op9_ann_prefix_forest")
def op9(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    words = spelling_variants.word_counts(_table(spark, sf_dir, "documents"), drop_every=97, shortest=5)
    return spelling_variants.spelling_variants(words.where("n >= 3"))


def planted_period(text: F.Column, doc_id: F.Column) -> F.Column:
    """The text, or for a tenth of the documents its words with a period that the id gives."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        start = (g % n).cast("int")
        period = (F.lit(1) + F.floor((n - start) / (F.lit(3) + g % 8))).cast("int")
        tail = F.transform(F.sequence(start, n - 1), lambda i: F.get(words, (start + (i - start) % period).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, start), tail), " ")
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # the words are bound to a name: they are cut out once
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return F.when(h % 10 == 0, F.coalesce(planted, text)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs.select("doc_id", planted_period(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"),
                                                              r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_sentencepiece")
def op13(spark, sf_dir):
    model = piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    rows = piece_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), model)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0).cast("bigint")).alias("n_source_bytes"))

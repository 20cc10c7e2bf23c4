"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown_lm, codes, decontaminate, exact_dedup, importance, mixing, near_dedup, pii, quality, token_rollup, token_store, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_read(spark, sf_dir, "documents")).drop("__node")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_rollup.vocabulary_counts(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json"))
    return token_rollup.maintained_totals(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), *token_rollup.VOCABULARIES, counts)


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with counts of words and bytes, which SQL can count too."""
    return token_rollup.maintained_totals(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


WORD_ROLLUP_SQL = r"""
WITH marks AS (
  SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), counted AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, octet_length(encode(coalesce(text, ''))) AS bytes,
         coalesce(toxic, 0) AS toxic, coalesce(quality, 1) AS quality
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
)
SELECT source, lang, CASE WHEN quality = 0 THEN 'utf8_bytes-1' ELSE 'whitespace-1' END AS tokenizer, count(*) AS n_docs,
       sum(CASE WHEN quality = 0 THEN bytes ELSE words END)::BIGINT AS n_tokens
FROM counted WHERE toxic <> 1 GROUP BY 1, 2, 3
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_equal_texts(_read(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classified(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), columns=["doc_id"])
    names = {"__evidence": "evidence", "__host_prior": "host_prior", "__prior": "path_prior", "__score": "score", "__keep": "keep"}
    return judged.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS most FROM sources
), levels AS (
  SELECT *, (150 * sum(source_size) OVER () / 100.0
             - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY most::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, least(most::DOUBLE, w * coalesce((SELECT max(level) FROM levels WHERE level <= most::DOUBLE / w), 'infinity'::DOUBLE)) AS target,
         ('0x' || substr(sha256('7:' || coalesce(source, '')), 1, 5))::BIGINT::DOUBLE / 1048576 AS u
  FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS LAST) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, least(floor(u + k * rate) - floor(u + (k - 1) * rate), ceil(rate))::BIGINT * size AS taken FROM placed
"""


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampling(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: Words of a text as the contracts of op11 and op12 have them.
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
), b AS (
  SELECT {_WORDS_SQL} AS w FROM benchmark
), doc_features AS MATERIALIZED (
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM d
), item_features AS MATERIALIZED (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS f FROM b
), crc_table AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) s(i)
), hexed AS (
  SELECT f, hex(f) AS h FROM (SELECT f FROM doc_features UNION SELECT f FROM item_features)
), buckets AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(h), 2), lambda k: ('0x' || h[k:k + 1])::BIGINT)),
                            lambda c, byte: xor(c >> 8, t[(xor(c, byte) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table
), s AS (
  SELECT bucket, count(*) AS s FROM doc_features JOIN buckets USING (f) GROUP BY 1
), t AS (
  SELECT bucket, count(*) AS t FROM item_features JOIN buckets USING (f) GROUP BY 1
), alls AS (
  SELECT (SELECT count(*) FROM doc_features) AS s_all, (SELECT count(*) FROM item_features) AS t_all
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), alls
), summed AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS g FROM doc_features JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
         coalesce(floor(g::DOUBLE / n), 0)::BIGINT
           + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN summed USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= 20) OVER () AS long_enough FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * long_enough // 100 THEN place END AS rank FROM ranked
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS name, {_WORDS_SQL} AS w FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT name, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT name, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT name, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0))
), places AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS MATERIALIZED (
  SELECT r, k, n, name FROM places JOIN windows USING (n, win)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM met)) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM met) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN listed USING (r)
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_label_errors(*codes.compressed(_read(spark, sf_dir, "embeddings")))


def _op13_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS) -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), p AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) s(part)
), b0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, any_value(x) AS x, min(((list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c))::BIGINT * {entries} + entry)) AS best
  FROM p JOIN b{k} USING (part) GROUP BY r, part
)""")
        if k < rounds:
            steps.append(f"""m{k} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
    SELECT part, best % {entries} AS entry, pos, floor(sum(x[pos + 1]) / count(*)) AS mean
    FROM (SELECT part, best, x, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2
), b{k + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry)
)""")
    last = rounds
    steps.append(f"""coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{last} GROUP BY r
), books AS (
  SELECT sha256(string_agg(n, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(range(len(c))) AS pos, unnest(c)::BIGINT::VARCHAR AS n FROM b{last})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), books""")
    return ", ".join(steps)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_token_rollup": op4_token_rollup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_topk": op7_topk,
    "op8_brown_lm": op8_brown_lm,
    "op9_mixing": op9_mixing,
    "op10_token_store": op10_token_store,
    "op11_importance": op11_importance,
    "op12_decontaminate": op12_decontaminate,
    "op13_codes": op13_codes,
    "word_rollup": word_rollup,
}

ORACLE_SQL = {"word_rollup": WORD_ROLLUP_SQL, "op5_exact_dedup": OP5_SQL, "op7_topk": OP7_SQL, "op9_mixing": OP9_SQL, "op11_importance": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_codes": _op13_sql()}

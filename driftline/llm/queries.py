"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import ann, bytebpe, decontaminate, jaccard, langid, licenses, linededup, packing, quality, resampling, suffix, tokenfiles, whitening

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(_documents(spark, sf_dir), with_bytes=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_and_read(_documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=False)
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_line_dedup, op3_ngram_jaccard, op4_license_scan, op5_suffix_dedup, op6_byte_bpe, op7_quality_rules, op8_packing, op9_language_id, op10_token_files, op11_decontaminate, op12_importance_resampling, op13_embedding_whitening)}

#: Expressions shared by the statements below.
_LINES = "string_split(coalesce(text, ''), chr(10))"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = linededup.UPPER, linededup.LOWER



def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(x: str) -> str:
    """The canonical form of licence texts; the copyright pattern without the flag that only Java has."""
    x = f"regexp_replace(lower({x}), {_quoted(licenses.COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, ' ', 'g')"
    x = rf"(' ' || trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') || ' ')"
    for other, one in licenses.WORDS + licenses.PHRASES:
        x = f"replace(replace({x}, ' {other} ', ' {one} '), ' {other} ', ' {one} ')"
    return f"trim({x}, ' ')"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.known_texts())
_DIGESTS = ", ".join(f"('{name}', '{digest}')" for name, digest, _ in licenses.DIGESTS)
_WORD = r"'[^\x20\x09-\x0D]+'"


def _plain_words(x: str) -> str:
    """Runs of letters, digits and all beyond ASCII, A-Z lower-cased."""
    return rf"regexp_extract_all(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL = {
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, {_LINES} AS x FROM documents)
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.doc_id, pos, line, coalesce(first < k.doc_id, false) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op4_license_scan": f"""
WITH known AS (
  SELECT digest, min(name) AS license_id FROM (SELECT name, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {_KNOWN}) k(name, text) UNION ALL SELECT * FROM (VALUES {_DIGESTS})) GROUP BY digest
), c AS (
  SELECT doc_id, {_canonical_sql("text")} AS c FROM documents
), l AS (
  SELECT doc_id, unnest({_LINES}) AS line FROM documents
), hits AS (
  SELECT l.doc_id, k.license_id FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM l) l JOIN known k ON l.digest = k.digest
), h AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS names FROM hits GROUP BY doc_id
)
SELECT c.doc_id, CAST(length(c) AS BIGINT) AS n_canonical, sha256(c) AS digest, k.license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM c LEFT JOIN known k ON sha256(c) = k.digest LEFT JOIN h ON c.doc_id = h.doc_id""",
    "op7_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS x FROM d)
), t AS (
  SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), r AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM t WHERE w3 IS NOT NULL) x, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, source, line, translate(trim(line, {_WHITE}), '{_UPPER}', '{_LOWER}') AS key, len(regexp_extract_all(line, {_WORD})) AS n
  FROM (SELECT doc_id, source, unnest({_LINES}) AS line FROM d) WHERE regexp_matches(line, {_WORD})
), f AS (
  SELECT h.source, h.key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM l GROUP BY source, key) h
  JOIN (SELECT source, count(*) AS docs FROM d GROUP BY source) s ON h.source = s.source WHERE n > {quality.LINE_DOCS} AND (n > {quality.LINE_SHARE}::DOUBLE * docs OR n > {quality.LINE_MOST})
), per AS (
  SELECT l.doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(l.n) FILTER (WHERE f.key IS NOT NULL), 0) AS lost FROM l LEFT JOIN f ON l.source = f.source AND l.key = f.key GROUP BY l.doc_id
), a AS (
  SELECT d.doc_id, CAST(len(regexp_extract_all(text, {_WORD})) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_frequent_words
  FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - n_frequent_words < {quality.LEFT_SHARE}::DOUBLE * n_words AS depleted FROM a
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM b""",
    "op11_decontaminate": f"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({decontaminate.WINDOW}, len(w)) AS m FROM (SELECT item_id, {_plain_words('text')} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, m, list_slice(w, p, p + m - 1) AS g FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS p FROM i)
), d AS (
  SELECT doc_id, {_plain_words('text')} AS w FROM documents
), grams AS (
  SELECT doc_id, p, m, list_slice(w, p, p + m - 1) AS g FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM windows))
), met AS (
  SELECT doc_id, p, x.m, item_id FROM grams x JOIN windows y ON x.m = y.m AND x.g = y.g
), hit AS (
  SELECT doc_id, count(DISTINCT h) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + m - 1)) AS h FROM (SELECT DISTINCT doc_id, p, m FROM met)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id""",
    "op12_importance_resampling": f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(b, generate_series(1, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t FROM (SELECT unnest(generate_series(0, 255)) AS b)
), d AS (
  SELECT doc_id, {_plain_words('text')} AS w FROM documents
), grams AS (
  SELECT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - k), lambda p: array_to_string(list_slice(w, p, p + k), ' '))) AS gram FROM d, (VALUES (0), (1), (2)) s(k) WHERE len(w) > k)
), target AS (
  SELECT unnest(list_transform(generate_series(1, len(w) - k), lambda p: array_to_string(list_slice(w, p, p + k), ' '))) AS gram FROM (SELECT {_plain_words('text')} AS w FROM benchmark), (VALUES (0), (1), (2)) s(k) WHERE len(w) > k
), bytes AS (
  SELECT gram, list_transform(generate_series(1, strlen(gram)), lambda p: CAST(16 * (instr('0123456789ABCDEF', substr(hex(gram), 2 * p - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(gram), 2 * p, 1)) - 1 AS BIGINT)) AS b FROM (SELECT gram FROM grams UNION SELECT gram FROM target)
), buckets AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM bytes, crc
), s AS (
  SELECT bucket, count(*) AS s FROM grams NATURAL JOIN buckets GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM target NATURAL JOIN buckets GROUP BY bucket
), gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM grams) + {resampling.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + {resampling.BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket
), weights AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM grams NATURAL JOIN buckets NATURAL JOIN gains GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(w) AS n, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights ON d.doc_id = weights.doc_id
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM scored WHERE n >= {resampling.MIN_WORDS}
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * total // 100 THEN rank END AS rank FROM scored s LEFT JOIN ranks r ON s.doc_id = r.doc_id""",
}

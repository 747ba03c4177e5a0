"""The operators of this subpackage bound to the test tables, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymart.llm import (
    bpe,
    fill_in_middle,
    hmm,
    line_crf,
    line_dedup,
    matrix_bpe,
    mixing,
    neighbours,
    repeats,
    secret_scan,
    simhash,
    spelling,
    wordpiece,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode(documents(spark, folder), path, decoded=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    field = line_crf.train(docs, table(spark, folder, "labels"))
    return line_crf.judge(docs, field).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"
    )


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = secret_scan.scan(docs, secret_scan.train(docs))

    def shown(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", parts)

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        of("random"),
        F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def op5_hidden_states(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(documents(spark, folder))


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


def op7_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_repeated_lines(documents(spark, folder)).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.encode("line_dedup.kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(documents(spark, folder))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


def op12_matrix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded by ranks and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return matrix_bpe.encode(documents(spark, folder), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's transformed form and the text rebuilt from it, as digests."""

    def digest(text):
        return F.sha2(F.encode(text, "UTF-8"), 256)

    made = fill_in_middle.fill_in_middle(documents(spark, folder))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(back).alias("restored_sha256")
    )


QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_graph_neighbours": op2_graph_neighbours,
    "op3_line_quality": op3_line_quality,
    "op4_secrets": op4_secrets,
    "op5_hidden_states": op5_hidden_states,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_source_mix": op10_source_mix,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_matrix_bpe": op12_matrix_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Word counts, targets by repeated sharing out, and the sample by one running sum for each source.
OP10 = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source,
         CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[^w]', '', 'g')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || md5(coalesce(text, ''))) AS h
  FROM documents),
sized AS (SELECT *, ('0x' || substr(h, 1, 13))::BIGINT AS draw, ('0x' || substr(h, 14, 13))::BIGINT AS second FROM rows),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
stops AS (SELECT *, 3.0 * source_size / weight AS stop,
                 row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT k, stop, ((SELECT sum(source_size) FROM stops) - coalesce((SELECT sum(3.0 * b.source_size) FROM stops b WHERE b.k < a.k), 0))
                  / (SELECT sum(b.weight) FROM stops b WHERE b.k >= a.k) AS level FROM stops a),
level AS (SELECT min_by(level, k) AS level FROM levels WHERE level <= stop),
targets AS (
  SELECT source, source_size,
         CAST(CASE WHEN level IS NULL OR stop <= level THEN 3.0 * source_size ELSE level * weight END AS DOUBLE) AS target
  FROM stops, level),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM targets),
ranked AS (
  SELECT doc_id, size, s.source, s.source_size, target, draw, second, floor(share) AS whole, share - floor(share) AS part,
         target - floor(share) * s.source_size AS missing, (draw + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM sized JOIN shares s ON sized.source IS NOT DISTINCT FROM s.source),
odds AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS odds FROM ranked),
placed AS (SELECT *, CASE WHEN part > 0 THEN least(CAST(floor(odds / (1 + odds) * 281474976710656) AS BIGINT), 281474976710655) END AS rank FROM odds),
alike AS (SELECT source, rank, draw, second, any_value(missing) AS missing, sum(size) AS size FROM placed WHERE part > 0 GROUP BY ALL),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, draw, second) AS until FROM alike),
gaps AS (SELECT source, any_value(missing) - coalesce(max(until) FILTER (until <= missing), 0) AS gap FROM running GROUP BY source),
judged AS (
  SELECT p.*, coalesce(r.until <= r.missing, false) AS fits, g.gap FROM placed p
  LEFT JOIN running r ON p.source IS NOT DISTINCT FROM r.source AND p.rank = r.rank AND p.draw = r.draw AND p.second = r.second
  LEFT JOIN gaps g ON p.source IS NOT DISTINCT FROM g.source),
largest AS (
  SELECT source, arg_min(struct_pack(a := rank, b := draw, c := second), struct_pack(o := -size, a := rank, b := draw, c := second)) AS f,
         max(size) AS filled
  FROM judged WHERE part > 0 AND NOT fits AND size BETWEEN 1 AND gap GROUP BY source),
again AS (
  SELECT j.*, coalesce(f = struct_pack(a := rank, b := draw, c := second), false) AS one, gap - coalesce(filled, 0) AS still
  FROM judged j LEFT JOIN largest l ON j.source IS NOT DISTINCT FROM l.source),
nearest AS (
  SELECT source, arg_min(struct_pack(a := rank, b := draw, c := second), struct_pack(o := abs(still - size), a := rank, b := draw, c := second)) AS f
  FROM again WHERE part > 0 AND NOT fits AND NOT one AND abs(still - size) < still GROUP BY source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN part > 0 AND (fits OR one OR coalesce(f = struct_pack(a := rank, b := draw, c := second), false)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM again LEFT JOIN nearest ON again.source IS NOT DISTINCT FROM nearest.source
"""

#: Every window of 35 words by itself, counted, and the words of those that occur twice or more taken out.
OP6 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
hashed AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM windows),
twice AS (SELECT r, i FROM hashed QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Lines cut out one by one, and the parts put together as the form says.
OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, len(l) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END)
         AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op6_repeated_passages": OP6, "op10_source_mix": OP10, "op13_fill_in_middle": OP13}

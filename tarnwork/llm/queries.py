"""The operators' registered queries over the driver's tables, and SQL where it exists."""

import public_tokenizers

from pyspark.sql import functions as F

from . import alignment, decontamination, html_text, jaccard, packing, quality, rank_bpe, sharding, substrings, token_counts, token_files, vector_codes, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    """Method: two tiers of unit lengths inside each task."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_sharding(spark, sf_dir):
    """Method: global prefix sums from range totals; the law held is ``bytes``."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)


def op3_token_files(spark, sf_dir):
    """Method: binary shards with a minimal perfect hash index."""
    manifest = token_files.write_token_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_shards(manifest)


def op4_jaccard(spark, sf_dir):
    """Method: blocked sparse product of the document by 3-gram incidence."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_warc(spark, sf_dir):
    """Method: candidate boundaries, kept where the chain from the file's start reaches them."""
    files = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark, sf_dir):
    """Method: descending pieces to the sequence of lowest attention cost with room."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def op7_quality_rules(spark, sf_dir):
    """Method: cutoffs certified on labelled holdouts."""
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_html_text(spark, sf_dir):
    """Method: a bidirectional LSTM over leaf blocks."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark, sf_dir):
    """Method: SimHash windows, Hamming blocks, exact weighted-shingle similarity."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_substrings(spark, sf_dir):
    """Method: run-length BWT with sampled run ends and streamed matching statistics."""
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_vector_codes(spark, sf_dir):
    """Method: memoised grid cells with the entries that nothing dominates in their box."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_alignment(spark, sf_dir):
    """Method: each distinct text tokenised and aligned once, counts weighted by its copies."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(_table(spark, sf_dir, "documents"), *paths, groups="sha256").withColumnRenamed("groups", "groups_sha256")


def op13_rank_bpe(spark, sf_dir):
    """Method: a sentencepiece BPE model written from the ranks; decoding by the inverse map."""
    coded = rank_bpe.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries():
    made = (op1_token_counts, op2_sharding, op3_token_files, op4_jaccard, op5_warc, op6_packing, op7_quality_rules, op8_html_text, op9_decontamination, op10_substrings, op11_vector_codes, op12_alignment, op13_rank_bpe)
    return {f.__name__: f for f in made}


# Pages whose payload repeats revisit the largest page_id among them.
WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS winner FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM w
"""


# Six rounds of moving the codebooks, spelt out: nearest entries as distance * 16 + entry, then means.
CODES_SQL = """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, label, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM k, range(8) t(p)
), b0 AS MATERIALIZED (
  SELECT p, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 16) USING (vec_id)
), {rounds}, {last}
SELECT vec_id, string_agg(printf('%02x', CAST(m % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error, CAST(sum(sum(m // 16)) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM a6 GROUP BY vec_id, label
"""
NEAREST_SQL = "a{n} AS MATERIALIZED (SELECT vec_id, label, v.p, any_value(v.x) AS x, min(CAST(list_sum(list_transform(v.x, lambda y, i: (y - b.x[i]) * (y - b.x[i]))) AS HUGEINT) * 16 + e) AS m FROM v JOIN b{n} b ON b.p = v.p GROUP BY vec_id, label, v.p)"
MOVE_SQL = "b{next} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM b{n} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS x FROM (SELECT p, m % 16 AS e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (SELECT p, m, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{n}) GROUP BY ALL) GROUP BY ALL) n USING (p, e))"


def oracle_sql():
    rounds = ", ".join(f"{NEAREST_SQL.format(n=n)}, {MOVE_SQL.format(n=n, next=n + 1)}" for n in range(6))
    return {"op5_warc": WARC_SQL, "op11_vector_codes": CODES_SQL.format(rounds=rounds, last=NEAREST_SQL.format(n=6))}

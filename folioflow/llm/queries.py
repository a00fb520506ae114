"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .embedding_dedup import embedding_duplicates
from .exact_dedup import exact_dedup
from .fill_in_middle import fill_in_middle
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pii import find_personal_data
from .piece_bpe import encode_pieces
from .quality import fit_quality, score_quality
from .sharding import histogram_shards
from .toxicity import fit_toxicity, score_toxicity
from .warc import round_trip
from .whitening import whiten


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through dictionary-compressed archives and back; every record is verified."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents and whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts. The kernel counts subsequences of three letters up to a span of seven characters (wider ones weigh
    under 3 per cent) and compares words on their own, spelled-out ones joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and weakly supervised spans of personal data and secrets in all whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more", "n_spans")


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a similarity of 0.85 on five-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op7_hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label linked at a cosine of 0.98."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes: whole rows are exchanged and written, the columns come from that table."""
    return histogram_shards(table(spark, sf_dir, "documents"), 8).select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), F.col("slot").cast("long"), "grown_shard")


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from two views that taught each other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "text_score", "meta_score", "score", "predicted", (F.col("predicted") == 1).alias("kept"))


def word_bpe() -> str:
    """The word BPE vocabulary of the contract; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, word_bpe()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def piece_bpe() -> str:
    """The merge-type piece vocabulary of the contract; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts and the texts decoded from them; ``agrees``: the library came to the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encode_pieces(docs, piece_bpe()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op12_pair_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all sound vectors."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_duckdb_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts rearranged around a middle that their id chooses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {f.__name__: f for f in (op1_warc_dictionary, op2_exact_dedup, op3_cube_mixing, op4_toxicity, op5_weak_supervision_pii, op6_hyperminhash, op7_hnsw_shards, op8_histogram_shards, op9_co_training, op10_ffd_packing, op11_piece_agenda, op12_pair_whitening, op13_duckdb_fim)}

SQL = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
""",
    "op13_duckdb_fim": r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT *, len(unit) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
         CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
places AS (
  SELECT *, length(array_to_string(unit[1:a], '')) AS p, length(array_to_string(unit[a + 1:b], '')) AS m FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN concat('<P>', text[1:p], '<S>', text[p + m + 1:], '<M>', text[p + 1:p + m])
              ELSE concat('<S>', text[p + m + 1:], '<P>', text[1:p], '<M>', text[p + 1:p + m]) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM places
""",
}

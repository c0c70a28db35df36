"""The registered queries of this subpackage, each over its whole table, and the SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import chat, errata_trie, fill_middle, jaccard, media, mixing_lm, oracles, packing, pii, resampling, segmentation, token_store, vector_dedup, wrapper
from loglattice.llm.runtime import materialize, scratch

#: Named in the queries only; a deployment passes its own.
PII_KEY = b"surrogates of the registered query"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-store")
    token_store.write_token_store(_docs(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_token_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_docs(spark, sf_dir), words=4, percent=85)


def op3_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.text_to_media(_docs(spark, sf_dir).select("doc_id", "text")).drop("text"), "media")
    digests = media.media_features(media.sniff_media(stored))
    return digests.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "detected_type", "corrected")


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score_documents(_docs(spark, sf_dir))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_chats(chat.text_parts(rows.unionByName(extra))), ordered=True)


def byte_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): byte-level tokens of the whole text, one byte each, and the end token 0."""
    return docs.select("doc_id", F.concat(F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.lit(b"\0")).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens in training sequences that are written and read back: where each piece stands, and a digest of what stands there."""
    sequences = materialize(packing.pack_sequences(byte_tokens(_docs(spark, sf_dir)), "ids", 1), "sequences")
    return packing.unpack(sequences, 1).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_docs(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op9_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segmentations of each whole text: how many pieces, a digest of their ids and of the text that these decode to, and the scores."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    drawn = segmentation.sample_segmentations(_docs(spark, sf_dir), model, k=3)
    return segmentation.decode_segmentations(drawn, model).select("doc_id", "rank", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"), "log_prob", "perturbed", "log_inclusion")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op11_errata_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errata_trie.spelling_variants(_docs(spark, sf_dir))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle(_docs(spark, sf_dir), digests=True)


def op13_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_media_sniffing": op3_media_sniffing,
    "op4_context_mixing": op4_context_mixing,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_sampled_segmentations": op9_sampled_segmentations,
    "op10_vector_dedup": op10_vector_dedup,
    "op11_errata_trie": op11_errata_trie,
    "op12_fill_middle": op12_fill_middle,
    "op13_wrapper_induction": op13_wrapper_induction,
}

ORACLES: dict[str, str] = {"op11_errata_trie": oracles.OP11, "op12_fill_middle": oracles.OP12}

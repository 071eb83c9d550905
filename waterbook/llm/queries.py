"""Registered queries of this package: each applies one operator, with its
production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, fingerprints, jaccard_join, language_id, license_scan, mixing, quality, sql, token_counts, toxicity, vector_codes, warc
from .common import public_vocabulary, shared_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    records = warc.read_archives(spark, manifest)
    page = lambda c: F.substring(c, len(warc.RECORD_ID) + 1, 40).try_cast("long")
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.col("payload_length")).cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first training position."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", "taken",
        F.size("copies").alias("n_copies"), F.get("copies", F.lit(0))["position"].alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.link_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_vocabulary("word_bpe_49k.json")
    return bpe.with_digests(bpe.round_trip(table(spark, sf_dir, "documents"), path))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("shingles_estimate"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.when(~language_id.held_out(F.col("doc_id")), F.col("lang")).alias("lang")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", learned)
    _, out = language_id.learn_and_identify(docs, keep=["doc_id"], **language_id.CALIBRATION)
    return out.select(
        "row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), F.col("prediction.lang").alias("lang_pred"),
        "prediction.score", "prediction.entropy", "prediction.accepted",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_edits(docs, token_counts.sample_edits(docs), vocabulary or public_vocabulary("word_bpe_49k.json"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.read_packs(chat.format_packs(chat.conversations(rows)))
    turns, loss = chat.turns_text(F.col("turns")), chat.loss_text(F.col("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.apply(docs, quality.fit(docs, quality.trusted_ids(labels)))


def op11_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    paths = byte_level or public_vocabulary("byte_bpe_50k.json"), pieces or public_vocabulary("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_sentences")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.fit(vectors)
    coded = vector_codes.encode(vectors, books, ["vec_id", "label"])
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_bpe": op4_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {"op1_warc": sql.WARC, "op3_jaccard_join": sql.JACCARD, "op13_vector_codes": sql.VECTOR_CODES}

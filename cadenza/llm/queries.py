"""Registered queries of this subpackage, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import (
    chat, collocations, decontamination, fingerprints, mixing, ngram_join, packing, quality_model, quality_rules, secret_scan, suffix_dedup, token_files, vector_codes,
)
from cadenza.session import scratch_path, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token files, read back."""
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(manifest)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule figures and verdicts of all documents; the source is the host."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("source", "host_rate")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all texts and their edited forms."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, with one that speaks in marks."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(extra))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings removed from all documents."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, length=1024)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), mixing.n_words(F.col("text")))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_model.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases that keep together best."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks of 16 parts."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_files, op2_quality_rules, op3_fingerprints, op4_chat_format, op5_suffix_dedup, op6_packing, op7_ngram_join,
                                   op8_mixing, op9_quality_model, op10_secret_scan, op11_collocations, op12_decontamination, op13_vector_codes, pipeline)}
ORACLES = {"op2_quality_rules": quality_rules.ORACLE, "op4_chat_format": chat.ORACLE, "op8_mixing": mixing.ORACLE,
           "op11_collocations": collocations.ORACLE, "op12_decontamination": decontamination.ORACLE, "op13_vector_codes": vector_codes.ORACLE}

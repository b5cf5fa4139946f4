"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, exact, language_model, lines, merkle, minhash, mixing, periodic, repeats, secret_scan, token_files, toxicity, url_filter
from docspark.llm.common import table

#: Probability of the highest grade from which a document is rejected.
REJECT = 0.5
#: Rules of the page filter: host and start of the path.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = mixing.mixed_sizes(table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "quality"))
    return sizes.select("doc_id", "size", "source_size", "target", "taken")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.span_report(secret_scan.scan_secrets(table(spark, folder, "documents")))


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_documents(table(spark, folder, "documents"))


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_from_labels(docs, toxicity.graded_labels(table(spark, folder, "labels")))
    scored = toxicity.with_severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "toxicity.severity", F.col("toxicity.top").alias("p_toxic"), (F.col("toxicity.top") >= REJECT).alias("rejected"))


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents")).drop("text_key")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    report = token_files.token_report(spark, table(spark, folder, "documents"), tokenizer_path())
    return report.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, folder, "pages"), url_filter.rule_table(spark, URL_RULES))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(fields).alias("leaf"), merkle.leaf_digest(fields, text=bare).alias("now"))
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf", ["now"])
    return merkle.audit(proven, "now").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_report(periodic.periodic_runs(periodic.with_planted_runs(table(spark, folder, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_secrets, op3_language_model, op4_lines, op5_exact, op6_repeats, op7_decontamination, op8_toxicity, op9_minhash, op10_token_files, op11_redirects, op12_merkle, op13_periodic)
}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.SQL,
    "op2_secrets": secret_scan.SQL,
    "op4_lines": lines.SQL,
    "op5_exact": exact.SQL,
    "op11_redirects": url_filter.SQL,
    "op12_merkle": merkle.SQL,
}

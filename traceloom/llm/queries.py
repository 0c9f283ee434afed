"""The registered queries of this subpackage: production parameters, whole tables, contract columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import collocations, decontaminate, divergence, html_text, kernel_quality, minhash, mixing, ngram_quality, secrets, simhash, token_files, toxicity, url_filter
from traceloom.llm.common import table, texts


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(texts(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.quality_rules(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public tokenizer of the token-ID output."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(texts(spark, sf_dir, "documents"), tokenizer_path())


#: Target shares of the mixture; every other source has the share 1.
MIX_WEIGHTS = {"src0": 6.0, "src1": 3.0, "src2": 2.0, "src3": 0.5}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(texts(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", "copy")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spark, texts(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(texts(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(texts(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.quality_scores(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_output": op3_token_output,
    "op4_source_mixing": op4_source_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_html_extraction": op6_html_extraction,
    "op7_url_filter": op7_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op4_source_mixing": mixing.mixing_sql(MIX_WEIGHTS),
    "op7_url_filter": url_filter.url_sql(),
    "op9_decontamination": decontaminate.contamination_sql(),
    "op11_source_divergence": divergence.divergence_sql(),
    "op12_collocations": collocations.collocation_sql(),
    "op13_minhash_near_dedup": minhash.near_duplicate_sql(),
}

"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import block_ann, hamming_topk, html_extract, lattice_lm, line_dedup, mixing, ngram_join, packing, quality, secrets
from quillspark.llm.common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.search(table(spark, sf_dir, "embeddings"))


def op4_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.search(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), text=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_ngram_join": op2_ngram_join,
    "op3_hamming_topk": op3_hamming_topk,
    "op4_block_ann": op4_block_ann,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_secret_scan": op9_secret_scan,
    "op10_lattice_lm": op10_lattice_lm,
}

SQL: dict[str, str] = {
    "op3_hamming_topk": hamming_topk.SQL,
    "op4_block_ann": block_ann.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_poisson_mix": mixing.SQL,
}

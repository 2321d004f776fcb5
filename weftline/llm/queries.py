"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import langid, linkage, maintext, packing, tokens
from weftline.shared import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_batches(table(spark, sf_dir, "records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_lines(table(spark, sf_dir, "http_responses"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialize(tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc-sizes")
    return packing.pack(sizes, table(spark, sf_dir, "pack_targets"))


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good the filling of :func:`p7_pack` is: containers, the certified least number, unused room."""
    targets = table(spark, sf_dir, "pack_targets")
    return packing.report(materialize(p7_pack(spark, sf_dir), "p7-packed"), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(table(spark, sf_dir, "lang_samples"), documents)
    return langid.relabelled(langid.classify(documents, model))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p6_ids": p6_ids, "p7_pack": p7_pack, "p7_bounds": p7_bounds, "p8_found": p8_found}
SQL: dict[str, str] = {}

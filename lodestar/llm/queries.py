"""Queries over the driver's tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from . import decontam, html, licenses, packing, quality, rules, secrets, simhash, token_counts, token_files


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark, sf_dir):
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_decontamination(spark, sf_dir):
    return decontam.digest(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_token_files(spark, sf_dir):
    return token_files.read(token_files.write(load(spark, sf_dir, "documents")))


def op5_licenses(spark, sf_dir):
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return licenses.scan(load(spark, sf_dir, "documents"), path)


def op6_quality_rules(spark, sf_dir):
    return rules.apply(load(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    return secrets.digest(load(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(load(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op10_html(spark, sf_dir):
    return html.main_text(load(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_decontamination, op4_token_files, op5_licenses, op6_quality_rules, op7_secrets, op8_packing, op9_token_counts, op10_html)}

SQL = {"op6_quality_rules": rules.sql()}

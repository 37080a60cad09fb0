"""A corpus pipeline of five operators; each stage works on all that its predecessor kept.

Quality rules drop documents, near-duplicate search leaves one of each group, decontamination
takes test items out, secret scans redact, packing lays what is left into sequences.
"""

from __future__ import annotations

from lodestar.llm import decontam, packing, rules, secrets, simhash
from lodestar.session import load, written


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rule or their group's thresholds go."""
    return rules.keep(docs)


def near_duplicates(spark, docs, sf_dir):
    """The document with the smallest id of each group of near copies stays."""
    return simhash.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Spans of test items go from texts; documents that are mostly test items go."""
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced by a mark."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """Pieces of documents with their place in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: Fingerprints, Markov scores and packing are not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name)
    return docs

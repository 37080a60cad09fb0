"""Held-out accuracy of the quality classifier on the larger fixture."""

import duckdb

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from lodestar.llm.queries import QUERIES

    rows = QUERIES["op2_quality"](spark, SF).where("held_out").select("doc_id", "score", "predicted").collect()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.doc_id in labels]
    right = sum(y == p for y, _, p in held) / len(held)
    good, bad = sorted(s for y, s, _ in held if y == 1), sorted(s for y, s, _ in held if y == 0)
    auc = sum(sum(b < g for b in bad) for g in good) / (len(good) * len(bad))
    print("held out", len(held), "accuracy", right, "AUC", auc)
    assert right >= 0.85 and auc >= 0.9

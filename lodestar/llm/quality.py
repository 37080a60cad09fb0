"""Quality scores by compression: how much better a text fits good examples than bad ones.

Two zstandard dictionaries are trained, one from texts labelled good and one from texts
labelled bad. A text is compressed with each, in independent pieces that together are the
whole text, so that the dictionaries and not its own beginning do the work. The difference of
the two sizes over the text's size is turned into a probability by a logistic curve that is
fitted on labelled texts kept out of the dictionaries.

Training takes at most ``max_docs`` rows and ``max_bytes`` bytes of each label (whole texts,
in the order of a hash of doc_id); nothing else is sampled. Labels, lang, source and doc_id
never enter a score.

Defined results: null and empty texts have no size and no difference, and get the curve's score
for that; null labels and labels other than 0 and 1 are not used; a doc_id labelled both ways
counts as both; with one label missing every score is the share of label 1 (one half without
any label); repeated rows stay repeated. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_list, id_and_text, map_text, worker_cache

MAX_DOCS, MAX_BYTES = 4000, 16 << 20
DICT_BYTES, LEVEL, PIECE = 96 << 10, 3, 1024
FOLDS, THRESHOLD = 5, 0.3
#: Bytes at which half of a difference counts.
SHORT = 48


def fold(doc_id) -> F.Column:
    """crc32 of the doc_id as text, modulo five; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


class Compressors:
    """The two dictionaries, ready to compress."""

    def __init__(self, good: bytes, bad: bytes, piece: int = PIECE):
        import zstandard

        self.piece, self.pair = piece, []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def difference(self, data: bytes) -> float:
        """(size with the bad dictionary - size with the good one) / bytes of the text."""
        if not data:
            return 0.0
        good, bad = self.pair
        parts = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return (sum(map(len, map(bad, parts))) - sum(map(len, map(good, parts)))) / len(data)


def _training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, max_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts of at most ``max_docs`` rows and ``max_bytes`` bytes for each label; ids are picked before any text is moved.

    A text of more than 1/64 of ``max_bytes`` is passed over, so that the bound fills with others.
    """
    ids = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for y in (0, 1):
        own = ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(max_docs)
        picked = own if picked is None else picked.unionByName(own)
    rows = docs.join(F.broadcast(picked), "doc_id").where("text is not null and text <> ''")  # 2 * max_docs ids at most
    rows = rows.select("y", F.col("text").cast("binary").alias("data"), "h", F.octet_length("text").alias("n")).where(F.col("n") <= max_bytes // 64)
    sums = rows.withColumn("sum", F.sum("n").over(Window.partitionBy("y").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, 0)))
    return [(bytes(r.data), r.y) for r in sums.where(F.col("sum") <= max_bytes).orderBy("y", "h", "n").collect()]


def features(difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the curve takes: the difference, shrunk for texts of few bytes, and how short a text is."""
    short = SHORT / (SHORT + size)
    return np.column_stack([difference * (1 - short), short, np.ones(len(size))])


def fit_logistic(design: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic curve, by Newton steps with a small ridge on scaled columns."""
    scale = np.where(design.std(axis=0) > 0, design.std(axis=0), 1.0)
    design, w = design / scale, np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ w)
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> dict:
    """Dictionaries and curve from the labelled rows outside fold 0."""
    import zstandard

    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").distinct()
    rows = _training_rows(id_and_text(docs, doc_id, text).where(fold("doc_id") != 0), named.where(fold("doc_id") != 0), max_docs, max_bytes)
    shares = {r.y: r["count"] for r in named.where(fold("doc_id") != 0).groupBy("y").count().collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    # every third training text is kept out of the dictionaries, for the curve
    texts = {y: [d for d, z in rows if z == y] for y in (0, 1)}
    if min(len(texts[0]), len(texts[1])) < 3:
        return {"prior": prior}
    dicts = []
    for y in (1, 0):
        samples = [d[i : i + PIECE] for n, d in enumerate(texts[y]) if n % 3 for i in range(0, len(d), PIECE)]
        try:
            data = zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 4)), samples).as_bytes()
        except zstandard.ZstdError:  # too little text to train: the text itself is the dictionary
            data = b"".join(samples)[:DICT_BYTES]
        dicts.append(data)
    machine = Compressors(*dicts)
    x, size, y = [], [], []
    for label_, own in texts.items():
        for d in own[::3]:
            x.append(machine.difference(d)), size.append(len(d)), y.append(label_)
    y = np.array(y, dtype=float)
    curve = fit_logistic(features(np.array(x), np.array(size)), y)
    # the sample holds both labels alike; the labels' own shares are put back
    had = y.mean()
    curve[-1] += math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - math.log(had / (1 - had))
    return {"good": dicts[0], "bad": dicts[1], "curve": curve.tolist(), "prior": prior}


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        made = worker_cache("compressors", dict)
        key = hash((model.get("good"), model.get("bad")))
        if "good" in model and key not in made:
            made.clear()
            made[key] = Compressors(model["good"], model["bad"])
        for b in batches:
            if "good" in model:
                texts = byte_list(b.column(1))
                x = np.array([made[key].difference(d) for d in texts], dtype=float)
                s = sigmoid(features(x, np.array([len(d) for d in texts], dtype=float)) @ np.array(model["curve"]))
            else:
                s = np.full(b.num_rows, model["prior"])
            yield pa.record_batch([b.column(0), pa.array(s)], names=["doc_id", "score"])

    out = map_text(id_and_text(docs, doc_id, text), run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows, score all."""
    return score(docs, fit(docs, labels, **options))

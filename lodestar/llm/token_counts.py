"""Token counts by a scan for separators in flat token files without an index.

A flat file is a run of ids, documents one after the other, each closed by the end-of-document
id; its blocks are cut at a fixed number of ids, wherever that falls. Ids take 16 bits, or 32 where
the vocabulary or the end-of-document id needs them; each block names its width, and the reader
goes by that. Each block is searched for the separator as one array. What lies
before its first and after its last separator is stitched by a prefix scan over one row for
each block, so a document may span any number of blocks.

Defined results: null and empty texts count zero ids beside the separator; ids of files are
those of the tasks that wrote them; repeated rows stay repeated; an empty table has no block;
ids after the last separator of a file belong to no document. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import id_and_text, map_text, text_list
from .tokens import default_path, encoder

BLOCK_IDS = 1 << 19
END = 50256


def write_flat(docs: DataFrame, path: str | None = None, end_id: int = END, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, wide: bool | None = None) -> DataFrame:
    """Write flat files: rows of (part, block, width, ids); and, apart, which document came where (part, nth, doc_id).

    ``wide``: 32-bit ids or not; None goes by the vocabulary. An id that a given width cannot hold is an error. Strings of special tokens in a text are ordinary text, so the separator never occurs inside one.
    """
    path = path or default_path("byte_bpe_50k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, block, nth, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        width = 4 if (max(encoder(path, plain_specials=True).top, end_id) > 0xFFFF if wide is None else wide) else 2

        def row(data: bytes):
            ids = np.frombuffer(data, dtype="<u4")
            if width == 2 and len(ids) and ids.max() > 0xFFFF:
                raise ValueError(f"id {ids.max()} does not fit into 16 bits")
            ids = ids.astype(f"<u{width}").tobytes()
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([ids], pa.binary()), pa.array([[]], pa.list_(pa.int64())), pa.array([0], pa.int64())], names=names)

        names = ["part", "block", "width", "ids", "doc_ids", "nth"]
        for b in batches:
            for ids in encoder(path, plain_specials=True).ids(text_list(b.column(1))):
                held.append(ids + end)
                size += len(ids) // 4 + 1
            if size >= block_ids:
                data = b"".join(held)
                whole = size // block_ids * block_ids * 4
                for at in range(0, whole, 4 * block_ids):
                    yield row(data[at : at + 4 * block_ids])
                    block += 1
                held, size = [data[whole:]], size - whole // 4
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([-1], pa.int32()), pa.array([width], pa.int32()), pa.array([None], pa.binary()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([nth], pa.int64())], names=names)
            nth += b.num_rows
        if size:
            yield row(b"".join(held))

    return written(map_text(id_and_text(docs, doc_id, text), run, "part int, block int, width int, ids binary, doc_ids array<long>, nth long"), "flat-tokens")


def documents_of(files: DataFrame) -> DataFrame:
    """(part, nth, doc_id) of flat files that :func:`write_flat` wrote."""
    return files.where("block < 0").select("part", "nth", F.posexplode("doc_ids").alias("at", "doc_id")).select("part", (F.col("nth") + F.col("at")).alias("nth"), "doc_id")


def counts(files: DataFrame, end_id: int = END) -> DataFrame:
    """(part, nth, start, n_tokens): the documents of each flat file, from its ids alone; the separator is not counted."""

    def run(batches):
        for b in batches:
            for part, block, width, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(data, dtype=f"<u{width}")
                at = np.flatnonzero(ids == end_id)
                run = np.diff(at, prepend=-1, append=len(ids)) - 1  # ids before each separator, and after the last
                k = len(run)
                yield pa.record_batch([pa.array(np.full(k, part), pa.int32()), pa.array(np.full(k, block), pa.int32()), pa.array(np.arange(k)), pa.array(run.astype(np.int64)), pa.array(np.full(k, k - 1)), pa.array(np.append(at, len(ids)).astype(np.int64))], names=["part", "block", "k", "run", "n_ends", "at"])

    blocks = files.where("block >= 0").select("part", "block", "width", "ids")
    found = written(map_text(blocks, run, "part int, block int, k long, run long, n_ends long, at long"), "separators")
    last = found.where("k = n_ends").select("part", "block", "n_ends", F.col("run").alias("tail"), F.col("at").alias("size"))
    w = Window.partitionBy("part").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scan = last.select("part", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ends"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begin"), F.coalesce(F.last(F.when(F.col("n_ends") > 0, F.col("block")), ignorenulls=True).over(before), F.lit(-1)).alias("opened"), F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails"))
    at_open = last.join(scan.select("part", "block", "tails"), ["part", "block"]).select("part", F.col("block").alias("opened"), F.col("tails").alias("tails_open"))
    # ids carried into a block: the tail of the last block with a separator and all of those since
    carried = scan.join(at_open, ["part", "opened"], "left").select("part", "block", "ends", "begin", (F.col("tails") - F.coalesce("tails_open", F.lit(0))).alias("carry"))
    out = found.where("k < n_ends").join(carried, ["part", "block"])
    n = F.col("run") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)
    return out.select("part", (F.col("ends") + F.col("k")).alias("nth"), (F.col("begin") + F.col("at") - n).alias("start"), n.alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, end_id: int = END, **options) -> DataFrame:
    """(doc_id, part, nth, start, n_tokens) of every document, by writing flat files and scanning them."""
    files = write_flat(docs, path, end_id, **options)
    return documents_of(files).join(counts(files, end_id), ["part", "nth"]).select("doc_id", "part", "nth", "start", "n_tokens")

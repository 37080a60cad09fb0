"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A file is a run of blocks in document order. A block holds whole documents:

    doc_ids   array<long>   ids of its documents (null stays null)
    lengths   binary        unsigned 32-bit: tokens of each document
    table     binary        unsigned 32-bit: the ids that occur, the most frequent first
    control   binary        four 2-bit codes a byte, the first lowest: bytes less one of each rank
    data      binary        the ranks, lowest byte first, without leading zero bytes
    part, block, before     file number, block number in it, tokens of the file before the block

The 256 most frequent ids of a block take one byte. A reader looks each control byte up in a
table of four lengths, and so finds all ranks of a block by numpy without a loop over tokens.
Each block has its own table, so writing takes one pass and a block can be read alone.

Defined results: null and empty texts hold the end id alone; null ids come first, ties of
doc_id lie in the order of their texts; repeated rows stay; an empty table has no file.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import id_and_text, map_text, text_list
from .tokens import default_path, encoder

#: Tokens of a block at which it is closed (a longer document is a block of its own).
BLOCK_TOKENS = 1 << 20
BLOCK_SCHEMA = "part int, block int, before long, doc_ids array<long>, lengths binary, table binary, control binary, data binary"
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(table, control, data) of unsigned 32-bit ids."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids) if ids.max() < 1 << 22 else None
    if counts is None:  # ids too large for a direct count
        values, where, n = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        values = np.flatnonzero(counts)
        n = counts[values]
    order = np.lexsort((values, -n))
    table = values[order].astype("<u4")
    rank_of = np.empty(len(values), dtype="<u4")
    rank_of[order] = np.arange(len(values), dtype="<u4")
    if counts is None:
        ranks = rank_of[where]
    else:
        full = np.zeros(len(counts), dtype="<u4")
        full[values] = rank_of
        ranks = full[ids]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return table.tobytes(), control.tobytes(), data.tobytes()


def decode(table: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids that :func:`encode` took."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    ranks = np.zeros((n, 4), dtype=np.uint8)
    ranks[np.arange(4) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return np.frombuffer(table, dtype="<u4")[ranks.view("<u4").ravel()] if n else np.zeros(0, dtype="<u4")


def write(docs: DataFrame, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", tag: str = "token-files") -> DataFrame:
    """Encode every text, close it with ``end_id`` and write token files in ascending doc_id order; returns them as read back.

    One shuffle, by ranges of doc_id; each file is one range.
    """
    path = path or default_path("byte_bpe_50k.json")
    docs = id_and_text(docs, doc_id, text)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, block, before = TaskContext.get().partitionId(), 0, 0
        names, parts, held = [], [], 0

        def close():
            table, control, data = encode(np.frombuffer(b"".join(parts), dtype="<u4"))
            lengths = np.array([len(p) // 4 for p in parts], dtype="<u4").tobytes()
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (lengths, table, control, data))],
                names=["part", "block", "before", "doc_ids", "lengths", "table", "control", "data"],
            )

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), encoder(path).ids(text_list(b.column(1)))):
                if parts and held + len(ids) // 4 + 1 > BLOCK_TOKENS:
                    yield close()
                    block, before, names, parts, held = block + 1, before + held, [], [], 0
                names.append(name), parts.append(ids + end)
                held += len(ids) // 4 + 1
        if parts:
            yield close()

    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(map_text(ordered, run, BLOCK_SCHEMA), tag)


def read(files: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in token files; start counts all ids before it.

    The driver holds one number for each file.
    """
    sizes = {r.part: r.total for r in _totals(files).collect()}
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]

    def run(batches):
        for b in batches:
            for part, before, names, lengths, table, control, data in zip(*(b.column(i).to_pylist() for i in range(7))):
                each = np.frombuffer(lengths, dtype="<u4").astype(np.int64)
                first = np.cumsum(each) - each
                got = decode(table, control, data, int(each.sum())).astype("<u4").tobytes()
                each_bytes = [got[4 * a : 4 * (a + k)] for a, k in zip(first.tolist(), each.tolist())]
                columns = [pa.array(names, pa.int64()), pa.array(first + before + starts[part]), pa.array(each), pa.array([zlib.crc32(x) for x in each_bytes], pa.int64())]
                if ids:
                    columns.append(pa.array(each_bytes, pa.binary()))
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    out = files.select("part", "before", "doc_ids", "lengths", "table", "control", "data")
    return map_text(out, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def _totals(files: DataFrame) -> DataFrame:
    """(part, total): tokens of each file, from the last block's start and lengths alone."""

    def run(batches):
        for b in batches:
            parts, befores, lengths = (b.column(i).to_pylist() for i in range(3))
            total = [x + int(np.frombuffer(y, dtype="<u4").sum(dtype=np.int64)) for x, y in zip(befores, lengths)]
            yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(total, pa.int64())], names=["part", "total"])

    return files.select("part", "before", "lengths").mapInArrow(run, "part int, total long").groupBy("part").agg(F.max("total").alias("total"))

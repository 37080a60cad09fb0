"""Flat binary vector files: two unsigned 64-bit counts, then values; little-endian throughout.

Vector files hold (rows, columns) and 32-bit floats, ground-truth files (queries, k) and 64-bit
ids. Readers go through Spark's binaryFile source, so any store that Spark reads will do; each
file is decoded by one task. The writer makes one file for each partition with pyarrow's
file systems, under a name that a repeated task overwrites with the same bytes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ELEMENTS = 1_000_000_000


def encode_vectors(rows: np.ndarray) -> bytes:
    return struct.pack("<QQ", *rows.shape) + rows.astype("<f4").tobytes()


def header(data: bytes, width: int) -> tuple[int, int]:
    """(rows, columns) of a file whose values take ``width`` bytes; ValueError where the size does not fit."""
    if len(data) < 16:
        raise ValueError("the file has no header")
    n, d = struct.unpack_from("<QQ", data)
    if n * d > MAX_ELEMENTS:
        raise ValueError(f"{n} x {d} values are more than {MAX_ELEMENTS}")
    if len(data) != 16 + n * d * width:
        raise ValueError(f"{n} x {d} values do not fit {len(data)} bytes")
    return n, d


def decode_vectors(data: bytes) -> np.ndarray:
    n, d = header(data, 4)
    return np.frombuffer(data, dtype="<f4", offset=16).reshape(n, d)


def decode_ground_truth(data: bytes) -> np.ndarray:
    n, k = header(data, 8)
    return np.frombuffer(data, dtype="<i8", offset=16).reshape(n, k)


def parse_vector(text: str) -> list[float]:
    """A vector typed as "0.1, 0.2"."""
    return [float(x) for x in text.split(",")]


def put(path: str, data: bytes) -> None:
    """Write one file where pyarrow's file systems reach."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def write_vectors(vectors: DataFrame, folder: str, vec: str = "embedding", key: str = "vec_id", files: int = 4) -> DataFrame:
    """Write vectors in ascending order of key, one file for each range; returns (file, n_rows)."""

    def run(batches):
        from pyspark import TaskContext

        parts = [b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if parts:
            rows = np.concatenate(parts)
            name = f"part-{TaskContext.get().partitionId():05d}.bin"
            put(f"{folder}/{name}", encode_vectors(rows))
            yield pa.record_batch([pa.array([name]), pa.array([len(rows)], pa.int64())], names=["file", "n_rows"])

    ordered = vectors.repartitionByRange(files, key).sortWithinPartitions(key)
    return ordered.select(F.col(vec).cast("array<float>")).mapInArrow(run, "file string, n_rows long")


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, embedding): rows numbered from 0 through the files in order of their names. One number a file goes to the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)

    def head(batches):
        for b in batches:
            n = [struct.unpack_from("<Q", x)[0] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["path", "n"])

    sizes = files.select("path", F.expr("substring(content, 1, 16)").alias("content")).mapInArrow(head, "path string, n long")
    first, at = {}, 0
    for r in sorted(sizes.collect()):
        first[r.path], at = at, at + r.n

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = decode_vectors(data)
                flat = pa.array(x.ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
                yield pa.record_batch([pa.array(np.arange(len(x)) + first[path]), lists], names=["vec_id", "embedding"])

    return files.select("path", "content").mapInArrow(run, "vec_id long, embedding array<float>")


def read_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, rank, vec_id) of ground-truth files."""

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                x = decode_ground_truth(data)
                q, r = np.indices(x.shape)
                yield pa.record_batch([pa.array(q.ravel()), pa.array(r.ravel()), pa.array(x.ravel())], names=["qid", "rank", "vec_id"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gt").load(folder).select("content").mapInArrow(run, "qid long, rank long, vec_id long")


def safe_name(name: str) -> str:
    """A shard or file name without a way out of its folder."""
    if not name or any(x in name for x in ("/", "\\", "..", "\0")):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def is_safe(name: Column) -> Column:
    """The same for a column of names."""
    bad = [F.contains(name, F.lit(x)) for x in ("/", "\\", "..", "\0")]
    return F.coalesce((name != "") & ~(bad[0] | bad[1] | bad[2] | bad[3]), F.lit(False))

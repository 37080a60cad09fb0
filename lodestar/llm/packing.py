"""Packing: shortest-pack-first over the histogram of lengths.

Every text becomes ids with an end id and is cut at multiples of the sequence length, so a
document gives full pieces and one rest. Only the histogram of piece lengths (at most one
count for each length up to ``size``) goes to the driver. There lengths are placed longest
first, each into the open packs with the most room; what is kept is packing patterns with
counts, not packs. A pattern says which lengths a sequence holds; pieces join it by their
rank among the pieces of their length, so no piece moves for it but as a row of five numbers.

A sequence is padded to ``size``, unless its length is a power of two.

Defined results: null and empty texts are the end id alone; repeated rows are separate
documents; ties of length are ranked by doc_id (null first) and start, equal rows take any of
their places; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import id_and_text, map_text, text_list
from .tokens import default_path, encoder

SIZE, END_ID = 2048, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: full ones of ``size`` ids and the rest."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for b in batches:
            rows = []
            for name, ids in zip(b.column(0).to_pylist(), encoder(path).ids(text_list(b.column(1)))):
                ids += end
                n = len(ids) // 4
                rows += [(name, at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_text(id_and_text(docs, doc_id, text), run, PIECE)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Packing patterns (count, lengths) for counts of lengths: the longest first, into the shortest packs that have room."""
    open_: dict[int, list[list]] = {}  # room -> [count, lengths]
    rooms: list[int] = []  # sorted keys of open_
    done: list[tuple[int, list[int]]] = []

    def put(room: int, count: int, lengths: list[int]) -> None:
        if not room:
            done.append((count, lengths))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                each = size // length  # new packs, filled with this length as far as they go
                packs, odd = divmod(left, each)
                if packs:
                    put(size - each * length, packs, [length] * each)
                if odd:
                    put(size - odd * length, 1, [length] * odd)
                break
            room = rooms[-1]
            group = open_[room]
            count, lengths = group[-1]
            used = min(count, left)
            left -= used
            if used == count:
                group.pop()
                if not group:
                    del open_[room], rooms[bisect_left(rooms, room)]
            else:
                group[-1][0] -= used
            put(room - length, used, [*lengths, length])
    return done + [(c, x) for room in rooms for c, x in open_[room]]


def padding(found: list[tuple[int, list[int]]], size: int = SIZE) -> tuple[int, int]:
    """(padding, tokens) of patterns."""
    pad = tokens = 0
    for count, lengths in found:
        n = sum(lengths)
        tokens += count * n
        pad += count * (size - n) * (n & (n - 1) > 0)
    return pad, tokens


def places(found: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, the slots' first sequence ids and offsets."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for count, lengths in found:
        at = 0
        for n in lengths:
            slots.setdefault(n, []).append((rank.get(n, 0), base, at))
            rank[n] = rank.get(n, 0) + count
            at += n
        base += count
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*s)) for n, s in slots.items()}


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int], dict[int, int]]:
    """Pieces in ranges of (length, doc_id, start) with their range's number and their place among its equals.

    Also the rank at which each (range, length) begins and the histogram: as ranges follow the
    lengths, both are a row for each length and one more for each range.
    """
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("start")]

    def run(batches):
        from pyspark import TaskContext

        part, last, place = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            length = b.column(2).to_numpy()
            if not len(length):
                continue
            first = np.concatenate(([0], np.flatnonzero(np.diff(length)) + 1))
            runs = np.diff(np.append(first, len(length)))
            at = np.arange(len(length)) - np.repeat(first, runs)
            if length[0] == last:
                at[: runs[0]] += place
            last, place = length[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(at)], names=[*b.schema.names, "part", "place"])

    out = written(map_text(pieces.repartitionByRange(n, *order).sortWithinPartitions(*order), run, PIECE + ", part int, place long"), "pieces")
    begins, total = {}, {}
    for r in sorted(out.groupBy("part", "length").count().collect()):
        begins[r.part, r.length] = total.get(r.length, 0)
        total[r.length] = begins[r.part, r.length] + r["count"]
    return out, begins, total


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # written first: dealing out by ranges reads its input twice
    pieces = written(cut(docs, path or default_path("word_bpe_49k.json"), size, end_id, doc_id, text), "cut")
    pieces, begins, histogram = ranked(pieces)
    slots = pieces.sparkSession.sparkContext.broadcast((places(patterns(histogram, size)), begins))

    def run(batches):
        found, begins = slots.value
        for b in batches:
            length, part, place = b.column(2).to_numpy(), b.column(5).to_numpy(), b.column(6).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            both = part.astype(np.int64) << 32 | length
            for key in np.unique(both).tolist():
                own = np.flatnonzero(both == key)
                n = key & 0xFFFFFFFF
                first, base, at = found[n]
                rank = place[own] + begins[key >> 32, n]
                slot = np.searchsorted(first, rank, side="right") - 1
                sequence[own], offset[own] = base[slot] + rank - first[slot], at[slot]
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_text(pieces, run, PIECE + ", sequence_id long, offset long")

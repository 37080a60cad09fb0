"""SimHash near-duplicates: 64-bit fingerprints, linked at three or fewer differing bits.

Search. The distinct fingerprints are sorted by Gray rank and dealt into ranges of that order,
where neighbours share most bits. Every eight of them form a node that keeps the bits all of them
share, eight nodes form an upper node, and so on up to the whole range; nodes of all ranges form
the upper index, of a fixed size, which every task gets. A search adds up the differing bits
from node to node and leaves a whole group as soon as the sum passes its limit: first in the
upper index, which tells the ranges where a fingerprint must still look, then inside those.

Orders. Of three differing bits at most one lies in one of the two halves. So there are two
Gray orders, one led by either half, and a search passes one difference at most in the leading
half and three in all; what it can miss in one order it finds in the other. A fingerprint goes
only to later ranges than its own that survive (about half of one for each bit that the ranges
tell apart), so copies grow with the logarithm of the number of ranges.

Nothing is sampled or dropped: ranges are of equal size as fingerprints are distinct, and pairs
in the making are bounded by splitting the work, not by a cap.

Groups. Each range gives a spanning forest of its own links, and for an outer fingerprint one
link to each tree it touches, never all pairs. Components come from alternating large-star and
small-star steps over written tables.

Defined results: null, empty and white-space texts have fingerprint zero and link like any
other; texts under three words are one shingle; repeated rows stay repeated in the output; a
null doc_id keeps its row and never names a component (the component is null when no member
has an id). Extra columns are ignored. :func:`keep_one` keeps one row of each component: that of
the smallest (doc_id, fingerprint), a row with an id before those without; of rows that agree
in both, the one with the smallest hash of the whole row. So rows that share an id but not a
text are decided each by its own text.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .common import byte_list, id_and_text, map_text

SEED, BITS, REACH, SHINGLE = 42, 64, 3, 3
#: Bits by which the two Gray orders turn a fingerprint, and the differences allowed in the half that leads.
ORDERS, LEAD_REACH = (0, 32), 1
FANOUT = 8
#: Distinct fingerprints of a range (8 bytes each in its task), and of a small one, on average.
RANGE_FPS, LEAST_FPS = 1 << 20, 1 << 12
#: Nodes of a range in the upper index, and of the whole upper index (16 bytes each, sent to every task).
RANGE_NODES, MAX_NODES = 64, 1 << 20
#: (query, node) pairs that a search holds at once; more are split.
PAIRS = 1 << 18


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text (UTF-8)."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else [b" ".join(words)]
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(grams), 1 << 16):
        part = grams[lo : lo + (1 << 16)]
        h = np.fromiter(map(digest, part), dtype="<u8", count=len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as the signed long with the same bits."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in byte_list(b.column(1))], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_text(id_and_text(docs, doc_id, text), run, "doc_id long, fp long")


def with_fingerprint(carried: DataFrame, text: str) -> DataFrame:
    """(id_, doc_) with rows as structs -> (id_, doc_, fp)."""
    rows = carried.select("id_", "doc_", F.col("doc_").getField(text).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in byte_list(b.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id_", "doc_", "fp"])

    return map_text(rows, run, rows.drop("text").schema.add("fp", "long"))


def gray_rank(fp):
    """Column: the place of a fingerprint in Gray-code order, as a signed long that sorts alike."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def turned(f: np.ndarray, by: int) -> np.ndarray:
    """Fingerprints with their bits turned (32: the halves exchanged, which undoes itself)."""
    return f << np.uint64(by) | f >> np.uint64(64 - by) if by else f


def levels_of(both: np.ndarray, any_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the lowest nodes up to one: (shared pattern, mask of the shared bits) of every FANOUT below."""
    levels = []
    while len(both) > 1 or not levels:
        at = np.arange(0, len(both), FANOUT)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
        levels.append((both, ~(both ^ any_)))
    return levels


def search(q: np.ndarray, levels, pattern: np.ndarray, mask: np.ndarray | None = None, after: np.ndarray | None = None, seen: dict | None = None):
    """Pairs (which of q, which entry) of arrays: entries of the index within reach of each query.

    Entries are fingerprints, or with ``mask`` the nodes of a shared index. ``after``: only entries
    behind this place. ``seen`` counts entries met and groups left.
    """
    top = len(levels) - 1
    none = np.zeros(len(q), dtype=np.int64)
    todo = [(top, np.arange(len(q)), none, none, none)]
    while todo:
        depth, who, node, lead, total = todo.pop()
        if len(who) > PAIRS:
            for lo in range(0, len(who), PAIRS):
                cut = slice(lo, lo + PAIRS)
                todo.append((depth, who[cut], node[cut], lead[cut], total[cut]))
            continue
        own, bits = (pattern, mask) if depth < 0 else levels[depth]
        fresh = np.uint64((1 << 64) - 1) if bits is None else bits[node]
        if depth < top:
            fresh = fresh & ~levels[depth + 1][1][node // FANOUT]  # an upper node has settled the others
        differ = (q[who] ^ own[node]) & fresh
        lead, total = lead + np.bitwise_count(differ >> np.uint64(32)), total + np.bitwise_count(differ)
        live = (total <= REACH) & (lead <= LEAD_REACH)
        if after is not None:
            live &= (node + 1) * FANOUT ** (depth + 1) - 1 > after[who]
        if seen is not None:
            kind = "met" if depth < 0 else "left"
            seen[kind] = seen.get(kind, 0) + (len(live) if depth < 0 else int(np.count_nonzero(~live)))
        who, node, lead, total = who[live], node[live], lead[live], total[live]
        if depth < 0:
            if len(who):
                yield who, node
            continue
        below = len(levels[depth - 1][0]) if depth else len(pattern)
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        inside = child < below
        who, lead, total = (np.repeat(x, FANOUT)[inside] for x in (who, lead, total))
        todo.append((depth - 1, who, child[inside], lead, total))


class Range:
    """One range of a Gray order: its index, and the trees that its own links make."""

    BLOCK = 4096

    def __init__(self, f: np.ndarray, seen: dict | None = None):
        self.f, self.seen, self.levels = f, seen, levels_of(f, f)
        self.root = np.arange(len(f))
        for lo in range(0, len(f), self.BLOCK):
            q = f[lo : lo + self.BLOCK]
            for who, at in search(q, self.levels, f, after=np.arange(lo, lo + len(q)), seen=seen):
                self._join(who + lo, at)
        self.root = self._find(np.arange(len(f)))

    def _find(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[i]
            if np.array_equal(up, i):
                return i
            i = up

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._find(a), self._find(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of a spanning forest."""
        i = np.flatnonzero(self.root != np.arange(len(self.f)))
        return self.f[self.root[i]], self.f[i]

    def outer(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One link of each fingerprint from outside to each tree it touches."""
        a, b = [q[:0]], [q[:0]]
        for lo in range(0, len(q), self.BLOCK):
            for who, at in search(q[lo : lo + self.BLOCK], self.levels, self.f, seen=self.seen):
                pair = np.unique(who * len(self.f) + self.root[at])
                a.append(q[lo + pair // len(self.f)]), b.append(self.f[pair % len(self.f)])
        return np.concatenate(a), np.concatenate(b)


def _groups(order: int, size: int):
    """Fingerprints in Gray order -> a row for each ``size`` of them: (order, part, grp, both, any, fps)."""

    def run(batches):
        from pyspark import TaskContext

        part, grp, held = TaskContext.get().partitionId(), 0, np.zeros(0, dtype=np.uint64)

        def rows(f: np.ndarray):
            nonlocal grp
            cut = [f[i : i + size] for i in range(0, len(f), size)]
            both = np.array([np.bitwise_and.reduce(x) for x in cut], dtype=np.uint64)
            any_ = np.array([np.bitwise_or.reduce(x) for x in cut], dtype=np.uint64)
            grp += len(cut)
            return pa.record_batch(
                [pa.array([order] * len(cut), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array(range(grp - len(cut), grp), pa.int32()), pa.array(both.view(np.int64)), pa.array(any_.view(np.int64)), pa.array([x.tobytes() for x in cut], pa.binary())],
                names=["order", "part", "grp", "both", "any", "fps"],
            )

        for b in batches:
            held = np.concatenate([held, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = len(held) // size * size
            if whole:
                yield rows(held[:whole])
                held = held[whole:]
        if len(held):
            yield rows(held)

    return run


def gray_index(fps: DataFrame, n: int) -> DataFrame:
    """The distinct ``fps.fp`` (``n`` of them) in both Gray orders, ranges cut into groups; a written table."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-n // RANGE_FPS), min(tasks, -(-n // LEAST_FPS)), 1)
    ranges = min(ranges, MAX_NODES // (2 * len(ORDERS)))
    nodes = max(2, min(RANGE_NODES, MAX_NODES // (ranges * len(ORDERS)) - 1))
    size = max(FANOUT, -(-n // (ranges * nodes)))
    both = None
    for order, by in enumerate(ORDERS):
        fp = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")
        sorted_ = fps.select(fp.alias("fp")).repartitionByRange(ranges, gray_rank(F.col("fp"))).sortWithinPartitions(gray_rank(F.col("fp")))
        rows = map_text(sorted_, _groups(order, size), "order int, part int, grp int, both long, any long, fps binary")
        both = rows if both is None else both.unionByName(rows)
    return written(both, "gray-index")


def _route(shared):
    """Groups -> (slot, kind, grp, order, fps): the group itself for its own range, its surviving members for later ones."""

    def run(batches):
        upper = shared.value
        for b in batches:
            for order, part, grp, fps in zip(*(b.column(i).to_pylist() for i in range(4))):
                slots, levels, pattern, mask, slot_of = upper[order]
                own, q = slot_of[part], np.frombuffer(fps, dtype=np.uint64)
                out = [(own, 0, grp, fps)]
                pairs = [np.zeros(0, dtype=np.int64)]
                for lo in range(0, len(q), Range.BLOCK):
                    for who, node in search(q[lo : lo + Range.BLOCK], levels, pattern, mask, after=np.full(Range.BLOCK, np.searchsorted(slots, own, "right") - 1)):
                        pairs.append(np.unique(slots[node].astype(np.int64) * len(q) + who + lo))
                pairs = np.unique(np.concatenate(pairs))
                to, who = pairs // len(q), pairs % len(q)
                cut = np.flatnonzero(np.diff(to, prepend=-1))
                out += [(int(to[i]), 1, grp, q[w].tobytes()) for i, w in zip(cut, np.split(who, cut[1:]))]
                yield pa.record_batch(
                    [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([order] * len(out), pa.int32()), pa.array([x[3] for x in out], pa.binary())],
                    names=["slot", "kind", "grp", "order", "fps"],
                )

    return run


def _search_ranges(batches):
    """Rows of :func:`_route` by (slot, kind, grp) -> links (a, b)."""

    def links(found, order):
        a, b = (turned(x, ORDERS[order]) for x in found)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    slot, held, range_, last = None, [], None, 0
    for batch in batches:
        for at, kind, order, fps in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            if at != slot:
                if held:  # a range that no outer fingerprint came to
                    yield links(Range(np.concatenate(held)).own(), last)
                slot, held, range_ = at, [], None
            last = order
            if kind == 0:
                held.append(np.frombuffer(fps, dtype=np.uint64))
                continue
            if held:
                range_ = Range(np.concatenate(held))
                held = []
                yield links(range_.own(), order)
            yield links(range_.outer(np.frombuffer(fps, dtype=np.uint64)), order)
    if held:
        yield links(Range(np.concatenate(held)).own(), last)


def upper_index(index: DataFrame) -> tuple[dict, int]:
    """{order: (slot of each node, levels, patterns, masks, {part: slot})} over the groups of all ranges, and the number of slots.

    At most about MAX_NODES rows, by the choice of ranges and groups in :func:`gray_index`.
    """
    nodes = index.select("order", "part", "grp", "both", "any").toPandas().sort_values(["order", "part", "grp"])
    if len(nodes) > 2 * MAX_NODES:
        raise ValueError(f"{len(nodes)} nodes of the upper index, {2 * MAX_NODES} at most")
    upper, slots = {}, 0
    for order, own in nodes.groupby("order"):
        slot_of = {int(p): slots + i for i, p in enumerate(sorted(own.part.unique()))}
        slots += len(slot_of)
        both, any_ = own["both"].to_numpy().view(np.uint64), own["any"].to_numpy().view(np.uint64)
        upper[int(order)] = (own.part.map(slot_of).to_numpy().astype(np.int32), levels_of(both, any_), both, ~(both ^ any_), slot_of)
    return upper, slots


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that join all distinct fingerprints ``fps.fp`` within reach into their components."""
    spark = fps.sparkSession
    n = fps.count()
    none = spark.createDataFrame([], "u long, v long")
    if n < 2:
        return none
    index = gray_index(fps, n)
    upper, slots = upper_index(index)
    shared = spark.sparkContext.broadcast(upper)
    to_ranges = map_text(index.select("order", "part", "grp", "fps"), _route(shared), "slot int, kind int, grp int, order int, fps binary")
    met = to_ranges.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "kind", "grp")
    found = map_text(met, _search_ranges, "a long, b long")
    out = written(found.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    dropped(index)
    return out


def components(edges: DataFrame, salts: int = 8, most: int = 100) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u > v) but the roots, by large-star and small-star steps.

    A vertex with very many neighbours is met in ``salts`` parts; only its minimum, which is one row, is copied.
    Steps double the reach of a minimum, so their number grows with the logarithm of the longest chain; more
    than ``most`` of them raise an error.
    """
    state = None
    for _ in range(most):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        low = low.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        large = both.hint("merge").join(low, ["u", "s"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(low, "u").select("u", "v", "m")
        new = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = written(new.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges)
        edges = new
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components are not settled after {most} steps")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: (doc_id, fp) of each row, and (fp, root, component_id) of each distinct fingerprint."""
    marks = written(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    edges = links(nodes.select("fp"))
    roots = components(edges) if not edges.isEmpty() else edges.select("u", F.col("v").alias("root"))
    named = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    out = written(named.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id"), "components")
    dropped(nodes)
    return marks, out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; the component is the smallest doc_id reachable."""
    marks, named = grouped(docs, doc_id, text)
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


#: Removed ids (16 bytes or so each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component left (see the module's text for which)."""
    marks, named = grouped(docs, doc_id, text)
    found = marks.join(named, "fp").select("doc_id", "fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    winners = written(found.groupBy("root").agg(first.alias("w")).select("w.doc_id", "w.fp"), "winners")
    twice = written(marks.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    side = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    # ids of one row are decided by the id alone
    gone = written(marks.select("doc_id").join(winners.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null"), "duplicates")
    own = F.col(f"`{doc_id}`").cast("long")
    carried = docs.select(own.alias("id_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_"))
    kept = carried.join(side(gone.withColumnRenamed("doc_id", "id_")), "id_", "left_anti").select("doc_.*")
    if twice.isEmpty():
        return kept
    # rows that share an id, or have none, are decided by their own text
    again = side(twice.where("doc_id is not null").withColumnRenamed("doc_id", "id_"))
    alone = carried.where("id_ is not null").join(side(gone.withColumnRenamed("doc_id", "id_")), "id_", "left_anti").join(again, "id_", "left_anti")
    rest = carried.where("id_ is null").unionByName(carried.join(again, "id_", "left_semi"))
    marked = with_fingerprint(rest, text).alias("r")
    won = side(winners).alias("w")
    chosen = marked.join(won, F.col("w.doc_id").eqNullSafe(F.col("r.id_")) & (F.col("w.fp") == F.col("r.fp")), "left_semi")
    chosen = chosen.groupBy("id_", "fp").agg(F.min_by("doc_", F.xxhash64(F.to_json("doc_"))).alias("doc_"))
    return alone.select("doc_.*").unionByName(chosen.select("doc_.*"))

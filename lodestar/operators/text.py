"""Full-text search, rank fusion, decay, and text functions."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: The token pattern and the ranking constants.
TOKEN = "([a-záéíóúñü0-9]+)"
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case tokens in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def re_tokens(text: str) -> list[str]:
    """The same tokens of a Python string."""
    import re

    return re.findall(TOKEN, text.lower())


def where_all(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that match every given column; None is no constraint."""
    for c, v in wanted.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    return rows


def counted(words: Column) -> Column:
    """Array of (term, tf): the distinct words of a row, counted where the row is. Sorted words lie in runs; a run's length is its count."""
    let = lambda value, f: F.transform(F.array(value), f)[0]
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    return F.when(F.size(words) > 0, let(F.sort_array(words), lambda s: let(starts(s), lambda at: runs(s, at)))).otherwise(F.expr("cast(array() as array<struct<term:string,tf:bigint>>)"))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, term, tf): tokens are counted by document and term, first in each task."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


class Index(NamedTuple):
    """A written word index: lists of postings in folders by a hash of the term and sorted by term; lengths of all documents; their number and mean length."""

    postings: DataFrame
    lengths: DataFrame
    n: int
    avgdl: float


#: Folders of an index's postings; the next one holds the lengths of all documents.
FOLDERS = 64
#: Tokens of which lists are made at once, at most but for a longer text.
TOKENS = 1 << 22


def _listed(batches):
    """(folder, term, docs, dls, tfs) of Arrow batches (doc_id, t): one list for each term and batch, and one without a term with the lengths of all rows."""
    names = ["folder", "term", "docs", "dls", "tfs"]

    def lists(keys, sizes, terms, columns):
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.record_batch([pa.array(keys, pa.int32()), terms, *[pa.ListArray.from_arrays(ends, c) for c in columns]], names=names)

    for whole in batches:
        ends = np.cumsum(np.asarray(whole.column("t").value_lengths()))
        at = 0
        while at < whole.num_rows:
            before = int(ends[at - 1]) if at else 0
            until = max(at + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
            b, at = whole.slice(at, until - at), until
            ids, t = b.column("doc_id"), b.column("t")
            dl = np.asarray(t.value_lengths()).astype(np.int32)
            yield lists([FOLDERS], [len(dl)], pa.array([None], pa.string()), [ids, pa.array(dl), pa.array(np.zeros(len(dl), np.int32))])
            words = t.flatten().dictionary_encode()
            if not len(words):
                continue
            pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
            term, doc = pair // len(dl), pair % len(dl)
            folder = [zlib.crc32(w.encode()) % FOLDERS for w in words.dictionary.to_pylist()]
            yield lists(folder, np.bincount(term, minlength=len(folder)), words.dictionary, [ids.take(pa.array(doc)), pa.array(dl[doc]), pa.array(tf.astype(np.int32))])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """One pass over the texts and one shuffle, of lists of postings by their folder: documents' words are counted and listed by term in each task.

    The lists of a very common term are dealt into several tasks.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = rows.mapInArrow(_listed, f"folder int, term string, docs array<{kind}>, dls array<int>, tfs array<int>")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = lists.repartition(max(n, 1), "folder", F.pmod(F.xxhash64("docs"), F.lit(4))).sortWithinPartitions("folder", "term")
    held = written(held, "postings", ("folder",))
    lengths = held.where(F.col("folder") == FOLDERS).select(F.explode(F.arrays_zip("docs", "dls")).alias("l")).select(F.col("l.docs").alias("doc_id"), F.col("l.dls").cast("long").alias("dl"))
    s = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return Index(held, lengths, s.n, s.avgdl or 0.0)


def listed_postings(index: Index, terms: list[str]) -> DataFrame:
    """(doc_id, dl, term, tf) of some terms; rows that share an id and a length count as one document, as in :func:`postings`."""
    folders = sorted({zlib.crc32(w.encode()) % FOLDERS for w in terms})
    lists = index.postings.where(F.col("folder").isin(folders) & F.col("term").isin(sorted(terms)))
    each = lists.select("term", F.explode(F.arrays_zip("docs", "dls", "tfs")).alias("p")).select(F.col("p.docs").alias("doc_id"), F.col("p.dls").cast("long").alias("dl"), "term", F.col("p.tfs").cast("long").alias("tf"))
    return each.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))


def search_index(index: Index, query: str | list[str], k: int | None = 10, allowed: DataFrame | None = None, removed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) as :func:`bm25` gives them, from the folders of the query's words alone.

    ``removed`` (doc_id): documents that are gone, from the statistics too. ``allowed`` narrows the results only.
    """
    words = re_tokens(query) if isinstance(query, str) else list(query)
    weight = {w: words.count(w) for w in words}
    if not weight:
        return index.lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    tf = listed_postings(index, sorted(weight))
    n, avgdl = index.n, index.avgdl
    if removed is not None:
        gone = removed.select("doc_id").distinct()
        tf = tf.join(gone, "doc_id", "left_anti")
        n, avgdl = index.lengths.join(gone, "doc_id", "left_anti").agg(F.count("*"), F.avg("dl")).first()
    return _scored(tf, weight, n, avgdl or 0.0, k, allowed, k1, b)


def _scored(tf: DataFrame, weight: dict[str, int], n: int, avgdl: float, k: int | None, allowed: DataFrame | None, k1: float, b: float, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of (doc_id, dl, term, tf) for the words of a query and how often each is asked for."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query word
    scored = tf.join(F.broadcast(df), "term")
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    times = F.element_at(F.create_map(*[x for w in sorted(weight) for x in (F.lit(w), F.lit(weight[w]))]), F.col("term"))
    part = times * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    if allowed is not None:
        scored = scored.join(allowed.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    out = scored.groupBy("doc_id").agg(F.sum(part).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "doc_id").limit(k)


def rerank(hits: DataFrame, score: Column, k: int, key: str = "doc_id") -> DataFrame:
    """The k rows of a bounded result list that a scorer of one's own (any column of ``hits``) puts first, with ranks from 0."""
    top = hits.withColumn("score_", score).orderBy(F.desc("score_"), key).limit(k)
    return ranked(top, F.desc("score_"), "rank", key).withColumnRenamed("score_", "rerank_score")


def doc_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("dl"))


def bm25(docs: DataFrame, query: str | list[str], k: int | None = 10, allowed: DataFrame | None = None, k1: float = K1, b: float = B, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of the best documents; repeated query words count as often as they occur.

    Texts are read once: each one's length and its tokens among the query's words are written, and
    both the statistics and the scores come from that narrow table. ``allowed`` narrows the results, not the statistics.
    """
    words = re_tokens(query) if isinstance(query, str) else list(query)
    weight = {w: words.count(w) for w in words}
    if not weight:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    asked = F.array(*[F.lit(w) for w in sorted(weight)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t")).select("doc_id", F.size("t").cast("long").alias("dl"), F.filter("t", lambda x: F.array_contains(asked, x)).alias("t"))
    rows = written(rows, "query-postings")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = rows.select("doc_id", "dl", F.explode(counted(F.col("t"))).alias("c")).select("doc_id", "dl", "c.term", "c.tf")
    s = stats.first()
    return _scored(tf, weight, s.n, s.avgdl or 0.0, k, allowed, k1, b, doc_id)


def ranked(hits: DataFrame, by: Column, name: str, key: str = "doc_id") -> DataFrame:
    """A bounded result list with 0-based ranks."""
    return hits.withColumn(name, (F.row_number().over(Window.orderBy(by, key)) - 1).cast("long"))


def rrf(first: DataFrame, second: DataFrame, weight: float = 0.6, k: int = 60, key: str = "doc_id") -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (key, rank); a missing side ranks at its list's length."""
    n1, n2 = first.count(), second.count()
    a, b = first.select(key, F.col("rank").alias("r1")), second.select(key, F.col("rank").alias("r2"))
    both = a.join(b, key, "full_outer")
    score = weight / (k + F.coalesce("r1", F.lit(n1)) + 1) + (1 - weight) / (k + F.coalesce("r2", F.lit(n2)) + 1)
    return both.select(key, score.alias("score"))


def rrf_sum(lists: list[DataFrame], k: int = 60, key: str = "doc_id") -> DataFrame:
    """Unweighted fusion: an absent list adds nothing."""
    out = lists[0].select(key, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(key, "rank"))
    return out.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def decay(ts: Column, now: Column, half_life_s: float) -> Column:
    """exp(-0.693 age / half-life)."""
    return F.exp(-0.693 * (F.unix_timestamp(now) - F.unix_timestamp(ts)) / half_life_s)


#: Keywords of each category, in the order that decides ties.
CATEGORIES = {
    "decision": ["decided", "decision", "chose", "elected", "agreed", "plan"],
    "preference": ["prefers", "likes", "loves", "favorite", "default"],
    "project": ["project", "implement", "build", "feature", "sprint"],
    "error": ["error", "bug", "failed", "crash", "exception", "broken"],
    "learning": ["learned", "lesson", "discovered", "realized", "insight"],
    "task": ["todo", "task", "pending", "reminder", "need to"],
}


def category(text: Column, table: dict[str, list[str]] | None = None) -> Column:
    """The category with most keywords present; the first wins a tie; null without any."""
    table = table or CATEGORIES
    low = F.lower(text)
    scores = {c: sum((low.contains(w).cast("int") for w in ws[1:]), low.contains(ws[0]).cast("int")) for c, ws in table.items()}
    best = F.greatest(*scores.values())
    out = F.when(best == 0, F.lit(None).cast("string"))
    for c, s in scores.items():
        out = out.when(s == best, F.lit(c))
    return out


#: Patterns of structural entities, as (kind, pattern).
ENTITIES = [
    ("contact", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"),
    ("url", r"(https?://[^\s<>\"]+|www\.[^\s<>\"]+)"),
    ("contact", r"(\d{3}[-.]?\d{3}[-.]?\d{4})"),
    ("date", r"(\d{4}-\d{2}-\d{2})"),
    ("money", r"(\$\d+(?:,\d{3})*(?:\.\d{2})?)"),
]


def entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, entity, n): structural entities by lower-cased form."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(1)).alias("m")) for k, p in ENTITIES])
    rows = docs.select(key, F.explode(found).alias("f")).select(key, F.col("f.kind").alias("kind"), F.explode("f.m").alias("m"))
    return rows.groupBy(key, "kind", F.lower("m").alias("entity")).agg(F.count("*").alias("n"))


def passages(docs: DataFrame, size: int = 200, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passage, body): windows of words with an overlap."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size - overlap))
    return rows.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("passage", "body"))


def answer_f1(predicted: Column, expected: Column) -> Column:
    """Set intersection over token-list lengths, after lower-casing and dropping punctuation and articles."""
    clean = lambda c: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), r"\b(a|an|the)\b", " "), " +"), lambda w: w != "")
    p, e = clean(predicted), clean(expected)
    same = F.size(F.array_intersect(p, e))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(e)))


def rle(data: bytes) -> bytes:
    """Length (4 bytes, little-endian), then runs of 4 to 255 as FF, byte, count; FF itself always as a run."""
    import re

    out = [len(data).to_bytes(4, "little")]
    at = 0
    for m in re.finditer(rb"(.)\1{3,254}|\xff", data, re.S):
        run = m[0]
        out += [data[at : m.start()], b"\xff", run[:1], bytes([len(run)])]
        at = m.end()
    return b"".join([*out, data[at:]])


def unrle(data: bytes) -> bytes:
    """What :func:`rle` took."""
    import re

    out = re.sub(rb"\xff(.)(.)", lambda m: m[1] * m[2][0], data[4:], flags=re.S)
    if len(out) != int.from_bytes(data[:4], "little"):
        raise ValueError("the run-length data is torn")
    return out


#: Words that start no name, and words that may join two parts of one.
NAME_STOP = set(
    "el la los las un una unos unas de del a ante con en para por y o u e que es son se su lo the an and or in on at to for with is are of from by this that it as was were be been has have".split()
)
NAME_JOIN = {"de", "del", "la", "el", "y", "e", "u"}


def names_in(text: str) -> dict[str, tuple[str, int]]:
    """{lower-case form: (first form, times)}: capitalised words in a row, up to four or a little over where a joining word takes part."""
    import re

    words = re.findall(r"\b[A-Za-z0-9]+\b", text)
    big = [len(w) > 1 and w[0].isupper() for w in words]
    starts = [b and w.lower() not in NAME_STOP for b, w in zip(big, words)]
    found: dict[str, tuple[str, int]] = {}
    i = 0
    while i < len(words):
        end = i + 1
        while starts[i] and end < len(words) and end - i < 4:
            if starts[end]:
                end += 1
            elif words[end].lower() in NAME_JOIN and end + 1 < len(words) and big[end + 1]:
                end += 2
            else:
                break
        if starts[i]:
            name = " ".join(words[i:end])
            form, n = found.get(name.lower(), (name, 0))
            found[name.lower()] = (form, n + 1)
        i = end
    return found


#: Words left out, and short forms, of semantic compression.
DENSE_STOP = set(
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into through during before after above below between out off over under again further then once that this these those am it its".split()
)
SHORT_FORMS = {
    "information": "info", "application": "app", "configuration": "config", "database": "db", "document": "doc", "environment": "env", "management": "mgmt", "performance": "perf", "reference": "ref",
    "administrator": "admin", "password": "pwd", "number": "num", "value": "val", "parameter": "param", "return": "ret", "request": "req", "response": "resp", "message": "msg", "transaction": "txn",
    "authentication": "auth", "authorization": "authz", "development": "dev", "production": "prod", "staging": "stg", "television": "tv", "telephone": "tel", "please": "plz", "thank you": "thx",
    "for example": "e.g.", "that is": "i.e.", "with respect to": "re", "versus": "vs", "through": "thru", "although": "tho", "because": "cuz", "technical": "tech", "technology": "tech",
    "department": "dept", "experience": "exp", "education": "edu", "government": "gov", "organization": "org", "association": "assoc", "corporation": "corp", "incorporated": "inc", "university": "uni",
}


def dense(text: str) -> str:
    """Short forms, no filler words but capitalised ones, single spaces, no sentence twice."""
    import re

    def short(m):
        s = SHORT_FORMS[m[0].lower()]
        return s[0].upper() + s[1:] if "A" <= m[0][0] <= "Z" else s

    if not hasattr(dense, "pattern"):
        # spelt out in both cases, by first letters: a search looks for those alone, and tries a few words there
        either = lambda w: "".join({"k": "[kK\u212a]", ".": r"\."}.get(c, f"[{c}{c.upper()}]" if c.isalpha() else c) for c in w)
        first = {c: [w[1:] for w in sorted(SHORT_FORMS) if w[0] == c] for c in sorted({w[0] for w in SHORT_FORMS})}
        words = "|".join(f"(?<={either(c)})(?:{'|'.join(map(either, rest))})" for c, rest in first.items())
        dense.pattern = re.compile(f"[{''.join(first)}{''.join(first).upper()}](?<!(?i:[A-Za-z]).)(?:{words})(?!(?i:[A-Za-z]))")
    words = [w for w in dense.pattern.sub(short, text).split() if w[0].isupper() or w.lower() not in DENSE_STOP]
    seen = {}
    for s in " ".join(words).split(". "):
        seen.setdefault(s.lower(), s)
    return ". ".join(seen.values())


#: Words that label no room.
LABEL_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need dare ought used to of in for on with at by from as into through during before after above below between out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just because but and or if while about up its it this that these those i me my we our you your he him his she her they them their what which who whom "
    "el la los las un una unos unas de del en por para con sin sobre entre hacia hasta desde que es son fue ser estar ha han se no si su sus como más muy también pero yo tú él ella nosotros ellos esto eso ya hay puede todo"
).split()

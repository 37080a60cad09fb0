"""Quality rules with thresholds that follow each language and source.

Base measures of every whole text are taken once. The adaptive measures (whole numbers) go
into quantile sketches: histograms with exact bins up to 128 and 64 bins for each power of two
beyond, so a quantile is at most 1/64 too high. Counts of bins add up, so sketches of tasks
merge into those of a (language, source), these into a language's and into the one of all.
A group of fewer than ``min_docs`` texts takes its language's thresholds, or else those of all.

Limits come from the group's sketch alone. With ``t`` the quantile of a measure's tail (a share of
texts that are taken to be ordinary) and ``m`` the median, a text is rejected beyond
``t + spread * (t - m)``, and for the words' mean length also below the mirror image of that at
the other tail. There is no constant floor: where nearly all texts of a group have none of
something, its limit is zero, and where they have much, the limit follows.

Defined results: null and empty texts have no words and fail the base rule; a null language
or source is as an empty one; repeated rows stay repeated; an empty table gives no row. Extra
columns pass through :func:`measured` and :func:`keep`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import byte_list, map_text

MIN_WORDS, MAX_REPEAT = 50, 50
#: Texts of a group that has limits of its own (the tail at 99 % needs about a hundred), and the spread.
MIN_DOCS, SPREAD = 100, 4
#: Adaptive measures: (name, quantile of the tail in percent, whether there is a lower bound too).
MEASURES = [("symbols", 85, False), ("dup_lines", 99, False), ("repeats", 99, False), ("word_length", 90, True)]
#: Groups (a row of some 100 bytes each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
_SPACE = b" \t\n\x0b\x0c\r"
_NOT_POINTS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
OWN = ["m_words", "m_word_chars", "m_symbols", "m_lines", "m_dup_lines", "m_repeat_words"]


def measure(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(words, word_chars, symbols, lines with a word, duplicate lines, words in repeated 3-word windows) of one text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    n, repeated = len(words), 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        _, which, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        hit = np.zeros(n, dtype=bool)
        for k in range(3):
            hit[at + k] = True
        repeated = int(hit.sum())
    return n, len(data.translate(None, _NOT_POINTS)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", only: list[str] | None = None) -> DataFrame:
    """(doc_, m_lang, m_source, m_*): each row of ``docs`` (all columns, or those in ``only``) as one struct, and its measures.

    The struct keeps the columns of ``docs`` apart from the names used here.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in (only or docs.columns)])
    names = [carried.alias("doc_"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"m_{n}") for c, n in ((lang, "lang"), (source, "source")))]
    docs = docs.select(*names, F.col(text).cast("string").alias("m_text"))
    out = docs.drop("m_text").schema
    for c in OWN:
        out = out.add(c, "long")

    def run(batches):
        for b in batches:
            values = list(zip(*map(measure, byte_list(b.column(b.num_columns - 1))))) or [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, pa.int64()) for v in values)], names=[*b.schema.names[:-1], *OWN])

    return map_text(docs, run, out)


def rates() -> dict[str, F.Column]:
    """The adaptive measures as whole numbers: shares in 1/10,000, word length in 1/100."""
    share = lambda a, b: F.expr(f"({a} * 10000) div greatest({b}, 1)")
    return {"symbols": share("m_symbols", "m_word_chars"), "dup_lines": share("m_dup_lines", "m_lines"), "repeats": share("m_repeat_words", "m_words"), "word_length": F.expr("(m_word_chars * 100) div greatest(m_words, 1)")}


def bin_of(v: F.Column) -> F.Column:
    """The sketch's bin of a whole number from 0."""
    e = F.length(F.bin(v)) - 7
    return F.when(v < 128, v).otherwise(128 + (e - 1) * 64 + F.call_function("shiftright", v, e) - 64).cast("int")


def top_of(b: F.Column) -> F.Column:
    """The largest number of a bin."""
    e = F.floor((b - 128) / 64).cast("int") + 1
    return F.when(b < 128, b.cast("long")).otherwise(F.call_function("shiftleft", ((b - 128) % 64 + 65).cast("long"), e) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n) over rows with measures that pass the base rule."""
    values = F.array(*[F.struct(F.lit(i).alias("measure"), bin_of(rates()[m]).alias("bin")) for i, (m, _, _) in enumerate(MEASURES)])
    each = rows.where(~base_failed()).select(F.col("m_lang").alias("lang"), F.col("m_source").alias("source"), F.explode(values).alias("v"))
    return each.groupBy("lang", "source", "v.measure", "v.bin").agg(F.count("*").alias("n"))


def base_failed() -> F.Column:
    return F.expr(f"m_words < {MIN_WORDS} or 100 * m_repeat_words > {MAX_REPEAT} * m_words")


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by..., measure, total, low, mid, tail) of merged sketches; a group has a bounded number of bins."""
    merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    sums = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    tail = F.element_at(F.array(*[F.lit(t) for _, t, _ in MEASURES]), F.col("measure") + 1)
    q = lambda k: F.min(F.when(F.col("upto") * 100 >= F.col("total") * k, top_of(F.col("bin"))))
    return sums.groupBy(*by, "measure").agg(F.max("total").alias("total"), q(100 - tail).alias("low"), q(F.lit(50)).alias("mid"), q(tail).alias("tail"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """(lang, source, low_*, high_*): one row for each language and source of the sketches."""
    marks = ("low", "mid", "tail")
    own = quantiles(sketch, "lang", "source")
    tongue = quantiles(sketch, "lang").select("lang", "measure", *(F.col(c).alias(f"l_{c}") for c in ("total", *marks)))
    every = quantiles(sketch.withColumn("all", F.lit(0)), "all").select("measure", *(F.col(c).alias(f"a_{c}") for c in marks))
    rows = own.join(tongue, ["lang", "measure"]).join(F.broadcast(every), "measure")  # a row for each measure
    pick = lambda c: F.when(F.col("total") >= min_docs, F.col(c)).when(F.col("l_total") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    rows = rows.select("lang", "source", "measure", *(pick(c) for c in marks))
    aggs = []
    for i, (m, _, low) in enumerate(MEASURES):
        of = lambda c: F.max(F.when(F.col("measure") == i, c))
        aggs.append(of(F.col("tail") + spread * (F.col("tail") - F.col("mid"))).alias(f"high_{m}"))
        if low:
            aggs.append(of(F.col("low") - spread * (F.col("mid") - F.col("low"))).alias(f"low_{m}"))
    return rows.groupBy("lang", "source").agg(*aggs)


def judged(rows: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD) -> DataFrame:
    """Written rows with measures -> the same with ``base_failed`` and ``kept`` behind."""
    limits = written(thresholds(sketches(rows), min_docs, spread).withColumnsRenamed({"lang": "m_lang", "source": "m_source"}), "thresholds")
    side = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    passes = ~base_failed()
    for m, _, low in MEASURES:
        passes &= F.coalesce(rates()[m] <= F.col(f"high_{m}"), F.lit(True))
        if low:
            passes &= F.coalesce(rates()[m] >= F.col(f"low_{m}"), F.lit(True))
    return rows.join(side, ["m_lang", "m_source"], "left").select(*rows.columns, base_failed().alias("base_failed"), passes.alias("kept"))


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    rows = written(measured(docs, text, lang, source, only=[doc_id]), "measures")
    out = judged(rows, **options)
    return out.select(F.col("doc_").getField(doc_id).alias("doc_id"), F.col("m_words").alias("n_words"), F.col("m_word_chars").alias("word_chars"), F.col("m_symbols").alias("n_symbols"), F.col("m_dup_lines").alias("n_dup_lines"), F.col("m_repeat_words").alias("n_repeat_words"), "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns."""
    rows = written(measured(docs, text, lang, source), "measured-documents")
    return judged(rows, **options).where("kept").select("doc_.*")


#: The same in SQL, for comparison.
def sql(min_docs: int = MIN_DOCS, spread: int = SPREAD) -> str:
    sizes = {"symbols": "(n_symbols * 10000) // greatest(word_chars, 1)", "dup_lines": "(n_dup_lines * 10000) // greatest(n_lines, 1)", "repeats": "(n_repeat_words * 10000) // greatest(n_words, 1)", "word_length": "(word_chars * 100) // greatest(n_words, 1)"}
    bins = " union all ".join(f"select lang, source, {i} as measure, {sizes[m]} as v from base where not base_failed" for i, (m, _, _) in enumerate(MEASURES))
    highs = ", ".join(f"max(case when measure = {i} then tail + {spread} * (tail - mid) end) as high_{i}, max(case when measure = {i} then low - {spread} * (mid - low) end) as low_{i}" for i in range(len(MEASURES)))
    at = "case measure " + " ".join(f"when {i} then {t}" for i, (_, t, _) in enumerate(MEASURES)) + " end"
    marks = ("low", "mid", "tail")
    picks = ", ".join(f"case when o.total >= {min_docs} then o.{c} when t.total >= {min_docs} then t.{c} else e.{c} end as {c}" for c in marks)
    tests = " and ".join(f"coalesce({sizes[m]} <= high_{i}, true)" + f" and coalesce({sizes[m]} >= low_{i}, true)" * low for i, (m, _, low) in enumerate(MEASURES))

    def quart(by: str) -> str:
        keys = f"{by}, measure" if by else "measure"
        return f"""select {keys}, max(total) as total, min(case when upto * 100 >= total * (100 - {at}) then top end) as low, min(case when upto * 100 >= total * 50 then top end) as mid, min(case when upto * 100 >= total * {at} then top end) as tail
            from (select {keys}, case when bin < 128 then bin else ((((bin - 128) % 64) + 65) << ((bin - 128) // 64 + 1)) - 1 end as top, sum(n) over (partition by {keys} order by bin) as upto, sum(n) over (partition by {keys}) as total
                  from (select {keys}, bin, count(*) as n from binned group by {keys}, bin)) group by {keys}"""

    return f"""
    with texts as (select row_number() over () as k, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
    split as (select k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l, text from texts),
    spots as (select k, unnest(range(1, len(w) - 1)) as i, w from split where len(w) > 2),
    grams as (select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from spots),
    often as (select k, i from (select k, i, count(*) over (partition by k, a, b, c) as n from grams) where n > 1),
    rep as (select k, count(distinct p) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as p from often) group by k),
    base as (select t.k, doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(s.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        (len(w) < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT} * len(w)) as base_failed
        from texts t join split s using (k) left join rep using (k)),
    values_ as ({bins}),
    binned as (select lang, source, measure, case when v < 128 then v else 128 + (length(bin(v)) - 8) * 64 + (v >> (length(bin(v)) - 7)::int) - 64 end as bin from values_),
    own as ({quart("lang, source")}), tongue as ({quart("lang")}), every_ as ({quart("")}),
    picked as (select o.lang, o.source, o.measure, {picks}
        from own o join tongue t on o.lang = t.lang and o.measure = t.measure join every_ e on o.measure = e.measure),
    limits as (select lang, source, {highs} from picked group by lang, source)
    select doc_id, n_words::bigint as n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
        (not base_failed and {tests}) as kept
    from base left join limits using (lang, source)"""

"""Secret scans in DataFrame functions only: fixed patterns, and two character Markov models.

Base spans are the leftmost non-overlapping matches of three patterns (assignments, access
keys, long hex runs). The method adds tokens that a Markov model of random strings explains
better than one of ordinary identifiers: the log-likelihood ratio of a token's transitions
must reach ``least`` in all and ``mean`` for each character, and the token must hold a letter and no
sign four times in a row (ruled lines).
Tokens have 6 characters or more; those under 16 must also hold a digit, as short words that the
samples do not know would pass (the README gives figures). Both models are trained from labelled
samples, random strings and identifiers, with add-one smoothing; the table of transitions has a
fixed size (one number for each pair of 63 characters).

Positions are code points, from 0, end exclusive. They come from the gaps between matches:
a split by the pattern gives the gaps, the extraction gives the matches in the same order, and
sums of lengths give the places. Running sums, greatest ends and least starts are folded in
blocks (:func:`running`), a token's characters are met once, and pieces of a text are cut out of
its blocks of 1,024 characters, so the work is in proportion to a text's length, whatever
the length of a token and the number of matches.

Defined results: null and empty texts have no span; repeated rows stay repeated; added spans
that touch a base span are left out; very long texts are scanned whole. Other columns pass
through :func:`with_spans` and :func:`redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Whole runs of 16 characters or more, or of 6 or more with a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/_=-]{16,}|(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{6,})"
SPAN = "struct<start:int,order:int,end:int,value:string>"
KINDS = ["assign", "access", "hex", "random"]
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Set by recall and false positives on held-out samples; figures in the README.
RATIO, MEAN = 4.0, 0.1
RULED = r"([+/_=-])\1{3}"
#: Elements of a block of a running fold; characters of a block of text.
FOLD, CUT = 64, 1024
#: How many random strings of each alphabet are drawn (from hashes of 1, 2, ...).
N_RANDOM = 1500
_WORDS = """the and that have with this from they would there their what about which when make like time just know take people into year your good some could them other than then now look only come over think also back after work first well even want because these give most information version language configuration application development environment documentation implementation transaction connection description international organization responsibility characteristics understanding communication administration representation interpretation
der und die das nicht sich auch werden haben wird sind einer einem wurde durch zwischen geschwindigkeit verantwortung wissenschaft entwicklung gesellschaft möglichkeit veranstaltung unternehmen zusammenarbeit verschiedenen beispielsweise schreiben
les des une dans pour que qui sur avec est sont pas plus par tout nous vous leur comme mais être avoir faire gouvernement développement administration organisation communication responsabilité connaissance environnement particulièrement quelque toujours
los las una del por para con como pero más sus este esta entre cuando muy sin sobre también hasta desde donde todos durante información desarrollo administración organización comunicación responsabilidad conocimiento particularmente
get set value name list index count start end item user account order customer message request response handler manager service factory controller repository buffer stream channel thread process queue cache table column schema query result error exception default parameter argument option setting property attribute element document content header footer section title image source target path file directory folder update delete insert create select filter group sort join merge split convert format parse encode decode encrypt validate initialize execute schedule retry timeout interval threshold maximum minimum average total""".split()

#: Short names with digits that identifiers are made with.
_SHORT = "utf8 utf16 sha1 sha256 md5 base64 ipv4 ipv6 int32 uint8 float64 mp3 mp4 h264 x86 x64 arm64 win32 python3 http2 1st 2nd 3rd 4th 2d 3d i18n k8s s3 b2b c3po latin1 iso8601 rfc822 64bit v2 r2".split()


def samples(spark: SparkSession) -> DataFrame:
    """(text, random): labelled samples. Ordinary ones are words and identifiers made of them, some with dates."""
    words = spark.createDataFrame([(i, w) for i, w in enumerate(_WORDS)], "i long, w string")
    other = words.select((F.pmod(F.col("i") * 7 + 3, F.lit(len(_WORDS)))).alias("i"), F.col("w").alias("v"))
    both = words.join(other, "i")
    turn = lambda n, first: F.pmod(F.col("i") * 13, F.lit(n)) + first
    day = F.format_string("%d-%02d-%02d", turn(41, 1990), turn(12, 1), turn(28, 1))
    short = F.element_at(F.array(*[F.lit(x) for x in _SHORT]), (F.pmod(F.col("i") * 5, F.lit(len(_SHORT))) + 1).cast("int"))
    plain = both.select(F.explode(F.array("w", F.upper("w"), F.initcap("w"), F.concat("w", "v"), F.concat_ws("_", "w", "v"), F.concat_ws("-", "w", "v"), F.concat_ws("/", "w", "v"), F.concat("w", F.initcap("v")), F.concat(F.initcap("w"), F.initcap("v")), F.upper(F.concat_ws("_", "w", "v")), F.upper(F.concat("w", "v")), F.concat("w", F.pmod("i", F.lit(10)).cast("string")), F.concat_ws("_", day, "w"), F.concat_ws("-", "w", day), F.concat("w", F.substring(day, 1, 4)), F.concat_ws("T", day, turn(24, 0)), F.concat(turn(90, 10), F.lit("x"), turn(70, 20), "w"), F.concat("w", turn(9, 1), "v"), F.concat(turn(990, 10), "w"), F.concat("w", turn(99, 1), F.lit("bit")), F.concat(F.lit("v"), turn(9, 1), "w", turn(9, 1)), F.concat("w", F.lit("-"), "v", F.substring(day, 1, 4)), F.concat(short, "w"), F.concat("w", short), F.concat_ws("_", short, "w"), F.concat_ws("-", "w", short))).alias("text"))
    h = F.sha2(F.col("id").cast("string"), 256)
    base = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    drawn = spark.range(1, N_RANDOM + 1).select(F.explode(F.array(h, base, F.regexp_replace(F.upper(base), "[^A-Z0-9]", ""), F.regexp_replace(F.lower(base), "[^a-z0-9]", ""), F.regexp_replace(base, "[^A-Za-z0-9]", ""))).alias("text"))
    return plain.withColumn("random", F.lit(False)).unionByName(drawn.withColumn("random", F.lit(True)))


def code(c: Column) -> Column:
    """A character's number: its place among letters and digits, or one number for all others."""
    return F.pmod(F.call_function("instr", F.lit(LETTERS), c) - 1, F.lit(len(LETTERS) + 1))


def let(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, op, zero: Column) -> Column:
    """Array of ``op`` over each element and all before it (``op`` associative, ``zero`` neutral), folded in blocks."""
    next_ = lambda out, x: F.concat(out, F.array(op(F.element_at(out, -1), x)))

    def whole(v):
        at = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(FOLD))
        return F.transform(at, lambda i: F.slice(F.aggregate(F.slice(v, i + 1, F.lit(FOLD)), F.array(zero), next_), 2, FOLD))

    def offset(blocks):
        return let(F.aggregate(blocks, F.array(zero), lambda out, b: F.concat(out, F.array(op(F.element_at(out, -1), F.coalesce(F.try_element_at(b, F.lit(-1)), zero))))), lambda before: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: op(F.get(before, i), x)))))

    return let(values, lambda v: let(whole(v), offset))


def fit(labelled: DataFrame, smooth: float = 1.0) -> list[float]:
    """For each pair of characters, the log ratio of its chance in random strings to that in ordinary ones."""
    k = len(LETTERS) + 1
    pairs = labelled.where(F.length("text") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: code(F.col("text").substr(i, F.lit(1))) * k + code(F.col("text").substr(i + 1, F.lit(1))))).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # at most 2 * 63 * 63 rows
    rows = {(y, a): sum(counts.get((y, a * k + b), 0) for b in range(k)) for y in (False, True) for a in range(k)}
    chance = lambda y, a, b: (counts.get((y, a * k + b), 0) + smooth) / (rows[y, a] + smooth * k)
    return [round(math.log(chance(True, a, b) / chance(False, a, b)), 6) for a in range(k) for b in range(k)]


def matches(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Array of (start, order, end, value) of a pattern's leftmost non-overlapping matches.

    ``least``: matches whose second group is shorter take part in the search but are dropped.
    """
    order = KINDS.index(kind)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})" if not least else pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    each = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), whole.alias("hit"), inner.alias("inner"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    # every gap and the match behind it end where the lengths up to there add up to
    ends = running(F.zip_with(gaps, whole, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0))), lambda a, b: a + b, F.lit(0))
    each = F.arrays_zip(ends.alias("end"), whole.alias("hit"), inner.alias("inner"))
    good = F.filter(each, lambda e: e.hit.isNotNull() & ((F.length(e.inner) >= least) if least else F.lit(True)))
    found = F.transform(good, lambda e: F.struct((e.end - F.length(e.hit)).alias("start"), F.lit(order).alias("order"), e.end.alias("end"), e.hit.alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(none)


def ratio(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of a token's transitions."""
    k = len(LETTERS) + 1
    steps = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: table[a * k + b])
    return let(F.transform(F.split(token, ""), code), lambda c: F.aggregate(steps(c), F.lit(0.0), lambda s, x: s + x))


def touched(spans: Column, base: Column) -> Column:
    """The ``spans`` that touch no span of ``base``, in order; both are sorted as one, and each looks at its surroundings.

    A span touches one before it if the greatest end of those is beyond its start, and one behind it if the
    least start of those is before its end.
    """
    row = lambda x, own: F.struct(x.start.alias("start"), x.order.alias("order"), x.end.alias("end"), x.value.alias("value"), F.lit(own).alias("own"))
    top = 2**31 - 1

    def apart(all_):
        ends = running(F.transform(all_, lambda x: F.when(x.own, 0).otherwise(x.end)), lambda a, b: F.greatest(a, b), F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x.own, top).otherwise(x.start))), lambda a, b: F.least(a, b), F.lit(top)))
        each = F.arrays_zip(all_.alias("x"), ends.alias("reach"), starts.alias("next"))
        free = F.filter(each, lambda e: e.x.own & (e.reach <= e.x.start) & (e.next >= e.x.end))
        return F.transform(free, lambda e: F.struct(*(e.x[c].alias(c) for c in ("start", "order", "end", "value"))))

    merged = F.array_sort(F.concat(F.transform(spans, lambda x: row(x, True)), F.transform(base, lambda x: row(x, False))))
    return F.when(F.size(spans) == 0, spans).when(F.size(base) == 0, spans).otherwise(let(merged, apart))


def with_spans(docs: DataFrame, table: list[float], text: str = "text", least: float = RATIO, mean: float = MEAN) -> DataFrame:
    """(doc_, text_, base_, added_): each row as one struct, its text, and two arrays of (start, order, end, value).

    The struct keeps the columns of ``docs`` apart from the names used here.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text_"))
    t = F.col("text_")
    log = F.from_json(F.lit(str(list(table))), "array<double>")  # one node of the plan, folded into a constant
    base = F.array_sort(F.concat(matches(t, ASSIGN, "assign", 6), matches(t, ACCESS, "access"), matches(t, HEX, "hex")))
    out = out.withColumn("base_", base).withColumn("tokens_", matches(t, TOKEN, "random"))
    scored = F.transform("tokens_", lambda x: F.struct(x.alias("x"), ratio(x.value, log).alias("llr")))
    good = F.filter(scored, lambda y: y.x.value.rlike("[A-Za-z]") & ~y.x.value.rlike(RULED) & (y.llr >= least) & (y.llr >= mean * F.length(y.x.value)))
    random = F.when(F.size("tokens_") > 0, F.transform(good, lambda y: y.x)).otherwise(F.col("tokens_"))
    return out.withColumn("random_", random).withColumn("added_", touched(F.col("random_"), F.col("base_"))).drop("tokens_", "random_")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.order], x.start.cast("string"), x.end.cast("string"))), ",")


def digest(docs: DataFrame, table: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    table = table or fit(samples(docs.sparkSession))
    rows = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), table).select("doc_.doc_id", "base_", "added_")
    n = lambda k: F.size(F.filter("base_", lambda x: x.order == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base_")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base_", "added_"))).alias("spans"))


def redact(docs: DataFrame, table: list[float] | None = None, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span; texts without a span stay as they are. ``n_chars`` follows the text."""
    table = table or fit(samples(docs.sparkSession))
    rows = with_spans(docs, table, text).withColumn("all_", F.array_sort(F.concat("base_", "added_")))
    t = F.col("text_")

    def piece(blocks, a, b):
        """Characters a to b of the text, out of the blocks they lie in."""
        first = F.floor(a / CUT).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(some, a - first * CUT + 1, b - a)).otherwise("")

    def cleaned(all_):
        # a span that begins before an earlier one ends makes no mark of its own; text goes on after the greatest end
        ends = running(F.transform(all_, lambda x: x.end), lambda a, b: F.greatest(a, b), F.lit(0))

        def joined(reach):
            starts = F.arrays_zip(all_.alias("x"), F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1)).alias("at"))
            marks = F.filter(starts, lambda e: e.x.start >= e["at"])
            cut = lambda blocks: F.concat(F.array_join(F.transform(marks, lambda e: F.concat(piece(blocks, e["at"], e.x.start), F.lit(mark))), ""), piece(blocks, F.element_at(reach, -1), F.length(t)))
            return let(F.regexp_extract_all(t, F.lit(f"(?s)(.{{1,{CUT}}})"), F.lit(1)), cut)

        return let(ends, joined)

    hit = F.size("all_") > 0
    clean = let(F.col("all_"), cleaned)
    rows = rows.withColumn("clean_", F.when(hit, clean))
    own = lambda c: F.col("doc_").getField(c)
    changed = {text: F.when(hit, F.col("clean_")).otherwise(own(text))}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(hit & own(n_chars).isNotNull(), F.length("clean_").cast(docs.schema[n_chars].dataType)).otherwise(own(n_chars))
    return rows.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])

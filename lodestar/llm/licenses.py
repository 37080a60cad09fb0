"""License scans in DataFrame functions only: TF-IDF cosine of lines to templates, then inheritance along paths.

Every run of adjacent lines of a whole text is a possible header: a line, a wrapped header of any
number of lines, a paragraph, the whole text. Comment marks are no words. A run's words are weighted
by the templates' inverse document frequencies and compared with each template by the cosine; the
best at ``threshold`` or more is the run's license. The whole text's license is the document's own,
else that of the best run. A line that is one of the fixed short forms scores 1. The templates are a
fixed small list, so their weights are literals of the plan. No run is too long to be scored: texts
and lines are passed over only where a bound shows that no run can reach the threshold, which changes
no result. The lines that are left (a header and a few lines around it in most texts) cost the square
of their number.

A document of which ``file_share`` of the words or more lie in lines of license runs is a license
file; it licenses its directory. A document without a license of its own inherits that of the
nearest ancestor directory that has one: its own directory, else the parent, up to the root.
Distinct directories are joined to their ancestors, then documents to their directory.

Defined results: null and empty texts have no line and can only inherit; a null path is the
root directory; of several license files in a directory the license with most files wins,
ties go to the smaller name; ties of score (to 10 decimals) go to the smaller license name; a line without
words has no score; repeated rows stay repeated. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} Public License as published by the Free Software Foundation, {2} of the License, or (at your option) any later version."
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: Short headers and the openings of license files (public texts).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_REST}"),
    ("GPL-3.0", GNU.format("program", "GNU General", "either version 3")),
    ("GPL-2.0", GNU.format("program", "GNU General", "either version 2")),
    ("LGPL-3.0", GNU.format("library", "GNU Lesser General", "either version 3")),
    ("LGPL-2.1", GNU.format("library", "GNU Lesser General", "either version 2.1")),
    ("AGPL-3.0", GNU.format("program", "GNU Affero General", "either version 3")),
    ("BSD-2-Clause", f"{BSD[0]} {BSD[1]}"),
    ("BSD-3-Clause", f"{BSD[0]} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD[1]}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved. Confidential and proprietary, no redistribution without written permission."),
]
WORD, THRESHOLD, FILE_SHARE = "[a-z0-9]+(?:\\.[0-9]+)*", 0.85, 0.5
#: Lines of a run and words of a text that is scored: no limit (the brute force of the tests reads both).
WINDOW, MAX_WORDS = sys.maxsize, sys.maxsize
#: Times that ranges of lines are narrowed before their runs are met; changes no result.
ROUNDS = 3
#: Names in short forms, which are met word by word: too few words for a cosine ("mit" alone has 0.9 to "MIT License").
ALIASES = {"MIT": ["mit"], "ISC": ["isc"], "Apache-2.0": ["apache", "apache 2.0", "apache license 2.0", "apache license version 2.0"], "GPL-3.0": ["gpl 3.0", "gplv3", "gnu gpl v3", "gnu general public license v3.0"], "GPL-2.0": ["gpl 2.0", "gplv2", "gnu gpl v2"], "LGPL-3.0": ["lgpl 3.0", "lgplv3"], "AGPL-3.0": ["agpl 3.0", "agplv3"], "BSD-3-Clause": ["bsd 3 clause"], "BSD-2-Clause": ["bsd 2 clause"], "MPL-2.0": ["mpl 2.0"], "CC0-1.0": ["cc0 1.0"], "CC-BY-4.0": ["cc by 4.0"]}
_FORMS = [f"{who}{verb} under {the}{{0}}{end}" for who in ("", "this project is ", "this software is ", "this code is ", "this file is ", "this work is ") for verb in ("licensed", "released", "distributed", "available") for the in ("the ", "") for end in (" license", "")]
SHORT = {form.format(a): name for name, own in ALIASES.items() for a in own for form in ("the {0} license", "{0} license", "the {0} license {0}", "license {0}", *_FORMS)} | {f"spdx license identifier {a}{end}": name for name, own in ALIASES.items() for a in own for end in ("", " only", " or later")}
LIKE_SHORT = "(?i)licens|(?:released|distributed|available)\\s+under"
#: Directories (some 100 bytes each) that are sent to every executor; more are joined by a shuffle.
BROADCAST_DIRS = 100_000


def weights(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequency of each template word, and each template as a unit vector."""
    bags = [(name, re.findall(WORD, text.lower())) for name, text in templates]
    n = len(bags)
    idf = {w: 1 + math.log((1 + n) / (1 + sum(w in b for _, b in bags))) for w in sorted({w for _, b in bags for w in b})}
    units = []
    for name, bag in bags:
        v = {w: bag.count(w) * idf[w] for w in sorted(set(bag))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        units.append((name, {w: x / norm for w, x in v.items()}))
    return idf, units


def needed(unit: dict[str, float], threshold: float) -> list[list[str]]:
    """Groups of a template's words of which a line holds at least one each if it reaches the threshold.

    By Cauchy-Schwarz the words of the template that a line lacks have squared weights of
    1 - threshold**2 together at most, so it has a word of any group that weighs more. The
    first group is made of long words, which are rare in other texts.
    """
    groups, left = [], dict(unit)
    while sum(x * x for x in left.values()) > 1 - threshold**2 + 1e-9:
        own, weight = [], 0.0
        for w in sorted(left, key=lambda w: (-len(w), w) if not groups else (-left[w], w)):
            own.append(w)
            weight += left[w] ** 2
            if weight > 1 - threshold**2 + 1e-9:
                break
        groups.append(own)
        for w in own:
            del left[w]
    return groups


def marks(units: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """A few words of which a text holds at least one if any unit of it reaches the threshold with any template.

    The words that a template has among them weigh more than a unit may lack of it. Chosen one by one, the
    word that settles most first; words of six letters or more, which are rarer, before others.
    """
    left = [1 - threshold**2 + 1e-9] * len(units)
    chosen: list[str] = []
    while max(left) >= 0:
        gain = lambda w: sum(min(x, u.get(w, 0.0) ** 2) if x >= 0 else 0.0 for x, (_, u) in zip(left, units))
        best = max(sorted({w for x, (_, u) in zip(left, units) if x >= 0 for w in u if w not in chosen}), key=lambda w: (len(w) >= 6, gain(w)))
        chosen.append(best)
        left = [x - u.get(best, 0.0) ** 2 for x, (_, u) in zip(left, units)]
    return chosen


def any_of(words: list[str]) -> str:
    """A pattern for any of these whole words, branching on their first characters."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:^|[^a-zA-Z0-9])(?i:" + "|".join(f"{a}(?:{'|'.join(ws)})" for a, ws in by.items()) + ")(?:[^a-zA-Z0-9]|$)"


def table(templates, threshold: float) -> Column:
    """Each template word's squared weight, its share in the dot product with each template, and whether it is of a first group; a constant of the plan."""
    idf, units = weights(templates)
    first = {w for _, u in units for w in needed(u, threshold)[0]}
    rows = {w: {"sq": x * x, "d": [x * u.get(w, 0.0) for _, u in units], "gate": w in first} for w, x in idf.items()}
    return F.from_json(F.lit(json.dumps(rows)), "map<string,struct<sq:double,d:array<double>,gate:boolean>>")


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def facts_of(bag: Column, rows: Column, n: int, unknown: float) -> Column:
    """Of some words: weights ``v`` of the distinct ones, their squared norm, dot products with each of ``n`` templates, how many words no template has, whether any has one, and whether one is of a first group."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    each = lambda s, at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("double").alias("n"), F.element_at(rows, F.get(s, p)).alias("r")))
    words = let(F.array_sort(bag), lambda s: F.when(F.size(s) > 0, let(starts(s), lambda at: each(s, at))).otherwise(F.slice(each(s, F.array(F.lit(0))), 1, 0)))
    dots = lambda known: F.when(F.size(known) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(known, F.lit(0.0), lambda s, e: s + e.n * F.get(e.r.d, i)))).otherwise(F.array_repeat(F.lit(0.0), n))
    weight = lambda e: e.n * F.sqrt(F.coalesce(e.r.sq, F.lit(unknown**2)))
    return let(words, lambda ws: F.struct(
        F.transform(ws, lambda e: F.struct(e.w.alias("w"), weight(e).alias("x"))).alias("v"),
        F.aggregate(ws, F.lit(0.0), lambda s, e: s + e.n * e.n * F.coalesce(e.r.sq, F.lit(unknown**2))).alias("sq"),
        let(F.filter(ws, lambda e: e.r.isNotNull()), dots).alias("d"),
        F.aggregate(F.filter(ws, lambda e: e.r.isNull()), F.lit(0.0), lambda s, e: s + e.n).alias("u"),
        F.exists(ws, lambda e: e.r.isNotNull()).alias("known"),
        F.exists(ws, lambda e: F.coalesce(e.r.gate, F.lit(False))).alias("gate"),
    ))


def best_of(d: Column, sq: Column, names: Column) -> Column:
    """The least (minus score, license) by dot products and squared norm (not 0); scores are rounded so that ties are ties."""
    score = lambda i: F.get(d, i) / F.sqrt(sq)
    same = lambda m: F.filter(names, lambda _, i: (score(i) >= m - 1e-10) & (F.round(score(i), 10) == F.round(m, 10)))
    return let(F.array_max(d) / F.sqrt(sq), lambda m: F.struct((-F.round(m, 10)).alias("low"), F.array_min(same(m)).alias("license")))


def part(rows: Column, r: Column) -> Column:
    return F.slice(rows, r.a + 1, r.b - r.a + 1)


def pair(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def narrowed(ranges: Column, facts: Column, rows: Column, threshold: float, unknown: float) -> Column:
    """The parts of ranges of lines in which a run that reaches the threshold can lie.

    A run's words of no template weigh at least their number times ``unknown`` by the root of how many distinct
    ones the range has, and the others at least the dot product with any template. So in a run that reaches the
    threshold the lines' best dot products, times ``slack``, outweigh that. Both are sums over lines: a line stays
    if the best sum of a run through it, from both sides, is not negative.
    """
    slack = math.sqrt(1 - threshold**2) / threshold
    grown = lambda z: F.slice(F.aggregate(z, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(x + F.greatest(F.element_at(s, -1), F.lit(0.0))))), F.lit(2), F.size(z))
    through = lambda z: F.zip_with(F.zip_with(z, grown(z), lambda x, f: f - x), F.reverse(grown(F.reverse(z))), lambda x, g: x + g >= -1e-9)
    edge = lambda ok, k: F.filter(F.sequence(F.lit(0), F.size(ok) - 1), lambda i: F.get(ok, i) & ~F.coalesce(F.get(ok, i + k), F.lit(False)))

    def kept(r):
        distinct = F.greatest(F.size(F.array_distinct(F.flatten(F.transform(part(facts, r), lambda x: F.transform(F.filter(x.v, lambda e: F.element_at(rows, e.w).isNull()), lambda e: e.w))))), F.lit(1)).cast("double")
        z = let(distinct, lambda m: F.transform(part(facts, r), lambda x: slack * F.array_max(x.d) - unknown * x.u / F.sqrt(m)))
        return let(let(z, through), lambda ok: F.zip_with(edge(ok, -1), edge(ok, 1), lambda a, b: pair(r.a + a, r.a + b)))

    return F.filter(F.flatten(F.transform(ranges, kept)), lambda r: F.exists(part(facts, r), lambda x: x.gate))


KIND = "struct<best:struct<low:double,license:string>,a:int,b:int>"


def best_runs(r: Column, facts: Column, names: Column, n: int, threshold: float) -> Column:
    """Every run of lines of a range is scored: for each first line with a run at the threshold, the last line of the longest and the best (score, license) so far.

    First lines are met from the end. ``c`` holds for each line its dot product with the lines from the first to the
    one before it, so that a run's squared norm grows from that of the run without its last line.
    """
    dot = lambda v, m: F.aggregate(v, F.lit(0.0), lambda s, e: s + e.x * F.coalesce(F.element_at(m, e.w), F.lit(0.0)))

    def step(own, c):
        def take(t, j):
            line = F.get(own, j)
            grown = F.struct((t.sq + line.sq + 2 * F.get(c, j)).alias("sq"), F.when(line.known, F.zip_with(t.d, line.d, lambda x, y: x + y)).otherwise(t.d).alias("d"))
            score = lambda g: F.when(g.sq > 0, F.array_max(g.d) / F.sqrt(g.sq)).otherwise(0.0)
            reached = lambda x: x >= threshold - 5e-11
            better = lambda x: reached(x) & (t.best.isNull() | (x >= -t.best.low - 1e-10))
            after = lambda g, x: F.struct(g.sq.alias("sq"), g.d.alias("d"), F.when(better(x), F.least(t.best, best_of(g.d, g.sq, names))).otherwise(t.best).alias("best"), F.when(reached(x), j).otherwise(t.b).alias("b"))
            return let(grown, lambda g: let(score(g), lambda x: after(g, x)))

        return take

    def first(own, size):
        def take(s, k):
            a = size - 1 - k
            vector = F.map_from_entries(F.get(own, a).v)
            dots = let(vector, lambda m: F.transform(s.c, lambda x, j: F.when(j > a, x + dot(F.get(own, j).v, m)).otherwise(x)))
            zero = F.struct(F.lit(0.0).alias("sq"), F.array_repeat(F.lit(0.0), n).alias("d"), F.get(s.found, F.size(s.found) - 1).best.alias("best"), F.lit(-1).alias("b"))
            runs = lambda c: F.aggregate(F.sequence(a, size - 1), zero, step(own, c))
            more = lambda t: F.when(t.b >= 0, F.array(F.struct(t.best.alias("best"), (r.a + a).alias("a"), (r.a + t.b).alias("b")).cast(KIND))).otherwise(F.expr(f"cast(array() as array<{KIND}>)"))
            return let(dots, lambda c: let(runs(c), lambda t: F.struct(c.alias("c"), F.concat(s.found, more(t)).alias("found"))))

        return take

    start = lambda own: F.struct(F.transform(own, lambda x: F.lit(0.0)).alias("c"), F.expr(f"cast(array() as array<{KIND}>)").alias("found"))
    return let(part(facts, r), lambda own: F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), start(own), first(own, F.size(own)), lambda s: s.found))


def own_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``docs`` with ``own`` (license or null), ``score`` and ``is_file`` behind."""
    _, units = weights(templates)
    n, unknown = len(units), 1 + math.log(1 + len(templates))
    groups = [needed(unit, threshold) for _, unit in units]
    gate = any_of([w for g in groups for w in g[0]])
    whole = "^(?:" + "|".join(sorted({"".join(f"(?=.*{any_of(own)})" for own in g) for g in groups})) + ")"
    words = lambda c: F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+"))
    rows, names = table(templates, threshold), F.array(*[F.lit(name) for name, _ in units])
    t, lines, bags, facts = F.col(text), F.col("lines_"), F.col("bags_"), F.col("facts_")
    none = F.expr(f"cast(array() as array<{KIND}>)")
    # a plain search for a few words comes before any pattern
    low = F.lower(t)
    seen = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in [*marks(units, threshold), "licens", "under"]))
    possible = t.rlike(gate) & t.rlike("(?s)" + whole)
    out = docs.withColumn("lines_", F.when(seen & (t.rlike(LIKE_SHORT) | possible), F.split(t, "\n")))
    every, last = F.sequence(F.lit(0), F.size(lines) - 1), F.size(lines) - 1
    bag = lambda x: F.regexp_extract_all(F.lower(x), F.lit(f"({WORD})"), F.lit(1))
    forms = F.from_json(F.lit(json.dumps(SHORT)), "map<string,string>")
    named = lambda i: F.element_at(forms, F.array_join(bag(F.get(lines, i)), " "))
    short = F.filter(every, lambda i: F.get(lines, i).rlike(LIKE_SHORT) & named(i).isNotNull())
    short = F.transform(short, lambda i: F.struct(F.struct(F.lit(-1.0).alias("low"), named(i).alias("license")).alias("best"), i.cast("int").alias("a"), i.cast("int").alias("b")).cast(KIND))
    # only texts in which some run can reach the threshold have words and facts
    out = out.withColumn("short_", F.coalesce(short, none)).withColumn("bags_", F.when(lines.isNotNull() & possible, F.transform(lines, bag)))
    out = out.withColumn("all_", let(facts_of(F.flatten(bags), rows, n, unknown), lambda f: F.when(f.sq > 0, best_of(f.d, f.sq, names))))
    # the whole text first: if it has a license, that decides, and it covers all lines
    entire = F.when(F.col("all_.low") <= -threshold, F.array(F.struct(F.col("all_").alias("best"), F.lit(0).alias("a"), last.alias("b")).cast(KIND)))
    out = out.withColumn("whole_", F.concat(F.coalesce(entire, none), F.when(last == 0, F.col("short_")).otherwise(none)))
    out = out.withColumn("facts_", F.when((F.size("whole_") == 0) & bags.isNotNull(), F.transform(bags, lambda x: facts_of(x, rows, n, unknown))))
    out = out.withColumn("ranges_", F.when(facts.isNotNull(), F.array(pair(F.lit(0), last))))
    for _ in range(ROUNDS):
        out = out.withColumn("ranges_", narrowed(F.col("ranges_"), facts, rows, threshold, unknown))
    runs = F.coalesce(F.flatten(F.transform("ranges_", lambda r: best_runs(r, facts, names, n, threshold))), none)
    out = out.withColumn("found_", F.when(lines.isNotNull(), F.when(F.size("whole_") > 0, F.col("whole_")).otherwise(F.concat("short_", runs))))
    covered = F.filter(every, lambda i: F.exists("found_", lambda x: (x.a <= i) & (i <= x.b)))
    share = F.aggregate(covered, F.lit(0), lambda n, i: n + words(F.get(lines, i))) >= file_share * F.greatest(words(t), F.lit(1))
    out = out.withColumn("best_", F.array_min(F.transform("found_", lambda x: x.best)))
    return out.select(*docs.columns, F.col("best_.license").alias("own"), (-F.col("best_.low")).alias("score"), ((F.size("found_") > 0) & F.coalesce(share, F.lit(False))).alias("is_file"))


def directory(path: Column) -> Column:
    """What comes before the last slash of a path."""
    return F.coalesce(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def inherited(rows: DataFrame, path: str = "path") -> DataFrame:
    """Written rows with own and is_file -> the same with ``license`` and ``inherited_from`` (a directory, or null) behind."""
    rows = rows.withColumn("dir_", directory(F.col(path)))
    votes = rows.where("is_file").groupBy("dir_", "own").count()
    licensed = votes.groupBy("dir_").agg(F.min(F.struct((-F.col("count")).alias("c"), "own")).alias("m")).select(F.col("dir_").alias("up_"), F.col("m.own").alias("from_license_"))
    dirs = rows.select("dir_").distinct()
    depth = F.size(F.split("dir_", "/"))
    ups = dirs.select("dir_", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(F.split("dir_", "/"), 1, k), "/"))).alias("up_"))
    near = ups.join(licensed, "up_").groupBy("dir_").agg(F.max(F.struct(F.length("up_").alias("n"), "up_", "from_license_")).alias("m"))
    near = written(near.select("dir_", F.col("m.up_").alias("up_"), F.col("m.from_license_").alias("from_license_")), "licensed-directories")
    side = F.broadcast(near) if near.count() <= BROADCAST_DIRS else near
    keep = [c for c in rows.columns if c != "dir_"]
    return rows.join(side, "dir_", "left").select(*keep, F.coalesce("own", "from_license_").alias("license"), F.when(F.col("own").isNull(), F.col("up_")).alias("inherited_from"))


def scan(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, path, own, score, is_file, license, inherited_from) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), path.alias("path"), F.col(text).cast("string").alias("text"))
    return inherited(written(own_licenses(rows, **options).drop("text"), "licenses"))

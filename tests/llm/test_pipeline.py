"""Each stage of the corpus pipeline against a brute-force version on the stage's own input."""

import re

import duckdb
import pytest

import brute

SF = "/root/testdata/sf0.001"


def cleaned(text, items):
    """The text without hit words, or None where more than half of its words are hit."""
    spots = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    words = [brute.lower(text[a:b]) for a, b in spots]
    hit = set()
    for t in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.lower(t))
        for k in [w[a : a + 8] for a in range(len(w) - 7)] if len(w) >= 8 else [w] if w else []:
            for a in range(len(words) - len(k) + 1):
                if words[a : a + len(k)] == k:
                    hit.update(range(a, a + len(k)))
    if len(hit) * 2 > len(words):
        return None
    out, at, i = "", 0, 0
    while i < len(words):
        if i in hit:
            end = i
            while end + 1 in hit:
                end += 1
            out += text[at : spots[i][0]].rstrip(" \t\r")
            at = spots[end][1]
            i = end
        i += 1
    return out + text[at:]


def redacted(text, table, letters, token, ratio, mean):
    base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in brute.secrets(text)[4])]
    k = len(letters) + 1
    at = lambda c: letters.find(c) % k
    spans = list(base)
    for m in re.finditer(token, text):
        llr = sum(table[at(a) * k + at(b)] for a, b in zip(m[0], m[0][1:]))
        if re.search("[A-Za-z]", m[0]) and llr >= ratio and llr >= mean * len(m[0]) and all(m.end() <= a or b <= m.start() for a, b in base):
            spans.append(m.span())
    out, done = "", 0
    for a, b in sorted(spans):
        if a >= done:
            out += text[done:a] + "[SECRET]"
        done = max(done, b)
    return out + text[done:] if spans else text


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [("input", docs.collect())]
    for name, f in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        seen.append((name, docs.collect()))
    return dict(seen)


def test_quality_rules(stages):
    from lodestar.llm import rules

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {x[0] for x in db.sql(f"select doc_id from ({rules.sql()}) where kept").fetchall()}
    assert {r.doc_id for r in stages["quality_rules"]} == want
    assert set(stages["quality_rules"]) <= set(stages["input"])


def test_near_duplicates(stages):
    before = stages["quality_rules"]
    groups = brute.components([(r.doc_id, r.text) for r in before])
    assert sorted(stages["near_duplicates"]) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_decontamination(stages):
    items = [x[0] for x in duckdb.sql(f"select text from '{SF}/benchmark.parquet' where text is not null and item_id is not null").fetchall()]
    want = {r.doc_id: t for r in stages["near_duplicates"] if (t := cleaned(r.text, items)) is not None}
    assert {r.doc_id: r.text for r in stages["decontamination"]} == want
    assert all(r.n_chars == len(r.text) for r in stages["decontamination"])


def test_secret_scan(spark, stages):
    from lodestar.llm import secrets

    table = secrets.fit(secrets.samples(spark))
    want = {r.doc_id: redacted(r.text, table, secrets.LETTERS, secrets.TOKEN, secrets.RATIO, secrets.MEAN) for r in stages["decontamination"]}
    assert {r.doc_id: r.text for r in stages["secret_scan"]} == want


def test_packing(stages):
    ids = dict(brute.tokens([(r.doc_id, r.text) for r in stages["secret_scan"]], "word_bpe_49k.json", 1))
    pieces, sequences = {}, {}
    for r in stages["packing"]:
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048

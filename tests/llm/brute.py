"""Brute-force versions of the text operators, written apart from them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for x in g:
        h = xxhash.xxh64(x.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(g))


def components(rows):
    """{doc_id: (hex, component)} for [(doc_id, text)] with distinct ids."""
    fps = {i: fingerprint(t) for i, t in rows}
    uniq = np.array(sorted(set(fps.values())), dtype=np.uint64)
    root = list(range(len(uniq)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(uniq)):
        for j in np.flatnonzero(np.bitwise_count(uniq[i + 1 :] ^ uniq[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    of = {int(u): find(k) for k, u in enumerate(uniq)}
    low = defaultdict(lambda: 1 << 62)
    for i, f in fps.items():
        low[of[f]] = min(low[of[f]], i)
    return {i: (f"{f:016x}", low[of[f]]) for i, f in fps.items()}


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)} by looking for every window at every word."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in [tuple(w[a : a + 8]) for a in range(len(w) - 7)] if len(w) >= 8 else [tuple(w)] if w else []:
            windows[k].add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    hit.update(range(a, a + n))
                    found |= own
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def secrets(text):
    text = text or ""
    found = []
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (kind, p, ok) in enumerate([("assign", a, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]):
        found += [(m.start(), k, kind, m.end()) for m in p.finditer(text) if ok(m)]
    found.sort()
    n = Counter(x[2] for x in found)
    text_ = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(text_.encode()).hexdigest(), [f"{kind}:{s}:{e}" for s, _, kind, e in found]


def tokens(rows, name, end):
    """[(doc_id, ids)] by the tokenizers library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, [*e.ids, end]) for (i, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False))]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def random_spans(text, table, letters, token, ratio, mean, ruled):
    """The model's spans beside the base ones, each token scored and compared with every base span."""
    text = text or ""
    base = [(int(a), int(b)) for _, a, b in (x.split(":") for x in secrets(text)[4])]
    k = len(letters) + 1
    at = lambda c: letters.find(c) % k
    out = []
    for m in re.finditer(token, text):
        llr = sum(table[at(a) * k + at(b)] for a, b in zip(m[0], m[0][1:]))
        if re.search("[A-Za-z]", m[0]) and not re.search(ruled, m[0]) and llr >= ratio and llr >= mean * len(m[0]) and all(m.end() <= a or b <= m.start() for a, b in base):
            out.append(f"random:{m.start()}:{m.end()}")
    return out


def license_of(text, templates, short, threshold, share, window, max_words):
    """(own, score, is_file) of one text by scoring every window, paragraph and the whole against every template."""
    import math

    words = lambda s: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", s.lower())
    n = len(templates)
    bags = [Counter(words(t)) for _, t in templates]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: 1 + math.log((1 + n) / (1 + df[w]))
    vec = lambda bag: {w: c * idf(w) for w, c in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vecs = [(name, vec(b)) for (name, _), b in zip(templates, bags)]
    if text is None:
        return None, None, False
    lines = text.split("\n")
    size = lambda a, b: len(WORD.findall(" ".join(lines[a : b + 1])))
    blank = [not re.search("[A-Za-z0-9]", x) for x in lines]
    units = {(a, b) for a in range(len(lines)) for b in range(a, min(len(lines), a + window))}
    for i in range(len(lines)):
        if not blank[i]:
            a, b = i, i
            while a > 0 and not blank[a - 1]:
                a -= 1
            while b + 1 < len(lines) and not blank[b + 1]:
                b += 1
            if size(a, b) <= max_words:
                units.add((a, b))
    if size(0, len(lines) - 1) <= max_words:
        units.add((0, len(lines) - 1))
    known = set(df)
    found = []
    for a, b in units:
        bag = Counter(words(" ".join(lines[a : b + 1])))
        if not known & set(bag):
            continue
        v = vec(bag)
        best = min((-sum(x * t.get(w, 0.0) for w, x in v.items()) / (norm(v) * norm(t)), name) for name, t in vecs)
        if best[0] <= -threshold:
            found.append((best, a, b))
    for i, x in enumerate(lines):
        name = short.get(" ".join(words(x)))
        if name and re.search(r"(?i)licens|(?:released|distributed|available)\s+under", x):
            found.append(((-1.0, name), i, i))
    if not found:
        return None, None, False
    whole = [x for x, a, b in found if (a, b) == (0, len(lines) - 1)]
    best = min(whole or [x for x, _, _ in found])
    covered = {i for _, a, b in found for i in range(a, b + 1)}
    held = sum(len(WORD.findall(lines[i])) for i in covered)
    return best[1], -best[0], held >= share * max(1, len(WORD.findall(text)))

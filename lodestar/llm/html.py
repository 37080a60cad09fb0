"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Scripts, styles, comments of the markup,
and whatever lies in menus, page headers, footers, sidebars, notices, adverts, forms and
reader comments (by tag, role, class or id) never become blocks. Where a page marks its article,
only blocks in it go on.

First pass (:func:`decide`): a block made of links is bad, and so is one that states a copyright.
A long block is good if enough of its words are stop words. All others are undecided: short ones,
and long ones almost without stop words (tables, lists of names).

Second pass (:func:`settle`): each undecided block takes the label of its nearest decided
neighbours: that of both if they agree; else the nearer one's; at equal distances headings and
blocks with stop words are good. If no block of a page is good, undecided blocks are kept: nothing
speaks against them (so a page of short blocks only keeps these).

Defined results: null, empty and text-free pages give an empty text; unclosed tags end with
the page; nothing is cut off; repeated rows stay repeated. Extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, text_list

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = set("nav footer aside form menu dialog button select label fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|cookies?|consent|gdpr|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|recommendations|promo|promotion|sponsor|sponsored|newsletter|subscribe|signup|popup|modal|notice|notices|notification|alert|toolbar|pagination|pager|widget|login|search|skip|copyright|disclaimer|legal|masthead|topbar|outbrain|taboola)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|site-?head)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
STOP = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in into is it its not of on or our she so that the their them there they this to was we were what when which who will with you your "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war wie wird zu zum zur "
    "al como con cuando del desde donde el ella ellos era es esta este esto fue ha hasta hay las lo los más me mi muy no nos o para pero por porque quien se sin sobre su sus también te todo tu una y ya yo".split()
)
#: Characters of a long block; the share in links that makes a block bad; the share of stop words that makes a long one good.
LONG, MAX_LINKS, MIN_STOP = 70, 0.5, 0.08
LETTERS = re.compile(r"[^\W\d_]+")
LEGAL = re.compile("©|\\(c\\)|\\bcopyright\\b|\\ball rights reserved\\b|\\balle rechte vorbehalten\\b|\\btous droits réservés\\b|\\btodos los derechos reservados\\b", re.I)
#: Blocks that stay open to the end of an enclosing one may be closed by these.
CLOSES = {"li": {"li"}, "p": BLOCK - {"button", "label", "option", "legend"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Block:
    __slots__ = ("article", "heading", "links", "parts")

    def __init__(self, article: bool, heading: bool):
        self.article, self.heading, self.links, self.parts = article, heading, 0, []


def blocks(html: str) -> tuple[list[tuple[str, float, bool, bool]], bool]:
    """(text, share in links, in an article, heading) of each block that is not dropped; whether the page marks an article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, drops, article
    dropping = inside = linked = 0
    marked = False
    block: Block | None = None
    at, end = 0, len(html)

    def text(data: str) -> None:
        nonlocal block
        if dropping or not data:
            return
        if block is None:
            if data.isspace():
                return
            block = Block(inside > 0, any(n[0] in "hH" and n[1:].isdigit() for n, _, _ in stack[-4:]))
            out.append(block)
        block.parts.append(data)
        if linked:
            block.links += len(data)

    def close(k: int) -> None:
        nonlocal dropping, inside, linked, block
        for name, drops, article in stack[k:]:
            dropping -= drops
            inside -= article
            linked -= name == "a"
            if name in BLOCK:
                block = None
        del stack[k:]

    for m in iter(lambda: TOKEN.search(html, at), None):
        text(html[at : m.start()])
        at = m.end()
        if m[2]:
            closing, name, rest = m[1], m[2].lower(), m[3]
        elif m[5]:
            closing, name, rest = m[4], m[5].lower(), m[6]
        else:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "table") and name in ("p", "li", "div", "span", "b", "i", "a", "em", "strong"):
                    break  # a stray end tag does not close the article
            if name in BLOCK:
                block = None
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not rest.rstrip().endswith("/"):
                at = found.end() if found else end
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            block = None
        if name in VOID or rest.rstrip().endswith("/") and name not in BLOCK:
            continue
        while stack and name in CLOSES.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if name in BLOCK:  # a paragraph ends where a block begins, whatever inline tags it left open
            for k in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                if stack[k][0] in CLOSES and name in CLOSES[stack[k][0]]:
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        drops = name in DROPPED or (name == "header" and not inside)
        article = name in ("article", "main")
        if rest and not drops:
            a = {x.lower(): p or q or r for x, p, q, r in ATTRIBUTE.findall(rest)}
            own = f"{a.get('class', '')} {a.get('id', '')}"
            if a.get("role", "").lower() in ("main", "article"):
                article = True
            drops = "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", ""))) or a.get("role", "").lower() in ROLES
            if own != " " and not article and name not in ("html", "body", "p", "span", "a", "b", "i", "em", "strong", "h1", "h2", "h3"):
                drops = drops or bool(HINT.search(own)) or (not inside and bool(HEADER.search(own)))
            elif own != " " and name in ("article", "p", "span", "a"):
                drops = drops or bool(re.search(r"(?:^|[\s_-])(?:comments?|ads?|advert|cookies?|share|sponsored)(?:$|[\s_-])", own, re.I))
        if drops:
            block = None
        marked = marked or (article and not dropping and not drops)
        stack.append((name, drops, article and not drops))
        dropping += drops
        inside += article and not drops
        linked += name == "a"
    text(html[at:])
    made = []
    for b in out:
        raw = "".join(b.parts)
        clean = " ".join(unescape(raw).split())
        if clean:
            made.append((clean, b.links / max(1, len(raw)), b.article, b.heading))
    return made, marked


def decide(clean: str, links: float, article: bool, heading: bool) -> bool | None:
    """First pass: good, bad or undecided."""
    if links > MAX_LINKS and not (article and heading):
        return False
    words = LETTERS.findall(clean.lower())
    stops = sum(w in STOP for w in words) / max(1, len(words))
    if not article and len(clean) < 4 * LONG and LEGAL.search(clean):
        return False
    return True if len(clean) >= LONG and stops >= MIN_STOP else None


def settle(labels: list[bool | None], found: list[tuple[str, float, bool, bool]]) -> list[bool]:
    """Second pass: undecided blocks take the label of their nearest decided neighbours."""
    n = len(labels)
    if True not in labels:
        return [x is None for x in labels]
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] is not None else after[i + 1]
    out = []
    for i, own in enumerate(labels):
        if own is None:
            p, q = before[i], after[i]
            a = labels[p if p >= 0 else q]
            b = labels[q if q < n else p]
            if a == b:
                own = a
            elif i - p != q - i:
                own = a if i - p < q - i else b
            else:
                own = found[i][3] or any(w in STOP for w in LETTERS.findall(found[i][0].lower()))
        out.append(own)
    return out


def extract(html: str) -> str:
    """The main text: blocks of one line each, joined by two newlines."""
    found, marked = blocks(html)
    if marked:
        found = [x for x in found if x[2]]
    good = settle([decide(*x) for x in found], found)
    return "\n\n".join(x[0] for x, keep in zip(found, good) if keep)


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(keep..., text, n_chars) of each page."""
    pages = pages.select(*keep, F.col(html).cast("string").alias("html_"))
    out = pages.drop("html_").schema.add("text", "string")

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in text_list(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    return map_text(pages, run, out).withColumn("n_chars", F.length("text").cast("long"))

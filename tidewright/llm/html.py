"""Main text of web pages: flat blocks, their neighbours' words and links, and a decision tree."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[a-zA-Z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[a-zA-Z/!?][^<>]*(?:>|$)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_HINT = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile("[^a-z0-9]+")

# Element names of the HTML standard, by what they mean here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg math canvas select option datalist button textarea audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AROUND = frozenset("nav header footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
HINTS = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead banner ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert newsletter subscribe signup popup modal overlay social share sharing related recommended breadcrumb breadcrumbs pagination pager comment comments reply replies discussion disqus respond widget toolbar search login complementary contentinfo".split()
)
FIRM = frozenset("comment comments reply replies discussion disqus respond related recommended".split())
NEUTRAL = frozenset("box block section list wrap wrapper container inner outer area bar panel link links item items slot unit top bottom left right primary secondary main site page global post posts entry article articles story form text message content group row col column module region button buttons icon icons small large mobile desktop 1 2 3 4".split())
CLOSES_P = BLOCKS - {"body", "html"}


class Block:
    __slots__ = ("text", "words", "linked", "main", "around", "heading")

    def __init__(self, main: bool, around: bool, heading: bool):
        self.text, self.words, self.linked = [], 0, 0
        self.main, self.around, self.heading = main, around, heading


def _hinted(tag: str) -> tuple[bool, bool]:
    """Whether an element is named like something around the text, and like readers' words.

    A class counts if one of its parts is a hint and the others just say where or what kind of
    box it is: `comments-list` does, `share-price` and `with-sidebar` do not.
    """
    hinted = firm = False
    for m in _HINT.finditer(tag):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = {x for x in _PARTS.split(name) if x}
            hints = parts & HINTS
            if hints and parts <= HINTS | NEUTRAL:
                hinted, firm = True, firm or not FIRM.isdisjoint(hints)
    return hinted, firm


def blocks(page: str) -> list[Block]:
    """A page's text blocks in order. Broken markup is read as browsers do in the common cases:
    a block start closes an open paragraph, an end tag closes what is open inside its element,
    an unknown end tag is ignored; what has no end lasts to the page's end. A hint in an element's
    name counts for what is inside it, but never from above the outermost article or main."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, int, int]] = []  # name; unseen, around, main; hints in force before it
    unseen = around = main = links = soft = 0
    block: Block | None = None
    skip_to = None
    pos = 0

    def pop(to: int) -> None:
        nonlocal unseen, around, main, links, soft
        while len(stack) > to:
            name, u, a, m, soft = stack.pop()
            unseen, around, main = unseen - u, around - a, main - m
            links -= name == "a"

    while pos < len(page):
        if skip_to:
            found = re.compile(f"</{skip_to}\\b", re.I).search(page, pos)
            if not found:
                break
            pos, skip_to = found.start(), None
        m = _TOKEN.match(page, pos)
        token = m[0]
        pos = m.end()
        if token[0] != "<" or len(token) == 1:
            if unseen:
                continue
            if block is None:
                if token.isspace():
                    continue
                name = next((n for n, *_ in reversed(stack) if n in BLOCKS), "")
                block = Block(main > 0, around + soft > 0, len(name) == 2 and name[0] == "h" and name[1].isdigit())
                out.append(block)
            block.text.append(token)
            if links:
                block.linked += len(token.split())
            continue
        if token.startswith(("<!", "<?")):
            continue
        found = _NAME.match(token)
        if not found:
            continue
        name = found[1].lower()
        if token[1] == "/":
            if name in BLOCKS:
                block = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        if name in BLOCKS:
            block = None
        if name == "br" and block is not None and not unseen:
            block.text.append(" ")
        if name in VOID:
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in ("li", "tr", "td", "th", "dd", "dt", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "dl", "tr" if name in ("td", "th") else "table", "select"):
                    break
        if name == "body":
            pop(0)
        if token.endswith("/>") and name not in BLOCKS and name != "a":
            continue
        whole = name in ("html", "body") or (name in MAIN and not main)
        hinted, firm = (False, False) if whole else _hinted(token)
        state = (name, int(name in UNSEEN), int(name in AROUND or firm), int(name in MAIN), soft)
        stack.append(state)
        # What a wrapper outside is called does not touch the article in it.
        soft = 0 if name in MAIN and not main else soft + (hinted and not firm)
        unseen, around, main = unseen + state[1], around + state[2], main + state[3]
        links += name == "a"
        if name in RAW:
            skip_to = name
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.text)).split())
        if b.text:
            b.words = b.text.count(" ") + 1
            kept.append(b)
    return kept


FEATURES = ("main", "around", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")


def features(page: list[Block]) -> np.ndarray:
    """One row a block: where it stands, its words and link density, and those of its neighbours."""
    words = np.array([0, *[b.words for b in page], 0], float)
    links = np.array([0, *[min(b.linked / max(b.words, 1), 1.0) for b in page], 0], float)
    place = np.array([(b.main, b.around, b.heading) for b in page], float).reshape(-1, 3)
    return np.column_stack((place, words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]))


# The labelled table. A row is a block of a typical page: inside article or main,
# inside an element around the text, heading, words, link density, then words and link density
# of the block before and after; last 1 for main text.
LABELLED = np.array([
    (0, 1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 1, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 1, 0, 3, 1.0, 2, 1.0, 8, 0.0, 0), (0, 1, 0, 8, 0.0, 1, 1.0, 12, 0.0, 0),
    (0, 1, 0, 40, 0.1, 30, 0.0, 9, 0.0, 0), (0, 1, 0, 60, 0.0, 80, 0.0, 50, 0.0, 0), (0, 1, 1, 2, 0.0, 90, 0.0, 25, 0.0, 0), (0, 1, 0, 9, 0.0, 70, 0.0, 0, 0.0, 0),
    (0, 1, 1, 5, 0.0, 1, 1.0, 6, 0.0, 0), (0, 1, 0, 25, 0.4, 60, 0.0, 4, 1.0, 0), (0, 1, 0, 120, 0.0, 100, 0.0, 3, 0.0, 0), (0, 1, 0, 14, 0.0, 14, 0.0, 14, 0.0, 0),
    (1, 0, 1, 12, 0.0, 8, 0.0, 30, 0.0, 1), (1, 0, 1, 1, 0.0, 80, 0.0, 60, 0.0, 1), (1, 0, 0, 1, 0.0, 50, 0.0, 70, 0.0, 1), (1, 0, 0, 2, 0.0, 12, 0.0, 1, 0.0, 1),
    (1, 0, 0, 30, 0.0, 12, 0.0, 90, 0.0, 1), (1, 0, 0, 120, 0.0, 60, 0.0, 80, 0.0, 1), (1, 0, 0, 600, 0.0, 40, 0.0, 9, 0.0, 1), (1, 0, 0, 45, 0.2, 70, 0.0, 20, 0.1, 1),
    (1, 0, 0, 6, 0.5, 40, 0.0, 55, 0.0, 1), (1, 0, 0, 4, 0.0, 1, 1.0, 30, 0.0, 1), (1, 0, 0, 5, 0.0, 60, 0.0, 9, 0.0, 1), (1, 0, 0, 8, 1.0, 60, 0.0, 70, 0.0, 1),
    (1, 0, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1), (1, 0, 0, 3, 0.0, 0, 0.0, 0, 0.0, 1), (1, 0, 0, 2, 1.0, 1, 1.0, 1, 1.0, 1), (1, 0, 0, 4, 0.0, 2, 1.0, 2, 1.0, 1),
    (1, 0, 1, 2, 0.0, 1, 1.0, 1, 1.0, 1), (1, 0, 0, 5, 0.0, 1, 0.0, 0, 0.0, 1), (1, 0, 0, 1, 1.0, 0, 0.0, 2, 1.0, 1), (1, 0, 0, 1, 0.0, 3, 0.0, 3, 0.0, 1),
    (1, 1, 0, 20, 0.0, 80, 0.0, 15, 0.0, 0), (1, 1, 0, 3, 0.0, 70, 0.0, 22, 0.0, 0), (1, 1, 0, 90, 0.0, 100, 0.0, 60, 0.0, 0), (1, 1, 1, 1, 0.0, 90, 0.0, 12, 0.0, 0),
    (1, 1, 0, 5, 1.0, 60, 0.0, 4, 1.0, 0), (1, 1, 0, 12, 0.0, 5, 0.0, 80, 0.0, 0),
    (0, 0, 0, 60, 0.0, 12, 0.0, 80, 0.0, 1), (0, 0, 0, 150, 0.0, 60, 0.0, 40, 0.0, 1), (0, 0, 0, 40, 0.1, 70, 0.0, 60, 0.0, 1), (0, 0, 1, 9, 0.0, 2, 1.0, 60, 0.0, 1),
    (0, 0, 1, 3, 0.0, 80, 0.0, 70, 0.0, 1), (0, 0, 0, 20, 0.0, 60, 0.0, 90, 0.0, 1), (0, 0, 0, 18, 0.0, 90, 0.0, 18, 0.0, 1), (0, 0, 0, 6, 0.0, 50, 0.0, 60, 0.0, 1),
    (0, 0, 0, 50, 0.0, 80, 0.0, 1, 0.0, 1), (0, 0, 0, 45, 0.0, 60, 0.0, 0, 0.0, 1), (0, 0, 0, 25, 0.0, 30, 0.0, 1, 1.0, 1), (0, 0, 0, 90, 0.0, 1, 1.0, 3, 1.0, 1),
    (0, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 0, 2, 1.0, 0, 0.0, 2, 1.0, 0), (0, 0, 0, 12, 0.9, 60, 0.0, 10, 0.9, 0), (0, 0, 0, 30, 0.8, 12, 0.9, 4, 1.0, 0),
    (0, 0, 0, 4, 0.0, 1, 1.0, 3, 1.0, 0), (0, 0, 0, 5, 0.0, 4, 0.0, 2, 1.0, 0), (0, 0, 0, 8, 0.0, 80, 0.0, 0, 0.0, 0), (0, 0, 0, 3, 0.0, 0, 0.0, 2, 1.0, 0),
    (0, 0, 1, 2, 0.0, 60, 0.0, 3, 1.0, 0), (0, 0, 1, 2, 0.0, 1, 1.0, 2, 1.0, 0),
    (1, 0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 1), (1, 0, 0, 2, 1.0, 0, 0.0, 2, 1.0, 1), (1, 0, 0, 12, 0.9, 60, 0.0, 10, 0.9, 1), (1, 0, 0, 30, 0.8, 12, 0.9, 4, 1.0, 1),
    (1, 0, 0, 4, 0.0, 1, 1.0, 3, 1.0, 1), (1, 0, 0, 5, 0.0, 4, 0.0, 2, 1.0, 1), (1, 0, 0, 8, 0.0, 80, 0.0, 0, 0.0, 1), (1, 0, 0, 3, 0.0, 0, 0.0, 2, 1.0, 1),
    (1, 0, 1, 2, 0.0, 60, 0.0, 3, 1.0, 1), (1, 0, 1, 2, 0.0, 1, 1.0, 2, 1.0, 1), (1, 0, 0, 100, 0.0, 0, 0.0, 3, 0.0, 1), (1, 0, 0, 3, 0.0, 100, 0.0, 0, 0.0, 1),
])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A CART by Gini impurity: a leaf is a label, a node (feature, threshold, at most, above)."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return bool(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            cost = sum(len(p) * (1 - p.mean() ** 2 - (1 - p.mean()) ** 2) for p in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return bool(y.mean() >= 0.5)
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def main_text(page: str | None, tree) -> str:
    """The blocks that the tree takes for main text, joined by an empty line."""
    found = blocks(page) if page else []
    if not found:
        return ""
    rows = features(found).tolist()
    return "\n\n".join(b.text for b, row in zip(found, rows) if decide(tree, row))


def extract(pages: DataFrame, html: str = "html", labelled: np.ndarray = LABELLED) -> DataFrame:
    """Add `__tw_text`, the main text of each page.

    Null and empty pages, and pages without main text, give an empty text. Pages are read in
    whole; each is judged for itself, so repeated rows give the same; other columns stay (names
    that begin with `__tw_` are ours); an empty table gives no rows.
    """
    tree = grow(labelled[:, :-1], labelled[:, -1])

    def run(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("__tw_html").to_pylist()]
            names = [f for f in batch.schema.names if f != "__tw_html"]
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in names], pa.array(texts, pa.string())], names=[*names, "__tw_text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html]
    return pages.withColumn("__tw_html", F.col(html)).drop(html).transform(in_arrow, run, ", ".join([*fields, "__tw_text string"]))


def op10_html(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole table pages."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("__tw_text").alias("text"), F.length("__tw_text").cast("long").alias("n_chars"))

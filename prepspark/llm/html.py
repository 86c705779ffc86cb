"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of its
neighbours, and where it stands (article, page furniture, heading, a page of short blocks only). A small tree, trained on the labelled table below,
says which blocks belong to the article. Pages are independent: one narrow pass, bounded by one page.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prepspark.llm.common import load, map_text, query

# Fixed values of HTML: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe object svg textarea title select canvas audio video math".split()
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and class or id words of page furniture.
FURNITURE = frozenset("nav footer aside form head menu dialog button".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup login social share sharing related "
    "recommended recommendations comment comments commentlist disqus replies respond reply discussion widget widgets toolbar pagination "
    "pager copyright legal disclaimer search form hidden teaser outbrain taboola skip masthead topbar"
).split())
# Words that say whether a page has such furniture, not that an element is it.
STATES = frozenset("has no with without".split())
READERS = frozenset("comment comments commentlist disqus replies respond reply discussion".split())
TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?<=/)>|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

FEATURES = ("words", "links", "prev_words", "prev_links", "next_words", "next_links", "furniture", "article", "heading", "short")
# Words up to which a block is no running text; a page without an article element and without running text is short.
SCRAP = 10
# Labelled blocks: the features in the order above but for the last (0 here), then 1 for main text.
LABELLED: list[tuple[float, ...]] = [
    # articles: headings, short and long paragraphs, list items, paragraphs with links
    (9, 0, 0, 0, 12, 0, 0, 1, 1, 1), (12, 0, 5, 0, 60, 0, 0, 1, 1, 1), (1, 0, 40, 0, 55, 0, 0, 1, 0, 1), (2, 0, 3, 0, 3, 0, 0, 1, 0, 1),
    (60, 0, 55, 0, 48, 0, 0, 1, 0, 1), (120, 0.05, 40, 0, 30, 0.1, 0, 1, 0, 1), (35, 0.2, 20, 0, 8, 0, 0, 1, 0, 1), (6, 0.4, 60, 0, 70, 0, 0, 1, 0, 1),
    (3, 1, 60, 0, 70, 0, 0, 1, 0, 1), (8, 0, 70, 0, 6, 0, 0, 1, 0, 1), (15, 0, 8, 0, 0, 0, 0, 1, 0, 1), (300, 0, 9, 0, 6, 0.3, 0, 1, 0, 1),
    # articles: headings, paragraphs and list items that are links, alone or among others
    (7, 1, 0, 0, 60, 0, 0, 1, 1, 1), (12, 1, 45, 0, 50, 0, 0, 1, 0, 1), (6, 1, 5, 1, 8, 1, 0, 1, 0, 1), (20, 0.9, 30, 0, 25, 0, 0, 1, 0, 1),
    (15, 1, 14, 1, 2, 1, 0, 1, 0, 1), (30, 0.8, 60, 0, 0, 0, 0, 1, 0, 1), (2, 1, 3, 1, 3, 1, 0, 1, 0, 1), (5, 0.6, 6, 0.5, 40, 0, 0, 1, 0, 1),
    # pages without an article element: running text among short blocks
    (45, 0, 50, 0, 38, 0, 0, 0, 0, 1), (90, 0.1, 8, 0, 60, 0, 0, 0, 0, 1), (18, 0, 60, 0, 75, 0, 0, 0, 0, 1), (7, 0, 45, 0, 50, 0, 0, 0, 0, 1),
    (6, 0, 2, 0, 70, 0, 0, 0, 1, 1), (10, 0, 1, 1, 42, 0, 0, 0, 1, 1), (25, 0.1, 12, 0, 30, 0, 0, 0, 0, 1), (14, 0, 33, 0, 2, 1, 0, 0, 0, 1),
    # the same: short paragraphs that end a page or come before a scrap
    (7, 0, 45, 0, 0, 0, 0, 0, 0, 1), (9, 0, 60, 0, 3, 1, 0, 0, 0, 1), (5, 0, 50, 0, 2, 0, 0, 0, 0, 1), (10, 0, 22, 0, 0, 0, 0, 0, 0, 1),
    # the same: short headings and lines before running text
    (2, 0, 0, 0, 50, 0, 0, 0, 1, 1), (3, 0, 2, 1, 65, 0, 0, 0, 1, 1), (1, 0, 30, 0, 40, 0, 0, 0, 1, 1), (4, 0, 55, 0, 12, 0, 0, 0, 0, 1),
    (4, 0, 1, 1, 9, 0, 0, 0, 0, 1), (2, 0.2, 40, 0, 44, 0, 0, 0, 0, 1), (3, 0, 3, 0, 6, 0, 0, 0, 0, 1), (2, 0, 40, 0, 6, 0, 0, 0, 0, 1), (4, 0, 8, 0, 6, 0, 0, 0, 0, 1),
    (1, 0, 20, 0, 6, 0, 0, 0, 0, 1), (3, 0, 60, 0, 6, 0, 0, 0, 1, 1), (6, 0.5, 2, 0, 30, 0, 0, 0, 0, 1),
    # the same: paragraphs that stand alone between scraps, links or the ends of the page
    (11, 0, 0, 0, 0, 0, 0, 0, 0, 1), (12, 0, 2, 1, 2, 1, 0, 0, 0, 1), (14, 0.1, 4, 0, 3, 0, 0, 0, 0, 1), (26, 0, 3, 1, 0, 0, 0, 0, 0, 1),
    (40, 0.5, 2, 1, 5, 1, 0, 0, 0, 1), (11, 0.3, 1, 0, 4, 0, 0, 0, 0, 1), (60, 0.2, 0, 0, 2, 1, 0, 0, 0, 1),
    (22, 0, 4, 1, 19, 0, 0, 0, 0, 1), (5, 0, 28, 0, 31, 0, 0, 0, 0, 1), (200, 0.02, 3, 1, 2, 1, 0, 0, 0, 1), (16, 0.1, 20, 0, 24, 0, 0, 0, 0, 1),
    # the same: linked headings and short linked lines before running text
    (3, 1, 0, 0, 60, 0, 0, 0, 1, 1), (7, 1, 2, 1, 40, 0, 0, 0, 1, 1), (4, 1, 50, 0, 45, 0, 0, 0, 1, 1), (9, 0.6, 3, 0, 25, 0, 0, 0, 1, 1),
    (3, 1, 60, 0, 70, 0, 0, 0, 0, 1), (2, 1, 45, 0, 50, 0, 0, 0, 0, 1), (4, 0.6, 20, 0, 30, 0, 0, 0, 0, 1), (1, 1, 3, 0, 9, 0, 0, 0, 0, 1),
    # page furniture, whatever its length
    (1, 1, 1, 1, 1, 1, 1, 0, 0, 0), (2, 1, 0, 0, 2, 1, 1, 0, 0, 0), (3, 1, 3, 1, 40, 0, 1, 0, 0, 0), (9, 0, 1, 1, 12, 0, 1, 0, 0, 0),
    (25, 0, 2, 1, 50, 0, 1, 0, 0, 0), (80, 0, 60, 0, 40, 0, 1, 0, 0, 0), (8, 0.2, 70, 0, 0, 0, 1, 0, 0, 0), (14, 0, 45, 0, 20, 0, 1, 1, 0, 0),
    (40, 0, 55, 0, 35, 0, 1, 1, 0, 0), (4, 0, 0, 0, 9, 0, 1, 1, 1, 0), (6, 0, 50, 0, 60, 0, 1, 0, 1, 0), (2, 0, 3, 0, 2, 0, 1, 1, 0, 0),
    # link lists and scraps outside an article
    (2, 1, 2, 1, 3, 1, 0, 0, 0, 0), (5, 1, 4, 1, 6, 1, 0, 0, 0, 0), (12, 0.9, 10, 0.8, 11, 1, 0, 0, 0, 0), (30, 0.8, 2, 1, 3, 1, 0, 0, 0, 0),
    (3, 0, 2, 1, 2, 1, 0, 0, 0, 0), (2, 0, 0, 0, 3, 1, 0, 0, 0, 0), (4, 0.6, 40, 0, 2, 1, 0, 0, 0, 0), (1, 0, 1, 0, 1, 0, 0, 0, 0, 0),
    (5, 0, 4, 0, 3, 0, 0, 0, 0, 0), (6, 0.6, 5, 0, 50, 0, 0, 0, 0, 0), (2, 0, 3, 1, 0, 0, 0, 0, 1, 0), (3, 0, 1, 0, 2, 1, 0, 0, 1, 0),
    (7, 0, 2, 0, 4, 0, 0, 0, 0, 0), (20, 0.7, 30, 0, 25, 0, 0, 0, 0, 0),
    (8, 0, 3, 0, 0, 0, 0, 0, 0, 0), (9, 0, 2, 1, 4, 0, 0, 0, 0, 0), (10, 0.1, 5, 0, 2, 1, 0, 0, 0, 0), (6, 0, 0, 0, 5, 1, 0, 0, 0, 0),
    (10, 0, 6, 1, 5, 0, 0, 0, 0, 0), (40, 0.6, 3, 1, 60, 0, 0, 0, 0, 0), (9, 0.55, 50, 0, 40, 0, 0, 0, 0, 0),
]
# What is a link list or scrap elsewhere belongs to the article inside one.
LABELLED += [(*row[:7], 1, row[8], 1) for row in LABELLED if not row[6] and not row[9]]
LABELLED = [(*row[:9], 0, row[9]) for row in LABELLED]
# On a short page the same scraps are all the text there is; links and furniture are none there either.
LABELLED += [(*row[:9], 1, int(not row[6] and row[1] <= 0.5)) for row in LABELLED if not row[7] and (row[0] <= SCRAP or row[6] or row[1] > 0.5)]


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple:
    """Binary tree by Gini impurity; ties go to the earlier feature and lower border. A leaf is the share of main text."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= cut
            p, q, n = labels[left].mean(), labels[~left].mean(), left.sum()
            score = n * p * (1 - p) + (len(labels) - n) * q * (1 - q)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, float(cut), left)
    if best is None:
        return (share,)
    _, f, cut, left = best
    return (f, cut, fit_tree(rows[left], labels[left], depth - 1), fit_tree(rows[~left], labels[~left], depth - 1))


@lru_cache(maxsize=1)
def tree() -> tuple:
    table = np.array(LABELLED, dtype=float)
    return fit_tree(table[:, :-1], table[:, -1])


def classify(node: tuple, rows: np.ndarray) -> np.ndarray:
    """True for rows of main text."""
    if len(node) == 1:
        return np.full(len(rows), node[0] >= 0.5)
    f, cut, low, high = node
    left = rows[:, f] <= cut
    out = np.empty(len(rows), dtype=bool)
    out[left], out[~left] = classify(low, rows[left]), classify(high, rows[~left])
    return out


def furniture_words(value: str) -> set[str]:
    """Furniture words of a class or id; what follows a state word, as in ``has-sidebar``, does not count."""
    said: set[str] = set()
    for token in value.split():
        for w in map(str.lower, SPLIT.split(token)):
            if w in STATES:
                break
            said.add(w)
    return said & WORDS


def furniture_of(name: str, rest: str, in_article: bool) -> int:
    """2 for an element of page furniture by its name, role or being hidden, 1 for one by class or id only, else 0.

    Words of reader discussion inside an article, or on it, give 2.
    """
    if name in FURNITURE or name == "header" and not in_article:
        return 2
    if not rest or "=" not in rest and "hidden" not in rest:
        return 0
    found = 0
    for m in ATTR.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if name in ("html", "body"):
                continue
            said = furniture_words(value)
            if name in ("article", "main"):
                said &= READERS
            if said & READERS and (in_article or name in ("article", "main")):
                return 2
            if said or not in_article and name != "article" and "header" in SPLIT.split(value.lower()):
                found = 1
        elif key == "role" and value.lower() in ROLES or key == "hidden":
            return 2
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return found


def page_blocks(source: str) -> tuple[list[str], list[tuple[float, ...]]]:
    """Texts of the flat blocks of a page and their own features: words, links, furniture, article, heading.

    A container that is furniture by class or id only is none if it holds the article: of the article elements (and likewise
    of the main elements) those with the fewest such containers around them free these; teasers in deeper ones stay furniture.
    """
    texts: list[str] = []
    rows: list[tuple[float, ...]] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    state = [0, 0, 0, 0]  # open elements of furniture, articles, headings, links
    around, depth = [0], [0]  # containers that are furniture by class or id: the next one outside, how many outside; 0 is none
    inner = 0  # the innermost open one
    within: list[int] = []  # that of each block
    holds: dict[str, list[int]] = {"article": [], "main": []}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                n = text.count(" ") + 1
                texts.append(text)
                rows.append((n, min(1.0, linked / n), float(state[0] > 0), float(state[1] > 0), float(state[2] > 0)))
                within.append(inner)
            parts.clear()
        linked = 0

    def count(name: str, furniture: int, by: int) -> None:
        nonlocal inner
        open_[name] = open_.get(name, 0) + by
        state[0] += by * (furniture == 2)
        if furniture == 1 and by > 0:
            around.append(inner)
            depth.append(depth[inner] + 1)
            inner = len(around) - 1
        elif furniture == 1:
            inner = around[inner]
        state[1] += by * (name in ("article", "main"))
        state[2] += by * (name in HEADINGS)
        state[3] += by * (name == "a")

    def close(name: str) -> None:
        while stack:
            top = stack.pop()
            if top[1] or top[0] in BLOCK:
                flush()
            count(top[0], top[1], -1)
            if top[0] == name:
                return

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if state[3]:
                linked += len(text.split())

    at = 0
    for m in TAG.finditer(source):
        add(source[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if open_.get(name):
                close(name)
            elif name in BLOCK:
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        if name in BLOCK:
            flush()
            if open_.get("p"):
                close("p")
            for same in ((name,) if name in ("li", "option", "tr") else ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else ()):
                if open_.get(same) and _near(stack, same):
                    close(same)
            for left in ("head",) if name == "body" else ("nav", "header", "head") if name in ("article", "main") else ():
                if open_.get(left):
                    close(left)
        furniture = furniture_of(name, rest, state[1] > 0)
        if furniture:
            flush()
        if not rest.endswith("/") or name in BLOCK:
            stack.append((name, furniture))
            count(name, furniture, 1)
            if name in holds and not state[0]:
                holds[name].append(inner)
    add(source[at:])
    flush()
    if len(around) == 1:
        return texts, rows
    free = {0}
    for found in holds.values():
        least = min((depth[k] for k in found), default=0)
        for k in found:
            while depth[k] and depth[k] <= least and k not in free:
                free.add(k)
                k = around[k]
    barred = [False] * len(around)
    for k in range(1, len(around)):
        barred[k] = k not in free or barred[around[k]]
    return texts, [(*r[:2], float(r[2] or barred[k]), *r[3:]) for r, k in zip(rows, within, strict=True)]


def _near(stack: list[tuple[str, int]], name: str) -> bool:
    """Whether ``name`` is open within the innermost list or table."""
    for top in reversed(stack):
        if top[0] == name:
            return True
        if top[0] in ("ul", "ol", "menu", "table", "dl", "select"):
            return False
    return False


def main_text(pages: list[str]) -> list[str]:
    """Main text of each page; empty where no block qualifies."""
    cut = [page_blocks(p) for p in pages]
    rows = []
    for _, own in cut:
        pad = [(0.0, 0.0), *[r[:2] for r in own], (0.0, 0.0)]
        short = float(not any(not r[2] and (r[3] or r[0] > SCRAP and r[1] <= 0.5) for r in own))
        rows += [(*r[:2], *pad[i], *pad[i + 2], *r[2:], short) for i, r in enumerate(own)]
    keep = classify(tree(), np.array(rows, dtype=float).reshape(-1, len(FEATURES))).tolist()
    out, at = [], 0
    for texts, _ in cut:
        out.append(" ".join([t for t, k in zip(texts, keep[at:at + len(texts)], strict=True) if k]))
        at += len(texts)
    return out


def extract(df: DataFrame, keep: list[str], source: str = "html") -> DataFrame:
    """Columns ``keep`` of every row plus ``text`` (main text, empty if none) and ``n_chars`` (its code points).

    A null page counts as empty. Character references are decoded, white space inside a block becomes one space, blocks
    are joined by one space in page order; nothing is cut. Rows keep their number, equal pages included.
    """
    def run(pages: list[str]) -> dict[str, list]:
        texts = main_text(pages)
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_text(df, run, "text string, n_chars bigint", keep, source)


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"), ["page_id", "url"])

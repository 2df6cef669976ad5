"""Main text of a web page from flat text blocks.

A page is cut at block-level tags into flat text blocks.  Each block has its word
count and link density, those of its neighbours, and what encloses it; a decision
tree trained on the blocks of the small labelled pages below tells article blocks from the rest.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, values

# Elements of the HTML standard by what they do to text blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math head iframe object canvas select textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that name parts of a page besides its article.
PART = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|side\w*|foot\w*|masthead|topbar|"
    r"breadcrumbs?|cookies?|consent|notice\w*|alert\w*|popup|modal|comments?|replies|respond|share\w*|social\w*|"
    r"related|recommend\w*|newsletter|subscri\w*|login|signup|search|widget\w*|pagination|toolbar|complementary|"
    r"contentinfo|navigation)(?:$|[\s_\d-])",
    re.I,
)
HEADER_PART = re.compile(r"(?:^|[\s_-])(?:site|page|global|top)[_-]?header", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "part", "main", "outside", "form",
)


def _is_part(attributes: str) -> bool:
    for x in NAMES.findall(attributes):
        x = x.strip("\"'")
        if PART.search(x) or HEADER_PART.search(x):
            return True
    return False


def blocks_of(page: str) -> list[dict]:
    """The text blocks of a page in order: text, n (words), linked (words inside links) and what encloses them."""
    out: list[dict] = []
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag, aside, part, main, link, unseen
    open_tags: dict[str, int] = {}  # a closing tag that opened nowhere is not looked for
    now = ("", False, False, False, False, False)
    chunks: list[tuple[str, bool]] = []
    held = now

    def close() -> None:
        nonlocal chunks
        if chunks:
            text = "".join(c for c, _ in chunks)
            words = (html.unescape(text) if "&" in text else text).split()
            if words:
                linked = sum(len(c.split()) for c, is_link in chunks if is_link)
                out.append({"text": " ".join(words), "n": len(words), "linked": linked, "at": held})
            chunks = []

    def say(text: str) -> None:
        nonlocal held
        if text and not now[5]:
            if not chunks:
                held = now
            elif held[1:4] != now[1:4]:
                close()
                held = now
            chunks.append((text, now[4]))

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        if m[2]:
            while open_tags.get(tag):
                top = stack.pop()[0]
                open_tags[top] -= 1
                if top == tag:
                    break
        elif tag not in VOID and not m[4].rstrip().endswith("/"):
            if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
                stack.pop()
                open_tags[tag] -= 1
            open_tags[tag] = open_tags.get(tag, 0) + 1
            over = stack[-1] if stack else ("", False, False, False, False, False)
            # a header inside the article holds its headline
            aside = over[1] or (tag in ASIDE and not (tag == "header" and over[3]))
            stack.append(
                (
                    tag,
                    aside,
                    over[2] or (bool(m[4]) and _is_part(m[4])),
                    over[3] or tag in MAIN,
                    over[4] or tag == "a",
                    over[5] or tag in UNSEEN,
                )
            )
        now = stack[-1] if stack else ("", False, False, False, False, False)
    rest = page[at:]
    say(rest)
    close()
    return out


def features(blocks: list[dict]) -> np.ndarray:
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    n = np.array([b["n"] for b in blocks], float)
    d = np.array([min(1.0, b["linked"] / b["n"]) for b in blocks])
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    of = lambda k: np.array([float(b["at"][k]) for b in blocks])
    main = of(3)
    form = np.array([float(b["at"][0] in ("label", "legend", "option")) for b in blocks])
    outside = float(main.any()) * (1 - main)
    return np.c_[n, d, before(n), before(d), after(n), after(d), of(1), of(2), main, outside, form]


def labelled_pages(n: int = 300, seed: int = 9) -> list[str]:
    """Small pages whose article text is made of the word "art" and all other text of the word "oth"; no feature sees words.

    Some have an article element, some a plain page where only the runs of text and links tell, some one block.
    """
    rng = np.random.default_rng(seed)
    some = lambda a, b: int(rng.integers(a, b))
    pick = lambda x: x[some(0, len(x))]
    art, oth = (lambda k: " ".join(["art"] * k)), (lambda k: " ".join(["oth"] * k))
    link = lambda k, word: f"<a href='/x'>{word(k)}</a>"

    def paragraph(shortest, longest):
        k = some(shortest, longest)
        tag = pick(["p", "p", "p", "li", "blockquote", "div"])
        linked = link(min(k, some(1, 4)), art) + " " if some(0, 6) == 0 else ""
        return f"<{tag}>{linked}{art(k)}</{tag}>"

    def links():
        tag = pick(["li", "li", "div", "p"])
        return "".join(f"<{tag}>{link(some(1, 4), oth)}</{tag}>" for _ in range(some(2, 8)))

    names = ["ad", "advert", "sponsor-box", "promo", "banner", "sidebar", "comments", "related", "newsletter", "cookie-notice", "share-buttons", "widget", "site-header", "footer-links"]

    def part():
        body = pick([lambda: oth(some(1, 6)), lambda: oth(some(2, 90)), lambda: links(), lambda: f"<p>{oth(some(5, 60))}</p><p>{oth(some(1, 30))}</p>"])()
        mark = pick(["class", "id"])
        return pick([f"<div {mark}='{pick(names)}'>{body}</div>", f"<aside>{body}</aside>", f"<section {mark}='{pick(names)}'>{body}</section>"])

    def form():
        return f"<form><label>{oth(some(1, 5))}</label><p>{oth(some(1, 20))}</p></form>"

    def nav():
        return pick([f"<nav><ul>{links()}</ul></nav>", f"<header><p>{oth(some(1, 9))}</p>{links()}</header>", f"<ul>{links()}</ul>"])

    def inside():
        out = [f"<header><h1>{art(some(1, 12))}</h1></header>" if some(0, 4) == 0 else f"<h1>{art(some(1, 12))}</h1>"]
        for _ in range(some(0, 9)):
            kind = some(0, 14)
            if kind == 0:
                out.append(part())
            elif kind == 1:
                out.append(f"<p>{link(some(1, 14), art)}</p>")
            elif kind == 2:
                out.append(form() if some(0, 2) else f"<label>{oth(some(1, 5))}</label>")
            elif kind == 3:
                out.append(f"<h2>{art(some(1, 8))}</h2>")
            else:
                out.append(paragraph(1, 120))
        return "".join(out)

    pages = []
    for i in range(n):
        top, end = nav(), pick([f"<footer>{oth(some(1, 30))}</footer>", f"<footer>{links()}</footer>", part(), nav()])
        if i % 5 < 3:
            tag = pick(["article", "article", "main"])
            plain = f"<div>{oth(some(1, 60))}</div>" if some(0, 2) else ""
            pages.append(f"{top}{pick([part, nav])()}{plain}<{tag}>{inside()}</{tag}>{plain if some(0, 2) else ''}{end}")
        elif i % 5 == 3:
            text = f"<h1>{art(some(2, 10))}</h1>{paragraph(25, 90)}"
            for _ in range(some(1, 6)):
                text += pick([lambda: paragraph(14, 90), lambda: paragraph(14, 90), lambda: paragraph(2, 8), lambda: f"<h2>{art(some(2, 8))}</h2>"])() + paragraph(20, 90)
            pages.append(f"{top}{part()}<ul>{links()}</ul><p>{oth(some(1, 4))}</p>{links()}<div>{text}</div>{links()}<p>{oth(some(1, 4))}</p>{links()}{end}")
        else:
            pages.append(pick([art(some(1, 40)), f"<p>{art(some(1, 4))}</p>", f"<p>{art(some(1, 40))}</p>", f"<div><p>{art(some(1, 60))}</p><p>{art(some(1, 60))}</p></div>", f"{art(some(10, 40))}{part()}", links()]))
    return pages


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and class (1: article text) of the labelled pages' blocks."""
    x, y = [], []
    for page in labelled_pages():
        blocks = blocks_of(page)
        x.append(features(blocks))
        y += [b["text"].startswith("art") for b in blocks]
    return np.concatenate(x), np.array(y, float)


def grown(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A CART tree by Gini impurity: a leaf is a class, a node (feature, threshold, low, high)."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best, found = 1e9, None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[:-1] + v[1:]) / 2:
            low = x[:, f] <= t
            p, q = y[low].mean(), y[~low].mean()
            gini = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if gini < best - 1e-12:
                best, found = gini, (f, t, low)
    if found is None:
        return int(y.mean() >= 0.5)
    f, t, low = found
    return (f, float(t), grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def trained_tree():
    return grown(*labelled_blocks())


def told(tree, x: np.ndarray) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree=None) -> str:
    tree = trained_tree() if tree is None else tree
    blocks = blocks_of(page)
    return " ".join(b["text"] for b, x in zip(blocks, features(blocks), strict=True) if told(tree, x))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null and empty pages give an empty text.  A page cut off inside a tag ends there.
    Null ids and urls stay null, repeated rows and equal ids are extracted each, extra columns
    are ignored, an empty table gives no rows.  Pages of any length and nesting are read once.
    """
    tree = trained_tree()

    def run(batches):
        for b in batches:
            texts = [main_text(p, tree) for p in values(b.column(2))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.coalesce(F.col(html_col), F.lit(""))
    )
    return rows.mapInArrow(releasing(run), "page_id long, url string, text string, n_chars long")

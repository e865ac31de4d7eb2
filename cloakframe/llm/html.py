"""Main-text extraction from HTML by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text under one innermost block element. A block's features are
its ancestors' tags and class words, and figures of its text (length, links, punctuation, digits). The
field labels the sequence of blocks as main text or boilerplate; it is trained on labelled pages by
maximising the conditional likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import map_batches, table

_TAG = re.compile(r"<(!?/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What a tag may end at, or a quoted value may start with.
_EDGE = re.compile(r">|=\s*([\"'])")
#: Elements whose content is no text of the page.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in "script style noscript template svg textarea iframe".split()}
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that break text into blocks; all others are inline.
BLOCKS = frozenset("html head body title div p ul ol li dl dt dd table thead tbody tfoot tr td th nav header footer aside main article section h1 h2 h3 h4 h5 h6 form fieldset blockquote pre figure figcaption address hr option select button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes the open elements on the right, up to the nearest one that isn't named with it.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head", "title"}}
CLOSES |= {x: {"p"} for x in "p div ul ol dl table nav header footer aside main article section h1 h2 h3 h4 h5 h6 form blockquote pre figure address hr fieldset".split()}
#: Words in class, id and role that are features of a block below them.
MARKS = frozenset("ad ads advert banner article body breadcrumb breadcrumbs comment comments content copyright cookie entry footer head header links main masthead menu meta nav navbar navigation newsletter pagination popup post promo related share sharing sidebar social sponsor story subscribe tags teaser text toolbar widget".split())

#: path (equal for equal ancestors), parent tag, ancestor tags, ancestor marks, text, share of it in links, breaks.
Block = tuple[int, str, frozenset[str], frozenset[str], str, float, int]
NONE: frozenset[str] = frozenset()


def tokens(page: str) -> Iterator[tuple[str | None, str, str]]:
    """(None, text, "") and (tag, "", attributes) or (tag, "/", "") of a page, in one pass.

    A quoted value after "=" may hold ">". A page with a tag that doesn't end because of its quotes is read on
    without regard to quotes, and what follows the last ">" is text, so no part of a page is searched again and again.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield None, page[at:] if not page.startswith("<!--", lt) or lt < 0 else page[at:lt], ""
            return
        if lt > at:
            yield None, page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page[lt + 1] in "!?":
                at = page.find(">", lt) + 1
            else:
                yield None, "<", ""
                at = lt + 1
            continue
        end = -1
        if quotes:
            p = m.end()
            while e := _EDGE.search(page, p):
                if e[1] is None:
                    end = e.start()
                    break
                p = page.find(e[1], e.end()) + 1
                if not p:
                    break
            quotes = end >= 0
        if end < 0:
            end = page.find(">", m.end())
        at, tag = end + 1, m[2].lower()
        if m[1] == "":
            yield tag, "", page[m.end() : end]
            if tag in RAW:
                close = RAW[tag].search(page, at)
                at = close.end() if close else size
        elif m[1] == "/":
            yield tag, "/", ""


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page. An open element holds what its blocks have in common, so depth costs nothing."""
    out: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, frozenset[str], frozenset[str]]] = [("", 0, NONE, NONE)]
    opened: Counter[str] = Counter()
    links, parts, linked, breaks = 0, [], 0, 0

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            tag, path, tags, marks = stack[-1]
            out.append((path, tag, tags, marks, text, min(1.0, linked / len(text)), breaks))
        parts, linked, breaks = [], 0, 0

    def close() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for tag, text, attributes in tokens(page):
        if tag is None:
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)
        elif text == "/":
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
                if opened[tag]:
                    while close() != tag:
                        pass
                    links = 0
        elif tag == "br":
            parts.append("\n")
            breaks += 1
        elif tag == "a":
            links += 1
        elif tag in BLOCKS:
            flush()
            links = 0
            closes = CLOSES.get(tag, ())
            while stack[-1][0] in closes:
                close()
            if tag not in VOID and not attributes.endswith("/"):
                _, path, tags, marks = stack[-1]
                own = frozenset(w for x in _NAME.findall(attributes) for w in _WORDS.findall("".join(x).lower()) if w in MARKS) if attributes else NONE
                stack.append((tag, paths.setdefault((path, tag), len(paths) + 1), tags if tag in tags else tags | {tag}, marks if own <= marks else marks | own))
                opened[tag] += 1
    flush()
    return out


# --- features ---------------------------------------------------------------------------------------

_TAGS = sorted(BLOCKS)
_TEXT = ["bias", "words1", "words4", "words10", "words25", "words60", "words150", "links0", "links<50", "links>50", "links1", "stops", "stop_end", "commas", "digits", "upper", "copyright", "pipes", "first", "second", "last", "early", "late", "breaks", "title_case", "prev_longer", "next_longer", "same_parent", "run"]
FEATURES = {f: i for i, f in enumerate([*(f"tag:{t}" for t in _TAGS), *(f"parent:{t}" for t in _TAGS), *(f"mark:{m}" for m in sorted(MARKS)), *_TEXT])}
_SIZES = [(1, "words1"), (4, "words4"), (10, "words10"), (25, "words25"), (60, "words60")]


@lru_cache(maxsize=10_000)
def _places(parent: str, tags: frozenset[str], marks: frozenset[str]) -> tuple[int, ...]:
    names = [f"tag:{t}" for t in tags if t not in ("html", "body")] + [f"parent:{parent}"] + [f"mark:{m}" for m in marks]
    return tuple(FEATURES[x] for x in names if x in FEATURES)


def features(page: list[Block]) -> list[list[int]]:
    """The features of each block, by number."""
    out, n = [], len(page)
    words = [b[4].count(" ") + 1 for b in page]
    for i, (path, parent, tags, marks, text, links, breaks) in enumerate(page):
        f = ["bias", next((name for top, name in _SIZES if words[i] <= top), "words150")]
        f.append("links0" if not links else "links1" if links > 0.95 else "links<50" if links < 0.5 else "links>50")
        if ". " in text or "! " in text or "? " in text:
            f.append("stops")
        if text[-1] in ".!?\"”»":
            f.append("stop_end")
        if "," in text:
            f.append("commas")
        if sum(map(text.count, "0123456789")) * 5 > len(text):
            f.append("digits")
        if text.isupper():
            f.append("upper")
        if "©" in text or "opyright" in text:
            f.append("copyright")
        if "|" in text or "»" in text or "·" in text:
            f.append("pipes")
        if i < 2:
            f.append("first" if not i else "second")
        if i == n - 1:
            f.append("last")
        f.append("early" if i * 4 < n else "late" if i * 4 >= 3 * n else "run")
        if breaks:
            f.append("breaks")
        if text.istitle():
            f.append("title_case")
        if i and words[i - 1] > 2 * words[i]:
            f.append("prev_longer")
        if i + 1 < n and words[i + 1] > 2 * words[i]:
            f.append("next_longer")
        if i and page[i - 1][0] == path:
            f.append("same_parent")
        out.append(sorted([*_places(parent, tags, marks), *(FEATURES[x] for x in f)]))
    return out


# --- the field: labels 0 (boilerplate) and 1 (main text) ----------------------------------------------


class Field:
    """weights: features x 2; moves: label before x label; ends: start and end x label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, ends: np.ndarray):
        self.weights, self.moves, self.ends = weights, moves, ends

    def scores(self, pages: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (pages x positions x labels) and lengths."""
        lengths = np.array([len(p) for p in pages])
        out = np.zeros((len(pages), max(lengths.max(), 1) if len(pages) else 1, 2))
        rows = [x for p in pages for x in p]
        if rows:
            flat = np.concatenate([np.array(x) for x in rows])
            at = np.concatenate([[0], np.cumsum([len(x) for x in rows])[:-1]])
            own = np.add.reduceat(self.weights[flat], at, axis=0)
            page = np.repeat(np.arange(len(pages)), lengths)
            out[page, np.concatenate([np.arange(n) for n in lengths])] = own
        return out, lengths

    def viterbi(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each page, all pages in step."""
        if not pages:
            return []
        s, lengths = self.scores(pages)
        best, back = s[:, 0] + self.ends[0], np.zeros(s.shape, np.int8)
        for t in range(1, s.shape[1]):
            step = best[:, :, None] + self.moves
            back[:, t] = step.argmax(1)
            now = step.max(1) + s[:, t]
            best = np.where((lengths > t)[:, None], now, best)
        label = (best + self.ends[1]).argmax(1)
        out = np.zeros(s.shape[:2], np.int8)
        for t in range(s.shape[1] - 1, -1, -1):
            inside = lengths > t
            out[inside, t] = label[inside]
            label = np.where(inside & (t > 0), back[np.arange(len(label)), t, label], label)
        return [x[:n] for x, n in zip(out, lengths)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials over the two labels on an axis."""
    return np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))


def train(pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood (forward-backward for the gradient, Adam for the steps)."""
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels) if p])
    lengths = np.array([len(p) for p in pages])
    n, most = len(pages), int(lengths.max())
    y = np.zeros((n, most), int)
    for i, own in enumerate(labels):
        y[i, : len(own)] = own
    on = np.arange(most) < lengths[:, None]
    truth = np.eye(2)[y] * on[..., None]
    pair_truth = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    # The features of all blocks, one block after the other.
    counts = np.array([len(f) for p in pages for f in p])
    flat, starts = np.concatenate([np.array(f) for p in pages for f in p]), np.cumsum(counts) - counts
    gathered = lambda d: np.stack([np.bincount(flat, np.repeat(d[:, k], counts), len(FEATURES)) for k in (0, 1)], axis=1)
    theta = [np.zeros((len(FEATURES), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(q) for q in theta], [np.zeros_like(q) for q in theta]
    for step in range(1, rounds + 1):
        w, moves, ends = theta
        s = np.zeros((n, most, 2))
        s[on] = np.add.reduceat(w[flat], starts, axis=0)
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0] + ends[0]
        for t in range(1, most):
            a[:, t] = np.where(on[:, t, None], _lse(a[:, t - 1][:, :, None] + moves, 1) + s[:, t], a[:, t - 1])
        b[:, -1] = ends[1]
        for t in range(most - 2, -1, -1):
            b[:, t] = np.where(on[:, t + 1, None], _lse(moves + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), ends[1])
        z = _lse(a[:, -1] + ends[1], 1)
        unary = np.exp(a + b - z[:, None, None]) * on[..., None]
        pair = np.zeros((2, 2))
        for t in range(1, most):
            e = np.exp(a[:, t - 1][:, :, None] + moves + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None])
            pair += e[on[:, t]].sum(0)
        last = np.arange(n), lengths - 1
        grads = [gathered((truth - unary)[on]), pair_truth - pair, np.stack([(truth - unary)[:, 0].sum(0), (truth[last] - unary[last]).sum(0)])]
        for q, g, mm, vv in zip(theta, grads, m, v):
            g = g / n - l2 * q
            mm += 0.1 * (g - mm)
            vv += 0.001 * (g * g - vv)
            q += rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Field(*theta)


# --- labelled pages -----------------------------------------------------------------------------------

#: Labelled pages that the field is trained on; they are made here, from templates.
TRAINING_PAGES, TRAINING_SEED = 400, 7


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A page of one of several layouts, and the label of each of its leaf blocks.

    Main text is marked with the attribute data-main, which no feature reads; labels come from it.
    """
    letters = "aeioubcdfglmnprstvéüñ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: phrase(3, 16).capitalize().replace(" ", ", " if rng.random() < 0.2 else " ", 1) + rng.choice(["."] * 8 + ["!", "?"])
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    semantic = rng.random() < 0.5
    tag = lambda name, cls: (name if semantic else "div", "" if semantic and rng.random() < 0.6 else f' class="{cls}"')

    def box(name: str, cls: str, inner: str) -> str:
        t, c = tag(name, cls)
        return f"<{t}{c}>{inner}</{t}>"

    def items(k: int, a: int = 1, b: int = 3) -> str:
        rows = "".join(f'<li><a href="/{word()}">{phrase(a, b)}</a>' + ("</li>" if rng.random() < 0.8 else "") for _ in range(k))
        return f"<ul>{rows}</ul>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.1:
            return f"<p data-main><b>{prose(1, 2)}<br><p data-main>{prose(1, 4)}</p>"
        if kind < 0.16:
            return f'<p data-main>{prose(1, 3)} <a href="/x">{phrase(1, 4)}</a> {prose(1, 2)}</p>'
        if kind < 0.22:
            return f"<h2 data-main>{phrase(2, 8)}</h2>"
        if kind < 0.27:
            return "<ul>" + "".join(f"<li data-main>{prose(1, 1)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.31:
            return f"<blockquote data-main>{prose(1, 3)}</blockquote>"
        if kind < 0.34:
            return f"<p data-main>{phrase(1, 4)}.</p>"
        return f"<p data-main>{prose(1, 7)}</p>"

    parts = [f"<!DOCTYPE html><html><head><title>{phrase(3, 9)}</title><style>p{{}}</style></head><body>"]
    if rng.random() < 0.8:
        parts.append(box("nav", rng.choice(["nav", "menu", "navbar"]), items(rng.randint(3, 8))))
    if rng.random() < 0.5:
        parts.append(box("header", "header", f"<p>{phrase(1, 5)}</p>"))
    if rng.random() < 0.5:
        parts.append(f'<div class="{rng.choice(["ad", "ads", "promo", "banner"])}">{prose(1, 2)}</div>')
    main = f"<h1 data-main>{phrase(2, 12)}</h1>" * (rng.random() < 0.9) + "".join(paragraph() for _ in range(rng.randint(1, 9)))
    if rng.random() < 0.3:
        k = main.find("<p", len(main) // 2)
        if k > 0:
            main = main[:k] + f'<div class="{rng.choice(["ad", "share", "related"])}">{phrase(2, 9)}</div>' + main[k:]
    parts.append(rng.choice([lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>", lambda x: f'<div class="{rng.choice(["content", "post", "entry", "story", "x1"])}">{x}</div>', lambda x: f"<div><section>{x}</section></div>"])(main))
    if rng.random() < 0.4:
        parts.append(box("aside", rng.choice(["sidebar", "related", "widget"]), f"<h3>{phrase(1, 3)}</h3>" + items(rng.randint(2, 6), 2, 8)))
    if rng.random() < 0.3:
        parts.append(box("section", "comments", "".join(f"<p>{prose(1, 2)}</p>" for _ in range(rng.randint(1, 4)))))
    if rng.random() < 0.85:
        parts.append(box("footer", rng.choice(["footer", "copyright"]), f"&copy; {phrase(1, 2)} &middot; {prose(1, 1) if rng.random() < 0.5 else phrase(1, 6)}"))
    page = "".join(parts) + "</body></html>"
    return page, [int(x) for x in main_blocks(page)]


def main_blocks(page: str) -> list[bool]:
    """For a labelled page, whether each leaf block is marked as main text."""
    marked = re.sub(r"<([a-z0-9]+) data-main>", "<\\1>\x02", page)
    return ["\x02" in b[4] for b in blocks(marked)]


def labelled_pages(n: int, seed: int) -> tuple[list[str], list[list[int]]]:
    rng = random.Random(seed)
    made = [labelled_page(rng) for _ in range(n)]
    return [p.replace(" data-main", "") for p, _ in made], [y for _, y in made]


@cache
def default_field() -> Field:
    pages, labels = labelled_pages(TRAINING_PAGES, TRAINING_SEED)
    return train([features(blocks(p)) for p in pages], labels)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, n_blocks, n_main, text): the main text of each page, one line for each of its blocks.

    Null, empty and textless pages have an empty text and no blocks; pages of which no block is main text
    have an empty text. Broken HTML is read as far as it can be: elements that are left open end
    with their parent. Equal scores of labels go to boilerplate. Time grows with a page's length, however deep its
    elements are. A null page_id stays null; repeated rows give repeated results; an empty table gives an empty
    result. Other columns than page_id and html are not read.
    """
    field = field or default_field()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parsed = [blocks(x) if x else [] for x in batch.column("html").to_pylist()]
        labels = field.viterbi([features(b) for b in parsed])
        text = ["\n".join(b[4] for b, y in zip(own, label) if y) for own, label in zip(parsed, labels)]
        counts = [pa.array([len(b) for b in parsed], pa.int32()), pa.array([int(x.sum()) for x in labels], pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *counts, pa.array(text, pa.string())], ["page_id", "n_blocks", "n_main", "text"])

    return map_batches(pages, ["page_id", "html"], run, "page_id long, n_blocks int, n_main int, text string", "html")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`extract` over the whole table `pages`; no shuffle."""
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import spread_sample

#: Pages the field is trained on, at most.
TRAINING_PAGES = 300
#: Longer pages, in characters, are no examples: the driver holds 300 pages of at most this.
TRAINING_CHARS = 1 << 18
EPOCHS, RATE, PENALTY = 120, 0.3, 1e-5
# Elements that begin and end a block of text, that have no end tag, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("iframe math noembed noscript object script style svg template".split())
# Elements and class words of what is no main text, also inside an article, and words that say nothing beside them.
_REST_TAGS = frozenset("aside footer form nav".split())
_REST_NAMES = frozenset(
    "ad ads advert advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer menu "
    "modal navigation newsletter notice pagination popup promo promoted recommended related share sharing sidebar social "
    "sponsor sponsored subscribe widget".split()
)
_PLAIN_NAMES = frozenset("area articles block bottom box container content inline inner items left legal list posts right section slot top unit wrapper".split())
_SECTIONS = frozenset("article aside footer form header main nav section".split())
# A paragraph ends where one of these begins, an item where the next one does.
_CLOSED_BY = {
    "p": BLOCKS - {"button", "label", "option", "body", "html", "head", "title"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
# All that a head holds; anything else, text too, ends one whose end tag is left out.
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-gold)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


class _Open:
    """An open block element. ``fresh`` are the tag and names that none of its ancestors has, as features."""

    __slots__ = ("tag", "names", "gold", "parent", "near", "fresh", "article", "heading", "rest")

    def __init__(self, tag: str, names: tuple[str, ...], gold: bool | None, parent: _Open | None, fresh: list[str]):
        self.tag, self.names, self.parent, self.fresh = tag, names, parent, fresh
        self.gold = parent.gold if gold is None and parent else gold
        # The innermost container that has a name or divides the page. A teaser or comment is part of what it is in.
        teaser = tag == "article" and parent is not None and parent.rest
        self.near = (tag, *names) if (names or tag in _SECTIONS) and not teaser else parent.near if parent else ("",)
        self.article = tag == "article" or (parent is not None and parent.article)
        self.heading = tag in ("head", "title") or (parent is not None and parent.heading)
        own = tag in _REST_TAGS or (any(n in _REST_NAMES for n in names) and all(n in _REST_NAMES or n in _PLAIN_NAMES for n in names))
        self.rest = own or (parent is not None and parent.rest)

    def up(self) -> Iterator[_Open]:
        node: _Open | None = self
        while node:
            yield node
            node = node.parent


@dataclass(eq=False)
class Block:
    """A run of text between the edges of block elements, and the innermost one it is in."""

    text: str
    at: _Open | None
    linked: int

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(x.tag for x in self.at.up())[::-1] if self.at else ()

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for x in list(self.at.up())[::-1] for n in x.names) if self.at else ()

    @property
    def gold(self) -> bool | None:
        return self.at.gold if self.at else None

    @property
    def heading(self) -> bool:
        """Whether it is in the page's head or title."""
        return self.at is not None and self.at.heading


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, white space folded and references decoded. Broken pages give what they have.

    Blocks share their ancestors, so elements without an end tag cost no more than others.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = []
    open_tags: Counter[str] = Counter()
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    at, size = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, len("".join(linked))))
            parts.clear()
            linked.clear()

    def push(tag: str, attributes: str) -> None:
        names, gold = _attributes(attributes)
        fresh = []
        for name in (f"in={tag}", *(f"name={n}" for n in dict.fromkeys(names))):
            if not held[name]:
                fresh.append(name)
            held[name] += 1
        open_tags[tag] += 1
        stack.append(_Open(tag, names, gold, stack[-1] if stack else None, fresh))

    def pop() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        for name in (f"in={node.tag}", *(f"name={n}" for n in dict.fromkeys(node.names))):
            held[name] -= 1
            if not held[name]:
                del held[name]

    while at < size:
        found = _TAG.search(page, at)
        end = found.start() if found else size
        if end > at:
            text = entities.unescape(page[at:end])
            if stack and stack[-1].tag == "head" and text.strip():
                flush()
                pop()
            parts.append(text)
            if links:
                linked.append(text)
        if not found:
            break
        at = found.end()
        if found[1] is None:
            continue
        tag = found[1].lower()
        if page[end + 1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                flush()
                if open_tags[tag]:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        if stack and stack[-1].tag == "head" and tag not in _IN_HEAD:
            flush()
            pop()
        if tag in OPAQUE:
            if not found[0].endswith("/>"):
                close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCKS:
            flush()
            while stack and tag in _CLOSED_BY.get(stack[-1].tag, ()):
                pop()
            if tag not in EMPTY:
                push(tag, found[2])
                links = 0
    flush()
    return out


def _attributes(text: str) -> tuple[tuple[str, ...], bool | None]:
    """The words in classes, id and role of an element, and its label if it has one."""
    names: list[str] = []
    gold = None
    if "=" in text:
        for key, *values in _ATTRIBUTE.findall(text):
            value = "".join(values).lower()
            if key.lower() == "data-gold":
                gold = value == "1"
            else:
                names += _NAME.findall(value)
    return tuple(names), gold


def _own_features(block: Block) -> list[str]:
    """What a block's text and innermost containers look like."""
    text, at = block.text, block.at
    size = len(text)
    words = text.count(" ") + 1
    share = block.linked / size
    out = ["bias", f"own={at.tag if at else ''}", f"words={min(words.bit_length(), 7)}"]
    # The innermost container speaks for itself, also within the main text.
    out += [f"near={n}" for n in set(at.near if at else ("",))]
    out.append("links=" + ("none" if not block.linked else "some" if share < 0.5 else "most"))
    out.append("ends=" + ("stop" if text[-1] in ".!?\"'»”…" else "colon" if text[-1] == ":" else "other"))
    marks = text.count(",") + text.count(". ")
    out.append(f"marks={min(marks.bit_length(), 4)}")
    if "©" in text:
        out.append("copyright")
    if at and at.rest:
        out.append("rest")
    return out


def features(block: Block) -> list[str]:
    """Names of a block's features: ancestors, their classes and ids, and what its text looks like."""
    above = [f for x in block.at.up() for f in x.fresh] if block.at else []
    outside = [] if "in=article" in above or "in=main" in above else ["outside"]
    return _own_features(block) + above + outside


class Field:
    """A linear-chain conditional random field with the labels 0 (left out) and 1 (main text)."""

    def __init__(self, weights: dict[str, tuple[float, float]], chain: list[list[float]]):
        self.weights, self.chain = weights, chain

    def decode(self, named: list[list[str]]) -> list[bool]:
        """The most probable labels of blocks with these features."""
        return self._best([self._weight(names) for names in named])

    def labels(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels of a page's blocks. What blocks have by their ancestors is added up once an ancestor."""
        none = 0.0, 0.0, False
        sums: dict[_Open, tuple[float, float, bool]] = {}
        weights = []
        for block in blocks:
            path = []
            node = block.at
            while node and node not in sums:
                path.append(node)
                node = node.parent
            x, y, inside = sums[node] if node else none
            for node in reversed(path):
                own = self._weight(node.fresh)
                x, y, inside = sums[node] = x + own[0], y + own[1], inside or node.tag in ("article", "main")
            own = self._weight(_own_features(block) + ([] if inside else ["outside"]))
            weights.append((x + own[0], y + own[1]))
        return self._best(weights)

    def _weight(self, names: list[str]) -> tuple[float, float]:
        found = [self.weights[n] for n in names if n in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def _best(self, weights: list[tuple[float, float]]) -> list[bool]:
        """The labels of the greatest sum (Viterbi)."""
        if not weights:
            return []
        (a, b), (c, d) = self.chain
        steps: list[tuple[bool, bool]] = []
        off = on = 0.0
        for k, (x, y) in enumerate(weights):
            if k:
                # Whether the best way to each label comes from label 1.
                steps.append((on + c > off + a, on + d > off + b))
                off, on = max(off + a, on + c) + x, max(off + b, on + d) + y
            else:
                off, on = x, y
        label = on > off
        out = [label]
        for from_off, from_on in reversed(steps):
            label = from_on if label else from_off
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[bool]]], epochs: int = EPOCHS) -> Field:
    """The field that makes the labels of ``pages`` (features and labels of their blocks) most probable."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    names = sorted({n for named, _ in pages for f in named for n in f})
    number = {n: k for k, n in enumerate(names)}
    longest = max(len(named) for named, _ in pages)
    count = len(pages)
    owner, column = [], []
    gold = np.zeros((count, longest), dtype=np.int64)
    here = np.zeros((count, longest), dtype=bool)
    for i, (named, labels) in enumerate(pages):
        here[i, :len(named)] = True
        gold[i, :len(named)] = labels
        for t, f in enumerate(named):
            owner += [i * longest + t] * len(f)
            column += [number[n] for n in f]
    owner, column = np.array(owner, dtype=np.int64), np.array(column, dtype=np.int64)
    w, chain = np.zeros((len(names), 2)), np.zeros((2, 2))
    truth = np.eye(2)[gold] * here[..., None]
    moves = (truth[:, :-1, :, None] * truth[:, 1:, None, :]).sum(axis=(0, 1))
    square = [np.full_like(w, 1e-8), np.full_like(chain, 1e-8)]
    blocks = max(1, int(here.sum()))
    for _ in range(epochs):
        unary = np.stack(
            [np.bincount(owner, weights=w[column, y], minlength=count * longest) for y in (0, 1)], axis=1
        ).reshape(count, longest, 2)
        forward, backward = np.zeros_like(unary), np.zeros_like(unary)
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + chain, axis=1) + unary[:, t]
            forward[:, t] = np.where(here[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(chain + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(here[:, t + 1, None], step, 0.0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        node = np.exp(forward + backward - whole[:, None, None]) * here[..., None]
        pair = np.exp(
            forward[:, :-1, :, None] + chain + (unary + backward)[:, 1:, None, :] - whole[:, None, None, None]
        ) * here[:, 1:, None, None]
        miss = (truth - node).reshape(-1, 2)
        slopes = (
            np.stack([np.bincount(column, weights=miss[owner, y], minlength=len(names)) for y in (0, 1)], axis=1)
            / blocks - PENALTY * w,
            (moves - pair.sum(axis=(0, 1))) / blocks - PENALTY * chain,
        )
        for part, slope, held in zip((w, chain), slopes, square):
            held += slope**2
            part += RATE * slope / np.sqrt(held)
    return Field({n: (float(w[k, 0]), float(w[k, 1])) for n, k in number.items()}, chain.tolist())


# --- labelled pages -----------------------------------------------------------------

# Kinds of containers around main text and around everything else, as tag and class.
_MAIN = (
    ("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"),
    ("div", "entry-content"), ("section", "post-body"), ("div", "main"), ("div", "story"), ("div", "text"), ("article", "entry"),
)
_REST = (
    ("nav", ""), ("nav", "menu"), ("div", "menu"), ("div", "navigation"), ("ul", "breadcrumbs"), ("header", ""),
    ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("footer", ""), ("footer", "site-footer"),
    ("div", "footer"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"),
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"),
    ("div", "banner"), ("div", "cookie"), ("div", "cookie-notice"), ("div", "cookies consent"), ("div", "notice"),
    ("div", "popup modal"), ("div", "newsletter subscribe"), ("form", ""), ("form", "search"), ("form", "login"),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("ol", "comment-list"), ("div", "share social"),
    ("div", "pagination"), ("div", "tags"), ("div", "author meta"), ("div", "disclaimer legal"),
)
_INSIDE = tuple(x for x in _REST if x[0] in ("div", "aside", "form", "section", "nav"))
#: Used where a table has no page to learn from.
_PROSE = (
    "The river rises in the hills, and after a long way through the plain it reaches the sea.",
    "Most of the houses were built in the last century; few of them stand today.",
    "She opened the letter, read it twice and put it back without a word.",
    "In spring the market moves to the square, where it stays until the first frost.",
)
_SHORT = ("Home", "Contact", "About us", "Log in", "All rights reserved.", "Read more", "Share", "Next page", "Archive")


def made_up_page(rng: random.Random, paragraphs: list[str], shorts: list[str]) -> str:
    """A page with known labels: ``data-gold`` says which containers hold main text. Texts are given, the layout is drawn."""
    clean = [entities.escape(p) for p in paragraphs]
    small = [entities.escape(s) for s in shorts]

    def rest(kinds) -> str:
        tag, name = rng.choice(kinds)
        body = []
        for _ in range(rng.randint(1, 5)):
            text = rng.choice(small) if rng.random() < 0.6 else rng.choice(clean)
            if tag in ("nav", "ul", "ol") or name in ("menu", "navigation", "related", "pagination", "tags"):
                text = f'<a href="#">{text}</a>' if tag != "ol" else text
                body.append(f"<li>{text}</li>" if tag in ("ul", "ol") or rng.random() < 0.5 else text)
            elif tag == "form":
                body.append(rng.choice((f"<label>{text}</label><input>", f"<button>{text}</button>", f"<p>{text}")))
            else:
                body.append(f"<p>{text}</p>" if rng.random() < 0.6 else f"<div>{text}</div>")
            if name in ("related", "comments", "comment", "promo") and rng.random() < 0.4:
                # Teasers and comments may be articles of their own.
                body[-1] = f"<article>{body[-1]}</article>"
        return f'<{tag} class="{name}" data-gold="0">{" ".join(body)}</{tag}>'

    def main() -> str:
        tag, name = rng.choice(_MAIN)
        body = [f"<h1>{rng.choice(small)}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.randint(2, 10)):
            if rng.random() < 0.15:
                body.append(rest(_INSIDE))
            elif rng.random() < 0.12:
                body.append("<ul>" + "".join(f"<li>{rng.choice(small)}</li>" for _ in range(3)) + "</ul>")
            elif rng.random() < 0.1:
                body.append(f"<h2>{rng.choice(small)}</h2>")
            else:
                body.append(f"<p>{rng.choice(clean)}</p>")
        return f'<{tag} class="{name}" data-gold="1">{"".join(body)}</{tag}>'

    before = [rest(_REST) for _ in range(rng.randint(0, 4))]
    after = [rest(_REST) for _ in range(rng.randint(0, 4))]
    return f"<body data-gold=\"0\">{''.join(before)}{main()}{''.join(after)}</body>"


def labelled(pages: list[str], seed: int = 7) -> list[tuple[list[list[str]], list[bool]]]:
    """Features and labels: the pages' own articles without what _REST_TAGS and _REST_NAMES tell, and drawn layouts around their texts."""
    rng = random.Random(seed)
    out, long, short = [], list(_PROSE), list(_SHORT)
    for page in pages:
        blocks = [b for b in leaf_blocks(page) if not b.heading]
        for b in blocks:
            (long if b.text.count(" ") >= 8 else short).append(b.text[:400])
        labels = [b.at is not None and b.at.article and not b.at.rest for b in blocks]
        if any(labels):
            out.append(([features(b) for b in blocks], labels))
    for _ in range(max(2 * len(pages), 300)):
        blocks = leaf_blocks(made_up_page(rng, rng.sample(long, min(20, len(long))), rng.sample(short, min(20, len(short)))))
        out.append(([features(b) for b in blocks], [bool(b.gold) for b in blocks]))
    return out


def main_text(page: str | None, own: Field) -> str:
    """The page's main text, a line per block."""
    blocks = [b for b in leaf_blocks(page) if not b.heading]
    keep = own.labels(blocks)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extracted(
    pages: DataFrame, training_pages: int = TRAINING_PAGES, id_col: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """(page_id, text) for every row of ``pages``.

    The field learns from at most ``training_pages`` pages with an article element,
    of at most TRAINING_CHARS characters and with the least hash of their html, and from drawn layouts; it is then
    applied to every whole page. Null and empty pages give an empty text. Repeated rows come
    out each time, a null page_id stays; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    usable = rows.filter(F.col("html").contains("<article") & (F.length("html") <= TRAINING_CHARS)).select("html")
    sample = [r["html"] for r in spread_sample(usable, F.col("html"), training_pages).collect()]
    sent = pages.sparkSession.sparkContext.broadcast(fit(labelled(sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = [main_text(x.as_py(), own) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, text string")

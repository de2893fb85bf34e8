"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.llm.labelled_pages import HINTS, MARK, labelled_pages
from canopia.plans.shared import bounded_batches

#: Training: so many labelled pages, passes of gradient descent, step and penalty.
PAGES, PASSES, STEP, PENALTY, SEED = 1000, 200, 0.1, 1e-4, 11
# Elements of HTML by how they lay out.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style title template noscript svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
REGIONS = frozenset("article aside dialog footer form header main nav section".split())
#: Hidden elements whose content the parser takes as raw text up to their end.
RAW = frozenset({"script", "style"})
NAME = re.compile(r"[A-Za-z]+")
HIDDEN_END = re.compile(rf"</({'|'.join(sorted(HIDDEN))})\b", re.I)


class Element:
    """An open element, linked to the one around it: what its path has, without a copy of the path.

    ``fresh`` are the features of this element that no element around it has; ``region``, ``inner`` and ``last`` are the innermost
    region, the innermost names, and the innermost of both.
    """

    __slots__ = ("above", "tag", "words", "main", "fresh", "region", "inner", "last", "known")

    def __init__(self, above: Element | None, tag: str, words: tuple[str, ...] = (), main: bool = False, fresh: tuple[str, ...] = ()) -> None:
        self.above, self.tag, self.words, self.fresh = above, tag, words, fresh
        self.main = main or (above is not None and above.main)
        self.region = tag if tag in REGIONS else above.region if above else "none"
        self.inner = words or (above.inner if above else ())
        self.last: tuple[str, ...] = tuple(f"last {w}" for w in words) or ((f"last <{tag}>",) if tag in REGIONS else above.last if above else ("last <none>",))
        #: The field that weighed ``fresh`` of this and all elements around it, and the sum.
        self.known: tuple[object, float] | None = None

    def own_features(self) -> set[str]:
        own = self.tag if self.tag not in ("html", "body", "") else "none"
        return {f"own {own}", f"region {self.region}", *(f"inner {w}" for w in self.inner), *self.last}


class Block:
    """A leaf block: the element around it, its text, and the length of linked text."""

    __slots__ = ("path", "text", "linked", "main")

    def __init__(self, path: Element, text: str, linked: int) -> None:
        self.path, self.text, self.linked, self.main = path, text, linked, path.main


class _Reader(HTMLParser):
    """Cuts a page into its leaf blocks; forgives unclosed and stray tags, and declarations of any kind."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._open = [Element(None, "")]
        self._tags: Counter[str] = Counter()
        self._names: Counter[str] = Counter()
        self._parts: list[str] = []
        self._linked, self._link, self._hidden, self._depth = 0, 0, "", 0
        #: End tags still to come: a hidden element without one hides nothing.
        self._ends = Counter(x.lower() for x in HIDDEN_END.findall(html))

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections such as CDATA are comments in web pages."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append(Block(self._open[-1], text, self._linked))
        self._parts, self._linked = [], 0

    def _close(self, tag: str, among: frozenset[str] | None = None) -> None:
        """Close the innermost ``tag`` and all inside it, unless an element outside ``among`` stands between."""
        if not self._tags[tag]:
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i].tag == tag:
                for x in self._open[i:]:
                    self._tags[x.tag] -= 1
                    self._names.subtract(x.fresh)
                del self._open[i:]
                return
            if among is not None and self._open[i].tag not in among:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._hidden:
            self._depth += tag == self._hidden
            return
        if tag in HIDDEN:
            if self._ends[tag] > 0 or tag in RAW:
                self._hidden, self._depth = tag, 1
            return
        if tag == "br":
            self._parts.append(" ")
        elif tag == "a":
            self._link = 1
        elif tag in BLOCKS:
            self.flush()
            self._link = 0
            self._close("p", frozenset())
            if tag in ("li", "dt", "dd", "option"):
                self._close(tag, frozenset({"p"}))
            elif tag in ("td", "th", "tr"):
                for t in ("td", "th", *(("tr",) if tag == "tr" else ())):
                    self._close(t, frozenset({"p", "td", "th"} if tag == "tr" else {"p"}))
            if re.fullmatch("h[1-6]", tag):
                for t in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    self._close(t, frozenset())
            if tag not in VOID:
                given = dict(attrs) if attrs else {}
                words = tuple(NAME.findall(f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}".lower()))
                names = {*(f"named {w}" for w in words), *((f"in {tag}",) if tag not in ("html", "body") else ())}
                fresh = tuple(sorted(n for n in names if not self._names[n]))
                self._names.update(fresh)
                self._tags[tag] += 1
                self._open.append(Element(self._open[-1], tag, words, MARK in given, fresh))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN or (self._hidden and tag == self._hidden):
            return
        self.handle_starttag(tag, attrs)
        if not self._hidden and tag in BLOCKS and tag not in VOID and self._open[-1].tag == tag:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self._ends[tag] -= 1
        if self._hidden:
            if tag == self._hidden:
                self._depth -= 1
                # More openings than ends are left: the last end closes them all.
                if not self._depth or not self._ends[tag]:
                    self._hidden = ""
        elif tag == "a":
            self._link = 0
        elif tag in BLOCKS:
            self.flush()
            self._link = 0
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._parts.append(data)
            if self._link:
                self._linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order: character references decoded, white space inside a block one space, trimmed, none empty.

    No page is refused; the time grows with its length, however deep its elements are nested.
    """
    reader = _Reader(html or "")
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def path_features(path: Element) -> list[str]:
    """The elements around a block: all of them, the innermost region, the block's own element; and the words they are named by."""
    out, x = path.own_features(), path
    while x is not None:
        out.update(x.fresh)
        x = x.above
    return sorted(out)


def text_features(b: Block, at: int, n: int) -> list[str]:
    """Size, linked share, signs and place of a block."""
    words = b.text.count(" ") + 1
    size = "1" if words < 2 else "4" if words < 5 else "9" if words < 10 else "24" if words < 25 else "many"
    share = b.linked / max(len(b.text), 1)
    out = [f"words {size}", "linked all" if share > 0.8 else "linked half" if share > 0.3 else "linked little"]
    if b.text[-1] in ".?!:":
        out.append("sentence")
    if words < 60 and not HINTS.isdisjoint(NAME.findall(b.text.lower())):
        out.append("hint")
    if "©" in b.text:
        out.append("copyright")
    if at == 0:
        out.append("first")
    if at == n - 1:
        out.append("last of page")
    return out


class Field:
    """Weights of the two-label chain: features for main against other, and the change between neighbours."""

    def __init__(self, weights: dict[str, float], change: np.ndarray) -> None:
        self.weights, self.change = weights, change.tolist()

    def _around(self, path: Element) -> float:
        """The weight of all that is around a block; each element is weighed once."""
        get, way, x = self.weights.get, [], path
        while x is not None and (x.known is None or x.known[0] is not self):
            way.append(x)
            x = x.above
        total = x.known[1] if x is not None else get("bias", 0.0)
        for x in reversed(way):
            total += sum(get(f, 0.0) for f in x.fresh)
            x.known = (self, total)
        return total + sum(get(f, 0.0) for f in sorted(path.own_features()))

    def main_blocks(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labelling of a page's blocks (Viterbi); of equal ones that with other at the later block."""
        get, n = self.weights.get, len(blocks)
        best, back = [0.0, 0.0], []
        for i, b in enumerate(blocks):
            own = self._around(b.path) + sum(get(f, 0.0) for f in text_features(b, i, n))
            if i:
                c = self.change
                into = [[best[0] + c[0][k], best[1] + c[1][k]] for k in (0, 1)]
                back.append([int(x[1] > x[0]) for x in into])
                best = [max(into[0]), max(into[1]) + own]
            else:
                best = [0.0, own]
        label = int(best[1] > best[0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return [bool(x) for x in reversed(out)][:n]


def fit(pages: list[str]) -> Field:
    """Fit by gradient descent on the conditional likelihood of the marked labels, by forward-backward over all pages at once."""
    rows = [(leaf_blocks(p)) for p in pages]
    rows = [r for r in rows if r]
    features = [[["bias", *path_features(b.path), *text_features(b, i, len(r))] for i, b in enumerate(r)] for r in rows]
    names = {f: k for k, f in enumerate(sorted({f for r in features for b in r for f in b}))}
    n, longest = len(rows), max(map(len, rows))
    at = [(i * longest + j, names[f]) for i, r in enumerate(features) for j, b in enumerate(r) for f in b]
    cell, column = np.array(at).T
    gold, there = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, r in enumerate(rows):
        gold[i, : len(r)], there[i, : len(r)] = [b.main for b in r], True
    pairs = there[:, 1:]
    weights, change = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))]
    seen_change = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for k in range(1, PASSES + 1):
        own = np.bincount(cell, weights[column], n * longest).reshape(n, longest)
        emit = np.stack([np.zeros_like(own), own], 2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for j in range(1, longest):
            step = np.logaddexp(ahead[:, j - 1, :1] + change[0], ahead[:, j - 1, 1:] + change[1]) + emit[:, j]
            ahead[:, j] = np.where(there[:, j, None], step, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            after = emit[:, j + 1] + behind[:, j + 1]
            step = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
            behind[:, j] = np.where(there[:, j + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        main = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None]) * there
        joint = np.exp(ahead[:, :-1, :, None] + change + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        g_weights = np.bincount(column, (main - gold).reshape(-1)[cell], len(names)) / n + PENALTY * weights
        g_change = (joint.sum((0, 1)) - seen_change) / n + PENALTY * change
        for x, g, m, v in ((weights, g_weights, *moments[:2]), (change, g_change, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field({f: float(weights[k]) for f, k in names.items()}, change)


@cache
def trained() -> Field:
    """The field fitted on the labelled pages of this package; the same in every session."""
    return fit(labelled_pages(PAGES, SEED))


def main_text(field: Field, html: str | None) -> str:
    blocks = leaf_blocks(html)
    return "\n\n".join(b.text for b, keep in zip(blocks, field.main_blocks(blocks), strict=True) if keep) if blocks else ""


def extract_text(pages: DataFrame, html_col: str = "html", to: str = "text", length: str = "n_chars") -> DataFrame:
    """``pages`` without ``html_col``, with the main text of each whole page and its number of characters.

    All other columns stay; columns with the new names are replaced. A null, empty or blank page and one without main blocks
    have an empty text. Repeated rows come out as often as they came in; an empty table gives an empty one. One narrow pass; the
    fitted weights are some hundred numbers.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared.value
        for s in batches:
            yield pd.Series([main_text(field, h) for h in s], dtype=object)

    rest = [c for c in pages.columns if c not in (html_col, to, length)]
    return pages.select(*rest, of(F.col(html_col)).alias(to)).withColumn(length, F.length(to).cast("long"))

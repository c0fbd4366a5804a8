"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags, with the elements above it. Each block has
features of its ancestors (tags, words of class, id and role) and of its text; neighbours are tied by transition
weights. The weights are trained on labelled pages (``htmlpages``), and Viterbi decoding labels the blocks of a page.

Defined results: a null or empty page has empty text; scripts, styles, comments, the head and form controls hold no
text; a tag that the page's end cuts off is markup; unclosed elements end with their parent; repeated rows each get
their result; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of HTML by their role.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title select button option textarea noscript template svg math iframe object script style audio video canvas".split())
ZONES = frozenset("article main nav footer header aside form section".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "option", "optgroup", "legend"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")


class Block:
    """Text of a leaf block: its element, and of all elements above it the tags, the names and the innermost zone."""

    __slots__ = ("linked", "names", "own", "tags", "text", "zone")

    def __init__(self, above: Above, text: str, linked: int):
        self.own, self.tags, self.names, self.zone = above.own, above.tags, above.names, above.zone
        self.text, self.linked = text, linked


class Above:
    """What is said of an open element and all elements above it. Sets are shared as long as nothing new comes in."""

    __slots__ = ("hidden", "names", "own", "tags", "zone")

    def __init__(self, own: str, tags: frozenset[str], names: frozenset[str], zone: str, hidden: bool):
        self.own, self.tags, self.names, self.zone, self.hidden = own, tags, names, zone, hidden

    def inside(self, name: str, names: set[str], hidden: bool) -> Above:
        tags = self.tags if name in self.tags else self.tags | {name}
        more = self.names if names <= self.names else self.names | names
        return Above(name, tags, more, name if name in ZONES else self.zone, self.hidden or hidden)


_TOP = Above("", frozenset(), frozenset(), "none", False)
_LISTS = ("ul", "ol", "menu", "dl", "table")


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks with text, in page order. Tags and names that aren't ``known`` count as one each.

    Each element is entered and left once, and places of open elements are kept by tag, so time is linear in the page.
    """
    out: list[Block] = []
    stack: list[tuple[str, Above]] = []
    places: dict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            above = stack[-1][1] if stack else _TOP
            text = "" if above.hidden else " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                out.append(Block(above, text, sum(len(p.strip()) for p, in_link in parts if in_link)))
            parts.clear()

    def last(name: str) -> int:
        return places[name][-1] if places[name] else -1

    def close(name: str) -> None:
        at = last(name)
        if at < 0 or name not in BLOCKS and open_blocks and open_blocks[-1] > at:
            return
        if open_blocks and open_blocks[-1] >= at:
            flush()
        while len(stack) > at:
            gone, _ = stack.pop()
            places[gone].pop()
            if open_blocks and open_blocks[-1] == len(stack):
                open_blocks.pop()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append((page[at : m.start()], bool(places["a"])))
        at = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            close(name)
            if name in ("p", "br"):
                flush()
            continue
        if name == "br":
            parts.append((" ", bool(places["a"])))
        if name in BLOCKS:
            flush()
            if name in CLOSES_P:
                close("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and last(name) > max(map(last, _LISTS)):
                close(name)
        if name in VOID or m[4].endswith("/") and name not in BLOCKS:
            continue
        names, hidden = set(), name in SILENT
        for key, *values in _ATTRIBUTE.findall(m[4]):
            if key.lower() == "hidden":
                hidden = True
            elif key.lower() in ("class", "id", "role"):
                names.update(_NAME.findall("".join(values).lower()))
        tag = name
        if known is not None:
            names = {x if x in known else "?" for x in names}
            tag = name if name in known or name in BLOCKS else "?"
        if name in BLOCKS:
            open_blocks.append(len(stack))
        places[name].append(len(stack))
        stack.append((name, (stack[-1][1] if stack else _TOP).inside(tag, names, hidden)))
    if at < len(page):
        parts.append((page[at:], bool(places["a"])))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        words = b.text.split()
        ratio = b.linked / n if n else 0
        f = [f"own={b.own}", *{f"in={t}" for t in b.tags}, *{f"name={x}" for x in b.names}]
        f.append(f"words={min(len(words), 64).bit_length()}")
        f.append("links=" + ("none" if ratio == 0 else "some" if ratio < 0.5 else "most"))
        f.append(f"stops={min(3, sum(b.text.count(c) for c in '.!?'))}")
        if "\N{COPYRIGHT SIGN}" in b.text:
            f.append("copyright")
        if b.text[-1:] in ".!?":
            f.append("ends")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        f.append(f"zone={b.zone}" + ("" if b.names else ",plain"))
        out.append(f)
    return out


class Field:
    """Weights of (feature, label) and of (label, label); label 1 is main text."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: np.ndarray):
        self.weights, self.steps = weights, steps
        self.known = frozenset(x.partition("=")[2] for x in weights if x.startswith(("in=", "name=")))

    def labels(self, page: list[Block]) -> list[int]:
        """The likeliest labels of the whole chain (Viterbi)."""
        if not page:
            return []
        t00, t01, t10, t11 = self.steps.ravel().tolist()
        back: list[tuple[int, int]] = []
        zero = one = 0.0
        for i, f in enumerate(features(page)):
            u0 = u1 = 0.0
            for x in f:
                w = self.weights.get(x)
                if w:
                    u0 += w[0]
                    u1 += w[1]
            if i:
                a, b, c, d = zero + t00, one + t10, zero + t01, one + t11
                back.append((int(b > a), int(d > c)))
                zero, one = max(a, b) + u0, max(c, d) + u1
            else:
                zero, one = u0, u1
        label = int(one > zero)
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.3, l2: float = 0.05) -> Field:
    """Maximum likelihood by gradient steps; expectations come from the forward-backward recursion over all pages at once."""
    pages = [(p, y) for p, y in pages if p]
    index: dict[str, int] = {}
    rows = [[index.setdefault(x, len(index)) for x in f] for p, _ in pages for f in features(p)]
    flat = np.concatenate([np.array(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    sizes = np.array([len(p) for p, _ in pages])
    page, place = np.repeat(np.arange(len(pages)), sizes), np.concatenate([np.arange(n) for n in sizes])
    gold = np.concatenate([np.array(y) for _, y in pages])
    inside = np.arange(sizes.max()) < sizes[:, None]
    follows = place > 0
    counted = np.zeros((2, 2))
    np.add.at(counted, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
    w, steps = np.zeros((len(index), 2)), np.zeros((2, 2))
    g2, s2 = np.full_like(w, 1e-6), np.full_like(steps, 1e-6)
    for _ in range(rounds):
        own = np.stack([np.bincount(of, weights=w[flat, k], minlength=len(rows)) for k in (0, 1)], axis=1)
        u = np.zeros((*inside.shape, 2))
        u[page, place] = own
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for i in range(1, u.shape[1]):
            moved = alpha[:, i - 1, :, None] + steps
            alpha[:, i] = u[:, i] + np.logaddexp(moved[:, 0], moved[:, 1])
        for i in range(u.shape[1] - 2, -1, -1):
            moved = steps + (u[:, i + 1] + beta[:, i + 1])[:, None, :]
            beta[:, i] = np.where(inside[:, i + 1, None], np.logaddexp(moved[:, :, 0], moved[:, :, 1]), 0)
        z = np.logaddexp(*alpha[np.arange(len(pages)), sizes - 1].T)
        belief = np.exp((alpha + beta)[page, place] - z[page, None])
        belief[np.arange(len(rows)), gold] -= 1
        gw = l2 * w + np.stack([np.bincount(flat, weights=belief[of, k], minlength=len(index)) for k in (0, 1)], axis=1)
        pair = np.exp(alpha[:, :-1, :, None] + steps + (u + beta)[:, 1:, None, :] - z[:, None, None, None])
        gs = l2 * steps + pair[inside[:, 1:]].sum(axis=0) - counted
        g2 += gw * gw
        s2 += gs * gs
        w -= rate * gw / np.sqrt(g2)
        steps -= rate * gs / np.sqrt(s2)
    return Field({x: (float(w[i, 0]), float(w[i, 1])) for x, i in index.items()}, steps)


@functools.lru_cache(1)
def default_field() -> Field:
    from . import htmlpages

    return train(htmlpages.labelled(400))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page or "", field.known)
    return "\n".join(b.text for b, y in zip(found, field.labels(found), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` with text and n_chars, its code points."""
    field = field or default_field()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [main_text(p, field) for p in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])
    found = pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)
    return found.withColumn("n_chars", F.length("text").cast("long"))

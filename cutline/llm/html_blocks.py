"""Main-text extraction: a recurrent labeller over the blocks of a page.

A page is read into leaf blocks: runs of text between block-level tags, with the path of tags, classes and ids above
them.  A block's input is the sum of vectors of its hashed path parts and hashed words, and a few measures.  A
bidirectional LSTM runs over all blocks of the page, so every block is classified with the whole page in view.

Nobody labelled the pages.  The network learns from those whose markup says what is what (an article element,
a nav, a footer): their blocks teach, re-dressed in other markup each time, with menus, notices, adverts, forms and
reader comments of other pages put around and between.  It so learns to do without the telling tags.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import slices

#: Pages, chosen by a hash of their ids, that teach the network.
FIT_PAGES = 400
#: Blocks of a page that one training example holds; scoring always reads whole pages.
FIT_BLOCKS = 120
#: Further levels of nesting that taught pages get, below this number.
MORE_NESTED = 15
HASHED, VECTOR, STATE, MEASURES = 2048, 16, 16, 8
#: Pages labelled together, and blocks times pages at most.
TOGETHER, CELLS = 256, 60_000

# A tag or a quote that never ends takes the rest of the page, so no character is tried twice.
_INSIDE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^>"']++)*+"""
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<(script|style|template|noscript|iframe|svg|textarea|title)\b{_INSIDE}(?:>|\Z).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_INSIDE})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-zA-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup"
    " time tt u var wbr label".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of the values' tags ends an open element of the key.
_ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p"
        " pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
}


@dataclass(frozen=True)
class Block:
    """A leaf: the parts of its path from the outermost, its text, how many characters are in links."""

    path: tuple[str, ...]
    text: str
    linked: int


def _element(tag: str, attributes: str) -> tuple[str, ...]:
    parts = [tag]
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        parts += [f"{name.lower()}:{p.lower()}" for p in _PART.findall("".join(values))]
    return tuple(parts)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in its order, white space in each made one space; blank ones are left out."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    outer: list[str] = []  # the open elements that are not inline
    count: dict[str, int] = {}
    text: list[str] = []
    linked = depth = 0

    def end_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                path = tuple(part for tag, parts in stack if tag not in _INLINE for part in parts)
                found.append(Block(path, joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal depth
        while stack:
            top = stack.pop()[0]
            depth -= top == "a"
            count[top] -= 1
            if top not in _INLINE:
                outer.pop()
            if top == tag:
                break

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            text.append(piece)
            linked += len(piece) if depth else 0
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            end_block()
        if token[2]:
            if count.get(tag):
                close(tag)
            continue
        if tag in _VOID:
            continue
        while outer and tag in _ENDED_BY.get(outer[-1], ()):
            close(outer[-1])
        stack.append((tag, _element(tag, token[4])))
        count[tag] = count.get(tag, 0) + 1
        if tag not in _INLINE:
            outer.append(tag)
        depth += tag == "a"
    text.append(page[at:])
    end_block()
    return found


# --- inputs


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % HASHED


def inputs(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """For every block: hashed parts of its whole path, hashed words of its whole text, measures."""
    total = sum(len(b.text) for b in page) or 1
    paths, words, measures = [], [], []
    before = 0
    for number, block in enumerate(page):
        text, n = block.text, len(block.text)
        # Paths and long texts repeat their parts; the first of a kind says it all.
        paths.append([_slot(f"path/{part}") for part in dict.fromkeys(block.path)] + [_slot(f"leaf/{block.path[-1]}" if block.path else "leaf/")])
        words.append([_slot(f"word/{w}") for w in dict.fromkeys(_WORD.findall(text.lower()))])
        stops = sum(map(text.count, ".!?,"))
        measures.append(
            [np.log1p(n) / 8, block.linked / n, min(stops / n * 20, 2), text[-1] in ".!?", number / len(page), before / total, n / total, text[:1].isupper()]
        )
        before += n
    return paths, words, np.array(measures, float).reshape(-1, MEASURES)


# --- the network


@dataclass
class Network:
    """All parameters by name; ``step`` computes probabilities and, given labels, gradients."""

    parameters: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        width = 2 * VECTOR + MEASURES
        p = {"vectors": rng.normal(0, 0.3, (HASHED, VECTOR)), "out": rng.normal(0, 0.3, 2 * STATE), "bias": np.zeros(1)}
        for way in ("right", "left"):
            p[f"in_{way}"] = rng.normal(0, width**-0.5, (width, 4 * STATE))
            p[f"state_{way}"] = rng.normal(0, STATE**-0.5, (STATE, 4 * STATE))
            p[f"bias_{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], STATE)
        return cls(p)

    def _bag(self, bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(b) for b in bags])
        flat = np.array([i for b in bags for i in b], np.int64)
        owner = np.repeat(np.arange(len(bags)), sizes)
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        sums = np.zeros((len(bags), VECTOR))
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(self.parameters["vectors"][flat], (np.cumsum(sizes) - sizes)[full], axis=0)
        return sums * scale[:, None], flat, owner, scale

    def step(self, pages: list[tuple], labels: list[np.ndarray] | None = None):
        """Probabilities for each page; with labels, (loss, gradients) instead."""
        p = self.parameters
        lengths = np.array([len(page[0]) for page in pages])
        steps, n = int(lengths.max()), len(pages)
        paths = self._bag([bag for page in pages for bag in page[0]])
        words = self._bag([bag for page in pages for bag in page[1]])
        rows = np.hstack([paths[0], words[0], np.vstack([page[2] for page in pages])])
        page_of = np.repeat(np.arange(n), lengths)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = {"right": place, "left": lengths[page_of] - 1 - place}
        runs, states = {}, np.zeros((len(rows), 2 * STATE))
        for k, way in enumerate(("right", "left")):
            x = np.zeros((steps, n, rows.shape[1]))
            x[where[way], page_of] = rows
            runs[way] = self._run(x, way, labels is not None)
            states[:, k * STATE : (k + 1) * STATE] = runs[way][0][where[way], page_of]
        probability = 1 / (1 + np.exp(-np.clip(states @ p["out"] + p["bias"], -30, 30)))
        if labels is None:
            return np.split(probability, np.cumsum(lengths)[:-1])
        y = np.concatenate(labels)
        loss = -np.mean(y * np.log(probability + 1e-9) + (1 - y) * np.log(1 - probability + 1e-9))
        error = (probability - y) / len(y)
        g = {"out": states.T @ error, "bias": np.array([error.sum()])}
        d_rows = np.zeros_like(rows)
        for k, way in enumerate(("right", "left")):
            d_hidden = np.zeros((steps, n, STATE))
            d_hidden[where[way], page_of] = error[:, None] * p["out"][k * STATE : (k + 1) * STATE]
            d_x = self._back(runs[way], d_hidden, way, g)
            d_rows += d_x[where[way], page_of]
        g["vectors"] = np.zeros_like(p["vectors"])
        for k, (_, flat, owner, scale) in enumerate((paths, words)):
            np.add.at(g["vectors"], flat, (d_rows[:, k * VECTOR : (k + 1) * VECTOR] * scale[:, None])[owner])
        return loss, g

    def _run(self, x: np.ndarray, way: str, keep: bool):
        """Hidden states of an LSTM over the first axis; with ``keep``, what the way back needs."""
        p = self.parameters
        drive = x @ p[f"in_{way}"] + p[f"bias_{way}"]
        hidden, cell = np.zeros((2, x.shape[1], STATE))
        out, kept = np.empty((*x.shape[:2], STATE)), []
        for t in range(len(x)):
            gates = drive[t] + hidden @ p[f"state_{way}"]
            opened = 1 / (1 + np.exp(-gates[:, : 3 * STATE]))
            fresh = np.tanh(gates[:, 3 * STATE :])
            into, forget, out_gate = opened[:, :STATE], opened[:, STATE : 2 * STATE], opened[:, 2 * STATE :]
            before, cell = (hidden, cell), forget * cell + into * fresh
            squashed = np.tanh(cell)
            hidden = out_gate * squashed
            out[t] = hidden
            if keep:
                kept.append((*before, into, forget, out_gate, fresh, squashed))
        return out, kept, x

    def _back(self, run, d_out: np.ndarray, way: str, g: dict[str, np.ndarray]) -> np.ndarray:
        p = self.parameters
        _, kept, x = run
        d_gates = np.empty((*x.shape[:2], 4 * STATE))
        d_hidden, d_cell = np.zeros((2, x.shape[1], STATE))
        g_state = np.zeros_like(p[f"state_{way}"])
        for t in range(len(x) - 1, -1, -1):
            hidden, cell, into, forget, out_gate, fresh, squashed = kept[t]
            d_h = d_out[t] + d_hidden
            d_c = d_cell + d_h * out_gate * (1 - squashed**2)
            d_gates[t] = np.hstack(
                [d_c * fresh * into * (1 - into), d_c * cell * forget * (1 - forget), d_h * squashed * out_gate * (1 - out_gate), d_c * into * (1 - fresh**2)]
            )
            d_cell = d_c * forget
            d_hidden = d_gates[t] @ p[f"state_{way}"].T
            g_state += hidden.T @ d_gates[t]
        g[f"state_{way}"] = g_state
        g[f"in_{way}"] = np.einsum("tnx,tng->xg", x, d_gates, optimize=True)
        g[f"bias_{way}"] = d_gates.sum((0, 1))
        return d_gates @ p[f"in_{way}"].T

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probabilities of all pages, pages of like length run together."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, page in enumerate(pages) if len(page[0])), key=lambda i: len(pages[i][0]))
        while order:
            n = max(1, min(TOGETHER, CELLS // max(1, len(pages[order[min(TOGETHER, len(order)) - 1]][0]))))
            group, order = order[:n], order[n:]
            for i, probability in zip(group, self.step([pages[i] for i in group])):
                out[i] = probability
        return out


# --- teaching

# What pages call the parts of their markup.
_TEXT_HINTS = frozenset("article main".split())
_REST_HINTS = frozenset(
    "nav header footer aside form menu dialog button select ad ads advert advertisement adsbygoogle sponsored promo banner"
    " cookie consent notice sidebar comment comments respond reply related share social newsletter subscribe breadcrumb"
    " breadcrumbs pagination popup modal".split()
)
_TEXT_DRESSES = [
    ("article",), ("main",), ("main", "article"), ("div", "class:content"), ("div", "id:content"), ("div", "class:post", "class:body"),
    ("div", "class:entry", "class:content"), ("section", "class:article"), ("div", "class:story"), ("div", "id:main"), ("div",),
    ("section",), ("div", "class:text"), ("div", "class:page", "div", "class:body"), ("article", "class:post", "section"), (),
]
_REST_DRESSES = {
    "menu": [("nav", "ul", "li"), ("div", "class:menu", "ul", "li"), ("ul", "class:navbar", "li"), ("header", "nav", "ul", "li"),
             ("div", "id:navigation", "ul", "li"), ("div", "class:breadcrumbs"), ("nav",), ("ul", "li"), ("div", "role:navigation")],
    "header": [("header",), ("div", "class:header"), ("div", "id:header"), ("header", "div", "class:logo"), ("header", "p"), ("div", "class:topbar")],
    "footer": [("footer",), ("footer", "p"), ("div", "class:footer"), ("div", "id:footer", "p"), ("div", "class:copyright"), ("footer", "div"),
               ("div", "class:bottom")],
    "advert": [("div", "class:ad"), ("div", "class:ads"), ("div", "class:advert"), ("aside", "class:ad"), ("div", "class:sponsored"), ("ins", "class:adsbygoogle"),
               ("div", "class:banner"), ("div", "class:promo", "p"), ("div", "id:advertisement", "p"), ("section", "class:advertisement", "p")],
    "sidebar": [("aside", "ul", "li"), ("aside", "p"), ("aside",), ("div", "class:sidebar", "p"), ("div", "id:sidebar", "ul", "li"), ("aside", "h3"),
                ("div", "class:related", "ul", "li"), ("section", "class:related", "h3"), ("div", "class:widget", "p"), ("aside", "div")],
    "notice": [("div", "class:cookie", "class:notice", "p"), ("div", "id:cookie", "id:banner"), ("div", "role:dialog", "p"), ("div", "class:consent"),
               ("div", "class:newsletter", "p"), ("div", "class:notice"), ("section", "class:notice", "p"), ("div", "class:popup", "p"),
               ("div", "class:share"), ("div", "class:alert"), ("div", "role:alert", "p")],
    "form": [("form",), ("form", "button"), ("form", "p"), ("form", "select", "option"), ("form", "fieldset", "legend"), ("div", "class:search", "form"),
             ("form", "class:subscribe", "button"), ("button",), ("form", "div")],
    "comment": [("div", "class:comments", "div", "class:comment", "p"), ("section", "id:comments", "p"), ("ol", "class:commentlist", "li", "p"),
                ("section", "class:comments", "article", "p"), ("div", "id:respond", "h3"), ("ul", "class:comments", "li"), ("div", "class:comment"),
                ("div", "class:comment", "class:body", "p"), ("section", "class:comments", "article", "class:comment", "p"), ("div", "id:comments", "h2"),
                ("div", "class:discussion", "p"), ("section", "class:replies", "blockquote", "p")],
}
_REST_WORDS = {
    "notice": "we use cookies to improve your experience accept all subscribe to our newsletter share this page sign up".split(),
    "form": "name email password search submit send log in register your comment".split(),
    "header": "home welcome site menu log in".split(),
    "sidebar": "related most read latest popular tags archive about".split(),
    "menu": "home news about contact archive help".split(),
}
#: Around the text and between its blocks, in the order of a page.
_BEFORE, _AMONG, _AFTER = ("notice", "header", "menu", "advert", "form"), ("advert", "sidebar", "notice", "form"), (
    "comment", "comment", "sidebar", "form", "footer", "notice", "advert", "menu",
)


def told(page: list[Block]) -> list[int] | None:
    """What the markup says: 1 for text, 0 for the rest; nothing, if no element is marked as the text."""
    names = [[part.split(":")[-1] for part in block.path] for block in page]
    if not any(set(n) & _TEXT_HINTS for n in names):
        return None
    return [int(bool(set(n) & _TEXT_HINTS) and not set(n) & _REST_HINTS) for n in names]


def redressed(page: list[Block], is_text: list[int], others: list[Block], sentences: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page's text in other markup, with other pages' rest around and between it."""
    pick = lambda options: options[int(rng.integers(len(options)))]

    def rest(kind: str) -> list[tuple[Block, int]]:
        dress, out = pick(_REST_DRESSES[kind]), []
        for _ in range(int(rng.integers(1, 9 if kind == "menu" else 4))):
            roll = rng.random()
            if kind == "comment" or (kind in ("advert", "sidebar", "notice", "footer") and roll < 0.5):
                text = pick(sentences)
            elif kind in _REST_WORDS and roll < 0.8:
                text = " ".join(pick(_REST_WORDS[kind]) for _ in range(int(rng.integers(1, 9)))).capitalize()
            else:
                text = pick(others).text
            if kind in ("comment", "advert", "sidebar", "notice", "footer") and rng.random() < 0.15:
                text = " ".join(pick(sentences) for _ in range(8))
            linked = len(text) if kind == "menu" or (kind == "sidebar" and roll > 0.4) else 0
            out.append((Block(outer + dress, text, linked), 0))
        return out

    outer = ("html", "body") + pick([(), (), ("div",), ("div", "class:wrapper"), ("div", "id:page"), ("div", "class:container")])
    dress = pick(_TEXT_DRESSES)
    out = [row for kind in _BEFORE if rng.random() < 0.5 for row in rest(kind)]
    head = True
    for block, label in zip(page, is_text):
        if not label:
            continue
        leaf = tuple(part for part in block.path[-1:] if part in ("h1", "h2", "h3", "p", "li", "blockquote", "pre", "td", "dd"))
        roll = rng.random()
        if head and rng.random() < 0.3:
            leaf = ("header", *leaf)
        elif roll < 0.3:
            leaf = pick([("p",), ("div",), ("section", "p"), ("ul", "li"), ("blockquote", "p"), ("h2",), ("figure", "figcaption"), ("table", "tr", "td"), ("ol", "li")])
        head = False
        out.append((Block(outer + dress + (leaf or ("p",)), block.text, block.linked), 1))
        if rng.random() < 0.06:
            out += [(Block(b.path[: len(outer)] + dress + b.path[len(outer) :], b.text, b.linked), 0) for b, _ in rest(pick(_AMONG))]
    out += [row for kind in _AFTER if rng.random() < 0.5 for row in rest(kind)]
    return [b for b, _ in out], [label for _, label in out]


def nested(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with further plain elements inside the path of each block, as many for each block of one path."""
    depths: dict[tuple[str, ...], tuple[int, int]] = {}
    out = []
    for block in page:
        at, more = depths.setdefault(block.path, (int(rng.integers(len(block.path) + 1)), int(rng.integers(MORE_NESTED))))
        out.append(Block(block.path[:at] + ("div",) * more + block.path[at:], block.text, block.linked))
    return out


def train(pages: list[str], passes: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Network:
    """Fits the network on pages whose markup tells.  Without any the network stays as it began."""
    rng = np.random.default_rng(seed)
    network = Network.new()
    known = [(page, labels) for page in map(blocks, pages) if page and (labels := told(page)) and 0 < sum(labels)]
    others = [b for page, labels in known for b, label in zip(page, labels) if not label] or [Block((), "menu", 4)]
    sentences = [s for page, labels in known for b, label in zip(page, labels) if label for s in re.split(r"(?<=[.!?]) ", b.text)[:6] if s] or ["text."]
    sentences += [" ".join(sentences[i : i + 3]) for i in range(0, len(sentences), 3)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.parameters.items()}
    turn = 0
    for _ in range(passes):
        order = rng.permutation(len(known))
        for at in range(0, len(order), batch):
            examples = []
            for i in order[at : at + batch]:
                page, labels = known[i]
                if rng.random() < 0.75:
                    page, labels = redressed(page, labels, others, sentences, rng)
                    page = nested(page, rng) if rng.random() < 0.4 else page
                start = int(rng.integers(max(1, len(page) - FIT_BLOCKS + 1)))
                part = slice(start, start + FIT_BLOCKS)
                examples.append((inputs(page[part]), np.array(labels[part], float)))
            _, gradients = network.step([x for x, _ in examples], [y for _, y in examples])
            turn += 1
            norm = np.sqrt(sum((g**2).sum() for g in gradients.values()))
            for name, gradient in gradients.items():
                gradient = gradient * min(1, 5 / (norm + 1e-9))
                first, second = moments[name]
                first += 0.1 * (gradient - first)
                second += 0.01 * (gradient**2 - second)
                step = (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
                network.parameters[name] -= rate * step
    return network


def fitted(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Network:
    """A network taught by at most ``fit_pages`` pages, chosen by their ids alone."""
    ids = pages.where("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    # At most fit_pages ids: a proven bound for the broadcast.
    chosen = pages.where("html IS NOT NULL").join(F.broadcast(ids), "page_id", "left_semi").select("page_id", "html")
    rows = chosen.orderBy("page_id", "html").limit(fit_pages).collect()
    return train([row["html"] for row in rows])


def extract(pages: DataFrame, network: Network) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the blocks labelled as text, in page order, joined by a space.

    A null or empty page has an empty text, as has one without blocks.  Rows are kept as they come, repeated rows
    and null ids included; other columns are left behind.
    """
    shared = pages.sparkSession.sparkContext.broadcast(network)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [blocks(page or "") for page in batch.column("html").to_pylist()]
            labels = shared.value.label([inputs(page) for page in found])
            texts = [" ".join(b.text for b, p in zip(page, ps) if p >= 0.5) for page, ps in zip(found, labels)]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(label, "page_id bigint, url string, text string, n_chars bigint")

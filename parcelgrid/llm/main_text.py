"""Main text of web pages by a recurrent block labeller.

Method: a page becomes a sequence of leaf blocks.  Each block is a vector of its hashed tag path, its hashed words and
a few measures; a bidirectional LSTM in numpy reads the whole sequence and gives every block the probability that it
belongs to the article, so a block is judged by what stands around it on the whole page.  The labeller is fitted on a
bounded sample of pages, whose blocks are labelled by the landmarks in their tag paths; parts that a sample may lack,
such as comments or notices, are put into it at random.  Planning projects hold no web pages, so the operator is
general.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.batches import keyed, map_rows
from parcelgrid.session import cut_lineage

FIT_PAGES, FIT_PAGE_BYTES = 160, 1 << 16
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 128, 16, 4, 20
INPUT = PATH_SIZE + WORD_SIZE + MEASURES
BATCH_BLOCKS = 1 << 15
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|iframe|textarea|select)(?=[\s/>])[^>]*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</?[a-z][^>]*+\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Drawings and formulas stand inside a line until they end or one of ``BREAKS`` does; ``<svg/>`` is closed at once.
FOREIGN = frozenset(("svg", "math"))
BREAKS = frozenset(
    "article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table tbody td tfoot th thead tr ul".split()
)
#: Steps of a path that are kept at either end; between them only the names of landmarks are.
OUTER, INNER = 32, 32
#: Containers of article and other parts alike, which therefore tell nothing by themselves.
WRAPS = (
    ("table", "tbody", "tr", "td"), ("table", "tr", "th"), ("dl", "dt"), ("dl", "dd"), ("pre",), ("noscript",), ("blockquote", "p"),
    ("figure", "figcaption"), ("ul", "li"), ("ol", "li"), ("h1",), ("h2",), ("h3",), ("section", "p"), ("div",), ("object",),
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an element ends by starting, up to the containers of the kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
_KEEP = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ARTICLE = frozenset("article main story post entry content articlebody maintext".split())
ASIDE = frozenset(
    "nav header footer aside form head title button dialog menu sidebar ad ads advert advertisement banner cookie "
    "cookies consent notice notices alert comment comments reply replies disqus promo sponsored related recommended "
    "share sharing social subscribe newsletter signup popup modal breadcrumb breadcrumbs pagination toolbar search "
    "login copyright legal widget footnotes".split()
)
LANDMARKS = ARTICLE | ASIDE
#: Landmarks that are elements by themselves.
ELEMENTS = ("nav", "header", "footer", "aside", "form", "dialog")


def path_to(path: tuple[str, ...], step: str) -> tuple[str, ...]:
    """The path with one more step, each step once.  A path of any depth keeps all of its landmarks and is bounded."""
    if step in path:
        return path
    path = (*path, step)
    names = [p for p in path if " " not in p and p in LANDMARKS]
    if len(path) - len(names) <= OUTER + INNER:
        return path
    middle = path[OUTER]
    kept = (n for n in middle.split(" ") if n in LANDMARKS and n not in path)
    return (*kept, *path[:OUTER], *path[OUTER + 1 :])


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: path of open elements with their class, id and role names, and clean text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = foreign = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else (), text, linked))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        linked += len(text) if links else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                close()
            continue
        tag = tag.lower()
        if tag in FOREIGN:
            if m[2]:
                foreign = max(0, foreign - 1)
            elif not m[4].rstrip().endswith("/"):
                foreign += 1
            continue
        if foreign:
            if tag not in BREAKS:
                continue
            foreign = 0
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if m[2] else 1))
            continue
        if tag == "br":
            add(" ")
            continue
        close()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in VOID:
            continue
        # a paragraph ends where another block starts, list items and cells end each other
        if stack and stack[-1][0] == "p":
            stack.pop()
        ends, keep = _ENDS.get(tag, ()), _KEEP.get(tag, ())
        while ends and any(t in ends for t, _ in stack):
            k = max(i for i, (t, _) in enumerate(stack) if t in ends)
            if any(t in keep for t, _ in stack[k + 1 :]):
                break
            del stack[k:]
        names = [w for g in _NAMES.finditer(m[4]) for w in re.split(r"[^a-z0-9]+", (g[1] or g[2] or g[3] or "").lower()) if w] if m[4] else []
        stack.append((tag, path_to(stack[-1][1] if stack else (), " ".join([tag, *names]))))
    if at < len(page):
        add(page[at:])
    close()
    return out


def landmark_label(path: tuple[str, ...]) -> float | None:
    """1 inside an article, 0 inside a part that is none, None without a landmark."""
    names = [set(step.split(" ")) for step in path]
    if any(n & ASIDE for n in names):
        return 0.0
    return 1.0 if any(n & ARTICLE for n in names) else None


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_SIZE, np.float32)
    for step in path:
        tag, *names = step.split(" ")
        for word in (tag, *(f".{n}" for n in names)):
            h = zlib.crc32(word.encode())
            v[h % PATH_SIZE] = 1.0
            v[(h >> 16) % PATH_SIZE] = 1.0
    return v


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = k = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_SIZE
        return k


_BUCKETS = _Buckets()


def block_vectors(blocks: Sequence[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    for k, b in enumerate(blocks):
        words = b.text.split(" ")
        x[k, :PATH_SIZE] = _path_vector(b.path)
        x[k, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount([_BUCKETS[w] for w in words], minlength=WORD_SIZE) / len(words)
        x[k, -MEASURES:] = np.log1p(len(words)) / 5, min(1.0, b.linked / len(b.text)), k / len(blocks), b.text[-1] in ".!?"
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over padded sequences ``(pages, blocks, INPUT)`` with a mask of the real blocks."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.15, (INPUT, 4 * HIDDEN))
            self.w[f"h{d}"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            self.w[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.w["skip"], self.w["out"], self.w["bias"] = r.normal(0, 0.15, INPUT), r.normal(0, 0.15, 2 * HIDDEN), np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; padded places hand the state on."""
        n, t, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.w[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c2)
            h2 = m * (o * th) + (1 - m) * h
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, th, m))
            h, c = h2, c2
            out[:, k] = h
        return out

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate((self._run(x, mask, "f"), self._run(x, mask, "b")), -1)
        return _sigmoid(h @ self.w["out"] + x @ self.w["skip"] + self.w["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over weighted blocks, by back propagation through the sequence."""
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], -1)
        p = _sigmoid(h @ self.w["out"] + x @ self.w["skip"] + self.w["bias"])
        dz = (p - y) * weight / max(weight.sum(), 1)
        grad = {"out": np.einsum("nt,nth->h", dz, h), "skip": np.einsum("nt,ntd->d", dz, x), "bias": np.array([dz.sum()])}
        for part, d in enumerate("fb"):
            dh_out = dz[:, :, None] * self.w["out"][part * HIDDEN : (part + 1) * HIDDEN]
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN))
            wh = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for k, h0, c0, i, f, o, g, th, m in reversed(kept[d]):
                dh = dh + dh_out[:, k]
                do, dcell = m * dh * th, dc + m * dh * o * (1 - th * th)
                di, df, dg = m * dcell * g, m * dcell * c0, m * dcell * i
                step = np.concatenate((di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), dg * (1 - g * g)), 1)
                dpre[:, k] = step
                wh += h0.T @ step
                dh = step @ self.w[f"h{d}"].T + (1 - m) * dh
                dc = m * dcell * f + (1 - m) * dcell
            grad[f"x{d}"] = np.einsum("ntd,ntz->dz", x, dpre)
            grad[f"h{d}"], grad[f"c{d}"] = wh, dpre.sum((0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.02) -> BlockLabeller:
        """``pages``: vectors, labels and weights of the blocks of each page.  Adam, pages of similar length together."""
        r = np.random.default_rng(11)
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [padded(pages[k : k + 24]) for k in range(0, len(pages), 24)]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            for b in r.permutation(len(batches)):
                grad = self.gradients(*batches[b])
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    change = rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.w[k] -= change.astype(np.float32)
        return self


def padded(pages: Sequence[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Vectors, mask, and further columns of the blocks of several pages, filled up to the longest."""
    n, t = len(pages), max(len(p[0]) for p in pages)
    out = [np.zeros((n, t, INPUT), np.float32), *(np.zeros((n, t), np.float32) for _ in pages[0])]
    for k, page in enumerate(pages):
        size = len(page[0])
        out[0][k, :size], out[1][k, :size] = page[0], 1
        for column, values in zip(out[2:], page[1:]):
            column[k, :size] = values
    return out


def training_pages(pages: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sample pages as they are, and twice more with parts from other pages put into containers of all kinds.

    In those, some articles lose their landmark or stand in containers without a name, and blocks of all parts are wrapped
    in tables, lists and the like, so that a name or a tag alone decides little and the neighbourhood of a block counts.
    """
    r = np.random.default_rng(3)
    parsed = [b for b in map(blocks_of, pages) if b]
    texts = [b.text for blocks in parsed for b in blocks][:20_000]
    tags, asides, articles = ("div", "section", "ul"), sorted(ASIDE), sorted(ARTICLE)
    out = []

    def wrapped(path: tuple[str, ...]) -> tuple[str, ...]:
        return (*path, *WRAPS[int(r.integers(len(WRAPS)))]) if r.random() < 0.4 else path

    def shortened(text: str) -> str:
        """Articles and other parts alike hold short blocks without a stop: terms, cells, code."""
        few = " ".join(text.split(" ")[: int(r.integers(1, 5))]).rstrip(".!?")
        return few if few and r.random() < 0.25 else text

    def add(blocks: list[Block], labels: list[float | None] | None = None) -> None:
        labels = labels or [landmark_label(b.path) for b in blocks]
        y = np.array([v or 0.0 for v in labels])
        out.append((block_vectors(blocks), y, np.array([float(v is not None) for v in labels])))

    def mix(blocks: list[Block]) -> tuple[list[Block], list[float | None]]:
        mixed, labels, renamed = [], [], str(r.choice(articles))
        # without a landmark of its own, under any name or none
        head = "main" if renamed == "main" else f"div {renamed}" if r.random() < 0.6 else str(r.choice(("div", "section", f"div c{r.integers(99)}")))
        for b in blocks:
            path, label = b.path, landmark_label(b.path)
            if label == 1.0:
                if r.random() < 0.8:
                    path = tuple(head if set(s.split(" ")) & ARTICLE else s for s in path)
                path = wrapped(path)
            text = shortened(b.text) if label == 1.0 else b.text
            mixed.append(Block(path, text, min(b.linked, len(text))))
            labels.append(label)
        for _ in range(int(r.integers(1, 6))):
            name, at = str(r.choice(ELEMENTS if r.random() < 0.4 else asides)), int(r.integers(0, len(mixed) + 1))
            inside = mixed[at - 1].path if at and r.random() < 0.5 else ("html", "body")
            bare = name in ELEMENTS and r.random() < 0.7
            leaf = ("p",) if r.random() < 0.5 else ()
            path = (*inside, name if bare else f"{r.choice(tags)} {name}", *leaf)
            part = [Block(wrapped(path), shortened(texts[int(r.integers(len(texts)))])) for _ in range(int(r.integers(1, 4)))]
            mixed[at:at], labels[at:at] = part, [0.0] * len(part)
        return mixed, labels

    for blocks in parsed:
        add(blocks)
        for _ in range(2):
            add(*mix(blocks))
    return out


def fit_labeller(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", fit_pages: int = FIT_PAGES,
    fit_page_bytes: int = FIT_PAGE_BYTES,
) -> BlockLabeller:
    """Labeller fitted on at most ``fit_pages`` pages of at most ``fit_page_bytes``, first by a hash of the id.

    The ids are chosen before any page is read whole, and only the sample reaches the driver.  Without pages the
    labeller stays as it was initialised.
    """
    rows = keyed(pages, page_id, html=html).filter(F.octet_length("html") <= fit_page_bytes)
    first = rows.select("key").filter("key IS NOT NULL").distinct().orderBy(F.xxhash64("key"), "key").limit(fit_pages)
    # bounded by fit_pages
    chosen = rows.join(F.broadcast(cut_lineage(first)), "key").dropDuplicates(["key"]).orderBy("key")
    sample = training_pages([r["html"] for r in chosen.select("html").collect()])
    return BlockLabeller().fit(sample) if sample else BlockLabeller()


def extract_text(
    pages: DataFrame, labeller: BlockLabeller, page_id: str = "page_id", html: str = "html", url: str = "url"
) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``, one row per input row.

    Blocks of the article are joined by a space; character references are decoded and white space is one space.  Null
    and empty pages, and pages without a block of an article, give empty text.  Whole pages are read, unclosed and cut
    off ones included; repeated rows stay repeated; extra columns are ignored.  No shuffle.
    """
    spread = pages.sparkSession.sparkContext.broadcast(labeller)

    def make():
        model = spread.value

        def work(part: pa.RecordBatch):
            parsed = [blocks_of(h or "") for h in part.column("html").to_pylist()]
            texts = [""] * len(parsed)
            order = sorted((k for k, b in enumerate(parsed) if b), key=lambda k: len(parsed[k]))
            while order:
                # as many pages of similar length as fit
                size = max(1, min(len(order), BATCH_BLOCKS // max(1, len(parsed[order[-1]]))))
                group, order = order[-size:], order[:-size]
                p = model.predict(*padded([(block_vectors(parsed[k]),) for k in group]))
                for row, k in zip(p, group):
                    texts[k] = " ".join(b.text for b, v in zip(parsed[k], row) if v >= 0.5)
            return part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())

        return work

    rows = keyed(pages, page_id, html=html, url=url)
    return map_rows(rows, "html", make, "url string, text string, n_chars bigint", page_id)

"""Main text of web pages by a bidirectional LSTM that labels every block with the whole page as its context.

A page becomes the sequence of its blocks (leaf texts) with their tag paths. A block is a vector: the pooled vectors of its path parts (tag, class and
id words), those of its hashed words, and a few numbers. The network, in numpy, reads the sequence both ways and gives each block a
probability of being main text. It is fitted to a bounded number of the given pages, labelled by their own tags and class words (pages with an article or main element first),
and to the same texts set again in other layouts, where containers carry only class names.

Defined results: null html is empty; a page without main blocks has an empty text; scripts, styles, comments in the markup and the head are never blocks; repeated rows get the same
text; blocks that score one half are main; when no page can be learned from, every block is main but those apart by tag or class word. Very long pages and paths are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspan.llm.arrays import batch_of

FIT_PAGES = 120  # pages that the network is fitted to
LAYOUTS = 6  # other layouts that each of them is set in
EPOCHS, BATCH, RATE = 8, 32, 0.01
SLOTS, WIDTH, HIDDEN = 4096, 16, 24
N_NUMBERS = 6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe title".split())
SKIPPED = frozenset(["head"])
#: Elements that a new one of the same list ends.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S
)
NAMED = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


class Block(NamedTuple):
    path: tuple[str, ...]  # parts such as ``div``, ``div.sidebar`` or ``div#top``, outermost first
    text: str
    linked: int  # characters inside links


def _parts(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for kind, a, b, c in NAMED.findall(attributes):
            mark = "#" if kind.lower() == "id" else "."
            out += [mark + w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a or b or c).lower()) if w]
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """Leaf texts in page order: runs of text that no block element or line break interrupts, white space made one, empty ones left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            own = "".join(text)
            if "&" in own:
                own = html.unescape(own)
            own = " ".join(own.split())
            if own and not any(t in SKIPPED for t, _ in stack):
                path = tuple(p for t, parts in stack if t not in INLINE for p in parts)
                out.append(Block(path, own, min(linked, len(own))))
        text.clear()
        linked = 0

    while True:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            piece = page[at : m.start() if m else len(page)]
            text.append(piece)
            if any(t == "a" for t, _ in stack):
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and any(t not in INLINE for t, _ in stack[k + 1 :]):
                        del stack[k]  # a stray end of an inline element ends no block
                    else:
                        del stack[k:]
                    break
            continue
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_END_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag == "body":
            stack = [s for s in stack if s[0] not in SKIPPED]
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, _parts(tag, attributes)))
    flush()
    return out


# -------------------------------------------------------------------------------------------------------------- learning

BOILERPLATE = frozenset("nav footer header aside form menu dialog button select".split())
MAIN = frozenset(["article", "main"])
#: Class words that layouts use for containers of main text and of everything else.
MAIN_WORDS = "content article post entry main story body text".split()
OTHER_WORDS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar links toc pagination".split(), "header": "header masthead banner top branding".split(),
    "footer": "footer bottom copyright legal colophon site-footer".split(), "aside": "sidebar aside widget related recommended trending popular promo".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay message".split(), "ad": "ad ads advert advertisement sponsored sponsor banner promo".split(),
    "form": "form login signup subscribe newsletter search".split(), "comments": "comments comment replies reply discussion respond reader-comments".split(),
    "share": "share social follow meta byline tags".split(),
}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}


#: Class and id words whose blocks are no main text, also inside an article.
APART = frozenset(
    "comments comment replies reply respond discussion ad ads advert advertisement sponsored sidebar widget related recommended cookie consent gdpr newsletter subscribe share social breadcrumb breadcrumbs".split()
)
MAIN_NAMES = frozenset("content article post entry story".split())
HOLDS_MAIN = r"(?i)<(article|main)\b"
NAMES_MAIN = r"(?i)(class|id)\s*=\s*.?[^>]*\b(content|article|post|entry|story)\b"


def _apart(parts: tuple[str, ...]) -> bool:
    return any(p in BOILERPLATE or (p[0] in ".#" and p[1:] in APART) for p in parts)


def page_labels(found: list[Block]) -> list[int] | None:
    """1 for blocks inside an article or main element, or, if the page has none, one with a class word for main text, and in nothing below it that is apart by its tag or class words.

    None if the page has no such element.
    """
    for is_main in (lambda p: p in MAIN, lambda p: p[0] in ".#" and p[1:] in MAIN_NAMES):
        labels = []
        for b in found:
            last = max((k for k, p in enumerate(b.path) if is_main(p)), default=-1)
            labels.append(int(last >= 0 and not _apart(b.path[last:])))
        if any(labels):
            return labels
    return None


def other_layout(found: list[Block], labels: list[int], strange: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The same texts set in another layout; reader comments and related teasers get paragraphs of other pages (``strange``)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    main = [b for b, y in zip(found, labels, strict=True) if y]
    rest = [b for b, y in zip(found, labels, strict=True) if not y] or [Block((), "Home", 4)]

    def container(kind: str) -> tuple[str, ...]:
        if kind == "main":
            tag = pick(["div", "section", "main", "article", "td", "div", "div"])
            words = [pick(MAIN_WORDS) for _ in range(int(rng.integers(0 if tag in MAIN else 1, 3)))]
        else:
            tag = SEMANTIC[kind] if kind in SEMANTIC and rng.random() < 0.5 else pick(["div", "div", "section", "ul", "aside", "td"])
            words = [pick(OTHER_WORDS[kind]) for _ in range(int(rng.integers(0 if tag in BOILERPLATE else 1, 3)))]
        return (tag, *(pick([".", ".", "#"]) + w for w in words for w in w.split("-")))

    def noise(kind: str) -> list[Block]:
        own, n = container(kind), int(rng.integers(1, 7))
        if kind in ("comments", "aside", "ad", "notice") and rng.random() < 0.7:
            texts = [pick(strange) for _ in range(int(rng.integers(1, 5)))]
        else:
            texts = [pick(rest).text for _ in range(n)]
        item = pick([("p",), ("li",), ("div",), (), ("ul", "li"), ("div", ".item"), ("h3",), ("label",), ("span",)])
        if kind == "comments" and rng.random() < 0.5:
            item = (pick(["div", "li", "article"]), ".comment", "p")
        return [Block(outer + own + item, t, len(t) if kind in ("nav", "aside", "share", "footer") and rng.random() < 0.6 else 0) for t in texts]

    outer = (*pick([("html", "body"), ("html", "body"), ("body",), ()]), *pick([(), ("div", "#page"), ("div", ".wrapper"), ("div", ".container"), ("table", "tr")]))
    kinds = list(OTHER_WORDS)
    ahead = [k for k in kinds if rng.random() < 0.45 and k not in ("comments", "footer")]
    after = [k for k in kinds if rng.random() < 0.5]
    inside = [k for k in ("ad", "aside", "share", "notice", "form", "nav") if rng.random() < 0.15]
    seq: list[tuple[Block, int]] = [(b, 0) for k in ahead for b in noise(k)]
    own = container("main")
    bare = rng.random() < 0.1
    cut = sorted(int(x) for x in rng.integers(0, len(main) + 1, len(inside)))
    for k, b in enumerate(main):
        for c, kind in zip(cut, inside, strict=True):
            if c == k:
                seq += [(Block(outer + own + n.path[len(outer) :], n.text, n.linked), 0) for n in noise(kind)]
        leaf = ("h1",) if k == 0 and rng.random() < 0.5 else pick([("p",), ("p",), ("p",), ("div",), ("blockquote", "p"), ("ul", "li"), ("h2",), ("pre",), ()])
        text = b.text if rng.random() < 0.85 else " ".join(b.text.split()[: int(rng.integers(1, 5))])  # paragraphs of a few words
        seq.append((Block(outer + (() if bare else own) + leaf, text, 0), 1))
    seq += [(b, 0) for k in after for b in noise(k)]
    return [b for b, _ in seq], [y for _, y in seq]


def _slot(part: str) -> int:
    return zlib.crc32(part.encode()) % SLOTS


class Encoded(NamedTuple):
    """Blocks of pages one after the other."""

    paths: np.ndarray  # slots of path parts of all blocks
    n_paths: np.ndarray  # how many each block has (at least one)
    words: np.ndarray
    n_words: np.ndarray
    numbers: np.ndarray


def encode(pages: list[list[Block]], cache: dict[str, int] | None = None, known: set[str] | None = None) -> Encoded:
    """Every different part of a path counts once, however deep it is nested; parts that the network hasn't met (none of ``known``) say nothing."""
    cache = {} if cache is None else cache
    paths: list[int] = []
    words: list[int] = []
    n_paths: list[int] = []
    n_words: list[int] = []
    numbers = []
    for found in pages:
        for k, b in enumerate(found):
            named = [p for p in b.path if p[0] in ".#"]
            tags = [p for p in b.path if p[0] not in ".#"]
            parts = [*tags, *named]
            if tags:
                parts.append("last:" + tags[-1])
            own = []
            for p in dict.fromkeys(parts):
                if p[0] in ".#":
                    p = p[1:] + "!"  # class and id words count alike
                s = cache.get(p)
                if s is None:
                    s = cache[p] = _slot(p) if known is None or p in known else -1
                if s >= 0:
                    own.append(s)
            own = own or [_slot("none")]
            paths += own
            n_paths.append(len(own))
            w = [zlib.crc32(x) % SLOTS for x in b.text.encode().split()]
            words += w
            n_words.append(len(w))
            n = len(b.text)
            numbers.append((np.log1p(n) / 5, np.log1p(len(w)) / 4, b.linked / n, min(1.0, sum(map(b.text.count, ".,;!?")) / max(1, len(w)) * 3), k / len(found), min(1.0, len(found) / 100)))
        if len(cache) > 100_000:
            cache.clear()
    as_int = lambda x: np.array(x, np.int64)
    return Encoded(as_int(paths), as_int(n_paths), as_int(words), as_int(n_words), np.array(numbers, float).reshape(-1, N_NUMBERS))


def _pooled(table: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the vectors over the root of their number, so that one part of a long path still counts."""
    return np.add.reduceat(table[ids], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]


class Network:
    """Vectors of path parts and words, an LSTM each way, and a logistic output; fitted by Adam."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size, gates = 2 * WIDTH + N_NUMBERS, 4 * HIDDEN
        self.p = {"path": rng.normal(0, 0.3, (SLOTS, WIDTH)), "word": rng.normal(0, 0.1, (SLOTS, WIDTH)), "out": rng.normal(0, 0.1, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, size**-0.5, (size, gates)), f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, gates)), f"c{d}": np.zeros(gates)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

        self.known: set[str] = set()  # path parts of the pages that it was fitted to

    def vectors(self, e: Encoded) -> np.ndarray:
        return np.concatenate([_pooled(self.p["path"], e.paths, e.n_paths), _pooled(self.p["word"], e.words, e.n_words), e.numbers], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (step, page, unit) of one direction; x is (step, page, feature)."""
        steps, pages, _ = x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((pages, HIDDEN))
        out = np.zeros((steps, pages, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tc = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[t] = h
        return out

    def _back(self, keep: list, x: np.ndarray, grad: np.ndarray, d: str, g: dict) -> np.ndarray:
        dx = np.zeros_like(x)
        dh = dc = 0.0
        wh, wx = self.p[f"h{d}"], self.p[f"x{d}"]
        for t, i, f, o, gg, c, tc, h, m in reversed(keep):
            dh = dh + grad[t]
            do = np.where(m, dh, 0)
            dn = do * o * (1 - tc**2) + np.where(m, dc, 0)
            z = np.concatenate([dn * gg * i * (1 - i), dn * c * f * (1 - f), do * tc * o * (1 - o), dn * i * (1 - gg**2)], axis=1)
            g[f"h{d}"] += h.T @ z
            g[f"x{d}"] += x[t].T @ z
            g[f"c{d}"] += z.sum(0)
            dx[t] = z @ wx.T
            dh = z @ wh.T + np.where(m, 0, dh)
            dc = dn * f + np.where(m, 0, dc)
        return dx

    @staticmethod
    def _grid(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        page = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        x, mask = np.zeros((int(lengths.max()), len(lengths), v.shape[1])), np.zeros((int(lengths.max()), len(lengths)), bool)
        x[step, page], mask[step, page] = v, True
        return x, mask, (step, page)

    def predict(self, e: Encoded, lengths: np.ndarray) -> np.ndarray:
        """Probability of each block; ``lengths`` are the numbers of blocks of the pages, none 0."""
        x, mask, at = self._grid(self.vectors(e), lengths)
        z = np.concatenate([self._run(x, mask, "f")[at], self._run(x, mask, "b")[at]], axis=1) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 7) -> "Network":
        rng = np.random.default_rng(seed)
        m, v, k = ({n: np.zeros_like(w) for n, w in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), BATCH):
                own = [pages[i] for i in order[lo : lo + BATCH]]
                met: dict[str, int] = {}
                e, lengths = encode([b for b, _ in own], met), np.array([len(b) for b, _ in own])
                self.known |= met.keys()
                y = np.concatenate([np.array(t, float) for _, t in own])
                vectors = self.vectors(e)
                heard = 2.0 * (rng.random((len(vectors), 1)) < 0.5)  # words are left out at random, so that they don't stand in for the path
                vectors[:, WIDTH : 2 * WIDTH] *= heard
                x, mask, at = self._grid(vectors, lengths)
                keep: dict[str, list] = {"f": [], "b": []}
                states = np.concatenate([self._run(x, mask, d, keep[d])[at] for d in "fb"], axis=1)
                p = 1 / (1 + np.exp(-np.clip(states @ self.p["out"] + self.p["bias"], -30, 30)))
                dz = (p - y) / len(y)
                g = {n: np.zeros_like(w) for n, w in self.p.items()}
                g["out"], g["bias"] = states.T @ dz, np.array([dz.sum()])
                dv = np.zeros((len(y), x.shape[2]))
                for j, d in enumerate("fb"):
                    grad = np.zeros((*mask.shape, HIDDEN))
                    grad[at] = dz[:, None] * self.p["out"][None, j * HIDDEN : (j + 1) * HIDDEN]
                    dv += self._back(keep[d], x, grad, d, g)[at]
                np.add.at(g["path"], e.paths, np.repeat(dv[:, :WIDTH] / np.sqrt(e.n_paths)[:, None], e.n_paths, axis=0))
                np.add.at(g["word"], e.words, np.repeat(heard * dv[:, WIDTH : 2 * WIDTH] / np.sqrt(e.n_words)[:, None], e.n_words, axis=0))
                k += 1
                for n, w in self.p.items():
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                    w -= RATE * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)
        return self


def fit(pages: DataFrame, n_pages: int = FIT_PAGES, layouts: int = LAYOUTS) -> Network | None:
    """Fit to at most ``n_pages`` of ``pages`` (page_id, html), by order of an md5 of their id."""
    order = F.md5(F.coalesce(pages["page_id"].cast("string"), F.lit("")))
    tagged = pages["html"].rlike(HOLDS_MAIN)
    usable = pages.where(tagged | pages["html"].rlike(NAMES_MAIN))
    few = usable.select(F.concat(F.when(tagged, "a").otherwise("b"), order).alias("o"), pages["page_id"].alias("p")).orderBy("o", "p").limit(n_pages)
    some = pages.join(few, pages["page_id"].eqNullSafe(few["p"])).select(few["o"], pages["html"].alias("html")).distinct()
    sample = [blocks(r["html"]) for r in sorted(some.collect(), key=lambda r: (r["o"], r["html"] or ""))]
    known = [(b, y) for b in sample if b and (y := page_labels(b)) is not None]
    if not known:
        return None
    rng = np.random.default_rng(7)
    strange = [b.text for found, labels in known for b, y in zip(found, labels, strict=True) if y]
    more = [other_layout(b, y, strange, rng) for b, y in known for _ in range(layouts)]
    return Network().fit([*known * 4, *more])  # the layout that the pages have counts more than each other one


def main_texts(pages: list[str | None], network: Network | None, cache: dict[str, int]) -> list[str]:
    """Main text of each page; pages of like numbers of blocks run together."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(found[order[hi]]) <= 8192:
            hi += 1
        own = order[lo:hi]
        if network is None:
            p = np.array([0.0 if _apart(b.path) else 1.0 for i in own for b in found[i]])
        else:
            p = network.predict(encode([found[i] for i in own], cache, network.known), np.array([len(found[i]) for i in own]))
        at = 0
        for i in own:
            out[i] = " ".join(b.text for b, q in zip(found[i], p[at : at + len(found[i])], strict=True) if q >= 0.5)
            at += len(found[i])
        lo = hi
    return out


def extract(pages: DataFrame, network: Network | None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                texts = main_texts(b.column("html").to_pylist(), network, cache)
                yield batch_of(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

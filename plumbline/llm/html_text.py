"""8. HTML extraction: a recurrent network labels a page's leaf blocks as main text or not.

A page becomes the sequence of its leaf blocks (text between block-level tags; scripts,
styles, head, comments and the like never are blocks). A block's vector holds its hashed tag
path with classes and ids, its hashed words, and a few shares. A bidirectional LSTM in numpy
reads the whole sequence, so that each block is labelled with the page's context.

The network is trained here, on the driver and once per process, on PAGES synthetic pages
made from a seeded grammar of layouts (`synthetic_page`); the bound is the parameter. Its
weights, some hundred kilobytes whatever the input, are broadcast. Pages are labelled where
they lie: one pass, no shuffle, a page at most with its own length in memory.

Defined results: null or empty html gives an empty text; a page without main text gives an
empty text; broken or unclosed tags close with their parents; raw text (RAW) without its end
tag reaches to the end of the page, as in browsers; an unclosed head ends at the first tag or
text that is no head content, other skipped elements without an end tag with their parent, or
at a block that cannot be theirs; repeated rows get a row each; an empty table gives an empty
result; extra columns are ignored. Very long pages take time in proportion to their length, however
they are broken: markup is found by one scanner that moves forward only, and the open elements'
names are kept as counts.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import ship

PATH, WORDS, SHARES, HIDDEN = 128, 32, 6, 16
#: Synthetic training pages, and passes over them.
PAGES, EPOCHS = 700, 5
#: Elements whose content is no markup, and those that never are blocks.
RAW = frozenset("script style iframe textarea".split())
SKIPPED = RAW | frozenset("noscript template head title svg object select".split())
#: What a head may hold, and tags that end an unclosed skipped element that cannot hold them.
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main nav ol p pre section table ul".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr del ins big strike".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_name = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: Of a tag what comes before its end or an unclosed quotation, by the quotation marks that count.
_inside = {
    "\"'": re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+"""), '"': re.compile(r"""[^">]*+(?:"[^"]*+"[^">]*+)*+"""),
    "'": re.compile(r"""[^'>]*+(?:'[^']*+'[^'>]*+)*+"""), "": re.compile(r"[^>]*+"),
}
_named = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_part = re.compile(r"[A-Za-z]+")
_space = re.compile(r"\s+")


#: Raw text goes to its end tag; else a start tag of the same name, a body or the head's end come first where the end tag is missing.
_ends = {t: re.compile(rf"</{t}\s*>" if t in RAW else rf"<(?:(/){t}\s*>|(?:{t}|body|/head)(?=[\s/>]))", re.I) for t in SKIPPED}


class Scanner:
    """Finds markup from left to right. What a search has found out about the rest of the page is kept, so that
    unclosed tags, quotations and sections do not make it look through the rest again."""

    def __init__(self, page: str):
        self.page, self.marks = page, "\"'"
        self.known: dict[str, tuple[int, re.Match | None]] = {}
        self.next: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Place of a string from `at` on; the page's length where there is none."""
        if self.next.get(what, -1) < at:
            found = self.page.find(what, at)
            self.next[what] = len(self.page) if found < 0 else found
        return self.next[what]

    def end_of_skipped(self, tag: str, at: int) -> re.Match | None:
        first, found = self.known.get(tag, (len(self.page) + 1, None))
        if first > at or found and found.start() < at:
            found = _ends[tag].search(self.page, at)
            self.known[tag] = (at, found)
        return found

    def end_of_tag(self, at: int) -> int:
        """Place of the > that ends a tag. A quotation mark without its partner is no quotation, here and later on."""
        while self.find(">", at) < len(self.page):
            end = _inside[self.marks].match(self.page, at).end()
            if end < len(self.page) and self.page[end] == ">":
                return end
            self.marks = self.marks.replace(self.page[end], "") if end < len(self.page) else self.marks[:-1]
        return len(self.page)

    def token(self, at: int) -> tuple[int, int, str, str]:
        """(first, end, kind or name, rest) of the next piece of markup: kind is ! for what is passed over and [ for
        the text rest; a name starts with / in end tags."""
        page = self.page
        while (at := self.find("<", at)) < len(page):
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, min(end + 3, len(page)), "!", ""
            if page.startswith("<![CDATA[", at) and (end := self.find("]]>", at + 9)) < len(page):
                return at, end + 3, "[", page[at + 9 : end]
            if page[at + 1 : at + 2] in ("!", "?") and at + 1 < len(page):
                if (end := self.find(">", at)) < len(page):
                    return at, end + 1, "!", ""
            elif m := _name.match(page, at + 1):
                if (end := self.end_of_tag(m.end())) < len(page):
                    return at, end + 1, m[0].lower(), page[m.end() : end]
            at += 1
        return len(page), len(page), "", ""


class Stack:
    """The open elements: where each name is open, the bits of their names' hashes, and each one's nearest parent that is not inline."""

    def __init__(self):
        self.tags: list[str] = []
        self.bits: list[list[int]] = []
        self.parents: list[int] = []
        self.open: dict[str, list[int]] = {}
        self.counts = [0] * PATH
        self.mask = 0

    def push(self, tag: str, names: list[str]) -> None:
        at = len(self.tags)
        up = at - 1
        self.parents.append(self.parents[up] if up >= 0 and self.tags[up] in INLINE else up)
        self.tags.append(tag)
        self.open.setdefault(tag, []).append(at)
        bits = [_hashed(n, PATH) for n in names if n not in ("html", "body")]
        self.bits.append(bits)
        for b in bits:
            self.counts[b] += 1
            self.mask |= 1 << b

    def leave(self, n: int) -> None:
        while len(self.tags) > n:
            self.open[self.tags.pop()].pop()
            self.parents.pop()
            for b in self.bits.pop():
                self.counts[b] -= 1
                if not self.counts[b]:
                    self.mask &= ~(1 << b)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of that name, -1 without one."""
        found = self.open.get(tag)
        return found[-1] if found else -1

    def end_of_skipped(self, hidden: int, tag: str) -> int | None:
        """How much of the stack a start tag leaves that ends the unclosed skipped element at hidden; None when it does not."""
        name = self.tags[hidden]
        if name == "head":
            return None if tag in HEAD else hidden
        up = self.parents[hidden]
        parent = self.tags[up] if up >= 0 else ""
        if parent in CLOSES.get(tag, ()) and all(self.last(t) <= hidden for t in CLOSES[tag] | {"ul", "ol", "dl", "table"}):
            return hidden
        if tag in BLOCK and parent == "p":
            return up
        return hidden if tag in BLOCK and (name in ("svg", "select", "title") or parent in ("", "html", "body")) else None


def blocks_of(page: str) -> list[tuple[str, int, int]]:
    """(text, bits of the hashed names from the root, characters within links) of each leaf block in page order."""
    out: list[tuple[str, int, int]] = []
    stack, scanner = Stack(), Scanner(page)
    texts: list[str] = []
    linked = at = 0
    path: int | None = None
    hidden: int | None = None  # place in the stack of the outermost skipped element

    def flush() -> None:
        nonlocal texts, linked, path
        text = _space.sub(" ", html.unescape("".join(texts))).strip()
        if text:
            out.append((text, path or 0, linked))
        texts, linked, path = [], 0, None

    def leave(n: int) -> None:
        nonlocal hidden
        stack.leave(n)
        if hidden is not None and n <= hidden:
            hidden = None

    def take(s: str) -> None:
        nonlocal linked, path
        if hidden is not None and len(stack.tags) == hidden + 1 and stack.tags[hidden] == "head" and s.strip():
            leave(hidden)
        if s and hidden is None:
            texts.append(s)
            if s.strip():
                path = stack.mask if path is None else path
                if stack.last("a") >= 0:
                    linked += len(s.strip())

    while at < len(page):
        first, end, tag, rest = scanner.token(at)
        take(page[at:first])
        at = end
        if tag in ("", "!", "["):
            if tag == "[":
                take(html.escape(rest))
            continue
        if tag[0] == "/":
            own = stack.last(tag[1:])
            if tag[1:] not in INLINE and (hidden is None or 0 <= own < hidden):
                flush()
            if own >= 0:
                leave(own)
            continue
        if hidden is not None:
            n = stack.end_of_skipped(hidden, tag)
            if n is not None:
                leave(n)
        empty = rest.rstrip().endswith("/")
        if tag in SKIPPED:
            if empty:
                continue
            found = scanner.end_of_skipped(tag, at)
            if tag in RAW:
                at = found.end() if found else len(page)
            elif tag != "head" and found and found[1]:
                at = found.end()
            else:
                hidden = len(stack.tags) if hidden is None else hidden
                stack.push(tag, [])
            continue
        if tag not in INLINE and hidden is None:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES:
            while stack.tags and stack.tags[-1] in CLOSES[tag] | INLINE and any(t in CLOSES[tag] for t in stack.tags[-8:]):
                stack.leave(len(stack.tags) - 1)
        if not empty:
            names = [tag]
            for a in _named.finditer(rest):
                names += [f".{w.lower()}" for w in _part.findall(a[1] or a[2] or a[3] or "")]
            stack.push(tag, names)
    flush()
    return out


def _hash(s: str, size: int) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % size


_hashed = lru_cache(maxsize=100_000)(_hash)


def vectors(blocks: list[tuple[str, int, int]]) -> np.ndarray:
    """A row per block."""
    x = np.zeros((len(blocks), PATH + WORDS + SHARES), np.float32)
    for i, (text, path, linked) in enumerate(blocks):
        x[i, :PATH] = np.unpackbits(np.frombuffer(path.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        words = text.lower().split(" ")
        x[i, PATH : PATH + WORDS] = np.bincount([_hashed(w, WORDS) for w in words], minlength=WORDS) / len(words)
        n = len(text)
        x[i, PATH + WORDS :] = (np.log1p(n) / 8, min(1.0, linked / n), i / len(blocks), text[-1] in ".!?", sum(map(str.isdigit, text)) / n, np.log1p(len(blocks)) / 8)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output, over padded batches (pages, blocks, features)."""

    def __init__(self, seed: int = 1):
        r, f = np.random.default_rng(seed), PATH + WORDS + SHARES
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.1, (f, 4 * HIDDEN))
            self.w[f"h{d}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.w["o"], self.w["c"] = r.normal(0, 0.2, (2 * HIDDEN,)), np.zeros(1)

    def _run(self, x, mask, d, keep):
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        z_all, out, tape = x @ self.w[f"x{d}"] + self.w[f"b{d}"], np.zeros((n, t, HIDDEN)), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_all[:, k] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[:, k, None]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            if keep:
                tape.append((k, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
            out[:, k] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.w["o"] + self.w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = (_sigmoid(both @ self.w["o"] + self.w["c"]) - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,nth->h", error, both), "c": np.array([error.sum()])}
        for at, d in enumerate("fb"):
            down = error[:, :, None] * self.w["o"][at * HIDDEN : (at + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
            dh, dc, wh = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN)), np.zeros_like(self.w[f"h{d}"])
            for k, h, c, i, f, o, g, tc, m in reversed(runs[d][1]):
                total = dh + down[:, k]
                cell = dc + np.where(m, total * o * (1 - tc * tc), 0)
                dz = np.where(m, np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), total * tc * o * (1 - o), cell * i * (1 - g * g)], axis=1), 0)
                dz_all[:, k] = dz
                wh += h.T @ dz
                dh, dc = np.where(m, dz @ self.w[f"h{d}"].T, total), np.where(m, cell * f, dc)
            grads |= {f"x{d}": np.einsum("ntf,ntz->fz", x, dz_all), f"h{d}": wh, f"b{d}": dz_all.sum((0, 1))}
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((len(pages), t, pages[0].shape[1]), np.float32), np.zeros((len(pages), t), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def synthetic_page(r: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """(html, leaf blocks with whether they are main text): a page of a random layout in random syllables."""
    parts: list[str] = []
    truth: list[tuple[str, bool]] = []
    syllables = [a + b for a in ("", "b", "ch", "d", "er", "g", "l", "m", "n", "qu", "r", "s", "sch", "st", "t", "th", "v", "w") for b in ("a", "e", "é", "i", "o", "ou", "u", "ü", "an", "ing", "ion")]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize()

    def leaf(tag: str, main: bool, lo: int, hi: int, extra: str = "", end: str = "") -> None:
        s = text(lo, hi) + end
        truth.append((s, main))
        inner = s
        if r.random() < 0.15 and " " in s:
            a, b = s.split(" ", 1)
            inner = f"{a} <b>{b}</b>"
        parts.append(f"<{tag}{extra}>{inner}" + (f"</{tag}>" if r.random() < 0.9 or tag != "p" else ""))

    def links(n: int, items: bool) -> None:
        for _ in range(n):
            s = text(1, 3)
            truth.append((s, False))
            parts.append(f'<li><a href="/{s}">{s}</a></li>' if items else f'<div><a href="#">{s}</a></div>')

    def box(opening: str, kind: str) -> None:
        tag = opening.split()[0]
        parts.append(f"<{opening}>")
        if kind == "menu":
            parts.append("<ul>")
            links(r.randint(2, 9), True)
            parts.append("</ul>")
        elif kind == "short":
            for _ in range(r.randint(1, 3)):
                if r.random() < 0.6:
                    leaf(r.choice(["p", "div", "span"]) if r.random() < 0.5 else "p", False, 2, 25, end=r.choice(["", "."]))
                else:
                    s = text(2, 20) + r.choice(["", "."])
                    truth.append((s, False))
                    parts.append(s + "<br>")
        elif kind == "form":
            leaf("label", False, 1, 4)
            parts.append('<input type="text"><br>')
            leaf("button", False, 1, 2)
        elif kind == "comments":
            leaf("h3", False, 1, 3)
            for _ in range(r.randint(1, 5)):
                parts.append(f'<{r.choice(["div", "li"])} class="{r.choice(["comment", "reply", "comment-body"])}">')
                leaf("p", False, 4, 40, end=".")
                parts.append("</div>")
        parts.append(f"</{tag}>")

    before = [("nav", "menu"), ("header", "short"), ('div class="header"', "short"), ('div class="menu"', "menu"), ('div id="nav"', "menu"), ('div class="ad"', "short"), ('div class="advert banner"', "short"), ('div class="cookie-notice"', "short"), ('div class="notice"', "short"), ("form", "form"), ('aside class="sidebar"', "menu"), ('div class="breadcrumb"', "menu")]
    after = [("footer", "short"), ('div class="footer"', "short"), ('section class="comments"', "comments"), ('div id="comments"', "comments"), ("aside", "short"), ('div class="sidebar widget"', "menu"), ('div class="related"', "menu"), ('div class="share social"', "menu"), ('div class="newsletter subscribe"', "form"), ('div class="ads sponsored"', "short"), ('div class="popup modal"', "short"), ('div class="disclaimer"', "short")]
    parts.append(f"<html><head><title>{text(2, 6)}</title><script>var a = 1;</script></head><body>")
    for opening, kind in r.sample(before, r.randint(0, 5)):
        box(opening, kind)
    home = r.choice(["article"] * 4 + ["main", 'div class="content"', 'div id="main"', 'div class="post-body entry"', 'section class="article"', "main"])
    parts.append(f"<{home}>")
    if r.random() < 0.85:
        leaf(r.choice(["h1", "h1", "h2"]), True, 1, 12, end=r.choice(["", "."]))
    for _ in range(r.randint(0, 14)):
        pick = r.random()
        if pick < 0.72:
            leaf("p", True, 1, 110, end=".")
        elif pick < 0.80:
            s = text(2, 25) + "."
            truth.append((s, True))
            parts.append(f"<p><b>{s}<br>")
        elif pick < 0.86:
            leaf(r.choice(["h2", "h3", "blockquote", "pre"]), True, 1, 10)
        elif pick < 0.92:
            parts.append("<ul>")
            for _ in range(r.randint(1, 4)):
                leaf("li", True, 2, 15, end=".")
            parts.append("</ul>")
        else:
            box(*r.choice([b for b in before + after if b[0].startswith(("div", "aside", "form")) and b[1] != "comments"]))
    parts.append(f"</{home.split()[0]}>")
    for opening, kind in r.sample(after, r.randint(0, 5)):
        box(opening, kind)
    parts.append("</body></html>")
    return "".join(parts), truth


def training_pages(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of synthetic pages; a block is main text when its text is."""
    r, out = random.Random(seed), []
    while len(out) < n:
        page, truth = synthetic_page(r)
        main = {_space.sub(" ", s).strip() for s, m in truth if m}
        blocks = blocks_of(page)
        if blocks:
            out.append((vectors(blocks), np.array([b[0] in main for b in blocks], float)))
    return out


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """The network after Adam steps over batches of pages of like length; the same each time."""
    data = sorted(training_pages(pages, seed), key=lambda p: len(p[0]))
    batches = [data[i : i + 16] for i in range(0, len(data), 16)]
    net, r, step = Labeller(), random.Random(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for _ in range(epochs):
        r.shuffle(batches)
        for batch in batches:
            x, mask = padded([b[0] for b in batch])
            y = np.zeros(mask.shape)
            for i, b in enumerate(batch):
                y[i, : len(b[1])] = b[1]
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.w[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: its main blocks, joined by single spaces."""
    found = [blocks_of(p) for p in pages]
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    out = [""] * len(pages)
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 64 and (hi - lo + 1) * len(found[order[hi]]) <= 8192:
            hi += 1
        some = order[lo:hi]
        x, mask = padded([vectors(found[i]) for i in some])
        for i, row in zip(some, net.scores(x, mask), strict=True):
            out[i] = " ".join(b[0] for b, s in zip(found[i], row, strict=False) if s > 0)
        lo = hi
    return out


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    net = spark.sparkContext.broadcast(trained())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = main_texts(net.value, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return rows.mapInArrow(label, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

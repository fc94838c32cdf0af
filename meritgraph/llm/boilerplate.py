"""Main text of web pages by a recurrent block labeller.

A page becomes its leaf blocks in order: runs of text between block-level tags, each with the tags, classes, ids and
roles on its path and its words, hashed into one-hot ranges, and a few lengths. A bidirectional LSTM in numpy reads the
whole sequence in both directions and gives each block a probability of belonging to the article, so a block is judged
by the blocks around it, however far. It is trained here, on ``PAGES`` invented pages of many layouts that are labelled
as they are made (a documented, fixed bound); training takes some seconds on the driver and its few thousand weights go
to the tasks with the function.

Scripts, styles, titles and other contents that a page never shows are no blocks. Character references are decoded,
white space inside a block becomes one space, kept blocks are joined by a line feed. Null and empty pages give an empty
text, as do pages without an article. Broken markup is read as browsers do in the main: unclosed elements end with
their parents, an unclosed comment or script hides the rest, a tag without its ``>`` ends at the next ``<``, and signs
inside quoted attributes mean nothing. Markup is read in one pass whose time grows with the page, however deep or broken
it is. Repeated rows are extracted alike; other columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meritgraph.llm.common import table

#: A tag after its ``<``: slash, name, and attributes with quoted values taken whole. No part gives back what it took.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+|[\"'])*+)>?")
#: Elements whose contents are never shown, and how each ends.
UNSEEN = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style title noscript template textarea select svg iframe object".split()}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[^a-z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start of the key ends an open element of the first set, up to the nearest of the second.
ENDS = {t: (frozenset(["p"]), frozenset("div section article li td th body main aside header footer nav form blockquote".split())) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
ENDS |= {"li": (frozenset(["li"]), frozenset(["ul", "ol"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"]))}
ENDS |= {"dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]))}

PATHS, WORDS, LENGTHS = 1024, 512, 6
HIDDEN = 16
FEATURES = 1 << 16
PAGES, EPOCHS, BATCH, RATE = 800, 10, 20, 0.02
SEED = 7


@lru_cache(maxsize=100_000)
def _place(kind: int, word: str) -> int:
    size, base = ((PATHS, 0), (WORDS, PATHS))[kind]
    return base + zlib.crc32(word.encode("utf-8", "replace")) % size


class _Open:
    """The elements that are open: each with the hashed tags and names on its path, which it shares with its parent where
    it adds none, and for each tag its places, so that nothing is ever searched for."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[tuple[int, ...]] = []
        self.places: dict[str, list[int]] = {}

    def path(self) -> tuple[int, ...]:
        return self.paths[-1] if self.paths else ()

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, names: list[str]) -> None:
        path = self.path()
        new = dict.fromkeys(p for p in (_place(0, x) for x in names) if p not in path)
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.paths.append((*path, *new) if new else path)

    def cut(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.places[tag].pop()
        del self.tags[k:], self.paths[k:]


def blocks(page: str | None) -> list[tuple[tuple[int, ...], str, float]]:
    """(hashed tags and names on the path, text, share of its characters in links) of each block with text."""
    out: list[tuple[tuple[int, ...], str, float]] = []
    opened = _Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((opened.path(), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened.places.get("a"):
                linked += len(text.strip())

    page, at, seen = page or "", 0, 0  # up to ``at`` all is read, up to ``seen`` there is no tag
    while (begin := page.find("<", seen)) >= 0:
        if page.startswith(("<!", "<?"), begin):
            end = page.find("-->", begin + 2) if page.startswith("<!--", begin) else page.find(">", begin)
            add(page[at:begin])
            at = seen = len(page) if end < 0 else end + (3 if page.startswith("--", end) else 1)
            continue
        m = TAG.match(page, begin + 1)
        if not m:  # a sign in the text
            seen = begin + 1
            continue
        add(page[at:begin])
        tag, at = m[2].lower(), m.end()
        seen = at
        if tag in UNSEEN and not m[1]:
            if not (tag == "svg" and m[3].endswith("/")):
                closed = UNSEEN[tag].search(page, at)
                at = seen = closed.end() if closed else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            if (k := opened.last(tag)) >= 0:
                opened.cut(k)
            continue
        if tag in ENDS:
            closes, bounds = ENDS[tag]
            if (k := max(map(opened.last, closes))) > max(map(opened.last, bounds)):
                opened.cut(k)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            names = [x for found in NAMES.findall(m[3]) for x in PART.split("".join(found).lower()) if x] if m[3] else []
            opened.push(tag, [f"<{tag}", *names])
    add(page[at:])
    flush()
    return out


def features(found: list[tuple[tuple[int, ...], str, float]]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each block the places of its hashed features, their weights (a word's: its share of the block's words), and its
    lengths. All words of the whole block count."""
    places, weights, rest = [], [], np.zeros((len(found), LENGTHS), dtype=np.float32)
    for i, (path, text, linked) in enumerate(found):
        words = text.lower().split()
        own = Counter(_place(1, w.strip(".,:;!?()")) for w in words)
        places.append(np.array([*path, *own], dtype=np.int64))
        weights.append(np.array([1.0] * len(path) + [c / len(words) for c in own.values()], dtype=np.float32))
        ends = sum(w[-1] in ".!?" for w in words)
        rest[i] = (np.log1p(len(text)) / 5, linked, ends / (len(words) or 1), np.log1p(len(words)) / 4, i / len(found), 1.0)
    return places, weights, rest


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, rng: np.random.Generator) -> None:
        h = HIDDEN
        small = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
        self.w = {}
        for side in "fb":
            self.w |= {f"e{side}": np.zeros((PATHS + WORDS, 4 * h), np.float32), f"x{side}": small(LENGTHS, 4 * h), f"u{side}": small(h, 4 * h), f"o{side}": small(h, 1)}
            self.w[f"x{side}"][-1, h : 2 * h] += 1  # the forget gate begins open
        self.w["o"] = np.zeros(1, np.float32)

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        h = HIDDEN
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
        return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])

    def _inputs(self, side: str, pages: list, length: int) -> np.ndarray:
        """(block, page, gate) sums of embeddings; backwards for the second direction. Padding is zero."""
        out = np.zeros((length, len(pages), 4 * HIDDEN), dtype=np.float32)
        e, x = self.w[f"e{side}"], self.w[f"x{side}"]
        for j, (places, weights, rest) in enumerate(pages):
            if not places:
                continue
            own, ends = rest @ x, np.cumsum([len(p) for p in places])
            a = 0
            while a < len(places):  # so many blocks that their features stay within FEATURES rows
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FEATURES, side="right")))
                rows = e[np.concatenate(places[a:b])] * np.concatenate(weights[a:b])[:, None]
                own[a:b] += np.add.reduceat(rows, np.append(0, ends[a : b - 1] - (ends[a - 1] if a else 0)), axis=0)
                a = b
            out[: len(places), j] = own if side == "f" else own[::-1]
        return out

    def run(self, pages: list) -> tuple[list[np.ndarray], dict]:
        """Probabilities for each page's blocks, and what training needs of the way there."""
        length, n = max((len(p[0]) for p in pages), default=0), len(pages)
        states: dict = {}
        for side in "fb":
            z_in, u = self._inputs(side, pages, length), self.w[f"u{side}"]
            hs, cs = np.zeros((length + 1, n, HIDDEN), np.float32), np.zeros((length + 1, n, HIDDEN), np.float32)
            gates = []
            for t in range(length):
                i, f, o, g = self._gates(z_in[t] + hs[t] @ u)
                cs[t + 1] = f * cs[t] + i * g
                hs[t + 1] = o * np.tanh(cs[t + 1])
                gates.append((i, f, o, g))
            states[side] = (hs, cs, gates)
        out = []
        for j, (places, _, _) in enumerate(pages):
            k = len(places)
            both = states["f"][0][1 : k + 1, j] @ self.w["of"] + states["b"][0][1 : k + 1, j][::-1] @ self.w["ob"] + self.w["o"]
            out.append(1 / (1 + np.exp(-np.clip(both[:, 0], -30, 30))))
        return out, states

    def label(self, pages: list) -> list[np.ndarray]:
        """What ``run`` gives, without what only training needs: both directions take a step together, and a halved
        argument turns each gate's logistic function into the tangent that the cell takes in any case."""
        h, length, n = HIDDEN, max((len(p[0]) for p in pages), default=0), len(pages)
        scale = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), h)
        z = np.stack([self._inputs(side, pages, length) for side in "fb"], axis=1) * scale
        u = np.stack([self.w["uf"], self.w["ub"]]) * scale
        states, own = np.zeros((length + 1, 2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(length):
            gates = np.tanh(z[t] + states[t] @ u)
            own = 0.5 * ((gates[..., h : 2 * h] + 1) * own + (gates[..., :h] + 1) * gates[..., 3 * h :])
            states[t + 1] = 0.5 * (gates[..., 2 * h : 3 * h] + 1) * np.tanh(own)
        out = []
        for j, (places, _, _) in enumerate(pages):
            k = len(places)
            both = states[1 : k + 1, 0, j] @ self.w["of"] + states[1 : k + 1, 1, j][::-1] @ self.w["ob"] + self.w["o"]
            out.append(1 / (1 + np.exp(-np.clip(both[:, 0], -30, 30))))
        return out

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        found, states = self.run(pages)
        total = sum(map(len, labels))
        wrong = [(p - y) / total for p, y in zip(found, labels, strict=True)]
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["o"][0] = sum(map(np.sum, wrong))
        for side in "fb":
            hs, cs, gates = states[side]
            length, n = len(gates), len(pages)
            dh = np.zeros((length, n, HIDDEN), np.float32)
            for j, d in enumerate(wrong):
                own = d if side == "f" else d[::-1]
                grads[f"o{side}"] += hs[1 : len(d) + 1, j].T @ own[:, None].astype(np.float32)
                dh[: len(d), j] = own[:, None] * self.w[f"o{side}"][:, 0]
            carry_h, carry_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            dz = np.zeros((length, n, 4 * HIDDEN), np.float32)
            for t in range(length - 1, -1, -1):
                i, f, o, g = gates[t]
                tc = np.tanh(cs[t + 1])
                d = dh[t] + carry_h
                dc = carry_c + d * o * (1 - tc * tc)
                dz[t] = np.concatenate([dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                carry_h, carry_c = dz[t] @ self.w[f"u{side}"].T, dc * f
                grads[f"u{side}"] += hs[t].T @ dz[t]
            for j, (places, weights, rest) in enumerate(pages):
                own = dz[: len(places), j] if side == "f" else dz[: len(places), j][::-1]
                grads[f"x{side}"] += rest.T @ own
                sizes = [len(p) for p in places]
                flat = np.concatenate(places)
                order = np.argsort(flat, kind="stable")
                known, at = np.unique(flat[order], return_index=True)
                grads[f"e{side}"][known] += np.add.reduceat((np.repeat(own, sizes, axis=0) * np.concatenate(weights)[:, None])[order], at, axis=0)
        return grads


#: Names that pages give to what is around an article, and to the article.
AROUND = {
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs tabs", "header": "header masthead topbar logo branding", "footer": "footer bottom colophon copyright legal",
    "sidebar": "sidebar aside widget widgets rail related recommended popular tags", "notice": "notice cookie cookies consent banner alert gdpr popup modal message", "advert": "ad ads advert advertisement sponsored promo sponsor adsense",
    "form": "form search login signup subscribe newsletter", "comments": "comment comments reply replies discussion respond disqus", "share": "share social sharing follow",
}
INSIDE = "content article post entry story body text main page column"
TAGS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section", "advert": "div aside section", "form": "form div", "comments": "div section ol", "share": "div ul"}
PHRASES = {
    "menu": "Home|About|Contact|News|Products|Services|Blog|Archive|Next|Previous", "header": "Welcome|Daily news|Site name|Log in|Search", "footer": "Copyright 2024 all rights reserved|© site|Privacy policy|Terms of use|Imprint|Contact us",
    "sidebar": "Related articles|Most read|Popular posts|Categories|Tags|Recent posts", "notice": "We use cookies to improve this site|Accept all cookies|Please enable notifications|This site uses cookies", "advert": "Advertisement|Sponsored|Buy now|Special offer|Click here",
    "form": "Subscribe to our newsletter|Your email|Search|Sign up|Password|Submit", "comments": "Reply|Leave a comment|Great article|Thanks for sharing|says|I agree|Comments", "share": "Share|Tweet|Like|Follow us|Email this",
}


def invented_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page and a label for each of its blocks (1: article)."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    letters = "etaoinshrdlucmfwypvbgkéèüöñáí"
    word = lambda: "".join(pick(letters) for _ in range(int(rng.integers(1, 9))))
    end = lambda: pick([".", ".", ".", "!", "?", ""])
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + end()
    out: list[str] = []
    labels: list[int] = []

    def block(tag: str, text: str, label: int, close: bool = True) -> None:
        inner = f'<a href="/{word()}">{text}</a>' if label == 0 and rng.random() < 0.4 else text
        if label and rng.random() < 0.15:
            inner = pick(["<b>{}", "<b>{}<br>", "<i>{}</i>", "<span>{}</span>", '<a href="/x">{}</a>']).format(text)
        out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))
        labels.append(label)

    def around(kind: str) -> None:
        tag, name = pick(TAGS[kind].split()), pick(AROUND[kind].split())
        attr = pick(["", f' class="{name}"', f' id="{name}"', f' class="{name} {word()}"', f' class="{word()}" id="{name}"'])
        if tag in ("div", "section") and not attr:
            attr = f' class="{name}"'
        out.append(f"<{tag}{attr}>")
        inner = "li" if tag in ("ul", "ol") else pick(["li", "p", "div", "span", "", ""])
        for _ in range(int(rng.integers(1, 9 if kind in ("menu", "sidebar", "comments") else 4))):
            text = pick(PHRASES[kind].split("|")) if rng.random() < 0.5 else prose(int(rng.integers(1, 40 if kind in ("comments", "advert", "notice") else 9)))
            if inner in ("", "span"):
                out.append(text if not inner else f"<span>{text}</span>")
                labels.append(0)
                break  # one block
            block(inner, text, 0)
        out.append(f"</{tag}>")

    out.append(f'<!DOCTYPE html><html><head><title>{prose(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    for kind in ["notice", "header", "menu", "advert", "sidebar", "form", "share"]:
        if rng.random() < 0.45:
            around(kind)
    shape = rng.random()
    names = f' class="{pick(INSIDE.split())}"'
    tag, attr = ("article", "") if shape < 0.5 else ("main", "") if shape < 0.65 else ("div", names) if shape < 0.9 else ("article", names)
    out.append(f"<{tag}{attr}>")
    if rng.random() < 0.8:
        block(pick(["h1", "h1", "h2"]), prose(int(rng.integers(1, 12))), 1)
    for _ in range(int(rng.integers(1, 14))):
        u = rng.random()
        if u < 0.75:
            block("p", prose(int(rng.integers(1, 6) if rng.random() < 0.3 else rng.integers(10, 90))), 1, close=rng.random() < 0.9)
        elif u < 0.83:
            block(pick(["h2", "h3"]), prose(int(rng.integers(1, 8))), 1)
        elif u < 0.9:
            out.append("<ul>")
            for _ in range(int(rng.integers(1, 5))):
                block("li", prose(int(rng.integers(1, 15))), 1)
            out.append("</ul>")
        elif u < 0.95:
            block("blockquote", prose(int(rng.integers(5, 40))), 1)
        else:
            around(pick(["advert", "share", "sidebar", "form"]))
    if rng.random() < 0.25:
        around("comments")
    out.append(f"</{tag}>")
    for kind in ["share", "comments", "sidebar", "form", "advert", "notice", "footer"]:
        if rng.random() < (0.8 if kind == "footer" else 0.4):
            around(kind)
    if rng.random() < 0.9:
        out.append("</body></html>")
    return "".join(out), labels


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The labeller, by Adam over invented pages; the same for every call, as all numbers follow from SEED."""
    rng = np.random.default_rng(SEED)
    data = []
    for _ in range(PAGES):
        page, labels = invented_page(rng)
        found = blocks(page)
        if len(found) == len(labels):  # two neighbours without a tag between them would be one block
            data.append((features(found), np.array(labels, dtype=np.float32)))
    net = Labeller(rng)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    data.sort(key=lambda x: len(x[1]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    step = 0
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            step += 1
            grads = net.gradients([x[0] for x in batches[k]], [x[1] for x in batches[k]])
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                net.w[name] -= RATE * 0.85**epoch * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
    return net


def main_texts(pages: list[str | None], net: Labeller) -> list[str]:
    out = [""] * len(pages)
    found = [blocks(p) for p in pages]
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):  # pages of like length together; fewer where they are long
        n = max(1, min(64, 4_096 // len(found[order[min(at + 63, len(order) - 1)]])))
        group = order[at : at + n]
        at += n
        for i, p in zip(group, net.label([features(found[i]) for i in group]), strict=True):
            out[i] = "\n".join(text for (_, text, _), x in zip(found[i], p, strict=True) if x >= 0.5)
    return out


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(part.column(2).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

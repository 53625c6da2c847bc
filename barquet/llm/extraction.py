"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks. Each block is a vector: its tag path (element names, words of class,
id and role) and its words, both hashed with signs into a fixed number of places, and a few shares
and lengths. A bidirectional LSTM, written in numpy, reads the blocks of the whole page and labels
each one as main text or not, so a block is judged by its own looks and by everything around it.

Training needs no hand labels. It takes a bounded sample of the pages: blocks below ``article`` or
``main``, and not below an element that the HTML standard gives another role, are main text. From
the texts of those pages it also lays out pages of its own, with the parts in many orders and under
many names (``layout``), so that the labeller does not depend on one site's markup.

Defined results: a null or empty page, or one without main text, gives the empty text; pages of any
length are read whole, and repeated rows are extracted once each; extra columns are never read. With
no page to learn from, layouts of filler words are the whole training set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, parse
from .common import bounded_batches, whole

SAMPLE_PAGES = 256
PATH_PLACES, WORD_PLACES, NUMBERS = 96, 24, 8
WIDTH = PATH_PLACES + WORD_PLACES + NUMBERS
HIDDEN = 20
ROUNDS = 420
PAGES_A_ROUND = 24
RATE = 0.01
SEED = 3
#: Blocks in a row that a training step reads of a page.
TRAIN_BLOCKS = 120

# Names that pages give their parts, for layouts.
ASIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toc pagination pager submenu",
    "header": "header masthead banner topbar logo siteheader branding",
    "footer": "footer copyright legal colophon bottom siteinfo credits",
    "sidebar": "sidebar aside widget rail related recommended popular trending tags archive",
    "notice": "notice cookie cookies consent gdpr alert popup modal privacy disclaimer paywall toast",
    "ad": "ad ads advert advertisement sponsored promo promotion banner sponsor",
    "form": "form newsletter subscribe signup login search contact survey poll",
    "comments": "comments comment discussion replies reply responses disqus thread reviews",
    "share": "share social sharing follow buttons toolbar tools meta byline author",
}
MAIN = "article content main post entry story body text page prose markdown text-content post-body entry-content article-body".split()
CHATTER = {
    "nav": "home about news contact products services blog archive next previous top menu sections login".split(),
    "header": "welcome home search menu site the daily news online".split(),
    "footer": "copyright all rights reserved privacy policy terms contact imprint sitemap powered by".split(),
    "sidebar": "related articles popular posts read more recent tags categories archive see also".split(),
    "notice": "we use cookies to improve your experience accept all decline settings privacy policy this site".split(),
    "ad": "advertisement sponsored buy now sale offer save free shipping click here limited".split(),
    "form": "email name subscribe sign up enter your address password log in search submit send".split(),
    "comments": "says replied reply comments great post thanks posted at agree report like".split(),
    "share": "share on tweet follow us print email by posted updated min read".split(),
}
ROLES = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "notice": "div", "ad": "div", "share": "div"}
NOT_MAIN = frozenset("nav header footer aside form button dialog menu label fieldset search .hidden".split())


@lru_cache(maxsize=1 << 16)
def place(kind: str, token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(f"{kind}:{token}".encode())
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


#: Names that say something; all others are one name, so that a page's own vocabulary is no noise.
KNOWN = frozenset(
    f".{w}" for names in (*ASIDE.values(), " ".join(MAIN), "site main page wrap inner list box block area unit slot comment reply user hidden")
    for w in names.replace("-", " ").split()
)


@lru_cache(maxsize=1 << 14)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_PLACES)
    for i, step in enumerate(path):
        step = ".?" if step[0] == "." and step not in KNOWN else step
        at, sign = place("p", step, PATH_PLACES)
        out[at] += sign
        if i >= len(path) - 2:
            at, sign = place("leaf", step, PATH_PLACES)
            out[at] += 0.5 * sign
    return np.clip(out, -2, 2)


def block_matrix(blocks: Sequence[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(blocks), WIDTH))
    for i, b in enumerate(blocks):
        x[i, :PATH_PLACES] = path_vector(b.path)
        words = b.text.lower().split()
        # all words of short blocks; of long ones the counts flatten out, so their sum is scaled
        share = 1.0 / max(4.0, len(words)) ** 0.5
        held = [0.0] * WORD_PLACES
        for w in words:
            at, sign = place("w", w, WORD_PLACES)
            held[at] += share * sign
        x[i, PATH_PLACES : PATH_PLACES + WORD_PLACES] = held
        n, k = len(b.text), len(words)
        x[i, -NUMBERS:] = (
            np.log1p(n) / 8, np.log1p(k) / 6, b.links, b.text[-1] in ".!?…\"'»”", b.text[:1].isupper(),
            sum(map(b.text.count, ".,;:!?")) / max(1, k), i / max(1, len(blocks)), 1.0,
        )
    x[:, PATH_PLACES : PATH_PLACES + WORD_PLACES] = np.clip(x[:, PATH_PLACES : PATH_PLACES + WORD_PLACES], -2, 2)
    return x


def rule_label(b: Block) -> float:
    """Main text by the standard's element roles."""
    return float(("article" in b.path or "main" in b.path) and not NOT_MAIN.intersection(b.path) and "title" not in b.path)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent, bias) and of the output."""

    w: list[np.ndarray]

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        h, w = HIDDEN, []
        for _ in range(2):
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0  # remember at first
            w += [rng.normal(0, WIDTH**-0.5, (WIDTH, 4 * h)), rng.normal(0, h**-0.5, (h, 4 * h)), bias]
        return cls([*w, rng.normal(0, h**-0.5, (2 * h + WIDTH,)), np.zeros(1)])

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits (pages by blocks) of padded pages ``x``; with ``keep`` also what backward needs."""
        n, t, _ = x.shape
        h, tapes, sides = HIDDEN, [], []
        for d in range(2):
            wx, wh, b = self.w[3 * d : 3 * d + 3]
            z_all = x @ wx + b
            hid, cell = np.zeros((n, h)), np.zeros((n, h))
            out = np.zeros((n, t, h))
            tape = []
            for s in range(t) if d == 0 else range(t - 1, -1, -1):
                z = z_all[:, s] + hid @ wh
                gate = sigmoid(z[:, : 3 * h])
                i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                g = np.tanh(z[:, 3 * h :])
                m = mask[:, s : s + 1]
                new = f * cell + i * g
                flat = np.tanh(new)
                if keep:
                    tape.append((s, i, f, o, g, cell, hid, flat, m))
                cell = m * new + (1 - m) * cell
                hid = m * (o * flat) + (1 - m) * hid
                out[:, s] = hid
            tapes.append(tape)
            sides.append(out)
        joint = np.concatenate([*sides, x], axis=2)
        logits = joint @ self.w[6] + self.w[7][0]
        return (logits, joint, tapes) if keep else logits

    def slopes(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean logistic loss."""
        logits, joint, tapes = self.run(x, mask, keep=True)
        dl = (sigmoid(logits) - y) * mask / mask.sum()
        h = HIDDEN
        out: list[np.ndarray] = []
        d_joint = dl[:, :, None] * self.w[6]
        for d in range(2):
            wh = self.w[3 * d + 1]
            dz_all = np.zeros((*x.shape[:2], 4 * h))
            g_wh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), h)), np.zeros((len(x), h))
            for s, i, f, o, g, cell, hid, flat, m in reversed(tapes[d]):
                dh = dh + d_joint[:, s, d * h : (d + 1) * h]
                live, dead = dh * m, dh * (1 - m)
                dnew = dc * m + live * o * (1 - flat * flat)
                dz = np.concatenate(
                    [dnew * g * i * (1 - i), dnew * cell * f * (1 - f), live * flat * o * (1 - o), dnew * i * (1 - g * g)], axis=1
                )
                dz_all[:, s] = dz
                g_wh += hid.T @ dz
                dh = dz @ wh.T + dead
                dc = dnew * f + dc * (1 - m)
            out += [np.tensordot(x, dz_all, axes=([0, 1], [0, 1])), g_wh, dz_all.sum(axis=(0, 1))]
        return [*out, np.tensordot(joint, dl, axes=([0, 1], [0, 1])), np.array([dl.sum()])]


def padded(mats: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max((len(m) for m in mats), default=1))
    x, mask = np.zeros((len(mats), t, WIDTH)), np.zeros((len(mats), t))
    for i, m in enumerate(mats):
        x[i, : len(m)], mask[i, : len(m)] = m, 1.0
    return x, mask


def layout(rng: np.random.Generator, prose: Sequence[str], noise: Sequence[str]) -> list[tuple[str, float]]:
    """A made-up page as (html, label) pieces: main text somewhere among parts of other roles.

    ``prose`` are paragraphs, ``noise`` short texts of the pages' other parts. Half of the layouts have
    random names, or none, in place of telling ones: there only elements, words and places speak.
    """
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    mute = rng.random() < 0.5

    def named(name: str) -> str:
        if not mute:
            return name
        return "".join(pick("abcdefghijklmnoprstuvwz") for _ in range(int(rng.integers(2, 9))))

    def words(text: str, low: int, high: int) -> str:
        cut = text.split()
        at = int(rng.integers(max(1, len(cut) - low)))
        return " ".join(cut[at : at + int(rng.integers(low, high))]) or text

    def content() -> str:
        """One piece of main text in the shapes that articles use besides paragraphs."""
        form, text = rng.random(), pick(prose)
        if form < 0.25:
            head = "".join(f"<th>{words(pick(prose), 1, 3)}</th>" for _ in range(int(rng.integers(2, 5)))) if rng.random() < 0.6 else ""
            cells = lambda: "".join(f"<td>{words(pick(prose), 1, 7) if rng.random() < 0.7 else int(rng.integers(2000))}</td>" for _ in range(int(rng.integers(2, 5))))
            body = "".join(f"<tr>{cells()}</tr>" for _ in range(int(rng.integers(1, 6))))
            return f"<table>{f'<tr>{head}</tr>' if head else ''}{body}</table>"
        if form < 0.45:
            code = "\n".join(f"{pick(['x', 'run', 'if a', 'for i in', 'return', 'def f', 'print', '$ ls', 'let y'])} = {words(pick(prose), 1, 4)};" for _ in range(int(rng.integers(1, 6))))
            return f"<pre>{f'<code>{code}</code>' if rng.random() < 0.5 else code}</pre>"
        if form < 0.65:
            return "<dl>" + "".join(f"<dt>{words(pick(prose), 1, 4)}</dt><dd>{words(pick(prose), 3, 20)}</dd>" for _ in range(int(rng.integers(1, 4)))) + "</dl>"
        if form < 0.8:
            return f'<figure><img src="/p.jpg"><figcaption>{words(text, 3, 14)}</figcaption></figure>'
        kind = pick(["ol", "ul"])
        return f"<{kind}>" + "".join(f"<li>{words(pick(prose), 2, 25)}</li>" for _ in range(int(rng.integers(1, 6)))) + f"</{kind}>"

    def chatter(role: str) -> str:
        kind = rng.random()
        if role == "comments" and kind < 0.7 or not mute and role in ("sidebar", "notice", "ad", "footer") and kind < 0.3:
            return pick(prose if rng.random() < 0.6 else noise)
        if kind < 0.5 and noise:
            return pick(noise)
        return " ".join(pick(CHATTER[role]) for _ in range(int(rng.integers(1, 9)))).capitalize()

    def part(role: str) -> list[tuple[str, float]]:
        # prose under a name that says nothing is main text; comments are known by their names
        name = pick(ASIDE[role].split()) if role == "comments" else named(pick(ASIDE[role].split()))
        tag = ROLES[role] if rng.random() < 0.45 else pick(["div", "section", "div", "ul" if role == "nav" else "div"])
        label = f' {pick(["class", "id"])}="{pick(["", "site-", "js ", "main-", "page-"]) if not mute else ""}{name}{pick(["", "", "-list", "-box", "-wrap", "-inner", "-slot", "-unit", "-area", "-block"]) if not mute else ""}"'
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        out = [(f"<{tag}{'' if plain else label}>", -1.0)]
        if rng.random() < 0.3:
            out.append((f"<h3>{chatter(role)}</h3>", 0.0))
        items = int(rng.integers(1, 8 if role in ("nav", "comments", "sidebar", "footer") else 4))
        item = pick(["li", "li", "a", "p", "span"]) if role in ("nav", "footer", "sidebar", "share") else pick(["p", "p", "div", "label", ""])
        for _ in range(items):
            body = chatter(role)
            if role in ("nav", "footer", "sidebar", "share") and rng.random() < 0.7:
                body = f'<a href="/x">{body}</a>'
            if role == "comments" and rng.random() < 0.5:
                out.append((f'<div class="{pick(["comment", "reply", "user", "comment-body"])}"><p>{body}</p></div>', 0.0))
            else:
                out.append((f"<{item}>{body}</{item}>" if item else body, 0.0))
        return [*out, (f"</{tag}>", -1.0)]

    def main() -> list[tuple[str, float]]:
        kind = rng.random()
        if kind < 0.35:
            begin, end = "<article>", "</article>"
        elif kind < 0.5:
            begin, end = "<main>", "</main>"
        elif kind < 0.9:
            tail = "" if mute else pick(["", "", "-wrap", "-main"])
            begin, end = f'<{"section" if rng.random() < 0.15 else "div"} {pick(["class", "id"])}="{named(pick(MAIN))}{tail}">', "</div>"
        else:
            begin, end = "", ""
        out = [(begin, -1.0)]
        head = pick(prose)[:60]
        if rng.random() < 0.8:
            out.append((f"<h1>{head}</h1>", 1.0))
        for _ in range(int(rng.integers(1, 12))):
            form = rng.random()
            text = pick(prose)
            if form < 0.02:
                out.append((f"<h3>{words(text, 1, 6)}</h3>", 1.0))
            elif form > 0.84:
                out.append((content(), 1.0))
            elif form < 0.06:
                out.append((f"<h2>{text[:50]}</h2>", 1.0))
            elif form < 0.12:
                out.append((f"<ul><li>{text[:120]}</li></ul>", 1.0))
            elif form < 0.16:
                out.append((f"<blockquote>{text}</blockquote>", 1.0))
            elif form < 0.2:
                out.append((f"<p>{text[: int(rng.integers(5, 60))]}</p>", 1.0))
            else:
                out.append((f"<p>{text}</p>" if rng.random() < 0.93 else f"<p><b>{text}<br>", 1.0))
            if rng.random() < 0.1:
                out += part(pick(["ad", "share", "sidebar", "form", "notice"]))
        if rng.random() < 0.15:
            out += part(pick(["comments", "share"]))
        return [*out, (end, -1.0)]

    before = [r for r in ("header", "nav", "notice", "ad", "sidebar", "share") if rng.random() < 0.4]
    after = [r for r in ("share", "comments", "sidebar", "ad", "form", "nav", "notice", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    page = [("<html><body>", -1.0)]
    for r in before:
        page += part(r)
    page += main()
    for r in after:
        page += part(r)
    return page


def labelled_layout(rng: np.random.Generator, prose: Sequence[str], noise: Sequence[str]) -> tuple[list[Block], np.ndarray]:
    """Blocks and labels of one layout: pieces carry a mark through the parser."""
    page = layout(rng, prose, noise)
    marked = "".join(p if y < 0 else p.replace(">", f">\x01{int(y)}", 1) if p.startswith("<") else f"\x01{int(y)}{p}" for p, y in page)
    blocks, labels = [], []
    last = 0.0
    for b in parse(marked):
        at = b.text.find("\x01")
        if at >= 0:
            last = float(b.text[at + 1])
        text = " ".join(b.text.replace("\x010", " ").replace("\x011", " ").split())
        if text:
            blocks.append(Block(text, b.path, b.links))
            labels.append(last)
    return blocks, np.array(labels)


def stretch(rng: np.random.Generator, page: tuple[np.ndarray, np.ndarray], longest: int = TRAIN_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """A page's vectors and labels, or of a longer one ``longest`` blocks in a row from anywhere in it.

    The vectors were made from the whole page, so their places in it are right.
    """
    x, y = page
    at = int(rng.integers(max(1, len(y) - longest + 1)))
    return x[at : at + longest], y[at : at + longest]


def train(pages: Sequence[str], seed: int = SEED, rounds: int = ROUNDS) -> Labeller:
    """Fit the labeller to ``pages`` (by element roles) and to layouts of their texts (Adam)."""
    rng = np.random.default_rng(seed)
    real, prose, noise = [], [], []
    for page in pages:
        blocks = parse(page)
        y = np.array([rule_label(b) for b in blocks])
        if y.any():
            real.append((block_matrix(blocks), y))
        prose += [b.text for b, k in zip(blocks, y, strict=True) if k and len(b.text) > 30]
        noise += [b.text for b, k in zip(blocks, y, strict=True) if not k]
    filler = [w for words in CHATTER.values() for w in words]
    if not prose:
        prose = [" ".join(rng.choice(filler, int(rng.integers(8, 80)))).capitalize() + "." for _ in range(64)]
    noise = noise or filler
    # paragraphs stand in the text as they were read; "<" and "&" must not become markup again
    prose = [t.replace("&", "&amp;").replace("<", "&lt;") for t in prose]
    noise = [t.replace("&", "&amp;").replace("<", "&lt;") for t in noise]
    net = Labeller.fresh(rng)
    first = [np.zeros_like(w) for w in net.w]
    second = [np.zeros_like(w) for w in net.w]
    for step in range(1, rounds + 1):
        batch = []
        for _ in range(PAGES_A_ROUND):
            if real and rng.random() < 0.25:
                batch.append(stretch(rng, real[int(rng.integers(len(real)))]))
            else:
                blocks, y = labelled_layout(rng, prose, noise)
                if len(y):
                    batch.append(stretch(rng, (block_matrix(blocks), y)))
        x, mask = padded([m for m, _ in batch])
        y = np.zeros(mask.shape)
        for i, (_, labels) in enumerate(batch):
            y[i, : len(labels)] = labels
        rate = RATE * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        for k, g in enumerate(net.slopes(x, mask, y)):
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.w[k] = net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def label_pages(net: Labeller, pages: Sequence[list[Block]], cells: int = 16_384) -> list[np.ndarray]:
    """Probability of main text for every block of every page; like lengths are run together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
            end += 1
        group = order[at:end]
        x, mask = padded([block_matrix(pages[i]) for i in group])
        p = sigmoid(net.run(x, mask))
        for row, i in enumerate(group):
            out[i] = p[row, : len(pages[i])]
        at = end
    return out


def learn(pages: DataFrame, html: str = "html", key: str = "url", sample_pages: int = SAMPLE_PAGES, seed: int = SEED) -> Labeller:
    """Train on at most ``sample_pages`` pages: of each hash slot of ``key`` the one with the smallest hash."""
    mix = F.xxhash64(F.col(key).cast("string"))
    drawn = (
        pages.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(mix, F.lit(sample_pages)).alias("slot"))
        .agg(F.min(F.struct(F.xxhash64(mix).alias("h"), F.col(key).alias("k"))).alias("m"))
        .select("m.k")
        .collect()
    )
    rows = (
        pages.filter(F.col(key).isin([r["k"] for r in drawn]))
        .groupBy(F.col(key).alias("k"))
        .agg(F.min(html).alias("html"))
        .orderBy("k")
        .collect()
    )
    return train([r["html"] for r in rows if r["html"]], seed)


def main_text(net: Labeller, html: str | Column = "html") -> Column:
    """The main text of a page's whole html."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            pages = [parse(h) for h in batch]
            chances = label_pages(net, pages)
            yield pd.Series(
                ["\n".join(b.text for b, p in zip(blocks, ps, strict=True) if p >= 0.5) for blocks, ps in zip(pages, chances, strict=True)],
                dtype=object,
            )

    return run(whole(html))


def extract(pages: DataFrame, net: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out``."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(out, main_text(net, html))

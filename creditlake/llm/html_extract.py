"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector of its hashed tag
path, its hashed words and a few measures; a bidirectional LSTM (numpy) reads
the whole sequence, so that a block is judged in the context of its document,
and every block is labelled as main text or not.  The main text is the labelled
blocks in page order.

Training needs no hand labels.  Pages that mark their article say which blocks
are main text; since they show few kinds of other blocks, further pages are
built from their paragraphs with menus, headers, sidebars, notices, adverts,
forms and comments around them, under many class names.  The sample is bounded
(``TRAIN_PAGES`` pages of at most ``TRAIN_CHARS`` characters, the first by a
hash of page_id), its weights have a fixed size; all pages are then labelled
by workers, in batches.

Defined cases: a null or empty page has no text (the empty string); a page
without any block likewise; repeated rows are labelled one by one; without a
usable page the model is trained on built pages with plain words; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks

TRAIN_PAGES = 200
TRAIN_CHARS = 16_000
BUILT_PAGES = 480
BUCKETS = 512
EMBED, HIDDEN = 24, 16
EPOCHS, BATCH, RATE = 16, 32, 0.012
N_NUMBERS = 8
#: pages labelled together
PAGES = 128

#: fixed word lists: elements and class words of blocks that are not main text
OTHER_TAGS = frozenset("nav header footer aside form button select fieldset dialog menu".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer header menu nav "
    "navbar navigation newsletter notice pagination popup promo related respond reply share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split())


# vectors

@lru_cache(maxsize=200_000)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def path_features(path: tuple[str, ...]) -> list[int]:
    """Every element, every class word, and each element under its parent, over
    the whole path.  Each counts once, so that unclosed tags that pile up don't
    outweigh the elements around them."""
    out, above = [], "^"
    for e in path:
        tag, *words = e.split(" ")
        out.append(_bucket(f"t:{tag}"))
        out += [_bucket(f"c:{w}") for w in words]
        out.append(_bucket(f"p:{above}>{tag}"))
        above = tag
    out.append(_bucket(f"last:{above}"))
    return list(dict.fromkeys(out))


def word_features(text: str) -> list[int]:
    return [BUCKETS + _bucket("w:" + w) for w in text.lower().split()]


def numbers(b: Block, place: int, of: int) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    marks = sum(map(b.text.count, ".,;:!?"))
    return [math.log1p(words) / 5, min(1.0, b.link_chars / n), min(1.0, 4 * marks / words), float(b.text[-1] in ".!?\"”»"),
            place / of, float(place == 0), float(words < 5), math.log1p(of) / 6]


class Sequence:
    """Feature ids (flat, with the block of each), weights and measures."""

    def __init__(self, page: list[Block], drop: random.Random | None = None):
        ids, row, weight = [], [], []
        for k, b in enumerate(page):
            p, w = path_features(b.path), word_features(b.text)
            if drop is not None:
                # paths must speak for themselves: words go often, path features rarely
                p = [x for x in p if drop.random() > 0.05] or p[-1:]
                w = [] if drop.random() < 0.3 else [x for x in w if drop.random() > 0.2]
            ids += p + w
            row += [k] * (len(p) + len(w))
            weight += [1 / math.sqrt(len(p))] * len(p) + [1 / max(1, len(w))] * len(w)
        self.ids, self.row, self.weight = np.array(ids, np.int32), np.array(row, np.int64), np.array(weight, np.float32)
        self.numbers = np.array([numbers(b, k, len(page)) for k, b in enumerate(page)], np.float32).reshape(len(page), N_NUMBERS)
        self.n = len(page)


# the network

SHAPES = {"E": (2 * BUCKETS, EMBED), "N": (N_NUMBERS, EMBED), "b": (EMBED,), "out": (2 * HIDDEN + EMBED,), "out_b": (1,)} | {
    f"{d}{k}": s for d in "fr" for k, s in (("W", (EMBED, 4 * HIDDEN)), ("U", (HIDDEN, 4 * HIDDEN)), ("c", (4 * HIDDEN,)))}


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3 if k == "E" else 1 / math.sqrt(s[0]), s) for k, s in SHAPES.items()}
    for k in ("b", "out_b", "fc", "rc"):
        w[k] = np.zeros(SHAPES[k])
    for k in ("fc", "rc"):
        w[k][HIDDEN:2 * HIDDEN] = 1.0         # remember at first
    return w


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _embed(w, batch: list[Sequence]):
    """(batch, time, EMBED) with zeros after each sequence, and the mask."""
    t = max(s.n for s in batch)
    kind = w["E"].dtype
    flat = np.zeros((len(batch) * t, EMBED), kind)
    at = np.concatenate([s.row + i * t for i, s in enumerate(batch)])
    ids, weight = np.concatenate([s.ids for s in batch]), np.concatenate([s.weight for s in batch])
    if len(at):
        # rows ascend, so each block's features are one run
        begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        flat[at[begin]] = np.add.reduceat(w["E"][ids] * weight[:, None], begin, axis=0)
    mask = np.zeros((len(batch), t), kind)
    num = np.zeros((len(batch), t, N_NUMBERS), kind)
    for i, s in enumerate(batch):
        mask[i, :s.n], num[i, :s.n] = 1, s.numbers
    x = np.tanh(flat.reshape(len(batch), t, EMBED) + num @ w["N"] + w["b"]) * mask[:, :, None]
    return x, mask, num, (at, ids, weight)


def _lstm(x, mask, W, U, c, keep=True):
    """States over time; where the mask is 0 the state stays as it is."""
    n, t, _ = x.shape
    z = x @ W + c
    h, s = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    hs, tape = np.zeros((n, t, HIDDEN), x.dtype), []
    for k in range(t):
        a = z[:, k] + h @ U
        gates = _sigmoid(a[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(a[:, 3 * HIDDEN:])
        m = mask[:, k:k + 1]
        s2 = f * s + i * g
        th = np.tanh(s2)
        if keep:
            tape.append((h, s, i, f, o, g, th, m))
        h, s = m * o * th + (1 - m) * h, m * s2 + (1 - m) * s
        hs[:, k] = h
    return hs, tape


def _lstm_back(dhs, x, tape, W, U):
    n, t, _ = x.shape
    dW, dU, dc, dx = np.zeros_like(W), np.zeros_like(U), np.zeros(4 * HIDDEN), np.zeros_like(x)
    dh, ds = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for k in range(t - 1, -1, -1):
        h, s, i, f, o, g, th, m = tape[k]
        dh = dh + dhs[:, k]
        now = dh * m
        dcell = now * o * (1 - th * th) + ds * m
        da = np.concatenate([dcell * g * i * (1 - i), dcell * s * f * (1 - f), now * th * o * (1 - o), dcell * i * (1 - g * g)], 1)
        dW += x[:, k].T @ da
        dU += h.T @ da
        dc += da.sum(0)
        dx[:, k] = da @ W.T
        dh, ds = da @ U.T + dh * (1 - m), dcell * f + ds * (1 - m)
    return dW, dU, dc, dx


def forward(w, batch: list[Sequence], keep: bool = True):
    x, mask, num, sparse = _embed(w, batch)
    hf, tf = _lstm(x, mask, w["fW"], w["fU"], w["fc"], keep)
    # right to left; the padding comes first and leaves the zero state as it is
    hr, tr = _lstm(x[:, ::-1], mask[:, ::-1], w["rW"], w["rU"], w["rc"], keep)
    top = np.concatenate([hf, hr[:, ::-1], x], 2)
    return _sigmoid(top @ w["out"] + w["out_b"]), (x, mask, num, sparse, tf, tr, top)


def gradients(w, batch: list[Sequence], labels: list[np.ndarray]):
    """(loss, gradients) of the mean cross entropy per block."""
    p, (x, mask, num, (at, ids, weight), tf, tr, top) = forward(w, batch)
    y = np.zeros_like(mask)
    for i, t in enumerate(labels):
        y[i, :len(t)] = t
    n = mask.sum()
    loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n
    d = (p - y) * mask / n
    g = {"out": (top * d[:, :, None]).sum((0, 1)), "out_b": np.array([d.sum()])}
    dtop = d[:, :, None] * w["out"]
    g["fW"], g["fU"], g["fc"], dx = _lstm_back(dtop[:, :, :HIDDEN], x, tf, w["fW"], w["fU"])
    g["rW"], g["rU"], g["rc"], dr = _lstm_back(dtop[:, ::-1, HIDDEN:2 * HIDDEN], x[:, ::-1], tr, w["rW"], w["rU"])
    da = (dx + dr[:, ::-1] + dtop[:, :, 2 * HIDDEN:]) * (1 - x * x) * mask[:, :, None]
    g["N"], g["b"] = np.einsum("ntk,nte->ke", num, da), da.sum((0, 1))
    g["E"] = np.zeros_like(w["E"])
    order = np.argsort(ids, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) > 0))) if len(ids) else []
    if len(begin):
        g["E"][ids[order][begin]] = np.add.reduceat(da.reshape(-1, EMBED)[at[order]] * weight[order][:, None], begin, axis=0)
    return loss, g


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` passes of Adam; the same pages give the same weights."""
    rnd, w = random.Random(seed), new_weights(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    pages = [p for p in pages if p[0]]
    step = 0
    for epoch in range(epochs):
        order = sorted(pages, key=lambda p: len(p[0]) + rnd.random() * 8)
        groups = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        rnd.shuffle(groups)
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for group in groups:
            step += 1
            _, g = gradients(w, [Sequence(b, rnd) for b, _ in group], [np.array(t, float) for _, t in group])
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return w


# training pages

def marked(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article; None if it doesn't."""
    tags = [[e.split(" ")[0] for e in b.path] for b in page]
    if not any("article" in t or "main" in t for t in tags):
        return None
    def is_main(b, t):
        inside = min((i for i, x in enumerate(t) if x in ("article", "main")), default=None)
        if inside is None:
            return 0
        # an article in an article is a comment or a teaser; one in main is the article
        nested = t[inside + 1:].count("article") > (t[inside] == "main")
        return int(not nested and not any(x in OTHER_TAGS for x in t)
                   and not any(w in OTHER_WORDS for e in b.path for w in e.split(" ")[1:]))
    return [is_main(b, t) for b, t in zip(page, tags)]


PLAIN = ("the of and a to in is that for it as was with be by on not he his but at are this have from or had an they which one "
         "you were all her she there would their we him been has when who will no more if out so up said what").split()
MENU = "Home|About us|Contact|News|Products|Login|Register|Archive|Help|Terms|Privacy|Sitemap|Search|More".split("|")
NOTICES = ("We use cookies to improve this site.|Accept all|By continuing you agree to our terms.|Sign up for our newsletter.|"
           "Subscribe now and save.|This site needs a newer browser.|Share this page|Follow us|Read also").split("|")
FORMS = "Your name|Your e-mail|Message|Send|Search|Password|I agree|Submit|Leave a reply|Phone".split("|")
_LABEL = "\x01"


def built(paragraphs: list[str], rnd: random.Random) -> str:
    """A page whose main text blocks begin with ``_LABEL``."""
    pick = rnd.choice
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    para = lambda: esc(pick(paragraphs))
    bit = lambda: " ".join(para().split()[:rnd.randint(1, 9)])
    some = lambda a, b, f: "".join(f() for _ in range(rnd.randint(a, b)))
    item = lambda words: f"<li><a href='/x'>{pick([pick(words), bit()])}</a></li>"
    name = lambda words: pick([f' class="{pick(words)}"', f' id="{pick(words)}"', f' class="{pick(words)} box-{rnd.randint(1, 9)}"'])

    def main_block():
        t = _LABEL + para()
        return pick([f"<p>{t}</p>"] * 6 + [f"<p>{_LABEL}{bit()}</p>"] * 2 + [f"<p><b>{t}<br>", f"<h2>{_LABEL}{bit()}</h2>", f"<ul><li>{t}</li><li>{_LABEL}{bit()}</li></ul>",
                     f"<blockquote>{t}</blockquote>", f"<pre>{t}</pre>", f"<table><tr><td>{t}</td></tr></table>",
                     f"<p>{_LABEL}{bit()} <a href='/y'>{bit()}</a> {bit()}</p>", f"<div>{t}</div>", f"<figure><figcaption>{_LABEL}{bit()}</figcaption></figure>"])

    def comment():
        body = f"<p{pick(['', name(['author', 'meta'])])}>{bit()}</p><p>{para()}</p>" + pick(["", "<a href='#'>Reply</a>"])
        return pick([f"<div{name(['comment', 'comment-body', 'reply'])}>{body}</div>", f"<li{name(['comment'])}>{body}</li>", f"<article{name(['comment'])}>{body}</article>"])

    def comments():
        return pick([f"<section{name(['comments', 'comment-list', 'discussion'])}><h2>{pick(['Comments', '3 comments', bit()])}</h2>{some(1, 4, comment)}</section>",
                     f"<div{name(['comments', 'disqus', 'responses', 'reader-comments'])}>{some(1, 4, comment)}</div>",
                     f"<ol{name(['comment-list', 'commentlist'])}>{some(1, 4, comment)}</ol>"])
    menu = lambda: pick(["<nav{n}><ul>{x}</ul></nav>", "<div{n}><ul>{x}</ul></div>", "<ul{n}>{x}</ul>", "<menu>{x}</menu>"]).format(
        n=pick(["", name(["menu", "nav", "navbar", "main-menu", "breadcrumb", "navigation"])]), x=some(2, 8, lambda: item(MENU))).replace(
        "<div><ul>", '<div class="menu"><ul>').replace("<ul><li><a", '<ul class="nav"><li><a')
    box = lambda: pick([f"<p>{para()}</p>", f"<p>{bit()}</p>", f"<div>{bit()}</div>", f"<h3>{bit()}</h3>", para(), bit()])
    head = lambda: f"<header{pick(['', name(['site-header', 'header', 'masthead', 'top'])])}>{some(1, 3, box)}</header>"
    top = lambda: f"<div{name(['header', 'masthead', 'logo', 'topbar', 'site-title'])}>{some(1, 2, box)}</div>"
    side = lambda: pick(["<aside{n}>{x}</aside>", "<div{m}>{x}</div>"]).format(
        n=pick(["", name(["sidebar", "widget"])]), m=name(["sidebar", "widget", "related", "right-rail", "recommended", "share"]),
        x=some(1, 4, lambda: pick([box(), f"<ul>{some(1, 4, lambda: item(NOTICES))}</ul>"])))
    advert = lambda: f"<div{name(['ad', 'ads', 'advert', 'promo', 'sponsored', 'banner', 'advertisement'])}>{some(1, 2, box)}</div>"
    notice = lambda: pick(["<div{n}>{x}</div>", "<section{n}>{x}</section>", "<dialog>{x}</dialog>"]).format(
        n=name(["cookie-notice", "notice", "cookies", "alert", "newsletter", "popup", "gdpr", "subscribe"]),
        x=some(1, 3, lambda: pick([f"<p>{pick(NOTICES)}</p>", box(), "<button>OK</button>"])))
    form = lambda: f"<form{pick(['', name(['search', 'contact', 'login', 'newsletter'])])}>" + some(1, 5, lambda: pick([
        f"<label>{pick(FORMS)}</label><input name='a'>", f"<button>{pick(FORMS)}</button>", f"<p>{pick([pick(FORMS), para()])}</p>",
        f"<select><option>{bit()}</option><option>{pick(MENU)}</option></select>"])) + "</form>"
    foot = lambda: pick(["<footer{n}>{x}</footer>", "<div{m}>{x}</div>"]).format(
        n=pick(["", name(["footer", "site-footer"])]), m=name(["footer", "site-footer", "bottom", "copyright"]),
        x=some(1, 3, lambda: pick([f"<p>&copy; {bit()}</p>", box(), f"&copy; 2020 {bit()}", f"<ul>{some(1, 4, lambda: item(MENU))}</ul>"])))
    maybe = lambda f, p=0.5: f() if rnd.random() < p else ""
    inner = maybe(lambda: f"<h1>{_LABEL}{bit()}</h1>", 0.7)
    for _ in range(rnd.randint(1, 12)):
        inner += main_block() + maybe(lambda: pick([advert, side, notice, form])(), 0.06)
    inner += maybe(comments, 0.15)
    body = pick(["<article{n}>{x}</article>"] * 4 + ["<main><article>{x}</article></main>", "<main{n}>{x}</main>", "<div{m}>{x}</div>", "<section{m}>{x}</section>", "{x}"]).format(
        n=pick(["", name(["post", "entry", "story"])]), m=name(["content", "main-content", "article", "post-body", "entry", "story", "text", "body"]), x=inner)
    before = [maybe(menu, 0.7), maybe(head, 0.4), maybe(top, 0.3), maybe(notice, 0.3), maybe(advert, 0.5), maybe(form, 0.2), maybe(side, 0.2)]
    after = [maybe(comments, 0.4), maybe(side, 0.4), maybe(form, 0.3), maybe(advert, 0.3), maybe(menu, 0.2), maybe(notice, 0.2), maybe(foot, 0.9)]
    rnd.shuffle(before)
    page = "".join(before) + body + "".join(after)
    if rnd.random() < 0.3:
        page = f'<div{name(["page", "wrapper", "container", "site"])}>{page}</div>'
    return f"<html><head><title>{bit()}</title></head><body>{page}" + pick(["</body></html>", ""])


def training_pages(htmls: list[str], seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    rnd = random.Random(seed)
    out, paragraphs = [], []
    for html in htmls:
        page = blocks(html)
        labels = marked(page)
        if labels and 0 < sum(labels) < len(labels):
            out += [(page, labels)] * 3
            paragraphs += [b.text for b, y in zip(page, labels) if y]
    if len(paragraphs) < 40:
        paragraphs += [" ".join(rnd.choice(PLAIN) for _ in range(rnd.randint(3, 60))).capitalize() + "." for _ in range(200)]
    for _ in range(BUILT_PAGES):
        page = blocks(built(paragraphs, rnd))
        labels = [int(_LABEL in b.text) for b in page]
        out.append(([b._replace(text=b.text.replace(_LABEL, "") or "-") for b in page], labels))
    return out


# on Spark

def sample(pages: DataFrame, n: int = TRAIN_PAGES) -> list[str]:
    """Html of the first ``n`` pages by a hash of page_id (a bounded top-k)."""
    hashed = pages.where(F.length("html").between(1, TRAIN_CHARS)).select("html", F.xxhash64("page_id", "html").alias("h"))
    # every task offers n hashes; only the chosen pages themselves travel
    first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(n).collect()]
    if not first:
        return []
    rows = hashed.where(F.col("h") <= first[-1]).dropDuplicates(["h"]).collect()
    return [r["html"] for r in sorted(rows, key=lambda r: r["h"])]


def label(w: dict[str, np.ndarray], pages: list[list[Block]]) -> list[np.ndarray]:
    """Probability of being main text, per block; pages of like length together."""
    w = {k: v.astype(np.float32) for k, v in w.items()}
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    for k in range(0, len(order), 32):
        some = order[k:k + 32]
        p, _ = forward(w, [Sequence(pages[i]) for i in some], keep=False)
        for row, i in zip(p, some):
            out[i] = row[:len(pages[i])]
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, keep: tuple[str, ...] = ("page_id", "url"),
            html: str = "html") -> DataFrame:
    """``keep`` columns, the main ``text`` and ``n_blocks`` (blocks of the page)."""
    w = weights if weights is not None else train(training_pages(sample(pages)))
    kept = pages.select(*keep, F.col(html).alias("_html"))
    schema = kept.drop("_html").selectExpr("*", "'' text", "0 n_blocks").schema

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, PAGES):
                b = whole.slice(i, PAGES)
                found = [blocks(x) for x in b.column(b.num_columns - 1).to_pylist()]
                text = ["\n".join(x.text for x, y in zip(page, p) if y >= 0.5) for page, p in zip(found, label(w, found))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(k) for k in range(b.num_columns - 1)]
                    + [pa.array(text, pa.string()), pa.array([len(p) for p in found], pa.int32())], names=schema.names)
    return kept.mapInArrow(run, schema)

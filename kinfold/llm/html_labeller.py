"""HTML extraction (operator 4) by a recurrent block labeller.

A page is a sequence of leaf blocks. A block is read as the sum of learnt vectors of its tag path's names, the mean of
learnt vectors of its hashed words, and four numbers (length, links, capitals, place). A bidirectional LSTM in numpy
reads the whole sequence and says of every block whether it is main text, so each choice knows the document around it.

The labeller is trained here, on PAGES pages that a layout grammar writes (a documented bound): articles in many kinds
of container, with menus, headers, footers, sidebars, notices, adverts, forms and comment lists around and within
them. Words of articles and surroundings are drawn alike, so it has to learn layout rather than vocabulary.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .html_blocks import Block, blocks

#: Sizes of the model, and of its training: pages written, passes over them, pages a step.
NAMES, WORDS, DIM, HIDDEN = 1024, 512, 16, 24
PAGES, PASSES, STEP, RATE, SEED = 1600, 10, 16, 0.006, 11

#: Names that layouts give to regions (the grammar's vocabulary).
REGIONS = {
    "menu": (("nav", "ul", "div", "menu"), "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs site-nav links tabs toc pagination pager"),
    "header": (("header", "div"), "header masthead site-header topbar banner branding logo page-header top"),
    "footer": (("footer", "div"), "footer site-footer copyright colophon bottom legal foot footer-links page-footer"),
    "sidebar": (("aside", "div", "section"), "sidebar aside side widget related related-posts recommended trending popular rail sidebar-right more-stories secondary most-read"),
    "notice": (("div", "section", "p"), "notice cookie cookie-banner consent gdpr alert popup modal newsletter subscribe overlay cookie-notice paywall warning announcement social share"),
    "advert": (("div", "section", "ins", "aside"), "ad ads advert advertisement sponsor sponsored promo ad-slot adsbygoogle banner-ad promoted ad-container dfp commercial"),
    "form": (("form", "div", "fieldset"), "form search search-form login signup contact-form subscribe-form newsletter-form register poll survey"),
    "comments": (("div", "section", "ol", "ul"), "comments comment-list comment discussion replies disqus responses reader-comments comments-area user-comments thread respond"),
}
MAIN = "content article post entry main story body article-body post-content entry-content text page-content main-content story-body article-content"


class Pages:
    """Writes pages with known labels: each block is a sentence of its own, kept in `main` or not."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = "an ber con der el fo gra hin is jo ka lu mor ne ou pi que ra sa ti un ve wa xi ya zo th sch é ü ñ".split()
        self.words = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4))) for _ in range(4000)]

    def text(self, most: int = 30) -> str:
        r = self.r
        words = [r.choice(self.words) for _ in range(r.randint(1, most) if r.random() < 0.7 else r.randint(1, 5))]
        if r.random() < 0.7:
            words[0] = words[0].capitalize()
        if r.random() < 0.08:
            words = r.choice([words[:1] * len(words), [x for w in words for x in (w, "|")], [w + "***" for w in words], [w.upper() for w in words], [str(len(w)) for w in words]])
        out = " ".join(w + ("," if r.random() < 0.08 else "") for w in words) + r.choice([".", ".", ".", "", "!", "?"])
        return out if r.random() < 0.9 else out + r.choice([" ***", " &amp;&amp;", " %%%", " ###", " Released under the MIT License.", " a@b.org", " &quot;x&quot;", " 2024"])

    def named(self, tag: str, words: str, chance: float = 0.85) -> str:
        """An opening tag, most often with a class or id out of words."""
        r = self.r
        if r.random() > chance:
            return f"<{tag}>"
        return f'<{tag} {r.choice(["class", "class", "class", "id"])}="{r.choice(words.split())}{r.choice(["", "", "", " clearfix", " col-3", "-1"])}">'

    def para(self, most: int = 40) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.25:
            return f"<p><b>{self.text(most)}<br>"
        if kind < 0.8:
            return f"<p>{self.text(most)}</p>"
        if kind < 0.9:
            return f'<p>{self.text(8)} <a href="/x">{self.text(4)}</a> {self.text(8)}</p>'
        return f"<div>{self.text(most)}</div>"

    def link_list(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.text(3)}</a></li>' for i in range(n)) + "</ul>"

    def region(self, kind: str) -> str:
        """A region that isn't main text."""
        r = self.r
        tags, words = REGIONS[kind]
        tag = r.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form", "menu")
        start = self.named(tag, words, 0.5 if plain else 1)
        n = r.randint(1, 6)
        if kind == "menu":
            body = self.link_list(n) if tag != "ul" else "".join(f'<li><a href="/{i}">{self.text(3)}</a></li>' for i in range(n))
        elif kind == "header":
            body = r.choice(["", f"<h1>{self.text(5)}</h1>", f'<div class="logo">{self.text(3)}</div>', f"<p>{self.text(8)}</p>"]) + (self.link_list(n) if r.random() < 0.4 else self.text(6))
        elif kind == "footer":
            body = r.choice(["&copy; ", "", "Copyright "]) + self.text(8) + (self.link_list(n) if r.random() < 0.3 else "") + (self.para(12) if r.random() < 0.3 else "")
        elif kind == "sidebar":
            body = r.choice(["", f"<h3>{self.text(4)}</h3>"]) + r.choice([self.link_list(n), "".join(self.para(15) for _ in range(r.randint(1, 3)))])
        elif kind == "form":
            body = r.choice(["", f"<label>{self.text(3)}</label>", f"<p>{self.text(8)}</p>", f"<legend>{self.text(3)}</legend>"]) + "<input name='q'>" + r.choice([f"<button>{self.text(2)}</button>", f"<select><option>{self.text(2)}</option><option>{self.text(2)}</option></select>", f"<textarea>{self.text(4)}</textarea>", self.text(4)])
        elif kind == "comments":
            item, name = r.choice([("li", "comment"), ("div", "comment"), ("article", "comment"), ("div", "reply"), ("p", "comment")])
            body = r.choice(["", f"<h2>{self.text(4)}</h2>", f"<h3>{self.text(3)}</h3>"])
            for _ in range(r.randint(1, 5)):
                inner = self.text(20) if item == "p" else r.choice([f"<p>{self.text(25)}</p>", f'<div class="author">{self.text(2)}</div><p>{self.text(25)}</p>', f"<b>{self.text(2)}</b><p>{self.text(25)}</p><p>{self.text(25)}</p>", self.text(20)])
                body += self.named(item, name, 0.8) + inner + f"</{item}>"
        else:
            body = self.text(20) if r.random() < 0.6 else (self.para(20) if tag != "p" else self.text(20)) + (self.link_list(2) if r.random() < 0.2 and tag != "p" else "")
        return f"{start}{body}</{tag}>"

    def main(self) -> list[str]:
        """Elements of an article's text."""
        r = self.r
        out = [r.choice([f"<h1>{self.text(8)}</h1>", f"<h1>{self.text(30)}</h1>", f"<h2>{self.text(8)}</h2>", f"<header><h1>{self.text(8)}</h1></header>", ""])]
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14, 20]) if r.random() < 0.95 else r.randint(40, 90)):
            kind = r.random()
            if kind < 0.7:
                out.append(self.para())
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{self.text(6)}</h3>")
            elif kind < 0.9:
                out.append(f"<{r.choice(['ul', 'ol'])}>" + "".join(f"<li>{self.text(r.choice([4, 12, 30]))}</li>" for _ in range(r.randint(1, 6))) + "</ul></ol>")
            elif kind < 0.94:
                out.append(f"<blockquote>{self.text(20)}</blockquote>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{self.text(4)}</td><td>{self.text(4)}</td></tr></table>")
            else:
                out.append(f"<section>{self.para()}</section>")
        return out if any(out) else [f"<p>{self.text(20)}</p>"]

    def page(self) -> tuple[str, list[int]]:
        """A page and, for each of its blocks, whether it is main text."""
        r = self.r
        parts: list[tuple[str, int]] = [(f"<title>{self.text(8)}</title>", 0)] if r.random() < 0.9 else []
        parts += [("<body>", 0)]
        before, after = ["menu", "header", "advert", "notice", "form", "sidebar"], ["footer", "sidebar", "advert", "comments", "notice", "menu", "form"]
        for kind in before:
            if r.random() < (0.55 if kind in ("menu", "header") else 0.28):
                parts.append((self.region(kind), 0))
        wrap = []
        for tag in r.choice([["article"], ["article"], ["article"], ["main"], ["main", "article"], ["div", "article"], ["div"], ["div", "div"], ["main", "div"], ["section"]]):
            named = tag in ("div", "section")
            wrap.append(tag)
            parts.append((self.named(tag, MAIN, 1 if named else 0.3), 0))
        for x in self.main():
            parts.append((x, 1))
            if r.random() < 0.05:
                parts.append((self.region(r.choice(["advert", "sidebar", "notice", "form", "advert"])), 0))
        if r.random() < 0.12:
            parts.append((self.region("comments"), 0))
        parts += [(f"</{x}>", 0) for x in reversed(wrap)]
        r.shuffle(after)
        for kind in after:
            if r.random() < (0.75 if kind == "footer" else 0.3 if kind == "comments" else 0.2):
                parts.append((self.region(kind), 0))
        # labels: mark main text's elements by a sign in the text, then look where it lands
        page = "".join(x.replace(">", ">\x01") if main else x for x, main in parts)
        found = blocks(page)
        return page.replace("\x01", ""), [int("\x01" in b.text) for b in found if b.text.strip("\x01 ")]


def inputs(found: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Hashed names of each block's path, hashed words, and its numbers; all of a block's text counts."""
    n = len(found)
    hashed = {x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % NAMES for b in found for x in b.path}
    names = [sorted(set(map(hashed.__getitem__, b.path))) or [0] for b in found]
    words = [[zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in b.text.lower().split()] for b in found]
    numbers = np.array([[min(1.0, len(b.text) / 400), b.linked, sum(map(str.isupper, b.text)) / len(b.text), i / max(1, n - 1)] for i, b in enumerate(found)], np.float32).reshape(n, 4)
    return names, words, numbers


def _bag(rows: list[list[int]], power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices one after another, the row of each, and each one's weight: its row's size to -power."""
    sizes = np.array([len(x) for x in rows])
    return np.array([i for x in rows for i in x], np.int64), np.repeat(np.arange(len(rows)), sizes), np.repeat(np.maximum(sizes, 1.0) ** -power, sizes).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: embeddings, two LSTMs, a logistic output; trained with Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        width = 2 * DIM + 4
        draw = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        self.p = {"names": draw(NAMES, DIM, by=0.2), "words": draw(WORDS, DIM, by=0.1), "out": draw(2 * HIDDEN + 2 * DIM + 4, by=0.1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(width, 4 * HIDDEN, by=width**-0.5), f"h{d}": draw(HIDDEN, 4 * HIDDEN, by=HIDDEN**-0.5), f"c{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    def forward(self, pages: list[tuple], keep: bool = False):
        """Chances of all blocks of the pages, one page after another."""
        p = self.p
        sizes = np.array([len(x[0]) for x in pages])
        bags = [_bag([row for x in pages for row in x[k]], float(k)) for k in (0, 1)]
        n, b, t = int(sizes.sum()), len(pages), int(sizes.max())
        x = np.zeros((n, 2 * DIM + 4), np.float32)
        for k, (i, row, w) in enumerate(bags):
            starts = np.searchsorted(row, np.arange(n))
            summed = np.add.reduceat(p[("names", "words")[k]][i] * w[:, None], np.minimum(starts, len(row) - 1)) if len(row) else 0  # rows without any are set to 0 below
            x[:, k * DIM : k * DIM + DIM] = summed
            x[np.bincount(row, minlength=n) == 0, k * DIM : k * DIM + DIM] = 0
        x[:, 2 * DIM :] = np.concatenate([q[2] for q in pages])
        page = np.repeat(np.arange(b), sizes)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = {"f": place, "b": np.repeat(sizes, sizes) - 1 - place}
        live = (b - np.searchsorted(np.sort(sizes), np.arange(t), side="right")).tolist()  # pages that reach step k; longer ones come first
        order = np.empty(b, np.int64)
        order[np.argsort(-sizes, kind="stable")] = np.arange(b)
        row = order[page]
        hs, tapes = [], {}
        for d in "fb":
            z = np.zeros((t, b, 4 * HIDDEN), np.float32)
            z[at[d], row] = x @ p["x" + d] + p["c" + d]
            h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            all_h = np.zeros((t, b, HIDDEN), np.float32)
            tape = []
            for k in range(t):
                m = live[k]
                g = z[k, :m] + h[:m] @ p["h" + d]
                gates, new = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                before, h0 = c[:m], h[:m]
                c = f * before + i * new
                th = np.tanh(c)
                h = o * th
                all_h[k, :m] = h
                if keep:
                    tape.append((m, i, f, o, new, before, th, h0))
            hs.append(all_h[at[d], row])
            tapes[d] = tape
        top = np.concatenate([*hs, x], axis=1)
        chance = _sigmoid(top @ p["out"] + p["bias"])
        return (chance, (x, bags, at, row, t, b, top, tapes)) if keep else chance

    def gradients(self, pages: list[tuple], truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by back-propagation through time."""
        p = self.p
        chance, (x, bags, at, row, t, b, top, tapes) = self.forward(pages, keep=True)
        n = len(truth)
        loss = float(-np.mean(np.log(np.where(truth, chance, 1 - chance) + 1e-7)))
        delta = ((chance - truth) / n).astype(np.float32)
        g = {"out": top.T @ delta, "bias": np.array([delta.sum()], np.float32)}
        d_top = delta[:, None] * p["out"]
        dx = d_top[:, 2 * HIDDEN :].copy()
        for j, d in enumerate("fb"):
            dh_all = np.zeros((t, b, HIDDEN), np.float32)
            dh_all[at[d], row] = d_top[:, j * HIDDEN : (j + 1) * HIDDEN]
            dz = np.zeros((t, b, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
            gh = np.zeros_like(p["h" + d])
            for k in range(t - 1, -1, -1):
                m, i, f, o, new, before, th, h0 = tapes[d][k]
                dhk = dh_all[k, :m] + dh[:m]
                dck = dc[:m] + dhk * o * (1 - th * th)
                z = np.concatenate([dck * new * i * (1 - i), dck * before * f * (1 - f), dhk * th * o * (1 - o), dck * i * (1 - new * new)], axis=1)
                dz[k, :m] = z
                gh += h0.T @ z
                dh, dc = np.zeros_like(dh), np.zeros_like(dc)
                dh[:m], dc[:m] = z @ p["h" + d].T, dck * f
            flat = dz[at[d], row]
            g |= {"x" + d: x.T @ flat, "h" + d: gh, "c" + d: flat.sum(0)}
            dx += flat @ p["x" + d].T
        for k, name in enumerate(("names", "words")):
            i, r, w = bags[k]
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], i, dx[r, k * DIM : k * DIM + DIM] * w[:, None])
        return loss, g

    def train(self, pages: list[tuple], truths: list[np.ndarray], passes: int = PASSES, seed: int = SEED) -> float:
        """Adam over shuffled steps of pages of like length; the last pass's mean loss."""
        r = np.random.default_rng(seed)
        m, v, k, losses = {a: np.zeros_like(x) for a, x in self.p.items()}, {a: np.zeros_like(x) for a, x in self.p.items()}, 0, []
        by_size = np.argsort([len(x[0]) for x in pages], kind="stable")
        steps = [by_size[i : i + STEP] for i in range(0, len(pages), STEP)]
        for done in range(passes):
            losses = []
            for s in r.permutation(len(steps)):
                # words and numbers of most blocks are hidden, so that the path and its surroundings have to do
                some = [(a, [[] if hide else w for w, hide in zip(b, hidden)], c * ~hidden[:, None]) for a, b, c in (pages[i] for i in steps[s]) for hidden in [r.random(len(a)) < 0.75]]
                loss, g = self.gradients(some, np.concatenate([truths[i] for i in steps[s]]))
                losses.append(loss)
                k += 1
                rate = RATE * (1 - done / passes)
                for a, x in g.items():
                    m[a] += 0.1 * (x - m[a])
                    v[a] += 0.001 * (x * x - v[a])
                    self.p[a] -= rate * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)
        return float(np.mean(losses))

    def label(self, pages: list[list[Block]]) -> list[list[bool]]:
        """Whether each block of each page is main text."""
        out: list[list[bool]] = [[] for _ in pages]
        some = sorted((i for i, x in enumerate(pages) if x), key=lambda i: len(pages[i]))
        start = 0
        while start < len(some):
            # pages of like length share a step, within a bound of blocks
            stop = start + 1
            while stop < len(some) and stop - start < 256 and (stop - start + 1) * len(pages[some[stop]]) <= 20_000:
                stop += 1
            group = some[start:stop]
            chance = self.forward([inputs(pages[i]) for i in group])
            ends = np.cumsum([len(pages[i]) for i in group])
            for i, x in zip(group, np.split(chance > 0.5, ends[:-1])):
                out[i] = x.tolist()
            start = stop
        return out


@lru_cache(maxsize=1)
def trained(seed: int = SEED, pages: int = PAGES) -> Labeller:
    """The labeller, trained once for each driver process on pages of the grammar."""
    writer = Pages(seed)
    made = [writer.page() for _ in range(pages)]
    held = [(inputs(blocks(page)), np.array(truth, np.float32)) for page, truth in made if len(truth)]
    out = Labeller(seed)
    out.train([x for x, _ in held], [y for _, y in held])
    return out


def extract_text(labeller: Labeller, pages: list[str | None]) -> list[str]:
    """Main text of each page: its main blocks in order, joined by blank lines."""
    found = [blocks(x or "") for x in pages]
    return ["\n\n".join(b.text for b, main in zip(page, marks) if main) for page, marks in zip(found, labeller.label(found))]


def extract(df: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text; pages without main text too; repeated rows give equal rows; an empty table
    gives none; other columns are not looked at. The model's size is fixed, whatever the input.
    """
    model = df.sparkSession.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = extract_text(model.value, batch.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

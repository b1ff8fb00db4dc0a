"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM in numpy.

A page is cut into leaf blocks: the text between two block-level tags, inline tags melted
in. A block is described by its tag path (tags, class and id words of all its ancestors,
hashed), its words (hashed) and a few ratios, and the LSTM reads a page's blocks in both
directions, so each is judged with the whole page as context. Blocks judged to be article
text are joined in page order.

The labeller is trained where it is used, from pages that ``sample_page`` writes by rule
from ``SEED``: known labels, many layouts, no input data. ``TRAIN_PAGES`` bounds it, and
its weights (under a megabyte) are sent to the executors. A tag path always projects to the
same vector, so workers remember projections of up to ``PATHS`` paths.

Defined cases: null or empty html, or html without article text, gives empty text; text
outside any tag is a block; unclosed and stray tags are closed or skipped as browsers do (a
head ends at the first tag or text that can't be in it, an svg at a paragraph or the like, any
element with its parent, and elements deeper than ``DEPTH`` are siblings); an unclosed script
or style runs to the page's end; script, style and other text that is never shown makes no
block and parts none; a ``<`` that starts no tag is text; tags are read as the HTML standard has
them, at any length: a quote after ``=`` hides what is up to its like, and one that has none
before the page's last ``>`` is a character as others; ``<!-->`` and ``<!--->`` are whole
comments, and one without an end takes the rest of the page; repeated rows each get their text;
an empty table gives an empty result; extra columns are ignored. A page is read in time
proportional to its length.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm.shared import map_arrow

SEED = 11
TRAIN_PAGES = 2000
EPOCHS = 6
PATH_DIM = 512
WORD_DIM = 16
RATIOS = 6
HIDDEN = 16
#: Projections of tag paths, and buckets of words, that a worker remembers.
PATHS = 50_000
WORDS = 200_000
#: Pages that the network reads side by side, and blocks of these, shorter pages filled up.
SIDE_BY_SIDE = 64
BLOCKS_AT_ONCE = 1 << 16
#: Open elements, at most.
DEPTH = 512

#: Tags that end a block, a fixed value from the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main"
    " menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul"
    " button textarea input iframe".split()
)
VOID_TAGS = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)
#: Elements that hold no tags up to their end tag, those whose contents are never shown,
#: those of a head, and those that a paragraph or the like ends: fixed values from the HTML standard.
RAW = frozenset("script style title iframe noembed noframes xmp".split())
SILENT = frozenset("head noscript template svg math canvas object".split())
HEAD_TAGS = RAW | frozenset("meta link base basefont bgsound noscript template head".split())
FOREIGN = frozenset("svg math".split())
#: A tag whose start ends an open one of these.
IMPLIED_END = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
#: Elements that an implied end does not look out of.
SCOPES = frozenset("ul ol table dl select body div article section aside nav main".split())

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^ \t\n\f\r/>]*+)")
#: The end of a tag, or an attribute's name with the quote its value starts with, or a plain value.
ATTRIBUTE = re.compile(
    r"""[ \t\n\f\r/]*+(?:(>)|([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)"""
    r"""(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:(["'])|([^ \t\n\f\r>]*+)))?+)"""
)
PLAIN = re.compile(r"[^ \t\n\f\r>]*+")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
#: Attributes whose values tell what an element is for.
TELLING = frozenset("class id role itemprop".split())
NAME_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    path: str
    text: str
    link_chars: int = 0


@dataclass
class Reader:
    """Blocks of one page, gathered as its tokens go by."""

    stack: list[str] = field(default_factory=list)  # tags
    paths: list[str] = field(default_factory=list)  # tag and names, from the root down
    open_tags: Counter[str] = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    link_chars: int = 0
    hidden: int = 0  # place in the stack, from 1, of the element that hides what it holds

    def text(self, raw: str) -> None:
        if not raw:
            return
        if self.hidden:
            if self.stack[-1] != "head" or raw.isspace():
                return
            self.close(len(self.stack) - 1)
        self.parts.append(raw)
        if self.links:
            self.link_chars += len(raw)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                path = self.paths[-1] if self.paths else ""
                self.blocks.append(Block(path, text, min(self.link_chars, len(text))))
            self.parts, self.link_chars = [], 0

    def close(self, to: int) -> None:
        for tag in self.stack[to:]:
            self.open_tags[tag] -= 1
        del self.stack[to:], self.paths[to:]
        if self.hidden > to:
            self.hidden = 0

    def open(self, tag: str, path: str) -> None:
        if len(self.stack) >= DEPTH:
            self.close(DEPTH - 1)
        self.stack.append(tag)
        self.paths.append(path)
        self.open_tags[tag] += 1

    def start_tag(self, tag: str, names: str, closed: bool) -> None:
        if self.hidden:
            outer = self.stack[self.hidden - 1]
            if self.stack[-1] == "head" and tag not in HEAD_TAGS or outer in FOREIGN and tag in BLOCK_TAGS:
                self.close(self.hidden - 1)
        if tag in SILENT:
            if not (tag in FOREIGN and closed):
                self.open(tag, self.paths[-1] if self.paths else "")
                self.hidden = self.hidden or len(self.stack)
            return
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        if tag not in BLOCK_TAGS:
            return
        if not self.hidden:
            self.end_block()
        if tag in VOID_TAGS:
            return
        if "p" in self.stack[-1:]:
            self.close(len(self.stack) - 1)
        ends = IMPLIED_END.get(tag, ())
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at] in ends:
                self.close(at)
            elif self.stack[at] in SCOPES:
                break
        words = NAME_WORD.findall(CAMEL.sub(" ", names).lower()) if names else ()
        own = " ".join([tag, *(f".{w}" for w in dict.fromkeys(words))])
        self.open(tag, f"{self.paths[-1]}/{own}" if self.paths and self.paths[-1] else own)

    def end_tag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        at = len(self.stack) - 1 - self.stack[::-1].index(tag) if self.open_tags[tag] else len(self.stack)
        if tag in BLOCK_TAGS and (not self.hidden or at < self.hidden):
            self.end_block()
        self.close(at)


def attributes(page: str, at: int, end: int, alone: set[str]) -> tuple[str, int]:
    """Telling values of the tag whose attributes start here, and where it ends.

    ``end`` is after the page's last ``>``; ``alone`` gathers quotes that none follows before it,
    so that no part of a page is searched twice for the same.
    """
    found: list[str] = []
    while not (m := ATTRIBUTE.match(page, at))[1]:
        at, quote, value = m.end(), m[3], m[4]
        if quote:
            close = -1 if quote in alone else page.find(quote, at, end)
            if close < 0:
                alone.add(quote)
                value = PLAIN.match(page, at)[0]
                at += len(value)
            else:
                value, at = page[at:close], close + 1
        if value and m[2].lower() in TELLING:
            found.append(value)
    return " ".join(found), m.end()


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page, in order."""
    page, reader = page or "", Reader()
    done = at = 0  # up to where text is read, and tags are looked for
    end = page.rfind(">") + 1  # no tag ends later
    alone: set[str] = set()
    while (at := page.find("<", at, end)) >= 0:
        follows = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            reader.text(page[done:at])
            if m := re.match("-?>", page[at + 4 : at + 6]):
                done = at = at + 4 + m.end()
            else:
                close = COMMENT_END.search(page, at + 4)
                done = at = close.end() if close else len(page)
        elif m := TAG_NAME.match(page, at + 1):
            reader.text(page[done:at])
            tag = m[2].lower()
            names, done = attributes(page, m.end(), end, alone)
            at = done
            if m[1]:
                reader.end_tag(tag)
            elif tag in RAW:
                if tag == "iframe":
                    reader.end_block()
                found = RAW_END[tag].search(page, at)
                done = at = found.start() if found else len(page)
            else:
                reader.start_tag(tag, names, page[at - 2] == "/")
        elif follows in "!?/":
            reader.text(page[done:at])
            done = at = page.find(">", at) + 1
        else:
            at += 1
    reader.text(page[done:])
    reader.end_block()
    return reader.blocks


# Features.


def path_places(path: str) -> np.ndarray:
    """Places of a tag path's parts in its hashed vector."""
    steps = path.split("/")
    parts = {f"last {w}" for w in steps[-1].split(" ")}
    for step in steps:
        parts.update(step.split(" "))
    return np.array(sorted({zlib.crc32(p.encode()) % PATH_DIM for p in parts}))


class Words:
    """Buckets of words, remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def vector(self, block: Block) -> np.ndarray:
        out = np.zeros(WORD_DIM + RATIOS, np.float32)
        words = block.text.split(" ")
        known = self.known
        if len(known) > WORDS:
            known.clear()
        at = []
        for w in words:
            bucket = known.get(w)
            if bucket is None:
                bucket = known[w] = zlib.crc32(w.lower().encode()) % WORD_DIM
            at.append(bucket)
        out[:WORD_DIM] = np.bincount(at, minlength=WORD_DIM) / len(words)
        n = len(block.text)
        out[WORD_DIM:] = (
            np.log1p(len(words)) / 5,
            np.log1p(n) / 8,
            block.link_chars / n,
            block.text[-1] in ".!?:;…»\"'”",
            n / len(words) / 10,
            block.text[:1].isupper(),
        )
        return out


# The network.


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def flipped(n: int, lengths: np.ndarray) -> np.ndarray:
    """For each sequence, places 0 up to its length in reverse order; the rest as they are."""
    at = np.arange(n)[None, :]
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


class Labeller:
    """A bidirectional LSTM over sequences of blocks, and a logistic unit on its states."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + RATIOS, HIDDEN
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for way in "fb":
            self.p[f"w{way}"] = rng.normal(0, 0.1, (d, 4 * h))
            self.p[f"u{way}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p[f"b{way}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of sequences whose inputs ``x`` are projected: (sequence, place, 4 gates)."""
        u, h = self.p[f"u{way}"], HIDDEN
        n, length, _ = x.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((n, length, h), np.float32), []
        for t in range(length):
            z = x[:, t] + state @ u
            gates = sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before_cell, before_state = cell, state
            cell = f * before_cell + i * g
            tan = np.tanh(cell)
            state = o * tan
            out[:, t] = state
            if keep:
                kept.append((i, f, o, g, tan, before_cell, before_state))
        return out, kept

    def scores(self, xf: np.ndarray, xb: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-odds of each block, from projected inputs in page order."""
        flip = flipped(xf.shape[1], lengths)[..., None]
        forth, _ = self.states(xf, "f", False)
        back, _ = self.states(np.take_along_axis(xb, flip, 1), "b", False)
        both = np.concatenate([forth, np.take_along_axis(back, flip, 1)], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(
        self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray
    ) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients over sequences of inputs with labels."""
        p, h = self.p, HIDDEN
        flip = flipped(x.shape[1], lengths)[..., None]
        ways = {"f": x, "b": np.take_along_axis(x, flip, 1)}
        ran = {w: self.states(v @ p[f"w{w}"] + p[f"b{w}"], w, True) for w, v in ways.items()}
        both = np.concatenate([ran["f"][0], np.take_along_axis(ran["b"][0], flip, 1)], axis=2)
        prob = sigmoid(both @ p["out"] + p["bias"])
        mask = np.arange(x.shape[1])[None, :] < lengths[:, None]
        n = mask.sum()
        loss = -(np.log(np.where(y == 1, prob, 1 - prob) + 1e-12) * mask).sum() / n
        d = ((prob - y) * mask / n).astype(np.float32)
        grads = {"out": np.einsum("st,sth->h", d, both), "bias": d.sum(keepdims=True).reshape(1)}
        d_states = d[..., None] * p["out"]
        parts = {"f": d_states[..., :h], "b": np.take_along_axis(d_states[..., h:], flip, 1)}
        for w, ds in parts.items():
            u = p[f"u{w}"]
            dz_all = np.zeros((*ds.shape[:2], 4 * h), np.float32)
            du = np.zeros_like(u)
            d_state = d_cell = np.zeros((len(x), h), np.float32)
            for t in range(ds.shape[1] - 1, -1, -1):
                i, f, o, g, tan, before_cell, before_state = ran[w][1][t]
                d_state = d_state + ds[:, t]
                d_cell = d_cell + d_state * o * (1 - tan**2)
                dz = dz_all[:, t]
                dz[:, :h] = d_cell * g * i * (1 - i)
                dz[:, h : 2 * h] = d_cell * before_cell * f * (1 - f)
                dz[:, 2 * h : 3 * h] = d_state * tan * o * (1 - o)
                dz[:, 3 * h :] = d_cell * i * (1 - g**2)
                du += before_state.T @ dz
                d_state = dz @ u.T
                d_cell = d_cell * f
            flat = dz_all.reshape(-1, 4 * h)
            grads[f"w{w}"] = ways[w].reshape(len(flat), -1).T @ flat
            grads[f"u{w}"], grads[f"b{w}"] = du, flat.sum(axis=0)
        return loss, grads


def dense(page: list[Block], words: Words) -> np.ndarray:
    out = np.zeros((len(page), PATH_DIM + WORD_DIM + RATIOS), np.float32)
    for row, block in zip(out, page, strict=True):
        row[path_places(block.path)] = 1
        row[PATH_DIM:] = words.vector(block)
    return out


@cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted to sample pages, by Adam."""
    rng = np.random.default_rng(seed)
    words, data = Words(), []
    for _ in range(pages):
        found, labels = labelled(sample_page(rng))
        data.append((dense(found, words), np.array(labels, float)))
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        # Pages of like length side by side, batches in random order.
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]))
        batches = [order[a : a + 16] for a in range(0, len(order), 16)]
        for b in rng.permutation(len(batches)):
            some = [data[i] for i in batches[b]]
            lengths = np.array([len(y) for _, y in some])
            x = np.zeros((len(some), lengths.max(), some[0][0].shape[1]), np.float32)
            y = np.zeros(x.shape[:2], np.float32)
            for k, (xs, ys) in enumerate(some):
                x[k, : len(ys)], y[k, : len(ys)] = xs, ys
            _, grads = model.gradients(x, y, lengths)
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                rate = float(0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
                model.p[k] = model.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


class Extractor:
    """Main texts of pages, by a labeller; remembers projections of tag paths."""

    def __init__(self, model: Labeller):
        self.model, self.words = model, Words()
        self.paths: dict[str, np.ndarray] = {}
        self.own = np.concatenate([model.p["wf"], model.p["wb"]], axis=1)
        self.bias = np.concatenate([model.p["bf"], model.p["bb"]])

    def project(self, page: list[Block]) -> np.ndarray:
        if len(self.paths) > PATHS:
            self.paths.clear()
        rows = []
        for block in page:
            row = self.paths.get(block.path)
            if row is None:
                row = self.own[path_places(block.path)].sum(axis=0) + self.bias
                self.paths[block.path] = row
            rows.append(row)
        rest = np.stack([self.words.vector(b) for b in page])
        return np.stack(rows) + rest @ self.own[PATH_DIM:]

    def judge(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Log-odds of the blocks of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        batches: list[list[int]] = []
        for i in order:
            if (
                not batches
                or len(batches[-1]) >= SIDE_BY_SIDE
                or (len(batches[-1]) + 1) * len(pages[i]) > BLOCKS_AT_ONCE
            ):
                batches.append([])
            batches[-1].append(i)
        for some in batches:
            lengths = np.array([len(pages[i]) for i in some])
            x = np.zeros((len(some), lengths.max(), 8 * HIDDEN), np.float32)
            for k, i in enumerate(some):
                x[k, : lengths[k]] = self.project(pages[i])
            found = self.model.scores(x[..., : 4 * HIDDEN], x[..., 4 * HIDDEN :], lengths)
            for k, i in enumerate(some):
                out[i] = found[k, : lengths[k]]
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        found = [blocks(p) for p in pages]
        return [
            "\n".join(b.text for b, s in zip(page, scores, strict=True) if s > 0)
            for page, scores in zip(found, self.judge(found), strict=True)
        ]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trained())
    kind = pages.schema["page_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = extractor(shared.value).texts(batch.column("html").to_pylist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(found, pa.string()),
                pa.array([len(t) for t in found], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    return map_arrow(
        pages.select("page_id", "url", "html"),
        each,
        f"page_id {kind}, url string, text string, n_chars bigint",
    )


_extractors: dict[int, Extractor] = {}


def extractor(model: Labeller) -> Extractor:
    """This worker's extractor of a model."""
    if id(model) not in _extractors:
        _extractors.clear()
        _extractors[id(model)] = Extractor(model)
    return _extractors[id(model)]


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# Sample pages with known labels.

#: Marks article blocks of sample pages: a private-use character.
MARK = ""
SYLLABLES = (
    "the er in on an re ou ti th at en es or nd he st ed to it is ar te ve de le la un ein sch"
    " ung ich que ment tion elle eau ción ado mente ías per con sta mo ra li su pa é ü ñ ß"
).split()
#: Class and id words of page parts, fixed values.
NAMES_OF = {
    "nav": "nav navbar navigation menu main-menu topnav site-nav links tabs pagination pager toc",
    "header": "header site-header masthead top-bar branding logo banner page-header",
    "footer": "footer site-footer bottom copyright legal colophon page-footer",
    "sidebar": "sidebar side-bar aside widget widget-area rail secondary right-column",
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay paywall message",
    "ad": "ad ads advert advertisement ad-slot sponsored promo promotion sponsor banner-ad",
    "share": "share social social-share sharing follow-us buttons tools",
    "related": "related related-posts more-stories recommended read-next also-like trending popular",
    "comments": "comments comment comment-list discussion replies responses reader-comments respond",
    "form": "form newsletter subscribe signup search search-form contact-form login",
    "crumbs": "breadcrumb breadcrumbs crumbs path",
    "meta": "tags tag-list categories author-bio bio",
    "content": "content main-content article article-body post post-content entry entry-content"
    " story story-body body-text main text page-content post-body",
}


def sample_page(rng: np.random.Generator) -> str:
    """A page of some layout; each article block starts with ``MARK``."""

    def chance(p: float) -> bool:
        return rng.random() < p

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def words(low: int, high: int) -> str:
        out = []
        for _ in range(int(rng.integers(low, high + 1))):
            w = "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5))))
            end = pick([".", ",", "", "", "", "", "", ""])
            noise = pick(["***", "###", "%%%", "&amp;&amp;", "$$$"]) if noisy else ""
            out.append((w.title() if chance(0.15) else w) + end + noise)
        text = " ".join(out)
        return text + "." if chance(0.7) else text

    def named(part: str) -> str:
        name = pick(NAMES_OF[part].split())
        if chance(0.25):
            name = f"{name} {pick(['box', 'block', 'clearfix', 'col', 'inner', 'wrap', 'row'])}"
        quote = pick(['"', '"', "'"])
        return f" {pick(['class', 'class', 'class', 'id'])}={quote}{name}{quote}"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))

    def prose(low: int = 1, high: int = 3, mark: str = "") -> str:
        return "".join(
            f"<p>{mark}{inline(words(3, 60))}</p>" for _ in range(int(rng.integers(low, high + 1)))
        )

    def inline(text: str) -> str:
        if chance(0.2):
            tag = pick(["b", "i", "em", "strong", "span", 'a href="#"'])
            cut = len(text) // 2
            return f"{text[:cut]}<{tag}>{text[cut:]}</{tag.split()[0]}>"
        return text

    def part(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside"}.get(kind)
        tag, attrs = (tag, "") if tag and chance(0.55) else (pick(["div", "div", "section"]), named(kind))
        if tag in ("nav", "header", "footer", "aside") and chance(0.4):
            attrs = named(kind)
        if kind in ("nav", "crumbs"):
            body = f"<ul>{links(int(rng.integers(2, 9)))}</ul>" if chance(0.8) else words(1, 8)
        elif kind == "header":
            body = f"<{pick(['h1', 'h2', 'div', 'p'])}>{words(1, 6)}</div><p>{words(2, 10)}</p>"
        elif kind == "footer":
            body = pick([f"&copy; {words(1, 30)}", f"<p>&copy; {words(2, 25)}</p><ul>{links(3)}</ul>"])
        elif kind == "ad":
            body = pick([words(2, 40), f"<p>{words(3, 30)}</p>", f'<a href="#">{words(2, 12)}</a>'])
        elif kind == "comments":
            head = f"<h3>{words(1, 3)}</h3>" if chance(0.5) else ""
            body = head + "".join(
                f"<{w}{named('comments') if chance(0.6) else ''}>{prose(1, 2)}</{w}>"
                for w in [pick(["div", "li", "article"])] * int(rng.integers(1, 6))
            )
        elif kind in ("related", "sidebar", "meta"):
            body = f"<h3>{words(1, 4)}</h3>" + pick([f"<ul>{links(4)}</ul>", prose(1, 2)])
        elif kind == "form":
            label = f"<label>{words(1, 5)}</label><input name=q><button>{words(1, 2)}</button>"
            return f"<form{named('form') if chance(0.6) else ''}>{pick([label, prose(1, 1) + label])}</form>"
        else:
            body = pick([words(2, 30), prose(1, 2), f"<span>{words(1, 6)}</span>"])
        return f"<{tag}{attrs}>{body}</{tag}>"

    def content() -> str:
        out = []
        if chance(0.85):
            out.append(f"<h1>{MARK}{words(1, 10)}</h1>")
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.58:
                text = f"{MARK}{inline(words(1, 90))}"
                out.append(pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"]))
            elif kind < 0.66:
                level = pick(["h2", "h3", "h4"])
                out.append(f"<{level}>{MARK}{words(1, 8)}</{level}>")
            elif kind < 0.72:
                items = "".join(f"<li>{MARK}{words(1, 20)}</li>" for _ in range(int(rng.integers(1, 5))))
                out.append(pick([f"<ul>{items}</ul>", f"<ol>{items}</ol>"]))
            elif kind < 0.76:
                out.append(f"<blockquote>{prose(1, 1, MARK)}</blockquote>")
            elif kind < 0.79:
                out.append(f"<pre>{MARK}{words(3, 20)}</pre>")
            elif kind < 0.82:
                cells = "".join(f"<td>{MARK}{words(1, 4)}</td>" for _ in range(3))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.85:
                out.append(f"<figure><figcaption>{MARK}{words(2, 12)}</figcaption></figure>")
            elif kind < 0.88:
                out.append(f"<div>{MARK}{words(5, 60)}</div>")
            else:
                out.append(part(pick(["ad", "share", "related", "form", "notice", "meta"])))
        return "".join(out)

    noisy = chance(0.1)
    above = ["nav", "header", "ad", "notice", "crumbs", "form", "nav", "share"]
    below = ["footer", "comments", "related", "sidebar", "ad", "form", "share", "notice", "meta"]
    top = [part(k) for k in above if chance(0.4)]
    end = [part(k) for k in rng.permutation(below).tolist() if chance(0.4)]
    shell = rng.random()
    if shell < 0.45:
        middle = f"<article{named('content') if chance(0.3) else ''}>{content()}</article>"
    elif shell < 0.6:
        middle = f"<main><article>{content()}</article></main>"
    elif shell < 0.7:
        middle = f"<main>{content()}</main>"
    elif shell < 0.95:
        middle = f"<div{named('content')}>{content()}</div>"
    else:
        middle = ""
    if chance(0.2):
        middle = f"<div class=wrapper>{middle}{part('sidebar') if chance(0.5) else ''}</div>"
    inner = "".join([*top, middle, *end])
    return (
        f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head>"
        f'<body><script>var t="</p>";</script>{inner}' + ("</body></html>" if chance(0.9) else "")
    )


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a sample page without their marks, and which had one."""
    found = blocks(page)
    labels = [int(b.text.startswith(MARK)) for b in found]
    kept = [Block(b.path, b.text.replace(MARK, "").strip() or "-", b.link_chars) for b in found]
    return kept, labels

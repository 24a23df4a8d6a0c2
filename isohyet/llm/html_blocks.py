"""HTML extraction by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, in page order, each with its path of open tags.
A bidirectional LSTM (numpy) reads one vector per block - hashed tags, classes and ids of the whole path, all hashed words, a few
sizes - and labels each block as main text or not, seeing the whole page in both directions. Its weights (block_lstm.npz)
were trained by html_training.py on generated pages; nothing of the tables went into them.

Scripts, styles, comments and other markup never become text. Character references are decoded, white space inside
a block becomes one space, blocks are trimmed and joined by two line breaks. Broken markup is read as a browser would: a new
paragraph ends the open one, unknown end tags are skipped, an unfinished tag at the end is dropped.

Text inside elements that browsers may show instead of something else (object, noscript, canvas, iframe, math, svg, audio, video) is text like any other: the
labeller decides.

Null or empty html, and pages without main text, give an empty text (n_chars 0). Repeated rows are extracted each. An empty table
gives an empty result; there are no ties. Other columns are ignored, whatever their names. Very long pages are labelled in strips of `STRIP` blocks with the state carried over, so that what is held
for a page is its text and some 200 bytes a block, however many blocks or open tags it has.
"""

from __future__ import annotations

import functools
import html
import os
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements that start a block, have no end tag, or hold no text to be shown.
BLOCKS = frozenset("address article aside blockquote body button center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template".split())
#: An element that ends an open one of these, with what stops the search for it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")

#: Blocks of a strip.
STRIP = 1 << 13
TAG_BUCKETS, WORD_BUCKETS, SIZES = 160, 16, 8
INPUTS = TAG_BUCKETS + WORD_BUCKETS + SIZES


class _Buckets(dict):
    """Name or word -> bucket; those not longer than 64 characters are remembered, 65,536 at most."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % self.buckets
        if len(self) >= 1 << 16:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


_TAGS, _WORDS = _Buckets(TAG_BUCKETS), _Buckets(WORD_BUCKETS)


class Tag:
    """An open element. names: how often each bucket of tags, classes and ids occurs from the root to here."""

    __slots__ = ("name", "up", "four_up", "names")

    def __init__(self, name: str, attributes: str, up: Tag | None):
        self.name, self.up = name, up
        self.four_up = up and up.up and up.up.up and up.up.up.up  # the last element that is not among the last four
        own = np.zeros(TAG_BUCKETS, np.int32) if up is None else up.names.copy()
        own[_TAGS["<" + name]] += 1
        if "=" in attributes:
            for found in NAMES.findall(attributes):
                for part in PARTS.findall("".join(found).lower()):
                    own[_TAGS[part]] += 1
        self.names = own


@dataclass(slots=True)
class Block:
    """A run of text. tags: the hashed path in halves: the last four elements count two, those further up one, four at most."""

    tags: np.ndarray
    text: str
    linked: int


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks in order, white space and character references resolved."""
    blocks: list[Block] = []
    stack: list[Tag] = []
    is_open: Counter = Counter()
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tags = np.zeros(TAG_BUCKETS, np.int32)
                if stack:
                    here = stack[-1]
                    tags = 2 * here.names - (here.four_up.names if here.four_up else 0)
                blocks.append(Block(np.minimum(tags, 4).astype(np.uint8), text, linked))
            parts.clear()
        linked = 0

    def close_from(i: int) -> None:
        is_open.subtract(x.name for x in stack[i:])
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if (stop := m.start() if m else end) > at:
            parts.append(page[at:stop])
            if any(x.name == "a" for x in stack[-4:]):
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
        if closing:
            if is_open[tag] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == tag:
                        close_from(i)
                        break
                    if tag not in BLOCKS and stack[i].name in BLOCKS:
                        break
            continue
        if tag in HIDDEN:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and tag not in ("html", "head", "body") and is_open["p"] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    close_from(i)
                    break
                if stack[i].name in BLOCKS:
                    break
        if tag == "body":  # whatever head left open
            close_from(1)
        if tag in ENDS:
            own, limits = ENDS[tag]
            if any(is_open[x] > 0 for x in own):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in own:
                        close_from(i)
                        break
                    if stack[i].name in limits:
                        break
        stack.append(Tag(tag, attributes, stack[-1] if stack else None))
        is_open[tag] += 1
    flush()
    return blocks


def features(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """Vectors of blocks that are the `first` and following ones of `total`."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    total = len(blocks) if total is None else total
    for i, b in enumerate(blocks):
        words = b.text.lower().split(" ")
        n, n_words = len(b.text), len(words)
        x[i, :TAG_BUCKETS] = b.tags
        x[i, TAG_BUCKETS : TAG_BUCKETS + WORD_BUCKETS] = np.bincount([_WORDS[w] for w in words], minlength=WORD_BUCKETS) / n_words
        x[i, TAG_BUCKETS + WORD_BUCKETS :] = (
            np.log1p(n) / 5, np.log1p(n_words) / 4, min(1.0, b.linked / n), float(b.text[-1] in ".!?\"…"),
            min(1.0, 10 * sum(map(b.text.count, ",.;")) / n), (first + i) / total, float(first + i == 0), float(total < 4),
        )
    x[:, :TAG_BUCKETS] /= 2
    return x


class BlockLstm:
    """One layer in each direction, one logistic output. Gates in the order input, forget, cell, output."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: weights[k].astype(np.float32) for k in ("wf", "uf", "bf", "wb", "ub", "bb", "v", "c")}

    @staticmethod
    def run(z: np.ndarray, u: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """z: inputs' part of the gates, (step, page, 4 * hidden). Returns the hidden states and the state after the last step."""
        steps, pages, width = z.shape
        n, out = width // 4, np.zeros((z.shape[0], z.shape[1], z.shape[2] // 4), np.float32)
        h, c = state or (np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32))
        for t in range(steps):
            g = z[t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            c = s[:, n : 2 * n] * c + s[:, :n] * np.tanh(g[:, 2 * n : 3 * n])
            h = out[t] = s[:, 3 * n :] * np.tanh(c)
        return out, (h, c)

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """x: (step, page, input), padded at the end. Log odds, (step, page)."""
        w, steps = self.w, x.shape[0]
        back = np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)
        pages = np.arange(x.shape[1])[None, :]
        forward = self.run(x @ w["wf"] + w["bf"], w["uf"])[0]
        backward = self.run(x[back, pages] @ w["wb"] + w["bb"], w["ub"])[0][back, pages]
        return np.concatenate([forward, backward], axis=2) @ w["v"] + w["c"]

    def long_scores(self, blocks: list[Block], strip: int = STRIP) -> np.ndarray:
        """Log odds of one page's blocks: strip by strip forwards, then backwards, the state carried from strip to strip."""
        w, n = self.w, len(self.w["v"]) // 2
        out, starts = np.full(len(blocks), self.w["c"], np.float32), range(0, len(blocks), strip)
        for way, part in (("f", w["v"][:n]), ("b", w["v"][n:])):
            state, step = None, 1 if way == "f" else -1
            for s in starts[::step]:
                x = features(blocks[s : s + strip], s, len(blocks))[::step, None]
                hidden, state = self.run(x @ w["w" + way] + w["b" + way], w["u" + way], state)
                out[s : s + strip] += (hidden[:, 0] @ part)[::step]
        return out


@functools.lru_cache(1)
def model() -> BlockLstm:
    with np.load(os.path.join(os.path.dirname(__file__), "block_lstm.npz")) as f:
        return BlockLstm(dict(f))


def main_texts(pages: list[str | None], lstm: BlockLstm, cells: int = 1 << 14, strip: int = STRIP) -> list[str]:
    """Main text of each page. Pages of similar length are labelled together, `cells` blocks at most; those of more than `strip` blocks by themselves."""
    out, small = [""] * len(pages), []
    for i, page in enumerate(pages):
        own = leaf_blocks(page) if page else []
        if len(own) > strip:
            out[i] = "\n\n".join(b.text for b, odds in zip(own, lstm.long_scores(own, strip)) if odds > 0)
        elif own:
            small.append((i, own))
    small.sort(key=lambda x: len(x[1]))
    start = 0
    while start < len(small):
        stop = start + 1
        while stop < len(small) and len(small[stop][1]) * (stop + 1 - start) <= cells:
            stop += 1
        group, start = small[start:stop], stop
        sizes = np.array([len(own) for _, own in group])
        x = np.zeros((sizes.max(), len(group), INPUTS), np.float32)
        for k, (_, own) in enumerate(group):
            x[: sizes[k], k] = features(own)
        chosen = lstm.scores(x, sizes) > 0
        for k, (i, own) in enumerate(group):
            out[i] = "\n\n".join(b.text for b, main in zip(own, chosen[:, k]) if main)
    return out


def _extract(batches):
    lstm = model()
    for batch in batches:
        texts = []
        column = batch.column(2)
        for i in range(0, batch.num_rows, 64):
            texts += main_texts(column.slice(i, 64).to_pylist(), lstm)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")

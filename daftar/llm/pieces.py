"""Oversized texts cut into overlapping pieces at natural boundaries.

All texts of a block are laid end to end in one array of code points.  Every
boundary (end of paragraph, sentence or word) is joined to its farthest legal
successor, which gives one successor table for the whole block; squaring that
table reaches the greedy cuts of all texts at once in a logarithmic number of
steps, however long a text is.

A piece ends at a boundary e and the next begins ``overlap`` characters before
e.  A successor is the farthest paragraph end in the upper half of the window,
else the farthest sentence end there, else the farthest natural boundary in the
window, else the farthest word end; words longer than the window get
boundaries at its width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAGE = re.compile(r"(?m)^#[^\S\n]*Page[^\S\n]*(\d+)[^\S\n]*$")
_BLOCK = 1_000_000  # code points worked on at a time; a longer text is a block of its own
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDERS = [ord(c) for c in ".?!।"]
WORD, SENTENCE, PARAGRAPH = 1, 2, 3

_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[_SPACES] = True


class Block:
    """Boundaries of some texts, as positions in their concatenation.

    ``at`` holds the cut positions (first character after white space, and the
    end of each text), ``level`` how natural each is, ``before`` where the
    white space before it begins, ``owner`` the text it belongs to.
    """

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _IS_SPACE[np.minimum(code, 0x3001)]
        n = len(code)
        first = np.zeros(n + 1, bool)
        first[self.start] = True
        # Cut positions: a character that follows white space or begins a text.
        cut = np.zeros(n + 1, bool)
        if n:
            cut[1:n] = ~space[1:] & space[:-1]
        cut |= first
        self.at = np.flatnonzero(cut)
        ink = np.where(space, 0, np.arange(1, n + 1))
        last_ink = np.concatenate([[0], np.maximum.accumulate(ink)]) if n else np.zeros(1, np.int64)
        self.before = last_ink[self.at]
        lines = np.concatenate([[0], np.cumsum(code == 10)])
        blank = lines[self.at] - lines[self.before] >= 2
        ends = np.isin(code[np.maximum(self.before - 1, 0)], _ENDERS) if n else np.zeros(len(self.at), bool)
        self.level = np.where(first[self.at] | blank, PARAGRAPH, np.where(ends, SENTENCE, WORD))
        self.sizes = sizes

    def longest(self, level: int) -> np.ndarray:
        """Per text the longest unit between boundaries of at least ``level``, without the white space after it."""
        k = np.flatnonzero(self.level >= level)
        at, before = self.at[k], self.before[k]
        out = np.zeros(len(self.sizes), np.int64)
        if len(at) > 1:
            unit = np.maximum(before[1:] - at[:-1], 0)
            owner = np.searchsorted(self.start, at[:-1], "right") - 1
            np.maximum.at(out, owner, unit)
        return out

    def cuts(self, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, end) of every piece, by pointer doubling over the successor table."""
        step = limit - overlap
        at, level = self.at, self.level
        gaps = np.diff(at)
        if len(gaps) and gaps.max() > step:
            wide = np.flatnonzero(gaps > step)
            more = np.concatenate([np.arange(at[k] + step, at[k + 1], step) for k in wide])
            order = np.argsort(np.concatenate([at, more]), kind="stable")
            level = np.concatenate([level, np.zeros(len(more), level.dtype)])[order]
            at = np.concatenate([at, more])[order]
        owner = np.searchsorted(self.start, at, "right") - 1
        owner = np.minimum(owner, len(self.sizes) - 1)
        # The end of one text is the start of the next: as a successor it is the end, as a source the start.
        stop = self.start[owner + 1]
        is_start = at == self.start[owner]
        reach = np.where(is_start, at + limit, at + step)
        half = np.where(is_start, at + limit // 2, at + step // 2)
        # A first piece no longer than the overlap would lie wholly inside the second.
        low = np.where(is_start, at + overlap, at)
        rank = np.arange(len(at))

        def farthest(least: int) -> np.ndarray:
            own = np.where(level >= least, rank, -1)
            return np.maximum.accumulate(own)[np.searchsorted(at, reach, "right") - 1]

        succ = farthest(0)
        for least, floor in ((WORD, low), (SENTENCE, low), (SENTENCE, half), (PARAGRAPH, half)):
            f = farthest(least)
            succ = np.where((f >= 0) & (at[np.maximum(f, 0)] > floor), f, succ)
        ending = np.searchsorted(at, stop)
        succ = np.where(stop <= reach, ending, succ)
        # An end of text is its own successor: one extra node per text, so that the next text's start stays a source.
        m, k = len(at), len(self.sizes)
        node = np.concatenate([np.where(succ == ending, m + owner, succ), m + np.arange(k)])
        hit = np.zeros(m + k, bool)
        sources = np.searchsorted(at, self.start[:-1])[self.sizes > 0]
        # Empty texts share a position with the text after them, whose start it is.
        hit[sources] = True
        table = node
        while True:
            reached = np.flatnonzero(hit)
            hit[table[reached]] = True
            squared = table[table]
            if np.array_equal(squared, table):
                break
            table = squared
        hit[node[np.flatnonzero(hit)]] = True
        cut = np.flatnonzero(hit[:m] & ~is_start)
        ended = np.flatnonzero(hit[m:])
        text = np.concatenate([owner[cut], ended])
        end = np.concatenate([at[cut], self.start[ended + 1]])
        order = np.lexsort((end, text))
        return text[order], end[order]


def page_marks(text: str) -> tuple[list[int], list[int], list[int]]:
    """Start, end and number of each page mark. Numbers beyond int are no pages."""
    found = [(m.start(), m.end(), int(m[1])) for m in PAGE.finditer(text) if len(m[1]) < 10]
    return tuple(map(list, zip(*found))) if found else ([], [], [])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        if k > a and size + len(t) > _BLOCK:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _pages(text: str, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    mark, done, number = page_marks(text)
    if not mark:
        return [(1, 1)] * len(starts)
    out = []
    for s, e in zip(starts, ends):
        body = text[s:e]
        head = s + len(body) - len(body.lstrip())
        tail = s + len(body.rstrip())
        i, j = np.searchsorted(mark, head, "right") - 1, np.searchsorted(done, tail, "left") - 1
        first, last = number[i] if i >= 0 else 1, number[j] if j >= 0 else 1
        # A piece that ends with a bare page mark has nothing of that page.
        out.append((first, last if j >= i else first))
    return out


def split(df: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 150) -> DataFrame:
    """Pieces of each text: (key, chunk_index, page_start, page_end, start, stop, piece).

    Every character is in a piece, pieces follow each other with exactly
    ``overlap`` characters in common and have at most ``limit``.  Null texts and
    texts of no character have no piece; rows are taken as they are, so a text
    stored twice is cut twice.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, texts = b["k"].tolist(), b["t"].tolist()
            for lo, hi in _blocks(texts):
                block = Block(texts[lo:hi])
                owner, end = block.cuts(limit, overlap)
                rows = []
                for i in np.unique(owner):
                    t, base = texts[lo + i], block.start[i]
                    stops = (end[owner == i] - base).tolist() if len(owner) < 64 else (end[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")] - base).tolist()
                    starts = [0, *(max(0, e - overlap) for e in stops[:-1])]
                    for n, (s, e, p) in enumerate(zip(starts, stops, _pages(t, starts, stops))):
                        rows.append((keys[lo + i], n, p[0], p[1], s, e, t[s:e]))
                yield pd.DataFrame(rows, columns=["k", "chunk_index", "page_start", "page_end", "start", "stop", "piece"])

    cols = df.selectExpr(f"`{key}` as k", f"`{text}` as t").where("t is not null and t <> ''")
    return cols.mapInPandas(run, f"k {kind}, chunk_index int, page_start int, page_end int, start int, stop int, piece string").withColumnRenamed("k", key)


def survey(df: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 150) -> DataFrame:
    """(key, n_pieces, paragraph, sentence, word, pages): how far each text is from the limit.

    ``n_pieces`` counts the cuts of ``split``; the next three are the longest
    unit whose end no boundary of that level reaches, ``pages`` the numbers of
    its page marks (1 where it has none).
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, texts = b["k"].tolist(), b["t"].tolist()
            for lo, hi in _blocks(texts):
                block = Block(texts[lo:hi])
                owner, _ = block.cuts(limit, overlap)
                yield pd.DataFrame({
                    "k": keys[lo:hi], "n_pieces": np.bincount(owner, minlength=hi - lo).astype("int32"),
                    "paragraph": block.longest(PARAGRAPH), "sentence": block.longest(SENTENCE), "word": block.longest(WORD),
                    "pages": [sorted(set(page_marks(t)[2])) or [1] for t in texts[lo:hi]],
                })

    cols = df.selectExpr(f"`{key}` as k", f"`{text}` as t").where("t is not null")
    return cols.mapInPandas(run, f"k {kind}, n_pieces int, paragraph long, sentence long, word long, pages array<int>").withColumnRenamed("k", key)

"""Noise in scanned text: page furniture, broken words and misread letters.

Misread letters are found by a noisy channel.  The corpus gives word and
word-pair counts; pairs of a rare and a frequent word that differ in one short
stretch give the confusions and their probabilities, and a word whose count its
confusions explain is no word of the language.  A line's words get candidates
(themselves and what the confusions make of them) and Viterbi picks the
sequence of greatest channel times n-gram probability.

Counting covers all texts.  All words are listed, and all pairs that occur
twice: the floors are numbers of occurrences, the same at every size of corpus.
The lists therefore grow with the vocabulary, not with the text; README gives
their measured size.

Stored pieces are whole lines of their document.  A piece is laid along the
lines of its document, so each of its lines takes the label of the very line it
came from; what its document lacks is labelled by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.languages import _CLOSE, _HEAD, _LIST
from daftar.llm.lookalike import look
from daftar.session import Scratch

LISTED_WORD, LISTED_PAIR, FREQUENT = 3, 2, 20  # occurrences: of a word of the lexicon, of a pair, of a word that misreadings are learned from
SUPPORT, RARE, EXPLAINED = 4, 0.05, 12.0

_LETTER = "[^\\W\\d_ऀ-ः़ा-ॏ॑-ॗॢॣ]"
# ASCII digits may stand for letters inside a Latin word.
_TAIL = r"(?:[^\W\d_]|[ऀ-ः़ा-ॏ॑-ॗॢॣ]|(?<=[a-z])[0-9]|(?<=[a-z][0-9])[0-9])*"
_WORD = re.compile(rf"(?:\b[0-9](?=[a-z]))?{_LETTER}{_TAIL}(?:-{_LETTER}{_TAIL})*")
_MARK = re.compile(r"^\s*#\s*Page\s*\d+\s*$")
_NUMBER = r"[\[(\-–—\s]*(?:(?:पृष्ठ|पान|पृ\.|Page|Pg\.?|P\.)\s*)?[0-9०-९]{1,4}(?:\s*(?:/|of|पैकी|में से|-)\s*[0-9०-९]{1,4})?[\])\-–—.\s]*"
_PAGE_NUMBER = re.compile(rf"^{_NUMBER}$", re.IGNORECASE)
_WITH_NUMBER = re.compile(rf"(?:^\s*{_NUMBER}\s{{2,}})|(?:\s{{2,}}{_NUMBER}$)", re.IGNORECASE)
_BARE_TABLE = re.compile(r"^\s*[0-9०-९]+\s*$")
_NO_LETTER = re.compile(r"(?:[\W\d_](?<![ऀ-ॣ]))+")
_DIGIT = re.compile(r"\d")
_OUTLINE = re.compile(r"^\s*(?:\d{1,3}[).]\s|.*\|)")
_SIGNS = "-‐‑－­¬"
_INVISIBLE = "​⁠﻿ \t\xa0 \r"


def _key(line: str) -> str:
    """Letters of a line without its page number."""
    return _NO_LETTER.sub("", _WITH_NUMBER.sub(" ", line).casefold())


def _grams(key: str) -> set[str]:
    return {key[i : i + 3] for i in range(len(key) - 2)} or {key}


class Layout:
    """Kind of every line of a text: mark, blank, pageno, running, outline, head, close or body."""

    def __init__(self, text: str, paged: bool = True):
        self.raw = text.split("\n")
        self.seen = look(text).split("\n")
        lines = self.seen
        kinds = ["blank" if not x.strip() else "mark" if _MARK.match(x) else "outline" if _OUTLINE.match(x) else "body" for x in lines]
        self.kinds = kinds
        if not paged:
            self._by_line()
            return
        # Blocks of each page; a page mark also ends a block.
        pages: list[list[list[int]]] = [[]]
        fresh = True
        for i, k in enumerate(kinds):
            if k == "mark":
                pages.append([])
                fresh = True
            elif k == "blank":
                fresh = True
            else:
                if fresh:
                    pages[-1].append([])
                pages[-1][-1].append(i)
                fresh = False
        pages = [p for p in pages if p]
        blocks = [b for p in pages for b in p]
        for b in blocks:
            if any(_LIST.search(lines[i].strip()) for i in b):
                for i in b:
                    kinds[i] = "outline"
            elif len(b) > 1 and any(_HEAD.search(lines[i].strip()) for i in b) and not (len(b) == 2 and any(_PAGE_NUMBER.match(lines[i].strip()) for i in b)):
                self._letterhead(b)
            elif len(b) > 2 and sum(bool(_BARE_TABLE.match(lines[i])) for i in b) * 2 >= len(b):
                for i in b:
                    kinds[i] = "outline"
        for b in blocks:
            for n, i in enumerate(b):
                if kinds[i] == "body" and _CLOSE.search(lines[i].strip()):
                    for j in b[n:]:
                        if kinds[j] == "body":
                            kinds[j] = "close"
                    break
        self._furniture(pages)

    def _by_line(self) -> None:
        """Kinds in a piece of a text, which has neither blank lines nor page marks to go by."""
        kinds, lines = self.kinds, self.seen
        heads = [i for i, x in enumerate(lines) if _HEAD.search(x.strip())]
        own: set[str] = set()
        if heads and heads[-1] < 12:
            for i in range(heads[-1] + 1):
                kinds[i] = "head"
            keys = [_key(x) for x in lines[: heads[-1] + 1]]
            own = set().union(*(_grams("".join(keys[j : j + 2])) for j in range(len(keys))))
        bare = [bool(_BARE_TABLE.match(x)) for x in lines] + [False]
        for i, x in enumerate(lines):
            x = x.strip()
            if kinds[i] != "body":
                continue
            key = _key(x)
            if _LIST.search(x) or bare[i] and (bare[i - 1] or bare[i + 1]):
                kinds[i] = "outline"
            elif _CLOSE.search(x):
                kinds[i] = "close"
            elif _PAGE_NUMBER.match(x) and int(re.search(r"\d+", x)[0]) <= 99:
                kinds[i] = "pageno"
            elif x[-1:] not in ".?!।" and len(key) >= 4:
                g = _grams(key)
                if (own and len(g & own) * 100 >= 85 * len(g)) or _WITH_NUMBER.search(x):
                    kinds[i] = "running"

    def _letterhead(self, block: list[int]) -> None:
        """Lines of a letterhead up to its last heading line; running text that follows in the same block stays body."""
        last = max(n for n, i in enumerate(block) if _HEAD.search(self.seen[i].strip()))
        for i in block[: last + 1]:
            self.kinds[i] = "head"

    def _furniture(self, pages: list[list[list[int]]]) -> None:
        kinds, lines = self.kinds, self.seen
        edge: dict[int, int] = {}
        for n, p in enumerate(pages):
            for b in (p[0], p[-1], *(p[1:2] if len(p) > 2 and len(p[0]) == 1 else ()), *(p[-2:-1] if len(p) > 2 and len(p[-1]) == 1 else ())):
                if len(b) <= 2:
                    edge.update((i, n) for i in b if kinds[i] in ("body", "close"))
        for i in list(edge):
            if _PAGE_NUMBER.match(lines[i].strip()):
                # Far beyond the pages there are, it is a cell of a table.
                if int(re.search(r"\d+", lines[i])[0]) <= len(pages) + 20:
                    kinds[i] = "pageno"
                del edge[i]
        keys = {i: _key(lines[i]) for i in edge}
        grams = {i: _grams(k) for i, k in keys.items() if len(k) >= 4}
        if not grams:
            return
        head = [_key(lines[i]) for i, k in enumerate(kinds) if k == "head"]
        own = set().union(*(_grams("".join(head[j : j + 2])) for j in range(len(head)))) if head else set()
        by_key = defaultdict(set)
        for i in grams:
            by_key[keys[i]].add(edge[i])
        for i, g in grams.items():
            # A sentence that ends, or a word that breaks off, is text.
            if kinds[i] == "close" or _WITH_NUMBER.sub("", lines[i]).rstrip(_INVISIBLE)[-1:] in ".?!।" or (break_sign(self.raw[i]) and not re.search(r"\d", lines[i])):
                continue
            twin = len(by_key[keys[i]]) > 1 or any(
                edge[j] != edge[i] and abs(len(g) - len(h)) * 3 < len(g) + 3 and len(g & h) * 10 >= 6 * len(g | h) for j, h in grams.items() if j != i
            )
            if twin or (own and len(g & own) * 100 >= 85 * len(g)):
                kinds[i] = "running"

    def flow(self) -> list[int]:
        """The lines of running text in order, furniture and page marks left out."""
        return [i for i, k in enumerate(self.kinds) if k == "body"]


def break_sign(raw: str) -> str:
    """The break sign a line ends with, if it follows a letter; else nothing."""
    tail = raw.rstrip(_INVISIBLE)
    if len(tail) > 1 and tail[-1] in _SIGNS:
        before = look(tail[:-1])[-1:]
        if before.isalpha() or "ऀ" <= before <= "ॣ":
            return tail[-1]
    return ""


def flowing(layout: Layout) -> tuple[list[tuple[str, int, int]], dict[int, tuple[str, str, str]]]:
    """Words of the running text as (lower-case word, first line, last line), and the line-end breaks.

    A break is (left part, right part, sign).  A word broken over lines comes
    once, joined by a plain hyphen for now: ``left + '\\0' + right``.
    """
    words: list[tuple[str, int, int]] = []
    breaks: dict[int, tuple[str, str, str]] = {}
    open_at: int | None = None
    for i in layout.flow():
        line = layout.seen[i].rstrip(_INVISIBLE)
        sign = break_sign(layout.raw[i])
        if sign and line[-1:] in "-¬":
            line = line[:-1]
        found = _WORD.findall(line.lower())
        at_start = bool(line.strip()) and bool(found) and line.lower().lstrip().startswith(found[0])
        if open_at is not None:
            left, before, _ = words[-1]
            sign_before = breaks[open_at][2]
            if at_start:
                breaks[open_at] = (left, found[0], sign_before)
                words[-1] = (left + "\0" + found[0], before, i)
                found = found[1:]
                if not found and sign:
                    # The whole line is the middle of a word.
                    breaks[i] = (words[-1][0], "", sign)
                    open_at = i
                    continue
            open_at = None
        words.extend((w, i, i) for w in found)
        if sign and found and line.lower().endswith(found[-1]):
            breaks[i] = (found[-1], "", sign)
            open_at = i
    return words, breaks


_TORN = re.compile(r"(?<=[^\W\d_])[-‐‑－¬\xad][ \t\u200b\u2060\ufeff]*\n[ \t]*(?=[^\W\d_])")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        one: Counter = Counter()
        two: Counter = Counter()
        for text in b["t"].tolist():
            found = _WORD.findall(look(_TORN.sub("", text)).lower())
            one.update(found)
            two.update(zip(found, found[1:]))
        yield pd.DataFrame({"a": [*one, *(x for x, _ in two)], "b": [*("" for _ in one), *(y for _, y in two)], "n": [*one.values(), *two.values()]})


class Channel:
    """Lexicon, confusions with their probabilities, and n-gram counts."""

    def __init__(self, words: dict[str, int], pairs: dict[tuple[str, str], int]):
        self.total = max(sum(words.values()), 1)
        self.confusions = self._learn(words)
        self.inverse: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for (old, new), p in self.confusions.items():
            self.inverse[new].append((old, p))
        self.words = words
        # Words whose count their confusions explain are no words.
        self.lexicon = {w: n for w, n in words.items() if n >= LISTED_WORD and not _DIGIT.search(w) and not self._explained(w, n)}
        self.pairs = {k: n for k, n in pairs.items() if k[0] in self.lexicon and k[1] in self.lexicon}
        self.doubtful = {w: c for w in self.lexicon if (c := [x for x in self._variants(w) if x[0] != w])}
        self.stems = {w[:i] for w in self.lexicon for i, c in enumerate(w) if c == "-"}
        self._memo: dict[str, list[tuple[str, float]]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "words")}

    def __setstate__(self, state):
        self.__dict__.update(state, _memo={})

    @staticmethod
    def _learn(words: dict[str, int]) -> dict[tuple[str, str], float]:
        holes: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for f, n in words.items():
            if n >= FREQUENT and len(f) > 2 and not _DIGIT.search(f):
                for i in range(len(f) + 1):
                    for a in range(0, min(3, len(f) - i) + 1):
                        holes[f[:i] + "\0" + f[i + a :]].append((f, f[i : i + a]))
        support: dict[tuple[str, str], set[str]] = defaultdict(set)
        mass: Counter = Counter()
        for r, n in words.items():
            if len(r) < 3:
                continue
            best: dict[tuple[str, str], str] = {}
            for i in range(len(r) + 1):
                for b in range(0, min(2, len(r) - i) + 1):
                    new = r[i : i + b]
                    for f, old in holes.get(r[:i] + "\0" + r[i + b :], ()):
                        # Stretches are taken at their shortest: no common letter at either end.
                        if old == new or n > RARE * words[f] or (old and new and (old[0] == new[0] or old[-1] == new[-1])) or "-" in old + new:
                            continue
                        best[old, new] = f
            for op, f in best.items():
                support[op].add(f)
                mass[op] += n
        sites: Counter = Counter()
        wanted = {op for op, s in support.items() if len(s) >= SUPPORT}
        olds = {old for old, _ in wanted}
        for f, n in words.items():
            for old in olds:
                k = len(f) + 1 if not old else f.count(old)
                if k:
                    sites[old] += n * k
        found = {op: min(mass[op] / max(sites[op[0]], 1), 0.2) for op in wanted if mass[op] and sites[op[0]]}
        # Inflections and torn words meet by chance; misreadings are as frequent as each other.
        usual = sorted(found.values())[len(found) // 2] if found else 0
        return {op: p for op, p in found.items() if p >= (0.3 if op[0] and op[1] else 0.8) * usual and not (len(op[0]) > 1 and not op[1])}

    def _variants(self, w: str) -> list[tuple[str, float]]:
        """Listed words that one confusion turns into ``w``, with its probability."""
        out: dict[str, float] = {}
        for i in range(len(w) + 1):
            for b in range(0, min(2, len(w) - i) + 1):
                for old, p in self.inverse.get(w[i : i + b], ()):
                    x = w[:i] + old + w[i + b :]
                    if x != w and x in (self.lexicon if hasattr(self, "lexicon") else self.words):
                        out[x] = max(out.get(x, 0), p)
        return sorted(out.items())

    def _explained(self, w: str, n: int) -> bool:
        if len(w) < 3:
            return False
        return any(n <= RARE * self.words[x] and n <= max(2.0, EXPLAINED * p * self.words[x]) for x, p in self._variants(w))

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """(word, log channel probability); the word itself first."""
        if (known := self._memo.get(w)) is not None:
            return known
        listed = w in self.lexicon
        out = [(w, -0.02)]
        if listed:
            out += [(x, math.log(p)) for x, p in self.doubtful.get(w, ())]
        elif len(w) > 1:
            first = self._variants(w)
            out += [(x, math.log(p)) for x, p in first]
            if not first and len(w) > 3:
                two: dict[str, float] = {}
                for i in range(len(w) + 1):
                    for b in range(0, min(2, len(w) - i) + 1):
                        for old, p in self.inverse.get(w[i : i + b], ()):
                            for x, q in self._variants(w[:i] + old + w[i + b :]):
                                if x != w:
                                    two[x] = max(two.get(x, 0), p * q)
                out += [(x, math.log(p)) for x, p in sorted(two.items())]
        if len(self._memo) > 100_000:  # a memory bound of the cache; what falls out is made again
            self._memo.clear()
        self._memo[w] = out
        return out

    def _pair(self, a: str, b: str) -> float:
        n = self.pairs.get((a, b), 0)
        if n and b in self.doubtful:
            n = max(0.0, n - EXPLAINED * sum(p * self.pairs.get((a, x), 0) for x, p in self.doubtful[b]))
        if n and a in self.doubtful:
            n = max(0.0, n - EXPLAINED * sum(p * self.pairs.get((x, b), 0) for x, p in self.doubtful[a]))
        one = self.lexicon.get(b, 0.05) / self.total
        return math.log(0.7 * n / self.lexicon.get(a, 1e9) + 0.3 * one)

    def decode(self, words: list[str]) -> list[str]:
        """The most probable words behind ``words`` (Viterbi over their candidates)."""
        states = [(0.0, None, "")]
        history = []
        for w in words:
            step = []
            for x, channel in self.candidates(w):
                k = max(range(len(states)), key=lambda j: states[j][0] + self._pair(states[j][2], x))
                step.append((states[k][0] + self._pair(states[k][2], x) + channel, k, x))
            history.append(step)
            states = step
        out, k = [], max(range(len(states)), key=lambda j: states[j][0]) if words else 0
        for step in reversed(history):
            out.append(step[k][2])
            k = step[k][1] or 0
        return out[::-1]

    def whole(self, left: str, right: str, sign: str) -> tuple[str, bool]:
        """The word behind a line break, and whether the break sign is its own."""
        plain, dashed = left + right, left + "-" + right
        if sign in "-‐‑－":
            # Counting joined all torn words, so a compound torn at its own hyphen is also listed without it.
            if self.lexicon.get(dashed, 0) > self.lexicon.get(plain, 0):
                return dashed, True
            if plain not in self.lexicon and dashed not in self.lexicon:
                a = max((self.lexicon.get(x, 0) for x, _ in self.candidates(dashed)[1:]), default=0)
                b = max((self.lexicon.get(x, 0) for x, _ in self.candidates(plain)[1:]), default=0)
                if a > b:
                    return dashed, True
        return plain, False


def fit(docs: DataFrame, text: str) -> Channel:
    """The channel of a corpus; null texts count for nothing."""
    counts = docs.select(F.col(text).alias("t")).where("t is not null").mapInPandas(_counts, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = Scratch(docs.sparkSession, "ocr").write(counts, "counts")
    words = {r["a"]: r["n"] for r in counts.where("b = ''").toLocalIterator()}
    pairs = counts.where("b <> ''").where(F.col("n") >= LISTED_PAIR)
    return Channel(words, {(a, b): n for a, b, n in pairs.toPandas().itertuples(index=False)})


def label(channel: Channel, text: str, paged: bool = True) -> list[tuple[int, str]]:
    """(line number, noise) of a text."""
    layout = Layout(text, paged)
    words, breaks = flowing(layout)
    return _noise(channel, layout, breaks, misread_lines(channel, words, breaks), paged)


def _noise(channel: Channel, layout: Layout, breaks: dict[int, tuple[str, str, str]], bad: set[int], paged: bool = True) -> list[tuple[int, str]]:
    out = [(i, k) for i, k in enumerate(layout.kinds) if k in ("running", "pageno")]
    for i, (left, right, sign) in breaks.items():
        left = left.rsplit("\0", 1)[-1]
        if right or not paged:
            if sign not in "-‐‑－" or not (channel.whole(left, right, sign)[1] if right else left in channel.stems):
                out.append((i, "hyphen"))
        else:
            # The text ends here: only a stem of a compound may have a hyphen of its own.
            if sign not in "-‐‑－" or left not in channel.stems:
                out.append((i, "hyphen"))
    out.extend((i, "misread") for i in bad)
    return sorted(set(out))


def misread_lines(channel: Channel, words: list[tuple[str, int, int]], breaks: dict[int, tuple[str, str, str]]) -> set[int]:
    lexicon, doubtful = channel.lexicon, channel.doubtful
    plain = []
    for w, a, b in words:
        if "\0" in w:
            left, _, right = w.partition("\0")
            w = channel.whole(left, right.replace("\0", ""), breaks[a][2] if a in breaks else "-")[0]
        plain.append(w)
    lines: set[int] = set()
    n = len(plain)
    k = 0
    while k < n:
        w = plain[k]
        if w in lexicon and w not in doubtful:
            k += 1
            continue
        # A run of words in doubt is decoded between the sure words at its ends.
        lo = k
        while k < n and (plain[k] not in lexicon or plain[k] in doubtful):
            k += 1
        head = plain[lo - 1 : lo]
        tail = plain[k : k + 1]
        run = plain[lo:k]
        if all(len(channel.candidates(x)) == 1 for x in run):
            continue
        best = channel.decode(head + run + tail)[len(head) : len(head) + len(run)]
        for j, (was, now) in enumerate(zip(run, best)):
            if was != now:
                _, a, b = words[lo + j]
                if a == b:
                    lines.add(a)
                else:
                    cut = len(words[lo + j][0].partition("\0")[0])
                    same = next((x for x in range(min(len(was), len(now))) if was[x] != now[x]), min(len(was), len(now)))
                    lines.add(a if same < cut else b)
    return lines


def repair(channel: Channel, text: str) -> str:
    """The text as continuous paragraphs: furniture and page marks gone, words joined, misread words corrected, nothing else changed."""
    layout = Layout(text)
    words, breaks = flowing(layout)
    return _paragraphs(channel, layout, breaks, misread_lines(channel, words, breaks))


def repair_piece(channel: Channel, text: str, noise: list[tuple[int, str]]) -> str:
    """``repair`` of a piece, by the noise of its lines: what is furniture and what is misread was found in its document."""
    layout = Layout(text, paged=False)
    furniture = {i: k for i, k in noise if k in ("running", "pageno")}
    layout.kinds = [furniture.get(i, "body" if k in ("running", "pageno") else k) for i, k in enumerate(layout.kinds)]
    breaks = flowing(layout)[1] if any(map(break_sign, layout.raw)) else {}
    return _paragraphs(channel, layout, breaks, {i for i, k in noise if k == "misread"})


def _paragraphs(channel: Channel, layout: Layout, breaks: dict[int, tuple[str, str, str]], bad: set[int]) -> str:
    paragraphs: list[str] = []
    current = ""
    joined = bridged = False
    for i, kind in enumerate(layout.kinds):
        if kind in ("mark", "running", "pageno"):
            continue
        if kind == "blank":
            # A page end inside a sentence does not end the paragraph.
            bridged = bridged or bool(current) and _broken_off(current, layout, i)
            if current and not bridged and not joined:
                paragraphs.append(current)
                current = ""
            continue
        bridged = False
        line = layout.seen[i].strip()
        if i in bad:
            line = _corrected(channel, line)
        if kind != "body":
            current += ("\n" if current else "") + line
            joined = False
            continue
        if i in breaks and breaks[i][1]:
            left, right, sign = breaks[i]
            own = channel.whole(left.rsplit("\0", 1)[-1], right, sign)[1]
            stem = line[:-1] if line[-1:] in "-¬" else line
            current += ("" if joined or not current else " ") + stem + ("-" if own else "")
            joined = True
        else:
            glue = "" if joined or not current else "\n" if layout.kinds[i - 1] in ("head", "outline", "close") else " "
            current += glue + line
            joined = False
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def _broken_off(current: str, layout: Layout, at: int) -> bool:
    """Whether the blank line at ``at`` only surrounds a page change in the middle of a sentence."""
    if current.rstrip()[-1:] in ".?!।:":
        return False
    crossed = False
    for k in layout.kinds[at:]:
        if k in ("mark", "running", "pageno"):
            crossed = True
        elif k != "blank":
            return crossed and k == "body"
    return False


def _corrected(channel: Channel, line: str) -> str:
    found = list(_WORD.finditer(line))
    best = channel.decode([m[0].lower() for m in found])
    out, last = [], 0
    for m, now in zip(found, best):
        was = m[0]
        out.append(line[last : m.start()])
        out.append(was if was.lower() == now else now.capitalize() if was[:1].isupper() else now)
        last = m.end()
    return "".join(out) + line[last:]


def labels(df: DataFrame, key: str, text: str, channel: Channel, paged: bool = True) -> DataFrame:
    """(key, line_no, noise, line): the noisy lines of each text; null texts have none, rows are taken as they are."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(channel)  # grows with the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = []
            for k, t in zip(b["k"].tolist(), b["t"].tolist()):
                lines = t.split("\n")
                rows.extend((k, n, noise, lines[n]) for n, noise in label(known, t, paged))
            yield pd.DataFrame(rows, columns=["k", "line_no", "noise", "line"])

    cols = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return cols.mapInPandas(run, f"k {kind}, line_no int, noise string, line string").withColumnRenamed("k", key)


def repaired(docs: DataFrame, pieces: DataFrame, channel: Channel) -> DataFrame:
    """(tbl, row_key, text): each text and each stored piece as clean continuous paragraphs; a null text stays null.

    ``docs`` has doc_id and text, ``pieces`` faiss_id, gr_id and text; rows are
    taken as they are.  A piece is repaired by the noise that ``noisy_lines``
    finds in its lines.
    """
    work = Scratch(docs.sparkSession, "noise")
    shared = docs.sparkSession.sparkContext.broadcast(channel)
    found = work.write(_labelled(docs, channel, True), "documents")

    def keyless(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row_key": b["row_key"], "text": [None if t is None else repair(shared.value, t) for t in b["text"].tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            noise = [[] if n is None else list(zip(n.tolist(), k.tolist())) for n, k in zip(b["line_nos"], b["noises"])]
            yield pd.DataFrame({"row_key": b["row_key"], "text": [None if t is None else repair_piece(shared.value, t, x) for t, x in zip(b["text"].tolist(), noise)]})

    out = "row_key string, text string"
    key = F.col("doc_id").cast("string").alias("row_key")
    of_docs = found.select(key, "text").unionByName(docs.where("text is null or doc_id is null").select(key, "text").mapInPandas(keyless, out))
    noise = _noise_of_pieces(found.drop("text"), pieces, channel, work).select("piece", "line_no", "noise").distinct()
    marked = noise.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("line_no", "noise"))).alias("x")).select("piece", F.col("x.line_no").alias("line_nos"), F.col("x.noise").alias("noises"))
    held = pieces.select(F.col("faiss_id").cast("string").alias("row_key"), "text", _piece().alias("piece"))
    of_pieces = held.join(marked, "piece", "left").drop("piece").mapInPandas(run, out)
    return of_docs.select(F.lit("gr_documents").alias("tbl"), "row_key", "text").unionByName(of_pieces.select(F.lit("gr_chunks").alias("tbl"), "row_key", "text"))


def laid_along(piece: list[int], lines: list[int], blank: int, noisy: set[int]) -> list[int | None]:
    """For each line of a piece the line of the document it is, None for one the document lacks or a blank one; both as hashes.

    The longest common runs are placed first, so that a line that stands in the
    document twice is taken for the one among its neighbours; without any
    neighbour it is taken for one of the ``noisy`` lines, if such a line is equal.
    """
    mine = [i for i, x in enumerate(piece) if x != blank]
    theirs = [i for i, x in enumerate(lines) if x != blank]
    a, b = [piece[i] for i in mine], [lines[i] for i in theirs]
    at: list[int | None] = [None] * len(piece)
    for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if m.size > 1:
            for k in range(m.size):
                at[mine[m.a + k]] = theirs[m.b + k]
    first = {x: i for i, x in reversed(list(zip(theirs, b)))} | {lines[i]: i for i in sorted(noisy, reverse=True)}
    for i, x in zip(mine, a):
        if at[i] is None:
            at[i] = first.get(x)
    return at


def _labelled(docs: DataFrame, channel: Channel, repaired: bool = False) -> DataFrame:
    """(doc_id, h, line_nos, noises): hashes of all lines of each text, and its noisy lines; ``repaired``: and the repaired text."""
    shared = docs.sparkSession.sparkContext.broadcast(channel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            found, clean = [], []
            for t in b.pop("t").tolist():
                layout = Layout(t)
                words, breaks = flowing(layout)
                bad = misread_lines(known, words, breaks)
                found.append(_noise(known, layout, breaks, bad))
                if repaired:
                    clean.append(_paragraphs(known, layout, breaks, bad))
            b = b.assign(line_nos=[[n for n, _ in x] for x in found], noises=[[k for _, k in x] for x in found])
            yield b.assign(text=clean) if repaired else b

    cols = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").alias("t"), _line_hashes("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cols.mapInPandas(run, f"doc_id {kind}, h array<bigint>, line_nos array<int>, noises array<string>" + (", text string" if repaired else ""))


def _line_hashes(text: str) -> Column:
    # Page marks are left out of the pieces, so they count as blank.
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.when(x.rlike(_MARK.pattern), "").otherwise(F.rtrim(x))))


def _piece() -> Column:
    """A number of a stored piece, by its order, its id and its lines."""
    return F.xxhash64("gr_id", "faiss_id", _line_hashes("text"))


def _taken_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels that pieces take from the lines of their document, and their lines that it lacks."""
    for b in batches:
        line_nos, noises, only = [], [], []
        for piece, lines, at, kinds, blank in zip(b["p"], b["h"], b["line_nos"], b["noises"], b["blank"]):
            if lines is None:
                line_nos.append([]), noises.append([]), only.append(None)
                continue
            found = defaultdict(list)
            for n, k in zip(at, kinds):
                found[n].append(k)
            place = laid_along(list(piece), list(lines), blank, set(at))
            mine = [(i, k) for i, n in enumerate(place) if n is not None for k in found.get(n, ())]
            line_nos.append([i for i, _ in mine]), noises.append([k for _, k in mine])
            only.append([i for i, (n, x) in enumerate(zip(place, piece)) if n is None and x != blank])
        yield pd.DataFrame({"piece": b["piece"], "faiss_id": b["faiss_id"], "line_nos": line_nos, "noises": noises, "only": only})


def noisy_lines(docs: DataFrame, pieces: DataFrame, channel: Channel) -> DataFrame:
    """(tbl, row_key, line_no, noise) of whole texts and of the stored pieces of them.

    ``docs`` has doc_id and text, ``pieces`` faiss_id, gr_id and text.  A piece
    is laid along its document by hashes of lines and takes over the labels of
    the lines it consists of.  Pieces of documents that are gone or have no
    text, and lines of a piece that its document lacks (as parts of a divided
    line), are labelled by themselves.  Null texts and keys have none; repeated
    rows count once.
    """
    work = Scratch(docs.sparkSession, "noise")
    found = work.write(_labelled(docs, channel), "documents")
    zipped = F.explode(F.arrays_zip("line_nos", "noises")).alias("x")
    of_docs = found.select(F.lit("gr_documents").alias("tbl"), F.col("doc_id").alias("row_key"), zipped).select("tbl", "row_key", F.col("x.line_nos").alias("line_no"), F.col("x.noises").alias("noise"))
    of_pieces = _noise_of_pieces(found, pieces, channel, work).select(F.lit("gr_chunks").alias("tbl"), F.col("faiss_id").cast("string").alias("row_key"), "line_no", "noise")
    return of_docs.unionByName(of_pieces).distinct()


def _noise_of_pieces(found: DataFrame, pieces: DataFrame, channel: Channel, work: Scratch) -> DataFrame:
    """(piece, faiss_id, line_no, noise) of stored pieces, ``found`` being ``_labelled`` of their documents; rows may repeat."""
    zipped = F.explode(F.arrays_zip("line_nos", "noises")).alias("x")
    texts = found.dropDuplicates(["doc_id", "h"]).withColumnRenamed("doc_id", "gr_id")
    keyed = pieces.where("faiss_id is not null and text is not null").select("gr_id", "faiss_id", _line_hashes("text").alias("p")).distinct()
    both = keyed.join(texts, "gr_id", "left").withColumn("blank", F.xxhash64(F.lit(""))).withColumn("piece", F.xxhash64("gr_id", "faiss_id", "p"))
    kinds = f"piece bigint, faiss_id {pieces.schema['faiss_id'].dataType.simpleString()}"
    laid = work.write(both.mapInPandas(_taken_over, f"{kinds}, line_nos array<int>, noises array<string>, only array<int>"), "pieces")
    taken = laid.select("piece", "faiss_id", zipped).select("piece", "faiss_id", F.col("x.line_nos").alias("line_no"), F.col("x.noises").alias("noise"))
    asked = work.write(laid.where("only is null or size(only) > 0").select("piece", "faiss_id", "only").distinct(), "asked")
    alone = pieces.select(_piece().alias("piece"), "text").join(asked.select("piece"), "piece", "left_semi")
    own = labels(alone, "piece", "text", channel, paged=False).join(asked, "piece")
    own = own.where("only is null or array_contains(only, line_no)").select("piece", "faiss_id", "line_no", "noise")
    return taken.unionByName(own)

"""Languages of documents and of the blocks inside them, by rank-order profiles.

A profile lists the most frequent n-grams of a language in one script by rank.
A text's own ranked n-grams are compared with each profile by the out-of-place
distance (sum of rank differences, a full length for a missing n-gram); the
nearest profile names the language, so a script may serve several languages and
a language several scripts.

Profiles are fitted on a bounded sample of labelled documents.  As labels may
be wrong, the sample's blocks are reassigned to their nearest profile and the
profiles counted again.  Romanised profiles start from the transliterated words
of the Devanagari ones.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.lookalike import look

SAMPLE_DOCUMENTS = 3000  # bound of the labelled sample the profiles are fitted on
PROFILE, TEXT_RANKS, ROUNDS = 400, 200, 3
LEAST_WORDS = 12

# Spellings of the three labels, without region and case.
LABELS = {
    "mr": ("mr", "mar", "marathi", "मराठी"),
    "hi": ("hi", "hin", "hindi", "हिंदी", "हिन्दी"),
    "en": ("en", "eng", "english", "इंग्रजी", "अंग्रेज़ी"),
}
# Labels that say nothing.
NO_LABEL = ("", "-", "n/a", "na", "none", "null", "und", "unknown", "?", "mul", "zxx")

# How reference lists, headings and closings of orders begin or what they contain.
_LIST_HEAD = r"^(?:वाचा|पढ़ें|पढ़ें|संदर्भ|Read|References?)\s*:"
_CLOSING = r"^Copy (?:forwarded )?to\b|^(?:प्रत|प्रतिलिपि)\s*:|आदेशानुसार व नावाने|के आदेश से|^By order|प्राधिकाऱ्यांच्या सहमतीने|प्राधिकारी की सहमति|concurrence of the competent"
_HEADING = r"^(?:दिनांक|तारीख|Dated?|क्रमांक)\s*:|(?:क्रमांक|क्र\.|No\.?|सं\.|संख्या)\s*:?\s*\S*\S+[-/]\S|^(?:प्रांत शासन|Government of)"

_SKIP = re.compile(r"^\s*(?:#\s*Page\b.*|.*\|.*|\d{1,3}[).]\s.*|[\W\d_]*)$")
_LIST, _CLOSE, _HEAD = re.compile(_LIST_HEAD), re.compile(_CLOSING), re.compile(_HEADING)
_BREAK = re.compile(r"\n(?:[^\S\n]*\n)+")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ःऺ-ॏ॑-ॗॢ-ॣ])*")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")


def blocks(text: str) -> list[str]:
    return _BREAK.split(text.strip("\n"))


def running(block: str) -> str:
    """The running text of a block: what is left without marks, tables, lists, headings and closings; empty if it has none."""
    lines = block.split("\n")
    kept = [x for x in lines if not _SKIP.match(x)]
    if not kept or any(_LIST.search(x) or _HEAD.search(x) for x in kept):
        return ""
    closes = next((i for i, x in enumerate(kept) if _CLOSE.search(x)), None)
    if closes is not None:
        kept = kept[:closes]
    return "\n".join(kept)


def words_of(text: str) -> list[str]:
    """Words of two letters or more; single letters, as in codes, say nothing of a language."""
    return [w for w in _WORD.findall(text.lower()) if len(w) > 1]


def running_blocks(text: str) -> list[str]:
    """``running`` of every block of a text in its ``look`` form. Lines that the text repeats (page headers and footers) are no running text."""
    parts = blocks(look(text))
    lines = [["".join(filter(str.isalpha, x)) for x in b.split("\n")] for b in parts]
    seen = Counter(x for b in lines for x in b if len(x) > 3)
    if len(seen) < sum(seen.values()):
        parts = ["\n".join(x for x, k in zip(b.split("\n"), keys) if seen[k] < 2) for b, keys in zip(parts, lines)]
    return [running(b) if b else "" for b in parts]


def _ngrams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]


# Latin letters for Devanagari ones, as in common romanisation.
_CONSONANTS = dict(zip(
    "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(),
    "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(),
))
_VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऑ ॲ".split(), "a aa i i u u ru e ai o au o a".split()))
_SIGNS = dict(zip("ा ि ी ु ू ृ े ै ो ौ ॉ ॅ".split(), "a i i u u ru e ai o au o a".split()))


def romanise(word: str) -> str:
    out, open_ = [], False
    for c in word.replace("ऱ", "र"):
        if c in _CONSONANTS:
            out.append(("a" if open_ else "") + _CONSONANTS[c])
            open_ = True
        elif c in _SIGNS:
            out.append(_SIGNS[c])
            open_ = False
        elif c == "्":
            open_ = False
        elif c in "ंँ":
            out.append(("a" if open_ else "") + "n")
            open_ = False
        elif c in _VOWELS:
            out.append(("a" if open_ else "") + _VOWELS[c])
            open_ = False
    return "".join(out)


class Profiles:
    """Ranked n-grams of each (language, script), and the distance of a list of words to each of them."""

    def __init__(self, counts: dict[tuple[str, str], Counter]):
        self.keys = sorted(k for k, c in counts.items() if c)
        self.ranks: dict[str, np.ndarray] = {}
        for j, k in enumerate(self.keys):
            grams: Counter = Counter()
            for w, n in counts[k].items():
                for g in _ngrams(w):
                    grams[g] += n
            top = sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]
            for r, (g, _) in enumerate(top):
                self.ranks.setdefault(g, np.full(len(self.keys), -1, np.int32))[j] = r
        self._ids: dict[str, int] = {}
        self._rows = np.empty((1024, len(self.keys)), np.int32)
        self._words: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"keys": self.keys, "ranks": self.ranks}

    def __setstate__(self, state):
        self.__dict__.update(state, _ids={}, _rows=np.empty((1024, len(state["keys"])), np.int32), _words={})

    def _ids_of(self, word: str) -> np.ndarray:
        if (known := self._words.get(word)) is not None:
            return known
        out = []
        for g in _ngrams(word):
            if (i := self._ids.get(g)) is None:
                i = self._ids[g] = len(self._ids)
                if i == len(self._rows):
                    self._rows = np.concatenate([self._rows, np.empty_like(self._rows)])
                self._rows[i] = self.ranks.get(g, -1)
            out.append(i)
        if len(self._words) > 200_000:  # a memory bound of the cache; what falls out is made again
            self._words.clear()
        self._words[word] = made = np.array(out, np.int32)
        return made

    def nearest(self, words: list[str]) -> tuple[str, float] | None:
        """(language, confidence) of the words; none if there are none. Confidence is the lead over the nearest other language."""
        if not words or not self.keys:
            return None
        ids, n = np.unique(np.concatenate([self._ids_of(w) for w in words]), return_counts=True)
        top = ids[np.argsort(-n, kind="stable")[:TEXT_RANKS]]
        rows = self._rows[top]
        off = np.where(rows < 0, PROFILE, np.abs(rows - np.arange(len(top))[:, None])).sum(0) / (PROFILE * len(top))
        order = np.argsort(off, kind="stable")
        best = self.keys[order[0]][0]
        other = next((off[k] for k in order if self.keys[k][0] != best), 1.0)
        return best, float(max(0.0, min(1.0, (other - off[order[0]]) / max(other, 1e-9) * 2)))


def label_of(value: str | None) -> str | None:
    """mr, hi, en, ``other`` for another language, none if it says nothing."""
    v = look(value or "").strip().lower()
    base = re.split(r"[-_ ]", v)[0] if v not in NO_LABEL else ""
    if v in NO_LABEL or not base:
        return None
    return next((k for k, names in LABELS.items() if v in names or base in names), "other")


def _script(words: list[str]) -> str:
    return "Deva" if sum(bool(_DEVANAGARI.match(w)) for w in words) * 2 >= len(words) else "Latn"


def fit(labelled: list[tuple[str, str]]) -> Profiles:
    """Profiles from (label, text) pairs; wrong labels are outvoted by reassignment."""
    pool, counts = [], defaultdict(Counter)
    home = {"mr": "Deva", "hi": "Deva", "en": "Latn"}
    for label, text in labelled:
        lang = label_of(label)
        for body in running_blocks(text):
            words = words_of(body)
            if len(words) >= LEAST_WORDS:
                script = _script(words)
                pool.append((script, words))
                if lang in home and home[lang] == script:
                    counts[lang, script].update(words)
    for _ in range(ROUNDS):
        for lang in ("mr", "hi"):
            if counts[lang, "Deva"] and not counts[lang, "Latn"]:
                for w, n in counts[lang, "Deva"].items():
                    if r := romanise(w):
                        counts[lang, "Latn"][r] += n
        profiles = Profiles(counts)
        counts = defaultdict(Counter)
        for script, words in pool:
            if found := profiles.nearest(words):
                counts[found[0], script].update(words)
    return Profiles(counts)


def sample(docs: DataFrame, key: str, label: str, text: str, size: int = SAMPLE_DOCUMENTS) -> list[tuple[str, str]]:
    """At most ``size`` labelled documents, the same at every run: those of smallest hash.

    A count of the labels gives the hash below which about 1.2 ``size`` of them
    lie, so no task sorts or sends more than its share of those.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(key).alias("h")).where("k is not null and l is not null")
    n = rows.select("l").count()
    cut = int(-(2**63) + 2**64 * min(1.0, 1.2 * size / max(n, 1)))
    few = rows.where(F.col("h") < min(cut, 2**63 - 1)).where("t is not null")
    return [(r["l"], r["t"]) for r in few.orderBy("h", "k").limit(size).collect()]


def assign(docs: DataFrame, key: str, label: str, text: str, profiles: Profiles) -> DataFrame:
    """(key, label, block_no, lang, confidence, n_words): one row per document (block_no -1) and per running block.

    ``label`` comes out as ``label_of`` reads it.  The document's language is
    that of most words of its running text; a document without running text
    takes the language of all its words, and has none if it has no words.  Null
    texts give no rows; rows are taken as they are.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # three or four lists of PROFILE n-grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            rows = []
            for k, given, t in zip(batch["k"].tolist(), batch["l"].tolist(), batch["t"].tolist()):
                given = label_of(given)
                weight: Counter = Counter()
                sure: Counter = Counter()
                for no, body in enumerate(running_blocks(t)):
                    words = words_of(body) if body else []
                    if found := known.nearest(words):
                        n = len(body.split())
                        weight[found[0]] += n
                        sure[found[0]] += n * found[1]
                        rows.append((k, given, no, found[0], found[1], n))
                if weight:
                    lang = max(sorted(weight), key=weight.__getitem__)
                    rows.append((k, given, -1, lang, sure[lang] / sum(weight.values()), sum(weight.values())))
                elif found := known.nearest(words_of(look(t))):
                    rows.append((k, given, -1, found[0], found[1] / 2, 0))
            yield pd.DataFrame(rows, columns=["k", "label", "block_no", "lang", "confidence", "n_words"])

    cols = docs.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).where("t is not null")
    return cols.mapInPandas(run, f"k {kind}, label string, block_no int, lang string, confidence double, n_words int").withColumnRenamed("k", key)

"""Subject areas of documents by a seeded non-negative factorisation.

The document-term matrix V is factored as W H with non-negative alternating
(multiplicative, Kullback-Leibler) updates.  One component per subject area is
anchored by hand labels and by the words that name the area; a few free
components take up wording common to all subjects.  Terms are weighted by what
they tell about the subject, first from the labels, then from the factors
themselves, so phrases used in every order do not count.

Words of Indic script are romanised, so one term stands for a word of Marathi,
of Hindi and of romanised text.  The body's sentences are then given to the
component that explains their terms best under the mixture of their document,
and a document deals with the areas to which enough sentences are given.

H and the weights have one row per term that occurs in at least
``LEAST_DOCUMENTS`` documents, the same number at every size of the corpus;
they grow with the vocabulary, not with the text, and only such tables reach
the driver and the executors' Python workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.languages import _CLOSING, romanise
from daftar.llm.lookalike import look
from daftar.session import Scratch

LEAST_DOCUMENTS = 2  # in which a term must occur to be in the matrix
LEAST_SENTENCES = 3
ROUNDS, REWEIGH, ANCHOR = 7, (1, 3), 0.3

_END = re.compile(r"[.?!।](?=\s|$)")
_CLOSES = re.compile(_CLOSING)
_WORD = re.compile(r"[\wऀ-ःऺ-़ा-ॏ॑-ॗॢॣ]+")
_NUMBER = re.compile(r"[\d_]")
_LONGEST_CLOSING = 160  # characters; closings and copy lists stand in short lines


_TERMS: dict[str, int] = {}


def term(word: str) -> int:
    """64-bit id of a word, equal for a Devanagari word and its romanised form; 0 for what is no word of two letters."""
    if (known := _TERMS.get(word)) is not None:
        return known
    plain = (romanise(word) or word) if "ऀ" <= word[0] <= "ॿ" else word
    made = int.from_bytes(blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if len(word) > 1 and not _NUMBER.search(word) else 0
    if len(_TERMS) > 500_000:  # a memory bound of the cache; what falls out is made again
        _TERMS.clear()
    _TERMS[word] = made
    return made


class _Tokens(dict):
    """Ids of each blank-separated token, a 0 last if it ends a sentence; made once per distinct token."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = [i for w in _WORD.findall(token.lower()) if (i := term(w))]
        if token[-1] in ".?!।":
            ids.append(0)
        if len(self) > 500_000:  # a memory bound; what falls out is made again
            self.clear()
        made = self[token] = tuple(ids)
        return made


_TOKENS = _Tokens()


def body(title: str | None, text: str) -> str:
    """The body of a text: without title, letterhead (lines before the first sentence), closing and copy list."""
    name = look(title or "").strip()
    kept: list[str] = []
    for line in look(text).split("\n"):
        line = line.strip()
        if line and line != name and not (len(line) <= _LONGEST_CLOSING and _CLOSES.search(line)) and (kept or _END.search(line)):
            kept.append(line)
    return "\n".join(kept)


def body_sentences(title: str | None, text: str) -> list[str]:
    return _END.split(body(title, text))


def encode(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, terms): the terms of the body in order, a 0 after each sentence."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, t in zip(b["n"].tolist(), b["t"].tolist()):
                ids = list(chain.from_iterable(map(_TOKENS.__getitem__, body(name, t).split())))
                out.append(np.array([*ids, 0] if ids and ids[-1] else ids, np.int64))
            yield pd.DataFrame({"k": b["k"], "terms": out})

    cols = docs.select(F.col(key).alias("k"), F.col(title).alias("n"), F.col(text).alias("t")).where("k is not null and t is not null")
    return cols.mapInPandas(run, f"k {kind}, terms array<bigint>")


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = [np.unique(t) for t in b["terms"]]
        if parts:
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pd.DataFrame({"term": ids, "df": n})


class Model:
    """Vocabulary (sorted term ids), H (components x terms) and term weights."""

    def __init__(self, terms: np.ndarray, subjects: list[str], anchors: np.ndarray, labels: np.ndarray, df: np.ndarray, n_docs: int):
        k, t = anchors.shape
        self.terms, self.subjects = terms, subjects
        self.free = max(1, round(k / 3))  # components for wording common to all subjects
        self.scale = 0.25 * np.log(max(k, 2))  # nats about the subject from which a term counts in full
        share = df / max(n_docs, 1)
        p = df / max(df.sum(), 1)
        base = (anchors.sum(1) + 1e-9) / (anchors.sum() + k * 1e-9)
        seen = anchors.sum(0)
        pk = (anchors + 8 * base[:, None]) / (seen + 8)
        tells = (pk * np.log(pk / base[:, None])).sum(0)
        self.weight = np.where(labels < 3, np.where(share < 0.003, 0.5, 0.1), np.clip(tells / self.scale, 0, 1))
        own = anchors / np.maximum(anchors.sum(1, keepdims=True), 1e-9)
        lift = own / (seen / max(seen.sum(), 1e-9) + 1e-9)
        a = own * np.clip(lift - 1.5, 0, None) + 1e-12
        self.anchor = a / a.sum(1, keepdims=True)
        rng = np.random.default_rng(7)
        free = p * rng.uniform(0.5, 1.5, (self.free, t)) * np.where(share > 0.02, 1, 0.05)
        # A term that the labels tie to a subject stays out of the free components (an update keeps zeros).
        free[:, (labels >= 5) & (self.weight > 0.5)] = 0
        h = np.concatenate([self.anchor + 1e-3 * p, free])
        self.h = h / np.maximum(h.sum(1, keepdims=True), 1e-12)

    def matrix(self, terms: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count) of a batch, ordered by document; terms set aside are left out."""
        sizes = np.array([len(x) for x in terms], np.int64)
        flat = np.concatenate([*terms, np.empty(0, np.int64)])
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        known = (self.terms[col] == flat) & (self.weight[col] > 0.01)
        pair, n = np.unique(row[known] * len(self.terms) + col[known], return_counts=True)
        row, col = np.divmod(pair, len(self.terms))
        return row, col, n

    def mixtures(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """W of a batch under the present H, and H's columns for its entries."""
        ht = self.h.T[col]
        w = np.zeros((n, self.h.shape[0]))
        if not len(row):
            return w, ht
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        held = row[at]
        w[held] = np.add.reduceat(ht * (val / ht.sum(1))[:, None], at)
        for _ in range(steps):
            r = val / ((w[row] * ht).sum(1) + 1e-12)
            w[held] *= np.add.reduceat(ht * r[:, None], at)
        return w, ht

    def step(self, cols: pd.Series, counts: pd.Series, reweigh: bool) -> pd.DataFrame:
        """Partial sums of one H update and, to reweigh terms, of the document mixtures that each term occurs in."""
        sizes = np.array([len(x) for x in cols], np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.concatenate([*cols, np.empty(0, np.int32)])
        val = np.concatenate([*counts, np.empty(0, np.int32)])
        kept = self.weight[col] > 0.01
        row, col, val = row[kept], col[kept], val[kept] * self.weight[col[kept]]
        w, ht = self.mixtures(row, col, val, len(sizes), 1)
        k, t = len(self.subjects), len(self.terms)
        r = val / ((w[row] * ht).sum(1) + 1e-12)
        g = w[row] * r[:, None]
        parts = list(g.T)
        if reweigh:
            mix = w[:, :k] / (w[:, :k].sum(1, keepdims=True) + 1e-9)
            parts += list(mix[row].T)
        sums = np.stack([np.bincount(col, x, t) for x in parts], 1)
        some = np.flatnonzero(sums.any(1))
        return pd.DataFrame({"i": some.astype("int32"), "sums": list(sums[some])})

    def update(self, sums: np.ndarray, reweigh: bool) -> None:
        k = len(self.subjects)
        m = self.h * sums[:, : k + self.free].T
        m[:k] += 1e-15
        m[:k] += ANCHOR * m[:k].sum(1, keepdims=True) * self.anchor
        self.h = m / np.maximum(m.sum(1, keepdims=True), 1e-12)
        if reweigh:
            c = sums[:, k + self.free :]
            base = (c.sum(0) + 1e-9) / (c.sum() + k * 1e-9)
            pk = (c + 4 * base) / (c.sum(1, keepdims=True) + 4)
            tells = (pk * np.log(pk / base)).sum(1)
            # A term already set aside has no sums and stays aside.
            self.weight = np.where(c.any(1), np.clip(tells / self.scale, 0, 1) ** 2, np.minimum(self.weight, 0.01))

    def given(self, terms: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, subject, sentences given to it) of a batch."""
        k = len(self.subjects)
        row, col, n = self.matrix(terms)
        w, _ = self.mixtures(row, col, n * self.weight[col], len(terms), 5)
        prior = w[:, :k] / (w[:, :k].sum(1, keepdims=True) + 1e-12)
        sizes = np.array([len(x) for x in terms], np.int64)
        flat = np.concatenate([*terms, np.empty(0, np.int64)])
        sentence = np.cumsum(flat == 0) - (flat == 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)[flat == 0]
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        mass = self.h / (self.h.sum(0) + 1e-12)
        inform = np.maximum(mass[:k].sum(0), 0.2) * self.weight
        table = (inform * np.log(mass[:k] / (mass[:k].sum(0) + 1e-12) + 1e-3)).T
        known = (self.terms[at] == flat) & (inform[at] > 0.005)
        sentence, at = sentence[known], at[known]
        if not len(at):
            return np.empty(0, int), np.empty(0, int), np.empty(0, int)
        cut = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        of = doc[sentence[cut]]
        score = np.add.reduceat(table[at], cut) + np.log(prior[of] + 0.02)
        pair, n = np.unique(of * k + score.argmax(1), return_counts=True)
        return pair // k, pair % k, n


def _sparse(encoded: DataFrame, model: Model) -> DataFrame:
    """The document-term matrix: (cols, counts) of each document."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, col, n = shared.value.matrix(b["terms"])
            cut = np.searchsorted(row, np.arange(1, len(b)))
            if len(b):
                yield pd.DataFrame({"cols": np.split(col.astype("int32"), cut), "counts": np.split(n.astype("int32"), cut)})

    return encoded.select("terms").mapInPandas(run, "cols array<int>, counts array<int>").where(F.size("cols") > 0)


def fit(encoded: DataFrame, labels: DataFrame, areas: DataFrame, work: Scratch) -> Model:
    """``encoded`` as written by ``encode``; ``labels`` (k, subject); ``areas`` (subject, words): the fixed list of areas."""
    spark = encoded.sparkSession
    n_docs = encoded.count()
    counts = encoded.mapInPandas(_document_frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    rows = counts.where((F.col("term") != 0) & (F.col("df") >= LEAST_DOCUMENTS)).toPandas().sort_values("term")
    terms, df = rows["term"].to_numpy(np.int64), rows["df"].to_numpy(float)
    listed = sorted((r["subject"], r["words"] or "") for r in areas.collect() if r["subject"])
    subjects = [s for s, _ in listed]
    anchors = np.zeros((len(subjects), max(len(terms), 1)))
    n_of = labels.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    seen = (
        labels.join(n_of, "k").join(encoded, "k").select("subject", "n", F.explode("terms").alias("term")).where("term <> 0")
        .groupBy("subject", "term").agg(F.sum(1 / F.col("n")).alias("c"))
        .join(counts.where(F.col("df") >= LEAST_DOCUMENTS).select("term"), "term", "left_semi").toPandas()
    )
    if len(terms):
        at = np.searchsorted(terms, seen["term"].to_numpy(np.int64))
        for s, i, c in zip(seen["subject"], at, seen["c"]):
            if s in subjects and i < len(terms):
                anchors[subjects.index(s), i] += c
        labelled = anchors.sum(0)
        for k, (_, words) in enumerate(listed):
            for w in _WORD.findall(look(words).lower()):
                i = np.searchsorted(terms, term(w)) if len(w) > 3 else len(terms)
                if i < len(terms) and terms[i] == term(w):
                    anchors[k, i] += 3
    else:
        terms, df, labelled = np.array([1]), np.array([1.0]), np.zeros(1)
    model = Model(terms, subjects, anchors, labelled, df, n_docs)
    matrix = work.write(_sparse(encoded, model), "matrix")
    for r in range(ROUNDS):
        reweigh = r in REWEIGH
        width = len(subjects) * (2 if reweigh else 1) + model.free
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared, reweigh=reweigh) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield shared.value.step(b["cols"], b["counts"], reweigh)

        part = matrix.mapInPandas(run, "i int, sums array<double>")
        total = part.groupBy("i").agg(*[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]).toPandas()
        sums = np.zeros((len(terms), width))
        if len(total):
            sums[total["i"].to_numpy()] = total[[f"s{j}" for j in range(width)]].to_numpy()
        model.update(sums, reweigh)
        shared.destroy()
    return model


def assign(encoded: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, subject, n_sentences): sentences of each document given to each subject area."""
    kind = encoded.schema["k"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            if len(b):
                doc, subject, n = m.given(b["terms"])
                yield pd.DataFrame({"k": b["k"].to_numpy()[doc], "subject": np.array(m.subjects, object)[subject], "n_sentences": n.astype("int32")})

    return encoded.mapInPandas(run, f"k {kind}, subject string, n_sentences int").withColumnRenamed("k", key)


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, n_sentences) of ``docs`` (doc_id, title, text); rows with a null id or text give none.

    ``labels`` (doc_id, subject) may be empty, wrong in part, or name other
    areas (ignored); ``areas`` (subject, label_en, label_mr, scope_note) is the
    list of allowed areas.
    """
    work = Scratch(docs.sparkSession, "subjects")
    encoded = work.write(encode(docs, "doc_id", "title", "text"), "encoded")
    named = areas.select("subject", F.concat_ws(" ", "label_en", "label_mr", "scope_note").alias("words"))
    hand = labels.select(F.col("doc_id").alias("k"), "subject").where("k is not null and subject is not null").distinct()
    return assign(encoded, fit(encoded, hand, named, work), "doc_id")

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows (``per_label`` of each label, by
hash order). Inverse document frequencies of their terms are counted over all
documents, and no term is too common to index: a term's weight is its TF-IDF times
how unevenly it occurs between the example labels, so words of all texts count little and
words of toxic texts much, however many rows they stand in. The index orders examples by
blocks and keeps, for each term, the largest weight in each block it has; the most common
terms stand as whole rows instead. A query adds these up to bound every block's cosines, and
scores every block whose bound reaches a floor of its k-th best cosine, so none that could
hold a neighbour is left out. Texts are searched many at a time. Neighbours vote with their cosines; votes are turned into
probabilities by a logistic curve fitted to the examples' own leave-one-out votes.
All terms of the examples are indexed, however rare. No other labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import words
from pointloom.llm.common import bound_batches, digits_crc, trim

PER_LABEL = 1500
NEIGHBOURS = 25
BLOCK = 32
#: Texts, and characters of texts, that are handled at once (a longer text is handled alone); they bound a worker's memory.
STEP, STEP_CHARACTERS = 80, 240_000
STEMS = (4, 5)
#: So many of the most common terms are kept as whole rows of weights (a matter of storage only).
WHOLE = 2048
#: A term's chi-square against the labels at which it has about half of its TF-IDF weight.
HALF = 30


def steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if i > start and (i - start == STEP or size > STEP_CHARACTERS):
            yield texts[start:i]
            start, size = i, len(text or "")
    if start < len(texts):
        yield texts[start:]


class Terms:
    """Sorted distinct hashes, found by their leading bits: hashes spread evenly, so few share these."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.hashes, self._first = hashes, None

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self):
        return {"hashes": self.hashes, "_first": None}

    def find(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``term`` are known, and their places."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        shift = np.uint64(64 - self.BITS)
        if self._first is None:
            self._first = np.searchsorted(self.hashes >> shift, np.arange((1 << self.BITS) + 1, dtype=np.uint64)).astype(np.int32)
        top = (term >> shift).astype(np.int64)
        at, end = self._first[top], self._first[top + 1]
        left = np.flatnonzero(at < end)
        known, places = [], []
        while len(left):
            hit = self.hashes[at[left]] == term[left]
            known.append(left[hit])
            places.append(at[left[hit]])
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return (np.concatenate(known), np.concatenate(places)) if known else (np.empty(0, np.int64), np.empty(0, np.int64))


def counted(texts: list[str | None], vocabulary: Terms | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the distinct terms of each text, in order of text and term.

    Terms are hashes of words and of beginnings of longer words; with a vocabulary,
    only its terms, as places in it.
    """
    term, text = words.letter_terms(texts, STEMS)
    if vocabulary is not None:
        known, at = vocabulary.find(term)
        key = np.sort(text[known] * len(vocabulary) + at)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        text, term = np.divmod(key[first], max(len(vocabulary), 1))
        return text, term, np.diff(np.append(first, len(key)))
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], term[first], np.diff(np.append(first, len(term)))


@dataclass
class Vectors:
    """Unit vectors of texts: rows (text, term, weight) in order of text and term."""

    text: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n: int

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.text, [i, i + 1])
        return self.term[a:b], self.weight[a:b]


def vectors(texts: list[str | None], vocabulary: Terms, idf: np.ndarray) -> Vectors:
    """Of each text the places and weights, (1 + ln count) x the term's weight, of its indexed terms, scaled to length 1."""
    text, term, count = counted(texts, vocabulary)
    weight = idf[term] * (1 + np.log(count))
    norm = np.sqrt(np.bincount(text, weight**2, len(texts)))
    return Vectors(text, term, weight / np.maximum(norm, 1e-300)[text], len(texts))


def _spans(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[i] up to first[i + 1] of each i in ``at``, one after another, and how many each i has."""
    counts = first[at + 1] - first[at]
    places = np.repeat(first[at] - np.cumsum(counts) + counts, counts)
    places += np.arange(len(places))
    return places, counts


@dataclass
class Index:
    """Inverted index of unit TF-IDF vectors; examples are numbered so that blocks hold like ones."""

    vocabulary: Terms
    idf: np.ndarray  # times the unevenness between the labels
    first: np.ndarray  # per term: its postings' beginning (one more at the end)
    example: np.ndarray
    weight: np.ndarray
    part: np.ndarray  # per term: the beginning of its parts (one more at the end), a part being its postings in one block
    block: np.ndarray  # of each part
    largest: np.ndarray  # weight in each part
    start: np.ndarray  # each part's first posting (one more at the end)
    row: np.ndarray  # per term: its row in whole, -1 if it has none
    labels: np.ndarray
    ids: np.ndarray
    texts: list[str] | None  # until the curve is fitted
    curve: tuple[float, float] = (1.0, 0.0)
    _whole: np.ndarray | None = None

    @property
    def whole(self) -> np.ndarray:
        """Weights of the most common terms, a row each, by example; laid out from the postings where it is used."""
        if self._whole is None:
            self._whole = np.zeros((int(self.row.max(initial=-1)) + 1, len(self.labels)))
            for term in np.flatnonzero(self.row >= 0).tolist():
                a, b = self.first[term], self.first[term + 1]
                self._whole[self.row[term], self.example[a:b]] = self.weight[a:b]
        return self._whole

    def __getstate__(self):
        return self.__dict__ | {"_whole": None}

    def neighbours(self, v: Vectors, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of each text's k examples of largest cosine above 0 (ties: lower number first), best first: exact.

        ``leave``: of each text the example that is not looked at.
        """
        n, m = len(self.labels), v.n
        if not len(v.text) or not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        row = self.row[v.term]
        known = row >= 0
        x = np.zeros((m, len(self.whole)))
        x[v.text[known], row[known]] = v.weight[known]
        common = x @ self.whole
        text, term, weight = v.text[~known], v.term[~known], v.weight[~known]
        parts, counts = _spans(self.part, term)
        starts = np.arange(0, n, BLOCK)
        owner = np.repeat(text, counts) * len(starts) + self.block[parts]
        weights = np.repeat(weight, counts)
        bounds = np.bincount(owner, weights * self.largest[parts], m * len(starts)).reshape(m, -1) + np.maximum.reduceat(common, starts, axis=1)
        if leave is not None:
            common[np.arange(m), leave] = 0
        # weights are not negative: the k-th best cosine is no less than the k-th best of the common terms' shares of it
        least = np.partition(common, n - k, axis=1)[:, n - k] if n > k else np.zeros(m)
        todo = (bounds > 0) & (bounds >= least[:, None] - 1e-9)
        here = todo.reshape(-1)[owner]
        parts, owner, weights = parts[here], owner[here], weights[here]
        spots, sizes = _spans(self.start, parts)
        cell = np.repeat(owner // len(starts) * n, sizes)
        cell += self.example[spots]
        share = np.repeat(weights, sizes)
        share *= self.weight[spots]
        rest = np.bincount(cell, share, m * n)
        grid = np.where(np.repeat(todo, BLOCK, axis=1)[:, :n], common, 0) + rest.reshape(m, n)
        if leave is not None:
            grid[np.arange(m), leave] = 0
        best = np.partition(grid, n - k, axis=1)[:, n - k] if n > k else np.zeros(m)
        who, example = np.nonzero((grid >= best[:, None]) & (grid > 0))
        order = np.lexsort((example, -grid[who, example], who))
        who, example = who[order], example[order]
        top = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[top], example[top], grid[who[top], example[top]]

    def votes(self, v: Vectors, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the log odds of its neighbours' votes, each as strong as its cosine squared; and the neighbours."""
        text, example, cosine = found = self.neighbours(v, k, leave)
        yes, no = (np.bincount(text, cosine**2 * (self.labels[example] == y), v.n) for y in (1, 0))
        smooth = 0.05 * (yes + no) + 1e-4
        return np.log((yes + smooth) / (no + smooth)), found

    def scores(self, texts: list[str | None], k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scores of texts, and their neighbours."""
        slope, level = self.curve
        odds, found = self.votes(vectors(texts, self.vocabulary, self.idf), k)
        return 1 / (1 + np.exp(-(slope * odds + level))), found


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of a weighted logistic curve, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * b
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def present(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One label (the smallest) for each doc_id that ``docs`` has; rows with nulls are left out."""
    labelled = labelled.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    return labelled.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")


def _sample(docs: DataFrame, labelled: DataFrame, per_label: int) -> pd.DataFrame:
    """Up to per_label labelled texts of each label, by hash order: the only rows that reach the driver."""
    parts = []
    for label in (0, 1):
        # the order needs ids alone; their texts follow by a join with at most per_label ids
        chosen = labelled.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        parts.append(chosen)
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "label")).alias("r"))
    return found.select("doc_id", "r.text", "r.label").toPandas().sort_values("doc_id", ignore_index=True)


def _frequencies(docs: DataFrame, vocabulary: Terms) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary occurs, and the number of documents."""
    size = len(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for part in steps(batch["text"].tolist()):
                np.add.at(total, counted(part, vocabulary)[1], 1)
        yield pd.DataFrame({"term": np.append(np.arange(size), -1), "n": np.append(total, n)}).query("n > 0")
        trim()

    sums = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1, np.int64)
    df[sums["term"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return df[:size], int(df[size])


def _uneven(texts: list[str], labels: np.ndarray, vocabulary: Terms) -> np.ndarray:
    """How unevenly each term occurs between the labels: from 1 / HALF (evenly) to near 1, by its chi-square."""
    text, term, _ = counted(texts, vocabulary)
    every, yes = (np.bincount(term[labels[text] >= y], minlength=len(vocabulary)).astype(float) for y in (0, 1))
    n, toxic = len(labels), int(labels.sum())
    spread = every * (n - every) * toxic * (n - toxic)
    chi = np.divide((yes * n - every * toxic) ** 2 * n, spread, out=np.zeros(len(vocabulary)), where=spread > 0)
    return (chi + 1) / (chi + HALF)


def _index(texts: list[str], labels: np.ndarray, ids: np.ndarray, vocabulary: Terms, df: np.ndarray, n_docs: int) -> Index:
    """The index of the examples over these terms; like examples stand next to each other: by label, then by their heaviest term."""
    idf = np.log((n_docs + 1) / (df + 0.5)) * _uneven(texts, labels, vocabulary)
    v = vectors(texts, vocabulary, idf)
    heaviest = np.lexsort((v.term, -v.weight, v.text))
    with_terms, at = np.unique(v.text[heaviest], return_index=True)
    heads = np.full(len(texts), -1)
    heads[with_terms] = v.term[heaviest][at]
    order = np.lexsort((heads, labels)) if len(texts) else np.empty(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_term = np.lexsort((place[v.text], v.term))
    term, example, weight = v.term[by_term], place[v.text][by_term], v.weight[by_term]
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    start = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(example // BLOCK, prepend=-1))
    part = np.searchsorted(term[start], np.arange(len(vocabulary) + 1))
    largest = np.maximum.reduceat(weight, start) if len(start) else np.empty(0)
    row = np.full(len(vocabulary), -1)
    most = np.argsort(-np.diff(first), kind="stable")[:WHOLE]
    row[most] = np.arange(len(most))
    small = lambda x: x.astype(np.int32)
    return Index(vocabulary, idf, small(first), small(example), weight, small(part), small(example[start] // BLOCK), largest, small(np.append(start, len(term))), small(row), labels[order], ids[order], [texts[i] for i in order])


def fit(docs: DataFrame, labelled: DataFrame, per_label: int = PER_LABEL, k: int = NEIGHBOURS) -> Index:
    """An index of labelled examples with document frequencies of all ``docs``.

    ``labelled``: doc_id, label (0 or 1; rows with nulls are left out; of repeated
    doc_ids the smallest label counts). Without examples, scores are 0.
    """
    bound_batches(docs.sparkSession)
    labelled = present(docs, labelled)
    shares = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = _sample(docs, labelled, per_label)
    texts = sample["text"].tolist()
    labels, ids = (sample[c].to_numpy(np.int64) if len(sample) else np.empty(0, np.int64) for c in ("label", "doc_id"))
    vocabulary = Terms(np.unique(counted(texts)[1]))
    df, n_docs = _frequencies(docs, vocabulary)
    index = _index(texts, labels, ids, vocabulary, df, n_docs)
    texts, index.texts = index.texts, None
    if not {0, 1} <= set(labels.tolist()):
        index.curve = (1e-3, 12.0 if 1 in index.labels else -12.0)
        return index
    odds, at = [], 0
    for part in steps(texts):
        odds.append(index.votes(vectors(part, vocabulary, index.idf), k, np.arange(at, at + len(part)))[0])
        at += len(part)
    odds = np.concatenate(odds)
    weight = np.array([shares[y] / (index.labels == y).sum() for y in (0, 1)])[index.labels]
    index.curve = _logistic(odds, index.labels, weight / weight.mean())
    return index


def scored(docs: DataFrame, index: Index, k: int = NEIGHBOURS, evidence: int = 3) -> Column:
    """A column for ``docs``: score of the column ``text`` (0 to 1), ids of the nearest examples and their cosines."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    @F.pandas_udf("score double, evidence array<long>, cosines array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for text in batches:
            out = []
            for part in steps(text.tolist()):
                score, (of, example, cosine) = model.scores(part, k)
                cuts = np.searchsorted(of, np.arange(len(score)))
                ends = np.minimum(np.searchsorted(of, np.arange(len(score)), "right"), cuts + evidence)
                out += [(s, model.ids[example[a:b]].tolist(), cosine[a:b].tolist()) for s, a, b in zip(score.tolist(), cuts.tolist(), ends.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["score", "evidence", "cosines"])
        model._whole = None
        trim()

    return apply("text")


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with all their columns."""
    index = fit(docs, training_labels(labels))
    return docs.where(scored(docs, index)["score"] < most)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: rows whose crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(digits_crc() % 5 != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest rows: doc_id, held_out, score, predicted, and evidence.

    Null and empty texts have no neighbours and get the curve's value at even votes.
    Repeated rows get repeated results; a null doc_id stays null; of ``labels``, rows
    with nulls are left out. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(docs, fit(docs, training_labels(labels))).alias("s"))
    return rows.select("doc_id", (digits_crc() % 5 == 0).alias("held_out"), "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.evidence", "s.cosines")

"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap checks.

Items are indexed by classes of length, each with a stride: 64 words, or the power of two
times 64 that its items fit in. Every text is cut into overlapping passages twice as long as
the stride, so each occurrence of an item lies whole in one passage of its class, and how
long other items are makes no difference. A class of very many items has several indexes;
document frequencies, the number of items and their mean length are those of all items
together. A passage is a query against the items. An item's scores are taken as shares
of the score the item itself would get, so one threshold serves items of any length.
All items above it are retrieved: a passage whose terms' largest shares do not add up
to the threshold is skipped, then blocks of items are skipped by their largest shares,
and only the rest is scored. A retrieved item contaminates if enough of the shingles of
both its question and its answer occur in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm import words
from pointloom.llm.common import bound_batches, trim

K1, B = 1.2, 0.75
STRIDE = 64
BLOCK = 16
SHINGLE = 3
SHARE, OVERLAP = 0.5, 0.5
#: Words of the items of one index; larger classes of items have several.
MOST_WORDS = 4_000_000
#: Passages scored at once.
PASSAGES = 4000
FOUND = "array<struct<item_id: long, passage: long, bm25_share: double, question_overlap: double, answer_overlap: double>>"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's answer: its last sentence, or the last third of its words where there is only one."""
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    found = text.split()
    cut = len(found) - max(1, len(found) // 3)
    return " ".join(found[:cut]), " ".join(found[cut:])


def _shingles(hashes: np.ndarray) -> np.ndarray:
    n = min(SHINGLE, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    value = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        value = words.mix(value * np.uint64(0x100000001B3) + hashes[k : k + len(value)])
    return np.unique(value)


@dataclass
class Index:
    ids: np.ndarray
    vocabulary: np.ndarray
    first: np.ndarray  # of each term's postings
    item: np.ndarray
    share: np.ndarray
    largest: np.ndarray  # of each term
    block_first: np.ndarray
    block: np.ndarray
    block_largest: np.ndarray
    parts: list[tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]  # shingle length and shingles of question and answer
    stride: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


@dataclass
class Statistics:
    """Of all items with words: their number, mean length, and in how many each term occurs (sorted hashes)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    def frequencies(self, vocabulary: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, vocabulary)]


def statistics(texts: list[str]) -> Statistics:
    hashes, counts = words.alnum_words(texts)
    terms, place = np.unique(hashes, return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts) * max(1, len(terms)) + place)
    n = int((counts > 0).sum())
    return Statistics(n, float(counts.sum()) / max(1, n), terms, np.bincount(pairs % max(1, len(terms)), minlength=len(terms)))


def build(items: list[tuple[int, str]], of: Statistics | None = None, stride: int | None = None) -> Index:
    """The index of (item_id, text) with the statistics of all items (default: of these); items without words are left out."""
    of = of or statistics([t for _, t in items])
    hashed = words.alnum_words([t for _, t in items])
    split = np.split(hashed[0], np.cumsum(hashed[1])[:-1]) if items else []
    kept = [(i, t, h) for (i, t), h in zip(items, split, strict=True) if len(h)]
    lengths = np.array([len(h) for *_, h in kept], float)
    vocabulary = np.unique(hashed[0])
    pairs = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for *_, h in kept]
    term = np.concatenate([p[0] for p in pairs]) if kept else np.empty(0, np.int64)
    tf = np.concatenate([p[1] for p in pairs]).astype(float) if kept else np.empty(0)
    item = np.repeat(np.arange(len(kept)), [len(p[0]) for p in pairs])
    df = of.frequencies(vocabulary) if len(vocabulary) else np.empty(0)
    idf = np.log(1 + (of.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * lengths / max(1.0, of.mean))
    score = idf[term] * tf * (K1 + 1) / (tf + norm[item]) if kept else np.empty(0)
    share = score / np.bincount(item, score, len(kept))[item] if kept else np.empty(0)
    order = np.lexsort((item, term))
    term, item, share = term[order], item[order], share[order]
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    largest = np.zeros(len(vocabulary))
    np.maximum.at(largest, term, share)
    n_blocks = max(1, -(-len(kept) // BLOCK))
    blocks, inverse = np.unique(term * n_blocks + item // BLOCK, return_inverse=True)
    block_largest = np.zeros(len(blocks))
    np.maximum.at(block_largest, inverse, share)
    parts = []
    for _, text, h in kept:
        both = []
        for part in question_and_answer(text):
            p = words.alnum_words([part])[0]
            p = p if len(p) else h
            both.append((min(SHINGLE, len(p)), _shingles(p)))
        parts.append(tuple(both))
    return Index(
        np.array([i for i, *_ in kept], np.int64), vocabulary, first, item, share, largest, np.searchsorted(blocks // n_blocks, np.arange(len(vocabulary) + 1)),
        blocks % n_blocks, block_largest, parts, stride or stride_of(int(lengths.max(initial=0))),
    )


def stride_of(length: int) -> int:
    """64 words, or the least power of two times 64 that holds so many."""
    stride = STRIDE
    while stride < length:
        stride *= 2
    return stride


def _postings(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms' postings, and which of the terms each belongs to."""
    n = first[terms + 1] - first[terms]
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[terms], n), np.repeat(np.arange(len(terms)), n)


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score share) of at least ``share``, of n passages given by distinct (passage, term) rows."""
    found = []
    bound = np.bincount(passage, index.largest[term], n)
    alive = bound >= share
    passage, term = passage[alive[passage]], term[alive[passage]]
    cuts = np.searchsorted(passage, np.arange(0, n + PASSAGES, PASSAGES))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        local, t = np.unique(passage[a:b], return_inverse=True)
        m = len(local)
        spots, of = _postings(index.block_first, term[a:b])
        cell = t[of] * index.blocks + index.block[spots]
        open_cells = np.bincount(cell, index.block_largest[spots], m * index.blocks) >= share - 1e-9
        hit = open_cells.reshape(m, -1).any(1)
        rows = np.flatnonzero(hit[t])
        spots, of = _postings(index.first, term[a:b][rows])
        owner, item = t[rows][of], index.item[spots]
        inside = open_cells[owner * index.blocks + item // BLOCK]
        owner, item, spots = owner[inside], item[inside], spots[inside]
        cells, inverse = np.unique(owner * len(index.ids) + item, return_inverse=True)
        scores = np.bincount(inverse, index.share[spots], len(cells))
        best = np.flatnonzero(scores >= share - 1e-9)
        found.append((local[cells[best] // len(index.ids)], cells[best] % len(index.ids), scores[best]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(index: Index, texts: list[str | None], share: float, overlap: float) -> list[list[tuple]]:
    """Of each text, the contaminating items: (item_id, first word of the passage, score share, question and answer overlap)."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(index.ids):
        return out
    hashes, counts = words.alnum_words(texts)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(texts)), counts)
    segment = (np.arange(len(hashes)) - first[text]) // index.stride
    windows = np.maximum(1, -(-counts // index.stride) - 1)
    base = np.cumsum(windows) - windows
    at = np.searchsorted(index.vocabulary, hashes)
    known = np.flatnonzero(index.vocabulary[np.minimum(at, len(index.vocabulary) - 1)] == hashes)
    at, text, segment = at[known], text[known], segment[known]
    here, before = segment < windows[text], segment > 0
    passage = np.concatenate([(base[text] + segment)[here], (base[text] + segment - 1)[before]])
    term = np.concatenate([at[here], at[before]])
    size = len(index.vocabulary)
    rows = np.unique(passage * size + term)
    found, item, score = retrieve(index, rows // size, rows % size, int(windows.sum()), share)
    owner = np.searchsorted(base, found, "right") - 1
    best: dict[tuple[int, int], tuple] = {}
    for p, w, i, s in zip(found.tolist(), owner.tolist(), item.tolist(), score.tolist(), strict=True):
        start = (p - int(base[w])) * index.stride
        here_words = hashes[first[w] + start : first[w] + min(start + 2 * index.stride, counts[w])]
        shares = []
        for n, wanted in index.parts[i]:
            value = np.zeros(max(0, len(here_words) - n + 1), np.uint64)
            for k in range(n):
                value = words.mix(value * np.uint64(0x100000001B3) + here_words[k : k + len(value)])
            shares.append(float(np.isin(wanted, value).mean()))
        if min(shares) >= overlap:
            row = (int(index.ids[i]), start, s, *shares)
            if (w, i) not in best or min(shares) > min(best[w, i][3:]):
                best[w, i] = row
    for (w, _), row in sorted(best.items(), key=lambda x: (x[0][0], x[1][0])):
        out[w].append(row)
    return out


def indexes(items: DataFrame) -> list[Index]:
    """Indexes of bounded size, by length of item, that together hold all items (item_id, text); null texts are left out, equal rows count once.

    The test set is collected: it is small beside the corpus, and needed as a whole in every
    task. A test set beyond the driver's memory is searched by calling ``contaminated`` on parts
    of it, each with ``statistics`` of the whole.
    """
    rows = items.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    found = sorted(((r[0] if r[0] is not None else -1), r[1]) for r in rows.toLocalIterator())
    of = statistics([t for _, t in found])
    lengths = words.alnum_words([t for _, t in found])[1]
    classes: dict[int, list[list]] = {}
    size: dict[int, int] = {}
    for item, n in zip(found, lengths.tolist(), strict=True):
        stride = stride_of(n)
        if stride not in classes or size[stride] + n > MOST_WORDS:
            classes.setdefault(stride, []).append([])
            size[stride] = 0
        classes[stride][-1].append(item)
        size[stride] += n
    return [build(part, of, stride) for stride, parts in sorted(classes.items()) for part in parts]


def found_items(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> Column:
    """A column of the items that contaminate the column ``text``, by item_id; all indexes are searched in one pass over the texts."""
    bound_batches(docs.sparkSession)
    sent = [docs.sparkSession.sparkContext.broadcast(index) for index in indexes(items)]  # MOST_WORDS each

    @F.pandas_udf(FOUND)
    def contaminating(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            texts, out = text.tolist(), []
            for k in range(0, len(texts), 400):
                found = [search(b.value, texts[k : k + 400], share, overlap) for b in sent]
                for rows in zip(*found, strict=True) if found else [()] * len(texts[k : k + 400]):
                    rows = sorted((r for part in rows for r in part), key=lambda r: r[0])
                    out.append([dict(zip(("item_id", "passage", "bm25_share", "question_overlap", "answer_overlap"), r, strict=True)) for r in rows])
            yield pd.Series(out, dtype=object)
        trim()

    return contaminating("text")


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """A row per document row and contaminating item: doc_id, item_id, passage and the measures that decided.

    Null and empty texts, and items without words, match nothing; repeated rows give
    repeated results; a null item_id counts as -1; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found_items(docs, items, share, overlap).alias("f"))
    return rows.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*")


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    return docs.where(F.size(found_items(docs, items, share, overlap)) == 0)

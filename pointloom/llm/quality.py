"""Quality by Bradley-Terry ranking: weights from preference pairs, threshold by score quantile.

A pair prefers a text labelled 1 over one labelled 0. The model gives each text a
strength, linear in features of the whole text; the chance that one beats another is
the logistic function of the strengths' difference, and the weights minimise the
logistic loss of feature differences over pairs: each lower text meets ``PAIRS`` higher
ones, drawn with fixed seeds, and each higher one that no draw has met meets a lower one.
All labelled rows take part in the pairs, and centre, scale, threshold and curve are of all
of them. The rows stay in written tables; a step's sums, a vector per task, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import bound_batches, digits_crc, trim, written
from pointloom.operators.points import with_slot

#: Preference pairs drawn for each lower-quality example.
PAIRS = 24
#: So many draws come from one seed: any task can make those of its rows.
DRAWS = 1 << 16
#: Bins of strengths that are counted at once to find the threshold.
BINS = 4096
CUT = 0.7
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("a") : ord("z") + 1] = 3
_KINDS[ord("0") : ord("9") + 1] = 4
_KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KINDS[0x80:] = 6
_KINDS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
NAMES = (
    "log_words", "upper", "digit", "symbol", "bars", "marks", "exclaimed", "distinct_words", "repeated_next",
    "top_word", "distinct_lines", "word_length", "words_a_line", "stops", "compressed", "symbol_words", "upper_words", "short",
)


def features(text: str | None) -> np.ndarray:
    """Numbers about a whole text; empty and null texts give the same row."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KINDS[data], minlength=8)
    words = text.split()
    lines = [s for s in text.split("\n") if s.strip()]
    m = max(1, len(words))
    hashed = np.fromiter(map(hash, words), np.int64, len(words))
    _, counts = np.unique(hashed, return_counts=True)
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / n if raw else 1.0
    letters = max(1, kinds[2] + kinds[3])
    odd = sum(w[-1] in "!#$%&*|" for w in words)
    upper = sum(len(w) > 1 and w.isupper() for w in words)
    return np.array([
        np.log1p(m), kinds[2] / letters, kinds[4] / n, kinds[7] / n, text.count("|") / m, kinds[5] / n, text.count("!") / m,
        len(counts) / m * np.sqrt(np.log1p(m)), float((hashed[1:] == hashed[:-1]).mean()) if len(words) > 1 else 0.0,
        (counts.max() if len(counts) else 0) / m, len(set(lines)) / max(1, len(lines)), len(text) / m / 10, np.log1p(m / max(1, len(lines))),
        text.count(".") / m, packed, odd / m, upper / m, 1.0 / m,
    ])


@dataclass
class Ranker:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    level: float = 0.0

    def wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, z**2], 1)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.wide(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strengths(x) + self.level, -30, 30)))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(-1, len(NAMES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the packed features, of every row of ``docs``: texts are read once."""
    bound_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype("<f8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])
        trim()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, x binary"), "measured")


def _sums(rows: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of the vectors that ``step`` gives for batches of all rows, in an order that does not depend on the tasks' order."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = step(batch) if total is None else total + step(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["sums"])
        trim()

    return np.sum([np.frombuffer(s, "<f8") for s in sorted(bytes(r["sums"]) for r in rows.mapInArrow(apply, "sums binary").collect())], 0)


def _pairs(examples: DataFrame, lower: int, higher: int) -> DataFrame:
    """Pairs (low, high) of packed features in which each example occurs; examples of label 0 have the first ``lower`` slots.

    The draws are numbered: draw i is of the lower text i modulo their number, and block k
    of DRAWS draws comes from seed k.
    """
    each = min(PAIRS, higher)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            number = (batch.column("slot").to_numpy()[:, None] + np.arange(each) * lower).ravel()
            block, place = np.divmod(number, DRAWS)
            met = np.empty(len(number), np.int64)
            used = np.unique(block).tolist()
            blocks = {k: blocks[k] if k in blocks else np.random.default_rng(k).integers(higher, size=DRAWS) for k in used}
            for k in used:
                met[block == k] = blocks[k][place[block == k]]
            low = batch.column("x").take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
            yield pa.RecordBatch.from_arrays([low, pa.array(met)], names=["low", "place"])

    lows = examples.where(F.col("slot") < lower).select("slot", "x")
    highs = examples.where(F.col("slot") >= lower).select((F.col("slot") - lower).alias("place"), F.col("x").alias("high"))
    drawn = written(lows.mapInArrow(draw, "low binary, place long").join(highs, "place"), "drawn")
    left = highs.join(drawn.select("place").distinct(), "place", "left_anti").withColumn("slot", F.col("place") % lower)
    left = written(left.join(lows.withColumnRenamed("x", "low"), "slot").select("low", "high"), "left")
    return drawn.select("low", "high").unionByName(left)


def _pairwise(pairs: DataFrame, model: Ranker, ridge: float = 1e-2) -> np.ndarray:
    """Bradley-Terry weights: logistic loss on differences of a good and a bad text's features, by Newton steps over all pairs."""
    k = 2 * len(NAMES)
    w = np.zeros(k)
    for _ in range(40):

        def step(batch: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            high, low = (model.wide(_matrix(batch.column(c).to_pylist())) for c in ("high", "low"))
            d = high - low
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance of the wrong order
            return np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        n, *sums = np.split(_sums(pairs, step), [1, 1 + k])
        move = np.linalg.solve(sums[1].reshape(k, k) / n + ridge * np.eye(k), sums[0] / n - ridge * w)
        w = w + move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _slope(strengths: DataFrame) -> float:
    """Slope of a logistic curve from strength to label over all rows, by Newton steps with a small ridge."""
    b = np.zeros(2)
    for _ in range(50):

        def step(batch: pa.RecordBatch, b: np.ndarray = b) -> np.ndarray:
            s = batch.column("strength").to_numpy()
            a = np.stack([s, np.ones_like(s)], 1)
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            return np.concatenate([a.T @ (batch.column("label").to_numpy() - p), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])

        gradient, hessian = np.split(_sums(strengths, step), [2])
        move = np.linalg.solve(hessian.reshape(2, 2) + 1e-3 * np.eye(2), gradient - 1e-3 * b)
        b = b + move
        if np.abs(move).max() < 1e-8:
            break
    return float(max(b[0], 1e-3))


def _at_rank(strengths: DataFrame, rank: int) -> tuple[float, float]:
    """The strengths at places ``rank`` and ``rank + 1`` (from 0) in their order: exact, by bins narrowed down to one value."""
    s, before = F.col("strength"), 0
    low, high = strengths.agg(F.min(s), F.max(s)).first()
    while low < high:
        place = F.floor((s - low) / (high - low) * BINS).alias("bin")
        bins = strengths.where(s.between(low, high)).groupBy(place).agg(F.count("*"), F.min(s), F.max(s)).collect()
        for _, n, low, high in sorted(bins):  # noqa: B007
            if rank < before + n:
                break
            before += n
    same, above = strengths.agg(F.count(F.when(s == low, 1)), F.min(F.when(s > low, s))).first()
    return low, low if rank + 1 < before + same else above


def learn(rows: DataFrame, labelled: DataFrame) -> Ranker:
    """A ranker from all labelled rows of ``rows`` (doc_id, x as from ``measured``).

    ``labelled``: doc_id, label (0 or 1; rows with nulls are left out; of repeated doc_ids the
    smallest label counts). The quantile of the threshold is the share of label 0: the strength
    that so many labelled rows stay below gets the score CUT. Without both labels all texts get
    one score (1 if only label 1 occurs or none, else 0).
    """
    bound_batches(rows.sparkSession)
    labelled = labelled.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("long").alias("label"))
    order = ("label", "doc_id", F.xxhash64("x"))
    examples = written(with_slot(rows.join(labelled, "doc_id").select("label", "doc_id", "x"), *order), "examples")
    counts = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, k = sum(counts.values()), len(NAMES)
    if len(counts) < 2:
        return Ranker(np.zeros(k), np.ones(k), np.zeros(2 * k), 1.0, -12.0 if 0 in counts else 12.0)
    x = examples.select("x")
    centre = _sums(x, lambda batch: _matrix(batch.column("x").to_pylist()).sum(0)) / n
    scale = np.sqrt(_sums(x, lambda batch: ((_matrix(batch.column("x").to_pylist()) - centre) ** 2).sum(0)) / n) + 1e-6
    model = Ranker(centre, scale, np.zeros(2 * k))
    model.weights = _pairwise(_pairs(examples, counts[0], counts[1]), model)
    strengths = written(examples.select(_applied(model.strengths)("x").alias("strength"), "label"), "strengths")
    model.slope = _slope(strengths)
    threshold = sum(_at_rank(strengths, counts[0] - 1)) / 2
    model.level = float(np.log(CUT / (1 - CUT)) - model.slope * threshold)
    return model


def fit(docs: DataFrame, labelled: DataFrame) -> Ranker:
    """A ranker from all rows of ``docs`` that ``labelled`` names, see ``learn``."""
    return learn(measured(docs), labelled)


def _applied(number: Callable[[np.ndarray], np.ndarray]) -> Callable[[str], Column]:
    """A function of a column of packed features, from one of their matrix."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(number(_matrix(x.tolist())))
        trim()

    return apply


def scored(docs: DataFrame, model: Ranker) -> Column:
    """A column for ``docs``: the score of the column ``text`` (0 to 1)."""

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            x = np.stack([features(t) for t in text.tolist()]) if len(text) else np.zeros((0, len(NAMES)))
            yield pd.Series(model.scores(x))
        trim()

    return apply("text")


def clean(docs: DataFrame, labels: DataFrame, least: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    return docs.where(scored(docs, fit(docs, training_labels(labels))) >= least)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: rows whose crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(digits_crc() % 4 != 2).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest rows: doc_id, held_out, score, predicted.

    Repeated rows get repeated results, a null doc_id stays null, null and empty texts get
    one and the same score; other columns are not read.
    """
    measures = measured(docs)
    rows = measures.select("doc_id", _applied(learn(measures, training_labels(labels)).scores)("x").alias("score"))
    return rows.select("doc_id", (digits_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

"""Language-model scores by deleted interpolation of 1- and 2-gram relative frequencies.

A token's probability after h is
    w2[b] c(h, w) / c(h)  +  w1[b] c(w) / N  +  w0[b] (c(w) + 0.1) / (N + 0.1 (V + 1))
with weights by the bucket b of the context's frequency. The weights are learned by
expectation-maximisation on deleted counts: each training token is predicted from the
counts without itself, so every training token is held out once.

Counting is an exchange between batches of texts and n-gram partitions. Batches are cut
once and written. A batch sends each partition its distinct n-grams there, once, with
their training counts (so a very frequent n-gram costs a row entry per batch, never a row
per occurrence); the partition adds up and answers every batch in the order it asked.
There are as many partitions as the corpus needs for each to stay of one size. Nothing
of the counts is broadcast or collected; the driver sees the counts' totals and a
histogram of bounded size that the weights are learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import words
from pointloom.llm.common import bound_batches, digits_crc, written

#: Characters of a batch, and of the corpus for each n-gram partition; they bound a worker's memory.
BATCH, PARTITION = 12 << 20, 16 << 20
BUCKETS = 24
#: Bins of the logarithm of a probability in the histogram for the weights.
BINS, BIN_WIDTH = 120, 0.2
ROUNDS = 60
ADDED = 0.1
_END, _BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x0A0761D6478BD642)


def _pack(array: np.ndarray) -> bytes:
    """An array's bytes, first bytes first, compressed."""
    flat = np.ascontiguousarray(array)
    return zstandard.compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes() if len(flat) else b"", 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).reshape(-1).view(kind)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts (each text's words, then the end), and each text's number of tokens."""
    hashes, counts = words.plain_words(texts)
    ends = np.cumsum(counts)
    return np.insert(hashes, ends, _END), counts + 1


def bigrams(token: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (the first of a text: with the beginning)."""
    before = np.concatenate([[_BEGIN], token[:-1]]) if len(token) else token
    before = before.copy()
    before[np.cumsum(counts) - counts] = _BEGIN
    return words.mix(words.mix(before) * np.uint64(0x9E3779B97F4A7C15) + token)


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """A task's rows in batches of about BATCH characters, numbered within all tasks."""
    from pyspark import TaskContext

    first, n = TaskContext.get().partitionId() << 32, 0
    held, size = [], 0
    for frame in rows:
        for k in range(0, len(frame), 200):
            part = frame.iloc[k : k + 200]
            held.append(part)
            size += int(part["text"].str.len().fillna(0).sum())
            if size >= BATCH:
                yield first + n, pd.concat(held, ignore_index=True)
                held, size, n = [], 0, n + 1
    if held:
        yield first + n, pd.concat(held, ignore_index=True)


def _distinct(texts: list[str | None], train: np.ndarray):
    """Tokens, their counts by text, and the sorted distinct 1- and 2-grams with training counts and places."""
    token, counts = tokens(texts)
    learn = np.repeat(train, counts)
    out = []
    for gram in (token, bigrams(token, counts)):
        known, inverse = np.unique(gram, return_inverse=True)
        out.append((known, np.bincount(inverse, learn, len(known)).astype(np.uint32), inverse))
    return token, counts, out


def batched(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, train) in packed batches, a row each; written, so that all later steps see the same."""

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, rows in _batches(frames):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
            sizes = np.array([len(r) for r in raw], np.int64)
            ids = rows["doc_id"].astype("Int64")
            yield pd.DataFrame({
                "batch": [batch], "ids": [_pack(ids.fillna(0).to_numpy(np.int64))], "null": [_pack(ids.isna().to_numpy(np.uint8))],
                "train": [_pack(rows["train"].to_numpy(np.uint8))], "sizes": [_pack(sizes)], "bytes": [int(sizes.sum())], "raw": [zstandard.compress(b"".join(raw), 3)],
            })

    bound_batches(docs.sparkSession)
    return written(docs.mapInPandas(texts, "batch long, ids binary, null binary, train binary, sizes binary, bytes long, raw binary"), "batches")


def _grams(row) -> tuple[np.ndarray, np.ndarray, list]:
    """A batch's train flags, each text's number of tokens, and its distinct n-grams; see _distinct."""
    train = _unpack(row["train"], "u1").astype(bool)
    ends = np.cumsum(_unpack(row["sizes"], "i8")).tolist()
    raw = zstandard.decompress(row["raw"])
    texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    _, counts, grams = _distinct(texts, train)
    return train, counts, grams


def ask(batches: DataFrame, partitions: int) -> DataFrame:
    """Each batch's distinct n-grams by partition: the leading bits of the hash."""
    cuts = np.array([(i << 64) // partitions for i in range(1, partitions)], np.uint64)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, batch in frame.iterrows():
                grams = _grams(batch)[2]
                bounds = [np.concatenate([[0], np.searchsorted(known, cuts), [len(known)]]) for known, _, _ in grams]
                out = []
                for p in range(partitions):
                    row = [p, batch["batch"]]
                    for (known, n, _), at in zip(grams, bounds, strict=True):
                        mine = known[at[p] : at[p + 1]]
                        row += [_pack(np.diff(mine, prepend=np.uint64(0))), _pack(n[at[p] : at[p + 1]])]
                    out.append(row)
                    if len(out) == 256 or p == partitions - 1:
                        yield pd.DataFrame(out, columns=["p", "batch", "one", "n_one", "two", "n_two"])
                        out = []

    return batches.select("batch", "train", "sizes", "raw").mapInPandas(apply, "p int, batch long, one binary, n_one binary, two binary, n_two binary")


def answer(asked: DataFrame) -> DataFrame:
    """Every batch's answer from each partition: its n-grams' training counts, and the partition's number of training tokens and types."""

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        answers: dict[str, list[bytes]] = {}
        tokens_here = types_here = 0
        for name in ("one", "two"):
            keys = [np.cumsum(_unpack(r, "u8"), dtype=np.uint64) for r in rows[name]]
            counts = [_unpack(r, "u4") for r in rows[f"n_{name}"]]
            known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate(counts), len(known)).astype(np.uint64)
            at = np.cumsum([0, *map(len, keys)])
            answers[name] = [_pack(sums[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
            if name == "one":
                tokens_here, types_here = int(sums.sum()), int((sums > 0).sum())
        return pd.DataFrame({"batch": rows["batch"], "p": rows["p"], "one": answers["one"], "two": answers["two"], "tokens": tokens_here, "types": types_here})

    return asked.groupBy("p").applyInPandas(total, "batch long, p int, one binary, two binary, tokens long, types long")


def counted(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per document: doc_id, train, number of tokens, and packed training counts of its tokens and 2-grams; written.

    ``docs`` (doc_id, text, train) is read once; a task that is run again later reads the written
    batches, so it asks and looks up the same however the input came about.
    """

    def look_up(key, state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        answers = answers.sort_values("p")
        ids, null = _unpack(row["ids"], "i8"), _unpack(row["null"], "u1").astype(bool)
        train, counts, grams = _grams(row)
        places = []
        for name, (_, _, inverse) in zip(("one", "two"), grams, strict=True):
            places.append(np.concatenate([_unpack(r, "u8") for r in answers[name]])[inverse])
        cuts = np.cumsum(counts)[:-1]
        out = pd.DataFrame({
            "doc_id": pd.array(np.where(null, 0, ids), "Int64"), "train": train, "n_tokens": counts,
            "one": [_pack(x) for x in np.split(places[0], cuts)], "two": [_pack(x) for x in np.split(places[1], cuts)],
        })
        out.loc[null, "doc_id"] = pd.NA
        out["types"] = int(answers["types"].sum())
        out["tokens"] = int(answers["tokens"].sum())
        return out

    batches = batched(docs)
    n, size = batches.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    partitions = partitions or max(cores, -(-size // PARTITION))
    tasks = max(cores, n)
    replies = answer(ask(batches, partitions).repartition(partitions, "p")).repartition(tasks, "batch")
    both = batches.drop("bytes").repartition(tasks, "batch").groupBy("batch").cogroup(replies.groupBy("batch"))
    found = both.applyInPandas(look_up, "doc_id long, train boolean, n_tokens long, one binary, two binary, types long, tokens long")
    return written(found, "counted")


def _contexts(one: np.ndarray, two: np.ndarray, ends: int) -> np.ndarray:
    """Training count of each token's context: the token before, or the beginning (as often as texts end)."""
    return np.concatenate([[ends], one[:-1]]).astype(np.float64)


def _bucket(context: np.ndarray) -> np.ndarray:
    """Buckets by powers of two of the context's training count; 0 for none."""
    return np.minimum(BUCKETS - 1, np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0)).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.minimum(BINS - 2, np.floor(-np.log(np.maximum(p, 1e-300)) / BIN_WIDTH)), 0).astype(np.int64)


def histogram(rows: DataFrame, totals: tuple[int, int, int]) -> np.ndarray:
    """Over all training tokens: buckets by bins of the deleted 2-gram and 1-gram estimates."""
    n, v, ends = totals

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(BUCKETS * BINS * BINS, np.int64)
        for frame in frames:
            for a, b in zip(frame["one"], frame["two"], strict=True):
                one, two = _unpack(a, "u8").astype(float), _unpack(b, "u8").astype(float)
                context = _contexts(one, two, ends) - 1
                p2 = np.where(context > 0, (two - 1) / np.maximum(context, 1), 0)
                p1 = (one - 1) / max(1, n - 1)
                cells += np.bincount((_bucket(context) * BINS + _bin(p2)) * BINS + _bin(p1), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": at, "n": cells[at]})

    sums = rows.where("train").select("one", "two").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS * BINS * BINS, np.int64)
    out[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out.reshape(BUCKETS, BINS, BINS)


def learn(cells: np.ndarray, n: int, v: int) -> np.ndarray:
    """Mixture weights (buckets x 3: 2-gram, 1-gram, smoothed 1-gram) by expectation-maximisation."""
    middle = np.concatenate([[0], np.exp(-(np.arange(BINS - 1) + 0.5) * BIN_WIDTH)])
    p1 = np.broadcast_to(middle[None, :], (BINS, BINS))
    p2 = np.broadcast_to(middle[:, None], (BINS, BINS))
    p0 = (p1 * max(1, n - 1) + ADDED) / (max(0, n - 1) + ADDED * (v + 1))
    parts = np.stack([p2, p1, p0], -1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for b in range(BUCKETS):
        start = np.full(3, 1 / 3) if b else np.array([0, 0.5, 0.5])
        seen = cells[b].astype(float)
        for _ in range(ROUNDS if seen.sum() else 0):
            joint = parts * start
            share = joint / joint.sum(-1, keepdims=True)
            start = (share * seen[..., None]).sum((0, 1)) / seen.sum()
        start = np.maximum(start, [0, 0, 1e-6])  # never leave a token without probability
        weights[b] = start / start.sum()
    weights[0] = [0, weights[0, 1] / weights[0, 1:].sum(), weights[0, 2] / weights[0, 1:].sum()]
    return weights


def probabilities(one: np.ndarray, two: np.ndarray, context: np.ndarray, weights: np.ndarray, n: int, v: int) -> np.ndarray:
    """Each token's probability from its, its 2-gram's and its context's training counts."""
    w = weights[_bucket(context)]
    p2 = np.where(context > 0, two / np.maximum(context, 1), 0)
    p0 = (one + ADDED) / (n + ADDED * (v + 1))
    return w[:, 0] * p2 + w[:, 1] * one / max(1, n) + w[:, 2] * p0


def score(docs: DataFrame, train: F.Column | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    Null and empty texts are the end token alone; null ids stay null and are judged by the
    empty text's checksum; repeated rows are counted and scored each; without training
    texts all weight is on the smoothed estimate. Words are told apart by 64-bit hashes.
    """
    train = digits_crc() % 10 != 0 if train is None else train
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train"))
    found = counted(rows, partitions)
    n, v, ends = found.agg(F.coalesce(F.max("tokens"), F.lit(0)), F.coalesce(F.max("types"), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    weights = learn(histogram(found, (n, v, ends)), n, v)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            base, own, known = [], [], []
            for a, b in zip(frame["one"], frame["two"], strict=True):
                one, two = _unpack(a, "u8").astype(float), _unpack(b, "u8").astype(float)
                base.append(float(np.log10((one + ADDED) / (n + ADDED * (v + 1))).sum()))
                own.append(float(np.log10(probabilities(one, two, _contexts(one, two, ends), weights, n, v)).sum()))
                known.append(int((one > 0).sum()))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": ~frame["train"].astype(bool), "n_tokens": frame["n_tokens"], "n_known": known, "train_tokens": n, "base_score": base, "score": own})

    return found.select("doc_id", "train", "n_tokens", "one", "two").mapInPandas(
        apply, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

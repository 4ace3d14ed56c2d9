"""Best-fit packing of token sequences, planned on a histogram of lengths.

Only counts by length reach the driver (at most ``capacity`` rows). Best fit
decreasing runs over these counts: all pieces of one length that go to bins with one
free space are placed in one step, so a plan has a few thousand ranges however many
documents there are. Documents then take the planned slots by their rank within
their length. Ranks come from salted buckets, so no length is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm import bpe
from pointloom.llm.common import bound_batches, written

CAPACITY = 2048
#: Pieces of one length that are ranked together; more of a length are dealt to several buckets.
BUCKET_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids (its text's ids, then ``end_id``).

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``
    ids; the last may be shorter. Null text counts as empty (one piece: the end id);
    null doc_id stays null; repeated rows give repeated pieces; other columns of
    ``docs`` are not read. ``with_ids`` adds the ids themselves (array<int>).
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = bpe.encoder(vocabulary).encode
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                rows = []
                for doc, ids in zip(part["doc_id"].tolist(), encode(part["text"].tolist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at : at + capacity]
                        rows.append((doc, n, at, len(piece), zlib.crc32(piece.tobytes()), *([piece.astype(np.int32)] if with_ids else [])))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out
        bpe.release()

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit decreasing over counts: rows (length, first rank, first sequence, first offset, pieces per sequence).

    Pieces of a length with ranks from ``first rank`` up to the next row's of that length
    go to consecutive sequences, so many to each, one behind the other.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: ranges of sequences (first, how many)
    spaces: list[int] = []
    rows, used = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, first = capacity, used
                n = -(-left // (capacity // length))
                used += n
            each = space // length
            full, rest = min(n, left // each), 0
            if full < n:
                rest = min(left - full * each, each)
            rows.append((length, rank, first, capacity - space, each))
            rank += full * each + rest
            left -= full * each + rest
            put(space - each * length, first, full)
            if rest:
                put(space - rest * length, first + full, 1)
            put(space, first + full + bool(rest), n - full - bool(rest))
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns; length between 1 and capacity) with sequence_id and offset.

    Sequences hold at most ``capacity`` and are gapless from offset 0. ``pieces`` must be
    stable when read again (a written table); equal rows each get a place of their own.
    An empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = plan(counts, capacity)
    keys = table[:, 0] << 44 | table[:, 1]
    order = np.argsort(keys)
    table, keys = table[order], keys[order]
    spread = pieces.withColumn("__at", F.monotonically_increasing_id())
    crowded = [(length, -(-n // BUCKET_ROWS)) for length, n in counts.items() if n > BUCKET_ROWS]  # at most capacity rows
    buckets = F.broadcast(pieces.sparkSession.createDataFrame(crowded, "length long, __buckets long"))
    draw = F.pmod(F.xxhash64("__at"), F.coalesce("__buckets", F.lit(1))).cast("int")
    spread = written(spread.join(buckets, "length", "left").withColumn("__bucket", draw).drop("__buckets"), "pieces")
    sizes = spread.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy("__at")
    ranked = spread.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__base", "__bucket", "__at")

    def place(length: pd.Series, rank: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        nth = rank.to_numpy() - table[at, 1]
        each = table[at, 4]
        return table[at, 2] + nth // each, table[at, 3] + nth % each * length.to_numpy()

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = place(length, rank)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__slot", slot("length", "__rank"))
    return placed.select(*pieces.columns, "__slot.sequence_id", "__slot.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole packed sequences: sequence_id, ids and the pieces in them; ``packed`` needs the ids column."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p.doc_id, p.piece, p.offset)).alias("pieces"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Digest rows of all documents' pieces with their places (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = written(token_pieces(docs, capacity, vocabulary), "pieces")
    return pack(pieces, capacity)

"""N-gram Jaccard self-join: MinHash LSH forest for candidates, then exact verification.

1. Texts with the same set of word shingles form one copy class; classes go on.
2. A class's MinHash values are labels of ``DEEPEST`` values in ``TREES`` tries. Rows sorted by
   trie and label are the tries laid flat, cut over the tasks by ranges, so that a crowded
   branch is many tasks' work. Classes meet where their labels agree deepest; then the
   prefixes they share are shortened, a value at a time, until a pair at the threshold has met
   with the target ``RECALL`` (1 - (1 - s^d)^TREES at depth d). A class very close to
   a leader is linked to it and stops there: the leader stands for it on shorter prefixes. By
   the triangle inequality of the Jaccard distance no pair at the threshold is lost
   if links to leaders are accepted from a correspondingly lower similarity. Leaders of
   branches that several tasks share meet in a second pass.
3. The links' connected components are coarse clusters; within each, in blocks sorted by
   set size, all pairs are verified by exact intersections of the whole shingle sets.
   Blocks whose sizes cannot reach the threshold do not meet.
4. Only link counts and spanning links leave the verification, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import words
from pointloom.llm.common import bound_batches, trim
from pointloom.operators.points import running_sum
from pointloom.plans.components import components, local_roots
from pointloom.storage import written

SHINGLE = 5
SIMILARITY = 0.8
TREES, DEEPEST, RECALL = 24, 8, 0.9999
#: Bytes of MinHash values that travel with a class, for estimates in the tries.
SKETCH = 60
#: Distance up to which a class is represented by its leader, and room for estimation errors.
ABSORBED, ROOM = 0.08, 0.17
#: Rows of a branch that are compared at once, whatever their prefixes.
FEW = 64
#: Classes, and shingles of all their texts, in a block of the verification (a longer text is a block of its own).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Characters handled at once in a worker.
CHUNK = 4 << 20


def depth(similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix at which pairs of the given similarity meet with the target recall."""
    for d in range(deepest, 1, -1):
        if 1 - (1 - similarity**d) ** trees >= recall:
            return d
    return 1


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles (shorter texts: of all its words), and their counts."""
    hashes, counts = words.plain_words(texts)
    of = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    windows = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first, windows)
    owner = np.repeat(np.arange(len(texts)), windows)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    owners = np.concatenate([of, np.full(n, -1)])
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        part = np.where(owners[at + k] == owner, padded[at + k], np.uint64(k))
        value = words.mix(value * np.uint64(0x100000001B3) + part)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i - start >= 4000:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def minhashes(values: np.ndarray, counts: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values (32 bits) per set; empty sets get zeros."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.zeros((len(counts), n), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        for i in range(n):
            out[full, i] = (np.minimum.reduceat(values * factor[i] + plus[i], first) >> np.uint64(32)).astype(np.uint32)
    return out


def sign(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text key, class (hash of its shingle set), set size and MinHash values; written."""
    hashes = TREES * DEEPEST

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _chunks(texts):
                values, counts = shingle_sets(texts[part])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                ends = np.cumsum(counts)
                total = words.mix((sums[ends] - sums[ends - counts]) ^ counts.astype(np.uint64))
                signature = minhashes(values, counts, hashes)
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_key"), pa.array(total.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array([r.tobytes() for r in signature], pa.binary())],
                    ["doc_id", "text_key", "class", "n", "signature"],
                )
        trim()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(apply, "doc_id long, text_key long, class long, n long, signature binary"), "signed")


def copy_classes(signed: DataFrame) -> DataFrame:
    """One row per shingle set: class, n, signature, the least doc_id of its rows and how many they are."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key", "signature")).alias("r")
    rows = signed.groupBy("class", "n").agg(one, F.count("*").alias("copies"))
    return rows.select("class", "n", F.col("r.doc_id").alias("doc_id"), "r.text_key", "r.signature", "copies")


def _spread(d: int):
    """Each class once a trie: key (trie and first d values), the label's other values, class and sketch."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                m = part.num_rows
                values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(m, TREES, DEEPEST)
                flat = values.reshape(m, -1)
                sketch = _binary(flat[:, :: max(1, flat.shape[1] // SKETCH)][:, :SKETCH].astype(np.uint8))
                for tree in range(TREES):
                    key = np.full(m, tree + 1, np.uint64)
                    for k in range(d):
                        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, tree, k].astype(np.uint64))
                    longer = _binary(values[:, tree, d:].astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), longer, part.column("class"), sketch], ["key", "longer", "class", "sketch"])

    return apply


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of a matrix's rows of bytes."""
    m, width = rows.shape
    ends = pa.py_buffer((np.arange(m + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), m, [None, ends, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.ChunkedArray, start: int, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.slice(start, n).to_pylist()), np.uint8).reshape(n, -1)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """The least member of each member's component of a symmetric boolean matrix."""
    return local_roots(len(near), *np.nonzero(near))


def branch_links(labels: np.ndarray, sketches: np.ndarray, similarity: float, fixed: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Spanning links (least member, member) of the likely similar rows of one branch, its leaders, and which of these stand for others.

    ``labels`` (sorted) are the values below the branch. Rows meet where most values agree,
    and those that are left without a leader meet again one value higher up. ``fixed`` rows
    stand for others already, so no leader may stand for them.
    """
    least = (similarity - ABSORBED - ROOM) * sketches.shape[1]
    close = (1 - ABSORBED) * sketches.shape[1]
    n = len(sketches)
    union, stands = _Union(n), np.zeros(n, bool) if fixed is None else fixed.copy()

    def meet(rows: np.ndarray) -> np.ndarray:
        """Links the rows; gives those that no other stands for."""
        rows = rows[np.argsort(~stands[rows], kind="stable")]
        leaders = np.empty(0, np.int64)
        for start in range(0, len(rows), 256):
            now = rows[start : start + 256]
            if len(leaders):
                same = _agreement(sketches[now], sketches[leaders])
                roots = np.array([union.find(int(i)) for i in leaders])
                for i, row in zip(now.tolist(), same >= least, strict=True):
                    for root in np.unique(roots[row]).tolist():
                        union.join(i, root)
                near = (same >= close) & ~stands[now][:, None]
                stands[leaders[near.argmax(1)[near.any(1)]]] = True
                now = now[~near.any(1)]
            same = _agreement(sketches[now], sketches[now])
            for i, root in enumerate(_roots(same >= least).tolist()):
                union.join(int(now[i]), int(now[root]))
            near, kept = same >= close, np.ones(len(now), bool)
            for i in range(1, len(now)):
                hits = np.flatnonzero(near[i, :i] & kept[:i])
                if len(hits) and not stands[now[i]]:
                    kept[i] = False
                    stands[now[hits[0]]] = True
            leaders = np.concatenate([leaders, now[kept]])
        return leaders

    live = np.arange(n)
    for level in range(labels.shape[1] if n > FEW else 0, -1, -1):
        new = np.ones(len(live), bool)
        new[1:] = (labels[live[1:], :level] != labels[live[:-1], :level]).any(1)
        cuts = np.append(np.flatnonzero(new), len(live)).tolist()
        left = [meet(live[a:b]) if b - a > 1 else live[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        live = np.sort(np.concatenate(left))
    roots = [union.find(i) for i in range(n)]
    return [(r, i) for i, r in enumerate(roots) if r != i], live, stands[live]


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys in a sorted stream; each key's rows whole, most groups of one row together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(k)[batch.num_rows - 1] for k in key]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        open_rows = np.logical_and.reduce([c == x.as_py() for c, x in zip(columns, last, strict=True)])
        first_open = int(np.argmax(open_rows))  # sorted: the open key's rows stand last
        if first_open == 0:
            continue
        held[-1] = batch.slice(0, first_open)
        yield pa.Table.from_batches(held)
        held = [batch.slice(first_open)]
    if held:
        yield pa.Table.from_batches(held)


def _meet(similarity: float, ends: bool):
    """Links of each branch's classes; with ``ends``, also the leaders of a task's first and last branch, which other tasks may share."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple[int, int]], leaders: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            key, one, longer, sketch, stands = zip(*leaders, strict=True) if leaders else ((), (), (), (), ())
            none = [None] * len(a)
            columns = [pa.array([*a, *one], pa.int64()), pa.array([*b, *[None] * len(one)], pa.int64()), pa.array([*none, *key], pa.int64())]
            columns += [pa.array([*none, *longer], pa.binary()), pa.array([*none, *sketch], pa.binary()), pa.array([*none, *stands], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "longer", "sketch", "stands"])

        opening, last = True, []
        for rows in _by_key(batches, ["key"]):
            key = rows.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            number = rows.column("class").to_numpy()
            fixed = rows.column("stands").to_numpy() if "stands" in rows.column_names else None
            edge = {0, len(starts) - 1} if ends else set()
            links: list[tuple[int, int]] = []
            leaders: list[tuple] = []
            for g in np.union1d(np.flatnonzero(sizes > 1), sorted(edge)).astype(int).tolist():
                s, n = int(starts[g]), int(sizes[g])
                labels, sketches = _matrix(rows.column("longer"), s, n), _matrix(rows.column("sketch"), s, n)
                found, live, stands = branch_links(labels, sketches, similarity, None if fixed is None else fixed[s : s + n])
                links += [(int(number[s + i]), int(number[s + j])) for i, j in found]
                if g in edge:
                    led = [(int(key[s]), int(number[s + i]), labels[i].tobytes(), sketches[i].tobytes(), bool(y)) for i, y in zip(live.tolist(), stands.tolist(), strict=True)]
                    leaders, last = leaders + (led if opening else []), [] if opening and len(starts) == 1 else led
                    opening = False
            if links or leaders:
                yield out(links, leaders)
        if last:
            yield out([], last)
        trim()

    return apply


def candidate_links(classes: DataFrame, similarity: float = SIMILARITY, tasks: int | None = None) -> DataFrame:
    """Spanning links (a, b) of classes that may be similar."""
    found = "a long, b long, key long, longer binary, sketch binary, stands boolean"
    tasks = tasks or int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.where("n > 0").select("class", "signature").mapInArrow(_spread(depth(similarity)), "key long, longer binary, class long, sketch binary")
    order = ("key", "longer", "class")
    met = written(spread.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_meet(similarity, True), found), "met")
    shared = met.where("b is null").select("key", "longer", F.col("a").alias("class"), "sketch", "stands")
    again = shared.repartition(tasks, "key").sortWithinPartitions(*order).mapInArrow(_meet(similarity, False), found)
    return met.where("b is not null").select("a", "b").unionByName(again.select("a", "b"))


def similar_pairs(values: np.ndarray, counts: np.ndarray, similarity: Fraction, side: np.ndarray | None = None) -> np.ndarray:
    """A boolean matrix: which two sets have exact Jaccard similarity of at least the threshold (of different sides, if given)."""
    m = len(counts)
    owner = np.repeat(np.arange(m), counts)
    order = np.argsort(values, kind="stable")
    value, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(value)))
    shared = np.zeros((m, m), np.float32)
    frequent = np.flatnonzero(sizes > 24)
    for k in range(0, len(frequent), 2048):
        part = frequent[k : k + 2048]
        spots = np.arange(int(sizes[part].sum())) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part]) + np.repeat(starts[part], sizes[part])
        x = np.zeros((m, len(part)), np.float32)
        x[owner[spots], np.repeat(np.arange(len(part)), sizes[part])] = 1
        shared += x @ x.T
    flat = np.zeros(m * m, np.int64)
    for f in range(2, 25):
        at = starts[sizes == f]
        for k in range(0, len(at), 200_000):
            who = owner[at[k : k + 200_000, None] + np.arange(f)]
            for i in range(f):
                for j in range(i + 1, f):
                    flat += np.bincount(who[:, i] * m + who[:, j], minlength=m * m)
    flat = flat.reshape(m, m)
    both = shared.astype(np.int64) + flat + flat.T
    p, q = similarity.numerator, similarity.denominator
    n = counts.astype(np.int64)
    near = both * (p + q) >= p * (n[:, None] + n[None, :])
    near[np.arange(m), np.arange(m)] = False
    if side is not None:
        near &= side[:, None] != side[None, :]
    return near & (n[:, None] > 0)


def verify(docs: DataFrame, classes: DataFrame, clusters: DataFrame, similarity: float = SIMILARITY, tasks: int | None = None) -> DataFrame:
    """(class, root, links): of each pair of blocks, a class's links (in documents) and its spanning link."""
    exact = Fraction(str(similarity))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ["root", "low", "high"]):
            keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in ("root", "low", "high")])
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            stops = np.append(starts[1:], rows.num_rows)
            number, copies, block = (rows.column(c).to_numpy() for c in ("class", "copies", "block"))
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                texts = rows.column("text").slice(a, b - a).to_pylist()
                found = [shingle_sets(texts[s]) for s in _chunks(texts)]
                values, counts = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                near = similar_pairs(values, counts, exact, block[a:b] if keys[1, a] != keys[2, a] else None)
                links = near @ copies[a:b]
                some = np.flatnonzero(links)
                roots = _roots(near)[some]
                yield pa.RecordBatch.from_arrays([pa.array(number[a:b][some]), pa.array(number[a:b][roots]), pa.array(links[some].astype(np.int64))], ["class", "root", "links"])
        trim()

    members = classes.drop("signature").join(clusters.select(F.col("node").alias("class"), "root"), "class")
    members = members.withColumn("weight", F.greatest(F.lit(BLOCK_SHINGLES // BLOCK).cast("long"), F.col("n")))
    large = members.groupBy("root").agg(F.sum("weight").alias("m")).where(F.col("m") > BLOCK_SHINGLES).select("root")
    # positions over range partitions, less those before the cluster: no cluster is numbered by one task
    summed = written(running_sum(members.join(large, "root"), "weight", "root", "n", "class", name="upto"), "summed")
    base = summed.groupBy("root").agg(F.min(F.col("upto") - F.col("weight")).alias("base"))
    big = summed.join(base, "root").withColumn("block", F.floor((F.col("upto") - F.col("weight") - F.col("base")) / BLOCK_SHINGLES).cast("int"))
    big = big.drop("upto", "base", "weight")
    spans = big.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = (spans.select("root", F.col("block").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in ("low", "high"))
    p, q = exact.numerator, exact.denominator
    pairs = left.join(right, "root").where((F.col("low") <= F.col("high")) & (F.col("hi_low") * q >= F.col("lo_high") * p)).select("root", "low", "high")
    ends = F.array_distinct(F.array("low", "high"))
    tasks_of = pairs.select("root", "low", "high", F.explode(ends).alias("block"))
    big = big.join(tasks_of, ["root", "block"])
    zero = F.lit(0)
    small = members.drop("weight").join(large, "root", "left_anti").withColumns({"block": zero, "low": zero, "high": zero})
    wanted = small.unionByName(big)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1 << 63)))
    rows = texts.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key", "class", "low", "high"]) if has_repeats(docs) else texts.join(wanted, ["doc_id", "text_key"])
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("root", "low", "high", "block", "class", "copies", "text").repartition(tasks, "root", "low", "high").sortWithinPartitions("root", "low", "high", "block", "class")
    return rows.mapInArrow(check, "class long, root long, links long")


def has_repeats(docs: DataFrame) -> bool:
    """Whether a doc_id (null counts as one) occurs more than once."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _connected(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and each copy class (class, n, copy_id, text_key, copies, links) with the root of its component."""
    signed = sign(docs)
    classes = written(copy_classes(signed), "classes")
    clusters = components(candidate_links(classes, similarity))
    verified = written(verify(docs, classes, clusters, similarity), "verified")
    groups = components(verified.select(F.col("class").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "n", F.col("doc_id").alias("copy_id"), "text_key", "copies")
    known = known.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").join(links, "class", "left")
    return signed, known.withColumn("root", F.coalesce("root", "class"))


def join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, class_id, copy_id, copies, links.

    class_id is the least doc_id of all rows connected by similar pairs, copy_id that of
    the rows with the same shingle set, copies their number, links the number of other
    rows with similarity of at least the threshold (copies included). Texts without words
    (null, empty, white space) are copies of each other and similar to no other. Rows
    that repeat are copies; null doc_ids take part, and only give an id where no other is.
    """
    signed, known = _connected(docs, similarity)
    heads = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = known.join(heads, "root").select("class", "n", "class_id", "copy_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("doc_id", "class", "n").join(known, ["class", "n"]).select("doc_id", "class_id", "copy_id", "copies", "links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of connected rows: the least doc_id, whatever ids other groups have (null last; of rows with the same id, the least text key's; of equal rows, any one)."""
    _, known = _connected(docs, similarity)
    first = F.min(F.struct(F.col("copy_id").isNull().alias("no"), "copy_id", "text_key")).alias("r")
    heads = known.groupBy("root").agg(first).select(F.col("r.copy_id").alias("__head"), F.col("r.text_key").alias("__head_key"))
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64("text")})
    rows = rows.join(heads, F.col("__id").eqNullSafe(F.col("__head")) & (F.col("__key") == F.col("__head_key")), "left_semi")
    if has_repeats(docs):
        rows = rows.dropDuplicates(["__id", "__key"])
    return rows.select(*docs.columns)

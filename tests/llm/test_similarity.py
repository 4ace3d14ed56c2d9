import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import decontamination, jaccard
from tests.llm.conftest import prose


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_join_equals_brute_force(stored, rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and ((not sets[i] and not sets[j]) or (bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))) for j in range(n)] for i in range(n)]
    up = list(range(n))
    for _ in range(n):
        for i in range(n):
            up[i] = min([up[i], *(up[j] for j in range(n) if near[i][j])])
    ids = {r: min((rows[i][0] for i in range(n) if up[i] == r and rows[i][0] is not None), default=None) for r in set(up)}
    want = Counter((rows[i][0], ids[up[i]], sum(near[i])) for i in range(n))
    got = Counter((r["doc_id"], r["class_id"], r["links"]) for r in jaccard.join(stored).collect())
    assert got == want


def test_keep_one_keeps_one_row_of_each_group_and_all_columns(stored, rows):
    kept = jaccard.keep_one(stored)
    assert kept.columns == stored.columns
    groups = {r["class_id"] for r in jaccard.join(stored).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == groups


def test_keep_one_keeps_a_row_of_each_text_whatever_its_id(spark):
    rng = random.Random(31)
    a, b, c, d, e, f = (prose(rng, 40) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, e), (None, e), (3, f), (4, None), (None, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, a), (None, b), (1, c), (1, d), (2, e), (3, f), (4, None)])


def test_blocks_of_a_large_cluster_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 8 * 60)
    rng = random.Random(7)
    base = prose(rng, 60).split()
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    want = {i: sum(i != j and 10 * len(a & b) >= 8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r["doc_id"]: r["links"] for r in jaccard.join(docs).collect()} == want


def test_recall_of_the_forest(spark):
    rng = random.Random(3)
    rows = []
    for g in range(150):  # pairs close to the threshold
        words = [f"g{g}w{k}" for k in range(100)]
        other = list(words)
        other[10] = other[50] = "x"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    rng.shuffle(rows)
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = 10 * 86 >= 8 * 106
    assert sum(r["links"] for r in out) == (300 if want else 0)
    assert 1 - (1 - 0.8 ** jaccard.depth()) ** jaccard.TREES >= jaccard.RECALL


def test_empty_table(stored):
    assert jaccard.join(stored.limit(0)).count() == 0


def test_minhash_estimates():
    values = np.arange(200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m = jaccard.minhashes(np.concatenate([values[:150], values[50:200]]), np.array([150, 150]), 400)
    assert abs((m[0] == m[1]).mean() - 0.5) < 0.12


@pytest.fixture(scope="module")
def items():
    rng = random.Random(8)
    return [(k, f"{prose(rng, 20)} q{k}a q{k}b. {prose(rng, 5)} a{k}.") for k in range(30)] + [(30, ""), (31, "one")]


def plain_contaminated(rows, items, share=decontamination.SHARE, overlap=decontamination.OVERLAP):
    """BM25 over every passage and item, and overlaps of word triples, written out plainly."""
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or ""))
    bags = {i: split(t) for i, t in items if split(t)}
    df = Counter(w for b in bags.values() for w in set(b))
    mean = sum(map(len, bags.values())) / len(bags)

    def grams(ws, n):
        return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}

    def weights(b):
        idf = {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) for w in b}
        norm = 1.2 * (0.25 + 0.75 * len(b) / mean)
        raw = {w: idf[w] * c * 2.2 / (c + norm) for w, c in Counter(b).items()}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    found = set()
    for i, text in items:
        if i not in bags:
            continue
        b, shares = bags[i], weights(bags[i])
        stride = 64 * 2 ** max(0, math.ceil(math.log2(len(b) / 64)))
        parts = []
        for part in decontamination.question_and_answer(text):
            ws = split(part) or b
            n = min(3, len(ws))
            parts.append((n, grams(ws, n)))
        for doc, t in rows:
            ws = split(t)
            for start in range(0, max(1, math.ceil(len(ws) / stride) - 1) * stride, stride):
                passage = ws[start : start + 2 * stride]
                if sum(shares[w] for w in set(passage) & set(b)) >= share - 1e-9 and all(len(g & grams(passage, n)) / len(g) >= overlap for n, g in parts):
                    found.add((doc, i))
    return found


def test_decontamination_equals_brute_force(spark, stored, rows, items, monkeypatch):
    rng = random.Random(9)
    leaks = [(1000 + k, prose(rng, 150) + " " + items[k][1].upper() + " " + prose(rng, 150)) for k in range(10)] + [(2000, items[3][1] + " x " + items[4][1]), (2001, items[5][1][:40])]
    long = (50, prose(rng, 700) + ". " + prose(rng, 90))  # an item of a longer class
    leaks.append((3000, prose(rng, 500) + " " + long[1] + " " + prose(rng, 60) + " " + items[7][1]))
    leaks.append((3001, items[8][1].split(". ")[0] + " " + prose(rng, 300) + " " + items[8][1].split(". ")[1]))  # question and answer far apart
    every = [*items, long]
    docs = stored.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    table = spark.createDataFrame([*every, (None, None), items[0]], "item_id long, text string")
    want = plain_contaminated([*rows, *leaks], every)
    full = sorted(decontamination.contaminated(docs, table).collect())
    got = {(r["doc_id"], r["item_id"]) for r in full}
    assert got == want and {(1000 + k, k) for k in range(10)} | {(2000, 3), (2000, 4), (3000, 50), (3000, 7)} <= got
    assert not any(d in (2001, 3001) for d, _ in got)
    monkeypatch.setattr(decontamination, "MOST_WORDS", 60)  # many indexes give the same rows
    assert len(decontamination.indexes(table)) > 5 and sorted(decontamination.contaminated(docs, table).collect()) == full
    kept = decontamination.clean(stored, table)
    assert kept.columns == stored.columns
    assert decontamination.contaminated(docs.limit(0), table).count() == 0
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0


def test_retrieval_skips_nothing(items):
    rng = random.Random(11)
    index = decontamination.build(items)
    for _ in range(30):
        n = 6
        pairs = sorted({(rng.randrange(n), rng.randrange(len(index.vocabulary))) for _ in range(120)})
        p, t = (np.array(x) for x in zip(*pairs))
        got = set(zip(*(x.tolist() for x in decontamination.retrieve(index, p, t, n, 0.3)[:2])))
        dense = np.zeros((n, len(index.ids)))
        for a, b in pairs:
            for k in range(index.first[b], index.first[b + 1]):
                dense[a, index.item[k]] += index.share[k]
        assert got == set(zip(*(x.tolist() for x in np.nonzero(dense >= 0.3 - 1e-9))))


def edited(rng, words, changes, tag):
    """The words with some replaced, far enough apart that each costs five shingles."""
    out = list(words)
    for k in rng.sample(range(2, len(words) // 5 - 1), changes):
        out[5 * k] = f"{tag}{k}"
    return out


def test_recall_on_thousands_of_pairs_at_the_threshold(spark):
    """4,000 pairs of similarity 0.80 to 0.85, half of them with several very close copies that a leader stands for."""
    rng = random.Random(41)
    rows, want = [], 0
    for g in range(4000):
        n = rng.choice([88, 94, 100, 112])
        base = [f"g{g}w{k}" for k in range(n + 4)]
        total = n
        changes = next(c for c in range(1, 9) if 100 * (total - 5 * (c + 1)) < 80 * (total + 5 * (c + 1)))
        rows.append((g, 0, base))
        rows.append((g, 1, edited(rng, base, changes, "x")))
        if g % 2:
            rows += [(g, 2 + k, [*base, f"tail{k}"]) for k in range(3)]
        want += 1
    sets = {(g, k): shingles(" ".join(w)) for g, k, w in rows}
    docs = spark.createDataFrame([(8 * g + k, " ".join(w)) for g, k, w in rows], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["links"] for r in jaccard.join(docs).collect()}
    short = 0
    for g, k in sets:
        near = sum(10 * len(sets[g, k] & sets[g, j]) >= 8 * len(sets[g, k] | sets[g, j]) for j in range(5) if (g, j) in sets and j != k)
        assert got[8 * g + k] <= near
        short += near - got[8 * g + k]
    total = sum(got.values()) + short
    assert total > 15_000 and short <= 0.002 * total, (short, total)


@pytest.mark.parametrize("few", [0, 64])
def test_branches_that_tasks_share(spark, monkeypatch, few):
    """One cluster of near copies in a branch cut over many tasks: all links are found, whatever the prefixes compared first."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(17)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(edited(rng, base, rng.randint(0, 3), f"c{i}x")) for i in range(300)] + [prose(rng, 40) for _ in range(100)]
    sets = [shingles(t) for t in texts]
    want = {i: sum(i != j and 10 * len(a & b) >= 8 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {r["doc_id"]: r["links"] for r in jaccard.join(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want

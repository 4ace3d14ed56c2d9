import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pointloom.llm import bpe, packing, sharding


def test_encoder_gives_the_librarys_ids():
    e = bpe.Encoder()
    texts = ["á b́", "İstanbul don't we'll ÀÉ", "x\x1cy\x85z", "ΣΑΣ σας", "12ab34 #$%a", "<|endoftext|> hi<|endoftext|>!", " \n\n ", "a" * 5000, "été.Été", "ab'sc d'd", None, "", "×÷ýÿþß", "日本語 text", "a b c d"]
    for text, ids in zip(texts, e.encode(texts)):
        assert e.whole.encode(text or "", add_special_tokens=False).ids == ids.tolist() == e.encode([text])[0].tolist()


def test_packing_is_whole_and_tight(stored, rows):
    out = packing.pack_documents(stored, 256).collect()
    e = bpe.Encoder()
    want = Counter()
    for doc, text in rows:
        ids = np.append(np.array(e.whole.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        for n, at in enumerate(range(0, len(ids), 256)):
            piece = ids[at : at + 256]
            want[doc, n, at, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.06 * sum(r["length"] for r in out) / 256 + 1


def test_crowded_lengths_take_several_buckets(spark, monkeypatch):
    """Ranks stay gapless when a length is dealt to buckets: every place is taken once, and as many sequences are used."""
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.choice([3, 3, 3, 7, 11]), i) for i in range(900)]
    pieces = packing.written(spark.createDataFrame(rows, packing.PIECES).repartition(3), "p")
    used = lambda out: len({r["sequence_id"] for r in out})
    want = used(packing.pack(pieces, 16).collect())
    monkeypatch.setattr(packing, "BUCKET_ROWS", 40)
    out = packing.pack(pieces, 16).collect()
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 16
    assert len(out) == 900 and used(out) == want


def test_plan_equals_best_fit_one_by_one():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(1, 30))}
        bins: list[int] = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [b for b in range(len(bins)) if bins[b] >= length]
                if fit:
                    bins[min(fit, key=lambda b: bins[b])] -= length
                else:
                    bins.append(64 - length)
        table = packing.plan(counts, 64)
        used = defaultdict(int)
        for length in counts:
            part = table[table[:, 0] == length]
            for r in range(counts[length]):
                k = np.searchsorted(part[:, 1], r, "right") - 1
                used[part[k, 2] + (r - part[k, 1]) // part[k, 4]] += length
        assert sorted(64 - v for v in used.values()) == sorted(bins)


def test_packing_of_an_empty_table_and_sequences(stored):
    assert packing.pack_documents(stored.limit(0)).count() == 0
    pieces = packing.token_pieces(stored, 64, with_ids=True)
    whole = packing.sequences(packing.pack(packing.written(pieces, "p"), 64))
    assert whole.where(F.size("ids") > 64).isEmpty()


@pytest.mark.parametrize("law", sharding.LAWS)
def test_sharding_laws(stored, rows, law):
    out = sharding.shard(stored, 8, law, bucket_bytes=2000).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    slots, sizes, keys = defaultdict(list), Counter(), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        keys[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    if law == "bytes":
        assert max(sizes.values()) <= sum(sizes.values()) / 8 + max(r["size"] for r in out)
    if law == "key":
        assert all(len(v) == 1 and (a == b or b == 8) for v in keys.values() for a, b in v)
    again = sharding.shard(stored, 8, law, bucket_bytes=2000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


@pytest.mark.parametrize("law", sharding.LAWS)
def test_written_shards_hold_the_texts_in_a_random_order(spark, stored, rows, law, tmp_path):
    path = sharding.write_shards(stored, str(tmp_path / law), law=law, shards=3, bucket_bytes=2000)
    found = sharding.read_shards(spark, path, law).collect()
    assert Counter((d, t) for d, t in rows) == Counter((r["doc_id"], r["text"]) for r in found)
    for file in (tmp_path / law).rglob("*.parquet"):  # each file stands in the order of its slots
        slots = pq.read_table(file, columns=["__slot"])["__slot"].to_pylist()
        assert slots == sorted(slots)
    for shard in range(3):
        ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["slot"]) if r["shard"] == shard and r["doc_id"] is not None]
        falls = sum(a > b for a, b in zip(ids, ids[1:]))
        assert len(ids) < 4 or 0.25 * len(ids) < falls < 0.75 * len(ids)  # an order of its own, neither the input's nor its reverse
    other = sharding.read_shards(spark, sharding.write_shards(stored, law=law, shards=3, seed=8, bucket_bytes=2000), law)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in other.collect()} != {(r["doc_id"], r["shard"], r["slot"]) for r in found}


def test_places_in_a_bucket_are_uniform(spark):
    """Fisher-Yates over one bucket: over 200 buckets of 6 rows, each row stands at each place about equally often."""
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"))
    scattered, buckets = sharding.scatter(docs, 3, 60)
    by = defaultdict(dict)
    for r in sharding.shuffled(scattered, buckets, 3).collect():
        by[r["__bucket"]][r["__place"]] = r["doc_id"]
    assert all(sorted(b) == list(range(len(b))) for b in by.values())
    first = Counter(sorted(b.values()).index(b[0]) for b in by.values() if len(b) == 6)
    assert len(by) > 190 and len(first) == 6


def test_empty_shards_and_unknown_laws(stored):
    assert sharding.shard(stored.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(stored, law="none")

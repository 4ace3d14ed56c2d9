import base64
import hashlib
import io
import random
import re
import wave
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import bpe, media, rollup, warc


def test_warc_round_trip(spark):
    pages = [(i, f"http://h{i % 3}.example.com/{i % 7}?a", f"<p>{i % 11}</p>\r\n\r\nx") for i in range(60)]
    pages += [(60, None, None), (61, "http://h0.example.com/ä b", ""), (None, "u", "<p>1</p>\r\n\r\nx"), (62, "http://[bad", "é" * 3000), (5, *pages[5][1:])]
    df = spark.createDataFrame([(*p, 1, "r") for p in pages], "page_id long, url string, html string, offset int, run string").repartition(3)
    for least in (0, 5):
        out = warc.archive_pages(df, least).collect()
        last = {}
        for i, _, h in pages:
            if i is not None:
                last[h or ""] = max(i, last.get(h or "", i))
        want = Counter()
        for i, _, h in pages:
            raw = (h or "").encode()
            to = last.get(h or "") if len(raw) >= least else None
            to = None if to == i else to
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to] += 1
        assert want == Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
        keys = [(r["urlkey"], r["page_id"] is not None) for r in sorted(out, key=lambda r: (r["range_no"], r["place"]))]
        assert [k for k, _ in keys] == sorted(k for k, _ in keys)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_small_runs_and_ranges_give_the_same_archives(spark, monkeypatch):
    pages = [(i, f"http://h{i % 3}.example.com/{i % 7}?a", f"<p>{i % 11}</p>" * 30) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    order = lambda out: [(r["urlkey"], r["page_id"], r["refers_to"]) for r in sorted(out, key=lambda r: (r["range_no"], r["place"]))]
    want = order(warc.archive_pages(df).collect())
    monkeypatch.setattr(warc, "RUN_BYTES", 5000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 13)
    got = warc.archive_pages(df).collect()
    assert order(got) == want == sorted(want, key=lambda w: (w[0], w[1])) and len({r["range_no"] for r in got}) > 10


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 9))) for i in range(rng.randint(0, 9))]
        assert list(warc.loser_tree(runs)) == sorted(sum(runs, []))


def test_url_keys():
    assert warc.url_key("http://www.A.example.com:8080/x?y=1#z") == "com,example,a:8080)/x?y=1"
    assert warc.url_key(None) == "" and warc.url_key("http://a.b") == "b,a)/"


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(0, 0.13, 64) for _ in range(30)]
    audio = [media.render(v) for v in vectors]
    audio[7] = audio[0]  # a copy of a query
    audio[8] = media.render(np.concatenate([rng.normal(0, 0.13, 5), vectors[10][4:60]]))  # most of another, later
    rows = [(i, media.fingerprint(media.pcm(a)).astype("<u4").tobytes()) for i, a in enumerate(audio)] + [(30, b""), (31, None), (None, b""), (8, media.fingerprint(media.pcm(audio[8])).astype("<u4").tobytes())]
    return rows, spark.createDataFrame(rows, "rec_id long, fingerprint binary")


def test_search_equals_brute_force(recordings, monkeypatch):
    rows, df = recordings
    queries = [(i, np.frombuffer(f, "<u4")) for i, f in rows if i is not None and i % 10 == 0 and f]
    want = Counter()
    for i, f in rows:
        mine = np.frombuffer(f or b"", "<u4")
        hits = []
        for q, its in queries:
            if q == i:
                continue
            found = media.align(its, mine)
            if found and found[0] <= media.ERROR:
                hits.append((found[0], q, found[1]))
        best = min(hits, default=(None, None, None))
        want[i, len(mine), len(hits), best[1], best[2], best[0]] += 1
    got = Counter((r["rec_id"], r["frames"], r["queries"], r["best_query"], r["offset"], r["bit_error"]) for r in media.match(df, every=10).collect())
    assert got == want
    monkeypatch.setattr(media, "QUERY_BYTES", 600)  # many blocks give the same rows
    assert Counter((r["rec_id"], r["frames"], r["queries"], r["best_query"], r["offset"], r["bit_error"]) for r in media.match(df, every=10).collect()) == want
    found = {k[0]: k for k in want}
    assert found[7][2:4] == (1, 0) and found[8][3] == 10 and found[8][4] != 0
    assert media.match(df.limit(0)).count() == 0


def test_integral_image_and_audio_edges():
    x = media.pcm(media.render(np.linspace(-0.2, 0.2, 64)))
    assert len(x) == 64 * 256 and len(media.fingerprint(x)) > 50
    assert len(media.pcm(b"RIFFnothing")) == 0 and len(media.fingerprint(np.zeros(100))) == 0 and len(media.pcm(media.render(None))) == 0
    quieter = media.fingerprint(x * 0.5)
    assert np.bitwise_count(quieter ^ media.fingerprint(x)).sum() == 0


def test_rollup(spark, stored, rows):
    out = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollup.replay(stored).collect()}
    e = bpe.Encoder()
    want = {}
    for i, t in rows:
        folded = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), t or "")
        for version, n in ((rollup.BPE, len(e.whole.encode(t or "", add_special_tokens=False).ids)), (rollup.ALNUM, len(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", folded)))):
            key = (f"s{(i or 0) % 3}", "en", version)
            have = want.get(key, (0, 0))
            want[key] = (have[0] + 1, have[1] + n)
    assert out == want  # no row is left of the first word count


def test_commits_are_idempotent(spark):
    changes = spark.createDataFrame([("a", None, "v", 1, 10), ("a", None, "v", 1, 5), ("b", "en", "v", 1, 3), ("b", "en", "v", 1, None)], "source string, lang string, version string, sign int, tokens long")
    r = rollup.Rollup(spark)
    total = lambda: {tuple(x) for x in r.totals().collect()}
    assert r.totals().count() == 0
    assert r.commit("one/../1", changes) and not r.commit("one/../1", changes)
    assert total() == {("a", None, "v", 2, 15), ("b", "en", "v", 2, 3)}
    assert r.compact() and total() == {("a", None, "v", 2, 15), ("b", "en", "v", 2, 3)}
    assert not r.commit("one/../1", changes)
    assert r.commit("two", changes.where("tokens = 5").withColumn("sign", F.lit(-1)))
    assert r.commit("three", changes.where("source = 'b'").withColumn("sign", F.lit(-1)))
    assert total() == {("a", None, "v", 1, 10)}
    assert r.compact() and r.commit("four", changes.limit(0)) and total() == {("a", None, "v", 1, 10)}


def test_one_of_two_committers_gets_through(spark, monkeypatch):
    """Both see no batch of the name, both write; the second finds the name taken and changes nothing."""
    changes = spark.createDataFrame([("a", "en", "v", 1, 10)], "source string, lang string, version string, sign int, tokens long")
    r = rollup.Rollup(spark)
    monkeypatch.setattr(rollup.Rollup, "committed", lambda self, batch: False)
    assert r.commit("one", changes) and not r.commit("one", changes)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v", 1, 10)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_pcm_of_every_width(width):
    want = np.sin(np.arange(8000) / 9) * 0.8
    whole = np.rint((want if width > 1 else want + 1) * 2.0 ** (8 * width - 1)).astype("<i8")
    data = io.BytesIO()
    with wave.open(data, "wb") as w:
        w.setparams((1, width, media.RATE, 0, "NONE", ""))
        w.writeframes(whole.view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
    got = media.pcm(data.getvalue())
    assert len(got) == len(want) and np.abs(got - want).max() < 2.0 ** (1 - 8 * width)

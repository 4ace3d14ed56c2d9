import random

import corpus_pipeline
from pointloom.llm import packing
from tests.llm.conftest import prose


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(300):
        bad, low = i % 6 == 0, i % 5 == 1
        words = prose(rng, rng.randint(40, 90)).split() + [f"w{rng.randint(0, 9999)}" for _ in range(40)]
        if bad:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), f"{rng.choice('bcdfg')}vile{rng.choice('klmn')}")
        docs.append((i, " ".join(w + "!!" if low else w for w in words)))
        labels.append((i, int(not low), int(bad)))
    item = " ".join(f"bench{k}" for k in range(20)) + ". The answer is seven."
    docs += [(300, docs[2][1]), (301, " ".join(f"u{k}" for k in range(90)) + " " + item), (302, docs[2][1] + " one more")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline._table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, rows, str(tmp_path)), name)
        assert out.columns == rows.columns and out.count() < rows.count(), name
        rows = out
    ids = {r["doc_id"] for r in rows.collect()}
    clean = {i for i in range(300) if i % 6 and i % 5 != 1}
    assert len(clean - ids) <= 0.06 * len(clean) and not ids & {300, 301, 302}
    assert len([i for i in ids if not i % 6]) <= 3 and len([i for i in ids if i % 5 == 1]) <= 3
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == ids == {r["doc_id"] for r in packing.pack_documents(rows).collect()}

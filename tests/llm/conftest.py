import random

import pytest

WORDS = [a + b for a in ("the", "or", "lan", "mi", "ka", "st", "ver") for b in ("ta", "ne", "rio", "sk", "um", "al")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, n string, root int, score double, label int"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows, and columns of clashing names."""
    rng = random.Random(4)
    out = [(i, prose(rng, rng.randint(1, 120))) for i in range(60)]
    base = prose(rng, 80).split()
    for i in range(60, 80):  # near copies of one text
        words = list(base)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = f"x{rng.random()}"
        out.append((i, " ".join(words)))
    out += [(80, out[3][1]), (81, out[3][1]), (82, ""), (83, None), (84, " \n"), (85, "long " * 6000 + "Word's <|endoftext|> é 日本"), (86, out[5][1].upper()), (86, out[5][1].upper()), (None, "no id at all here today"), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "c", "n", 1, 0.5, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def stored(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)

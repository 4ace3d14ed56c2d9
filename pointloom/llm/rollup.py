"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is a table of signed rows: +1 for an insert, -1 for a delete, and -1
of the old with +1 of the new for a revised count. ``commit`` adds its rows up by key,
writes the sums aside, and renames them to the batch's name, which only the first of several
committers of one name can do: a batch counts once or not at all. Totals are the
sums over all committed batches, so they never read documents; ``compact`` puts the sums of
all batches so far in one table, after which totals read that and the batches since.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, words
from pointloom.llm.common import bound_batches, new_folder, written

KEYS = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, documents long, tokens long"
WORDS, ALNUM, BPE = "words-1", "words-2", "word_bpe_49k"


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each row's token counts by tokenizer version: words between white space, runs of letters and digits, BPE ids.

    Null text has none; null ids, sources and languages stay null; repeated rows count each.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder(vocabulary)
        for frame in frames:
            for k in range(0, len(frame), 500):
                part = frame.iloc[k : k + 500]
                texts = part["text"].tolist()
                out = part[["doc_id", "source", "lang"]].astype({"doc_id": "Int64"})
                yield out.assign(**{"w1": words.plain_words(texts)[1], "w2": words.alnum_words(texts)[1], "b": encoder.flat(texts)[1].astype(np.int64)})
        bpe.release()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    counts = rows.mapInPandas(count, "doc_id long, source string, lang string, w1 long, w2 long, b long")
    return counts.select("doc_id", "source", "lang", F.create_map(F.lit(WORDS), "w1", F.lit(ALNUM), "w2", F.lit(BPE), "b").alias("counts"))


def deltas(counts: DataFrame, version: str, sign: int) -> DataFrame:
    """Signed rows (source, lang, version, sign, tokens) of the counts of one version."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).alias("sign"), F.col("counts")[version].alias("tokens"))


class Rollup:
    """Additive totals in a folder; every batch is one committed table of sums there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_folder(spark, "rollup")
        self.jvm = spark._jvm

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, kind: str) -> list[str]:
        """Committed batches or compactions: their folders' names."""
        root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        return sorted(n for n in found if n.startswith(kind + "="))

    def _publish(self, aside: str, name: str) -> bool:
        """Renames a written folder; False, and the folder is gone, if the name is taken. The file system lets one of several through."""
        conf, target = self.spark._jsc.hadoopConfiguration(), self._path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), target, options)
            return True
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            context.delete(self._path(aside), True)
            return False

    def committed(self, batch: str) -> bool:
        return "batch=" + quote(batch, safe="") in self._names("batch")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed rows; False, and no change, if a batch of this name (any text) was committed.

        Rows add up on the map side first, so a source with a third of all rows is no
        hot task. A commit that broke off left an unused folder and can be made again.
        """
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        aside = f"aside-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{aside}")
        return self._publish(aside, "batch=" + quote(batch, safe=""))

    def compact(self) -> bool:
        """Puts the sums of all committed batches in one table; False if another compaction was faster. Batches keep their marks."""
        before, names = self._names("compact"), self._names("batch")
        aside = f"aside-{uuid.uuid4().hex}"
        self._sums(before, names).write.parquet(f"{self.folder}/{aside}/sums")
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{self.folder}/{aside}/names")
        return self._publish(aside, f"compact={len(before):09d}")

    def _sums(self, compactions: list[str], names: list[str]) -> DataFrame:
        paths = []
        if compactions:
            held = {r[0] for r in self.spark.read.schema("name string").parquet(f"{self.folder}/{compactions[-1]}/names").collect()}  # names of batches
            paths, names = [f"{self.folder}/{compactions[-1]}/sums"], [n for n in names if n not in held]
        paths += [f"{self.folder}/{n}" for n in names]
        rows = [self.spark.read.schema(TOTALS).parquet(p) for p in paths]
        every = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], TOTALS)
        sums = every.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """documents and tokens by source, lang and version, of all committed batches; keys without documents are gone."""
        return self._sums(self._names("compact"), self._names("batch"))


def replay(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The totals after a history of batches over all documents.

    Loads all documents, commits the load twice (once counts), revises every word count,
    deletes the documents whose id is odd, puts the sums so far in one table, and inserts them again.
    """
    counts = written(token_counts(docs, vocabulary), "token_counts")
    rollup = Rollup(docs.sparkSession)
    load = deltas(counts, WORDS, 1).unionByName(deltas(counts, BPE, 1))
    rollup.commit("load", load)
    rollup.commit("load", load)
    rollup.commit("revise", deltas(counts, WORDS, -1).unionByName(deltas(counts, ALNUM, 1)))
    odd = counts.where("doc_id % 2 <> 0")
    rollup.commit("delete", deltas(odd, ALNUM, -1).unionByName(deltas(odd, BPE, -1)))
    rollup.compact()
    rollup.commit("insert", deltas(odd, ALNUM, 1).unionByName(deltas(odd, BPE, 1)))
    return rollup.totals()

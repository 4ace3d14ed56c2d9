"""Two-pass external shuffle of whole records into shards, in DataFrame functions alone.

Pass one scatters the records by a seeded hash into buckets of about ``bucket_bytes``: one
shuffle, which is the only time a text travels. Pass two takes each bucket into memory as
an array in a fixed order, applies Spark's Fisher-Yates ``shuffle`` to it, and writes it
out by shard. Buckets follow each other, so every record has a place in one global random
order; shards and slots follow from that order by one of three laws. Sizes of
buckets are counted beforehand, from ids and lengths alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import new_folder, text_or_empty

BUCKET_BYTES = 16 << 20
LAWS = ("bytes", "rows", "key")


def key_shard(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the key and the number of shards decide; a further shard takes rows only into itself."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("draw"), s.alias("shard")))
    return F.array_max(draws)["shard"].cast("int")


def scatter(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The records (doc_id, text) with __size and __bucket, and the number of buckets.

    A record's place in its bucket's fixed order (__at) and its bucket are drawn from its
    id and its place in the input, so rows that repeat exactly still spread.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("__nth"))
    rows = rows.withColumn("__size", (F.octet_length(text_or_empty()) + 1).cast("long"))
    buckets = max(1, -(-(rows.agg(F.sum("__size")).first()[0] or 0) // bucket_bytes))
    draw = F.xxhash64(F.lit(seed), "doc_id", "__nth")
    return rows.withColumn("__bucket", F.pmod(draw, F.lit(buckets)).cast("int")).withColumn("__at", F.xxhash64(F.lit(seed + 1), "doc_id", "__nth")), buckets


def shuffled(scattered: DataFrame, buckets: int, seed: int, bases: DataFrame | None = None) -> DataFrame:
    """Pass two: doc_id, text, __size, __bucket and __place, the place in the bucket after a Fisher-Yates shuffle.

    ``shuffle`` draws from its seed and the task's number; every bucket is a task of its own
    and its rows stand in a fixed order before, so a task that is run again gives the same.
    ``bases`` (__bucket, __base: one struct a bucket) travels with the records, without a join.
    """
    row = F.struct("__at", "__nth", "doc_id", "text", "__size")
    if bases is not None:
        scattered = scattered.unionByName(bases, allowMissingColumns=True)
    held = scattered.repartitionById(buckets, "__bucket").groupBy("__bucket")
    rows = F.sort_array(F.collect_list(F.when(F.col("__nth").isNotNull(), row))).alias("__rows")  # null: not collected
    held = held.agg(rows, *([F.first("__base", ignorenulls=True).alias("__base")] if bases is not None else []))
    out = held.select("__bucket", F.posexplode(F.shuffle("__rows", seed)).alias("__place", "__row"), *(["__base"] if bases is not None else []))
    return out.select("__bucket", "__place", "__row.doc_id", "__row.text", "__row.__size", *(["__base"] if bases is not None else []))


def _before(what: str, *by: str) -> Column:
    """The sum of ``what`` over the buckets before."""
    window = Window.partitionBy(*by) if by else Window
    return F.coalesce(F.sum(what).over(window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 8, law: str = "rows", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Writes the records of ``docs`` (doc_id, text; other columns are not read) in shuffled order, a folder per shard, and returns the path.

    Files hold doc_id, text, grown_shard and __slot, in the order of __slot; a bucket writes one
    file a shard. Laws: ``rows`` (counts at most one apart), ``bytes`` (each shard's bytes within one
    record of an equal share), ``key`` (doc_id alone decides; grown_shard is the shard under one
    more). ``read_shards`` gives the records with their slots.
    """
    if law not in LAWS or shards < 1:
        raise ValueError(f"law must be one of {LAWS}, shards at least 1")
    path = path or new_folder(docs.sparkSession, "shards")
    scattered, buckets = scatter(docs, seed, bucket_bytes)
    shard = key_shard(F.col("doc_id"), shards, seed)
    grown = key_shard(F.col("doc_id"), shards + 1, seed) if law == "key" else F.lit(None).cast("int")
    if law == "key":
        sizes = scattered.select("__bucket", shard.alias("shard")).groupBy("__bucket", "shard").agg(F.count("*").alias("__n"))
        sizes = sizes.select("__bucket", F.struct("shard", _before("__n", "shard").alias("base")).alias("entry"))
        bases = sizes.groupBy("__bucket").agg(F.map_from_entries(F.collect_list("entry")).alias("bases"))  # at most a shard's entry each
        rows = shuffled(scattered, buckets, seed, bases.select("__bucket", F.struct("bases").alias("__base")))
        nth = F.row_number().over(Window.partitionBy("__bucket", "shard").orderBy("__place")) - 1
        rows = rows.withColumn("shard", shard).withColumn("__slot", F.element_at("__base.bases", F.col("shard")) + nth)
    else:
        sizes = scattered.groupBy("__bucket").agg(F.count("*").alias("__n"), F.sum("__size").alias("__bytes"))
        bases = F.struct(_before("__n").alias("rows"), _before("__bytes").alias("low"), F.sum("__bytes").over(Window.partitionBy()).alias("all"))
        rows = shuffled(scattered, buckets, seed, sizes.select("__bucket", bases.alias("__base")))
        rows = rows.withColumn("__slot", F.col("__base.rows") + F.col("__place"))
        if law == "rows":
            rows = rows.withColumn("shard", F.pmod("__slot", F.lit(shards)).cast("int")).withColumn("__slot", F.floor(F.col("__slot") / shards))
        else:
            by = Window.partitionBy("__bucket").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
            start = F.col("__base.low") + F.coalesce(F.sum("__size").over(by), F.lit(0))
            share = start.cast("decimal(38,0)") * shards / F.col("__base.all")
            rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.floor(share)).cast("int"))
    out = rows.select("doc_id", "text", grown.alias("grown_shard"), F.col("__slot").cast("long").alias("__slot"), "shard")
    out.sortWithinPartitions("shard", "__slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def read_shards(spark, path: str, law: str) -> DataFrame:
    """The written records: doc_id, text, shard, slot (gapless from 0 in each shard), grown_shard."""
    rows = spark.read.schema("doc_id long, text string, grown_shard int, __slot long, shard int").parquet(path)
    if law != "bytes":
        return rows.withColumnRenamed("__slot", "slot")
    first = rows.groupBy("shard").agg(F.min("__slot").alias("__first"))  # a row per shard
    return rows.join(F.broadcast(first), "shard").select("doc_id", "text", "grown_shard", (F.col("__slot") - F.col("__first")).alias("slot"), "shard")


def shard(docs: DataFrame, shards: int = 8, law: str = "rows", seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Writes the shards, reads them back, and gives each record's digest: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots of a shard are gapless from 0, in the shuffled order. A null text is empty (size
    1); a null doc_id is one key; repeated rows are kept apart under ``rows`` and ``bytes``.
    Records with equal texts have equal text_crc32 and go where the law puts each.
    Empty tables give empty results.
    """
    path = write_shards(docs, path, shards, law, seed, bucket_bytes)
    rows = read_shards(docs.sparkSession, path, law)
    size = (F.octet_length(text_or_empty()) + 1).cast("long")
    crc = F.crc32(text_or_empty().cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(law).alias("law"), "shard", "slot", "grown_shard")

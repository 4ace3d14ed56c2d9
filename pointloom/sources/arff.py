"""ARFF point tables: reading by lines with their order kept, and writing.

Lines are read whole through Spark (any store it reads, gzip too). Blank lines and
lines from % on are skipped, before and after @data; values part at commas, tabs or
spaces; the last is the class label.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.points import with_slot


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, nth): every file is one row first, so order is certain; ARFF files are small."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("all"))
    return files.select("path", F.posexplode("all").alias("nth", "line")).select("path", "nth", F.trim("line").alias("line"))


def attributes(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, type) of the header's attributes; types as written, nominal ones in braces."""
    rows = lines(spark, path).where(F.lower("line").startswith("@attribute")).orderBy("nth").collect()
    found = [re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+?)(?=[\s{])\s*(.+)", r["line"], re.I) for r in rows]
    return [(m[1].strip("'\""), m[2].strip()) for m in found if m]


def _rows(spark: SparkSession, path: str, sep: str = r"[,\s]+") -> DataFrame:
    """(path, nth, line, __v): the data lines and their values as text."""
    rows = lines(spark, path)
    start = rows.where(F.lower("line").startswith("@data")).groupBy("path").agg(F.min("nth").alias("__data"))
    rows = rows.join(F.broadcast(start), "path").where("nth > __data")  # a row per file
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith("%"))
    parts = F.filter(F.split(F.regexp_replace("line", r"[,\s]+$", ""), sep), lambda x: x != "")
    return rows.withColumn("__v", parts).where(F.size("__v") >= 2)


def read(spark: SparkSession, path: str, sep: str = r"[,\s]+", label: str | None = "last", label_type: str = "int", strict: bool = True) -> DataFrame:
    """id (row in the file, 0-based), coords and true_label.

    ``label`` None: all values are coordinates. ``label_type``: int (a number, truncated),
    string, or mixed (true_label int where it is one, and label_text). Rows of one value
    are skipped; a value that is no number is an error if ``strict``, else its row goes.
    """
    rows = _rows(spark, path, sep)
    texts = F.slice("__v", 1, F.size("__v") - (1 if label else 0))
    numbers = F.transform(texts, lambda x: F.trim(x).try_cast("double"))
    rows = rows.withColumn("coords", numbers)
    broken = F.exists("coords", lambda x: x.isNull())
    if strict:
        rows = rows.withColumn("coords", F.when(~broken, F.col("coords")).otherwise(F.raise_error(F.concat(F.lit("not numbers: "), F.col("line"))).cast("array<double>")))
    else:
        rows = rows.where(~broken)
    rows = with_slot(rows.select("path", "nth", "coords", "__v"), "path", "nth", name="id")
    if not label:
        return rows.select("id", "coords")
    last = F.trim(F.element_at("__v", -1))
    number = last.try_cast("double").cast("int")
    if label_type == "string":
        return rows.select("id", "coords", last.alias("true_label"))
    if label_type == "mixed":
        return rows.select("id", "coords", number.alias("true_label"), F.when(number.isNull(), last).alias("label_text"))
    return rows.select("id", "coords", number.alias("true_label"))


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """id and a column for each attribute of the header, by name: nominal ones and strings as text, others as doubles (null where a value is no number)."""
    rows = with_slot(_rows(spark, path).select("path", "nth", "__v"), "path", "nth", name="id")
    out = []
    for k, (name, kind) in enumerate(attributes(spark, path)):
        value = F.trim(F.try_element_at("__v", F.lit(k + 1)))
        out.append((value if "{" in kind or kind.lower() == "string" else value.try_cast("double")).alias(name))
    return rows.select("id", *out)


def join_columns(values: DataFrame, labels: DataFrame) -> DataFrame:
    """coords and labels of two tables put together by position (nth)."""
    return values.join(labels, "nth")


def write(points: DataFrame, path: str, relation: str = "points", digits: int = 6) -> None:
    """One ARFF file's lines, header first, rows in id order (a text folder of one part); an empty table gives the header alone."""
    spark = points.sparkSession
    d = points.agg(F.coalesce(F.max(F.size("coords")), F.lit(0))).first()[0]
    labels = [str(r[0]) for r in points.select("true_label").distinct().orderBy("true_label").collect()]
    head = [f"@relation {relation}", "", *[f"@attribute x{k + 1} REAL" for k in range(d)], f"@attribute class {{{','.join(labels)}}}", "", "@data"]
    first = spark.createDataFrame([(-1, i, h) for i, h in enumerate(head)], "a long, b long, value string")
    spelt = F.array_join(F.transform("coords", lambda c: F.format_string(f"%.{digits}f", c)), ",")
    body = points.select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), F.concat_ws(",", spelt, F.col("true_label").cast("string")).alias("value"))
    first.unionByName(body).coalesce(1).sortWithinPartitions("a", "b").select("value").write.mode("overwrite").text(path)

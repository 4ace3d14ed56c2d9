"""CSV, timing and polynomial files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLYNOMIALS = "components array<struct<index: int, degree: int, coeffs: array<double>, domain_a: double, domain_b: double, error: double, margin: double, t_i: double, basis: string>>"


def write_vector(df: DataFrame, path: str, value: str, header: str, order: str = "slot", digits: int = 6) -> None:
    """Point_ID and a value to six places, under a heading."""
    rows = df.select(F.col(order).alias("Point_ID"), F.format_string(f"%.{digits}f", F.col(value).cast("double")).alias(header))
    rows.orderBy("Point_ID").write.mode("overwrite").csv(path, header=True)


def write_order(slotted: DataFrame, path: str) -> None:
    """Heap_Position, Original_Index, Inv_Perm: positions with the rows that stand there, and each row's position."""
    inverse = slotted.select(F.col("id").alias("Heap_Position"), F.col("slot").alias("Inv_Perm"))
    rows = slotted.select(F.col("slot").alias("Heap_Position"), F.col("id").alias("Original_Index")).join(inverse, "Heap_Position", "left")
    rows.orderBy("Heap_Position").write.mode("overwrite").csv(path, header=True)


def differences(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Two results side by side by id, with the absolute difference of each column."""
    left = a.select("id", *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select("id", *[F.col(c).alias(f"b_{c}") for c in columns])
    gap = {f"diff_{c}": F.abs(F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double")) for c in columns}
    return left.join(right, "id", "full").withColumns(gap)


def result_rows(points: DataFrame, d: int, labels: dict[str, str], digits: int = 6, withheld: str | None = None) -> DataFrame:
    """x1..xd as text (NA where the column ``withheld`` holds), then columns under new headings."""
    hide = F.col(withheld) if withheld else F.lit(False)
    spelt = [F.when(hide, "NA").otherwise(F.format_string(f"%.{digits}f", F.col("coords")[k])).alias(f"x{k + 1}") for k in range(d)]
    return points.select(*spelt, *[F.col(c).alias(h) for c, h in labels.items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV file with a header; ``candidates`` names the first of several headings that is there."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    for name, options in (candidates or {}).items():
        there = [c for c in options if c in df.columns]
        if there:
            df = df.withColumn(name, F.col(there[0]))
    return df


def write_timings(spark: SparkSession, seconds: dict[str, float], path: str) -> None:
    """One text line a stage: name and seconds to six places."""
    rows = [(i, f"{k}: {v:.6f}") for i, (k, v) in enumerate(seconds.items())]
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_polynomials(spark: SparkSession, path: str) -> DataFrame:
    """A row per component of a polynomial file."""
    return spark.read.schema(POLYNOMIALS).json(path, multiLine=True).select(F.explode("components").alias("c")).select("c.*")


def read_columns_with_labels(spark: SparkSession, values: str, labels: str) -> DataFrame:
    """A numeric text file and a label file put together line by line: id, coords, true_label."""
    from pointloom.sources.arff import lines

    v = lines(spark, values).where("line <> ''").select("nth", F.transform(F.split("line", r"[,\s]+"), lambda x: x.cast("double")).alias("coords"))
    n = lines(spark, labels).where("line <> ''").select("nth", F.col("line").cast("double").cast("int").alias("true_label"))
    return v.join(n, "nth").select(F.col("nth").cast("long").alias("id"), "coords", "true_label")

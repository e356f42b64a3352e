"""Tables that cut a plan, and ranks over a whole table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset in a session of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return root or f"file://{tempfile.gettempdir()}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df by way of Parquet in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the order of all rows.

    Rows are dealt by ranges of the order and written; ranks are counted within each range
    and the counts of the ranges before added, one number for each range. No task sorts
    more than a range.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").count().orderBy("_range").collect()
    before, total = [], 0
    for row in counts:
        before.append((row["_range"], total))
        total += row["count"]
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place - 1).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def quantiles(rows: DataFrame, column: str, ranks: Sequence[float], *keys: str, weight: str | None = None) -> DataFrame:
    """keys and q, the quantiles of column by linear interpolation between order statistics; nulls don't count.

    Equal values are counted first (as weight whole rows, if given). Distinct ones are
    dealt by ranges, counts of the ranges before added, and the values at the asked places
    taken, so no task holds a group.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_x")).agg(n.cast("long").alias("_n")).where("_n > 0")
    counts = kept(counts.repartitionByRange(*keys, "_x").withColumn("_range", F.spark_partition_id()), "value-counts")
    group = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.withColumns({"_total": F.sum("_sum").over(group), "_before": F.sum("_sum").over(group.orderBy("_range")) - F.col("_sum")}).drop("_sum")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*keys, "_range")]
    joined = counts.alias("c").join(sums.alias("s"), on).select("c.*", "_total", "_before")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_x")) + F.col("_before")
    placed = joined.withColumn("_upto", upto)

    def at(place):
        return F.max(F.when((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col("_x")))

    places = [F.lit(float(r)) * (F.col("_total") - 1) for r in ranks]
    ends = [e for i, place in enumerate(places) for e in (at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"))]
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    q = F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place - F.floor(place)) for i, place in enumerate(places)])
    return found.where("_total is not null").select(*keys, q.alias("q"))


def _exact(kind: T.DataType) -> bool:
    """Whether values of a type have one text in every engine."""
    if isinstance(kind, T.ArrayType):
        return _exact(kind.elementType)
    return isinstance(kind, (T.IntegralType, T.StringType, T.BooleanType))


def recorded(rows: DataFrame, *columns: str, record: str = "record", digest: str = "sha256") -> DataFrame:
    """rows with columns as canonical JSON, and its SHA-256 in lower-case hex.

    Keys are in order of their code points, nothing stands between the parts, nulls stay,
    and characters outside ASCII are as they are. Whole numbers, texts, truth values and
    lists of them have one text; other types, such as doubles, are an error, so round
    or cast them first. Without columns all are taken. Columns of the two names are replaced.
    """
    columns = columns or tuple(c for c in rows.columns if c not in (record, digest))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    if bad := [c for c in columns if not _exact(kinds[c])]:
        raise TypeError(f"columns {bad} have no single text")
    text = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return rows.withColumn(record, text).withColumn(digest, F.sha2(F.col(record), 256))

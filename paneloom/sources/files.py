"""Readers of measurement files, weather files, rules and manifests.

Archives that Spark cannot split are read one file to a row and cut into rows in the task
that holds the file; everything else is a plain scan.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of headerless daily weather rows.
GHCN = "station string, date string, element string, value int, m_flag string, q_flag string, s_flag string, obs_time string"
#: First place (from 1) and length of the station list's fields.
STATION_FIELDS = {"station": (1, 11), "latitude": (13, 8), "longitude": (22, 9), "elevation": (32, 6)}


def zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], *, encoding: str = "utf-8-sig") -> DataFrame:
    """Rows of the one CSV member of each ZIP archive, all columns as text.

    An archive without exactly one CSV, or without a required column, is an error. A row
    with too many or too few fields has is_ragged set, so that it can be counted.
    """
    columns = list(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"{path_}: {len(members)} CSV members")
                    with archive.open(members[0]) as raw:
                        lines = csv.reader(io.TextIOWrapper(raw, encoding, newline=""))
                        header = next(lines, [])
                        if missing := set(columns) - set(header):
                            raise ValueError(f"{path_}: no column {sorted(missing)}")
                        at = [header.index(c) for c in columns]
                        some: list[list] = []
                        for line in lines:
                            ragged = len(line) != len(header)
                            some.append([*(None if ragged else line[i] for i in at), ragged, path_])
                            if len(some) == 20_000:
                                yield _batch(some, columns)
                                some = []
                        yield _batch(some, columns)

    names = ", ".join(f"`{c}` string" for c in columns)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, f"{names}, is_ragged boolean, file string")


def _batch(rows: list[list], columns: list[str]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * len(columns), pa.bool_(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*columns, "is_ragged", "file"])


def daily_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather rows (.csv or .csv.gz) with parsed dates; a bad date is null."""
    return spark.read.schema(GHCN).csv(path).withColumn("date_local", F.to_date(F.try_to_timestamp("date", F.lit("yyyyMMdd"))))


def weather_reason(country: str = "US"):
    """Why a daily maximum is not accepted, null if it is: quality, source, missing, other."""
    blank = F.trim(F.coalesce("q_flag", F.lit(""))) == ""
    sourced = F.trim(F.coalesce("s_flag", F.lit(""))) != ""
    other = ~F.startswith("station", F.lit(country)) | (F.col("element") != "TMAX") | F.col("date_local").isNull()
    return F.when(other, "other").when(~blank, "quality").when(~sourced, "source").when(F.col("value").isNull() | (F.col("value") == -9999), "missing")


def stations(spark: SparkSession, path: str, country: str = "US") -> DataFrame:
    """Fixed-width station list; an elevation of -999.9 is null."""
    text = spark.read.text(path)
    cut = {name: F.trim(F.substring("value", at, n)) for name, (at, n) in STATION_FIELDS.items()}
    out = text.select(*[(c if n == "station" else c.cast("double")).alias(n) for n, c in cut.items()])
    return out.where(F.startswith("station", F.lit(country))).withColumn("elevation", F.when(F.col("elevation") > -999.9, F.col("elevation")))


def last_by_file_order(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A code table in one CSV file; of rows with equal keys the last one."""
    rows = spark.read.csv(path, header=True).withColumn("_at", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c not in (*keys, "_at")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_at")).alias("r"))
    return best.select(*keys, *[F.col("r").getField(c).alias(c) for c in others])


def require_columns(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """df, if it has the columns and none of the forbidden ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if found := [c for c in forbidden if c in df.columns]:
        raise ValueError(f"columns that must not be read: {found}")
    return df


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def attempts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON checkpoints of attempts, one file each; an attempt or a success that is there twice is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    twice = rows.groupBy("attempt").count().where("count > 1").select(F.lit("attempt").alias("what"))
    again = rows.where("success").groupBy("replicate").count().where("count > 1").select(F.lit("successful replicate").alias("what"))
    if bad := twice.unionByName(again).limit(1).collect():
        raise ValueError(f"{bad[0]['what']} more than once in {path}")
    return rows


def file_summary(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def request_plan(spark: SparkSession, years: Sequence[int], states: Sequence[str], url: str) -> DataFrame:
    """One request for each year and state, with {year} and {state} in url filled in."""
    rows = [(y, s, url.format(year=y, state=s)) for y in years for s in states]
    return spark.createDataFrame(rows, "year int, state string, url string")


def bulk_plan(spark: SparkSession, years: Sequence[int], kinds: dict[str, str], once: Sequence[str] = ()) -> DataFrame:
    """(kind, year, file) of the archives to fetch: each kind's name with {year} filled in, and files that belong to no year."""
    rows = [(k, y, name.format(year=y)) for k, name in kinds.items() for y in years] + [("table", None, name) for name in once]
    return spark.createDataFrame(rows, "kind string, year int, file string")

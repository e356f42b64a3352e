"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder used where spark.checkpoint.dir is unset, as in local tests.
_local_dir: str | None = None

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a local one.

    A local folder serves a local session only; a cluster without the setting is an error.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="spark-shared-")
    return f"file://{_local_dir}"


#: Rows and bytes in an Arrow batch. Texts are long, and a task holds a batch on either side of its pipe.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows and, but for a longer row, BATCH_BYTES bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    The lineage ends at the files, so later stages survive a lost executor without
    computing df anew, and several readers share one computation.
    """
    short_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waiting(docs: DataFrame, *reads: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that an operator doesn't read under names that nothing uses, and what names them back.

    So no name of a caller's column meets one that the operator works with. A column that
    the operator adds takes the place of a caller's of that name.
    """
    mark = f"_{uuid.uuid4().hex}_"
    back = {f"{mark}{i}": c for i, c in enumerate(docs.columns) if c.lower() not in reads}
    away = {c: n for n, c in back.items()}

    def named(found: DataFrame) -> DataFrame:
        added = {c.lower() for c in found.columns if c not in back}
        return found.select(*[F.col(c).alias(back.get(c, c)) for c in found.columns if c not in back or back[c].lower() not in added])

    return docs.toDF(*[away.get(c, c) for c in docs.columns]), named


def fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id's text, modulo the number of folds; -1, no fold, for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds), F.lit(-1))


def least_hashed(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most most rows, those of the least hash of keys.

    A bound on the hash leaves little more than most rows before any are ordered, so the
    task that takes the least ones does not get most rows of every partition. A bound that
    leaves too few, as where many rows have one key, is doubled.
    """
    h = F.xxhash64(*keys)
    total = rows.count()
    share = min(1.0, 1.2 * most / max(total, 1))
    while share < 1.0 and rows.where(h <= F.lit(int(share * 2.0**64) - 2**63)).count() < most:
        share = min(1.0, 2 * share)
    some = rows if share >= 1.0 else rows.where(h <= F.lit(int(share * 2.0**64) - 2**63))
    return some.orderBy(h, *keys).limit(most)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into short ones, so that a task holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

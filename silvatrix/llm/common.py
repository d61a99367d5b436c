"""Helpers shared by the training-data operators.

Conventions that every operator here follows:

* it selects the columns it needs by name at once, so extra columns, also ones
  that bear the names of results, never clash with its own;
* a null text counts as the empty text;
* a row is known by ``row_key``: a digest of its id and text. Ids may be null
  or repeated without mixing up two rows that differ.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = "silvatrix"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a session of one process has none, as in tests, a temporary
    folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="silvatrix-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not a
    recomputation of everything before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_FOLDER}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`materialize`, once nothing needs them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if f"/{_FOLDER}/" not in f:
                raise ValueError(f"not a table of this library: {f}")
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_position(docs: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """``docs`` with its columns named by their place, and what ``names`` are called in it.

    Names of an operator's own can't clash with these; ``toDF`` gives the old ones back.
    """
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), *[f"c{docs.columns.index(n)}" for n in names]


#: Rows that are Python objects at a time.
SLICE = 256


def slices(batches, rows: int = SLICE):
    """Arrow batches in parts of so many rows, so that a worker holds few of them as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that identify a row by its id and text."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("~"))
    return F.unhex(F.md5(F.concat(ident, F.lit(":"), text_or_empty(text_col))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

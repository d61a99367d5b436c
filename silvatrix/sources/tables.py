"""Training and scoring tables from text files, and back.

Readers give DataFrames with columns ``f0..``, ``label`` and where there is one
``qid``; missing cells are NaN. What a file is, is decided on the driver from
its first lines; the file itself is read by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stored, write_file
from ..functions.windows import running_sum

#: Names that mark a label column.
LABELS = ("label", "target", "y", "class", "response")
_PAIR = re.compile(r"^\d+:[-+.\deE]+|^\d+:(?i:nan|inf)")


def _number(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def head(spark: SparkSession, path: str, n: int = 12) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]  # n lines


def numbered_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(n, value): lines with their number from 0, in order of file name and place.

    Splits of a file are read by many tasks. A line's number is what lies before
    its split, by file and offset of the block, and its place in the split; with
    ``keep`` only the lines it holds for are there and counted.
    """
    lines = spark.read.text(path)
    at = (lines if keep is None else lines.where(keep)).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    splits = at.groupBy("_f", "_b").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    ahead = splits.select("_f", "_b", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    return at.join(ahead, ["_f", "_b"]).select((F.col("_ahead") + F.col("_id") - F.col("_first")).alias("n"), "value")


def first_lines(spark: SparkSession, path: str, keep: Column, limit: int | None = None, until_blank: bool = False) -> DataFrame:
    """(value): the lines that ``keep`` holds for, the first ``limit`` of them, and none behind the first blank line if so asked."""
    if not until_blank:
        lines = spark.read.text(path).where(keep) if limit is None else numbered_lines(spark, path, keep).where(F.col("n") < limit)
        return lines.select("value")
    lines = numbered_lines(spark, path)
    stop = lines.where("trim(value) = ''").agg(F.min("n")).first()[0]
    lines = (lines if stop is None else lines.where(F.col("n") < stop)).where(keep)
    if limit is not None:
        lines = running_sum(lines.withColumn("_one", F.lit(1)), "n", "_one", "_k").where(F.col("_k") <= limit)
    return lines.select("value")


def is_libsvm(lines: list[str]) -> bool:
    lines = [x for x in lines if x.strip() and not x.startswith("#")][:8]
    hits = sum(bool(w) and _number(w[0]) and len(w) > 1 and all(_PAIR.match(p) for p in w[1:]) for w in (x.split() for x in lines))
    return hits >= 1 and hits * 2 >= len(lines)


def is_ranking(lines: list[str], sep: str = "\t") -> bool:
    rows = [x.split(sep) for x in lines if x.strip() and not x.startswith("#")]
    if len(rows) < 2 or any(len(r) < 3 or len(r) != len(rows[0]) for r in rows):
        return False
    if not all(re.fullmatch(r"-?\d+", r[0].strip()) and all(_number(v) for v in r[1:]) for r in rows):
        return False
    q = [int(r[0]) for r in rows]
    return all(a <= b for a, b in zip(q, q[1:]))


def delimiter(path: str, lines: list[str]) -> str:
    if path.endswith(".tsv"):
        return "\t"
    return "\t" if sum(x.count("\t") for x in lines) > sum(x.count(",") for x in lines) else ","


def sniff(path: str, lines: list[str]) -> dict:
    """{format, sep, header, label}: libsvm, ranking or csv; label is a column number or none."""
    lines = [x for x in lines if x.strip()]
    if not lines:
        raise ValueError(f"{path} is empty")
    if is_libsvm(lines):
        return {"format": "libsvm"}
    sep = delimiter(path, lines)
    if sep == "\t" and is_ranking(lines, sep):
        return {"format": "ranking", "sep": sep}
    rows = [x.split(sep) for x in lines if not x.startswith("#")]
    header = not all(_number(v) or not v.strip() for v in rows[0])
    label = next((i for i, v in enumerate(rows[0]) if v.strip().lower() in LABELS), None) if header else None
    if label is None and len(rows[0]) >= 3 and len(rows) >= 2:
        label = len(rows[0]) - 1
    return {"format": "csv", "sep": sep, "header": header, "label": label}


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = False, label: int | str | None = None, skip: list[str] | None = None, default: float = float("nan"), limit: int | None = None) -> DataFrame:
    """Numeric columns, of the first ``limit`` rows in order if given; an empty cell gets ``default``; a ragged or non-numeric row is an error."""
    first = head(spark, path, 1)[0].split(sep)
    names = [x.strip() for x in first] if header else [f"c{i}" for i in range(len(first))]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    options = {"sep": sep, "mode": "FAILFAST", "comment": "#", "nanValue": "NaN", "emptyValue": "", "nullValue": ""}
    if limit is None:
        df = spark.read.csv(path, header=header, schema=schema, enforceSchema=True, **options)
    else:
        rows = first_lines(spark, path, F.expr("length(trim(value)) > 0 AND NOT startswith(value, '#')"), limit + header)
        if header:
            rows = rows.where(F.col("value") != head(spark, path, 1)[0])
        df = rows.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("r.*")
    target = names[label] if isinstance(label, int) else label
    keep = [n for n in names if n != target and n not in (skip or [])]
    cols = [F.coalesce(F.col(f"`{n}`"), F.lit(default)).alias(n if header else f"f{i}") for i, n in enumerate(keep)]
    return df.select(*cols, *([F.col(f"`{target}`").alias("label")] if target else []))


def read_label_first(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return read_csv(spark, path, sep, False, 0)


def read_label_last(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return read_csv(spark, path, sep, False, len(head(spark, path, 1)[0].split(sep)) - 1)


def read_ranking(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """qid, label, f0..; rows of a qid are one group wherever they stand."""
    n = len(next(x for x in head(spark, path) if x.strip() and not x.startswith("#")).split(sep))
    schema = T.StructType([T.StructField("qid", T.IntegerType()), T.StructField("label", T.DoubleType()), *[T.StructField(f"f{i}", T.DoubleType()) for i in range(n - 2)]])
    return spark.read.csv(path, sep=sep, schema=schema, comment="#", mode="FAILFAST")


def read_libsvm(spark: SparkSession, path: str, base: int | None = None, n_features: int | None = None, absent: float = 0.0, limit: int | None = None, until_blank: bool = False) -> DataFrame:
    """label, f0..; ``base`` none: taken from the first pair of the first row.

    Absent cells are 0 for training, NaN where trees score sparse rows. ``limit``
    takes the first rows in order; ``until_blank`` ends at the first blank line,
    which training skips.
    """
    at = read_sparse(spark, path, base, limit, until_blank).select("label", F.map_from_arrays("indices", "values").alias("m"))
    if n_features is None:
        n_features = (at.select(F.max(F.array_max(F.map_keys("m")))).first()[0] or 0) + 1
    return at.select("label", *[F.coalesce(F.element_at("m", F.lit(i)), F.lit(absent)).alias(f"f{i}") for i in range(n_features)])


def read_sparse(spark: SparkSession, path: str, base: int | None = None, limit: int | None = None, until_blank: bool = False) -> DataFrame:
    """label, indices, values: rows of a LIBSVM file as they stand, for sparse scoring."""
    if base is None:
        pairs = next((x.split()[1:] for x in head(spark, path) if len(x.split()) > 1 and not x.startswith("#")), ["0:0"])
        base = 0 if pairs[0].startswith("0:") else 1
    lines = first_lines(spark, path, F.expr("length(trim(value)) > 0 AND NOT startswith(value, '#')"), limit, until_blank)
    words = F.split(F.trim("value"), r"\s+")
    pairs = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.contains(w, F.lit(":")))
    return lines.select(words[0].cast("double").alias("label"), F.transform(pairs, lambda w: F.split(w, ":")[0].cast("int") - base).alias("indices"), F.transform(pairs, lambda w: F.split(w, ":")[1].cast("double")).alias("values"))


def read_dense_libsvm(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """label, f0..: a file whose rows all have the columns 0 to n-1, in order; another row is an error."""
    rows = read_sparse(spark, path, 0, limit, until_blank=True)
    first = rows.select(F.size("indices")).first()
    n = first[0] if first else 0
    whole = F.col("indices") == F.array(*[F.lit(i) for i in range(n)]) if n else F.size("indices") == 0
    checked = rows.select("label", F.when(whole, F.col("values")).otherwise(F.raise_error(F.lit(f"a row has not the columns 0 to {n - 1}")).cast("array<double>")).alias("v"))
    return checked.select("label", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(n)])


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Read a table of any of the formats; without ``format`` its first lines decide."""
    how = {"format": format} if format else sniff(path, head(spark, path))
    kind = how.pop("format")
    readers = {"libsvm": read_libsvm, "ranking": read_ranking, "csv": read_csv, "label_first": read_label_first, "label_last": read_label_last}
    return readers[kind](spark, path, **(how | options))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    """Doubles in the shortest form that reads back the same."""
    df.write.csv(path, sep=sep, header=header)


def write_ranking(df: DataFrame, path: str, features: list[str], group: str = "qid", label: str = "label") -> None:
    """Rows of a group together and in order: qid, label, features."""
    df.select(group, label, *features).repartitionByRange(group).sortWithinPartitions(group).write.csv(path, sep="\t")


def write_ranking_and_manifest(df: DataFrame, rank_path: str, manifest_path: str, features: list[str], group: str = "qid", label: str = "label") -> int:
    """A ranking file and, row for row, the manifest of its users and items; the number of rows.

    The order, by group and falling recall score, is stored once. Both sinks
    write its partitions, so part k of one has the rows of part k of the other.
    """
    order = [F.col(group).asc(), F.col("recall_score").desc(), F.col("Item").asc()]
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows.select(group, label, *features).write.csv(rank_path, sep="\t")
    rows.select("User", "Item", "Tag", "recall_score").write.json(manifest_path)
    return rows.count()


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON object, in any store."""
    rows = report.toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("a report has one row")
    write_file(path, (rows[0] + "\n").encode(), report.sparkSession)


#: Columns of the recommender's tab-separated tables.
RECSYS = {
    "interactions": "User string, Item string, Score double, Tag string",
    "catalog": "Item string, Tag string, feat_pop double, feat_quality double, feat_age double, feat_bias double",
    "user_qid": "User string, qid int, split string",
    "recall": "User string, Item string, Tag string, recall_score double, feat_pop double, feat_quality double, feat_age double, feat_bias double",
    "deal": "User string, Item string, Tag string, Score double, rank int",
    "manifest": "User string, Item string, Tag string, recall_score double, Score double",
}


def read_recsys(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "manifest":
        return spark.read.json(path, schema=RECSYS[kind])
    return spark.read.csv(path, sep="\t", header=True, schema=RECSYS[kind], mode="FAILFAST")


def write_recsys(df: DataFrame, path: str, kind: str) -> None:
    cols = [c.split()[0] for c in RECSYS[kind].split(", ")]
    out = df.select(*cols)
    if kind == "manifest":
        out.write.json(path)
    else:
        out.write.csv(path, sep="\t", header=True)

"""Readers, checks and writers of the other file kinds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from planloom.operators.ordered import dealt, sort_tasks
from planloom.session import staged


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Line-delimited objects. Without a schema it is inferred, at the price of a further pass."""
    return read_inferred(spark, path) if schema is None else spark.read.schema(schema).json(path)


def _resolved(kind: str) -> tuple[T.DataType, str]:
    """The type that the beginning of a variant's schema names, and the rest.

    Whole numbers stay whole, other numbers are doubles; a field that is of several kinds, or null everywhere, is text.
    """
    name, rest = re.match(r"([A-Z_]+(?:\([0-9, ]+\))?)(.*)", kind, re.S).groups()
    if name == "ARRAY":
        item, rest = _resolved(rest[1:])
        return T.ArrayType(item), rest[1:]
    if name == "OBJECT":
        fields, rest = [], rest[1:]
        while not rest.startswith(">"):
            quoted, plain, rest = re.match(r"(?:`((?:[^`]|``)*)`|([^:`]+)): ?(.*)", rest.lstrip(", "), re.S).groups()
            found, rest = _resolved(rest)
            fields.append(T.StructField(plain if quoted is None else quoted.replace("``", "`"), found))
        return T.StructType(fields), rest[1:]
    number = T.DoubleType() if name.startswith("DECIMAL") or name in ("DOUBLE", "FLOAT") else None
    return number or {"BIGINT": T.LongType(), "BOOLEAN": T.BooleanType()}.get(name, T.StringType()), rest


def inferred_schema(texts: DataFrame, column: str) -> T.StructType:
    """One schema of all JSON objects in a text column, merged by Spark from partial schemas; texts that are no JSON are passed over."""
    kind = texts.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]
    if not (kind or "").startswith("OBJECT"):
        raise ValueError(f"no table of objects, but {kind}")
    return _resolved(kind)[0]


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited objects without a schema: a pass over all lines merges their types, a second one reads them.

    A field that only some lines have is null in the others. A line that is no object is a row of nulls.
    """
    lines = spark.read.text(path)
    schema = inferred_schema(lines, "value")
    return lines.select(F.from_json("value", schema).alias("_row")).select("_row.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_dataset(df: DataFrame, path: str, split: str | None = None) -> None:
    """Columnar write; ``split`` names the column whose values become partition folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, split: str = "split") -> DataFrame:
    """One named split of a dataset, by partition pruning; the whole set if it has no splits."""
    df = spark.read.parquet(path)
    if split not in df.columns:
        return df
    part = df.where(F.col(split) == name)
    if part.isEmpty():
        raise ValueError(f"no split {name!r} in {path}")
    return part.drop(split)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no usable record")
    return df


def read_preferences(df: DataFrame) -> DataFrame:
    return require_columns(df, "prompt", "chosen", "rejected").select("prompt", "chosen", "rejected")


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """List files as one column: each file is stripped as a whole, inner blank lines stay.

    Files are split like any others: one aggregate finds the first and the last line of each that is not blank, then the lines in between
    are kept and these two stripped. A file of blank lines is one empty line, one without lines has none.
    """
    lines = with_input_order(spark.read.text(path)).select("_file", "value", F.struct("_block", "_line").alias("_place"))
    said = F.when(F.col("value").rlike(r"\S"), F.col("_place"))
    ends = lines.groupBy("_file").agg(F.min(said).alias("_first"), F.max(said).alias("_last"), F.min("_place").alias("_any"))
    blank = F.col("_first").isNull()
    # a left join streams the lines, so that those of a small list stay in order
    kept = lines.join(ends, "_file", "left").where(F.when(blank, F.col("_place") == F.col("_any")).otherwise(
        F.col("_place").between(F.col("_first"), F.col("_last"))))
    text = F.when(F.col("_place") == F.col("_first"), F.regexp_replace("value", r"^\s+", "")).otherwise(F.col("value"))
    text = F.when(F.col("_place") == F.col("_last"), F.regexp_replace(text, r"\s+$", "")).otherwise(text)
    return kept.select(F.when(blank, "").otherwise(text).alias(name))


#: Rows of a dataset that a task merges; they are sorted by key, as texts have no place in a hash table of aggregates.
MERGED_ROWS = 1_000_000


def upsert(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], version: str, tasks: int | None = None) -> DataFrame:
    """Records with the latest non-null value of each field, over the old and the new rows of a key.

    Fields that only one side has stay, so that one model's results do not remove another's. Per-field
    ``max_by`` aggregates before the shuffle, or with ``tasks`` within as many partitions by key, so that no task sorts more than its share.
    """
    rows = new if existing is None else existing.unionByName(new, allowMissingColumns=True)
    fields = [c for c in rows.columns if c not in (*keys, version)]
    latest = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(version))).alias(c) for c in fields]
    return dealt(rows, keys, tasks).groupBy(*keys).agg(F.max(version).alias(version), *latest)


def upsert_in_place(new: DataFrame, path: str, keys: Sequence[str], version: str, split: str) -> None:
    """``upsert`` into the dataset at ``path``, partitioned by ``split`` (one of ``keys``); other partitions keep their files.

    Only partitions that ``new`` has rows of are read and replaced. Their merged rows are written to the shared folder first, as a
    dataset cannot be read and replaced at once. Without a dataset at ``path`` it is made. Null values of ``split`` are a partition.
    """
    spark = new.sparkSession
    new = staged(new, "new")
    existing: DataFrame | None = None
    sizes = new.select(F.lit(1))
    if _exists(spark, path):
        existing = spark.read.parquet(path)
        sizes = sizes.union(existing.select(F.lit(1)))
        touched = new.select(F.col(split).alias("_touched")).distinct()
        existing = existing.join(touched, existing[split].eqNullSafe(touched["_touched"]), "left_semi")
    tasks = sort_tasks(sizes, MERGED_ROWS)
    merged = staged(upsert(existing, new, keys, version, tasks), "merged")
    places = [F.col(split), F.pmod(F.xxhash64(*keys), F.lit(_spread(spark)))]
    ((merged.repartition(*places) if tasks is None else merged.repartition(tasks, *places)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(path))


def _spread(spark: SparkSession) -> int:
    """Into how many files a large partition is written."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


#: Columns by which rows of ``with_input_order`` are in the order of their files and lines.
INPUT_ORDER = ("_file", "_block", "_line")


def with_input_order(df: DataFrame) -> DataFrame:
    """Rows of a file scan with the order in which its files hold them: by path, place of the block in the file, place in the block.

    It must be asked of the scan itself, before any shuffle.
    """
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})


def first_rows(df: DataFrame, order: Sequence[str | Column], samples: int) -> DataFrame:
    """The first ``samples`` rows in a stated order; 0 or less means all. Filters come after, if any."""
    return df.orderBy(*order).limit(samples) if samples > 0 else df


def profile(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Row count, column names, their types, and the first record as JSON."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order))
    return df.agg(F.count("*").alias("rows"), first.alias("first")).select(
        "rows", F.to_json("first").alias("first_record"), F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(f.dataType.simpleString() for f in df.schema)).alias("types"))

"""Keyed JSON: files that hold one object ``{id: record}``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from planloom.sources.keyed_ranges import RANGE_BYTES, read_entries

RECORD = "map<string,string>"
_FRAMED_ROWS = 256


def _bad(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"keyed JSON: {what}: "), text)).cast(RECORD)


def _entries(chunk: Column, used: Column) -> Column:
    """Entries of an object, none if not ``used`` (a filter of its own might be merged with one on the error); a chunk that is
    no object ends the query, so that no record is lost unseen."""
    found = F.from_json(chunk, RECORD)
    return F.when(used & found.isNull(), _bad("no object, the file is damaged or of another layout", F.substring(chunk, 1, 200))).when(used, found)


#: A text value that may begin with a brace, also an escaped one.
_BRACED_TEXT = r':\s*"[\s\\u02]*(?:\{|7[bB])'


def _is_object(chunk: Column, key: Column, value: Column) -> Column:
    """Whether the value is an object; the rare chunk that holds a text like one is parsed again with kinds."""
    kind = F.schema_of_variant(F.try_element_at(F.from_json(chunk, "map<string,variant>"), key))
    return F.when(chunk.rlike(_BRACED_TEXT), F.startswith(kind, F.lit("OBJECT"))).otherwise(F.startswith(F.trim(value), F.lit("{")))


def _unclosed(parts: DataFrame, opened: Column, closed: Column) -> DataFrame:
    """A row for each file, without entries; it ends the query if not as many objects are closed as opened: a file cut off between records."""
    files = parts.groupBy("file_path").agg(F.sum(opened.cast("int")).alias("opened"), F.sum(closed.cast("int")).alias("closed"))
    return files.select(F.when(F.col("opened") != F.col("closed"), _bad("cut off or of another layout", F.col("file_path"))).alias("entries"), F.lit("").alias("chunk"))


def read_keyed_json(spark: SparkSession, path: str, schema: T.StructType | None = None, keep_id: bool = False,
                    layout: str = "lines", indent: int = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per key whose value is an object; ``id`` is the key. Other values are skipped.

    * ``"lines"`` (the default) reads files of ``write_keyed_json`` (one entry per line) and ``"indented"`` reads
      pretty-printed files (each record closed by a brace at ``indent``). Both split large files over tasks;
      keys must be unique there, while ``whole`` takes the last of repeated keys of a file.
    * ``"any"`` reads any layout by ranges of ``range_bytes``, so it splits large files too (``planloom.sources.keyed_ranges``).
    * ``"whole"`` reads any layout, one file per task, so it is for files of moderate size.

    Damaged files, files cut off and files of another layout raise an error when they are read; blank files have no rows.

    With ``schema`` the record's fields become columns, else one ``record`` map of JSON texts. ``keep_id``
    leaves a record's own ``id`` in place, even a null one, and uses the key only where there is none.
    """
    if layout == "whole":
        chunks = spark.read.text(path, wholetext=True).select(_entries(F.col("value"), F.col("value").rlike(r"\S")).alias("entries"), F.col("value").alias("chunk"))
    elif layout == "any":
        chunks = read_entries(spark, path, range_bytes).select(F.concat(F.lit("{"), F.col("entry"), F.lit("}")).alias("chunk")).select(
            _entries(F.col("chunk"), F.lit(True)).alias("entries"), "chunk")
    elif layout == "lines":
        parts = spark.read.text(path).select("value", "_metadata.file_path")
        line, text = F.regexp_replace(F.col("value"), r",\s*$", ""), F.trim("value")
        chunk = F.concat(F.lit("{"), line, F.lit("}"))
        chunks = parts.select(_entries(chunk, ~text.isin("{", "}", "")).alias("entries"), chunk.alias("chunk"))
        chunks = chunks.unionByName(_unclosed(parts, text == "{", text == "}"))
    elif layout == "indented":
        # a brace at the record's depth can only close a record: line breaks inside texts are escaped
        parts = spark.read.text(path, lineSep="\n" + " " * indent + "}").select("value", "_metadata.file_path")
        body = F.regexp_replace(F.col("value"), r"^[\s{,]+", "")
        chunk = F.concat(F.lit("{"), body, F.lit("}}"))
        chunks = parts.select(_entries(chunk, F.contains("value", F.lit('"'))).alias("entries"), chunk.alias("chunk"))
        # the part that begins the file opens its object, the one that ends it closes it at the margin
        chunks = chunks.unionByName(_unclosed(parts, F.col("value").rlike(r"^\s*\{"), F.col("value").rlike(r"(^|\n)\}\s*$|^\s*\{\s*\}\s*$")))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    rows = chunks.select("chunk", F.explode("entries").alias("_key", "_value")).where(
        _is_object(F.col("chunk"), F.col("_key"), F.col("_value"))).drop("chunk")
    rows = rows.withColumn("record", F.from_json("_value", schema if schema is not None else RECORD))
    if schema is None:
        own = F.when(F.map_contains_key("record", "id"), F.try_element_at("record", F.lit("id"))).otherwise(F.col("_key"))
        return rows.select((own if keep_id else F.col("_key")).alias("id"), "record")
    has_id = F.map_contains_key(F.from_json("_value", RECORD), "id")
    own = F.when(has_id, F.col("record.id")).otherwise(F.col("_key")) if keep_id and "id" in schema.names else F.col("_key")
    fields = [F.col("record").getField(n).alias(n) for n in schema.names if n != "id"]
    return rows.select(own.alias("id"), *fields)


def write_keyed_json(df: DataFrame, path: str, id_col: str, order: str | None = None) -> None:
    """Write ``{id: record}`` objects, one entry per line and one object per partition.

    Rows without an id are left out. Of repeated ids the last in ``order`` is kept. Entries stream through
    each task; nothing is gathered.
    """
    rows = df.where(F.col(id_col).isNotNull())
    if order is not None:
        rows = (rows.groupBy(F.col(id_col).alias("_id")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row"))
                .select("_row.*"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    entry = F.to_json(F.create_map(F.col(id_col).cast("string"), F.struct(*columns)), {"ignoreNullFields": "false"})
    # the entry without the braces of its own one-entry object
    entries = rows.select(F.substring(entry, F.lit(2), F.length(entry) - 2).alias("value"))
    write_entries(entries, path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Write JSON entries ``"key": value`` (one text column) as objects, one for each partition; a partition without entries is an empty object."""
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda values: pa.record_batch([pa.array(values, pa.string())], ["value"])
        yield lines(["{"])
        held: str | None = None
        for batch in batches:
            # a few rows at a time, and never as Python texts: a batch of long texts would stand in memory many times over
            for at in range(0, batch.num_rows, _FRAMED_ROWS):
                values = batch.column(0).slice(at, _FRAMED_ROWS)
                if values.null_count:
                    raise ValueError("keyed JSON: an entry without a text")
                if held is not None:
                    yield lines([held + ","])
                yield pa.record_batch([pc.binary_join_element_wise(values[:-1], ",", "").cast(pa.string())], ["value"])
                held = values[-1].as_py()
        yield lines(["}"] if held is None else [held, "}"])

    entries.toDF("value").mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def json_text(value: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)

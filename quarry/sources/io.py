"""Sources and sinks: text scans, tolerant JSON, partition discovery, idempotent writes."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: names of a text column, in the order they are looked for
TEXT_NAMES = ["text", "content", "raw_content", "document", "body"]


def text_column(df: DataFrame) -> str:
    """The first known text name among the columns, else the first string column."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = next((n for n in TEXT_NAMES if n in df.columns), None) or next(iter(strings), None)
    if found is None:
        raise ValueError(f"no text column among {df.columns}")
    return found


def scan_text(df: DataFrame, key: str, keep_empty: bool = False) -> DataFrame:
    """(doc_idx, text): the key counts all rows, so a dropped empty text leaves a gap."""
    c = F.col(text_column(df))
    d = df.select(F.col(key).alias("doc_idx"), F.coalesce(c, F.lit("")).alias("text"))
    return d if keep_empty else d.where(F.length("text") > 0)


def parse_ranges(spec: str) -> list[int]:
    """'320-322,330' -> [320, 321, 322, 330]: inclusive, sorted, distinct."""
    out: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"bad range {part!r}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def expand_ranges(spec: Column) -> Column:
    """The same as a column expression: the sorted distinct members of a range list."""
    bounds = lambda x: F.transform(F.split(F.trim(x), "-"), lambda y: y.cast("int"))
    each = F.transform(F.filter(F.split(spec, ","), lambda x: F.trim(x) != ""), lambda x: F.sequence(F.element_at(bounds(x), 1), F.element_at(bounds(x), -1)))
    return F.sort_array(F.array_distinct(F.flatten(each)))


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are no rows; lines that don't parse are dropped, or kept in
    `_corrupt_record`."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    d = spark.read.schema(T.StructType([*full.fields, T.StructField("_corrupt_record", T.StringType())])).json(paths, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return d if keep_bad else d.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_roots(spark: SparkSession, roots: list[str], schema: str, key: list[str], exclude: str | None = None) -> DataFrame:
    """JSON lines below several roots, at any depth, without the files whose path below matches `exclude`; of rows with one
    key the one from the first root counts (of these the first file's). Adds `root`."""
    parts = []
    for i, root in enumerate(roots):
        full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
        d = spark.read.schema(full).option("recursiveFileLookup", True).json(root, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
        d = d.withColumn("_path", F.col("_metadata.file_path")).where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        if exclude:
            d = d.where(~F.col("_path").rlike(exclude))
        parts.append(d.withColumns({"root": F.lit(root), "_at": F.lit(i)}))
    union = parts[0]
    for d in parts[1:]:
        union = union.unionByName(d)
    rest = [c for c in union.columns if c not in (*key, "_at", "_path")]
    return union.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("_at", "_path")).alias("_r")).select(*key, "_r.*")


def sections(text: Column) -> Column:
    """array<struct<section, body>>: what follows each line ---NAME--- up to the next one, trimmed."""
    marked = F.regexp_replace(text, r"(?m)^---([A-Z][A-Z0-9_ ]*)---[ \t]*$", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda x: F.contains(x, F.lit("\x02")))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("section"), trim(F.substring_index(x, "\x02", -1)).alias("body")))


def read_objects(spark: SparkSession, path: str, schema: str, nested: str) -> DataFrame:
    """A folder of files with one JSON object each; the fields of `nested` become columns nested_field."""
    d = spark.read.schema(schema).json(path, multiLine=True)
    return d.select(*(c for c in d.columns if c != nested), *(F.col(f"{nested}.{f}").alias(f"{nested}_{f}") for f in d.schema[nested].dataType.names))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def with_path_fields(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds the groups of a pattern of the row's file path as columns."""
    path = F.col("_metadata.file_path")
    return df.select("*", *(F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)))


def json_object(raw: Column, schema: str) -> Column:
    """The object in a text: the whole text, else from the first brace to the last, else the first object of an array."""
    whole = F.from_json(raw, schema)
    inner = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)
    first = F.get(F.from_json(raw, f"array<struct<{schema.replace(' ', ':')}>>" if "<" not in schema else schema), F.lit(0))
    is_array = F.trim(raw).startswith("[")
    empty = lambda x: F.to_json(x) == "{}"
    return F.when(is_array, first).otherwise(F.when(whole.isNull() | empty(whole), inner).otherwise(whole))


def key_values(raw: Column) -> Column:
    """'a=1;b=x' -> map of strings."""
    return F.str_to_map(raw, F.lit(";"), F.lit("="))


def coerced(value: Column) -> Column:
    """Struct of the value as integer, else as double, else as text."""
    i = F.expr("CAST(NULL AS BIGINT)") if value is None else value.try_cast("bigint")
    d = value.try_cast("double")
    return F.struct(i.alias("i"), F.when(i.isNull(), d).alias("d"), F.when(i.isNull() & d.isNull(), value).alias("s"))


def open_shards(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shards (shard) without a complete output: manifest (shard, tokens, rows, docs_n) is complete
    where its three counts agree."""
    done = manifest.where((F.col("tokens") == F.col("rows")) & (F.col("rows") == F.col("docs_n"))).select("shard")
    return wanted.join(done, "shard", "left_anti")


def merge_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Appends the rows whose key isn't there yet; running it twice changes nothing."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def write_atomic(df: DataFrame, path: str) -> None:
    """Writes beside the path and renames, so that a reader finds the old output or the new one, whole."""
    spark = df.sparkSession
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    here = spark._jvm.org.apache.hadoop.fs.Path
    fs = here(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here(path)):
        fs.delete(here(path), True)
    if not fs.rename(here(new), here(path)):
        raise OSError(f"cannot rename {new} to {path}")


def write_split(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder for each value; Spark's committer renames finished files only."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file. A file is one row, so this is for manifests and models, not for large files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))

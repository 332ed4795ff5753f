"""Scans of files: CSV and Parquet as text, JSON and YAML documents, images, arrays, partition values in paths."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV with every column as text and blanks as empty text; nothing is parsed as missing. Columns keep their order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def typed_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """CSV with a stated schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def text_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with nulls of text columns as empty text."""
    return spark.read.parquet(path).na.fill("")


def union_scan(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Many CSV files (globs allowed) as one table, with the file each row comes from."""
    return typed_csv(spark, paths, schema).withColumn("source_file", F.col("_metadata.file_path"))


def parameter_scan(spark: SparkSession, pattern: str, schema: str, names: list[str], layout: str, **wanted: str) -> DataFrame:
    """CSV files whose paths carry parameters (``layout``: a pattern with one group per name), with those as columns.

    ``wanted`` keeps rows with these values; a column that the files don't have is no filter.
    """
    df = path_values(union_scan(spark, [pattern], schema), layout, names, F.col("source_file"))
    for column, value in wanted.items():
        if column in df.columns:
            df = df.where(F.col(column) == value)
    return df


def path_values(df: DataFrame, pattern: str, names: list[str], path: Column | None = None) -> DataFrame:
    """Adds a column for each group of ``pattern`` found in the row's file path; null where it is not found."""
    at = F.col("_metadata.file_path") if path is None else path
    found = {n: F.regexp_extract(at, pattern, k + 1) for k, n in enumerate(names)}
    return df.withColumns({n: F.when(c != "", c) for n, c in found.items()})


def read_json(path: str | Path) -> dict:
    """A JSON object, with or without a byte order mark; anything but an object raises."""
    value = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def read_mapping(path: str | Path) -> dict:
    """A JSON or YAML mapping, by the file's suffix."""
    if Path(path).suffix.lower() == ".json":
        return read_json(path)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml module") from e
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files, one object each, with their paths."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def discover(spark: SparkSession, root: str, extensions: list[str], content: bool = False) -> DataFrame:
    """Files below ``root`` with one of the extensions (any case): path, relative_path, size and on request content.

    In order of the relative path in lower case when collected with ``orderBy("order_key")``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root or root.startswith("file:") else f"file:{root}"
    relative = F.regexp_replace(F.col("path"), "^" + base.replace("file://", "file:").rstrip("/") + "/+", "")
    kept = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*(e.lower() for e in extensions)))
    out = kept.select("path", relative.alias("relative_path"), F.col("length").alias("file_size_bytes"), F.lower(relative).alias("order_key"), *(["content"] if content else []))
    return out


def image_format(content: Column) -> Column:
    """The format that a file's first bytes tell: JPEG, PNG, GIF or BMP; null for anything else."""
    head = F.hex(F.substring(content, 1, 4))
    known = {"FFD8FF": "JPEG", "89504E47": "PNG", "47494638": "GIF", "424D": "BMP"}
    out = F.lit(None).cast("string")
    for start, name in known.items():
        out = F.when(head.startswith(start), name).otherwise(out)
    return out


def digests(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """relative_path and SHA-256 of the content of files."""
    return discover(spark, root, extensions, content=True).select("relative_path", F.sha2("content", 256).alias("sha256"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: origin, height, width, channels and bytes (blue, green, red); undecodable files are dropped."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select("image.*")


def npz_arrays(spark: SparkSession, root: str) -> DataFrame:
    """Named arrays of NPZ bundles in long form: path, name, shape and values in row-major order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as bundle:
                    names = list(bundle.files)
                    arrays = [np.asarray(bundle[n], np.float64) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names, pa.string()), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int32())), pa.array([a.ravel().tolist() for a in arrays], pa.list_(pa.float64()))], ["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)
    return files.select("path", "content").mapInArrow(run, "path string, name string, shape array<int>, values array<double>")

"""Sinks: tables with a stated column order, reports, write-once tables with digests, journals, arrays."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.session import cut


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """CSV with exactly ``columns`` in this order; missing or unknown columns raise."""
    unknown = sorted(set(df.columns) - set(columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    require_columns(df, columns).select(*columns).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_twins(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """The same table as CSV and Parquet, in the folders csv and parquet below ``path``."""
    write_csv(df, f"{path}/csv", columns, mode)
    df.select(*columns).write.mode(mode).parquet(f"{path}/parquet")


def twins_agree(csv: DataFrame, parquet: DataFrame) -> bool:
    """Whether both have the same columns in order and as many rows."""
    return csv.columns == parquet.columns and csv.count() == parquet.count()


def _write_shared(path: str, text: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a running session")
    file = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = file(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(file(f"{path}.next"), True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(file(path), False)
    if not fs.rename(file(f"{path}.next"), file(path)):
        raise OSError(f"cannot move {path}.next to {path}")


def write_text(path: str | Path, text: str) -> None:
    """Write a small text file at once: under another name first, then renamed. A path with a scheme (as hdfs:// or
    s3a://) goes to the shared store."""
    if "://" in str(path):
        _write_shared(str(path), text)
        return
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_json(path: str | Path, value: Any) -> None:
    """A report as JSON with sorted keys; NaN and infinities raise."""
    write_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n")


def canonical_json(value: Any) -> str:
    """JSON with sorted keys, without blanks, other letters as they are: the text whose digest identifies a value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def table_digest(df: DataFrame) -> str:
    """A digest of the rows (as a multiset) and columns of a table; equal for any order and partitioning."""
    h = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return text_digest(canonical_json([df.columns, *(str(x) for x in row)]))


def write_once(df: DataFrame, path: str) -> str:
    """Write a Parquet table that must not exist yet; returns its digest and keeps it beside the table."""
    df.write.mode("errorifexists").parquet(path)
    digest = table_digest(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(path, digest)], "path string, digest string").write.mode("errorifexists").json(f"{path.rstrip('/')}_digest")
    return digest


def write_progress(df: DataFrame, path: str) -> str:
    """Replace a Parquet table by the next state of a run; returns the digest. The new one is whole before the old one goes."""
    spark = df.sparkSession
    file = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = file(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fresh = f"{path.rstrip('/')}.next"
    df.write.mode("overwrite").parquet(fresh)
    digest = table_digest(spark.read.parquet(fresh))
    fs.delete(file(path), True)
    if not fs.rename(file(fresh), file(path)):
        raise OSError(f"cannot move {fresh} to {path}")
    return digest


def write_npz(df: DataFrame, path: str, bundle: str = "bundle") -> DataFrame:
    """One NPZ file per bundle of named arrays (bundle, name, shape, values), below a shared folder; returns (file, sha256).

    Each bundle is written by one task, so bundles must fit in it; repeated names in a bundle raise, existing files too.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if frame["name"].duplicated().any():
            raise ValueError(f"repeated arrays in {key[0]}")
        held = io.BytesIO()
        np.savez_compressed(held, **{n: np.asarray(v, float).reshape([int(k) for k in s]) for n, s, v in zip(frame["name"], frame["shape"], frame["values"], strict=True)})
        return pd.DataFrame({"file": [f"{path.rstrip('/')}/{key[0]}.npz"], "content": [held.getvalue()]})

    packed = df.select(bundle, "name", "shape", "values").groupBy(bundle).applyInPandas(run, "file string, content binary")
    written = cut(packed)
    target = Path(path.removeprefix("file://"))
    target.mkdir(parents=True, exist_ok=True)

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                with open(file.removeprefix("file://"), "xb") as f:
                    f.write(content)
            yield pd.DataFrame({"file": frame["file"], "sha256": [hashlib.sha256(c).hexdigest() for c in frame["content"]]})

    return cut(written.mapInPandas(save, "file string, sha256 string"))


def digest_table(digests: DataFrame, path: str) -> None:
    """Digests of files as lines "digest  relative_path", one text file per partition."""
    digests.select(F.concat_ws("  ", "sha256", "relative_path")).write.mode("errorifexists").text(path)


def append_journal(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the journal (Parquet) lacks, so a resumed run adds nothing twice; returns them."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as e:  # no journal yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = df.dropDuplicates(keys)
    if known is not None:
        new = new.join(known, keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def latex_table(rows: Iterable[dict], columns: list[str], caption: str = "") -> str:
    """A small table as LaTeX, with special characters escaped."""
    escape = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"})
    cell = lambda v: str(v).translate(escape)
    lines = [" & ".join(map(cell, columns)) + r" \\"] + [" & ".join(cell(r.get(c, "")) for c in columns) + r" \\" for r in rows]
    body = "\n".join([lines[0], r"\midrule", *lines[1:]])
    head = f"\\caption{{{caption}}}\n" if caption else ""
    return f"\\begin{{table}}\n{head}\\begin{{tabular}}{{{'l' * len(columns)}}}\n\\toprule\n{body}\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def log_lines(records: Iterable[dict]) -> str:
    """Log records as JSON lines."""
    return "".join(json.dumps(r, sort_keys=True, default=str) + "\n" for r in records)

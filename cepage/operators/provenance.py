"""Digests of inputs, verification of frozen digests, code versions, configuration overlays and run selection."""

from __future__ import annotations

import hashlib
import importlib.metadata
import subprocess
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cepage.sources.files import read_json
from cepage.sources.sinks import canonical_json, text_digest, write_json


def verify_digests(expected: DataFrame, actual: DataFrame, name: str = "name", digest: str = "digest") -> DataFrame:
    """name, problem for digests that are missing, unexpected or different (case aside); no rows if all agree."""
    both = expected.select(name, F.col(digest).alias("__e")).join(actual.select(name, F.col(digest).alias("__a")), name, "full")
    problem = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.lower("__e") != F.lower("__a"), "different")
    return both.select(name, problem.alias("problem")).where("problem is not null")


def file_digest(path: str | Path, chunk: int = 1 << 20) -> str:
    """SHA-256 of a file, read in pieces."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def tree_digest(root: str | Path, ignored: tuple[str, ...] = (".git", "__pycache__", ".pytest_cache")) -> str:
    """SHA-256 over all files below a folder: length and text of the path, length and content, in path order."""
    h = hashlib.sha256()
    base = Path(root)
    for path in sorted((p for p in base.rglob("*") if p.is_file() and not set(p.relative_to(base).parts) & set(ignored)), key=lambda p: p.relative_to(base).as_posix()):
        for part in (path.relative_to(base).as_posix().encode(), path.read_bytes()):
            h.update(len(part).to_bytes(8, "big"))
            h.update(part)
    return h.hexdigest()


def code_version(root: str | Path, configured: str | None = None) -> str:
    """The configured version, else the commit of the work tree, else the digest of the tree."""
    if configured:
        return configured
    try:
        said = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=20, check=True)
        return said.stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "tree-" + tree_digest(root)


def package_versions(names: list[str]) -> dict[str, str | None]:
    """Installed versions; None for what is not installed."""
    out: dict[str, str | None] = {}
    for n in names:
        try:
            out[n] = importlib.metadata.version(n)
        except importlib.metadata.PackageNotFoundError:
            out[n] = None
    return out


def run_identity(config: dict[str, Any], inputs: dict[str, str]) -> str:
    """Twenty digits that identify a run by its configuration and input digests."""
    return text_digest(canonical_json({"config": config, "inputs": inputs}))[:20]


def overlay(base: dict[str, Any], *layers: dict[str, Any], drop: tuple[str, ...] = ()) -> dict[str, Any]:
    """Later mappings win; keys in ``drop`` are left out of the layers."""
    out = dict(base)
    for layer in layers:
        out |= {k: v for k, v in layer.items() if k not in drop}
    return out


def run_settings(base: dict[str, Any], *layers: dict[str, Any], drop: tuple[str, ...] = (), focal: bool = False) -> dict[str, Any]:
    """``overlay``; a focal regime takes a hundredth of the learning rate, and clips at 1.0 unless a clip is set."""
    out = overlay(base, *layers, drop=drop)
    if focal:
        out["learning_rate"] = out["learning_rate"] * 0.01
        if out.get("clip_norm") is None:
            out["clip_norm"] = 1.0
    return out


def freeze(inputs: dict[str, str | Path], target: str | Path, **facts: Any) -> dict[str, Any]:
    """Write the digests of all input files and further facts to ``target``, once; missing inputs raise, nothing is written then."""
    target = Path(target)
    missing = sorted(n for n, p in inputs.items() if not Path(p).is_file())
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
    if target.exists():
        raise FileExistsError(str(target))
    record = {"status": "frozen", "digests": {n: file_digest(p) for n, p in inputs.items()}, **facts}
    write_json(target, record)
    return record | {"record_digest": file_digest(target)}


def verify_frozen(target: str | Path, inputs: dict[str, str | Path], record_digest: str | None = None) -> dict[str, Any]:
    """The frozen record, if it is whole and every input still has its digest; any difference raises."""
    target = Path(target)
    record = read_json(target)
    if record.get("status") != "frozen":
        raise ValueError(f"{target} is not frozen")
    if record_digest is not None and file_digest(target) != record_digest.lower():
        raise ValueError(f"{target} was changed")
    known = record.get("digests", {})
    wrong = sorted({n for n, p in inputs.items() if not Path(p).is_file() or str(known.get(n, "")).lower() != file_digest(p)} | (set(known) - set(inputs)))
    if wrong:
        raise ValueError(f"inputs differ from the frozen ones: {', '.join(wrong)}")
    return record


def matrix_summary(results: DataFrame, expected: DataFrame, keys: list[str], completed: Column, forbidden: Column) -> DataFrame:
    """One row: combinations expected and completed, forbidden accesses, and passed if all are there once and none is forbidden."""
    have = results.groupBy(*keys).agg(F.count("*").alias("__n"), F.bool_and(completed).alias("__done"), F.count_if(forbidden).alias("__bad"))
    both = expected.select(*keys).distinct().withColumn("__asked", F.lit(True)).join(have, keys, "full")
    row = both.agg(F.count("__asked").alias("expected"), F.count_if(F.col("__asked") & F.col("__done") & (F.col("__n") == 1)).alias("completed"), F.count_if(F.col("__asked").isNull()).alias("unexpected"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("forbidden"))
    return row.withColumn("passed", (F.col("expected") == F.col("completed")) & (F.col("unexpected") == 0) & (F.col("forbidden") == 0))


def first_present(row: dict[str, Any], names: list[str]) -> Any:
    """The value of the first name that is present and not None; none raises."""
    for n in names:
        if row.get(n) is not None:
            return row[n]
    raise KeyError(f"none of {', '.join(names)}")


def candidate_summary(journal: DataFrame, by: list[str], score: str, loss: str) -> DataFrame:
    """Per candidate: runs, mean and sample deviation of the score, mean loss; candidates of one run are left out."""
    sums = journal.groupBy(*by).agg(F.count(score).alias("runs"), F.avg(score).alias("mean_score"), F.stddev_samp(score).alias("std_score"), F.avg(loss).alias("mean_loss"))
    return sums.where("runs >= 2")


def best_candidate(summary: DataFrame, scope: list[str], candidate: str) -> DataFrame:
    """The candidate of each scope with the highest mean score, then least deviation, then least loss, then least itself."""
    key = F.struct((-F.col("mean_score")).alias("s"), F.col("std_score").alias("d"), F.col("mean_loss").alias("l"), F.col(candidate).alias("c"))
    return summary.groupBy(*scope).agg(F.min_by(candidate, key).alias(candidate), F.max("mean_score").alias("mean_score"))


def run_status(runs: DataFrame, expected: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """For every expected run whether it is done, not done or absent."""
    have = runs.groupBy(*keys).agg(F.bool_or(done).alias("__d"))
    joined = expected.join(have, keys, "left")
    return joined.withColumn("state", F.when(F.col("__d").isNull(), "absent").when(F.col("__d"), "done").otherwise("not_done")).drop("__d")

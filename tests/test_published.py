"""Curves, published manifests and splits, frozen inputs, bundles and packs of files."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_files import NS, U, picture, png

from cepage.functions import fingerprints as P
from cepage.functions import scalars as S
from cepage.operators import compaction, curves, manifest, provenance, review, splitting
from cepage.sources import files, sinks


def test_curves_of_maps_and_random_orders(spark, tmp_path):
    def brightness(images, target):
        return images[..., target].mean(axis=(1, 2))

    for k in range(2):
        png(tmp_path / f"{k}.png", picture(k))
    images = files.images(spark, str(tmp_path)).withColumn("target", F.lit(1))
    name = {r["origin"]: int(r["origin"][-5]) for r in images.select("origin").collect()}
    rng = np.random.default_rng(3)
    maps = {o: rng.random((32, 32)) for o in name}
    frame = spark.createDataFrame([(o, [32, 32], m.ravel().tolist()) for o, m in maps.items()], "origin string, shape array<int>, values array<double>")
    orders = curves.block_orders(frame, ["origin"], 8)
    assert {r["origin"]: r["block_order"] for r in orders.collect()} == {o: P.ranked_blocks(m, 8).tolist() for o, m in maps.items()}
    drawn = curves.random_orders(frame, ["origin"], 16, trials=3)
    assert all(sorted(r["block_order"]) == list(range(16)) for r in drawn.collect()) and drawn.count() == 6
    assert sorted(map(tuple, drawn.collect()), key=str) == sorted(map(tuple, curves.random_orders(frame.repartition(3), ["origin"], 16, trials=3).collect()), key=str)
    grid = curves.fractions()
    assert len(grid) == 11 and grid[-1] == pytest.approx(0.5)
    scores = curves.perturbed_scores(images, orders.unionByName(drawn), "origin", brightness, 8, grid)
    got = {(r["origin"], r["method"], r["kind"], round(r["fraction"], 2)): r["score"] for r in scores.collect()}
    assert len(got) == 2 * 4 * 2 * 11
    for o, k in name.items():
        x = picture(k) / 255
        base = P.blurred(x)
        for f in (0.0, 0.25, 0.5):
            put, cut = base.copy(), x.copy()
            for b in P.ranked_blocks(maps[o], 8)[: round(f * 16)]:
                at = slice(b // 4 * 8, b // 4 * 8 + 8), slice(b % 4 * 8, b % 4 * 8 + 8)
                put[at], cut[at] = x[at], base[at]
            assert got[o, "map", "insertion", f] == pytest.approx(put[..., 1].mean()) and got[o, "map", "deletion", f] == pytest.approx(cut[..., 1].mean())
    areas = curves.curve_areas(scores, ["origin"])
    one = areas.where("method = 'map'").collect()
    for r in one:
        y = [got[r["origin"], "map", "insertion", round(f, 2)] for f in grid]
        assert r["insertion_auc"] == pytest.approx(np.trapezoid(y, grid) / 0.5)
    beside = curves.against_random(areas, ["origin"]).collect()
    assert len(beside) == 2 and all(r["random_orders"] == 3 and r["random_deletion_std"] is not None for r in beside)
    row = curves.faithfulness_table(areas.where("method = 'map'").withColumn("model", F.lit("m")), ["model"]).first()
    assert row["images"] == 2 and len(row["insertion_auc_mean"].split(".")[1]) == 4
    with pytest.raises(Exception, match="every block"):
        curves.perturbed_scores(images, orders.withColumn("block_order", F.slice("block_order", 1, 5)), "origin", brightness, 8, grid).collect()


def test_scaled_baseline_and_completeness(spark):
    x = np.random.default_rng(1).random((40, 40, 3))
    mean, std = [0.4, 0.5, 0.6], [0.2, 0.3, 0.1]
    assert np.allclose(P.unscaled(P.scaled(x, mean, std), mean, std), x)
    assert np.allclose(P.blurred_baseline(P.scaled(x, mean, std), mean, std), P.scaled(P.blurred(x), mean, std))
    df = spark.createDataFrame([(0.01, 1.0), (0.2, 1.0), (None, 1.0), (float("nan"), 1.0)], "d double, x double")
    assert [r[0] for r in df.select(S.converged(F.col("d"), F.col("x"), 0.05)).collect()] == [True, False, False, False]
    texts = spark.createDataFrame([("1.5",), (None,)], "t string")
    assert [r[0] for r in texts.select(S.strict_number(F.col("t"))).collect()] == [1.5, None]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([("x1",)], "t string").select(S.strict_number(F.col("t"))).collect()


COLUMNS = ["image_id", "original_id", "class_name", "class_id", "relative_path", "sha256", "is_original", "is_augmented", "group_id", "group_id_status", "validation_status", "split", "split_seed"]


def test_manifest_is_published_once_and_audited(spark, tmp_path):
    root = tmp_path / "images"
    for k in range(3):
        png(root / "Healthy" / f"{U}{k:02d}___leaf {k}.png", picture(k))
    png(root / "Weed" / f"{U}50___leaf.png", picture(50))
    spec = {"width": 32, "height": 32, "mode": "RGB", "format": "PNG"}
    rows, _ = manifest.build_manifest(spark, str(root), {"Healthy": 0, "Weed": 1}, ["flipLR"], spec, NS, extensions=(".png",))
    full = rows.withColumns({"is_augmented": F.lit(False), "group_id": F.col("original_id"), "group_id_status": F.lit("provisional_original_id"), "split_seed": F.lit("")}).select(*COLUMNS)
    expected = {"Healthy": 3, "Weed": 1}
    with pytest.raises(ValueError, match="Healthy: expected 4, found 3"):
        manifest.publish_manifest(full, str(tmp_path / "no"), COLUMNS, {"Healthy": 4, "Weed": 1})
    with pytest.raises(ValueError, match="invalid rows"):
        manifest.publish_manifest(full.withColumn("validation_status", F.lit("invalid")), str(tmp_path / "no"), COLUMNS, expected)
    assert not (tmp_path / "no").exists()
    path = str(tmp_path / "out")
    digest = manifest.publish_manifest(full, path, COLUMNS, expected)
    assert spark.read.json(f"{path}/digest").first()["digest"] == digest
    with pytest.raises(Exception, match="(?i)exist"):
        manifest.publish_manifest(full, path, COLUMNS, expected)
    row, errors = manifest.audit_published(spark, str(root), path, COLUMNS, expected, ["flipLR"], (".png",))
    assert row.first()["passed"] is True and errors.count() == 0 and len(row.columns) == 15
    (root / "Weed" / f"{U}50___leaf.png").unlink()
    png(root / "Healthy" / f"{U}01___leaf 1.png", picture(9))
    row, errors = manifest.audit_published(spark, str(root), path, COLUMNS, {"Healthy": 3, "Weed": 2}, ["leaf 0"], (".png",))
    got = row.first().asDict()
    assert {k for k, v in got.items() if not v} == {"row_count_matches", "class_counts_match", "no_missing_files", "no_hash_mismatches", "no_variants", "passed"}
    assert sorted(r["error"] for r in errors.collect()) == ["digest_mismatch", "missing_file", "variant"]


def test_format_is_read_from_the_file(spark, tmp_path):
    png(tmp_path / "Healthy" / f"{U}01___a.jpg", picture(1))
    rows, _ = manifest.build_manifest(spark, str(tmp_path), {"Healthy": 0}, [], {"width": 32, "height": 32, "mode": "RGB", "format": "JPEG"}, NS, extensions=(".jpg",))
    assert rows.first()["validation_errors"] == "unexpected_format:PNG"


def test_split_is_written_only_if_feasible(spark, tmp_path):
    groups = spark.createDataFrame([(f"g{c}{k:02d}", f"c{c}", 1 + k % 3) for c in range(2) for k in range(40)], "group_id string, class_name string, size int")
    loose = splitting.SplitGoal(class_tolerance=5.0, overall_tolerance=3.0)
    split, report = splitting.write_split(groups, str(tmp_path / "s"), 40, goal=loose)
    assert report["feasible"] and split.count() == 80
    with pytest.raises(Exception, match="(?i)exist"):
        splitting.write_split(groups, str(tmp_path / "s"), 40, goal=loose)
    one = spark.createDataFrame([("g", "c", 9), ("h", "c", 9)], "group_id string, class_name string, size int")
    split, report = splitting.write_split(one, str(tmp_path / "t"), 5)
    assert split is None and not report["feasible"] and report["violations"] > 0 and not (tmp_path / "t").exists()


def test_frozen_inputs_and_settings(spark, tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    inputs = {n: tmp_path / n for n in "ab"}
    with pytest.raises(FileNotFoundError, match="c"):
        provenance.freeze(inputs | {"c": tmp_path / "c"}, tmp_path / "frozen.json")
    record = provenance.freeze(inputs, tmp_path / "frozen.json", seeds=[1, 2])
    assert provenance.verify_frozen(tmp_path / "frozen.json", inputs, record["record_digest"])["seeds"] == [1, 2]
    with pytest.raises(FileExistsError):
        provenance.freeze(inputs, tmp_path / "frozen.json")
    (tmp_path / "b").write_text("changed")
    with pytest.raises(ValueError, match="b"):
        provenance.verify_frozen(tmp_path / "frozen.json", inputs)
    with pytest.raises(ValueError, match="b"):
        provenance.verify_frozen(tmp_path / "frozen.json", {"a": tmp_path / "a"})
    with pytest.raises(ValueError, match="was changed"):
        provenance.verify_frozen(tmp_path / "frozen.json", inputs, "00")
    (tmp_path / "open.json").write_text(json.dumps({"status": "open"}))
    with pytest.raises(ValueError, match="not frozen"):
        provenance.verify_frozen(tmp_path / "open.json", {})
    base = {"learning_rate": 0.5, "clip_norm": None, "x": 1}
    assert provenance.run_settings(base, {"x": 2}) == base | {"x": 2}
    assert provenance.run_settings(base, focal=True) == {"learning_rate": 0.005, "clip_norm": 1.0, "x": 1}
    assert provenance.run_settings(base, {"clip_norm": 3.0}, focal=True)["clip_norm"] == 3.0
    grid = spark.createDataFrame([("a", 1), ("b", 1)], "m string, r int")
    done = spark.createDataFrame([("a", 1, True, False), ("b", 1, True, False)], "m string, r int, ok boolean, test boolean")
    passed = lambda rows: provenance.matrix_summary(rows, grid, ["m", "r"], F.col("ok"), F.col("test")).first()["passed"]
    assert passed(done) and not passed(done.limit(1)) and not passed(done.withColumn("test", F.lit(True))) and not passed(done.union(done)) and not passed(done.limit(0))


def test_bundles_progress_and_shared_reports(spark, tmp_path):
    rows = [("p", "map", [2, 2], [1.0, 2.0, 3.0, 4.0]), ("p", "d", [1], [0.5]), ("q", "map", [1], [7.0])]
    df = spark.createDataFrame(rows, "bundle string, name string, shape array<int>, values array<double>")
    written = {r["file"]: r["sha256"] for r in sinks.write_npz(df, str(tmp_path / "n")).collect()}
    assert all(hashlib.sha256(open(f, "rb").read()).hexdigest() == d for f, d in written.items()) and len(written) == 2
    back = {(r["path"][-5], r["name"]): (r["shape"], r["values"]) for r in files.npz_arrays(spark, str(tmp_path / "n")).collect()}
    assert back == {(b, n): (s, v) for b, n, s, v in rows}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_npz(df, str(tmp_path / "n"))
    one = sinks.write_progress(df, str(tmp_path / "state"))
    two = sinks.write_progress(df.limit(1), str(tmp_path / "state"))
    assert one != two and spark.read.parquet(str(tmp_path / "state")).count() == 1
    sinks.write_json(f"file://{tmp_path}/r/report.json", {"b": 1})
    sinks.write_json(f"file://{tmp_path}/r/report.json", {"a": 1})
    assert files.read_json(tmp_path / "r" / "report.json") == {"a": 1}


def test_files_are_packed_with_their_contents(spark, tmp_path):
    rng = np.random.default_rng(5)
    made = {}
    for k in range(60):
        path = tmp_path / "tree" / f"d{k % 3}" / f"f{k} é.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        made[path.name] = rng.bytes(int(rng.integers(0, 4000)) if k else 90_000)
        path.write_bytes(made[path.name])
    packs = compaction.pack_files(spark, str(tmp_path / "tree"), str(tmp_path / "packs"), target_bytes=20_000)
    got = packs.collect()
    assert len(got) == 60 and {r["path"].split("/")[-1]: bytes(r["content"]) for r in got} == made
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == len({r["pack_id"] for r in got}) < 20
    (tmp_path / "empty").mkdir()
    assert compaction.pack_files(spark, str(tmp_path / "empty"), str(tmp_path / "none")).collect() == []


def test_template_report_and_parameters(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "dhash", True), ("q", "dhash+phash", None)], "id string, triggered_by string, same_class boolean")
    blank = review.review_template(pairs).first()
    assert blank["decision"] == "" and blank["required_action"] == "independent_human_review"
    assert review.evidence_report(pairs).first().asDict() == {"candidates": 2, "cross_class": 1, "by_dhash": 1, "by_phash": 0, "by_both": 1}
    for seed in (1, 2):
        (tmp_path / "m" / f"seed_{seed}").mkdir(parents=True)
        (tmp_path / "m" / f"seed_{seed}" / "x.csv").write_text("target_type,v\ntrue,1\npredicted,2\n")
    scan = lambda **w: sorted((r["seed"], r["v"]) for r in files.parameter_scan(spark, f"{tmp_path}/*/*/x.csv", "target_type string, v int", ["model", "seed"], r"/([^/]+)/seed_(\d+)/", **w).collect())
    assert scan(target_type="true") == [("1", 1), ("2", 1)] and len(scan(other="x")) == 4

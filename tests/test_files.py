import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cepage.functions import fingerprints as P
from cepage.operators import manifest as Mf
from cepage.operators import review as R
from cepage.sources import files, sinks

U = "3f2504e0-4f89-41d3-9a0c-0305e82c33"
NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, size=32):
    rng = np.random.default_rng(seed)
    return np.clip(np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((size // 8, size // 8, 1))), 0, 255)


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\nNA,""\n,"a ""b"", c"\n01,null\n')
    df = files.text_csv(spark, str(tmp_path / "a.csv"), ["x", "y"])
    assert [tuple(r) for r in df.collect()] == [("NA", ""), ("", 'a "b", c'), ("01", "null")]


def test_twins_agree_and_columns_are_checked(spark, tmp_path):
    df = spark.createDataFrame([("1", ""), ("a,b", 'q"')], "x string, y string")
    sinks.write_twins(df, str(tmp_path / "t"), ["y", "x"])
    csv, parquet = files.text_csv(spark, str(tmp_path / "t/csv"), ["y", "x"]), files.text_parquet(spark, str(tmp_path / "t/parquet"))
    assert sinks.twins_agree(csv, parquet) and sorted(csv.collect()) == sorted(parquet.collect())
    with pytest.raises(ValueError, match="unknown"):
        sinks.write_csv(df, str(tmp_path / "u"), ["x"])
    with pytest.raises(ValueError, match="missing"):
        sinks.write_csv(df, str(tmp_path / "u"), ["x", "y", "z"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(df, str(tmp_path / "t/csv"), ["x", "y"])


def test_documents(tmp_path):
    (tmp_path / "a.json").write_text('﻿{"a": 1}', encoding="utf-8")
    (tmp_path / "b.json").write_text("[1]")
    assert files.read_json(tmp_path / "a.json") == {"a": 1} == files.read_mapping(tmp_path / "a.json")
    with pytest.raises(ValueError):
        files.read_json(tmp_path / "b.json")
    sinks.write_json(tmp_path / "d/c.json", {"b": "é", "a": [1]})
    assert (tmp_path / "d/c.json").read_text(encoding="utf-8") == '{\n  "a": [\n    1\n  ],\n  "b": "é"\n}\n'
    with pytest.raises(ValueError):
        sinks.write_json(tmp_path / "d/e.json", {"x": float("nan")})
    assert sinks.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert json.loads(sinks.log_lines([{"a": 1}])) == {"a": 1}
    assert r"a\_b & 1 \\" in sinks.latex_table([{"x": "a_b", "y": 1}], ["x", "y"])


def test_path_values_and_unions(spark, tmp_path):
    for arch, seed in (("r", 1), ("v", 2)):
        (tmp_path / arch / f"seed_{seed}").mkdir(parents=True)
        (tmp_path / arch / f"seed_{seed}" / "h.csv").write_text(f"epoch\n{seed}\n")
    df = files.union_scan(spark, [f"{tmp_path}/*/*/h.csv"], "epoch int")
    got = files.path_values(df, r"/([^/]+)/seed_(\d+)/", ["arch", "seed"], F.col("source_file")).select("arch", "seed", "epoch").collect()
    assert sorted(map(tuple, got)) == [("r", "1", 1), ("v", "2", 2)]


def test_write_once_and_journal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    digest = sinks.write_once(df, str(tmp_path / "w"))
    assert digest == sinks.table_digest(df.repartition(3)) != sinks.table_digest(df.limit(1))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "w"))
    j = str(tmp_path / "j")
    sinks.append_journal(df, j, ["k"])
    sinks.append_journal(spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string"), j, ["k"])
    assert sorted(map(tuple, spark.read.parquet(j).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_arrays_and_map_comparison(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = rng.random((16, 16))
    np.savez(tmp_path / "a.npz", map=m, other=np.arange(3))
    rows = {r["name"]: r for r in files.npz_arrays(spark, str(tmp_path)).collect()}
    assert rows["map"]["shape"] == [16, 16] and rows["map"]["values"] == m.ravel().tolist() and rows["other"]["values"] == [0, 1, 2]
    maps = spark.createDataFrame([("k", s, [16, 16], v.ravel().tolist()) for s, v in ((1, m), (2, m), (3, 1 - m))], "k string, seed int, shape array<int>, values array<double>")
    got = {(r["seed_a"], r["seed_b"]): r for r in R.compare_maps(maps, ["k"], "seed").collect()}
    assert got[(1, 2)]["spearman"] == pytest.approx(1) and got[(1, 2)]["overlap"] == 1 and got[(1, 2)]["ssim"] == pytest.approx(1)
    assert got[(1, 3)]["spearman"] == pytest.approx(-1) and got[(1, 3)]["overlap"] == 0 and len(got) == 3


def test_fingerprint_kernels():
    a, b = picture(1), picture(2)
    assert P.difference_hash(a) == P.difference_hash(a.copy()) and P.frequency_hash(a) != P.frequency_hash(b)
    brighter = np.clip(a * 0.9 + 5, 0, 255)
    assert ((P.difference_hash(a) ^ P.difference_hash(brighter)) & (2**64 - 1)).bit_count() <= 10
    assert P.structural_similarity(P.unit_grey(a), P.unit_grey(a)) == pytest.approx(1)
    assert float(P.colour_embedding(a) @ P.colour_embedding(a)) == pytest.approx(1)
    assert np.allclose(P.cosine_basis(32) @ P.cosine_basis(32).T, np.eye(32))
    assert np.allclose(P._lanczos(64, 9).sum(axis=1), 1) and P.resize(a, 9, 8).shape == (9, 8, 3)
    assert P.block_means(np.arange(16.0).reshape(4, 4), 2).tolist() == [2.5, 4.5, 10.5, 12.5] and P.ranked_blocks(np.zeros((4, 4)), 2).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        P.block_means(np.zeros((3, 4)), 2)
    assert P.unit_range(np.array([np.nan, 2.0, 4.0])).max() == pytest.approx(1)
    x = np.random.default_rng(0).random((40, 40, 3))
    assert P.blurred(x).shape == x.shape and P.blurred(x).std() < x.std()
    s = P.structural_similarity(x[:, :, 0], x[:, :, 1], 11)
    # Windows one by one.
    v = np.lib.stride_tricks.sliding_window_view
    p, q = v(x[:, :, 0], (11, 11)).reshape(-1, 121), v(x[:, :, 1], (11, 11)).reshape(-1, 121)
    cov = ((p - p.mean(1, keepdims=True)) * (q - q.mean(1, keepdims=True))).sum(1) / 120
    want = (2 * p.mean(1) * q.mean(1) + 1e-4) * (2 * cov + 9e-4) / ((p.mean(1) ** 2 + q.mean(1) ** 2 + 1e-4) * (p.var(1, ddof=1) + q.var(1, ddof=1) + 9e-4))
    assert s == pytest.approx(want.mean())


def test_manifest_of_a_tree(spark, tmp_path):
    for k in range(4):
        png(tmp_path / "Healthy" / f"{U}{k:02d}___leaf {k}.PNG", picture(k))
        png(tmp_path / "Healthy" / f"{U}{k:02d}___leaf {k}_flipLR.png", picture(k)[:, ::-1])
    png(tmp_path / "Healthy" / "unnamed.png", picture(0))
    png(tmp_path / "Weed" / f"{U}77___x.png", picture(9, 64))
    (tmp_path / "Healthy" / f"{U}88___broken.png").write_bytes(b"no image")
    (tmp_path / "Healthy" / "note.txt").write_text("x")
    spec = {"width": 32, "height": 32, "mode": "RGB", "format": "PNG"}
    rows, excluded = Mf.build_manifest(spark, str(tmp_path), {"Healthy": 2}, ["flipLR"], spec, NS, extensions=(".png",))
    got = {r["filename"]: r for r in rows.collect()}
    assert len(got) == 7 and excluded.count() == 4
    assert got["unnamed.png"]["validation_errors"] == "duplicate_sha256;invalid_or_missing_uuid"
    assert got[f"{U}00___leaf 0.PNG"]["validation_errors"] == "duplicate_sha256"
    assert got[f"{U}01___leaf 1.PNG"]["validation_status"] == "valid" and got[f"{U}01___leaf 1.PNG"]["class_id"] == 2 and len(got[f"{U}01___leaf 1.PNG"]["dhash"]) == 16
    assert got[f"{U}88___broken.png"]["validation_errors"] == "decode_error"
    assert got[f"{U}77___x.png"]["validation_errors"].startswith("unknown_class;unexpected_height:64")
    digests = files.digests(spark, str(tmp_path), [".png"])
    row, errors = Mf.audit_manifest(rows, digests, {"all_original": F.col("is_original")})
    assert {r["error"] for r in errors.collect()} == {"not_in_manifest"} and row.first()["n_errors"] == 4 and row.first()["passed"] is False
    changed = rows.select("relative_path", "is_original", F.lit("00").alias("sha256")).union(spark.createDataFrame([("../x", True, "1"), ("gone", True, "1")]))
    kinds = {r["error"] for r in Mf.audit_manifest(changed, digests, {})[1].collect()}
    assert kinds == {"digest_mismatch", "missing_file", "leaves_root", "not_in_manifest"}


def test_evidence_and_moments(spark, tmp_path):
    for k in range(3):
        png(tmp_path / f"{k}.png", picture(k % 2))
    images = files.images(spark, str(tmp_path))
    names = sorted(r["origin"] for r in images.select("origin").collect())
    pairs = spark.createDataFrame([(names[0], names[2]), (names[0], names[1])], "a string, b string")
    got = {(r["a"], r["b"]): r for r in R.similarity_evidence(pairs, images).collect()}
    assert got[(names[0], names[2])]["ssim"] == got[(names[0], names[2])]["cosine"] == 1 and got[(names[0], names[1])]["ssim"] < 0.9
    split = spark.createDataFrame([(names[0], "train"), (names[1], "test")], "path string, split string")
    rows = {r["channel"]: r for r in Mf.train_moments(split, images).collect()}
    x = picture(0) / 255
    assert len(rows) == 3 and rows[0]["mean"] == pytest.approx(x[:, :, 0].mean()) and rows[2]["std"] == pytest.approx(x[:, :, 2].std())


def test_command_line(data, capsys, monkeypatch, spark):
    import cepage.__main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda cores: spark)
    assert cli.main(["--list"]) == 0 and "p5_found" in capsys.readouterr().out
    assert cli.main(["a01_class_counts", "--data", data]) == 0 and len(json.loads(capsys.readouterr().out)) == 5
    assert cli.main(["p14_checks", "--data", data]) == 2


def test_streams_give_the_rows_of_batches(spark, data, tmp_path):
    from cepage.streaming import windows

    spark.read.parquet(f"{data}/events.parquet").orderBy("ts").repartition(3).write.parquet(str(tmp_path / "e"))
    stream = windows.windowed(windows.event_stream(spark, str(tmp_path / "e")), ["event_type"], late="4000 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.windowed(spark.read.parquet(f"{data}/events.parquet"), ["event_type"])
    key = lambda r: (r["window_start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.sql("select * from w").collect())) == sorted(map(key, batch.collect()))
    assert windows.sessions(spark.read.parquet(f"{data}/events.parquet"), ["user_id"], "1 day").agg(F.sum("n")).first()[0] == 1000

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.operators import compaction as K
from cepage.operators import orphans as O
from cepage.session import Kept, remove_path

U = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"


def value(spark, expression, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("text", [U, U.upper(), "{" + U + "}", f"urn:uuid:{U.upper()}", f" {U}\t", U.replace("-", ""), "{" + U.replace("-", "") + "} "])
def test_uuid_in_any_writing(spark, text):
    assert value(spark, N.uuid_text, text) == U


def test_ids_hashes_digests_and_labels(spark):
    for f in (N.uuid_text, N.hash64, N.digest256, N.split_name, N.label, N.file_path):
        assert value(spark, f, None) is None and value(spark, f, " \t") is None
    assert value(spark, N.uuid_text, " Row 7 ") == "row 7"
    assert [value(spark, N.uuid_text, x) for x in ("urn:uuid:", "{}", "{ }", " () ")] == [None] * 4
    assert value(spark, N.hash64, " 0xFFFFFFFFFFFFFFFF") == -1 and value(spark, N.hash64, "1f") == 31 and value(spark, N.hash64, "0" * 20 + "1f\t") == 31
    assert value(spark, N.hash64, "n/a") is None and value(spark, N.hash64, "1" * 17) is None
    assert value(spark, N.digest256, "SHA256:" + "AB" * 32) == "ab" * 32 and value(spark, N.digest256, "ab") is None
    assert [value(spark, N.split_name, s) for s in (" VAL", "Testing", "training ", "other")] == ["validation", "test", "train", None]
    assert value(spark, N.label, " Leaf__Blight ") == "leaf blight"
    assert [value(spark, N.is_held, s) for s in (None, "", "valid", " DELETED\t")] == [True, True, True, False]


@pytest.mark.parametrize(("path", "place"), [
    ("a/b.jpg", "a/b.jpg"), (" a//./b.jpg ", "a/b.jpg"), (".\\a\\b%20c.jpg", "a/b c.jpg"), ("x/../a/b.jpg", "a/b.jpg"), ("/a/b.jpg", "a/b.jpg"), ("a+b%2Bc.jpg", "a+b+c.jpg"),
    ("100%.jpg", "100%.jpg"), ("a/../../b", "../b"), ("../../b", "../../b"), ("A/b.jpg", "A/b.jpg"), ("..", ".."), ("a/..", None), (".", None), ("a/b/", "a/b"),
])
def test_paths_lead_to_one_place(spark, path, place):
    assert value(spark, N.file_path, path) == place


def orphan_keys(spark, parents, references, partitions=3):
    p = spark.createDataFrame([("r", k) for k in parents], "relation string, ref_key string")
    r = spark.createDataFrame([("r", k, n, 1) for n, k in enumerate(references)], "relation string, ref_key string, row int, parent int")
    return sorted((x["ref_key"], x["row"]) for x in O.find_orphans(p, r, partitions).collect())


def test_orphans_against_sets(spark):
    rng = random.Random(3)
    numbers = [str(rng.randrange(-500, 500)) for _ in range(600)]
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)] + [str(uuid.UUID(int=(7 << 64) + k)) for k in range(60)]
    words = [f"name {k}" for k in range(50)]
    keys = numbers + ids + words
    parents = [k for k in keys if rng.random() < 0.6] + keys[:5] + [None]
    references = [rng.choice(keys) for _ in range(900)] + ["hot"] * 500 + [None, None, str(uuid.UUID(int=0)), str(uuid.UUID(int=2**128 - 1)), str(2**63), "-5000"]
    want = sorted((k, n) for n, k in enumerate(references) if k is not None and k not in set(parents))
    for partitions in (1, 3, 16):
        assert orphan_keys(spark, parents, references, partitions) == want


def test_orphans_of_many_relations_in_small_batches(spark):
    rng = random.Random(5)
    names = [None, "a", "b", "plumless", "buckeroo"]  # the last two have equal CRC32
    parents = [(rng.choice(names), str(rng.randrange(60))) for _ in range(150)]
    references = [(rng.choice(names), str(rng.randrange(60)), n) for n in range(400)]
    want = sorted((n for r, k, n in references if (r, k) not in set(parents)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = O.find_orphans(spark.createDataFrame(parents, "relation string, ref_key string"), spark.createDataFrame(references, "relation string, ref_key string, n int"), 2)
        assert sorted(x["n"] for x in found.collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_orphans_of_empty_tables(spark):
    assert orphan_keys(spark, [], ["a", "1", None]) == [("1", 1), ("a", 0)]
    assert orphan_keys(spark, ["a"], []) == []


def test_orphan_report_counts_rows_and_keys(spark):
    p = spark.createDataFrame([("r", "1")], "relation string, ref_key string")
    rows = [("r", "2", "t", "f", "m1"), ("r", "2", "t", "f", "m1"), ("r", "3", "t", "f", "m1"), ("r", "2", "t", "f", None), ("r", "1", "t", "f", "m1"), ("r", None, "t", "f", "m1")]
    r = spark.createDataFrame(rows, "relation string, ref_key string, child_table string, child_field string, month string")
    got = {x["period"]: (x["orphan_keys"], x["orphan_rows"]) for x in O.orphan_report(p, r, F.col("month")).collect()}
    assert got == {"m1": (2, 3), None: (1, 1)}


@pytest.mark.parametrize(("bits", "n"), [(1, 2), (3, 2), (3, 3), (2, 4)])
def test_hilbert_curve_visits_each_cell_once_and_never_jumps(bits, n):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    codes = K.hilbert_index(points, bits)
    assert sorted(codes.tolist()) == list(range(len(points)))
    walk = points[np.argsort(codes)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


SHAPE = "source_row bigint, relative_path string, file_size_bytes bigint, kind string, at bigint, pack_id int, path string"


def listing(n, rng):
    rows = []
    for k in range(n):
        kind = "hot" if k % 3 else rng.choice(["a", "b", None])
        rows.append((k, f"d/{k}.jpg", rng.choice([10, 20, 50, None, -1]), kind, k if k % 5 else None, 1, "x"))
    for k in range(n, n + n // 5):
        rows.append((k, f".\\d\\{rng.randrange(n)}.jpg ", 30, "a", 1, 1, "x"))
    return rows + [(10_000, None, 5, "a", 1, 1, "x"), (10_001, " ", 5, "a", 1, 1, "x"), (10_002, "d/big.jpg", 5000, "a", 1, 1, "x")]


def test_every_file_once_in_balanced_packs(spark):
    rng = random.Random(8)
    rows = listing(400, rng)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    dims = [K.Dimension("kind"), K.Dimension("at", ordered=True)]
    written = K.compact_table(df, dims, target_bytes=600)
    got = written.collect()
    assert sorted(r["path"] for r in got) == sorted([f"d/{k}.jpg" for k in range(400)] + ["d/big.jpg"])
    files = written.select("pack_id", F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert len(files) == len({r["f"] for r in files}) == len({r["pack_id"] for r in files})
    packs: dict = {}
    for r in got:
        packs.setdefault(r["pack_id"], []).append(r)
    sizes = [sum(r["bytes"] for r in p) for p in packs.values()]
    assert sum(s > 600 for s in sizes) <= 1 and len(packs) < 60
    for p in packs.values():
        at = 0
        for r in sorted(p, key=lambda r: r["first_row"]):
            assert r["pack_offset"] == at
            at += r["bytes"]
    seen, left = set(), set()
    for k, path, *_ in sorted(rows, key=lambda r: r[0]):
        place = (path or "").strip().replace("\\", "/").removeprefix("./")
        if place:
            (left if place in seen else set()).add(k)
            seen.add(place)
    assert {r[0] for r in K.left_out(df, written).collect()} == left and left


def test_no_files_to_compact(spark):
    df = spark.createDataFrame([(1, None, 3, "a", 1, 1, "x")], SHAPE)
    written = K.compact_table(df, [K.Dimension("kind")])
    assert written.count() == 0 and K.left_out(df, written).count() == 0


def test_digest_tells_lost_and_doubled_rows(spark):
    df = spark.range(100)
    assert K.row_digest(df, ["id"]) == K.row_digest(df.repartition(7), ["id"])
    assert K.row_digest(df, ["id"]) != K.row_digest(df.where("id > 0"), ["id"])
    assert K.row_digest(df, ["id"]) != K.row_digest(df.union(spark.range(1)), ["id"])


def test_kept_tables_grow_by_what_is_new(spark, tmp_path):
    kept = Kept(spark, "grows", str(tmp_path))
    assert kept.read() is None and kept.read_all() is None
    df = spark.createDataFrame([(1,), (2,)], "k int")
    for rows in (df.limit(0), df.limit(1), df.limit(0), df):
        kept.append(rows)
    assert len(kept._versions()) == 3 and sorted(r["k"] for r in kept.read_all().collect()) == [1, 1, 2]
    remove_path(spark, kept.path)

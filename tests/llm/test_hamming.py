import math
import random
from collections import defaultdict

import numpy as np
import pytest

from cepage.llm import hamming as H
from cepage.llm import overlap as O
from cepage.llm.bits import flip_masks, ranges


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def near(h, most, rng):
    for b in rng.sample(range(64), rng.randint(0, most)):
        h ^= 1 << b
    return h


def hashes(n, seed, most=9, skew=False):
    """Random hashes with copies and neighbours; with skew a third of all share most of their bits."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if out and k % 3 == 0:
            out.append(near(rng.choice(out), most, rng))
        elif skew and k % 3 == 1:
            out.append((0xABCDEF << 40) | rng.getrandbits(20))
        else:
            out.append(rng.getrandbits(64))
    return out


def brute(hs, most):
    return {(min(a, b), max(a, b)) for i, a in enumerate(hs) for b in hs[:i] if a != b and (a ^ b).bit_count() <= most}


def test_thresholds_add_up_to_the_pigeonhole_bound():
    flat = np.ones((8, 256))
    for rows in (100, 300_000, 10**9):
        for total in (0, 3, 4, 6, 10, 20):
            w = H.block_width(total)
            parts = H.allocate(np.ones((64 // w, 1 << w)), rows, total)
            assert sum(p.threshold + 1 for p in parts) == total + 1
    assert max(p.blocks for p in H.allocate(flat, 10**9, 6)) >= max(p.blocks for p in H.allocate(flat, 100, 6))


def test_a_hot_block_gets_no_weight():
    hot = np.ones((8, 256))
    hot[0] = 0
    hot[0, 7] = 256
    parts = H.allocate(hot, 1_000_000, 3)
    assert not any(s == (0, 1) for p in parts for s in p.subs if p.blocks == 1)


def test_correlated_bits_share_a_block():
    rng = np.random.default_rng(1)
    b = rng.integers(0, 2, (4000, 64))
    b[:, 40] = b[:, 3]
    both = (b.T @ b).astype(float)
    order = H.correlated_order(both, len(b)).tolist()
    assert sorted(order) == list(range(64))
    assert order.index(3) // 8 == order.index(40) // 8


def test_permute_and_restore():
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, 100)
    order = rng.permutation(64)
    assert (H.restore(H.permute(h, order), order) == h).all()


@pytest.mark.parametrize(("skew", "max_bucket"), [(False, 2_000_000), (True, 2_000_000), (True, 40)])
def test_all_close_pairs_come_out_once(spark, skew, max_bucket):
    data = {"x": (hashes(500, 1, skew=skew), 4), "y": (hashes(500, 2, skew=skew), 6)}
    rows = [(k, signed(h)) for k, (hs, _) in data.items() for h in set(hs)] + [("x", None), ("z", 5)]
    df = spark.createDataFrame(rows, "kind string, h bigint")
    found = H.close_classes(df, {k: m for k, (_, m) in data.items()}, max_bucket=max_bucket, chunk=50, block=64).collect()
    got = defaultdict(list)
    for r in found:
        got[r["kind"]].append((r["h_a"], r["h_b"]))
    for k, (hs, m) in data.items():
        assert len(got[k]) == len(set(got[k]))
        assert {frozenset((a % 2**64, b % 2**64)) for a, b in got[k]} == {frozenset(p) for p in brute(list(set(hs)), m)}


def test_wide_distances(spark):
    hs = hashes(260, 9, most=12)
    df = spark.createDataFrame([("x", signed(h)) for h in set(hs)], "kind string, h bigint")
    for most in (0, 9):
        got = [(r["h_a"], r["h_b"]) for r in H.close_classes(df, {"x": most}, chunk=50).collect()]
        assert len(got) == len(set(got)) and {frozenset((a % 2**64, b % 2**64)) for a, b in got} == {frozenset(p) for p in brute(list(set(hs)), most)}
    with pytest.raises(ValueError):
        H.close_classes(df, {"x": 40})


def test_copies_nulls_repeats_extra_columns_and_empty(spark):
    shape = "id string, dh bigint, kind string, h string, n int"
    rows = [("a", 7, "k", "h", 1), ("a", 7, "k", "h", 2), ("b", 7, None, None, None), ("c", 6, "", "", 0), (None, 7, "", "", 0), ("d", None, "", "", 0), ("e", -1, "", "", 0)]
    df = spark.createDataFrame(rows, shape)
    pairs, members = H.near_duplicates(df, "id", {"dh": "dh"}, {"dh": 1})
    assert {tuple(r) for r in H.expand_pairs(pairs, members).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    pairs, members = H.near_duplicates(spark.createDataFrame([], shape), "id", {"dh": "dh"}, {"dh": 1})
    assert H.expand_pairs(pairs, members).collect() == []


def spans_of(x):
    """Places of the spans of at least eight set bits of a 64-bit number."""
    found, k = set(), 0
    while k < 64:
        n = k
        while n < 64 and x >> n & 1:
            n += 1
        if n - k >= 8:
            found |= set(range(k, n))
        k = max(n, k + 1)
    return found


@pytest.mark.parametrize("max_bucket, hot_rows, total", [(2_000_000, 200_000, 6), (9, 3, 6), (9, 3, 11), (2_000_000, 200_000, 0)])
def test_cross_split_overlaps_against_brute_force(spark, max_bucket, hot_rows, total, monkeypatch):
    rng = random.Random(5)
    hs = hashes(360, 3)
    rows = [(f"r{k:03d}", rng.choice(["train", "validation", "test", None]), rng.choice(["d1", "d2", None, None, None, None, f"u{k}"]), signed(h) if k % 17 else None) for k, h in enumerate(hs)]
    original = O.shared_spans
    monkeypatch.setattr(O, "shared_spans", lambda c, t: original(c, t, max_bucket=max_bucket, chunk=50, block=64))
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:20]], "id string, split string, digest string, h bigint, in_train string")
    want, cover = set(), {}
    for i, s, d, h in rows:
        for j, t, e, g in rows:
            if s in ("validation", "test") and t == "train":
                near = h is not None and g is not None and ((h ^ g) % 2**64).bit_count() <= total
                whole = d is not None and d == e
                if near or whole:
                    want.add((i, j))
                    cover[i] = cover.get(i, set()) | (set(range(64)) if whole else set()) | (spans_of(~(h ^ g) % 2**64) if near else set())
    got = [(r["eval_id"], r["train_id"]) for r in O.cross_split_overlaps(df, total, hot_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    report = {r["split"]: r for r in O.overlap_report(df, ["split"], total, hot_rows).collect()}
    for s in ("validation", "test"):
        own = [i for i, t, _, _ in rows if t == s]
        hit = [len(cover[i]) for i in own if i in cover]
        r = report[s]
        assert (r["n_records"], r["n_overlapping"], r["n_whole"], r["covered_places"]) == (len(own), len(hit), hit.count(64), sum(hit))


def test_seeds_follow_the_collection():
    """Candidates per pair of texts fall as the collection grows."""
    flat = np.ones((8, 256))
    share = []
    for rows in (10**4, 10**7, 10**11):
        parts = H.allocate(flat * rows / 256, rows, 6, rows // 10, rows * rows * 0.09)
        assert sum(p.threshold + 1 for p in parts) == 7
        share.append(sum(sum(math.comb(8 * p.blocks, e) for e in range(p.threshold + 1)) / 2 ** (8 * p.blocks) for p in parts))
    assert share[0] >= share[1] >= share[2] and share[2] < 1 / 100_000


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "id string, split string, digest string, h bigint")
    assert O.cross_split_overlaps(df).collect() == [] and O.overlap_report(df, ["split"]).collect() == []


def test_ranges_and_masks():
    left, right = np.array([0, 5, 5, 9]), np.array([3, 5, 9, 10])
    got = [(int(k), int(i)) for a, b in ranges(left, right, 2) for k, i in zip(a, b, strict=True)]
    assert got == [(k, i) for k in range(4) for i in range(left[k], right[k])]
    assert len(flip_masks(8, 2)) == 37 and flip_masks(8, 1)[0] == 0

import math
import random
import uuid
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cepage.functions import scalars as S
from cepage.functions.frames import partition_of
from cepage.operators import aggregates as A
from cepage.operators import components as C
from cepage.operators import inference as I
from cepage.operators import joins as J
from cepage.operators import metrics as M
from cepage.operators import provenance as P
from cepage.operators import review as R
from cepage.operators import splitting as Sp
from cepage.operators import windows as W

NS = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def one(spark, shape, row, expression):
    return spark.createDataFrame([row], shape).select(expression).first()[0]


def test_name_based_identifiers(spark):
    assert one(spark, "x string", ("é/1",), S.uuid5(NS, F.col("x"))) == str(uuid.uuid5(uuid.UUID(NS), "é/1"))
    pair = S.pair_id(NS, F.col("a"), F.col("b"))
    assert one(spark, "a string, b string", ("p", "q"), pair) == one(spark, "a string, b string", ("q", "p"), pair) == str(uuid.uuid5(uuid.UUID(NS), "p:q"))
    assert one(spark, "a string, b string", ("p", None), pair) is None
    group = S.group_id(NS, F.col("m"))
    assert one(spark, "m array<string>", (["z"],), group) == "z"
    assert one(spark, "m array<string>", (["z", "a", "z", None],), group) == str(uuid.uuid5(uuid.UUID(NS), "a:z"))
    assert one(spark, "m array<string>", ([],), group) is None
    assert one(spark, "x string", (f"{U.upper()}___leaf 7",), S.prefix_uuid(F.col("x"))) == U
    assert one(spark, "x string", ("scan 7",), S.prefix_uuid(F.col("x"))) is None


U = "3f2504e0-4f89-41d3-9a0c-0305e82c3301"


def test_hamming_of_hex_text(spark):
    d = S.hamming_hex(F.col("a"), F.col("b"))
    assert one(spark, "a string, b string", ("0f", "07"), d) == one(spark, "a string, b string", ("07", "0f"), d) == 1
    assert one(spark, "a string, b string", ("f" * 16, "0" * 16), d) == 64
    with pytest.raises(Exception, match="width"):
        one(spark, "a string, b string", ("0f", "0"), d)


def test_predicates(spark):
    dates = {"2026-02-03": True, "2026-2-3": False, "2026-02-30": False, "": False, None: False, "2024-02-29": True, "2026/02/03": False}
    for text, want in dates.items():
        assert one(spark, "x string", (text,), S.is_iso_date(F.col("x"))) is want
    inside = {"a/b": (True, True), "..": (False, False), "a/../..": (False, False), "a/..": (True, False), "/a": (False, False), "C:\\a": (False, False), "a/../b": (True, True)}
    for text, want in inside.items():
        assert (one(spark, "x string", (text,), S.stays_inside(F.col("x"))), one(spark, "x string", (text,), S.stays_inside(F.col("x"), False))) == want
    v = S.variant_suffix(F.col("x"), ["flipLR", "90deg", "new90deg"])
    assert [one(spark, "x string", (t,), v) for t in ("a_FLIPlr", "a_new90deg", "a_90deg_b", "a90deg")] == ["FLIPlr", "new90deg", None, None]
    p = S.valid_probabilities(F.col("p"), 2)
    for row, want in (([0.5, 0.5], True), ([0.5, 0.50001], True), ([0.5, 0.6], False), ([float("nan"), 1.0], False), ([None, 1.0], False), ([1.0], False), (None, False), ([float("inf"), 0.0], False)):
        assert one(spark, "p array<double>", (row,), p) is want


def test_arrays_and_schedules(spark):
    assert one(spark, "x array<double>", ([1.0, 3.0, 3.0],), S.argmax_lowest(F.col("x"))) == 1
    assert sum(one(spark, "x array<double>", ([1000.0, 1001.0],), S.softmax(F.col("x")))) == pytest.approx(1)
    assert one(spark, "a array<double>, b array<double>", ([0.0], [1.0]), S.cosine(F.col("a"), F.col("b"))) == 0.0
    assert one(spark, "b array<boolean>", ([True, False, False, False, False, False, False, True],), S.bits_to_hex(F.col("b"))) == "81"
    assert one(spark, "n int", (196,), S.top_count(F.col("n"), 0.125)) == 24
    assert one(spark, "x double", (float("nan"),), S.fixed_text(F.col("x"), 2)) == ""
    assert one(spark, "x double", (1.005,), S.min_max(F.col("x"), F.col("x"), F.col("x"))) == 1.0
    n, k = 300, 141
    want = sum(math.comb(n, i) for i in range(k + 1)) / 2**n
    assert one(spark, "n int, k int", (n, k), S.binomial_lower_tail(F.col("n"), F.col("k"))) == pytest.approx(want, rel=1e-9)


def test_numeric_members_of_json(spark):
    got = one(spark, "x string", ('{"a": 1, "b": "2.5", "c": true, "d": "x", "e": null}',), S.numeric_entries(F.col("x")))
    assert got == {"a": 1.0, "b": 2.5, "c": 1.0}
    assert one(spark, "a double, b double", (0.2, 0.0), S.relative_completeness(F.col("a"), F.col("b"))) == pytest.approx(2e5)


def test_holm_and_mcnemar(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None), ("g", "a", 0.9)], "family string, k string, p double")
    got = {(r["family"], r["k"]): r["p_holm"] for r in I.holm(df, ["family"], "p", ["k"]).collect()}
    assert got[("f", "a")] == pytest.approx(0.03) and got[("f", "b")] == got[("f", "c")] == pytest.approx(0.06) and got[("f", "d")] is None and got[("g", "a")] == 0.9
    pairs = spark.createDataFrame([("x", True, False), ("x", False, True), ("x", True, True), ("y", True, True), ("x", None, True)], "c string, correct_left boolean, correct_right boolean")
    got = {r["c"]: (r["discordant"], r["p_value"]) for r in I.mcnemar(pairs, ["c"]).collect()}
    assert got == {"x": (2, 1.0), "y": (0, 1.0)}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "c string, s int, g string, true_class int, predicted_class_left int, predicted_class_right int")


def test_paired_matched_and_assembled(spark):
    rows = [("a", 1, True), ("b", 1, False), ("a", 2, True), ("b", 3, True), ("c", 1, True), ("a", None, False)]
    df = spark.createDataFrame(rows, "s string, k int, y boolean")
    grid = I.comparison_grid(spark, ["a", "b"], ["f"])
    pairs = I.paired(df, "s", grid, ["k"], "y")
    assert {(r["k"], r["y_left"], r["y_right"]) for r in pairs.collect()} == {(1, True, False), (2, True, None), (3, None, True), (None, False, None)}
    assert I.matched(pairs, ["family", "left", "right"], ["k"], "y").count() == 1
    with pytest.raises(ValueError, match="repeated"):
        I.matched(pairs.union(pairs), ["family", "left", "right"], ["k"], "y")
    results = spark.createDataFrame([(3, "f", 0.04), (1, "g", 0.5), (2, "f", 0.01), (4, "f", None)], "i int, family string, p double")
    got = [(r["i"], r["family_position"], r["position"], r["p_holm"]) for r in I.assembled(results, "i", "family", "p", []).orderBy("position").collect()]
    assert got == [(1, 1, 1, 0.5), (2, 2, 2, 0.02), (3, 2, 3, 0.04), (4, 2, 4, None)]


def test_bootstrap_of_equal_and_of_different_systems(spark):
    same = [("same", s, f"g{k % 7}", k % 3, (k * s) % 3, (k * s) % 3) for s in (1, 2) for k in range(40)]
    better = [("better", s, f"g{k % 7}", k % 3, k % 3, (k + s) % 3) for s in (1, 2) for k in range(40)]
    got = {r["c"]: r for r in I.crossed_bootstrap(predictions(spark, same + better), ["c"], "s", "g", 3, resamples=300, block=70).collect()}
    assert (got["same"]["difference"], got["same"]["ci_low"], got["same"]["ci_high"], got["same"]["p_value"]) == (0, 0, 0, 1)
    assert got["better"]["difference"] > 0.9 and got["better"]["ci_low"] > 0.5 and got["better"]["p_value"] < 0.02 and got["better"]["resamples"] == 300
    again = {r["c"]: r for r in I.crossed_bootstrap(predictions(spark, (same + better)[::-1]).repartition(5), ["c"], "s", "g", 3, resamples=300, block=70).collect()}
    assert again["better"]["ci_low"] == pytest.approx(got["better"]["ci_low"])


def test_bootstrap_point_and_spread_do_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [("c", s, f"g{k % 30}", k % 3, rng.choice([k % 3, rng.randrange(3)]), rng.randrange(3)) for s in (1, 2, 3) for k in range(120)]

    def f1(chosen, side):
        return np.mean([2 * sum(r[3] == r[side] == k for r in chosen) / max(1, sum(r[3] == k for r in chosen) + sum(r[side] == k for r in chosen)) for k in range(3)])

    point = np.mean([f1([r for r in rows if r[1] == s], 4) - f1([r for r in rows if r[1] == s], 5) for s in (1, 2, 3)])
    one_, many = (I.crossed_bootstrap(predictions(spark, rows), ["c"], "s", "g", 3, resamples=600, task_groups=n).first() for n in (1000, 4))
    assert one_["difference"] == pytest.approx(point)
    for c in ("difference", "ci_low", "ci_high", "p_value", "resamples"):
        assert one_[c] == pytest.approx(many[c], abs=1e-12)
    # The literal way: rows of drawn groups for every drawn seed.
    draw = random.Random(5)
    by = {}
    for r in rows:
        by.setdefault((r[1], r[2]), []).append(r)
    plain = []
    for _ in range(300):
        gs = [f"g{draw.randrange(30)}" for _ in range(30)]
        plain.append(np.mean([f1(c, 4) - f1(c, 5) for c in ([r for g in gs for r in by[(s, g)]] for s in (draw.choice((1, 2, 3)) for _ in range(3)))]))
    assert one_["ci_low"] == pytest.approx(np.quantile(plain, 0.025), abs=0.06) and one_["ci_high"] == pytest.approx(np.quantile(plain, 0.975), abs=0.06)


def test_row_numbers_and_sums_without_gathering(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), F.when(F.col("id") % 3 > 0, "hot").alias("g")).repartition(7)
    got = [r["n"] for r in W.global_row_number(df, ["v"], "n").orderBy("v").collect()]
    assert got == list(range(1, 501))
    rows = df.collect()
    for r in W.sums_before(df, ["g"], "v", "v", "b").collect():
        assert r["b"] == sum(x["v"] for x in rows if x["g"] == r["g"] and x["v"] < r["v"])


def test_perfect_and_missing_classes(spark):
    df = spark.createDataFrame([("m", k % 2, k % 2) for k in range(8)] + [("m", None, 1)], "m string, true_class int, predicted_class int")
    row = M.summary(df, ["m"], 3).first()
    assert row["accuracy"] == 1 and row["macro_f1"] == pytest.approx(2 / 3) and row["n"] == 8
    assert M.confusion(df, ["m"], 3).count() == 9


def test_auc_with_ties_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6) / 5, rng.random() < 0.4) for _ in range(120)]
    df = spark.createDataFrame([("g", *r) for r in rows] + [("h", 1.0, True), ("g", None, True)], "g string, score double, y boolean")
    got = {r["g"]: r["auc"] for r in M.roc_auc(df, ["g"], "score", F.col("y")).collect()}
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got["g"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) and got["h"] is None


def test_calibration_bins_at_edges(spark):
    rows = [(k / 15, True) for k in range(16)] + [(None, True), (float("nan"), False)]
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, c double, y boolean")
    got = {r["bin"]: r["n"] for r in M.calibration_bins(df, ["g"], F.col("c"), F.col("y")).collect()}
    assert got == {k: 1 for k in range(14)} | {14: 2}


def test_summaries(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None), ("b", None)], "g string, v double")
    got = {r["g"]: r for r in A.seed_summary(df, ["g"], "v").collect()}
    assert set(got) == {None, "a"} and got["a"]["std"] == 0 and got["a"]["ci_low"] == 5
    assert got[None]["ci_high"] == pytest.approx(2 + 1.96 * math.sqrt(2) / math.sqrt(2))
    m = A.population_moments(df, ["g"], F.col("v")).where("g is null").first()
    assert (m["mean"], m["std"]) == (2, 1)
    assert A.checks(df.limit(0), {"x": F.col("v") > 0}).first().asDict() == {"x": True, "passed": True}
    assert A.checks(df, {"x": F.col("v") > 0}).first()["passed"] is False
    d = A.class_dictionary(spark.createDataFrame([(0, "a"), (2, "b"), (None, "c")], "k int, n string"), "k", "n").collect()
    assert [r["contiguous"] for r in sorted(d)] == [True, False]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "k int, b string")
    assert J.one_to_one(a, b, ["k"]).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        J.one_to_one(a.union(a), b, ["k"])
    with pytest.raises(Exception, match="key not found"):
        J.many_to_one(a, b, ["k"], required=True).collect()
    assert {r["k"]: r["match"] for r in J.match_indicator(a, b, ["k"]).collect()} == {1: "both", 2: "left_only", 3: "right_only"}
    assert not J.same_keys(a, b, "k") and J.same_keys(a, a, "k")


def test_hamming_join_against_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(60)]
    hs = base + [h ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 8))) for h in base]
    df = spark.createDataFrame([(f"i{k:03d}", h, None if k % 9 == 0 else h ^ (k % 3)) for k, h in enumerate(hs)], "id string, dhash bigint, phash bigint")
    df = df.union(df.where("id < 'i004'").selectExpr("concat('z', id)", "dhash", "phash"))
    got = {(r["a"], r["b"]): r["triggered_by"] for r in J.hamming_pairs(df, "id", {"dhash": 4, "phash": 6}).collect()}
    assert got == {(r["a"], r["b"]): r["triggered_by"] for r in J.hamming_pairs(df, "id", {"dhash": 4, "phash": 6}, hot_rows=1).collect()}
    want = {}
    rows = df.collect()
    for x, y in combinations(rows, 2):
        names = [n for n, m in (("dhash", 4), ("phash", 6)) if x[n] is not None and y[n] is not None and (x[n] ^ y[n]).bit_count() <= m]
        if names:
            want[(x["id"], y["id"])] = "+".join(names)
    assert got == want and want


@pytest.mark.parametrize("most", [0, 1, 2, 5, 11])
def test_close_hashes_of_any_distance(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(40)]
    hs = {h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 2))) for h in base for _ in range(3)}
    signed = [h - 2**64 if h >> 63 else h for h in hs]
    got = [tuple(r) for r in J.close_hashes(spark.createDataFrame([(h,) for h in signed] + [(None,)], "h bigint"), most).collect()]
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        J.close_hashes(spark.createDataFrame([], "h bigint"), 12)


@pytest.mark.parametrize(("most", "parts", "max_bucket"), [(1, 2, 3), (4, 2, 1000), (4, 3, 2), (6, 3, 1000), (6, 4, 4), (6, 7, 10), (11, 4, 1000), (11, 12, 20)])
def test_close_hashes_by_any_stretches_and_blocks(spark, most, parts, max_bucket):
    rng = random.Random(parts)
    base = [rng.getrandbits(64) for _ in range(25)] + [rng.getrandbits(9) << 50 for _ in range(12)]
    hs = {h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 2))) for h in base for _ in range(4)} | {0, 2**64 - 1, 2**63}
    signed = [h - 2**64 if h >> 63 else h for h in hs]
    got = [tuple(r) for r in J.close_hashes(spark.createDataFrame([(h,) for h in signed], "h bigint"), most, max_bucket, parts).collect()]
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_hamming_join_has_a_small_plan_and_few_copies(spark):
    df = spark.range(40).selectExpr("cast(id as string) id", "id * 7 dhash", "id * 11 phash")
    plan = J.hamming_pairs(df, "id", {"dhash": 4, "phash": 6})._jdf.queryExecution().executedPlan().toString()
    # The driver plans, compiles and reports each exchange; the text of this plan named 37.
    assert plan.count("Exchange") <= 8
    # Five and seven copies of a hash are shuffled, not one per changed value.
    for most in range(1, 12):
        for rows in (10, 300_000, 10**8):
            cuts = J._stretches(most, J._cheapest(most, rows))
            assert sum(len(J._pieces(*c)) for c in cuts) == most + 1 and cuts[0][0] == 0 and cuts[-1][1] == 64 and max(b - a for a, b, _ in cuts) <= 32


def test_hamming_join_of_repeated_keys(spark):
    rows = [("a", 0, 255), ("a", 1, 0), ("b", 3, None), ("b", 3, None), ("c", 15 << 20, 0), (None, 0, 0)]
    got = sorted(tuple(r) for r in J.hamming_pairs(spark.createDataFrame(rows, "id string, dhash bigint, phash bigint"), "id", {"dhash": 4, "phash": 6}).collect())
    assert got == [("a", "b", 1, None, "dhash"), ("a", "c", 4, 0, "dhash+phash")]


@pytest.mark.parametrize("in_one_task", [0, 15, 1000])
def test_components_of_chains_and_singletons(spark, in_one_task):
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(40)] + [(None,)], "node string")
    edges = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(10, 30)] + [("n00", "zz"), ("n05", "n05"), (None, "n01")], "a string, b string")
    got = {r["node"]: r["root"] for r in C.smallest_labels(nodes, edges, in_one_task=in_one_task).collect()}
    assert len(got) == 40 and {got[f"n{k:02d}"] for k in range(10, 31)} == {"n10"} and got["n00"] == "n00"


def test_review_consolidation(spark):
    manifest = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "y")], "image_id string, class_name string")
    candidates = spark.createDataFrame([("p", "1", "2", "x", "x"), ("q", "2", "3", "x", "x"), ("r", "3", "4", "x", "y")], "candidate_pair_id string, image_id_a string, image_id_b string, class_name_a string, class_name_b string")
    shape = "candidate_pair_id string, image_id_a string, image_id_b string, decision string, date string, reason string"
    good = [("p", "1", "2", "confirmed_related", "2026-01-02", "r"), ("q", "2", "3", " Confirmed_Same_Source", "2026-01-02", "r"), ("r", "3", "4", "rejected", "2026-01-02", "r")]
    allowed = ["confirmed_related", "confirmed_same_source", "rejected"]
    violations = lambda rows: {r[0]: r[1] for r in R.review_checks(manifest, candidates, spark.createDataFrame(rows, shape), allowed, ["reason"]).collect() if r[1]}
    assert violations(good) == {}
    bad = [("p", "2", "1", "", "2026-1-2", " "), ("q", "2", "3", "rejected", "2026-01-02", "r")]
    assert violations(bad) == {"coverage": 1, "decision_not_allowed": 1, "blank_fields": 1, "dates": 1, "pair_identity": 1}
    members, torn = R.consolidate(manifest, spark.createDataFrame(good, shape), allowed[:2], NS)
    groups = {r["image_id"]: (r["group_id"], r["size"]) for r in members.collect()}
    assert groups["1"] == groups["2"] == groups["3"] == (str(uuid.uuid5(uuid.UUID(NS), "1:2:3")), 3) and groups["4"] == ("4", 1)
    assert torn.count() == 0
    # Any failed check, and nothing comes out.
    whole = lambda rows, blocking=(): R.consolidate_checked(manifest, candidates, spark.createDataFrame(rows, shape), allowed, ["reason"], allowed[:2], NS, blocking)
    assert whole(good)[1].count() == 4 and {r["check"]: r["n_violations"] for r in whole(good)[0].collect()}["mixed_groups"] == 0
    for rows in (bad, good[:2], [*good[:2], (*good[2][:5], None)], [*good[:2], (*good[2][:4], "2026-02-30", "r")], [*good[:2], ("r", "3", "4", "confirmed_related", "2026-01-02", "r")], good + good[:1]):
        assert whole(rows)[1].collect() == []
    assert whole(good, ("rejected",))[1].collect() == []


def test_best_so_far_near_ties(spark):
    rows = [("a", 1, 0.5, 1.0), ("a", 2, 0.505, 0.9), ("a", 3, 0.505, 0.8), ("a", 4, 0.505, 0.85), ("a", 5, 0.4, 0.1), ("a", 6, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "r string, e int, s double, l double")
    got = W.best_so_far(df, ["r"], "e", "s", "l", 0.01, 10).first()
    assert (got["best_epoch"], got["accepted"], got["last_epoch"]) == (6, 4, 6)
    stopped = W.best_so_far(df, ["r"], "e", "s", "l", 0.01, 2).first()
    assert (stopped["best_epoch"], stopped["last_epoch"]) == (3, 5)


def test_grouped_split_is_reproducible_and_feasible(spark):
    groups = spark.createDataFrame([(f"g{c}{k:02d}", f"c{c}", 1 + k % 3) for c in range(4) for k in range(20)], "group_id string, class_name string, size int")
    goal = Sp.SplitGoal(class_tolerance=5.0, overall_tolerance=2.0)
    one_, report = Sp.optimise_split(groups, 60, goal=goal)
    two, _ = Sp.optimise_split(groups.repartition(3), 60, goal=goal)
    assert sorted(map(tuple, one_.collect())) == sorted(map(tuple, two.collect()))
    assert report["violations"] == 0 and one_.count() == 80
    with pytest.raises(ValueError):
        Sp.optimise_split(groups.limit(0), 3)


def test_sampling_ranks_and_trapezoid(spark):
    df = spark.createDataFrame([("a", f"k{k}", float(k), 1.0) for k in range(5)] + [("b", "z", 1.0, 1.0), ("a", None, 1.0, 1.0)], "c string, k string, x double, y double")
    assert W.stratified_sample(df, "c", "k", 3, 1, allow_short=True).groupBy("c").count().orderBy("c").collect() == [("a", 3), ("b", 1)]
    with pytest.raises(Exception, match="fewer than 3 rows in b"):
        W.stratified_sample(df, "c", "k", 3, 1).collect()
    areas = {r["c"]: r["auc"] for r in W.trapezoid_area(df, ["c"], "x", "y", "k", allow_empty=True).collect()}
    assert areas == {"a": 1.0, "b": None}
    with pytest.raises(Exception, match="no length"):
        W.trapezoid_area(df, ["c"], "x", "y", "k").collect()


def test_ranks_and_quantiles_of_ties_nulls_and_one_large_group(spark):
    rng = random.Random(8)
    rows = [("big" if k % 3 else rng.choice(["a", None]), k, float(rng.randrange(40)) if k % 11 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {r["k"]: r["mean_rank"] for r in W.average_rank(df, ["g"], "v").collect()}
    for g in ("big", "a", None):
        own = sorted((v is not None, v or 0.0) for h, _, v in rows if h == g)
        for h, k, v in rows:
            if h == g:
                at = [n for n, x in enumerate(own, 1) if x == (v is not None, v or 0.0)]
                assert got[k] == sum(at) / len(at)
    q = {r["g"]: r for r in W.interpolated_quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for g in ("big", "a", None):
        own = [v for h, _, v in rows if h == g and v is not None]
        assert [q[g][c] for c in ("low", "mid", "top")] == pytest.approx(np.quantile(own, [0.1, 0.5, 1.0]).tolist())
    assert W.interpolated_quantiles(df.limit(0), ["g"], "v", {"x": 0.5}).collect() == []
    assert W.average_rank(df.limit(0), ["g"], "v").collect() == []


def test_weights_draws_partitions_and_deviations(spark):
    df = spark.createDataFrame([("a", k) for k in range(6)] + [("b", 10), (None, 11)], "c string, k int")
    for hot_rows in (2, 100):
        weights = {r["k"]: r["weight"] for r in W.inverse_frequency(df, "c", hot_rows).collect()}
        assert weights == {k: 1 / 6 for k in range(6)} | {10: 1.0}
    weighted = W.inverse_frequency(df, "c")
    drawn = [r["k"] for r in W.weighted_draws(weighted, "k", "weight", 4000, 7).collect()]
    assert len(drawn) == 4000 and abs(drawn.count(10) / 4000 - 0.5) < 0.03 and set(drawn) == {*range(6), 10}
    assert sorted(drawn) == sorted(r["k"] for r in W.weighted_draws(weighted.repartition(7), "k", "weight", 4000, 7).collect())
    assert W.weighted_draws(weighted.limit(0), "k", "weight", 5, 7).collect() == []
    with pytest.raises(ValueError, match="no rows with c = z"):
        partition_of(df, "c", "z")
    with pytest.raises(Exception, match="no deviation"):
        A.channel_moments(spark.createDataFrame([("g", [1.0, 2.0]), ("g", [1.0, 3.0])], "g string, v array<double>"), ["g"], F.col("v")).collect()


def test_provenance(spark, tmp_path):
    shape = "name string, digest string"
    a = spark.createDataFrame([("x", "AB"), ("y", "cd"), ("z", "1")], shape)
    b = spark.createDataFrame([("x", "ab"), ("y", "ce"), ("w", "1")], shape)
    assert {tuple(r) for r in P.verify_digests(a, b).collect()} == {("y", "different"), ("z", "missing"), ("w", "unexpected")}
    (tmp_path / "a").write_text("1")
    first = P.tree_digest(tmp_path)
    (tmp_path / "b").write_text("2")
    assert P.tree_digest(tmp_path) != first and P.code_version(tmp_path).startswith("tree-")
    assert P.run_identity({"b": 1, "a": 2}, {}) == P.run_identity({"a": 2, "b": 1}, {}) and len(P.run_identity({}, {})) == 20
    assert P.overlay({"a": 1, "b": 2}, {"b": 3, "c": 4}, drop=("c",)) == {"a": 1, "b": 3}
    with pytest.raises(KeyError):
        P.first_present({"a": None}, ["a", "b"])


def test_groups_beyond_the_bound_are_laid_out(spark):
    rows = [(f"g{k:04d}", f"c{k % 2}", 1 + k % 7) for k in range(2000)]
    groups = spark.createDataFrame(rows, "group_id string, class_name string, size int")
    got, report = Sp.optimise_split(groups, 20, max_groups=300)
    found = got.collect()
    assert sorted((r["group_id"], r["class_name"], r["size"]) for r in found) == rows
    assert (report["searched"], report["laid_out"]) == (300, 1700)
    for c in ("c0", "c1"):
        of = [r for r in found if r["class_name"] == c]
        assert abs(sum(r["size"] for r in of if r["split"] == "train") / sum(r["size"] for r in of) - 0.7) < 0.02


def test_side_by_side_placement_equals_one_by_one():
    sizes, classes, goal = np.array([1.0, 2.0, 5.0, 3.0]), np.array([0, 0, 1, 2]), Sp.SplitGoal()
    kinds = np.arange(400) % 4
    order, chosen = Sp.place([np.random.default_rng([9, k]) for k in range(3)], kinds, sizes, classes, goal)
    shares = np.array(goal.shares)
    want = shares * np.bincount(classes[kinds], weights=sizes[kinds])[:, None]
    for kind, split in zip(order, chosen, strict=True):
        have = np.zeros((3, 3))
        for g, s in zip(kind, split, strict=True):
            def cost(at, n=sizes[g], b=classes[g], have=have):
                more = have.copy()
                more[b, at] += n
                return (((more.sum(axis=0) - want.sum(axis=0)) / want.sum(axis=0)) ** 2).sum() + 2.0 * (((more[b] - want[b]) / want[b]) ** 2).sum()
            costs = [cost(at) for at in range(3)]
            assert costs[s] <= min(costs) + 1e-9
            have[classes[g], s] += sizes[g]


def test_registered_split_takes_all_images(spark, data):
    from cepage.plans.analytics import x07_grouped_split
    from cepage.sources.tables import held_images, table

    groups = x07_grouped_split(spark, data).collect()
    assert len({r["group_id"] for r in groups}) == len(groups) and {r["split"] for r in groups} == {"train", "validation", "test"}
    assert sum(r["size"] for r in groups) == held_images(table(spark, data, "image_record")).count()

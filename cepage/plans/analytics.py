"""Queries on the star schema, events and embeddings: summaries, rankings, ordered scans and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cepage.functions import normalise as N
from cepage.functions import scalars as S
from cepage.operators import aggregates as A
from cepage.operators import joins as J
from cepage.operators import splitting
from cepage.operators import windows as W
from cepage.session import parallelism
from cepage.sources.tables import held_images, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, coalesce(stddev_samp(l_extendedprice), 0) AS std FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, l_linestatus, n, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - 1.96 * std / sqrt(n), 4) AS ci_low, round(mean + 1.96 * std / sqrt(n), 4) AS ci_high FROM s""")
def a08_lineitem_summary(spark, sf):
    return _rounded(A.seed_summary(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


_EVENT = "events"


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT label, channel::INT AS channel, count(*)::DOUBLE AS n, round(avg(v), 6) AS mean, round(sqrt(greatest(0, avg(v * v) - avg(v) * avg(v))), 6) AS std FROM x GROUP BY ALL""")
def a10_channel_moments(spark, sf):
    return _rounded(A.channel_moments(table(spark, sf, "embeddings"), ["label"], F.col("embedding")))


@query("""WITH e AS (SELECT event_type, user_id % 5 AS rep, value FROM events), r AS (SELECT event_type, rep, avg(value) AS m, max(value) AS peak FROM e GROUP BY ALL),
  b AS (SELECT event_type, coalesce(stddev_samp(m), 0) AS std_between, max(peak) AS peak, count(*) AS repetitions FROM r GROUP BY ALL)
  SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(any_value(std_between), 6) AS std_between, round(quantile_cont(value, 0.5), 6) AS median,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(16000.0::DOUBLE / avg(value), 6) AS throughput, round(any_value(peak), 6) AS peak, any_value(repetitions) AS repetitions FROM e JOIN b USING (event_type) GROUP BY event_type""")
def a19_latency_summary(spark, sf):
    events = table(spark, sf, "events").withColumn("rep", F.col("user_id") % 5)
    return _rounded(A.latency_summary(events, ["event_type"], "rep", "value", 16))


@query("""WITH s AS (SELECT o_orderpriority, o_orderstatus, count(o_totalprice) AS n, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS std FROM orders GROUP BY ALL)
  SELECT o_orderpriority, o_orderstatus, n, round(mean, 4) AS mean, round(std, 4) AS std, round(std / sqrt(greatest(n, 1)), 4) AS sem FROM s""")
def a21_epoch_summary(spark, sf):
    return _rounded(A.epoch_summary(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), 4)


@query("""WITH d AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
  SELECT event_type, count(DISTINCT user_id) AS seeds, round(avg(value), 6) AS final_mean, round(stddev_samp(value), 6) AS final_std, round(sum(value), 4) AS final_sum FROM d GROUP BY event_type""")
def a22_final_summary(spark, sf):
    last = W.last_row(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    out = last.groupBy("event_type").agg(F.count_distinct("user_id").alias("seeds"), F.round(F.avg("value"), 6).alias("final_mean"), F.round(F.stddev_samp("value"), 6).alias("final_std"), F.round(F.sum("value"), 4).alias("final_sum"))
    return out


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
def a25_quantiles(spark, sf):
    return _rounded(W.interpolated_quantiles(table(spark, sf, "events"), ["event_type"], "value", {"low": 0.025, "high": 0.975}))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean_loss, sum(l_quantity) AS samples, count(DISTINCT l_partkey) AS unique_items, count(l_partkey) - count(DISTINCT l_partkey) AS repeated_items FROM lineitem GROUP BY l_returnflag")
def a26_running_loss(spark, sf):
    return _rounded(A.running_loss(table(spark, sf, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", "l_partkey"), 9)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type HAVING count(*) > 10")
def a05_having(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).where("n > 10")


@query("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, rn AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS rn FROM orders) WHERE rn <= 2")
def w06_first_orders(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.first_rows(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT user_id, strftime(max((ts, event_id))[1], '%Y-%m-%d %H:%M:%S.%f') AS ts, max((ts, event_id))[2] AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def w07_last_event(spark, sf):
    return W.last_row(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["value"]).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("""SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS mean_rank FROM events""")
def w03_average_rank(spark, sf):
    return W.average_rank(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_type"], "value").drop("value")


@query("""WITH r AS (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, k)::DOUBLE AS ra, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, k)::DOUBLE AS rb
  FROM (SELECT *, l_orderkey * 1000000000000 + l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey AS k FROM lineitem))
  SELECT l_returnflag, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY l_returnflag""")
def w04_ordinal_correlation(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("k", F.expr("l_orderkey * 1000000000000 + l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey"))
    return _rounded(W.ordinal_correlation(rows, ["l_returnflag"], "l_quantity", "l_extendedprice", "k"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ra, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rb, greatest(1, round_even(count(*) OVER (PARTITION BY p_brand) * 0.1, 0)) AS k FROM part)
  SELECT p_brand, count(*) FILTER (WHERE ra <= k AND rb <= k) AS shared, round(count(*) FILTER (WHERE ra <= k AND rb <= k)::DOUBLE / count(*) FILTER (WHERE ra <= k OR rb <= k), 9) AS jaccard FROM r GROUP BY p_brand""")
def o05_top_overlap(spark, sf):
    return _rounded(W.top_overlap(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_size", "p_partkey", 0.10), 9)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS x, value AS y FROM events), s AS (SELECT user_id, x, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id))
  SELECT user_id, round(sum(a) / nullif(max(x) - min(x), 0), 6) AS auc FROM s GROUP BY user_id""")
def w08_trapezoid_area(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("x"), F.col("value").alias("y"))
    return _rounded(W.trapezoid_area(rows, ["user_id"], "x", "y", "event_id", allow_empty=True))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS x, value AS y FROM events), s AS (SELECT user_id, x, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
  u AS (SELECT user_id, sum(a) / nullif(max(x) - min(x), 0) AS auc FROM s GROUP BY user_id) SELECT user_id % 4 AS model, count(auc) AS n, round(avg(auc), 6) AS mean, round(coalesce(stddev_samp(auc), 0), 6) AS std FROM u GROUP BY ALL""")
def a24_area_summary(spark, sf):
    areas = w08_trapezoid_area(spark, sf).withColumn("model", F.col("user_id") % 4)
    return _rounded(areas.groupBy("model").agg(F.count("auc").alias("n"), F.avg("auc").alias("mean"), F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("std")), 5).select("model", "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  scan AS (SELECT user_id, k, value AS s, event_id AS best, 1 AS accepted, 0 AS waited, event_id AS last FROM e WHERE k = 1
    UNION ALL SELECT x.user_id, x.k, CASE WHEN good THEN x.value ELSE x.s END, CASE WHEN good THEN x.event_id ELSE x.best END, x.accepted + good::INT, CASE WHEN good THEN 0 ELSE x.waited + 1 END, x.event_id
    FROM (SELECT e.user_id, e.k, e.value, e.event_id, scan.s, best, accepted, waited, e.value > scan.s + 0.5 OR (abs(e.value - scan.s) <= 0.5 AND e.value > scan.s) AS good FROM scan JOIN e ON e.user_id = scan.user_id AND e.k = scan.k + 1 WHERE waited < 10) x)
  SELECT user_id, arg_max(best, k) AS best_epoch, arg_max(s, k) AS best_score, arg_max(accepted, k) AS accepted, arg_max(last, k) AS last_epoch FROM scan GROUP BY user_id""")
def w11_best_so_far(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", (-F.col("value")).alias("loss"))
    return W.best_so_far(rows, ["user_id"], "event_id", "value", "loss", 0.5, 10)


@query("""WITH s AS (SELECT l_suppkey, sum(l_quantity) AS volume, avg(l_discount) AS discount, count(*) AS n FROM lineitem GROUP BY ALL),
  b AS (SELECT min(volume) AS v0, max(volume) AS v1, min(discount) AS d0, max(discount) AS d1, min(n) AS n0, max(n) AS n1 FROM s),
  x AS (SELECT l_suppkey, coalesce((volume - v0)::DOUBLE / nullif(v1 - v0, 0), 1) AS volume_score, coalesce(1 - (discount - d0) / nullif(d1 - d0, 0), 1) AS discount_score, coalesce((n - n0)::DOUBLE / nullif(n1 - n0, 0), 1) AS n_score FROM s, b)
  SELECT l_suppkey, round(volume_score, 9) AS volume_score, round(discount_score, 9) AS discount_score, round(n_score, 9) AS n_score, round((volume_score + discount_score + n_score) / 3, 9) AS score FROM x""")
def w12_min_max_scores(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("volume"), F.avg("l_discount").alias("discount"), F.count("*").alias("n"))
    return _rounded(W.min_max_scores(sums, "l_suppkey", {"volume": True, "discount": False, "n": True}), 9)


@query("SELECT p_type, arg_min(p_partkey, (-p_retailprice, p_size, p_partkey)) AS best_part FROM part GROUP BY p_type")
def o02_best_by_key(spark, sf):
    key = F.struct(-F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey"))
    return table(spark, sf, "part").groupBy("p_type").agg(F.min_by("p_partkey", key).alias("best_part"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def o04_top_one(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select("p_partkey", "p_retailprice")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""")
def o06_pivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in ("F", "O", "P")))


# The order in which a report shows the priorities; one of them is never met.
SHOWN = ["1-URGENT", "2-HIGH", "0-NONE", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT s.p AS o_orderpriority, s.k::INT AS place, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{p}', {k})" for k, p in enumerate(SHOWN)) + ") AS s(p, k) LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) ON o_orderpriority = s.p")
def o06_fixed_order(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return W.reindexed(counts, "o_orderpriority", SHOWN, {"n": 0})


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem")
def u01_union_all(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).unionByName(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u05_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("SELECT c_custkey, c_mktsegment, n_orders FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def j01_one_to_one(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return J.one_to_one(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"])


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j06_three_way(spark, sf):
    nation = F.broadcast(table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey"))
    region = F.broadcast(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"))
    return table(spark, sf, "customer").join(nation, "c_nationkey").join(region, "n_regionkey").select("c_custkey", "n_name", "r_name")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b
  ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id""")
def f14_cosine_to_all(spark, sf):
    blocks = parallelism(spark)
    vectors = table(spark, sf, "embeddings").select("vec_id", S.l2_normalised(F.col("embedding")).alias("v"))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("v").alias("va"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    every = vectors.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return asked.join(every, "block").where("a <> b").select("a", "b", F.round(S.dot(F.col("va"), F.col("vb")), 5).alias("cosine"))


@query("""SELECT vec_id, list_reduce([(CASE WHEN embedding[i] > embedding[i + 1] THEN 1 ELSE 0 END)::BIGINT FOR i IN range(1, 64)], lambda a, b: a * 2 + b) AS bits FROM embeddings""")
def f09_difference_bits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", S.bits_to_number(S.difference_bits(F.col("embedding"))).alias("bits"))


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings)
  SELECT vec_id, (k - 1)::INT AS k, round(e[k] / list_sum(e), 6) AS softmax FROM m, range(1, 65) r(k)""")
def f21_softmax(spark, sf):
    p = S.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.transform(p, lambda x: F.round(x, 6))).alias("k", "softmax"))


@query("SELECT vec_id, k::INT AS k, CASE WHEN label = k THEN 1.0::DOUBLE ELSE 0.0 END AS one_hot FROM embeddings, range(10) r(k)")
def f22_one_hot(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.one_hot(F.col("label"), 10)).alias("k", "one_hot"))


@query("""SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, round(CASE WHEN l_linenumber < 2 THEN (l_linenumber + 1) / 2.0::DOUBLE ELSE 0.5 * (1 + cos(least(1, (l_linenumber - 2) / 5.0::DOUBLE) * pi())) END, 9) AS factor,
  round(pow(1 - least(0.99, 0.05 + l_discount), 2) * -ln(greatest(least(0.99, 0.05 + l_discount), 1e-12)), 9) AS focal, printf('%.4f', l_extendedprice) AS price_text FROM lineitem""")
def f23_schedules(spark, sf):
    p = F.least(F.lit(0.99), F.lit(0.05) + F.col("l_discount"))
    c = F.col
    return table(spark, sf, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", F.round(S.warmup_cosine(c("l_linenumber"), 2, 7), 9).alias("factor"), F.round(S.focal_loss(p, 2.0), 9).alias("focal"), S.fixed_text(c("l_extendedprice"), 4).alias("price_text"))


@query("SELECT n::INT AS n, greatest(1, round_even(n * 0.125, 0))::INT AS k FROM range(1, 2001) t(n)")
def f16_half_even(spark, sf):
    return spark.range(1, 2001).select(F.col("id").cast("int").alias("n"), S.top_count(F.col("id"), 0.125).alias("k"))


@query("SELECT i::INT AS step, round(i * 0.05::DOUBLE, 2) AS fraction FROM range(0, 21) t(i)")
def f17_grid(spark, sf):
    return spark.range(21).select(F.col("id").cast("int").alias("step"), F.round(F.col("id") * 0.05, 2).alias("fraction"))


@query("""SELECT n::INT AS n, k::INT AS k, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(k + 1) z(i)), 9) AS tail FROM range(1, 200, 7) a(n), range(0, 100, 9) b(k) WHERE k < n""")
def f20_binomial_tail(spark, sf):
    n, k = spark.range(1, 200, 7).toDF("n"), spark.range(0, 100, 9).toDF("k")
    grid = n.join(F.broadcast(k), F.col("k") < F.col("n"))
    return grid.select(F.col("n").cast("int").alias("n"), F.col("k").cast("int").alias("k"), F.round(S.binomial_lower_tail(F.col("n"), F.col("k")), 9).alias("tail"))


@query("""SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events""")
def s05_json_fields(spark, sf):
    keys = F.json_object_keys("props")
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.element_at(parsed, F.element_at(keys, 1)).alias("first_value"), F.size(keys).cast("bigint").alias("n_keys"))


@query("""WITH x AS (SELECT event_type, unnest(json_keys(props)) AS field, props FROM events)
  SELECT event_type, field, count(v) AS n, round(avg(v), 6) AS mean FROM (SELECT event_type, field, try_cast(json_extract_string(props, '$.' || field) AS DOUBLE) AS v FROM x) GROUP BY ALL HAVING count(v) > 0""")
def a09_numeric_fields(spark, sf):
    long = table(spark, sf, "events").select("event_type", F.explode(S.numeric_entries(F.col("props"))).alias("field", "v"))
    return long.groupBy("event_type", "field").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT o_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber)::INT AS block_rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def w14_block_rank(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.row_number().over(w).alias("block_rank"))


@query()
def x07_grouped_split(spark, sf):
    images = held_images(table(spark, sf, "image_record"), group_id=N.uuid_text(F.col("group_id")), class_name=N.label(F.col("class_name")))
    # An image of no group is a group by itself; a group of several classes counts to its most frequent one.
    group = F.coalesce("group_id", F.concat(F.lit("record:"), "image_id"))
    counts = images.groupBy(group.alias("group_id"), F.coalesce("class_name", F.lit("")).alias("class_name")).agg(F.count("*").alias("k"))
    groups = counts.groupBy("group_id").agg(F.max_by("class_name", F.struct("k", "class_name")).alias("class_name"), F.sum("k").alias("size"))
    best, _ = splitting.optimise_split(groups, restarts=20_000)
    return best

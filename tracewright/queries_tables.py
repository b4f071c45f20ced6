"""Queries over the star-schema and text tables: names, bindings, ranking, aggregates, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .functions.scalar import airborne, observation, round_even
from .operators import aggregates as agg
from .operators import comparison as cmp
from .operators import matching, sets
from .registry import HOUR, MINUTE, events, query, table


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS fastest, min(o_totalprice) AS best_time FROM orders GROUP BY o_custkey""")
def fastest_per_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("none", F.lit(None).cast("double"))
    return agg.fastest(o, ["o_custkey"], "o_orderkey", "none", "o_totalprice")


@query("""SELECT p_name, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS ids, CAST(count(DISTINCT p_partkey) AS INTEGER) AS n_ids FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1""")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return agg.shared_names(p, "p_name", "id").withColumn("ids", F.array_join("ids", ","))


@query("""SELECT p_brand, arg_max(p_name, (p_size, p_partkey)) AS p_name FROM part WHERE p_name <> 'red widget' GROUP BY p_brand""")
def preferred_name(spark: SparkSession, d: str) -> DataFrame:
    return agg.preferred(table(spark, d, "part"), ["p_brand"], "p_name", "p_size", "p_partkey", F.col("p_name") != "red widget")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round_even(l_quantity, 0) AS BIGINT)) AS BIGINT) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def lineitem_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.rint("l_quantity").cast("long")).alias("total"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.percentile("l_quantity", F.lit(0.5)).alias("median"),
    )


@query("""d AS (SELECT l_orderkey, CAST(round_even(sum(round_even(l_extendedprice * 100, 0)), 0) AS BIGINT) AS cents FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey, o_custkey, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) - cents AS change FROM orders JOIN d ON o_orderkey = l_orderkey),
s AS (SELECT *, CASE WHEN change > 0.0005 THEN 'loss' WHEN change < -0.0005 THEN 'gain' END AS side FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, side ORDER BY abs(change) DESC, o_orderkey) AS rank FROM s WHERE side IS NOT NULL)
SELECT o_custkey, o_orderkey, change, side, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def order_changes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.select("o_custkey", "o_orderkey", (F.rint(F.col("o_totalprice") * 100).cast("long") - F.col("cents")).alias("change"))
    return sets.top_changes(o, ["o_custkey"], "change", "o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY')
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def set_intersect_rebuild(spark: SparkSession, d: str) -> DataFrame:
    visible = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    removed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(visible, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(removed, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("""g AS (SELECT n_nationkey + 100 AS game_id, 'name' || (n_nationkey % 20) AS name FROM nation),
r AS (SELECT s_suppkey % 23 AS resource_id, 'name' || (s_suppkey % 15) AS name, CASE WHEN s_suppkey % 5 = 0 THEN 100 + s_suppkey % 9 END AS declared_id FROM supplier),
a AS (SELECT 103 AS game_id, 'name3' AS name, 7 AS resource_id UNION ALL SELECT 104, 'name4', 999),
known AS (SELECT DISTINCT resource_id AS rid FROM r),
de AS (SELECT declared_id AS game_id, count(DISTINCT resource_id) AS d_n, min(resource_id) AS d_id FROM r WHERE declared_id IS NOT NULL GROUP BY 1),
na AS (SELECT name, count(DISTINCT resource_id) AS n_n, min(resource_id) AS n_id FROM r GROUP BY 1), tw AS (SELECT name, count(*) AS g_n FROM g GROUP BY 1),
j AS (SELECT g.*, a.resource_id AS a_id, k1.rid AS a_rid, d_n, d_id, n_n, n_id, g_n, k2.rid FROM g LEFT JOIN a USING (game_id, name) LEFT JOIN known k1 ON k1.rid = a.resource_id
  LEFT JOIN de USING (game_id) LEFT JOIN tw USING (name) LEFT JOIN na USING (name) LEFT JOIN known k2 ON k2.rid = g.game_id - 100),
s AS (SELECT *, CASE WHEN a_rid IS NOT NULL THEN 'verified_anchor' WHEN a_id IS NOT NULL THEN 'verified_anchor_resource_missing' WHEN d_n = 1 THEN 'declared_id' WHEN d_n > 1 THEN 'ambiguous_declared_id'
  WHEN g_n > 1 THEN 'ambiguous_game_name' WHEN n_n = 1 THEN 'exact_name' WHEN n_n > 1 THEN 'ambiguous_resource_name' WHEN rid IS NOT NULL THEN 'offset_candidate' ELSE 'unresolved' END AS status FROM j)
SELECT game_id, name, CASE status WHEN 'verified_anchor' THEN a_id WHEN 'declared_id' THEN d_id WHEN 'exact_name' THEN n_id WHEN 'offset_candidate' THEN rid END AS resource_id, status,
  status IN ('verified_anchor', 'declared_id', 'exact_name') AS authoritative FROM s""")
def binding_resolution(spark: SparkSession, d: str) -> DataFrame:
    games = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("game_id"), F.concat(F.lit("name"), F.col("n_nationkey") % 20).alias("name"))
    k = F.col("s_suppkey")
    resources = table(spark, d, "supplier").select((k % 23).alias("resource_id"), F.concat(F.lit("name"), k % 15).alias("name"), F.when(k % 5 == 0, 100 + k % 9).alias("declared_id"))
    anchors = spark.createDataFrame([(103, "name3", 7), (104, "name4", 999)], "game_id int, name string, resource_id int")
    return matching.resolve_bindings(games, resources, anchors)


@query("""q AS (SELECT c_custkey AS want_id, c_mktsegment AS want_role FROM customer), t AS (SELECT s_suppkey * 3 AS id, CASE WHEN s_suppkey = 5 THEN 'MACHINERY' WHEN s_suppkey < 5 THEN 'BUILDING' ELSE 'x' END AS role, s_name FROM supplier),
r AS (SELECT role, min(s_name) AS nm FROM t GROUP BY role HAVING count(*) = 1)
SELECT want_id, want_role, coalesce(i.s_name, r.nm) AS s_name, CASE WHEN i.id IS NOT NULL THEN 'id' WHEN r.role IS NOT NULL THEN 'unique_role' ELSE 'unresolved' END AS resolved_by
FROM q LEFT JOIN t i ON q.want_id = i.id LEFT JOIN r ON q.want_role = r.role""")
def unique_role_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("want_id"), F.col("c_mktsegment").alias("want_role"))
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select((k * 3).alias("id"), F.when(k == 5, "MACHINERY").when(k < 5, "BUILDING").otherwise("x").alias("role"), "s_name")
    return matching.unique_or_role(q, t, "id", "role", "s_name")


@query("""h AS (SELECT o_orderkey AS replay, 'NATION_' || (o_orderkey % 40) || '-lap' AS hint FROM orders),
rooms AS (SELECT n_name AS room, n_nationkey AS game_id FROM nation UNION ALL SELECT 'NATION', 77), b AS (SELECT n_nationkey AS game_id, n_nationkey + 1000 AS rid FROM nation WHERE n_regionkey < 3),
c AS (SELECT o_orderkey AS replay, 5 AS uid FROM orders WHERE o_orderpriority = '1-URGENT'), nm AS (SELECT DISTINCT 'NATION_' || n_nationkey || '-lap' AS hint, n_nationkey + 2000 AS nid FROM nation WHERE n_regionkey = 4),
x AS (SELECT h.replay, r.game_id, length(r.room) AS l, max(length(r.room)) OVER (PARTITION BY h.replay) AS m FROM h JOIN rooms r ON starts_with(h.hint, r.room)),
u AS (SELECT replay, min(game_id) AS game_id FROM x WHERE l = m GROUP BY replay HAVING count(DISTINCT game_id) = 1)
SELECT h.replay, h.hint, CAST(coalesce(b.rid, c.uid, nm.nid) AS BIGINT) AS resource_id, CASE WHEN b.rid IS NOT NULL THEN 'room_prefix' WHEN c.uid IS NOT NULL THEN 'user_confirmed' WHEN nm.nid IS NOT NULL THEN 'exact_name' ELSE 'unresolved' END AS method
FROM h LEFT JOIN u USING (replay) LEFT JOIN b USING (game_id) LEFT JOIN c USING (replay) LEFT JOIN nm USING (hint)""")
def replay_tiers(spark: SparkSession, d: str) -> DataFrame:
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    k, nk = F.col("o_orderkey"), F.col("n_nationkey")
    replays = o.select(k.alias("replay"), F.concat(F.lit("NATION_"), k % 40, F.lit("-lap")).alias("hint"))
    rooms = n.select(F.col("n_name").alias("room"), nk.cast("long").alias("game_id")).unionByName(spark.createDataFrame([("NATION", 77)], "room string, game_id long"))
    bindings = n.select(nk.cast("long").alias("game_id"), (nk + 1000).cast("long").alias("resource_id"), (F.col("n_regionkey") < 3).alias("authoritative"))
    confirmed = o.where("o_orderpriority = '1-URGENT'").select(k.alias("replay"), F.lit(5).cast("long").alias("resource_id"))
    names = n.where("n_regionkey = 4").select(F.concat(F.lit("NATION_"), nk, F.lit("-lap")).alias("name"), (nk + 2000).cast("long").alias("resource_id"))
    return matching.resolve_tiers(replays, rooms, bindings, confirmed, names)


@query("""p AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT p_name AS name, p_partkey AS id, 'exact' AS s FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_partkey, 'alias' FROM part WHERE p_size > 40)
SELECT name, id, string_agg(DISTINCT s, ',' ORDER BY s) AS sources FROM p JOIN a USING (name) GROUP BY name, id""")
def name_probe(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    t = lambda cond: p.where(cond).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    probes = p.select(F.col("p_name").alias("name")).distinct()
    return matching.probe_names(probes, {"exact": t("p_size > 25"), "alias": t("p_size > 40")}).withColumn("sources", F.array_join("sources", ","))


@query("""a AS (SELECT user_id, event_id AS id, t // 1000000 AS t FROM ev WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS rid, t // 1000000 AS rt FROM ev WHERE event_type = 'purchase'),
j AS (SELECT a.user_id, a.id, b.rid, abs(a.t - b.rt) AS gap FROM a JOIN b USING (user_id) WHERE abs(a.t - b.rt) <= 14400),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY gap, rid) AS rn, count(*) FILTER (gap <= 3600) OVER (PARTITION BY user_id, id) AS n, lead(gap) OVER (PARTITION BY user_id, id ORDER BY gap, rid) AS g2 FROM j),
c AS (SELECT *, CASE WHEN n = 1 THEN 'high' WHEN gap <= 1800 AND (g2 IS NULL OR g2 - gap >= 600) THEN 'medium' END AS confidence FROM r WHERE rn = 1)
SELECT a.user_id, a.id, a.t, c.confidence, CASE WHEN c.confidence IS NOT NULL THEN c.rid END AS rid FROM a LEFT JOIN c ON a.user_id = c.user_id AND a.id = c.id""")
def time_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("s", F.expr("t div 1000000"))
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("s").alias("t"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("rid"), F.col("s").alias("t"))
    return matching.match_by_time(left, right, ["user_id"], 14400, 3600, 1800, 600)


@query(r"""SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS name, length(translate(coalesce(text, ''), '? ' || chr(9), '')) > 0 AS usable,
  trim(regexp_replace(text, '(?i)[\s_-]*by[-_ ].*$', '')) AS alias FROM documents""")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", fn.normalize_name(text, lower=True).alias("name"), fn.name_is_usable(text).alias("usable"), fn.display_alias(text).alias("alias"))


@query(r"""f AS (SELECT o_orderkey, 'dir/Map ' || (o_orderkey % 9) || '_' || strftime(o_orderdate, '%Y%m%d') || '101500.sav' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'data.vfs' WHEN 1 THEN 'Data' || (o_orderkey % 30) || '.VFS' WHEN 2 THEN 'other.vfs' ELSE 'data7.vfs.bak' END AS archive FROM orders)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', ''), '[\s_-]*\d{14}.*$', '')) AS hint,
  strftime(strptime(regexp_extract(path, '(\d{14})[^/\\]*$', 1), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') AS stamp,
  CASE WHEN regexp_matches(lower(archive), '^data\d*\.vfs$') THEN coalesce(try_cast(regexp_extract(lower(archive), '^data(\d*)\.vfs$', 1) AS INT), 0) ELSE -1 END AS rank FROM f""")
def filename_hint(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    path = F.concat(F.lit("dir/Map "), k % 9, F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("101500.sav"))
    archive = F.when(k % 4 == 0, "data.vfs").when(k % 4 == 1, F.concat(F.lit("Data"), k % 30, F.lit(".VFS"))).when(k % 4 == 2, "other.vfs").otherwise("data7.vfs.bak")
    o = table(spark, d, "orders")
    stamp = F.date_format(fn.filename_time(path), "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", fn.filename_hint(path).alias("hint"), stamp.alias("stamp"), fn.archive_rank(archive).alias("rank"))


@query("""v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 25 AS a, l_discount * 100 - 5 AS b, l_tax * 100 - 4 AS c, l_partkey % 8 AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round_even(sqrt(a * a + b * b + c * c) * 1e6, 0) / 1e6 AS norm, round_even(((a * 3.0 + pi()) - floor((a * 3.0 + pi()) / (2 * pi())) * (2 * pi()) - pi()) * 1e6, 0) / 1e6 AS wrapped,
  CASE st WHEN 0 THEN 'in_air' WHEN 1 THEN 'none_contact' WHEN 2 THEN 'one_contact' WHEN 3 THEN 'two_contact' WHEN 4 THEN 'three_contact' WHEN 5 THEN 'full_contact' ELSE 'unknown_' || st END AS contact,
  CASE st WHEN 0 THEN true WHEN 5 THEN false END AS airborne, CAST(floor(greatest(0.0, 15.4 * a)) AS BIGINT) AS shown, greatest(0.0, least(1.0, b / 5)) AS share,
  CASE WHEN abs(b / 10000) < 0.0005 THEN 'equal' WHEN b > 0 THEN 'loss' ELSE 'gain' END AS direction,
  round_even(CASE WHEN a >= 0 THEN least(pi() / 2, abs(abs(a) - pi() / 2)) ELSE -least(pi() / 2, abs(abs(a) - pi() / 2)) END * 1e6, 0) / 1e6 AS slip FROM v""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5, F.col("l_tax") * 100 - 4
    st = (F.col("l_partkey") % 8).cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", round_even(fn.hypot3(a, b, c), 6).alias("norm"), round_even(fn.wrap_pi(a * 3.0), 6).alias("wrapped"), fn.contact_state_name(st).alias("contact"),
        airborne(st).alias("airborne"), fn.display_speed(a).alias("shown"), fn.clamp01(b / 5).alias("share"), fn.delta_direction(b / 10000).alias("direction"), round_even(fn.slip_angle(a), 6).alias("slip"),
    )


@query("""e AS (SELECT user_id, list_sort(list_distinct(list_transform(list(t), lambda v: (v // 60000000)::DOUBLE))) AS p FROM ev GROUP BY user_id),
u AS (SELECT user_id, unnest(p) AS x, generate_subscripts(p, 1) AS i, len(p) AS n, p FROM e)
SELECT user_id, n AS marks, p[1] AS first, p[n] AS last FROM u WHERE i = 1""")
def boundary_marks(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("user_id", F.lit(1).alias("component"), F.expr(f"t div {MINUTE}").cast("double").alias("m"))
    b = cmp.boundaries(e, ["user_id"], "component", "m", F.lit(0.0))
    return b.select("user_id", F.size("boundaries").cast("long").alias("marks"), F.col("boundaries")[0].alias("first"), F.element_at("boundaries", -1).alias("last"))


@query("""RECURSIVE m AS (SELECT DISTINCT user_id % 5 AS pair, (t // 3600000000)::DOUBLE AS h FROM ev),
r AS (SELECT pair, min(h) AS h FROM m GROUP BY pair UNION ALL SELECT r.pair, min(m.h) FROM r JOIN m ON m.pair = r.pair AND m.h >= r.h + 5 GROUP BY r.pair),
z AS (SELECT pair, max(h) AS last FROM m GROUP BY pair), x AS (SELECT pair, max(h) AS top, min(h) AS low FROM r GROUP BY pair)
SELECT pair, h FROM r JOIN x USING (pair) JOIN z USING (pair) WHERE h = last OR h = low OR h < top OR last - top >= 5 UNION SELECT pair, last FROM z""")
def thinned_boundaries(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select((F.col("user_id") % 5).alias("pair"), F.lit(1).alias("component"), F.expr(f"t div {60 * MINUTE}").cast("double").alias("h"))
    return cmp.boundaries(e, ["pair"], "component", "h", F.lit(5.0)).select("pair", F.explode("boundaries").alias("h"))


@query("""m AS (SELECT DISTINCT user_id % 5 AS pair, t // 3600000000 AS h FROM ev), b AS (SELECT pair, h::DOUBLE AS lo, lead(h::DOUBLE) OVER (PARTITION BY pair ORDER BY h) AS hi FROM m)
SELECT pair, 1 AS component, CAST(row_number() OVER (PARTITION BY pair ORDER BY lo) AS INTEGER) AS window_no, lo, hi, hi - lo AS span FROM b WHERE hi > lo""")
def windows_between_boundaries(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select((F.col("user_id") % 5).alias("pair"), F.lit(1).alias("component"), F.expr(f"t div {60 * MINUTE}").cast("double").alias("h"))
    return cmp.windows_between(cmp.boundaries(e, ["pair"], "component", "h", F.lit(0.0)), ["pair"], "component")


@query("""s AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, t // 86400000000 AS day, CAST(sum(cents) AS BIGINT) AS c FROM ev GROUP BY ALL),
w AS (SELECT pair, day, max(CASE WHEN side = 0 THEN c END) AS subject_time, max(CASE WHEN side = 1 THEN c END) AS baseline_time FROM s GROUP BY pair, day),
d AS (SELECT *, subject_time - baseline_time AS delta, day % 7 < 5 AS matched FROM w),
g AS (SELECT pair, CAST(sum(delta) FILTER (matched) AS BIGINT) AS matched_delta, CAST(sum(delta) FILTER (NOT matched) AS BIGINT) AS unmatched_delta, count(*) AS n_windows FROM d GROUP BY pair),
x AS (SELECT pair, CAST(sum(CASE WHEN side = 0 THEN c END) - sum(CASE WHEN side = 1 THEN c END) AS BIGINT) AS total_delta, count(DISTINCT day) AS spans, 500 AS sample_interval, 1.0::DOUBLE AS subject_coverage, 0.5::DOUBLE AS baseline_coverage FROM s GROUP BY pair),
j AS (SELECT x.*, matched_delta, unmatched_delta, n_windows, total_delta - coalesce(matched_delta, 0) - coalesce(unmatched_delta, 0) AS residual, (2 * spans + 2) * sample_interval AS tolerance, least(subject_coverage, baseline_coverage) AS coverage FROM x LEFT JOIN g USING (pair))
SELECT *, CASE WHEN total_delta IS NULL OR matched_delta IS NULL THEN 'unavailable' WHEN abs(residual) <= tolerance THEN 'reconciled' ELSE 'residual_exceeds_tolerance' END AS status FROM j""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    s = e.groupBy(F.expr("user_id div 2").alias("pair"), (F.col("user_id") % 2).alias("side"), F.expr("t div 86400000000").alias("day")).agg(F.sum("cents").alias("c"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("c")))
    w = cmp.window_deltas(s.groupBy("pair", "day").agg(of(0).alias("subject_time"), of(1).alias("baseline_time"))).withColumn("matched", F.col("day") % 7 < 5)
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("c")))
    totals = s.groupBy("pair").agg((total(0) - total(1)).alias("total_delta"), F.countDistinct("day").alias("spans"), F.lit(500).alias("sample_interval"), F.lit(1.0).alias("subject_coverage"), F.lit(0.5).alias("baseline_coverage"))
    return cmp.reconcile(w, totals, ["pair"])


@query("""s AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, t // 86400000000 AS day, CAST(sum(cents) AS BIGINT) AS c FROM ev GROUP BY ALL),
w AS (SELECT pair, day, max(CASE WHEN side = 1 THEN c END) AS subject_time, max(CASE WHEN side = 0 THEN c END) AS baseline_time FROM s GROUP BY pair, day)
SELECT *, subject_time - baseline_time AS delta, CASE WHEN abs(subject_time - baseline_time) < 0.0005 THEN 'equal' WHEN subject_time > baseline_time THEN 'loss' WHEN subject_time < baseline_time THEN 'gain' END AS direction FROM w""")
def swapped_windows(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy(F.expr("user_id div 2").alias("pair"), (F.col("user_id") % 2).alias("side"), F.expr("t div 86400000000").alias("day")).agg(F.sum("cents").alias("c"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("c")))
    return cmp.swap(cmp.window_deltas(s.groupBy("pair", "day").agg(of(0).alias("subject_time"), of(1).alias("baseline_time"))))


@query("""d AS (SELECT o_orderkey, o_orderpriority, (o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) / 1e6 AS d FROM orders)
SELECT o_orderkey, round_even(d * 1e6, 0) / 1e6 AS d, CASE WHEN d IS NULL THEN NULL ELSE
  o_orderpriority || ' ' || printf('%+.3f', d) || ' s ' || CASE WHEN abs(d) < 0.0005 THEN 'equal' WHEN d > 0 THEN 'slower' ELSE 'faster' END END AS said FROM d""")
def price_steps(spark: SparkSession, d: str) -> DataFrame:
    step = (F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))) / 1e6
    return table(spark, d, "orders").select("o_orderkey", round_even(step, 6).alias("d"), observation(F.col("o_orderpriority"), step).alias("said"))


@query("""a AS (SELECT user_id, {'resource_id': CASE WHEN user_id % 3 = 0 THEN user_id % 4 END, 'game_id': user_id % 6, 'name_key': 'n' || user_id % 2} AS a,
  {'resource_id': CASE WHEN user_id % 2 = 0 THEN user_id % 5 END, 'game_id': CASE WHEN user_id % 7 > 2 THEN user_id % 6 END, 'name_key': 'n' || user_id % 3} AS b FROM (SELECT DISTINCT user_id FROM ev))
SELECT user_id, coalesce(CASE WHEN a.resource_id IS NOT NULL AND b.resource_id IS NOT NULL THEN CASE WHEN a.resource_id = b.resource_id THEN 'resource_id' ELSE 'conflict_resource_id' END END,
  CASE WHEN a.game_id IS NOT NULL AND b.game_id IS NOT NULL THEN CASE WHEN a.game_id = b.game_id THEN 'game_id' ELSE 'conflict_game_id' END END,
  CASE WHEN a.name_key = b.name_key THEN 'name_key' ELSE 'conflict_name_key' END, 'unknown') AS same FROM a""")
def same_map_gate(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("user_id")
    a = F.struct(F.when(u % 3 == 0, u % 4).alias("resource_id"), (u % 6).alias("game_id"), F.concat(F.lit("n"), u % 2).alias("name_key"))
    b = F.struct(F.when(u % 2 == 0, u % 5).alias("resource_id"), F.when(u % 7 > 2, u % 6).alias("game_id"), F.concat(F.lit("n"), u % 3).alias("name_key"))
    return events(spark, d).select("user_id").distinct().select("user_id", a.alias("a"), b.alias("b")).select("user_id", cmp.same_map().alias("same"))


@query("""w AS (SELECT user_id, d, d * 86400000000 AS lo, d * 86400000000 + 43200000000 AS hi FROM (SELECT DISTINCT user_id, t // 86400000000 AS d FROM ev))
SELECT w.*, max(e.cents) AS max_cents FROM w LEFT JOIN ev e ON e.user_id = w.user_id AND e.t BETWEEN lo AND hi GROUP BY ALL""")
def window_maximum(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    w = e.select("user_id", F.expr("t div 86400000000").alias("d")).distinct()
    w = w.withColumns({"lo": F.col("d") * 86400000000, "hi": F.col("d") * 86400000000 + 43200000000})
    return cmp.max_in_window(e, w, ["user_id"], "d", "t", "cents", width=12 * HOUR)


@query("""c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, nullif(count(*) FILTER (event_type = 'error'), 0) AS errors, user_id % 3 > 0 AS counts_allowed FROM ev GROUP BY user_id)
SELECT user_id, counts_allowed, CASE WHEN counts_allowed THEN 'primary' ELSE 'raw_only' END AS click_status, CASE WHEN counts_allowed THEN clicks END AS click_value, clicks AS click_raw,
  CASE WHEN errors IS NULL THEN 'unavailable' WHEN counts_allowed THEN 'primary' ELSE 'raw_only' END AS error_status FROM c""")
def product_statistics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    c = events(spark, d).groupBy("user_id").agg(F.count_if(t == "click").alias("clicks"), F.nullif(F.count_if(t == "error"), F.lit(0)).alias("errors")).withColumn("counts_allowed", F.col("user_id") % 3 > 0)
    out = agg.product_statistics(c, ["clicks", "errors"])
    return out.select("user_id", "counts_allowed", F.col("clicks.status").alias("click_status"), F.col("clicks.value").alias("click_value"), F.col("clicks.raw").alias("click_raw"), F.col("errors.status").alias("error_status"))

"""Operators on small tables, with boundary values and sequential loops to compare with."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch import dictionaries as d
from tidewatch.functions import columns as c
from tidewatch.operators import events as ev
from tidewatch.operators import headlines as hl
from tidewatch.operators import network as nw
from tidewatch.operators import scores as sc
from tidewatch.operators import spatial as sp

from .oracle import shuffles, without_broadcasts


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_half_up_of_negative_halves(spark):
    assert [value(spark, c.half_up(F.lit(x))) for x in (-0.5, 0.5, 1.5, -1.5)] == [0, 1, 2, -1]


def test_invalid_boxes_give_no_condition():
    assert c.in_bbox(F.col("a"), F.col("b"), 10, 0, 5, 1) is None
    assert c.in_bbox(F.col("a"), F.col("b"), -190, 0, 5, 1) is None


def test_text_functions(spark):
    assert value(spark, c.without_attribution(F.lit("A - B - The Source"))) == "A - B"
    assert value(spark, c.without_attribution(F.lit("A - ends with stop."))) == "A - ends with stop."
    assert value(spark, c.plain_text(F.lit("<b>a&amp;b</b>  &lt;c&gt;"))) == "a&b <c>"
    assert value(spark, c.coded_entities(F.lit("cve-2024-12345 and apt28, APT28; xAPT1"))) == ["APT28", "CVE-2024-12345"]
    assert value(spark, c.domain_of(F.lit("https://www.Example.org:80/x"))) == "example.org"
    assert value(spark, c.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert value(spark, c.image_of(F.lit("<meta content='http://x/y.png' property='og:image'>"))) == "http://x/y.png"


def test_merge_confidence_equals_the_loop(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for key in range(40):
        scores = [rng.randint(0, 100) for _ in range(rng.randint(1, 9))]
        rows += [(key, i, s) for i, s in enumerate(scores)]
        now = scores[0]
        for s in scores[1:]:
            now = min(100, max(now, s) + 3)
        expected[key] = now
    df = spark.createDataFrame(rows, "k int, i int, s int")
    assert {r.k: r.confidence for r in ev.merge_confidence(df, "k", "i", "s").collect()} == expected


@pytest.mark.parametrize("times, kept", [([0, 5, 16, 40], [0, 16, 40]), ([0, 15, 29, 30], [0, 15, 30]), ([3], [3])])
def test_cooldown_counts_from_the_last_emitted(spark, times, kept):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, minute int").withColumn("ts", F.timestamp_seconds(F.col("minute") * 60))
    assert sorted(r.minute for r in hl.with_cooldown(df, F.lit("k"), "ts", 15).collect()) == kept


def test_radius_join_equals_brute_force_at_poles_and_date_line(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([rng.uniform(-89.9, 89.9), rng.uniform(85, 89.99), rng.uniform(-1, 1)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(250)]
    left = spark.createDataFrame(points, "id int, lat double, lon double")
    right = left.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    for km in (50.0, 300.0):
        got = {(r.id, r.r_id) for r in sp.radius_join(left, right, km).collect()}
        brute = {(r.id, r.r_id) for r in left.crossJoin(right).filter(c.haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")) <= km).collect()}
        assert got == brute


def test_baseline_needs_24_samples_before_it_fires(spark):
    def counts(spike_at):
        rows = [("k", i, 5 + i % 2 if i != spike_at else 50) for i in range(30)]
        return spark.createDataFrame(rows, "key string, h int, n long").withColumn("hour", F.timestamp_seconds(F.col("h") * 3600)).drop("h")

    assert sc.baseline_anomalies(counts(23), ["key"]).count() == 1  # the 24th row
    assert sc.baseline_anomalies(counts(22), ["key"]).count() == 0


def test_merged_baselines_equal_the_whole(spark):
    whole = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 3.0)], "k string, n double")
    parts = sc.merge_baselines(sc.baseline_state(whole.filter("n < 4"), ["k"]), sc.baseline_state(whole.filter("n >= 4"), ["k"]), ["k"])
    expected = {r.k: (r.samples, r["mean"], r.m2) for r in sc.baseline_state(whole, ["k"]).collect()}
    got = {r.k: (r.samples, r["mean"], r.m2) for r in parts.collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_weak_first_edge_blocks_a_strong_later_one(spark):
    edges = spark.createDataFrame([("s", "a", "k", 0.9, 0.0, 1), ("s", "b", "k", 0.01, 0.0, 2), ("s", "b", "k", 0.9, 0.0, 3), ("a", "c", "k", 0.4, 0.0, 1), ("c", "d", "k", 0.5, 0.0, 1), ("d", "e", "k", 1.0, 0.0, 1)], "src string, dst string, kind string, strength double, redundancy double, edge_seq long")
    one = spark.createDataFrame([("s",)], "src string")
    found = {(r.node, r.level) for r in nw.cascade(edges, one).collect()}
    assert found == {("a", 1), ("c", 2), ("d", 3)}
    strongest = {(r.node, r.level) for r in nw.cascade(edges, one, mode="strongest_edge").collect()}
    assert strongest == found | {("b", 1)}


def clustered(rows, threshold=0.30, ttl=6 * 3600):
    """Literal loop: the most alike earlier headline, the earlier of equal ones; clusters by root."""
    roots, seen = {}, []
    for i, at, words in sorted(rows, key=lambda r: (r[1], r[0])):
        best = None
        for j, t, other in seen:
            like = len(words & other) / len(words | other)
            if like >= threshold and at - t <= ttl and (best is None or like > best[0]):
                best = (like, j)
        roots[i] = roots[best[1]] if best else i
        seen.append((i, at, words))
    return roots


def test_clusters_equal_the_loop(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(30)]
    texts = [(i, 1_700_000_000 + 60 * i, " ".join(rng.sample(vocabulary, rng.randint(3, 7)))) for i in range(80)]
    texts = [t for k, t in enumerate(texts) if " ".join(sorted(t[2].split())) not in {" ".join(sorted(u[2].split())) for u in texts[:k]}]
    df = spark.createDataFrame(texts, "id int, s long, title string").withColumn("published_at", F.timestamp_seconds("s"))
    got = {r.id: r.cluster_id for r in hl.cluster_headlines(df, d.COMMON_WORDS).collect()}
    assert got == clustered([(i, t, set(w.split())) for i, t, w in texts])


def test_summary_fetches_titles_of_the_best_only(spark):
    # the titles of all headlines went through each step of the sums
    rows = spark.createDataFrame([(1, "a", "s", 2, 10), (2, "b", "t", 1, 11), (3, "c", "s", 1, 12), (4, "d", "s", 1, 12), (5, None, "u", 1, 9)], "id long, title string, source string, tier int, s long").withColumn("published_at", F.timestamp_seconds("s"))
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)], "id long, cluster_id long")
    found = hl.cluster_summary(rows, clusters, 1)
    assert "max_by(title" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.cluster_id, r.articles, r.title, r.sources, r.best_tier) for r in found.collect()) == [(1, 4, "c", 2, 1), (5, 1, None, 1, 1)]
    assert [r.cluster_id for r in hl.cluster_summary(rows, clusters).collect()] == [1]


def test_copies_of_a_headline_are_one_cluster(spark):
    df = spark.createDataFrame([(i, 1_700_000_000 + i, "Missile strike reported") for i in range(200)], "id int, s long, title string").withColumn("published_at", F.timestamp_seconds("s"))
    assert {r.cluster_id for r in hl.cluster_headlines(df, []).collect()} == {0}


def test_guarded_latest_keeps_a_fresh_primary_fix(spark):
    rows = [(1, 1, "p", 100), (2, 1, "s", 120), (3, 2, "p", 100), (4, 2, "s", 131)]
    df = spark.createDataFrame(rows, "fix_id int, object_id int, source string, s long").withColumn("updated_at", F.timestamp_seconds("s"))
    assert {r.object_id: r.fix_id for r in sc.guarded_latest(df, "p").collect()} == {1: 1, 2: 4}


def test_activity_index(spark):
    rows = [(50.0, True, False, [("a", 1.0)]), (None, False, False, [("b", 9.0)]), (90.0, False, True, [])]
    df = spark.createDataFrame(rows, "popularity double, is_spike boolean, is_closed boolean, sparkline array<struct<at:string,value:double>>")
    assert sc.activity_index(df).first().activity == 43  # 50 * 0.6 + 40 / 3


def test_hotspot_groups_equal_a_search(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(10, 14), rng.uniform(10, 14)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    pairs = [(r.id, r.neighbour_id) for r in sp.neighbour_pairs(df).collect()]
    group = {a: a for a, _ in pairs}
    for _ in range(len(group)):
        for a, b in pairs:
            group[a] = min(group[a], group[b])
    assert {r.id: r.group_id for r in sp.hotspot_groups(df).collect()} == group


def test_sparkline_means_and_bands(spark):
    df = spark.createDataFrame([("p", [(h, float(h)) for h in range(24)])], "place_id string, sparkline array<struct<hour:int,value:double>>")
    means = {r.hour: r["mean"] for r in sc.sparkline_means(df).collect()}
    assert means[0] == 3 and means[12] == 12 and means[23] == 20
    assert value(spark, sc.anomaly_message(F.lit("drone"), F.lit(9), F.lit(2.0), F.lit(3.5))) == "drone: 9 reports in an hour, usually 2.0 (high, z 3.5)"
    assert value(spark, nw.port_importance(F.lit("oil"), F.lit(5))) == 1.0
    assert value(spark, sc.recent_flag(F.lit("2024-01-30 22:00:00").cast("timestamp_ntz"), "2024-01-31 00:00:00"))


def test_sparkline_lines_are_not_joined_with_themselves(spark):
    """Lines of two rows are one; no point meets the others by a join, whose rows would be 24 times the points."""
    rng = random.Random(2)
    line = [(h, None if h % 5 == 0 else float(rng.randrange(40))) for h in rng.sample(range(60), 24)]
    df = spark.createDataFrame([("p", line[:10]), ("p", line[10:]), ("q", line[:3])], "place_id string, sparkline array<struct<hour:int,value:double>>")
    found = sc.sparkline_means(df)
    expected = {}
    for place, points in (("p", line), ("q", line[:3])):
        for h, _ in points:
            near = [v for _, _, v in sorted((abs(o - h), o, v) for o, v in points)[:7] if v is not None]
            expected[place, h] = int(sum(near) / len(near) + 0.5) if near else None
    assert {(r.place_id, r.hour): r["mean"] for r in found.collect()} == expected
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_events_of_one_place_are_paired_as_rows(spark):
    """Copies of places are paired as rows of ids, in parts of some ids each; all operators on pairs equal plain loops."""
    rng = random.Random(7)
    spots = [(30 + rng.random(), 40 + rng.random()) for _ in range(9)] + [(12.0, 179.99), (12.0, -179.99), (-40.0, 5.0)]
    rows = [(i, *spots[i % 12 if i < 150 else i % 3], rng.choice([0, 60, 90_000, 400_000]), i % 5 != 0) for i in range(221)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, s long, is_active boolean").withColumn("occurred_at", F.timestamp_seconds("s"))

    def km(a, b):
        la, lo, lb, lp = (math.radians(x) for x in (a[1], a[2], b[1], b[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0.0)))

    near = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and km(a, b) <= 25}
    assert sorted((r.id, r.neighbour_id) for r in sp.neighbour_pairs(df).collect()) == sorted(near)
    parts = sp.gathered(df, ["latitude", "longitude"], 5).collect()
    assert len(parts) > 40 and sorted(i for r in parts for i in r.ids) == list(range(221)) and all(r["first"] == min(r.ids) for r in parts)
    around = {a[0]: sorted(j for i, j in near if i == a[0]) for a in rows}
    counts = sp.hotspot_count(df, 25.0, 30).first()
    assert (counts.hotspots, counts.crowded) == (len({x[0] for x in around.values() if x}), sum(len(x) >= 30 for x in around.values()))
    found = sorted((r.a_id, r.b_id) for r in sp.corroborate(df, df, 24, 160.0).collect())
    assert found == sorted((a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and km(a, b) <= 160 and abs(a[3] - b[3]) <= 86_400)
    best = {(p[0], i + 1): b[0] for p in rows[::7] for i, b in enumerate(sorted((b for b in rows if b[4] and b[0] != p[0] and km(p, b) <= 50), key=lambda b: (-b[3], b[0]))[:5])}
    assert {(r.probe_id, r["rank"]): r.id for r in sp.nearby(df, df.filter("id % 7 = 0")).collect()} == best
    plan = sp.nearby(df, df.filter("id % 7 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_many_boxes_equal_the_list(spark):
    rng = random.Random(4)

    def box(k):
        lat, lon = rng.uniform(-89, 85), rng.uniform(-179, 170)
        return (k, f"b{k % 700}", lat, lat + rng.choice([0.0, 0.001, 0.3, 1.0, 4.0]), lon, lon + rng.choice([0.0, 0.01, 0.5, 2.0, 8.0]))

    boxes = [box(k // 2) for k in range(3000)] + [(9999, "whole", -90.0, 90.0, -180.0, 180.0), (9998, None, 0.0, 1.0, 0.0, 1.0), (1, "upside down", 5.0, -5.0, 0.0, 1.0)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)] + [(300 + i, b[2], b[5]) for i, b in enumerate(boxes[:50])] + [(7, 1.0, 1.0), (7, 1.0, 1.0), (8, None, 1.0)]
    table = spark.createDataFrame(boxes, "seq int, country string, min_lat double, max_lat double, min_lon double, max_lon double")
    found = sp.box_country(spark.createDataFrame(points, "id long, lat double, lon double").repartition(3), table)
    expected = []
    for i, lat, lon in points:
        inside = [(b[0], b[1] is not None, b[1]) for b in boxes if lat is not None and b[2] <= lat <= b[3] and b[4] <= lon <= b[5]]
        if inside and min(inside)[2] is not None:
            expected.append((i, min(inside)[2]))
    assert sorted((r.id, r.box_country) for r in found.collect()) == sorted(expected) and len(expected) > 300
    few = table.filter("seq < 60 or seq > 9000")
    same = spark.createDataFrame(points, "id long, lat double, lon double")
    assert sorted(map(tuple, sp.box_country(same, few).collect())) == sorted(map(tuple, sp.box_country(same, few, listed=1).collect()))


def test_pairs_within_one_table_are_as_between_two(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(20, 22), rng.choice([-179.9, 179.9, 10.0]) + rng.uniform(-0.5, 0.1), i * 3000) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, s long").withColumn("occurred_at", F.timestamp_seconds("s"))
    copy = df.select("*")
    assert sorted(map(tuple, sp.corroborate(df, df, 5, 60.0).collect())) == sorted(map(tuple, sp.corroborate(df, copy, 5, 60.0).collect())) != []


def test_reports_go_to_few_blocks_and_pairs_keep_runs(spark):
    # a report went to fifteen cells or more at three times each, and the two ways of each pair were stored in turn
    rng = random.Random(11)
    rows = [(i, rng.uniform(20, 40), rng.uniform(30, 60), 3600 * rng.randrange(400)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, s long").withColumn("occurred_at", F.timestamp_seconds("s"))
    with without_broadcasts(spark):
        found = sp.corroborate(df, df, 24, 160.0)
        assert found.count() == found.distinct().count()
        found.collect()
        sent = sum(n for columns, n in shuffles(found) if any(c.endswith("ids: array<bigint>") for c in columns))
    assert 600 < sent < 14 * 600
    here = spark.createDataFrame([(i, 20.0 + i % 2, 30.0, 7200 * (i % 2)) for i in range(60)], df.schema.fieldNames()[:4]).withColumn("occurred_at", F.timestamp_seconds("s"))
    firsts = [r.a_id for r in sp.corroborate(here, here, 24, 160.0).collect()]
    assert len(firsts) == 60 * 59 and sum(a != b for a, b in zip(firsts, firsts[1:])) < 2 * 60


def on_a_globe(rng, n):
    spots = [(90.0, 0.0), (-90.0, 77.0), (89.95, 10.0), (89.95, -170.0), (0.0, 180.0), (0.0, -180.0), (0.1, 179.95), (60.0, -179.9), (60.0, 179.9)]
    around = [(lat + rng.uniform(-1.5, 1.5), lon + rng.uniform(-1.5, 1.5)) for lat, lon in spots for _ in range(n)] + [(rng.choice([-1, 1]) * rng.uniform(88.5, 90), rng.uniform(-180, 180)) for _ in range(4 * n)]
    return spots + [(max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180) for lat, lon in around] + [(None, 5.0), (5.0, None)]


def far(a, b):
    la, lo, lb, lp = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0.0)))


@pytest.mark.parametrize("radius", [160.0, 900.0])
def test_reports_around_poles_and_date_line_equal_a_search(spark, radius):
    rng = random.Random(12)
    rows = [(i, *spot, rng.choice([0, 3600, 86_400, 90_000, 170_000])) for i, spot in enumerate(on_a_globe(rng, 8))]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, s long").withColumn("occurred_at", F.timestamp_seconds("s"))
    whole = [r for r in rows if None not in r]
    expected = sorted((a[0], b[0]) for a in whole for b in whole if a[0] != b[0] and abs(a[3] - b[3]) <= 86_400 and far(a[1:3], b[1:3]) <= radius)
    assert sorted(map(tuple, sp.corroborate(df, df, 24, radius).collect())) == expected != []
    assert sorted(map(tuple, sp.corroborate(df, df.select("*"), 24, radius).collect())) == expected


def test_neighbours_around_poles_and_date_line_equal_a_search(spark):
    rng = random.Random(13)
    rows = [(i, *spot) for i, spot in enumerate(on_a_globe(rng, 8) + on_a_globe(random.Random(13), 8)[:20])]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    whole = [r for r in rows if None not in r]
    expected = {(a[0], b[0]): far(a[1:], b[1:]) for a in whole for b in whole if a[0] != b[0] and far(a[1:], b[1:]) <= 25}
    found = sp.neighbour_pairs(df).collect()
    assert {(r.id, r.neighbour_id): round(r.km, 6) for r in found} == {k: round(v, 6) for k, v in expected.items()} and len(found) == len(expected) > 20
    assert {(r.id, r.neighbour_id): r.km for r in sp.neighbour_pairs(df, digits=2).collect()} == {(r.id, r.neighbour_id): round(r.km + 1e-12, 2) for r in found}


def test_neighbours_are_dealt_to_all_tasks_and_rounded_once_a_place(spark):
    # pairs were made by as many tasks as some MB of places filled, a million pairs of a row at once, and the distance of each was rounded
    df = spark.range(3000).select("id", (F.col("id") % 2 * 0.1).alias("latitude"), F.lit(5.0).alias("longitude"))
    found = sp.neighbour_pairs(df, digits=4)
    assert found.rdd.getNumPartitions() >= 16
    assert found.agg(F.count("*"), F.countDistinct("id", "neighbour_id"), F.max("km")).first()[:] == (3000 * 2999, 3000 * 2999, 11.1195)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("round(")].count("Generate explode") >= 2
    assert max(len(r.ids) for r in sp.gathered(df, ["latitude", "longitude"]).collect()) < 200

"""Streams that carry state, runs and messages, against literal loops."""

import json
import math
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import headlines as hl
from tidewatch.operators import scores as sc
from tidewatch.sources import outbox, runs
from tidewatch.streaming import baselines, clusters, instability, streams, trends

from .oracle import shuffles, without_broadcasts
from .test_streams import arriving, drained

START = 1_700_000_000


def titles(rng, n):
    words = [f"word{i}" for i in range(40)]
    return [" ".join(rng.sample(words, rng.randint(1, 6))) for _ in range(n)]


def alike(a, b):
    return len(a & b) / len(a | b)


def looped_clusters(batches, threshold, ttl, most):
    """cluster ids by headline, and what is live at the end: literally, a headline and a batch at a time."""
    live, out = {}, {}
    for batch in batches:
        updated = {c: max(at for _, at, _ in arts) for c, arts in live.items()}
        before = {c: list(arts) for c, arts in live.items()}
        fresh = []
        for k, title, at in sorted(batch, key=lambda r: (r[2], r[0])):
            words = frozenset(w for w in title.split() if len(w) >= 3)
            if len(words) < 2 or any(k == i for arts in before.values() for i, _, _ in arts):
                continue
            near = [(alike(words, w), -t, -i, c) for c, arts in before.items() if at - updated[c] <= ttl for i, t, w in arts if (t, i) < (at, k)]
            near += [(alike(words, w), -t, -i, c) for i, t, w, c in fresh if at - t <= ttl and (t, i) < (at, k)]
            best = max((x for x in near if x[0] >= threshold), default=None)
            cluster = best[3] if best else k
            out[k] = cluster
            fresh.append((k, at, words, cluster))
            live.setdefault(cluster, []).append((k, at, words))
        newest = max((at for arts in live.values() for _, at, _ in arts), default=0)
        last = {c: max(at for _, at, _ in arts) for c, arts in live.items()}
        kept = sorted((c for c in live if newest - last[c] <= ttl), key=lambda c: (-last[c], -c))[:most]
        live = {c: live[c] for c in kept}
    return out, live


@pytest.mark.parametrize("most", [200, 3])
def test_cluster_stream_equals_the_loop(spark, tmp_path, most):
    rng = random.Random(most)
    names = titles(rng, 90)
    rows = [(i, names[i] if i % 4 else names[i // 8], f"s{i % 5}", 1 + i % 3, i * 400 + (30_000 if i > 60 else 0)) for i in range(90)]
    batches = [rows[:30], rows[30:55], rows[55:] + rows[50:52]]
    stream = arriving(spark, tmp_path, batches, "id long, title string, source string, tier int, s long").withColumn("published_at", F.timestamp_seconds(F.col("s") + START))
    clusters.cluster_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp", [], most=most).awaitTermination(600)
    expected, live = looped_clusters([[(r[0], r[1], r[4]) for r in b] for b in batches], 0.30, 6 * 3600, most)
    found = spark.read.parquet(f"file://{tmp_path}/o").collect()
    assert {r.id: r.cluster_id for r in found} == expected and Counter(r.id for r in found).most_common(1)[0][1] == 1
    ends = {r.cluster_id: r for r in spark.read.parquet(f"file://{tmp_path}/t-clusters/version=2").collect()}
    assert {c: r.articles for c, r in ends.items()} == {c: len(arts) for c, arts in live.items()} and len(ends) <= most
    assert not (tmp_path / "t-clusters" / "version=0").exists()
    by_id = {r[0]: r for r in rows}
    for c, r in ends.items():
        own = [by_id[i] for i, _, _ in live[c]]
        best = max(own, key=lambda x: (-x[3], x[4], -x[0]))
        assert (r.best.title, r.best.tier, r.sources, r.created, r.updated) == (best[1], best[3], sorted({x[2] for x in own}), min(x[4] for x in own) + START, max(x[4] for x in own) + START)


def test_no_live_cluster_is_dropped_for_their_number(spark, tmp_path):
    # of 230 live clusters the 200 that were updated last stayed, and headlines like the other 30 began clusters of their own
    first = [(i, f"alpha{i} beta{i} gamma{i}", "s", 1, i * 10) for i in range(230)]
    batches = [first, [(1000 + i, title, "s", 1, 3600 + i * 10) for i, title, *_ in first]]
    stream = arriving(spark, tmp_path, batches, "id long, title string, source string, tier int, s long").withColumn("published_at", F.timestamp_seconds(F.col("s") + START))
    clusters.cluster_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp", []).awaitTermination(600)
    assert {r.id: r.cluster_id for r in spark.read.parquet(f"file://{tmp_path}/o").collect()} == {k: k % 1000 for batch in batches for k, *_ in batch}
    assert spark.read.parquet(f"file://{tmp_path}/t-clusters/version=1").count() == 230


def test_cluster_batch_equals_the_loop(spark):
    rng = random.Random(5)
    names = titles(rng, 80)
    rows = [(i, names[i % 70], f"s{i % 5}", 1, i * 500) for i in range(80)]
    found = hl.cluster_headlines(spark.createDataFrame(rows, "id long, title string, source string, tier int, s long").withColumn("published_at", F.timestamp_seconds("s")), [])
    expected, _ = looped_clusters([[(r[0], r[1], r[4]) for r in rows]], 0.30, 6 * 3600, 10**6)
    assert {r.id: r.cluster_id for r in found.collect()} == expected


@pytest.mark.parametrize("crowd", [0, 3000, 2**27])
def test_quiet_and_crowded_slices_pair_alike(spark, crowd):
    # every word of a set was a row of its own, shuffled three times, whatever the slice held
    rng = random.Random(6)
    sets = [(i, START + 300 * i, START + 300 * i + (40_000 if i % 9 == 0 else 0), sorted(rng.sample([f"word{k}" for k in range(40)], rng.randint(2, 9)))) for i in range(0, 160) if i % 40 < 30 or i % 3]
    schema = "head long, at long, last long, words array<string>"
    cases = {None: (sets, []), 50: (sets[50:], sets[:50])}
    for cut, (fresh, old) in cases.items():
        expected = {}
        for head, at, _, words in fresh:
            earlier = [(alike(set(words), set(w)), -t, -h) for h, t, last, w in sets if (t, h) < (at, head) and at - last <= 6 * 3600]
            best = max((e for e in earlier if e[0] >= 0.30), default=None)
            if best:
                expected[head] = -best[2]
        known = spark.createDataFrame(old, schema) if old else None
        found = hl.best_earlier(spark.createDataFrame(fresh, schema), known, 0.30, 6 * 3600, crowd)
        assert {r.head: r.root for r in found.collect()} == expected and expected
        if crowd == 2**27:
            assert "explode(words" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sets_are_shuffled_as_texts_and_mostly_once(spark):
    # arrays of words were shuffled, once for each node and twice more for each as an earlier one
    sets = spark.createDataFrame([(i, START + 600 * i, START + 600 * i, ["same", f"word{i}"]) for i in range(400)], "head long, at long, last long, words array<string>")
    with without_broadcasts(spark):
        found = hl.best_earlier(sets, None, 0.30, 6 * 3600)
        assert {r.head: r.root for r in found.collect()} == {i: max(0, i - 36) for i in range(1, 400)}
        sets_of = [(columns, rows) for columns, rows in shuffles(found) if any(c.startswith("words: ") for c in columns)]
    assert all("words: string" in columns for columns, _ in sets_of)
    assert len(sets_of) == 2 and sum(rows for _, rows in sets_of) < 2.5 * 400


def test_words_of_a_title_are_made_once(spark):
    # a filter on the number of words made them a second time
    rows = spark.createDataFrame([(1, "Two words words", 5), (2, "one", 6)], "id long, title string, s long").withColumn("published_at", F.timestamp_seconds("s"))
    sets = hl.title_sets(rows, ["near"])
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r.id, r.words) for r in sets.collect()] == [(1, ["two", "words"])]


# trending


def looped_trends(batches, min_count, multiplier, min_sources, cooldown, refresh):
    seen, rows, baseline, refreshed, alerted, out = set(), [], {}, None, {}, []
    newest = None
    for n, batch in enumerate(batches):
        for source, link, title, s in sorted(batch, key=lambda r: r[3]):
            if (source, link, title) not in seen and title.strip():
                seen.add((source, link, title))
                rows += [(s, source, w) for w in set(re.findall(r"[a-z0-9_'-]{3,}", title.lower()))]
                newest = s if newest is None else max(s, newest)
        if newest is None:
            continue
        if refreshed is None or newest - refreshed >= refresh:
            baseline, refreshed = Counter(w for s, _, w in rows if newest - 7 * 86400 < s <= newest), newest
        now = defaultdict(list)
        for s, source, w in rows:
            if newest - 7200 < s <= newest:
                now[w].append(source)
        for w, sources in now.items():
            usual = baseline.get(w, 0) / 7
            if len(sources) >= min_count and len(set(sources)) >= min_sources and (not usual or len(sources) > multiplier * usual) and not (w in alerted and newest - alerted[w] < cooldown):
                alerted[w] = newest
                out.append((n, w, len(sources), len(set(sources)), round(usual, 6)))
    return out


@pytest.mark.parametrize("exact", [True, False])
def test_trending_stream_equals_the_loop(spark, tmp_path, exact):
    rng = random.Random(8)
    common, rare = [f"common{i}" for i in range(8)], [f"rare{i}" for i in range(300)]
    batches, at = [], START
    for n in range(4):
        batch = []
        for i in range(120):
            at += rng.choice([20, 40, 200])
            batch.append((f"s{rng.randint(0, 4)}", f"l{n}-{i}", " ".join([rng.choice(common[2 * (n // 2) : 2 * (n // 2) + 5]), rng.choice(rare)]), at))
        batches.append([*batch, batch[0], ("s1", "l", "  ", at)])
        at += 600
    stream = arriving(spark, tmp_path, batches, "source string, link string, title string, s long").withColumn("published_at", F.timestamp_seconds("s"))
    trends.trending_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp", most_terms=400, exact=exact).awaitTermination(600)
    found = spark.read.parquet(f"file://{tmp_path}/o").collect()
    by_time, expected = {}, looped_trends(batches, 5, 3.0, 2, 1800, 3600)
    for r in found:
        by_time.setdefault(r.batch, set()).add((r.term, r.recent_count, r.sources, round(r.baseline, 6)))
    loop = {}
    for n, *rest in expected:
        loop.setdefault(n, set()).add(tuple(rest))
    assert loop and list(by_time.values()) and sorted(map(sorted, by_time.values())) == sorted(map(sorted, loop.values()))


def test_trending_stream_stores_only_what_can_still_count(spark, tmp_path):
    # a batch of a hundred days wrote files of each day
    rows = [[(f"s{i % 3}", f"l{i}", f"common word{i}", START + i * 86_400) for i in range(100)] + [(f"s{i % 3}", f"m{i}", "burst", START + 99 * 86_400 + i) for i in range(30)]]
    stream = arriving(spark, tmp_path, rows, "source string, link string, title string, s long").withColumn("published_at", F.timestamp_seconds("s"))
    trends.trending_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp").awaitTermination(600)
    found = [(r.term, r.recent_count, r.sources, round(r.baseline, 6)) for r in spark.read.parquet(f"file://{tmp_path}/o").collect()]
    assert found == [("burst", 30, 3, round(30 / 7, 6))]
    assert all(len(list((tmp_path / f"t-{kind}").glob("date=*"))) <= 8 for kind in ("rows", "hours", "summaries"))


def test_recall_of_the_summaries(spark):
    rng = random.Random(1)
    rows = [(START + rng.randint(0, 7000), f"t{min(int(rng.paretovariate(0.9)), 4000)}") for _ in range(30_000)]
    terms = spark.createDataFrame(rows, "s long, term string").select(F.timestamp_seconds("s").alias("published_at"), "term").repartition(6)
    exact = {w for w, n in Counter(w for _, w in rows).items() if n >= 60}
    found = {r.term for r in trends.frequent(trends.summaries(terms, 250), 250).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) <= 250
    whole = {r.term for r in trends.frequent(trends.summaries(terms, 10_000), 10_000).collect()}
    assert whole == {w for _, w in rows}


# baselines


def hours_of(counts, key="a", first=0):
    return [(key, n, first + h) for h, n in enumerate(counts)]


def test_baselines_are_saved_and_gone_on_with(spark, tmp_path):
    rng = random.Random(3)
    counts = [rng.randint(3, 5) for _ in range(40)] + [30, 40, 2, 50, 4, 60, 61] + [rng.randint(3, 5) for _ in range(10)] + [90]
    rows = hours_of(counts) + hours_of([n + 1 for n in counts], "b")
    schema = "key string, n long, h long"
    early, late = [r for r in rows if r[2] < 43], [r for r in rows if r[2] >= 43]

    def stream(folder, part):
        (tmp_path / folder).mkdir()
        return arriving(spark, tmp_path / folder, [part], schema).withColumn("hour", F.timestamp_seconds(F.col("h") * 3600))

    def alerts(folder, part, saved=None):
        found = drained(baselines.baseline_alerts(stream(folder, part), "key", saved), folder, "append", tmp_path / folder)
        return sorted((r.key, r.ms, r.n, round(r.mean, 6), round(r.z, 6)) for r in found.collect())

    whole = alerts("whole", rows)
    first = alerts("first", early)
    held = baselines.state_table(spark, f"file://{tmp_path}/first/cp-first", "key")
    folder = f"file://{tmp_path}/saved"
    assert baselines.save_baselines(held, folder) == 0
    loaded = baselines.load_baselines(spark, folder)
    row = {r.key: r for r in loaded.collect()}["a"]
    assert (row.samples, row["last"], row.last_ms, row.alerted) == (43, counts[42], 42 * 3_600_000, max(ms for k, ms, *_ in first if k == "a"))
    assert row.mean == pytest.approx(sum(counts[:43]) / 43)
    second = alerts("second", late, loaded)
    assert whole and sorted(first + second) == whole
    assert alerts("alone", late) != second

    assert baselines.save_baselines(baselines.state_table(spark, f"file://{tmp_path}/second/cp-second", "key"), folder) == 1
    assert baselines.versions(spark, folder) == [0, 1] and {r.samples for r in baselines.load_baselines(spark, folder).collect()} == {len(counts)}
    assert {r.samples for r in baselines.load_baselines(spark, folder, 0).collect()} == {43}
    with pytest.raises(ValueError):
        baselines.load_baselines(spark, folder, 7)


def test_saved_baselines_are_there_as_a_whole_or_not(spark, tmp_path):
    folder = f"file://{tmp_path}/saved"
    good = spark.createDataFrame([("a", 1, 2.0, 0.0, 2, 0, None)], f"key string, {baselines.STATE}")
    broken = good.withColumn("samples", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        baselines.save_baselines(broken, folder)
    assert baselines.versions(spark, folder) == []
    assert baselines.save_baselines(good, folder) == 0 and baselines.load_baselines(spark, folder).count() == 1


# instability


def looped_ticks(signals, closed, sanctioned, conflict):
    by = defaultdict(Counter)
    for country, weight, s in signals:
        hour = s // 3600
        if hour <= closed:
            by[country.strip().lower()][hour] += 1
    out = []
    for country, hours in by.items():
        if not country:
            continue
        hour, ticks = min(hours), 0
        while hour <= closed:
            n = sum(hours.get(h, 0) for h in range(hour - 167, hour + 1))
            if not n:
                nexts = [h for h in hours if h > hour]
                if ticks:
                    out.append((country, hour, n, ticks + 1))
                if not nexts:
                    break
                hour, ticks = min(nexts), 0
                continue
            ticks = min(168, ticks + 1)
            out.append((country, hour, n, ticks))
            hour += 1
    full = []
    for country, hour, n, ticks in out:
        own = [by[country].get(h, 0) for h in range(hour - 47, hour + 1)]
        recent, older = sum(own[24:]), sum(own[:24])
        ratio = recent / older if older else 2.0 if recent else 1.0
        trend = "stable" if ticks < 48 else "accelerating" if ratio > 1.3 else "decelerating" if ratio < 0.7 else "stable"
        base = 10 * (country in sanctioned) + 10 * (country in conflict)
        score = min(40, n / 50 * 40) + min(30, 2.0 * n / 150 * 30) + {"accelerating": 10, "decelerating": -5, "stable": 0}[trend] + base
        full.append((country, hour * 3_600_000, n, trend, max(0, min(100, math.floor(score + 0.5)))))
    return full


def test_instability_ticks_equal_the_loop(spark, tmp_path):
    rng = random.Random(6)
    hour0 = 480_000
    signals = [("North ", rng.randint(0, 150)) for _ in range(90)] + [("south", h) for h in (0, 1, 2, 60, 61, 62, 63)] + [("east", 3), ("east", 200), ("  ", 5)] + [("west", 330)]
    signals = sorted(((c, 2.0, (hour0 + h) * 3600 + rng.randint(0, 3599)) for c, h in signals), key=lambda r: r[2])
    hourly = [(c, (hour0 + h), n) for (c, h), n in Counter((c.strip().lower(), s // 3600 - hour0) for c, _, s in signals if c.strip()).items()]
    hourly.sort(key=lambda r: r[1])
    parts = [hourly[:20], hourly[20:45], hourly[45:]]
    stream = arriving(spark, tmp_path, parts, "country string, h long, n long").select("country", F.timestamp_seconds(F.col("h") * 3600).alias("hour"), "n", (F.col("n") * 2.0).alias("weight"))
    found = drained(instability.instability_ticks(stream, ["north"], ["north", "east"]), "ticks", "append", tmp_path).collect()
    got = sorted(tuple(r) for r in found)
    # hours that are behind the newest one of all have closed, those of the newest only where it came itself
    last = hour0 + 330
    expected = sorted(r for r in looped_ticks(signals, last, {"north"}, {"north", "east"}) if r[1] < last * 3_600_000 or r[0] == "west")
    assert got == expected
    ranked = instability.ranked(spark.createDataFrame(found), 1).collect()
    assert len(ranked) == len({r[1] for r in got}) and all(r["rank"] == 1 for r in ranked)


# runs and messages


def test_a_failing_run_leaves_a_failed_record(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    changes = spark.range(10).select("id", F.when(F.col("id") < 3, "insert").when(F.col("id") < 5, "update").otherwise("none").alias("change"))
    runs.recorded(changes, log, "a", lambda df: df.write.parquet(f"file://{tmp_path}/a"))

    def broken(df):
        df.select(F.when(F.col("id") == 9, F.raise_error(F.lit("no more"))).otherwise(F.col("id"))).write.mode("overwrite").parquet(f"file://{tmp_path}/b")

    with pytest.raises(Exception, match="no more"):
        runs.recorded(changes, log, "b", broken)
    found = {r.run: r for r in runs.runs(spark, log).collect()}
    assert (found["a"].status, found["a"].fetched, found["a"].created, found["a"].updated, found["a"].error) == ("completed", 10, 3, 2, None)
    assert (found["b"].status, found["b"].fetched) == ("failed", None) and "no more" in found["b"].error
    assert all(r.started_at <= r.completed_at for r in found.values())
    runs.recorded(changes, log, "b", lambda df: df.write.mode("overwrite").parquet(f"file://{tmp_path}/b"))
    assert sorted((r.run, r.status) for r in runs.runs(spark, log).collect()) == [("a", "completed"), ("b", "completed")]


def test_runs_of_streams(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[(1, "insert"), (2, "update")], [(3, "insert")]], "id long, change string")
    log = f"file://{tmp_path}/log"
    streams.per_batch(stream, f"file://{tmp_path}/cp", runs.recorded_batches(log, lambda df, n: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch={n}"))).awaitTermination(120)
    assert sorted((r.run, r.status, r.fetched, r.created, r.updated) for r in runs.runs(spark, log).collect()) == [("batch-0", "completed", 2, 1, 1), ("batch-1", "completed", 1, 1, 0)]

    listener = runs.BatchLog("feed")
    spark.streams.addListener(listener)
    try:
        stream.observe("feed", *runs.counts()).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(120)
        failing = stream.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("cut off")).cast("long")).otherwise(F.col("id")))
        with pytest.raises(Exception, match="cut off"):
            failing.observe("feed", *runs.counts()).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp3").trigger(availableNow=True).start().awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(50):
            if sum(r[1] == "failed" for r in listener.rows):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    taken = listener.take(spark).collect()
    assert sorted((r.run, r.fetched) for r in taken if r.status == "completed")[:1] == [("feed-0", 2)] and any(r.fetched == 1 for r in taken)
    assert ["cut off" in r.error for r in taken if r.status == "failed"] == [True] and listener.rows == []


def test_messages_survive_a_kill_between_sinks(spark, tmp_path):
    box = outbox.Outbox(spark, f"file://{tmp_path}/box")
    computed, got = [], {"a": [], "b": []}

    def messages(n):
        def made():
            computed.append(n)
            return outbox.detector_messages(spark.range(n * 10, n * 10 + 7).withColumn("term", F.lit("t")), "spikes", 3)

        return made

    def sink(name, broken=False):
        def take(df, key):
            if broken:
                raise OSError("gone")
            got[name] += [(key, json.loads(r.payload)) for r in df.collect()]

        return take

    assert box.put(1, "spikes", messages(1)) and not box.put(1, "spikes", messages(1)) and computed == [1]
    with pytest.raises(OSError):
        box.send({"a": sink("a"), "b": sink("b", broken=True)})
    box.put(2, "spikes", messages(2))
    assert outbox.Outbox(spark, f"file://{tmp_path}/box").send({"a": sink("a"), "b": sink("b")}) == 3
    assert box.send({"a": sink("a"), "b": sink("b")}) == 0
    for rows in got.values():
        assert sorted(x["id"] for _, payload in rows for x in payload) == [*range(10, 17), *range(20, 27)] and all(len(p) <= 3 for _, p in rows)
    assert outbox.detector_messages(spark.range(0), "spikes").count() == 0


def test_cooldown_equals_the_loop(spark):
    rng = random.Random(2)
    rows, at = [], 0
    for k in range(20):
        at = 0
        for _ in range(rng.randint(1, 120)):
            at += rng.choice([0, 1, 100, 800, 899, 900, 901, 1000, 5000])
            rows.append((len(rows), f"k{k}", at))
    expected = {}
    for i, k, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        last = expected.get(k, [])
        if not last or s - last[-1][1] >= 900:
            expected[k] = [*last, (i, s)]
    df = spark.createDataFrame(rows + [(-1, None, 5)], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = {}
    for r in hl.with_cooldown(df, F.col("k"), "ts", 15).collect():
        found.setdefault(r.k, []).append((r.id, r.s))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert hl.with_cooldown(df.limit(0), F.col("k"), "ts", 15).count() == 0

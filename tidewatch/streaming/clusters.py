"""Clusters of headlines as a stream: each batch meets the live clusters only, by an index of their words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.headlines import best_earlier, roots_of, set_chains, title_sets
from ..storage import scratch, written
from .streams import per_batch
from .versions import put, version

ARTICLES = "cluster_id long, id long, at long, key binary, words array<string>"
CLUSTERS = "cluster_id long, articles long, sources array<string>, best struct<tier: int, at: long, id: long, title: string>, created long, updated long"


def merged(clusters: DataFrame) -> DataFrame:
    """Rows of one cluster as one: counts add up, sources are united, the best headline has the lowest tier and is the latest of those."""
    sums = clusters.groupBy("cluster_id").agg(
        F.sum("articles").alias("articles"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.max_by("best", F.struct(-F.col("best.tier"), F.col("best.at"), -F.col("best.id"))).alias("best"), F.min("created").alias("created"), F.max("updated").alias("updated"),
    )
    return sums


def cluster_stream(headlines: DataFrame, table: str, out: str, checkpoint: str, stop_words: list[str], threshold: float = 0.30, ttl_hours: int = 6, most: int | None = None) -> StreamingQuery:
    """(id, cluster_id) of each batch's headlines (id, title, source, tier, published_at) in out, by batch; the live clusters in `table`-clusters, by version.

    A headline joins the cluster of the most alike earlier headline, from the threshold on; of equally alike ones the earliest. It meets
    every headline of the clusters that were live before its batch, however old, and those of its batch that are at most ttl_hours older. A cluster is live
    for a headline until ttl_hours after the cluster's last one. After a batch, clusters that are older than that by the newest time of all go; all others
    stay. Only who asks for `most` keeps those that were updated last (of equal times the later id), and loses what would have joined the others.
    A headline that comes again while its cluster is live is left out; titles of fewer than two words have no cluster.

    The index is a table of the live clusters' distinct word sets; only new headlines look for partners. A batch writes its own version of
    each table, so one that runs twice ends as one that runs once."""
    ttl = ttl_hours * 3600

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            articles, clusters = version(spark, f"{table}-articles", n - 1, ARTICLES), version(spark, f"{table}-clusters", n - 1, CLUSTERS)
            rows = batch.dropDuplicates(["id"]).join(articles.select("id"), "id", "left_anti").select("id", "title", "source", "tier", "published_at")
            rows = written(rows, "headlines")
            sets = written(title_sets(rows, stop_words), "sets")
            nodes, members = set_chains(sets.select("id", "at", "key"), ttl)
            nodes = written(nodes.select("head", "at", "last").join(sets.select(F.col("id").alias("head"), "words"), "head"), "nodes")
            live = articles.filter("words is not null").join(clusters.select("cluster_id", F.col("updated").alias("last")), "cluster_id")
            live = written(live.select("cluster_id", F.col("id").alias("head"), "at", "last", "words"), "live")
            best = best_earlier(nodes, live.drop("cluster_id"), threshold, ttl)
            roots = roots_of(nodes.select("head").join(best, "head", "left").select("head", F.coalesce("root", "head").alias("root")))
            known = roots.join(live.select(F.col("head").alias("root"), "cluster_id"), "root", "left").select("head", F.coalesce("cluster_id", "root").alias("cluster_id"))
            found = written(sets.join(members, ["key", "at"]).join(known, "head").select("id", "at", "key", "cluster_id", F.when(F.col("id") == F.col("head"), F.col("words")).alias("words")), "found")
            found.select("id", "cluster_id").write.mode("overwrite").parquet(f"{out}/batch={n}")

            best_headline = F.struct(F.col("tier").cast("int").alias("tier"), "at", "id", "title")
            new = found.join(rows.select("id", "title", "source", "tier"), "id").groupBy("cluster_id").agg(
                F.count("*").alias("articles"), F.collect_set("source").alias("sources"), F.max_by(best_headline, F.struct(-F.col("tier"), "at", -F.col("id"))).alias("best"), F.min("at").alias("created"), F.max("at").alias("updated"),
            )
            after = written(merged(clusters.unionByName(new)), "clusters")
            newest = after.agg(F.max("updated").alias("newest"))
            kept = after.join(F.broadcast(newest)).filter(F.col("newest") - F.col("updated") <= ttl).drop("newest")
            kept = written(kept.orderBy(F.desc("updated"), F.desc("cluster_id")).limit(most) if most is not None else kept, "kept")
            # a set that its cluster holds already is no node again
            again = found.join(articles.filter("words is not null").select("cluster_id", "key"), ["cluster_id", "key"], "left_semi").select("id").withColumn("again", F.lit(True))
            fresh = found.join(again, "id", "left").select("cluster_id", "id", "at", "key", F.when(F.col("again").isNull(), F.col("words")).alias("words"))
            put(articles.unionByName(fresh).join(kept.select("cluster_id"), "cluster_id", "left_semi"), f"{table}-articles", n)
            put(kept, f"{table}-clusters", n)

    return per_batch(headlines, checkpoint, work)

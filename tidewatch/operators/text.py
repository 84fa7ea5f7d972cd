"""Classification, place and entity look-up of headlines by dictionaries.

Dictionaries that are tables are broadcast up to a counted bound and joined with a shuffle beyond it; lists are parameters of a fixed size: weights of contained keywords become one sum of
conditions, membership of n-grams an equi join with a broadcast dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import AFTER, BEFORE, clamp, contains_any, domain_of, half_up, precision_of, quoted
from .dictionary import BOUND, names_of, owned, small, texts_with, texts_with_whole_words


def weight_of(text: Column, keywords: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the keywords that the text holds; overlapping ones all count."""
    found = F.lit(0)
    for word, weight in keywords:
        found = found + F.when(F.contains(text, F.lit(word)), weight).otherwise(0)
    return found


def classify_events(df: DataFrame, text: str, keywords: list[tuple[str, str, int]], types: list[str], severity: list[tuple[str, int]], reliability: Column, fallback: str = "alert") -> DataFrame:
    """Adds event_type (the type of the highest weight, the first of equal ones), margin points and severity."""
    low = F.lower(F.col(text))
    df = df.withColumn("_w", F.array(*(weight_of(low, [(w, n) for t, w, n in keywords if t == kind]).cast("int") for kind in types)))
    best, second = F.array_max("_w"), F.element_at(F.sort_array("_w", False), 2)
    kind = F.when(best == 0, fallback).otherwise(F.element_at(F.array(*map(F.lit, types)), F.array_position("_w", best).cast("int")))
    return df.select(*[c for c in df.columns if c != "_w"], *judged(kind, best, second, weight_of(low, severity), reliability))


def judged(kind: Column, best: Column, second: Column, severe: Column, reliability: Column) -> list[Column]:
    """event_type, margin points and severity by the weights of the best and the second type and of severity words."""
    lead = best - second
    margin = F.when(best == 0, -20).when(lead >= 10, 10).when(lead >= 5, 5).when(lead >= 2, 0).otherwise(-5)
    points = (margin + half_up((reliability - 60) / F.lit(4.0))).cast("long")
    return [kind.alias("event_type"), points.alias("points"), clamp(2 + severe, 1, 5).cast("long").alias("event_severity")]


def classify_by_tables(df: DataFrame, key: str, text: str, keywords: DataFrame, severity: DataFrame, reliability: Column, fallback: str = "alert", most: int = BOUND) -> DataFrame:
    """classify_events with tables of any number of words: keywords (word, event_type, weight, seq) with weights above 0, and severity (word, weight).

    Texts meet only words whose first letters they hold. Of types of equal weight the one whose first word has the smallest
    seq wins. key is unique; rows without key or text have no words."""
    order = F.min("seq").over(Window.partitionBy("event_type"))
    words = keywords.select(F.lower("word").alias("word"), "event_type", "weight", order.alias("order"))
    texts = df.select(key, text)
    kinds = texts_with(texts, key, text, words, most).groupBy(key, "event_type", "order").agg(F.sum("weight").alias("w"))
    # an entry for each type of a text, the best first
    kinds = kinds.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "order", F.col("event_type").alias("kind")))).alias("_kinds"))
    severe = texts_with(texts, key, text, severity.select(F.lower("word").alias("word"), "weight"), most).groupBy(key).agg(F.sum("weight").alias("_severe"))
    joined = df.join(kinds, key, "left").join(severe, key, "left")
    best, second = (F.coalesce(-F.get("_kinds", F.lit(i))["w"], F.lit(0)) for i in (0, 1))
    kind = F.coalesce(F.get("_kinds", F.lit(0))["kind"], F.lit(fallback))
    return joined.select(*df.columns, *judged(kind, best, second, F.coalesce("_severe", F.lit(0)), reliability))


def classify_threat(text: Column, threats: list[tuple[str, str, str]], exclusions: list[str], confidence: dict[str, float], bounds: dict[str, str] | None = None, actions: tuple[str, ...] = (), targets: tuple[str, ...] = (), escalated: float = 0.85) -> Column:
    """Level, category and confidence by the first keyword in order; excluded texts are info.

    A keyword matches anywhere, or as bounds has it: as a whole word (word), where no word goes on behind it (trailing) or
    where none comes before it (leading). A high military or conflict match with an action and a target is critical."""
    low = F.lower(text)
    around = {"word": (BEFORE, AFTER), "trailing": ("", "(?![A-Za-z0-9_-])"), "leading": (BEFORE, "")}

    def holds(words: tuple[str, ...]) -> Column:
        return low.rlike(f"{BEFORE}(?:{quoted(list(words))}){AFTER}") if words else F.lit(False)

    def made(level: str, category: str, sure: float | None = None) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), F.lit(confidence[level] if sure is None else sure).alias("confidence"))

    out = F.when(contains_any(text, exclusions), made("info", "general"))
    for level, word, category in threats:
        before, after = around.get((bounds or {}).get(word, ""), ("", ""))
        hit = low.rlike(before + quoted([word]) + after)
        if level == "high" and category in ("military", "conflict") and actions and targets:
            out = out.when(hit & holds(actions) & holds(targets), made("critical", category, escalated))
        out = out.when(hit, made(level, category))
    return out.otherwise(made("info", "general"))


def geocode(df: DataFrame, key: str, texts: list[str], gazetteer: DataFrame, longest: int = 3) -> DataFrame:
    """The place of the first text that names one: the longest n-gram in the gazetteer, then the most important, then the first."""
    found = []
    for rank, text in enumerate(texts):
        words = F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[,.()\[\]:;'\"!?]", " "), r"\s+"), lambda w: w != "")
        found.append(F.struct(F.lit(rank).alias("rank"), words.alias("words")))
    gazetteer = gazetteer.filter("name is not null")
    names = names_of(gazetteer, "name")
    grams = df.select(key, F.explode(F.array(*found)).alias("t")).select(key, "t.rank", "t.words")

    def of_length(n: int):
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        every = F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice("words", i, n), " ").alias("gram")))
        # names are looked up in the row, so that only hits become rows
        return every if names is None else F.filter(every, lambda g: g["gram"].isin(names))

    grams = grams.select(key, "rank", F.explode(F.flatten(F.array(*map(of_length, range(1, longest + 1))))).alias("g")).select(key, "rank", "g.*")
    hits = grams.join(small(gazetteer), F.col("gram") == F.col("name"))
    order = Window.partitionBy(key).orderBy("rank", F.desc("n"), F.desc("importance"), "at", F.desc("seq"))
    return hits.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(key, F.col("name").alias("place"), "latitude", "longitude", "country")


def located_items(articles: DataFrame, keywords: list[tuple[str, str, int]], types: list[str], severity: list[tuple[str, int]], reliability: list[tuple[str, int]], gazetteer: DataFrame, radius_km: dict[int, float], text: str = "title", places_in: tuple[str, ...] = ("title",)) -> DataFrame:
    """Raw items of normalised articles (external_id, title, domain, occurred_at) of which one of the columns places_in names a place, the first of them that does: type and severity by
    keywords of the column text, confidence from 15 to 85 by six tenths of the domain's reliability and the points of the type, place with the precision and radius of its importance."""
    reliable = domain_reliability(F.col("domain"), reliability)
    known = classify_events(articles, text, keywords, types, severity, reliable)
    places = geocode(articles, "external_id", list(places_in), gazetteer).join(small(gazetteer.select(F.col("name").alias("place"), "importance")), "place")
    radius = F.lit(None).cast("double")
    for importance, km in radius_km.items():
        radius = F.when(F.col("importance") == importance, km).otherwise(radius)
    confidence = clamp(half_up(reliable * 0.6) + F.col("points"), 15, 85)
    return known.join(places, "external_id").select(
        "external_id", "title", "event_type", F.col("event_severity").alias("severity"), confidence.cast("long").alias("confidence_score"), F.when(confidence >= 75, "partial").otherwise("unverified").alias("verification_status"),
        "latitude", "longitude", "country", F.when(F.col("importance") == 1, F.col("place")).alias("city"), radius.alias("location_radius_km"), precision_of(F.col("importance")).alias("geolocation_precision"), "occurred_at",
    )


def extract_entities(df: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """Entities whose words the text holds as whole words: (key, entity, position). Entities are (entity, word), or (entity, word, kind, seq) with kind
    keyword or alias: then a word that several entities list belongs to the last of them by seq, within its kind, and the position is that of an alias only where no keyword is found."""
    words = owned(entities) if "kind" in entities.columns else entities.withColumn("kind", F.lit("keyword"))
    hits = texts_with_whole_words(df, key, text, words.select("entity", "word", "kind"))
    at = F.col("at").cast("long")
    return hits.groupBy(key, "entity").agg(F.coalesce(F.min(F.when(F.col("kind") == "keyword", at)), F.min(at)).alias("position"))


def looked_up(df: DataFrame, on: Column, dictionary: DataFrame, name: str, value: str, default) -> DataFrame:
    """The dictionary's value for an expression, or the default."""
    table = small(dictionary.select(F.col(name).alias("_name"), F.col(value).alias("_value")))
    return df.join(table, on == F.col("_name"), "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_name", "_value")


def source_tiers(df: DataFrame, name: Column, url: Column, tiers: DataFrame, default: int = 4) -> DataFrame:
    """source_tier by the source's name in lower case, else by the host of its address without www., else the default. Tiers are
    (name, tier), a list of feeds; of equal names the last by seq counts."""
    known = tiers.groupBy(F.lower("name").alias("_name")).agg(F.max_by("tier", "seq").alias("_tier"))
    by_name = small(known.select(F.col("_name").alias("_n"), F.col("_tier").alias("_nt")))
    by_host = small(known.select(F.col("_name").alias("_h"), F.col("_tier").alias("_ht")))
    found = df.join(by_name, F.lower(name) == F.col("_n"), "left").join(by_host, domain_of(url) == F.col("_h"), "left")
    return found.withColumn("source_tier", F.coalesce("_nt", "_ht", F.lit(default))).drop("_n", "_nt", "_h", "_ht")


def domain_reliability(domain: Column, scores: list[tuple[str, int]], default: int = 58) -> Column:
    """The score of the first entry that the domain contains."""
    out = None
    for part, score in scores:
        hit = F.contains(F.lower(domain), F.lit(part))
        out = F.when(hit, score) if out is None else out.when(hit, score)
    return out.otherwise(default) if out is not None else F.lit(default)


def importance(text: Column, tiers: list[tuple[str, int, int, list[str]]], demotions: list[str]) -> Column:
    """Points of a title: base and bonus for each match of a tier, 30 less for a demotion, 0 at least."""
    low, total = F.lower(text), F.lit(0)
    for _, base, bonus, words in tiers:
        n = weight_of(low, [(w, 1) for w in words])
        total = total + F.when(n > 0, base + n * bonus).otherwise(0)
    return F.greatest(F.lit(0), total - F.when(contains_any(text, demotions), 30).otherwise(0)).cast("long")


SUFFIXES = ["", "s", "es", "ed", "d", "ing", "er", "ers", "or", "ion", "ions", "ment", "ments", "ly"]


def _with_suffixes(base: Column) -> Column:
    return F.array(*(F.concat(base, F.lit(s)) for s in SUFFIXES))


def keyword_matches(df: DataFrame, key: str, text: str, keywords: DataFrame, min_length: int = 4) -> DataFrame:
    """(key, keyword): keywords that a text holds, single words with inflections, phrases word by word in order.

    Inflections of keywords of min_length or more are listed once in the dictionary (a final e may fall), so texts
    are only cut into words and phrases and joined with it."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^A-Za-z0-9_]+"), lambda w: w != "")
    low = F.lower("keyword")
    stem = F.when(low.endswith("e"), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)
    forms = F.array_union(_with_suffixes(low), _with_suffixes(stem))
    single = ~F.contains(low, F.lit(" "))
    table = keywords.select("keyword", F.explode(F.when(single & (F.length(low) >= min_length), forms).otherwise(F.array(low))).alias("form")).filter((F.col("form") != "") & (single | (F.col("form") == low)))
    longest = 3
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w")))
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    found = df.select(key, words.alias("w")).filter(F.size("w") > 0).select(key, F.explode(F.array_distinct(grams)).alias("form"))
    return found.join(small(table), "form").select(key, "keyword").distinct()


def affiliation(df: DataFrame, flags: DataFrame, sides: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Adds the flag of the id's first three digits and the flag's affiliation, neutral where none is listed."""
    df = df.withColumn("_mid", F.substring(F.col(id_col).cast("string"), 1, 3)).join(small(flags.withColumnRenamed("prefix", "_mid")), "_mid", "left").drop("_mid")
    return df.join(small(sides), "flag", "left").withColumn("side", F.coalesce("side", F.lit("neutral")))


def ship_type(code: Column) -> Column:
    """The name of a ship type by its number's decade, with single numbers in the thirties."""
    tens = F.floor(code / 10)
    out = F.when(code == 30, "fishing").when(code == 35, "military").when(code == 36, "sailing").when(code == 37, "pleasure")
    for decade, name in ((2, "wing in ground"), (4, "high speed"), (5, "special"), (6, "passenger"), (7, "cargo"), (8, "tanker")):
        out = out.when(tens == decade, name)
    return out.otherwise("other")

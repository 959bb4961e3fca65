"""The older daily digest: topic filter, signal score, hard cap, sections by topic score."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..functions import markup, rules, scores
from ..operators import dedup
from ..operators.durable import durable
from ..sources.store import write_text

MOST = 10
# Fixed value: the questions that close a digest.
GUIDE = """---

**Analysis Guide**
1. **Trends** — Which topics are gaining momentum? What's the signal vs. noise?
2. **Surprises** — What's unexpected or counter-intuitive in today's digest?
3. **Connections** — How do items across different topics relate to each other?
4. **Action Items** — What concrete next steps does this suggest?
5. **Questions** — What important questions does this raise that aren't answered here?

---
_Generated by storyline_"""


def scored_items(items: DataFrame, weights: DataFrame, config: dict, now, strict: bool = True) -> DataFrame:
    """Items with a topic, with topics, hours_old, keyword_density and score.

    ``items`` has seq, url, title, source, published, collected_at, points,
    is_release; ``weights`` (source, weight) may repeat a source: the last by seq wins.
    Not ``strict``, a configuration without topics keeps all items.
    """
    last = weights.groupBy("source").agg(F.max_by("weight", "seq").alias("weight"))
    tagged = items.withColumn("topics", rules.topics_by_rules(F.col("title"), config))
    found = tagged.where(F.size("topics") > 0) if config or strict else tagged
    aged = found.withColumn("hours_old", scores.hours_old(F.col("published"), F.col("collected_at"), F.lit(now))).withColumn(
        "keyword_density", rules.keyword_density(F.col("title"), config)
    )
    score = scores.signal_score(F.col("weight"), F.col("points"), F.col("keyword_density"), F.coalesce("is_release", F.lit(False)), F.col("hours_old"))
    return aged.join(last, "source", "left").withColumn("score", score).drop("weight")


def hard_cap(items: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` best items; equal scores in order of arrival."""
    return items.orderBy(F.desc("score"), "seq").limit(most)


def sections(items: DataFrame) -> DataFrame:
    """``(topic, n, topic_score, section)`` of items by their first topic.

    Sections are ranked by size (ties by first appearance in score order), then
    scored by that rank, their share and their age, and ordered by score.
    """
    topic = F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("uncategorized"))
    first = F.min(F.struct(-F.col("score"), F.col("seq")))
    grouped = items.groupBy(topic.alias("topic")).agg(F.count("*").alias("n"), F.avg("hours_old").alias("hours"), first.alias("_first"))
    # From here on there is a row per topic.
    rank = 1 / F.row_number().over(Window.orderBy(F.desc("n"), "_first"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    scored = grouped.withColumn("topic_score", scores.topic_score(rank, share, scores.hotness(F.col("hours"))))
    return scored.select("topic", "n", "topic_score", F.row_number().over(Window.orderBy(F.desc("topic_score"), "topic")).alias("section"))


def digest_markdown(items: DataFrame, day: str, stats: dict) -> str:
    """The digest as text; ``items`` are at most a digest's (hard_cap bounds them)."""
    ranked = items.withColumn("topic", F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("uncategorized"))).join(sections(items), "topic")
    rows = ranked.orderBy("section", F.desc("score"), "seq").select(
        markup.heading(F.col("topic")).alias("heading"), markup.badge(F.col("topic_score")).alias("badge"), "topic_score", "title", "url", "source",
        F.replace(F.format_number("score", 1), F.lit(",")).alias("score"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("is_new", F.lit(False)).alias("is_new"),
    ).collect()
    lines = [f"# News Digest — {day}", "", f"_Collected: {stats.get('collected', 0)} | Filtered: {stats.get('filtered', 0)} | Kept: {stats.get('kept', 0)} | Cost: ${stats.get('cost', 0.0):.4f}_", ""]
    before, n = None, 0
    for row in rows:
        if row["heading"] != before:
            lines += [f"## {row['heading']}" + (f" (score: {row['badge']})" if row["topic_score"] > 0 else ""), ""]
            before, n = row["heading"], 0
        n += 1
        lines += [f"{n}. [{'[NEW] ' if row['is_new'] else ''}{row['title']}]({row['url']})  ", f"   Score: {row['score']} | Source: {row['source']}"]
        lines += [f"   {row['summary']}"] * bool(row["summary"]) + [""]
    return "\n".join([*lines, GUIDE])


@dataclass(frozen=True)
class Analysis:
    """One day's digest, its items, its counts, and what is seen after it."""

    text: str
    items: DataFrame
    stats: dict
    seen: DataFrame


def analyze(items: DataFrame, seen: DataFrame | None, config: dict, now, day: str, strict: bool = True) -> Analysis:
    """The older pipeline over legacy items (seq, url, title, source, published, collected_at, points, is_release).

    Deduplicates against ``seen`` (key, seen_at) and within the batch, keeps
    items with a topic, scores them, caps them, and writes the digest.
    ``config`` has keywords, feeds (name, weight) and scoring.max_items.
    """
    spark = items.sparkSession
    keywords, most = config.get("keywords") or {}, (config.get("scoring") or {}).get("max_items", MOST)
    weights = spark.createDataFrame([(k, f["name"], float(f.get("weight", 0.1))) for k, f in enumerate(config.get("feeds") or [])], "seq long, source string, weight double")
    if seen is None:
        seen = spark.createDataFrame([], "key string, seen_at timestamp")
    # Counts come with what is written; no job counts for itself.
    counts = {name: Observation() for name in ("collected", "filtered", "kept")}
    number = F.count(F.lit(1)).alias("n")
    rows = durable(items.observe(counts["collected"], number))
    accepted = durable(dedup.dedup_items(rows, seen))
    scored = durable(scored_items(accepted, weights, keywords, now, strict).observe(counts["filtered"], number))
    capped = hard_cap(scored, most).withColumns({c: F.lit(None).cast(t) for c, t in (("summary", "string"), ("is_new", "boolean")) if c not in scored.columns})
    final = durable(capped.observe(counts["kept"], number))
    stats = {name: own.get["n"] for name, own in counts.items()} | {"cost": 0.0}
    return Analysis(digest_markdown(final, day, stats), final, stats, dedup.seen_after(seen, accepted, now))


def demo(items: DataFrame, config: dict, now, day: str) -> str:
    """The digest of a batch with nothing seen before, kept or written; without topics all items go in."""
    return "_Demo: nothing is saved_\n\n" + analyze(items, None, config, now, day, strict=False).text


def write_digest(spark, result: Analysis, folder: str, day: str, seen_path: str, now: str) -> None:
    """The digest, what is seen and the last run's status, each whole or not at all."""
    folder = folder.rstrip("/")
    write_text(spark, f"{folder}/digests/{day}.md", result.text)
    dedup.write_seen(result.seen, seen_path)
    write_text(spark, f"{folder}/state/last_run.json", last_run(now, True, result.stats["collected"], result.stats["kept"]))


def last_run(timestamp: str, success: bool, collected: int, kept: int) -> str:
    """The status file's JSON."""
    return json.dumps({"timestamp": timestamp, "status": "success" if success else "failure", "items_collected": collected, "items_kept": kept}) + "\n"

"""The older deduplication: seen urls with a time to live, and greedy acceptance by title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..sources.store import replace_folder
from .durable import durable
from .similarity import DUPLICATE_THRESHOLD, similar_titles

MAX_AGE_DAYS = 90


def parse_seen(lines: DataFrame, now, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """``(key, seen_at)`` of lines "<sha-256> <ISO time>" not older than ``max_age_days``; malformed ones are dropped."""
    parts = F.split(F.trim("value"), " ")
    rows = lines.where(F.size(parts) == 2).select(parts[0].alias("key"), parts[1].try_cast("timestamp").alias("seen_at"))
    return rows.where(F.col("seen_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days)))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    return items.withColumn("key", F.sha2("url", 256)).join(seen.select("key"), "key", "left_anti").drop("key")


def seen_after(seen: DataFrame, accepted: DataFrame, now) -> DataFrame:
    """``(key, seen_at)``: what was seen and the accepted items' urls, these as of ``now``."""
    new = accepted.select(F.sha2("url", 256).alias("key"), F.lit(now).cast("timestamp").alias("seen_at"))
    return seen.select("key", "seen_at").unionByName(new).groupBy("key").agg(F.max("seen_at").alias("seen_at"))


def write_seen(seen: DataFrame, path: str) -> None:
    """Lines as parse_seen reads them, in a folder that takes the old one's place when it is whole."""
    stamp = F.date_format("seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    replace_folder(seen.sparkSession, path, lambda beside: seen.select(F.concat_ws(" ", "key", stamp)).write.text(beside))


def dedup_items(items: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The accepted rows of ``items`` (seq, url, title, ...), in the order of seq.

    An item is refused for a url seen before or accepted earlier, or a title
    too similar to an accepted one; a refused item does not mark its url.
    Items without an equal url or similar title are accepted at once. The rest
    is settled in rounds: an item before which no rival is left undecided is
    accepted, its later rivals are refused. A round's work is a few minima by
    url and title, so no group of rivals meets in one task; rounds are as many
    as the longest chain of decisions that wait for each other.
    """
    rows = durable(unseen(items, seen) if seen is not None else items)
    low = durable(rows.select("seq", "url", F.lower("title").alias("low")))
    titled = low.select(F.col("low").alias("title")).distinct()
    pairs = similar_titles(titled, DUPLICATE_THRESHOLD, strict=True, autojunk=False)
    # The later title comes first in the ratio.
    rivals = pairs.where("forth").select(F.col("a").alias("later"), F.col("b").alias("earlier"))
    rivals = durable(rivals.unionByName(pairs.where("back").select(F.col("b").alias("later"), F.col("a").alias("earlier"))))
    met = rivals.select(F.col("later").alias("low")).unionByName(rivals.select(F.col("earlier").alias("low"))).distinct()
    crowded = low.groupBy("url").count().where("count > 1").select("url"), low.groupBy("low").count().where("count > 1").select("low").unionByName(met).distinct()
    contested = low.join(crowded[0].withColumn("u", F.lit(1)), "url", "left").join(crowded[1].withColumn("t", F.lit(1)), "low", "left")
    contested = durable(contested.withColumn("open", F.col("u").isNotNull() | F.col("t").isNotNull()).select("seq", "url", "low", "open"))
    accepted = [contested.where("not open").select("seq")]
    open_ = contested.where("open").select("seq", "url", "low")
    while not open_.isEmpty():
        by_url = open_.groupBy("url").agg(F.min("seq").alias("url_first"))
        by_title = open_.groupBy("low").agg(F.min("seq").alias("title_first"))
        near = rivals.join(by_title, F.col("earlier") == F.col("low")).groupBy("later").agg(F.min("title_first").alias("rival_first"))
        judged = open_.join(by_url, "url").join(by_title, "low").join(near.withColumnRenamed("later", "low"), "low", "left")
        first = (F.col("seq") == F.col("url_first")) & (F.col("seq") == F.col("title_first")) & (F.col("seq") <= F.coalesce("rival_first", F.col("seq")))
        judged = durable(judged.select("seq", "url", "low", first.alias("won")))
        won = judged.where("won")
        accepted.append(won.select("seq"))
        lost = won.select(F.col("low").alias("earlier"), F.col("seq").alias("since")).join(rivals, "earlier").groupBy(F.col("later").alias("low")).agg(F.min("since").alias("since"))
        # An accepted item is the first of its url and its title, so whatever shares these is later.
        left = judged.where("not won").join(won.select("url"), "url", "left_anti").join(won.select("low"), "low", "left_anti").join(lost, "low", "left")
        open_ = durable(left.where("since is null or since > seq").select("seq", "url", "low"))
    return rows.join(reduce(DataFrame.unionByName, accepted), "seq", "left_semi")

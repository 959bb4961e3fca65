"""Read commands over a store's tables: topics, stories, one story, one article, sources, search answers, JSON envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import search
from ..operators.stories import in_rank_order

MOST = 25


def topic_counts(article_topics: DataFrame) -> DataFrame:
    """``(topic, articles)``: how many articles have each topic."""
    return article_topics.groupBy("topic").agg(F.count_distinct("article_id").alias("articles"))


def story_list(stories: DataFrame, members: DataFrame, status: str | None = None) -> DataFrame:
    """Stories with their numbers of articles and of sources (members: story_id, article_id, source_id)."""
    counted = members.groupBy(F.col("story_id").alias("id")).agg(F.count("article_id").alias("articles"), F.count_distinct("source_id").alias("sources"))
    chosen = stories if status is None else stories.where(F.col("status") == status)
    none = F.lit(0).cast("long")
    return chosen.join(counted, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("articles", "sources")})


def story_detail(stories: DataFrame, members: DataFrame, topics: DataFrame, story_id) -> DataFrame:
    """One story with its articles in rank order and its topics by name; no row if there is none."""
    own = F.col("story_id") == F.lit(story_id)
    ranked = members.where(own).groupBy("story_id").agg(in_rank_order("article_id").alias("articles"))
    tagged = topics.where(own).groupBy("story_id").agg(F.sort_array(F.collect_list("topic")).alias("topics"))
    return stories.where(F.col("id") == F.lit(story_id)).join(ranked.withColumnRenamed("story_id", "id"), "id", "left").join(tagged.withColumnRenamed("story_id", "id"), "id", "left")


def article_detail(articles: DataFrame, members: DataFrame, topics: DataFrame, article_id) -> DataFrame:
    """One article with the story that holds it and its topics by name."""
    own = F.col("article_id") == F.lit(article_id)
    held = members.where(own).select(F.col("article_id").alias("id"), "story_id")
    tagged = topics.where(own).groupBy(F.col("article_id").alias("id")).agg(F.sort_array(F.collect_list("topic")).alias("topics"))
    return articles.where(F.col("id") == F.lit(article_id)).join(held, "id", "left").join(tagged, "id", "left")


def source_list(sources: DataFrame, mentions: DataFrame) -> DataFrame:
    """All sources with how many articles each mentions."""
    counted = mentions.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("articles"))
    return sources.join(counted, "id", "left").withColumn("articles", F.coalesce("articles", F.lit(0).cast("long")))


def highlighted(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """``text`` with marks around each whole word that is one of ``terms``."""
    wanted = "|".join(sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, rf"(?iU)(?<![\p{{L}}\p{{N}}])({wanted})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}") if wanted else text


def search_answer(rows: DataFrame, terms: list[str], most: int = MOST, key: str = "id", text: str = "title") -> DataFrame:
    """The ``most`` best texts that hold every term: ``(key, rank, highlight)``, ties by key."""
    index = search.postings(rows, key, text)
    found = search.bm25(index, terms, key, search.sizes(rows, text)).join(search.matches_all(index, terms, key), key, "left_semi")
    return found.orderBy(F.desc("rank"), key).limit(most).join(rows, key).select(key, "rank", highlighted(F.col(text), terms).alias("highlight"))


def envelope(rows: DataFrame, command: str) -> DataFrame:
    """One row a result row, as JSON that says which command it answers: {"command", "data"}."""
    return rows.select(F.to_json(F.struct(F.lit(command).alias("command"), F.struct(*rows.columns).alias("data"))).alias("json"))

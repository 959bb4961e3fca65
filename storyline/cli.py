"""Command line: ``init`` a folder, ``run`` a batch (fetched or stored items), ``recluster`` recent articles, print the ``brief``, the ``status`` or JSON answers; the older ``digest`` and its ``demo``."""

from __future__ import annotations

import argparse
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from pyspark.sql import DataFrame, functions as F

from .operators import dedup, search
from .operators.durable import durable
from .operators.stories import ClusterConfig
from .plans import brief, digest, query
from .plans.run import recluster, run_batch
from .sources import feeds
from .sources.config import legacy_config, load_config
from .sources.store import Store, settle_folder


EXAMPLE = "sources:\n- {id: front-page, name: Front Page, type: hn, weight: 0.3}\ntopics: {}\n"


def _members(store: Store):
    return store.read("story_articles").join(
        store.read("articles").selectExpr("id AS article_id", "origin_source_id AS source_id", "score_base", "seq"), "article_id"
    )


#: Commands whose answers are JSON lines.
ANSWERS = {
    "topics": lambda store, _: query.topic_counts(store.read("article_topics")),
    "stories": lambda store, _: query.story_list(store.read("stories"), _members(store), "active"),
    "story": lambda store, key: query.story_detail(store.read("stories"), _members(store), store.read("story_topics"), key),
    "article": lambda store, key: query.article_detail(store.read("articles"), store.read("story_articles"), store.read("article_topics"), key),
    "sources": lambda store, _: query.source_list(store.read("sources"), store.read("mentions")),
    "search": lambda store, expression: _found(store, expression or ""),
}


def _found(store: Store, expression: str) -> DataFrame:
    """The best articles that match, marked."""
    terms = [t for words, _ in search.Match(expression).leaves for t in words]
    best = search.TitleIndex(store).ranked(expression).orderBy(F.desc("rank"), "id").limit(query.MOST)
    return best.join(store.read("articles").select("id", "title", "url_canonical"), "id").select("id", "rank", query.highlighted(F.col("title"), terms).alias("title"), "url_canonical").orderBy(F.desc("rank"), "id")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="storyline")
    parser.add_argument("command", choices=("init", "run", "recluster", "brief", "status", "digest", "demo", *ANSWERS))
    parser.add_argument("--store", required=True, help="folder of the snapshots; of digests and state (digest)")
    parser.add_argument("--config", help="configuration file (init, run, digest, demo)")
    parser.add_argument("--items", help="Parquet of raw items (run), JSON lines (digest); without it the sources are fetched")
    parser.add_argument("--id", help="what story and article show; what search looks for")
    parser.add_argument("--since", type=float, default=7, help="days whose articles recluster lets go")
    parser.add_argument("--retain", type=float, help="days after which run drops briefs")
    parser.add_argument("--day", default=time.strftime("%Y-%m-%d"), help="the digest's day")
    args = parser.parse_args(argv)
    if args.command == "init":
        path = Path(args.config or "storyline.yaml")
        if path.exists():
            parser.error(f"{path} is there already")
        path.write_text(EXAMPLE, encoding="utf-8")
        return 0
    spark = SparkSession.builder.appName("storyline").getOrCreate()
    if args.command in ("digest", "demo"):
        return _legacy(spark, args, parser)
    store = Store(spark, args.store)
    if args.command == "run":
        if not args.config:
            parser.error("run needs --config")
        config = load_config(args.config)
        rows = [(s.id, s.name, s.url, s.weight, s.category) for s in config.sources]
        sources = spark.createDataFrame(rows, "id string, name string, url string, weight double, category string")
        items = spark.read.parquet(args.items) if args.items else feeds.collected(durable(feeds.fetch(spark, feeds.requests_of(config.sources, None, config.search_key))))
        print(run_batch(store, items, sources, config.topics, config.clustering or ClusterConfig(), briefs=f"{args.store}/briefs", retain_days=args.retain))
        return 0
    stories = store.read("stories")
    if stories is None:
        print("no data yet")
        return 1
    if args.command == "recluster":
        made = recluster(store, int(time.time() - args.since * 86_400), int(time.time()), load_config(args.config).clustering if args.config else None)
        print(f"reclustered: {made}")
        return 0
    if args.command in ANSWERS:
        for row in query.envelope(ANSWERS[args.command](store, args.id), args.command).toLocalIterator():
            print(row["json"])
        return 0
    if args.command == "brief":
        now = int(time.time())
        articles = store.read("articles")
        facts = store.read("story_articles").join(
            articles.selectExpr("id AS article_id", "origin_source_id AS source_id", "title", "url_original AS url", "score_base", "seq"), "article_id"
        )
        print(brief.brief_markdown(brief.brief_rows(brief.top_stories(stories, now), facts, store.read("story_topics")), now))
    else:
        row = brief.status(store.read("articles"), stories, store.read("pipeline_runs")).first()
        print(f"articles: {row['articles']}\nactive stories: {row['active_stories']}\nlast run: {row['last_finished']}")
    return 0


def _legacy(spark: SparkSession, args, parser) -> int:
    """The older pipeline's digest, kept; or its demo, which keeps nothing."""
    if not args.config:
        parser.error(f"{args.command} needs --config")
    config = legacy_config(args.config)
    if args.items:
        items = feeds.read_jsonl(spark, args.items).withColumn("seq", F.monotonically_increasing_id())
    else:
        # The demo tries each address once and not for long.
        bounds = {"attempts": 1, "timeout": 3} if args.command == "demo" else {}
        asked = feeds.legacy_requests(config, os.environ.get("TAVILY_API_KEY"))
        items = feeds.legacy_collected(durable(feeds.legacy_fetch(spark, asked, **bounds)))
    now = time.strftime("%Y-%m-%dT%H:%M:%S")
    if "collected_at" not in items.columns:
        items = items.withColumns({"collected_at": F.lit(now), "is_new": F.lit(True)})
    if args.command == "demo":
        print(digest.demo(items, config, now, args.day))
        return 0
    path = f"{args.store.rstrip('/')}/state/seen"
    seen = dedup.parse_seen(spark.read.text(path), now) if settle_folder(spark, path) else None
    result = digest.analyze(items, seen, config, now, args.day)
    digest.write_digest(spark, result, args.store, args.day, path, now)
    print(result.text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

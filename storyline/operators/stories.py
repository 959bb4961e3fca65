"""Clustering of articles into stories: exact greedy first match, run component by component."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import scores, titles, urls
from .components import connected_components
from .durable import durable
from .similarity import STORY_THRESHOLD, ratio, similar, similar_titles

DAY = 86_400
TOP_TOPICS = 5
#: Words that say nothing of a title's matter; they don't count as shared tokens.
STOP_WORDS = frozenset("a an and are as at be by for from has how in is it its new not of on or that the this to was what when who why will with you your".split())


@dataclass(frozen=True)
class ClusterConfig:
    threshold: float = STORY_THRESHOLD
    max_time_gap_days: int = 7
    min_title_words: int = 4
    canonical_delta: float = 0.1
    #: Tokens besides stop words that two titles must share, whether the most similar story is taken instead of the latest, and whether an outlet's name at the end of titles is left out.
    token_overlap: int = 0
    best_match: bool = False
    strip_outlets: bool = False
    #: Whether similar titles are sought by the approximate index instead of among all, for very many open stories.
    approximate: bool = False

    @property
    def gap(self) -> int:
        return self.max_time_gap_days * DAY


FOLD_SCHEMA = "story_id string, article_id string, is_new boolean, title string, story_type string, canonical_article_id string, first_seen long, last_updated long, step int"
#: Rows of one session that a task replays (a power of two); the rest of a longer session follows in further waves.
CHUNK = 1 << 15
#: Similar titles that an article brings along; one with more is compared with the open stories.
NEAR = 512


class Shelf:
    """Open stories by their titles' numbers, each list by recency: the later updated, then the later made, stands last."""

    def __init__(self, stories: list[dict], config: ClusterConfig) -> None:
        self.config, self.made, self.known = config, 0, {}
        self.lists: dict[tuple, list[tuple[int, int, dict]]] = {}
        self.norms: dict[str, list[tuple[int, int, dict]]] = {}
        for story in stories:
            self.put(story)

    def put(self, story: dict) -> None:
        self.made = max(self.made, story["n"] + 1)
        for own in self.lists.setdefault(tuple(story["numbers"]), []), self.norms.setdefault(story["norm"], []):
            insort(own, (story["last"], story["n"], story), key=lambda x: x[:2])

    def take(self, story: dict) -> None:
        for own in self.lists[tuple(story["numbers"])], self.norms[story["norm"]]:
            del own[bisect_left(own, (story["last"], story["n"]), key=lambda x: x[:2])]

    def alike(self, norm: str, other: str, told: bool) -> bool:
        """Whether titles are similar (``told``: that much is known) and share tokens enough."""
        if (norm, other) not in self.known:
            shared = not self.config.token_overlap or len(meaning(norm) & meaning(other)) >= self.config.token_overlap
            self.known[norm, other] = shared and (told or similar(norm, other, self.config.threshold, False, True))
        return self.known[norm, other]

    def within(self, article: dict) -> list[tuple[int, int, dict]]:
        """Stories not older than the gap, latest first: those whose title the article names as similar, or all of its numbers."""
        near, since = article.get("near"), article["collected_at"] - self.config.gap
        lists = [self.lists.get(tuple(article["numbers"]), [])] if near is None else [self.norms[n] for n in {article["norm"], *near} if n in self.norms]
        found = [x for own in lists for x in own[bisect_left(own, since, key=lambda x: x[0]) :]]
        return sorted(found, key=lambda x: x[:2], reverse=True) if len(lists) > 1 else found[::-1]

    def match(self, article: dict) -> dict | None:
        """The first story by recency that all guards let through, or with ``best_match`` the most similar of them."""
        at, found, best, told = article["collected_at"], None, -1.0, article.get("near") is not None
        topics, paper = set(article["topics"]), article["paper"]
        for last, _, story in self.within(article):
            if last - at > self.config.gap or topics and story["topics"] and not topics & story["topics"] or paper is not None and story["papers"] - {paper}:
                continue
            if self.alike(article["norm"], story["norm"], told):
                if not self.config.best_match:
                    return story
                if (value := ratio(article["norm"], story["norm"])) > best:
                    found, best = story, value
        return found

    def open_at(self, time: int) -> list[dict]:
        """Stories that an article of ``time`` or later may still join."""
        return [story for own in self.lists.values() for last, _, story in own if last >= time - self.config.gap]


def fold(stories: Shelf, new: list[dict]) -> Iterator[dict]:
    """Replays articles in order of (collected_at, seq) over open stories; yields the state of a story after each article it takes.

    An article holds article_id, title, norm, numbers, collected_at, seq,
    score_base, story_type, topics and paper, and may hold near: the titles
    that its own is similar to. Without it open stories are compared.
    """
    for article in sorted(new, key=lambda r: (r["collected_at"], r["seq"])):
        own = {"id": article["article_id"], "score": article["score_base"], "title": article["title"], "norm": article["norm"], "numbers": list(article["numbers"]), "type": article["story_type"]}
        story = stories.match(article)
        if story is None:
            story = own | {
                "last": article["collected_at"], "first": article["collected_at"], "canonical": own["id"], "leader": own, "topics": set(), "papers": set(), "n": stories.made, "step": 0, "new": True,
            }
        else:
            stories.take(story)
            leader = story["leader"]
            if story["canonical"] is None or leader is not None and own["score"] > leader["score"] + stories.config.canonical_delta:
                story["canonical"], story["leader"] = own["id"], own
            if story["leader"] is not None:
                story |= {c: story["leader"][c] for c in ("title", "norm", "numbers", "type")}
            story["last"] = max(story["last"], article["collected_at"])
        story["topics"] |= set(article["topics"])
        story["papers"] |= {article["paper"]} - {None}
        story["step"] += 1
        stories.put(story)
        yield {
            "story_id": story["id"], "article_id": own["id"], "is_new": story["new"], "title": story["title"], "story_type": story["type"],
            "canonical_article_id": story["canonical"], "first_seen": story["first"], "last_updated": story["last"], "step": story["step"],
        }


def meaning(norm: str) -> set[str]:
    """A title's tokens that are no stop words."""
    return {w for w in norm.split() if w not in STOP_WORDS}


def _nodes(articles: DataFrame, topics: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    own = topics.groupBy("article_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    norm = _norm(config or ClusterConfig())
    return (
        articles.withColumn("norm", norm)
        .join(own.withColumnRenamed("article_id", "id"), "id", "left")
        .select(
            F.col("id").alias("article_id"), "title", "norm", "collected_at", "seq", "score_base", "story_type",
            F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
            urls.paper_id(F.col("url_canonical")).alias("paper"), titles.number_tokens(F.col("norm")).alias("numbers"),
        )
    )


def _norm(config: ClusterConfig) -> Column:
    title = F.col("title")
    return titles.normalize_title(titles.without_outlet(title) if config.strip_outlets else title)


def in_rank_order(column: str) -> Column:
    """Aggregate: a story's ``column`` of its articles by score, best first, then by arrival (score_base, seq)."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score_base")).alias("k"), "seq", column)))
    return F.transform(ranked, lambda a: a[column])


def unclustered(articles: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Articles that no story holds (members: article_id)."""
    return articles.join(members.select(F.col("article_id").alias(key)), key, "left_anti")


_LEADER = pa.struct([("id", pa.string()), ("score", pa.float64()), ("title", pa.string()), ("norm", pa.string()), ("numbers", pa.list_(pa.string())), ("type", pa.string())])
_STORY = pa.struct([
    ("id", pa.string()), ("title", pa.string()), ("norm", pa.string()), ("numbers", pa.list_(pa.string())), ("type", pa.string()), ("last", pa.int64()), ("first", pa.int64()),
    ("canonical", pa.string()), ("leader", _LEADER), ("topics", pa.list_(pa.string())), ("papers", pa.list_(pa.string())), ("n", pa.int64()), ("step", pa.int32()), ("new", pa.bool_()),
])
_DONE = pa.struct([
    ("story_id", pa.string()), ("article_id", pa.string()), ("is_new", pa.bool_()), ("title", pa.string()), ("story_type", pa.string()),
    ("canonical_article_id", pa.string()), ("first_seen", pa.int64()), ("last_updated", pa.int64()), ("step", pa.int32()),
])
_REPLAYED = (
    f"component string, session long, done struct<{FOLD_SCHEMA}>, story struct<id string, title string, norm string, numbers array<string>, type string, last long, first long, canonical string, "
    "leader struct<id string, score double, title string, norm string, numbers array<string>, type string>, topics array<string>, papers array<string>, n long, step int, new boolean>"
)


def _seeds(nodes: DataFrame, stories: DataFrame, members: DataFrame, config: ClusterConfig) -> DataFrame:
    """Active stories as ``story``: title, times, canonical article, and their members' topics and papers together."""
    own = nodes.join(members, "article_id")
    known = own.groupBy("story_id").agg(F.array_distinct(F.flatten(F.collect_set("topics"))).alias("topics"), F.collect_set("paper").alias("papers"))
    leads = own.select(
        "story_id", F.col("article_id").alias("canonical"),
        F.struct(F.col("article_id").alias("id"), F.col("score_base").alias("score"), "title", "norm", "numbers", F.col("story_type").alias("type")).alias("leader"),
    )
    active = stories.where("status = 'active'").select(
        F.col("id").alias("story_id"), "title", _norm(config).alias("norm"), F.col("story_type").alias("type"), F.col("last_updated").alias("last"),
        F.col("first_seen").alias("first"), F.col("canonical_article_id").alias("canonical"),
    )
    return active.join(known, "story_id").join(leads, ["story_id", "canonical"], "left").select(F.struct(
        F.col("story_id").alias("id"), "title", "norm", titles.number_tokens(F.col("norm")).alias("numbers"), "type", "last", "first", "canonical", "leader", "topics", "papers",
        F.lit(None).cast("long").alias("n"), F.lit(0).alias("step"), F.lit(False).alias("new"),
    ).alias("story"))


def _replay(config: ClusterConfig):
    """Replays a session's articles over its stories; its stories that are still open come after what was done."""

    def replay(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = [r["story"] | {"topics": set(r["story"]["topics"]), "papers": set(r["story"]["papers"])} for r in rows if r["story"]]
        for n, story in enumerate(sorted((s for s in found if s["n"] is None), key=lambda s: (s["first"], s["id"]))):
            story["n"] = n
        shelf, new = Shelf(found, config), [r["article"] for r in rows if r["article"]]
        done = list(fold(shelf, new))
        still = shelf.open_at(max(a["collected_at"] for a in new)) if new else []
        open_ = [s | {"topics": sorted(s["topics"]), "papers": sorted(s["papers"])} for s in still]
        count = len(done) + len(open_)
        columns = [
            pa.array([rows[0]["component"]] * count, pa.string()), pa.array([rows[0]["session"]] * count, pa.int64()),
            pa.array([*done, *[None] * len(open_)], _DONE), pa.array([*[None] * len(done), *open_], _STORY),
        ]
        return pa.table(columns, names=["component", "session", "done", "story"])

    return replay


def _sessions(rows: DataFrame, gap: int) -> DataFrame:
    """``(component, bucket, session, n)``: a component's times in sessions that lie more than ``gap`` apart, and each session's rows.

    Rows are summed by buckets of ``gap`` first, so what is put in order is a
    component's buckets, not its rows.
    """
    spans = rows.groupBy("component", "bucket").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("rows"))
    order = Window.partitionBy("component").orderBy("bucket")
    begins = F.coalesce(F.col("low") - F.lag("high").over(order) > gap, F.lit(False)).cast("long")
    spans = spans.withColumn("begins", begins).withColumn("session", F.sum("begins").over(order))
    return spans.select("component", "bucket", "session", F.sum("rows").over(Window.partitionBy("component", "session")).alias("n"))


def _chunks(articles: DataFrame) -> DataFrame:
    """``articles`` with ``chunk``: their session's place in steps of CHUNK rows at most, by (collected_at, seq)."""
    order = ["component", "session", "article.collected_at", "article.seq"]
    placed = articles.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("block", F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1))
    placed = durable(placed)
    steps = placed.select("component", "session", "block").distinct()
    steps = steps.withColumn("chunk", F.row_number().over(Window.partitionBy("component", "session").orderBy("block")) - 1)
    return placed.join(steps, ["component", "session", "block"]).drop("block")


def _with_near(fresh: DataFrame, pairs: DataFrame, config: ClusterConfig) -> DataFrame:
    """``fresh`` with ``near``: the titles that an article's is similar to, itself first in the ratio; null if over NEAR, or if the pairs may lack some."""
    if config.approximate:
        return fresh.withColumn("near", F.lit(None).cast("array<string>"))
    ways = pairs.where("forth").select(F.col("a").alias("norm"), F.col("b").alias("other")).unionByName(pairs.where("back").select(F.col("b").alias("norm"), F.col("a").alias("other")))
    counted = ways.groupBy("norm").agg(F.count("*").alias("many"))
    near = ways.join(counted.where(F.col("many") <= NEAR).select("norm"), "norm", "left_semi").groupBy("norm").agg(F.collect_list("other").alias("near"))
    found = fresh.join(near, "norm", "left").join(counted, "norm", "left")
    return found.withColumn("near", F.when(F.coalesce("many", F.lit(0)) <= NEAR, F.coalesce("near", F.array().cast("array<string>")))).drop("many")


def title_pairs(articles: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """The similar titles among all articles long enough to cluster, for several calls of :func:`cluster` over them."""
    config = config or ClusterConfig()
    norms = articles.select(_norm(config).alias("title")).where(titles.word_count(F.col("title")) >= config.min_title_words).distinct()
    keyed = norms.withColumn("numbers", F.array_join(titles.number_tokens(F.col("title")), " "))
    return durable(similar_titles(keyed, config.threshold, key="numbers", approximate=config.approximate))


def cluster(
    articles: DataFrame, topics: DataFrame, stories: DataFrame | None = None, members: DataFrame | None = None, config: ClusterConfig | None = None, pairs: DataFrame | None = None,
) -> DataFrame:
    """FOLD_SCHEMA rows: each newly clustered article with its story's state after it.

    Every merge needs a similar pair of titles with equal numbers, and a
    story's titles are its new articles', its leader's or its own: so stories
    never reach over connected components of similar titles. Nor do they reach
    over a pause longer than the gap, so a component replays in sessions, apart
    from each other; a session of over CHUNK rows replays in waves, the stories
    still open being all that one wave hands to the next. A session of one
    article is a story without Python. An article brings the titles similar to
    its own along, so a replay looks stories up instead of comparing titles:
    its work is that of the links. Ties of last_updated go to the story
    made later. Only active stories take part. ``pairs`` of :func:`title_pairs`
    are taken instead of seeking similar titles again, if stories have no titles but the articles'.
    """
    config = config or ClusterConfig()
    nodes = durable(_nodes(articles, topics, config))
    fresh = nodes if members is None else unclustered(nodes, members, "article_id")
    fresh = fresh.where(titles.word_count(F.col("norm")) >= config.min_title_words)
    norms = fresh.select(F.col("norm").alias("title"), F.array_join("numbers", " ").alias("numbers"))
    ties = seeds = None
    if stories is not None and members is not None:
        seeds = durable(_seeds(nodes, stories, members, config))
        for side in ("story", "story.leader"):
            norms = norms.unionByName(seeds.select(F.col(f"{side}.norm").alias("title"), F.array_join(f"{side}.numbers", " ").alias("numbers")).where("title is not null"))
        ties = seeds.select(F.col("story.norm").alias("a"), F.col("story.leader.norm").alias("b")).where("a != b")
    if pairs is None:
        pairs = durable(similar_titles(norms.distinct(), config.threshold, key="numbers", approximate=config.approximate))
    elif seeds is not None:
        present = norms.select("title").distinct()
        for side in ("a", "b"):
            pairs = pairs.join(present.withColumnRenamed("title", side), side, "left_semi")
        pairs = durable(pairs.select("a", "b", "forth", "back"))
    links = pairs.select("a", "b")
    parts = connected_components(links if ties is None else links.unionByName(ties))
    columns = ("article_id", "title", "norm", "numbers", "collected_at", "seq", "score_base", "story_type", "topics", "paper", "near")
    rows = _with_near(fresh, pairs, config).select("norm", F.col("collected_at").alias("at"), F.struct(*columns).alias("article"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select(F.col("story.norm").alias("norm"), F.col("story.last").alias("at"), "story"), allowMissingColumns=True)
    else:
        rows = rows.withColumn("story", F.lit(None).cast(_replayed_type("story")))
    placed = rows.join(parts.withColumnRenamed("node", "norm"), "norm", "left").withColumn("component", F.coalesce("component", "norm"))
    placed = durable(placed.withColumn("bucket", F.floor(F.col("at") / max(config.gap, 1))).drop("norm"))
    placed = durable(placed.join(_sessions(placed, config.gap), ["component", "bucket"]).drop("bucket", "at"))

    alone = placed.where("n = 1 and article is not null").select(
        F.col("article.article_id").alias("story_id"), "article.article_id", F.lit(True).alias("is_new"), "article.title", "article.story_type",
        F.col("article.article_id").alias("canonical_article_id"), F.col("article.collected_at").alias("first_seen"), F.col("article.collected_at").alias("last_updated"), F.lit(1).alias("step"),
    )
    key, replay = ("component", "session"), _replay(config)
    short = placed.where(f"n > 1 and n <= {CHUNK}").select(*key, "article", "story").groupBy(*key).applyInArrow(replay, _REPLAYED)
    found = alone.unionByName(short.where("done is not null").select("done.*"))
    long = placed.where(f"n > {CHUNK}").drop("n")
    waves = _waves(long) if not long.isEmpty() else None
    if waves is not None:
        state = long.where("story is not null").select(*key, "story")
        for number in range(waves.agg(F.max("chunk")).first()[0] + 1):
            now = waves.where(F.col("chunk") == number).select(*key, "article")
            out = durable(now.unionByName(state, allowMissingColumns=True).select(*key, "article", "story").groupBy(*key).applyInArrow(replay, _REPLAYED))
            found = found.unionByName(out.where("done is not null").select("done.*"))
            state = out.where("story is not null").select(*key, "story")
    return found


def _waves(long: DataFrame) -> DataFrame:
    return durable(_chunks(long.where("article is not null").select("component", "session", "article")))


def _replayed_type(column: str):
    return T.StructType.fromDDL(_REPLAYED)[column].dataType


def effective_sources(members: DataFrame, order: list) -> DataFrame:
    """``(story_id, sources)``: distinct sources, a paper counting only for its first article by ``order``.

    ``members`` has story_id, source_id, url and the order's columns.
    """
    paper = urls.paper_id(F.col("url"))
    first = F.row_number().over(Window.partitionBy("story_id", "paper").orderBy(*order))
    counted = members.withColumn("paper", paper).withColumn("_first", first).where("paper is null or _first = 1")
    return counted.groupBy("story_id").agg(F.greatest(F.count_distinct("source_id"), F.lit(1)).alias("sources"))


def story_scores(members: DataFrame, now: int, config: ClusterConfig | None = None) -> DataFrame:
    """``(story_id, score)`` from members with story_id, source_id, url, score_base, collected_at and seq."""
    config = config or ClusterConfig()
    best = members.groupBy("story_id").agg(F.max("score_base").alias("best"), F.max("collected_at").alias("latest"))
    recent = F.col("latest") >= now - config.gap
    return best.join(effective_sources(members, [F.col("seq")]), "story_id").select("story_id", scores.story_score(F.col("best"), F.col("sources"), recent).alias("score"))


def story_topics(members: DataFrame, topics: DataFrame) -> DataFrame:
    """``(story_id, topic)``: the five most frequent topics of a story's articles, ties by name."""
    counts = members.join(topics, "article_id").groupBy("story_id", "topic").count()
    place = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("count"), "topic"))
    return counts.withColumn("_n", place).where(F.col("_n") <= TOP_TOPICS).select("story_id", "topic")


def apply_clusters(stories: DataFrame | None, members: DataFrame | None, changes: DataFrame, articles: DataFrame, now: int, config: ClusterConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Stories and members after :func:`cluster`; scores are recomputed only for stories that took an article."""
    added = changes.select("story_id", "article_id")
    all_members = added if members is None else members.unionByName(added)
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("step")))).where("_n = 1")
    facts = all_members.join(added.select("story_id").distinct(), "story_id", "left_semi").join(
        articles.select(F.col("id").alias("article_id"), F.col("origin_source_id").alias("source_id"), F.col("url_canonical").alias("url"), "score_base", "collected_at", "seq"), "article_id"
    )
    changed = last.join(story_scores(facts, now, config), "story_id").select(
        F.col("story_id").alias("id"), "title", F.lit(None).cast("string").alias("summary"), "story_type", "score", "canonical_article_id", "first_seen", "last_updated", F.lit("active").alias("status")
    )
    return (changed if stories is None else changed.unionByName(stories.join(changed, "id", "left_anti"))), all_members


def deactivate_stale(stories: DataFrame, now: int, config: ClusterConfig | None = None) -> DataFrame:
    """Active stories not updated within the gap become inactive; nothing becomes active again."""
    config = config or ClusterConfig()
    stale = (F.col("status") == "active") & (F.col("last_updated") < now - config.gap)
    return stories.withColumn("status", F.when(stale, "inactive").otherwise(F.col("status")))


def detach_since(stories: DataFrame, members: DataFrame, articles: DataFrame, since: int) -> tuple[DataFrame, DataFrame]:
    """For clustering anew: members collected from ``since`` on are let go, and stories left without any dropped."""
    late = articles.where(F.col("collected_at") >= since).select(F.col("id").alias("article_id"))
    kept = members.join(late, "article_id", "left_anti")
    return stories.join(kept.select(F.col("story_id").alias("id")), "id", "left_semi"), kept

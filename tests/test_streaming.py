from datetime import datetime, timedelta

from storyline.sources.store import Store
from storyline.streaming import live

SCHEMA = "seq long, url string, title string, source_id string, published_at long, points int, extra string, ts timestamp"


def test_upsert_stream_and_live_items(spark, tmp_path):
    sources = spark.createDataFrame([("a", 0.5)], "id string, weight double")
    rows = spark.sql("SELECT 1L seq, 'https://x.com/a' url, 'Title one' title, 'a' source_id, CAST(NULL AS LONG) published_at, 3 points, CAST(NULL AS STRING) extra, TIMESTAMP '2024-01-01 00:00:00' ts "
                     "UNION ALL SELECT 2L, 'http://www.x.com/a', 'Title two', 'a', NULL, 9, NULL, TIMESTAMP '2024-01-01 00:05:00'")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    live.upsert_stream(stream, sources, store, {"t": ["title"]}, lambda: 50, f"{tmp_path}/cp").awaitTermination()
    stored = store.read("articles").collect()
    assert [(r["title"], r["points"]) for r in stored] == [("Title one", 9)]
    query = live.live_items(stream, sources).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live").count() == 1
    assert live.hot_sources(stream).isStreaming


def test_unseen_items_expire(spark, tmp_path):
    """Micro-batches over a year: a url counts as seen for 90 days from its acceptance, and its state goes after that."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    days = [[(0, "a"), (0, "a"), (1, "b")], [(30, "a"), (89, "a"), (89, "c")], [(91, "a"), (91, "b")], [(92, "b"), (179, "a")], [(182, "a"), (183, "a"), (300, "d")], [(310, "c")]]
    query, seq, seen, expected = None, 0, {}, []
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for batch in days:
        rows = []
        for day, url in batch:
            rows.append((seq, f"https://x.com/{url}", "T", "a", None, 1, None, datetime(2024, 1, 1) + timedelta(days=day)))
            if url not in seen or day - seen[url] > 90:
                seen[url] = day
                expected.append(seq)
            seq += 1
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # Each start is a restart: state comes from the checkpoint.
        query = live.unseen_items(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == expected
    held = [p["numRowsTotal"] for p in query.lastProgress["stateOperators"]]
    assert held and held[0] < 4 * 3  # of a, b, c, d only what is younger than 90 days is left

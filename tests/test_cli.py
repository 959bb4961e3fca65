"""The commands over a store: run, search, recluster, and the older digest and demo."""

import json
import time

from storyline import cli


def said(capsys, *argv):
    assert cli.main(list(argv)) == 0
    return capsys.readouterr().out


def test_commands(spark, tmp_path, capsys):
    config, store = tmp_path / "c.yaml", str(tmp_path / "store")
    config.write_text("sources:\n- {id: a, name: A, url: http://127.0.0.1:9/none, weight: 0.5}\ntopics: {ai: [model]}\nclustering: {threshold: 0.6}\n", encoding="utf-8")
    rows = [(f"https://x.com/{k}", title, "a", int(time.time()), 5, None, k) for k, title in enumerate(["The big new model is here today", "The big new model is here today folks", "Éclairs sell out over there"])]
    schema = "url string, title string, source_id string, published_at long, points int, extra string, seq long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "items"))
    assert "story_count: 2" in said(capsys, "run", "--store", store, "--config", str(config), "--items", str(tmp_path / "items"), "--retain", "30")
    found = [json.loads(line) for line in said(capsys, "search", "--store", store, "--id", '"new model" NOT folks').splitlines()]
    assert [f["data"]["title"] for f in found] == ["The big <b>new</b> <b>model</b> is here today"] and found[0]["command"] == "search"
    assert "Éclairs" in said(capsys, "search", "--store", store, "--id", "eclair*")
    assert said(capsys, "recluster", "--store", store, "--config", str(config)) == "reclustered: 3\n"
    assert len(said(capsys, "stories", "--store", store).splitlines()) == 2
    assert "active stories: 2" in said(capsys, "status", "--store", store)


def test_digest_and_demo(spark, tmp_path, capsys):
    config, raw = tmp_path / "old.yaml", tmp_path / "raw.jsonl"
    config.write_text("feeds:\n- {name: A, url: http://127.0.0.1:9/none, weight: 0.5}\nkeywords: {ai: [model]}\n", encoding="utf-8")
    raw.write_text("\n".join(json.dumps({"url": f"https://x.com/{k}", "title": t, "source": "A", "published": "2024-01-01T00:00:00Z", "collected_at": "2024-01-02T00:00:00"}) for k, t in enumerate(["A new model", "Nothing else"])), encoding="utf-8")
    shared = ["--store", str(tmp_path / "out"), "--config", str(config), "--items", str(raw), "--day", "2024-01-02"]
    first = said(capsys, "digest", *shared)
    assert "A new model" in first and (tmp_path / "out/digests/2024-01-02.md").read_text(encoding="utf-8").strip() == first.strip()
    assert "A new model" not in said(capsys, "digest", *shared)  # seen
    assert "A new model" in said(capsys, "demo", *shared)

"""Dump layouts, export, tables and the stream."""
import json

import pytest
from pyspark.sql import functions as F

from checks.views import requests, sources
from labelaudit.sources import dumps, export as ex, tables
from labelaudit.streaming import items as st


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=2), encoding="utf-8")


@pytest.mark.parametrize("names", [
    ("src-unsafe.json", "src-bot.json"), ("src-unsafe-2024-07.json", "src-bot-2024-07.json"),
    ("src/src-unsafe.json", "src/src-bot.json"), ("src/src-unsafe-2.json", "src/src-bot-1.json")])
def test_load_source_layouts(spark, tmp_path, names):
    write(tmp_path / names[0], [{"headers": '{"h":"u"}', "request": '{"r":"u"}'}])
    write(tmp_path / names[1], [{"headers": '{"h":"b"}'}, {"request": '{"r":"c"}'}])
    write(tmp_path / "other-bot.json", [])
    got = sorted(map(tuple, dumps.load_source(spark, "src", [str(tmp_path)]).select(
        "headers", "request", "y").collect()))
    assert got == sorted([('{"h":"u"}', '{"r":"u"}', 0), ('{"h":"b"}', "{}", 1), ("{}", '{"r":"c"}', 1)])
    assert [r[0] for r in dumps.list_sources(spark, [str(tmp_path)]).collect()] == ["src"]


def test_first_match_wins(spark, tmp_path):
    write(tmp_path / "s-bot-2.json", [{"headers": "dated"}])
    write(tmp_path / "s" / "s-bot.json", [{"headers": "nested"}])
    assert dumps.find_dump(spark, [str(tmp_path)], "s", "bot").endswith("/s-bot-2.json")
    with pytest.raises(FileNotFoundError):
        dumps.find_dump(spark, [str(tmp_path)], "s", "unsafe")


def test_export_layout_and_manifest(spark, sf, tmp_path):
    root = str(tmp_path / "out")
    listed = ex.export(requests(spark, sf), sources(spark, sf), root, limit_per_group=5,
                       start="2024-01-01 00:00:00", write_empty=True)
    rows = listed.collect()
    assert len(rows) == 75 and all(0 <= r["rows"] <= 5 for r in rows)
    assert {r["scope"] for r in rows} == {"traffic_source"}
    items = spark.read.json(f"{root}/datasets/traffic_source=nation-7/label_group=bot")
    assert set(items.columns) == {"headers", "request", "decision", "campaign_id", "traffic_source_id",
                                  "datetime", "body"}
    assert items.select("decision").distinct().collect()[0][0] == "bot"


def test_overlapping_groups(spark, sf):
    grouped = ex.grouped_requests(requests(spark, sf), sources(spark, sf),
                                  {"clean": ("offer", "safe"), "offer": ("offer",)}, None)
    n = {r["label_group"]: r["count"] for r in grouped.groupBy("label_group").count().collect()}
    assert n["clean"] > n["offer"] > 0


def test_table_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,x,\n2.5,3,nan\n")
    got = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(got.dtypes) == {"a": "double", "b": "string", "c": "double"}


def test_missing_study_is_none(spark, tmp_path):
    assert tables.load_study(spark, str(tmp_path), "x") is None


def test_stream_flags(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"headers": '{"User-Agent":"curl/8"}', "request": "{}"}) + "\n"
                                   + json.dumps({"request": "{{x}}"}) + "\n" + json.dumps({"headers": "{}"}) + "\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    st.write_stream(st.flag_items(st.read_item_stream(spark, str(folder))), out, mark).awaitTermination(60)
    got = sorted(r["weak_label"] for r in spark.read.parquet(out).collect())
    assert got == [-1, 1, 1]
    assert spark.read.parquet(out).where(F.col("has_script_ua")).count() == 1


def test_a_source_saved_again_is_replaced(spark, tmp_path):
    root = str(tmp_path / "study")
    rows = lambda *r: spark.createDataFrame(r, "source string, value int")
    every = lambda d: {name: d for name in tables.STUDY_TABLES}
    tables.save_study(every(rows(("a", 1), ("a", 2), ("b", 3))), root)
    tables.save_study(every(rows(("a", 5))), root)
    found = {s: sorted(r["value"] for r in tables.load_study(spark, root, s)["summary"].collect()) for s in "ab"}
    assert found == {"a": [5], "b": [3]}


@pytest.mark.parametrize("folder", ["dumps.v1+x", "raw", "two words/raw", "src"])
def test_folder_names_are_no_patterns(spark, tmp_path, monkeypatch, folder):
    write(tmp_path / folder / "raw" / "raw-bot.json", [{"headers": "b"}])
    write(tmp_path / folder / "raw" / "raw-unsafe.json", [{"headers": "u"}])
    write(tmp_path / folder / "deep" / "er" / "x-bot.json", [])
    write(tmp_path / folder / "deep" / "er" / "x-unsafe.json", [])
    monkeypatch.chdir(tmp_path)
    for root in (str(tmp_path / folder), f"file:{tmp_path / folder}/", f"file://{tmp_path / folder}"):
        assert [r[0] for r in dumps.list_sources(spark, [root]).collect()] == ["raw"]
        got = dumps.load_source(spark, "raw", [root]).select("headers", "y").collect()
        assert sorted(map(tuple, got)) == [("b", 1), ("u", 0)]


def test_dumps_that_are_folders(spark, tmp_path):
    rows = spark.createDataFrame([("b", "{}")], "headers string, request string").repartition(2)
    for name in ("s-bot.json", "s-unsafe.json", "t/t-bot-3.json", "t/t-unsafe-3.json"):
        rows.unionByName(rows).write.json(str(tmp_path / name))
    assert [r[0] for r in dumps.list_sources(spark, [str(tmp_path)]).collect()] == ["s", "t"]
    for source in "st":
        assert dumps.load_source(spark, source, [str(tmp_path)], json_lines=True).count() == 4


def test_manifest_is_one_object(spark, sf, tmp_path):
    root = str(tmp_path / "out")
    ex.export(requests(spark, sf), sources(spark, sf), root, limit_per_group=5, start="2024-01-01 00:00:00")
    text = "".join(p.read_text() for p in (tmp_path / "out" / "manifest").glob("*.json"))
    found = json.loads(text)
    assert found["scope"] == "traffic_source"
    assert found["interval"] == {"start_inclusive": "2024-01-01 00:00:00", "end_exclusive": None}
    first = found["datasets"][0]
    assert list(first) == ex.DATASET and first["decisions"] == ["bot"] and first["rows"] <= 5
    assert spark.read.json(first["path"]).count() == first["rows"]

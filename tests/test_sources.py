import datetime as dt
import json
import os
import warnings

import pytest
from pyspark.sql import functions as F

from touchline.sources import clean, dynamic, landed, pages, tables


def test_clean_values(spark):
    df = spark.createDataFrame(
        [(float("nan"), float("inf"), dt.datetime(2024, 8, 16, 1, 2, 3), [1, 2], dt.date(2024, 1, 1), 3, "x")],
        "a double, b double, t timestamp_ntz, l array<int>, d date, i int, s string")
    r = clean.clean_values(df).first()
    assert (r.a, r.b, r.t, r.l, r.d, r.i, r.s) == (None, float("inf"), "2024-08-16T01:02:03", [1, 2], "2024-01-01", 3, "x")


def test_flatten_and_tag(spark):
    df = spark.createDataFrame([((1, ("z",)), 2)], "`Playing Time` struct<`90s`:int,` `:struct<n:string>>, k int")
    flat = clean.tag_provenance(clean.flatten_columns(df), "src", "L", "2425")
    assert flat.columns == ["Playing Time_90s", "Playing Time_n", "k", "_source", "_league", "_season"]


def test_read_landed_lines(spark, tmp_path):
    part = tmp_path / "_league=L0" / "_season=0102"
    part.mkdir(parents=True)
    (part / "a.jsonl").write_text(json.dumps({"game_id": "1", "score": "1-0", "week": 2}) + "\n\n{broken\n")
    rows = landed.read_landed(spark, str(tmp_path), "schedule").cache()
    assert {(r.game_id, r._season, r._corrupt_record) for r in rows.collect()} == {("1", "0102", None), (None, "0102", "{broken")}
    with pytest.raises(ValueError):
        landed.read_landed(spark, str(tmp_path), "nothing")


def test_wrapped_json(spark, tmp_path):
    texts = {"L_1.json": '<html><head></head><body> {"k": 1}\n</body></html>', "L_2.json": '[1]',
             "L_3.json": "<html><body><p>x</p></body></html>", "L_4.json": "<html><body>[2]", "M_1.json": "<body>[3]</body>"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    got = {r.file_name: (r.text, r.repaired) for r in landed.read_wrapped(spark, str(tmp_path), "L_").collect()}
    assert got == {"L_1.json": ('{"k": 1}', True), "L_2.json": ("[1]", False),
                   "L_3.json": (texts["L_3.json"], False), "L_4.json": ("[2]", True)}


def test_append_ignores_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, "L", "0102"), ("a", 0, "L", "0102"), ("b", 2, "L", "0102")], "k string, v int, _league string, _season string")
    assert tables.append_table(df, path, ["k", "_season"]) == (3, 2)
    assert tables.append_table(df, path, ["k", "_season"]) == (3, 0)
    back = tables.read_table(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == [("a", 0, "L", "0102"), ("b", 2, "L", "0102")]
    assert tables.append_table(df, path) == (3, 3)


def test_append_with_null_keys_and_known_copies(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, m map<string,int>, _league string, _season string"
    df = spark.createDataFrame([(None, {"a": 1}, "L", "1"), ("b", {"a": 2}, None, "1"), ("c", None, "L", "2"), ("c", {"a": 0}, "L", "2")], schema)
    key = ["k", "_league", "_season"]
    assert tables.append_table(df, path, key) == (4, 3)
    for _ in range(2):
        assert tables.append_table(df, path, key) == (4, 0)
    other = spark.createDataFrame([("c", {"z": 1}, "L", "3")], schema)
    assert tables.append_table(other, path, key) == (1, 1)
    tables.append_table(other, path)  # now there twice
    assert tables.append_table(other, path, key) == (1, 0) and tables.append_table(other, path, ["k"]) == (1, 0)
    assert tables.read_table(spark, path, df.schema).count() == 5


def test_a_refused_feature_table_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "f")
    tables.write_feature_table(spark.range(9).withColumnRenamed("id", "row_idx"), path)
    with pytest.raises(ValueError):
        tables.write_feature_table(spark.range(3).select(F.lit(1).alias("row_idx")), path)
    assert spark.read.parquet(path).count() == 9


def test_replace_is_idempotent_and_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "L", "0102"), (2, "M", "0102")], "v int, _league string, _season string")
    tables.replace_partitions(df, path)
    for _ in range(2):
        tables.replace_partitions(df.where("v = 1"), path)
    assert tables.read_table(spark, path, df.schema).count() == 2


def test_targets_and_report(spark):
    grid = tables.target_grid(spark, ["A", "B"], ["1", "2"], choose_leagues=["B"])
    assert sorted(map(tuple, grid.collect())) == [("B", "1"), ("B", "2")]
    with pytest.raises(ValueError):
        tables.choose(["A"], ["C"])
    named = {"source": F.lit("s"), "collection": F.lit("c")}
    loaded = spark.createDataFrame([("B", "1")] * 3, "league string, season string").withColumns(named)
    report = tables.ingest_report(loaded, grid.withColumns(named)).collect()
    assert {(r.season, r.rows, r.status) for r in report} == {("1", 3, "loaded"), ("2", 0, "empty")}


def test_feature_table_and_artifacts(spark, tmp_path):
    path = str(tmp_path / "f")
    assert tables.write_feature_table(spark.range(9).withColumnRenamed("id", "row_idx"), path) == 9
    with pytest.raises(ValueError):
        tables.write_feature_table(spark.range(3).select(F.lit(1).alias("row_idx")), path)
    with pytest.raises(FileNotFoundError):
        tables.load_artifact(spark, str(tmp_path / "none"))
    tables.save_artifact(spark.range(2), str(tmp_path / "a"))
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        tables.load_artifact(spark, str(tmp_path / "a"), ["other"])
    assert any("rebuild" in str(w.message) for w in seen)


def _land(spark, folder):
    rows = [("L1", "2324", "g1"), ("L1", "2425", "g2"), ("L2", "2425", "g3")]
    spark.createDataFrame(rows, "league string, season string, game_id string").withColumns(
        {"_league": F.col("league"), "_season": F.col("season"), "week": F.lit(3)}).write.partitionBy("_league", "_season").json(folder)
    odd = f"{folder}/_league=L3/_season=2526"
    os.makedirs(odd)
    with open(f"{odd}/part-9.json", "w") as f:
        f.write('{"game_id": "g4", "week": "late"}\n\nnot json\n[1]\n{"game_id": 5, "week": 2.5}\n')


def test_pages_source_prunes_folders_and_keeps_bad_lines(spark, tmp_path):
    folder = str(tmp_path / "land")
    _land(spark, folder)
    rows = landed.read_landed(spark, folder, "schedule", reader="pages")
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 7
    one = rows.where("_league = 'L1' AND _season = '2425'")
    assert [(r.game_id, r.week, r._season) for r in one.collect()] == [("g2", 3.0, "2425")] and one.rdd.getNumPartitions() == 1
    odd = sorted(map(tuple, rows.where("_league = 'L3'").select("game_id", "week", "_corrupt_record").collect()), key=repr)
    assert odd == sorted([("g4", None, None), (None, None, "not json"), (None, None, "[1]"), ("5", 2.5, None)], key=repr)


def test_pages_source_streams_each_file_once(spark, tmp_path):
    folder, out = str(tmp_path / "land"), str(tmp_path / "out")
    _land(spark, folder)

    def run():
        pages.stream_pages(spark, folder, "schedule").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 7
    with open(f"{folder}/_league=L3/_season=2526/qart.json", "w") as f:
        f.write('{"game_id": "g6"}\n')
    assert run() == 8


def test_records_whose_fields_come_and_go(spark, tmp_path):
    lines = ['{"team": "a", "Performance_Gls": 3, "age": "22-100"}', '{"team": "b", "Performance": {"Gls": "4"}, "Playing Time": {"Min": 90}}',
             '{"team": "c", "Performance": [1]}', '{"team": "d"', '[1]', '7', '', '{}']
    with open(tmp_path / "x.json", "w") as f:
        f.write("\n".join(lines))
    records = dynamic.read_records(spark, str(tmp_path))
    got = {r.team: (r.Performance_Gls, r["Playing Time_Min"], r.age) for r in dynamic.collection(records, "player_standard").collect()}
    assert got == {"a": ("3", None, "22-100"), "b": ("4", "90", None), "c": (None, None, None), None: (None, None, None)}
    assert sorted(r.reject_reason for r in dynamic.rejected(records).collect()) == ["no JSON", "no object", "no object"]
    events = tmp_path / "e"
    events.mkdir()
    (events / "e.json").write_text('{"game_id": "g", "x": "83.5"}\n{"game_id": "h", "x": 4}\n{"game_id": "i", "x": "far"}\n')
    read = dynamic.collection(dynamic.read_records(spark, str(events)), "match_events")
    assert {r.game_id: r.x for r in read.collect()} == {"g": 83.5, "h": 4.0, "i": None}

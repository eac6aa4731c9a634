"""Sources and sinks on small files."""

import json

from pyspark.sql import functions as F

from girder.sources import dictionaries, sinks


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"base": 1.0, "a": 16, "b": 26, "thickness": 20}, {"base": "bad"}]))
    got = dictionaries.json_rows(spark, str(tmp_path / "t.json"), dictionaries.THRESHOLDS).collect()
    assert got[0]["thickness"] == 20.0 and got[1]["base"] is None
    (tmp_path / "t.xml").write_text("<t><row><cell>1</cell><cell>16,5</cell><cell>x</cell><cell>20</cell></row><row><cell>1</cell></row></t>")
    assert [tuple(r) for r in dictionaries.xml_thresholds(spark, str(tmp_path / "t.xml")).collect()] == [(1.0, 16.5, 0.0, 20.0)]
    (tmp_path / "x.xml").write_text('<c><coat index="2"><column min="30"><heat dpr="1" delta="1" rate="9"/><row dpr="1" delta="2" rate="3"/><row dpr="4" delta="5" rate="6"/></column><column min="45"/></coat></c>')
    got = dictionaries.xml_coats(spark, str(tmp_path / "x.xml")).orderBy("c_ord", "ord").collect()
    assert [(r["coat"], r["limit"], r["dpr"], r["rate"], r["heat_rate"]) for r in got] == [(2, 30.0, 1.0, 3.0, 9.0), (2, 30.0, 4.0, 6.0, 9.0), (2, 45.0, None, None, None)]


def test_markup_and_catalogs(spark, tmp_path):
    (tmp_path / "roll.txt").write_text('<select shape="I"><o id="1" label="20" h="200" b="1,5" note="x"><o id="2" h="3"></select><select shape="U"><o id="3" h="7">')
    got = dictionaries.markup_catalog(spark, str(tmp_path / "roll.txt")).orderBy("ord").collect()
    assert [(r["shape"], r["id"], r["dims"]) for r in got] == [("I", "1", {"label": 20.0, "h": 200.0, "b": 1.5}), ("I", "2", {"h": 3.0}), ("U", "3", {"h": 7.0})]
    table = spark.createDataFrame([(["d", "m"], [["1", "5"], ["2", None]])], "columns array<string>, rows array<array<string>>")
    got = dictionaries.columns_and_rows(table, "columns", "rows", "m", F.lit(9.0)).orderBy("ord").collect()
    assert [r["mass"] for r in got] == [5.0, 9.0]


def test_answers(spark):
    text = 'Sure:\n```json\n{"rows": [{"name": "a", "mass": 1.5, "parts": [{"kind": "k", "mass": 1.5}]}, {"name": "b"}]}\n```'
    rows = dictionaries.answer_rows(spark.createDataFrame([(1, text), (2, "none")], "id int, t string"), "t", "id").collect()
    assert [(r["id"], r["ord"], r["name"], r["mass"]) for r in rows] == [(1, 0, "a", 1.5), (1, 1, "b", None)]


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([("a", None, 1), ("b", "o", 2)], "mark string, owner string, v int")
    rows = spark.createDataFrame([("a", None, 5), ("c", "o", 3)], "mark string, owner string, v int")
    assert sorted((r["mark"], r["v"]) for r in sinks.upserted(base, rows, ["mark", "owner"]).collect()) == [("a", 5), ("b", 2), ("c", 3)]
    sinks.append(rows, f"{tmp_path}/p")
    sinks.append(rows.limit(0), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    sinks.json_tables(base, "mark", ["v"], ["owner", "v"], f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    sinks.grid(spark.createDataFrame([("x\x01y", 1)], "a string, b int"), f"{tmp_path}/g")
    assert spark.read.option("sep", ";").option("header", True).csv(f"{tmp_path}/g").first()["a"] == "xy"
    total = {(r["mark"], r["owner"], r["level"]): float(r["v"]) for r in sinks.sheets(base.fillna("-"), "mark", "owner", "v").collect()}
    assert total[(None, None, 3)] == 3.0 and total[("b", None, 1)] == 2.0

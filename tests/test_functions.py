"""Functions and operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from girder.functions import geometry, rounding, text
from girder.operators import classify, fuzzy, graph, lookup, merge, ordered, reshape
from girder.plans import bills


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_the_regression_anchor_of_the_bill(spark):
    """An I-beam 200 x 100 x 5.6 x 8.5, R 12, six metres, R60: area, perimeter, thickness and volume worked out by hand."""
    c, on = F.col, geometry.sides(*(F.lit(True) for _ in range(4)))
    beam = spark.createDataFrame([(200.0, 100.0, 5.6, 8.5, 12.0, 6.0, 60.0)], "h double, b double, s double, t double, r double, len double, req double")
    beam = beam.withColumn("area", geometry.i_beam_area(c("h"), c("b"), c("s"), c("t"), c("r"))).withColumn("per", geometry.i_beam_perimeter(c("h"), c("b"), c("s"), c("r"), on))
    beam = bills.with_thickness(beam.withColumn("dpr", geometry.reduced_thickness(c("area"), c("per"))), "dpr", "req")
    sv, sm = geometry.cladding(c("h"), c("b"), c("t"), c("delta"), c("len"), on)
    got = beam.select("area", "per", "dpr", "delta", sm.alias("sm"), rounding.scaled(sv * c("delta") / 1000 * 1.25, 3).alias("v")).first()
    assert got["area"] == pytest.approx(2848.41, abs=0.01) and got["per"] == pytest.approx(768.20, abs=0.01)
    assert (got["dpr"], got["delta"], got["v"]) == (3.7, 30.0, 0.176) and got["sm"] == pytest.approx(4.32)


def test_rounding(spark):
    assert one(spark, rounding.scaled(F.col("v"), 2), v=0.285) == 0.28
    assert one(spark, rounding.half_up(F.col("v"), 0), v=-2.5) == -2.0
    assert one(spark, rounding.half_even(F.col("v")), v=2.5) == 2.0
    assert one(spark, rounding.divided(F.lit(1.0), F.col("v")), v=0.0) == 0.0


@pytest.mark.parametrize(("raw", "mark"), [("Двутавр 35Б2 ГОСТ 26020-83", "35Б2"), ("10 Б1", "10Б1"), ("10B1", "10Б1"), ("Уголок 75x75x6", "75Х75Х6"), ("С255", ""), ("", ""), ("20P", "20П")])
def test_marks(spark, raw, mark):
    assert one(spark, text.normal_mark(F.col("v")), v=raw) == mark


def test_numbers_standards_pages_and_keys(spark):
    number = lambda v: one(spark, text.number(F.col("v")), v=v)
    assert [number(v) for v in ("1,5", "12 345,5", "1 2", "x", "-3", "1\u00a0234,5\u202f", "\t7", "1  234")] == [1.5, 12345.5, None, None, -3.0, 1234.5, 7.0, None]
    assert one(spark, text.standards(F.col("v")), v="ГОСТ Р  57837-2017, ГОСТ Р 57837-2017 и ТУ 14-1") == ["ГОСТ Р 57837-2017", "ТУ 14"]
    assert one(spark, text.pages(F.col("v")), v="1-3, 5,x,2") == [1, 2, 3, 5]
    assert one(spark, text.group_key(F.col("v")), v="  Колонны  /  Стойки ") == "колонны/стойки"
    assert one(spark, text.without_markup(F.col("v")), v="<b>a &lt; b</b>&nbsp;c") == "a < b c"
    assert one(spark, text.three_number_angle(F.col("v")), v="63Х5") == "63Х63Х5"


def test_keywords_and_categories(spark):
    got = one(spark, classify.keywords(F.col("v"), classify.COUNTED, classify.EXCLUDED), v="Балки и ограждения")
    assert (got["counted"], got["excluded"], got["mixed"], got["matched"]) == (True, True, True, "балк")
    category = lambda v: one(spark, classify.category(F.col("v"), classify.CATEGORY_RULES, F.lit("")), v=v)
    assert [category(v) for v in ("Швеллер гнутый", "Швеллеры", "Профили гнутые квадратные", "Двутавры", "Лист")] == ["shveller-gnut", "shveller", "truba-kvadr", "balka", ""]
    assert one(spark, classify.category_of_standard(F.col("v")), v="ГОСТ 8509-93") == "ugolok"


@pytest.mark.parametrize(("value", "wanted", "ok"), [("a / b", "a", True), ("a / b", "c", False), ("", "c", True), (" ", "c", True), ("a", "", True), ("a/b", "a/b", True), ("a/b", "b/a", False), (None, "x", True), ("ab", "a", False)])
def test_facets(spark, value, wanted, ok):
    assert one(spark, classify.facet_matches(F.col("v").cast("string"), F.col("w")), v=value, w=wanted) is ok


def test_broken_json_and_fuzzy_words():
    assert fuzzy.complete_objects('x {"rows": [{"a": "}]"}, {"b": {"c": 1}}, {"d": ') == ['{"a": "}]"}', '{"b": {"c": 1}}']
    assert fuzzy.complete_objects("none") == []


def test_asof_and_layers(spark):
    left = spark.createDataFrame([(1, 10), (1, 1), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 5, 1, "a"), (1, 10, 2, "b"), (1, 10, 1, "c")], "k int, at int, n int, v string")
    got = {(r["k"], r["at"]): r["v"] for r in lookup.asof(left, right, ["k"], "at", ["n"], ["v"]).collect()}
    assert got == {(1, 10): "b", (1, 1): None, (2, 5): None}


def test_totals_of_two_levels(spark):
    rows = spark.createDataFrame([("d", 1, "data", 1.0), ("d", 2, "data", 2.0), ("d", 3, "group_total", 3.0), ("d", 4, "data", 4.0), ("d", 5, "profile_total", 7.0), ("d", 6, "group_total", 1.0)], "doc string, row int, kind string, v double")
    got = [(r["row"], r["calculated"], r["status"]) for r in ordered.group_totals(rows, ["doc"], ["row"], "kind", "v", F.lit(0.05)).orderBy("row").collect()]
    assert got == [(3, 3.0, "ok"), (5, 7.0, "ok"), (6, 0.0, "failed")]


def test_merge_components_and_reshape(spark):
    old = spark.createDataFrame([(1, "x", "s", 1), (2, "y", "t", 2)], "id int, v string, source string, ord int")
    new = spark.createDataFrame([(1, "X", "s", 1), (2, "Y", "s", 2), (3, "Z", "s", 3)], "id int, v string, source string, ord int")
    got = [(r["id"], r["v"], r["state"]) for r in merge.keyed_merge(old, new, ["id"], ["v"], "source", "ord").orderBy("block", "ord").collect()]
    assert got == [(1, "X", "updated"), (2, "y", "kept"), (3, "Z", "inserted")]
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 21), 30, 31, 40]], "n int").withColumnRenamed("n", "node")
    parts = {r["node"]: r["component"] for r in graph.components(nodes, edges, "node").collect()}
    assert parts == {i: 1 for i in range(1, 21)} | {30: 30, 31: 30, 40: 40}
    masses = spark.createDataFrame([(1, {"a": 2.0, "b": 0.0}, 5.0), (2, {"a": 0.0}, 7.0)], "id int, m map<string,double>, total double")
    got = sorted((r["id"], r["element"], r["mass"]) for r in reshape.unpivoted(masses, ["id"], F.col("m"), F.col("total")).collect())
    assert got == [(1, "a", 2.0), (2, "total", 7.0)]


def test_streaming_share_is_the_batch_share(spark, tmp_path):
    from girder.streaming import rates

    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 37) as ts, case when id % 5 = 0 then 'error' else 'view' end as event_type from range(200)")
    events.write.parquet(f"{tmp_path}/e")
    flag = F.col("event_type") == "error"
    q = rates.stream(spark, f"{tmp_path}/e", events.schema, flag, "shares")
    q.awaitTermination(60)
    streamed = {(r["start"], r["n"], r["flagged"]) for r in spark.table("shares").collect()}
    batch = {(r["start"], r["n"], r["flagged"]) for r in rates.share(events, flag).collect()}
    assert streamed and streamed <= batch


def test_marks_lose_what_is_printed_around_them(spark):
    from girder.functions import marks

    given = {
        "12х4": ("12х4", "12Х4"), "Гн. 25-26-2": ("25-26-2", "25-26-2"), "1 50Ш4": ("50Ш4", "50Ш4"), "L 100х8": ("100х8", "100Х8"),
        "40Б2 (214-202-0103-0002)": ("40Б2", "40Б2"), "25Б1 т": ("25Б1", "25Б1"), "лист т": ("лист т", "ЛИСТТ"), "25ШО": ("25ШО", "25Ш0"), "30B1": ("30B1", "30Б1"), "": ("", ""), None: ("", ""),
    }
    df = spark.createDataFrame([(k,) for k in given], "raw string")
    got = {r.raw: (r.mark, r.key) for r in df.select("raw", marks.cleaned_mark(F.col("raw")).alias("mark"), marks.book_key(F.col("raw")).alias("key")).collect()}
    assert got == given


def test_letters_beside_digits_are_digits(spark):
    from girder.functions import marks

    given = {"СЗ45-5": "С345-5", "6З": "63", "ГОСТ": "ГОСТ", "16П": "16П", "OЗ5": "O35", "5ЗО": "530", "": "", "З О": "З О"}
    df = spark.createDataFrame([(k,) for k in given], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", marks.digits_in_context(F.col("raw"))).collect()} == given


def test_cells_merge_to_rectangles_only(spark):
    from girder.operators import grids

    nodes = spark.createDataFrame([(1, r, c, r * 2 + c) for r in range(2) for c in range(2)] + [(2, r, c, 4 + r * 2 + c) for r in range(2) for c in range(2)], "page int, r int, c int, node int")
    sides = spark.createDataFrame([(0, 1), (4, 5), (4, 6)], "a int, b int")
    got = sorted(tuple(r) for r in grids.merged_cells(nodes, sides, ["page"], "node").collect())
    assert got == [(1, 0, 0, 1, 2), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 1, 1), (2, 0, 1, 1, 1), (2, 1, 0, 1, 1), (2, 1, 1, 1, 1)]


def test_salvage_against_a_plain_reader():
    """Objects of an array that breaks off, read one after another by the JSON decoder."""
    import json
    import random

    from girder.operators import fuzzy

    def plain(text):
        at = text.index("[") + 1
        out, decoder = [], json.JSONDecoder()
        while True:
            while at < len(text) and text[at] in ", }\n":
                at += 1
            if at >= len(text) or text[at] == "]":
                return [] if at < len(text) else out
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                return out
            out.append(text[at:end])
            at = end

    rng = random.Random(4)
    for _ in range(500):
        rows = [json.dumps({rng.choice("abc"): rng.choice([1, "x]}", 'q"{', [1, {"z": 2}], {"y": "\\"}, None])}) for _ in range(rng.randrange(5))]
        whole = '{"rows": [' + rng.choice(["", "} "]) + ", ".join(rows)
        text = whole + rng.choice(["", "]", "]}", ', {"cut": 1', ', {"cut": "a'])
        assert fuzzy.complete_objects(text) == plain(text), text
    assert fuzzy.complete_objects('{"rows": [} {"a":1}, {"b":2}') == ['{"a":1}', '{"b":2}']


def test_broken_numbers_are_mended_and_told(spark):
    from girder.operators import cells

    def mended(raw, other=None):
        got = one(spark, cells.mended_number(F.col("v"), F.col("o")), v=raw, o=other or "")
        return got["text"], got["value"], got["review"]

    assert mended("|29,34") == ("29,34", 29.34, False)
    assert mended("12 34") == ("12,34", 12.34, True)
    assert mended("12,5\n771") == ("12,5", 12.5, True)
    assert mended("46,.9") == ("46,9", 46.9, True)
    assert mended("9.") == ("9", 9.0, False)
    assert mended("1 25", "125") == ("125", 125.0, True)
    assert mended("1 25", "126") == ("1 25", None, True)
    assert mended("１２，５") == ("12,5", 12.5, False)
    assert mended("") == ("", None, True)


def test_rows_are_marked_by_their_text(spark):
    from girder.operators import cells

    marker = lambda v: one(spark, cells.row_marker(F.col("v")), v=v)
    texts = ("|Итого:", "B том числе по маркам", "Всего  профиля", "Итого масса металла", "Mм020:", "Балка", "")
    assert [marker(v) for v in texts] == ["group_total", "section_header", "profile_total", "grand_total", None, None, None]


def test_a_window_s_quantile_is_near_without_holding_its_values(spark):
    from girder.streaming import rates

    rows = spark.range(20_000).selectExpr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 600) AS ts", "id % 2 AS k", "cast(id * 7919 % 20011 AS double) AS v")
    exact = {(r["k"], r["start"]): r["q"] for r in rates.quantile(rows, ["k"], "v", 0.95, "5 minutes", accuracy=None).collect()}
    near = {(r["k"], r["start"]): r["q"] for r in rates.quantile(rows, ["k"], "v", 0.95, "5 minutes", accuracy=1000).collect()}
    assert len(exact) == 4 and exact.keys() == near.keys()
    assert all(abs(near[k] - exact[k]) <= 20011 * 2 / 1000 for k in exact)

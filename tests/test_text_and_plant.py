from pyspark.sql import functions as F

from tagloom.functions import geometry, text
from tagloom.operators import plant, worksheet


def col(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def test_questions(spark):
    q = ["is there a path between A and B", "what is downstream of 27-PT1", "what feeds from it", "what protects 27-VG1", "what trips the valve", "loop of 27", "which section", "list all valves", "hm"]
    assert col(spark, q, text.intent) == ["path", "downstream", "upstream", "protects", "trips_closing", "loop", "section", "list_type", "neighbors"]
    assert col(spark, ["position switches in system 27, System 13"], text.systems) == [["27", "13"]]
    assert col(spark, ["which controllers and position switch"], text.types) == [["FIC", "LIC", "PIC", "TIC", "ZL", "ZS"]]
    assert col(spark, ["list all PSVs and the trip LSHH"], text.types) == [sorted({*text.RELIEF, *text.TRIPS})]
    assert col(spark, ["pressure relief valve", "valve manual"], text.query_codes) == [["PSV"], ["HV"]]
    assert col(spark, ["What is the Pressure, at V-1?"], text.terms) == [["pressure", "at"]]


def test_labels(spark):
    assert col(spark, ["GAS COOLER.", "123-45", "ab", "x" * 50, "Müll Über", "as built"], text.is_descriptive) == [True, False, False, False, False, False]
    kinds = [["20-2003PT", "20-PT2003"], ["20-LSL548", "20-LSL 548"], ["0548", "548"], ["a", "b"]]
    assert col(spark, kinds, text.difference_kind, "array<string>") == ["nummer-først vs type-først", "separator/whitespace", "leading zeros", "different spelling"]
    assert col(spark, ['x ```json\n["a"]\n``` y', "no"], lambda c: text.tolerant_json(c, "array<string>")) == [["a"], None]
    assert col(spark, ["Alpha", "", "alp"], lambda c: text.option_matches(c, F.lit("alpha"))) == [True, False, True]


def test_shapes(spark):
    assert col(spark, ["N1", "27-N12", "NOTE", "27-PT1"], text.is_nozzle) == [True, True, False, False]
    assert col(spark, ["27-4510PV", "4454PL", "27-PT1"], text.is_valve_line) == [True, True, False]


def test_mentions(spark):
    tags = lambda *ts: spark.createDataFrame([("d", t) for t in ts], "drawing string, tag string")
    got = {r.tag: r["class"] for r in text.classify_mentions(tags("27-PT1234", "27-1234PV", "13-XV99", "zz", "27-LT55"), tags("27-PT1234", "27-PV1234"), tags("PT1234", "XV 99")).collect()}
    assert got == {"27-PT1234": "CONFIRMED_BOTH", "27-1234PV": "RECOVERED", "13-XV99": "TEXT_ONLY", "zz": "NOISE", "27-LT55": "UNCONFIRMED"}
    a = text.audit_answer(spark.createDataFrame([("see 27-PT1234 and 27-XV9999",), ("none",)], "t string"), "t", tags("27-PT1234")).orderBy("t").collect()
    assert (a[1].known, a[1].unknown, a[0].known) == (["27-PT1234"], ["27-XV9999"], [])


def test_geometry(spark):
    square = [[(0.0, 0.0), (2.0, 0.0)], [(2.0, 0.0), (2.0, 1.0)]]
    kind = "array<array<struct<x:double,y:double>>>"
    a, b = col(spark, [square, [[(x * 3 + 5, y * 3 + 7) for x, y in c] for c in square]], geometry.fingerprint, kind)
    assert a == b and (a.aspect, a.q10, a.q90) == (2.0, 0.5, 1.0)
    assert len(set(col(spark, [square, [[(x + 9, y + 9) for x, y in c] for c in square[::-1]]], geometry.signature, kind))) == 1
    assert col(spark, [[]], geometry.fingerprint, kind)[0].aspect == 0.0


def test_plant(spark):
    o = spark.createDataFrame([("d1", "A", "LSH", "1"), ("d1", "B", "LIC", "1"), ("d2", "B", "LIC", "1"), ("d2", "C", "XV", "2"), ("d2", "D", "PSV", "2")], "drawing string, tag string, type_code string, loop string")
    e = spark.createDataFrame([("d1", "A", "B", "p"), ("d2", "B", "C", "p"), ("d2", "C", "D", "p"), ("d1", "B", "C", "q")], "drawing string, src string, dst string, kind string")
    v, m, bridge = plant.merge_drawings(o, e)
    assert v.count() == 4 and bridge.count() == 5 and {(r.src, r.dst): r.kind for r in m.collect()}["B", "C"] == "p"
    s = plant.stitches(spark.createDataFrame([("L1", "d1", "A"), ("L1", "d2", "D"), ("L1", "d2", "A")], "line string, drawing string, tag string"))
    assert {(r.src, r.dst) for r in s.collect()} == {("A", "D"), ("D", "A")}
    all_edges = plant.stitched(m.select("src", "dst", "kind"), s)
    assert all_edges.count() == 5 and {r.node: r.degree for r in plant.criticality(all_edges).collect()}["A"] == 1
    ask = lambda intent, *tags, types=(): {r.tag for r in plant.answer(plant.Query(intent, list(tags), list(types)), v, m.select("src", "dst")).collect()}
    assert ask("downstream", "B") == {"C", "D"} and ask("upstream", "C") == {"A", "B"} and ask("path", "A", "D") == {"A", "B", "C", "D"}
    assert ask("protects", "B") == {"A", "C", "D"} and ask("trips_closing", "C") == {"A"} and ask("loop", "C") == {"C", "D"} and ask("list_type", types=["XV"]) == {"C"} and ask("neighbors", "B") == {"A", "C"}
    lines = plant.line_anchors(spark.createDataFrame([("s", "n"), ("n", "A"), ("A", "B")], "src string, dst string"), spark.createDataFrame([("L", "s")], "line string, segment string"), spark.createDataFrame([("A",), ("B",)], "node string"))
    assert [tuple(r) for r in lines.collect()] == [("L", "A")]


def test_worksheet_defaults(spark):
    o = spark.createDataFrame([("1", "1-KA1", "KA"), ("1", "1-XV1", "XV"), ("2", "2-PT1", "PT")], "loop string, tag string, type_code string")
    rows = worksheet.build(o).collect()
    assert {r.parameter for r in rows} == {"Flow"} and len(rows) == 4 and all(r.safeguards == "1-XV1" for r in rows)

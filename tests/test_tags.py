import pytest
from pyspark.sql import functions as F

from tagloom.functions import tags
from tagloom.operators import resolve

REGISTER = ["41-FT7001", "52-FT7001", "41-LALL7003", "41-7004TV", "41-TI7005A", "41-TI7005B", "53-AE801A", "41-ZS88"]
#: One for each rule: raw, tag, status.
CASES = [
    ("41-FT7001", "41-FT7001", "exact"),
    *[(raw, "41-FT7001", "resolved") for raw in ("41FT7001", "41_ft_7001", "HX41-FT-7001", "41FT7001.SP", "41FT7001.PALL", "41FT7001_LL", "POINT:41-FT7001:MEAS", "41-7001FT")],
    ("52FT7001", "52-FT7001", "resolved"), ("41-LALL7003", "41-LALL7003", "exact"), ("417004TV", "41-7004TV", "resolved"), ("41TI7005B", "41-TI7005B", "resolved"),
    ("41TI7005", None, "ambiguous"), ("53AE801", None, "ambiguous"), ("53-AE801A", "53-AE801A", "exact"),
    ("77-FT7001", None, "unresolved"), ("REFER TO SHEET 9", None, "unresolved"), ("", None, "unresolved"), ("Gateway.Node.Mode", None, "unresolved"),
]


def values(spark, make, *rows):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r.v for r in df.select("i", make.alias("v")).orderBy("i").collect()]


def test_resolver_cases(spark):
    register = spark.createDataFrame([(t,) for t in REGISTER], "tag string")
    points = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = resolve.resolve_points(points, register).orderBy("i").collect()
    assert [(r.raw, r.tag, r.status) for r in got] == CASES
    by = {r.raw: r for r in got}
    assert by["41TI7005"].candidates == ["41-TI7005A", "41-TI7005B"] and by["41FT7001.PALL"].alarm_level == "LL" and by["41FT7001.SP"].attribute == "SP"
    assert resolve.evaluate_resolver(register).agg(F.sum("wrong")).first()[0] == 0


def test_parse(spark):
    got = values(spark, tags.parse_tag(F.col("c0")), " 27-pt4805a ", "27-KA50", "27-4805PV", "x")
    assert got[0].asDict() == {"tag": "27-PT4805A", "system": "27", "type_code": "PT", "number": "4805", "suffix": "A", "category": "input", "loop": "27-4805"}
    assert [g.type_code for g in got[1:]] == ["", "", ""] and got[1].category == "other" and got[1].loop == "27-KA50"
    assert values(spark, tags.parse_tag(F.col("c0"), True), "27-4805PV")[0].type_code == "PV"
    assert [tuple(v) for v in values(spark, tags.split_tag(F.col("c0")), "27-PT4805A", "27-4510PV", "127-PT1")] == [("27", "PT", "4805A"), ("27", "PV", "4510"), ("?", "?", "127-PT1")]


def test_inline(spark):
    assert values(spark, tags.inline_tags(F.col("c0")), "see 27-PT4250A/B and 27-4510PV, 27-XV4813.", "none")[0] == ["27-4510PV", "27-PT4250A", "27-PT4250B", "27-XV4813"]


def test_keys(spark):
    assert values(spark, tags.loose_key(F.col("c0")), "HV 2264", "13-HV-2264", "13-2264HV", "NOTE 12", "PI 2262A") == ["HV|2264", "HV|2264", "HV|2264", None, "PI|2262"]
    assert values(spark, tags.strict_key(F.col("c0")), "27-XV4814", "27-4814XV", "27-XV 4814", "PI4805A", "hello") == ["27:XV4814", "27:XV4814", "27:XV4814", ":PI4805A", "HELLO"]
    assert values(spark, tags.validation_key(F.col("c0")), "27-pt 48/05") == ["27PT4805"]


@pytest.mark.parametrize("code, want", [("LSHH", ("high", "trip", 1)), ("LAL", ("low", "alarm", 2)), ("XV", (None, None, 1)), ("PT", (None, None, 3)), ("PI", (None, None, 4)), ("QQ", (None, None, 3))])
def test_alarm_semantics(spark, code, want):
    got = values(spark, tags.alarm_semantics(F.col("c0")), code)[0]
    assert (got.direction, got.level, got.priority) == want


def test_numbers(spark):
    assert values(spark, tags.risk_band(F.col("c0"), F.col("c1")), ("5", "3"), ("4", "2"), ("1", "2"), ("x", "2"), (None, "1"), ("9", "1")) == ["High", "Medium", "Low", "", "", ""]
    df = spark.createDataFrame([(1.0, 10.0, 20.0, 100.0, 50.0)], "a double, b double, t double, v double, q double")
    fill = lambda v: tags.isothermal_fill_seconds(F.col("a"), F.col("b"), F.col("t"), v, F.col("q"))
    one, two, bad = df.select(fill(F.col("v")), fill(2 * F.col("v")), fill(-F.col("v"))).first()
    assert abs(two / one - 2) < 1e-9 and one > 0 and bad is None
    assert df.select(tags.level_fill_seconds(F.lit(1.0), F.lit(1800.0), F.lit(1000.0))).first()[0] == 2000.0
    hazard = df.select(tags.hazard_score(F.lit(2.0), F.array(F.lit(0.2), F.lit(None).cast("double"))), tags.hazard_score(F.lit(4.0), F.array().cast("array<double>"))).first()
    assert hazard[0] == 3.2 and hazard[1] == 5.0


def test_files(spark):
    assert values(spark, tags.system_of_file(F.col("c0")), "C025-V-HO27-P-_E-001", "plain") == ["27", "00"]
    assert values(spark, tags.discipline_of_file(F.col("c0")), "C025-V-HO27-P-_E-001", "plain") == ["P", None]
    got = values(spark, tags.line_label(F.col("c0")), '6"-PL-271234-AD200-A', '0.5" x VF - 1234 - B1234', "no")
    assert tuple(got[0]) == (6.0, "PL", "271234", "27", "AD200", "A") and tuple(got[1]) == (0.5, "VF", "1234", None, "B1234", "") and got[2] is None

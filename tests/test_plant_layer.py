from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.functions import text as X
from tagloom.operators import cause_effect as CE
from tagloom.operators import drawing_graph as D
from tagloom.operators import events as E
from tagloom.operators import inventory as I
from tagloom.operators import recall as R
from tagloom.operators import situation as S
from tagloom.operators import worksheet as W
from tagloom.sources import xml

TAGS = ["31-PT1001", "31-PIC1001", "31-XV1001", "31-LSHH1002", "31-PSH1003", "31-FV1003"]


def objects(spark):
    df = spark.createDataFrame([(t,) for t in TAGS], "t string")
    return df.select(T.parse_tag(F.col("t")).alias("p")).select("p.*")


def edges(spark):
    return spark.createDataFrame(list(zip(TAGS, TAGS[1:])), "src string, dst string")


def test_situation(spark):
    o, e = objects(spark), edges(spark)
    active = spark.createDataFrame([(TAGS[0], 0.0), (TAGS[1], 2.0), (TAGS[3], 20.0)], "node string, t double")
    got = S.briefs(e, active, o).collect()
    assert [(r.node, r.explains, r.priority, r.cluster, r.first_in_cluster, r.place) for r in got] == [(TAGS[0], 2, 3, 0, True, 1), (TAGS[3], 0, 1, 1, True, 2)]
    c = spark.createDataFrame([(TAGS[1],)], "tag string")
    checks = S.cross_checks(e, o, c).first()
    assert (checks.loop_mates, checks.upstream_sensors, checks.downstream_next) == ([TAGS[0]], [TAGS[0]], [TAGS[2]])
    assert S.barriers(e, o, c).first().barriers == sorted([TAGS[2], TAGS[3], TAGS[4]])
    fall = {r.tag: r.t for r in S.cascade(e, spark.createDataFrame([(TAGS[0],)], "tag string"), o).collect()}
    assert set(fall) == {t for t in TAGS if "FV" not in t} and fall[TAGS[0]] == 0 and sorted(fall, key=fall.get) == [t for t in TAGS if t in fall]
    ranks = S.root_ranks(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "scenario int, node string, place int"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "scenario int, node string")).first()
    assert tuple(ranks) == (3, 2, 1, 2, 1.5)
    chosen = spark.createDataFrame([(1, "f", "f"), (2, "f", "n"), (3, "f", "s"), (4, "g", "u"), (5, "f", None)], "scenario int, fault string, tag string")
    one = lambda *xs: spark.createDataFrame(list(xs), "scenario int, tag string")
    said = S.debrief(chosen, one((2, "n")), one((1, "f"), (2, "f"), (3, "f"), (5, "f")), one((4, "u"))).orderBy("scenario").collect()
    assert [r.verdict for r in said] == ["source", "noise", "symptom", "nearest_symptom", "none"]


def test_watch(spark):
    rows = [("b", 1, 0.0, 1, "a", 0, ["a"], 9.0), ("b", 2, 1.0, 3, "a", 2, ["x"], 9.0), ("b", 3, 2.0, 5, "c", 3, ["x"], 9.0), ("b", 4, 9.0, 10, "c", 9, ["y"], 9.0)]
    ticks = spark.createDataFrame(rows, "g string, i int, t double, n int, leader string, explains int, isolated array<string>, window double")
    got = [(r.i, r.event) for r in E.watch_events(ticks, "g", "i").orderBy("i").collect()]
    assert got == [(1, "start"), (2, "unexplained"), (3, "leader"), (3, "consolidation"), (4, "flood"), (4, "unexplained"), (4, "complete")]
    alarms = spark.createDataFrame([("g", k, float(i), i) for i, k in enumerate("abbaaacccccb")], "g string, k string, t double, i int")
    assert [(r.i, r.leader, r.before, r.n) for r in E.leader_changes(alarms, "g", "k", "t", "i").orderBy("i").collect()] == [(2, "b", "a", 2), (4, "a", "b", 3), (10, "c", "a", 5)]


def test_answers(spark):
    register = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    text = "1. WEIGHING EVIDENCE PT 1001 and 31-PT1001 over 31-XV1001.\n2. VERIFICATION PLAN\n1. Check 31-1001PT\nand more\n2) Look at XV 1001 and 99-ZZ9999\n3. DO NOT ACT YET: hold 31-PIC1001.\nStructural decision support"
    answers = spark.createDataFrame([(1, text), (2, "1. one 31-PT1001\n2. two"), (3, "3. alone")], "id int, text string")
    plan = [(r.id, r.n, r.body, r.tags) for r in X.verification_plan(answers, "id", "text", register).orderBy("id", "step").collect()]
    assert plan == [(1, 1, "Check 31-1001PT and more", [TAGS[0]]), (1, 2, "Look at XV 1001 and 99-ZZ9999", [TAGS[2]]), (2, 1, "one 31-PT1001", [TAGS[0]]), (2, 2, "two", [])]
    assert [(r.id, r.body, r.tags) for r in X.hold_off(answers, "id", "text", register).collect()] == [(1, "hold 31-PIC1001.", [TAGS[1]])]
    cands = spark.createDataFrame([(1, TAGS[2]), (1, TAGS[0])], "id int, tag string")
    assert [tuple(r) for r in X.favoured(answers, "id", "text", register, cands).collect()] == [(1, TAGS[0])]


def test_cause_effect(spark):
    register = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    rows = spark.createDataFrame([("d", 1, "31-lshh 1002", "31-XV1001", "JA", "closes"), ("d", 2, "31-PSH1003", "77-XX1", "no", ""), ("d", 3, "", "x", "no", "")], "drawing string, seq int, cause_tag string, effect_tag string, verified string, function string")
    v = CE.validate(rows, register)
    assert sorted((r.seq, r.cause, r.effect, r.ok, r.is_verified) for r in v.collect()) == [(1, TAGS[3], TAGS[2], True, True), (2, TAGS[4], None, False, False)]
    assert tuple(CE.statistics(v).first()) == (2, 1, 1, 1)
    d = CE.designed_response(v, spark.createDataFrame([(TAGS[3],)], "tag string"), spark.createDataFrame([("31-xv1001",)], "tag string")).first()
    assert (d.effect, d.observed) == (TAGS[2], True)
    read = spark.createDataFrame([("d", 1, "LSHH 1002", "31-XV1001"), ("d", 2, "31-LSHH1002", "XV1001"), ("d", 3, "31-XV1001", "XV 1001"), ("d", 4, "blurred", "31-XV1001"), ("d", 5, "31-TT5555", "31-XV1001")], "drawing string, seq int, cause_tag string, effect_tag string")
    got = {r.seq: (r.cause_out, r.cause_status, r.verdict) for r in CE.read_rows(read, register).collect()}
    assert got == {1: (TAGS[3], "verified_loose", "kept"), 2: (TAGS[3], "verified", "repeated"), 3: (TAGS[2], "verified", "self_loop"), 4: ("BLURRED", "suspect", "suspect"), 5: ("31-TT5555", "new_candidate", "kept")}


def test_whole_worksheet(spark):
    m = objects(spark).select(F.col("loop").alias("node"), "tag", "type_code", "category", "loop")
    reach = spark.createDataFrame([(TAGS[0], TAGS[3]), (TAGS[0], TAGS[1])], "seed string, node string")
    ce = spark.createDataFrame([(TAGS[4], TAGS[2], True, "closes, slowly", False, "S1")], "cause string, effect string, ok boolean, function string, is_verified boolean, source string")
    rows = {(r.node, r.deviation): r for r in W.worksheet(m, reach, ce).collect()}
    high = rows["31-1001", "High pressure"]
    assert high.causes == "31-PIC1001: wrong output; 31-PIC1001: tuning drift; blocked outlet (generic); upstream pressure source (generic)"
    assert high.consequences == "possible overpressure of section (generic); functions affected: 31-LSHH1002, 31-PIC1001, 31-XV1001; safety functions in node: 31-XV1001"
    assert high.safeguards == "31-XV1001 (⚠ same loop — verify independence)"
    assert rows["31-1003", "High pressure"].safeguards == "31-PSH1003 → 31-XV1001: closes; slowly [S1] [⚠ detection in node — verify independence; UNVERIFIED]"
    assert rows["31-1003", "Low pressure"].safeguards == W.NONE_FOUND and ("31-1003", "Reverse flow") in rows


def test_recall(spark):
    found = spark.createDataFrame([("d", "text", "27-PT1"), ("d", "vision", "27 XV2"), ("d", "vision", "27-ZZ9")], "drawing string, channel string, tag string")
    truth = spark.createDataFrame([("d", "27-PT1"), ("d", "27-XV2"), ("d", "N1")], "drawing string, tag string")
    got = {(r.drawing, r.channel): (r.truth, r.tp, r.missed, r.extra, r.recall, r.recall_ex_nozzle) for r in R.channel_scores(found, truth).collect()}
    assert got["d", "text"] == (3, 1, 2, 0, 0.333, 0.5) and got["TOTAL", "union"] == (3, 2, 1, 1, 0.667, 1.0) and len(got) == 6
    report = spark.createDataFrame([("d", 10, 1, 1, 9), ("e", 4, 0, 0, 4)], "drawing string, truth_tags int, extracted int, tp int, missed int")
    diffs = spark.createDataFrame([("d", "27-4510PV", "MISSED"), ("d", "N1", "MISSED"), ("d", "27-4511PV", "MISSED"), ("e", "27-PT1", "EXTRA")], "drawing string, tag string, issue string")
    assert [r.drawing for r in R.near_zero_yield(report).collect()] == ["d"]
    w = R.what_if(report, diffs).first()
    assert (w.recovered, round(w.recall, 3), round(w.recall_if, 3)) == (2, 0.071, 0.214)
    assert {r.drawing: (r.nozzles, r.recall_ex) for r in R.nozzle_adjusted(report, diffs).collect()} == {"d": (1, 1 / 9), "e": (0, 0.0)}
    words = spark.createDataFrame([("d", "x4510y")], "drawing string, text string")
    assert tuple(R.text_present(diffs, words).first()) == ("d", 1, 1)


def test_inventory(spark):
    seg = spark.createDataFrame([("a", "PV"), ("a", "PV"), ("b", "PV"), ("b", None)], "drawing string, fluid_code string")
    assert sorted(map(tuple, I.fluid_counts(seg).collect())) == [("TOTAL", "PV", 3), ("a", "PV", 2), ("b", "PV", 1)]
    s, l = spark.createDataFrame([("C025-HO27-001",), ("zz",), ("001",)], "stem string"), spark.createDataFrame([("27-001",), ("ho27 001",), ("q",)], "label string")
    assert {r.stem: r.label for r in I.longest_suffix(s, l).collect()} == {"C025-HO27-001": "ho27 001", "zz": None, "001": "ho27 001"}
    p = spark.createDataFrame([("accepted",), ("rejected",), ("accepted",)], "verdict string")
    assert round(I.review_precision(p).first().precision, 3) == 0.667 and I.review_precision(p.limit(0)).first().precision is None


DOC = b"""<PlantModel><Equipment ID="E1" TagName="31-VG001"><Nozzle ID="N1"/></Equipment><Equipment ID="E2" TagName="31-PA002"><Nozzle ID="N2"/></Equipment>
<PipingNetworkSystem ID="S"><PipingNetworkSegment ID="P1"><PipingComponent ID="V1"><GenericAttributes><GenericAttribute Name="valveTag" Value="31-XV1001"/></GenericAttributes></PipingComponent>
<Connection FromID="N1" ToID="V1"/><Connection FromID="V1" ToID="N2"/></PipingNetworkSegment></PipingNetworkSystem>
<ProcessInstrumentationFunction ID="I1" TagName="31-PT1001"><Association Type="is located in" ItemID="E1"/><InformationFlow ID="F1"><Connection FromID="I1" ToID="I2"/></InformationFlow></ProcessInstrumentationFunction>
<ProcessInstrumentationFunction ID="I2" TagName="31-PIC1001"/><ProcessInstrumentationFunction ID="I3" TagName="31-TT1"><Association Type="fulfills" ItemID="I2"/></ProcessInstrumentationFunction></PlantModel>"""


def test_drawing_graphs(spark):
    e = xml.elements_of(spark.createDataFrame([("/a/d1.xml", DOC)], "path string, content binary")).cache()
    bare = lambda c: F.element_at(F.split(c, "\u0001"), -1)
    pairs = lambda df: {tuple(r) for r in df.select(bare("src"), bare("dst")).collect()}
    assert {("E1", "N1"), ("P1", "V1"), ("S", "P1")} <= pairs(D.containment(e))
    assert ("I1", "I2") not in pairs(D.membership(e)) and ("I1", "I2") in pairs(D.flow(e)) and ("E1", "I1") in pairs(D.membership(e))
    got = {(r.src, r.dst) for r in D.tag_edges(e).collect()}
    assert ("31-VG001", "31-XV1001") in got and ("31-XV1001", "31-PA002") in got and ("31-PT1001", "31-PIC1001") in got and ("31-VG001", "31-PA002") not in got
    sections = {}
    for r in D.sections(e).collect():
        sections.setdefault(r.section, set()).add(r.tag)
    assert {"31-VG001", "31-PT1001"} <= sections["31-VG001-section"] and {"31-PIC1001", "31-TT1"} in sections.values()
    nodes, links = D.topology(e)
    assert nodes.count() >= 10 and links.count() == D.flow(e).count()

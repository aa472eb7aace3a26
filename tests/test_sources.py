from pyspark.sql import functions as F

from tagloom.sources import files, sinks, words, xml

DOC = b"""<PlantModel><Equipment ID="E1" ComponentClass="Pump" TagName="27-PA001"><Position><Location X="1.5" Y="2"/></Position>
<GenericAttributes><GenericAttribute Name="part1" Value="27"/><GenericAttribute Name="part1" Value="28"/><GenericAttribute Name="FluidCode" Value="VF"/></GenericAttributes>
<ConnectionPoints><Node Type="process"/><Node/></ConnectionPoints>
<Nozzle ID="N1"><GenericAttributes><GenericAttribute Name="tagName" Value="27-N1"/></GenericAttributes></Nozzle></Equipment>
<PipingNetworkSegment ID="P1" TagName='6"-PV-27'><Connection FromID="E1" ToID="N1"/><Association Type="is located in" ItemID="E1"/></PipingNetworkSegment>
<Equipment ID="E1" TagName="again"/><Equipment ID="E9" TagName="empty 3"/></PlantModel>"""


def elements(spark):
    return xml.elements_of(spark.createDataFrame([("/a/d1.xml", DOC), ("/a/bad.xml", b"<x><y></x>")], "path string, content binary"))


def test_xml(spark):
    e = elements(spark).cache()
    assert e.filter("drawing = 'bad'").select(F.col("error").isNotNull()).first()[0]
    tags = {r.id: r for r in xml.tags(e).collect()}
    assert (tags["E1"].tag_name, tags["E1"].category, tags["E1"].x_mm) == ("27-PA001", "equipment", 1.5) and tags["N1"].tag_name == "27-N1"
    c = xml.connections(e).first()
    assert (c.owner_id, c.kind, c.from_id, c.to_id) == ("P1", "process", "E1", "N1")
    a = xml.associations(e).first()
    assert (a.source_id, a.target_id) == ("P1", "E1")
    i = {r.item_id: r for r in xml.items(e).filter("tag <> 'again'").collect()}
    assert i["E1"].parts == {"part1": "28"} and i["E1"].n_connection_points == 2 and i["E1"].connection_types == ["process", ""]
    assert {(r.tag, r.is_pipe) for r in xml.truth_tags(e).collect()} == {("27-PA001", False), ("27-N1", False), ('6"-PV-27', True)}
    assert {r.id: r.FluidCode for r in xml.component_list(e).collect()}["N1"] == "VF"
    deep = b"<P><S ID='a'><GenericAttributes><GenericAttribute Name='FluidCode' Value='PL'/></GenericAttributes>" + b"".join(b"<S ID='x%d'>" % i for i in range(6)) + b"</S>" * 6 + b"</S></P>"
    got = xml.component_list(xml.elements_of(spark.createDataFrame([("/a/d.xml", deep)], "path string, content binary"))).collect()
    assert len(got) == 7 and {r.FluidCode for r in got} == {"PL"}


def test_files(spark, tmp_path):
    rows = [("/r/P&ID/C025-V-HO27-P-_E-001.PDF", 2048), ("/r/P&ID/c025-v-ho27-p-_e-001.pdf", 9), ("/r/SCD/HO27 J 1.pdf", 9), ("/r/SCD legend/x.pdf", 9), ("/r/x/C025_V HO27-P-_E-001.DGN.xml", 9), ("/r/x/lost.xml", 9), ("/r/SCD/license.pdf", 9)]
    f = files.described(spark.createDataFrame(rows, "path string, length long"))
    d = files.drawings(f).collect()
    assert sorted((r.doc_type, r.system) for r in d) == [("PID", "27"), ("SCD", "27")]
    assert files.system_pairs(files.drawings(f)).first().system == "27"
    pairs = {r.xml: r.pdf for r in files.pdf_xml_pairs(f).collect()}
    assert pairs["/r/x/lost.xml"] is None and pairs["/r/x/C025_V HO27-P-_E-001.DGN.xml"].lower().endswith("001.pdf")
    heads = spark.createDataFrame([(b"\xd0\xcf\x11\xe0zz",), (b"\x08\x09\x10\x00",), (b"ab",)], "c binary")
    assert [r.v for r in heads.select(files.dgn_version(F.col("c")).alias("v")).collect()] == ["V8", "V7", "unknown"]
    blob = spark.createDataFrame([("p", b"\x00\x01Hello there\x00\x00" + "Wide text".encode("utf-16-le"))], "path string, content binary")
    assert {r.text for r in files.binary_strings(blob).collect()} == {"Hello there", "Wide text"}
    dxf = spark.createDataFrame([("p", b"0\nSECTION\n0\nTEXT\n8\nL1\n1\n27-PT1\n10\n1.0\n20\n2.0\n0\nEOF\n")], "path string, content binary")
    assert tuple(files.dxf_entities(dxf).first())[1:] == ("TEXT", "L1", None, "27-PT1", 1.0, 2.0)
    assert files.dgn_elements(spark.createDataFrame([("p", b"\x08\x09\x01\x00\x00\x00\xff\xff\xff\xff")], "path string, content binary")).collect()[0].type == 9
    (tmp_path / "a.csv").write_text("cause_tag,effect_tag\nA,\n")
    row = files.csv_rows(spark, str(tmp_path / "a.csv"), ["cause_tag", "effect_tag", "note"]).first()
    assert (row.cause_tag, row.effect_tag, row.note) == ("A", "", "") and row.file.endswith("a.csv")


def test_words(spark):
    w = spark.createDataFrame([("d", "27", 1, "PT", 100.0, 100.0), ("d", "27", 2, "4805A/B", 104.0, 110.0), ("d", "27", 3, "9999", 104.0, 140.0), ("d", "27", 4, "27-XV4813", 0.0, 0.0), ("d", "27", 5, "27-4510PV", 0.0, 9.0)], "drawing string, system string, seq int, text string, x double, y double")
    assert {r.tag for r in words.extract_tags(w).collect()} == {"27-PT4805A", "27-PT4805B", "27-XV4813", "27-4510PV"}
    l = spark.createDataFrame([("d", 1, '6"-PL-', 0.0, 10.0, 5.0, 1.0), ("d", 2, "271234-AD200", 12.0, 30.0, 20.0, 1.5), ("d", 3, "word", 0.0, 1.0, 1.0, 9.0)], "drawing string, seq int, text string, x0 double, x1 double, x double, y double")
    got = words.line_labels(l).collect()
    assert len(got) == 1 and got[0].label.fluid == "PL" and got[0].label.line_no == "271234"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    v = sinks.upsert(spark, str(tmp_path / "t"), 0, df, "k")
    v = sinks.upsert(spark, str(tmp_path / "t"), v, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    got = {r.k: (r.v, r.saves) for r in spark.read.parquet(str(tmp_path / f"t/v={v}")).collect()}
    assert got == {"a": (1, 1), "b": (3, 2), "c": (4, 1)}
    for form in ("csv", "json", "xml", "orc", "parquet"):
        sinks.write_report(df, str(tmp_path / form), form, single=True)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2 and spark.read.option("rowTag", "row").format("xml").load(str(tmp_path / "xml")).count() == 2
    names = spark.createDataFrame([("x" * 40 + "1",), ("x" * 40 + "2",), ("a/b",)], "node string")
    sheets = [r.sheet for r in sinks.sheet_names(names, "node").collect()]
    assert len(set(sheets)) == 3 and max(map(len, sheets)) <= 31
    c = spark.createDataFrame([("p", "1", "{}")], "collection string, id string, json string")
    assert sinks.merge_patterns(c, spark.createDataFrame([("p", "1", "{1}"), ("p", "2", "{}")], c.schema)).count() == 2

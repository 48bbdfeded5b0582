"""Workbooks there and back, documents and slides, preprocessing with counters, catalogues."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from evalloom.sources import catalogue, io, office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
S = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006/relationships"


def test_workbook_there_and_back(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    one = spark.createDataFrame([(1, "ä <&> \"x\"", 1.5, None, True, ["p", "q"]), (2, None, 2.0, None, False, []), (None, None, None, None, None, None)], "k long, t string, d double, none string, b boolean, l array<string>")
    two = spark.createDataFrame([("Wissen", 7)], "Aufgabentyp string, `n m` int")
    office.write_workbook({"Eins": one.coalesce(1), "Zwei & mehr": two}, path)
    got = office.read_workbook(spark, path)
    assert got.dtypes == [("k", "bigint"), ("t", "string"), ("d", "double"), ("b", "string"), ("l", "string")]  # the empty column is gone
    assert [tuple(r) for r in got.collect()] == [(1, 'ä <&> "x"', 1.5, "True", "p; q"), (2, None, 2.0, "False", None)]  # so is the empty row
    assert [tuple(r) for r in office.read_workbook(spark, path, ("none", "Zwei & mehr")).collect()] == [("Wissen", 7)]
    assert io.read_table(spark, path, ("k", "none")).count() == 2
    with pytest.raises(ValueError, match="missing columns: ..y.."):
        io.read_table(spark, path, ("k", "y"))
    office.write_workbook({"Eins": two}, path)  # replaced whole
    assert office.read_workbook(spark, path).columns == ["Aufgabentyp", "n m"]
    assert sorted(os.listdir(tmp_path)) in (["b.xlsx"], [".b.xlsx.crc", "b.xlsx"], [".b.xlsx.part.crc", "b.xlsx"])


def test_a_frame_too_long_for_a_sheet_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(office, "SHEET_ROWS", 10)
    with pytest.raises(ValueError, match="more than 10 rows"):
        office.write_workbook({"s": spark.range(10)}, str(tmp_path / "b.xlsx"))
    assert not os.path.exists(tmp_path / "b.xlsx")


def test_shared_strings_gaps_and_markdown(tmp_path):
    path = tmp_path / "s.xlsx"
    main = office._MAIN[1:-1]
    with zipfile.ZipFile(path, "w") as z:
        office._write_parts(z, ["S"])
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>zu</t></r><r><t>sammen</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="inlineStr"><is><t>n</t></is></c></row><row r="4"><c r="B4" t="s"><v>1</v></c><c r="AA4"><v>2</v></c></row><row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5"/></row></sheetData></worksheet>')
    content = path.read_bytes()
    assert [c[2:] for c in office._cells(content)] == [(2, 2, "name", None), (2, 27, "n", None), (4, 2, "zusammen", None), (4, 27, None, 2.0), (5, 2, "True", None)]
    assert office.workbook_text(content) == "\n--- EXCEL BLATT: 'S' ---\n| name     |   n |\n|:---------|----:|\n| zusammen |   2 |\n| True     | nan |\n"


def word(path):
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{run("a")}{run("b")}</w:tc><w:tc>{run("c")}</w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{run("Erstens")}{run(" ")}{table}<w:p><w:r><w:t>Zwei</w:t><w:tab/><w:t>tens</w:t></w:r></w:p></w:body></w:document>')


def slides(path):
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    page = lambda s: f'<p:sld xmlns:p="{S}" xmlns:a="{A}"><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{S}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{PACK}"><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>')
        z.writestr("ppt/slides/slide1.xml", page(shape("später") + shape("")))
        z.writestr("ppt/slides/slide2.xml", page(shape("Text") + shape("Kopf", '<p:ph type="title"/>')))


def test_preprocessing_counts_and_reads_what_has_changed(spark, tmp_path):
    files, out = tmp_path / "in", str(tmp_path / "corpus")
    files.mkdir()
    word(files / "w.docx")
    slides(files / "s.pptx")
    (files / "a b.txt").write_text("hallo")
    (files / "e.txt").write_text(" ")
    (files / "x.docx").write_text("kein Archiv")
    (files / "y.bin").write_text("?")
    assert io.preprocess(spark, str(files), out) == {"processed": 3, "skipped": 1, "empty": 1, "errors": 1}
    text = {r.source: r.text for r in io.corpus(spark, out).collect()}
    assert set(text) == {"w.docx", "s.pptx", "a b.txt"}
    assert "--- FLIESSTEXT ---\nErstens\nZwei\ttens\n\n--- TABELLEN IN DOKUMENT ---\na b | a b | c\n[Tabelle Ende]\n" in text["w.docx"]
    assert "\n--- FOLIE 1 ---\nTITEL: Kopf\n- Text\n\n--- FOLIE 2 ---\n- später\n" in text["s.pptx"]
    assert io.preprocess(spark, str(files), out) == {"processed": 0, "skipped": 6, "empty": 0, "errors": 0}
    (files / "a b.txt").write_text("neu")
    os.utime(files / "a b.txt", (2_000_000_000, 2_000_000_000))
    assert io.preprocess(spark, str(files), out) == {"processed": 1, "skipped": 5, "empty": 0, "errors": 0}
    assert [r.text.split("\n")[1] for r in io.corpus(spark, out).where("source = 'a b.txt'").collect()] == ["neu"]
    assert io.preprocess(spark, str(files), out, force=True)["processed"] == 3
    assert io.corpus(spark, out).count() == 3


def test_fingerprint_of_no_corpus(spark, tmp_path):
    kind = "path string, content binary, length long"
    assert io.fingerprint(spark.createDataFrame([], kind)).first().fingerprint == io.NO_CORPUS


def test_json_file(spark, tmp_path):
    io.write_json(spark.createDataFrame([("ä", ["x"], None)], "a string, b array<string>, c int"), str(tmp_path / "q.json"))
    text = (tmp_path / "q.json").read_text(encoding="utf-8")
    assert json.loads(text) == [{"a": "ä", "b": ["x"], "c": None}] and '\n  {\n    "a": "ä"' in text


def test_catalogue_from_a_workbook(spark, tmp_path):
    path = str(tmp_path / "k.xlsx")
    office.write_workbook({"Fragen": spark.createDataFrame([(1, "Regulatorik", "Wissen", "Was gilt?", "Etwas", 2, "Atomic Facts")], "ID int, Kategorie string, Aufgabentyp string, Frage string, Referenzantwort string, Schwierigkeitslevel int, Antwortoptionen string")}, path)
    r = catalogue.to_questions(io.read_table(spark, path)).first()
    assert (r.id, r.task_type_raw, r.difficulty, r.reference_answer, r.atomic_facts, r.max_words, r.expected_trap_behavior) == ("1", "Wissen", "2", "Etwas", ["Etwas"], "", "")


def test_catalogue_aliases_facts_and_traps(spark):
    kind = "ID string, Frage string, Goldstandard string, Referenzantwort string, `Atomic Facts` string, Atomic_Facts string, atomic_fact_1 string, atomic_fact_2 string, Antwortoptionen string, `Trap-Kriterium` string, `Fangfragen-Kriterium` string"
    rows = [
        ("1", "q", "gold", "ref", " - a\nb|c; ", "x", "", "", "", "early", "late"),
        ("2", "q", "g1; g2", "", "", "", "n1", "n2", "Fangfrage", "early", ""),
        ("3", "q", "", "", "", "", "n1", " ", "trap", "", None),
        ("4", "q", "", "", " ; ", "y", "", "", "Trap", "", ""),
        ("5", "q", "old", "old", "", "", "", "", "Fangfrage", "", ""),
    ]
    overrides = spark.createDataFrame([("5", "neu; zwei", "so"), ("1", None, "anders")], "id string, reference_answer string, expected_trap_behavior string")
    df = spark.createDataFrame(rows, kind)
    got = {r.id: r for r in catalogue.to_questions(df).collect()}
    # The later header counts, even where it is empty.
    assert (got["1"].reference_answer, got["1"].expected_trap_behavior, got["1"].atomic_facts) == ("ref", "late", ["a", "b", "c"])
    assert (got["2"].reference_answer, got["2"].atomic_facts) == ("g1; g2", ["g1", "g2"]) and got["2"].expected_trap_behavior == catalogue.BEHAVIOUR + "g1; g2"
    assert (got["3"].reference_answer, got["3"].atomic_facts) == ("n1", ["n1"])
    assert (got["4"].atomic_facts, got["4"].expected_trap_behavior) == (["y"], catalogue.BEHAVIOUR + "y")
    new = {r.id: r for r in catalogue.to_questions(df, overrides).collect()}
    assert (new["5"].reference_answer, new["5"].atomic_facts, new["5"].expected_trap_behavior) == ("neu; zwei", ["neu", "zwei"], "so")
    assert (new["1"].reference_answer, new["1"].expected_trap_behavior, new["1"].atomic_facts) == ("ref", "anders", ["a", "b", "c"])
    assert df.select(F.lit(1)).count() == len(new)

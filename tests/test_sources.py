import io
import zipfile

import pytest
from pyspark.sql import functions as F

from grainstore.engine import Engine
from grainstore.sources import files as S


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, content in entries.items():
            box.writestr(name, content)
    return out.getvalue()


DOCX = _zip({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = _zip({
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="i1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>id</t></si><si><t>Alice</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"/><row r="2"><c r="A2" t="s"><v>0</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>',
})
PPTX = _zip({"ppt/slides/slide1.xml": '<s xmlns:p="p" xmlns:a="a"><p:sp><a:t>One</a:t></p:sp></s>', "ppt/slides/slide2.xml": "<s/>"})


@pytest.mark.parametrize(
    "raw, name, kind",
    [(b"%PDF-1.7", "x.txt", "pdf"), (DOCX, "A.DOCX", "docx"), (XLSX, "a.xlsx", "xlsx"), (PPTX, "a.pptx", "zip"), (b"hi", "a.md", "md"), (b"x", "a.zip", "zip"),
     (b"x", "A.java", "code"), (b"x", "a.ini", "text"), (b"x", "a.exe", "unknown"), (b"", None, "unknown")],
)
def test_kinds(spark, raw, name, kind):
    df = spark.createDataFrame([(name, bytearray(raw))], "filename string, content binary")
    assert df.select(S.file_kind(F.col("content"), F.col("filename")).alias("k")).first().k == kind


def test_encodings():
    assert S.decoded("한글".encode()) == "한글" == S.decoded("한글".encode("cp949")) and S.decoded(b"\xff\xfe\xe9") and S.decoded(b"abcdef", 3) == "abc"


def test_parsers():
    assert S.csv_text("id,name\n1,Alice\n\n2,B,C\n") == "row 2 | id: 1 | name: Alice\nrow 4 | id: 2 | name: B | col_3: C"
    assert S.csv_text("id,name\n") == "id,name\n" and S.csv_text("") == ""
    assert S.docx_text(DOCX) == "Hello\n\ntable row 1 | a | b"
    assert S.xlsx_sheets(XLSX) == [("S1", "sheet S1 row 3 | id: 7 | col_2: Alice")]
    assert S.pptx_text(PPTX) == "slide 1 | One"


def test_archives_stay_in_their_folder():
    assert S.safe_path("../../etc/passwd.txt") == "etc/passwd.txt" and S.safe_path("C:\\x\\..\\a.py") == "x/a.py" and S.safe_path("/..") == ""
    raw = _zip({"../../a.py": "x", "node_modules/b.js": "x", ".env": "x", "c.exe": "x", "Dockerfile": "x", "d/e.csv": "h\n1"})
    assert {p for p, _ in S.archive_entries(raw, S.SourceConfig())} == {"a.py", "Dockerfile", "d/e.csv"}
    for config in (S.SourceConfig(max_entries=2), S.SourceConfig(max_bytes=3)):
        with pytest.raises(ValueError):
            list(S.archive_entries(raw, config))


def test_engine_from_files_to_answers(spark, tmp_path):
    code = "class AuthController:\n    def login(self):\n        return 1\n"
    for name, raw in {"a.txt": b"hello world", "app.zip": _zip({"auth/controller/auth_controller.py": code, "bad.docx": b"x"}), "one.py": code.encode(), "t.docx": DOCX, "s.xlsx": XLSX,
                      "broken.zip": b"PK\x03\x04xx", "x.pdf": b"%PDF-broken", "y.bin": b"?"}.items():
        (tmp_path / name).write_bytes(raw)
    engine = Engine(spark, generator=lambda prompt: str(len(prompt)))
    errors = {r.filename for r in engine.ingest(S.read_files(spark, str(tmp_path))).collect()}
    assert {"broken.zip", "x.pdf", "y.bin", "app.zip"} == errors
    n = engine.code_chunks.count(), engine.text_chunks.count()
    engine.ingest(S.read_files(spark, str(tmp_path)))
    assert (engine.code_chunks.count(), engine.text_chunks.count()) == n == (2, 3)
    cases = spark.createDataFrame([(1, "AuthController login", "auth/controller/auth_controller.py")], "question_id long, question string, expected_top_path string")
    assert tuple(engine.evaluate(cases).first()) == (1, 1, 1.0)
    assert int(engine.ask(cases.select("question_id", "question")).first().answer) > 30
    scope = spark.createDataFrame([("code", "none")], "kind string, ref_id string")
    assert engine.search(cases, scope).count() == 0

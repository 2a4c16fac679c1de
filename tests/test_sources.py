from __future__ import annotations

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.operators.grid import ROW
from gridloom.sources import csv as C
from gridloom.sources import ooxml as X


FERRY = [["pier", "sails"], ["Nørre", "06:15"], ["Øst", "07:40"]]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_of_each_mark_encoding_and_line_end(mark, encoding, end):
    rows, meta = C.parse("".join(mark.join(r) + end for r in FERRY).encode(encoding))
    assert rows == FERRY and meta.delimiter == mark and not meta.lossy


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('pier,note\nA,"windy, ""very"""\n', [["pier", "note"], ["A", 'windy, "very"']]), ('p,q\n"upper\nlower",7\n', [["p", "q"], ["upper\nlower", "7"]]), ("p\nq,r,s\nt,u\n", [["p", "", ""], ["q", "r", "s"], ["t", "u", ""]]),
        ("\np,q\n\n\nr,s\n;;\n", [["p", "q"], ["r", "s"], [";;", ""]]), ('p,q\nr,s\n""\n""\n', [["p", "q"], ["r", "s"]]), ('p\n""\nq\n', [["p"], [""], ["q"]]), ("solo\nduo\n", [["solo"], ["duo"]]), ('p,q\n"never closed,1\nr,s\n', [["p", "q"], ["never closed,1\nr,s\n", ""]]),
    ],
)
def test_csv_rows(text, rows):
    assert C.parse(text.encode())[0] == rows


@pytest.mark.parametrize(
    ("encoding", "text"),
    [
        ("gb18030", "码头,开船,票价\n北岸码头,清晨六点,三十元\n南岸码头,中午十二点,四十元\n"), ("big5", "碼頭,開船,票價\n北岸碼頭,清晨六點,三十元\n南岸碼頭,中午十二點,四十元\n"), ("shift_jis", "桟橋,出航,運賃\nきたの桟橋,あさ六時,三百円\nみなみの桟橋,ひる十二時,四百円\n"),
        ("euc_kr", "선착장,출항,요금\n북쪽 선착장,아침 여섯시,삼천원\n남쪽 선착장,점심 열두시,사천원\n"), ("windows-1252", "quai,départ,été\nNoël,première façade,où être\nCafé,âge,garçon\n"),
    ],
)
def test_csv_encodings_are_told_apart(encoding, text):
    rows, meta = C.parse(text.encode(encoding))
    assert meta.encoding == encoding and rows == [r.split(",") for r in text.split()] if " " not in text else rows[0] == text.split("\n")[0].split(",")


@pytest.mark.parametrize(("data", "kind"), [(b"", "empty"), (b" \r\n\t", "empty"), (b"pier\x00,q\n", "not_text"), (b"".join(bytes([k % 8 + 1, 65]) for k in range(400)), "not_text"), (b"\xef\xbb\xbf\xff\xff\xff", "undecodable")])
def test_csv_errors(data, kind, spark, tmp_path):
    with pytest.raises(C.CsvError) as e:
        C.parse(data)
    assert e.value.kind == kind
    (tmp_path / "x.csv").write_bytes(data)
    # Spark's file scan passes over files of no bytes.
    assert [r["error"] for r in C.read_csv_files(spark, str(tmp_path)).collect()] == [kind] * bool(data)
    with pytest.raises(C.CsvError) as e:
        C.read_csv(spark, str(tmp_path / "x.csv"))
    assert e.value.kind == kind


def quays(seed: int, n: int, quoted: bool, mark: str = ",") -> str:
    """Ragged lines, some blank, with quoted marks, quotes and line feeds if asked for."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        cells = [f"q{k}", *("".join(rng.choice("abc é漢") for _ in range(rng.randrange(8))) for _ in range(rng.choice([1, 2, 2, 2, 6 if k > n * 0.9 else 3])))]
        if quoted and rng.random() < 0.4:
            at = rng.randrange(len(cells))
            cells[at] = '"' + cells[at] + rng.choice([mark, '""', "\n", "\r\n", '\n""\n', "line\n" * 40]) + '"'
        out.append(mark.join(cells) + rng.choice(["\n", "\r\n"]) + ("\n" if rng.random() < 0.05 else ""))
    return "".join(out) + ('""\n""\n' if quoted else "\n\n")


@pytest.mark.parametrize(("quoted", "encoding", "mark", "split"), [(False, "utf-8-sig", ";", 2000), (True, "utf-8", ",", 700), (True, "gb18030", "\t", 3000), (True, "utf-16", ",", 10**8), (False, "utf-8", "|", 10**8)])
def test_csv_in_splits_is_as_the_whole_file(spark, tmp_path, monkeypatch, quoted, encoding, mark, split):
    """Rows wider than the head's, quoted line feeds over splits, blank lines: the same rows whatever the splits are."""
    monkeypatch.setattr(C, "HEAD_BYTES", 1024 if encoding != "utf-16" else C.HEAD_BYTES)
    text = quays(7, 400, quoted, mark) if encoding != "gb18030" else quays(7, 400, quoted, mark).replace("é", "岸")
    path = tmp_path / "quays.csv"
    path.write_bytes(text.encode(encoding))
    want = C.parse(text.encode("utf-8"), mark)[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        grid, names = C.read_csv(spark, str(path), mark, header=True, physical=True)
        got = sorted(grid.collect(), key=lambda r: r[ROW])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[ROW] for r in got] == list(range(len(want))) and [list(r[2:]) for r in got] == want
    assert [r["_fields"] for r in got] == [len(x) for x in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if x][: len(got)] or encoding == "utf-16"
    assert [x for x in names if x] == [x for x in want[0] if x]


def test_csv_limits_and_meta(spark, tmp_path):
    rows, meta = C.parse(b"pier;deck\nA;1\nB;2\n", max_rows=2, max_cols=1)
    assert rows == [["pier"], ["A"]] and (meta.delimiter, meta.delimiter_source, meta.truncated_rows, meta.truncated_cols) == (";", "sniffed", True, True)
    (tmp_path / "wide.csv").write_text(",".join(map(str, range(C.MAX_COLS + 3))) + "\n")
    r = C.read_csv_files(spark, str(tmp_path)).first()
    assert len(r["fields"]) == C.MAX_COLS and r["truncated_cols"] and not r["truncated_rows"]


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items: tuple[str, str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in items) + "</Relationships>"


CHART = '<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:cat><c:strCache><c:pt><c:v>Jan</c:v></c:pt><c:pt><c:v>Feb</c:v></c:pt></c:strCache></c:cat><c:val><c:numCache><c:pt><c:v>10</c:v></c:pt><c:pt><c:v>20</c:v></c:pt></c:numCache></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>'
WORKBOOK = package({
    "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="Kai" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml")),
    "xl/sharedStrings.xml": "<sst><si><t>boat</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns:r="{REL}"><cols><col min="1" max="2" width="12"/></cols><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>0.25</v></c><c r="B2" s="2"><v>43831</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><f>A2*2</f><v>0.5</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells><conditionalFormatting sqref="A1:A9"><cfRule type="cellIs" operator="greaterThan"><formula>5</formula></cfRule></conditionalFormatting><drawing r:id="d1"/></worksheet>',
    "xl/worksheets/_rels/sheet1.xml.rels": rels(("d1", "drawing", "../drawings/drawing1.xml")),
    "xl/drawings/drawing1.xml": f'<wsDr xmlns:r="{REL}"><anchor><from><col>1</col><row>2</row></from><to><col>4</col><row>6</row></to><chart r:id="c1"/></anchor></wsDr>',
    "xl/drawings/_rels/drawing1.xml.rels": rels(("c1", "chart", "../charts/chart1.xml")),
    "xl/charts/chart1.xml": CHART,
})
DOCUMENT = package({
    "word/document.xml": f'<w:document xmlns:w="w" xmlns:r="{REL}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Title</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:hyperlink r:id="h1"><w:r><w:t>two</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>pier</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>4410</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/_rels/document.xml.rels": f'<Relationships><Relationship Id="h1" Type="{REL}/hyperlink" Target="https://example.com/" TargetMode="External"/><Relationship Id="n1" Type="{REL}/footnotes" Target="footnotes.xml"/><Relationship Id="c1" Type="{REL}/comments" Target="comments.xml"/></Relationships>',
    "word/footnotes.xml": '<w:footnotes xmlns:w="w"><w:footnote w:id="0"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>',
    "word/comments.xml": '<w:comments xmlns:w="w"><w:comment w:id="0" w:author="Ann"><w:p><w:r><w:t>why?</w:t></w:r></w:p></w:comment></w:comments>',
})
SLIDES = package({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="1" r:id="s2"/><p:sldId id="2" r:id="s1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(("s1", "slide", "slides/slide1.xml"), ("s2", "slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:spTree><p:sp><p:cNvPr id="9"/><p:spPr><a:xfrm rot="5400000"><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm><a:solidFill><a:srgbClr val="FF0000"/></a:solidFill></p:spPr><p:txBody><a:p><a:r><a:t>first </a:t></a:r><a:r><a:t>slide</a:t></a:r></a:p></p:txBody></p:sp></p:spTree><p:timing><p:cTn nodeType="clickEffect"><p:spTgt spid="9"/></p:cTn></p:timing></p:sld>',
    "ppt/slides/slide2.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:spTree><p:grpSp><p:grpSpPr><a:xfrm><a:off x="100" y="100"/><a:ext cx="20" cy="20"/><a:chOff x="0" y="0"/><a:chExt cx="10" cy="10"/></a:xfrm></p:grpSpPr><p:sp><p:cNvPr id="2"/><p:spPr><a:xfrm><a:off x="5" y="5"/><a:ext cx="1" cy="1"/></a:xfrm></p:spPr></p:sp></p:grpSp><p:sp><p:spPr/></p:sp></p:spTree></p:sld>',
})


def test_workbook_facets():
    cells = {(c["row"], c["col"]): c for c in X.workbook_cells(WORKBOOK)}
    assert [cells[0, 0]["display"], cells[0, 1]["display"], cells[1, 0]["display"], cells[1, 1]["display"], cells[1, 2]["display"]] == ["boat", "ab", "25.00%", "2020-01-01", "TRUE"]
    assert cells[1, 3]["formula"] == "=A2*2" and cells[1, 3]["display"] == "0.5" and cells[0, 0]["sheet"] == "Kai"
    layout = {r["facet"]: (r["ref"], r["value"]) for r in X.workbook_layout(WORKBOOK)}
    assert layout["merge"] == ("A3:B3", None) and layout["width"] == ("1:2", "12") and layout["conditional"] == ("A1:A9", "cellIs:greaterThan:5")
    assert layout["chart"] == ("2,1-6,4", "bar|Sales|Jan,Feb|10,20")


def test_document_blocks():
    blocks = list(X.document_blocks(DOCUMENT))
    assert [(b["path"], b["text"], b["list"]) for b in blocks if b["section"] == "body"] == [("0", "Title", None), ("1", "one", "3:0:1"), ("2", "two", "3:0:2"), ("3/0,0/0", "pier", None), ("3/0,1/0", "4410", None)]
    assert blocks[0]["style"] == "Heading1" and blocks[0]["runs"][0]["bold"] and blocks[2]["runs"][1]["link"] == "https://example.com/" and blocks[2]["runs"][0]["revision"] == "del"
    assert [b["text"] for b in blocks if b["kind"] == "note"] == ["1. note", "Ann:why?"]


def test_slide_shapes():
    shapes = list(X.slide_shapes(SLIDES))
    assert [(s["slide"], s["shape"], s["kind"]) for s in shapes] == [(1, "2", "shape"), (2, "9", "text")]
    assert (shapes[0]["x"], shapes[0]["w"]) == (110.0, 2.0)
    assert (shapes[1]["text"], shapes[1]["rotation"], shapes[1]["fill"], shapes[1]["step"]) == ("first slide", 90.0, "FF0000", 1)


def test_charts_without_series_are_none():
    assert X.chart(X.ET.fromstring("<c><barChart/></c>")) is None


def test_packages_are_read_as_dataframes(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(WORKBOOK)
    (tmp_path / "b.xlsx").write_bytes(b"PK not a zip")
    rows = X.read_packages(spark, str(tmp_path), "cells").collect()
    assert sum(r["error"] is None for r in rows) == 6 and sum(r["error"] is not None for r in rows) == 1
    assert X.detect(WORKBOOK) == "xlsx" and X.detect(DOCUMENT) == "docx" and X.detect(SLIDES) == "pptx" and X.detect(b"a,b\n1,2") == "csv" and X.detect(b"\0\1") == "unknown"


def test_a_date_without_a_code_is_shown_in_iso_form():
    assert [X.shown("n", raw, None, True) for raw in ("43890", "43890.75", "43890.9999999")] == ["2020-02-29", "2020-02-29 18:00:00", "2020-03-01"]
    assert X.shown("n", "43890", None) == "43890" and X.shown("n", "43890", "yyyy", True) == "2020"


def test_packed_rows_come_back_and_corrupt_ones_do_not(spark):
    from gridloom.sources import packed as K

    rows = [(0, ["a", "", "漢字"]), (1, []), (2, ["x" * 300, None]), (7, ["é"]), (9, ["1", "2", "3", "4"])]
    df = spark.createDataFrame(rows, "_row long, fields array<string>").repartition(3)
    made = K.pack(df, 4, "fields")
    assert {r["_row"]: r["fields"] for r in K.unpack(made).collect()} == {i: [c or "" for c in f] for i, f in rows}
    assert {r["col"]: r["width"] for r in K.widths_of(made).collect()} == {0: 60, 1: 3, 2: 4, 3: 3}
    good = {"text": "aé".encode(), "cell_ends": [1, 3], "row_starts": [0, 1, 2], "cols": 1, "widths": [3], "numbers": [4, 5]}
    assert K.checked(**good) == [["a"], ["é"]]
    wrong = {"not UTF-8": {"text": b"a\xff\xff"}, "no row starts": {"row_starts": []}, "widths": {"widths": []}, "number of cells": {"row_starts": [0, 1]}, "row starts fall": {"row_starts": [0, 3, 2]}, "cell ends fall": {"cell_ends": [4, 3]}, "length of text": {"cell_ends": [1, 2]}, "do not fit": {"numbers": [1]}, "inside a character": {"cell_ends": [2, 3]}}
    for reason, part in wrong.items():
        with pytest.raises(K.CorruptPacked, match=reason):
            K.checked(**good | part)
    with pytest.raises(Exception, match="corrupt_packed"):
        K.unpack(made.withColumn("cols", F.lit(0))).collect()
    assert K.unpack(K.pack(df.limit(0), 4, "fields")).collect() == []

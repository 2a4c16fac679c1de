"""Queries over the sources: each writes a table as files or packages and reads it back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import ROW
from gridloom.plans.language import a1
from gridloom.sources.csv import read_csv, read_csv_files
from gridloom.sources.ooxml import detect, parse_packages
from gridloom.sources.packed import pack, unpack, widths_of
from gridloom.sources.scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Fixed value: the namespace of package relationships.
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def query(name: str, sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(df: DataFrame, line: str, order: str) -> str:
    """The folder of one text file with a line for each row, in order."""
    path = shared_folder(df.sparkSession)
    df.select(F.expr(line).alias("value"), order).coalesce(1).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("csv_ragged", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _row, 2 + p_partkey % 4 AS _fields, CAST(p_partkey AS VARCHAR) AS c0, p_name AS c1, CASE WHEN p_partkey % 4 > 0 THEN 'x' ELSE '' END AS c2, CASE WHEN p_partkey % 4 > 1 THEN 'x' ELSE '' END AS c3, CASE WHEN p_partkey % 4 > 2 THEN 'x' ELSE '' END AS c4 FROM part")
def _ragged(s: SparkSession, d: str) -> DataFrame:
    path = lines_of(table(s, d, "part"), "concat(p_partkey, ';', p_name, repeat(';x', CAST(p_partkey % 4 AS INT)), CASE WHEN p_partkey % 5 = 0 THEN '\\n' ELSE '' END)", "p_partkey")
    return read_csv(s, path, physical=True)[0].withColumn("_fields", F.col("_fields").cast("long"))


@query("csv_quoted_lines", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS _row, CAST(p_partkey AS VARCHAR) AS c0, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS c1, CAST(p_size AS VARCHAR) AS c2 FROM part")
def _quoted(s: SparkSession, d: str) -> DataFrame:
    line = """concat(p_partkey, ',"', p_name, ', ""', p_brand, '""', chr(10), p_type, '",', p_size)"""
    return read_csv(s, lines_of(table(s, d, "part"), line, "p_partkey"))[0]


@query("csv_encoded", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _row, CAST(n_nationkey AS VARCHAR) AS c0, n_name || '中国的人' AS c1, CASE WHEN n_regionkey > 2 THEN n_name ELSE '我们，是' END AS c2 FROM nation")
def _encoded(s: SparkSession, d: str) -> DataFrame:
    """Text in a double-byte encoding that the reader has to find out."""
    path = shared_folder(s)
    made = table(s, d, "nation").orderBy("n_nationkey").select("n_nationkey", F.concat("n_name", F.lit("中国的人")), F.when(F.col("n_regionkey") > 2, F.col("n_name")).otherwise("我们，是"))
    s.conf.set("spark.sql.legacy.javaCharsets", "true")  # the writer takes few encodings otherwise
    try:
        made.coalesce(1).write.option("encoding", "GB18030").csv(path)
    finally:
        s.conf.unset("spark.sql.legacy.javaCharsets")
    return read_csv(s, path)[0]


@query("csv_blank_end", "SELECT p_partkey AS _row, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE p_name END AS c0, CASE WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS c1 FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_partkey % 3 <> 1 AND p_partkey < (SELECT count(*) - 5 FROM part))")
def _blank_end(s: SparkSession, d: str) -> DataFrame:
    """Rows of one empty field are rows in the middle and none at the end."""
    parts = table(s, d, "part")
    return read_csv(s, lines_of(parts, f"CASE WHEN p_partkey % 3 = 1 OR p_partkey >= {parts.count() - 5} THEN '\"\"' ELSE concat(p_name, '\t', p_brand) END", "p_partkey"))[0]


@query("packed_round_trip", "SELECT p_partkey AS _row, CAST(p_size AS VARCHAR) AS c0, p_name AS c1, p_brand || '－' AS c2 FROM part")
def _packed(s: SparkSession, d: str) -> DataFrame:
    """A grid packed, written, read, checked and cut up again."""
    path = shared_folder(s)
    grid = table(s, d, "part").select(F.col("p_partkey").alias(ROW), "p_size", "p_name", F.concat("p_brand", F.lit("－")).alias("b"))
    pack(grid, 512).write.parquet(path)
    return unpack(s.read.parquet(path)).select(ROW, *[F.col("fields")[i].alias(f"c{i}") for i in range(3)])


@query("packed_widths", "SELECT CAST(col AS INTEGER) AS col, CAST(least(greatest(max(w), 3), 60) AS INTEGER) AS width FROM (SELECT 0 AS col, length(CAST(p_size AS VARCHAR)) AS w FROM part UNION ALL SELECT 1, length(p_name) FROM part UNION ALL SELECT 2, length(p_brand) + 2 FROM part) GROUP BY col")
def _packed_widths(s: SparkSession, d: str) -> DataFrame:
    return widths_of(pack(table(s, d, "part").select(F.col("p_partkey").alias(ROW), "p_size", "p_name", F.concat("p_brand", F.lit("－")).alias("b")), 300))


@query("csv_whole_files", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, 'not_text' AS error FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1)")
def _files(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s)
    made = table(s, d, "nation").select(F.concat_ws("|", "n_nationkey", "n_name").alias("value"), F.col("n_regionkey").alias("region"))
    made = made.union(s.createDataFrame([("\u0000\u0001,binary", -1)], "value string, region int"))
    made.repartition(4, "region").write.partitionBy("region").text(path)
    found = read_csv_files(s, f"{path}/region=*/*.txt")
    good = F.col("error").isNull()
    return found.agg(F.count_distinct(F.when(good, F.col("path"))).alias("files"), F.count_if(good).alias("rows"), F.max("error").alias("error"))


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(kind: str, targets: list[str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{REL}/{kind}" Target="{t}"/>' for i, t in enumerate(targets)) + "</Relationships>"


def workbook(rows: pd.DataFrame) -> bytes:
    cells = "".join(f'<row r="{r + 1}"><c r="{a1(r, 0)}" t="str"><v>{escape(x.n_name)}</v></c><c r="{a1(r, 1)}" s="1"><v>{x.n_nationkey / 8}</v></c></row>' for r, x in enumerate(rows.itertuples()))
    return packed({
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets><sheet name="nations" r:id="r0"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels("worksheet", ["worksheets/sheet1.xml"]),
        "xl/styles.xml": '<styleSheet><numFmts/><fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
    })


def document(rows: pd.DataFrame) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x.n_name)}</w:t></w:r></w:p>" for x in rows.itertuples())
    return packed({"word/document.xml": f'<w:document xmlns:w="w" xmlns:r="{REL}"><w:body>{body}</w:body></w:document>'})


def slides(rows: pd.DataFrame) -> bytes:
    many = list(rows.itertuples())
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldIdLst>' + "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(len(many))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels("slide", [f"slides/slide{i}.xml" for i in range(len(many))]),
    }
    for i, x in enumerate(many):
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr id="{i + 2}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{12700 * i}" y="0"/><a:ext cx="12700" cy="12700"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{escape(x.n_name)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return packed(parts)


def packages(s: SparkSession, d: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """``path, content``: a package for each region, of its nations."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(part.n_regionkey.iloc[0])], "content": [make(part.sort_values("n_nationkey"))]})

    return table(s, d, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(build, "path string, content binary")


_PLACED = "(SELECT CAST(n_regionkey AS VARCHAR) AS path, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)"


@query("xlsx_cells", f"SELECT path AS file, 'nations' AS sheet, CAST(i AS INTEGER) AS row, 0 AS col, n_name AS display FROM {_PLACED} UNION ALL SELECT path, 'nations', CAST(i AS INTEGER), 1, printf('%.2f%%', n_nationkey * 12.5) FROM {_PLACED}")
def _xlsx(s: SparkSession, d: str) -> DataFrame:
    return parse_packages(packages(s, d, workbook), "cells").select("file", "sheet", "row", "col", "display")


@query("docx_blocks", f"SELECT path AS file, 'body' AS section, CAST(i AS VARCHAR) AS path, n_name AS text FROM {_PLACED}")
def _docx(s: SparkSession, d: str) -> DataFrame:
    return parse_packages(packages(s, d, document), "blocks").select("file", "section", "path", "text")


@query("pptx_shapes", f"SELECT path AS file, CAST(i + 1 AS INTEGER) AS slide, CAST(i + 2 AS VARCHAR) AS shape, n_name AS text FROM {_PLACED}")
def _pptx(s: SparkSession, d: str) -> DataFrame:
    return parse_packages(packages(s, d, slides), "shapes").select("file", "slide", "shape", "text")


@query("detect_format", "SELECT CAST(n_regionkey AS VARCHAR) AS path, k.kind FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES ('xlsx'), ('docx'), ('pptx')) k(kind)")
def _detect(s: SparkSession, d: str) -> DataFrame:
    every = packages(s, d, workbook).union(packages(s, d, document)).union(packages(s, d, slides))

    def kinds(parts):
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "kind": [detect(bytes(c)) for c in part["content"]]})

    return every.mapInPandas(kinds, "path string, kind string")

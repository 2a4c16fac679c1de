"""Office Open XML packages: parts, relationships, workbooks, documents, presentations, charts.

Packages are read whole, one per task (``binaryFile``), into rows of facets, so that a
folder of files is one DataFrame. A package that cannot be read is a row with an error.
"""

from __future__ import annotations

import io
import math
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions.cells import general
from gridloom.functions.numfmt import BUILTIN, Section, format_with, sections
from gridloom.functions.serial import from_serial
from gridloom.plans.language import parse_a1
from gridloom.sources.csv import DELIMITERS, files

MAX_CELLS = 8_000_000


def detect(head: bytes) -> str:
    """xlsx, docx, pptx, csv or unknown, from a file's bytes."""
    if head.startswith(b"PK\x03\x04"):
        return next((k for mark, k in ((b"word/", "docx"), (b"xl/", "xlsx"), (b"ppt/", "pptx")) if mark in head), "unknown")
    start = head[: 8 * 1024]
    marked = start.startswith((b"\xff\xfe", b"\xfe\xff"))
    return "csv" if start and (marked or b"\0" not in start) and (marked or any(d.encode() in start for d in DELIMITERS)) else "unknown"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def every(node: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in node.iter() if local(x.tag) == name)


def first(node: ET.Element | None, *names: str) -> ET.Element | None:
    """The first child of a child ... of these names."""
    for name in names:
        node = None if node is None else next((x for x in node if local(x.tag) == name), None)
    return node


def attr(node: ET.Element | None, name: str, default: str | None = None) -> str | None:
    return default if node is None else next((v for k, v in node.attrib.items() if local(k) == name), default)


def rid(node: ET.Element) -> str | None:
    """The relationship that an element names; its plain ``id`` is something else."""
    return next((v for k, v in node.attrib.items() if k.startswith("{") and local(k) == "id"), None)


def flag(node: ET.Element | None) -> bool:
    return node is not None and attr(node, "val", "1") not in ("0", "false", "none")


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def bytes(self, part: str) -> bytes | None:
        return self.zip.read(part) if part in self.names else None

    def xml(self, part: str) -> ET.Element | None:
        raw = self.bytes(part)
        return None if raw is None else ET.fromstring(raw)

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (kind, target part)."""
        folder, name = posixpath.split(part)
        tree = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels")
        out = {}
        for r in [] if tree is None else tree:
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id")] = (r.get("Type", "").rpartition("/")[2], target)
        return out


# Charts


def chart(tree: ET.Element) -> dict | None:
    """Kind, series, categories and title from the cached values; None without a known kind or a series."""
    kinds = {"barChart": "bar", "bar3DChart": "bar", "lineChart": "line", "areaChart": "line", "pieChart": "pie", "doughnutChart": "pie"}
    plot = next((x for x in tree.iter() if local(x.tag) in kinds), None)
    if plot is None:
        return None

    def cached(node: ET.Element | None, cache: str) -> list[str]:
        found = None if node is None else next(every(node, cache), None)
        return [] if found is None else [first(p, "v").text or "" for p in every(found, "pt") if first(p, "v") is not None]

    series = [[float(v) for v in cached(first(s, "val"), "numCache") if re.fullmatch(r"[-+0-9.eE]+", v)] for s in every(plot, "ser")]
    series = [s for s in series if s]
    if not series:
        return None
    categories = next((c for s in every(plot, "ser") if (c := cached(first(s, "cat"), "strCache"))), [])
    title = first(tree, "chart", "title")
    return {"kind": kinds[local(plot.tag)], "series": series, "categories": categories, "title": "".join(t.text or "" for t in every(title, "t")) if title is not None else None}


# Workbooks


def styles(pkg: Package) -> list[dict]:
    """For each cell style its format code, font, fill and border."""
    tree = pkg.xml("xl/styles.xml")
    if tree is None:
        return []
    codes = {int(n.get("numFmtId")): n.get("formatCode") for n in every(tree, "numFmt")}
    part = lambda name: list(first(tree, name) if first(tree, name) is not None else [])
    fonts, fills, borders = part("fonts"), part("fills"), part("borders")
    out = []
    for xf in part("cellXfs"):
        fid = int(xf.get("numFmtId", 0))
        at = lambda items, key, x=xf: items[int(x.get(key, 0))] if int(x.get(key, 0)) < len(items) else None
        font, fill, border = at(fonts, "fontId"), at(fills, "fillId"), at(borders, "borderId")
        color = None if fill is None else next((attr(c, "rgb") for c in every(fill, "fgColor")), None)
        code = codes.get(fid, BUILTIN.get(fid))
        out.append({"code": code, "date": is_date(code) if code else fid in DATE_IDS, "bold": flag(first(font, "b")), "italic": flag(first(font, "i")), "color": attr(first(font, "color"), "rgb"), "fill": color, "border": border is not None and any(b.get("style") for b in border)})
    return out


#: The built-in format ids of dates and times, which have no declared code.
DATE_IDS = frozenset((*range(14, 23), 45, 46, 47))


def is_date(code: str | None) -> bool:
    return code is not None and any(Section(s.body).kind == "date" for s in sections(code))


def shown(kind: str, raw: str, code: str | None, date: bool = False) -> str:
    """A cell's text: numbers by their format code, dates without one in ISO form."""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    try:
        n = float(raw)
    except ValueError:
        return raw
    return format_with(n, code)[0] if code else iso(n) if date and math.isfinite(n) else str(general(n))


def iso(serial: float) -> str:
    """Date, and the time to the second unless it is midnight."""
    day, seconds = divmod(math.floor(serial * 86400 + 0.5), 86400)
    y, m, d = from_serial(day)
    return f"{y:04}-{m:02}-{d:02}" + (f" {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}" if seconds else "")


def sheet_parts(pkg: Package) -> list[tuple[str, str]]:
    rels = pkg.rels("xl/workbook.xml")
    tree = pkg.xml("xl/workbook.xml")
    return [] if tree is None else [(s.get("name", ""), rels[rid(s)][1]) for s in every(tree, "sheet") if rid(s) in rels]


def workbook_cells(data: bytes) -> Iterator[dict]:
    """``sheet, row, col, kind, raw, display, formula, style``; cached values, nothing is calculated.

    A sheet of more than ``MAX_CELLS`` ends with a row of the kind ``truncated`` and no place.
    """
    pkg = Package(data)
    shared = pkg.xml("xl/sharedStrings.xml")
    strings = [] if shared is None else ["".join(t.text or "" for t in every(si, "t")) for si in shared]
    looks, count = styles(pkg), 0
    for name, part in sheet_parts(pkg):
        tree = pkg.xml(part)
        if tree is None:
            continue
        count = 0
        for c in every(tree, "c"):
            at = parse_a1(c.get("r", ""))
            if at is None or (count := count + 1) > MAX_CELLS:
                continue
            kind, v, f = c.get("t", "n"), first(c, "v"), first(c, "f")
            raw = "" if v is None else v.text or ""
            if kind == "s":
                raw = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in every(c, "t"))
            style = int(c.get("s", 0))
            look = looks[style] if style < len(looks) else {"code": None, "date": False}
            display = shown(kind, raw, look["code"], look["date"]) if raw else ""
            yield {"sheet": name, "row": at[0], "col": at[1], "kind": kind, "raw": raw, "display": display, "formula": None if f is None else "=" + (f.text or ""), "style": style}
        if count > MAX_CELLS:
            yield {"sheet": name, "row": None, "col": None, "kind": "truncated", "raw": "", "display": "", "formula": None, "style": None}


def workbook_layout(data: bytes) -> Iterator[dict]:
    """``sheet, facet, ref, value``: merges, column widths, frozen panes, conditional formats, sparklines, images, charts."""
    pkg = Package(data)
    for name, part in sheet_parts(pkg):
        tree = pkg.xml(part)
        if tree is None:
            continue
        row = lambda facet, ref, value=None, n=name: {"sheet": n, "facet": facet, "ref": ref, "value": value}
        yield from (row("merge", m.get("ref")) for m in every(tree, "mergeCell"))
        yield from (row("width", f"{c.get('min')}:{c.get('max')}", c.get("width")) for c in every(tree, "col") if c.get("width"))
        yield from (row("frozen", p.get("topLeftCell"), f"{p.get('ySplit', 0)},{p.get('xSplit', 0)}") for p in every(tree, "pane") if p.get("state") == "frozen")
        for cf in every(tree, "conditionalFormatting"):
            yield from (row("conditional", cf.get("sqref"), f"{r.get('type')}:{r.get('operator', '')}:" + ",".join(x.text or "" for x in every(r, "formula"))) for r in every(cf, "cfRule"))
        for s in every(tree, "sparkline"):
            texts = {local(x.tag): x.text for x in s}
            yield row("sparkline", texts.get("sqref"), texts.get("f"))
        rels = pkg.rels(part)
        for kind, target in rels.values():
            drawing = pkg.xml(target) if kind == "drawing" else None
            inner = pkg.rels(target) if drawing is not None else {}
            for anchor in [] if drawing is None else drawing:
                ends = [[int(x.text or 0) for x in (first(e, "row"), first(e, "col")) if x is not None] for e in (first(anchor, "from"), first(anchor, "to")) if e is not None]
                where = "-".join(f"{e[0]},{e[1]}" for e in ends if len(e) == 2)
                for blip in every(anchor, "blip"):
                    yield row("image", where, inner.get(attr(blip, "embed"), ("", ""))[1])
                for c in every(anchor, "chart"):
                    found = pkg.xml(inner.get(rid(c), ("", ""))[1])
                    made = None if found is None else chart(found)
                    if made:
                        yield row("chart", where, f"{made['kind']}|{made['title'] or ''}|{','.join(made['categories'])}|" + ";".join(",".join(map(str, map(general, s))) for s in made["series"]))


# Documents


def document_blocks(data: bytes) -> Iterator[dict]:
    """``section, path, kind, style, list, text, runs``: paragraphs and cells in order, nested by path."""
    pkg = Package(data)
    rels = pkg.rels("word/document.xml")
    counters: dict[tuple[str, str], int] = {}

    def run_rows(p: ET.Element) -> list[dict]:
        out = []

        def visit(node: ET.Element, link: str | None, mark: str | None) -> None:
            for x in node:
                tag = local(x.tag)
                if tag == "r":
                    props = first(x, "rPr")
                    text = "".join("\t" if local(t.tag) == "tab" else "\n" if local(t.tag) == "br" else t.text or "" for t in x.iter() if local(t.tag) in ("t", "delText", "tab", "br"))
                    image = next((rels.get(attr(b, "embed"), ("", ""))[1] for b in every(x, "blip")), None)
                    if text or image:
                        out.append({"text": text, "bold": flag(first(props, "b")), "italic": flag(first(props, "i")), "underline": flag(first(props, "u")), "color": attr(first(props, "color"), "val"), "link": link, "revision": mark, "image": image})
                elif tag == "hyperlink":
                    visit(x, rels.get(rid(x), ("", attr(x, "anchor")))[1], mark)
                elif tag in ("ins", "del"):
                    visit(x, link, tag)
                elif tag in ("sdt", "sdtContent", "smartTag"):
                    visit(x, link, mark)

        visit(p, None, None)
        return out

    def paragraph(p: ET.Element, section: str, path: str) -> dict:
        props = first(p, "pPr")
        num = first(props, "numPr")
        label = None
        if num is not None:
            key = (attr(first(num, "numId"), "val", "0"), attr(first(num, "ilvl"), "val", "0"))
            counters[key] = counters.get(key, 0) + 1
            label = f"{key[0]}:{key[1]}:{counters[key]}"
        runs = run_rows(p)
        return {"section": section, "path": path, "kind": "paragraph", "style": attr(first(props, "pStyle"), "val"), "align": attr(first(props, "jc"), "val"), "list": label, "text": "".join(r["text"] for r in runs if r["revision"] != "del"), "runs": runs}

    def blocks(node: ET.Element, section: str, path: str) -> Iterator[dict]:
        n = 0
        for x in node:
            tag = local(x.tag)
            if tag == "p":
                yield paragraph(x, section, f"{path}{n}")
                n += 1
            elif tag == "tbl":
                for i, tr in enumerate(y for y in x if local(y.tag) == "tr"):
                    for j, tc in enumerate(y for y in tr if local(y.tag) == "tc"):
                        yield from blocks(tc, section, f"{path}{n}/{i},{j}/")
                n += 1
            elif tag in ("sdt", "sdtContent"):
                yield from blocks(x, section, f"{path}{n}s/")
                n += 1

    body = pkg.xml("word/document.xml")
    if body is not None:
        yield from blocks(next(every(body, "body")), "body", "")
    for kind, target in rels.values():
        if kind in ("header", "footer") and (tree := pkg.xml(target)) is not None:
            yield from blocks(tree, kind, "")
        elif kind == "footnotes" and (tree := pkg.xml(target)) is not None:
            notes = [f for f in every(tree, "footnote") if int(attr(f, "id", "0")) > 1]
            yield from ({"section": "footnote", "path": str(i), "kind": "note", "style": None, "align": None, "list": None, "text": f"{i}. " + "".join(t.text or "" for t in every(f, "t")), "runs": []} for i, f in enumerate(notes, 1))
        elif kind == "comments" and (tree := pkg.xml(target)) is not None:
            yield from ({"section": "comment", "path": str(i), "kind": "note", "style": None, "align": None, "list": None, "text": f"{attr(c, 'author', '')}:" + "".join(t.text or "" for t in every(c, "t")), "runs": []} for i, c in enumerate(every(tree, "comment"), 1))


# Presentations


def slide_parts(pkg: Package) -> list[str]:
    rels, tree = pkg.rels("ppt/presentation.xml"), pkg.xml("ppt/presentation.xml")
    listed = [] if tree is None else [rels[rid(s)][1] for s in every(tree, "sldId") if rid(s) in rels]
    return listed or sorted((n for n in pkg.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def box(node: ET.Element | None) -> tuple[float, float, float, float] | None:
    off, ext = first(node, "off"), first(node, "ext")
    return None if off is None or ext is None else (float(off.get("x", 0)), float(off.get("y", 0)), float(ext.get("cx", 0)), float(ext.get("cy", 0)))


def placeholder(sp: ET.Element) -> tuple[str, str] | None:
    ph = next(every(sp, "ph"), None)
    return None if ph is None else (ph.get("type", "body"), ph.get("idx", "0"))


def slide_shapes(data: bytes) -> Iterator[dict]:
    """``slide, shape, kind, x, y, w, h, rotation, fill, placeholder, text, cells, chart, image, step``."""
    pkg = Package(data)
    theme = pkg.xml(next((n for n in sorted(pkg.names) if n.startswith("ppt/theme/theme")), ""))
    scheme = {} if theme is None else {local(c.tag): attr(x, "val") if local(x.tag) == "srgbClr" else attr(x, "lastClr") for s in every(theme, "clrScheme") for c in s for x in c}
    alias = {"tx1": "dk1", "bg1": "lt1", "tx2": "dk2", "bg2": "lt2"}

    def color(node: ET.Element | None) -> str | None:
        for x in [] if node is None else node.iter():
            if local(x.tag) == "srgbClr":
                return x.get("val")
            if local(x.tag) == "schemeClr":
                return scheme.get(alias.get(x.get("val"), x.get("val")))
        return None

    for number, part in enumerate(slide_parts(pkg), 1):
        tree = pkg.xml(part)
        if tree is None:
            continue
        rels = pkg.rels(part)
        inherited: dict[tuple[str, str], tuple] = {}
        at, parents = part, []
        for kind in ("slideLayout", "slideMaster"):
            at = next((t for k, t in pkg.rels(at).values() if k == kind), None)
            if at is None:
                break
            parents.append(pkg.xml(at))
        for parent in parents:
            for sp in [] if parent is None else every(parent, "sp"):
                key, where = placeholder(sp), box(first(sp, "spPr", "xfrm"))
                if key and where:
                    inherited.setdefault(key, where)
                    inherited.setdefault((key[0], "*"), where)
        steps: dict[str, int] = {}
        click = 0
        for node in every(tree, "cTn"):
            if node.get("nodeType") == "clickEffect":
                click += 1
            if node.get("nodeType") in ("clickEffect", "withEffect", "afterEffect"):
                for target in every(node, "spTgt"):
                    steps.setdefault(target.get("spid"), click)

        def shapes(node: ET.Element, moves: list[Callable], number=number, rels=rels, inherited=inherited, steps=steps) -> Iterator[dict]:
            for x in node:
                tag = local(x.tag)
                if tag == "grpSp":
                    frame = first(x, "grpSpPr", "xfrm")
                    outer, co, ce = box(frame), first(frame, "chOff"), first(frame, "chExt")
                    if outer and co is not None and ce is not None:
                        cx, cy, cw, ch = float(co.get("x", 0)), float(co.get("y", 0)), float(ce.get("cx", 0)) or 1, float(ce.get("cy", 0)) or 1
                        move = lambda b, o=outer, c=(cx, cy, cw, ch): (o[0] + (b[0] - c[0]) * o[2] / c[2], o[1] + (b[1] - c[1]) * o[3] / c[3], b[2] * o[2] / c[2], b[3] * o[3] / c[3])
                        yield from shapes(x, [move, *moves])
                    else:
                        yield from shapes(x, moves)
                    continue
                if tag not in ("sp", "pic", "graphicFrame", "cxnSp"):
                    continue
                props = first(x, "spPr")
                frame = first(props, "xfrm") if first(props, "xfrm") is not None else first(x, "xfrm")
                key = placeholder(x)
                where = box(frame) or (key and (inherited.get(key) or inherited.get((key[0], "*"))))
                for move in moves if where else ():
                    where = move(where)
                body = first(x, "txBody")
                text = "" if body is None else "\n".join("".join(t.text or "" for t in every(p, "t")) for p in every(body, "p"))
                cells = [["".join(t.text or "" for t in every(tc, "t")).strip() for tc in every(tr, "tc")] for tr in every(x, "tr")]
                made = next((m for c in every(x, "chart") if (f := pkg.xml(rels.get(rid(c), ("", ""))[1])) is not None and (m := chart(f))), None)
                image = next((t for b in every(x, "blip") if (r := rels.get(attr(b, "embed"))) and r[0] == "image" and (t := r[1])), None)
                if not where and not text.strip() and not cells and not made and not image:
                    continue
                stops = list(every(first(props, "gradFill"), "gs")) if first(props, "gradFill") is not None else []
                fill = color(first(props, "solidFill")) or (f"{color(stops[0])}-{color(stops[-1])}" if stops else None)
                name = next((n.get("id") for n in every(x, "cNvPr")), "")
                where = where or (0.0, 0.0, 0.0, 0.0)
                yield {
                    "slide": number, "shape": name, "kind": "table" if cells else "chart" if made else "image" if image else "text" if text.strip() else "shape", "x": where[0], "y": where[1], "w": where[2], "h": where[3],
                    "rotation": float(attr(frame, "rot", "0")) / 60000, "fill": fill, "placeholder": ":".join(key) if key else None, "text": text, "cells": cells, "chart": f"{made['kind']}|{made['title'] or ''}" if made else None, "image": image, "step": steps.get(name),
                }

        yield from shapes(next(every(tree, "spTree")), [])


FACETS: dict[str, tuple[Callable[[bytes], Iterator[dict]], str]] = {
    "cells": (workbook_cells, "sheet string, row int, col int, kind string, raw string, display string, formula string, style int"),
    "layout": (workbook_layout, "sheet string, facet string, ref string, value string"),
    "blocks": (document_blocks, "section string, path string, kind string, style string, align string, list string, text string, runs array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,color:string,link:string,revision:string,image:string>>"),
    "shapes": (slide_shapes, "slide int, shape string, kind string, x double, y double, w double, h double, rotation double, fill string, placeholder string, text string, cells array<array<string>>, chart string, image string, step int"),
}


def read_packages(spark: SparkSession, path: str, facet: str) -> DataFrame:
    """One facet of all packages at a path: ``file``, the facet's columns, ``error``."""
    return parse_packages(files(spark, path), facet)


def parse_packages(packages: DataFrame, facet: str) -> DataFrame:
    """The same of packages in a table (``path, content``), one package after the other in each task."""
    parse, schema = FACETS[facet]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"file": name, **r, "error": None} for r in parse(data)]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, StopIteration) as e:
                    rows = [{"file": name, "error": f"{type(e).__name__}: {e}"}]
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=arrow)

    full = f"file string, {schema}, error string"
    arrow = to_arrow_schema(T._parse_datatype_string(full))
    return packages.select("path", "content").mapInArrow(run, full)

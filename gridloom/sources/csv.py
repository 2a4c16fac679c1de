"""Delimited text: encoding, delimiter, limits, rows.

Two readers: ``read_csv`` reads one file of any size in splits, ``read_csv_files`` many
whole files, one per task. Both follow the sheet rules: blank lines are no rows, rows
that hold one empty field are dropped at the end, quoted fields may hold delimiters
and line feeds, short rows are padded to the widest row of the whole file.

``read_csv`` looks at each line twice. The first pass counts, for each split, records
and fields; where the file has no quotes, it and the second pass are DataFrame
functions only. A split of a file with quotes may begin inside a quoted field, so it is
counted for both cases; the driver then goes through the splits' few numbers, which
tells how each begins and which row it starts with, and the second pass parses with
that. The pieces of records that go on in the next split are put together by row.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.grid import ROW

# Candidates in order of preference, sample sizes and limits of the format.
DELIMITERS = (",", "\t", ";", "|")
SAMPLE_LINES, HEAD_BYTES, BINARY_CHARS = 20, 256 * 1024, 8 * 1024
MAX_BYTES, MAX_ROWS, MAX_COLS = 256 * 1024 * 1024, 2_000_000, 16_384
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: The common characters' lead bytes in each double-byte encoding, as first and last.
COMMON_LEADS = {"gb18030": (0xB0, 0xD7), "big5": (0xA4, 0xC6), "euc_kr": (0xB0, 0xC8), "shift_jis": (0x82, 0x97)}
#: Lines that a guess of the encoding looks at.
GUESS_LINES = 200


class CsvError(ValueError):
    """``kind``: empty, too_large, undecodable, not_text, several_files (one grid is one file) or malformed (with the line)."""

    def __init__(self, kind: str, detail: str = "", line: int | None = None):
        super().__init__(" ".join(filter(None, (kind, detail, f"line {line}" if line is not None else ""))))
        self.kind, self.line = kind, line


@dataclass(frozen=True)
class CsvMeta:
    encoding: str
    delimiter: str
    delimiter_source: str
    lossy: bool
    rows: int
    cols: int
    truncated_rows: bool
    truncated_cols: bool


def likely(name: str, data: bytes) -> float:
    """How well non-UTF-8 bytes fit an encoding, 0 to 1; -1 if they don't decode."""
    try:
        text = codecs.getincrementaldecoder(name)().decode(data)
    except UnicodeDecodeError:
        return -1.0
    high = sum(c >= 0x80 for c in data)
    if name == "windows-1252":
        # Letters with accents stand alone among plain ones.
        alone = re.findall(rb"(?<![\x80-\xff])[\xc0-\xff](?![\x80-\xff])", data)
        return len(alone) / max(1, high)
    first, last = COMMON_LEADS[name]
    pairs = [c.encode(name, "ignore") for c in text if ord(c) > 127]
    if name == "shift_jis":
        # Kana mark Japanese; half-width kana as single bytes do not.
        kana = sum("\u3040" <= c <= "\u30ff" for c in text)
        fit = sum(len(x) == 2 and (x[0] in (0x81, 0x82, 0x83) or 0x88 <= x[0] <= last) for x in pairs)
        return (fit + kana) / max(1, 2 * len(pairs)) if kana else 0.4 * fit / max(1, len(pairs))
    fit = sum(len(x) == 2 and (first <= x[0] <= last or x[0] in (0xA1, 0xA3)) for x in pairs)
    hangul = sum("\uac00" <= c <= "\ud7a3" for c in text)
    return fit / max(1, len(pairs)) * (1.0 if name != "euc_kr" else 1.02 if hangul > 0.9 * len(pairs) else 0.5) * (1.0 if name != "gb18030" or all(len(x) <= 2 for x in pairs) else 0.9)


def guess(data: bytes) -> str:
    """The encoding that non-UTF-8 bytes fit best; earlier ones win ties."""
    names = [*COMMON_LEADS, "windows-1252"]
    scores = [likely(n, data) for n in names]
    return names[scores.index(max(scores))] if max(scores) >= 0 else "utf-8"


def decode(data: bytes) -> tuple[str, str, bool]:
    """Text, encoding, and whether characters were lost. By mark, as UTF-8, then by guess."""
    for bom, name in BOMS:
        if data.startswith(bom):
            text = data[len(bom) :].decode(name, "replace")
            return text, name, "\ufffd" in text
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    name = guess(data[:HEAD_BYTES])
    text = data.decode(name, "replace")
    return text, name, "\ufffd" in text


def looks_binary(text: str) -> bool:
    head = text[:BINARY_CHARS]
    if "\0" in head:
        return True
    odd = sum(c == "�" or (ord(c) < 32 or 127 <= ord(c) < 160) and c not in "\t\r\n" for c in head)
    return odd >= 4 and odd > len(head) * 0.01


def outside_quotes(line: str, mark: str) -> int:
    return sum(part.count(mark) for part in line.split('"')[::2])


def sniff(text: str) -> str | None:
    """The candidate with the highest mean count outside quotes; the same count on every line counts ten times."""
    lines = [x for x in text[:HEAD_BYTES].splitlines() if x.strip()][:SAMPLE_LINES]
    best, most = None, 0.0
    for mark in DELIMITERS:
        counts = [outside_quotes(x, mark) for x in lines]
        score = int(sum(counts) / max(1, len(counts)) * (10 if len(set(counts)) == 1 else 1) * 100)
        if sum(counts) and score > most:
            best, most = mark, score
    return best


def parse(data: bytes, delimiter: str | None = None, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS, max_cols: int = MAX_COLS) -> tuple[list[list[str]], CsvMeta]:
    """Rows of equal length, and what was found out about the file."""
    if not data.strip():
        raise CsvError("empty")
    if len(data) > max_bytes:
        raise CsvError("too_large", str(len(data)))
    text, encoding, lossy = decode(data)
    if not text.replace("\ufffd", "").strip():
        raise CsvError("undecodable", encoding)
    if looks_binary(text):
        raise CsvError("not_text")
    found = delimiter or sniff(text)
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    rows: list[list[str]] = []
    cut_rows = cut_cols = False
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=found or ",")
    while True:
        try:
            fields = next(reader, None)
        except csv.Error as e:
            raise CsvError("malformed", str(e), reader.line_num) from e
        if fields is None:
            break
        if not fields:
            continue
        if len(rows) >= max_rows:
            cut_rows = True
            break
        cut_cols = cut_cols or len(fields) > max_cols
        rows.append(fields[:max_cols])
    while rows and rows[-1] == [""]:
        rows.pop()
    if not rows:
        raise CsvError("empty")
    width = max(map(len, rows))
    source = "explicit" if delimiter else "sniffed" if found else "fallback"
    return [r + [""] * (width - len(r)) for r in rows], CsvMeta(encoding, found or ",", source, lossy, len(rows), width, cut_rows, cut_cols)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_csv_files(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """``path, _row, fields, encoding, delimiter, truncated_rows, truncated_cols, error`` of whole files, one per task.

    A bad file is one row with its error. Files beyond the limits are cut as the limits
    say, and each of their rows tells so.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                try:
                    rows, meta = parse(bytes(data), delimiter)
                except CsvError as e:
                    yield pd.DataFrame({"path": [name], ROW: [None], "fields": [None], "encoding": [None], "delimiter": [None], "truncated_rows": [None], "truncated_cols": [None], "error": [e.kind]})
                    continue
                for k in range(0, len(rows), 10_000):
                    block = rows[k : k + 10_000]
                    yield pd.DataFrame({"path": name, ROW: range(k, k + len(block)), "fields": block, "encoding": meta.encoding, "delimiter": meta.delimiter, "truncated_rows": meta.truncated_rows, "truncated_cols": meta.truncated_cols, "error": None})

    return files(spark, path).mapInPandas(run, f"path string, {ROW} long, fields array<string>, encoding string, delimiter string, truncated_rows boolean, truncated_cols boolean, error string")


def ends_of(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """The first bytes and the last one of a file, or of a folder's only file, whatever store it is in."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    if status.isDirectory():
        files = [f for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", "."))]
        files = [f for f in files if f.getLen()] or files[:1]
        if len(files) != 1:
            raise CsvError("empty" if not files else "several_files")
        status = files[0]
    stream = fs.open(status.getPath())
    try:
        bounded = jvm.org.apache.commons.io.input.BoundedInputStream
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded(stream, HEAD_BYTES)))
        stream.seek(max(0, status.getLen() - 1))
        return head, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(bounded(stream, 1)))
    finally:
        stream.close()


def pieces_of(line: str) -> list[str]:
    """A line, cut after carriage returns that end lines by themselves; the ends stay."""
    return list(io.StringIO(line, newline="")) if "\r" in line[:-2] else [line]


def records(lines: list[str], delimiter: str, inside: bool) -> tuple[list[list[str]], list[int], bool]:
    """Records of lines with their ends, the lines read up to each record's end, and whether the last is still open."""
    csv.field_size_limit(1 << 40)
    mark = "\ue000"
    feed = [f'"{lines[0] if lines else ""}', *lines[1:]] if inside else lines
    reader = csv.reader([*feed, mark], delimiter=delimiter)
    rows, ends = [], []
    for row in reader:
        rows.append(row)
        ends.append(min(reader.line_num, len(lines)))
    if rows[-1] == [mark]:
        return rows[:-1], ends[:-1], False
    rows[-1][-1] = rows[-1][-1].removesuffix(mark)
    return rows, ends, True


def without_blank(rows: list[list[str]]) -> list[list[str]]:
    return [r for r in rows if r]


@dataclass(frozen=True)
class Split:
    """What a split holds if it begins inside a quoted field, or not."""

    rows: int
    width: int
    head: int
    tail: int
    closes: bool
    opens: bool
    blank: int


def measured(lines: list[str], delimiter: str, inside: bool) -> Split:
    rows, _, open_ = records(lines, delimiter, inside)
    head = len(rows[0]) - 1 if inside else 0
    if inside and open_ and len(rows) == 1:
        return Split(0, 0, head, 0, False, True, 0)
    tail = len(rows[-1]) - 1 if open_ else 0
    whole = without_blank(rows[int(inside) : len(rows) - int(open_)])
    blank = next((k for k, r in enumerate(reversed(whole)) if r != [""]), len(whole))
    return Split(len(whole), max(map(len, whole), default=0), head, tail, inside, open_, blank)


def starts(found: dict[int, dict[bool, Split]]) -> tuple[dict[int, tuple[bool, int]], int, int]:
    """How each split begins and its first row; the widest record; the rows up to the last that isn't blank."""
    at, row, width, inside, fields, last = {}, 0, 0, False, 0, 0
    for part in sorted(found):
        s = found[part][inside]
        at[part] = (inside, row)
        if inside:
            fields += s.head
            if not s.closes:
                continue
            width, row, inside = max(width, fields + 1), row + 1, False
            last = row
        last = row + s.rows - s.blank if s.rows > s.blank else last
        width, row = max(width, s.width), row + s.rows
        if s.opens:
            inside, fields = True, s.tail
    if inside:
        width, row = max(width, fields + 1), row + 1
        last = row
    return at, width, last


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select("value", F.spark_partition_id().alias("__part"))


def quoted_grid(lines: DataFrame, encoding: str, delimiter: str, fed: bool) -> tuple[DataFrame, int]:
    """``_row, fields`` and the greatest number of fields; ``fed`` tells whether the file ends in a line feed."""
    raw = lines.select("__part", F.col("value").cast("binary").alias("value"))

    def own(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, list[str]]:
        part, out = None, []
        for batch in batches:
            for p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += pieces_of(v.decode(encoding, "replace") + "\n")
                part = p
        if part == 0 and out:
            out[0] = out[0].removeprefix("\ufeff")
        return part, out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text = own(batches)
        if part is not None:
            both = [measured(text, delimiter, inside) for inside in (False, True)]
            yield pa.RecordBatch.from_pylist([{"part": part, "inside": bool(k), **vars(s)} for k, s in enumerate(both)])

    found: dict[int, dict[bool, Split]] = {}
    for r in raw.mapInArrow(count, "part long, inside boolean, rows long, width long, head long, tail long, closes boolean, opens boolean, blank long").collect():  # two rows for each split
        d = r.asDict()
        part, inside = d.pop("part"), d.pop("inside")
        found.setdefault(part, {})[inside] = Split(**d)
    at, width, last = starts(found)
    end = max(found, default=None)

    def parse_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text = own(batches)
        if part is None:
            return
        if part == end and not fed:
            text[-1] = text[-1].removesuffix("\n")
        inside, first = at[part]
        rows, ends, open_ = records(text, delimiter, inside)
        pieces = []
        if inside:
            cut = len(text) if open_ and len(rows) == 1 else ends[0]
            pieces.append((first, "".join(text[:cut])))
            first += 1
        whole = without_blank(rows[int(inside) : len(rows) - int(open_)])
        if open_ and not (inside and len(rows) == 1):
            pieces.append((first + len(whole), "".join(text[ends[-2] if len(ends) > 1 else 0 :])))
        numbers = [*range(first, first + len(whole)), *(n for n, _ in pieces)]
        fields = pa.array([*whole, *[None] * len(pieces)], pa.list_(pa.string()))
        texts = pa.array([None] * len(whole) + [t for _, t in pieces], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([part] * len(numbers), pa.int32()), fields, texts], names=[ROW, "part", "fields", "piece"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [records(list(io.StringIO(t, newline="")), delimiter, False)[0][0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=[ROW, "fields"])

    made = raw.mapInArrow(parse_split, f"{ROW} long, part int, fields array<string>, piece string")
    whole = made.where("piece IS NULL").select(ROW, "fields")
    if any(s[x].opens for s in found.values() for x in (False, True)):
        parts = made.where("piece IS NOT NULL").groupBy(ROW).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"])).alias("text"))
        whole = whole.unionByName(parts.mapInArrow(join, f"{ROW} long, fields array<string>"))
    return whole.where(F.col(ROW) < last), width


def plain_grid(lines: DataFrame, delimiter: str, sizes: dict[int, int]) -> DataFrame:
    """``_row, fields`` of a file without quotes, in DataFrame functions only; a split's rows follow those before it."""
    parts = sorted(sizes)
    befores = [0, *accumulate(sizes[p] for p in parts)]
    starts = pd.DataFrame({"__part": parts, "__before": befores[: len(parts)]})
    known = lines.sparkSession.createDataFrame(starts, "__part int, __before long")
    kept = lines.select(plain_line().alias("line"), "__part").where("line <> ''").withColumn("__id", F.monotonically_increasing_id())
    kept = kept.join(F.broadcast(known), "__part")  # one row for each split
    return kept.select((F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(ROW), F.split("line", re.escape(delimiter), -1).alias("fields"))


def plain_line() -> Column:
    """A line without the carriage return at its end and the mark before the first one."""
    own = F.when(F.col("value").endswith("\r"), F.expr("left(value, char_length(value) - 1)")).otherwise(F.col("value"))
    return F.when(F.col("__part") == 0, F.regexp_replace(own, "^\ufeff", "")).otherwise(own)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = False, physical: bool = False) -> tuple[DataFrame, list[str]]:
    """A grid (``_row, c0 ... cN``) and the first row's fields if it is a header; with ``physical`` also ``_fields``, the fields that a row really has."""
    head, end = ends_of(spark, path)
    if not head.strip():
        raise CsvError("empty")
    whole = len(head) < HEAD_BYTES
    sample = head if whole else head[: head.rfind(b"\n") + 1] or head
    marked = next((name for bom, name in BOMS if head.startswith(bom)), None)
    if marked in ("utf-16-le", "utf-16-be"):  # its line feeds are two bytes; such files are read whole
        first, meta = parse(sample[: len(sample) // 2 * 2], delimiter)
        rows = read_csv_files(spark, path, delimiter).where("error IS NULL").select(ROW, "fields")
        width = rows.agg(F.max(F.size("fields"))).first()[0] or 0
        return shaped(rows, width, physical), first[0] if header else []
    lines = text_lines(spark, path)
    mark = delimiter
    if mark is None:
        mark = sniff(decode(sample)[0]) or ","
    line = plain_line()
    odd = F.col("value").contains('"') | line.contains("\r")
    seen = lines.groupBy("__part").agg(
        F.count_if(line != "").alias("rows"), F.max(F.char_length(line) - F.char_length(F.replace(line, F.lit(mark), F.lit("")))).alias("marks"), F.max(odd).alias("odd"), F.max(~F.is_valid_utf8("value")).alias("foreign")
    ).collect()  # one row for each split
    encoding = "utf-8"
    if marked is None and any(r["foreign"] for r in seen):
        bad = lines.where(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("v")).limit(GUESS_LINES).collect()
        encoding = guess(b"\n".join(bytes(r["v"]) for r in bad))
    text = sample.decode(encoding, "replace").removeprefix("\ufeff")
    if not text.replace("\ufffd", "").strip():
        raise CsvError("undecodable", encoding)
    if looks_binary(text):
        raise CsvError("not_text")
    if delimiter is None and encoding != "utf-8":
        mark = sniff(text) or ","
    if encoding == "utf-8" and not any(r["odd"] for r in seen):
        rows, width = plain_grid(lines, mark, {r["__part"]: r["rows"] for r in seen}), max(r["marks"] for r in seen) + 1
    else:
        rows, width = quoted_grid(lines, encoding, mark, end == b"\n")
    names: list[str] = []
    if header:
        names = next(iter(without_blank(records(list(io.StringIO(text, newline="")), mark, False)[0])), [])
        names += [""] * (width - len(names))
    return shaped(rows, width, physical), names


def shaped(rows: DataFrame, width: int, physical: bool) -> DataFrame:
    """Fields as columns; missing ones are empty."""
    columns = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    return rows.select(ROW, *([F.size("fields").alias("_fields")] if physical else []), *columns)


def write_tsv(lines: DataFrame, path: str) -> None:
    """The copy sink: tab-separated lines as they are."""
    lines.select("line").write.text(path)

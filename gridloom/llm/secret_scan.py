"""Secret scan: rule spans plus sliding-window entropy over candidate strings.

Rules give the base spans: assignments to names such as ``password``, access key
ids, and long hexadecimal strings. Beyond them, every candidate string (a long run
of key characters) is cut into runs of one character class; a window slides over
each run and its Shannon entropy follows from counts that change by one character
in and one out. A run shorter than the window is one window, with the threshold scaled
to its length. Windows at or over the class's threshold merge into ``entropy``
spans. The allow list then takes back spans that are known not to be secrets. All of
it takes time in proportion to the text, whatever its longest run is.

Defined results: a null or empty text has no spans; spans are code points, end
exclusive; base spans are never taken back, and an entropy span that touches one is
left out, as its characters are reported already; repeated rows and null ids keep
their rows; of the input only the id and the text are looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import documents, map_rows, text_or_empty

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")
SHORTEST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars``; entropy in bits over ``window`` characters; fewest digits and letters in a window.

    ``cased`` capitals and as many small letters, if not 0, do instead of the digits.
    """

    name: str
    chars: str
    window: int
    bits: float
    digits: int
    letters: int
    cased: int = 0


CLASSES = (
    CharClass("hex", "[0-9a-fA-F]", 24, 3.0, 6, 4),
    CharClass("upper", "[A-Z0-9]", 20, 3.4, 3, 4),
    CharClass("mixed", "[A-Za-z0-9+/_=-]", 24, 3.9, 3, 6, 6),
)


@dataclass(frozen=True)
class Known:
    """What ``pattern`` matches (its group ``known``, if there is one), grown to both sides over ``run`` characters."""

    pattern: str
    run: str = ""

    def finder(self):
        pattern = re.compile(self.pattern)
        group = "known" if "known" in pattern.groupindex else 0
        grow = re.compile(f"{self.run}*") if self.run else None

        def spans(text: str) -> Iterator[tuple[int, int]]:
            done = 0
            for m in pattern.finditer(text):
                start, end = m.span(group)
                if grow is not None:
                    if end <= done:  # inside the run of the match before
                        continue
                    while start > done and grow.match(text[start - 1]).end():
                        start -= 1
                    end = done = grow.match(text, end).end()
                yield start, end

        return spans


#: What may not follow a digest, if it is one.
_END = r"(?![A-Za-z0-9+/=])"
#: Hexadecimal digests by their lengths; base64 ones by the hash's name.
_HEX = "|".join(f"[0-9a-f]{{{n}}}" for n in (128, 96, 64, 56, 40, 32))
_BASE64 = "|".join(f"(?i:{name})[-:= ]{{1,3}}[A-Za-z0-9+/]{{{n}}}{end}" for name, n, end in (("md5", 22, "=="), ("sha1", 27, "="), ("sha224", 38, "=="), ("sha256", 43, "="), ("sha384", 64, ""), ("sha512", 86, "==")))
#: Spans inside one of these are not secrets: ids, digests of known kind and length, placeholders (words as far as they
#: are written in one case, with a short number behind), runs of the alphabet, host and path of a URL (not its user info
#: or query). What stands beside a placeholder or behind a digest's name counts as anywhere else.
ALLOWED = (
    Known(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    Known(rf"(?i)\b(?:sha(?:1|224|256|384|512)|md5|integrity|checksum|commit|etag)[-:= ]{{1,3}}[\"']?(?:{_HEX}){_END}"),
    Known(rf"(?i)\bcommit[-:= ]{{1,3}}[0-9a-f]{{7,40}}{_END}"),
    Known(rf"\b(?:{_BASE64}){_END}"),
    Known(rf"(?:[Ee]xample|[Pp]laceholder|[Cc]hangeme|[Dd]ummy|[Rr]edacted)[a-z_.-]*(?:[0-9]{{1,6}}{_END})?", "[a-z_.-]"),
    Known(rf"(?:EXAMPLE|PLACEHOLDER|CHANGEME|DUMMY|REDACTED)[A-Z_.-]*(?:[0-9]{{1,6}}{_END})?", "[A-Z_.-]"),
    Known(r"EXAMPLE(?:KEY)?(?![A-Za-z0-9+/=_-])", "[A-Za-z0-9+/]"),
    Known(r"x{4,}|X{4,}"),
    Known(r"(?i)abcdefghijk|0123456789", "[A-Za-z0-9+/]"),
    Known(r"https?://(?![^\s/?#]*@)[^\s/?#]+(?:/[^\s?#]*)?"),
    Known(r"https?://[^\s/?#]*@(?P<known>[^\s/?#@]+(?:/[^\s?#]*)?)"),
)
#: Fractional bits of the whole numbers that stand for entropies, so that sums are exact in any order.
FRACTION = 40


def scaled(x: float) -> int:
    return round(x * (1 << FRACTION))


def window_sums(codes: np.ndarray, size: int) -> np.ndarray:
    """``sum(c * log2(c))`` over the counts ``c`` of each window of ``size`` characters, by incremental counts.

    A character that enters a window raises its own count there from ``n`` to ``n + 1``,
    one that leaves lowers it; the two changes of each step are summed up.
    """
    weight = np.array([0, *(scaled(c * log2(c)) for c in range(1, size + 1))], np.int64)
    before, after = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    for d in range(1, size):
        same = codes[d:] == codes[:-d]
        before[d:] += same
        after[:-d] += same
    entered = np.cumsum(weight[before + 1] - weight[before])
    left = np.cumsum(weight[after + 1] - weight[after])
    sums = entered[size - 1 :].copy()
    sums[1:] -= left[: len(sums) - 1]
    return sums


def union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, sorted, with those merged that overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def clear_of(spans: list[tuple[int, int]], taken: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that share no character with one of ``taken``."""
    blocks = union(taken)
    starts = [a for a, _ in blocks]
    return [(a, b) for a, b in spans if not (k := bisect_left(starts, b)) or blocks[k - 1][1] <= a]


def outside(spans: list[tuple[int, int]], known: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie inside none of ``known``."""
    blocks = sorted(known)
    starts, reach = [a for a, _ in blocks], list(accumulate((b for _, b in blocks), max))
    return [(a, b) for a, b in spans if not (k := bisect_right(starts, a)) or reach[k - 1] < b]


class SecretScanner:
    def __init__(self, classes: Iterable[CharClass] = CLASSES, allowed: Iterable[Known] = ALLOWED):
        self.classes = [(c, re.compile(f"{c.chars}{{{min(c.window, SHORTEST)},}}")) for c in classes]
        self.allowed = [a.finder() for a in allowed]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return found

    def dense(self, text: str) -> list[tuple[int, int]]:
        """Merged stretches of candidates whose windows have enough entropy.

        A class's runs of like windows are scored in one go, side by side; windows
        that would go from one run into the next don't count.
        """
        found: list[tuple[int, int]] = []
        candidates = [m.span() for m in CANDIDATE.finditer(text)]
        for kind, runs in self.classes:
            alike: dict[int, list[tuple[int, int]]] = {}
            for a, b in candidates:
                for m in runs.finditer(text, a, b):
                    alike.setdefault(min(kind.window, m.end() - m.start()), []).append(m.span())
            for w, spans in alike.items():
                codes = np.frombuffer("".join([text[a:b] for a, b in spans]).encode("ascii"), np.uint8)
                starts, sizes = np.array(spans).T[0], np.diff(np.array(spans))[:, 0]
                before = np.cumsum(sizes) - sizes
                own = np.repeat(np.arange(len(spans)), sizes)
                most = scaled(w * (log2(w) - kind.bits * log2(w) / log2(kind.window)))
                digits, letters, cased = (x * w // kind.window for x in (kind.digits, kind.letters, kind.cased))
                big = (codes >= 65) & (codes <= 90)
                small = (codes >= 97) & (codes <= 122)
                digit, upper, both = (np.concatenate([[0], np.cumsum(x)]) for x in ((codes >= 48) & (codes <= 57), big, big | small))
                digit, upper, both = (x[w:] - x[:-w] for x in (digit, upper, both))
                right = (own[: len(digit)] == own[w - 1 :]) & (both >= letters)
                right &= (digit >= digits) | ((upper >= cased) & (upper <= both - cased) if cased else False)
                if not right.any():
                    continue
                at = np.flatnonzero(right & (window_sums(codes, w) <= most))
                if len(at):
                    at = at + (starts - before)[own[at]]
                    ends = np.flatnonzero(np.diff(at) > w)
                    found += zip(at[np.concatenate([[0], ends + 1])].tolist(), (at[np.concatenate([ends, [len(at) - 1]])] + w).tolist(), strict=True)
        return union(found)

    def scan(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans and all spans, each by start, then kind as listed."""
        base = self.base(text)
        extra = self.dense(text)
        if extra:
            extra = clear_of(extra, [s[:2] for s in base])
        if extra:
            extra = outside(extra, [span for find in self.allowed for span in find(text)])
        every = base + [(a, b, "entropy") for a, b in extra]
        rank = KINDS.index
        return sorted(base, key=lambda s: (s[0], rank(s[2]))), sorted(every, key=lambda s: (s[0], rank(s[2])))


def written(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: Iterable[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """``id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans`` and, if asked for, ``redacted_text``.

    One narrow pass without a shuffle; a task holds one Arrow batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both = [scanner.scan(t) for t in texts]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[2] == kind for s in every) for _, every in both], pa.int64()) for kind in KINDS]
            columns += [pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]), pa.array([written(every) for _, every in both], pa.string())]
            if redacted:
                columns.append(pa.array([redact(t, every) for t, (_, every) in zip(texts, both, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *["redacted_text"] * redacted]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", redacted_text string" * redacted
    return map_rows(df, [id_col, text_or_empty(text_col).alias("__text")], scan, schema)


def redact_documents(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text and the length set anew.

    A null text stays null.
    """
    names, fields = df.columns, df.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner()
        at = names.index(text_col)
        for batch in batches:
            texts = [t if t is None else redact(t, scanner.scan(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    out = df.mapInArrow(scan, fields)
    return out.withColumn(length_col, F.char_length(text_col).cast(fields[length_col].dataType)) if length_col in names else out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))

"""Exact token counts at every prefix, by dynamic programming over prefixes.

A BPE encoding is the one chain of pieces in which every two neighbours are
*compatible*: encoding the two pieces' joined text gives just these two pieces.
So the last piece of each prefix determines the whole encoding of that prefix:
``last[i]`` is the piece ``t`` that ends at ``i`` and is compatible with the last
piece of the prefix before ``t``; the count there is one more. One pass thus gives
the token count of every prefix, and truncation or budget questions need no
second encoding.

A piece holds space marks at its start only, and no piece has both letters and other
characters (letters for which the vocabulary has an exception count as others). A
text therefore falls into units, of space marks and either letters or others, that
never merge with each other; a worker computes the table of a unit once.

Defined results: a null or empty text has 0 bytes and 0 tokens; a character that
the vocabulary lacks counts as its UTF-8 bytes; repeated rows and null ids keep
their rows; columns other than the id and the text are not looked at, so names
that clash with the result's do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import documents, map_rows, text_or_empty

MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
#: Units (most of them words) whose tables a worker keeps, twice over.
CACHE = 500_000
#: Longer units' tables are not kept; they are computed again where they are needed.
LONG = 64
#: Begins deltas of four bytes; as a signed byte it would be a change of -128, which the narrow form never has.
WIDE = b"\x80"
NEVER = float("-inf")
LIMIT = 4096


class PrefixCounter:
    """Token counts of prefixes under a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.longest = max(map(len, self.scores))
        bodies = [p.lstrip(MARK) for p in self.scores]
        assert not any(MARK in b for b in bodies), "space marks inside pieces"
        odd = "".join(sorted({c for b in bodies if len({bool(LETTER.match(c)) for c in b}) > 1 for c in b if LETTER.match(c)}))
        letter = f"[^\\W\\d_{re.escape(odd)}]"
        other = f"(?:[^{MARK}\\w]|[\\d_{re.escape(odd)}])"
        self.cut = re.compile(f"{MARK}*{letter}+|{MARK}*{other}+|{MARK}+").findall
        self.compatible: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple] = {}
        self.kept = _Units(self)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def spines(self, piece: str) -> tuple[list, list]:
        """The symbols at the piece's left and right edge while it is being merged.

        Each is a list, from the single character up to the piece, of a symbol and
        the score of the merge that ends it (none for the piece itself).
        """
        found = self.edges.get(piece)
        if found is None:
            parts, left, right = list(piece), [], []
            while len(parts) > 1:
                score, at = max((self.scores.get(a + b, NEVER), -i) for i, (a, b) in enumerate(pairwise(parts)))
                if score == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], score))
                if -at == len(parts) - 2:
                    right.append((parts[-1], score))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            alone = len(parts) == 1 and all(a[1] > b[1] for side in (left, right) for a, b in pairwise(side))
            found = self.edges[piece] = ([*left, (piece, NEVER)], [*right, (piece, NEVER)]) if alone else None
            self.edges[piece] = found or ()
        return found or ()

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``; an empty ``left`` is the text's start.

        Merging first builds both pieces' edges towards each other. They stay apart
        if no two symbols that meet there would have merged before one of them grew.
        """
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        if not left or not (a := self.spines(left)) or not (b := self.spines(right)):
            fit = self.merge(left + right) == ([left, right] if left else [right])
        else:
            a, b, i, j, fit = a[1], b[0], 0, 0, True
            while fit:
                (x, grows_x), (y, grows_y) = a[i], b[j]
                joined = self.scores.get(x + y, NEVER)
                if joined > NEVER and joined > grows_x and joined >= grows_y:
                    fit = False
                elif grows_x == NEVER and grows_y == NEVER:
                    break
                elif grows_x >= grows_y:
                    i += 1
                else:
                    j += 1
        self.compatible[left, right] = fit
        return fit

    def table(self, unit: str) -> list[int]:
        """Counts at the prefixes of 0, 1, ... characters of a unit."""
        scores, longest, compatible, fits = self.scores, self.longest, self.compatible, self.fits
        counts, starts, last = [0], [0], 0
        for end in range(1, len(unit) + 1):
            # Only one start can be right: most often the last piece grows, or a new one begins.
            for start in (last, end - 1, *range(end - 2, max(end - longest, 0) - 1, -1)):
                piece = unit[start:end]
                if piece in scores:
                    left = unit[starts[start] : start]
                    fit = compatible.get((left, piece))
                    if fit or fit is None and fits(left, piece):
                        counts.append(counts[start] + 1)
                        break
                elif start == end - 1:  # bytes stand for a character that the vocabulary lacks
                    counts.append(counts[start] + len(piece.encode("utf-8", "surrogatepass")))
                    break
            starts.append(start)
            last = start
        return counts

    def units(self, text: str) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def deltas(self, text: str) -> bytes:
        """The change of the count with each character of a text, a signed byte each.

        Where a change is too large for that, all are four bytes after a mark; see :func:`changes`.
        """
        if not text:
            return b""
        parts = list(map(self.kept.__getitem__, self.units(text)))
        joined = b"".join(parts)
        if WIDE in joined:  # no byte of the narrow form
            wide = np.concatenate([changes(p) for p in parts])
            return WIDE + np.concatenate([[wide[0] + wide[1]], wide[2:]]).astype("<i4").tobytes()
        # The first is that of the mark before the text, which comes with its first character.
        return ((joined[0] + joined[1]) & 255).to_bytes(1, "little") + joined[2:]

    def count(self, text: str) -> int:
        return total(self.deltas(text))

    def prefixes(self, text: str) -> list[int]:
        """The count at each prefix of 0 to ``len(text)`` characters."""
        return [0, *np.cumsum(changes(self.deltas(text)), dtype=np.int64).tolist()]


def changes(deltas: bytes) -> np.ndarray:
    """Stored deltas as numbers."""
    return np.frombuffer(deltas, "<i4", offset=1) if deltas[:1] == WIDE else np.frombuffer(deltas, np.int8)


def total(deltas: bytes) -> int:
    return int(changes(deltas).sum(dtype=np.int64))


def fitting_prefix(deltas: bytes, budget: int) -> int:
    """The most characters that a prefix of at most ``budget`` tokens can have, from stored deltas.

    Counts can fall by a merge, so the last prefix within budget is meant.
    """
    fits = np.flatnonzero(np.cumsum(changes(deltas), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


class _Units(dict):
    """Units' deltas; a new unit's table is computed, and kept, when it is first asked for.

    Of a full cache one more is kept while the next one fills, from which units that
    are asked for again move on.
    """

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.old = counter, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            table = self.counter.table(unit)
            if len(unit) > LONG:
                deltas = np.diff(table)
                if np.abs(deltas).max() >= 128:
                    return WIDE + deltas.astype("<i4").tobytes()
                return deltas.astype(np.int8).tobytes()
            found = bytes([b - a & 255 for a, b in pairwise(table)])  # at most four for a character, and never below zero in all
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found


_counters: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """One counter for each model and process."""
    if model not in _counters:
        _counters[model] = PrefixCounter(public_tokenizers.path(model))
    return _counters[model]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fitting_chars, prefix_deltas`` for each row.

    ``fitting_chars``: characters of the longest prefix within ``limit`` tokens. One
    narrow pass, no shuffle; memory is a batch and the bounded table of units.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            deltas = [own.deltas(t) for t in texts]
            counts = list(map(total, deltas))
            columns = [
                batch.column(0),
                pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
                pa.array([len(t) if n <= limit else fitting_prefix(d, limit) for t, d, n in zip(texts, deltas, counts, strict=True)], pa.int64()),
                pa.array(deltas, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit", "fitting_chars", "prefix_deltas"]
    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_or_empty(text_col).alias("__text")], count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long, prefix_deltas binary")


def within_budget(counted: DataFrame, budget: int, id_col: str = "doc_id") -> DataFrame:
    """``id, budget_chars``: the longest prefixes within any budget, from the stored table alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = [fitting_prefix(d, budget) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64())], names=[id_col, "budget_chars"])

    return map_rows(counted, [id_col, "prefix_deltas"], fit, f"`{id_col}` {counted.schema[id_col].dataType.simpleString()}, budget_chars long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))

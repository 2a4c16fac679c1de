"""Compression classifier for text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled text.
A text that is like the good ones compresses better with their dictionary; the
difference of the two compressed sizes, normalised by the text's size and by the
compressed sizes, is the one thing learnt from: no size or ratio enters by itself. A
logistic curve fitted on further labelled rows turns it into a calibrated score.

Whole texts are scored: in blocks of ``BLOCK`` bytes, whose sizes are summed, so
that a long text's own repetitions don't outweigh the dictionaries. The fit uses a
bounded sample of labelled rows (``TRAIN_ROWS`` of each label, of at most
``TRAIN_CHARS`` characters each, those with the least hashes; longer texts among the
picked rows are left out, so fewer may be learnt from); half builds the dictionaries,
half the curve. Of several rows with one id the least text is learnt from. Class shares come from all labelled rows.

Defined results: a null or empty text compresses to nothing either way and scores
what the curve gives for no difference; labels other than 0 and 1 and null ones
are not learnt from; with one label missing every score is the share of good rows
(1/2 without labels); repeated rows and null ids keep their rows; source, language,
id and label are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import documents, map_rows, text_or_empty

TRAIN_ROWS, TRAIN_CHARS = 2000, 20_000
DICTIONARY, BLOCK, LEVEL = 65_536, 512, 3
THRESHOLD = 0.7
_HEADER = 6


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        """A function of a list of texts; built once per task, as contexts cannot be sent."""
        if not self.good or not self.bad:
            return lambda texts: [self.prior] * len(texts)
        packers = [packer(d) for d in (self.good, self.bad)]
        return lambda texts: probability(features(texts, packers), self.weights).tolist()


def dictionary(texts: list[str]) -> bytes:
    """Trained from the texts' blocks; a handful of texts is used as it is."""
    import zstandard

    blocks = [b for t in texts for b in cut(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:] or b" "


def packer(content: bytes):
    import zstandard

    own = zstandard.ZstdCompressionDict(content)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_dict_id=False).compress


def cut(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def features(texts: list[str], packers: list) -> np.ndarray:
    """The size difference, normalised by the text's size and by the compressed sizes, and both damped for long texts.

    A short text's difference is less sure, hence the damped pair. All are 0 where
    both dictionaries do alike.
    """
    out = np.zeros((len(texts), 4))
    for r, text in enumerate(texts):
        blocks = cut(text)
        good, bad = (sum(len(p(b)) - _HEADER for b in blocks) for p in packers)
        size = sum(map(len, blocks))
        both = (bad - good) / max(1, size), (bad - good) / max(1, bad + good)
        short = 1 / (1 + size / 200)
        out[r] = *both, both[0] * short, both[1] * short
    return out


def probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    z = weights[0] + x @ np.array(weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weighted logistic fit by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.array([0.0, *[1.0] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (share * (p - y)) + penalty * w
        step = np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), gradient)
        w = w - step * min(1.0, 20 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> CompressionModel:
    """From the texts of documents with a mark; ``marks``: columns ``__mark_id`` and ``__label``.

    The rows to learn from are picked by the hash of their id in the marks alone, at
    most ``rows`` of each label, so no other text is moved.
    """
    known = marks.where(F.col("__label").isin(0, 1)).withColumn("__key", F.xxhash64("__mark_id"))
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    if len(counts) < 2:
        return CompressionModel(b"", b"", (), prior)
    ids = [known.where(F.col("__label") == k).orderBy("__key", "__mark_id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("__own"), text_or_empty(text_col).alias("__text")).join(F.broadcast(ids[0].union(ids[1])), F.col("__own") == F.col("__mark_id"))
    # A label that several rows share by their id is learnt from one text, so no more than the picked rows come here.
    once = texts.where(F.char_length("__text") <= TRAIN_CHARS).groupBy("__key", "__mark_id", "__label").agg(F.min("__text").alias("__text"))
    found = sorted((r["__key"], r["__label"], r["__text"]) for r in once.select("__key", "__label", "__text").collect())
    picked = {k: [t for _, label, t in found if label == k] for k in (0, 1)}
    if not all(picked.values()):
        return CompressionModel(b"", b"", (), prior)
    halves = {k: (t[::2], t[1::2] or t) for k, t in picked.items()}
    good, bad = dictionary(halves[1][0]), dictionary(halves[0][0])
    packers = [packer(d) for d in (good, bad)]
    x = np.vstack([features(halves[k][1], packers) for k in (0, 1)])
    sizes = [len(halves[k][1]) for k in (0, 1)]
    y = np.repeat([0.0, 1.0], sizes)
    share = np.repeat([(1 - prior) / sizes[0], prior / sizes[1]], sizes) * sum(sizes)
    return CompressionModel(good, bad, logistic(x, y, share), prior)


def quality_scores(df: DataFrame, model: CompressionModel, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The kept columns with ``score`` (0 to 1, higher: better). One narrow pass.

    The closure carries the two dictionaries: 220 kB at any size of the data.
    """
    rows = df.select(*keep, text_or_empty(text_col).alias("__text"))
    names, fields = rows.columns[:-1], rows.schema.fields[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = pa.array(scorer(batch.column(len(names)).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*names, "score"])

    return rows.mapInArrow(score, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_labels(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """From ``labels.quality`` of the documents that are not held out."""
    marks = labels.select(F.col("doc_id").alias("__mark_id"), F.col("quality").cast("int").alias("__label"))
    return fit(docs, marks.where(~held_out("__mark_id")).dropDuplicates(["__mark_id"]))


def quality_filter(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                scores = scorer([t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs, model, ["doc_id", held_out().alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

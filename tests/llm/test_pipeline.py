from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm.common import documents, materialize
from gridloom.llm.packing import encoding, packed_documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = documents(spark, SF)
    names = docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), f"test{k}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= before and ids
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        before = ids
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_packed_pieces_carry_their_token_ids(spark):
    docs = documents(spark, SF)
    rows = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(map(tuple, packed_documents(docs).select(*names).collect()))
    by_doc: dict = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], b"") + r["ids"]
    for r in docs.collect():
        assert encoding().decode(np.frombuffer(by_doc[r["doc_id"]], "<u4")[:-1].tolist()) == (r["text"] or "")


# Odd tables: null ids and texts, repeated rows, one id with several texts, very long texts, columns whose names clash.

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, label string, score double, kept boolean, __id long, __text string, __key long, __row string, __draw double, text_hash long, set_key long, piece int, ids binary"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    texts = [(None, None), (None, ""), (None, words(1, 80)), (None, words(2, 80)), (None, words(2, 80)), (3, words(3, 80)), (3, words(3, 80)), (3, words(4, 80)), (5, words(3, 80)), (6, None), (7, " "), (8, "token=abcdefgh12345 " + words(5, 60)), (9, words(6, 9000)), (10, "x" * 50_000)]
    texts += [(100 + i, words(100 + i, 60)) for i in range(60)] + [(200 + i, " ".join(["buy now"] * 30) + words(300 + i, 4)) for i in range(40)]
    rows = [(i, t, "en", None if k % 5 == 0 else "s", None, 1, "l", 0.5, True, 7, "t", 1, "r", 0.1, 1, 2, 3, b"x") for k, (i, t) in enumerate(texts)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(100 + i, 1, int(i % 9 == 0)) for i in range(60)] + [(200 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (100, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.createDataFrame(rows, FIELDS).repartition(3), str(folder)


def as_rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_and_empty_tables(spark, odd, k):
    docs, folder = odd
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, folder)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and rows
        if k != 2:  # what stays is as it was
            left = as_rows(docs)
            for r in map(repr, rows):
                left.remove(r)
    if k == 1:
        kept = [(r["doc_id"], r["text"]) for r in rows]
        assert len(kept) == len(set(kept)) and {(None, words(1, 80)), (None, words(2, 80)), (3, words(4, 80)), (3, words(3, 80)), (9, words(6, 9000))} <= set(kept) and (5, words(3, 80)) not in kept
    if k == 2:
        assert len(rows) == docs.count() and not any("abcdefgh12345" in (r["text"] or "") for r in rows)
    if k == 4:
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) >= docs.count()
    empty = spark.createDataFrame([], docs.schema)
    assert stage(spark, empty, folder).count() == 0

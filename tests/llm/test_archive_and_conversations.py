"""The archive, the repair of conversations and their trie, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import conversation_repair, prefix_trie, warc_archive
from gridloom.llm.common import scratch_folder

# Archive

PAGES = "page_id long, url string, html string, header string, address binary, payload string, __id int"
BIG = "<p>ü😀</p>" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x", BIG), (2, "http://a/y", BIG), (3, None, BIG), (4, "http://b/ q\r\nWARC-Type: revisit\r\n", "small"), (5, "http://b/", "small"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (None, "n", "<b>" * 500), (None, "n", "<b>" * 500), (9, "d", "x" * 999), (9, "d", "x" * 999), (10, "e", "y" * 1000), (10, "e", "y" * 1000), (11, "l", "long text\r\n\r\n" * 60_000)]
    return spark.createDataFrame([(*r, "h", b"a", "p", 1) for r in rows], PAGES).repartition(4)


def archived(df, **more):
    path = scratch_folder(df.sparkSession, "warc-test")
    warc_archive.write_archive(df, path, **more)
    return path


def test_records_are_rebuilt_from_payloads_stored_once(spark, pages):
    path = archived(pages, date="2024-02-29T12:00:00Z")
    got = warc_archive.read_archive(spark, path).collect()
    source = sorted((str(r["page_id"]), (r["html"] or "").encode()) for r in pages.collect())
    assert sorted((str(r["source_id"]), bytes(r["payload"])) for r in got) == source
    assert spark.read.parquet(f"{path}/payloads").count() == len({p for _, p in source})
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) == len(got)
    for r in got:
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(lines) == head.count(b"\r\n") and block.endswith(b"\r\n\r\n")
        assert len(block) - 4 == int(lines["Content-Length"]) and lines["WARC-Type"] == r["record_type"] and lines["WARC-Date"] == "2024-02-29T12:00:00Z"
        http, body = block[:-4].split(b"\r\n\r\n", 1)
        assert f"Content-Length: {len(r['payload'])}".encode() in http
        assert body == (b"" if r["record_type"] == "revisit" else bytes(r["payload"]))
        assert lines["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(r["payload"]).hexdigest()
        if r["record_type"] == "revisit":
            other = by_id[lines["WARC-Refers-To"]]
            assert other["record_type"] == "response" and other["payload"] == r["payload"] and other["source_id"] == r["refers_to"]
    groups = defaultdict(list)
    for r in got:
        groups[bytes(r["payload"])].append(r)
    for payload, rs in groups.items():
        responses = [r for r in rs if r["record_type"] == "response"]
        assert len(responses) == (len(rs) if len(payload) < 1000 else 1)
        if len(payload) >= 1000:
            assert int(responses[0]["source_id"] or -1) == max(int(r["source_id"] or -1) for r in rs)
    assert {r["url"] for r in got if r["source_id"] == "4"} == {"http://b/%20q%0D%0AWARC-Type:%20revisit%0D%0A"}


def test_a_changed_payload_ends_the_reading(spark, pages):
    path = archived(pages)
    other = scratch_folder(spark, "warc-changed")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b" "))).write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="not the payload"):
        warc_archive.read_archive(spark, other).collect()
    spark.read.parquet(f"{path}/payloads").limit(0).write.parquet(f"{other}-none/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{other}-none/records")
    with pytest.raises(Exception, match="not the payload"):
        warc_archive.read_archive(spark, f"{other}-none").collect()


def test_an_empty_archive(spark, pages):
    assert warc_archive.read_archive(spark, archived(pages.limit(0))).collect() == []


# Repair

ROWS = "conv_id long, turn long, role string, text string, conv string, fault int, present string, fate int"


def turns(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 5)):
            turn = rng.choice([t, t, t, t, t + 3, t, None])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            out.append((c if c else None, turn, role, rng.choice(["Yes.", "cut", "", " \t", "Why?", "Go on!\n", None, "ü. ", f"{t}."])))
    return out


def fates(rows: list[tuple]) -> dict:
    """Conversations after damage, in order."""
    out: dict = defaultdict(list)
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[c] += [] if fate == 0 else [(t, role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode())) for c, r in out.items()}


def judged(rows: list[tuple]) -> list[tuple]:
    seen, out = set(), []
    for t, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((t, role, text, 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def brute(rows: list[tuple]) -> tuple[int, str, str]:
    """The best of all edits, tried one after the other."""
    best = None

    def go(i: int, roles: str, cost: int, audit: str, texts: tuple, run: int) -> None:
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(x for x in (best, (cost, audit, texts)) if x)
        if run < 2:
            for r, name in (("u", "user"), ("a", "assistant")):
                if re.match("s?(ua)*u?$", roles + r):
                    go(i, roles + r, cost + 2, audit + "I", (*texts, f"{name}:"), run + 1)
        if i == len(rows):
            return
        _, role, text, fault = rows[i]
        go(i + 1, roles, cost + 3, audit + "D", texts, 0)
        if fault in (1, 2):
            return
        for letter, name, c in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
            if name[:1] in ("s", "u", "a") and re.match("s?(ua)*u?$", roles + name[:1]):
                go(i + 1, roles + name[:1], cost + c + (fault == 3), audit + letter, (*texts, f"{name}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def test_repairs_are_the_cheapest_edits(spark):
    rows = turns(5, 90)
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], ROWS).repartition(3)
    made = conversation_repair.damaged(df)
    got = {r["conv"]: r for r in conversation_repair.repaired(made).collect()}
    want = fates(rows)
    assert set(got) == set(want)
    for c, rs in want.items():
        r, rs = got[c], judged(rs)
        known = [t for t, *_ in rs if t is not None]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == brute(rs)
        assert r["gaps"] == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [sum(x[3] == k for x in rs) for k in (1, 2, 3)]
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
    by_conv = defaultdict(list)
    for r in conversation_repair.repaired_turns(made).collect():
        by_conv[r["conv"]].append((r["place"], r["role"], r["text"]))
    for c, r in got.items():
        text = "\n".join(f"{role}:{text}" for _, role, text in sorted(by_conv[c]))
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]


def test_a_long_conversation_and_one_whose_ways_never_meet(spark):
    rows = [("talk", k, ("user", "assistant")[k % 2], f"Turn {k}. " + "word " * 20 + ".") for k in range(30_000)] + [("odd", k, "system", f"{k}.") for k in range(30_001)]
    df = spark.createDataFrame(rows, "conv string, turn long, role string, text string").withColumn("present", F.lit(True))
    got = {r["conv"]: r for r in conversation_repair.repaired(df).collect()}
    assert got["talk"]["cost"] == 0 and got["talk"]["audit"] == "K" * 30_000
    assert got["odd"]["cost"] == 2 * 30_000 and got["odd"]["audit"] == "K" + "R" * 30_000


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert conversation_repair.repaired(conversation_repair.damaged(df)).collect() == []


# Trie


def nodes_of(ways: dict[int, list[tuple[str, int]]]) -> list[tuple]:
    """Every prefix of every sequence of (turn, words)."""
    found: dict[tuple, list[int]] = defaultdict(list)
    for c, way in ways.items():
        for d in range(len(way) + 1):
            found[tuple(way[:d])].append(c)
    kids = defaultdict(set)
    for p in found:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, cs in found.items():
        below = [q for q in found if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(ways[c]) == len(p))))
        out.append((min(cs), len(p), min(found[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in below), sum((len(found[q]) - 1) * q[-1][1] for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def as_tuples(df) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [2, 3, 2048])
def test_the_trie_has_every_node(spark, block):
    rng = random.Random(block)
    rows, ways = [], {}
    for c in range(-3, 70):
        own = [(rng.choice("ab"), rng.choice(["x y", "z", "", None])) for _ in range(rng.choice([1, 2, 3, 6, 9]))]
        if c % 3 == 0:
            own = [("a", "x y")] * rng.choice([2, 5, 6])
        rows += [(c, k if k else None, role, text, None, 1, "n", 0) for k, (role, text) in enumerate(own)]
        ways[c] = own
    rows += [(None, 1, "a", "x", None, 1, "n", 0)]

    def built(c: int) -> list[tuple]:
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - math.fmod(c, 20))
        way = ways.get(base, [])[:h] + ways[c][h:]
        return [(f"{r}:{t or ''}", len((t or "").split())) for r, t in way]

    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = as_tuples(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)), block, 5))
    assert got == nodes_of({c: built(c) for c in ways})


def test_a_conversation_of_many_turns(spark):
    n = 3 * prefix_trie.BLOCK
    long = [(c, k, "user", f"turn {k}" if k < n - c else "other") for c in (1, 2) for k in range(n)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string")
    ways = prefix_trie.turns_of(df).withColumn("part", F.lit(1))
    starts = ways.select("conv").distinct().select("conv", F.lit(0).cast("int").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), F.lit(-1).alias("part"))
    got = prefix_trie.trie(ways.unionByName(starts))
    assert got.count() == n + 3
    top = got.where("depth = 0").first()
    assert (top["n_convs"], top["n_leaves"], top["n_children"], top["saved_tokens"]) == (2, 2, 1, 2 * (n - 2))


def test_a_trie_of_nothing(spark):
    df = spark.createDataFrame([], ROWS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df))).collect() == []

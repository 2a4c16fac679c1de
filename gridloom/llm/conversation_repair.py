"""Repair of conversations whose turns were dropped, blanked, cut, repeated or misattributed.

A repaired conversation is ``(system? (user assistant)+)?``. Its rows are kept, given
another role, or deleted, and empty turns are inserted, at the least cost; of equally
cheap ways that with the least audit string counts. The way is found by a forward
Viterbi pass over the four states of the grammar (nothing yet, after the system turn,
after a user turn, after an assistant turn). Each state carries its cost, its audit and
the digest of its text so far; each turn's layer is closed by inserts, of which two at
most are of use.

A conversation is a stream: rows are sorted within a partition and one at a time is in
memory. The audits themselves are kept as one byte a row and state. Two audits are
compared by what follows their common start, of which the first character alone matters
once both have one; where only one goes on, it does so by inserts, as both have one edit
for each row. A text's digest is a chain, so one conversation is one task's stream, even
where it holds a third of all rows; that takes time but no memory.

Defined results: a null role or text is one space; rows of a null ``conv_id`` are one
conversation; rows without a turn come first and count in no gap; rows of one turn are
taken by role, then by text, and of equal ones the later are duplicates; a role is what
its first character says; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: First faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a turn of the role may follow.
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (START,)}
ROLE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: A row's edit and the inserts after it, as a number below 64 with the state it came from.
EDITS = [e + "I" * n for e in ("", "K", "R", "D") for n in range(3)]
CODE = {e: k for k, e in enumerate(EDITS)}


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, present``: rows damaged by a hash of conversation and turn; dropped ones are not present."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space(conv_col), F.lit(":"), or_space(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), or_space(role_col).alias("role"), or_space(text_col).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), F.when(F.col("fate") != 0, text).otherwise("").alias("text"), (F.col("fate") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))))
    return rows.drop("col")


def first_faults(rows: DataFrame) -> DataFrame:
    """With ``fault``, within partitions of whole conversations.

    One shuffle: the window's rows are where the conversation's are.
    """
    dealt = rows.repartition("conv").withColumn("__same", F.when(F.col("present"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    later = F.row_number().over(W.partitionBy("conv", "__same").orderBy(F.col("turn").asc_nulls_first())) > 1
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(~F.col("present"), NONE).when(shown == "", BLANK).when(later, DUPLICATE).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE)
    return dealt.withColumn("fault", fault).drop("__same")


class Chain:
    """The forward pass over one conversation's rows."""

    def __init__(self):
        empty = hashlib.sha256()
        self.cost: list[int | None] = [0, None, None, None]
        self.sha = [empty, None, None, None]
        self.steps = bytearray()
        self.rest = {(i, j): ("", "") for i in range(4) for j in range(4)}
        self.layer({START: [(0, START, "", None)]})

    def less(self, a: tuple, b: tuple) -> bool:
        """Whether a way (cost, state it comes from, edits, ...) is better than another."""
        if a[0] != b[0]:
            return a[0] < b[0]
        x, y = self.rest[a[1], b[1]]
        return x + a[2] < y + b[2]

    def layer(self, ways: dict[int, list[tuple]]) -> None:
        """Takes the best way to each state and closes the layer with inserts; a way is (cost, from, edits, turns)."""
        best: list[tuple | None] = [None] * 4
        for state, found in ways.items():
            for way in found:
                if best[state] is None or self.less(way, best[state]):
                    best[state] = way
        for to in (USER, ASSISTANT):
            for s in BEFORE[to]:
                if best[s] is not None and best[s][2].count("I") < 2:
                    c, at, edits, turns = best[s]
                    way = (c + INSERT, at, edits + "I", (turns or ()) + ((NAME_OF[to], None),))
                    if best[to] is None or self.less(way, best[to]):
                        best[to] = way
        sha = []
        for way in best:
            if way is None:
                sha.append(None)
                continue
            h = self.sha[way[1]]
            if way[3]:
                h, first = h.copy(), way[1] == START
                for name, text in way[3]:
                    h.update(f"{'' if first else chr(10)}{name}:".encode("utf-8", "surrogatepass"))
                    if text:
                        h.update(text)
                    first = False
            sha.append(h)
        rest = {}
        for i, a in enumerate(best):
            for j, b in enumerate(best):
                if i < j and a is not None and b is not None:
                    x, y = self.rest[a[1], b[1]]
                    x, y = x + a[2], y + b[2]
                    k = 0
                    while k < len(x) and k < len(y) and x[k] == y[k]:
                        k += 1
                    x, y = x[k:], y[k:]
                    if x and y:
                        x, y = x[0], y[0]
                    rest[i, j], rest[j, i] = (x, y), (y, x)
        rest |= {(i, i): ("", "") for i in range(4)}
        self.cost, self.sha, self.rest = [w and w[0] for w in best], sha, rest
        self.cost = [None if w is None else w[0] for w in best]
        self.steps += bytes(0 if w is None else w[1] * 16 + CODE[w[2]] for w in best)

    def row(self, role: str, text: bytes, fault: int) -> None:
        ways: dict[int, list[tuple]] = {}
        for s, c in enumerate(self.cost):
            if c is not None:
                ways.setdefault(s, []).append((c + DELETE, s, "D", None))
        if fault not in (BLANK, DUPLICATE):
            more, own = TRUNCATED * (fault == CUT), ROLE_OF.get(role[:1])
            for to in (SYSTEM, USER, ASSISTANT):
                if to == SYSTEM and own != SYSTEM:
                    continue
                for s in BEFORE[to]:
                    if self.cost[s] is not None:
                        way = (self.cost[s] + KEEP + more, s, "K", ((role, text),)) if own == to else (self.cost[s] + REROLE + more, s, "R", ((NAME_OF[to], text),))
                        ways.setdefault(to, []).append(way)
        self.layer(ways)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best way that the grammar accepts."""
        state = START
        if self.cost[ASSISTANT] is not None and self.less((self.cost[ASSISTANT], ASSISTANT, ""), (self.cost[START], START, "")):
            state = ASSISTANT
        cost, digest, out = self.cost[state], self.sha[state].hexdigest(), []
        for at in range(len(self.steps) - 4, -1, -4):
            step = self.steps[at + state]
            out.append(EDITS[step % 16])
            state = step // 16
        return cost, "".join(reversed(out)), digest


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row of sorted batches with whether a conversation begins."""
    before: tuple = ()
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield row[:1] != before, row
            before = row[:1]


def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of sorted ``conv, turn, role, text, fault, present`` rows."""
    kind, out = None, []

    def closed() -> tuple:
        span = high - low + 1 - distinct if low is not None else 0
        return (conv, span, *faults[1:], illegal, *chain.end())

    def full() -> pa.RecordBatch:
        names = ["conv", *[f.split()[0] for f in COUNTS.split(", ")]]
        types = [kind, *[pa.string() if f.endswith("string") else pa.int64() for f in COUNTS.split(", ")]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for b in source:
            kind = b.schema.field(0).type
            yield b

    chain = None
    for begins, (own, turn, role, text, fault, present) in conversations(typed(batches)):
        if begins:
            if chain is not None:
                out.append(closed())
                if len(out) >= 4096:
                    yield full()
                    out = []
            conv, chain, faults, illegal, last, low, high, distinct = own, Chain(), [0] * 4, 0, None, None, None, 0
        if not present:
            continue
        if turn is not None and turn != high:
            low, high, distinct = turn if low is None else low, turn, distinct + 1
        faults[fault] += 1
        illegal += last is not None and last + role[:1] not in LEGAL
        last = role[:1]
        chain.row(role, text, fault)
    if chain is not None:
        out.append(closed())
        yield full()


def in_order(rows: DataFrame) -> DataFrame:
    """Conversations one after the other, their rows by turn; of equal rows the first is no duplicate."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE]
    return rows.sortWithinPartitions(*order)


def repaired(rows: DataFrame) -> DataFrame:
    """``conv`` and :data:`COUNTS` for each conversation of ``conv, turn, role, text, present`` rows without nulls in role and text."""
    kind = rows.schema["conv"].dataType.simpleString()
    made = in_order(first_faults(rows)).select("conv", "turn", "role", F.col("text").cast("binary").alias("text"), "fault", "present")
    return made.mapInArrow(repair, f"conv {kind}, {COUNTS}")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv, place, role, text, edit``: the turns of the repaired conversations, inserted ones included."""
    kind = rows.schema["conv"].dataType.simpleString()
    audits = repaired(rows).select(F.col("conv").alias("__conv"), "audit")
    made = first_faults(rows.where("present")).join(audits, F.col("conv").eqNullSafe(F.col("__conv"))).repartition("conv")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = place = 0
        audit = ""
        last = START

        def put(name: str, text: str, edit: str) -> None:
            nonlocal place, last
            out.append((conv, place, name, text, edit))
            place, last = place + 1, ROLE_OF[name[:1]]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(NAME_OF[ASSISTANT if last == USER else USER], "", "I")
                at += 1

        conv = None
        for b in batches:
            for begins, (own, role, text, own_audit) in conversations_of(b, conv, place == 0 and at == 0):
                if begins:
                    conv, at, place, audit, last = own, 0, 0, own_audit, START
                    inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(role if edit == "K" else NAME_OF[ASSISTANT if last == USER else USER], text, edit)
                inserts()
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:]]], names=["conv", "place", "role", "text", "edit"])
                out = []

    def conversations_of(b: pa.RecordBatch, before, fresh: bool) -> Iterator[tuple]:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield fresh or row[0] != before, row
            before, fresh = row[0], False

    return in_order(made).select("conv", "role", "text", "audit").mapInArrow(apply, f"conv {kind}, place long, role string, text string, edit string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


def _crc32(text: str) -> str:
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295)"


def _way(state: str, cost: str, edit: str, turn: str | None = None) -> str:
    text = f"{state}.t" if turn is None else f"{turn}" if state.endswith("0") else f"{state}.t || chr(10) || {turn}"
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{edit}', t := {text})"


_NO = "struct_pack(c := 1000000000, a := '~', t := '')"


def _turn(states: str, initial: str, name: str) -> str:
    kept = ", ".join(_way(f"s{i}", "more", "K", "role || ':' || text") for i in states)
    other = ", ".join(_way(f"s{i}", "more + 2", "R", f"'{name}:' || text") for i in states) if name else _NO
    return f"CASE WHEN fault IN (1, 2) THEN {_NO} WHEN left(role, 1) = '{initial}' THEN least({kept}, {_NO}) ELSE least({other}, {_NO}) END"


ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations),
hit AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM base WHERE fate <> 0),
judged AS (
  SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS shown, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS later,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hit),
faulty AS (
  SELECT *, CASE WHEN shown = '' THEN 1 WHEN later THEN 2 WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, fault = 3 AS more_, CAST(CASE WHEN fault = 3 THEN 1 ELSE 0 END AS BIGINT) AS more,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM judged),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), struct_pack(c := CAST(0 AS BIGINT), a := '', t := ''), struct_pack(c := CAST(1000000000 AS BIGINT), a := '~', t := ''),
    struct_pack(c := CAST(2 AS BIGINT), a := 'I', t := 'user:'), struct_pack(c := CAST(4 AS BIGINT), a := 'II', t := 'user:' || chr(10) || 'assistant:') FROM conversations
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, least(n3, {_way("m2", "2", "I", "'assistant:'")}) FROM (
    SELECT *, least(n2, {_way("n0", "2", "I", "'user:'")}, {_way("n1", "2", "I", "'user:'")}, {_way("n3", "2", "I", "'user:'")}) AS m2 FROM (
      SELECT w.conv_id, f.i, {_way("s0", "3", "D")} AS n0, least({_way("s1", "3", "D")}, {_turn("0", "s", "")}) AS n1, least({_way("s2", "3", "D")}, {_turn("013", "u", "user")}) AS n2, least({_way("s3", "3", "D")}, {_turn("2", "a", "assistant")}) AS n3
      FROM walk w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1))),
ends AS (SELECT conv_id, arg_max(CASE WHEN struct_pack(c := s3.c, a := s3.a) < struct_pack(c := s0.c, a := s0.a) THEN s3 ELSE s0 END, i) AS e FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, e.e.c AS cost, e.e.a AS audit, sha256(e.e.t) AS repaired_sha256
FROM ends e LEFT JOIN counts k ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""

"""Exact Jaccard join of word shingle sets with token-combination prefixes.

Shingles are ordered by hash, the same for all documents. Two sets of Jaccard
similarity 0.8 or more share at least ``min(need(x), need(y))`` shingles among their
*extended prefixes* (the prefix that would guarantee one, and a quarter more). From
that everything follows:

1. Equal sets are one class; the join runs over classes.
2. Support: a class needs ``need`` prefix shingles that some other class shares too.
   Classes without are out, and so are, round after round, those that were supported
   by classes that are out. A passage or a line that many texts share supports none
   of them unless it makes up most of its prefix.
3. Stars: each shingle has a *pivot*, the class that has least of its prefix to
   itself (in a group of near copies that is their model or close to it), and
   the pivot is compared with the shingle's other classes. That is linear, however
   many copies share the shingle, and links nearly all copies; linked classes form
   components. A few turns with other pivots of that kind do so for what is left.
   What follows makes only pairs across components.
4. Rare shingles (held by at most ``RARE`` classes) are indexed alone. A pair must
   share enough of them, given how many frequent ones it may share besides.
5. Frequent shingles: the classes of one pivot are indexed by what *differs* between
   them and it. If ``d(x)`` is the number of shingles that only one of ``x`` and the
   pivot has, a pair of similarity 0.8 has at least ``(d(x) + d(y) - (|x| + |y|) / 9) /
   2`` such differences in common, and this is positive unless both are linked to
   the pivot, hence in one component. Differences that no class of another component
   has count as not shared. A class much of which the pivot lacks is first looked up
   by a few such tokens. Open differences are ordered by frequency and cut
   to a prefix; rare ones (``RARE_DIFFERENCE``) are indexed alone, of frequent ones
   combinations of two, which a prefix that is extended by one makes safe. A class that may share just one
   difference with a partner looks for it among the single ones.
6. Candidates are verified on their whole sets.

So no link between different components is lost, while pairs inside a component that
add nothing are never made, and a large group of near copies is told apart by its
few differences, not by the many shingles that all of it shares. Set classes are
named by a 64-bit hash of the set.

Defined results: a document without words (or text) has an empty set and is linked
with nothing; equal sets are linked; repeated rows and rows with a null id are
members like others (a component of null ids only has a null id); an empty table
gives an empty result; of the input only the id and the text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import documents, map_rows, materialize, release, text_or_empty
from gridloom.llm.components import components
from gridloom.llm.shingles import K, shingle_set

THRESHOLD = Fraction(4, 5)
#: Classes that share a shingle of the rare kind at most.
RARE = 32
#: Classes that share a difference of the rare kind at most. A class has many differences
#: to combine by two, while few pairs of those that share one pass the bounds.
RARE_DIFFERENCE = 256
#: Tokens beyond those that a partner may lack by which a class is looked up; a quarter of those if that is more.
PROBE = 17
#: Turns of pivots.
STAR_ROUNDS = 3
#: Tasks that the rows of one component are dealt to at least when its id is told to them.
SALTS = 16


def prefix(n: int, t: Fraction = THRESHOLD) -> tuple[int, int]:
    """Length of the extended prefix of a set of ``n``, and how many of it a partner with a like prefix shares."""
    p = n - ceil(t * n) + 1
    extra = min(p // 4, n - p)
    return p + extra, extra + 1


def need(n: Column, t: Fraction = THRESHOLD) -> Column:
    """What the smallest partner of a set of ``n`` shares of its extended prefix."""
    a, b = t.numerator, t.denominator
    return shared_tokens(F.floor((a * n + b - 1) / b), t)


def set_table(df: DataFrame, id_col: str, text_col: str, t: Fraction, k: int = K) -> DataFrame:
    """``id, text_hash, n, set_key, tokens`` (the extended prefix) of each row.

    A task gives the prefix of a set once; later copies get none.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, k)
                key = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                sizes.append(len(own))
                keys.append(key)
                tokens.append(own[: prefix(len(own), t)[0]].view(np.int64) if len(own) and key not in seen else own[:0].view(np.int64))
                seen.add(key)
            if len(seen) > 1_000_000:
                seen.clear()
            ends = np.cumsum([0, *map(len, tokens)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens) if tokens else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists], names=names)

    names = ["__id", "text_hash", "n", "set_key", "tokens"]
    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return map_rows(df, [F.col(id_col).alias("__id"), F.xxhash64(text).alias("text_hash"), text.alias("__text")], build, f"__id {kind}, text_hash long, n long, set_key long, tokens array<long>")


def supported(entries: DataFrame, t: Fraction, tell: str) -> DataFrame:
    """The entries (token, set_key, n) of shared tokens, for the classes that have enough of them (``k``).

    A token's least and greatest class are aggregated before the shuffle; the join
    back can be split where a token is skewed.
    """
    ends = entries.groupBy("token").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("token")
    shared = materialize(entries.join(ends, "token").select("token", "set_key", "n").distinct(), f"{tell}-shared")
    enough = shared.groupBy("set_key", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need(F.col("n"), t)).select("set_key", "k")
    kept = materialize(shared.join(enough, "set_key").select("token", "set_key", "n", "k"), f"{tell}-kept")
    release(shared)
    return kept


def shared_tokens(n: Column, t: Fraction = THRESHOLD) -> Column:
    """What a partner that is no smaller shares of a set of ``n``'s extended prefix."""
    a, b = t.numerator, t.denominator
    return F.floor((n - F.floor((a * n + b - 1) / b) + 1) / 4) + 1


def fits(a: Column, b: Column, t: Fraction) -> Column:
    return F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator


def verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                hit.append(both * t.denominator >= (len(u) + len(v) - both) * t.numerator)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_())), batch.column(1).filter(pa.array(hit, pa.bool_()))], names=["a", "b"])

    own = pairs.join(sets.select(F.col("set_key").alias("b"), F.col("grams").alias("gb")), "b")
    both = own.join(sets.select(F.col("set_key").alias("a"), F.col("grams").alias("ga")), "a")
    return both.select("a", "b", "ga", "gb").mapInArrow(compare, "a long, b long")


def whole_sets(df: DataFrame, wanted: DataFrame, text_col: str, k: int = K) -> DataFrame:
    """``set_key, grams`` for the wanted texts (text_hash)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, grams = [], []
            for text in batch.column(0).to_pylist():
                own = shingle_set(text, k)
                key = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    grams.append(own.tobytes())
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], names=["set_key", "grams"])

    text = text_or_empty(text_col)
    rows = df.select(text.alias("__text"), F.xxhash64(text).alias("text_hash")).join(wanted, "text_hash", "left_semi").select("__text")
    return rows.mapInArrow(build, "set_key long, grams binary").groupBy("set_key").agg(F.first("grams").alias("grams"))


def labelled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))


def prefix_size(n: Column, t: Fraction = THRESHOLD) -> Column:
    """Length of the extended prefix of a set of ``n``, as :func:`prefix` has it."""
    p = n - F.floor((t.numerator * n + t.denominator - 1) / F.lit(t.denominator)) + 1
    return p + F.least(F.floor(p / 4), n - p)


def pivots(entries: DataFrame, turn: int, t: Fraction) -> DataFrame:
    """``token, pivot, m``: of each token's classes the one with the least share of its prefix to itself, and its size.

    Of several it is the one of the least hash, another one each turn, but the same for
    all tokens, so few classes are pivots.
    """
    own = F.round(1 - F.col("k") / prefix_size(F.col("n"), t), 2)
    best = entries.groupBy("token").agg(F.min(F.struct(own.alias("o"), F.xxhash64("set_key", F.lit(turn)).alias("h"), "set_key", "n")).alias("p"))
    return materialize(best.select("token", F.col("p.set_key").alias("pivot"), F.col("p.n").alias("m")), "jaccard-pivots")


def stars(entries: DataFrame, centres: DataFrame, labels: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of each token's pivot with its classes of other components."""
    placed = labelled(entries, labels)
    heads = labelled(centres.withColumnRenamed("pivot", "set_key"), labels).select("token", F.col("set_key").alias("pivot"), "m", F.col("label").alias("lp"))
    met = placed.join(heads, "token").where((F.col("label") != F.col("lp")) & fits(F.col("n"), F.col("m"), t))
    return met.select(F.least("set_key", "pivot").alias("a"), F.greatest("set_key", "pivot").alias("b")).distinct()


def open_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of tokens that several components hold, with the label and the number of classes (``df``)."""
    placed = labelled(entries, labels)
    open_ = placed.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("df")).where("l0 <> l1").select("token", "df")
    return placed.join(open_, "token")


def overlap_of_differences(d: Column, db: Column, n: Column, nb: Column, both: Column, t: Fraction) -> Column:
    """Whether a pair with ``both`` common differences at most can be similar enough."""
    a, b = t.numerator, t.denominator
    return (d + db - 2 * both) * (a + b) <= (n + nb) * (b - a)


def rare_pairs(placed: DataFrame, t: Fraction) -> DataFrame:
    """``a, b``: pairs across components that share enough tokens of the rare kind.

    ``placed``: token, set_key, n, label, df, the tokens that several components hold.
    A pair's other shared tokens are frequent ones, at most as many as either has.
    """
    often = placed.where(F.col("df") > RARE).groupBy("set_key").agg(F.count("*").alias("f"))
    few = placed.where(F.col("df") <= RARE).join(often, "set_key", "left").select("token", "set_key", "n", "label", F.coalesce("f", F.lit(0)).alias("f"))
    right = few.select("token", F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("f").alias("fb"))
    met = few.join(right, "token").where((F.col("set_key") < F.col("b")) & (F.col("label") != F.col("lb")) & fits(F.col("n"), F.col("nb"), t))
    together = met.groupBy(F.col("set_key").alias("a"), "b").agg(F.count("*").alias("rare"), F.first(F.least("f", "fb")).alias("frequent"), F.first(F.least("n", "nb")).alias("n"))
    return together.where(F.col("rare") + F.col("frequent") >= shared_tokens(F.col("n"), t)).select("a", "b")


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``pivot, m, set_key, n, label, added, d, tokens``: what only the member has (``added`` tokens), then what only the pivot has."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True)]
            added = [np.setdiff1d(x, y, assume_unique=True) for x, y in both]
            found = [np.concatenate([new, np.setdiff1d(y, x, assume_unique=True)]) for new, (x, y) in zip(added, both, strict=True)]
            sizes = list(map(len, found))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(list(map(len, added)), pa.int64()), pa.array(sizes, pa.int64()), lists], names=["pivot", "m", "set_key", "n", "label", "added", "d", "tokens"])

    # The join by class comes last and deals the rows evenly, however many of them are of one pivot.
    own = members.join(sets.select(F.col("set_key").alias("pivot"), F.col("grams").alias("gp")), "pivot")
    both = own.join(sets.select("set_key", F.col("grams").alias("g")), "set_key")
    return both.select("pivot", "m", "set_key", "n", "label", "g", "gp").mapInArrow(compare, "pivot long, m long, set_key long, n long, label long, added long, d long, tokens array<long>")


def similar(most: Column, n: Column, nb: Column, t: Fraction) -> Column:
    """Whether two sets with ``most`` common tokens at most can be similar enough."""
    return most * t.denominator >= (n + nb - most) * t.numerator


def least_shared(d: Column, n: Column, m: Column, t: Fraction) -> Column:
    """Differences that a class shares with any partner of another component at least.

    A class that is linked to the pivot (of size ``m``) has partners only among those
    that are not, and these differ by more than a link allows. Another one has
    partners of at most ``1 / t`` times its size.
    """
    a, b = t.numerator, t.denominator
    linked = d * (a + b) <= (n + m) * (b - a)
    near = F.floor((d * (a + b) - (n - m) * (b - a)) / F.lit(2 * (a + b))) + 1
    return F.greatest(F.lit(1), F.when(linked, near).otherwise(d - F.floor(n * (b - a) / F.lit(a))))


def unshared(n: Column, t: Fraction) -> Column:
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - F.floor((t.numerator * n + t.denominator - 1) / F.lit(t.denominator))


def probe(n: Column, t: Fraction) -> Column:
    """Tokens beyond :func:`unshared` by which a set of ``n`` is looked up; no fewer for larger sets."""
    return F.greatest(F.lit(PROBE), F.floor(unshared(n, t) / 4))


def open_differences(tokens: DataFrame) -> DataFrame:
    """``pivot, token, df``: the differences from a pivot that classes of several components have.

    Labels and counts are aggregated before the shuffle, however many classes have one.
    """
    return tokens.groupBy("pivot", "token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("df")).where("l0 <> l1").select("pivot", "token", "df")


def promising(apart: DataFrame, t: Fraction) -> DataFrame:
    """The rows of :func:`differences` whose class can share enough of what the pivot lacks.

    A partner lacks :func:`unshared` tokens of a class at most. Where the pivot lacks
    more, the partner has the rest. All classes have these tokens in one order, so the
    ``c``-th common one is among the first ``unshared + c`` of either, and no class is
    indexed or looked up by more: of those of a class, as many as its smallest partner
    goes beyond :func:`unshared` are open.
    """
    n, added = F.col("n"), F.col("added")
    may = unshared(n, t)
    few = apart.withColumn("few", F.least(added, may + probe(n, t)).cast("int"))
    open_ = open_differences(few.select("pivot", "label", F.explode(F.slice("tokens", F.lit(1), F.col("few"))).alias("token"))).select("pivot", "token")
    smallest = F.floor((t.numerator * n + t.denominator - 1) / F.lit(t.denominator))
    least = F.least(added - may, probe(smallest, t))
    asked = few.where(added > may).select("pivot", "set_key", least.alias("least"), F.explode(F.slice("tokens", F.lit(1), F.col("few"))).alias("token"))
    found = asked.join(open_, ["pivot", "token"], "left_semi").groupBy("pivot", "set_key", "least").agg(F.count("*").alias("c")).where("c >= least")
    return apart.where(added <= may).union(apart.where(added > may).join(found.select("pivot", "set_key"), ["pivot", "set_key"], "left_semi").select(*apart.columns))


def with_additions(apart: DataFrame, t: Fraction) -> DataFrame:
    """The rows of :func:`promising` that can have a partner, ``new``, what of a class's additions is open, and ``q``.

    ``q`` is what a class can have in common with a partner: what it shares with the
    pivot, and its open additions. Where that is too little, or where these and all
    that the pivot alone has are fewer than a partner shares, no partner is left, and
    what the pivot alone has need not be counted for the class.
    """
    fresh = apart.select("pivot", "set_key", "label", F.explode(F.slice("tokens", F.lit(1), F.col("added").cast("int"))).alias("token"))
    new = fresh.join(open_differences(fresh), ["pivot", "token"]).groupBy("pivot", "set_key").agg(F.collect_list(F.struct("token", "df")).alias("new"))
    both = apart.join(new, ["pivot", "set_key"], "left").withColumn("new", F.coalesce("new", F.array().cast("array<struct<token:bigint,df:bigint>>")))
    both = both.withColumn("q", F.col("n") - F.col("added") + F.size("new"))
    return both.where((F.col("q") * t.denominator >= F.col("n") * t.numerator) & (F.col("d") - F.col("added") + F.size("new") >= F.col("o")))


def first_differences(apart: DataFrame, t: Fraction) -> DataFrame:
    """``pivot, set_key, n, label, d, o, q, k, token, df, r``: each class's prefix of open differences, rarest first.

    ``k`` counts a class's open differences and ``q`` what it can have in common with a
    partner; classes that have too few are left out. What only the pivot has is counted
    once for each of its tokens, for the classes that :func:`with_additions` leaves, and
    the counts go to its classes as one array, no longer than the pivot's text.
    """

    def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, o = (batch.column(c).to_numpy() for c in ("added", "o"))
            (at, all_), (at_new, new), (_, new_df), (at_old, old), (_, old_df) = (lists(batch.column(c)) for c in ("tokens", "new", "new_df", "old", "old_df"))
            rows, sizes, tokens, counts, ranks = [], [], [], [], []
            for i in range(batch.num_rows):
                fresh = slice(at_new[i], at_new[i + 1])
                known = slice(at_old[i], at_old[i + 1])
                _, _, place = np.intersect1d(all_[at[i] + added[i] : at[i + 1]], old[known], assume_unique=True, return_indices=True)
                token, df = np.concatenate([new[fresh], old[known][place]]), np.concatenate([new_df[fresh], old_df[known][place]])
                k = len(token)
                if k < o[i]:
                    continue
                best = np.lexsort((token, df))[: k - o[i] + 2]
                rows.append(np.full(len(best), i))
                sizes.append(np.full(len(best), k))
                tokens.append(token[best])
                counts.append(df[best])
                ranks.append(np.arange(1, len(best) + 1))
            of, k, token, df, r = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, sizes, tokens, counts, ranks))
            own = batch.select(["pivot", "set_key", "n", "label", "d", "o", "q"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, (k, token, df, r))], names=[*own.schema.names, "k", "token", "df", "r"])

    left = materialize(with_additions(apart, t), "jaccard-left")
    added = F.col("added").cast("int")
    # Slices start inside the array, so rows without such tokens are left out first.
    lacked = left.where("d > added").select("pivot", "label", F.explode(F.slice("tokens", added + 1, (F.col("d") - F.col("added")).cast("int"))).alias("token"))
    old = open_differences(lacked).groupBy("pivot").agg(F.collect_list(F.struct("token", "df")).alias("old"))
    both = left.join(old, "pivot", "left").withColumn("old", F.coalesce("old", F.array().cast("array<struct<token:bigint,df:bigint>>")))
    wide = both.select("pivot", "set_key", "n", "label", "added", "d", "o", "q", "tokens", F.col("new.token").alias("new"), F.col("new.df").alias("new_df"), F.col("old.token").alias("old"), F.col("old.df").alias("old_df"))
    return wide.mapInArrow(choose, "pivot long, set_key long, n long, label long, d long, o long, q long, k long, token long, df long, r long")


def frequent_pairs(placed: DataFrame, centres: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """``a, b``: pairs across components that share a frequent token, by their differences from its pivot."""
    # What is here shares no rare token, hence so many frequent ones that one is among the first of each, in any one order.
    own = W.partitionBy("set_key")
    often = placed.where(F.col("df") > RARE).withColumn("f", F.count("*").over(own)).where(F.col("f") >= need(F.col("n"), t))
    # Tokens of the pivots that most classes meet go first, so a class meets few pivots. A pivot's tokens are no more than its prefix.
    heads = placed.where(F.col("df") > RARE).select("token", "df").distinct().join(centres, "token")
    heads = heads.withColumn("met", F.sum("df").over(W.partitionBy("pivot"))).select("token", "pivot", "m", "met")
    often = often.join(heads, "token").withColumn("r", F.row_number().over(own.orderBy(F.desc("met"), "pivot", "token"))).where(F.col("r") <= F.col("f") - need(F.col("n"), t) + 1)
    members = often.select("pivot", "m", "set_key", "n", "label").where("pivot <> set_key").distinct()
    apart = promising(materialize(differences(members, sets), "jaccard-differences"), t).withColumn("o", least_shared(F.col("d"), F.col("n"), F.col("m"), t))
    chosen = materialize(first_differences(materialize(apart, "jaccard-apart"), t), "jaccard-chosen")
    # A key is a pair's first common one somewhere; from there on it has ``s`` differences in common at most.
    own = ["set_key", "n", "d", "q", "label"]
    # A class that shares two of its prefix with any partner meets those of its kind by two; if it may share just one, it meets all by one.
    one = (F.col("df") <= RARE_DIFFERENCE) | (F.col("o") < 2)
    single = chosen.select(F.xxhash64("pivot", "token").alias("key"), *own, (F.col("k") - F.col("r") + 1).alias("s"), one.alias("one"))
    frequent = chosen.where(~one)
    other = frequent.select("pivot", "set_key", F.col("token").alias("token2"), F.col("r").alias("r2"))
    combined = frequent.join(other, ["pivot", "set_key"]).where("token < token2").select(F.xxhash64("pivot", "token", "token2").alias("key"), *own, (F.col("k") - F.greatest("r", "r2") + 2).alias("s"), F.lit(True).alias("one"))
    index = single.union(combined)
    alone = index.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("one").alias("any")).where("l0 <> l1 AND any").select("key")
    index = materialize(index.join(alone, "key"), "jaccard-index")
    right = index.select("key", F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("s").alias("sb"), F.col("q").alias("qb"), F.col("label").alias("lb"))
    could = (F.col("set_key") != F.col("b")) & (F.col("label") != F.col("lb")) & fits(F.col("n"), F.col("nb"), t)
    could = could & overlap_of_differences(F.col("d"), F.col("db"), F.col("n"), F.col("nb"), F.least("s", "sb"), t) & similar(F.least("q", "qb"), F.col("n"), F.col("nb"), t)
    return index.where("one").join(right, "key").where(could).select(F.least("set_key", "b").alias("a"), F.greatest("set_key", "b").alias("b")).distinct()


def across(entries: DataFrame, labels: DataFrame, centres: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Every pair across components that can be similar enough."""
    counted = open_entries(entries, labels).select("token", "set_key", "n", "label", "df")
    enough = counted.groupBy("set_key", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need(F.col("n"), t)).select("set_key")
    placed = materialize(counted.join(enough, "set_key"), "jaccard-open")
    return materialize(rare_pairs(placed, t), "jaccard-rare").union(frequent_pairs(placed, centres, sets, t)).distinct()


def labelled_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Fraction = THRESHOLD, k: int = K) -> DataFrame:
    """``__id, text_hash, n, label`` for each row; rows with words are one group if their labels are equal."""
    wide = materialize(set_table(df, id_col, text_col, t, k), "jaccard-sets")
    once = supported(wide.where(F.size("tokens") > 0).select("set_key", "n", F.explode("tokens").alias("token")), t, "jaccard-1")
    table = materialize(wide.drop("tokens"), "jaccard-rows")
    release(wide)
    entries = supported(once, t, "jaccard-2")
    release(once)
    classes = entries.select("set_key").distinct()
    wanted = table.join(classes, "set_key", "left_semi").groupBy("set_key").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
    sets = materialize(whole_sets(df, wanted, text_col, k), "jaccard-grams")

    labels = df.sparkSession.createDataFrame([], "node long, label long")
    links = tested = df.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(STAR_ROUNDS):
        held = materialize(open_entries(entries, labels).select("token", "set_key", "n", "k"), "jaccard-held") if turn else entries
        heads = pivots(held, turn, t)
        centres = centres if turn else heads
        met = stars(held, heads, labels, t)
        met = materialize(met.join(tested, ["a", "b"], "left_anti") if turn else met, "jaccard-pairs")
        links, tested = links.union(materialize(verify(met, sets, t), "jaccard-links")), tested.union(met)
        labels = components(links, "jaccard")
    more = materialize(across(entries, labels, centres, sets, t).join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
    found = materialize(verify(more, sets, t), "jaccard-links")
    if not found.isEmpty():
        labels = components(links.union(found), "jaccard")
    return labelled(table.select("__id", "text_hash", "n", "set_key"), labels).drop("set_key")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: Fraction = THRESHOLD, k: int = K) -> DataFrame:
    """``id, n_shingles, component_id`` for each row."""
    placed = labelled_rows(df, id_col, text_col, t, k)
    # A group may hold a third of all rows, so its id goes out to several salts.
    least = placed.where("n > 0").groupBy("label").agg(F.min("__id").alias("component_id"))
    least = least.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = placed.where("n > 0").withColumn("__salt", F.pmod(F.xxhash64("__id", "text_hash"), F.lit(SALTS)).cast("int"))
    empty = placed.where("n = 0").select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.col("__id").alias("component_id"))
    full = dealt.join(least, ["label", "__salt"]).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns, and every row whose text has no words.

    It is the row of the least id (null ids last), then of the least hash of its text;
    of rows that are alike in both, the one of the least hash of all columns.
    """
    placed = labelled_rows(df, id_col, text_col)
    alike = placed.where("n > 0").groupBy("label", "__id", "text_hash").agg(F.count("*").alias("copies"))
    first = alike.groupBy("label").agg(F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "text_hash", "copies")).alias("f"))
    empty = placed.where("n = 0").select("__id", "text_hash", F.lit(1).cast("long").alias("copies")).distinct()
    keys = materialize(first.select("f.__id", "f.text_hash", "f.copies").union(empty), "jaccard-kept")
    # The rows go as structs, as their columns may have any names.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__own"), F.xxhash64(text_or_empty(text_col)).alias("__hash"))
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("text_hash"))
    kept = rows.join(keys.where("copies = 1").select("__id", "text_hash"), same, "left_semi").select("__row.*")
    repeated = keys.where("copies > 1").select("__id", "text_hash")
    if repeated.isEmpty():
        return kept
    order = F.xxhash64(*[F.col(f"__row.`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    one = rows.join(repeated, same).groupBy("__id", "text_hash").agg(F.min_by("__row", order).alias("__row"))
    return kept.union(one.select("__row.*"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))

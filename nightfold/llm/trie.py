"""The prefix trie of rebuilt conversations, from composable fingerprints.

A conversation is rebuilt from the head of its family's first conversation and its own later turns. Texts are never
put together for that: a sequence of turns has the fingerprint (length, sum of x_k B^k), x_k a hash of turn k, and these
form a monoid: (l, s) (l', s') = (l + l', s + B^l s'). The fingerprint of every rebuilt prefix is the head's, combined with
that of a range of own turns, which is a difference of two prefix sums. Sums are taken modulo three primes. They are
built blockwise by the same law, so that a conversation of any length is spread over tasks.

Equal fingerprints of equal length form a node. Every member row refers to a stored turn, its last, and to its parent's
fingerprint; a node whose members do not all agree in both, or two different texts behind one turn hash, are found, and all is
done again with another base. So equality is verified, not assumed, turn by turn from the root.

Sums over subtrees become sums over members: a leaf counts for its smallest member, a node's savings are put down to
its smallest member, and both are added up over the members of each node, so no level-by-level walk is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from nightfold.llm.common import shuffle_partitions, stored

FAMILY = 100  # conversations that share the head of their first
HEADS = 6  # heads have fewer turns than this
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_000_003, 998_244_353, 1_234_567_891, 777_777_773)
ENDS = 500  # ids of one node that are put together before they are shuffled
BLOCK = 1024  # depths of a conversation that are summed up in one window


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _powers(base: int) -> Callable[[Column], Column]:
    """base^k modulo each prime, as an array, of whole numbers k >= 0."""

    @F.pandas_udf("array<long>")
    def power(k: pd.Series) -> pd.Series:
        out = []
        for p in PRIMES:
            left, square, value = k.to_numpy(np.int64).copy(), base % p, np.ones(len(k), np.int64)
            while left.any():
                value = np.where(left & 1, value * square % p, value)
                square, left = square * square % p, left >> 1
            out.append(value)
        return pd.Series(list(np.stack(out, axis=1)))

    return power


def _sum_mod(c: str, over=None) -> list[Column]:
    """Sums of the array column `c`, prime by prime: fewer than 2^32 values below 2^31 fit a long."""
    return [F.sum(F.col(c)[i]) if over is None else F.coalesce(F.sum(F.col(c)[i]).over(over), F.lit(0)) for i in range(len(PRIMES))]


def _mod(parts: Sequence[Column]) -> Column:
    return F.array(*[F.pmod(x, F.lit(p)) for x, p in zip(parts, PRIMES)])


def _plus(a: str | Column, b: str | Column, times: Column | None = None) -> Column:
    """a + times * b, prime by prime."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return _mod([a[i] + (b[i] if times is None else times[i] * b[i] % p) for i, p in enumerate(PRIMES)])


def _slim(conversations: DataFrame, seed: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(seed), role, text).alias("h"), F.xxhash64(F.lit(~seed), text, role).alias("g"),
    )


def numbered_turns(slim: DataFrame, base: int) -> DataFrame:
    """(conv_id, i, h, g, chars, before, upto), stored: turns 1, 2, ... of every conversation, and the fingerprints' sums of
    the turns before it and up to it.

    Turns are cut into ranges by (conversation, turn); ranges are numbered and summed up by themselves, then shifted by
    what is before them in their conversation.
    """
    spark, order = slim.sparkSession, [F.asc_nulls_first("turn"), F.asc("role"), F.asc("h"), F.asc("g")]
    rows = slim.select("conv_id", "turn", "role", "h", "g", F.length("text").cast("long").alias("chars"))
    ranged = stored(rows.repartitionByRange(shuffle_partitions(spark), F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    inside = W.partitionBy("conv_id", "part").orderBy(*order)
    power = _powers(base)
    local = ranged.select("conv_id", "part", "h", "g", "chars", F.row_number().over(inside).cast("long").alias("k"))
    term = _mod([F.pmod(F.col("h"), F.lit(PRIMES[0])), F.pmod(F.col("g"), F.lit(PRIMES[1])), F.pmod(F.col("h").bitwiseXOR(F.col("g")), F.lit(PRIMES[2]))])
    local = local.withColumn("x", term).withColumn("x", _plus(F.array(*[F.lit(0).cast("long")] * len(PRIMES)), "x", power("k")))
    local = stored(local, "terms")
    totals = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"), _mod(_sum_mod("x")).alias("s"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    totals = totals.withColumn("l", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("shift", power("l"))
    totals = totals.withColumn("s", _plus(F.array(*[F.lit(0).cast("long")] * len(PRIMES)), "s", F.col("shift")))
    totals = totals.withColumn("s", _mod(_sum_mod("s", earlier))).select("conv_id", "part", "l", "s", "shift")
    upto = W.partitionBy("conv_id", "part").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = local.withColumn("local", _mod(_sum_mod("x", upto))).join(totals, ["conv_id", "part"])
    summed = summed.withColumn("upto", _plus("s", "local", F.col("shift"))).withColumn("own", _mod([F.col("shift")[i] * F.col("x")[i] for i in range(len(PRIMES))]))
    before = _mod([F.col("upto")[i] - F.col("own")[i] for i in range(len(PRIMES))])
    return stored(summed.select("conv_id", (F.col("l") + F.col("k")).alias("i"), "h", "g", "chars", before.alias("before"), "upto"), "numbered")


def member_rows(turns: DataFrame, base: int) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, h, g, chars, ends), stored: one row per rebuilt conversation and prefix of it, the
    empty one included. (a, b): the prefix's fingerprint; (pa, pb): its parent's; h, g, chars: its last turn's;
    ends: nothing follows."""
    family, h = F.col("conv_id") - F.col("conv_id") % FAMILY, head_length(F.col("conv_id"))
    size = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    last = F.struct("i", "h", "g", "chars", "before", "upto")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEADS)).groupBy("conv_id").agg(F.array_sort(F.collect_list(last)).alias("head"))  # HEADS - 1 turns at most
    own = turns.where(F.col("i") == h).select("conv_id", F.col("upto").alias("cut"))
    zero = F.array(*[F.lit(0).cast("long")] * len(PRIMES))
    plan = size.withColumn("family", family).withColumn("h", h).join(heads.withColumnRenamed("conv_id", "family"), "family", "left").join(own, "conv_id", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    plan = plan.withColumn("taken", F.size("head")).withColumn("depths", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    plan = plan.withColumn("head_sum", F.coalesce(F.try_element_at("head", F.lit(-1))["upto"], zero)).withColumn("cut", F.coalesce("cut", zero))
    # B^(taken - h): the family's head may be shorter than what its place in the conversation's own turns.
    inverse = F.array(*[F.array(*[F.lit(pow(base, -k, p)) for p in PRIMES]) for k in range(HEADS)])
    plan = stored(plan.withColumn("shift", F.get(inverse, F.col("h") - F.col("taken"))), "plan")

    first = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("chars"), zero.alias("before"), zero.alias("upto"))
    early = plan.select("conv_id", "depths", F.inline(F.concat(F.array(first), F.col("head"))))
    early = early.select("conv_id", F.col("i").alias("depth"), F.col("upto").alias("now"), F.col("before").alias("was"), "h", "g", "chars", "depths")
    mine = turns.withColumn("own_h", h).where(F.col("i") > F.col("own_h")).join(plan.select("conv_id", "taken", "cut", "head_sum", "shift", "depths"), "conv_id")
    combined = lambda c: _plus("head_sum", _mod([F.col(c)[i] - F.col("cut")[i] for i in range(len(PRIMES))]), F.col("shift"))
    late = mine.select("conv_id", (F.col("taken") + F.col("i") - F.col("own_h")).alias("depth"), combined("upto").alias("now"), combined("before").alias("was"), "h", "g", "chars", "depths")
    a, b = (lambda c: F.shiftleft(F.col(c)[0], 31).bitwiseOR(F.col(c)[1])), (lambda c: F.col(c)[2])
    rows = early.unionByName(late)
    return stored(rows.select("conv_id", "depth", a("now").alias("a"), b("now").alias("b"), a("was").alias("pa"), b("was").alias("pb"), "h", "g", "chars", (F.col("depth") == F.col("depths")).alias("ends")), "members")


NODE = ["depth", "a", "b"]


def nodes_of(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Nodes (NODE, conv_id, n_convs, n_ends, pa, pb, chars), stored, and whether all members of each agree."""
    same = ["pa", "pb", "h", "g", "chars"]
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"max_{c}") for c in same],
    )
    nodes = stored(nodes, "nodes")
    differs = F.lit(False)
    for c in same:
        differs = differs | (F.col(c) != F.col(f"max_{c}"))
    return nodes.select(*NODE, "conv_id", "n_convs", "n_ends", "pa", "pb", "chars"), nodes.where(differs).isEmpty()


def one_text_each(slim: DataFrame) -> bool:
    """Whether turns with equal hashes have equal roles and texts. Only texts whose hash occurs again are compared, and
    copies are combined where they lie."""
    again = stored(slim.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "again")
    texts = slim.join(again, ["h", "g"], "left_semi").groupBy("h", "g").agg(*[f(c).alias(f"{k}_{c}") for c in ("role", "text") for k, f in (("a", F.min), ("z", F.max))])
    return texts.where("a_role != z_role or a_text != z_text").isEmpty()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of nodes, ENDS of one node at a time as text."""
    key, first, ids = None, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "a": [key[1]], "b": [key[2]], "first": [first], "ids": [",".join(ids).encode()]})

    for batch in batches:
        for d, a, b, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if key != (d, a, b) or len(ids) == ENDS:
                if ids:
                    yield out()
                key, first, ids = (d, a, b), c, []
            ids.append(str(c))
    if ids:
        yield out()


def _hash_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose texts come one after another; only one of them is held."""
    key, digest = None, None
    names = ["depth", "a", "b", "ends_sha256"]
    for batch in batches:
        done = []
        for d, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if key == (d, a, b):
                digest.update(b"," + ids)
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (d, a, b), hashlib.sha256(ids)
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))
    if key:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, (*key, digest.hexdigest()))})


def end_digests(rows: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of the nodes at which conversations end. A hot node's ids are put together in ranges of the
    sorted ids; its hash, which must go through all of them in turn, then reads one row for every ENDS of them."""
    ends = rows.where("ends").select(*NODE, "conv_id")
    n = shuffle_partitions(rows.sparkSession)
    parts = ends.repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_together, "depth long, a long, b long, first long, ids binary")
    # Two ranges may share a node, so its texts are told apart by their first ids.
    return parts.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hash_on, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bases: Sequence[int] = BASES) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (code points), ends_sha256.

    Null roles and texts are empty; turns go by number, null first, equal numbers by role and then by hash, so repeated
    rows are repeated turns. Rows without conv_id belong to no conversation; a conversation is one that has a row, so an
    empty table has no node, not even the root. Other columns are not read.
    """
    for base in bases:
        slim = _slim(conversations, base, conv_col, turn_col, role_col, text_col)
        rows = member_rows(numbered_turns(slim, base), base)
        nodes, agree = nodes_of(rows)
        if agree and one_text_each(slim):
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes are equal for each of {len(bases)} bases")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").fillna(0, ["n_children"]).withColumn("saved", (F.col("n_convs") - 1) * F.when(F.col("depth") > 0, F.col("chars")).otherwise(0)), "children")

    # What each conversation stands for: the leaf of which it is the smallest member, and the savings of such nodes.
    stands = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")).where("all_saved > 0 or leaves > 0")
    sums = rows.select("conv_id", *NODE).join(stands, "conv_id").groupBy(*NODE).agg(F.sum("all_saved").alias("all_saved"), F.sum("leaves").alias("n_leaves"))
    # The smallest member of a node also stands for nodes above it, which are not in the subtree: those are taken off.
    cells = nodes.where("n_convs > 1").withColumn("block", F.floor(F.col("depth") / BLOCK))
    upto = lambda *keys: W.partitionBy("conv_id", *keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    blocks = cells.groupBy("conv_id", "block").agg(F.sum("saved").alias("s")).select("conv_id", "block", F.coalesce(F.sum("s").over(upto("block")), F.lit(0)).alias("earlier"))
    inside = cells.withColumn("above", F.coalesce(F.sum("saved").over(upto("block", "depth")), F.lit(0))).join(blocks, ["conv_id", "block"])
    above = inside.select(*NODE, (F.col("above") + F.col("earlier")).alias("above"))

    out = nodes.join(sums, NODE, "left").join(above, NODE, "left").join(end_digests(rows), NODE, "left")
    # Where one conversation is alone, all below is a single chain that saves nothing.
    shared = F.col("n_convs") > 1
    out = out.withColumn("n_leaves", F.when(shared, F.col("n_leaves")).otherwise(1)).withColumn("saved_tokens", F.when(shared, F.col("all_saved") - F.col("above")).otherwise(0))
    parents = nodes.where("n_children > 0").select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    linked = out.join(parents, (F.col("depth") == F.col("p_depth") + 1) & (F.col("pa") == F.col("p_a")) & (F.col("pb") == F.col("p_b")), "left")
    number = lambda c: F.col(c).cast("long").alias(c)
    return linked.select("conv_id", "depth", "parent_conv_id", *map(number, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

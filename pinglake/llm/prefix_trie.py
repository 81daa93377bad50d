"""Conversation prefix trie, rolled up by depth bands.

A node is a distinct sequence of first turns. It is known by its depth and 128 bits: the exclusive
or of two 64-bit hashes of every turn with its place, so a prefix's bits are a running value and a
parent's bits need no join. (Two different prefixes of 10^12 meet with a probability below 10^-14.)

Subtree totals: depths are cut into bands of ``HEIGHT``. A node hands its values only to its
ancestors within its band, so it becomes at most ``HEIGHT`` rows, summed before they are shuffled.
The totals of band roots complete each other in the same way, one level up, where the roots of all
bands are themselves a trie that is ``HEIGHT`` times lower; so depth D takes log(D) rounds. The
completed total of a band root is then added at its parent, which hands it on within its band.

No task holds a conversation or the conversations of a node: rows are dealt by ranges of
(conversation, turn), and of (node, conversation) for the digests of conversations that end at
a node, whose ids are joined to one string per range; the digest itself reads these strings in order.

Defined cases: a null role or text is empty; rows of a conversation with equal turns are ordered by
role, then text; turn null is first; rows without conv_id belong to no conversation and are left
out; conversations of any length are taken whole; an empty table has no nodes, not even a root;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, ship

HEIGHT = 4
# Rebuilding: ids of a hundred share the first turns of their first; fewer than HEADS of them.
FAMILY, HEADS = 100, 6


def by_ranges(df: DataFrame, order: list, out: str = "_range") -> DataFrame:
    """Rows dealt to tasks by ranges of ``order`` and stored, with the number of their range.

    A key with many rows covers several ranges; equal rows are told apart by where they were read.
    """
    at = F.monotonically_increasing_id()
    d = df.withColumn("_at", at).repartitionByRange(*order, "_at").withColumn(out, F.spark_partition_id())
    return cut(d.drop("_at"), "ranges")


def positions(df: DataFrame, key: str, order: list, out: str) -> DataFrame:
    """Position of each row within its key, from 0; ``order`` begins with the key."""
    d = by_ranges(df, order)
    before = d.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(key, "_range").orderBy(*order[1:])
    return d.withColumn("_rn", F.row_number().over(w)).join(before, [key, "_range"]).withColumn(out, F.col("_before") + F.col("_rn") - 1).drop("_rn", "_before", "_range")


def ordered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): turns in order, null first, equal ones by role and text."""
    d = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # Spark sorts nulls first when ascending.
    return positions(d.where(F.col("conv_id").isNotNull()), "conv_id", ["conv_id", "turn", "role", "text"], "pos").select("conv_id", "pos", "role", "text")


def _turn(place: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its place."""
    return [F.xxhash64(F.lit(seed), place, "role", F.length("role"), "text").alias(n) for seed, n in ((11, "x"), (23, "y"))]


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n turns) and their rebuilt turns (conv_id, d from 1, x, y, chars).

    The first turns are those of the family's first conversation, as many as the id's checksum says.
    """
    n_own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % family
    convs = n_own.select("conv_id", "n_own", base.alias("base"), head.alias("h"))
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    n_base = first.groupBy("base").agg(F.count("*").alias("n_base"))
    convs = convs.join(n_base, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    # A family has at most `family` members, or twice as many around zero, so no base is hot.
    shared = convs.where("shared > 0").join(first, "base").where("pos < shared").select("conv_id", (F.col("pos") + 1).alias("d"), "role", "text")
    own = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("shared") + F.col("pos") - F.col("h") + 1).alias("d"), "role", "text")
    whole = shared.unionByName(own).select("conv_id", "d", *_turn(F.col("d")), F.length("text").cast("long").alias("chars"))
    return convs.select("conv_id", "n"), whole


def _id(d: Column, x: Column, y: Column) -> Column:
    return F.struct(d.cast("long").alias("d"), x.alias("x"), y.alias("y"))


def paths(convs: DataFrame, turns: DataFrame, rows: int = 65536) -> DataFrame:
    """(conv_id, n, d, node, parent, chars): the nodes every conversation passes, root included."""
    t = turns.withColumn("_block", F.floor(F.col("d") / rows))
    # Running values: within blocks of turns, and over one row per block.
    carry = t.groupBy("conv_id", "_block").agg(F.bit_xor("x").alias("_x"), F.bit_xor("y").alias("_y"))
    past = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("conv_id", "_block", *[F.coalesce(F.bit_xor(c).over(past), F.lit(0).cast("long")).alias(c) for c in ("_x", "_y")])
    up = Window.partitionBy("conv_id", "_block").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.join(carry, ["conv_id", "_block"]).withColumns({f"p{c}": F.bit_xor(c).over(up).bitwiseXOR(F.col(f"_{c}")) for c in ("x", "y")})
    parent = _id(F.col("d") - 1, F.col("px").bitwiseXOR(F.col("x")), F.col("py").bitwiseXOR(F.col("y")))
    t = t.join(convs, "conv_id").select("conv_id", "n", F.col("d").cast("long").alias("d"), _id(F.col("d"), F.col("px"), F.col("py")).alias("node"), parent.alias("parent"), "chars")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", "n", zero.alias("d"), _id(zero, zero, zero).alias("node"), zero.alias("chars"))
    return t.unionByName(root, allowMissingColumns=True)


def subtree_totals(path: DataFrame, values: DataFrame, names: list[str], height: int = HEIGHT) -> DataFrame:
    """(node, one total over its subtree for each of ``names``).

    ``path``: (conv_id, d, node, parent), the nodes that conversations pass from the root (d 0)
    down, gapless; ``values``: (node, names).
    """
    band = Window.partitionBy("conv_id", F.floor(F.col("d") / height)).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = path.select("conv_id", "d", "node", "parent", F.collect_list("node").over(band).alias("up"))
    # All conversations through a node have the same way there; any will do.
    nodes = cut(steps.groupBy("node").agg(F.max("d").alias("d"), F.any_value("parent").alias("parent"), F.any_value("up").alias("up")).join(values, "node"), "bands")
    if nodes.where(F.col("d") >= height).isEmpty():
        own = nodes.select("up", *names)
    else:
        within = nodes.groupBy(F.get("up", F.lit(0)).alias("node")).agg(*[F.sum(c).alias(c) for c in names])
        # The next level: band roots, whose parent is the root of the band above.
        tops = steps.select("conv_id", "d", "node", F.get("up", F.lit(0)).alias("top"))
        roots = tops.where(F.col("d") % height == 0).select("conv_id", "d", "node")
        above = tops.where(F.col("d") % height == height - 1).select("conv_id", (F.col("d") + 1).alias("d"), F.col("top").alias("parent"))
        level = roots.join(above, ["conv_id", "d"], "left").withColumn("d", F.floor(F.col("d") / height))
        done = subtree_totals(cut(level, "band-roots"), within, names, height)
        hung = nodes.where((F.col("d") > 0) & (F.col("d") % height == 0)).select("node", "parent").join(done, "node")
        added = hung.groupBy(F.col("parent").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in names])
        own = nodes.join(added, "node", "left").select("up", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in names])
    return own.select(F.explode("up").alias("node"), *names).groupBy("node").agg(*[F.sum(c).alias(c) for c in names])


def ending_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): digest of the ids that end at each node, ascending, joined by commas."""
    d = by_ranges(ends.select("node", "conv_id"), ["node", "conv_id"])
    joined = d.groupBy("node", "_range").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))
    # Ranges of a node, in order, in one task: one string for each, read one after the other.
    dealt = joined.select(F.to_json("node").alias("node"), "_range", F.encode("ids", "UTF-8").alias("ids")).repartition("node").sortWithinPartitions("node", "_range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            done = []
            for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if node != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    out = dealt.mapInArrow(run, "node string, ends_sha256 string")
    return out.select(F.from_json("node", "d long, x long, y long").alias("node"), "ends_sha256")


def trie(path: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: smallest member, depth, parent's smallest member, members, children, leaves, saved tokens, digest of the members that end there."""
    path = cut(path, "paths")
    nodes = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("parent").alias("parent"), F.max("chars").alias("chars"))
    nodes = cut(nodes, "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    values = nodes.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(path.select("conv_id", "d", "node", "parent"), values, ["n_leaves", "saved_tokens"], height)
    facts = cut(totals.join(ending_digests(path.where("d = n")), "node", "left"), "totals")
    # The parent's row is unique but may be asked for by a third of all nodes: plain joins of stored tables, which adaptive execution splits.
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = cut(nodes.join(parents, "parent", "left"), "named")
    return named.join(facts, "node").select(
        "conv_id", F.col("node.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = rebuilt(cut(ordered_turns(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")), "turns"))
    return trie(paths(convs, turns))


# The checksum of an id's decimal text is CRC-32, one bit at a time. A node is the list of its
# turns; subtree totals go from every node to all its prefixes.
SQL = """
with turns as (
  select conv_id, struct_pack(r := coalesce(role, ''), t := coalesce("text", '')) as x,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as pos
  from conversations where conv_id is not null
), own as (
  select conv_id, list(x order by pos) as xs,
         (4294967295 - list_reduce(
            list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))) % 6 as h
  from turns group by conv_id
), whole as (
  select o.conv_id, list_concat(coalesce(b.xs[1:o.h], []), o.xs[o.h + 1:]) as xs
  from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100
), path as (
  select conv_id, len(xs) as n, d, xs[1:d] as node, coalesce(length(xs[d].t), 0) as chars
  from (select conv_id, xs, unnest(range(len(xs) + 1)) as d from whole)
), nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends_sha256
  from path group by node, d
), children as (
  select node[1:d - 1] as node, count(*) as n_children from nodes where d > 0 group by 1
), facts as (
  select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c on c.node = n.node
), totals as (
  select node, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
  from (select node[1:k] as node, leaf, saved
        from (select node, (n_children = 0)::bigint as leaf, (n_convs - 1) * chars as saved, unnest(range(d + 1)) as k from facts))
  group by node
)
select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, t.n_leaves, t.saved_tokens, f.ends_sha256
from facts f join totals t on t.node = f.node left join nodes p on f.d > 0 and p.node = f.node[1:f.d - 1]
"""

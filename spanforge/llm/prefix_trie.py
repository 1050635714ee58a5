"""Prefix trie of conversations as a z-fast trie.

A conversation is a sequence of turns (role, text).  A turn is known by 128 bits of hash,
a prefix by its depth and the exclusive or of its turns' hashes, each mixed with its
depth.  Equal conversations are one *class*.  The trie over the classes is compacted: a
node is an edge ``(up, depth]`` below its parent's depth, read along one class (``rep``).

A node's *handle* is its prefix at the two-fattest depth of its edge (the one divisible by
the highest power of two).  A dictionary of handles lets a class find its exit node by
fat binary search: it looks up its prefix at the two-fattest depth of what is left, goes on
below the node found, or above that depth if there is none.  The child that shares its next
turn, and the depth up to which they agree, give the exit.  Classes are inserted in
batches: in a round all open classes search; exits split edges; of the classes that leave
at one point by the same turn one (drawn by hash) becomes a leaf, the others search again.
Such a draw halves what is left on average, so the rounds grow with the logarithm of the classes.

Figures of subtrees are added up by pointer doubling over the compacted nodes; then edges
are expanded to one row a depth.  The list of ids that end at a node is sorted by range
partitions, joined in chunks and hashed chunk by chunk, never held as a whole.

All steps are joins, sums and windows over at most ``SPAN`` turns; a conversation may have
any length and any number of copies.  Nothing but row counts and the greatest length
reaches the driver.

Defined results: rows without a conv_id belong to no conversation; a null role or text is
an empty one; null turns come first; turns that tie are in the order of their hashes, and
repeated rows are turns each.  No conversations give no nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..blocks import positions
from .common import read, shared_folder, written

#: turns that a window orders together
SPAN = 1024
#: ids joined to one text before hashing
CHUNK = 4096
#: search steps between two written tables
STEPS = 5
SALT = 7_919
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _fattest(lo: str, hi: str) -> str:
    """The number in (lo, hi] that the highest power of two divides."""
    high = f"(length(bin({lo} ^ {hi})) - 1)"
    return f"shiftleft(shiftright({hi}, {high}), {high})"


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, size`` of each turn: place in the conversation from 1, hash, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    x = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(SALT), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    shared_folder(rows.sparkSession)
    x = written(positions(x, ["conv_id", "turn", "a", "b", "row"]))
    first = x.groupBy("conv_id").agg(F.min("__i").alias("first"))
    return x.join(first, "conv_id").select("conv_id", (F.col("__i") - F.col("first") + 1).cast("long").alias("depth"), "a", "b", "size")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, upto, own``: hash and bytes of the prefix that ends with each turn, and the turn's bytes."""
    mixed = [F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64(F.lit(SALT), "b", "depth", "a").alias("b")]
    x = written(turns.select("conv_id", "depth", *mixed, "size", F.expr(f"(depth - 1) div {SPAN}").alias("part")))
    inside = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = x.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a0"), F.bit_xor("b").alias("b0"), F.sum("size").alias("s0"))
    parts = parts.select("conv_id", "part", *[F.coalesce(f.over(before), F.lit(0)).alias(n) for f, n in ((F.bit_xor("a0"), "a0"), (F.bit_xor("b0"), "b0"), (F.sum("s0"), "s0"))])
    x = x.select("conv_id", "part", "depth", F.bit_xor("a").over(inside).alias("a"), F.bit_xor("b").over(inside).alias("b"), F.sum("size").over(inside).alias("upto"), F.col("size").alias("own"))
    return x.join(parts, ["conv_id", "part"]).select("conv_id", "depth", F.expr("a ^ a0").alias("a"), F.expr("b ^ b0").alias("b"), (F.col("upto") + F.col("s0")).alias("upto"), "own")


def _at(df: DataFrame, paths: DataFrame, rep: str, depth: str, names: tuple[str, str], how: str = "left") -> DataFrame:
    """Add the prefix hash of class ``rep`` at ``depth``; depth 0 has the hash 0, 0."""
    side = paths.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    got = df.join(side, (F.col(rep) == F.col("_c")) & (F.col(depth) == F.col("_d")), how)
    zero = F.col(depth) == 0
    return got.withColumns({n: F.when(zero, 0).otherwise(F.col(c)) for n, c in zip(names, ("_a", "_b"), strict=True)}).drop("_c", "_d", "_a", "_b")


class ZFastTrie:
    """Compacted trie over classes of conversations.

    ``nodes``: rep, up, depth, and the prefix hashes at the handle (f, ha, hb) and at the first turn of the edge (ca, cb).
    """

    def __init__(self, paths: DataFrame, longest: int):
        self.paths, self.longest = paths, longest
        self.nodes: DataFrame | None = None

    def keyed(self, edges: DataFrame) -> DataFrame:
        """Edges ``rep, up, depth`` with their dictionary keys."""
        x = edges.withColumn("f", F.expr(_fattest("up", "depth"))).withColumn("next", F.col("up") + 1)
        return _at(_at(x, self.paths, "rep", "f", ("ha", "hb")), self.paths, "rep", "next", ("ca", "cb")).drop("next")

    def search(self, classes: DataFrame) -> DataFrame:
        """Exit of each class ``x, size``: the node (t_rep, t_up, t_depth; null: the root), the depth ``l`` of agreement, and the prefix hash (na, nb) one deeper."""
        node = ["t_rep", "t_up", "t_depth"]
        if self.nodes is None:
            s = classes.withColumns({n: F.lit(None).cast("long") for n in node}).withColumn("l", F.lit(0).cast("long"))
        else:
            handles = self.nodes.select(F.col("f").alias("f_"), "ha", "hb", F.col("rep").alias("h_rep"), F.col("up").alias("h_up"), F.col("depth").alias("h_depth"))
            s = classes.withColumns({n: F.lit(None).cast("long") for n in ("t_rep", "t_up", "t_depth")})
            s = s.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("size"), "seen": F.lit(0).cast("long")})
            for k in range(self.longest.bit_length() + 1):
                s = s.withColumn("f", F.expr(f"case when lo < hi then {_fattest('lo', 'hi')} end"))
                s = _at(s, self.paths, "x", "f", ("a", "b"))
                s = s.withColumn("key", F.coalesce("a", "x")).join(handles, F.expr("f = f_ and key = ha and b = hb"), "left")
                hit = F.col("h_rep").isNotNull()
                s = s.select(
                    "x", "size", *[F.when(hit, F.col(h)).otherwise(F.col(t)).alias(t) for h, t in zip(("h_rep", "h_up", "h_depth"), node, strict=True)],
                    F.when(hit, F.col("h_depth")).otherwise(F.col("lo")).alias("lo"),
                    F.when(hit | F.col("f").isNull(), F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                    F.when(hit, F.col("f")).otherwise(F.col("seen")).alias("seen"),
                )
                s = written(s) if k % STEPS == STEPS - 1 else s
            # the child by which the class goes on, if it goes beyond the node found
            children = self.nodes.select(F.expr("up + 1").alias("f_"), "ca", "cb", F.col("rep").alias("h_rep"), F.col("up").alias("h_up"), F.col("depth").alias("h_depth"))
            s = s.withColumn("f", F.expr("case when lo < size then lo + 1 end"))
            s = _at(s, self.paths, "x", "f", ("a", "b")).withColumn("key", F.coalesce("a", "x")).join(children, F.expr("f = f_ and key = ca and b = cb"), "left")
            hit = F.col("h_rep").isNotNull()
            s = written(s.select("x", "size", *[F.when(hit, F.col(h)).otherwise(F.col(t)).alias(t) for h, t in zip(("h_rep", "h_up", "h_depth"), node, strict=True)], F.when(hit, F.col("f")).otherwise(F.col("seen")).alias("seen")))
            # how far both agree on the edge
            own = s.where("t_rep is not null").join(self.paths.select(F.col("conv_id").alias("x"), "depth", "a", "b"), "x").where("depth > seen and depth <= least(size, t_depth)")
            other = self.paths.select(F.col("conv_id").alias("t_rep"), "depth", "a", "b")
            same = own.select("x", "t_rep", "depth", "a", "b").join(other, ["t_rep", "depth", "a", "b"], "left_semi").groupBy("x").agg(F.max("depth").alias("far"))
            s = s.join(same, "x", "left").withColumn("l", F.coalesce("far", "seen")).drop("far", "seen")
        s = s.withColumn("next", F.expr("case when l < size then l + 1 end"))
        return written(_at(s, self.paths, "x", "next", ("na", "nb")).drop("next"))

    def insert(self, classes: DataFrame) -> int:
        """Insert all classes ``x, size``; returns the number of rounds."""
        rounds = 0
        while not classes.isEmpty():
            exits = self.search(classes)
            open_ = exits.where("l < size")
            drawn = written(open_.groupBy("l", "na", "nb").agg(F.min_by(F.struct("x", "size"), F.xxhash64("x")).alias("w")).select("w.x", "w.size", "l"))
            leaves = drawn.select(F.col("x").alias("rep"), F.col("l").alias("up"), F.col("size").alias("depth"))
            if self.nodes is None:
                self.nodes = written(self.keyed(leaves))
            else:
                edge = [F.col("t_rep").alias("rep"), F.col("t_up").alias("up0"), F.col("t_depth").alias("end")]
                cuts = written(exits.where("l > t_up and l < t_depth").select(*edge, F.col("l").alias("depth")).distinct())
                split = cuts.select("rep", F.col("end").alias("depth")).distinct()
                points = cuts.unionByName(cuts.select("rep", "up0", "end", F.col("end").alias("depth")).distinct())
                order = W.partitionBy("rep", "end").orderBy("depth")
                parts = points.select("rep", F.coalesce(F.lag("depth").over(order), "up0").alias("up"), "depth")
                self.nodes = written(self.nodes.join(split, ["rep", "depth"], "left_anti").unionByName(self.keyed(leaves.unionByName(parts))))
            classes = written(open_.join(drawn.select("x"), "x", "left_anti").select("x", "size"))
            rounds += 1
        return rounds


def _ends(members: DataFrame) -> DataFrame:
    """``rep, ends_sha256``: digest of the ids ``conv_id`` of each class, ascending and joined by commas."""
    def chunks(batches):
        rep, first, ids = None, None, []
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (r != rep or len(ids) == CHUNK):
                    yield pa.RecordBatch.from_pydict({"rep": [rep], "first": [first], "ids": [",".join(ids)]})
                    ids = []
                if not ids:
                    rep, first = r, c
                ids.append(str(c))
        if ids:
            yield pa.RecordBatch.from_pydict({"rep": [rep], "first": [first], "ids": [",".join(ids)]})

    def digest(batches):
        rep, sha = None, None
        for b in batches:
            out = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if r != rep:
                    if sha:
                        out.append((rep, sha.hexdigest()))
                    rep, sha = r, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"rep": [o[0] for o in out], "ends_sha256": [o[1] for o in out]})
        if sha:
            yield pa.RecordBatch.from_pydict({"rep": [rep], "ends_sha256": [sha.hexdigest()]})

    alone = members.where("n = 1").select("rep", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    dealt = members.where("n > 1").select("rep", "conv_id").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    joined = dealt.mapInArrow(chunks, "rep long, first long, ids string").repartition("rep").sortWithinPartitions("rep", "first")
    return alone.unionByName(joined.mapInArrow(digest, "rep long, ends_sha256 string"))


def _subtrees(nodes: DataFrame) -> DataFrame:
    """Sums over each node's subtree of ``members, leaves, bytes, length`` and the least ``low``, by pointer doubling."""
    sums = ["members", "leaves", "bytes", "length"]
    s, to = nodes.select("key", F.when(F.col("up") > 0, F.col("parent")).alias("to"), *sums, "low"), "to"
    s = written(s)
    while not s.where("to is not null").isEmpty():
        add = s.where("to is not null").groupBy(F.col("to").alias("key")).agg(*[F.sum(c).alias(f"{c}_") for c in sums], F.min("low").alias("low_"))
        far = s.where("to is not null").select(F.col("key").alias("via"), F.col("to").alias("far"))
        s = s.join(add, "key", "left").join(far, F.col(to) == F.col("via"), "left")
        s = written(s.select("key", F.col("far").alias("to"), *[(F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in sums], F.least("low", "low_").alias("low")))
    return s


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie, one row a depth.

    ``turns``: conv_id, depth (1, 2, ...), a, b, size; ``conversations``: conv_id and size, the number of its turns.
    """
    paths = written(prefixes(turns))
    ends = written(_at(conversations.select("conv_id", "size"), paths, "conv_id", "size", ("a", "b")))
    classes = written(ends.groupBy("size", "a", "b").agg(F.min("conv_id").alias("x"), F.count("*").alias("n")))
    longest = classes.agg(F.max("size")).first()[0]
    if longest is None:
        return paths.sparkSession.createDataFrame([], NODE)
    kept = written(paths.join(classes.select(F.col("x").alias("conv_id")), "conv_id", "left_semi"))
    index = ZFastTrie(kept, longest)
    index.insert(classes.where("size > 0").select("x", "size"))
    members = ends.join(classes.select("size", "a", "b", "x", "n"), ["size", "a", "b"]).select(F.col("x").alias("rep"), "conv_id", "n")
    closed = written(classes.join(_ends(members).withColumnRenamed("rep", "x"), "x"))

    if index.nodes is not None:
        total = kept.select(F.col("conv_id").alias("rep"), "depth", "upto")
        n = _at(_at(index.nodes.select("rep", "up", "depth"), kept, "rep", "depth", ("a", "b")), kept, "rep", "up", ("pa", "pb"))
        n = n.join(total, ["rep", "depth"]).join(total.select("rep", F.col("depth").alias("up"), F.col("upto").alias("above")), ["rep", "up"], "left")
        end = closed.select(F.col("size").alias("depth"), "a", "b", F.col("x").alias("low"), F.col("n").alias("members"), "ends_sha256")
        n = n.join(end, ["depth", "a", "b"], "left")
        n = written(
            n.select(
                F.struct("depth", "a", "b").alias("key"), F.struct(F.col("up").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).alias("parent"), "rep", "up", "depth",
                F.coalesce("members", F.lit(0)).alias("members"), (F.coalesce("members", F.lit(0)) * F.col("upto")).alias("bytes"), (F.col("upto") - F.coalesce("above", F.lit(0))).alias("length"),
                F.coalesce("above", F.lit(0)).alias("above"), "low", "ends_sha256",
            )
        )
        children = n.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        n = written(n.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaves", F.expr("if(n_children = 0, 1L, 0L)")))
        sub = _subtrees(n)
        low = sub.select(F.col("key").alias("parent"), F.col("low").alias("parent_low"))
        whole = sub.select("key", *[F.col(c).alias(f"sub_{c}") for c in ("members", "leaves", "bytes", "length", "low")])
        n = n.select("key", "parent", "rep", "up", "depth", "above", "n_children", "ends_sha256").join(whole, "key").join(low, "parent", "left").drop("key", "parent")
        part = F.explode(F.expr(f"sequence(up div {SPAN}, (last - 1) div {SPAN})"))
        n = n.withColumnRenamed("depth", "last").withColumn("part", part).withColumn("depth", F.explode(F.expr(f"sequence(greatest(up + 1, part * {SPAN} + 1), least(last, (part + 1) * {SPAN}))")))
        rows = n.join(kept.select(F.col("conv_id").alias("rep"), "depth", (F.col("upto") - F.col("own")).alias("before")), ["rep", "depth"])
        rows = written(
            rows.select(
                F.col("sub_low").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("up") + 1, F.col("sub_low")).otherwise(F.col("parent_low")).alias("parent_conv_id"),
                F.col("sub_members").alias("n_convs"), F.when(F.col("depth") < F.col("last"), F.lit(1)).otherwise(F.col("n_children")).cast("long").alias("n_children"), F.col("sub_leaves").alias("n_leaves"),
                F.expr("sub_bytes - sub_members * before - sub_length + before - above").alias("saved_tokens"), F.when(F.col("depth") == F.col("last"), F.col("ends_sha256")).alias("ends_sha256"),
                (F.col("up") == 0).alias("top"),
            )
        )
        first = rows.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    else:
        rows, first = None, paths.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    top = classes.agg(F.min("x").alias("conv_id"), F.sum("n").alias("n_convs")).crossJoin(F.broadcast(first))  # one row each
    empty = closed.where("size = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = top.crossJoin(F.broadcast(empty)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if rows is None:
        return root.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    least = classes.agg(F.min("x").alias("least"))
    rows = rows.crossJoin(F.broadcast(least)).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent_conv_id"))).drop("least", "top")
    return rows.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of the rebuilt conversations: conversation c opens with the first h turns of c - c % 5 and goes on with its own after h, h = crc32(c) % 9."""
    turns = written(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    c = sizes.withColumns({"h": F.expr("crc32(cast(conv_id as string)) % 9"), "base": F.expr("conv_id - conv_id % 5")})
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("there")), "base", "left")
    c = written(c.withColumn("lead", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("size", F.expr("lead + greatest(turns - h, 0)")))
    own = turns.join(c.select("conv_id", "h", "lead"), "conv_id").where("depth > h").withColumn("depth", F.expr("depth - h + lead")).drop("h", "lead")
    heads = turns.where("conv_id % 5 = 0 and depth <= 8").withColumnRenamed("conv_id", "base")
    led = heads.join(c.select("conv_id", "base", "h"), "base").where("depth <= h").drop("base", "h")
    return own.unionByName(led), c.select("conv_id", "size")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, conversations = rebuilt(turns_of(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return trie(turns, conversations)


SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hex AS (SELECT DISTINCT c, CAST(c AS varchar) AS s FROM t),
bits AS (SELECT c, list_reduce(list_prepend(CAST(4294967295 AS ubigint), list_transform(range(length(s)), lambda i: CAST(ascii(s[i + 1]) AS ubigint))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS ubigint[])), lambda r, _: xor(r >> 1, (r & 1) * CAST(3988292384 AS ubigint)))) AS crc FROM hex),
cs AS (SELECT bits.c, CAST(xor(crc, CAST(4294967295 AS ubigint)) % 9 AS bigint) AS h, bits.c - bits.c % 5 AS base, (SELECT count(*) FROM t WHERE t.c = bits.c - bits.c % 5) AS there FROM bits),
r AS (SELECT cs.c, p AS d, role, text FROM cs JOIN t ON t.c = base AND p <= h
  UNION ALL SELECT cs.c, p - h + least(h, there), role, text FROM cs JOIN t ON t.c = cs.c AND p > h),
keyed AS (SELECT c, d, strlen(text) AS bytes, md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM r),
paths AS (SELECT c, d, bytes, k FROM keyed UNION ALL SELECT c, 0, 0, '' FROM cs),
size AS (SELECT c, max(d) AS size FROM paths GROUP BY c),
n AS (SELECT d, k, min(c) AS low, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS varchar), ',' ORDER BY c) FILTER (d = size), '')) AS ends FROM paths JOIN size USING (c) GROUP BY d, k),
up AS (SELECT n.d, n.k, p.low AS parent_low, p.k AS pk FROM n JOIN paths q ON q.c = n.low AND q.d = n.d - 1 JOIN n p ON p.d = q.d AND p.k = q.k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM up GROUP BY ALL),
sub AS (SELECT q.d, q.k, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (kids.kids IS NULL) AS leaves
  FROM n LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k JOIN paths q ON q.c = n.low AND q.d <= n.d GROUP BY q.d, q.k)
SELECT n.low AS conv_id, CAST(n.d AS bigint) AS depth, up.parent_low AS parent_conv_id, CAST(n.n AS bigint) AS n_convs, CAST(coalesce(kids.kids, 0) AS bigint) AS n_children,
  CAST(sub.leaves AS bigint) AS n_leaves, CAST(sub.saved AS bigint) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN sub ON sub.d = n.d AND sub.k = n.k LEFT JOIN up ON up.d = n.d AND up.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
"""

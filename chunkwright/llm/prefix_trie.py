"""A trie over conversations: every different beginning is a node, with its members, children, leaves and what sharing it saves.

Beginnings are compared by digests: turn by turn the SHA-256 values of (depth, role, text) are put together by XOR, so that the digests
of a conversation of any length are a running value that may be cut into ranges. Equal digests are taken for equal beginnings, which is
safe against chance but isn't meant against texts made to collide.

The smallest member of a beginning owns it. Members of a longer beginning are members of a shorter one, so a conversation owns
all beginnings from some depth on: its chain. That depth is found by binary search, all conversations at once, by joins of the digest
in the middle of each search with the minima of shared digests. Chains hang on the node before their first one; sums over subtrees
run up that tree of chains in doubling steps, and then along each chain.

Rows: turns are ordered by turn (null first), then role and text; null roles and texts are empty. Rows with a null conversation are left out.
Repeated rows are turns like others. Columns of other names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.llm.common import materialise
from chunkwright.operators import scan

LANES = 4
#: A digest shared by more than this part of all turns is broadcast; there are fewer of them than its inverse.
HOT = 4096
#: Conversation numbers a piece of a node's list of members may span.
PIECE = 4096
#: Most turns that a conversation borrows from the head of its family.
HEAD = 5


def numbered(turns: DataFrame, most: int = scan.MOST) -> DataFrame:
    """(c, i, role, text, chars): turns of each conversation, numbered from 1 in order."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    placed = scan.running(rows, ["c"], [F.col("turn").asc_nulls_first(), "role", "text"], {"i": (F.lit(1), "count")}, most=most)
    return placed.select("c", "i", "role", "text", F.length("text").cast("bigint").alias("chars"))


def with_family_heads(turns: DataFrame, most: int = scan.MOST) -> DataFrame:
    """(c, depth, role, text, chars): each conversation c with its first h = crc32(c) mod 6 turns replaced by those of c - c mod 100.

    Conversations that are left without turns have one row of depth 0.
    """
    rows = materialise(numbered(turns, most), "numbered")
    known = rows.groupBy("c").agg(F.max("i").alias("size"))
    known = known.select("c", "size", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEAD + 1)).alias("h"), (F.col("c") - F.col("c") % 100).alias("family"))
    heads = known.where("c = family").select("family", F.col("size").alias("there"))
    convs = materialise(known.join(heads, "family", "left").select("c", "family", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k")), "known")
    # a family has two hundred conversations at most (0 that many, any other half), and a head five turns
    borrowed = rows.where((F.col("i") <= HEAD) & (F.col("c") % 100 == 0)).withColumnRenamed("c", "family").join(convs, "family").where("i <= k").select("c", F.col("i").alias("depth"), "role", "text", "chars")
    own = rows.join(convs, "c").where("i > h").select("c", (F.col("i") - F.col("h") + F.col("k")).alias("depth"), "role", "text", "chars")
    bare = convs.select("c", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("chars"))
    return borrowed.unionByName(own).unionByName(bare)


def _lanes(depth: str) -> dict[str, Column]:
    """64-bit parts of the SHA-256 of (depth, role, text); the role's length keeps role and text apart."""
    whole = F.sha2(F.concat_ws(":", F.col(depth), F.length("role"), F.col("role"), F.col("text")).cast("binary"), 256)
    # 15 hexadecimal digits a lane fit a signed number
    return {f"_l{k}": F.conv(F.substring(whole, 1 + 15 * k, 15), 16, 10).cast("bigint") for k in range(LANES)}


def digested(rebuilt: DataFrame, most: int = scan.MOST) -> DataFrame:
    """(c, depth, digest, chars) of each beginning of each conversation; texts are no longer needed. Depth 0 has no row."""
    rows = rebuilt.where("depth > 0").withColumns(_lanes("depth")).drop("role", "text")
    summed = scan.running(rows, ["c"], ["depth"], {f"x{k}": (F.col(f"_l{k}"), "xor") for k in range(LANES)}, most=most)
    return summed.select("c", "depth", F.unhex(F.concat(*[F.lpad(F.hex(f"x{k}"), 16, "0") for k in range(LANES)])).alias("digest"), "chars")


def first_owned(convs: DataFrame, prefixes: DataFrame, shared: DataFrame, turns: int) -> DataFrame:
    """(c, size, first, above): the least depth that each conversation owns (size + 1: none) and who owns the one before it (null at depth 1).

    `shared` has (digest, owner, members) of the digests with more than one member. A round halves every search; its state is
    one row per conversation.
    """
    hot = shared.where(F.col("members") * HOT > turns).select("digest", F.col("owner").alias("hot"))
    rare = shared.where(F.col("members") * HOT <= turns).select("digest", F.col("owner").alias("rare"))
    state = convs.select("c", "size", F.lit(1).cast("bigint").alias("lo"), (F.col("size") + 1).alias("hi"), F.lit(None).cast("bigint").alias("above"))
    done = []
    while True:
        state = materialise(state, "search")
        done.append(state.where("lo = hi"))
        state = state.where("lo < hi").withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        if state.isEmpty():
            break
        met = state.join(prefixes.select("c", "depth", "digest"), ["c", "depth"])
        met = met.join(F.broadcast(hot), "digest", "left").join(rare, "digest", "left")  # hot: fewer than HOT rows
        owner = F.coalesce("hot", "rare", "c")
        mine = owner == F.col("c")
        state = met.select("c", "size", F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("above")).otherwise(owner).alias("above"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("c", "size", F.col("lo").alias("first"), "above")


def subtree_sums(chains: DataFrame, names: list[str]) -> DataFrame:
    """(c, names...): sums over each chain and all chains below it, from (c, up, names...) where `up` is the chain it hangs on.

    After k steps a chain has the sum of what is less than 2^k chains below it, and a pointer 2^k chains up: as many steps as the
    height of the tree has binary digits. Only chains whose pointer is not yet past the top send anything.
    """
    sums, pointers = chains.select("c", *names), chains.where("up is not null").select("c", "up")
    while True:
        sums, pointers = materialise(sums, "sums"), materialise(pointers, "pointers")
        if pointers.isEmpty():
            return sums
        sent = pointers.join(sums, "c").groupBy("up").agg(*[F.sum(n).alias(f"_{n}") for n in names]).withColumnRenamed("up", "c")
        sums = sums.join(sent, "c", "left").select("c", *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names])
        # the many that point at one chain meet its single row; both sides are tables, so a skewed part can be split
        pointers = pointers.join(pointers.select(F.col("c").alias("up"), F.col("up").alias("over")), "up").select("c", F.col("over").alias("up"))


def _digests_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order, one node after the other."""
    at, hashed = None, sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([hashed.hexdigest()])], ["node", "depth", "ends_sha256"])

    for batch in batches:
        for node, depth, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (node, depth) == at:
                hashed.update(b"," + piece.encode())
                continue
            if at is not None:
                yield row()
            at, hashed = (node, depth), sha256(piece.encode())
    if at is not None:
        yield row()


def ends(chains: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the conversations that end at a node, as the hash of their numbers in ascending order.

    A piece of a list spans PIECE numbers. Most lists have one piece; the pieces of others are hashed in order, one at a time, as the hash of
    a list can't be put together from parts.
    """
    ended = chains.select(F.when(F.col("first") <= F.col("size"), F.col("c")).otherwise(F.coalesce("above", F.lit(0))).alias("node"), F.col("size").alias("depth"), "c")
    pieces = ended.groupBy("node", "depth", (F.col("c") - F.pmod("c", F.lit(PIECE))).alias("piece")).agg(F.array_sort(F.collect_list("c")).alias("members"))
    pieces = pieces.select("node", "depth", "piece", F.array_join("members", ",").alias("text"))
    ordered = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").select("node", "depth", "text")
    return ordered.mapInArrow(_digests_of_lists, "node bigint, depth bigint, ends_sha256 string")


def trie(rebuilt: DataFrame, most: int = scan.MOST) -> DataFrame:
    """Nodes of the trie of conversations (c, depth, role, text, chars), where a row of depth 0 stands for a conversation itself.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (characters of a node's last text times its
    members less one, summed over its subtree), ends_sha256.
    """
    rebuilt = materialise(rebuilt, "rebuilt")
    prefixes = materialise(digested(rebuilt, most), "prefixes")
    sizes = materialise(rebuilt.groupBy("c").agg(F.max("depth").alias("size")), "sizes")
    minima = materialise(prefixes.groupBy("digest").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("members")), "minima")
    chains = materialise(first_owned(sizes, prefixes, minima.where("members > 1"), prefixes.count()), "chains")

    # a node is where its owner's chain has it; its digest is on both sides once
    owned = prefixes.join(chains.select("c", "first"), "c").where("depth >= first").select("c", "depth", "digest", "chars")
    nodes = owned.join(minima.select("digest", "members"), "digest").select("c", "depth", "members", ((F.col("members") - 1) * F.col("chars")).alias("own"))
    hanging = chains.where("first <= size").select("c", "size", "first", F.col("above").alias("up"))
    branches = hanging.where("up is not null").groupBy(F.col("up").alias("c"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("branches"))
    nodes = nodes.join(branches, ["c", "depth"], "left").join(sizes, "c")
    below = F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("size")).cast("bigint")
    nodes = materialise(nodes.select("c", "depth", "members", "own", below.alias("n_children"), (below == 0).cast("bigint").alias("leaf")), "nodes")

    chain_sums = nodes.groupBy("c").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    totals = subtree_sums(hanging.join(chain_sums, "c").select("c", "up", "leaves", "saved"), ["leaves", "saved"])
    joined = materialise(hanging.join(totals, "c"), "chain_sums")
    hung = joined.where("up is not null").groupBy(F.col("up").alias("c"), (F.col("first") - 1).alias("depth")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    nodes = nodes.join(hung, ["c", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("_leaves", F.lit(0)), "own": F.col("own") + F.coalesce("_saved", F.lit(0))}).drop("_leaves", "_saved")
    nodes = scan.running(nodes, ["c"], [F.desc("depth")], {"n_leaves": (F.col("leaf"), "sum"), "saved_tokens": (F.col("own"), "sum")}, most=most)

    top = joined.where("up is null").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = sizes.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("members")).where("members > 0").crossJoin(top)  # one row each
    root = materialise(root.select("c", F.lit(0).cast("bigint").alias("depth"), "members", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")), "root")
    lists = ends(chains)
    # the root's list is kept under the number 0 at depth 0
    rooted = root.join(F.broadcast(lists.where("depth = 0").select("depth", "ends_sha256")), "depth", "left").withColumn("parent", F.lit(None).cast("bigint"))
    first = root.select(F.col("c").alias("_root"))
    nodes = nodes.join(lists.where("depth > 0").withColumnRenamed("node", "c"), ["c", "depth"], "left")
    nodes = nodes.join(hanging.select("c", "first", "up"), "c").crossJoin(F.broadcast(first))  # one row
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > F.col("first"), F.col("c")).otherwise(F.coalesce("up", "_root")))
    names = ["c", "depth", "parent", "members", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = nodes.select(*names).unionByName(rooted.select(*names))
    return out.select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )

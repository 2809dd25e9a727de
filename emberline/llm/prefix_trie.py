"""The trie of conversation prefixes, as flat arrays addressed by minimal perfect hashes.

A node is a distinct sequence of first turns. Its digest is a pair of 64-bit sums over the turns of the
sequence, of hashes of the turn's place, role and text; so digests along a conversation are running
sums, which a conversation of any length gets in parts (:mod:`emberline.operators.scan`). Nodes are
counted by digest, with partial sums, before anything else is done with them.

The smallest member of a node owns it. The nodes that a conversation owns are the last stretch of its
path; cut into BAND depths, such a stretch is a piece. Pieces are dealt to shards by hash, whatever the
shape of the trie: a first turn that all conversations share, or one very long conversation, is spread.
In a shard each node has a slot: a minimal perfect hash of its digest, checked against the whole digest.
Counts are scattered into one array for each column, parents are slots as well, and sums run
through the parents' slots from the deepest nodes upwards.

Sums cross pieces beforehand: each piece has the totals of its own nodes, and pieces form a tree, on which
sums of all pieces below are had by doubling: in round k a piece adds what the pieces 2^k above
themselves have gathered. Rounds grow with the logarithm of the tree's depth.

Cases: turns of a conversation are ordered by number (null first), those with equal numbers by role and
then by a hash of role and text; null roles and texts are empty; rows without a conversation id belong to no
conversation and are left out; repeated rows are turns of their own; texts of any length are hashed
whole and not carried along; an empty table gives no rows (there is no conversation to own the root); further
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators import scan
from emberline.operators.digests import streamed_sha256

from .common import stored
from .tokens import FIELDS, Index, pack_index

#: Depths of a piece, as a power of two: 64.
BAND = 6
#: Nodes of a shard on average, and shards at least.
SHARD_NODES, LEAST_SHARDS = 1 << 16, 32
#: Fixed values of how conversations are rebuilt: how many share a donor, and turns taken from it at most, plus one.
SHARED, HEADS = 5, 9
#: Turns of a conversation whose sums one task takes, as a power of two: 4,096.
STRETCH = 12


def _pair(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos, c1, c2, size: each conversation's turns in order from 0, with hashes of role and text and the text's bytes."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    c1, c2 = _pair(*said)
    rows = conversations.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"), c1.alias("c1"), c2.alias("c2"), F.octet_length(said[1]).cast("long").alias("size"))
    dealt = scan.spread(rows.where("conv IS NOT NULL"), [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("c1").asc()], "turns")
    counted = scan.running(dealt, ["conv"], {"nth": scan.count()})
    return stored(counted.select("conv", (F.col("nth") - 1).alias("pos"), "c1", "c2", "size"), "turns")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns after each conversation's first ones were taken from its donor; and all conversations with their length."""
    lengths = stored(ordered.groupBy("conv").agg(F.count("*").alias("own")), "lengths")
    donor = F.col("conv") - F.col("conv") % SHARED
    asked = lengths.select("conv", "own", donor.alias("donor"), (F.crc32(F.col("conv").cast("string")) % HEADS).alias("heads"))
    had = lengths.select(F.col("conv").alias("donor"), F.col("own").alias("donor_turns"))
    # at most SHARED conversations ask one donor
    plan = stored(asked.join(had, "donor", "left").withColumn("taken", F.least("heads", F.coalesce("donor_turns", F.lit(0)))), "rebuilding")
    heads = ordered.where(F.col("pos") < HEADS).withColumnRenamed("conv", "donor")
    taken = plan.select("conv", "donor", "taken").join(heads, "donor").where("pos < taken").select("conv", "pos", "c1", "c2", "size")
    kept = ordered.join(plan.select("conv", "heads", "taken"), "conv").where("pos >= heads")
    both = taken.unionByName(kept.select("conv", (F.col("pos") - F.col("heads") + F.col("taken")).alias("pos"), "c1", "c2", "size"))
    length = F.col("taken") + F.greatest(F.col("own") - F.col("heads"), F.lit(0))
    return both, plan.select("conv", length.alias("length"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, size, d1, d2 (the digest of the first ``depth`` turns) and p1, p2 (that of one turn less)."""
    placed = rows.select("conv", "size", (F.col("pos") + 1).alias("depth"), F.shiftright("pos", STRETCH).alias("part"), F.col("pos").alias("place"), *[h.alias(n) for h, n in zip(_pair(F.col("pos"), F.col("c1"), F.col("c2")), ("h1", "h2"), strict=True)])
    summed = scan.running(placed, ["conv"], {"d1": scan.xor(F.col("h1")), "d2": scan.xor(F.col("h2"))})
    return summed.select("conv", "depth", "size", "d1", "d2", F.col("d1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("h2")).alias("p2"))


def nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: digest, parent's digest, owner, members, members that end there, bytes of the last text."""
    ends = rows.join(lengths, "conv")
    below = ends.groupBy("d1", "d2", "depth").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv").alias("owner"), F.count("*").alias("members"), F.sum((F.col("length") == F.col("depth")).cast("long")).alias("ends"), F.max("size").alias("size"))
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv").alias("owner"), F.count("*").alias("members"), F.sum((F.col("length") == 0).cast("long")).alias("ends")).where("owner IS NOT NULL")
    top = root.select(*[zero.alias(c) for c in ("d1", "d2", "depth")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], "owner", "members", "ends", zero.alias("size"))
    found = stored(below.unionByName(top), "nodes")
    known = found.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_owner"))
    leaf, saved = F.col("members") == F.col("ends"), (F.col("members") - 1) * F.col("size")
    whole = found.join(known, ["p1", "p2", "depth"], "left").withColumns({"leaf": leaf.cast("long"), "saved": saved, "band": F.shiftright("depth", BAND), "parent_band": F.shiftright(F.col("depth") - 1, BAND)})
    top_of_piece = F.col("parent_owner").isNull() | (F.col("owner") != F.col("parent_owner")) | (F.col("band") != F.col("parent_band"))
    return stored(whole.withColumn("top", top_of_piece), "nodes")


def totals(tree: DataFrame) -> DataFrame:
    """For each piece (owner, band), its top's parent (up_owner, up_depth) and the sums over all nodes below and with its top."""
    own = tree.groupBy("owner", "band").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    tops = tree.where("top").select("owner", "band", F.col("parent_owner").alias("up_owner"), F.when(F.col("parent_owner").isNotNull(), F.col("depth") - 1).alias("up_depth"))
    pieces = stored(own.join(tops, ["owner", "band"]), "pieces")
    state = pieces.select("owner", "band", "leaves", "saved", F.col("up_owner").alias("far_owner"), F.shiftright("up_depth", BAND).alias("far_band"))
    while not (moving := state.where("far_owner IS NOT NULL")).isEmpty():
        # many pieces may hang under one: sums are partial before they are shuffled
        given = moving.groupBy(F.col("far_owner").alias("owner"), F.col("far_band").alias("band")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select(F.col("owner").alias("far_owner"), F.col("band").alias("far_band"), F.col("far_owner").alias("next_owner"), F.col("far_band").alias("next_band"))
        added = state.join(given, ["owner", "band"], "left").join(above, ["far_owner", "far_band"], "left")
        plus = lambda a: (F.col(a) + F.coalesce(F.col(f"more_{a}"), F.lit(0))).alias(a)
        state = stored(added.select("owner", "band", plus("leaves"), plus("saved"), F.col("next_owner").alias("far_owner"), F.col("next_band").alias("far_band")), "pieces")
    return state.select("owner", "band", "leaves", "saved").join(pieces.select("owner", "band", "up_owner", "up_depth"), ["owner", "band"])


def accumulate(group: pa.Table) -> pa.Table:
    """Nodes of a shard, with what hangs under them from outside added in: children, leaves and saved bytes of each node's subtree."""
    columns = {c: group[c].to_numpy() for c in ("depth", "owner", "leaf", "saved", "more_children", "more_leaves", "more_saved")}
    d1, d2, p1, p2 = (group[c].fill_null(0).to_numpy().view(np.uint64) for c in ("d1", "d2", "p1", "p2"))
    n = len(group)
    index = Index(pack_index(d1, d2, dict.fromkeys(FIELDS, np.zeros(n, np.int64))))
    slot = index.find(d1, d2)
    held1, held2, depth = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.empty(n, np.int64)
    held1[slot], held2[slot], depth[slot] = d1, d2, columns["depth"]
    inside = ~group["top"].to_numpy()
    up = index.find(p1[inside], p2[inside])
    checked = [(held1[slot] == d1) & (held2[slot] == d2) & (slot >= 0), (held1[up] == p1[inside]) & (held2[up] == p2[inside]) & (up >= 0)]
    if not all(c.all() for c in checked):
        raise ValueError("a slot does not hold the digest that was looked up")
    parent = np.full(n, -1)
    parent[slot[inside]] = up
    children, leaves, saved = (np.empty(n, np.int64) for _ in range(3))
    children[slot] = columns["more_children"]
    leaves[slot] = columns["leaf"] + columns["more_leaves"]
    saved[slot] = columns["saved"] + columns["more_saved"]
    np.add.at(children, parent[parent >= 0], 1)
    deepest = np.argsort(-depth, kind="stable")
    borders = np.nonzero(np.diff(depth[deepest], prepend=-1))[0]
    for a, b in zip(borders, [*borders[1:], n], strict=True):
        here = deepest[a:b]
        here = here[parent[here] >= 0]
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])
    out = {"n_children": children[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot]}
    kept = ["d1", "d2", "depth", "owner", "parent_owner", "members"]
    return pa.table([*(group[c] for c in kept), *(pa.array(v) for v in out.values())], [*kept, *out])


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    rows, lengths = rebuilt(turns(conversations, conv, turn, role, text))
    lengths = stored(lengths, "rebuilt-lengths")
    paths = stored(prefixes(rows), "prefixes")
    tree = nodes(paths, lengths)
    below = totals(tree)
    hung = below.where("up_owner IS NOT NULL").groupBy(F.col("up_owner").alias("owner"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("more_children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("long")
    whole = tree.join(hung, ["owner", "depth"], "left").withColumns({c: F.coalesce(c, zero) for c in ("more_children", "more_leaves", "more_saved")})
    shards = max(LEAST_SHARDS, -(-tree.count() // SHARD_NODES))
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64("owner", "band"), F.lit(shards)))
    longs = ("d1", "d2", "depth", "owner", "parent_owner", "members", "n_children", "n_leaves", "saved_tokens")
    summed = dealt.groupBy("shard").applyInArrow(accumulate, ", ".join(f"{c} long" for c in longs))

    ended = paths.join(lengths, "conv").where("depth = length").select("d1", "d2", "conv")
    turnless = lengths.where("length = 0").select(zero.alias("d1"), zero.alias("d2"), "conv")
    digests = streamed_sha256(ended.unionByName(turnless), ["d1", "d2"], "conv", "ends_sha256")
    found = summed.join(digests, ["d1", "d2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    names = {"owner": "conv_id", "parent_owner": "parent_conv_id", "members": "n_convs"}
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", none)).withColumnsRenamed(names).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

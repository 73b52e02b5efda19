"""Prefix trie of rebuilt conversations, packed in double arrays.

Turns become two 64-bit hashes and a length; texts are not shuffled. Equal turn sequences are one row with a weight, sorted
and cut into shards of consecutive sequences. In each shard turn ids are made dense and a trie is packed into BASE and
CHECK arrays; sequences step through the arrays, and what they pass are the shard's nodes. Only nodes on the first and
last path of a shard can be in another one too: these come out as parts, which are added up by the digest of
their prefix, and subtree totals are then carried up among them by doubling the distance to the ancestor.

A sequence of over ``TIER`` turns is cut; the next piece hangs in a trie of its own below the digest of all before it, and
its path is treated like a shard's last one, so no row and no shard grows with a conversation's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.base import arrow_type, column, fields_of, settle
from caseloom.llm.segments import SEGMENT_ROWS, packed, streamed_sha256
from caseloom.operators.lookup import lookup

TIER = 4096  # turns of a piece
SHARD_TURNS = 100_000  # turns that a double array is packed from, and one piece more
TRIES = 32  # free places tried for a node's children before they go to the end
GROUP = 5  # conversations that share the head of the first of them
HEAD = 9  # heads have fewer turns than this
CHUNK_BITS = 12  # ids that share their upper bits are joined in one chunk
EMPTY = hashlib.sha256(b"").hexdigest()
ITEMS = "array<struct<k1:long,k2:long,size:long>>"
PARTS = (
    "z binary, q binary, part boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved long, size long"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_digests(depth: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for a turn at a depth; those of a prefix are their exclusive or."""
    step = depth.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    a, b = k1.astype("i8").view("u8"), k2.astype("i8").view("u8")
    return mixed(mixed(a + step) ^ b), mixed(mixed(b + step + np.uint64(1)) + a)


def as_digests(z1: np.ndarray, z2: np.ndarray) -> pa.Array:
    raw = np.stack([z1, z2], axis=1).astype("<u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(z1), [None, pa.py_buffer((np.arange(len(z1) + 1, dtype="i4") * 16).tobytes()), pa.py_buffer(raw)])


class DoubleArray:
    """Trie of sequences of dense ids from 1: the child of state s by id c is BASE[s] + c if CHECK there is s."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        top = int(codes.max(initial=0)) + 1
        self.base = np.zeros(len(codes) + top + 2, "i8")
        self.check = np.full(len(self.base), -1, "i8")
        self.check[0] = -2  # the root
        self.low, self.size = 1, 1  # all below low is taken, all from size on is free
        state = np.zeros(len(starts), "i8")
        for depth in range(int(lengths.max(initial=0))):
            here = np.flatnonzero(lengths > depth)
            pairs, back = np.unique(state[here] * top + codes[starts[here] + depth], return_inverse=True)
            state[here] = self._place(pairs // top, pairs % top)[back]

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, "i8")])
            self.check = np.concatenate([self.check, np.full(more, -1, "i8")])

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free places."""
        self._grow(self.size + n)
        return self.low + np.flatnonzero(self.check[self.low : self.size + n] == -1)[:n]

    def _place(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Puts the children (ids) of ascending ``parents`` into free places, and returns these."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(first, len(parents)))
        places = np.zeros(len(parents), "i8")
        for k in np.flatnonzero(counts > 1).tolist():
            a, b = int(first[k]), int(first[k] + counts[k])
            mine = ids[a:b] - ids[a]  # ascending from 0
            for place in self._free(TRIES).tolist():
                self._grow(place + int(mine[-1]) + 1)
                if (self.check[place + mine] == -1).all():
                    break
            else:
                place = self.size
                self._grow(place + int(mine[-1]) + 1)
            places[a:b] = place + mine
            self._take(places[a:b], parents[a:b], ids[a:b])
        alone = first[counts == 1]
        if len(alone):
            places[alone] = self._free(len(alone))
            self._take(places[alone], parents[alone], ids[alone])
        return places

    def _take(self, places: np.ndarray, parents: np.ndarray, ids: np.ndarray) -> None:
        self.base[parents] = places - ids  # may be below zero
        self.check[places] = parents
        self.size = max(self.size, int(places.max()) + 1)
        if places.min() == self.low:
            taken = self.check[self.low : self.size] != -1
            self.low += len(taken) if taken.all() else int(np.argmin(taken))

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of the states by the ids; -1 where there is none."""
        there = self.base[states] + ids
        inside = (there > 0) & (there < len(self.check))
        return np.where(inside & (self.check[np.where(inside, there, 0)] == states), there, -1)


def nodes_of(
    piece: int, tier: int, prefix: bytes, k1: np.ndarray, k2: np.ndarray, size: np.ndarray, lengths: np.ndarray,
    weight: np.ndarray, conv: np.ndarray, goes_on: np.ndarray,
) -> list:
    """Columns of ``PARTS`` for the trie of some sorted sequences below a prefix of ``tier`` times ``piece`` turns."""
    starts = np.cumsum(lengths) - lengths
    both = np.stack([k1, k2], axis=1)
    codes = np.unique(both, axis=0, return_inverse=True)[1].reshape(-1).astype("i8") + 1 if len(k1) else np.zeros(0, "i8")
    trie = DoubleArray(codes, starts, lengths)
    n = trie.size
    count, least, depth = np.zeros(n, "i8"), np.full(n, np.iinfo("i8").max), np.zeros(n, "i8")
    size_at, is_part, z1, z2 = np.zeros(n, "i8"), np.zeros(n, bool), np.zeros(n, "u8"), np.zeros(n, "u8")
    z1[0], z2[0] = np.frombuffer(prefix, "<u8")
    marked = goes_on.copy()
    marked[[0, -1]] = True
    is_part[0] = True
    if not tier:
        count[0], least[0] = weight.sum(), conv.min()
    state, levels = np.zeros(len(lengths), "i8"), []
    for d in range(int(lengths.max(initial=0))):
        here = np.flatnonzero(lengths > d)
        at = starts[here] + d
        before, after = state[here], trie.step(state[here], codes[at])
        np.add.at(count, after, weight[here])
        np.minimum.at(least, after, conv[here])
        depth[after], size_at[after] = tier * piece + d + 1, size[at]
        one, two = turn_digests(depth[after], k1[at], k2[at])
        z1[after], z2[after] = z1[before] ^ one, z2[before] ^ two
        is_part[after[marked[here]]] = True
        state[here] = after
        levels.append(np.unique(after))
    parent = trie.check[:n]
    kids, leaves, saved = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
    for level in reversed(levels):
        mine = level[~is_part[level]]  # a part's totals wait for those of other shards
        leaves[mine] += kids[mine] == 0
        saved[mine] += (count[mine] - 1) * size_at[mine]
        np.add.at(kids, parent[mine], 1)
        np.add.at(leaves, parent[mine], leaves[mine])
        np.add.at(saved, parent[mine], saved[mine])
    all_states = np.concatenate([[0], *levels]).astype("i8")
    up = np.maximum(parent[all_states], 0)
    is_root = all_states == 0
    z, q = as_digests(z1[all_states], z2[all_states]), as_digests(z1[up], z2[up])
    q = pa.compute.if_else(pa.array(is_root), pa.scalar(None, pa.binary()), q)
    no_conv = is_root if tier else np.zeros(len(is_root), bool)
    depth[0] = tier * piece
    return [
        z, q, pa.array(is_part[all_states]), depth[all_states], pa.array(least[all_states], mask=no_conv),
        pa.array(least[up], mask=is_part[up] | is_root), count[all_states], kids[all_states], leaves[all_states],
        saved[all_states], size_at[all_states],
    ]


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS, piece: int = TIER) -> DataFrame:
    """Nodes and parts of nodes of distinct sequences (tier, prefix, items, weight, conv_id, goes_on)."""
    keys = ["tier", "prefix", "items"]
    rows = sequences.select(*keys, "weight", "conv_id", "goes_on").repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = fields_of(PARTS)
    types, names = [arrow_type(f.dataType) for f in fields], [f.name for f in fields]

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        tier, prefix, items, weight, conv, goes_on = (c.combine_chunks() for c in table.columns)
        lengths = pa.compute.list_value_length(items).to_numpy().astype("i8")
        flat = items.flatten()
        k1, k2, size = (flat.field(i).to_numpy() for i in range(3))
        offsets = np.append(0, np.cumsum(lengths))
        roots = list(zip(tier.to_pylist(), prefix.to_pylist(), strict=True))
        weight, conv, goes_on = weight.to_numpy(), conv.to_numpy(), goes_on.to_numpy(zero_copy_only=False)
        a = 0
        for b in range(1, len(roots) + 1):
            if b == len(roots) or roots[b] != roots[a]:
                at = slice(int(offsets[a]), int(offsets[b]))
                made = nodes_of(piece, *roots[a], k1[at], k2[at], size[at], lengths[a:b], weight[a:b], conv[a:b], goes_on[a:b])
                arrays = [pa.array(v, t) if isinstance(v, np.ndarray) else v.cast(t) for v, t in zip(made, types, strict=True)]
                batch = pa.RecordBatch.from_arrays(arrays, names=names)
                for k in range(0, batch.num_rows, 10_000):
                    yield batch.slice(k, 10_000)
                a = b

    def run(batches):
        held, turns = [], 0
        for whole in batches:
            for k in range(0, whole.num_rows, 100):
                batch = whole.slice(k, 100)
                held.append(batch)
                turns += len(batch.column(2).flatten())
                if turns >= shard_turns:
                    yield from shard(held)
                    held, turns = [], 0
        if held:
            yield from shard(held)

    return rows.mapInArrow(run, PARTS)


def with_digests(rows: DataFrame, piece: int) -> DataFrame:
    """Rows (conv_id, tier, items) with the digest of the items, as if nothing stood before the tier."""

    def run(batches):
        for batch in batches:
            items = batch.column(2)
            lengths = pa.compute.list_value_length(items).to_numpy().astype("i8")
            flat = items.flatten()
            starts = np.cumsum(lengths) - lengths
            tier = np.repeat(batch.column(1).to_numpy().astype("i8"), lengths)
            depth = tier * piece + np.arange(len(flat)) - np.repeat(starts, lengths) + 1
            out = []
            for z in turn_digests(depth, flat.field(0).to_numpy(), flat.field(1).to_numpy()):
                total = np.zeros(len(lengths), "u8")
                some = lengths > 0
                if some.any():
                    total[some] = np.bitwise_xor.reduceat(z, starts[some])
                out.append(pa.array(total.view("i8")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=["conv_id", "tier", "items", "x1", "x2"])

    return rows.select("conv_id", "tier", "items").mapInArrow(run, f"conv_id long, tier int, items {ITEMS}, x1 long, x2 long")


def digest(z1: str, z2: str):
    """The 16 bytes that ``as_digests`` makes of two longs."""
    return F.concat(little(z1), little(z2))


def little(name: str):
    """A long as 8 bytes, least first."""
    big = F.unhex(F.lpad(F.hex(F.col(name)), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])


def rebuilt(df: DataFrame, conv_id: str, turn: str, role: str, text: str, most_rows: int, piece: int) -> DataFrame:
    """(conv_id, tier, items, prefix, z, goes_on): the rebuilt turn sequences in pieces; z is the digest at a piece's end."""
    name, who, what = column(conv_id).cast("long"), F.coalesce(column(role), F.lit("")), F.coalesce(column(text), F.lit(""))
    k1, k2 = F.xxhash64(who, what), F.xxhash64(F.lit(7), what, who)
    values = {"k1": k1, "k2": k2, "size": F.octet_length(what).cast("long")}
    rows = df.filter(column(conv_id).isNotNull())
    segments = settle(packed(rows, name, [column(turn), k1, k2], values, most_rows=most_rows), "turns")
    before = Window.partitionBy("key").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = segments.filter("not whole").withColumn("start", F.coalesce(F.sum(F.size("k1")).over(before), F.lit(0)))
    placed = segments.filter("whole").withColumn("start", F.lit(0).cast("long")).unionByName(cut)
    placed = placed.select("key", "whole", "start", F.arrays_zip("k1", "k2", "size").alias("own"))
    first = placed.filter((F.col("key") % GROUP == 0) & (F.col("start") < HEAD - 1))
    first = first.select("key", F.struct("start", F.slice("own", 1, HEAD - 1).alias("own")).alias("s"))
    heads = first.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["own"])).alias("head"))
    heads = heads.select(F.col("key").alias("first"), "head")
    h = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    joined = placed.withColumn("h", h).withColumn("first", F.col("key") - F.col("key") % GROUP).join(heads, "first", "left")
    # a slice of length zero is empty; a null head too
    joined = joined.withColumn("head", F.slice(F.coalesce("head", F.array().cast(ITEMS)), F.lit(1), F.col("h")))
    own = F.slice("own", F.greatest(F.col("h") - F.col("start"), F.lit(0)).cast("int") + 1, F.greatest(F.size("own"), F.lit(1)))
    at_start = F.col("start") == 0
    joined = joined.select(
        "key", "whole", F.when(at_start, F.concat("head", own)).otherwise(own).cast(ITEMS).alias("items"),
        F.when(at_start, 0).otherwise(F.size("head") + F.greatest(F.col("start") - F.col("h"), F.lit(0))).cast("long").alias("start"),
    )
    whole = with_digests(joined.filter("whole").select(F.col("key").alias("conv_id"), F.lit(0).alias("tier"), "items"), piece)
    none = F.lit(0).cast("long")
    whole = whole.select("conv_id", "tier", "items", none.alias("p1"), none.alias("p2"), "x1", "x2", F.lit(False).alias("goes_on"))
    turns = joined.filter("not whole").select("key", "start", F.posexplode_outer("items").alias("i", "x"))
    turns = turns.withColumn("pos", F.col("start") + F.col("i"))
    turn_ = F.when(F.col("pos").isNotNull(), F.struct("pos", "x"))
    pieces = turns.groupBy("key", F.coalesce(F.floor(F.col("pos") / piece), F.lit(0)).cast("int").alias("tier")).agg(F.sort_array(F.collect_list(turn_)).alias("s"))
    pieces = with_digests(pieces.select(F.col("key").alias("conv_id"), "tier", F.transform("s", lambda s: s["x"]).cast(ITEMS).alias("items")), piece)
    above = Window.partitionBy("conv_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    for k in "12":
        pieces = pieces.withColumn(f"p{k}", F.coalesce(F.bit_xor(f"x{k}").over(above), none))
    pieces = pieces.withColumn("goes_on", F.lead("tier").over(Window.partitionBy("conv_id").orderBy("tier")).isNotNull())
    for k in "12":
        pieces = pieces.withColumn(f"x{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")))
    both = whole.unionByName(pieces)
    return both.select("conv_id", "tier", "items", digest("p1", "p2").alias("prefix"), digest("x1", "x2").alias("z"), "goes_on")


def ends(sequences: DataFrame) -> DataFrame:
    """(z, ends_sha256): the ids of the conversations that end at a node, in chunks of at most 2^CHUNK_BITS ids."""
    rows = sequences.filter("not goes_on").select("z", "conv_id", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    joined = F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>"))
    chunks = settle(rows.groupBy("z", "chunk").agg(joined.alias("ids")), "ends")
    counted = chunks.groupBy("z").agg(F.count("*").alias("n"), F.min("chunk").alias("least"), F.min("ids").alias("ids"))
    one = counted.filter("n = 1").select("z", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    some = chunks.join(counted.filter("n > 1").select("z", "least"), "z")
    comma = F.when(F.col("chunk") > F.col("least"), ",").otherwise("")
    piece = some.select("z", "chunk", F.concat(comma, "ids").cast("binary").alias("piece"))
    return one.unionByName(streamed_sha256(piece, ["z"], ["chunk"], "piece").withColumnRenamed("sha256", "ends_sha256"))


def merged(parts: DataFrame) -> DataFrame:
    """The nodes that come in parts, with totals of their subtrees."""
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    nodes = parts.groupBy("z").agg(*added, F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("q", "depth", "size")])
    nodes = settle(nodes, "parts")
    kids = nodes.filter("q is not null").groupBy(F.col("q").alias("z")).agg(F.count("*").alias("more"))
    nodes = nodes.join(kids, "z", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = nodes.select(
        "z", F.col("q").alias("up"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    totals = settle(own, "totals")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        # a row holds the totals of its subtree down to some distance; its ancestor at that distance adds them to its own
        more = totals.filter("up is not null").groupBy(F.col("up").alias("z")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        ups = totals.filter("up is not null").select(F.col("z").alias("up"), F.col("up").alias("next"))
        totals = totals.join(more, "z", "left").join(ups, "up", "left")
        totals = totals.select(
            "z", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        totals = settle(totals, "totals")
    return settle(nodes.drop("n_leaves", "saved").join(totals.drop("up"), "z"), "upper")


def prefix_trie(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    shard_turns: int = SHARD_TURNS, most_rows: int = SEGMENT_ROWS, piece: int = TIER,
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations of ``df``.

    Ids are whole numbers; rows without one belong to no conversation. Null roles and texts are empty. Rows go by turn,
    nulls first, and rows that share a turn by the XXH64 of role and text. An empty table has no nodes. Other columns are
    not read. ``most_rows`` + 8 must not be over ``piece``. Equality of turns and prefixes rests on 128 bits of hashes.
    """
    sequences = settle(rebuilt(df, conv_id, turn, role, text, most_rows, piece), "sequences")
    distinct = sequences.groupBy("tier", "prefix", "z").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.first("items").alias("items"), F.max("goes_on").alias("goes_on"),
    )
    nodes = settle(trie_nodes(distinct, shard_turns, piece), "nodes")
    upper = merged(nodes.filter("part"))
    inner = nodes.filter("not part")
    known = inner.filter("parent_conv_id is not null")
    names = upper.select(F.col("z").alias("q"), F.col("conv_id").alias("top"))
    # children of parts, which may be many of one part: the lookup is broadcast behind a count, else salted
    rest = inner.filter("parent_conv_id is null").drop("parent_conv_id").unionByName(upper, allowMissingColumns=True)
    rest = lookup(rest, names, ["q"]).withColumnRenamed("top", "parent_conv_id")
    columns = ["z", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    every = known.select(*columns).unionByName(rest.select(*columns)).withColumnRenamed("saved", "saved_tokens")
    return every.join(ends(sequences), "z", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*RESULT)

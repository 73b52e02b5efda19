"""Near-duplicates by Jaccard similarity of word shingles, with HyperMinHash sketches.

A set's sketch has 128 registers. The first bits of a shingle's hash choose a register, which keeps the least of the rest
as a count of leading zeros and the bits after the first one: six bits and 26. Bands of four registers are the
keys under which sets meet: a pair with similarity 0.85 agrees in each band with chance 0.52 and so misses all 32 with
chance 6e-11, one with 0.8 with chance 5e-8; of small sets each differing shingle spoils one band at most. In a bucket
the similarity is estimated on registers with ten bits of mantissa, corrected for chance collisions. A pair goes on unless
its registers differ in more places than its sets may differ in shingles, or the estimate is more than six standard errors
too low.

Pairs that go on only join sets to groups: a bucket returns a forest of them, never all pairs. In each group, links are
confirmed on the full sets (``groups``).
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import simhash
from caseloom.llm.base import add_columns, as_bytes, column, named, numbered, settle
from caseloom.llm.fragments import mixed
from caseloom.llm.groups import confirmed_links, stars_of
from caseloom.llm.links import connected_components

SEED = 42
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 26
SHORT = 10  # bits of mantissa that estimates look at
BAND = 4  # registers
ERRORS = 6.0  # standard errors that an estimate may be too low by
BLOCK = 1024  # sets of a bucket in one block; a cell holds two
KEYS = ["_doc", "_txt"]


def shingle_set(data: bytes | None, shingle: int) -> np.ndarray:
    """Ascending XXH64 of the different shingles of lower-case words; shorter texts are one shingle, none without words."""
    words = (data or b"").lower().split()
    if not words:
        return np.array([], "u8")
    size = min(shingle, len(words))
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends][: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], "u8"))


def sketch(s: np.ndarray) -> np.ndarray:
    """The registers of a set as unsigned 32-bit numbers; 0 is empty."""
    out = np.zeros(REGISTERS, "u4")
    if not len(s):
        return out
    h = np.sort(mixed(s))
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype("i8")
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = (h[first] << np.uint64(BUCKET_BITS)) | np.uint64(1)  # the last bit ends the count of zeros
    top = np.floor(np.log2(rest.astype("f8"))).astype("i8")
    top -= rest < (np.uint64(1) << top.clip(0, 63).astype("u8"))  # rounded up to a power of two
    top = top.clip(0, 63)
    zeros = 63 - top
    after = np.where(zeros < 63, rest << np.minimum(zeros + 1, 63).astype("u8"), 0) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (np.minimum(zeros + 1, 63).astype("u8") << np.uint64(MANTISSA) | after).astype("u4")
    return out


def shortened(registers: np.ndarray) -> np.ndarray:
    """Registers as 16 bits: zeros and the first bits of the mantissa."""
    return (registers >> np.uint32(MANTISSA - SHORT)).astype("u2")


def band_keys(registers: np.ndarray) -> tuple[list[int], list[int]]:
    """(bands, keys) of the bands that are not empty."""
    rows = registers.reshape(-1, BAND)
    some = np.flatnonzero(rows.any(axis=1))
    wide = np.ascontiguousarray(rows).view("u8")
    keys = mixed(mixed(wide[:, 0]) ^ (wide[:, 1] + np.uint64(0x9E3779B97F4A7C15)))
    return some.tolist(), keys.view("i8")[some].tolist()


def collisions() -> np.ndarray:
    """Chance that registers of two sets without common shingles agree, by the rounded binary logarithms of their sizes."""
    zeros = np.arange(64)
    load = 2.0 ** np.arange(40)[:, None] / REGISTERS
    cells = np.exp(-load * 0.5 ** (zeros + 1)) - np.exp(-load * 0.5**zeros)  # of the least hash having so many zeros
    return cells @ cells.T / (1 << SHORT)


CHANCE = collisions()


def may_be_similar(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of rows of short registers, whether their sets may have the similarity."""
    filled = ((a > 0) | (b > 0)).sum(axis=1)
    differ = filled - ((a == b) & (a > 0)).sum(axis=1)
    allowed = (n_a + n_b) * (100 - percent) / (100 + percent)  # shingles that similar sets of these sizes may differ in
    t = percent / 100
    by_chance = CHANCE[np.log2(n_a.clip(1)).round().astype("i8"), np.log2(n_b.clip(1)).round().astype("i8")] * differ
    estimate = 1 - (differ + by_chance) / filled.clip(1)
    return (differ <= allowed) & (estimate >= t - ERRORS * np.sqrt(t * (1 - t) / filled.clip(1)))


def with_sketches(rows: DataFrame, shingle: int, keep: list[str]) -> DataFrame:
    """The kept columns with node (a hash of the set), n and registers."""

    def make():
        def compute(texts):
            nodes, sizes, registers = [], [], []
            for t in texts:
                s = shingle_set(t.as_py(), shingle)
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes(), SEED) - (1 << 63))
                sizes.append(len(s))
                registers.append(sketch(s).tobytes())
            return [nodes, sizes, registers]

        return compute

    return add_columns(rows, [F.col("text")], "node long, n long, registers binary", make, keep)


def buckets(nodes: DataFrame) -> DataFrame:
    """(node, band, key): the buckets of sets."""

    def make():
        def compute(registers):
            both = [band_keys(np.frombuffer(r.as_py(), "u4")) for r in registers]
            return [[b[0] for b in both], [b[1] for b in both]]

        return compute

    rows = add_columns(nodes, [F.col("registers")], "band array<int>, key array<long>", make, ["node"])
    return rows.select("node", F.explode(F.arrays_zip("band", "key")).alias("x")).select("node", "x.band", "x.key")


def estimated_links(nodes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all sets that share a bucket and may be similar.

    A bucket of more than ``block`` sets is cut by size, so that only sizes that allow the similarity meet, and then
    into cells of two blocks, every pair in one. A cell returns stars: each set with the least one it is joined with.
    """
    # a smaller set can't be similar to any other one: n / (n + 1) is below the similarity
    posts = settle(buckets(nodes.filter(F.col("n") * (100 - percent) >= percent)), "buckets")
    sizes = posts.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1")
    shared = posts.join(sizes, ["band", "key"])
    short = add_columns(
        nodes, [F.col("registers")], "short binary", lambda: lambda r: [[shortened(np.frombuffer(x.as_py(), "u4")).tobytes() for x in r]], ["node", "n"]
    )
    rows = shared.join(short, "node").withColumn("_blocks", F.ceil(F.col("c") / block).cast("int"))
    # sets of similar sizes are in the same class of sizes or in neighbouring ones
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.000001 * math.log(100 / percent))).cast("int")
    rows = rows.withColumn("_class", F.explode(F.when(F.col("_blocks") > 1, F.array(step, step - 1)).otherwise(F.array(F.lit(0)))))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64("band", "key", "_class", F.least("_own", "_other"), F.greatest("_own", "_other"))
    cells = rows.select(cell.alias("cell"), "n", "node", "short").repartition("cell").sortWithinPartitions("cell", "n", "node")

    def forest(cell, n, node, short):
        root = np.arange(len(cell))
        out = []
        here = np.arange(len(cell))
        for d in range(1, len(cell)):
            here = here[here + d < len(cell)]
            # ascending sizes: what is too far apart at one distance is so at greater ones
            here = here[(cell[here] == cell[here + d]) & (100 * n[here] >= percent * n[here + d])]
            if not len(here):
                break
            apart = here[root[here] != root[here + d]]
            for k in range(0, len(apart), 4096):
                pair = apart[k : k + 4096]
                near = pair[may_be_similar(short[pair], n[pair], short[pair + d], n[pair + d], percent)]
                for i in near.tolist():
                    a, b = i, i + d
                    while root[a] != a:
                        a = root[a]
                    while root[b] != b:
                        b = root[b]
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(node[i]), int(node[i + d])))
            while not np.array_equal(up := root[root], root):
                root = up
        both = np.array(stars_of(out), "i8").reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(x.as_py() for x in batch.column(3))
            arrays = [*(c.to_numpy() for c in batch.columns[:3]), np.frombuffer(raw, "u2").reshape(-1, REGISTERS)]
            if rest is not None:
                arrays = [np.concatenate([r, a]) for r, a in zip(rest, arrays, strict=True)]
            last = int(np.searchsorted(arrays[0], arrays[0][-1]))  # the last cell may go on in the next batch
            rest = [a[last:] for a in arrays]
            if last:
                yield forest(*(a[:last] for a in arrays))
        if rest is not None:
            yield forest(*rest)

    return cells.mapInArrow(run, "a long, b long")


def components(
    df: DataFrame, percent: int, doc_id: str, text: str, shingle: int, keep: list[str], block: int, tau: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The kept columns by number with id, keys, node and n of each row; and (node, n, root, component_id) of each node.

    With ``tau``, sets whose texts' SimHash fingerprints are joined by links of that many bits are candidates as well.
    """
    rows = df.select(
        *numbered(keep), column(doc_id).alias("id"), as_bytes(text).alias("text"),
        F.xxhash64(column(doc_id)).alias("_doc"), F.xxhash64(column(text)).alias("_txt"),
    )
    passed = [*(f"k{i}" for i in range(len(keep))), "id", *KEYS]
    if tau is None:
        prints = with_sketches(rows, shingle, passed)
    else:
        prints = with_sketches(simhash.with_fingerprints(rows, "text", shingle, [*passed, "text"]), shingle, [*passed, "_fp"])
    prints = settle(prints, "sketches")
    nodes = prints.groupBy("node").agg(F.min("n").alias("n"), F.min("registers").alias("registers"), F.min(F.struct(*KEYS)).alias("source"))
    nodes = settle(nodes, "nodes")
    links = estimated_links(nodes, percent, block)
    if tau is not None:
        near = prints.filter("n > 0").select("node", "_fp").distinct().join(simhash.fingerprint_components(prints, tau, block), "_fp")
        first = near.groupBy("root").agg(F.min("node").alias("b"))
        links = links.unionByName(near.join(first, "root").select(F.col("node").alias("a"), "b"))
    groups = settle(connected_components(links), "groups")
    # rows that repeat id and text share a key: one of them is read
    wanted = nodes.join(groups, "node").select("node", F.col("root").alias("group"), "source.*")
    texts = rows.select("text", *KEYS).join(wanted, KEYS).dropDuplicates(["node"])
    sets = add_columns(texts, [F.col("text")], "s binary", lambda: lambda t: [[shingle_set(x.as_py(), shingle).tobytes() for x in t]], ["group", "node"])
    roots = settle(connected_components(confirmed_links(settle(sets, "sets"), percent)), "roots")
    ids = prints.groupBy("node").agg(F.min("n").alias("n"), F.min("id").alias("id")).join(roots, "node", "left")
    ids = settle(ids.withColumn("root", F.coalesce("root", "node")), "ids")
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    return prints, settle(ids.join(least, "root").select("node", "n", "root", "component_id"), "components")


def similar_documents(
    df: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, keep: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """``df`` with n_shingles, component_id (the smallest id reachable over pairs with the similarity) and kept.

    Words are lower-case ASCII between U+0020 and U+0009-U+000D; a set holds the different shingles, a text of fewer words
    being one. Texts without words have an empty set and are linked with nothing, each being its own component. Ids may
    be of any type that has an order. A null id never names a component; one without any id is null. ``kept`` is whether the row's id
    names its component, null for null ids. Rows that repeat an id are rows of their own. Columns of these names are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_shingles", "component_id", "kept")]
    prints, ids = components(df, percent, doc_id, text, shingle, kept, block)
    joined = prints.drop("n").join(ids, "node")
    joined = joined.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return joined.select(*named(kept), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def first_documents(
    df: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, block: int = BLOCK, tau: int | None = None
) -> DataFrame:
    """One row of ``df`` for each component: that of the smallest id, then of the smallest text hash; without an id last.

    Texts without words are copies of one another here. Of rows that repeat that id and text any one stays.
    """
    prints, ids = components(df, percent, doc_id, text, shingle, [], block, tau)
    order = F.struct(F.isnull("id").alias("none"), "id", F.col("_txt"), F.col("_doc"))
    first = prints.drop("n").join(ids, "node").groupBy("root").agg(F.min(order).alias("first"))
    chosen = first.select(F.col("first._doc").alias("_doc"), F.col("first._txt").alias("_txt")).distinct()
    keyed = df.select(*numbered(df.columns), F.xxhash64(column(doc_id)).alias("_doc"), F.xxhash64(column(text)).alias("_txt"))
    return keyed.join(chosen, KEYS).dropDuplicates(KEYS).select(*named(df.columns))

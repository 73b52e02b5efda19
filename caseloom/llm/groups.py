"""Links between similar sets, confirmed on the full sets inside groups.

``sets`` has columns group, node and s (ascending 64-bit numbers as bytes); only sets of a group are compared. A cell is
held in one task, bounded in sets and bytes, and names for each set the least one it is joined with: every pair that is
not yet joined is compared, none is listed.

A group that fits a cell is one. Larger ones go through three steps. Blocks of them are cells, and then blocks of one set
from each part that has formed: this joins a large group of near copies at a cost that grows with its size. At last what
lies outside a group's largest part is compared with all of the group, block by block, which leaves no pair out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.base import settle

CELL_SETS = 512
CELL_BYTES = 8 << 20


def cell_links(node: list[int], side: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of a cell, leaving out pairs of side 0 and of the same part."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, side = [sets[i] for i in order], sizes[order], side[order]
    root = np.unique(part[order], return_inverse=True)[1].reshape(-1)
    starts = np.cumsum(sizes) - sizes
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(numbers), bool)
    out = []
    for i in range(len(sets) - 1):
        stop = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        others = np.arange(i + 1, stop)
        others = others[(root[others] != root[i]) & (side[others] + side[i] > 0)]
        if not len(others):
            continue
        a, b = int(others[0]), int(others[-1]) + 1
        mine = flat[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[flat[starts[a] : starts[b - 1] + sizes[b - 1]]], starts[a:b] - starts[a], dtype="i8")
        mark[mine] = False
        both = both[others - a]
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((node[order[i]], node[order[j]]))
    return out


def stars_of(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node it is linked with) of all other nodes of a forest."""
    root: dict[int, int] = {}

    def find(n: int) -> int:
        while root.setdefault(n, n) != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(n, find(n)) for n in list(root) if find(n) != n]


def _in_cells(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (cell, node, side, part, s), a cell at a time: b is the least node of the cell that a is joined with."""
    dealt = rows.select("cell", "node", "side", "part", "s").repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        here, held = None, []

        def done():
            found = cell_links([r[0] for r in held], np.array([r[1] for r in held]), np.array([r[2] for r in held]), [r[3] for r in held], percent)
            both = np.array(stars_of(found), "i8").reshape(-1, 2)
            return pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})

        for batch in batches:
            cells, nodes, sides, parts = (c.to_pylist() for c in batch.columns[:4])
            for i, cell in enumerate(cells):
                if cell != here:
                    if len(held) > 1:
                        yield done()
                    here, held = cell, []
                held.append((nodes[i], sides[i], parts[i], np.frombuffer(batch.column(4)[i].as_py(), "u8")))
        if len(held) > 1:
            yield done()

    return dealt.mapInArrow(run, "a long, b long")


def _blocks(cell_sets: int, cell_bytes: int):
    rows = F.ceil(F.count("*") / cell_sets)
    return F.greatest(rows, F.ceil(F.sum(F.octet_length("s")) / cell_bytes)).cast("int")


def confirmed_links(sets: DataFrame, percent: int, cell_sets: int = CELL_SETS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Links (a, b) that join exactly the sets of a group that a chain of similar sets joins."""
    sizes = settle(sets.groupBy("group").agg(F.count("*").alias("c"), _blocks(cell_sets, cell_bytes).alias("blocks")).filter("c > 1"), "group_sizes")
    rows = sets.join(sizes, "group").withColumn("side", F.lit(1)).withColumn("part", F.col("node"))
    small = _in_cells(rows.filter("blocks = 1").withColumn("cell", F.col("group")), percent)
    if not sizes.filter("blocks > 1").limit(1).count():
        return small
    large = settle(rows.filter("blocks > 1"), "large_groups")
    small = settle(small, "links")

    def block(n, salt):
        return F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")

    links = settle(_in_cells(large.withColumn("cell", F.xxhash64("group", block(F.col("blocks"), 1))), percent), "links")
    parts = settle(_parts(large.withColumn("part", F.col("node")), links), "parts")
    one = parts.filter("node = part").drop("blocks").withColumn("side", F.lit(1))
    own = one.groupBy("group").agg(_blocks(cell_sets, cell_bytes).alias("blocks"))
    one = one.join(own, "group").withColumn("cell", F.xxhash64("group", block(F.col("blocks"), 2)))
    more = settle(_in_cells(one, percent), "links")
    parts = _parts(parts, more)
    by_size = Window.partitionBy("group").orderBy(F.desc("m"), "part")
    largest = parts.groupBy("group", "part").agg(F.count("*").alias("m")).withColumn("r", F.row_number().over(by_size)).filter("r = 1")
    parts = settle(parts.join(largest.select("group", F.col("part").alias("most")), "group").withColumn("rest", F.col("part") != F.col("most")), "parts")
    rest = parts.filter("rest").groupBy("group").agg(_blocks(cell_sets, cell_bytes).alias("others"))
    # a set outside the largest part meets each block of its group, and each set of the group each block of those outside
    dealt = parts.join(rest, "group").withColumn("own", block(F.col("blocks"), 3)).withColumn("other", block(F.col("others"), 4))
    as_rest = dealt.filter("rest").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.col("other").alias("y"), F.lit(1).alias("side"))
    as_any = dealt.select("*", F.col("own").alias("x"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("y"), F.lit(0).alias("side"))
    meet = as_rest.unionByName(as_any).withColumn("cell", F.xxhash64("group", "x", "y"))
    return small.unionByName(links).unionByName(more).unionByName(_in_cells(meet, percent))


def _parts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(group, blocks, node, s, part) where parts that are linked with a lesser one take its name."""
    renamed = links.select(F.col("a").alias("part"), F.col("b").alias("least"))
    joined = rows.select("group", "blocks", "node", "s", "part").join(renamed, "part", "left")
    return joined.select("group", "blocks", "node", "s", F.coalesce("least", "part").alias("part"))

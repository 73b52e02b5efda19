"""SimHash near-duplicates with the generalised pigeonhole principle.

If two fingerprints differ in at most ``tau`` bits, and the bits are cut into groups with thresholds t_i whose sum of
(t_i + 1) is tau + 1, then they differ in at most t_i bits of some group i. Bits that go together are put in one group,
and dynamic programming shares out the thresholds so that signatures and expected candidates cost least. A fingerprint
is probed under one signature for each way to blank t_i bits of group i; fingerprints that share one are verified.

Equal fingerprints are one class, so only distinct ones are probed. Of a bucket only a spanning forest of its links is
returned, never all pairs; a large bucket is compared in cells of bounded size in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.base import add_columns, as_bytes, column, named, numbered, settle
from caseloom.llm.links import connected_components

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 100_000
BLOCK = 1024  # fingerprints of a bucket in one block; a cell holds two blocks
PAIR_COST = 0.02  # verifying a candidate, in units of making and dealing out a signature


def fingerprint(data: bytes | None, shingle: int = 3) -> bytes:
    """8 bytes: the bits set in over half of the XXH64 of the shingles; zero without words."""
    words = (data or b"").lower().split()
    if not words:
        return bytes(8)
    size = min(shingle, len(words))
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends][: len(words) - size + 1]
    stops = ends[size - 1 :]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, "i8")
    for k in range(0, len(starts), SHINGLES_AT_ONCE):
        part = zip(starts[k : k + SHINGLES_AT_ONCE], stops[k : k + SHINGLES_AT_ONCE], strict=True)
        raw = b"".join([digest(flat[a : b - 1], SEED) for a, b in part])
        ones += np.unpackbits(np.frombuffer(raw, "u1")).reshape(-1, BITS).sum(axis=0, dtype="i8")
    return np.packbits(ones * 2 > len(starts)).tobytes()


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``df`` with fingerprint (16 hex digits) and _fp (the same bits as a signed long)."""

    def make():
        def compute(texts):
            made = [fingerprint(t.as_py(), shingle) for t in texts]
            return [[x.hex() for x in made], [int.from_bytes(x, "big", signed=True) for x in made]]

        return compute

    return add_columns(df, [as_bytes(text)], "fingerprint string, _fp long", make, keep)


def bits_of(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">i8").view("u1")).reshape(-1, BITS)


def joint_counts(fps: DataFrame) -> np.ndarray:
    """How often two bits are both set, over all rows of ``_fp``; single bits on the diagonal."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy(zero_copy_only=False)).astype("f4")
            total += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS), "n": total.ravel().astype("i8")})

    rows = fps.select("_fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 64 x 64
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.k] = r.n
    return out.reshape(BITS, BITS)


def correlation(joint: np.ndarray, n: int) -> np.ndarray:
    p = np.diag(joint) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    c = np.abs((joint / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(c, 0)
    return c


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of about equal size; each grows by the bit that goes most with the bits it has."""
    free = set(range(BITS))
    groups = []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


@dataclass(frozen=True)
class Plan:
    groups: list[list[int]]
    thresholds: list[int]  # -1: the group is not probed
    cost: float


def within(differ: list[float], most: int) -> float:
    """Chance that at most ``most`` of independent bits differ."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return float(chance.sum())


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Share out ``units`` among the groups at least cost; costs[i][u] is that of giving group i ``u`` units."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, given) in best.items():
            for u in range(units - used + 1):
                total = cost + row[u]
                if used + u not in new or total < new[used + u][0]:
                    new[used + u] = (total, [*given, u])
        best = new
    return best[units]


def plan_probes(fps: DataFrame, n: int, tau: int) -> Plan:
    """Groups and thresholds for distinct fingerprints. All rows are counted: bit pairs, and equal keys of each group.

    Candidates at a threshold above 0 are estimated from the equal keys, scaled by how much likelier the bits' own
    frequencies make that many differences.
    """
    joint = joint_counts(fps)
    p = np.diag(joint) / n
    differ = 2 * p * (1 - p)
    corr = correlation(joint, n)
    choices = [group_bits(corr, m) for m in range(2, tau + 2)]
    masks = [signed(mask_of(g)) for groups in choices for g in groups]
    keys = fps.select(F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(m)) for m in masks])).alias("g", "key"))
    same = keys.groupBy("g", "key").count().groupBy("g").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    pairs = {r.g: r.pairs for r in same.collect()}  # a row for each group
    plans, g = [], 0
    for groups in choices:
        costs = []
        for bits in groups:
            d = [float(x) for x in differ[bits]]
            none = max(within(d, 0), 1e-30)
            row = [0.0]
            for e in range(tau + 1):
                candidates = min(pairs.get(g, 0.0) * within(d, e) / none, n * n / 2)
                row.append(comb(len(bits), e) * n + PAIR_COST * candidates * (1 if e == 0 else e + 1))
            costs.append(row)
            g += 1
        cost, units = allocate(costs, tau + 1)
        plans.append(Plan(groups, [u - 1 for u in units], cost))
    return min(plans, key=lambda x: x.cost)


def signatures(fps: DataFrame, plan: Plan) -> DataFrame:
    """(probe, key, _fp, rep): a row for each way to blank t_i bits of group i."""
    masks = np.array([
        mask_of(set(bits) - set(blank))
        for bits, t in zip(plan.groups, plan.thresholds, strict=True) if t >= 0
        for blank in combinations(bits, t)
    ], "u8")

    def run(batches):
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(0, len(masks), 64):
                part = masks[k : k + 64]
                key = (fp.view("u8")[:, None] & part).view("i8").ravel()
                probe = np.tile(np.arange(k, k + len(part), dtype="i4"), len(fp))
                yield pa.RecordBatch.from_pydict({"probe": probe, "key": key, "_fp": np.repeat(fp, len(part)), "rep": np.repeat(rep, len(part))})

    return fps.select("_fp", "rep").mapInArrow(run, "probe int, key long, _fp long, rep long")


def forest(cell: np.ndarray, fp: np.ndarray, node: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside cells. ``cell`` is ascending; rows at growing distance are compared at once."""
    n = len(fp)
    root = np.arange(n)
    out = []
    here = np.arange(n)
    for d in range(1, n):
        here = here[here + d < n]
        here = here[cell[here] == cell[here + d]]
        if not len(here):
            break
        near = here[np.bitwise_count((fp[here] ^ fp[here + d]).view("u8")) <= tau]
        near = near[root[near] != root[near + d]]
        for i in near.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[i + d])))
        if len(near):
            while not np.array_equal(up := root[root], root):
                root = up
    return out


def links_of(sigs: DataFrame, tau: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``tau`` bits that share a signature.

    A bucket of more than ``block`` rows is cut into blocks, and each pair of blocks is a cell of its own: every pair is
    compared in some cell, no task gets more than two blocks at a time, and a cell returns a forest, not its pairs.
    """
    sizes = sigs.groupBy("probe", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = sigs.join(sizes, ["probe", "key"]).withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64("probe", "key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    cells = rows.select(cell.alias("cell"), "_fp", "rep").repartition("cell").sortWithinPartitions("cell", "_fp")

    def run(batches):
        rest: list[np.ndarray] = [np.array([], "i8")] * 3
        for batch in batches:
            arrays = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            if not len(arrays[0]):
                continue
            last = int(np.searchsorted(arrays[0], arrays[0][-1]))  # the last cell may go on in the next batch
            rest = [a[last:] for a in arrays]
            yield _as_batch(forest(*(a[:last] for a in arrays), tau))
        yield _as_batch(forest(*rest, tau))

    return cells.mapInArrow(run, "a long, b long")


def _as_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, "i8").reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": both[:, 0], "b": both[:, 1]})


def fingerprint_components(prints: DataFrame, tau: int = 3, block: int = BLOCK) -> DataFrame:
    """(_fp, root) of each different fingerprint of ``prints``: root is the smallest one reachable over ``tau`` bits or fewer."""
    classes = settle(prints.select("_fp").distinct().withColumn("rep", F.col("_fp")), "classes")
    n = classes.count()
    if n < 2:
        return classes.withColumnRenamed("rep", "root")
    sigs = settle(signatures(classes, plan_probes(classes, n, tau)), "signatures")
    roots = connected_components(links_of(sigs, tau, block)).withColumnRenamed("node", "_fp")
    return settle(classes.join(roots, "_fp", "left").select("_fp", F.coalesce("root", "rep").alias("root")), "components")


def near_duplicates(
    df: DataFrame, tau: int = 3, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, keep: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """``df`` with fingerprint and component_id, the smallest document id reachable over links of ``tau`` bits or fewer.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint and so a
    component; rows that repeat an id with other texts are linked by their own texts alone. Ids may be of any type that has
    an order. A null id never names a component; one without any id is null. Columns of these names are replaced.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("fingerprint", "component_id")]
    rows = df.select(*numbered(kept), column(doc_id).alias("id"), as_bytes(text).alias("text"))
    prints = settle(with_fingerprints(rows, "text", shingle, [*(f"k{i}" for i in range(len(kept))), "id"]), "fingerprints")
    ids = prints.groupBy("_fp").agg(F.min("id").alias("id")).join(fingerprint_components(prints, tau, block), "_fp")
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    ids = ids.join(least, "root").select("_fp", "component_id")
    return prints.join(ids, "_fp").select(*named(kept), "fingerprint", "component_id")

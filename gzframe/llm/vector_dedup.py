"""Operator 4: near-duplicate vectors by collision-counting projections.

Vectors are scaled to length one; equal vectors are one class with a weight, so
copies cost a row each. Random projections, each sorted and cut at its median,
give a code of ``depth`` projections in each of several tables; vectors of one
code share a cell, and ``depth`` grows with the vectors so that cells do not.
In a cell the vectors are sorted on further projections: each query's window on
the first of them is a slice, further windows, centred at the query, count
collisions per pair, and pairs whose count passes a threshold are verified by
cosine in double precision. A pair that several tables hold is counted in the
first of them.

All this follows from the wanted recall. A pair at the least cosine differs in
one projection by about a normal deviate of scale sqrt((2 - 2 cos) / dims):
windows miss one pair in 100, and the count is the largest that misses at most
one in 100 of the rest. How often such a pair shares a cell is measured on
``sample_rows`` vectors (with neighbours made at the least cosine), from which
also the medians come, a documented bound; as many tables are made as leave at
most ``missed`` of the pairs. Closer pairs are missed less.

A cell of more than ``block`` vectors (a dense group) is cut into blocks that
meet in pairs of blocks, a task each. Linked pairs are counted in the task; what
leaves it is one row per vector, a count and the smallest row it hangs together
with, so a group of any size gives as many rows as it has vectors. The driver
holds the sample and the medians, no list that grows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths do not link; a
cosine of exactly ``least`` links; rows of one vec_id are vectors of their own,
each with its row; a null vec_id links with nothing; an empty table gives an
empty result; further columns are ignored."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gzframe.llm.common import bounded_batches, connected_components, written

#: Vectors in a cell, about, and in a block of a large cell at most.
CELL, BLOCK = 2048, 8192
#: Queries compared at a time.
QUERIES = 128
#: Salts that a class of equal vectors is spread over.
SALTS = 64


def directions(dims: int, projections: int, seed: int) -> np.ndarray:
    g = np.random.default_rng([seed, dims]).standard_normal((dims, projections))
    return g / np.linalg.norm(g, axis=0)


def windows(least: float, dims: int, projections: int, missed: float = 0.01) -> tuple[float, float, int]:
    """(first window, further windows, needed collisions among the further ones)."""
    scale = math.sqrt(max(2 - 2 * least, 1e-12) / dims)
    first, further = 2.576 * scale, 1.8 * scale
    p, m = math.erf(1.8 / math.sqrt(2)), projections - 1
    below, need = 0.0, 0
    for k in range(m + 1):
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > missed:
            break
        need = k + 1
    return first, further, need


def usable_vectors(column: pa.Array, kind: str) -> list[np.ndarray | None]:
    """The vectors of a list column as ``kind``; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            a = np.asarray(v.values.to_numpy(zero_copy_only=False)).astype(kind)
            if np.isfinite(a).all() and a.any():
                x = a
        out.append(x)
    return out


def unit_rows(raw: list[bytes], dims: int, kind: str) -> np.ndarray:
    """Vectors as they came, to rows of length one in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Plan:
    """How vectors of one length are dealt to cells: for each table ``depth`` directions and their medians."""

    axes: np.ndarray  # dims, tables * depth
    cuts: np.ndarray  # tables * depth
    tables: int
    depth: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the code of each vector in each table."""
        if not self.depth:
            return np.zeros((len(x), self.tables), np.uint32)
        bits = (x @ self.axes > self.cuts).reshape(len(x), self.tables, self.depth)
        return (bits << np.arange(self.depth)).sum(axis=2, dtype=np.uint32)


def plan_for(sample: np.ndarray, vectors: int, least: float, missed: float, cell: int, seed: int) -> Plan:
    """Depth from the number of vectors; medians and tables from ``sample``."""
    dims = sample.shape[1]
    depth = min(31, max(0, math.ceil(math.log2(max(1, vectors / cell)))))
    if not depth:
        return Plan(np.zeros((dims, 0)), np.zeros(0), 1, 0)
    rng = np.random.default_rng([seed, dims, 1])
    side = rng.standard_normal(sample.shape)
    side -= (side * sample).sum(axis=1, keepdims=True) * sample
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    near = least * sample + math.sqrt(max(0.0, 1 - least * least)) * side / np.maximum(norm, 1e-12)
    left, count = np.ones(len(sample)), 0
    axes, cuts = [], []
    while left.mean() > missed:
        g = rng.standard_normal((dims, depth))
        g /= np.linalg.norm(g, axis=0)
        at = sample @ g
        cut = np.median(at, axis=0)
        left *= ((at > cut) != (near @ g > cut)).any(axis=1)
        axes.append(g)
        cuts.append(cut)
        count += 1
    return Plan(np.concatenate(axes, axis=1), np.concatenate(cuts), count, depth)


def _vectors(kind: str, usable: bool):
    """vec_id, dims and bytes of the vectors that can link, or else the vec_id of the others."""

    def run(batches):
        for batch in batches:
            ids, data = batch.column(0).to_pylist(), usable_vectors(batch.column(1), kind)
            keep = [i for i, x in enumerate(data) if (x is not None and ids[i] is not None) == usable]
            columns = [pa.array([ids[i] for i in keep], pa.int64())]
            if usable:
                columns += [pa.array([len(data[i]) for i in keep], pa.int32()), pa.array([data[i].tobytes() for i in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dims", "raw"][: len(columns)])

    return run


def _deal(plans, kind: str):
    """One row for each vector and table: cell, and the codes by which a pair's first table is known."""

    def run(batches):
        for batch in batches:
            rows, dims, weights = (batch.column(i).to_numpy() for i in range(3))
            raw = batch.column(3).to_pylist()
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                plan = plans.value[int(n)]
                codes = plan.codes(unit_rows([raw[i] for i in at], int(n), kind))
                for t in range(plan.tables):
                    cells = (np.int64(t) << 32) | codes[:, t].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), n, np.int32)), pa.array(cells), pa.array(rows[at]), pa.array(weights[at]), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([raw[i] for i in at], pa.binary())],
                        ["dims", "cell", "row", "weight", "codes", "raw"],
                    )

    return run


def link_cells(a: dict, b: dict | None, table: int, least: float, projections: int, seed: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between two blocks of a cell (b None: within a): weights linked to a's rows then b's rows, and joined row pairs of a local forest."""
    same = b is None
    b = a if same else b
    dims = a["x"].shape[1]
    first, further, need = windows(least, dims, projections)
    d = directions(dims, projections, seed)
    pa_, pb = (a["x"] @ d).astype(np.float32), (b["x"] @ d).astype(np.float32)
    order = np.argsort(pb[:, 0], kind="stable")
    x, pb, codes, weight = b["x"][order], np.ascontiguousarray(pb[order].T), b["codes"][order], b["weight"][order]
    counts = np.zeros(len(a["x"]) + (0 if same else len(x)), np.int64)
    parent = np.arange(len(counts))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    queries = np.argsort(pa_[:, 0], kind="stable")
    shift = 0 if same else len(a["x"])
    for q0 in range(0, len(queries), QUERIES):
        q = queries[q0 : q0 + QUERIES]
        lo = int(np.searchsorted(pb[0], pa_[q[0], 0] - first, side="left"))
        hi = int(np.searchsorted(pb[0], pa_[q[-1], 0] + first, side="right"))
        if same:
            # each pair once: the second row does not come before the first in the order
            lo = max(lo, q0)
        if hi <= lo:
            continue
        near = np.abs(pb[0, lo:hi] - pa_[q, 0][:, None]) <= first
        hits = np.zeros(near.shape, np.int8)
        for j in range(1, projections):
            hits += np.abs(pb[j, lo:hi] - pa_[q, j][:, None]) <= further
        qi, ci = np.nonzero(near & (hits >= need))
        ci += lo
        if same:
            once = ci > q0 + qi
            qi, ci = qi[once], ci[once]
        for k in range(0, len(qi), 500_000):
            u, v = qi[k : k + 500_000], ci[k : k + 500_000]
            good = np.einsum("ij,ij->i", a["x"][q[u]], x[v]) >= least
            u, v = u[good], v[good]
            # a table before this one has counted the pairs that share a cell of it
            fresh = ~(a["codes"][q[u], :table] == codes[v, :table]).any(axis=1)
            u, v = u[fresh], v[fresh]
            counts += np.bincount(q[u], weight[v], len(counts)).astype(np.int64) + np.bincount(order[v] + shift, a["weight"][q[u]], len(counts)).astype(np.int64)
            u, v = q[u], order[v] + shift
            # a row's links to rows that already hang together add nothing to the forest
            for i in np.unique(u):
                r = top(i)
                for c in np.unique(parent[v[u == i]]):
                    t = top(c)
                    if t != r:
                        r, t = min(r, t), max(r, t)
                        parent[t] = r
    return counts, [(i, top(i)) for i in range(len(counts)) if counts[i]]


def _pair(tables_of, kind: str, least: float, projections: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        dims, cell, i, j = (table[c][0].as_py() for c in ("dims", "cell", "i", "j"))
        own = table["own"].to_numpy()

        def side(k):
            t = table.filter(pa.array(own == k))
            return {"row": t["row"].to_numpy(), "weight": t["weight"].to_numpy(), "x": unit_rows(t["raw"].to_pylist(), dims, kind), "codes": np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint32).reshape(-1, tables_of[dims])}

        a, b = side(i), None if i == j else side(j)
        if not len(a["row"]) or (b is not None and not len(b["row"])):
            return pa.table({"row": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        counts, forest = link_cells(a, b, cell >> 32, least, projections, seed)
        rows = a["row"] if b is None else np.concatenate([a["row"], b["row"]])
        at, to = np.array([f[0] for f in forest], np.int64), np.array([f[1] for f in forest], np.int64)
        return pa.table({"row": rows[at], "links": counts[at], "other": rows[to]})

    return run


def near_vectors(vectors: DataFrame, *, least: float = 0.9, projections: int = 12, missed: float = 0.01, cell: int = CELL, block: int = BLOCK, sample_rows: int = 2000, seed: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    spark = bounded_batches(vectors.sparkSession)
    base = vectors.select("vec_id", "embedding")
    kind = "<f4" if "float" in base.schema["embedding"].dataType.simpleString() else "<f8"
    keys = ["dims", "h1", "h2"]
    unit = base.mapInArrow(_vectors(kind, True), "vec_id long, dims int, raw binary")
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    unit = written(unit.withColumns({"row": F.monotonically_increasing_id(), "h1": F.xxhash64("raw"), "h2": F.xxhash64(F.lit(1), "raw")}).withColumn("salt", salt), "vectors-read")
    # equal vectors are one class; salted, as a third of all rows may be one class
    low = unit.groupBy(*keys, "salt").agg(F.min("row").alias("low"), F.count("*").alias("n"), F.min("vec_id").alias("v"))
    classes = written(low.groupBy(*keys).agg(F.min("low").alias("rep"), F.sum("n").alias("weight"), F.min("v").alias("least_id")), "vectors-classes")
    reps = unit.join(classes.select(F.col("rep").alias("row"), "weight"), "row").select("row", "dims", "weight", "raw")
    counted = {r.dims: r.n for r in classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect()}
    plans = {}
    for n, many in counted.items():
        some = classes.where(F.col("dims") == n).orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(sample_rows).select(F.col("rep").alias("row"))
        drawn = unit.join(F.broadcast(some), "row").select("row", "raw").collect() if many > cell else []
        sample = unit_rows([r.raw for r in sorted(drawn)], n, kind) if drawn else np.zeros((0, n))
        plans[n] = plan_for(sample, many, least, missed, cell, seed)
    sent = spark.sparkContext.broadcast(plans)
    dealt = written(reps.mapInArrow(_deal(sent, kind), "dims int, cell long, row long, weight long, codes binary, raw binary"), "vectors-cells")
    # dense cells are cut into blocks that meet pair by pair; most cells are one block
    large = dealt.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    cut = dealt.join(large, ["dims", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    sent_rows = cut.select("dims", "cell", "row", "weight", "codes", "raw", "own", F.explode(meets).alias("m")).select("dims", "cell", "row", "weight", "codes", "raw", "own", "m.i", "m.j")
    tables_of = {n: p.tables for n, p in plans.items()}
    found = written(sent_rows.groupBy("dims", "cell", "i", "j").applyInArrow(_pair(tables_of, kind, least, projections, seed), "row long, links long, other long"), "vectors-links")

    parts = connected_components(found.select("row", "other"), "vectors-components")
    # a component is named by its smallest vec_id
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    small = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = found.groupBy(F.col("row").alias("rep")).agg(F.sum("links").alias("links"))
    whole = named.join(small, "component").join(linked, "rep", "left").select(*keys, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    usable = unit.select("vec_id", *keys, "salt").join(low.select(*keys, "salt").join(whole, keys), [*keys, "salt"]).select("vec_id", "n_links", "component_id")
    # vectors that could not be used, and rows without an id, link with nothing
    rest = base.mapInArrow(_vectors(kind, False), "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return usable.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

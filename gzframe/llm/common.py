"""What the operators of this subpackage share: the shared folder, written
intermediate tables, connected components and a few column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gzframe.sources.shared import fresh_path, local_path, shared_dir

__all__ = ["bounded_batches", "connected_components", "fold", "free_name", "fresh_path", "local_path", "partitions", "shared_dir", "slices", "written"]

def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks that read it.
    The table stays in the application's part of the shared folder until the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that a task hands to Python at once, about.
BATCH_BYTES = 8 * 2**20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """``spark``, with Arrow batches bounded by bytes: rows of any length then cost a Python worker about as much.

    Sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the session, unless it is set to less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def slices(texts, most: int = 2 * 2**20):
    """Consecutive slices of an Arrow array of strings, each of about ``most`` bytes or one longer string."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as decimal text, modulo ``mod`` (null id: the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod).cast("long"))


def _roots(pairs):
    """Union-find over integer pairs; yields each node with its smallest linked node."""
    parent: dict[int, int] = {}

    def top(x):
        r = x
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(n, top(n)) for n in list(parent)]


def _contract(batches):
    """Replace each partition's edges by stars around its local smallest nodes."""
    import pyarrow as pa

    for batch in batches:
        got = [(n, r) for n, r in _roots(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if n != r]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], ["a", "b"])


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns), the component being the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each
    step is written to the shared folder. Edges are first contracted inside
    their partitions, so groups of any size enter as stars. Nothing is
    collected but a count and a checksum."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = written(e.mapInArrow(_contract, "a long, b long").distinct(), name)

    def mark(x):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(e)
    if not before[0]:
        return spark.createDataFrame([], "node long, component long")
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        e = written(small, name)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())

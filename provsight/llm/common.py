"""Shared pieces of the training-data operators: table access, lineage cuts, Arrow maps, linking and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; whole texts are long, so the session default of 10,000 would make batches of a gigabyte.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table, by Spark's reader alone; also keeps Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; only in local mode may it be unset, and then one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder, so that later reads survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, *by: str) -> DataFrame:
    """As cut, but written as Parquet in that folder (by these columns): columns are read apart and stay compressed. For wide rows."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast when its counted rows stay within max_rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_batches(df: DataFrame, make: Callable[[dict[str, list]], Iterator[dict[str, list]] | dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists; make returns one dict of columns per batch."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(make(batch.to_pydict()), schema=fields)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Alternating large-star and small-star rounds, each cut to shared storage. Edges stay on the cluster; the driver
    sees one count and checksum a round. Self edges and nulls are ignored; an empty table gives an empty result.
    """
    edge = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edge, before = cut(edge), None
    for _ in range(max_rounds):
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edge = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edge.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def block_links(rows: DataFrame, keys: list[str], block: int, linked: Callable, kind: str = "long") -> DataFrame:
    """Links (a, b) in large groups of rows(keys, id, item, rest): between rows marked as rest, and between these and the others.

    A group is dealt by the hash of id into blocks of about `block` rows, and each two blocks that are to be compared meet in a
    row of their own, dealt by group and blocks; so a task holds blocks of one group or of many, and a hot group is spread.
    linked(items, items) gives a boolean matrix. Of each two blocks only a spanning forest of their links is returned.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count_if("rest") / block).alias("n_rest"), F.ceil(F.count_if(~F.col("rest")) / block).alias("n_other"))
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), "n_rest")).otherwise(F.col("n_rest") + F.pmod(F.xxhash64("id"), F.greatest("n_other", F.lit(1))))
    dealt = rows.join(sizes, keys).withColumn("blk", own.cast("int"))
    last = F.when(F.col("rest"), F.col("n_rest") + F.col("n_other")).otherwise(F.col("n_rest")).cast("int") - 1
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last))).withColumn("low", F.least("blk", "with")).withColumn("high", F.greatest("blk", "with"))
    member = F.struct("id", "item")
    pairs = met.groupBy(*keys, "low", "high").agg(*(F.collect_list(F.when(F.col("blk") == F.col(side), member)).alias(side + "_rows") for side in ("low", "high")))
    fields = to_arrow_schema(StructType.fromDDL(f"a {kind}, b {kind}"))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                x, y = left.as_py(), right.as_py()
                if x and y:
                    yield pa.RecordBatch.from_pydict(dict(zip("ab", _spanning(x, y, linked([m["item"] for m in x], [m["item"] for m in y])))), schema=fields)

    return pairs.select("low_rows", "high_rows").mapInArrow(forest, f"a {kind}, b {kind}")


def _spanning(x: list, y: list, matrix) -> tuple[list[int], list[int]]:
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.setdefault(k, k) != k:
            root[k] = k = root[root[k]]
        return k

    a, b = [], []
    for i, j in zip(*(side.tolist() for side in matrix.nonzero())):
        p, q = x[i]["id"], y[j]["id"]
        if (rp := find(p)) != (rq := find(q)):
            root[rq] = rp
            a.append(p)
            b.append(q)
    return a, b

"""Pieces shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The folder of spark.checkpoint.dir that all executors share; in local mode a new one where none is set."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: Writes values as they are, so that the size of the files, by which Spark decides on broadcasts, is near that of the rows in memory.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder (in local mode a new one where none is set) and read it again.

    For loops: checkpoint() keeps the constraints of the plan that it cuts, and these multiply from round to round
    until the filters inferred from them no longer compile; a Parquet scan starts without any. options: of the Parquet writer.
    """
    session = df.sparkSession
    path = f"{shared_folder(session)}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return session.read.schema(df.schema).parquet(path)


class Deltas:
    """Rows that a loop finds, round by round: each round adds a part to one shared folder, and none is written again."""

    def __init__(self, session: SparkSession, schema: str):
        self._session, self._schema, self._rounds = session, schema, 0
        self._path = f"{shared_folder(session)}/deltas-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of df, as the newest part."""
        part = f"{self._path}/part{self._rounds}"
        df.select(*(c.split()[0] for c in self._schema.split(", "))).write.options(**PLAIN).parquet(part)
        self._rounds += 1
        return self._session.read.schema(self._schema).parquet(part)

    def all(self, rounds: int | None = None) -> DataFrame:
        """All rows, or those of the first so many rounds (one at least)."""
        return self._session.read.schema(self._schema).parquet(*(f"{self._path}/part{k}" for k in range(self._rounds if rounds is None else rounds)))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer splits than these, for work that costs far more than moving its rows; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[Column | str], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with its rows' places 1, 2, 3, ... by `order`, counted anew for each value of `keys`, which must lead that order.

    Rows are dealt in ranges of the order and sorted there, so that a key of any size spreads over many tasks; of each
    range (and key) one row is counted, and what earlier ranges hold is added. No task sees a key as a whole.
    """
    at, part, first, held = "__at", "__part", "__first", "__held"
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.expr("shiftright(__at, 33)")))
    sizes = placed.groupBy(part, *keys).agg(F.count("*").alias("__n"), F.min(at).alias(first))
    # as many rows as ranges, and as keys
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), first, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(held))
    same = placed[part] == starts[part]
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(starts[f"__k{i}"])
    place = (F.col(held) + F.col(at) - F.col(first) + 1).cast("long")
    return placed.join(starts, same).select(*(placed[c] for c in df.columns), place.alias(name))

"""Filter interaction audit: what each of five filters removes, by part of the corpus and in every order of the filters.

Files are processed as available-now micro-batches of a streaming query. A document's failures are a mask of five bits. Four
come from its text alone; the fifth, being a copy of a smaller doc_id's text, depends on all documents, seen or to come: the
state of a text is its smallest id so far with the parts and labels of the rows that hold it. A smaller id that arrives later
takes its place, and the mask that was counted for the old one is retracted from the counters and counted anew. Each
micro-batch writes its changes of the counters (part, label, mask, n) under its number, so a batch that is run again
overwrites its own; their sums are the audit, and kept, removed and the like follow from 32 counts a part.

Before the shuffle to the state each task reduces what it holds of a text to the rows of the smallest id, so a text with very
many copies is a row or so a task. One state row holds about TEXTS_PER_STATE texts (as many rows as the count of documents
asks for), since a Python call for each text would cost more than the rest.

Defined cases: null text is empty; a null part is the empty string; a null doc_id is no copy and makes none; rows of one
doc_id with the same text are no copies of each other; repeated label rows count as the largest; documents without labels
count for neither loss; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import shared_folder

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "#$%&*|"
COPY = 1 << FILTERS.index("E")
TEXTS_PER_STATE, BATCHES = 1000, 4
_CAPITALS, _INNER, _SYMBOLS = bytes(range(65, 91)), bytes(range(0x80, 0xC0)), SYMBOLS.encode()
_ROWS = "bucket long, digest binary, doc_id long, part string, label int, mask int, n long"
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_OUT = "part string, label int, mask int, n long"


def text_mask(text: bytes) -> int:
    """Failures of filters A to D on a text in UTF-8. bytes.split cuts at the six ASCII white-space characters and no others."""
    words = text.split()
    points = len(text.translate(None, _INNER))  # bytes that start a character
    short = len(words) < MIN_WORDS
    repeats = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)
    shouts = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MAX_CAPITAL_PERCENT * points
    odd = len(text.translate(None, _SYMBOLS)) < len(text)
    return short + 2 * repeats + 4 * shouts + 8 * odd


def masks(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, part, mask, digest, bucket) of docs(doc_id, source, text), batch or stream. bucket is a part of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(2).cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            bucket = np.frombuffer(b"".join(digests), "<u8")[::2] % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text_mask(t) for t in texts], pa.int32()), pa.array(digests, pa.binary()), pa.array(bucket.astype(np.int64))], names=["doc_id", "part", "mask", "digest", "bucket"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, part string, mask int, digest binary, bucket long")


def _settle(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(rows of each text's smallest id, rows whose failure of E is known: larger ids fail it, rows without id do not)."""
    known = rows.doc_id.notna()
    least = rows.groupby("digest").doc_id.transform("min")
    first = known & (rows.doc_id == least)
    settled = rows[~first].copy()
    settled["mask"] |= np.where(settled.doc_id.notna(), COPY, 0).astype(settled["mask"].dtype)
    return rows[first], settled


def reduced(rows: DataFrame) -> DataFrame:
    """Each batch of a task reduced: of a text only its smallest id stays open; settled rows are counts without a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            if not len(data):
                continue
            first, settled = _settle(data.assign(n=1))
            first = first.groupby(["bucket", "digest", "doc_id", "part", "label", "mask"], as_index=False).n.sum()
            settled = settled.groupby(["part", "label", "mask"], as_index=False).agg(n=("n", "sum"), bucket=("bucket", "first")).assign(digest=None, doc_id=None)
            for made in (first, settled):
                yield pa.RecordBatch.from_pandas(made[_NAMES], schema=fields, preserve_index=False)

    fields = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("label", pa.int32()), ("mask", pa.int32()), ("n", pa.int64())])
    return rows.select(*_NAMES[:-1]).mapInArrow(run, _ROWS)


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New rows of one state's texts against their smallest ids so far: changes of the counters."""
    came = pd.concat(list(batches), ignore_index=True)
    whole = came.digest.isna()
    settled = came[whole]
    new = came[~whole].assign(old=False)
    new["doc_id"] = new.doc_id.astype("int64")
    if state.exists:
        old = pa.ipc.open_stream(state.get[0]).read_all().to_pandas().assign(old=True)
        rows = pd.concat([old, new], ignore_index=True) if len(new) else old
    else:
        rows = new
    out = [settled[["part", "label", "mask", "n"]]]
    if len(new):
        copy = rows.doc_id > rows.groupby("digest").doc_id.transform("min")
        moved = rows[copy & rows.old]  # counted as first until now
        counted = pd.concat([rows[~rows.old], moved])
        fails = np.where(copy.loc[counted.index], COPY, 0)
        out += [counted.assign(mask=counted["mask"] | fails), moved.assign(n=-moved.n)]
        first = rows[~copy].groupby(["digest", "doc_id", "part", "label", "mask"], as_index=False).n.sum()
        state.update((_pack(first),))
    change = pd.concat([x[["part", "label", "mask", "n"]] for x in out]).groupby(["part", "label", "mask"], as_index=False).n.sum()
    yield change[change.n != 0].astype({"label": "int32", "mask": "int32", "n": "int64"})


def count_masks(docs: DataFrame, labels: DataFrame, n_docs: int, folder: str) -> DataFrame:
    """(part, label, mask, n) of the streaming DataFrame docs(doc_id, source, text), processed to its present end.

    labels(doc_id, quality, toxic) is read with each micro-batch. label: 1 if quality is 1, plus 2 if toxic is 1.
    """
    spark, counters = docs.sparkSession, f"{folder}/counters"
    spark.createDataFrame([], _OUT).write.parquet(f"{counters}/batch=-1")  # so that there is one, whatever comes
    is_one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((is_one("quality") + 2 * is_one("toxic")).alias("label"))
    marked = masks(docs, max(1, -(-n_docs // TEXTS_PER_STATE))).join(marks, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    changes = reduced(marked).groupBy("bucket").applyInPandasWithState(update, _OUT, "held binary", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "label", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{counters}/batch={number}")

    changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_OUT).parquet(counters).groupBy("part", "label", "mask").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from counts(part, label, mask, n)."""
    cells = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label").bitwiseAND(1) > 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("label").bitwiseAND(2) > 0, F.col("n")).otherwise(0)).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    passes = lambda what: F.expr(f"transform(sequence(0, 31), s -> aggregate(cells, 0L, (a, c) -> a + if(c.mask & s = 0, c.{what}, 0L)))")
    share = F.expr("transform(sequence(0, 4), f -> aggregate(cells, 0L, (a, c) -> a + if(c.mask & shiftleft(1, f) > 0, c.n * 120 div bit_count(c.mask), 0L)))")
    parts = parts.select("part", passes("n").alias("p"), passes("good").alias("g"), passes("toxic").alias("t"), share.alias("share"))
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = " + ".join(f"if(instr(filter_order, '{f}') < step, {1 << k}, 0)" for k, f in enumerate(FILTERS))
    steps = steps.withColumn("own", F.expr("ascii(substr(filter_order, step, 1)) - 65")).withColumn("before", F.expr(before)).withColumn("after", F.expr("before + shiftleft(1, own)"))
    lost = lambda a: F.col(a)[F.col("before")] - F.col(a)[F.col("after")]
    return steps.select(
        "part", "filter_order", "step", F.col("p")[F.col("after")].alias("kept"), lost("p").alias("removed"),
        (F.col("p")[0] - F.expr("p[shiftleft(1, own)]") - lost("p")).alias("redundant"), F.expr("p[31 - shiftleft(1, own)] - p[31]").alias("unique_fails"),
        lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.col("share")[F.col("own")].alias("shapley"))


def audit_files(spark: SparkSession, documents: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of all Parquet files at the path `documents`, in about so many micro-batches of files."""
    given = spark.read.parquet(documents)
    files = max(1, -(-len(given.inputFiles()) // batches))
    if documents.rstrip("/").split("/")[-1] in (x.split("/")[-1] for x in given.inputFiles()):
        documents = f"{documents[:-1]}[{documents[-1]}]"  # a stream takes a single file only by a pattern
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", files).parquet(documents)
    return audit(count_masks(stream, labels, given.count(), f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"))

"""Line dedup: lines that many documents share stay in one document only. DataFrame functions throughout.

Hashes of line keys are range-partitioned with their document and sorted by document and position, so that a frequent
line spreads over many partitions; each partition is streamed in that order and marks the first occurrence in every
document, and from these alone documents are counted and the keeper is found, combined before they meet.
The result is a compressed keep bitmap per document: 64-bit words of keep bits, present only where a line goes.

Defined cases: null or empty text is one empty line; rows of one doc_id count as one document and each distinct text
of it has its own bitmap; rows without doc_id keep no shared line and count for no document; ties cannot occur, as
the keeper is the largest doc_id; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, saved

MIN_CHARS, MIN_DOCS = 40, 5
#: Shared lines (40 bytes each) that may be broadcast; beyond it the join is shuffled and its skew split.
MAX_BROADCAST = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tid, pos, hash) of every line whose key has min_chars code points or more. tid tells texts of one doc_id apart."""
    texts = docs.select("doc_id", F.xxhash64(_text()).alias("tid"), _text().alias("text"))  # below the generator: once a text, not once a line
    lines = texts.select("doc_id", "tid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", F.translate(F.btrim("line", F.lit(_SPACE)), _UPPER, _LOWER)).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "tid", "pos", F.unhex(F.md5("key")).alias("hash"))


def first_occurrences(hashes: DataFrame) -> DataFrame:
    """hashes in ranges of (hash, doc_id), sorted by (hash, doc_id, pos); first marks a document's first line with the hash."""
    ranged = hashes.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id", "pos")
    in_document = Window.partitionBy("hash", "doc_id").orderBy("pos")  # ranges and order fit: no further shuffle or sort
    return ranged.withColumn("first", F.row_number().over(in_document) == 1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tid, n_dropped, keep: map of word number to 64 keep bits) of the documents that lose a line."""
    ordered = saved(first_occurrences(saved(line_hashes(docs, min_chars))))  # saved before as well, since ranges are sampled
    shared = ordered.where("first").groupBy("hash").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = broadcast_if_small(cut(shared), MAX_BROADCAST)  # apart from the join, so that a frequent line's rows can be split
    drops = ordered.join(shared, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "tid", "pos").distinct()
    words = drops.groupBy("doc_id", "tid", F.expr("cast(pos div 64 AS bigint)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.count("*").alias("n"))
    return words.groupBy("doc_id", "tid").agg(F.sum("n").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text reduced to its kept lines, and n_lines (before) and n_dropped added, in place of columns of these names."""
    text = F.coalesce("d.text", F.lit(""))
    lines = F.split(text, "\n", -1)
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(text) == F.col("b.tid"))
    word = lambda i: F.coalesce(F.try_element_at("b.keep", F.floor(i / 64)), F.lit(-1).cast("long"))
    kept = F.filter(lines, lambda x, i: F.call_function("shiftright", word(i), i % 64).bitwiseAND(1) == 1)
    made = {
        "text": F.when(F.col("b.keep").isNull(), text).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce("b.n_dropped", F.lit(0)).cast("long"),
    }
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.alias("d").join(bitmaps.alias("b"), same, "left")
    return joined.select(*(made["text"].alias("text") if c == "text" else F.col(f"d.`{c}`") for c in others), *(made[c].alias(c) for c in ("n_lines", "n_dropped")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))

"""SimHash near-dedup: 64-bit fingerprints, linked at three or fewer differing bits, grouped by components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Two fingerprints that differ in d bits are at
Manhattan distance d or less there, so with d <= 3 one of the two halves of 16 segments is at distance 0 or 1. Each
half is a grid of unit cells; a range join visits the own cell and the cells one step up, filters by the distance of
the whole embedding (the lower bound) and verifies by the differing bits. Equal fingerprints are joined once.

Defined cases: null or blank text has fingerprint zero and links like any other; rows of one doc_id keep their own
fingerprints; a null doc_id is never a component's name unless all its members lack one; empty tables give empty
results; columns of the input other than doc_id and text are ignored (near_dedup keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, block_links, components, cut, map_batches

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Rows of a grid cell from which its fingerprints are compared block by block instead of pair by pair.
HOT_CELL, BLOCK = 128, 1024
_word = re.compile(WORD)
_upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = _word.findall((text or "").translate(_upper) if text and not text.isascii() else (text or "").lower())
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < SHINGLE else map(" ".join, zip(words, words[1:], words[2:]))
    digest, seed = xxhash.xxh64_digest, SEED
    hashes = b"".join([digest(s.encode(), seed) for s in shingles])
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 18):  # long texts by pieces, so that memory stays bounded
        total += np.unpackbits(np.frombuffer(hashes[k : k + (1 << 18)], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes) // 8).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, fp); tid is the hash of the text."""
    read = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    return map_batches(read, lambda c: {"doc_id": c["doc_id"], "tid": c["tid"], "fp": [fingerprint(t) for t in c["text"]]}, "doc_id long, tid long, fp long")


def _embedded(fps: DataFrame) -> DataFrame:
    """Adds emb: 32 two-bit fields, each the number of set bits of its segment."""
    half = "(({0} & 1431655765L) + (shiftrightunsigned({0}, 1) & 1431655765L))"
    return fps.withColumn("emb", F.expr(f"shiftleft({half.format('shiftrightunsigned(fp, 32)')}, 32) | {half.format('fp')}"))


#: Manhattan distance of two packed embeddings: each field's difference is 0, 1 or 2.
def _distance(a: str, b: str) -> str:
    low, high = "6148914691236517205L", "-6148914691236517206L"
    differ = f"({a} ^ {b})"  # fields 0, 1, 2: 1^0 = 01, 2^0 = 10, 2^1 = 11
    return f"(bit_count({differ} & {low}) + 2 * bit_count({differ} & {high} & ~shiftleft({differ} & {low}, 1)))"


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT_CELL) -> DataFrame:
    """Links (a, b) between the reps of fps(rep, fp), enough of them to give the same components as all links."""
    fps = _embedded(fps)
    halves = fps.select("rep", "fp", "emb", F.posexplode(F.array(F.expr("shiftrightunsigned(emb, 32)"), F.expr("emb & 4294967295L"))).alias("half", "cell"))
    steps = F.expr("transform(filter(sequence(0, 15), s -> (shiftright(cell, 2 * s) & 3) < 2), s -> cell + shiftleft(1L, 2 * s))")
    probes = halves.unionByName(halves.withColumn("cell", F.explode(steps)))
    crowded = cut(halves.groupBy("half", "cell").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("half", "cell"))
    none = crowded.isEmpty()
    own = halves if none else halves.join(crowded, ["half", "cell"], "left_anti")
    p, q = own.alias("p"), probes.alias("q")
    same = (F.col("p.half") == F.col("q.half")) & (F.col("p.cell") == F.col("q.cell")) & (F.col("p.fp") != F.col("q.fp"))
    near = F.expr(f"{_distance('p.emb', 'q.emb')} <= {max_bits} AND bit_count(p.fp ^ q.fp) <= {max_bits}")
    links = p.join(q, same & near).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
    if none:
        return links
    members = probes.join(crowded, ["half", "cell"]).select("half", "cell", F.col("rep").alias("id"), F.col("fp").alias("item"), F.lit(True).alias("rest"))
    return links.unionByName(block_links(members, ["half", "cell"], BLOCK, lambda x, y: _bits_apart(x, y) <= max_bits))


def _bits_apart(x: list[int], y: list[int]) -> np.ndarray:
    return np.bitwise_count(np.array(x, np.int64).view(np.uint64)[:, None] ^ np.array(y, np.int64).view(np.uint64)[None, :])


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, fp, component_id) for every row of docs. Fingerprints are the nodes, so those of rows without doc_id link as well."""
    prints = cut(fingerprints(docs))
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = components(near_links(fps.select(F.col("fp").alias("rep"), "fp")))
    named = cut(fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "tid", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, the one with the smallest doc_id.

    Rows without doc_id stay, and so do all rows of the document that stays; of a repeated doc_id only the texts go that have another keeper.
    """
    goes = near_groups(docs).where("doc_id <> component_id").select("doc_id", "tid").distinct()
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.tid"))
    return docs.alias("d").join(goes.alias("g"), same, "left_anti")

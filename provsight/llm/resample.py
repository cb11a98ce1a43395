"""Target-distribution importance resampling: draw the documents whose word runs look most like the target's.

Features are all runs of one to three words, hashed into buckets. A bucket's gain is the logarithm of how much more of the
target's features it holds than of the corpus's; a document's weight is the sum of its features' gains, its score the weight
with Gumbel noise that its id seeds, and the highest scores are drawn (sampling without replacement in proportion to
exp(weight)). Buckets are found once, by Arrow kernels over slices of a batch: ascii_lower, split_pattern_regex,
list_flatten and dictionary_encode; shifted dictionary indices make the pairs and triples, whose checksums are computed once
for each distinct one from those of its parts. They are kept as two bytes a feature, so that the second pass only looks
gains up. Counts are summed in each task and then by bucket; the gains are as many numbers as there are buckets.

Defined cases: null or empty text has no features and weight 0; rows of one doc_id are scored apart; a null doc_id seeds
its noise as the text "null" and comes last among ties; an empty corpus gives an empty result; an empty target leaves the
gains to the corpus's counts; other columns are ignored. Ranks of documents that are not drawn are null.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import numbered
from .common import saved

BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 42, 20, 5
#: What separates words, after lower-casing: ASCII but digits and small letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once; a single longer text is split alone.
SLICE_BYTES = 2_000_000
_STEP = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _shift_tables() -> np.ndarray:
    """By length 0 to _STEP, place of a byte and its value: what a checksum's byte becomes when so many zero bytes follow."""
    one, value = _byte_table(), np.arange(256, dtype=np.uint32)
    out = np.empty((_STEP + 1, 4, 256), np.uint32)
    out[0] = np.stack([value << np.uint32(8 * k) for k in range(4)])
    for n in range(1, _STEP + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ one[out[n - 1] & np.uint32(255)]
    return out


_ONE, _SHIFT = _byte_table(), _shift_tables()


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    return _SHIFT[by, 0, crc & 255] ^ _SHIFT[by, 1, (crc >> 8) & 255] ^ _SHIFT[by, 2, (crc >> 16) & 255] ^ _SHIFT[by, 3, crc >> 24]


def crc_joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums of left + " " + right from those of both and the sizes in bytes of the right parts."""
    flipped = ~left
    crc = ~(_ONE[(flipped ^ np.uint32(32)) & np.uint32(255)] ^ (flipped >> np.uint32(8)))
    by = size.copy()
    while (far := np.flatnonzero(by > _STEP)).size:
        crc[far] = _shifted(crc[far], np.full(far.size, _STEP))
        by[far] -= _STEP
    return _shifted(crc, by) ^ right


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the distinct codes each is, the place of each distinct code's first)."""
    coded = pa.array(codes).dictionary_encode()
    index = coded.indices.to_numpy()
    first = np.zeros(len(coded.dictionary), np.int64)
    first[index[::-1]] = np.arange(len(index))[::-1]
    return index.astype(np.int64), first


def _sized(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about SLICE_BYTES."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, list[bytes]]:
    """(words, buckets of all features as little-endian 16-bit numbers) of each text."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATOR)
    words, of = pc.list_flatten(split), pc.list_parent_indices(split).to_numpy()
    full = pc.not_equal(words, "")  # a separator at either end leaves an empty piece
    words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    size = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    crc = np.fromiter((zlib.crc32(w.encode()) for w in distinct.to_pylist()), np.uint32, len(distinct))
    # place: where a run starts; run: its number among the distinct ones of its width; run_crc: their checksums
    place, run, run_crc = np.arange(len(of)), index, crc
    found, owner = [crc[index]], [of]
    for more in (1, 2):
        longer = np.flatnonzero(place + more < len(of))
        longer = longer[of[place[longer]] == of[place[longer] + more]]
        place, left = place[longer], run[longer]
        right = index[place + more]
        run, first = _distinct(left * max(len(distinct), 1) + right)
        run_crc = crc_joined(run_crc[left[first]], crc[right[first]], size[right[first]])
        found.append(run_crc[run])
        owner.append(of[place])
    by_text = np.concatenate(owner).astype(np.uint16 if len(texts) < 1 << 16 else np.int64)
    bucket = (np.concatenate(found) % np.uint32(buckets)).astype("<u2")[np.argsort(by_text, kind="stable")].tobytes()
    ends = 2 * np.cumsum(np.bincount(by_text, minlength=len(texts)))
    return np.bincount(of, minlength=len(texts)), [bucket[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def hashed_features(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets): two bytes for each feature of the text. doc_id is null where docs has none."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in _sized(batch.column(1).cast(pa.string())):
                n_words, found = feature_buckets(part, buckets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], schema=fields)
                start += len(part)

    key = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(key.alias("doc_id"), text).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_buffer(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """By bucket: floor(1000 ln of the smoothed share in the target over that in the corpus). At most `buckets` rows a side come to the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for row in counts.collect():
            into[row.bucket] = row.n
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * whole_s / ((float(x) + 1) * whole_t))) for x, y in zip(s, t)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 times a Gumbel number) that the id seeds."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            weight = np.array([int(gain[x].sum()) for x in held], np.int64)  # text by text, so that memory follows the longest
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            sizes = pa.array([len(x) for x in held], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(weight), pa.array(score)], names=names)

    return features.select("doc_id", "n_words", "buckets").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank 1, 2, ... of the percent drawn of those with min_words words, else null."""
    features = saved(hashed_features(docs, buckets=buckets))
    gain = gains(bucket_counts(features, buckets), bucket_counts(hashed_features(target, buckets=buckets), buckets), buckets)
    placed = numbered(scored(features, gain, seed).withColumn("apart", F.col("n_words") < min_words), ["apart", F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    n_drawn = percent * placed.where(~F.col("apart")).count() // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(~F.col("apart") & (F.col("place") <= n_drawn), F.col("place")).alias("rank"))

"""Benchmark decontamination by greedy string tiling.

Seeds are the five-token shingles of the test items. A document shares seeds with an item or it cannot hold a tile of
it; seeds give an upper bound of the coverage, and pairs under the threshold end there. For the others the longest
common run of unmarked tokens is found again and again by Karp-Rabin hashes of decreasing length and marked on both
sides, so passages count in whatever order they stand. A pair is contaminated when its tiles cover enough of the item.

The items travel to the executors only while they are small (MAX_BROADCAST_CHARS, checked); beyond it, seeds of items
and documents meet in a shuffled join and texts follow their pairs.

Defined cases: tokens are runs of letters, digits and underscores, lower-cased; null or empty texts have none; items
shorter than a seed count as one seed of their whole length; repeated rows each give their rows; empty tables give an
empty result; other columns are ignored (drop_contaminated keeps the documents' columns, and all rows of a doc_id go
together).
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, map_batches, saved

MIN_MATCH, COVERAGE = 5, 0.5
MAX_BROADCAST_CHARS = 8_000_000
#: Seeds of the items (16 bytes here) that may be broadcast to leave out others.
MAX_BROADCAST_SEEDS = 1_000_000
_token = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SCHEMA = "doc_id long, item_id long, n_tokens int, covered int, n_tiles int"


def tokens(text: str | None) -> list[str]:
    return _token.findall((text or "").lower())


def _windows(ids: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the windows without a marked token."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    value, power, done = np.zeros(n, np.uint64), ids.astype(np.uint64) + np.uint64(1), 0
    base, span = np.full(1, _BASE), 1  # an array: its products wrap without a warning
    while done < length:  # the hash of `length` tokens from hashes of 1, 2, 4, ... tokens
        if length >> (span.bit_length() - 1) & 1:
            value = value * base + power[done : done + n]
            done += span
        if done < length:
            power = power[:-span] * base + power[span:]
            base, span = base * base, span * 2
    gaps = np.concatenate(([0], np.cumsum(~free)))
    ok = np.flatnonzero(gaps[length:] == gaps[:-length])
    return ok, value[ok]


def tile(item: list[str], doc: list[str], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length) of the longest non-overlapping matches, longest first."""
    code: dict[str, int] = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a = np.array([code[w] for w in item], np.int64)
    b = np.array([code.get(w, -1) for w in doc], np.int64)
    free_a, free_b, tiles, top = np.ones(len(a), bool), b >= 0, [], min(len(a), len(b))

    def occurs(length: int) -> bool:
        return bool(np.isin(_windows(a, free_a, length)[1], _windows(b, free_b, length)[1]).any())

    def mark(length: int) -> None:
        """Marks the matches of this length, by item and document position; a run of one word has very many."""
        sa, ha = _windows(a, free_a, length)
        sb, hb = _windows(b, free_b, length)
        order = np.argsort(hb, kind="stable")
        sb, hb = sb[order], hb[order]
        gaps = np.concatenate(([0], np.cumsum(~free_b)))
        for i, low, high in zip(sa.tolist(), np.searchsorted(hb, ha).tolist(), np.searchsorted(hb, ha, "right").tolist()):
            if low < high and free_a[i : i + length].all():
                starts = sb[low:high][gaps[sb[low:high] + length] == gaps[sb[low:high]]]
                for j in starts.tolist():  # the first, unless hashes collide
                    if (a[i : i + length] == b[j : j + length]).all():
                        free_a[i : i + length] = free_b[j : j + length] = False
                        tiles.append((i, j, length))
                        gaps = np.concatenate(([0], np.cumsum(~free_b)))
                        break

    while top >= least:
        low, high = least - 1, top  # a common run of n tokens holds one of n - 1, so the longest can be bisected
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if occurs(mid) else (low, mid - 1)
        if low < least:
            break
        mark(low)
        top = low - 1 if low == top else low
    return tiles


def _seeds(words: list[str], width: int) -> list[tuple[str, ...]]:
    width = min(width, len(words))
    return list(zip(*(words[k:] for k in range(width)))) if width else []


def _covered_by_seeds(item: list[str], found: set, least: int) -> int:
    mask = np.zeros(len(item), bool)
    for k, seed in enumerate(_seeds(item, least)):
        if seed in found:
            mask[k : k + least] = True
    return int(mask.sum())


def _rows(doc_id, words: list[str], found: set, items: list[tuple], least: int, coverage: float):
    for item_id, item in items:
        if _covered_by_seeds(item, found, least) >= coverage * len(item):
            tiles = tile(item, words, min(least, len(item)))
            if (covered := sum(n for _, _, n in tiles)) >= coverage * len(item):
                yield doc_id, item_id, len(item), covered, len(tiles)


def contaminated(docs: DataFrame, items: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, max_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, n_tokens, covered, n_tiles) of every document and item whose tiles cover enough of the item."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("item_text"))
    size = items.agg(F.coalesce(F.sum(F.char_length("item_text") + 16), F.lit(0))).first()[0]
    found = _by_broadcast if size <= max_chars else _by_join
    return found(docs.select("doc_id", "text"), items, least, coverage)


def _by_broadcast(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    parsed = [(r["item_id"], w) for r in items.collect() if (w := tokens(r["item_text"]))]  # at most MAX_BROADCAST_CHARS
    shared = docs.sparkSession.sparkContext.broadcast(parsed)
    index: dict = {}

    def look_up() -> dict:
        if not index:  # once a worker
            by_seed = defaultdict(set)
            for k, (_, words) in enumerate(shared.value):
                for seed in _seeds(words, least):
                    by_seed[seed].add(k)
            index.update(by_seed=by_seed, vocabulary={w for seed in by_seed for w in seed}, short={n for _, w in shared.value if (n := len(w)) < least})
        return index

    def make(columns: dict[str, list]) -> dict[str, list]:
        know, out = look_up(), []
        by_seed, vocabulary = know["by_seed"], know["vocabulary"]
        for doc_id, text in zip(columns["doc_id"], columns["text"]):
            words = tokens(text)
            known = np.fromiter(map(vocabulary.__contains__, words), bool, len(words))
            hits: dict[int, set] = defaultdict(set)
            for width in (least, *know["short"]):
                if (n := len(words) - width + 1) > 0:
                    run = np.concatenate(([0], np.cumsum(known)))
                    for k in np.flatnonzero(run[width:] - run[:-width] == width).tolist():
                        for item in by_seed.get(seed := tuple(words[k : k + width]), ()):
                            hits[item].add(seed)
            for item, seeds in hits.items():
                out.extend(_rows(doc_id, words, seeds, [shared.value[item]], least, coverage))
        return dict(zip(("doc_id", "item_id", "n_tokens", "covered", "n_tiles"), zip(*out) if out else [[]] * 5))

    return map_batches(docs, make, _SCHEMA)


def _by_join(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """The same rows for items of any size. A text of its own is told by its hash, as doc_id may repeat.

    Of the documents' seeds only those that an item has are shuffled. A pair's seeds are counted before any text is fetched: a
    seed covers `least` tokens at most, so pairs with too few for the coverage (a common phrase and no more) end there.
    """

    def hashed(texts: list, widths: set[int] | None):
        for k, text in enumerate(texts):
            words = tokens(text)
            of = widths or {min(least, len(words))}
            for seed in {s for w in of if 0 < w <= len(words) for s in _seeds(words, w)}:
                yield k, len(words), xxhash.xxh3_64_intdigest("\x1f".join(seed).encode("utf-8", "surrogatepass")) - (1 << 63)

    def seeds_of(widths: set[int] | None):
        def make(c: dict[str, list]) -> dict[str, list]:
            out = [(c["id"][k], c["tid"][k], n, seed) for k, n, seed in hashed(c["text"], widths)]
            return dict(zip(("id", "tid", "n", "seed"), zip(*out) if out else [[]] * 4))

        return make

    schema = "id long, tid long, n int, seed long"
    docs = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tid"), "text")
    items = items.select(F.col("item_id").alias("id"), F.xxhash64("item_text").alias("tid"), F.col("item_text").alias("text"))
    of_items = saved(map_batches(items, seeds_of(None), schema).select(F.col("id").alias("item_id"), F.col("tid").alias("iid"), F.col("n").alias("n_item"), "seed"))
    widths = {r["w"] for r in of_items.select(F.least("n_item", F.lit(least)).alias("w")).distinct().collect()}  # as many as `least` at most
    known = broadcast_if_small(of_items.select("seed").distinct(), MAX_BROADCAST_SEEDS)
    of_docs = map_batches(docs, seeds_of(widths | {least}), schema).join(known, "seed", "left_semi").select(F.col("id").alias("doc_id"), "tid", "seed")
    met = of_docs.join(of_items, "seed").groupBy("doc_id", "tid", "item_id", "iid", "n_item").agg(F.count("*").alias("shared"))
    pairs = cut(met.where(F.col("shared") * F.least("n_item", F.lit(least)) >= coverage * F.col("n_item")).select("doc_id", "tid", "item_id", "iid"))
    d, i = docs.toDF("d2", "t2", "text"), items.toDF("i2", "j2", "item_text")  # repeated rows each give their rows
    read = pairs.join(d, pairs["doc_id"].eqNullSafe(d["d2"]) & (pairs["tid"] == d["t2"])).join(i, F.col("item_id").eqNullSafe(F.col("i2")) & (F.col("iid") == F.col("j2")))

    def make(columns: dict[str, list]) -> dict[str, list]:
        out = []
        for doc_id, text, item_id, item_text in zip(*columns.values()):
            words, item = tokens(text), tokens(item_text)
            out.extend(_rows(doc_id, words, set(_seeds(words, min(least, len(item)))), [(item_id, item)], least, coverage))
        return dict(zip(("doc_id", "item_id", "n_tokens", "covered", "n_tiles"), zip(*out) if out else [[]] * 5))

    return map_batches(read.select("doc_id", "text", "item_id", "item_text"), make, _SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """docs without those that hold enough of an item; rows without doc_id are told by the hash of their text.

    Few documents go, so their names are counted and then sent or shuffled.
    """
    unnamed = F.col("doc_id").isNull()
    named = contaminated(docs.where(~unnamed), items, least, coverage).select(F.lit(False).alias("unnamed"), "doc_id")
    others = contaminated(docs.where(unnamed).select(F.xxhash64("text").alias("doc_id"), "text"), items, least, coverage).select(F.lit(True).alias("unnamed"), "doc_id")
    goes = broadcast_if_small(cut(named.unionByName(others).distinct()), 1_000_000).alias("g")
    name = F.when(F.col("d.doc_id").isNull(), F.xxhash64("d.text")).otherwise(F.col("d.doc_id"))
    return docs.alias("d").join(goes, (F.col("d.doc_id").isNull() == F.col("g.unnamed")) & (name == F.col("g.doc_id")) & (F.col("d.doc_id").isNotNull() | F.col("d.text").isNotNull()), "left_anti")

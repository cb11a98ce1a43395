"""Substring dedup: passages that occur again, by MinHash bands over paragraphs, exact comparison and components.

There are two kinds of paragraphs, both read in one pass over the texts.

* A line of MIN_WORDS words or more. Its bands are of ROWS minima over five-word shingles, as many as tune_bands finds
  for RECALL at SIMILARITY. Equal lines (128 bits of their words) are one node. Nodes that share a band collide; each is
  compared with its bucket's pivot, those not linked to that with all of the bucket, by exact Jaccard of the shingles.
  Links make components.
* Every LENGTH words in a row, over line ends (a sliding paragraph), for passages that are part of a line or spread over
  lines. It has one band of one minimum, over shingles of GRAM words: where words only need to be equal, that has a recall
  of 1, since equal paragraphs have equal minima. Sliding paragraphs that follow each other mostly share their minimum, so
  the rows are the different minima, about one for 16 words. Colliding minima stand for GRAM words compared by 96 bits,
  and the words from one minimum to the end of the next by 32 more before they make one span.

So passages of LENGTH equal words are found wherever they stand, and lines that differ in a few words. Of each cluster
one paragraph stays, the first by (doc_id, pos); the others are removals. A span reaches from the first to the last of
its minima: up to LENGTH - GRAM words at either end of a passage may be outside it. The rows of spans leave out the
lines that have rows of their own (of a span that is removed, only the removed lines).

Defined cases: null or empty text has no paragraph; copies within one document count, unless they overlap the copy that
stays; ties on doc_id are broken by position; rows without doc_id sort last; a word repeated without end is one passage
in each text; an empty table gives an empty result; columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import block_links, broadcast_if_small, components, cut, map_batches, saved
from .words import Words, chunks, ranges, rolled

SHINGLE, MIN_WORDS, SIMILARITY, RECALL, ROWS = 5, 20, 0.8, 0.999, 3
LENGTH, GRAM = 50, 20
#: Pairs of a bucket (members by those not linked to its pivot) from which they are compared by blocks, and the rows of a block.
HOT_PAIRS, BLOCK = 1024, 128
#: Places of lines that may be broadcast when their texts are fetched (some 60 bytes each).
MAX_BROADCAST = 200_000
_mix = np.random.default_rng(20240501).integers(1, 2**63, size=(4, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = ("doc_id", "text_id", "word", "n_words", "pos", "start", "n_chars")
_DIGEST = "kind int, doc_id long, text_id long, word int, n_words int, pos int, start int, n_chars int, hash binary, bands array<long>, h1 long, h2 int, gap int, step int"


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` minima that make a pair at `similarity` collide with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _bands(shingles: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band keys of each run of shingles that starts at `first`."""
    out = np.empty((len(first), bands), np.uint64)
    high = shingles >> np.uint64(32)
    for b in range(bands):
        key = np.full(len(first), np.uint64(b + 1) * _mix[0, 0])
        for r in range(rows):
            low = np.minimum.reduceat((shingles * _mix[1, b * rows + r]) ^ (high * _mix[2, b * rows + r]), first)
            key = (key ^ low) * _mix[3, r + 1]
            key ^= key >> np.uint64(31)
        out[:, b] = key
    return out.view(np.int64)


def _rows_of(batch: pa.RecordBatch, names: pa.Schema, bands: int, min_words: int) -> Iterator[pa.RecordBatch]:
    def made(text: np.ndarray, k0: int, **columns) -> pa.RecordBatch:
        at = pa.array(text + k0)
        known = {"doc_id": batch.column(0).take(at), "text_id": batch.column(1).take(at)} | columns
        empty = pa.nulls(len(text))
        return pa.RecordBatch.from_arrays([known[f.name] if isinstance(known.get(f.name), pa.Array) else pa.array(known[f.name], f.type) if f.name in known else empty.cast(f.type) for f in names], schema=names)

    for k0, texts in chunks([t or "" for t in batch.column(2).to_pylist()]):
        words = Words(texts)
        if len(words.hash) < min(min_words, LENGTH):
            continue
        first = np.flatnonzero(np.diff(words.line, prepend=-1))
        size = np.diff(np.append(first, len(words.line)))
        first, size = first[size >= min_words], size[size >= min_words]
        if len(first):
            shingles = rolled(words.hash, SHINGLE, 0)[ranges(first, size - SHINGLE + 1)]
            keys = _bands(shingles, np.cumsum(size - SHINGLE + 1) - (size - SHINGLE + 1), bands, ROWS)
            text, line = words.text[first], words.line[first]
            start = words.lines[line]
            digest = np.stack((words.sums(first, size, 6), words.sums(first, size, 14)), 1).tobytes()
            yield made(
                text, k0, kind=np.zeros(len(first), np.int32), word=first - np.searchsorted(words.text, text), n_words=size, pos=line - words.first_line(text), start=start - words.offsets[text],
                n_chars=words.lines[line + 1] - 1 - start, hash=pa.array([digest[k : k + 16] for k in range(0, len(digest), 16)], pa.binary()),
                bands=pa.ListArray.from_arrays(np.arange(0, bands * len(first) + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))))
        at = _minima(words)
        if len(at):
            text = words.text[at]
            step = np.where(np.diff(text, append=-1) == 0, np.diff(at, append=0), 0)
            yield made(
                text, k0, kind=np.ones(len(at), np.int32), word=at - np.searchsorted(words.text, text), n_words=np.full(len(at), GRAM), pos=words.line[at] - words.first_line(text), start=words.start[at] - words.offsets[text],
                n_chars=words.end[at + GRAM - 1] - words.start[at], h1=rolled(words.hash, GRAM, 22)[at].view(np.int64), h2=(rolled(words.hash, GRAM, 25)[at] >> np.uint64(33)).astype(np.int32),
                gap=(words.sums(at, step + GRAM, 30) >> np.uint64(33)).astype(np.int32), step=step)


def _minima(words: Words) -> np.ndarray:
    """The first words of the least GRAM-word shingles of all sliding paragraphs, each once.

    Of equal ones in a paragraph the first counts, unless the one before still is in it: a word repeated without end has a
    row for every 31 words. Equal paragraphs have equal shingles in any case.
    """
    if len(words.hash) < LENGTH:
        return np.empty(0, np.int64)
    h = rolled(words.hash, GRAM, 22)
    width = LENGTH - GRAM + 1
    starts = np.arange(len(h) - width + 1)
    whole = words.text[: len(starts)] == words.text[LENGTH - 1 :]
    starts = starts[whole]
    least = starts + np.lib.stride_tricks.sliding_window_view(h, width).argmin(1)[whole]
    new = np.flatnonzero(np.diff(least, prepend=-1) != 0)
    at, first = least[new], starts[new]
    again = (h[at[1:]] == h[at[:-1]]) & (words.text[at[1:]] == words.text[at[:-1]]) & (first[1:] == starts[new[1:] - 1] + 1)
    if not again.any():
        return at
    keep = np.ones(len(at), bool)
    runs = np.flatnonzero(np.diff(again, prepend=False, append=False))  # at[a], ..., at[b] are equal shingles
    for a, b in zip(runs[::2].tolist(), runs[1::2].tolist()):
        keep[a : b + 1] = False
        stop = int(starts[new[b + 1] - 1]) if b + 1 < len(new) else int(starts[-1])
        start = int(first[a])
        while start <= stop:  # the last that the paragraph at `start` holds serves all paragraphs up to its own
            k = int(np.searchsorted(at[a : b + 1], start + width, "left")) - 1 + a
            keep[k] = True
            start = int(at[k]) + 1
    return at[keep]


def paragraphs(docs: DataFrame, bands: int, min_words: int = MIN_WORDS) -> DataFrame:
    """Both kinds of paragraphs. kind 0, lines: hash and bands; kind 1, minima of sliding paragraphs: h1 and h2 of the GRAM words,
    step (words to the next one, 0 at the last) and gap (hash of the words to the end of the next). start and n_chars are code points."""
    if min_words < SHINGLE:
        raise ValueError(f"a paragraph has {SHINGLE} words at least")
    names = to_arrow_schema(StructType.fromDDL(_DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows_of(batch, names, bands, min_words)

    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(run, _DIGEST)


def _sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for _, part in chunks(lines):
        words = Words(part)
        h = rolled(words.hash, SHINGLE, 0)
        edge = np.searchsorted(words.text, np.arange(len(part) + 1))
        out += [np.unique(h[a : b - SHINGLE + 1]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _similar(x: list[str], y: list[str], least: float) -> np.ndarray:
    sets = _sets([*x, *y])
    ids, place = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(sets), len(ids)), np.float32)
    has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    a, b = has[: len(x)], has[len(x) :]
    both = a @ b.T
    return both >= least * (a.sum(1)[:, None] + b.sum(1)[None, :] - both) - 1e-3


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of hashes whose lines are similar."""
    side = lambda k, name: texts.select(F.col("hash").alias(k), F.col("line").alias(name))
    read = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def make(c: dict[str, list]) -> dict[str, list]:
        number = {t: k for k, t in enumerate(dict.fromkeys((*c["x"], *c["y"])))}
        sets = _sets(list(number))
        good = [k for k, (x, y) in enumerate(zip(c["x"], c["y"])) if jaccard(sets[number[x]], sets[number[y]]) >= least]
        return {k: [c[k][i] for i in good] for k in "ab"}

    return map_batches(read, make, "a binary, b binary")


def _texts(docs: DataFrame, lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, line) of these hashes: one place of each is looked up in its document."""
    places = lines.join(broadcast_if_small(hashes, MAX_BROADCAST), "hash", "left_semi").groupBy("hash").agg(F.min(F.struct("doc_id", "text_id", "start", "n_chars")).alias("at"))
    places = broadcast_if_small(cut(places.select("hash", "at.*")), MAX_BROADCAST)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    met = texts.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_id") == F.col("p.text_id")))
    line = F.substring("text", F.col("start") + 1, F.col("n_chars"))
    return met.select("hash", line.alias("line")).groupBy("hash").agg(F.min("line").alias("line"))  # of rows that repeat


def similar_links(docs: DataFrame, lines: DataFrame, least: float = SIMILARITY, hot: int = HOT_PAIRS) -> DataFrame:
    """Links (a, b) between the hashes of different lines, enough for the components of all links that the bands find.

    Members of a bucket that are linked to its pivot (the least hash) are one component, so only the others meet all of the
    bucket: pair by pair, or, from `hot` pairs on, block by block.
    """
    nodes = lines.groupBy("hash").agg(F.first("bands").alias("bands"))
    keyed = saved(nodes.select("hash", F.explode("bands").alias("key")))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("hash").alias("pivot")).where("n > 1")
    members = saved(keyed.join(buckets, "key"))
    texts = saved(_texts(docs, lines, members.select("hash").distinct()))
    star = saved(_verified(members.where("hash <> pivot").select(F.col("pivot").alias("a"), F.col("hash").alias("b")).distinct(), texts, least))
    linked = star.select(F.col("a").alias("pivot"), F.col("b").alias("hash"), F.lit(True).alias("linked"))
    known = members.join(linked, ["pivot", "hash"], "left").withColumn("rest", F.col("linked").isNull() & (F.col("hash") != F.col("pivot"))).drop("linked")
    rests = saved(known.groupBy("key").agg(F.count_if("rest").alias("n_rest")).where("n_rest > 0"))
    if rests.isEmpty():
        return star
    open_ = saved(known.where("hash <> pivot").join(rests, "key"))
    cold = open_.where(F.col("n_rest") * F.col("n") <= hot)
    p, q = cold.where("rest").alias("p"), cold.alias("q")
    once = (F.col("p.key") == F.col("q.key")) & (F.col("p.hash") != F.col("q.hash")) & (~F.col("q.rest") | (F.col("p.hash") < F.col("q.hash")))
    pairs = p.join(q, once).select(F.least("p.hash", "q.hash").alias("a"), F.greatest("p.hash", "q.hash").alias("b")).distinct()
    links = star.unionByName(_verified(pairs, texts, least))
    crowded = open_.where(F.col("n_rest") * F.col("n") > hot)
    if crowded.isEmpty():
        return links
    rows = crowded.join(texts, "hash").select("key", F.col("hash").alias("id"), F.col("line").alias("item"), "rest")
    return links.unionByName(block_links(rows, ["key"], BLOCK, lambda x, y: _similar(x, y, least), "binary"))


def _order():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_id", "word", "pos", "gap")


def similar_lines(docs: DataFrame, digest: DataFrame, least: float = SIMILARITY, hot: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, text_id, word, n_words, pos, start, n_chars, keeper_doc, keeper_pos, n_copies, removed) of each line that has a near copy."""
    lines = digest.where("kind = 0")
    groups = components(similar_links(docs, lines, least, hot))
    counted = lines.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")).alias("first"))
    named = saved(counted.join(groups, counted["hash"] == groups["node"], "left").select("hash", "n", "first", F.coalesce("component", "hash").alias("cluster")))
    clusters = named.groupBy("cluster").agg(F.sum("n").alias("n_copies"), F.min("first").alias("keeper")).where("n_copies > 1")
    verdict = saved(named.join(clusters, "cluster").select("hash", "n_copies", F.col("keeper.doc_id").alias("keeper_doc"), F.col("keeper.pos").alias("keeper_pos")))
    rows = lines.select(*_PLACE, "hash").join(verdict, "hash").drop("hash")
    return rows.withColumn("removed", ~(F.col("doc_id").eqNullSafe(F.col("keeper_doc")) & (F.col("pos") == F.col("keeper_pos"))))


def equal_spans(digest: DataFrame) -> DataFrame:
    """(doc_id, text_id, word, n_words, pos, start, stop, keeper_doc, keeper_pos, n_copies, removed) of each span of repeated minima."""
    rows = digest.where("kind = 1").drop("kind", "hash", "bands", "n_words")
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).where("n > 1")
    found = rows.join(groups, ["h1", "h2"]).drop("h1", "h2")  # one side is unique, so a frequent one's rows can be split
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    found = found.withColumn("removed", ~(same & (F.col("word") == F.col("first.word"))))
    found = found.where(~(F.col("removed") & same & (F.col("word") < F.col("first.word") + GRAM)))  # overlaps the copy that stays
    by = Window.partitionBy("doc_id", "text_id", "removed").orderBy("word")
    before = F.lag(F.struct("word", "step", "gap", "first")).over(by)
    found = found.withColumn("before", before)
    one_text = F.col("before.first.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("before.first.text_id") == F.col("first.text_id"))
    moved = F.col("first.word") - F.col("before.first.word")  # as far as here, or not at all where a word is repeated without end
    follows = (
        one_text
        & (F.col("before.word") + F.col("before.step") == F.col("word"))
        & (moved == F.col("before.step"))
        & (F.col("before.gap") == F.col("before.first.gap"))
    )
    touches = one_text & (F.col("word") <= F.col("before.word") + GRAM) & moved.isin(F.col("word") - F.col("before.word"), F.lit(0))
    spans = found.withColumn("span", F.sum(F.when(follows | touches, 0).otherwise(1)).over(by))
    head = F.min(F.struct("word", "pos", "start", "first")).alias("head")
    spans = spans.groupBy("doc_id", "text_id", "removed", "span").agg(head, F.max("word").alias("last"), F.max(F.col("start") + F.col("n_chars")).alias("stop"), F.max("n").alias("n_copies"))
    return spans.select(
        "doc_id", "text_id", F.col("head.word").alias("word"), (F.col("last") + GRAM - F.col("head.word")).alias("n_words"), F.col("head.pos").alias("pos"), F.col("head.start").alias("start"), "stop",
        F.col("head.first.doc_id").alias("keeper_doc"), F.col("head.first.pos").alias("keeper_pos"), "n_copies", "removed")


def _uncovered(spans: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """The parts of the spans beside the lines that have rows of their own, document by document."""
    key = ["doc_id", "text_id"]
    own = lines.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("word", "n_words", "start", "n_chars", "pos", "removed"))).alias("lines"))
    all_spans = spans.groupBy(*key).agg(F.collect_list(F.struct("word", "n_words", "pos", "start", "stop", "keeper_doc", "keeper_pos", "n_copies", "removed")).alias("spans"))
    met = all_spans.alias("s").join(own.alias("o"), F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s.text_id") == F.col("o.text_id")), "left")
    names = ("doc_id", "pos", "start", "n_chars", "n_copies", "keeper_doc", "keeper_pos", "removed")

    def make(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in names}
        for doc_id, spans, lines in zip(c["doc_id"], c["spans"], c["lines"]):
            lines = lines or []
            taken = {False: lines, True: [x for x in lines if x["removed"]]}
            ends = {k: [x["word"] + x["n_words"] for x in v] for k, v in taken.items()}
            for s in spans:
                held, last = taken[s["removed"]], s["word"] + s["n_words"]
                word, pos, start = s["word"], s["pos"], s["start"]
                parts = []
                for k in range(bisect.bisect_right(ends[s["removed"]], word), len(held)):
                    x = held[k]
                    if x["word"] >= last:
                        break
                    parts.append((x["word"] - word, pos, start, x["start"] - 1))
                    word, pos, start = x["word"] + x["n_words"], x["pos"] + 1, x["start"] + x["n_chars"] + 1
                parts.append((last - word, pos, start, s["stop"]))
                for n, pos, start, stop in parts:
                    if n >= min_words:
                        for k, v in zip(names, (doc_id, pos, start, stop - start, s["n_copies"], s["keeper_doc"], s["keeper_pos"], s["removed"])):
                            out[k].append(v)
        return out

    return map_batches(met.select("s.doc_id", "spans", "lines"), make, "doc_id long, pos int, start int, n_chars int, n_copies long, keeper_doc long, keeper_pos int, removed boolean")


def _digest(docs: DataFrame, least: float, min_words: int, recall: float) -> DataFrame:
    return saved(paragraphs(docs, tune_bands(least, recall), min_words), "kind")


def repeated_passages(docs: DataFrame, least: float = SIMILARITY, min_words: int = MIN_WORDS, recall: float = RECALL, hot: int = HOT_PAIRS) -> DataFrame:
    """Lines alone: doc_id, pos, start, n_chars, keeper_doc, keeper_pos, n_copies, removed of each that has a near copy."""
    return similar_lines(docs, _digest(docs, least, min_words, recall), least, hot).drop("text_id", "word", "n_words")


def repeated_spans(docs: DataFrame, least: float = SIMILARITY, min_words: int = MIN_WORDS, recall: float = RECALL, hot: int = HOT_PAIRS) -> DataFrame:
    """The rows of repeated_passages, and as many columns for each part of a repeated span."""
    digest = _digest(docs, least, min_words, recall)
    rows = saved(similar_lines(docs, digest, least, hot))
    return rows.drop("text_id", "word", "n_words").unionByName(_uncovered(equal_spans(digest), rows, min_words))

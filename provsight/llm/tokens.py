"""Token counts without token ids: pieces are counted once per distinct pre-token, then summed by document.

First the corpus' pre-tokens are counted; each distinct one is encoded once. The most frequent ones, at most
HEAD of them whatever the corpus, go to the executors as a dictionary; the rest of a document's pre-tokens meets
their counts in a join. Together they cover every pre-token exactly.

Defined cases: null text is empty (0 bytes, 0 tokens); special strings inside texts are single tokens, as the
library takes them by default; rows with one doc_id are counted as rows of their own; empty tables give empty results.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

LIMIT = 1024
#: Most pre-tokens in the dictionary that is broadcast (about 20 MB on an executor's Python worker).
HEAD = 100_000
#: Distinct pre-tokens that a task keeps before it hands on their counts.
FLUSH = 200_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def _splitter(path: str, pattern: str):
    """A function from text to its pre-tokens; a special string is a pre-token of its own."""
    with open(path) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    words = regex.compile(pattern).findall
    if not special:
        return words
    apart = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words(text)
        return [w for k, part in enumerate(apart.split(text)) for w in ([part] if k % 2 else words(part))]

    return split


def pretoken_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(pretoken, n): occurrences in the corpus. Each task hands on counts, not occurrences."""

    def run(batches):
        split, count = _splitter(path, pattern), Counter()

        def out():
            rows = pa.RecordBatch.from_pydict({"pretoken": list(count), "n": pa.array(count.values(), pa.int64())}, schema=pa.schema([("pretoken", pa.string()), ("n", pa.int64())]))
            count.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                count.update(split(text or ""))
                if len(count) > FLUSH:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """Adds pieces, the number of tokens of each distinct pre-token."""

    def make(c: dict[str, list]) -> dict[str, list]:
        encoded = _tokenizer(path).encode_batch_fast(c["pretoken"], add_special_tokens=False)
        return {"pretoken": c["pretoken"], "n": c["n"], "pieces": [len(e) for e in encoded]}

    return map_batches(pretokens, make, "pretoken string, n long, pieces int")


def frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """At most `most` of the most frequent pre-tokens with their pieces; the cut is by octave of frequency."""
    octave = F.floor(F.log2("n")).cast("int")
    sizes = dict(pieces.groupBy(octave.alias("o")).agg(F.count("*")).collect())  # 64 rows at most
    total, least = 0, 64
    for o in sorted(sizes, reverse=True):
        if (total := total + sizes[o]) > most:
            break
        least = o
    return dict(pieces.where(octave >= least).select("pretoken", "pieces").collect()) if least < 64 else {}


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs."""
    pieces = saved(piece_counts(pretoken_counts(docs, path, pattern), path))
    known = docs.sparkSession.sparkContext.broadcast(frequent(pieces, head))

    def make(c: dict[str, list]) -> dict[str, list]:
        split, get = _splitter(path, pattern), known.value.get
        size, total, rest = [], [], []
        for text in c["text"]:
            text = text or ""
            count = Counter(split(text))
            found = [get(w) for w in count]
            size.append(len(text.encode()))
            total.append(sum(p * n for p, n in zip(found, count.values()) if p))
            rest.append([{"pretoken": w, "n": n} for (w, n), p in zip(count.items(), found) if p is None])
        return {"doc_id": c["doc_id"], "n_bytes": size, "n_head": total, "rest": rest}

    per_doc = map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_head long, rest array<struct<pretoken:string,n:long>>")
    per_doc = saved(per_doc.withColumn("row", F.monotonically_increasing_id()))  # a row's name, fixed by the write
    tail = per_doc.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    summed = tail.join(pieces.select("pretoken", "pieces"), "pretoken").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tail"))
    out = per_doc.join(summed, "row", "left").withColumn("n_tokens", F.col("n_head") + F.coalesce("n_tail", F.lit(0)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with its ends marked) and of itself, all hashed into one
table; a passage's is the mean of its words'. The table and the softmax over it are trained together, in numpy, on passages of
a bounded sample of labelled documents, so words never seen share vectors with those that look like them. One dimension starts
from the n-grams' odds between the classes' documents. Labels are of documents, so a passage of a toxic document may be
clean; after a first round only those passages of toxic documents count that the model takes for toxic, and each one's worst.
A document is judged by its worst passage, its worst tenth and their number, so that long texts are not diluted: a logistic
regression on these, fitted on other labelled documents and weighted by how common the labels are, gives the probability.

Scoring needs one number for each n-gram, as averages and softmax are linear within a passage: the table times the
difference of the two classes' weights. Texts are read as a whole, by chunks of a batch, each distinct word of a chunk once.

Defined cases: null, empty and wordless texts get the share of toxic documents among those that may be learnt from; repeated
label rows count as the largest, null labels as none; without labels of both classes every score is that share (0.5 without
any labels); rows of one doc_id are scored apart; a null doc_id is not held out and never learnt from; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import _tables, chunks, join, ranges, rolled

#: Documents of each class to fit the embeddings on, and half as many others to fit the probabilities on; passages of each clean and toxic one for the fit.
TRAIN_DOCS, TRAIN_PASSAGES = 1000, 32
#: Words in a passage (the last one of a text has up to twice as many), n-gram sizes, bits of the hash table, dimensions.
PASSAGE, GRAMS, BITS, SIZE = 8, (3, 4, 5), 20, 8
#: An n-gram has a vector if so many documents of the fit hold it; standard errors from which the odds that it starts from count.
MIN_DOCS, START_Z = 5, 2.0
ROUNDS, STEPS, RATE, DECAY, SEED = 3, 5, 0.1, 1e-3, 20240611
THRESHOLD = 0.7


class Bags:
    """Words of texts by passages: word (number among the distinct ones), passage, text; grams (bucket) and of (distinct word)."""

    def __init__(self, texts: list[str]):
        letter, mix = _tables()
        self.joined = "\n".join(texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(letter[codes], prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        size = self.end - self.start
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        n_words = np.bincount(self.text, minlength=len(texts))
        n_passages = np.maximum(n_words // PASSAGE, n_words > 0)
        place = np.arange(len(size)) - (np.cumsum(n_words) - n_words)[self.text]
        self.passage_text = np.repeat(np.arange(len(texts)), n_passages)
        self.passage = (np.cumsum(n_passages) - n_passages)[self.text] + np.minimum(place // PASSAGE, n_passages[self.text] - 1)
        self.first = np.flatnonzero(np.diff(self.passage, prepend=-1))  # of each passage, as all have words
        self.words_in = np.diff(np.append(self.first, len(size)))
        # a hash of each word tells the distinct ones apart; then their letters between two marks
        random = mix[codes]
        at = ranges(self.start, size)
        powers = np.multiply.accumulate(np.full(int(size.max()) if len(size) else 1, np.uint64(0x9E3779B97F4A7C15)))
        heads = np.cumsum(size) - size
        whole = np.add.reduceat(random[at] * powers[np.arange(len(at)) - np.repeat(heads, size)], heads) if len(size) else np.empty(0, np.uint64)
        hashes, example, self.word = np.unique(whole, return_index=True, return_inverse=True)
        length = size[example] + 2
        head = np.cumsum(length) - length
        marked = np.full(int(length.sum()), mix[2])
        marked[head + length - 1] = mix[3]
        marked[ranges(head + 1, size[example])] = random[ranges(self.start[example], size[example])]
        owner = np.repeat(np.arange(len(hashes)), length)
        left = np.repeat(head + length, length) - np.arange(len(marked))  # letters from here to the word's end
        grams, of = [join(hashes, hashes, 51)], [np.arange(len(hashes))]
        for n in GRAMS:
            if len(marked) >= n:
                here = np.flatnonzero(left[: len(marked) - n + 1] >= n)
                grams.append(rolled(marked, n, 40)[here])
                of.append(owner[here])
        self.of = np.concatenate(of)
        order = np.argsort(self.of, kind="stable")
        self.of, self.grams = self.of[order], (np.concatenate(grams)[order] & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    """table: a number for each n-gram; bias; weights and shift from a text's features to its logit; empty: the score of a text without words."""

    table: np.ndarray | None
    bias: float
    weights: np.ndarray
    shift: float
    empty: float

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the logit of its worst passage, the mean of its worst tenth, the logarithm of their number; nan without words."""
        out = np.full((len(texts), 3), np.nan)
        for first, some in chunks([t.lower() for t in texts]):
            bags = Bags(some)
            if not len(bags.first):
                continue
            per_word = np.bincount(bags.of, weights=self.table[bags.grams]) / np.bincount(bags.of)
            passage = np.add.reduceat(per_word[bags.word], bags.first) / bags.words_in + self.bias
            n = np.bincount(bags.passage_text)
            worst = passage[np.lexsort((-passage, bags.passage_text))]  # by text, falling
            heads = (np.cumsum(n) - n)[n > 0]
            tenth = -(-n[n > 0] // 10)
            total = np.concatenate(([0.0], np.cumsum(worst)))
            rows = np.stack([worst[heads], (total[heads + tenth] - total[heads]) / tenth, np.log(n[n > 0])], 1)
            out[first + np.flatnonzero(n)] = rows
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.empty)
        found = self.features(texts)
        known = ~np.isnan(found[:, 0])
        return np.where(known, 1 / (1 + np.exp(-np.clip(np.where(known[:, None], found, 0) @ self.weights + self.shift, -50, 50))), self.empty)


def _passages(text: str, most: int) -> list[str]:
    """At most so many passages of a text, evenly spread over it."""
    bags = Bags([text])
    chosen = np.unique(np.linspace(0, len(bags.first) - 1, most).astype(int)) if len(bags.first) else []
    last = np.append(bags.first[1:], len(bags.start)) - 1
    return [bags.joined[bags.start[bags.first[k]] : bags.end[last[k]]] for k in chosen]


def _sums(values: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], heads, axis=0)


def fit(passages: list[str], document: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(table, bias): embeddings and softmax trained together by full gradient steps, both classes of equal weight. toxic is of the passage's document."""
    bags = Bags(passages)
    owner = bags.passage_text  # passages are one bag each, unless they are long
    label, doc = toxic[owner].astype(np.int64), document[owner]
    # n-grams that MIN_DOCS documents hold; the others have no vector, which is a vector of zeros
    n_docs = int(document.max()) + 1
    word, held = np.divmod(np.unique(bags.word * n_docs + doc[bags.passage]), n_docs)
    ends = np.cumsum(np.bincount(bags.of))
    sizes = np.diff(ends, prepend=0)
    pairs = np.unique(bags.grams[ranges((ends - sizes)[word], sizes[word])] * n_docs + np.repeat(held, sizes[word]))
    in_docs = np.bincount(pairs // n_docs, minlength=1 << BITS)
    common = in_docs >= MIN_DOCS
    kept = common[bags.grams]
    of = bags.of[kept]
    used, gram = np.unique(bags.grams[kept], return_inverse=True)
    if not len(used):
        return np.zeros(1 << BITS, np.float32), 0.0
    scale = (1 / np.sqrt(in_docs[used])).astype(np.float32)[:, None]  # so that the noise of frequent n-grams does not drown the rest
    by_gram, by_word = np.argsort(gram, kind="stable"), np.argsort(bags.word, kind="stable")
    gram_heads = np.flatnonzero(np.diff(gram[by_gram], prepend=-1))
    word_heads = np.flatnonzero(np.diff(bags.word[by_word], prepend=-1))
    own_heads, some = np.flatnonzero(np.diff(of, prepend=-1)), np.unique(of)
    n_grams = sizes.astype(np.float32)[:, None]
    n_words = bags.words_in.astype(np.float32)[:, None]
    rng = np.random.default_rng(SEED)
    params = [rng.uniform(-1, 1, (len(used), SIZE)).astype(np.float32) / SIZE, rng.uniform(-1, 1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)]
    # the first dimension starts from how much more toxic than clean documents hold an n-gram, as far as chance does not explain it
    is_toxic = np.zeros(n_docs, bool)
    is_toxic[doc] = label == 1
    held_by = np.bincount(pairs[is_toxic[pairs % n_docs]] // n_docs, minlength=1 << BITS)[used]
    n1, n = is_toxic.sum(), in_docs[used]
    z = (held_by - n * n1 / n_docs) / np.sqrt(np.maximum(n * n1 / n_docs * (1 - n1 / n_docs), 1e-9))
    odds = np.log((held_by + 0.5) / (n1 + 1)) - np.log((n - held_by + 0.5) / (n_docs - n1 + 1))
    sure = np.clip((np.abs(z) - START_Z) / START_Z, 0, 1)
    params[0][:, 0] = PASSAGE * odds * sure / scale[:, 0]
    params[1][0] = -0.5, 0.5
    moments = [[np.zeros_like(p), 0.0] for p in params]
    counts, step = np.ones(len(label), bool), 0
    for _ in range(ROUNDS):
        weight = np.where(counts, 1.0, 0.0).astype(np.float32)
        for k in (0, 1):
            weight[label == k] /= max(weight[label == k].sum(), 1)
        for _ in range(STEPS):
            step += 1
            table, soft, bias = params
            words = np.zeros((len(sizes), SIZE), np.float32)
            words[some] = np.add.reduceat((table * scale)[gram], own_heads, axis=0)
            words /= n_grams
            bag = np.add.reduceat(words[bags.word], bags.first, axis=0) / n_words
            logits = bag @ soft + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(label)), label] -= 1
            error *= weight[:, None]
            to_bag = (error @ soft.T) / n_words
            to_word = _sums(to_bag[bags.passage], by_word, word_heads) / n_grams
            grads = [_sums(to_word[of], by_gram, gram_heads) * scale + DECAY / len(used) * table, bag.T @ error + DECAY * soft, error.sum(0)]
            for p, g, moment in zip(params, grads, moments):  # one scale for all of a matrix: rare n-grams move little
                moment[0] += 0.1 * (g - moment[0])
                moment[1] += 0.01 * (float((g * g).mean()) - moment[1])
                p -= RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        margin = logits[:, 1] - logits[:, 0]
        worst = np.full(int(document.max()) + 1, -np.inf, np.float32)
        np.maximum.at(worst, doc, margin)
        counts = (label == 0) | (margin > 0) | (margin == worst[doc])
    table, soft, bias = params
    out = np.zeros(1 << BITS, np.float32)
    out[used] = (table * scale) @ (soft[:, 1] - soft[:, 0])
    return out, float(bias[1] - bias[0])


def calibrated(found: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(weights, shift) of a logistic regression on the features by Newton steps; classes weighted by their shares, targets a little inside 0 and 1."""
    center, spread = found.mean(0), np.maximum(found.std(0), 1e-6)
    x = np.column_stack([(found - center) / spread, np.ones(len(found))])
    n = np.array([(~toxic).sum(), toxic.sum()])
    target = np.where(toxic, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(toxic, share / n[1], (1 - share) / n[0]) * len(toxic)
    ridge = 1e-3 * np.diag([1.0] * found.shape[1] + [0.0])
    loss = lambda w: float((weight * (np.logaddexp(0, x @ w) - target * (x @ w))).sum() + w @ ridge @ w / 2)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        change = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - target)) + ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * change) > loss(w):
            size /= 2
        w = w - size * change
        if np.abs(size * change).max() < 1e-9:
            break
    return w[:-1] / spread, float(w[-1] - (w[:-1] * center / spread).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> Model:
    """Learns from at most 2 * n_docs documents of each class, taken by the hash of their ids from those that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = saved(known.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi"))  # read by class, and counted
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    nothing = Model(None, 0.0, np.zeros(3), 0.0, share)
    if len(n) < 2 or min(n.values()) < 2:
        return nothing
    order = [F.xxhash64(F.col("id"), F.lit(SEED)), F.col("id")]
    chosen = known.where("toxic = 0").orderBy(*order).limit(2 * n_docs).unionByName(known.where("toxic = 1").orderBy(*order).limit(2 * n_docs))
    picked = [(r.id, r.toxic) for r in chosen.collect()]  # 4 * n_docs at most
    roles = [(i, y, int(k % 3 == 2)) for y in (0, 1) for k, i in enumerate(i for i, t in picked if t == y)]
    sides = docs.sparkSession.createDataFrame(roles, "id long, toxic int, role int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sample = saved(texts.join(F.broadcast(sides), "id"))  # so small a side by construction

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, t in zip(*(c.to_pylist() for c in batch.columns)):
                found = _passages((t or "").lower(), TRAIN_PASSAGES)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array([y] * len(found), pa.int32()), pa.array(found, pa.string())], names=["id", "toxic", "passage"])

    rows = sorted(map(tuple, sample.where("role = 0").select("id", "toxic", "text").mapInArrow(cut_up, "id long, toxic int, passage string").collect()))
    if len({y for _, y, _ in rows}) < 2:
        return nothing
    _, document = np.unique(np.array([i for i, _, _ in rows]), return_inverse=True)
    table, bias = fit([p for _, _, p in rows], document, np.array([y for _, y, _ in rows]))
    model = Model(table, bias, np.array([1.0, 0.0, 0.0]), 0.0, share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.features([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["toxic", "worst", "tenth", "size"])

    judged = sample.where("role = 1").select("toxic", "text").mapInArrow(judge, "toxic int, worst double, tenth double, size double").where("NOT isnan(worst)").collect()
    if len({r.toxic for r in judged}) == 2:
        model.weights, model.shift = calibrated(np.array([r[1:] for r in judged]), np.array([r.toxic == 1 for r in judged]), share)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS) -> DataFrame:
    return score(docs, train(docs, labels, n_docs))

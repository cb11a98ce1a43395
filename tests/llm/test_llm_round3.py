"""Toxicity, importance resampling and the filter audit against brute force, held-out labels and odd tables."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from provsight.llm import audit, lines, quality, resample, toxicity, wrapper
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, buckets string, part string, digest string, label string, id string, score double"


def docs(spark, rows):
    """rows of (doc_id, text, source), with extra columns named like those that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "b", "p", "d", "l", "i", 1.0) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, "one", "b"), (4, "one", "b"), (5, "word " * 40_000, "b"), (6, "é ß 漢字 \U0001f600 É A_b", "a"), (None, "no id", None), (None, "no id", "a"), (7, "y" * 100_000, ""), (8, "one", "c")]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é漢 -_.\n\x7f", max_size=200), min_size=1, max_size=6))
def test_buckets_like_checksums(texts):
    texts.append("x" * 300 + " y " + "z" * 150 + " " + "x" * 300)
    n_words, found = resample.feature_buckets(pa.array([*texts, None]), 9973)
    for text, n, held in zip([*texts, None], n_words, found):
        want = features(text)
        assert n == want[0] and sorted(np.frombuffer(held, "<u2").tolist()) == sorted(c % 9973 for c in want[1])


def brute_resample(rows, target, percent=5, min_words=20):
    kept = [(i, *features(t)) for i, t, _ in rows]
    s, t = Counter(c % 10000 for _, _, f in kept for c in f), Counter(c % 10000 for x in target for c in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    out = []
    for i, n, f in kept:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(c % 10000) for c in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted((*r[:4], place.get(id(r))) for r in out if r[0] is not None), Counter((*r[:4], place.get(id(r))) for r in out if r[0] is None)


def test_resample_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [(100 + k, " ".join(f"w{x}" for x in rng.integers(0, 300, int(rng.integers(1, 90)))), "a") for k in range(300)] + [(500 + k, "same words " * 15, "b") for k in range(40)]
    target = ["w1 w2 w3 w4", None, "", "w1 w2 same words"]
    got = resample.resample(docs(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")).collect()
    want, without_id = brute_resample(rows, target)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert Counter(tuple(r) for r in got if r.doc_id is None) == without_id


def test_resample_empty(spark):
    none, bench = docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.resample(none, bench).count() == 0
    assert resample.resample(docs(spark, ODD), bench.limit(0)).count() == len(ODD)


def fails(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    judged = [(s or "", fails(t) + [i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)], i) for i, t, s in rows]
    out = set()
    for part in {p for p, _, _ in judged}:
        mine = [(f, i) for p, f, i in judged if p == part]
        removed, rest = Counter(), []
        for order in permutations(range(5)):
            for step, k in enumerate(order):
                left = [(f, i) for f, i in mine if not any(f[j] for j in order[:step])]
                goes = [(f, i) for f, i in left if f[k]]
                removed[k] += len(goes)
                unique = sum(1 for f, _ in mine if f[k] and sum(f) == 1)
                rest.append((k, (part, "".join("ABCDE"[j] for j in order), step + 1, len(left) - len(goes), len(goes), sum(f[k] for f, _ in mine) - len(goes), unique, sum(i in good for _, i in goes), sum(i in toxic for _, i in goes))))
        out |= {(*row, removed[k]) for k, row in rest}
    return sorted(out)


def write_files(folder, rows, files):
    """The rows dealt to files that a stream reads in their order."""
    os.makedirs(folder)
    for k, some in enumerate(files):
        data = [rows[j] for j in some]
        table = pa.table({"doc_id": pa.array([r[0] for r in data], pa.int64()), "text": pa.array([r[1] for r in data], pa.string()), "source": pa.array([r[2] for r in data], pa.string()), "mask": pa.array(["x"] * len(data), pa.string())})
        pq.write_table(table, f"{folder}/part-{k}.parquet")
        os.utime(f"{folder}/part-{k}.parquet", (1_700_000_000 + 10 * k,) * 2)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_audit_retracts(spark, tmp_path, batches):
    """Smaller ids of a text come in later files, so what was counted for the first ones has to be taken back."""
    rng = np.random.default_rng(5)
    long = " ".join(f"w{k}" for k in range(220))
    base = [long, long + " $", "SHOUT " * 210, "the same " * 110, "short", "", long.upper(), "A short one #"]
    rows = [(int(i), base[int(rng.integers(len(base)))], ["a", "b", None][int(rng.integers(3))]) for i in rng.permutation(240)]
    rows += ODD + [rows[0], rows[5]]
    order = sorted(range(len(rows)), key=lambda k: -(rows[k][0] or 0))  # largest ids first
    write_files(str(tmp_path / "documents.parquet"), rows, np.array_split(order, 6))
    labels = [(i, i % 3 % 2, i % 4 // 3) for i in range(0, 240, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (8, None, None), (6, None, 1)]
    got = audit.audit_files(spark, str(tmp_path / "documents.parquet"), labels_of(spark, labels), batches)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_single_file_and_empty(spark, tmp_path):
    write_files(str(tmp_path / "many"), ODD, [range(len(ODD)), []])
    none = labels_of(spark, [])
    assert sorted(map(tuple, audit.audit_files(spark, str(tmp_path / "many/part-0.parquet"), none).collect())) == brute_audit(ODD, [])
    assert audit.audit_files(spark, str(tmp_path / "many/part-1.parquet"), none).count() == 0


def test_audit_reduces_copies_before_the_shuffle(spark):
    rows = docs(spark, [(k, "copy", "a") for k in range(5000)]).repartition(4)
    marked = audit.masks(rows, 10).withColumn("label", F.lit(0))
    open_ = audit.reduced(marked).where("digest IS NOT NULL").count()
    assert open_ <= 8  # a row a batch, of the 5,000


BAD = ["grumbol", "snarkit", "vilefink", "drolgar"]


def toxic_corpus(n, seed):
    """Prose in which toxic documents hold words built on a few stems."""
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{a}{b}{c}" for a, b, c in zip(rng.choice(["ta", "mo", "ri", "su"], 60), rng.choice(["len", "dor", "pa", "ke"], 60), rng.choice(["n", "s", "", "ta"], 60))]
        bad = i % 4 == 0
        for k in rng.choice(60, 4, replace=False) if bad else []:
            words[k] = BAD[int(rng.integers(4))] + str(rng.choice(["", "s", "en", "ig"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_misspelt(spark):
    rows, labels = toxic_corpus(900, 1)
    table = docs(spark, rows + ODD)
    model = toxicity.train(table, labels_of(spark, labels + [(3, 1, None), (None, 1, 1)]))
    got = toxicity.score(table, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    of = dict((i, y) for i, _, y in labels)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id > 8]
    right = sum(r.predicted == of[r.doc_id] for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)
    clean = rows[1][1]
    odd = model.scores([clean, clean + " grumboll snarkitt", clean + " vilefinkly drolgarr", "", " "])
    assert odd[0] < 0.3 and odd[1] > 0.7 and odd[2] > 0.7 and odd[3] == odd[4] == model.empty
    long = " ".join(t for _, t, _ in rows[1:200] if int(_ == "a") and not any(b in t for b in BAD))
    assert model.scores([long])[0] < 0.5


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows, labels = toxic_corpus(300, 2)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    table = docs(spark, rows)
    a, b = (sorted(map(tuple, toxicity.toxicity(table, labels_of(spark, x)).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(1, 1, 1), (2, 1, 1)], 1.0), ([(k, 1, 0) for k in range(9)], 0.0)])
def test_toxicity_without_both_classes(spark, labels, want):
    got = toxicity.toxicity(docs(spark, ODD), labels_of(spark, labels)).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {want}
    assert toxicity.toxicity(docs(spark, []), labels_of(spark, labels)).count() == 0


@pytest.mark.parametrize("n", [2, 5, 20])
def test_host_prior_is_unbiased(spark, n):
    """Rates from beta(2, 6), of variance 0.0208, seen through n documents a host."""
    rng = np.random.default_rng(n)
    hosts = [(n, int(x)) for x in rng.binomial(n, rng.beta(2, 6, 20_000))]
    row = quality.host_prior(spark.createDataFrame(hosts, "n_docs long, n_failed long")).first()
    assert abs(row.mean - 0.25) < 0.01 and abs(row.between - 0.0208) < 0.002


def test_planted_hosts_are_caught(spark):
    """Of hosts that mostly fail, those with enough documents to be sure of go; one bad document, or two, condemn nobody."""
    rng = np.random.default_rng(8)
    flags = [(f"good{h}", bool(x)) for h in range(60) for x in rng.random(80) < 0.08]
    flags += [(f"bad{h}", bool(x)) for h in range(5) for x in rng.random(60) < 0.9] + [("tiny", True), ("pair", True), ("pair", True), ("half", True), ("half", False)]
    got = {r.host for r in quality.host_verdicts(spark.createDataFrame(flags, "host string, failed boolean")).where("rejected").collect()}
    assert got == {f"bad{h}" for h in range(5)}


def test_line_hashes_grow_with_lines(spark):
    """The text is hashed below the generator, so a text of twice the lines takes no four times as long."""
    plan = lines.line_hashes(docs(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")


@pytest.mark.parametrize("html,want", [
    ('<div class="with-sidebar"><p>text</p></div>', "text"),
    ('<article><div class="article-header"><h1>Title</h1></div><div class="entry-content comment-free"><p>one</p></div><div class="comment-list">no</div></article>', "Title\none"),
    ('<div id="page" class="no-sidebar"><article><p>a b</p></article></div>', "a b"),
    ('<div class="sidebar"><div class="widget"><article><p>all of it</p></article></div></div>', "all of it"),
    ('<p>a long text of many words that is the article</p><div class="site-footer">f</div><div class="ad-box">buy</div><ul class="nav"><li>n</ul><div class="related-posts">r</div>', "a long text of many words that is the article"),
    ('<p>one<div class="cookie-notice" id=x>we use</div><p>two three four five six seven eight nine ten eleven twelve', "one\ntwo three four five six seven eight nine ten eleven twelve"),
])
def test_class_words_spare_the_content(html, want):
    assert wrapper.extract(html) == want


def test_pages_are_read_in_linear_time():
    """50,000 stray tags, open tags, quotes and comments of one kind: each page in seconds."""
    n = 50_000
    began = time.time()
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, '<a "' * n, "<a ' <a \" " * n, "<!--" * n, "<p>" * n, "<li>" * n, "<td><b>" * n):
        wrapper.extract(page)
    assert time.time() - began < 30
    assert wrapper.extract("<p>a<a \"x>b</a><p>c") == "ab\nc" and wrapper.extract("<p>a<a x") == "a<a x"


def test_alignment_of_long_lists_is_exact(monkeypatch):
    """Lists are halved beyond CELLS sums, and match as many nodes as when they are not."""
    rng = np.random.default_rng(11)
    page = lambda: "".join(f"<{t}>{'<ul><li>a</ul><p>b' * int(rng.integers(0, 3))}</{t}>" for t in rng.choice(["div", "h2", "section"], int(rng.integers(0, 60))))
    pairs = [(wrapper.slots(page()), wrapper.slots(page())) for _ in range(60)]
    whole = [wrapper.align(a, b)[0] for a, b in pairs]
    monkeypatch.setattr(wrapper, "CELLS", 12)
    for (a, b), n in zip(pairs, whole):
        got, found = wrapper.align(a, b)
        assert got == n == len({id(x) for x, _ in found}) == len({id(y) for _, y in found})

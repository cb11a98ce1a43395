"""The training-data operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as tk
import pytest
import xxhash
from pyspark.sql import functions as F

from provsight.llm import bpe, common, decontam, licences, lines, passages, quality, revisit, simhash, tokens, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tid long, hash string, key string, host string"
WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark, texts, **more):
    """Odd extra columns with the names that operators use inside."""
    rows = [(i, t, "en", more.get("source", "s"), len(t or ""), 1, "h", "k", "x") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


LONG = prose(1, 30_000)
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, LONG), (6, "é ß 漢字 \U0001f600 é"), (7, "<|endoftext|> a"), (None, "no id"), (8, "\r\n\x0b\x0c\xa0x")]


def fp(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def groups(items, linked):
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(items, 2):
        if linked(a, b):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: find(k) for k in items}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(60, 50), (50, 50), (70, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50, 70: 50}
    assert common.components(edges.limit(0)).count() == 0


def test_fingerprint_matches_definition():
    for text in ("", " ", "A b", "A B c É", LONG[:5000], prose(3, 50).upper()):
        assert simhash.fingerprint(text) % 2**64 == fp(text)


@pytest.mark.parametrize("hot", [simhash.HOT_CELL, 0, 3])
def test_simhash_links_like_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = sorted({b ^ sum(1 << int(p) for p in rng.choice(64, k, replace=False)) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(3)} | {0, 2**64 - 1})
    rows = [(k, f - 2**64 if f >= 2**63 else f) for k, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "rep long, fp long"), hot=hot)
    got = {r.node: r.component for r in common.components(links).collect()}
    want = groups([k for k, _ in rows], lambda a, b: ((rows[a][1] ^ rows[b][1]) & (2**64 - 1)).bit_count() <= 3)
    assert {k: got.get(k, k) for k in want} == want


def test_simhash_odd(spark):
    got = simhash.near_groups(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].fp == 0
    kept = simhash.near_dedup(docs(spark, ODD))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, 1, 4, 4, 5, 6, 7, 8])
    assert simhash.near_groups(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_simhash_links_fingerprints_without_id(spark, monkeypatch):
    """A fingerprint that only rows without doc_id have links, and joins others; with no doc_id at all the class has no name."""
    prints = [(None, 0, 0b1), (9, 0, 0b11), (None, 0, 0b1111), (4, 0, 0b1111111), (None, 0, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda _: spark.createDataFrame(prints, "doc_id long, tid long, fp long"))
    got = {r.fp: r.component_id for r in simhash.near_groups(docs(spark, [(1, "a")])).collect()}
    assert got == {0b1: 4, 0b11: 4, 0b1111: 4, 0b1111111: 4, -1: None}


def test_quality_counts():
    text = "a b c d e a b c d e\n# x\n# x\n \n"
    assert quality.text_counts(text) == (14, 14, 2, 1, 10)
    assert quality.text_counts(None) == quality.text_counts("") == (0, 0, 0, 0, 0)
    assert quality.repeated_words("a a a a a a".split()) == 6


def test_quality_hosts_stand_out_or_not(spark):
    """Three bad hosts among many go; hosts that differ by chance alone, and a single host however bad, have the mean rate."""
    rng, rows = np.random.default_rng(8), []
    for h in range(60):
        rows += [(f"h{h}", bool(rng.random() < (0.9 if h < 3 else 0.1))) for _ in range(int(rng.integers(5, 60)))]
    make = lambda r: quality.host_verdicts(spark.createDataFrame(r, "host string, failed boolean")).collect()
    assert {r.host for r in make(rows) if r.rejected} == {"h0", "h1", "h2"}
    chance = [(f"h{h}", bool(rng.random() < 0.6)) for h in range(60) for _ in range(3)]
    assert not any(r.rejected for r in make(chance)) and not any(r.rejected for r in make([("h", True)] * 9 + [("h", False)]))


def test_quality_hosts(spark):
    good, bad = prose(1, 60), "x"
    rows = [(k, bad, "junk") for k in range(40)] + [(40, good, "junk"), (41, good, None), (42, None, None)] + [(50 + k, good, f"h{k % 4}") for k in range(40)] + [(99, bad, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[40].host_rejected and not got[40].kept and not got[40].base_failed
    assert got[41].kept and not got[42].kept and got[50].kept and not got[99].kept
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.quality_rules(df.limit(0)).count() == quality.keep_good(df.limit(0)).count() == 0
    assert quality.quality_rules(docs(spark, ODD)).count() == len(ODD)


def test_line_dedup_streams_sorted_ranges(spark):
    """One shuffle by ranges; the window that marks first occurrences runs on its order, without another shuffle."""
    marked = lines.first_occurrences(lines.line_hashes(docs(spark, [(1, prose(1, 30)), (2, prose(1, 30) + "\n" + prose(1, 30))])))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(hash" in plan and "Window" in plan and "Sort [hash" in plan
    assert sorted((r.doc_id, r.pos, r.first) for r in marked.collect()) == [(1, 0, True), (2, 0, True), (2, 1, False)]


def test_line_dedup_like_brute_force(spark):
    shared = "Shared line of more than forty characters, it is."
    texts = [(k, f"own {k}\n  {shared if k % 2 else shared.upper()}\t\nshort\n{shared}\n" + "\n" * (k * 40)) for k in range(7)] + [(20, shared + "!"), (21, None), (22, ""), (23, LONG)]
    got = {r.doc_id: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert all(got[k].n_dropped == 2 and shared.lower() not in got[k].text.lower() for k in range(6))
    assert got[6].n_dropped == 0 and got[6].text == texts[6][1] and got[23].text == LONG
    assert got[0].text == "own 0\nshort\n" and got[3].n_lines == 125 and len(got[3].text.split("\n")) == 123
    assert got[21].text == got[22].text == "" and got[21].n_lines == 1
    assert lines.dedup_lines(docs(spark, ODD)).count() == len(ODD)
    assert lines.dedup_lines(docs(spark, ODD).limit(0)).count() == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    shared = "Shared line of more than forty characters, it is."
    rows = [(k, shared) for k in range(6)] + [(0, "other\n" + shared), (None, shared)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in lines.dedup_lines(docs(spark, rows)).collect())
    assert got == sorted([(k, "") for k in range(5)] + [(5, shared), (0, "other"), (-1, "")])


def jaccard(a, b):
    s = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)})(t.split())
    return len(s(a) & s(b)) / len(s(a) | s(b))


@pytest.mark.parametrize("hot", [passages.HOT_PAIRS, 1])
def test_passages_like_brute_force(spark, hot):
    texts, rng = {}, np.random.default_rng(9)
    for k in range(12):
        base = prose(100 + k, 60).split()
        for v in range(5):
            words = list(base)
            for at in rng.choice(60, v, replace=False):
                words[at] = f"new{k}{v}{at}"
            texts[10 * k + v] = " ".join(words)
    texts[900] = texts[0]
    got = passages.repeated_passages(docs(spark, [(k, "short line\n" + t) for k, t in texts.items()]), hot=hot).collect()
    want = groups(sorted(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    size = Counter(want.values())
    assert {r.doc_id: r.keeper_doc for r in got} == {k: c for k, c in want.items() if size[c] > 1}
    assert all(r.removed == (r.doc_id != r.keeper_doc) and r.pos == 1 and r.start == 11 for r in got)


def test_passages_odd(spark):
    assert passages.repeated_passages(docs(spark, ODD + [(30, LONG)])).count() == 2
    assert passages.repeated_passages(docs(spark, ODD).limit(0)).count() == 0
    assert 1 - (1 - 0.8**passages.ROWS) ** passages.tune_bands() >= 0.999


def test_passages_inside_lines_and_across_them(spark):
    """Runs of 50 words in unlike documents: in longer lines, over short lines, twice in one text. Spans hold nothing else."""
    run, other = prose(70, 50), prose(71, 50).split()
    broken = "\n".join(" ".join(other[k : k + 10]) for k in range(0, 50, 10))
    own = lambda k, n: " ".join(f"own{k}x{j}" for j in range(n))
    texts = {1: f"{own(1, 90)} {run} {own(2, 70)}", 2: f"{own(3, 5)}\n{own(4, 80)}, {run.upper()}; {own(5, 60)}", 3: f"{own(6, 9)}\n{broken}\n{own(7, 9)}", 4: f"{own(8, 30)} {' '.join(other)} {own(9, 30)}", 5: f"{own(10, 90)}\n{own(11, 90)}", 7: f"{run} {own(14, 60)} {run}"}
    got = passages.repeated_spans(docs(spark, list(texts.items()))).collect()
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    assert sorted((r.doc_id, r.keeper_doc, r.removed) for r in got) == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 3, True), (7, 1, True), (7, 1, True)]
    for r in got:
        span = words(texts[r.doc_id][r.start : r.start + r.n_chars])
        assert span in (" ".join(other) if r.doc_id in (3, 4) else words(run)) and len(span.split()) >= 20
        assert texts[r.doc_id][: r.start].count("\n") == r.pos


def test_planted_passages_are_caught(spark):
    """Passages of 51 to 120 words inside long lines and over line ends of unlike documents; the other documents are left alone."""
    rng, texts, planted = np.random.default_rng(31), {}, set()
    for k in range(150):
        passage = [f"p{k}x{w}" if rng.random() < 0.3 else w for w in prose(4000 + k, int(rng.integers(51, 121))).split()]
        for v in range(2):
            words = [f"{w}q{rng.integers(10**6)}" for w in prose(9000 + 2 * k + v, 300).split()]
            at = int(rng.integers(0, 301))
            words[at:at] = passage
            texts[2 * k + v] = "".join(w + ("\n" if rng.random() < 0.02 else " ") for w in words)
            planted.add(2 * k + v)
    for k in range(300, 600):
        texts[k] = " ".join(f"{w}q{rng.integers(10**6)}" for w in prose(k, 300).split()) + "\nThis short line is on very many pages of the site"
    found = {r.doc_id for r in passages.repeated_spans(docs(spark, list(texts.items()))).select("doc_id").collect()}
    assert found == planted


def test_spans_odd(spark):
    rows = [*ODD, (30, LONG), (31, "\u0130 " + LONG), (32, "a " * 200), (None, "\n".join(LONG.split()[:60]))]
    got = passages.repeated_spans(docs(spark, rows)).collect()
    assert {(r.doc_id, r.removed) for r in got} == {(5, False), (30, True), (31, True), (32, False), (32, True), (None, True)}
    assert passages.repeated_spans(docs(spark, ODD).limit(0)).count() == 0


def test_spans_like_brute_force(spark):
    """Every stretch of repeated windows of 50 words has spans of its own, whose words are all in their keeper's document too."""
    rng, texts = np.random.default_rng(12), []
    pool = [prose(80 + k, 120).split() for k in range(6)]
    for k in range(40):
        words = [f"u{k}x{j}" for j in range(30)]
        for j in range(3):
            a = int(rng.integers(0, 70))
            words += pool[int(rng.integers(0, 6))][a : a + int(rng.integers(30, 80))] + [f"v{k}x{j}"]
        texts.append((k, "".join(w + ("\n" if rng.random() < 0.15 else " ") for w in words)))
    at: dict = {}
    for k, t in texts:
        w = t.split()
        for j in range(len(w) - 49):
            at.setdefault(tuple(w[j : j + 50]), []).append((k, j))
    windows = {place for found in at.values() if len(found) > 1 for place in found}
    got: dict = {}
    for r in passages.equal_spans(passages._digest(docs(spark, texts), 0.8, 20, 0.999)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.word, r.word + r.n_words))
        span = texts[r.doc_id][1][r.start : r.stop].split()
        assert len(span) == r.n_words >= 20 and span == texts[r.doc_id][1].split()[r.word : r.word + r.n_words]
        assert " ".join(span) in " ".join(texts[r.keeper_doc][1].split()) and (r.removed or r.doc_id == r.keeper_doc)
    assert len(windows) > 500 and all(len(got[k] & set(range(j, j + 50))) >= 20 for k, j in windows)


def naive_tiles(a, b, least):
    """Longest common run of unmarked tokens, again and again."""
    ua, ub, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return out
        n, i, j = best[0], -best[1], -best[2]
        ua |= set(range(i, i + n))
        ub |= set(range(j, j + n))
        out.append(n)


def test_tiling_like_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = (list(map(str, rng.integers(0, 4, n))) for n in (18, 25))
        got = [n for _, _, n in decontam.tile(a, b, 3)]
        assert got == sorted(got, reverse=True) and sum(got) == sum(naive_tiles(a, b, 3))


@pytest.mark.parametrize("max_chars", [decontam.MAX_BROADCAST_CHARS, 0])
def test_contamination(spark, max_chars):
    item = prose(7, 40).split()
    swapped = " ".join(item[20:] + ["other"] * 3 + item[:20]).upper() + "."
    texts = [(1, prose(8, 200) + " " + " ".join(item)), (2, swapped), (3, " ".join(item[:12])), (4, prose(9, 300)), (5, "the tiny item")] + ODD[:3]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.n_tiles) for r in decontam.contaminated(docs(spark, texts), items, max_chars=max_chars).collect()}
    assert got == {(1, 1): (40, 1), (2, 1): (40, 2), (5, 4): (2, 1)}
    assert decontam.contaminated(docs(spark, texts), items.limit(0), max_chars=max_chars).count() == 0
    assert decontam.contaminated(docs(spark, texts).limit(0), items, max_chars=max_chars).count() == 0
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs(spark, texts), items).collect()) == [3, 3, 4]


@pytest.mark.parametrize("max_chars", [decontam.MAX_BROADCAST_CHARS, 0])
def test_contamination_of_long_texts_and_common_phrases(spark, max_chars):
    """Ways agree on a very long text, on a phrase that all documents and items share, and on clashing and repeated rows."""
    phrase = prose(40, 6)
    items = [(k, phrase + " " + " ".join(f"i{k}x{j}" for j in range(30))) for k in range(12)] + [(50, "tiny item"), (50, "tiny item"), (None, None)]
    texts = [(k, f"{prose(k, 20)} {phrase} {prose(k + 50, 20)}") for k in range(30)]
    long = LONG.split()
    long[15000:15000] = items[4][1].split()[20:] + ["gap"] + items[4][1].split()[:20]
    texts += [(100, " ".join(long)), (101, "a tiny item here"), (101, "a tiny item here"), (None, items[7][1]), (42, items[8][1]), (None, None)]
    got = decontam.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), max_chars=max_chars).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(100, 4), *[(101, 50)] * 4, (None, 7), (42, 8)], key=str)
    if max_chars:
        left = decontam.drop_contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(((r.doc_id, r.text is None) for r in left.collect()), key=str) == sorted([*((k, False) for k in range(30)), (None, True)], key=str)


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): v for a, v in k.items()}
    rows = [
        ("r1", "response", "http://WWW.a.com:80/x/?b=2&a=1&utm_source=z#f", 10, h(ETag='"1"', Content_Type="text/html", Server="old"), "d1"),
        ("r2", "response", "https://a.com/x?a=1&b=2", 20, h(etag='W/"2"', server="old"), "d2"),
        ("v0", "revisit", "http://a.com/x?a=1&b=2", 10, h(etag='"1"'), None), ("v1", "revisit", "http://a.com/x?a=1&b=2", 15, h(etag='"1"', Server="new", Content_Type="x"), None),
        ("v2", "revisit", "http://a.com/x?b=2&a=1", 25, h(etag='"2"'), None), ("v3", "revisit", "http://a.com/x?b=2&a=1", 26, h(etag='"1"'), None), ("v4", "revisit", "http://a.com/x?b=2&a=1", 27, None, None),
        ("v5", "revisit", None, 27, None, "d2"), ("v6", "revisit", "http://a.com/x?b=2&a=1", None, None, "d2"), ("v7", "revisit", "http://b.com", 9, None, "d"), ("v2", "revisit", "http://a.com/x?b=2&a=1", 25, h(etag='"2"'), None), ("w", "request", "http://a.com", 1, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, url string, ts long, headers map<string,string>, digest string").withColumn("piece", F.lit(1))
    got = {r.record_id: r for r in revisit.resolve_revisits(df).collect()}
    assert {k: (r.status, r.response_id) for k, r in got.items()} == {
        "v0": ("no_earlier_response", None), "v1": ("resolved", "r1"), "v2": ("resolved", "r2"), "v3": ("validator_mismatch", None), "v4": ("no_validator", None), "v5": ("no_earlier_response", None), "v6": ("no_earlier_response", None), "v7": ("no_earlier_response", None)}
    assert got["v1"].headers == {"etag": '"1"', "content-type": "text/html", "server": "new"}
    assert revisit.resolve_revisits(df).count() == 9 and revisit.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_across_pieces(spark):
    rows = [(f"r{k}", "response", "http://h.com/", 10 * k, {"etag": str(k)}, None) for k in range(0, 400, 7)] + [(f"v{k}", "revisit", "http://h.com", 10 * k + 5, {"etag": str(k // 7 * 7)}, None) for k in range(400)]
    df = spark.createDataFrame(rows, "record_id string, type string, url string, ts long, headers map<string,string>, digest string")
    assert {r.record_id: r.response_id for r in revisit.resolve_revisits(df).collect()} == {f"v{k}": f"r{k // 7 * 7}" for k in range(400)}


PAGE = """<html><head><title>t</title><style>x</style></head><body><div class="cookie-notice">Cookies</div><header>Head</header><nav><ul><li>Menu</ul></nav><aside>side</aside>
<article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four&nbsp; &#8211; &lt;five&gt;<form><input>f</form><div class="share">Share</div><div class=comments><p>nice</div><ul><li>x<li>y</ul><script>var a='</p>'</script></article><div class='ad'>Ad</div><footer>&copy;</footer></body>"""


def test_main_text():
    assert wrapper.extract(PAGE) == "A & B\nOne two three\nFour – <five>\nx\ny"
    assert wrapper.extract("") == "" and wrapper.extract("plain <i>text") == "plain text"
    assert wrapper.extract("<p>a<!-- <p>b --><p>c") == "a\nc"
    assert wrapper.extract("<body><p>no article</p><nav>n</nav></body>") == "no article"


def test_alignment_and_template(spark):
    page = lambda k, extra="": f"<body><article><h1>T{k}</h1><p>{prose(k, 9)}</p>{extra}<h2>Read more here</h2></article></body>"
    rows = [(k, "http://h.com/a", page(k, "<blockquote>q</blockquote>" if k % 2 else "")) for k in range(12)] + [(20, "http://one.com/", page(1)), (21, None, None), (22, "http://h.com/b", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in wrapper.main_text(df).collect()}
    assert all("Read more" not in got[k].text and got[k].text.startswith(f"T{k}\n") for k in range(12))
    assert "Read more here" in got[20].text and got[21].text == got[22].text == "" and got[21].n_chars == 0
    assert wrapper.main_text(df.limit(0)).count() == 0
    a, b = wrapper.slots(page(1)), wrapper.slots(page(2, "<table><tr><td>x</table>"))
    n, pairs = wrapper.align(a, b)
    assert n == len(pairs) == 6


def test_copies_of_an_article_are_no_template(spark):
    """A host of copies with other adverts and menus, near copies, and one different page: all keep their text."""
    page = lambda k, article: f"<body><nav>menu {k}</nav><article>{article}</article><div class='ad'>{prose(500 + k, 8)}</div></body>"
    one, other = prose(60, 40), prose(61, 40)
    copies = [(k, "http://h.com/a", page(k, f"<h1>Title</h1><p>{one}</p>")) for k in range(20)]
    near = [(30 + k, "http://h.com/n", page(30 + k, f"<h1>Title</h1><p>{one} day {k}</p>")) for k in range(20)]
    rows = [*copies, *near, (60, "http://h.com/b", page(60, f"<h1>Another</h1><p>{other}</p>"))]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Title\n{one}" for k in range(20))
    assert all(got[30 + k] == f"Title\n{one} day {k}" for k in range(20))
    assert got[60] == f"Another\n{other}"


def test_a_template_node_with_other_text_is_read(spark):
    page = lambda k, last: f"<body><article><h1>T{k}</h1><p>{prose(k, 9)}</p><h2>{last}</h2></article></body>"
    rows = [(k, "http://h.com/a", page(k, "Read more here")) for k in range(30)] + [(30, "http://h.com/b", page(30, "Own words of the page"))]
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Read more" not in got[k] for k in range(30)) and got[30].endswith("\nOwn words of the page")


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path, texts = tk.path("byte_bpe_50k.json"), ODD + [(40, "a <|endoftext|><|endoftext|>b  \n\n c"), (41, "don't  stop '' \t\n x²Ⅷ")]
    whole = Tokenizer.from_file(path)
    want = sorted((i or 0, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    for head in (tokens.HEAD, 0):
        got = tokens.token_counts(docs(spark, texts), path, tk.PATTERN, head=head).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.token_counts(docs(spark, texts).limit(0), path, tk.PATTERN).count() == 0


def naive_match(a, b):
    """Simple tree matching as it is defined: the best of all ways to match kids in order."""
    if a.label != b.label:
        return 0

    def best(x, y):
        return 0 if not x or not y else max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + naive_match(x[0], y[0]))

    return 1 + best(a.kids, b.kids)


def test_align_like_brute_force():
    rng = np.random.default_rng(6)

    def page(depth):
        return "".join(f"<{t}>{page(depth - 1) if depth else 'x'}</{t}>" for t in rng.choice(["div", "ul", "section"], int(rng.integers(0, 5))))

    for _ in range(60):
        a, b = wrapper.slots(page(2)), wrapper.slots(page(2))
        n, pairs = wrapper.align(a, b)
        assert n == naive_match(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)


def test_deep_and_long_pages(spark):
    """5,000 nested elements, 3,000 unlike siblings (other shapes each), and a long paragraph: read whole, in seconds."""
    deep = "<div>" * 5000 + "inner" + "</div>" * 5000
    wide = "".join(f"<h2>h{k}</h2><div>{'<ul><li>a</ul>' * (k % 7)}<p>t{k}</div>" for k in range(1500))
    long = "<article><p>" + "word " * 200_000 + "</article>"
    pages = [(k, "http://h/", p) for k, p in enumerate([deep, wide, long, deep + "x", wide + "<p>y"] * 2)]
    began = time.time()
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), min_pages=2).collect()}
    assert got[0].text == "inner" and got[3].text == "inner\nx" and got[2].n_chars == 999_999
    assert got[1].text.count("\n") > 2999 and got[4].text.endswith("\ny") and time.time() - began < 60
    n, pairs = wrapper.align(wrapper.slots(wide), wrapper.slots(wide + "<p>y"))
    assert n == wrapper.slots(wide).size


def test_wrapper_finds_the_content_of_unmarked_pages(spark):
    """No article element and no telling class: what stays the same goes, and the region with the varying words is the content."""
    def page(k, text):
        links = "".join(f"<li><a href='/{j}'>other page {j * k} of this site</a>" for j in range(9))
        return f"<div class=a1><div class=q><ul>{links}</ul></div><div class=b2><h2>{prose(700 + k, 6)}</h2>{text}</div><div class=c3><p>All rights kept by the owner of the site</p></div></div>"

    texts = {k: [prose(800 + 5 * k + j, 40) for j in range(k % 3 + 2)] for k in range(12)}
    rows = [(k, "http://unmarked.example/x", page(k, "".join(f"<p>{x}</p>" for x in t))) for k, t in texts.items()]
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == {k: "\n".join([prose(700 + k, 6), *t]) for k, t in texts.items()}
    assert all(r.n_decided == 2 for r in got.values())
    assert all(wrapper.extract(h) != got[k].text for k, _, h in rows)  # the page alone does not tell


def test_bpe_like_tiktoken(spark):
    import tiktoken

    path = tk.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs(spark, ODD), path, tk.PATTERN)
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, want.encode_ordinary(t or "")) for i, t in ODD)
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(got, path).collect()} == {i: (t or "").encode() for i, t in ODD}
    trip = {r.doc_id: r for r in bpe.round_trip(docs(spark, ODD), path, tk.PATTERN).collect()}
    assert all(trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in ODD)
    offsets = bpe.encode(docs(spark, [(1, "é\U0001f600a")]), path, tk.PATTERN, offsets=True).first()
    assert len(offsets.offsets) == len(offsets.ids) and offsets.offsets[-1][1] == 3
    assert bpe.round_trip(docs(spark, ODD).limit(0), path, tk.PATTERN).count() == 0
    text = "é 漢字😀 é " + "".join(map(chr, range(0x20, 0x3000, 7)))
    ids = want.encode_ordinary(text)
    assert "".join(bpe.decode_stream(ids, path)) == text == bpe.decode(ids, path).decode()
    inside = sum(1 for k in range(1, len(ids)) if bpe.decode(ids[k:], path)[0] & 0xC0 == 0x80)
    assert bpe.split_characters(ids, text.encode(), path) == inside > 0
    with pytest.raises((ValueError, IndexError)):
        bpe.decode([10**6], path)


def test_licences_held_out(spark):
    sample = [prose(k, 40) for k in range(400)]
    model = licences.fit(licences.training_rows(sample))
    held = licences.training_rows([prose(5000 + k, 40) for k in range(200)], seed=99, copies=6)
    guess = lambda w: (lambda p: model.families[int(p.argmax())])(model.probabilities(w))
    assert np.mean([guess(w) == f for w, f, _ in held]) > 0.95
    text = "intro\n" + licences.TEMPLATES["mit"][0] + "\n" + prose(3, 30) + " " + licences.TEMPLATES["gpl"][0] + "\nlicensed things under the roof"
    got = {(r.pos, r.family) for r in licences.scan(docs(spark, [(1, text), *ODD]), model).collect() if r.confirmed}
    assert got == {(1, "mit"), (2, "gpl")}
    assert licences.licence_scan(docs(spark, ODD)).count() == 0 and licences.licence_scan(docs(spark, ODD).limit(0)).count() == 0


def test_licences_wrapped_in_comments(spark):
    """Notices wrapped over lines behind comment marks, two notices on lines that follow each other, and one inside prose."""
    model = licences.fit(licences.training_rows([prose(k, 40) for k in range(400)]))

    def wrapped(text, mark, width=9):
        words = text.split()
        return "\n".join(f"{mark} " + " ".join(words[k : k + width]) for k in range(0, len(words), width))

    T = licences.TEMPLATES
    texts = {1: "code()\n" + wrapped(T["mit"][2], "#") + "\n\n" + prose(1, 20), 2: wrapped(T["gpl"][1], " *") + "\n *\n" + wrapped(T["gpl"][2], " *"), 3: T["mit"][0] + "\n" + T["apache"][0], 4: prose(2, 30) + " " + T["bsd"][0] + " " + prose(3, 9), 5: prose(4, 60)}
    got = sorted((r.doc_id, r.pos, r.family) for r in licences.scan(docs(spark, list(texts.items())), model).collect() if r.confirmed)
    assert got == [(1, 1, "mit"), (2, 0, "gpl"), (2, 6, "gpl"), (3, 0, "mit"), (3, 1, "apache"), (4, 0, "bsd")]


def test_licences_unseen_templates_and_calibration():
    """Licence texts that a fit has not seen are mostly told from prose (not by family: their names are unseen too), prose nearly always."""
    rows = licences.training_rows([prose(k, 40) for k in range(600)])
    held = licences.held_out(rows)
    families = [licences.UNKNOWN, *sorted(licences.TEMPLATES)]
    assert {f for (_, f, _), h in zip(rows, held) if h} == {f for f in families if len(licences.TEMPLATES.get(f, [1, 2])) > 1}
    index = licences.fit(rows, steps=1).index
    w, b = licences._regression([r for r, h in zip(rows, held) if not h], families, index, 300, 2.0, 1e-4)
    seen = [r for r, h in zip(rows, held) if h]
    p = licences._softmax(licences.Sparse([r[0] for r in seen], index).times(w) + b)
    right = np.array([families[k] == r[1] for k, r in zip(p.argmax(1), seen)])
    unknown = np.array([r[1] == licences.UNKNOWN for r in seen])
    assert right[unknown].mean() > 0.95 and (p[~unknown].argmax(1) > 0).mean() > 0.7

    dense = np.random.default_rng(1).normal(size=(len(index), 3))
    x = licences.Sparse([r[0] for r in rows[:50]] + [[]], index)
    full = np.zeros((51, len(index)))
    full[x.rows, x.columns] = x.values
    assert np.allclose(x.times(dense), full @ dense) and np.allclose(x.transposed_times(full @ dense), full.T @ (full @ dense))


def test_licence_similarity_like_brute_force():
    rng = np.random.default_rng(2)
    for family, texts in licences.TEMPLATES.items():
        words = licences.words_of(prose(5, 20) + " " + texts[-1])
        words = [w for w in words if rng.random() > 0.1]
        best = 0.0
        for t in texts:
            tw = licences.words_of(t)
            n = min(5, len(tw))
            have = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
            want = {tuple(tw[k : k + n]) for k in range(len(tw) - n + 1)}
            best = max(best, sum(x in have for x in want) / len(want))
        assert licences.similarity(words, family) == pytest.approx(best)


def test_tiling_of_one_repeated_word_is_bounded():
    tiles = decontam.tile(["a"] * 300, ["a"] * 200_000)
    assert tiles == [(0, 0, 300)]
    tiles = decontam.tile(["a"] * 50, (["a"] * 20 + ["b"]) * 500)
    assert [n for _, _, n in tiles] == [20, 20, 10]


def test_rows_without_id_are_decontaminated(spark):
    item = prose(7, 40)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontam.drop_contaminated(docs(spark, [(None, item), (None, prose(8, 50)), (None, None), (1, item)]), items)
    assert sorted(r.text or "" for r in left.collect()) == ["", prose(8, 50)]


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    a, b = prose(20, 60), prose(21, 60)
    left = simhash.near_dedup(docs(spark, [(1, a), (2, a), (2, b), (2, b), (None, a)]))
    assert left.columns == docs(spark, []).columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, a), (2, b), (2, b), (0, a)])


def test_inner_names_as_columns(spark):
    """Columns named like those that the operators join by pass through."""
    line = prose(22, 20)
    odd = docs(spark, [(k, line + f"\n{prose(30 + k, 12)}") for k in range(6)])
    for name in ("d", "b", "g", "r", "__host", "__keep", "__tid", "keep", "n_lines", "n_dropped", "a.b"):
        odd = odd.withColumn(name, F.lit("x"))
    out = lines.dedup_lines(odd)
    assert set(out.columns) == set(odd.columns)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r["a.b"], r["__keep"]) for r in out.collect()) == [(k, 2, int(k < 5), "x", "x") for k in range(6)]
    items = spark.createDataFrame([(1, prose(7, 40))], "item_id long, text string")
    for left in (quality.keep_good(odd), simhash.near_dedup(odd), decontam.drop_contaminated(odd, items)):
        assert left.columns == odd.columns and left.count() > 0

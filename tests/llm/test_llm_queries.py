"""The registered queries: those with SQL against it, and the pipeline stage by stage."""

import base64
import hashlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from provsight.llm import queries as Q

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF), c.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, data: sorted(tuple(str(r[k]) for k in sorted(range(len(columns)), key=lambda k: columns[k])) for r in data)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline(spark):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        sizes.append(docs.count())
        if name != "bpe_encode":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_decodes(spark):
    """The last stage's digests are of the texts that enter it, and its ids decode to them."""
    import corpus_pipeline
    import public_tokenizers

    from provsight.llm import bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert {r.doc_id: bpe.decode(r.ids, path) for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.decoded_sha256 for r in got} == {k: hashlib.sha256(t).hexdigest() for k, t in want.items()}
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_pipeline_like_brute_force(spark, tmp_path):
    """All five stages by plain Python on a small table: what stays, its ids and digests."""
    import re
    from itertools import combinations

    import corpus_pipeline
    import numpy as np
    import public_tokenizers
    import tiktoken
    from test_llm_operators import fp, groups, naive_tiles

    rng = np.random.default_rng(17)
    prose = lambda n: " ".join(f"v{k}" for k in rng.integers(0, 3000, n))
    shared = "A line that is on many pages, of forty characters at least"
    base, items = [prose(80) for _ in range(12)], [(k, prose(24)) for k in range(3)]
    rows = [(k, f"{t}\n{shared if k % 2 else shared.upper()}\nend {k}", "good") for k, t in enumerate(base)]
    rows += [(20, base[0] + " more", "good"), (21, base[1], "good"), (22, base[1], "good"), (23, "too short", "good"), (24, "again and again the same " * 9, "good")]
    rows += [(30, prose(20) + " " + " ".join(items[0][1].split()[12:] + ["x"] + items[0][1].split()[:12]) + " " + prose(9), "good"), (31, items[1][1] + " " + prose(40), None), (32, items[2][1][:20] + " " + prose(40), "good")]
    rows += [(40 + k, "junk", "bad") for k in range(30)] + [(90, prose(50), "bad"), (91, None, "good"), (92, "", None), (93, "é 漢字 \U0001f600 " + prose(30), "h9")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def failed(t):
        w = words(t)
        five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        held = {k + j for k, x in enumerate(five) if five.count(x) > 1 for j in range(5)}
        return len(w) < 10 or 100 * len(held) > 20 * len(w)

    rates: dict = {}
    for _, t, s in rows:
        if s is not None:
            rates.setdefault(s, []).append(failed(t))
    raw = {s: np.mean(x) for s, x in rates.items()}
    mean = np.mean(list(raw.values()))
    few = np.mean([1 / len(x) for x in rates.values()])
    between = (np.var(list(raw.values())) - mean * (1 - mean) * few) / (1 - few)
    weight = max(mean * (1 - mean) / between - 1, 0)

    def surely(x):
        a, b = sum(x) + mean * weight, len(x) - sum(x) + (1 - mean) * weight
        return a / (a + b) - 1.645 * np.sqrt(a * b / (a + b) ** 2 / (a + b + 1))

    bad = {s for s, x in rates.items() if surely(x) > max(mean + np.sqrt(between), 0.5)}
    assert bad == {"bad"}
    left = {i: t for i, t, s in rows if not failed(t) and s not in bad}

    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    on: dict = {}
    for i, t in left.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                on.setdefault(key(x), set()).add(i)
    left = {i: "\n".join(x for x in t.split("\n") if len(on.get(key(x), ())) < 5 or i == max(on[key(x)])) for i, t in left.items()}

    prints = {i: fp(t) for i, t in left.items()}
    group = groups(sorted(left), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    left = {i: t for i, t in left.items() if group[i] == i}

    token = lambda t: re.findall(r"\w+", t.lower())
    covered = lambda item, t: sum(naive_tiles(token(item), token(t), 5))
    left = {i: t for i, t in left.items() if not any(covered(x, t) >= 0.5 * len(token(x)) for _, x in items)}
    assert {30, 31}.isdisjoint(left) and 32 in left and any(a in group and group[a] == group[b] for a, b in combinations((1, 21, 22), 2))

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items())
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want

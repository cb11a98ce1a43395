"""Quality rules at two levels: a document's own text, and the host it came from.

Each document gets base counts and a base verdict. Failures are summed by host, each host's failure rate is shrunk
towards the others by an empirical beta prior, and the verdict on the host is joined back to its documents. The prior's
moments are those of the hosts' rates less what sampling alone would spread them: of n documents a host shows the variance
v + (m(1-m) - v)/n for a prior of mean m and variance v. A host is rejected when its posterior, again a beta, lies with 95 %
(its mean less CREDIBLE of its standard deviations) above both PRIOR_SPREADS standard deviations of the prior over its mean,
and MIN_HOST_RATE: as all documents of a rejected host go, more bad than good ones must be expected to.

Defined cases: null text counts as empty (no words: base_failed); a null host has no verdict of its own; repeated
rows count as often as they occur; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut, saved

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its failure rate is surely above both: so many standard deviations over the prior's mean, and this rate.
PRIOR_SPREADS, MIN_HOST_RATE = 1.0, 0.5
#: Standard deviations of the posterior below its mean that leave 95 % of it above.
CREDIBLE = 1.645
#: Rejected hosts that may be broadcast; beyond it the join is shuffled.
MAX_BROADCAST_HOSTS = 100_000
_word = re.compile(WORD)


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    covered = np.zeros(len(words), bool)
    starts = np.fromiter((count[w] > 1 for w in windows), bool, n)
    for k in range(width):
        covered[k : k + n] |= starts
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if _word.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _counts(text: Column) -> Column:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(x) for x in texts], columns=names, dtype="int64")

    return F.pandas_udf(make, ", ".join(f"{n} long" for n in names))(text)


def _failed(text: Column) -> Column:
    def make(texts: pd.Series) -> pd.Series:
        words = (_word.findall(x or "") for x in texts)
        return pd.Series([len(w) < MIN_WORDS or 100 * repeated_words(w) > MAX_REPEAT_PERCENT * len(w) for w in words], dtype=bool)

    return F.pandas_udf(make, "boolean")(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def host_prior(hosts: DataFrame) -> DataFrame:
    """One row (mean, between) from hosts(n_docs, n_failed): the moments of the hosts' own rates. between is null where sampling explains all."""
    raw = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(raw).alias("mean"), F.var_pop(raw).alias("var"), F.avg(1 / F.col("n_docs")).alias("inverse"))
    sampled = F.col("mean") * (1 - F.col("mean")) * F.col("inverse")
    between = F.when(F.col("inverse") < 1, (F.col("var") - sampled) / (1 - F.col("inverse")))
    return moments.select("mean", F.when(between > 1e-9, between).alias("between"))


def host_verdicts(flags: DataFrame, spreads: float = PRIOR_SPREADS, min_rate: float = MIN_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) from flags(host, failed): the beta prior is fitted to all hosts by moments.

    Where the rates differ no more than sampling explains, every host has the mean rate, and none stands out.
    """
    hosts = flags.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"))
    spread = F.col("mean") * (1 - F.col("mean"))
    joined = hosts.crossJoin(F.broadcast(host_prior(hosts)))  # the prior is one row
    weight = F.greatest(spread / F.col("between") - 1, F.lit(0.0))
    total = F.col("n_docs") + weight
    rate = F.coalesce((F.col("n_failed") + F.col("mean") * weight) / total, F.col("mean"))
    surely = rate - CREDIBLE * F.sqrt(rate * (1 - rate) / (total + 1))
    rejected = F.col("between").isNotNull() & F.coalesce(surely > F.greatest(F.col("mean") + spreads * F.sqrt("between"), F.lit(min_rate)), F.lit(False))
    return joined.select("host", "n_docs", "n_failed", rate.alias("rate"), rejected.alias("rejected"))


def quality_rules(docs: DataFrame, host: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, host, base counts, base_failed, host_rejected, kept."""
    digest = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), _counts(F.col(text)).alias("c"))
    digest = digest.select("doc_id", "host", "c.*").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    digest = cut(digest)  # two readers; a few numbers a document
    verdicts = cut(host_verdicts(digest.select("host", F.col("base_failed").alias("failed"))))
    rejected = broadcast_if_small(verdicts.where("rejected").select("host", F.lit(True).alias("host_rejected")), MAX_BROADCAST_HOSTS)
    out = digest.join(rejected, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their columns. Texts are judged once; the good ones are kept as Parquet until hosts are known."""
    flag = "failed"
    while flag in (c.lower() for c in docs.columns):
        flag += "_"
    judged = docs.withColumn(flag, _failed(F.col(text)))
    judged = saved(judged.withColumn(text, F.when(~F.col(flag), F.col(text))))
    rejected = cut(host_verdicts(judged.select(F.col(host).alias("host"), F.col(flag).alias("failed")))).where("rejected").select("host")
    good = judged.where(~F.col(flag)).drop(flag)
    return good.alias("d").join(broadcast_if_small(rejected, MAX_BROADCAST_HOSTS).alias("r"), F.col(f"d.{host}") == F.col("r.host"), "left_anti")

"""Set operations, drift, diff and reconciliation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import dependants


def set_drift(declared: DataFrame, live: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, status MATCHED, MISSING or UNDECLARED); with `within`, live rows outside the declared values of it do not count."""
    d, n = declared.select(*keys).distinct(), live.select(*keys).distinct()
    if within:
        n = n.join(d.select(*within).distinct(), within, "left_semi")
    both = d.withColumn("d", F.lit(True)).join(n.withColumn("n", F.lit(True)), keys, "full")
    return both.select(*keys, F.when(F.col("d").isNull(), "UNDECLARED").when(F.col("n").isNull(), "MISSING").otherwise("MATCHED").alias("status"))


def token_coverage(uses: DataFrame, defs: DataFrame, reserved: list[str]) -> DataFrame:
    """(env, token, finding, n): undefined, unused, empty or shared (a value that several tokens of an env have)."""
    used = uses.groupBy("env", "token").agg(F.count("*").alias("n"))
    undefined = used.join(defs, ["env", "token"], "left_anti").select("env", "token", F.lit("undefined").alias("finding"), "n")
    plain = defs.where(~F.col("token").isin(*reserved))
    row = lambda df, finding: df.select("env", "token", F.lit(finding).alias("finding"), F.lit(0).cast("long").alias("n"))
    unused = row(plain.join(used, ["env", "token"], "left_anti"), "unused")
    empty = row(defs.where("coalesce(value, '') = ''"), "empty")
    shared = plain.where("value != ''").groupBy("env", "value").agg(F.count("*").alias("c")).where("c > 1")
    return undefined.unionByName(unused).unionByName(empty).unionByName(row(plain.join(shared, ["env", "value"]), "shared"))


def undefined_files(uses: DataFrame, defs: DataFrame, path: str) -> DataFrame:
    """(env, token, path): the files that use a token which its environment does not define, as rows."""
    return uses.select("env", "token", path).distinct().join(defs.select("env", "token"), ["env", "token"], "left_anti")


def coverage_status(coverage: DataFrame, defs: DataFrame) -> DataFrame:
    """(env, status): error with an undefined token, warning with another finding, else success; all environments that are defined or found."""
    rank = F.max(F.when(F.col("finding") == "undefined", 2).when(F.col("finding").isNotNull(), 1).otherwise(0))
    every = defs.select("env", F.lit(None).cast("string").alias("finding")).distinct().unionByName(coverage.select("env", "finding"))
    return every.groupBy("env").agg(rank.alias("r")).select("env", F.when(F.col("r") == 2, "error").when(F.col("r") == 1, "warning").otherwise("success").alias("status"))


#: Families of types that convert with a warning, by the server's codes and by the names that stand for them.
FAMILIES = {
    "numeric": ("I1", "I2", "I", "I8", "F", "D", "BYTEINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DECIMAL", "NUMERIC"),
    "string": ("CF", "CV", "UC", "UV", "LF", "LV", "CHAR", "VARCHAR", "CLOB"),
    "datetime": ("DA", "TS", "TZ", "SZ", "AT", "TI", "DATE", "TIME", "TIMESTAMP"),
    "byte": ("BF", "BV", "BO", "BYTE", "VARBYTE", "BLOB"),
}


def _family(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind.isin(*v), F.lit(k)) for k, v in FAMILIES.items()], kind)


def schema_compat(old: DataFrame, new: DataFrame, table: str = "tab") -> DataFrame:
    """One row per column of either side: change and level (blocker, warning or ok)."""
    o = old.select(table, F.lower("name").alias("name"), F.col("type").alias("t0"), F.col("length").alias("l0"))
    n = new.select(table, F.lower("name").alias("name"), F.col("type").alias("t1"), F.col("length").alias("l1"), "not_null", "has_default")
    both = o.join(n, [table, "name"], "full")
    change = (F.when(F.col("t0").isNull(), F.when((F.col("not_null") == 1) & (F.col("has_default") == 0), "added_required").otherwise("added"))
              .when(F.col("t1").isNull(), "dropped").when((F.col("t0") == F.col("t1")) & (F.col("l1") < F.col("l0")), "narrower")
              .when((F.col("t0") == F.col("t1")) & (F.col("l1") > F.col("l0")), "wider").when(F.col("t0") == F.col("t1"), "same")
              .when(_family(F.col("t0")) == _family(F.col("t1")), "family").otherwise("other_type"))
    both = both.select(table, "name", change.alias("change"))
    level = F.when(F.col("change").isin("added_required", "narrower", "other_type"), "blocker").when(F.col("change").isin("dropped", "wider", "family"), "warning").otherwise("ok")
    return both.withColumn("level", level)


def compat_verdict(changes: DataFrame, table: str = "tab") -> DataFrame:
    """(table, can_migrate, n_blockers, n_warnings, blockers)."""
    return changes.groupBy(table).agg((F.count_if(F.col("level") == "blocker") == 0).alias("can_migrate"), F.count_if(F.col("level") == "blocker").alias("n_blockers"), F.count_if(F.col("level") == "warning").alias("n_warnings"),
                                      F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") == "blocker", F.col("name")))), ",").alias("blockers"))


def _casts(df: DataFrame, target: list[tuple[str, str, object]]) -> tuple[dict[str, Column], Column]:
    """(casts of the columns that df has, whether a value of a row cannot be cast)."""
    cast = {n: F.expr(f"try_cast(`{n}` AS {t})") for n, t, _ in target if n in df.columns}
    bad = F.lit(False)
    for n, c in cast.items():
        bad = bad | (F.col(n).isNotNull() & c.isNull())
    return cast, bad


def conform_counts(df: DataFrame, target: list[tuple[str, str, object]]) -> DataFrame:
    """One row (moved, rejected): what conform copies and what it returns, counted in one pass."""
    bad = _casts(df, target)[1]
    return df.agg(F.count_if(~bad).alias("moved"), F.count_if(bad).alias("rejected"))


def conform(df: DataFrame, target: list[tuple[str, str, object]], changes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in the target's shape, rejected rows): target is (name, type, default for added columns).

    A value that the type cannot hold rejects the row, which is returned as it was. changes: the table's rows of
    schema_compat; with a blocker among them nothing is copied and ValueError is raised.
    """
    if changes is not None and not changes.where("level = 'blocker'").isEmpty():
        raise ValueError("the schemas are not compatible: " + compat_verdict(changes.withColumn("tab", F.lit("")), "tab").first()["blockers"])
    have = set(df.columns)
    cast, bad = _casts(df, target)
    marked = df.withColumn("__bad", bad)
    good = marked.where("NOT __bad").select(*[cast[n].alias(n) if n in have else F.lit(v).cast(t).alias(n) for n, t, v in target])
    return good, marked.where("__bad").drop("__bad")


def contract_diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """(object, name, change) from (object, kind, pos, name, type[, direction]): breaking changes only; additions are compatible."""
    way = lambda df, alias: (F.col("direction") if "direction" in df.columns else F.lit(None).cast("string")).alias(alias)
    objects = lambda df: df.groupBy("object").agg(F.min("kind").alias("kind"))
    gone = objects(base).select("object", F.col("kind").alias("k0")).join(objects(now).select("object", F.col("kind").alias("k1")), "object", "left")
    whole = gone.where("k1 IS NULL OR k0 != k1").select("object", F.lit(None).cast("string").alias("name"), F.when(F.col("k1").isNull(), "object_removed").otherwise("kind_changed").alias("change"))
    kept = gone.where("k0 = k1").select("object", "k0")
    old = base.select("object", "kind", "name", F.col("type").alias("t0"), F.col("pos").alias("p0"), way(base, "d0"))
    pair = old.join(now.select("object", "name", F.col("type").alias("t1"), F.col("pos").alias("p1"), way(now, "d1")), ["object", "name"], "left").join(kept, "object").where("kind = k0")
    # all changes of a column from one pass; columns that are ranked stand in a part of their own
    ranked = pair.withColumn("common", F.expr("kind = 'VIEW' AND p1 IS NOT NULL"))
    place = lambda by: F.row_number().over(W.partitionBy("object", "common").orderBy(by))
    ranked = ranked.withColumn("moved", F.col("common") & (place("p0") != place("p1")))
    found = F.array(F.when(F.col("p1").isNull(), "column_removed").when(F.expr("NOT (t0 <=> t1)"), "type_changed"),
                    F.when(F.expr("p1 IS NOT NULL AND kind = 'PROCEDURE' AND NOT (d0 <=> d1)"), "direction_changed"), F.when(F.col("moved"), "reordered"))
    return whole.unionByName(ranked.select("object", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("change")))


def grant_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(grantee, n_missing, n_extra, status): consistent, drifted, missing (nothing granted) or orphaned (nothing expected)."""
    keys = ["grantee", "grantor", "privilege"]
    both = set_drift(expected, actual, keys)
    sums = both.groupBy("grantee").agg(F.count_if(F.col("status") == "MISSING").alias("n_missing"), F.count_if(F.col("status") == "UNDECLARED").alias("n_extra"), F.count_if(F.col("status") == "MATCHED").alias("n_matched"))
    status = F.when(F.col("n_missing") + F.col("n_extra") == 0, "consistent").when((F.col("n_matched") + F.col("n_extra")) == 0, "missing").when((F.col("n_matched") + F.col("n_missing")) == 0, "orphaned").otherwise("drifted")
    return sums.select("grantee", "n_missing", "n_extra", status.alias("status"))


def normal_definition(text: Column) -> Column:
    """Line ends trimmed, blank head and tail gone."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+(?=\n|\z)", ""), r"\A\n+", ""), r"\n+\z", "")


def definition_drift(baseline: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """(key, drifted); an object without a baseline has not drifted."""
    b = baseline.select(key, normal_definition(F.col(text)).alias("__b"))
    return current.select(key, normal_definition(F.col(text)).alias("__c")).join(b, key, "left").select(key, F.coalesce(F.col("__b") != F.col("__c"), F.lit(False)).alias("drifted"))


def definition_diff(baseline: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """(key, diff): unified line differences of the drifted objects only."""
    b, c = baseline.select(key, normal_definition(F.col(text)).alias("b")), current.select(key, normal_definition(F.col(text)).alias("c"))

    def diff(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff(x.split("\n"), y.split("\n"), "baseline", "current", lineterm="", n=1)) for x, y in zip(old, new)])

    return b.join(c, key).where("b != c").select(key, F.pandas_udf(diff, "string")("b", "c").alias("diff"))


def changeset(base: DataFrame, now: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change added, changed or removed) by content hash."""
    b, n = base.select(key, F.sha2(text, 256).alias("b")), now.select(key, F.sha2(text, 256).alias("n"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("b") != F.col("n"), "changed")
    return b.join(n, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def changeset_impact(changes: DataFrame, objects: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(node, role): the objects(key, node) of changed files, and all that depend on these over edges(node, dep)."""
    changed = objects.join(changes.select(key), key, "left_semi").select("node").distinct()
    return changed.withColumn("role", F.lit("changed")).unionByName(dependants(edges, changed).withColumn("role", F.lit("dependant")))


def twins(files: DataFrame, folder: str, name: str, item: Column, tokenised: Column, content: str) -> DataFrame:
    """(folder, item, n, finding, same_content): a literal and a tokenised name of one item are a pair, more are an error."""
    groups = files.withColumn("item", item).withColumn("tok", tokenised).groupBy(folder, "item").agg(
        F.count("*").alias("n"), F.count_if("tok").alias("n_tok"), (F.countDistinct(F.sha2(F.col(content).cast("string"), 256)) == 1).alias("same_content"))
    finding = F.when(F.col("n") > 2, "error").when((F.col("n") == 2) & (F.col("n_tok") == 1), "pair")
    return groups.withColumn("finding", finding).where("finding IS NOT NULL").select(folder, "item", "n", "finding", "same_content")


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """What only one of two implementations found: (keys, only_in a or b)."""
    return set_drift(a, b, keys).where("status != 'MATCHED'").select(*keys, F.when(F.col("status") == "MISSING", "a").otherwise("b").alias("only_in"))


def stale_completed(state: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """State rows, with COMPLETED ones that the live catalogue lacks reset to PENDING."""
    marked = state.join(live.select(key).distinct().withColumn("__live", F.lit(True)), key, "left")
    return marked.withColumn("state", F.when((F.col("state") == "COMPLETED") & F.col("__live").isNull(), "PENDING").otherwise(F.col("state"))).drop("__live")

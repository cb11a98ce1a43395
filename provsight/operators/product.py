"""Query patterns of a versioned data product: current state, first and latest rows, enrichment, point in time, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut, numbered


def current_rows(df: DataFrame, current: str = "is_current", deleted: str = "is_deleted") -> DataFrame:
    return df.where((F.col(current) == 1) & (F.col(deleted) == 0))


def active_rows(df: DataFrame, **equal) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), equal.items(), df)


def publish_views(spark: SparkSession, tables: dict[str, DataFrame], prefix: str) -> dict[str, DataFrame]:
    """A view with an explicit column list for each table, under prefix_name; business reads use the view."""
    for name, df in tables.items():
        df.select(*df.columns).createOrReplaceTempView(f"{prefix}_{name}")
    return {name: spark.table(f"{prefix}_{name}") for name in tables}


def map_namespace(name: Column, strategy: str, pattern: str = "", replacement: str = "", pairs: dict[str, str] | None = None) -> Column:
    """Tables namespace to views namespace: separated (pattern), colocated (the same), mapped (explicit pairs, else null)."""
    if strategy == "colocated":
        return name
    if strategy == "separated":
        return F.regexp_replace(name, pattern, replacement)
    return reduce(lambda c, kv: c.when(name == kv[0], kv[1]), (pairs or {}).items(), F.when(F.lit(False), None))


def decode(code: Column, meanings: dict[str, str], default: Column) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in meanings.items()], default)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def column_catalog(columns: DataFrame, curated: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """The description of each column: an override wins, then the curated text, then the dictionary's; origin says which."""
    c = curated.where("is_active = 1").select(*keys, blank_to_null(F.col("description")).alias("__curated"))
    o = overrides.where("is_active = 1").select(*keys, blank_to_null(F.col("description")).alias("__override"))
    out = columns.join(c, keys, "left").join(o, keys, "left").withColumn("__own", blank_to_null(F.col("description")))
    origin = F.when(F.col("__override").isNotNull(), "override").when(F.col("__curated").isNotNull(), "curated").when(F.col("__own").isNotNull(), "dictionary").otherwise("none")
    return out.withColumn("origin", origin).withColumn("description", F.coalesce("__override", "__curated", "__own")).drop("__override", "__curated", "__own")


def manifest_json(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Adds manifest: a JSON document of the fields, escaped by Spark."""
    return df.withColumn("manifest", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}))


#: What is shown instead of secret references, sensitive values and empty ones; names that are sensitive.
SECRET_SHOWN, MASKED_SHOWN, EMPTY_SHOWN = "«secret ref»", "«masked»", "«empty»"
SENSITIVE = r"(?i)(password|passwd|pwd|secret|credential|key)"


def redact(name: Column, raw: Column, value: Column | None = None) -> tuple[Column, Column]:
    """(class, display): only plain values are shown. raw decides whether it is a reference; value (raw by default) is what it resolved to."""
    value = raw if value is None else value
    bare = F.trim(F.coalesce(raw, F.lit("")))
    kind = F.when(bare.startswith("$env:") | bare.startswith("vault:"), "secret-ref").when(F.coalesce(name, F.lit("")).rlike(SENSITIVE), "sensitive").otherwise("plain")
    shown = F.when(kind == "secret-ref", SECRET_SHOWN).when(kind == "sensitive", MASKED_SHOWN).when(F.coalesce(value, F.lit("")) == "", EMPTY_SHOWN).otherwise(value)
    return kind, shown


def ttl_check(df: DataFrame, ts: str, max_days: int, as_of: str, level: str = "WARNING") -> DataFrame:
    """Adds age_days and flag (the level beyond max_days, else OK; 0 disables)."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col(ts).cast("date"))
    return df.withColumn("age_days", age).withColumn("flag", F.when((F.lit(max_days) > 0) & (age > max_days), level).otherwise("OK"))


def enrich(fact: DataFrame, inner: list[tuple[DataFrame, list[str]]], left: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Star enrichment; every side must be unique by its key, so that a row stays a row."""
    out = reduce(lambda d, s: d.join(s[0], s[1], "inner"), inner, fact)
    return reduce(lambda d, s: d.join(s[0], s[1], "left"), left, out)


def latest_join(parents: DataFrame, runs: DataFrame, key: str, ts: str) -> DataFrame:
    """Parents left-joined to their runs at the latest time, ties kept; parents without runs stay."""
    last = runs.groupBy(key).agg(F.max(ts).alias(ts))
    return parents.join(runs.join(last, [key, ts]), key, "left")


def as_of(history: DataFrame, ts, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return history.where((F.col(start) <= ts) & (F.lit(ts) < F.col(end)))


def asof_join(left: DataFrame, history: DataFrame, key: str, ts: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """left with the version valid at its time, if any: an equi-join with a range condition."""
    h = history.withColumnRenamed(key, "__key")
    return left.join(h, (F.col(key) == F.col("__key")) & (F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end)), "left").drop("__key")


def asof_fill(left: DataFrame, history: DataFrame, key: str, ts: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """As asof_join, for histories whose versions of a key do not overlap, and without a task that holds a key as a whole.

    Rows and versions are dealt in ranges of (key, time) and each range is filled forward by itself; what the ranges before
    hold of the key is carried in from one row a range and key. Rows without key or time match nothing.
    """
    taken = [c for c in history.columns if c != key]
    given = [c for c in left.columns if c != key]
    point = lambda df, t, side, row, version: df.select(F.col(key).alias("__key"), t.alias("__t"), F.lit(side).alias("__side"), row.alias("__row"), version.alias("__v"))
    kind = lambda df, cols: f"struct<{','.join(f'`{c}`:{df.schema[c].dataType.simpleString()}' for c in cols)}>"
    rows = point(left, F.col(ts), 1, F.struct(*given), F.lit(None).cast(kind(history, taken)))
    versions = point(history.where(F.col(key).isNotNull() & F.col(start).isNotNull()), F.col(start), 0, F.lit(None).cast(kind(left, given)), F.struct(*taken))
    order = ["__t", "__side", f"__v.{end}"]  # of versions that start together the one that ends last counts
    placed = cut(rows.unionByName(versions).repartitionByRange("__key", *order).withColumn("__part", F.spark_partition_id()))
    ends = placed.groupBy("__part", "__key").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    earlier = W.partitionBy("__key").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # as many rows of a key as it has ranges
    carried = ends.select("__part", "__key", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    here = W.partitionBy("__part", "__key").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = placed.withColumn("__v", F.last("__v", ignorenulls=True).over(here)).where("__side = 1")
    met = filled.join(carried.withColumnRenamed("__part", "__p").withColumnRenamed("__key", "__k"), (F.col("__part") == F.col("__p")) & F.col("__key").eqNullSafe(F.col("__k")), "left")
    found = F.coalesce("__v", "__carried")
    valid = F.when(F.col("__key").isNotNull() & (F.col("__t") < found[end]), found)
    met = met.select(F.col("__key").alias(key), "__row.*", valid.alias("__v"))
    return met.select(*left.columns, *(F.col("__v")[c].alias(c) for c in taken))


def pit_features(features: DataFrame, entity: DataFrame, key: str) -> DataFrame:
    """Feature history of the entities that are current, with its validity bounds."""
    return features.join(entity.select(key), key)


def attach(entity: DataFrame, side: DataFrame, key: str, **equal) -> DataFrame:
    return entity.join(active_rows(side, **equal), key)


def object_catalog(modules: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    deployed = objects.where((F.col("is_active") == 1) & (F.upper(F.trim("status")) == "DEPLOYED"))
    joined = modules.where("is_active = 1").drop("is_active").join(deployed.drop("is_active"), key)
    return joined.withColumn("full_name", F.concat_ws(".", F.trim("module_name"), F.trim("object_name")))


def orientation(registry: DataFrame, resources: list[tuple[str, str]]) -> DataFrame:
    """A constant list of resources for each registry row; the list is a literal, so it is exploded, not joined."""
    return registry.withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).alias("resource"), F.lit(b).alias("purpose")) for a, b in resources]))).select("*", "r.*").drop("r")


def unreferenced(declared: DataFrame, refs: DataFrame, name: str, ref: str) -> DataFrame:
    normal = lambda c: F.upper(F.regexp_replace(F.col(c).cast("string"), '"', ""))
    used = refs.select(normal(ref).alias("__used"))
    return declared.join(used, normal(name) == F.col("__used"), "left_anti")


def external_parents(children: DataFrame, known: DataFrame, parent: str, node: str, need: str) -> DataFrame:
    """Parents that nobody declares: (parent, n_children, need, children)."""
    missing = children.join(known.select(F.col(node).alias(parent)), parent, "left_anti")
    return missing.groupBy(parent).agg(F.count("*").alias("n_children"), F.sum(need).alias("need"), F.array_join(F.transform(F.array_sort(F.collect_set(node)), lambda x: x.cast("string")), ",").alias("children"))


def external_children(children: DataFrame, known: DataFrame, parent: str, node: str) -> DataFrame:
    """(parent, node) of each child of a parent that nobody declares: a row each, however many children there are."""
    return children.join(known.select(F.col(node).alias(parent)), parent, "left_anti").select(parent, node).distinct()


#: Rights to create and drop that a deployment needs by kind of object; indexes use those of tables.
RIGHTS = {
    "TABLE": ["CT", "DT"], "JOIN_INDEX": ["CT", "DT"], "HASH_INDEX": ["CT", "DT"], "INDEX": ["CT", "DT"], "VIEW": ["CV", "DV"], "MACRO": ["CM", "DM"],
    "PROCEDURE": ["PC", "PD"], "FUNCTION": ["CF", "DF"], "TRIGGER": ["CG", "DG"], "JAR": ["CE", "AE"],
}


def required_rights(objects: DataFrame) -> DataFrame:
    """(db, right) of objects(db, kind); kinds without rights of their own need none."""
    rights = F.coalesce(*[F.when(F.upper("kind") == k, F.array(*map(F.lit, v))) for k, v in RIGHTS.items()], F.array().cast("array<string>"))
    return objects.select("db", F.explode(rights).alias("right")).distinct()


def missing_rights(required: DataFrame, granted: DataFrame, created: DataFrame) -> DataFrame:
    """Required (db, right) not granted, where AL stands for all and databases created here need none."""
    everything = granted.where("right = 'AL'").select("db")
    return required.join(granted, ["db", "right"], "left_anti").join(everything, "db", "left_anti").join(created.select("db"), "db", "left_anti")


def excess_rights(granted: DataFrame, risky: DataFrame) -> DataFrame:
    return granted.join(risky, "right", "left_semi")


def inherit_comments(view_columns: DataFrame, table_comments: DataFrame) -> DataFrame:
    """View columns with the comment of the table's column of the same name; none is made up."""
    t = table_comments.select(F.col("table_name").alias("base_table"), F.lower("column_name").alias("__c"), "comment")
    return view_columns.withColumn("__c", F.lower("column_name")).join(t, ["base_table", "__c"], "left").drop("__c")


def attribute_failures(failures: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds expected: the message names an object of the batch, its database or its name alone."""
    named = failures.withColumn("__n", F.upper(F.regexp_extract("message", r"'([^']+)'", 1)))
    names = objects.select(F.explode(F.array(F.upper(F.concat_ws(".", "db", "name")), F.upper("db"), F.upper("name"))).alias("__n")).distinct()
    return named.join(names.withColumn("expected", F.lit(True)), "__n", "left").withColumn("expected", F.coalesce("expected", F.lit(False))).drop("__n")


def source_of(df: DataFrame, sources: DataFrame, location: str, prefixes: tuple[str, ...] = ("payload/", "payload/database/")) -> DataFrame:
    """Adds source: location without :line, slashes one way, tried as it is and under each prefix; the first hit wins."""
    bare = F.regexp_replace(F.regexp_replace(F.col(location), r":\d+$", ""), r"\\", "/")
    known = sources.groupBy("path").agg(F.min("source").alias("source"))
    out, found = df.alias("d"), []
    for k, prefix in enumerate(("", *prefixes)):  # equi-joins on the unique path: rows stay as many as they are
        out = out.join(known.select(F.col("path").alias(f"__p{k}"), F.col("source").alias(f"__s{k}")), F.concat(F.lit(prefix), bare) == F.col(f"__p{k}"), "left")
        found.append(F.col(f"__s{k}"))
    return out.select(*(F.col(f"d.`{c}`") for c in df.columns), F.coalesce(*found).alias("source"))


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that is last by order, in every column: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def history_findings(df: DataFrame, keys: list[str], ts: str, build: str, content: str, tie: str) -> DataFrame:
    """(keys, ts, build, finding): a later row with a lower build than the row before, or a build with other contents."""
    before = F.lag(build).over(W.partitionBy(*keys).orderBy(ts, tie))
    lower = df.withColumn("__b", before).where(F.col(build) < F.col("__b")).select(*keys, ts, build, F.lit("build_goes_back").alias("finding"))
    reused = df.groupBy(*keys, build).agg(F.countDistinct(content).alias("n"), F.max(ts).alias(ts)).where("n > 1").select(*keys, ts, build, F.lit("build_reused").alias("finding"))
    return lower.unionByName(reused)


def missing_siblings(df: DataFrame, keys: list[str], name: str, requires: str) -> DataFrame:
    """(keys, name, requires) of required members (an array column) that the group lacks."""
    wanted = df.select(*keys, name, F.explode(requires).alias("required"))
    return wanted.join(df.select(*keys, F.col(name).alias("required")), [*keys, "required"], "left_anti")


def mixed_builds(df: DataFrame, keys: list[str], build: str) -> DataFrame:
    """(keys, n_builds, lowest, highest) of groups whose packages are of more than one build."""
    return df.groupBy(*keys).agg(F.countDistinct(build).alias("n_builds"), F.min(build).alias("lowest"), F.max(build).alias("highest")).where("n_builds > 1")


def prereq_without_main(df: DataFrame, keys: list[str], role: str, prereq: str = "prereq", main: str = "main") -> DataFrame:
    """(keys) of groups that have the prerequisite half of a release and not its main half."""
    return df.groupBy(*keys).agg(F.bool_or(F.col(role) == prereq).alias("p"), F.bool_or(F.col(role) == main).alias("m")).where("p AND NOT coalesce(m, false)").select(*keys)


def digest_findings(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds digest_status: absent, mismatch or ok."""
    return df.withColumn("digest_status", F.when(F.col(actual).isNull() | F.col(expected).isNull(), "absent").when(F.col(actual) != F.col(expected), "mismatch").otherwise("ok"))


def prune(df: DataFrame, keys: list[str], ts: str, tie: str, keep_runs: int | None = None, keep_days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Adds kept, by exactly one rule: the newest N, or those within D days of as_of; a missing time is oldest."""
    if (keep_runs is None) == (keep_days is None):
        raise ValueError("give exactly one of keep_runs and keep_days")
    if keep_runs is not None:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.col(tie).desc()))
        return df.withColumn("kept", rank <= keep_runs)
    return df.withColumn("kept", F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.col(ts).cast("date")) <= keep_days, F.lit(False)))


def resolve_layers(df: DataFrame, key: list[str], layer: str, value: str, precedence: str) -> DataFrame:
    """(key, value, layer) of the highest layer with a value."""
    return df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(value, layer), F.struct(precedence, layer)).alias("r")).select(*key, "r.*")


def rollback_candidates(state: DataFrame, wave: int | None = None) -> DataFrame:
    """Objects that a rollback undoes, last processed first; with a wave, rows without one are left out."""
    done = state.where(F.col("state").isin("BACKED_UP", "CREATED", "MIGRATED", "COMPLETED"))
    return (done if wave is None else done.where(F.col("wave") == wave)).orderBy(F.desc("seq"))


def resumable(state: DataFrame) -> DataFrame:
    return state.where(F.col("state").isin("PENDING", "FAILED"))


def ordered_plan(nodes: DataFrame, wave: str, kind: str, name: str, ranks: list[str]) -> DataFrame:
    """Adds position inside its wave: by rank of the kind (unknown kinds last), then name. A wave of any size is ranked by ranges."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(ranks)], F.lit(len(ranks)))
    placed = numbered(nodes.withColumn("__rank", rank), ["__rank", name], "position", (wave,))
    return placed.drop("__rank").withColumn("position", F.col("position").cast("int"))


def lineage_legs(lineage: DataFrame, kinds: DataFrame) -> DataFrame:
    """(node, job, direction, kind): the source-to-job and job-to-target legs of each row."""
    name = lambda side: F.concat_ws(".", blank_to_null(F.col(f"{side}_database")), blank_to_null(F.col(f"{side}_table")))
    legs = lineage.select(name("source").alias("node"), "job", F.lit("in").alias("direction")).unionByName(lineage.select(name("target").alias("node"), "job", F.lit("out").alias("direction")))
    return legs.join(kinds, "node", "left").withColumn("kind", F.coalesce("kind", F.lit("EXTERNAL")))

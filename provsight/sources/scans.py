"""Scans and sinks: text corpora, key=value files, run logs, manifests; edge lists, graph and lineage documents, audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = ("1", "1.0", "2", "2.0")
RUN_LOG = "schema_version string, runs array<struct<run_id:string,started_at:string,status:string,stages:array<struct<name:string,status:string,issues:array<struct<file:string,rule:string,severity:string,message:string>>>>>>"


def read_corpus(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, ext, text) of the files below root, one row each; Spark leaves out names that start with . or _.

    Extensions count in any case; files of others are not opened.
    """
    wanted = sorted({e.lower().lstrip(".") for e in extensions})
    globs = ",".join("*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + globs + "}").text(root, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return named.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "text")


def parse_kv(texts: DataFrame, env: str = "env", text: str = "text") -> DataFrame:
    """(env, name, value, line_no): # comments, the first = splits, both sides trimmed; of equal names the last line wins."""
    lines = texts.select(env, F.posexplode(F.split(text, "\r?\n")).alias("at", "line")).where(~F.trim("line").startswith("#") & F.col("line").contains("="))
    named = lines.select(env, F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)).alias("name"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"), (F.col("at") + 1).alias("line_no"))
    return named.where("name != ''").groupBy(env, "name").agg(F.max_by("value", "line_no").alias("value"), F.max("line_no").alias("line_no"))


def read_kv(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("env"), F.col("value").alias("text"))
    return parse_kv(files)


def read_run_log(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, stages, issues) of nested JSON logs; a file of an unknown schema version fails the read."""
    raw = spark.read.schema(RUN_LOG).option("multiLine", True).json(paths)
    known = F.when(F.col("schema_version").isin(*VERSIONS), F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("unknown schema_version "), F.coalesce("schema_version", F.lit("null")))).cast("string"))
    runs = raw.select(known.alias("schema_version"), F.explode_outer("runs").alias("r")).where("r IS NOT NULL").select("schema_version", "r.*")
    stages = runs.select("run_id", "schema_version", F.posexplode_outer("stages").alias("stage_no", "s")).where("s IS NOT NULL").select("run_id", "schema_version", "stage_no", F.col("s.name").alias("stage"), F.col("s.status").alias("status"), "s.issues")
    issues = stages.select("run_id", "stage_no", "stage", F.explode_outer("issues").alias("i")).where("i IS NOT NULL").select("run_id", "stage_no", "stage", "i.*")
    return runs.drop("stages"), stages.drop("issues"), issues


def read_release_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per package of each release group's JSON."""
    schema = "environment string, name string, timestamp string, build long, packages array<struct<file:string,sha256:string,role:string>>"
    groups = spark.read.schema(schema).option("multiLine", True).json(paths)
    return groups.select("environment", "name", "timestamp", "build", F.explode_outer("packages").alias("p")).select("environment", "name", "timestamp", "build", "p.*")


def edge_list(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(source, target, edge_type, source_type, target_type), from dependency to dependent; an unknown source has a blank type."""
    s, t = kinds.select(F.col("node").alias("source"), F.col("kind").alias("source_type")), kinds.select(F.col("node").alias("target"), F.col("kind").alias("target_type"))
    named = edges.select(F.col("dep").alias("source"), F.col("node").alias("target")).join(s, "source", "left").join(t, "target", "left")
    kind = F.when(F.col("source_type").isNull(), "external").otherwise("internal")
    return named.select("source", "target", kind.alias("edge_type"), F.coalesce("source_type", F.lit("")).alias("source_type"), F.coalesce("target_type", F.lit("")).alias("target_type"))


def write_edges_csv(edges: DataFrame, kinds: DataFrame, path: str) -> None:
    edge_list(edges, kinds).write.mode("overwrite").option("header", True).csv(path)


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines (part, document): a row per node and edge, and one of counts."""
    row = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("document"))
    counts = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))  # one row each
    return row(nodes, "node").unionByName(row(edges, "edge")).unionByName(row(counts, "metadata"))


def lineage_inputs(edges: DataFrame) -> DataFrame:
    """(node, inputs): each node's dependencies in order."""
    return edges.groupBy("node").agg(F.array_sort(F.collect_set("dep")).alias("inputs"))


def lineage_events(edges: DataFrame, namespace: str, run: Column | None = None) -> DataFrame:
    """NDJSON rows (value): one COMPLETE event per node, inputs in order. run is uuid() unless given."""
    named = lambda c: F.struct(F.lit(namespace).alias("namespace"), c.cast("string").alias("name"))
    event = F.struct(F.lit("COMPLETE").alias("eventType"), F.struct((run if run is not None else F.uuid()).alias("runId")).alias("run"), F.struct(F.lit(namespace).alias("namespace"), F.col("node").cast("string").alias("name")).alias("job"),
                     F.transform("inputs", named).alias("inputs"), F.array(named(F.col("node"))).alias("outputs"))
    return lineage_inputs(edges).select(F.to_json(event).alias("value"))


#: Classes of native types in a catalogue.
TYPE_CLASSES = {"NUMBER": ("BYTEINT", "SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE"), "STRING": ("CHAR", "VARCHAR", "CLOB"), "DATE": ("DATE",), "TIME": ("TIMESTAMP", "TIME")}


def type_class(native: Column) -> Column:
    base = F.upper(F.regexp_extract(native, r"^\s*(\w+)", 1))
    return F.coalesce(*[F.when(base.isin(*v), F.lit(k)) for k, v in TYPE_CLASSES.items()], F.lit("OTHER"))


def catalog_proposals(assets: DataFrame, columns: DataFrame, lineage: DataFrame, product: str, layout: str = "aspects") -> DataFrame:
    """(asset, document) of assets(asset, subtype), columns(asset, pos, name, type), lineage(asset, upstream), in one of three layouts."""
    fields = columns.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", type_class(F.col("type")).alias("class")))).alias("fields"))
    up = lineage.groupBy("asset").agg(F.array_sort(F.collect_set("upstream")).alias("upstreams"))
    full = assets.join(fields, "asset", "left").join(up, "asset", "left").withColumn("product", F.lit(product))
    if layout == "aspects":
        aspects = F.array(F.struct(F.lit("properties").alias("aspect"), F.to_json(F.struct("asset", "subtype", "product")).alias("value")), F.struct(F.lit("schema").alias("aspect"), F.to_json(F.struct("fields")).alias("value")), F.struct(F.lit("upstream").alias("aspect"), F.to_json(F.struct("upstreams")).alias("value")))
        return full.select("asset", F.explode(aspects).alias("a")).select("asset", F.to_json("a").alias("document"))
    if layout == "nested":
        return full.select("asset", F.to_json(F.struct("product", "asset", "subtype", "fields", "upstreams")).alias("document"))
    if layout == "flat":
        return full.select("asset", "subtype", F.explode_outer("fields").alias("f")).select("asset", F.to_json(F.struct("asset", "subtype", "f.name", "f.type", "f.class")).alias("document"))
    raise ValueError(f"unknown layout {layout}")


def product_proposals(assets: DataFrame, product: str, **properties: str) -> DataFrame:
    """(entity, aspect, document): the product's own properties, and its assets(asset) as a row each, since there may be any number."""
    spark = assets.sparkSession
    own = spark.range(1).select(F.to_json(F.struct(F.lit(product).alias("product"), *[F.lit(v).alias(k) for k, v in properties.items()])).alias("document"))
    members = assets.select("asset").distinct().select(F.to_json(F.struct(F.lit(product).alias("product"), F.col("asset").cast("string").alias("asset"))).alias("document"))
    rows = own.select(F.lit("properties").alias("aspect"), "document").unionByName(members.select(F.lit("member").alias("aspect"), "document"))
    return rows.select(F.lit(product).alias("entity"), "aspect", "document")


def audit_records(results: DataFrame, run: str, ts: str = "ts", outcome: str = "outcome", done: str = "COMPLETED", failed: str = "FAILED") -> DataFrame:
    """One record a run from its objects' results: event, run, timestamp (the last), outcome, objects_deployed, objects_failed, duration_seconds."""
    of = lambda x: F.count_if(F.col(outcome) == x)
    seconds = F.timestamp_diff("SECOND", F.min(ts), F.max(ts))
    runs = results.groupBy(run).agg(F.max(ts).alias("timestamp"), of(done).alias("objects_deployed"), of(failed).alias("objects_failed"), seconds.alias("duration_seconds"))
    verdict = F.when(F.col("objects_failed") > 0, "failed").otherwise("success")
    return runs.select(F.lit("deploy").alias("event"), run, "timestamp", verdict.alias("outcome"), "objects_deployed", "objects_failed", "duration_seconds")


def append_audit(df: DataFrame, path: str) -> None:
    """Appends the rows as JSON lines."""
    df.write.mode("append").json(path)

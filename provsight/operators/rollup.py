"""Roll-ups: capacity, grants, findings, trust, census, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import cut, numbered
from ..functions.text import mask_noise


def _list(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def parse_bytes(text: Column) -> Column:
    """Bytes of 10, 10K, 1.5M, 2G or 1e9; null when there is no number."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?(?:[eE][0-9]+)?)\s*([kKmMgG]?)", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?(?:[eE][0-9]+)?)\s*([kKmMgG]?)", 2))
    return (F.nullif(number, F.lit("")).cast("double") * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)).cast("long")


def footprint(df: DataFrame, parents: list[str], size: str) -> DataFrame:
    """Bytes by every level of parents and in all; unresolved sizes (null) are counted apart."""
    return df.rollup(*parents).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.count_if(F.col(size).isNull()).alias("n_unresolved"))


def headroom(decls: DataFrame, roots: list[int]) -> DataFrame:
    """For each named parent: declared minus the sum of its direct children, and a status. Known roots are left out."""
    children = decls.groupBy(F.col("parent").alias("node")).agg(F.sum("bytes").alias("children_bytes"), F.count("*").alias("n_children"))
    own = decls.select("node", F.col("bytes").alias("declared"), F.lit(True).alias("known"))
    joined = children.where(~F.col("node").isin(*roots)).join(own, "node", "left")
    left = F.col("declared") - F.col("children_bytes")
    status = F.when(F.col("known").isNull(), "EXTERNAL").when(left.isNull(), "UNKNOWN").when(left < 0, "INSUFFICIENT").otherwise("OK")
    return joined.select("node", "declared", "children_bytes", "n_children", left.alias("headroom"), status.alias("status"))


def capacity(decls: DataFrame, objects: DataFrame, warn: float = 0.2) -> DataFrame:
    """decls(container, kind CREATE or MODIFY, seq, bytes) against objects(container, floor).

    The last MODIFY overrides the last CREATE. No object that takes space: OK; no declaration: UNKNOWN.
    """
    last = decls.groupBy("container").agg(F.max_by("bytes", F.when(F.col("kind") == "CREATE", F.col("seq"))).alias("c"), F.max_by("bytes", F.when(F.col("kind") == "MODIFY", F.col("seq"))).alias("m"))
    need = objects.groupBy("container").agg(F.sum("floor").alias("need"))
    both = last.select("container", F.coalesce("m", "c").alias("bytes")).join(need, "container", "full")
    status = F.when(F.coalesce("need", F.lit(0)) == 0, "OK").when(F.col("bytes").isNull(), "UNKNOWN").when(F.col("bytes") < F.col("need"), "INSUFFICIENT").when((F.col("bytes") - F.col("need")) * 100 < F.col("bytes") * int(warn * 100), "WARNING").otherwise("OK")
    return both.withColumn("status", status)


def free_space(usage: DataFrame, key: str, allowed: str, used: str, warn_pct: int = 20) -> DataFrame:
    """Free space by key; nothing allowed is an error. Sums are of exact numbers."""
    sums = usage.groupBy(key).agg(F.sum(allowed).alias("allowed"), F.sum(used).alias("used"))
    free = F.col("allowed") - F.col("used")
    status = F.when(F.col("allowed") == 0, "ERROR").when(free * 100 < F.col("allowed") * warn_pct, "WARNING").otherwise("OK")
    return sums.select(key, "allowed", "used", free.alias("free"), status.alias("status"))


def infer_grants(intents: DataFrame, view_bases: DataFrame) -> DataFrame:
    """(grantee, grantor, privileges): owners need their privileges on every other database they touch, and, through a view, on its bases."""
    direct = intents.select(F.col("owner_db").alias("grantee"), F.col("ref_db").alias("grantor"), "privilege")
    through = intents.join(view_bases, (intents["ref_db"] == view_bases["view_db"]) & (intents["ref_name"] == view_bases["view_name"])).select(F.col("owner_db").alias("grantee"), F.col("base_db").alias("grantor"), "privilege")
    need = direct.unionByName(through).where("grantee != grantor AND grantee IS NOT NULL")
    return need.groupBy("grantee", "grantor").agg(_list(F.collect_set("privilege")).alias("privileges"))


def merge_grants(grants: DataFrame, keys: list[str], privilege: str = "privilege") -> DataFrame:
    return grants.groupBy(*keys).agg(_list(F.collect_set(privilege)).alias("privileges"))


#: One form for both kinds of statement: without ON it is a role that is granted.
_DCL = r"(?i)^\s*(GRANT|REVOKE)\s+(.+?)\s+(?:ON\s+(?:(?:TABLE|VIEW|MACRO|(?:EXTERNAL\s+)?PROCEDURE|FUNCTION|DATABASE|USER|ROLE|PROFILE)\s+)?(\S+)\s+)?(?:TO|FROM)\s+(\S+?)(\s+WITH\s+(?:GRANT|ADMIN)\s+OPTION)?[\s;]*$"


def parse_grants(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, action, privileges (array, upper case; null for roles), role, on_object, grantee, option) of statements that grant or revoke."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract("__plain", _DCL, k)), F.lit(""))
    found = df.withColumn("__plain", mask_noise(F.col(text))).where(F.col("__plain").rlike(_DCL))
    rows = found.select(key, F.upper(part(1)).alias("action"), part(2).alias("__what"), part(3).alias("on_object"), part(4).alias("grantee"), part(5).isNotNull().alias("option"))
    on = F.col("on_object").isNotNull()
    several = F.filter(F.transform(F.split("__what", ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return rows.select(key, "action", F.when(on, several).alias("privileges"), F.when(~on, F.col("__what")).alias("role"), "on_object", "grantee", "option")


def merge_statements(grants: DataFrame) -> DataFrame:
    """(place, action, what, on_object, grantee, option) of parse_grants' rows: statements that differ in privileges alone become one.

    Privileges are united and sorted; roles stay a row each, without repeats, and come after; place is the order in which all are given out.
    """
    keys = ["action", "on_object", "grantee", "option"]
    merged = grants.where("role IS NULL").select(*keys, F.explode("privileges").alias("p")).groupBy(*keys).agg(_list(F.collect_set("p")).alias("what")).withColumn("late", F.lit(0))
    roles = grants.where("role IS NOT NULL").select(*keys, F.col("role").alias("what"), F.lit(1).alias("late")).distinct()
    placed = numbered(merged.unionByName(roles), ["late", "action", "on_object", "grantee", "option", "what"], "place")
    return placed.select("place", "action", "what", "on_object", "grantee", "option")


def cross_module_reads(refs: DataFrame, reader: str, read: str, modules: DataFrame | None = None) -> DataFrame:
    """(reader, reads): the other namespaces that each reads; with modules(namespace, module), those of its own module are left out too."""
    found = refs.where(F.col(reader) != F.col(read)).select(reader, read).distinct()
    if modules is not None:
        of = lambda side: modules.select(F.col("namespace").alias(side), F.col("module").alias(f"__{side}"))
        found = found.join(of(reader), reader, "left").join(of(read), read, "left").where(f"NOT coalesce(`__{reader}` = `__{read}`, false)")
    return found.groupBy(reader).agg(_list(F.collect_set(read)).alias("reads"))


def name_roots(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    """(pos, root, n, share, confidence): the most common segment at each position; ties go to the smaller segment."""
    total = df.agg(F.count(col).alias("total"))
    counts = df.select(F.posexplode(F.split(col, sep)).alias("pos", "root")).groupBy("pos", "root").agg(F.count("*").alias("n"))
    best = counts.groupBy("pos").agg(F.min_by("root", F.struct((-F.col("n")).alias("m"), F.col("root"))).alias("root"), F.max("n").alias("n"))
    joined = best.crossJoin(F.broadcast(total))  # one row
    confidence = F.when(F.col("n") * 10 >= F.col("total") * 9, "HIGH").when(F.col("n") * 10 >= F.col("total") * 6, "MEDIUM").otherwise("LOW")
    return joined.select("pos", "root", "n", "total", confidence.alias("confidence"))


def decompose(df: DataFrame, col: str, pattern: str, parts: list[str]) -> DataFrame:
    """Adds the parts of names that match, and outlier."""
    return df.withColumns({p: F.nullif(F.regexp_extract(col, pattern, k), F.lit("")) for k, p in enumerate(parts, 1)} | {"outlier": ~F.col(col).rlike(pattern)})


def name_collisions(df: DataFrame, literal: str, token: Column) -> DataFrame:
    """(token, n, literals) of tokens that more than one literal gives."""
    return df.select(token.alias("token"), literal).distinct().groupBy("token").agg(F.count("*").alias("n"), _list(F.collect_set(literal)).alias("literals")).where("n > 1")


def token_candidates(refs: DataFrame, literal: str, path: str, env_prefix: str, system: list[str]) -> DataFrame:
    """(literal, token, n_files, first_file) of qualifiers that are neither system names nor tokens."""
    rows = refs.where(~F.upper(literal).isin(*system) & ~F.col(literal).startswith("{{"))
    rest = F.expr(f"substring({literal}, {len(env_prefix) + 1})")
    token = F.when(F.upper(literal).startswith(env_prefix.upper()) & (F.length(rest) > 0), rest).otherwise(F.col(literal))
    return rows.select(literal, path).distinct().groupBy(literal).agg(F.count("*").alias("n_files"), F.min(path).alias("first_file")).withColumn("token", token)


def candidate_files(refs: DataFrame, literal: str, path: str, system: list[str]) -> DataFrame:
    """(literal, path): the files of each candidate, as rows, so that a frequent one needs no list in a single row."""
    return refs.where(~F.upper(literal).isin(*system) & ~F.col(literal).startswith("{{")).select(literal, path).distinct()


def placeholder_census(hits: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(variable, n, syntaxes, samples): the k smallest locations come from a bounded set, ranked before they are gathered."""
    sums = hits.groupBy("variable").agg(F.sum("n").alias("n"), _list(F.collect_set("syntax")).alias("syntaxes"))
    located = hits.groupBy("variable", key).agg(F.count("*").alias("c"))
    ranked = located.withColumn("__rn", F.row_number().over(W.partitionBy("variable").orderBy(key))).where(F.col("__rn") <= k)
    samples = ranked.groupBy("variable").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("samples"))
    return sums.join(samples, "variable")


_RANK = {"error": 2, "warning": 1}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def trust_status(issues: DataFrame, group: str, signal: str, expected: DataFrame) -> DataFrame:
    """(group, signals failed, warned, unknown, status): expected(group, signal) says which signals there are."""
    worst = issues.groupBy(group, signal).agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    all_signals = expected.join(worst, [group, signal], "left")
    state = F.when(F.col("worst").isNull(), "unknown").when(F.col("worst") == 2, "fail").when(F.col("worst") == 1, "warn").otherwise("pass")
    counts = all_signals.withColumn("state", state).groupBy(group).agg(F.count_if(F.col("state") == "fail").alias("n_fail"), F.count_if(F.col("state") == "warn").alias("n_warn"), F.count_if(F.col("state") == "unknown").alias("n_unknown"))
    status = F.when(F.col("n_fail") > 0, "BLOCKED").when(F.col("n_warn") + F.col("n_unknown") > 0, "READY_WITH_CAVEATS").otherwise("READY")
    return counts.withColumn("status", status)


def run_status(runs: DataFrame, stages: DataFrame, key: str, status: str) -> DataFrame:
    """(key, status): failed with any error, warning with any warning, else success, also without stages."""
    worst = runs.select(key).distinct().join(stages.groupBy(key).agg(F.max(severity_rank(F.col(status))).alias("worst")), key, "left")
    return worst.select(key, F.when(F.col("worst") == 2, "failed").when(F.col("worst") == 1, "warning").otherwise("success").alias("status"))


def highest_state(stages: DataFrame, key: str, state: str, ranks: list[str], bad: Column) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col(state) == s, F.lit(i)) for i, s in enumerate(ranks)], F.lit(-1))
    return stages.where(~bad).groupBy(key).agg(F.max_by(state, rank).alias("highest"))


def state_summary(df: DataFrame, state: str = "state") -> DataFrame:
    return df.groupBy(state).agg(F.count("*").alias("n"))


def wave_summary(df: DataFrame, wave: str = "wave", state: str = "state", ts: str = "ts") -> DataFrame:
    """(wave, total, completed, failed, skipped, pending, seconds from the first row to the last)."""
    of = lambda s: F.count_if(F.col(state) == s)
    seconds = F.timestamp_diff("SECOND", F.min(ts), F.max(ts))
    return df.groupBy(wave).agg(F.count("*").alias("total"), of("COMPLETED").alias("completed"), of("FAILED").alias("failed"), of("SKIPPED").alias("skipped"), of("PENDING").alias("pending"), seconds.alias("seconds"))


def wave_kinds(df: DataFrame, wave: str = "wave", kind: str = "kind") -> DataFrame:
    """(wave, kind, n): how many objects of each kind a wave has."""
    return df.groupBy(wave, kind).agg(F.count("*").alias("n"))


def tag_usage(log: DataFrame, tag: str = "tag", build: str | None = None, package: str | None = None, user: str = "user_id") -> DataFrame:
    """(day, user, build, env, wave, n): statements by these, of K=V; tags of one build and one package where they are given."""
    parsed = log.withColumn("t", F.str_to_map(F.rtrim(F.col(tag), F.lit(";")), F.lit(";"), F.lit("=")))
    of = lambda key: F.try_element_at("t", F.lit(key))
    for key, value in (("BUILD", build), ("PKG", package)):
        parsed = parsed if value is None else parsed.where(of(key) == value)
    return parsed.groupBy(F.col("ts").cast("date").alias("day"), F.col(user).alias("user"), of("BUILD").alias("build"), of("ENV").alias("env"), of("WAVE").alias("wave")).agg(F.count("*").alias("n"))


def write_tag(**fields: Column) -> Column:
    """K=V;K=V; of the fields in the order given."""
    return F.concat(*[F.concat(F.lit(k + "="), c.cast("string"), F.lit(";")) for k, c in fields.items()])


def fingerprint(df: DataFrame, group: str, key: str, content: str) -> DataFrame:
    """(group, n, fingerprint): sha256 of the sorted `key:sha256` lines, whatever the partitioning. A group's lines must
    fit a row; tree_fingerprint has no such bound."""
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(content, 256), F.lit("\n"))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("fingerprint"))


def bucketed_fingerprint(df: DataFrame, group: str, key: str, content: str, buckets: int = 256) -> DataFrame:
    """As fingerprint, by buckets of the key's hash first: another value, and groups may be so many times as large; tree_fingerprint has no bound."""
    b = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(content, 256), F.lit("\n"))
    inner = b.groupBy(group, "__b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))
    return inner.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "h"))), lambda s: s["h"]), ""), 256).alias("fingerprint"))


def tree_fingerprint(df: DataFrame, group: str, key: str, content: str, width: int = 4096) -> DataFrame:
    """(group, n, fingerprint): a tree of digests over the group's `key:sha256` lines in their order.

    Lines are numbered by ranges (no task holds a group) and `width` of them in a row make a digest; digests make digests in
    turn until a group has one, which is kept as it is while larger groups go on. No row is longer than `width` digests.
    """
    line = F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(content, 256), F.lit("\n"))
    nodes = numbered(df.select(F.col(group).alias("g"), line.alias("h")), ["h"], "at", ("g",)).withColumn("n", F.lit(1).cast("long"))
    open_ = True
    while open_:
        wide = nodes.groupBy("g", F.expr(f"(at - 1) div {width} + 1").alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "h"))).alias("hs"))
        joined = F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), ""), 256)
        # a lone digest is a finished group; a lone line is not one yet
        alone = (F.col("parts") == 1) & (F.col("at") == 1) & (F.length(F.col("hs")[0]["h"]) == 64)
        nodes = cut(wide.select("g", "at", "n", F.when(alone, F.col("hs")[0]["h"]).otherwise(joined).alias("h")))
        open_ = not nodes.where("at > 1").isEmpty()
    return nodes.select(F.col("g").alias(group), "n", F.col("h").alias("fingerprint"))


def verify_fingerprints(expected: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of items that changed, are missing or unexpected."""
    e, a = expected.select(key, F.col(digest).alias("e")), actual.select(key, F.col(digest).alias("a"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return e.join(a, key, "full").select(key, status.alias("status")).where("status IS NOT NULL")


def token_roles(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(token, role) from uses(token, position identity, scalar or label) and defs(token)."""
    seen = uses.groupBy("token").agg(F.bool_or(F.col("position") == "identity").alias("i"), F.bool_or(F.col("position") == "scalar").alias("s"))
    both = seen.join(defs.select("token").distinct().withColumn("d", F.lit(True)), "token", "full")
    role = F.when(F.col("d").isNull(), "unknown").when(F.col("i").isNull(), "unused").when(F.col("i") & F.col("s"), "mixed").when(F.col("i"), "identity").when(F.col("s"), "scalar").otherwise("label")
    return both.select("token", role.alias("role"))


def release_inventory(builds: DataFrame, trust: DataFrame, approvals: DataFrame, key: str) -> DataFrame:
    """builds with trust status and approval (approved, rejected, awaiting); unreadable builds (null build) are left out."""
    approval = F.when(F.col("approved"), "approved").when(~F.col("approved"), "rejected").otherwise("awaiting")
    joined = builds.where("build IS NOT NULL").join(trust, key, "left").join(approvals, key, "left")
    return joined.withColumn("approval", approval).drop("approved").withColumn("status", F.coalesce("status", F.lit("unknown")))

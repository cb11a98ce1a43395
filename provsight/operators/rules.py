"""Rules over a corpus of statements, and data-quality checks over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import spread
from ..functions.text import NAME, QUALIFIED, SYSTEM, TOKEN, classify, extract_owner, mask_noise


def apply_policy(corpus: DataFrame, rules: list[dict], key: str = "path", text: str = "text", kind: str = "kind", phase: str = "phase", strict: bool = False) -> DataFrame:
    """(key, rule, severity) of the rules that fire: deny (a match fires), required (absence fires), exclude (a match suppresses).

    A rule: id, mode, pattern, severity, and scopes types and phases (empty: all; a null type is in no scope). OFF never
    fires. A rule without id, pattern or a known mode raises when strict and is left out otherwise.
    """
    good = []
    for rule in rules:
        if rule.get("mode") not in ("deny", "required", "exclude") or not rule.get("id") or not rule.get("pattern"):
            if strict:
                raise ValueError(f"bad rule {rule}")
            continue
        if rule.get("severity") != "OFF":
            good.append(rule)

    def holds(rule: dict) -> Column:
        types, phases = rule.get("types") or [], rule.get("phases") or []
        scope = (F.col(kind).isin(*types) if types else F.lit(True)) & (F.col(phase).isin(*phases) if phases else F.lit(True))
        return F.coalesce(scope, F.lit(False))

    hit = lambda r: F.coalesce(F.col(text).rlike(r["pattern"]), F.lit(False))
    excluded = reduce(lambda p, q: p | q, [holds(r) & hit(r) for r in good if r["mode"] == "exclude"], F.lit(False))
    fired = [F.when(holds(r) & (hit(r) if r["mode"] == "deny" else ~hit(r)), F.struct(F.lit(r["id"]).alias("rule"), F.lit(r.get("severity", "WARNING")).alias("severity"))) for r in good if r["mode"] != "exclude"]
    if not fired:
        return corpus.select(key, F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)
    return corpus.where(~excluded).select(key, F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


_DDL = r"(?:CREATE|REPLACE|ALTER|DROP|COMMENT|GRANT|REVOKE|RENAME|COLLECT)"
_EXEMPT = ("DATABASE", "USER", "ROLE", "GRANT", "DML", "UNKNOWN")


def builtin_rules(text: Column, masked: Column, kind: Column, extension: Column, file_name: Column) -> dict[str, tuple[str, Column]]:
    """The row rules by id: (default severity, condition). masked is the text without noise; head is what stands before the first body."""
    head = F.element_at(F.split(masked, r"(?i)\bBEGIN\b(?!\s+TRANSACTION)"), 1)
    is_ = lambda c, p: c.rlike("(?i)" + p)
    qualified = is_(head, rf"^\s*(?:CREATE|REPLACE)\s+(?:\w+\s+)*?(?:VIEW|TABLE|MACRO|PROCEDURE|FUNCTION|TRIGGER|INDEX)\s+{QUALIFIED}")
    volatile = is_(head, r"^\s*CREATE\s+(?:\w+\s+)?VOLATILE\b")
    named = ~kind.isin(*_EXEMPT, "DROP", "COMMENT", "STATISTICS") & ~volatile
    token = text.rlike(TOKEN)
    words = lambda p: F.regexp_count(masked, F.lit(p))
    keywords = r"\b(?:SELECT|FROM|WHERE|CREATE|TABLE|VIEW|INSERT|INTO|UPDATE|DELETE|JOIN|ON|AND|OR|AS|SET|GROUP|ORDER|BY|REPLACE|DROP|NOT|NULL)\b"
    name = F.regexp_extract(masked, rf"(?i)^\s*(?:CREATE|REPLACE)\s+(?:\w+\s+)*?(?:VIEW|TABLE|MACRO|PROCEDURE|FUNCTION|TRIGGER|INDEX)\s+(?:{NAME}\.)?({NAME})", 1)
    own_db = F.regexp_extract(masked, rf"(?i)^\s*(?:CREATE|REPLACE)\s+(?:\w+\s+)*?(?:VIEW|TABLE|INDEX|TRIGGER)\s+({NAME})\.", 1)
    body_alter = F.regexp_extract(head, r"(?is)\bALTER\s+TABLE\s+\S+(.*)", 1)
    wanted = F.when(kind == "TABLE", "tbl").when(kind == "VIEW", "viw").when(kind == "MACRO", "mac").when(kind == "PROCEDURE", "spl").when(kind == "GRANT", "grt").when(kind == "DATABASE", "db").when(kind == "COMMENT", "cmt")
    leading, trailing = is_(masked, r"(?m)^\s*,"), is_(masked, r"(?m),[ \t]*$")
    return {
        "destructive_change": ("ERROR", is_(head, r"(?m)^\s*(?:DROP\s+\w+|DELETE\s+DATABASE|ALTER\s+TABLE\s+\S+\s+DROP)\b")),
        "data_dependent_change": ("WARNING", (is_(body_alter, r"\bNOT\s+NULL\b") & ~is_(body_alter, r"\bDEFAULT\b")) | is_(body_alter, r"\bUNIQUE\b|\bCHECK\s*\(|\bINDEX\b|\bPARTITION\b") | is_(head, r"\bCREATE\s+UNIQUE\s+INDEX\b")),
        "expensive_change": ("WARNING", is_(body_alter, r"\bADD\b.*\bDEFAULT\b") | is_(head, r"\bCREATE\s+INDEX\b")),
        "transaction_control": ("ERROR", is_(head, r"(?m)^\s*(?:BT\s*;|ET\s*;|(?:BEGIN|END)\s+TRANSACTION\b|COMMIT\b|ROLLBACK\b)")),
        "db_qualifier": ("ERROR", named & ~qualified),
        "set_multiset": ("WARNING", is_(masked, r"(?:^|;)\s*CREATE\s+(?!(?:\w+\s+)*?(?:SET|MULTISET)\b)(?:\w+\s+)*?TABLE\b") & (kind != "GRANT")),
        "ddl_terminator": ("WARNING", is_(masked, rf"(?m)^\s*{_DDL}\b[^;]*(?:\z|^\s*{_DDL}\b)")),
        "filename_token_format": ("ERROR", F.regexp_replace(file_name, TOKEN, "").rlike(r"\{\{|\}\}")),
        "object_level_grant": ("WARNING", (kind == "GRANT") & is_(masked, rf"\bGRANT\s+\w+\s*\(|\bON\s+{NAME}\.{NAME}")),
        "extension": ("WARNING", F.coalesce(extension != wanted, F.lit(False))),
        "type_suffix": ("INFO", name.rlike(r"(?i)_(?:TBL|VIEW|VW|TAB|PROC|MAC|IDX)$")),
        "token_naming": ("WARNING", (kind.isin("TABLE", "INDEX", "TRIGGER") & own_db.rlike(r"_V\}\}$")) | ((kind == "VIEW") & own_db.rlike(r"_T\}\}$"))),
        "hardcoded_name": ("ERROR", named & qualified & ~token & ~F.upper(own_db).isin(*SYSTEM)),
        "zero_tokens": ("WARNING", named & ~qualified & ~token),
        "keyword_case": ("INFO", (words("(?i)" + keywords) > 5) & (words(keywords.lower()) * 10 > words("(?i)" + keywords) * 3)),
        "comma_style": ("INFO", trailing & ~leading),
        "view_column_list": ("WARNING", (kind == "VIEW") & ~is_(masked, rf"^\s*(?:CREATE|REPLACE)\s+(?:RECURSIVE\s+)?VIEW\s+(?:{NAME}\.)?{NAME}\s*\(")),
        "comment_length": ("ERROR", (kind == "COMMENT") & (F.length(F.regexp_extract(text, r"(?is)\b(?:AS|IS)\s+'((?:[^']|'')*)'", 1)) > 254)),
    }


def inspect(corpus: DataFrame, key: str, text: str = "body", extension: str | None = None, file_name: str | None = None, severities: dict[str, str] | None = None) -> DataFrame:
    """(key, rule, severity) of the built-in rules in one pass; severities override the defaults, OFF silences."""
    none = F.lit(None).cast("string")
    kinds = spread(corpus).withColumn("__plain", mask_noise(F.col(text))).withColumn("__kind", classify(F.col("__plain")))  # columns, so that they are computed once
    rules = builtin_rules(F.col(text), F.col("__plain"), F.col("__kind"), F.col(extension) if extension else none, F.col(file_name) if file_name else F.lit(""))
    chosen = {r: ((severities or {}).get(r, s), c) for r, (s, c) in rules.items()}
    fired = [F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, (s, c) in chosen.items() if s != "OFF"]
    return kinds.select(key, F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull())).alias("f")).select(key, "f.*")


def config_findings(kv: DataFrame) -> DataFrame:
    """(env, name, finding) of key=value rows: merged lines, invalid characters, unresolved tokens, lower-case keys."""
    found = F.array(F.when(F.col("value").rlike(r"\s[A-Z][A-Z0-9_]+=\S"), "merged_lines"), F.when(F.col("value").rlike(r"[\x00-\x08\x0B-\x1F]"), "invalid_characters"),
                    F.when(F.col("value").rlike(r"\{\{|\}\}"), "unresolved_token"), F.when(F.col("name") != F.upper("name"), "key_case"))
    return kv.select("env", "name", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def self_reference(corpus: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Rows whose owner is among their own references(key, ref_db, ref_name), in any case."""
    owned = corpus.where("owner_db IS NOT NULL").select(key, F.upper("owner_db").alias("d"), F.upper("owner_name").alias("n"))
    r = refs.select(key, F.upper("ref_db").alias("d"), F.upper("ref_name").alias("n"))
    return owned.join(r, [key, "d", "n"], "left_semi").select(key)


def intra_package(objects: DataFrame, created: DataFrame) -> DataFrame:
    """Objects in a database that the same package creates."""
    return objects.join(created.select(F.upper("db").alias("__d")).distinct(), F.upper("owner_db") == F.col("__d"), "left_semi")


def one_object(corpus: DataFrame, key: str, text: str = "body") -> DataFrame:
    """(key, n) of rows with more than one top-level DDL or DCL verb."""
    n = F.regexp_count(mask_noise(F.col(text)), F.lit(rf"(?im)(?:^|;)\s*{_DDL}\b"))
    return corpus.select(key, n.cast("long").alias("n")).where("n > 1")


def eponymous(corpus: DataFrame, key: str, file_name: str, text: str = "body") -> DataFrame:
    """(key, declared, file) where the file is not named after the object it declares."""
    named = extract_owner(corpus, text).where("owner_name IS NOT NULL")
    stem = F.regexp_replace(F.col(file_name), r"\.[^.]*$", "")
    declared = F.concat_ws(".", "owner_db", "owner_name")
    return named.where(F.upper(stem) != F.upper(declared)).select(key, declared.alias("declared"), stem.alias("file"))


def placement_findings(refs: DataFrame, namespaces: DataFrame, colocated: bool = False) -> DataFrame:
    """Views' refs(…, kind, ref_db) that read a tables namespace; namespaces(db, role tables or views)."""
    if colocated:
        return refs.limit(0)
    tables = namespaces.where("role = 'tables'").select(F.upper("db").alias("__d"))
    return refs.where("kind = 'VIEW'").join(tables, F.upper("ref_db") == F.col("__d"), "left_semi")


def grant_placement(grants: DataFrame, namespaces: DataFrame, colocated: bool = False) -> DataFrame:
    """grants(on_object, grantee) with finding public_grant (PUBLIC on a tables namespace) or unmapped_grant."""
    if colocated:
        return grants.withColumn("finding", F.lit("")).limit(0)
    joined = grants.join(namespaces.select(F.upper("db").alias("__d"), "role"), F.upper(F.element_at(F.split("on_object", r"\."), 1)) == F.col("__d"), "left")
    public = F.col("grantee").rlike(r"(?i)\bPUBLIC\b") & (F.col("role") == "tables")
    unmapped = F.col("role").isNull() & ~F.upper(F.element_at(F.split("on_object", r"\."), 1)).isin(*SYSTEM)
    return joined.withColumn("finding", F.when(public, "public_grant").when(unmapped, "unmapped_grant")).where("finding IS NOT NULL").drop("__d", "role")


LABELS = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")


def sensitivity(objects: DataFrame, labels: DataFrame, key: str, allowed: tuple = LABELS, required: str | None = None) -> DataFrame:
    """(key, label, level): an invalid label is an error; a missing one has the level `required`, if that is given."""
    joined = objects.select(key).join(labels.select(key, "label"), key, "left")
    level = F.when(F.col("label").isNull(), F.lit(required or "ok")).when(~F.col("label").isin(*allowed), "error").otherwise("ok")
    return joined.withColumn("level", level)


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null) in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.*")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_predicate(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that violate it; an unknown outcome is none."""
    return df.where(~predicate)


def quality_metrics(df: DataFrame, spec: list[tuple[str, str, Column, float]]) -> DataFrame:
    """(column, metric, bad, sample_size, threshold_pct, met) from (column, metric, bad-row condition, most bad in percent)."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(c).alias(f"m{k}") for k, (_, _, c, _) in enumerate(spec)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(f"m{k}").alias("bad"), F.col("__n").alias("sample_size"), F.lit(int(t)).alias("threshold_pct"), (F.col(f"m{k}") * 100 <= F.col("__n") * int(t)).alias("met")) for k, (c, m, _, t) in enumerate(spec)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def metric_rows(df: DataFrame, db: str, table: str, spec: list[tuple[str, str, Column, float]]) -> DataFrame:
    """quality_metrics as rows of a metric table: db, table, column, metric, value and threshold (shares of bad rows), met, sample_size."""
    made = quality_metrics(df, spec)
    value = F.when(F.col("sample_size") > 0, F.col("bad") / F.col("sample_size")).cast("decimal(10,4)")
    return made.select(F.lit(db).alias("db"), F.lit(table).alias("table"), "column", "metric", value.alias("value"), (F.col("threshold_pct") / 100).cast("decimal(5,4)").alias("threshold"), "met", "sample_size")

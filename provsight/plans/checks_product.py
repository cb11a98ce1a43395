"""Queries of the product patterns."""

from pyspark.sql import functions as F

from ..operators import product as P
from .registry import query


@query("SELECT k, version_id, o_orderstatus, valid_from FROM <hist> WHERE is_current = 1 AND is_deleted = 0")
def current_orders(t):
    return P.current_rows(t("hist")).select("k", "version_id", "o_orderstatus", "valid_from")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def view_layer_nation(t):
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    return P.publish_views(nation.sparkSession, {"nation": nation}, "bus_v")["nation"]


@query("SELECT p_partkey, 'DWH_' || regexp_extract(p_brand, '#(\\d+)$', 1) || '_V' AS views_db, CASE p_size % 3 WHEN 0 THEN 'A_V' WHEN 1 THEN 'B_V' END AS mapped_db FROM part")
def ns_map(t):
    part = t("part").withColumn("tables_db", F.concat(F.lit("DWH_"), F.regexp_extract("p_brand", r"#(\d+)$", 1), F.lit("_T")))
    size = (F.col("p_size") % 3).cast("string")
    return part.select("p_partkey", P.map_namespace(F.col("tables_db"), "separated", "_T$", "_V").alias("views_db"), P.map_namespace(size, "mapped", pairs={"0": "A_V", "1": "B_V"}).alias("mapped_db"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'set by hand' WHEN o_orderkey % 3 = 0 THEN 'curated ' || o_orderkey
    ELSE CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END END AS description,
    CASE WHEN o_orderkey % 7 = 0 THEN 'override' WHEN o_orderkey % 3 = 0 THEN 'curated' ELSE 'dictionary' END AS origin FROM orders""")
def column_catalog(t):
    orders = t("orders").select("o_orderkey", P.decode(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, F.lit("partial")).alias("description"))
    curated = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" curated "), "o_orderkey", F.lit(" "))).otherwise(" ").alias("description"), F.lit(1).alias("is_active"))
    override = t("orders").select("o_orderkey", F.lit("set by hand").alias("description"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0).alias("is_active"))
    return P.column_catalog(orders, curated, override, ["o_orderkey"])


@query("""SELECT s_suppkey, to_json({'id': s_suppkey, 'name': trim(s_name), 'note': CASE WHEN s_suppkey % 2 = 0 THEN 'a "b" \\ c' END}) AS manifest FROM supplier""".replace("\\\\", "\\"))
def manifest_json(t):
    note = F.when(F.col("s_suppkey") % 2 == 0, F.lit('a "b" \\ c'))
    return P.manifest_json(t("supplier"), {"id": F.col("s_suppkey"), "name": F.trim("s_name"), "note": note}).select("s_suppkey", "manifest")


@query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'API_KEY' WHEN 1 THEN 'host' WHEN 2 THEN 'db_credentials' ELSE event_type END AS name,
    CASE event_id % 5 WHEN 0 THEN ' $env:KEY' WHEN 1 THEN '' WHEN 2 THEN 'vault:a/b' ELSE event_type END AS raw FROM events)
  SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN 'secret-ref' WHEN event_id % 4 IN (0, 2) THEN 'sensitive' ELSE 'plain' END AS class,
    CASE WHEN event_id % 5 IN (0, 2) THEN '«secret ref»' WHEN event_id % 4 IN (0, 2) THEN '«masked»' WHEN raw = '' THEN '«empty»' ELSE raw END AS display FROM r""")
def redact_props(t):
    e = t("events")
    of = lambda n, *values: F.coalesce(*[F.when(F.col("event_id") % n == k, v) for k, v in enumerate(values) if v is not None], F.col("event_type"))
    kind, shown = P.redact(of(4, "API_KEY", "host", "db_credentials"), of(5, " $env:KEY", "", "vault:a/b"))
    return e.select("event_id", kind.alias("class"), shown.alias("display"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS age_days,
    CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 700 THEN 'WARNING' ELSE 'OK' END AS flag FROM orders""")
def ttl_orders(t):
    return P.ttl_check(t("orders"), "o_orderdate", 700, "1998-08-02").select("o_orderkey", "age_days", "flag")


@query("""SELECT o_orderkey, c_name, n_name, n_lines, qty FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity)::DECIMAL(18, 2) AS qty FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def order_enriched(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").cast("decimal(18,2)").alias("qty"))
    customer = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    out = P.enrich(t("orders"), [(customer, ["o_custkey"])], [(t("nation").select("n_nationkey", "n_name"), ["n_nationkey"]), (lines, ["o_orderkey"])])
    return out.select("o_orderkey", "c_name", "n_name", "n_lines", "qty")


@query("""SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)) x ON o_custkey = c_custkey""")
def latest_order_per_customer(t):
    runs = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return P.latest_join(t("customer").select("c_custkey"), runs, "c_custkey", "o_orderdate").select("c_custkey", "o_orderkey", "o_orderdate")


@query("SELECT k, version_id, o_orderstatus FROM <hist> WHERE valid_from <= TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-06-01' < valid_to")
def orders_as_of(t):
    return P.as_of(t("hist"), F.expr("timestamp_ntz '1995-06-01 00:00:00'")).select("k", "version_id", "o_orderstatus")


@query("""SELECT event_id, h.version_id FROM (SELECT event_id, user_id AS k, TIMESTAMP '1992-01-01' + to_days((event_id % 2500)::INTEGER) AS tm FROM events) e
    LEFT JOIN <hist> h ON h.k = e.k AND valid_from <= tm AND tm < valid_to""")
def event_asof(t):
    e = t("events").select("event_id", F.col("user_id").alias("k"), F.expr("timestamp_ntz '1992-01-01 00:00:00' + make_dt_interval(cast(event_id % 2500 AS int))").alias("at"))
    return P.asof_join(e, t("hist"), "k", "at").select("event_id", "version_id")


@query("""SELECT event_id, h.version_id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 5 ELSE user_id END AS k, TIMESTAMP '1992-01-01' + to_days((event_id % 2500)::INTEGER) AS tm FROM events) e
    LEFT JOIN <hist> h ON h.k = e.k AND valid_from <= tm AND tm < valid_to""")
def event_asof_hot(t):
    """One key has half of all events; ranges of (key, time) spread it."""
    key = F.when(F.col("event_id") % 2 == 0, F.lit(5).cast("long")).otherwise(F.col("user_id"))
    e = t("events").select("event_id", key.alias("k"), F.expr("timestamp_ntz '1992-01-01 00:00:00' + make_dt_interval(cast(event_id % 2500 AS int))").alias("at"))
    return P.asof_fill(e, t("hist"), "k", "at").select("event_id", "version_id")


@query("SELECT k, version_id, valid_from, valid_to FROM <hist> WHERE k IN (SELECT k FROM <hist> WHERE is_current = 1 AND is_deleted = 0)")
def pit_features(t):
    return P.pit_features(t("hist"), P.current_rows(t("hist")), "k").select("k", "version_id", "valid_from", "valid_to")


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0")
def labelled_documents(t):
    return P.attach(t("documents").select("doc_id", "source"), t("labels"), "doc_id", toxic=0).select("doc_id", "source", "quality")


@query("""SELECT n_nationkey, trim(r_name) || '.' || trim(n_name) AS full_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3 AND n_nationkey % 4 <> 0""")
def region_catalog(t):
    modules = t("region").select("r_regionkey", F.col("r_name").alias("module_name"), F.when(F.col("r_regionkey") != 3, 1).otherwise(0).alias("is_active"))
    objects = t("nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey", F.concat(F.lit(" "), "n_name").alias("object_name"), F.lit(1).alias("is_active"), F.when(F.col("n_nationkey") % 4 != 0, " Deployed ").otherwise("draft").alias("status"))
    return P.object_catalog(modules, objects, "r_regionkey").select("n_nationkey", "full_name")


@query("SELECT c_custkey, resource, purpose FROM customer, (VALUES ('catalogue', 'find tables'), ('cookbook', 'ready queries')) v(resource, purpose)")
def orientation(t):
    return P.orientation(t("customer").select("c_custkey"), [("catalogue", "find tables"), ("cookbook", "ready queries")])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)")
def unused_parts(t):
    return P.unreferenced(t("part").select("p_partkey"), t("lineitem").where("l_linenumber = 1"), "p_partkey", "l_partkey")


@query("""SELECT parent, count(*) AS n_children, sum(bytes) AS need, string_agg(node::VARCHAR, ',' ORDER BY node) AS children FROM
    (SELECT p_partkey AS node, floor(p_partkey / 3.0)::BIGINT * 7 AS parent, p_size AS bytes FROM part) WHERE parent NOT IN (SELECT p_partkey FROM part) GROUP BY parent""")
def external_parents(t):
    children = t("part").select(F.col("p_partkey").alias("node"), (F.floor(F.col("p_partkey") / 3) * 7).alias("parent"), F.col("p_size").cast("long").alias("bytes"))
    return P.external_parents(children, children.select("node"), "parent", "node", "bytes")


@query("SELECT floor(p_partkey / 3.0)::BIGINT * 7 AS parent, p_partkey AS node FROM part WHERE floor(p_partkey / 3.0)::BIGINT * 7 NOT IN (SELECT p_partkey FROM part)")
def external_children(t):
    children = t("part").select(F.col("p_partkey").alias("node"), (F.floor(F.col("p_partkey") / 3) * 7).alias("parent"))
    return P.external_children(children, children.select("node"), "parent", "node")


_RIGHTS = """req AS (SELECT DISTINCT 'D' || p_size AS db, unnest(CASE p_partkey % 7 WHEN 0 THEN ['CT', 'DT'] WHEN 1 THEN ['CV', 'DV'] WHEN 2 THEN ['PC', 'PD'] WHEN 3 THEN ['CT', 'DT']
      WHEN 4 THEN ['CE', 'AE'] WHEN 5 THEN ['CG', 'DG'] ELSE [] END) AS right FROM part),
  gr AS (SELECT DISTINCT 'D' || s_suppkey % 50 AS db, CASE s_suppkey % 5 WHEN 0 THEN 'CT' WHEN 1 THEN 'CV' WHEN 2 THEN 'AL' WHEN 3 THEN 'PC' ELSE 'DT' END AS right FROM supplier)"""


def _rights(t):
    kinds = F.array(*map(F.lit, ("TABLE", "VIEW", "PROCEDURE", "JOIN_INDEX", "JAR", "TRIGGER", "ROLE")))
    required = P.required_rights(t("part").select(F.concat(F.lit("D"), "p_size").alias("db"), F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int")).alias("kind")))
    right = F.when(F.col("s_suppkey") % 5 == 0, "CT").when(F.col("s_suppkey") % 5 == 1, "CV").when(F.col("s_suppkey") % 5 == 2, "AL").when(F.col("s_suppkey") % 5 == 3, "PC").otherwise("DT")
    granted = t("supplier").select(F.concat(F.lit("D"), F.col("s_suppkey") % 50).alias("db"), right.alias("right")).distinct()
    return required, granted


@query(f"""WITH {_RIGHTS} SELECT db, "right" FROM req WHERE (db, "right") NOT IN (SELECT (db, "right") FROM gr) AND db NOT IN (SELECT db FROM gr WHERE "right" = 'AL')
    AND db NOT IN (SELECT 'D' || n_nationkey FROM nation)""".replace(" AS right", ' AS "right"'))
def missing_rights(t):
    required, granted = _rights(t)
    return P.missing_rights(required, granted, t("nation").select(F.concat(F.lit("D"), "n_nationkey").alias("db")))


@query(f"""WITH {_RIGHTS} SELECT db, "right" FROM gr WHERE "right" IN (SELECT "right" FROM req WHERE db = 'D1')""".replace(" AS right", ' AS "right"'))
def excess_rights(t):
    required, granted = _rights(t)
    return P.excess_rights(granted, required.where("db = 'D1'").select("right")).select("db", "right")


@query("""SELECT p_partkey, comment FROM part LEFT JOIN (SELECT s_suppkey, 'about ' || s_name AS comment FROM supplier) ON p_partkey = s_suppkey""")
def inherit_comments(t):
    columns = t("part").select("p_partkey", F.lit("B").alias("base_table"), F.concat(F.lit("Col"), "p_partkey").alias("column_name"))
    comments = t("supplier").select(F.lit("B").alias("table_name"), F.concat(F.lit("COL"), "s_suppkey").alias("column_name"), F.concat(F.lit("about "), "s_name").alias("comment"))
    return P.inherit_comments(columns, comments).select("p_partkey", "comment")


@query("""SELECT event_id, user_id % 40 IN (SELECT p_size FROM part WHERE p_partkey % 9 = 0) AS expected FROM events""")
def attribute_failures(t):
    failures = t("events").select("event_id", F.concat(F.lit("Object 'd.o"), F.col("user_id") % 40, F.lit("' does not exist.")).alias("message"))
    return P.attribute_failures(failures, t("part").where("p_partkey % 9 = 0").select(F.lit("D").alias("db"), F.concat(F.lit("O"), "p_size").alias("name"))).select("event_id", "expected")


@query("""SELECT o_orderkey % 9 AS line, CASE WHEN o_orderkey % 3 < 2 THEN 'src' || o_custkey % 100 END AS source FROM orders""")
def source_of(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.concat(F.when(F.col("o_orderkey") % 3 == 2, "gone\\").otherwise("ddl\\"), F.col("o_custkey") % 100, F.lit(".tbl:"), F.col("o_orderkey") % 9).alias("location"))
    sources = t("orders").select(F.concat(F.lit("payload/database/ddl/"), F.col("o_custkey") % 100, F.lit(".tbl")).alias("path"), F.concat(F.lit("src"), F.col("o_custkey") % 100).alias("source")).distinct()
    return P.source_of(o.drop("o_orderkey", "o_custkey"), sources, "location").select(F.regexp_extract("location", r"(\d+)$", 1).cast("long").alias("line"), "source")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE true QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def first_line_per_order(t):
    return P.dedup_first(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, ts, event_id, event_type FROM events WHERE true QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(t):
    return P.latest_by(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey % 5 AS build, o_orderkey, o_orderstatus FROM orders),
  b AS (SELECT *, lag(build) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM o)
  SELECT o_custkey, o_orderdate, build, 'build_goes_back' AS finding FROM b WHERE build < p
  UNION ALL SELECT o_custkey, max(o_orderdate), build, 'build_reused' FROM o GROUP BY o_custkey, build HAVING count(DISTINCT o_orderstatus) > 1""")
def nonlinear_orders(t):
    o = t("orders").select("o_custkey", "o_orderdate", (F.col("o_orderkey") % 5).alias("build"), "o_orderkey", "o_orderstatus")
    return P.history_findings(o, ["o_custkey"], "o_orderdate", "build", "o_orderstatus", "o_orderkey")


@query("""SELECT DISTINCT l_orderkey, l_linenumber::INTEGER AS line, (l_linenumber + 1)::INTEGER AS required FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM lineitem i WHERE i.l_orderkey = l.l_orderkey AND i.l_linenumber = l.l_linenumber + 1)""")
def missing_siblings(t):
    lines = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("line")).distinct().withColumn("needs", F.array(F.col("line") + 1))
    return P.missing_siblings(lines, ["l_orderkey"], "line", "needs").select("l_orderkey", "line", "required")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'absent' WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS digest_status FROM documents""")
def digest_status(t):
    d = t("documents").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.sha2("text", 256)).alias("e"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("a"))
    return P.digest_findings(d, "e", "a").select("doc_id", "digest_status")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3 AS kept,
    date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 365 AS recent FROM orders""")
def prune_orders(t):
    o = P.prune(t("orders"), ["o_custkey"], "o_orderdate", "o_orderkey", keep_runs=3).withColumnRenamed("kept", "k")
    o = P.prune(o, ["o_custkey"], "o_orderdate", "o_orderkey", keep_days=365, as_of="1998-08-02")
    return o.select("o_orderkey", F.col("k").alias("kept"), F.col("kept").alias("recent"))


@query("""WITH l AS (SELECT user_id, event_type AS setting, event_id % 3 AS layer, max(CASE WHEN event_id % 7 <> 0 THEN event_id END) AS value FROM events GROUP BY ALL)
  SELECT user_id, setting, value, layer FROM l WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, setting ORDER BY layer DESC) = 1""")
def layered_props(t):
    e = t("events").groupBy("user_id", F.col("event_type").alias("setting"), (F.col("event_id") % 3).alias("layer")).agg(F.max(F.when(F.col("event_id") % 7 != 0, F.col("event_id"))).alias("value"))
    return P.resolve_layers(e.withColumn("precedence", F.col("layer")), ["user_id", "setting"], "layer", "value", "precedence")


@query("SELECT seq, object, state FROM <states> WHERE state IN ('BACKED_UP', 'CREATED', 'MIGRATED', 'COMPLETED') AND wave = 2")
def rollback_candidates(t):
    return P.rollback_candidates(t("states"), 2).select("seq", "object", "state")


@query("SELECT seq, object, state FROM <states> WHERE state IN ('PENDING', 'FAILED')")
def resumable(t):
    return P.resumable(t("states")).select("seq", "object", "state")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_name, p_partkey) AS position FROM part""")
def ordered_plan(t):
    part = t("part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1))).withColumn("name", F.struct("p_name", "p_partkey"))
    return P.ordered_plan(part, "p_size", "kind", "name", ["PROMO", "ECONOMY"]).select("p_partkey", "position")


@query("""WITH l AS (SELECT 'S.' || l_suppkey AS s, 'P.' || l_partkey AS g, l_orderkey AS job FROM lineitem)
  SELECT s AS node, job, 'in' AS direction, 'SUPPLIER' AS kind FROM l UNION ALL SELECT g, job, 'out', 'EXTERNAL' FROM l""")
def lineage_legs(t):
    lineage = t("lineitem").select(F.lit("S ").alias("source_database"), F.col("l_suppkey").cast("string").alias("source_table"), F.lit("P").alias("target_database"), F.concat(F.col("l_partkey").cast("string"), F.lit(" ")).alias("target_table"), F.col("l_orderkey").alias("job"))
    return P.lineage_legs(lineage, t("supplier").select(F.concat(F.lit("S."), "s_suppkey").alias("node"), F.lit("SUPPLIER").alias("kind"))).select("node", "job", "direction", "kind")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey % 3) AS n_builds, min(l_suppkey % 3) AS lowest, max(l_suppkey % 3) AS highest FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 3) > 1")
def mixed_builds(t):
    """Releases (orders) whose packages (lines) are of several builds."""
    return P.mixed_builds(t("lineitem").withColumn("build", F.col("l_suppkey") % 3), ["l_orderkey"], "build")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND NOT bool_or(l_returnflag = 'N')")
def prereq_without_main(t):
    role = F.when(F.col("l_returnflag") == "A", "prereq").when(F.col("l_returnflag") == "N", "main").otherwise("other")
    return P.prereq_without_main(t("lineitem").withColumn("role", role), ["l_orderkey"], "role")

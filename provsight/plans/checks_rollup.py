"""Queries of the roll-ups, reconciliation, rules and streaming twins."""

from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import reconcile as D
from ..operators import rollup as A
from ..operators import rules as R
from ..sources import scans as S
from ..streaming import folds as ST
from .registry import query


@query("""SELECT n_regionkey, n_nationkey, coalesce(sum(c), 0) AS bytes, count(*) AS n, count(*) FILTER (c IS NULL) AS n_unresolved FROM
    (SELECT n_regionkey, n_nationkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 1024 END AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def footprint_rollup(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("size", A.parse_bytes(F.when(F.col("c_custkey") % 11 != 0, F.concat("c_custkey", F.lit("K"))).otherwise("big")))
    return A.footprint(c, ["n_regionkey", "n_nationkey"], "size")


@query("""WITH c AS (SELECT parent AS node, sum(bytes) AS children_bytes, count(*) AS n_children FROM <decls> GROUP BY parent)
  SELECT c.node, d.bytes AS declared, children_bytes, n_children, d.bytes - children_bytes AS headroom,
    CASE WHEN d.node IS NULL THEN 'EXTERNAL' WHEN d.bytes - children_bytes IS NULL THEN 'UNKNOWN' WHEN d.bytes < children_bytes THEN 'INSUFFICIENT' ELSE 'OK' END AS status
  FROM c LEFT JOIN <decls> d ON c.node = d.node WHERE c.node <> 1""")
def headroom_part_tree(t):
    return A.headroom(t("decls"), [1])


@query("""WITH d AS (SELECT s_nationkey AS container, arg_max(s_suppkey * 10, s_suppkey) FILTER (s_suppkey % 3 <> 0) AS c, arg_max(s_suppkey * 10, s_suppkey) FILTER (s_suppkey % 3 = 0) AS m FROM supplier GROUP BY 1),
  o AS (SELECT c_nationkey AS container, sum(c_custkey % 20) AS need FROM customer WHERE c_nationkey <> 5 GROUP BY 1),
  b AS (SELECT coalesce(d.container, o.container) AS container, coalesce(m, c) AS bytes, need FROM d FULL JOIN o ON d.container = o.container)
  SELECT container, bytes, need, CASE WHEN coalesce(need, 0) = 0 THEN 'OK' WHEN bytes IS NULL THEN 'UNKNOWN' WHEN bytes < need THEN 'INSUFFICIENT' WHEN (bytes - need) * 100 < bytes * 20 THEN 'WARNING' ELSE 'OK' END AS status FROM b""")
def capacity_by_nation(t):
    decls = t("supplier").select(F.col("s_nationkey").alias("container"), F.when(F.col("s_suppkey") % 3 == 0, "MODIFY").otherwise("CREATE").alias("kind"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") * 10).alias("bytes"))
    objects = t("customer").where("c_nationkey != 5").select(F.col("c_nationkey").alias("container"), (F.col("c_custkey") % 20).alias("floor"))
    return A.capacity(decls, objects)


@query("""SELECT *, allowed - used AS free, CASE WHEN allowed = 0 THEN 'ERROR' WHEN (allowed - used) * 100 < allowed * 20 THEN 'WARNING' ELSE 'OK' END AS status FROM
    (SELECT l_suppkey, sum((l_partkey % 50)::BIGINT) AS allowed, sum((l_partkey % 50 * (l_suppkey % 4) // 3)::BIGINT) AS used FROM lineitem GROUP BY 1)""")
def free_space_supplier(t):
    usage = t("lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("allowed"), F.expr("(l_partkey % 50 * (l_suppkey % 4)) div 3").alias("used"))
    return A.free_space(usage, "l_suppkey", "allowed", "used")


@query("SELECT grantee, grantor, string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges FROM <grants> GROUP BY 1, 2")
def merge_grants(t):
    return A.merge_grants(t("grants"), ["grantee", "grantor"])


#: Statements that grant and revoke, with numbers for #, + and !.
_DCL = ("GRANT SELECT ON D#.T TO R+", "grant insert , SELECT on table D#.T to R+;", "GRANT UPDATE ON D#.T TO R+ WITH GRANT OPTION", "REVOKE DELETE ON DATABASE D# FROM R+ -- ON X TO Y", "GRANT role_! TO U+ WITH ADMIN OPTION", "INSERT INTO D#.T SELECT 1", "REVOKE role_! FROM U+")


@query("""WITH o AS (SELECT DISTINCT o_orderkey % 7 AS k, o_custkey % 5 AS d, o_custkey % 3 AS g, o_custkey % 2 AS r FROM orders),
  p AS (SELECT DISTINCT CASE WHEN k = 3 THEN 'REVOKE' ELSE 'GRANT' END AS action, unnest(CASE k WHEN 0 THEN ['SELECT'] WHEN 1 THEN ['INSERT', 'SELECT'] WHEN 2 THEN ['UPDATE'] ELSE ['DELETE'] END) AS what, 'D' || d || CASE WHEN k = 3 THEN '' ELSE '.T' END AS on_object, 'R' || g AS grantee, k = 2 AS option FROM o WHERE k < 4),
  u AS (SELECT 0 AS late, action, string_agg(what, ',' ORDER BY what) AS what, on_object, grantee, option FROM p GROUP BY ALL UNION ALL SELECT DISTINCT 1, CASE WHEN k = 4 THEN 'GRANT' ELSE 'REVOKE' END, 'role_' || r, NULL, 'U' || g, k = 4 FROM o WHERE k IN (4, 6))
  SELECT row_number() OVER (ORDER BY late, action, on_object, grantee, option, what) AS place, action, what, on_object, grantee, option FROM u""")
def grant_statements(t):
    """Statements on one object, grantee and option merged; roles after them; numbered in their order."""
    text = F.element_at(F.array(*map(F.lit, _DCL)), (F.col("o_orderkey") % len(_DCL) + 1).cast("int"))
    for mark, n in (("#", 5), ("+", 3), ("!", 2)):
        text = F.replace(text, F.lit(mark), (F.col("o_custkey") % n).cast("string"))
    return A.merge_statements(A.parse_grants(t("orders").select("o_orderkey", text.alias("body")), "o_orderkey"))


@query("""SELECT reader, string_agg(DISTINCT read, ',' ORDER BY read) AS reads FROM (SELECT 'N' || sn.n_nationkey AS reader, 'N' || cn.n_nationkey AS read FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_regionkey <> cn.n_regionkey) GROUP BY 1""")
def cross_module_supply(t):
    """Nations are namespaces, regions modules: reads inside a region do not count."""
    sup, cus = t("supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("reader")), t("customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("read"))
    refs = t("lineitem").select("l_suppkey", "l_orderkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cus, F.col("o_custkey") == F.col("c_custkey"))
    return A.cross_module_reads(refs, "reader", "read", t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("namespace"), F.col("n_regionkey").alias("module")))


@query("""SELECT s AS reader, string_agg(DISTINCT c, ',' ORDER BY c) AS reads FROM (SELECT 'R' || sn.n_regionkey AS s, 'R' || cn.n_regionkey AS c FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey) WHERE s <> c GROUP BY 1""")
def cross_region_supply(t):
    n = t("nation")
    sup = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("R"), "n_regionkey").alias("reader"))
    cus = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("R"), "n_regionkey").alias("read"))
    refs = t("lineitem").select("l_suppkey", "l_orderkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cus, F.col("o_custkey") == F.col("c_custkey"))
    return A.cross_module_reads(refs, "reader", "read")


@query("""WITH s AS (SELECT unnest(string_split(p_type, ' ')) AS root, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS pos FROM part),
  c AS (SELECT pos, root, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT * FROM c WHERE true QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC, root) = 1)
  SELECT pos, root, n, total, CASE WHEN n * 10 >= total * 9 THEN 'HIGH' WHEN n * 10 >= total * 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM b, (SELECT count(*) AS total FROM part)""")
def type_roots(t):
    return A.name_roots(t("part"), "p_type")


@query("""SELECT p_partkey, nullif(regexp_extract(p_brand, '^Brand#([1-3])(\\d)$', 1), '') AS maker, nullif(regexp_extract(p_brand, '^Brand#([1-3])(\\d)$', 2), '') AS line,
    NOT regexp_matches(p_brand, '^Brand#([1-3])(\\d)$') AS outlier FROM part""")
def name_decomposition(t):
    return A.decompose(t("part"), "p_brand", r"^Brand#([1-3])(\d)$", ["maker", "line"]).select("p_partkey", "maker", "line", "outlier")


@query("""SELECT token, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS literals FROM (SELECT DISTINCT p_brand, upper(left(p_brand, 7)) AS token FROM part) GROUP BY 1 HAVING count(*) > 1""")
def name_collisions(t):
    return A.name_collisions(t("part"), "p_brand", F.upper(F.substring("p_brand", 1, 7)))


@query("""WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'dev_DB' || o_custkey % 30 WHEN 1 THEN 'DBC' WHEN 2 THEN '{{X}}' ELSE 'PRD' || o_custkey % 30 END AS literal, o_orderkey AS path FROM orders)
  SELECT literal, count(DISTINCT path) AS n_files, min(path) AS first_file, CASE WHEN starts_with(upper(literal), 'DEV_') THEN substr(literal, 5) ELSE literal END AS token
  FROM r WHERE literal NOT IN ('DBC', '{{X}}') GROUP BY 1""")
def token_candidates(t):
    k = F.col("o_orderkey") % 4
    literal = F.when(k == 0, F.concat(F.lit("dev_DB"), F.col("o_custkey") % 30)).when(k == 1, "DBC").when(k == 2, "{{X}}").otherwise(F.concat(F.lit("PRD"), F.col("o_custkey") % 30))
    return A.token_candidates(t("orders").select(literal.alias("literal"), F.col("o_orderkey").alias("path")), "literal", "path", "DEV_", ["DBC"])


@query("""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'dev_DB' ELSE 'PRD' END || o_custkey % 30 AS literal, o_orderkey AS path FROM orders WHERE o_orderkey % 4 IN (0, 3)""")
def candidate_files(t):
    k = F.col("o_orderkey") % 4
    literal = F.when(k == 0, F.concat(F.lit("dev_DB"), F.col("o_custkey") % 30)).when(k == 1, "DBC").when(k == 2, "{{X}}").otherwise(F.concat(F.lit("PRD"), F.col("o_custkey") % 30))
    return A.candidate_files(t("orders").select(literal.alias("literal"), F.col("o_orderkey").alias("path")), "literal", "path", ["DBC"])


@query("""WITH w AS (SELECT source, signal, max(CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS w FROM (SELECT *, 'S' || doc_id % 3 AS signal FROM <issues>) GROUP BY 1, 2),
  e AS (SELECT source, 'S' || i AS signal FROM (SELECT DISTINCT source FROM documents), range(4) r(i)),
  c AS (SELECT e.source, count(*) FILTER (w = 2) AS n_fail, count(*) FILTER (w = 1) AS n_warn, count(*) FILTER (w IS NULL) AS n_unknown FROM e LEFT JOIN w ON e.source = w.source AND e.signal = w.signal GROUP BY 1)
  SELECT *, CASE WHEN n_fail > 0 THEN 'BLOCKED' WHEN n_warn + n_unknown > 0 THEN 'READY_WITH_CAVEATS' ELSE 'READY' END AS status FROM c""")
def trust_by_source(t):
    signal = lambda k: F.concat(F.lit("S"), k)
    expected = t("documents").select("source").distinct().select("source", F.explode(F.array(*[F.lit(f"S{k}") for k in range(4)])).alias("signal"))
    return A.trust_status(t("issues").withColumn("signal", signal(F.col("doc_id") % 3)), "source", "signal", expected)


@query("""SELECT c_custkey AS user_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'warning' ELSE 'success' END AS status
    FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY 1""")
def user_run_status(t):
    stages = t("events").select("user_id", F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("ok").alias("s"))
    return A.run_status(t("customer").select(F.col("c_custkey").alias("user_id")), stages, "user_id", "s")


@query("""SELECT object, arg_max(state, CASE state WHEN 'PENDING' THEN 0 WHEN 'CREATED' THEN 1 WHEN 'MIGRATED' THEN 2 ELSE 3 END) AS highest FROM <states> WHERE state <> 'FAILED' GROUP BY 1""")
def highest_state(t):
    return A.highest_state(t("states"), "object", "state", ["PENDING", "CREATED", "MIGRATED", "COMPLETED"], F.col("state") == "FAILED")


@query("SELECT state, count(*) AS n FROM <states> GROUP BY 1")
def state_summary(t):
    return A.state_summary(t("states"))


@query("""SELECT wave, count(*) AS total, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'SKIPPED') AS skipped, count(*) FILTER (state = 'PENDING') AS pending,
    trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::BIGINT AS seconds FROM <states> GROUP BY 1""")
def wave_summary(t):
    return A.wave_summary(t("states"))


@query("SELECT p_size AS wave, p_brand AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def wave_kinds(t):
    return A.wave_kinds(t("part").select(F.col("p_size").alias("wave"), F.col("p_brand").alias("kind")))


@query("""SELECT ts::DATE AS day, user_id AS "user", (user_id % 4)::VARCHAR AS build, CASE WHEN event_id % 2 = 0 THEN 'DEV' ELSE 'PRD' END AS env, CASE WHEN event_id % 7 < 5 THEN (event_id % 7)::VARCHAR END AS wave, count(*) AS n FROM events GROUP BY ALL""")
def tag_usage(t):
    return A.tag_usage(t("tagged"))


@query("""SELECT ts::DATE AS day, user_id AS "user", '3' AS build, CASE WHEN event_id % 2 = 0 THEN 'DEV' ELSE 'PRD' END AS env, CASE WHEN event_id % 7 < 5 THEN (event_id % 7)::VARCHAR END AS wave, count(*) AS n FROM events WHERE user_id % 4 = 3 AND event_type = 'click' GROUP BY ALL""")
def tag_usage_of_a_build(t):
    return A.tag_usage(t("tagged"), build="3", package="click")


@query("""SELECT event_id, 'BUILD=' || user_id % 4 || ';PKG=' || event_type || ';' AS tag FROM events""")
def tag_write(t):
    return t("events").select("event_id", A.write_tag(BUILD=F.col("user_id") % 4, PKG=F.col("event_type")).alias("tag"))


@query("""SELECT source, count(*) AS n, sha256(string_agg(line, '' ORDER BY line)) AS fingerprint FROM (SELECT source, doc_id::VARCHAR || ':' || sha256(text) || chr(10) AS line FROM documents) GROUP BY 1""")
def doc_fingerprint(t):
    return A.fingerprint(t("documents"), "source", "doc_id", "text")


@query()
def doc_fingerprint_bucketed(t):
    return A.bucketed_fingerprint(t("documents"), "source", "doc_id", "text")


@query("""WITH a AS (SELECT source AS g, line AS h, row_number() OVER (PARTITION BY source ORDER BY line) - 1 AS k FROM (SELECT source, doc_id::VARCHAR || ':' || sha256(text) || chr(10) AS line FROM documents)),
  b AS (SELECT g, k // 16 AS k, count(*) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a GROUP BY g, k // 16),
  c AS (SELECT g, k // 16 AS k, sum(n) AS n, CASE WHEN count(*) = 1 AND k // 16 = 0 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM b GROUP BY g, b.k // 16),
  d AS (SELECT g, k // 16 AS k, sum(n) AS n, CASE WHEN count(*) = 1 AND k // 16 = 0 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM c GROUP BY g, c.k // 16)
  SELECT g AS source, sum(n)::BIGINT AS n, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS fingerprint FROM d GROUP BY g""".replace("AND k // 16 = 0", "AND min(k) < 16"))
def doc_fingerprint_tree(t):
    """Digests of 16 lines, of 16 digests, and so on; the SQL has four levels."""
    return A.tree_fingerprint(t("documents"), "source", "doc_id", "text", 16)


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'unexpected' ELSE 'changed' END AS status FROM documents WHERE doc_id % 10 IN (1, 2, 3)""")
def fingerprint_check(t):
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    now = d.where("doc_id % 10 != 1").withColumn("h", F.when(F.col("doc_id") % 10 == 3, F.concat("h", F.lit("x"))).otherwise(F.col("h")))
    return A.verify_fingerprints(d.where("doc_id % 10 != 2"), now, "doc_id", "h")


@query("""WITH u AS (SELECT 'T' || o_custkey % 60 AS token, CASE o_orderkey % 50 WHEN 0 THEN 'identity' WHEN 1 THEN 'scalar' ELSE 'label' END AS p FROM orders WHERE o_custkey % 60 < 50),
  s AS (SELECT token, bool_or(p = 'identity') AS i, bool_or(p = 'scalar') AS s FROM u GROUP BY 1), d AS (SELECT DISTINCT 'T' || c_custkey % 60 AS token FROM customer WHERE c_custkey % 60 >= 5)
  SELECT coalesce(s.token, d.token) AS token, CASE WHEN d.token IS NULL THEN 'unknown' WHEN s.token IS NULL THEN 'unused' WHEN i AND s THEN 'mixed' WHEN i THEN 'identity' WHEN s THEN 'scalar' ELSE 'label' END AS role
  FROM s FULL JOIN d ON s.token = d.token""")
def token_roles(t):
    uses = t("orders").where("o_custkey % 60 < 50").select(F.concat(F.lit("T"), F.col("o_custkey") % 60).alias("token"), F.when(F.col("o_orderkey") % 50 == 0, "identity").when(F.col("o_orderkey") % 50 == 1, "scalar").otherwise("label").alias("position"))
    return A.token_roles(uses, t("customer").where("c_custkey % 60 >= 5").select(F.concat(F.lit("T"), F.col("c_custkey") % 60).alias("token")))


@query("""SELECT o_orderkey, o_orderkey % 9 AS build, CASE WHEN o_orderkey % 2 = 0 THEN 'READY' ELSE 'unknown' END AS status,
    CASE o_orderkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'awaiting' END AS approval FROM orders WHERE o_orderkey % 10 <> 0""")
def release_inventory(t):
    o = t("orders")
    builds = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 9).alias("build"))
    trust = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("READY").alias("status"))
    return A.release_inventory(builds, trust, o.where("o_orderkey % 3 < 2").select("o_orderkey", (F.col("o_orderkey") % 3 == 0).alias("approved")), "o_orderkey").select("o_orderkey", "build", "status", "approval")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber <= 3), n AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber >= 2 AND l_orderkey IN (SELECT a FROM d))
  SELECT coalesce(d.a, n.a) AS l_orderkey, coalesce(d.b, n.b) AS l_partkey, CASE WHEN d.a IS NULL THEN 'UNDECLARED' WHEN n.a IS NULL THEN 'MISSING' ELSE 'MATCHED' END AS status FROM d FULL JOIN n ON d.a = n.a AND d.b = n.b""")
def set_drift(t):
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return D.set_drift(line.where("l_linenumber <= 3"), line.where("l_linenumber >= 2"), ["l_orderkey", "l_partkey"], ["l_orderkey"])


@query("""WITH u AS (SELECT env, token, count(*) AS n FROM <uses> GROUP BY 1, 2), d AS (SELECT * FROM <defs>)
  SELECT env, token, 'undefined' AS finding, n FROM u WHERE (env, token) NOT IN (SELECT (env, token) FROM d)
  UNION ALL SELECT env, token, 'unused', 0 FROM d WHERE token <> 'DB_10' AND (env, token) NOT IN (SELECT (env, token) FROM u)
  UNION ALL SELECT env, token, 'empty', 0 FROM d WHERE value = ''
  UNION ALL SELECT env, token, 'shared', 0 FROM d WHERE token <> 'DB_10' AND value <> '' AND (env, value) IN (SELECT (env, value) FROM d WHERE token <> 'DB_10' AND value <> '' GROUP BY env, value HAVING count(*) > 1)""")
def token_coverage(t):
    return D.token_coverage(t("uses"), t("defs"), ["DB_10"])


@query("""SELECT DISTINCT env, token, stmt_id FROM <uses> WHERE (env, token) NOT IN (SELECT (env, token) FROM <defs>)""")
def undefined_token_files(t):
    return D.undefined_files(t("uses"), t("defs"), "stmt_id")


@query("""WITH d AS (SELECT * FROM <defs> UNION ALL SELECT 2, 'DB_1', 'x' UNION ALL SELECT 3, 'DB_10', 'y'), u AS (SELECT env, token FROM <uses> UNION ALL SELECT 3, 'DB_10')
  SELECT env, CASE WHEN env < 2 AND env IN (SELECT env FROM u WHERE (env, token) NOT IN (SELECT (env, token) FROM d)) THEN 'error' WHEN env < 3 THEN 'warning' ELSE 'success' END AS status FROM d GROUP BY env""")
def token_status(t):
    more = t("region").where("r_regionkey IN (2, 3)").select(F.col("r_regionkey").cast("int").alias("env"), F.when(F.col("r_regionkey") == 2, "DB_1").otherwise("DB_10").alias("token"), F.when(F.col("r_regionkey") == 2, "x").otherwise("y").alias("value"))
    defs, uses = t("defs").unionByName(more), t("uses").select("env", "token").unionByName(more.where("env = 3").select("env", "token"))
    return D.coverage_status(D.token_coverage(uses, defs, []), defs)


_FAMILY = "CASE WHEN {0} IN ('INTEGER', 'BIGINT', 'DECIMAL') THEN 1 WHEN {0} IN ('CHAR', 'VARCHAR') THEN 2 WHEN {0} = 'DATE' THEN 3 WHEN {0} IN ('BYTE', 'VARBYTE') THEN 4 END"
_COMPAT = f"""WITH j AS (SELECT coalesce(o.tab, n.tab) AS tab, lower(coalesce(o.name, n.name)) AS name, o.type AS t0, n.type AS t1, o.length AS l0, n.length AS l1, not_null, has_default
    FROM <cols_old> o FULL JOIN <cols_new> n ON o.tab = n.tab AND lower(o.name) = lower(n.name)),
  c AS (SELECT tab, name, CASE WHEN t0 IS NULL THEN CASE WHEN not_null = 1 AND has_default = 0 THEN 'added_required' ELSE 'added' END WHEN t1 IS NULL THEN 'dropped' WHEN t0 = t1 AND l1 < l0 THEN 'narrower'
    WHEN t0 = t1 AND l1 > l0 THEN 'wider' WHEN t0 = t1 THEN 'same' WHEN {_FAMILY.format('t0')} = {_FAMILY.format('t1')} THEN 'family' ELSE 'other_type' END AS change FROM j),
  v AS (SELECT *, CASE WHEN change IN ('added_required', 'narrower', 'other_type') THEN 'blocker' WHEN change IN ('dropped', 'wider', 'family') THEN 'warning' ELSE 'ok' END AS level FROM c)"""


@query(_COMPAT + " SELECT * FROM v")
def schema_compat(t):
    return D.schema_compat(t("cols_old"), t("cols_new"))


@query(_COMPAT + """ SELECT tab, count(*) FILTER (level = 'blocker') = 0 AS can_migrate, count(*) FILTER (level = 'blocker') AS n_blockers, count(*) FILTER (level = 'warning') AS n_warnings,
    coalesce(string_agg(name, ',' ORDER BY name) FILTER (level = 'blocker'), '') AS blockers FROM v GROUP BY tab""")
def schema_verdict(t):
    return D.compat_verdict(D.schema_compat(t("cols_old"), t("cols_new")))


@query("""SELECT o_orderkey, (o_orderkey % 100)::SMALLINT AS code, 'new' AS added, NULL::DATE AS later FROM orders WHERE o_orderkey % 13 <> 0""")
def conform_orders(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "x1").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("code"), "o_orderstatus")
    return D.conform(o, [("o_orderkey", "bigint", None), ("code", "smallint", None), ("added", "string", "new"), ("later", "date", None)])[0]


@query("SELECT count(*) FILTER (o_orderkey % 13 <> 0) AS moved, count(*) FILTER (o_orderkey % 13 = 0) AS rejected FROM orders")
def conform_counts(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "x1").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("code"))
    return D.conform_counts(o, [("o_orderkey", "bigint", None), ("code", "smallint", None), ("added", "string", "new")])


@query("""SELECT o_orderkey, code FROM (SELECT o_orderkey, 'x1' AS code FROM orders WHERE o_orderkey % 13 = 0)""")
def conform_rejects(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, "x1").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("code"))
    return D.conform(o, [("o_orderkey", "bigint", None), ("code", "smallint", None)])[1]


_CONTRACT = """b AS (SELECT 'O' || l_orderkey AS object, CASE WHEN l_orderkey % 3 = 0 THEN 'PROCEDURE' ELSE 'VIEW' END AS kind, l_linenumber * 1000000 + l_partkey AS pos, 'c' || l_partkey AS name, l_returnflag AS type, CASE l_linenumber % 3 WHEN 0 THEN 'OUT' ELSE 'IN' END AS direction FROM lineitem WHERE l_orderkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_returnflag) = 1),
  n AS (SELECT object, CASE WHEN object LIKE '%7' THEN 'TABLE' ELSE kind END AS kind, CASE WHEN object LIKE '%3' THEN -pos ELSE pos END AS pos, name, CASE WHEN object LIKE '%1' THEN 'Z' ELSE type END AS type, CASE WHEN object LIKE '%6' THEN 'INOUT' ELSE direction END AS direction FROM b WHERE object NOT LIKE '%9' AND NOT (object LIKE '%2' AND pos < 2000000))"""


@query(f"""WITH {_CONTRACT}, g AS (SELECT b.object, min(b.kind) AS k0, min(n.kind) AS k1 FROM b LEFT JOIN n ON b.object = n.object GROUP BY 1),
  p AS (SELECT b.object, b.name, b.type AS t0, n.type AS t1, b.pos AS p0, n.pos AS p1, k0, b.direction AS d0, n.direction AS d1 FROM b JOIN g ON b.object = g.object AND k0 = k1 LEFT JOIN n ON b.object = n.object AND b.name = n.name),
  r AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY p0) AS r0, row_number() OVER (PARTITION BY object ORDER BY p1) AS r1 FROM p WHERE p1 IS NOT NULL AND k0 = 'VIEW')
  SELECT object, NULL AS name, CASE WHEN k1 IS NULL THEN 'object_removed' ELSE 'kind_changed' END AS change FROM g WHERE k1 IS NULL OR k0 <> k1
  UNION ALL SELECT object, name, CASE WHEN p1 IS NULL THEN 'column_removed' ELSE 'type_changed' END FROM p WHERE p1 IS NULL OR t0 <> t1
  UNION ALL SELECT object, name, 'direction_changed' FROM p WHERE k0 = 'PROCEDURE' AND p1 IS NOT NULL AND d0 <> d1 UNION ALL SELECT object, name, 'reordered' FROM r WHERE r0 <> r1""")
def contract_diff(t):
    from ..operators.product import dedup_first

    lines = t("lineitem").where("l_orderkey % 5 != 0").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    lines = cut(dedup_first(lines, ["l_orderkey", "l_partkey"], ["l_linenumber", "l_returnflag"]))  # read by both contracts and their objects
    base = lines.select(F.concat(F.lit("O"), "l_orderkey").alias("object"), F.lit("VIEW").alias("kind"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("pos"), F.concat(F.lit("c"), "l_partkey").alias("name"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linenumber") % 3 == 0, "OUT").otherwise("IN").alias("direction"))
    base = base.withColumn("kind", F.when(F.substring("object", 2, 20).cast("long") % 3 == 0, "PROCEDURE").otherwise("VIEW"))
    ends = lambda d: F.col("object").endswith(d)
    now = base.where(~ends("9") & ~(ends("2") & (F.col("pos") < 2000000))).select("object", F.when(ends("7"), "TABLE").otherwise(F.col("kind")).alias("kind"), F.when(ends("3"), -F.col("pos")).otherwise(F.col("pos")).alias("pos"), "name", F.when(ends("1"), "Z").otherwise(F.col("type")).alias("type"), F.when(ends("6"), "INOUT").otherwise(F.col("direction")).alias("direction"))
    return D.contract_diff(base, now)


@query("""WITH j AS (SELECT coalesce(e.grantee, a.grantee) AS grantee, e.grantee IS NOT NULL AS x, a.grantee IS NOT NULL AS y FROM <grants_expected> e FULL JOIN <grants_actual> a ON e.grantee = a.grantee AND e.grantor = a.grantor AND e.privilege = a.privilege)
  SELECT grantee, count(*) FILTER (x AND NOT y) AS n_missing, count(*) FILTER (y AND NOT x) AS n_extra,
    CASE WHEN bool_and(x AND y) THEN 'consistent' WHEN NOT bool_or(y) THEN 'missing' WHEN NOT bool_or(x) THEN 'orphaned' ELSE 'drifted' END AS status FROM j GROUP BY 1""")
def grant_drift(t):
    return D.grant_drift(t("grants_expected"), t("grants_actual"))


@query("SELECT doc_id, doc_id % 8 = 1 AS drifted FROM documents WHERE doc_id % 8 <> 5")
def definition_drift(t):
    d = t("documents").select("doc_id", "text")
    now = d.where("doc_id % 8 != 5").withColumn("text", F.when(F.col("doc_id") % 8 == 1, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("\n"), "text", F.lit("  \n"))))
    return D.definition_drift(d.where("doc_id % 8 != 6"), now, "doc_id", "text")


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 9 IN (1, 2, 3)""")
def changeset_docs(t):
    d = t("documents").select("doc_id", "text")
    now = d.where("doc_id % 9 != 2").withColumn("text", F.when(F.col("doc_id") % 9 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return D.changeset(d.where("doc_id % 9 != 1"), now, "doc_id", "text")


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 997 = 5), w AS (SELECT node FROM s UNION SELECT d.node FROM <dag> d JOIN w ON d.dep = w.node)
  SELECT node, CASE WHEN node IN (SELECT node FROM s) THEN 'changed' ELSE 'dependant' END AS role FROM w""")
def changeset_impact(t):
    part = t("part").select("p_partkey", "p_name")
    now = part.withColumn("p_name", F.when(F.col("p_partkey") % 997 == 5, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    objects = part.select("p_partkey", F.col("p_partkey").alias("node"))
    return D.changeset_impact(D.changeset(part, now, "p_partkey", "p_name"), objects, t("dag"), "p_partkey")


@query("""SELECT p_size AS folder, p_brand AS item, count(*) AS n, CASE WHEN count(*) > 2 THEN 'error' ELSE 'pair' END AS finding, count(DISTINCT p_type) = 1 AS same_content
    FROM part GROUP BY 1, 2 HAVING count(*) > 2 OR (count(*) = 2 AND count(*) FILTER (p_partkey % 2 = 0) = 1)""")
def twins(t):
    return D.twins(t("part").withColumnRenamed("p_size", "folder"), "folder", "p_name", F.col("p_brand"), F.col("p_partkey") % 2 == 0, "p_type")


@query("""SELECT seq, object, CASE WHEN state = 'COMPLETED' AND substr(object, 4)::BIGINT % 3 = 0 THEN 'PENDING' ELSE state END AS state FROM <states>""")
def stale_completed(t):
    live = t("events").where("user_id % 3 != 0").select(F.concat(F.lit("OBJ"), "user_id").alias("object"))
    return D.stale_completed(t("states"), live, "object").select("seq", "object", "state")


_RULES = [
    {"id": "no_mit", "mode": "deny", "pattern": "MIT License", "severity": "ERROR", "types": ["en", "fr"]},
    {"id": "needs_stop", "mode": "required", "pattern": r"\.", "severity": "WARNING"},
    {"id": "skip_gpl", "mode": "exclude", "pattern": "GNU General", "severity": "WARNING"},
    {"id": "silent", "mode": "deny", "pattern": ".", "severity": "OFF"},
    {"id": "late", "mode": "deny", "pattern": "Apache", "severity": "INFO", "phases": ["build"]},
    {"mode": "deny", "pattern": "no id"},
]


@query("""WITH d AS (SELECT * FROM documents WHERE text NOT LIKE '%GNU General%')
  SELECT doc_id, 'no_mit' AS rule, 'ERROR' AS severity FROM d WHERE text LIKE '%MIT License%' AND lang IN ('en', 'fr')
  UNION ALL SELECT doc_id, 'needs_stop', 'WARNING' FROM d WHERE text NOT LIKE '%.%'
  UNION ALL SELECT doc_id, 'late', 'INFO' FROM d WHERE text LIKE '%Apache%' AND doc_id % 2 = 0""")
def apply_policy(t):
    corpus = t("documents").withColumn("phase", F.when(F.col("doc_id") % 2 == 0, "build"))
    return R.apply_policy(corpus, _RULES, "doc_id", "text", "lang", "phase")


@query("""SELECT o.doc_id, label, CASE WHEN label IS NULL THEN 'warning' WHEN label = 'ODD' THEN 'error' ELSE 'ok' END AS level FROM documents o
    LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'ODD' WHEN quality = 1 THEN 'PUBLIC' ELSE 'INTERNAL' END AS label FROM labels) l ON o.doc_id = l.doc_id""")
def label_coverage(t):
    labels = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "ODD").when(F.col("quality") == 1, "PUBLIC").otherwise("INTERNAL").alias("label"))
    return R.sensitivity(t("documents"), labels, "doc_id", required="warning")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(t):
    return R.check_unique(t("lineitem"), ["l_orderkey", "l_suppkey"])


@query("""SELECT 'wave' AS "column", count(*) FILTER (wave IS NULL) AS n_null FROM <states> UNION ALL SELECT 'state', count(*) FILTER (state IS NULL) FROM <states>""")
def null_counts(t):
    return R.check_not_null(t("states"), ["wave", "state"])


@query("SELECT seq, wave FROM <states> WHERE NOT wave < 4")
def check_violations(t):
    return R.check_predicate(t("states"), F.col("wave") < 4).select("seq", "wave")


@query("""SELECT 'wave' AS "column", 'null_share' AS metric, count(*) FILTER (wave IS NULL) AS bad, count(*) AS sample_size, 5 AS threshold_pct, count(*) FILTER (wave IS NULL) * 100 <= count(*) * 5 AS met FROM <states>
    UNION ALL SELECT 'state', 'failed_share', count(*) FILTER (state = 'FAILED'), count(*), 50, count(*) FILTER (state = 'FAILED') * 100 <= count(*) * 50 FROM <states>""")
def quality_metrics(t):
    return R.quality_metrics(t("states"), [("wave", "null_share", F.col("wave").isNull(), 5), ("state", "failed_share", F.col("state") == "FAILED", 50)])


@query("""SELECT 'OPS' AS db, 'states' AS "table", 'wave' AS "column", 'null_share' AS metric, (count(*) FILTER (wave IS NULL) / count(*))::DECIMAL(10, 4) AS value, 0.05::DECIMAL(5, 4) AS threshold, count(*) FILTER (wave IS NULL) * 100 <= count(*) * 5 AS met, count(*) AS sample_size FROM <states>
    UNION ALL SELECT 'OPS', 'states', 'state', 'failed_share', (count(*) FILTER (state = 'FAILED') / count(*))::DECIMAL(10, 4), 0.5::DECIMAL(5, 4), count(*) FILTER (state = 'FAILED') * 100 <= count(*) * 50, count(*) FROM <states>""")
def metric_rows(t):
    return R.metric_rows(t("states"), "OPS", "states", [("wave", "null_share", F.col("wave").isNull(), 5), ("state", "failed_share", F.col("state") == "FAILED", 50)])


#: Of the states that the input has, written out apart from the operator's table: what may not follow what.
_ILLEGAL = """p IN ('COMPLETED') OR state = 'PENDING' OR (p = 'PENDING' AND state NOT IN ('CREATED', 'FAILED')) OR (p = 'CREATED' AND state = 'CREATED')
    OR (p = 'MIGRATED' AND state NOT IN ('COMPLETED', 'FAILED')) OR (p = 'FAILED' AND state = 'FAILED')"""


@query(f"""WITH m AS (SELECT *, lag(state) OVER (PARTITION BY object ORDER BY ts, seq) AS p FROM <states>)
  SELECT object, arg_max(state, (ts, seq)) AS state, min(ts) AS started_at, max(ts) FILTER (state IN ('COMPLETED', 'FAILED')) AS completed_at,
    nullif(arg_max(coalesce(error, ''), (ts, seq)) FILTER (state IN ('COMPLETED', 'FAILED')), '') AS error,
    count(*) AS n_events, count(*) FILTER (p IS NOT NULL AND ({_ILLEGAL})) AS n_illegal FROM m GROUP BY 1""")
def user_state_fold(t):
    return ST.fold_state(t("states"))


@query("""WITH r AS (SELECT user_id AS run_id, min(ts) FILTER (event_type = 'signup') AS started, max(ts) FILTER (event_type IN ('purchase', 'error')) AS ended, bool_or(event_type = 'error') AS failed,
    coalesce(string_agg(DISTINCT 'o' || event_id % 5, ',' ORDER BY 'o' || event_id % 5) FILTER (event_type IN ('purchase', 'error')), '') AS outputs,
    coalesce(string_agg(DISTINCT 'f' || event_id % 3, ',' ORDER BY 'f' || event_id % 3) FILTER (event_type = 'error'), '') AS failed_objects, (SELECT max(ts) FROM events) AS now FROM events GROUP BY 1)
  SELECT run_id, started, ended, trunc((epoch_us(ended) - epoch_us(started)) / 1000000)::BIGINT AS seconds, CASE WHEN started IS NULL THEN 'orphan' WHEN ended IS NULL THEN CASE WHEN started + INTERVAL 5 DAY <= now THEN 'abandoned' ELSE 'open' END
    WHEN failed THEN 'failed' ELSE 'complete' END AS outcome, outputs, failed_objects FROM r WHERE started IS NOT NULL OR ended IS NOT NULL""")
def session_pairs(t):
    kind = F.when(F.col("event_type") == "signup", "START").when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "FAIL").otherwise("OTHER")
    numbered = lambda c, n: F.array(F.concat(F.lit(c), F.col("event_id") % n))
    events = t("events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), "ts", numbered("o", 5).alias("outputs"), numbered("f", 3).alias("failed"))
    return ST.pair_runs(events, events.select(F.max("ts")).scalar(), "5 days")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS outcome, 'T' || user_id % 5 AS target, count(*) AS n FROM events GROUP BY 1, 2, 3")
def events_per_day_and_target(t):
    return ST.audit_counts(t("events").select("ts", F.col("event_type").alias("outcome"), F.concat(F.lit("T"), F.col("user_id") % 5).alias("target")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def events_per_day(t):
    return ST.audit_counts(t("events").withColumnRenamed("event_type", "outcome"))


@query("""SELECT 'deploy' AS event, object, max(ts) AS timestamp, CASE WHEN bool_or(state = 'FAILED') THEN 'failed' ELSE 'success' END AS outcome, count(*) FILTER (state = 'COMPLETED') AS objects_deployed,
    count(*) FILTER (state = 'FAILED') AS objects_failed, trunc((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000)::BIGINT AS duration_seconds FROM <states> GROUP BY object""")
def audit_records(t):
    return S.audit_records(t("states"), "object", outcome="state")

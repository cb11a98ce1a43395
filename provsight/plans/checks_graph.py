"""Queries of the graph operators and of the documents made from graphs."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import cut
from ..operators import graph as G
from ..operators import rollup as A
from ..sources import scans as S
from .registry import query

_M = "regexp_replace(body, $r$'(?:[^']|'')*'|--[^\\n]*|/\\*(?s:.*?)\\*/$r$, ' ', 'g')"
_OBJ = r"(SELECT DISTINCT regexp_extract(body, '^\w+ \w+ (\w+)\.(\w+)', 1) AS db, regexp_extract(body, '^\w+ \w+ (\w+)\.(\w+)', 2) AS name, stmt_id FROM <stmt> WHERE stmt_id % 5 IN (0, 1))"
_EDGES = rf"""o AS {_OBJ}, r AS (SELECT DISTINCT upper(o.db || '.' || o.name) AS src, upper(unnest(regexp_extract_all({_M}, '\b(?:FROM|JOIN) ([A-Za-z0-9_{{}}]+\.[A-Za-z0-9_]+)', 1))) AS dst FROM <stmt> s JOIN o ON s.stmt_id = o.stmt_id),
  e AS (SELECT src, dst, CASE WHEN dst IN (SELECT upper(db || '.' || name) FROM o) THEN 'internal' WHEN split_part(dst, '.', 1) IN (SELECT upper(db) FROM o) THEN 'external_known_db' ELSE 'external' END AS scope FROM r WHERE src <> dst)"""


def _mined(t):
    owned = T.extract_owner(t("stmt")).where("owner_db IS NOT NULL").select("stmt_id", F.col("owner_db").alias("src_db"), F.col("owner_name").alias("src_name"))
    refs = T.extract_refs(t("stmt"), "stmt_id", keep_owner=True).where("owner_db IS NOT NULL").withColumnsRenamed({"owner_db": "src_db", "owner_name": "src_name"})
    return G.build_edges(refs, owned.select(F.col("src_db").alias("db"), F.col("src_name").alias("name")).distinct())


@query(f"WITH {_EDGES} SELECT scope, count(*) AS n_edges FROM e GROUP BY 1")
def edges_stmt(t):
    """Statements to references to edges, counted by scope."""
    return _mined(t).groupBy("scope").agg(F.count("*").alias("n_edges"))


@query(f"WITH {_EDGES} SELECT src, dst, scope FROM e")
def edges_mined(t):
    return _mined(t)


@query(rf"""WITH i AS (SELECT DISTINCT stmt_id, regexp_extract(body, '^\w+ \w+ (\w+)\.', 1) AS g, split_part(unnest(regexp_extract_all({_M}, '\b(?:FROM|JOIN) ([A-Za-z0-9_{{}}]+\.[A-Za-z0-9_]+)', 1)), '.', 1) AS d FROM <stmt> WHERE stmt_id % 5 = 0)
  SELECT g AS grantee, d AS grantor, 'SELECT' AS privileges FROM i WHERE g <> d GROUP BY 1, 2""")
def infer_grants(t):
    owned = T.extract_owner(t("stmt")).where("owner_db IS NOT NULL").select("stmt_id", "owner_db", F.col("owner_name").alias("view_name"))
    intents = cut(T.extract_intents(t("stmt"), "stmt_id").join(owned, "stmt_id"))  # read by both sides of the inference
    bases = intents.where("intent = 'read'").select(F.col("owner_db").alias("view_db"), "view_name", F.col("ref_db").alias("base_db")).distinct()
    intents = intents.drop("view_name")
    return A.infer_grants(intents, bases)


@query("""WITH e AS (SELECT p_partkey AS src, p_size AS dst FROM part WHERE p_partkey <> p_size), k AS (SELECT p_partkey AS node, CASE p_partkey % 3 WHEN 0 THEN 'INDEX' WHEN 1 THEN 'STATISTICS' ELSE 'TABLE' END AS kind FROM part)
  SELECT src, dst FROM e UNION SELECT s.src, i.src FROM e s JOIN k ks ON s.src = ks.node AND ks.kind = 'STATISTICS' JOIN e i ON i.dst = s.dst JOIN k ki ON i.src = ki.node AND ki.kind = 'INDEX'""")
def inherited_edges(t):
    part = t("part")
    kinds = part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 3 == 0, "INDEX").when(F.col("p_partkey") % 3 == 1, "STATISTICS").otherwise("TABLE").alias("kind"))
    return G.inherit_edges(part.where("p_partkey != p_size").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst")), kinds)


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS node, 1 AS wave FROM part WHERE p_partkey < 2 UNION SELECT d.node, wave + 1 FROM <dag> d JOIN w ON d.dep = w.node) SELECT node, max(wave)::INTEGER AS wave FROM w GROUP BY 1""")
def part_waves(t):
    return G.waves(t("part").select(F.col("p_partkey").alias("node")), t("dag"))


@query("""WITH RECURSIVE w AS (SELECT dep AS seed, node FROM <dag> WHERE dep IN (3, 11) UNION SELECT seed, d.node FROM <dag> d JOIN w ON d.dep = w.node) SELECT DISTINCT node FROM w WHERE node NOT IN (3, 11)""")
def impact(t):
    return G.dependants(t("dag"), t("part").where("p_partkey IN (3, 11)").select(F.col("p_partkey").alias("node")))


#: Two short loops in the dag, and a ring of 12 nodes beside it.
_CYC = """(SELECT node, dep FROM <dag> UNION SELECT 2, 5 UNION SELECT 3, 20 UNION SELECT -p_partkey, -(p_partkey % 12 + 1) FROM part WHERE p_partkey BETWEEN 1 AND 12)"""


def _looped(t):
    part = t("part")
    more = part.where("p_partkey IN (2, 3)").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") == 2, 5).otherwise(20).cast("long").alias("dep"))
    more = more.unionByName(part.where("p_partkey BETWEEN 1 AND 12").select((-F.col("p_partkey")).alias("node"), (-(F.col("p_partkey") % 12 + 1)).alias("dep")))
    return t("dag").unionByName(more).distinct()


@query(f"""WITH RECURSIVE c AS {_CYC}, p AS (SELECT node AS first, dep AS at, [node, dep] AS path FROM c WHERE node < dep
    UNION ALL SELECT first, dep, list_append(path, dep) FROM p JOIN c ON c.node = p.at WHERE dep > first AND NOT list_contains(path, dep))
  SELECT array_to_string(path, '>') AS cycle, len(path)::INTEGER AS length FROM p JOIN c ON c.node = p.at AND c.dep = p.first""")
def cycle_core(t):
    return G.cycles(_looped(t))


@query(f"""WITH RECURSIVE c AS {_CYC}, s AS (SELECT node, dep FROM c WHERE node < 0 OR node < 64), r AS (SELECT node, dep AS at FROM s UNION SELECT r.node, s.dep FROM r JOIN s ON r.at = s.node)
  SELECT a.node, least(a.node, min(b.node)) AS component FROM r a JOIN r b ON a.node = b.at AND a.at = b.node GROUP BY a.node""")
def strong_components(t):
    return G.strong_components(_looped(t))


@query("""WITH RECURSIVE b AS (SELECT src, dst, cond FROM <rel> UNION SELECT dst, src, cond FROM <rel>), p AS (SELECT src, dst, 1 AS hops, [src, dst] AS nodes, [cond] AS conds FROM b WHERE src <> dst
    UNION ALL SELECT p.src, b.dst, hops + 1, list_append(nodes, b.dst), list_append(conds, cond) FROM p JOIN b ON p.dst = b.src WHERE hops < 5 AND NOT list_contains(nodes, b.dst))
  SELECT src, dst, hops, array_to_string(nodes, '>') AS path, array_to_string(conds, ' AND ') AS conds FROM p""")
def relationship_paths(t):
    return G.relationship_paths(t("rel"))


@query("""SELECT file::VARCHAR AS item, 'in_waves:' || string_agg(wave::VARCHAR, ',' ORDER BY wave) AS finding FROM (SELECT DISTINCT l_partkey AS file, l_linenumber AS wave FROM lineitem) GROUP BY 1, file HAVING count(*) > 1
    UNION ALL SELECT s_suppkey::VARCHAR, 'empty_wave' FROM supplier WHERE s_suppkey NOT IN (SELECT l_linenumber FROM lineitem)""")
def validate_waves(t):
    return G.validate_waves(t("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("wave")), t("supplier").select(F.col("s_suppkey").alias("wave")))


@query("""SELECT dep AS source, d.node AS target, CASE WHEN dep % 5 = 0 THEN 'external' ELSE 'internal' END AS edge_type, CASE WHEN dep % 5 = 0 THEN '' ELSE s.p_type END AS source_type,
    CASE WHEN d.node % 5 = 0 THEN '' ELSE g.p_type END AS target_type FROM <dag> d JOIN part s ON s.p_partkey = dep JOIN part g ON g.p_partkey = d.node""")
def edge_list(t):
    return S.edge_list(t("dag"), t("part").where("p_partkey % 5 != 0").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind")))


@query("""SELECT 'node' AS part, to_json({'node': p_partkey, 'kind': p_type}) AS document FROM part UNION ALL SELECT 'edge', to_json({'node': node, 'dep': dep}) FROM <dag>
    UNION ALL SELECT 'metadata', to_json({'n_nodes': (SELECT count(*) FROM part), 'n_edges': (SELECT count(*) FROM <dag>)})""")
def graph_document(t):
    return S.graph_document(t("part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind")), t("dag"))


@query("SELECT node, string_agg(dep::VARCHAR, ',' ORDER BY dep) AS inputs FROM <dag> GROUP BY 1")
def lineage_inputs(t):
    return S.lineage_inputs(t("dag")).select("node", F.array_join(F.transform("inputs", lambda x: x.cast("string")), ",").alias("inputs"))


@query("""SELECT to_json({'eventType': 'COMPLETE', 'run': {'runId': 'r' || node}, 'job': {'namespace': 'ns', 'name': node::VARCHAR}, 'inputs': list({'namespace': 'ns', 'name': dep::VARCHAR} ORDER BY dep),
    'outputs': [{'namespace': 'ns', 'name': node::VARCHAR}]}) AS value FROM <dag> GROUP BY node""")
def lineage_events(t):
    return S.lineage_events(t("dag"), "ns", F.concat(F.lit("r"), "node"))


@query("""SELECT class, count(*) AS n FROM (SELECT CASE WHEN split_part(p_type, ' ', 1) IN ('PROMO', 'SMALL') THEN 'NUMBER' WHEN split_part(p_type, ' ', 1) = 'ECONOMY' THEN 'STRING' ELSE 'OTHER' END AS class FROM part) GROUP BY 1""")
def field_types(t):
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    native = F.when(first.isin("PROMO", "SMALL"), "decimal(10,2)").when(first == "ECONOMY", "VARCHAR(20)").otherwise(first)
    return t("part").select(S.type_class(native).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT node AS asset, count(*) * 0 + 3 AS n_documents FROM <dag> GROUP BY 1")
def catalog_proposals(t):
    dag = t("dag")
    assets = dag.select(F.col("node").alias("asset")).distinct().withColumn("subtype", F.lit("TABLE"))
    columns = t("part").select(F.col("p_partkey").alias("asset"), F.lit(1).alias("pos"), F.col("p_name").alias("name"), F.lit("VARCHAR(20)").alias("type"))
    made = S.catalog_proposals(assets, columns, dag.select(F.col("node").alias("asset"), F.col("dep").alias("upstream")), "product")
    return made.groupBy("asset").agg(F.count("*").alias("n_documents"))


@query("""SELECT node AS asset, to_json({'product': 'shop', 'asset': node, 'subtype': 'VIEW', 'fields': [{'pos': 1, 'name': p_name, 'type': p_type, 'class': 'OTHER'}, {'pos': 2, 'name': 'n', 'type': 'decimal(9,2)', 'class': 'NUMBER'}], 'upstreams': list(dep ORDER BY dep)})::VARCHAR AS document
    FROM <dag> JOIN part ON p_partkey = node GROUP BY node, p_name, p_type""")
def catalog_documents(t):
    """The documents themselves, fields by position and upstream lists included."""
    dag = t("dag")
    field = lambda n, name, kind: F.struct(F.lit(n).alias("pos"), name.alias("name"), kind.alias("type"))
    two = F.array(field(2, F.lit("n"), F.lit("decimal(9,2)")), field(1, F.col("p_name"), F.col("p_type")))
    columns = t("part").select(F.col("p_partkey").alias("asset"), F.explode(two).alias("c")).select("asset", "c.*")
    return S.catalog_proposals(dag.select(F.col("node").alias("asset")).distinct().withColumn("subtype", F.lit("VIEW")), columns, dag.select(F.col("node").alias("asset"), F.col("dep").alias("upstream")), "shop", "nested")


@query("""SELECT 'shop' AS entity, 'properties' AS aspect, to_json({'product': 'shop', 'version': '2', 'environment': 'DEV'})::VARCHAR AS document UNION ALL SELECT DISTINCT 'shop', 'member', to_json({'product': 'shop', 'asset': node::VARCHAR})::VARCHAR FROM <dag>""")
def product_entity(t):
    return S.product_proposals(t("dag").select(F.col("node").alias("asset")), "shop", version="2", environment="DEV")


@query("SELECT p_size AS env, 'K' || p_partkey % 7 AS name, 'v=' || max(p_partkey) AS value FROM part GROUP BY 1, 2")
def kv_last_wins(t):
    line = F.concat(F.lit(" K"), F.col("p_partkey") % 7, F.lit(" = v="), "p_partkey", F.lit(" "))
    texts = t("part").groupBy(F.col("p_size").alias("env")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n# note = no\n").alias("text"))
    return S.parse_kv(texts).select("env", "name", "value")


@query("""SELECT 'D' || p_partkey AS src, 'D' || (p_partkey // 2)::BIGINT AS dst FROM part WHERE p_partkey > 0 AND p_partkey % 10 < 7 AND (p_partkey // 2) % 10 < 7""")
def container_edges(t):
    created = t("part").where("p_partkey % 10 < 7")
    return G.container_edges(created.select(F.concat(F.lit("D"), "p_partkey").alias("name"), F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 2)).alias("parent")))

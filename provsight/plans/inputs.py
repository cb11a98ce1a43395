"""Inputs of the checks, derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Written as format templates: {orders} is the table, a doubled brace is one brace.
SQL = {
    "dag": """select p_partkey as node, cast(floor(p_partkey / 2.0) as bigint) as dep from {part} where p_partkey >= 2
        union select p_partkey, cast(floor(p_partkey / 3.0) as bigint) from {part} where p_partkey >= 3""",
    "hist": """select o_custkey as k, o_orderkey as version_id, o_orderstatus, o_orderdate as valid_from,
        coalesce(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), {high}) as valid_to,
        case when lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) is null then 1 else 0 end as is_current,
        case when o_orderkey % 17 = 0 then 1 else 0 end as is_deleted from {orders}""",
    "stmt": """select o_orderkey as stmt_id, case o_orderkey % 5
        when 0 then concat('REPLACE VIEW V', o_custkey % 7, '.W', o_orderkey, ' AS SELECT a FROM T', o_custkey % 5, '.H', o_orderkey % 50,
                           ' x LEFT JOIN T', o_orderkey % 3, '.H', o_custkey % 50, ' y ON x.k = y.k')
        when 1 then concat('CREATE TABLE T', o_custkey % 5, '.H', o_orderkey % 50, ' (k INTEGER NOT NULL)')
        when 2 then concat('INSERT INTO T', o_custkey % 5, '.H', o_orderkey % 50, ' SELECT k FROM {{{{DB_', o_custkey % 9, '}}}}.S',
                           o_orderkey % 20, ' /* FROM NO.ISE */')
        when 3 then concat('DROP TABLE T', o_custkey % 5, '.H', o_orderkey % 50)
        else concat('UPDATE V', o_custkey % 7, '.W', o_orderkey % 100, ' SET p = $VAR_', o_custkey % 4, ' -- FROM NO.ISE') end as body
        from {orders}""",
    "grants": """select distinct concat('G', l_suppkey % 20) as grantee, concat('D', l_partkey % 15) as grantor,
        case l_returnflag when 'A' then 'SELECT' when 'N' then 'INSERT' else 'UPDATE' end as privilege from {lineitem}""",
    "grants_expected": """select distinct concat('G', l_suppkey % 20) as grantee, concat('D', l_partkey % 15) as grantor,
        case l_returnflag when 'A' then 'SELECT' when 'N' then 'INSERT' else 'UPDATE' end as privilege from {lineitem}
        where l_linenumber <= 3 and l_suppkey % 20 <> 7""",
    "grants_actual": """select distinct concat('G', l_suppkey % 20) as grantee, concat('D', l_partkey % 15) as grantor,
        case l_returnflag when 'A' then 'SELECT' when 'N' then 'INSERT' else 'UPDATE' end as privilege from {lineitem}
        where l_linenumber >= 2 and l_suppkey % 20 <> 3 and l_partkey % 2 = 0""",
    "tagged": """select event_id, ts, user_id, concat('BUILD=', user_id % 4, ';PKG=', event_type, ';ENV=',
        case when event_id % 2 = 0 then 'DEV' else 'PRD' end, case when event_id % 7 < 5 then concat(';WAVE=', event_id % 7) else '' end, ';') as tag from {events}""",
    "states": """select event_id as seq, ts, concat('OBJ', user_id) as object, case event_type when 'signup' then 'PENDING' when 'view' then 'CREATED'
        when 'click' then 'MIGRATED' when 'purchase' then 'COMPLETED' else 'FAILED' end as state,
        case when event_type not in ('signup', 'view', 'click', 'purchase') then concat('E', event_id % 9) end as error,
        case when event_id % 11 = 0 then null else event_id % 6 end as wave from {events}""",
    "decls": """select p_partkey as node, cast(floor(p_partkey / 2.0) as bigint) as parent, case when p_partkey % 13 = 0 then null else p_size end as bytes
        from {part} where p_partkey >= 1""",
    "uses": """select stmt_id % 2 as env, stmt_id, concat('DB_', stmt_id % 9) as token from (select o_orderkey as stmt_id from {orders}) o where stmt_id % 5 = 2""",
    "defs": """select distinct e.env, concat('DB_', o_custkey % 11) as token,
        case when o_custkey % 11 = 4 then '' else concat('VAL', o_custkey % 11 % 5) end as value
        from {orders}, (select 0 as env union all select 1 as env) e where (e.env = 0 and o_custkey % 11 < 7) or (e.env = 1 and o_custkey % 11 >= 3)""",
    "issues": """select d.doc_id, d.source, case when l.toxic = 1 then 'error' when l.quality = 0 then 'warning' else 'info' end as severity
        from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "cols_old": """select concat('T', p_size) as tab, concat('C', p_partkey % 40) as name, max(case p_partkey % 4 when 0 then 'INTEGER' when 1 then 'VARCHAR'
        when 2 then 'DECIMAL' else case p_partkey % 8 when 3 then 'CHAR' else 'BYTE' end end) as type, max(p_partkey % 7 * 10 + 10) as length, min(p_partkey) as pos from {part} where p_partkey % 5 <> 0 group by 1, 2""",
    "cols_new": """select concat('T', p_size) as tab, concat('C', p_partkey % 40) as name, max(case p_partkey % 6 when 0 then 'INTEGER' when 1 then 'VARCHAR'
        when 2 then 'BIGINT' when 3 then 'CHAR' when 4 then 'DATE' else 'VARBYTE' end) as type, max(p_partkey % 5 * 10 + 10) as length,
        max(-p_partkey) as pos, max(case when p_partkey % 3 = 0 then 1 else 0 end) as not_null, max(case when p_partkey % 2 = 0 then 1 else 0 end) as has_default
        from {part} where p_partkey % 7 <> 0 group by 1, 2""",
    "rel": """select concat('N', n_nationkey) as src, concat('R', n_regionkey) as dst, 'n_regionkey = r_regionkey' as cond from {nation}
        union all select concat('P', p_partkey), concat('P', cast(floor(p_partkey / 2.0) as bigint)), concat('part_of ', p_size) from {part} where p_partkey > 0
        union all select concat('R', r_regionkey), concat('R', (r_regionkey + 1) % 5), 'next' from {region}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived input, as a DataFrame."""
    return table(spark, sf_dir, name) if name in TABLES else sql(spark, sf_dir, SQL[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    needed = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{high}", "timestamp_ntz '9999-12-31 00:00:00'"), **needed) if needed else spark.sql(text)


def duck(name: str) -> str:
    """The same input in DuckDB's SQL, as a parenthesised subquery or a table's name."""
    if name in TABLES:
        return name
    return "(" + SQL[name].format(high="timestamp '9999-12-31 00:00:00'", **{t: t for t in TABLES}) + ")"

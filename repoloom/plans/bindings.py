"""Views that read the star-schema test tables as a code estate.

The SQL runs unchanged in Spark and in DuckDB, so the same text defines the
input of a query and of its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_NAME = "concat('c', cast({0} as varchar(20)))"
_PAIRS = """
select distinct pa.p_brand as repo, concat('c', cast(a.l_partkey as varchar(20))) as source,
  concat('c', cast(b.l_partkey as varchar(20))) as target
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
join part pa on pa.p_partkey = a.l_partkey join part pb on pb.p_partkey = b.l_partkey
where pa.p_brand = pb.p_brand and a.l_partkey {0} b.l_partkey"""

VIEWS: dict[str, str] = {
    "e_components": """
select p_brand as repo, concat('c', cast(p_partkey as varchar(20))) as name, p_partkey as ordinal,
  case p_type when 'STANDARD' then 'library' when 'ECONOMY' then 'service' when 'MEDIUM' then 'cli'
              when 'PROMO' then 'frontend' when 'SMALL' then 'pipeline' else 'contract' end as kind,
  case p_size % 4 when 0 then 'go-module' when 1 then 'rust-crate' when 2 then 'python-package'
              else 'typescript-package' end as type,
  concat(lower(p_type), '/c', cast(p_partkey as varchar(20))) as root_path
from part""",
    "e_edges": _PAIRS.format("<>"),
    "e_edges_acyclic": _PAIRS.format(">"),
    "e_services": """
select concat('s', cast(s_suppkey as varchar(20))) as id, s_name as name,
  case s_nationkey % 4 when 0 then 'database' when 1 then 'cache' when 2 then 'object_storage' else 'other' end as category
from supplier""",
    "e_integrations": """
select distinct p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as source,
  concat('s', cast(l_suppkey as varchar(20))) as target
from lineitem join part on p_partkey = l_partkey""",
    "e_files": """
select distinct regexp_extract(url, '^https?://([^/]+)', 1) as repo,
  regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) as path
from pages""",
    "e_roots": """
select distinct regexp_extract(url, '^https?://([^/]+)', 1) as repo,
  regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) as name
from pages where regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) <> 'en'""",
    "e_docs": """
select source as repo, concat('docs/d', cast(doc_id as varchar(20)), '.md') as path, text as content from documents""",
    "e_docs_next": """
select source as repo, concat('docs/d', cast(d.doc_id as varchar(20)), '.md') as path,
  case when l.quality = 0 then upper(text) else text end as content
from documents d left join labels l on l.doc_id = d.doc_id
where coalesce(l.toxic, 0) = 0
union all
select 'benchmark' as repo, concat('docs/b', cast(item_id as varchar(20)), '.md') as path, text as content from benchmark""",
    "e_citations": """
select distinct p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as component, l_orderkey as idx_key,
  concat(lower(p_type), '/c', cast(l_partkey as varchar(20)), '/f', cast(l_suppkey as varchar(20)), '.py') as file_path,
  l_linenumber as start_line, l_linenumber + cast(l_quantity as int) as end_line, concat(l_returnflag, l_linestatus) as claim
from lineitem join part on p_partkey = l_partkey""",
    "e_usage": """
select conv_id as seq, sum(case when role <> 'assistant' then length(text) else 0 end) as input_tokens,
  sum(case when role = 'assistant' then length(text) else 0 end) as output_tokens
from conversations group by conv_id""",
    "e_corpus": """
select c_custkey as repo_id, c_name as full_name, c_mktsegment as language,
  cast(round(c_acctbal * 100) as bigint) as stars, (c_custkey * 211) % 400000 as size_kb
from customer""",
    "e_audit_kinds": """
select p_brand as repo, concat('c', cast(p_partkey as varchar(20))) as component,
  case when p_size % 7 = 0 then 'infra' when p_type = 'STANDARD' then 'library' when p_type = 'ECONOMY' then 'service'
       when p_type = 'MEDIUM' then 'cli' when p_type = 'PROMO' then 'frontend' when p_type = 'SMALL' then 'pipeline'
       else 'contract' end as proposed
from part""",
    "e_audit_edges": """
select distinct p_brand as repo, concat('c', cast(l_partkey as varchar(20))) as source,
  concat('c', cast(l_orderkey % 1000 as varchar(20))) as target,
  case l_suppkey % 4 when 0 then 'import' when 1 then 'path_dep' when 2 then 'http_call' else 'unknown' end as evidence_type
from lineitem join part on p_partkey = l_partkey""",
    "e_missed": """
select distinct p_brand as repo, concat('m', cast(s_suppkey as varchar(20))) as proposed_name
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey
where l_returnflag = 'R' and l_linestatus = 'O'""",
    "e_artifacts": """
select source as service, concat(case doc_id % 4 when 0 then 'service_discovery' when 1 then 'dependency_graphs'
  when 2 then 'service_analyses' else 'architecture_docs' end, '/d', cast(doc_id as varchar(20)),
  case lang when 'en' then '.md' when 'fr' then '.json' when 'de' then '.md' else '.txt' end) as path, text as content
from documents""",
    "e_traces": """
select event_id as sequence_id, user_id as session_id, event_type as action, ts, value as duration_ms,
  case when event_type = 'error' then props else null end as error
from events""",
}


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the Parquet tables and the estate views of ``sf_dir`` (once per session)."""
    if spark.conf.get("repoloom.tables", None) == sf_dir and spark.catalog.tableExists("e_traces"):
        return
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    spark.conf.set("repoloom.tables", sf_dir)


def oracle(sql: str, *views: str) -> str:
    """``sql`` with the named estate views as leading common table expressions."""
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in views)
    if not views:
        return sql
    rest = sql.lstrip()
    return f"with {head}, {rest[5:]}" if rest.lower().startswith("with ") else f"with {head}\n{sql}"


def view(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)

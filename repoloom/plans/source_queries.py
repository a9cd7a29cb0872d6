"""Queries over sources: files, snapshots, corpora, traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from repoloom.plans.bindings import oracle, view
from repoloom.plans.registry import query
from repoloom.runtime import stage, stage_root
from repoloom.sources import files as files_
from repoloom.sources import tables as tables_


def scratch(spark, label: str) -> str:
    """A fresh folder below the shared one, for tables that a query writes itself."""
    return f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


_TREE = """
select repo, concat(root_path, '/', case type when 'go-module' then 'go.mod' when 'rust-crate' then 'Cargo.toml'
  when 'python-package' then 'pyproject.toml' else 'package.json' end) as path from e_components
union all select repo, concat(root_path, '/README.md') as path from e_components
union all select repo, concat(root_path, '/setup.py') as path from e_components where type = 'python-package'"""


@query("src1_scan_repos", oracle(
    "select repo, cast(count(*) as bigint) as docs, cast(sum(octet_length(encode(content)) + 1) as bigint) as bytes from e_docs group by repo", "e_docs"))
def scan(spark, sf_dir):
    root = scratch(spark, "tree")
    # every document of a repository follows the other in its files
    view(spark, "e_docs").select("repo", F.col("content").alias("value")).write.partitionBy("repo").option("lineSep", "\u0001").text(root)
    found = files_.scan_repos(spark, root, "*.txt")
    docs = F.size(F.split("content", "\u0001")) - 1
    return found.groupBy(F.substring_index("repo", "=", -1).alias("repo")).agg(F.sum(docs).alias("docs"), F.sum("size_bytes").alias("bytes"))


@query("src2_glob_files", oracle(
    "select repo, path, row_number() over (partition by repo order by string_split(path, '/')) as pos "
    "from e_files where regexp_matches(path, '^[^/]*/[^/]*$')", "e_files"))
def glob(spark, sf_dir):
    return files_.glob_files(view(spark, "e_files"), "*/*")


@query("src2_glob_overflow", oracle(
    "select repo, count(*) as matches, greatest(count(*) - 3, 0) as more from e_files where regexp_matches(path, '^(.*/)?[^/]*[.]html$') group by repo",
    "e_files"))
def glob_over(spark, sf_dir):
    return files_.glob_overflow(view(spark, "e_files"), "**/*.html", cap=3)


@query("src3_match_manifests", oracle(
    f"select repo, path, case when path like '%go.mod' then 'go' when path like '%Cargo.toml' then 'rust' "
    f"when path like '%package.json' then 'typescript' else 'python' end as ecosystem, "
    f"case when path like '%go.mod' then 0 when path like '%Cargo.toml' then 3 when path like '%package.json' then 2 else 1 end as precedence, "
    f"case when path like '%setup.py' then 1 else 0 end as pattern from ({_TREE}) t where path not like '%README.md'", "e_components"))
def manifests(spark, sf_dir):
    return files_.match_manifests(spark.sql(_TREE))


@query("src4_exclude_paths", oracle(
    "select repo, path, regexp_matches(path, '(^|/)(en|fr)/') as in_folder, "
    "(contains(path, 'en') or contains(path, '5')) as has_text from e_files", "e_files"))
def exclude(spark, sf_dir):
    path = F.col("path")
    return view(spark, "e_files").select(
        "repo", "path", files_.excluded(path, ["**/en/**", "**/fr/**"]).alias("in_folder"),
        files_.excluded(path, ["**/en/**", "**/5/**"], mode="substring").alias("has_text"),
    )


_VENDOR = """
select repo, concat(root_path, '/foundry.toml') as path from e_components where kind = 'contract'
union all
select c.repo, concat(c.root_path, '/lib/', i.target, '/foundry.toml') as path from e_components c join e_integrations i on i.repo = c.repo and i.source = c.name"""


@query("src5_exclude_vendored", oracle(
    "select repo, concat(root_path, '/foundry.toml') as path from e_components where kind = 'contract' union all "
    "select c.repo, concat(c.root_path, '/lib/', i.target, '/foundry.toml') as path from e_components c "
    "join e_integrations i on i.repo = c.repo and i.source = c.name where c.kind <> 'contract'", "e_components", "e_integrations"))
def vendored(spark, sf_dir):
    return files_.exclude_vendored(spark.sql(_VENDOR))


_LINES = """
select repo, path, case when parts[-1] = '' then parts[:-2] else parts end as parts
from (select repo, path, string_split_regex(content, '\\r\\n|\\r|\\n') as parts from e_docs) s"""


@query("src6_read_lines", oracle(
    f"select repo, path, cast(i as int) as line_no, parts[i] as line, "
    f"cast(len(parts) as int) as total_lines, cast(null as varchar) as note "
    f"from (select *, unnest(range(1, len(parts) + 1)) as i from ({_LINES}) l) r", "e_docs"))
def read(spark, sf_dir):
    return files_.read_lines(view(spark, "e_docs"))


_GREP = r"[A-Za-z0-9._]+@[a-z]+\.|License"


@query("src7_grep", oracle(
    f"select repo, path, line_no, line from (select repo, path, cast(i as int) as line_no, parts[i] as line from (select *, unnest(range(1, len(parts) + 1)) as i from ({_LINES}) l) r) x "
    f"where regexp_matches(line, '{_GREP}')", "e_docs"))
def grep(spark, sf_dir):
    return files_.grep(view(spark, "e_docs"), _GREP, include="*.md")


@query("src7_grep_overflow", oracle(
    f"select repo, count(*) as matches, greatest(count(*) - 5, 0) as more from (select repo, unnest(parts) as line from ({_LINES}) l) r "
    f"where regexp_matches(line, '{_GREP}') group by repo", "e_docs"))
def grep_over(spark, sf_dir):
    return files_.grep_overflow(view(spark, "e_docs"), _GREP, cap=5)


@query("src8_load_components", oracle(
    "select c.repo, c.name, c.kind, c.type, c.root_path, i.target as ext, 'c0' as dep from e_components c "
    "left join (select repo, source, min(target) as target from e_integrations group by all) i on i.repo = c.repo and i.source = c.name",
    "e_components", "e_integrations"))
def load(spark, sf_dir):
    docs = spark.sql("""
        select c.repo, to_json(struct(c.name, c.kind, c.type, c.root_path, array('c0') as internal_dependencies,
            case when i.target is null then array() else array(i.target) end as external_dependencies)) as one, c.kind
        from e_components c left join (select repo, source, min(target) as target from e_integrations group by all) i
          on i.repo = c.repo and i.source = c.name""")
    one = F.col("one")
    wrapped = F.when(F.col("kind") == "library", F.concat(F.lit("["), one, F.lit("]"))).otherwise(
        F.concat(F.lit('{"components": ['), one, F.lit("]}")))
    got = tables_.components_from_json(docs.select("repo", wrapped.alias("content")))
    return got.select("repo", "name", "kind", "type", "root_path", F.get("external_dependencies.name", F.lit(0)).alias("ext"), F.get("internal_dependencies", F.lit(0)).alias("dep"))


def _write_inventories(root: str):
    """One components.json per repository and bucket."""
    def write(key, rows):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        folder = f"{at}/{key[0].replace('#', '-')}/{key[1]}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/components.json") as out:
            out.write(('{"components": [' + ",".join(rows["one"]) + "]}").encode())
        return rows[["repo"]].head(1)

    return write


@query("src8_load_dependencies", oracle(
    "select c.repo, c.name, c.kind, c.type, c.root_path, d.scope, d.dependency from e_components c left join ("
    "select repo, source, 'external' as scope, target as dependency from e_integrations "
    "union all select repo, source, 'internal' as scope, target as dependency from e_edges) d on d.repo = c.repo and d.source = c.name",
    "e_components", "e_integrations", "e_edges"))
def load_files(spark, sf_dir):
    root = scratch(spark, "inventories")
    docs = spark.sql("""
        select c.repo, c.ordinal div 5000 as bucket, to_json(struct(c.name, c.kind, c.type, c.root_path,
            coalesce(e.targets, array()) as internal_dependencies, coalesce(i.targets, array()) as external_dependencies)) as one
        from e_components c
        left join (select repo, source, collect_list(target) as targets from e_integrations group by all) i on i.repo = c.repo and i.source = c.name
        left join (select repo, source, collect_list(target) as targets from e_edges group by all) e on e.repo = c.repo and e.source = c.name""")
    docs.groupBy("repo", "bucket").applyInPandas(_write_inventories(root), "repo string").count()
    got = tables_.load_components(spark, root)
    both = F.concat(
        F.transform("external_dependencies", lambda d: F.struct(F.lit("external").alias("scope"), d["name"].alias("dependency"))),
        F.transform("internal_dependencies", lambda d: F.struct(F.lit("internal").alias("scope"), d.alias("dependency"))))
    return got.select(F.replace("repo", F.lit("-"), F.lit("#")).alias("repo"), "name", "kind", "type", "root_path", F.explode_outer(both).alias("d")).select(
        "repo", "name", "kind", "type", "root_path", "d.scope", "d.dependency")


@query("src9_latest_manifest", """
select o_custkey as service, max(o_orderkey) as version, arg_max(o_orderpriority, o_orderkey) as model,
  arg_max(o_orderstatus, o_orderkey) as source_commit from orders group by o_custkey""")
def latest(spark, sf_dir):
    runs = spark.table("orders").selectExpr("o_custkey as service", "o_orderkey as version", "o_orderpriority as model", "o_orderstatus as source_commit")
    return tables_.latest_manifest(runs)


@query("src10_changed_files", oracle(
    "select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, "
    "case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end as change "
    "from e_docs a full join e_docs_next b on a.repo = b.repo and a.path = b.path "
    "where a.content is distinct from b.content", "e_docs", "e_docs_next"))
def changed(spark, sf_dir):
    return tables_.changed_files(view(spark, "e_docs"), view(spark, "e_docs_next"))


@query("src10_folder_digests", oracle("""
with hashed as (select repo, path, sha256(concat(path, chr(10), sha256(content))) as h from e_docs),
spread as (select repo, array_to_string(string_split(path, '/')[1:i], '/') as folder, h
  from (select *, unnest(range(0, len(string_split(path, '/')))) as i from hashed) u),
total as (select repo, folder, count(*) as files,
    sum(cast(cast('0x' || substr(h, 1, 15) as bigint) as hugeint)) as a, sum(cast(cast('0x' || substr(h, 16, 15) as bigint) as hugeint)) as b,
    sum(cast(cast('0x' || substr(h, 31, 15) as bigint) as hugeint)) as c, sum(cast(cast('0x' || substr(h, 46, 15) as bigint) as hugeint)) as d
  from spread group by repo, folder)
select repo, folder, files, sha256(concat_ws(':', cast(files as varchar), cast(a as varchar), cast(b as varchar), cast(c as varchar), cast(d as varchar))) as digest from total""", "e_docs"))
def folder_digests(spark, sf_dir):
    return tables_.folder_digests(tables_.file_digests(view(spark, "e_docs")))


@query("src10_changed_below", oracle(
    "select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, "
    "case when a.path is null then 'added' when b.path is null then 'removed' else 'modified' end as change "
    "from e_docs a full join e_docs_next b on a.repo = b.repo and a.path = b.path "
    "where a.content is distinct from b.content", "e_docs", "e_docs_next"))
def changed_below(spark, sf_dir):
    # the earlier snapshot is known by its kept digests alone
    kept, _ = stage(tables_.file_digests(view(spark, "e_docs")), "file-digests")
    folders, _ = stage(tables_.folder_digests(kept), "folder-digests")
    return tables_.changed_below(kept, view(spark, "e_docs_next"), folders)


@query("src11_select_corpus", oracle("""
select repo_id, full_name, language, stars, size_kb, pick from (
  select *, row_number() over (partition by language order by r) as pick from (
    select *, row_number() over (partition by language order by stars desc, full_name) as r from e_corpus) a
  where r <= 8 and size_kb <= 200000) b where pick <= 4""", "e_corpus"))
def corpus(spark, sf_dir):
    return tables_.select_corpus(view(spark, "e_corpus"))


@query("src11_select_from_all", oracle("""
select repo_id, full_name, language, stars, size_kb, pick from (
  select *, row_number() over (partition by language order by stars desc, full_name) as pick from e_corpus where size_kb <= 100000) a
where pick <= 4""", "e_corpus"))
def corpus_of_all(spark, sf_dir):
    return tables_.select_corpus(view(spark, "e_corpus"), max_size_kb=100_000, pool=None)


@query("src12_load_audits", """
select c_name as full_name, 'ok' as status, replace(c_name, '/', '__') as slug, n as audits
from customer join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey where c_acctbal > 0""")
def audits(spark, sf_dir):
    found = spark.sql("select c_name as full_name, case when c_acctbal > 0 then 'ok' else 'clone_failed' end as status from customer")
    done = spark.sql("select replace(c_name, '/', '__') as slug, count(*) as audits from orders join customer on o_custkey = c_custkey group by 1")
    return tables_.load_audits(found, done)


@query("src13_load_traces", """
select action, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(sum(epoch_us(ts)) // 1000000 as bigint) as secs, count(error) as errors
from (select event_id, ts, event_type as action, case when event_type = 'error' then props end as error from events) e group by action""")
def traces(spark, sf_dir):
    path = scratch(spark, "jsonl")
    view(spark, "e_traces").select(
        F.lit("action_complete").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.col("session_id").cast("string"), "action", "sequence_id", "duration_ms", "error",
    ).write.json(path)
    got = tables_.load_traces(spark, path)
    return got.groupBy("action").agg(
        F.count("*").alias("n"), F.sum("sequence_id").alias("ids"),
        F.floor(F.round(F.sum(F.unix_micros("timestamp").cast("decimal(30,0)")) / 1000000, 6)).cast("bigint").alias("secs"),
        F.count("error").alias("errors"),
    )

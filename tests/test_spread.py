"""Work is dealt to as many tasks as it needs, and tables that grow with the files stay off the driver."""

import pytest
from pyspark.sql import functions as F

from palisade.operators import config as K
from palisade.plans.fixtures import view
from palisade.sources import records as R

FILES = "file_id string, host string, path string, snapshot_id string, text string"
N = "/etc/nginx/"


def one_group(rows, folder, name):
    rows.coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(f"{folder}/{name}.parquet")


def tasks_of(spark, folder, name):
    rows = view(spark, str(folder), name)
    return rows.count(), rows.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("name", ["recipe_records", "step_recipes"])
def test_recipes_are_dealt_to_tasks(spark, tmp_path, name):
    one_group(spark.range(25_000).selectExpr("id AS p_partkey", "'a part' AS p_name"), tmp_path, "part")
    assert tasks_of(spark, tmp_path, name) == (25_000, 3)


@pytest.mark.parametrize("name", ["exception_records", "finding_records"])
def test_records_are_dealt_to_tasks(spark, tmp_path, name):
    one_group(spark.range(120_000).selectExpr(
        "id AS o_orderkey", "id % 100 AS o_custkey", "DATE '1995-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority"), tmp_path, "orders")
    assert tasks_of(spark, tmp_path, name) == (120_000, 3)


def test_records_are_parsed_once(spark, tmp_path):
    texts = [(1, "---\nname: a\nsteps: [x, y]\n---\n"), (2, "none"), (3, None), (4, "---\n---")]
    spark.createDataFrame(texts, "ord bigint, text string").write.parquet(f"{tmp_path}/records")
    read = R.key_values(R.parse_frontmatter(spark.read.parquet(f"{tmp_path}/records")), "ord")
    assert {tuple(r) for r in read.collect()} == {(1, "name", "string", "a"), (1, "steps", "list", "x,y")}
    assert "Filter ((size(" not in plan(read)


def test_config_files_are_dealt_to_tasks(spark, tmp_path):
    one_group(spark.range(2_500).selectExpr("id AS s_suppkey"), tmp_path, "supplier")
    one_group(spark.range(1), tmp_path, "events")  # named in a text of the view, not read
    assert tasks_of(spark, tmp_path, "config_files")[1] == 3


def stored(spark, folder, rows):
    """A table of files whose size is known, and small enough to be broadcast."""
    spark.createDataFrame(rows, FILES).write.parquet(f"{folder}/files.parquet")
    return spark.read.parquet(f"{folder}/files.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def conf(path, snapshot, text, host="h"):
    return (f"{host}|{path}|{snapshot}", host, path, snapshot, text)


def test_churn_of_snapshots_is_not_broadcast(spark, tmp_path):
    files = stored(spark, tmp_path, [
        conf("a", "s1", "x\ny\ny"), conf("a", "s2", "y\nz"), conf("a", "s3", None), conf("a", "s4", "q"),
        conf("b", "s1", "only"), conf("c", "s1", "l"), conf("c", "s1", "l"), conf("c", "s2", "l"),
        conf("a", None, "no snapshot"), (None, None, "a", "s2", "no host")])
    churn = K.snapshot_churn(files)
    got = {(r.path, r.snapshot_id): (r.added, r.removed) for r in churn.collect()}
    assert got == {("a", "s2"): (1, 2), ("a", "s3"): (0, 2), ("a", "s4"): (1, 0), ("c", "s2"): (0, 1)}
    assert "Broadcast" not in plan(K.snapshot_churn(files))


def test_includes_are_not_broadcast(spark, tmp_path):
    files = stored(spark, tmp_path, [conf(N + "a", "s", "include b;\ninclude d/*;\n"), conf(N + "b", "s", ""), conf(N + "d/x", "s", "include b;\n")])
    got = {(r.root[len(N):], r.file[len(N):]): r.depth for r in K.include_expand(files).collect()}
    assert got == {("a", "b"): 1, ("a", "d/x"): 1, ("d/x", "b"): 1}
    for df in (K.resolve_includes(K.include_edges(files), files), K.compat_includes(files), K.blast_radius(files)):
        assert "Broadcast" not in plan(df)


def test_gate_meets_its_reasons_without_broadcast(spark, tmp_path):
    files = stored(spark, tmp_path, [conf("a", "s", ""), conf("b", "s", "")])
    checks = files.select("host", "path", F.lit("tls_floor").alias("check_name"), F.when(F.col("path") == "a", "fail").otherwise("pass").alias("status"))
    overall = files.select("host", "path", F.lit("edge-public").alias("profile"), F.lit("pass").alias("overall"))
    gate = K.deploy_gate(checks, overall, "edge-public", {}, {})
    assert {r.path: (r.blocked, r.reasons) for r in gate.collect()} == {"a": (True, "invariant:tls_floor"), "b": (False, "")}
    assert "Broadcast" not in plan(gate)


def test_diff_reads_lines_of_two_snapshots_only(spark, tmp_path):
    files = stored(spark, tmp_path, [conf("a", "s1", "x\ny"), conf("a", "s2", "y\nz"), conf("a", "s0", "old"), conf("a", None, "none")])
    diff = K.line_diff(files, "s1", "s2")
    assert {(r.line, r.side) for r in diff.collect()} == {("x", "removed"), ("z", "added")}
    assert "IN (s1,s2)" in plan(diff)

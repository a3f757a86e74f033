import gzip
import hashlib
import json
import os

import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import events as E
from palisade.operators import governance as Gv
from palisade.plans import fixtures
from palisade.sinks import batches as B
from palisade.sinks import outputs as K
from palisade.sources import access_log as A
from palisade.sources import configs, feeds, records
from palisade.streaming import streams as R


def test_access_logs_plain_and_gzip(spark, tmp_path):
    line = '1.2.3.4 - - [23/Mar/2026:19:15:00 +0000] "GET /.env HTTP/1.1" 404 0 "-" "Mozilla/5.0"\n'
    (tmp_path / "access.log").write_text(line + "broken\n")
    (tmp_path / "access.log.1.gz").write_bytes(gzip.compress(line.encode()))
    parsed = A.parse_access_log(A.read_access_log(spark, str(tmp_path)))
    assert A.parse_counts(parsed).first().asDict() == {"lines": 3, "parsed": 2, "skipped": 1}
    assert parsed.where("parsed").first().timestamp == "2026-03-23T19:15:00Z"


def test_parsed_events_defaults_and_fail_closed(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"remote_addr":" 1.1.1.1 ","hex_path":"2f"}]')
    row = A.read_parsed_events(spark, str(tmp_path / "ok.json")).first()
    assert (row.remote_addr, row.status, row["count"]) == ("1.1.1.1", 0, 1)
    (tmp_path / "bad.json").write_text('[{"remote_addr": ')
    with pytest.raises(Exception):
        A.read_parsed_events(spark, str(tmp_path / "bad.json")).collect()


def test_feed_files_and_cap(spark, tmp_path):
    doc = {"vulnerabilities": [{"cveID": ""}] + [{"cveID": f"CVE-{i}"} for i in range(4)]}
    (tmp_path / "kev.json").write_text(json.dumps(doc, indent=1))
    assert feeds.read_feed(spark, "cisa_kev", str(tmp_path / "kev.json")).count() == 4
    assert feeds.read_feed(spark, "cisa_kev", str(tmp_path / "kev.json"), cap=3).count() == 2
    (tmp_path / "ips.txt").write_text("1.2.3.4\nnope\n# x\n")
    assert feeds.read_feed(spark, "blocklist_de", str(tmp_path / "ips.txt")).count() == 1


def test_corpus_and_snapshots(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.conf").write_text("server {\n}\n")
    (tmp_path / "note.txt").write_text("x")
    assert [r.path.endswith("sub/a.conf") for r in configs.read_config_corpus(spark, str(tmp_path)).collect()] == [True]
    base = tmp_path / "site.conf.bak.20260323-191500"
    base.write_text("hello")
    meta = {"run_id": "r1", "size_bytes": 5, "sha256": hashlib.sha256(b"hello").hexdigest()}
    (tmp_path / (base.name + ".meta.json")).write_text(json.dumps(meta))
    (tmp_path / "site.conf.bak.20260324-000000-001").write_text("other")
    catalog = configs.snapshot_catalog(configs.read_snapshots(spark, str(tmp_path)))
    rows = {r.backup_id: r for r in catalog.collect()}
    assert rows["20260323-191500"].run_id == "r1" and rows["20260323-191500"].timestamp == "2026-03-23T19:15:00Z"
    states = {r.backup_id: r.state for r in configs.snapshot_integrity(catalog).collect()}
    assert states == {"20260323-191500": "intact", "20260324-000000-001": "no sidecar"}


def test_frontmatter(spark, tmp_path):
    (tmp_path / "r.md").write_text('---\n# c\nname: "x y"\nn: -5\nf: 1.5\nflag: true\nitems:\n  - a\n  - b\ninline: [p, "q"]\nempty:\nbad line\nname: z\n---\nbody: no\n')
    row = records.parse_frontmatter(records.read_records(spark, str(tmp_path))).first()
    got = [(e.key, e.kind, e.value, list(e["items"])) for e in row.entries]
    assert got == [("name", "string", "x y", []), ("n", "int", "-5", []), ("f", "float", "1.5", []), ("flag", "bool", "true", []),
                   ("items", "list", "", ["a", "b"]), ("inline", "list", "", ["p", "q"]), ("empty", "string", "", []), ("name", "string", "z", [])]
    assert row.parse_errors == ["unparseable: bad line"]
    none = records.parse_frontmatter(spark.createDataFrame([("plain",)], "text string")).first()
    assert none.parse_errors == ["no frontmatter"]


def test_record_without_fields_lists_them_all(spark):
    df = spark.createDataFrame([("---\ntype: attack-pattern\n---\n",)], "text string")
    assert len(Gv.validate(df, "learning").first().errors) == 6


def test_event_sink_prunes_days(spark, sf, tmp_path):
    from palisade.plans.log_queries import clean
    K.write_events(E.dedup_events(clean(spark, sf)), str(tmp_path / "ev"))
    plan = spark.read.parquet(str(tmp_path / "ev")).where("dt = '2024-01-05'")
    assert re.search(r"PartitionFilters: \[[^\]]*dt#", plan._jdf.queryExecution().toString())
    assert plan.count() > 0


# --- streams -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """Access rows as files, plus a far later row that moves the watermark past every window."""
    rows = fixtures.view(spark, sf, "access_events")
    folder = str(tmp_path_factory.mktemp("rows"))
    rows.coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(folder)
    late = rows.orderBy("ord").limit(1).withColumns({"ts": F.lit("2030-01-01 00:00:00").cast("timestamp"), "ord": F.lit(10**9).cast("bigint")})
    return rows, folder, late


def run(spark, landed, job, name):
    rows, folder, late = landed
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    import tempfile
    query = (job(stream).writeStream.outputMode("append").format("memory").queryName(name)
             .option("checkpointLocation", tempfile.mkdtemp(prefix="run-")).trigger(availableNow=True).start())
    query.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.fixture(scope="module")
def with_sentinel(spark, landed):
    rows, folder, late = landed
    late.write.mode("append").parquet(folder)
    return landed


@pytest.mark.parametrize("name,job", [
    ("hours", lambda df: R.hourly_classes(E.sanitize_events(df))),
    ("bursts", lambda df: R.burst(E.sanitize_events(df), "2 hours", "1 hour", 2)),
    ("sess", lambda df: R.sessions(E.sanitize_events(df), "60 minutes")),
])
def test_stream_equals_batch(spark, with_sentinel, name, job):
    assert run(spark, with_sentinel, job, name) == {tuple(r) for r in job(with_sentinel[0]).collect()}


def test_sessions_of_a_batch_are_those_of_the_built_in_window(spark):
    # Whole seconds around the gap, so that requests exactly one gap apart occur; one source holds half of the rows.
    rows = spark.range(6000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN '1.1.1.1' ELSE concat('2.2.2.', cast(id % 40 as string)) END AS remote_addr", "id % 5 AS count",
        "timestamp_seconds(-2000000 + pmod(xxhash64(id), 4000000)) AS ts", "id")
    rows = rows.selectExpr("* except (ts, id)", "CASE WHEN id % 97 > 0 THEN ts END AS ts")
    for gap in ("10 seconds", "700 seconds", "1 hour"):
        built_in = (rows.groupBy(F.session_window("ts", gap).alias("w"), "remote_addr")
                    .agg(F.count(F.lit(1)).alias("requests"), F.sum("count").alias("hits"))
                    .select(F.date_format("w.start", R.ISO), F.date_format("w.end", R.ISO), "remote_addr", "requests", "hits"))
        assert sorted(map(tuple, R.sessions(rows, gap).collect())) == sorted(map(tuple, built_in.collect()))


def test_requests_one_gap_apart(spark):
    rows = spark.createDataFrame([("a", 1, t) for t in (0, 11, 21, 32, 32)], "remote_addr string, count bigint, s bigint").selectExpr(
        "*", "timestamp_seconds(s) AS ts")
    assert sorted((r.start[-2:], r.end[-2:], r.requests) for r in R.sessions(rows, "10 seconds").collect()) == [
        ("00", "10", 1), ("11", "31", 2), ("32", "42", 2)]


def test_day_sketches_fold_to_the_summary(spark, landed, tmp_path):
    rows = E.sanitize_events(landed[0]).select("ord", "ts", "timestamp", "count", *E.DISTINCT)
    exact, near = E.traffic_summary(rows).first(), E.traffic_summary(rows, approximate=True).first()
    assert near.asDict().keys() == exact.asDict().keys()
    for name, value in exact.asDict().items():
        assert abs(near[name] - value) <= 0.03 * value if name in E.DISTINCT.values() else near[name] == value
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (0, 1):
        rows.where(f"ord % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        R.stream_traffic(spark.readStream.schema(rows.schema).parquet(source), out, ck).awaitTermination()
    assert E.summary_of(B.read_batches(spark, out)).first() == near
    by_day = {r.dt: r.rows for r in E.summary_of(B.read_batches(spark, out).withColumn("dt", F.col("dt").cast("string")), "dt").collect()}
    assert by_day == {r.dt: r["count"] for r in rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).count().collect()}
    empty = E.traffic_summary(rows.where("false"), approximate=True).first()
    assert (empty.rows, empty.unique_ips) == (0, 0)


def test_stream_ioc_and_dedup(spark, sf, with_sentinel):
    indicators = fixtures.view(spark, sf, "indicators")
    job = lambda df: R.ioc_hits(E.sanitize_events(df), indicators)
    got = {r for r in run(spark, with_sentinel, job, "ioc") if r[0] < 10**9}
    assert got == {tuple(r) for r in job(with_sentinel[0]).collect()}
    seen = {r for r in run(spark, with_sentinel, lambda df: R.drop_replays(df).select(*R.REPLAY_KEY, "ord"), "fresh") if r[-1] < 10**9}
    keys = [tuple(r) for r in with_sentinel[0].select(*R.REPLAY_KEY).distinct().collect()]
    assert sorted(map(str, (r[:-1] for r in seen))) == sorted(map(str, keys))


def test_rules_expire_on_event_time(spark, tmp_path):
    schema = "rule_id string, ts timestamp, kind string, profile string"
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    batches = [[("r1", "2026-01-01 00:00:00", "emergency", "edge-public"), ("r2", "2026-01-01 00:00:00", "ip", "edge-public")],
               [("r1", "2026-01-01 12:00:00", "emergency", "edge-public")],
               [("tick", "2026-01-05 00:00:00", "ioc", "edge-public")], [("tick", "2026-01-05 02:00:00", "ioc", "edge-public")]]
    for b in batches:
        spark.createDataFrame(b, "rule_id string, ts string, kind string, profile string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        query = (R.stream_rule_expiry(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append")
                 .format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", ck)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.rule_id, r.expired_at_ms) for r in out] == [("r1", 1767355200000)]


INDICATOR = "type string, value string, seen_at string, confidence double, source string"


def test_feed_upsert_keeps_latest_and_reruns_safely(spark, tmp_path):
    path = str(tmp_path / "ind")
    first = spark.createDataFrame([("ip", f"1.1.1.{k}", "2026-01-01", 0.5, "a") for k in range(40)], INDICATOR)
    second = spark.createDataFrame([("ip", "1.1.1.1", "2026-01-02", 0.9, "b")], INDICATOR)
    for n, batch in ((0, first), (1, second), (1, first.where("false")), (1, second), (2, second.where("false"))):
        R.feed_upsert(batch, n, path, 8)
    got = {(r.value, r.seen_at) for r in R.read_indicators(spark, path).collect()}
    assert got == {("1.1.1.1", "2026-01-02")} | {(f"1.1.1.{k}", "2026-01-01") for k in range(40) if k != 1}
    version, folders = R._manifest(spark, path)
    # One bucket was touched after the first batch; the others stand as they were written.
    assert version == 2 and sorted(f.split("/")[1] for f in folders.values()) == ["v=0"] * (len(folders) - 1) + ["v=1"]
    third = spark.createDataFrame([("ip", f"1.1.1.{k}", "2026-01-03", 0.5, "a") for k in range(40)], INDICATOR)
    R.feed_upsert(third, 3, path, 8)
    R.feed_upsert(third.limit(1), 4, path, 8)
    kept = sorted(os.listdir(f"{path}/data"))
    assert "v=0" not in kept and "v=1" not in kept and R.read_indicators(spark, path).where("seen_at = '2026-01-03'").count() == 40
    assert sorted(n for n in os.listdir(f"{path}/manifest")) == ["v=3", "v=4"]


def test_a_cut_short_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ind")
    row = lambda seen: spark.createDataFrame([("ip", "1.1.1.1", seen, 0.5, "a")], INDICATOR)
    R.feed_upsert(row("2026-01-01"), 0, path, 4)
    monkeypatch.setattr(R, "_manifest", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        R.feed_upsert(row("2026-01-02"), 1, path, 4)
    monkeypatch.undo()
    assert [r.seen_at for r in R.read_indicators(spark, path).collect()] == ["2026-01-01"]
    R.feed_upsert(row("2026-01-02"), 1, path, 4)
    assert [r.seen_at for r in R.read_indicators(spark, path).collect()] == ["2026-01-02"]


def test_event_sink_survives_a_kill_and_a_replay(spark, landed, tmp_path, monkeypatch):
    rows, folder, _ = landed
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    source, clean_rows = str(tmp_path / "in"), E.dedup_events(E.sanitize_events(rows))
    events = clean_rows.select("ord", "timestamp_bucket", "path_class", "count")
    start = lambda: B.stream_events(spark.readStream.schema(events.schema).parquet(source), out, ck)
    events.where("ord % 2 = 0").coalesce(1).write.mode("append").parquet(source)
    start().awaitTermination()
    events.where("ord % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    with monkeypatch.context() as m:
        m.setattr(B, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination()
    assert {r.ord for r in B.read_batches(spark, out).collect()} == {r.ord for r in events.where("ord % 2 = 0").collect()}
    start().awaitTermination()
    want = sorted((r.ord, r["count"]) for r in events.collect())
    assert sorted((r.ord, r["count"]) for r in B.read_batches(spark, out).collect()) == want
    B.write_event_batch(events.limit(3), 1, out)
    assert sorted((r.ord, r["count"]) for r in B.read_batches(spark, out).collect()) == want
    plan = B.read_batches(spark, out).where("dt = '2024-01-05'")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*dt#", plan)


def test_live_hits_see_a_new_version_of_the_indicators(spark, tmp_path):
    table, source, out, ck = (str(tmp_path / n) for n in ("ind", "in", "out", "ck"))
    rows = spark.createDataFrame([(1, "1.1.1.1", "dotfile", 2), (2, "2.2.2.2", "dotfile", 3)], "ord bigint, remote_addr string, path_class string, count bigint")
    start = lambda: R.stream_ioc(spark.readStream.schema(rows.schema).parquet(source), table, out, ck).awaitTermination()
    R.feed_upsert(spark.createDataFrame([("ip", "1.1.1.1:80", "2026-01-01", 0.5, "a")], INDICATOR), 0, table, 4)
    rows.coalesce(1).write.mode("append").parquet(source)
    start()
    R.feed_upsert(spark.createDataFrame([("ip", "2.2.2.2", "2026-01-02", 0.5, "a")], INDICATOR), 1, table, 4)
    rows.selectExpr("ord + 10 AS ord", "remote_addr", "path_class", "count").coalesce(1).write.mode("append").parquet(source)
    start()
    assert sorted(r.ord for r in B.read_batches(spark, out).collect()) == [1, 11, 12]

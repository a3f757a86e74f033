"""What must hold beyond small inputs: long chains, large numbers, bad dates, files on one side only."""

import json
import random

from palisade.operators import config as K
from palisade.operators import detect as D
from palisade.operators import events as E
from palisade.operators import governance as G
from palisade.operators import ioc as I
from palisade.sinks import outputs
from palisade.sources import access_log as A
from palisade.sources import feeds
from palisade.sources import records as rec

FILES = "file_id string, host string, path string, snapshot_id string, text string"


def conf(spark, files, snapshot="s1"):
    return spark.createDataFrame([(f"{p}|{snapshot}", "h", p, snapshot, t) for p, t in files], FILES)


def test_includes_are_followed_to_the_end(spark):
    chain = [(f"/etc/nginx/a{i}.conf", f"include a{i + 1}.conf;") for i in range(10)] + [("/etc/nginx/a10.conf", "")]
    cycle = [(f"/etc/nginx/z{i}.conf", f"include z{(i + 1) % 8}.conf;") for i in range(8)]
    files = conf(spark, chain + cycle)
    rows = K.include_expand(files).collect()
    reach = {(r.root, r.file): r.depth for r in rows}
    assert {f: d for (r, f), d in reach.items() if r == "/etc/nginx/a0.conf"} == {f"/etc/nginx/a{i}.conf": i for i in range(1, 11)}
    assert sum(r.cycle for r in rows) == 8 and reach["/etc/nginx/z0.conf", "/etc/nginx/z0.conf"] == 8
    status = {r.path: (r.status, r.detail) for r in K.compat_includes(files).collect()}
    assert status["/etc/nginx/a0.conf"] == ("pass", "") and status["/etc/nginx/z3.conf"] == ("fail", "circular")
    outside = K.compat_includes(conf(spark, [("/etc/nginx/n.conf", "include /opt/x.conf;"), ("/opt/x.conf", "")])).collect()
    assert {r.path: r.status for r in outside} == {"/etc/nginx/n.conf": "warn", "/opt/x.conf": "pass"}


def test_files_on_one_side_only(spark):
    rule = "location ~ /x { return 404; }"
    files = conf(spark, [("/etc/nginx/gone.conf", rule)], "a").unionByName(conf(spark, [("/etc/nginx/new.conf", rule)], "b"))
    pairs = K.snapshot_pairs(K.parse_files(files), "a", "b")
    status = {r.path: r.status for r in K.inv_additive(pairs).collect()}
    assert status == {"/etc/nginx/gone.conf": "fail", "/etc/nginx/new.conf": "pass"}


def test_ids_beyond_four_digits(spark):
    taken = spark.createDataFrame([("NH-LOG-SCAN-9999",), ("NH-LOG-SCAN-10000",), ("NH-LOG-SCAN-10001",)], "finding_id string")
    new = spark.createDataFrame([(1, "LOG", "SCAN"), (2, "LOG", "SCAN")], "ord bigint, source string, category string")
    first = G.finding_id_assign(new, taken).select("finding_id")
    assert sorted(r[0] for r in first.collect()) == ["NH-LOG-SCAN-10002", "NH-LOG-SCAN-10003"]
    again = G.finding_id_assign(new, taken.unionByName(first))
    assert sorted(r.finding_id for r in again.collect()) == ["NH-LOG-SCAN-10004", "NH-LOG-SCAN-10005"]
    notes = spark.createDataFrame([("f", "see NH-LOG-SCAN-10001 and NH-LOG-SCAN-1000")], "file string, text string")
    assert {r.finding_id for r in G.finding_trace(notes).collect()} == {"NH-LOG-SCAN-10001", "NH-LOG-SCAN-1000"}
    assert G.lifecycle_status(notes).count() == 2


def test_bad_dates_end_nothing(spark):
    rows = [("E1", 1, "soon", "high", "2026-01-01"), ("E2", 2, "2026-03-20", "high", "2026-01-01"), ("E3", 3, "2026-03-20", "low", "2026-01-01")]
    df = spark.createDataFrame(rows, "exception_id string, ord bigint, review_by string, severity_tier string, last_reviewed_at string")
    assert {r.exception_id: r.state for r in G.exception_state(df, "2026-02-01").collect()} == {"E1": "invalid", "E2": "expiring", "E3": "active"}


def test_compaction_keeps_every_row_somewhere(spark):
    rows = [(f"L{i}", "dotfile", "active", "2024-02-01", 1, f"10.0.0.{i:03d}") for i in range(60)]
    rows += [("OLD", "php", "draft", "2023-01-01", 5, "1.1.1.1"), ("ODD", "php", "draft", "lately", 2, "1.1.1.2"), ("P", "php", "promoted", "2023-01-01", 7, "1.1.1.3")]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "learning_id string, path_class string, status string, discovered string, hit_count bigint, source_ip string, last_seen string")
    out = {r.learning_id: r for r in G.learning_compact(df, "2024-02-05").collect()}
    assert {k: r.action for k, r in out.items()} == {"merged-dotfile": "merged", "merged-php": "merged", "OLD": "archived", "P": "kept"}
    assert len(out["merged-dotfile"].source_ips.split(",")) == 50
    every = G.learning_addresses(df, "2024-02-05").collect()
    assert len(every) == 61 and sum(r.shown for r in every if r.path_class == "dotfile") == 50
    record = G.compaction_record(df, G.learning_compact(df, "2024-02-05")).first()
    assert (record.rows_before, record.rows_after, record.merged, record.kept, record.archived) == (63, 3, 61, 1, 1)
    assert all(r.ok for r in G.compaction_check(df, G.learning_compact(df, "2024-02-05"), "2024-02-05").collect())


def test_feeds_survive_bad_entries(spark):
    docs = spark.createDataFrame([(json.dumps({"query_status": "ok", "data": [{"ioc_value": "x.example", "ioc_type": "domain", "confidence_level": "high"}]}),), ("{broken",)], "value string")
    assert [r.confidence for r in feeds.parse_ioc_mixed(docs).collect()] == [0.5]
    assert tuple(feeds.rejected(docs, feeds.IOCS).first()) == (2, 1)
    score = lambda kind, n: json.dumps({"vulnerabilities": [{"cve": {"id": kind, "metrics": {kind: [{"cvssData": {"baseScore": n}}]}}}]})
    cves = spark.createDataFrame([(score("cvssMetricV2", 9.8),), (score("other", 9.8),)], "value string")
    assert {r.value: r.severity for r in feeds.parse_cve_catalog(cves).collect()} == {"cvssMetricV2": "critical", "other": None}


def test_unknown_values_are_refused(spark):
    df = spark.createDataFrame([("A", "server-block", None, "1d", "feed", True), (None, None, 0.9, "1d", "feed", True), ("A", "server-block", 0.9, "1d", "feed", True),
                                ("A", "server-block", 0.9, "1d", "feed", None), ("A", "server-block", 0.9, "1d", "feed", False)],
                               "rule_class string, blast_radius string, confidence double, ttl string, provenance string, invariants_pass boolean")
    assert [list(r.refusals) for r in I.emergency_eligible(df).collect()] == [["confidence"], ["class", "scope"], [], ["invariants"], ["invariants"]]
    assert not any(r.eligible for r in I.emergency_eligible(df.drop("invariants_pass")).collect())


def test_only_the_newest_readable_exception_suppresses(spark):
    findings = spark.createDataFrame([(k, f"NH-LOG-X-000{k}") for k in range(1, 6)], "ord int, finding_id string")
    rows = [("E1", "NH-LOG-X-0001", "finding", "high", "2026-01-01", 1, "soon"), ("E2", "NH-LOG-X-0002", "finding", "high", "2026-01-01", 2, "2027-01-01"),
            ("E2", "NH-LOG-X-0002", "finding", "high", "2026-02-01", 3, "2026-02-15"), ("E3", "NH-LOG-X-0003", "invariant", "high", "2026-01-01", 4, "2027-01-01"),
            ("E4", "NH-LOG-X-0004", "finding", "high", "2026-01-01", 5, "2026-03-01")]
    exceptions = spark.createDataFrame(rows, "exception_id string, finding_id string, target_kind string, severity_tier string, last_reviewed_at string, ord int, review_by string")
    left = G.exception_suppress(findings, exceptions, "2026-03-01").collect()
    assert sorted(r.ord for r in left) == [1, 2, 3, 5]


def test_nested_steps_of_recipes(spark):
    text = "---\nsteps:\n  - action: deploy\n    params:\n      target_path: /x\n      reload_nginx: true\n      paths:\n        - a\n        - 'b'\n    action: sync-repos\n  - plain words\n  - action: [p, q]\nodd line\nsteps_after: 1\n---\n"
    row = rec.record_fields(spark.createDataFrame([(text,)], "text string"), ["steps", "steps_after", "none"], nested=True).select(
        "*", rec.item_maps("f_steps.items").alias("maps")).first()
    assert [dict(m) for m in row.maps] == [
        {"params": [], "params.target_path": ["/x"], "params.reload_nginx": ["true"], "params.paths": ["a", "b"], "action": ["sync-repos"]}, {}, {"action": ["p", "q"]}]
    assert row.parse_errors == ["unparseable: odd line"] and row.f_steps_after.value == "1" and row.f_none is None


def test_fields_equal_the_entries(spark):
    """The fast cut by last occurrence against the general one."""
    rng = random.Random(9)
    lines = ["a: 1", "a:", "a: []", "b: [x, 'y']", "  - item", "  - 5", "b: true", "c: 'q'", "# note", "", "  # far", "stray", " c: x", "c: 1.5", "a:  - z", "\t"]
    texts = ["\n\n ---\n" + "\n".join(rng.choices(lines, k=rng.randrange(9))) + "\n---\na: out" for _ in range(400)] + ["", "---", "---\na: 1", "no", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    entries = rec.parse_frontmatter(df).collect()
    fields = rec.record_fields(df, ["a", "b", "c"]).collect()
    for e, f in zip(entries, fields, strict=True):
        assert f.parse_errors == (e.parse_errors or ["no frontmatter"] * (e.parse_errors is None)), e.text
        for name in "abc":
            last = [x for x in e.entries or [] if x.key == name][-1:]
            assert ([f[f"f_{name}"][k] for k in ("kind", "value", "items")] if f[f"f_{name}"] else None) == (
                [last[0][k] for k in ("kind", "value", "items")] if last else None), e.text


def test_query_strings_count(spark):
    requests = spark.createDataFrame([("http://a.example/x?id=2", 1, "2026-01-01"), ("http://a.example/x?id=1", 1, "2026-01-01"), (None, 1, "2026-01-01")], "url string, count bigint, timestamp string")
    wanted = spark.createDataFrame([("url", "http://a.example/x?id=1"), ("url", "http://a.example/x")], "type string, value string")
    assert {r.value: r.match_count for r in I.ioc_match_url(requests, wanted).collect()} == {"http://a.example/x?id=1": 1, "http://a.example/x": 2}


def test_reports_are_whole(spark):
    detail = spark.createDataFrame([(f"c{i}", i) for i in range(80)], "name string, hits bigint")
    rows = outputs.report_json(detail.groupBy().count(), detail).collect()
    assert [json.loads(r.report)["totals"]["count"] for r in rows if r.part == 0] == [80]
    assert {json.loads(r.report)["row"]["hits"] for r in rows if r.part == 1} == set(range(80))


def test_tls_lists_in_any_order(spark):
    files = [(f"/etc/nginx/{i}.conf", f"ssl_protocols {p};") for i, p in enumerate(["TLSv1.3", "TLSv1.3 TLSv1.2", "TLSv1.1 TLSv1.2"])]
    audit = K.static_audit(K.parse_files(conf(spark, files))).where("check_name = 'tls_protocols'")
    assert [r.passed for r in audit.orderBy("path").collect()] == [True, True, False]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name in ("b.log", "a.log"):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = A.read_access_log(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.ord for r in rows] == list(range(6000))
    assert [r.value for r in rows] == [f"{n} line {i}" for n in ("a.log", "b.log") for i in range(3000)]


def test_lines_meet_their_blocks_without_a_shuffle(spark, tmp_path):
    for name in ("b.log", "a.log", "c.log"):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(50)) if name != "c.log" else "")
    rows = A.read_access_log(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    wide = A.in_file_order(A._placed(spark.read.text(str(tmp_path)), "value"), most=0)
    assert sorted(map(tuple, wide.select("ord", "value").collect())) == sorted(map(tuple, rows.select("ord", "value").collect()))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.log").write_text("")
    assert A.read_access_log(spark, str(tmp_path / "none")).count() == 0


def test_parsed_events_are_numbered_over_files(spark, tmp_path):
    for name, first in (("b.json", 3), ("a.json", 0)):
        (tmp_path / name).write_text("[" + ",".join(f'{{"method": "GET", "bytes": {first + i}}}' for i in range(3)) + "]")
    rows = A.read_parsed_events(spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.bytes) for r in rows) == [(i, i) for i in range(6)]


def test_logs_become_accepted_events(spark, tmp_path):
    line = '203.0.113.7 - - [01/Jan/2024:00:00:0{} +0000] "GET {} HTTP/1.1" 404 10 "-" "zgrab/0.x"'
    (tmp_path / "x.log").write_text("\n".join([line.format(i % 10, p) for i, p in enumerate(["/.env"] * 15 + ["/.env.local"] * 10)] + ["no log line"]))
    events = E.analyze_logs(A.read_access_log(spark, str(tmp_path))).collect()
    assert [(r.path_class, r["count"], r.safe_notes.split("(")[1], r.rate_signal, r.accepted) for r in events] == [("dotfile", 25, "15 hits)", "elevated", True)]


def test_busy_sources_are_cut_by_reach(spark):
    rows = spark.createDataFrame([(i, "1.1.1.1", "dotfile", "/health" if i % 3 == 0 else "/env" if i % 3 == 1 else "/info", i / 2) for i in range(900)],
                                 "ord bigint, remote_addr string, path_class string, path string, s double").selectExpr("*", "timestamp_micros(cast(1700000000000000 + s * 1000000 as bigint)) as ts")
    assert D.sliced(rows, 2).select("_slice").distinct().count() > 7
    assert D.burst_detect(rows).count() == 898
    found = D.sequence_probe(rows, 2, ("health", "env", "info")).collect()
    assert sorted(r.ord for r in found) == [i for i in range(900) if i % 3 == 2]


def test_other_requests_may_lie_between_the_steps(spark):
    asked = ["/a", "/x", "/b", "/a", "/x", "/c", "/d", "/b", "/c", "/d", "/d"]
    rows = spark.createDataFrame([(i, "1.1.1.1", p, float(i)) for i, p in enumerate(asked)] + [(50, "2.2.2.2", "/d", 9.0)],
                                 "ord bigint, remote_addr string, path string, s double").selectExpr("*", "timestamp_seconds(1700000000 + s) as ts")
    hits = lambda seconds: sorted(r.ord for r in D.sequence_probe(rows, seconds, ("a", "b", "c", "d")).collect())
    # 0 a, 2 b, 5 c, 6 d take 6 seconds; 3 a, 7 b, 8 c, 9 d and 10 d take 6 and 7.
    assert (hits(5), hits(6), hits(7)) == ([], [6, 9], [6, 9, 10])


def test_errors_near_in_time(spark):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    gate = spark.createDataFrame([(at(299), 1), (at(905), 2)], "t string, count bigint").selectExpr("cast(t as timestamp) ts", "count")
    up = spark.createDataFrame([(at(0), "u"), (at(598), "u"), (at(604), "u")], "t string, upstream string").selectExpr("cast(t as timestamp) ts", "upstream")
    rows = D.upstream_correlation(gate, up, 300).collect()
    assert sorted((r.gateway_errors, r.near_pairs) for r in rows) == [(1, 2)]

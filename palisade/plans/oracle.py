"""SQL building blocks for the oracles: the same definitions, written independently in SQL."""

from __future__ import annotations

from palisade.functions import catalog as C
from palisade.functions.sanitize import quote
from palisade.plans.fixtures import with_views


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {q(pattern)})"


def sub(value: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({value}, {q(pattern)}, {by}, 'g')"


def first_match(value: str, table, default: str = "NULL", flags: str = "(?i)") -> str:
    arms = " ".join(f"WHEN {hit(value, flags + p)} THEN {q(label)}" for label, p in table)
    return f"CASE {arms} ELSE {default} END"


def lookup(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def in_list(value: str, items) -> str:
    return f"{value} IN ({', '.join(q(x) for x in items)})"


def ordinal(value: str, order) -> str:
    arms = " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(order, 1))
    return f"CASE {value} {arms} END"


def label_of(position: str, order) -> str:
    arms = " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(order, 1))
    return f"CASE {position} {arms} END"


def strip_injection(value: str) -> str:
    for literal in C.INJECTION_PHRASES + C.INJECTION_TOKENS:
        for _ in range(3):
            value = sub(value, "(?i)" + quote(literal))
    return value


def strip_templates(value: str) -> str:
    value = sub(value, r"\$\{(jndi:[^}]*)\}", r"'\1'")
    value = sub(value, r"\$\{[^}]*\}")
    return sub(sub(value, r"\$\([^)]*\)"), "`[^`]*`")


def allowlist(value: str) -> str:
    return sub(value, C.DISALLOWED_URL_CHARS)


def strip_shell(value: str) -> str:
    return sub(value, r"[;|&`$(){}<>\n\r\x00]")


def decode(value: str) -> str:
    return f"decode(unhex({value}))"


def status_bucket(value: str) -> str:
    return (f"CASE WHEN {value} BETWEEN 200 AND 299 THEN '2xx' WHEN {value} BETWEEN 300 AND 399 THEN '3xx' "
            f"WHEN {value} BETWEEN 400 AND 499 THEN '4xx' WHEN {value} BETWEEN 500 AND 599 THEN '5xx' "
            f"ELSE 'other' END")


def classify_ip(value: str) -> str:
    return (f"CASE WHEN {value} = '' THEN 'unknown' WHEN {value} LIKE '10.%' OR {value} LIKE '192.168.%' "
            f"OR {value} LIKE '172.%' THEN 'private_ipv4' WHEN {value} IN ('127.0.0.1', '::1') THEN 'loopback' "
            f"WHEN {value} LIKE '%:%' THEN 'public_ipv6' ELSE 'public_ipv4' END")


def ua_family(ua: str, scanner: str) -> str:
    return (f"CASE WHEN {ua} IN ('', '-') THEN 'empty' WHEN {scanner} IS NOT NULL THEN {scanner} "
            f"WHEN {ua} = 'Mozilla/5.0' THEN 'bare_mozilla' WHEN {hit(ua, C.ANCIENT_CHROME)} THEN 'ancient_chrome' "
            f"WHEN {ua} LIKE '%Chrome/%' AND {ua} NOT LIKE '%KHTML%' THEN 'truncated_chrome' "
            f"WHEN {hit(ua, C.MODERN_BROWSER)} THEN 'browser' ELSE 'unknown' END")


def rate_signal(value: str) -> str:
    return f"CASE WHEN {value} >= 100 THEN 'high' WHEN {value} >= 10 THEN 'elevated' ELSE 'normal' END"


def confidence(path_class: str, scanner: str) -> str:
    return (f"CAST(CASE WHEN {path_class} = 'unknown' AND {scanner} IS NULL THEN 0.3 "
            f"WHEN {path_class} = 'unknown' THEN 0.6 WHEN {scanner} IS NOT NULL THEN 0.98 ELSE 0.95 END AS DOUBLE)")


def method(value: str) -> str:
    return f"CASE WHEN {in_list(f'upper(trim({value}))', C.METHODS)} THEN upper(trim({value})) ELSE 'INVALID' END"


def safe_note(path_class: str, path: str, count: str) -> str:
    label = lookup(path_class, C.NOTE_LABELS, q(C.UNKNOWN_LABEL))
    return f"concat({label}, ': ', substr({path}, 1, 60), ' (', CAST({count} AS VARCHAR), ' hits)')"


HOUR = "concat(substr(timestamp, 1, 13), ':00Z')"

# Cleaned and classified access rows, one stage per CTE so that no expression is repeated.
SANITIZED = (
    ("s_decoded", f"""SELECT ord, remote_addr, ts, timestamp, count, {method('method')} AS method_class,
        {status_bucket('status')} AS status_bucket, {decode('hex_path')} AS path0,
        {decode('hex_user_agent')} AS ua0 FROM access_events"""),
    ("s_stripped", f"""SELECT *, {strip_injection('path0')} AS path1, {strip_injection('ua0')} AS ua1
        FROM s_decoded"""),
    ("s_clean", f"""SELECT *, substr({strip_shell(allowlist(strip_templates('path1')))}, 1, 200) AS path,
        substr({strip_shell(allowlist(strip_templates('ua1')))}, 1, 200) AS ua FROM s_stripped"""),
    ("s_labels", f"""SELECT *, {first_match('path', C.PATH_CLASSES, "'unknown'")} AS path_class,
        CASE WHEN ua IN ('', '-') THEN NULL ELSE {first_match('ua', C.SCANNERS)} END AS scanner_family
        FROM s_clean"""),
    ("sanitized", f"""SELECT ord, remote_addr, ts, timestamp, count, method_class, status_bucket, path, ua,
        path_class, scanner_family, {ua_family('ua', 'scanner_family')} AS user_agent_family,
        {classify_ip('remote_addr')} AS remote_addr_class FROM s_labels"""),
)


def over_access(body: str) -> str:
    return with_views(body, "access_events")


def over_sanitized(body: str, *more: str, ctes=()) -> str:
    return with_views(body, "access_events", *more, ctes=SANITIZED + tuple(ctes))

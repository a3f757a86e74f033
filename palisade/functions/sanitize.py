"""Column expressions that clean and classify hostile request fields."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import catalog as C


def quote(literal: str) -> str:
    """Regex text for a literal, in the subset every regex dialect reads alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def literal_alternatives(pattern: str) -> list[str] | None:
    """The words of a regex that is only a choice of plain words; None for any other regex."""
    shape = re.fullmatch(r"([^()|]*)\(([^()]*)\)([^()|]*)", pattern)
    head, body, tail = shape.groups() if shape else ("", pattern, "")
    raw = [head + word + tail for word in body.split("|")]
    words = [re.sub(r"\\([.+])", r"\1", r) for r in raw]
    return words if [quote(w) for w in words] == raw else None


def finds(lowered: str, pattern: str) -> str:
    """SQL test: is a case-insensitive regex found in a column of lower-case text?

    Most listed regexes are choices of words, which byte search answers several times faster
    than the regex engine.
    """
    pattern = pattern.lower()
    words = literal_alternatives(pattern.removeprefix("^"))
    if words is None:
        return f"{lowered} RLIKE r'{pattern}'"
    test = "startswith" if pattern.startswith("^") else "contains"
    return "(" + " OR ".join(f"{test}({lowered}, r'{w}')" for w in words) + ")"


def first_match(lowered: str, table: list[tuple[str, str]], default: str = "NULL") -> Column:
    """Ordered CASE over (label, regex); the first hit decides and later tests are not run.

    Built as one SQL text: hundreds of Column calls would cost more than the query's planning.
    """
    arms = " ".join(f"WHEN {finds(lowered, p)} THEN '{label}'" for label, p in table)
    return F.expr(f"CASE {arms} ELSE {default} END")


def lookup(key: Column, table: dict, default) -> Column:
    """Constant map lookup; the map is a literal, so no join and no shuffle."""
    entries = F.expr("map(" + ", ".join(f"r'{k}', r'{v}'" for k, v in table.items()) + ")")
    return F.coalesce(F.element_at(entries, key), F.lit(default))


def ordinal(value: Column, order: list[str], missing: int | None = None) -> Column:
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(pos > 0, pos.cast("int")).otherwise(F.lit(missing).cast("int"))


def label_of(position: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), position.cast("int"))


# --- cleaning ----------------------------------------------------------------------------------

def hex_decode(value: Column) -> Column:
    """Hex text to UTF-8; white space may stand between byte pairs, anything else gives ''."""
    def text(digits: Column) -> Column:
        return F.make_valid_utf8(F.unhex(digits).cast("string"))

    left_over = F.regexp_replace(value, "[0-9A-Fa-f]{2}", "")
    spaced = F.when(~left_over.rlike(r"[^ \t\n\r\x0B\f]"),
                    F.regexp_replace(value, r"[ \t\n\r\x0B\f]", ""))
    # The second arm only runs where the first gives NULL: on spaced or broken values.
    return F.coalesce(text(F.when(F.length(value) % 2 == 0, value)), text(spaced), F.lit(""))


INJECTIONS = C.INJECTION_PHRASES + C.INJECTION_TOKENS


def may_hold_injection(lowered: str) -> Column:
    stems = " OR ".join(f"contains({lowered}, '{x}')" for x in C.INJECTION_STEMS)
    literals = " OR ".join(f"contains({lowered}, '{x.lower()}')" for x in INJECTIONS)
    return F.expr(f"({lowered} RLIKE r'{C.INJECTION_MARKS}' OR {stems}) AND ({literals})")


def strip_injection(value: Column, suspect: Column | None = None) -> Column:
    """Remove each listed literal until it is gone, literals in list order.

    Nearly all rows hold none of them: ``suspect`` (see ``may_hold_injection``) lets those skip
    the fold.  The fold binds its running text to a lambda variable, so the plan stays small
    whatever the list length.
    """
    suspect = value.rlike("(?i)(" + "|".join(map(quote, INJECTIONS)) + ")") if suspect is None else suspect
    shortest = min(len(x) for x in INJECTIONS)

    def drop(text: Column, pattern: Column) -> Column:
        """Passes until nothing is found; after that the remaining steps only hand on the text."""
        passes = F.sequence(F.lit(1), F.greatest(
            F.lit(1), (F.length(text) / F.lit(shortest)).cast("int")))
        state = F.struct(text.alias("t"), F.lit(True).alias("more"))
        gone = F.aggregate(passes, state, lambda s, _: F.when(
            s["more"], F.struct(
                F.regexp_replace(s["t"], pattern, F.lit("")).alias("t"),
                F.regexp_like(s["t"], pattern).alias("more"))).otherwise(s), lambda s: s["t"])
        return F.when(F.regexp_like(text, pattern), gone).otherwise(text)

    quoted = F.expr("array(" + ", ".join(f"r'(?i){quote(x)}'" for x in INJECTIONS) + ")")
    return F.when(suspect, F.aggregate(quoted, value, drop)).otherwise(value)


def strip_templates(value: Column) -> Column:
    steps = [
        (r"\$\{(jndi:[^}]*)\}", "$1"),
        (r"\$\{(?!jndi:)[^}]*\}", ""),
        (r"\$\([^)]*\)", ""),
        (r"`[^`]*`", ""),
    ]
    cleaned = reduce(lambda v, s: F.regexp_replace(v, s[0], s[1]), steps, value)
    return F.when(value.contains("$") | value.contains("`"), cleaned).otherwise(value)


def apply_allowlist(value: Column) -> Column:
    return F.regexp_replace(value, C.DISALLOWED_URL_CHARS, "")


def strip_shell_meta(value: Column) -> Column:
    return F.translate(value, C.SHELL_CHARS, "")


def drop_unsafe(value: Column) -> Column:
    """Allowlist and shell strip at once: dropping single characters commutes.

    Two small character classes are several times faster than the one long class they equal.
    """
    return F.regexp_replace(F.regexp_replace(value, C.NOT_PRINTABLE, ""), C.UNSAFE_PRINTABLE, "")


def truncate(value: Column, size: int = C.MAX_FIELD_LEN) -> Column:
    return F.substring(value, 1, size)


def clean_text(value: Column) -> Column:
    """The fixed cleaning order for text that is already decoded."""
    return truncate(drop_unsafe(strip_templates(strip_injection(value))))


def hex_encode(value: Column) -> Column:
    return F.lower(F.hex(F.encode(truncate(value), "UTF-8")))


def sanitize_indicator(value: Column) -> Column:
    kept = F.regexp_replace(truncate(value, 500), C.DISALLOWED_INDICATOR_CHARS, "")
    return F.trim(kept)


def sanitize_tags(tags: Column) -> Column:
    kept = F.transform(F.slice(tags, 1, 20), lambda t: truncate(sanitize_indicator(t), 50))
    return F.coalesce(F.filter(kept, lambda t: t != ""), F.array().cast("array<string>"))


def redact_secrets(value: Column) -> Column:
    return reduce(lambda v, kind: F.regexp_replace(v, kind[1], F.lit(C.REDACTED)),
                  C.SECRET_PATTERNS, value)


def secret_hits(value: Column, kind: str) -> Column:
    """Hits of one kind, counted after the kinds before it were redacted."""
    for name, pattern in C.SECRET_PATTERNS:
        if name == kind:
            return F.regexp_count(value, F.lit(pattern))
        value = F.regexp_replace(value, pattern, F.lit(C.REDACTED))
    raise KeyError(kind)


def hash_ip(addr: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), addr), 256)


# --- classifying -------------------------------------------------------------------------------

def classify_path(lowered: str) -> Column:
    """Class of a cleaned path, given by the name of a lower-case column."""
    return first_match(lowered, C.PATH_CLASSES, "'unknown'")


def scanner_family(lowered: str) -> Column:
    """Scanner named by a cleaned, lower-case user agent column; NULL when none is."""
    return F.when(~F.col(lowered).isin("", "-"), first_match(lowered, C.SCANNERS))


def ua_family(ua: Column, scanner: Column) -> Column:
    """Family of a cleaned user agent, given its scanner column so that list runs once."""
    return (
        F.when((ua == "") | (ua == "-"), F.lit("empty"))
        .when(scanner.isNotNull(), scanner)
        .when(ua.rlike(C.BARE_MOZILLA), F.lit("bare_mozilla"))
        .when(ua.rlike(C.ANCIENT_CHROME), F.lit("ancient_chrome"))
        .when(ua.contains("Chrome/") & ~ua.contains("KHTML"), F.lit("truncated_chrome"))
        .when(ua.rlike(C.MODERN_BROWSER), F.lit("browser"))
        .otherwise(F.lit("unknown"))
    )


def status_bucket(status: Column) -> Column:
    hundreds = F.floor(status / 100)
    return F.when(hundreds.between(2, 5), F.concat(hundreds.cast("string"), F.lit("xx"))).otherwise(
        F.lit("other"))


def classify_ip(addr: Column, strict_rfc1918: bool = False) -> Column:
    addr = F.coalesce(addr, F.lit(""))
    private_172 = (addr.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\.") if strict_rfc1918
                   else addr.startswith("172."))
    return (
        F.when(addr == "", F.lit("unknown"))
        .when(addr.startswith("10.") | addr.startswith("192.168.") | private_172,
              F.lit("private_ipv4"))
        .when(addr.isin("127.0.0.1", "::1"), F.lit("loopback"))
        .when(addr.contains(":"), F.lit("public_ipv6"))
        .otherwise(F.lit("public_ipv4"))
    )


def rate_signal(count: Column) -> Column:
    return F.when(count >= 100, F.lit("high")).when(count >= 10, F.lit("elevated")).otherwise(
        F.lit("normal"))


def validate_method(method: Column) -> Column:
    verb = F.trim(F.upper(F.coalesce(method, F.lit(""))))
    return F.when(verb.isin(*C.METHODS), verb).otherwise(F.lit("INVALID"))


def mitigation_type(path_class: Column) -> Column:
    return F.when(path_class == "unknown", F.lit("monitor")).otherwise(F.lit("location_block"))


def confidence(path_class: Column, scanner: Column) -> Column:
    return (
        F.when((path_class == "unknown") & scanner.isNull(), F.lit(0.3))
        .when(path_class == "unknown", F.lit(0.6))
        .when(scanner.isNotNull(), F.lit(0.98))
        .otherwise(F.lit(0.95))
    )


def match_type(path_class: Column) -> Column:
    return F.when(path_class == "unknown", F.lit("none")).otherwise(F.lit("regex_path"))


def ttl(path_class: Column) -> Column:
    return F.when(path_class == "unknown", F.lit("review")).otherwise(F.lit("permanent"))


def safe_note(path_class: Column, path: Column, count: Column) -> Column:
    return F.concat(lookup(path_class, C.NOTE_LABELS, C.UNKNOWN_LABEL), F.lit(": "),
                    F.substring(path, 1, 60), F.lit(" ("), count.cast("string"), F.lit(" hits)"))


def timestamp_bucket(ts: Column) -> Column:
    """Hour as written; an offset is dropped, not applied.  Text that is no timestamp: unknown."""
    hour = F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}"),
                  F.concat(F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 2),
                           F.lit(":00Z")))
    hour = hour.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(ts, F.lit("T00:00Z")))
    return F.coalesce(F.when(ts.try_cast("timestamp").isNotNull(), hour), F.lit("unknown"))


def event_date(ts: Column) -> Column:
    return F.when(F.length(ts) >= 10,
                  F.regexp_replace(F.substring(ts, 1, 10), "-", "")).otherwise(F.lit("unknown"))


# --- policy ------------------------------------------------------------------------------------

def rule_class(action: Column) -> Column:
    """A containment, B request handling, C baseline, D routing; the lower class wins ties."""
    text = F.lower(action)
    return (
        F.when(text.rlike(r"(deny|rate.?limit|limit_req|block (scanner|ip|user-agent)"
                          r"|return 40[34])"), F.lit("A"))
        .when(text.rlike(r"(method|limit_except|body_size|exact.?path|location block"
                         r"|merge_slashes)"), F.lit("B"))
        .when(text.rlike(r"(header|ssl_|tls|hsts|timeout|logging|access_log|error_log"
                         r"|server_tokens)"), F.lit("C"))
        .otherwise(F.lit("D"))
    )


def finding_family(category: Column) -> Column:
    return lookup(category, C.FINDING_FAMILIES, C.DEFAULT_FAMILY)


def profile_severity(profile: Column, severity: Column, ua: Column, addr_class: Column,
                     method: Column, path_class: Column) -> Column:
    """Re-grade by environment profile; NULL means the row is left out of findings."""
    internal = profile == "internal-only"
    lockdown = profile == "high-risk-lockdown"
    static = profile == "static-site"
    abuse = method.isin("TRACE", "CONNECT", "INVALID") | (path_class == "path_traversal")
    return (
        F.when(internal & (addr_class == "private_ipv4"), F.lit(None).cast("string"))
        .when(internal & ua.isin("go-http-client", "python-requests", "curl"), F.lit("info"))
        .when(static & (method == "PUT"), F.lit("critical"))
        .when(static & method.isin("POST", "DELETE"), F.lit("high"))
        .when((profile == "api-gateway") & abuse, F.lit("high"))
        .when(lockdown & (severity == "medium"), F.lit("high"))
        .when(lockdown & (severity == "high"), F.lit("critical"))
        .otherwise(severity)
    )

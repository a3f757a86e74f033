"""Markdown records with a frontmatter block to typed fields, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = r"(?s)\A---(.*?)\n---"
KEY = r"[a-z_][a-z0-9_]*:"
ITEMS = r"^((?:  - [^\n]*(?:\n|$))*)"
NESTED_ITEMS = r"^((?:  - [^\n]*(?:\n|$)(?:    [^\n]*(?:\n|$))*)*)"
INT = r"^[+-]?\d+(_\d+)*$"
FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parse_frontmatter(records: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``entries`` array<struct<key, kind, value, items>> and ``parse_errors``.

    ``kind`` is list, bool, int, float or string; ``items`` holds list values.  The block is cut
    once, before each key; list items stay with their key, stray lines become errors.
    """
    block = F.regexp_extract(F.regexp_replace(text, r"\A\s+", ""), BLOCK, 1)
    cut = records.withColumn("_block", F.concat(F.lit("\n"), block)).withColumn(
        "_parts", F.split("_block", r"\n(?=" + KEY + ")"))
    raw = F.expr(r"""
      transform(transform(slice(_parts, 2, size(_parts)), e -> named_struct('e', e, 'head', substring_index(e, '\n', 1))),
        x -> named_struct('key', substring_index(x.head, ':', 1), 'v', trim(substring(x.head, instr(x.head, ':') + 1)),
                          'tail', substring(x.e, length(x.head) + 2)))""")
    listed = F.expr(rf"""
      transform(_raw, x -> named_struct('key', x.key, 'v', x.v, 'tail', x.tail,
        'items', CASE WHEN startswith(x.tail, '  - ') AND x.v IN ('', '[]') THEN regexp_extract(x.tail, r'{ITEMS}', 1) ELSE '' END))""")
    typed = F.expr(rf"""
      transform(_e, e -> CASE
        WHEN e.items <> '' THEN named_struct('key', e.key, 'kind', 'list', 'value', '',
             'items', transform(split(trim(TRAILING '\n ' FROM e.items), '\n'), x -> trim(substring(x, 5))))
        WHEN startswith(e.v, '[') AND endswith(e.v, ']') THEN named_struct('key', e.key, 'kind', 'list', 'value', '',
             'items', CASE WHEN trim(substring(e.v, 2, length(e.v) - 2)) = '' THEN cast(array() AS array<string>)
                      ELSE transform(split(substring(e.v, 2, length(e.v) - 2), ','), x -> trim(BOTH "'" FROM trim(BOTH '"' FROM trim(x)))) END)
        ELSE named_struct('key', e.key,
             'kind', CASE WHEN e.v IN ('true', 'True', 'false', 'False') THEN 'bool'
                          WHEN NOT contains('0123456789+-.iInN', substring(e.v, 1, 1)) OR e.v = '' THEN 'string'
                          WHEN e.v RLIKE r'{INT}' THEN 'int' WHEN e.v RLIKE r'{FLOAT}' THEN 'float' ELSE 'string' END,
             'value', CASE WHEN length(e.v) >= 2 AND ((startswith(e.v, '"') AND endswith(e.v, '"')) OR (startswith(e.v, "'") AND endswith(e.v, "'")))
                           THEN substring(e.v, 2, length(e.v) - 2) ELSE e.v END,
             'items', cast(array() AS array<string>)) END)""")
    stray = F.expr(r"""
      filter(flatten(concat(array(split(_parts[0], '\n')), transform(filter(_e, e -> length(e.tail) > length(e.items)),
        e -> split(substring(e.tail, length(e.items) + 1), '\n')))), x -> trim(x) <> '' AND NOT startswith(trim(x), '#'))""")
    errors = F.when(~F.regexp_replace(text, r"\A\s+", "").rlike(BLOCK), F.array(F.lit("no frontmatter"))).otherwise(
        F.transform(stray, lambda x: F.concat(F.lit("unparseable: "), x)))
    return (cut.withColumn("_raw", raw).withColumn("_e", listed)
            .withColumns({"entries": typed, "parse_errors": errors})
            .drop("_block", "_parts", "_raw", "_e"))


def _strays(block: str, nested: bool) -> str:
    """The lines that belong to nothing, of a block that begins with a line break."""
    items = NESTED_ITEMS if nested else ITEMS
    return rf"""
      transform(array(split({block}, r'\n(?={KEY})')), parts -> filter(flatten(concat(array(split(parts[0], '\n')), transform(
        filter(slice(parts, 2, size(parts)), p -> contains(p, '\n')),
        p -> split(CASE WHEN trim(substring(substring_index(p, '\n', 1), instr(p, ':') + 1)) IN ('', '[]') AND startswith(substring(p, instr(p, '\n') + 1), '  - ')
                   THEN regexp_replace(substring(p, instr(p, '\n') + 1), r'\A{items[1:]}', '') ELSE substring(p, instr(p, '\n') + 1) END, '\n')))),
        x -> trim(x) <> '' AND NOT startswith(trim(x), '#')))[0]"""


def record_fields(records: DataFrame, names: list[str], text: str = "text", nested: bool = False) -> DataFrame:
    """Adds ``f_<name>`` struct<kind, value, items> of each named key, NULL where there is none, and ``parse_errors``.

    A key's entry is what follows its last line in the block, so the last of equal keys wins and nothing but the named
    keys is cut out.  One regex tells a block without stray lines; only others are taken apart for them.
    ``nested`` takes lines that are indented below a list item as part of the item.
    """
    items = NESTED_ITEMS if nested else ITEMS
    below = r"(?:\n    [^\n]*+)*+" if nested else ""
    clean = (rf"\A(?:\n{KEY} *+(?:\[\])?+ *+(?=\n|\z)(?:\n  - [^\n]*+{below})*+|\n{KEY}[^\n]*+|\n *+(?:#[^\n]*+)?+(?=\n|\z))*+\z")
    block = records.withColumn("_t", F.ltrim(F.col(text), F.lit(" \t\n\r\x0b\x0c"))).withColumn(
        "_end", F.when(F.startswith("_t", F.lit("---")), F.expr(r"locate('\n---', _t, 4)")).otherwise(0)).withColumn(
        "_block", F.expr(r"concat('\n', CASE WHEN _end > 0 THEN substring(_t, 4, _end - 4) ELSE '' END)"))
    errors = F.expr(rf"""CASE WHEN _end = 0 OR _end IS NULL THEN array('no frontmatter')
        WHEN _block RLIKE r'{clean}' THEN cast(array() AS array<string>)
        ELSE transform({_strays('_block', nested)}, x -> concat('unparseable: ', x)) END""")
    cut = block.select(*records.columns, "_block", errors.alias("parse_errors"), *[
        F.expr(rf"CASE WHEN contains(_block, '\n{n}:') THEN substring_index(_block, '\n{n}:', -1) END").alias(f"_p_{n}") for n in names])
    cut = cut.withColumns({f"_v_{n}": F.expr(rf"trim(substring_index(_p_{n}, '\n', 1))") for n in names})
    typed = lambda n: F.expr(rf"""  -- one key
      CASE WHEN _p_{n} IS NULL THEN NULL
        WHEN _v_{n} IN ('', '[]') AND startswith(substring(_p_{n}, instr(_p_{n}, '\n')), '\n  - ') THEN
          named_struct('kind', 'list', 'value', '', 'items', transform(split(trim(TRAILING '\n ' FROM
            regexp_extract(substring(_p_{n}, instr(_p_{n}, '\n') + 1), r'{items}', 1)), r'\n(?=  - )'), x -> trim(substring(x, 5))))
        WHEN startswith(_v_{n}, '[') AND endswith(_v_{n}, ']') THEN named_struct('kind', 'list', 'value', '', 'items',
          CASE WHEN trim(substring(_v_{n}, 2, length(_v_{n}) - 2)) = '' THEN cast(array() AS array<string>)
               ELSE transform(split(substring(_v_{n}, 2, length(_v_{n}) - 2), ','), x -> trim(BOTH "'" FROM trim(BOTH '"' FROM trim(x)))) END)
        ELSE named_struct('kind', CASE WHEN _v_{n} IN ('true', 'True', 'false', 'False') THEN 'bool'
               WHEN _v_{n} = '' OR NOT contains('0123456789+-.iInN', substring(_v_{n}, 1, 1)) THEN 'string'
               WHEN _v_{n} RLIKE r'{INT}' THEN 'int' WHEN _v_{n} RLIKE r'{FLOAT}' THEN 'float' ELSE 'string' END,
             'value', CASE WHEN length(_v_{n}) >= 2 AND ((startswith(_v_{n}, '"') AND endswith(_v_{n}, '"')) OR (startswith(_v_{n}, "'") AND endswith(_v_{n}, "'")))
                           THEN substring(_v_{n}, 2, length(_v_{n}) - 2) ELSE _v_{n} END,
             'items', cast(array() AS array<string>)) END""")
    return once(cut.select(*records.columns, "parse_errors", *[typed(n).alias(f"f_{n}") for n in names]), records.columns)


def once(df: DataFrame, plain: list[str]) -> DataFrame:
    """The same rows, with the columns beside ``plain`` behind a one-row generator.

    A filter on them then stays above; pushed below, each use would repeat the whole expression, and those nest.
    """
    made = [c for c in df.columns if c not in plain]
    return df.select(*plain, F.inline(F.array(F.struct(*made))))


def item_maps(items: str) -> Column:
    """List items that are maps: array<map<string, array<string>>>, nested keys as ``outer.inner``.

    A scalar is an array of one; the last of equal keys wins; an item that is no map gives an empty map.  Keys stand at
    indents of 0 (the item's first line), 4 and 6; a list below a key stands deeper than the key, with ``- ``.
    """
    unquoted = "trim(BOTH \"'\" FROM trim(BOTH '\"' FROM trim({})))"
    head = r"^ *([a-z_][a-z0-9_]*):[ \t]*(.*)$"
    return F.expr(rf"""
      transform(transform({items}, x -> split(x, '\n')), lines -> map_from_entries(transform(filter(aggregate(lines,
        named_struct('outer', '', 'key', '', 'out', cast(array() AS array<struct<k:string,v:array<string>>>)),
        (s, l) -> CASE
          WHEN l RLIKE r'^ *- ' AND s.key <> '' THEN named_struct('outer', s.outer, 'key', s.key, 'out', transform(s.out,
               (e, i) -> CASE WHEN i = size(s.out) - 1 THEN named_struct('k', e.k, 'v', concat(e.v, array({unquoted.format("regexp_extract(l, r'^ *- (.*)$', 1)")}))) ELSE e END))
          WHEN l RLIKE r'{head}' THEN named_struct(
               'outer', CASE WHEN l RLIKE r'^ {{5,}}' THEN s.outer ELSE regexp_extract(l, r'{head}', 1) END,
               'key', regexp_extract(l, r'{head}', 1),
               'out', concat(s.out, array(named_struct(
                 'k', CASE WHEN l RLIKE r'^ {{5,}}' AND s.outer <> '' THEN concat(s.outer, '.', regexp_extract(l, r'{head}', 1)) ELSE regexp_extract(l, r'{head}', 1) END,
                 'v', CASE WHEN regexp_extract(l, r'{head}', 2) IN ('', '[]') THEN cast(array() AS array<string>)
                      WHEN regexp_extract(l, r'{head}', 2) RLIKE r'^\[.*\]$' THEN transform(split(regexp_extract(l, r'\[(.*)\]$', 1), ','), v -> {unquoted.format("v")})
                      ELSE array({unquoted.format("regexp_extract(l, r'" + head + "', 2)")}) END))))
          ELSE s END, s -> transform(s.out, (e, i) -> named_struct('k', e.k, 'v', e.v,
               'last', NOT exists(slice(s.out, i + 2, size(s.out)), o -> o.k = e.k)))),
        e -> e.last), e -> named_struct('k', e.k, 'v', e.v))))""")


def key_values(records: DataFrame, key: str) -> DataFrame:
    """One row per (record, key).

    The outer form keeps Spark from asking first, in a filter that parses every text once more, which have entries.
    """
    return records.select(key, F.explode_outer("entries").alias("e")).where("e IS NOT NULL").select(
        key, "e.key", "e.kind", F.when(F.col("e.kind") == "list", F.array_join("e.items", ","))
        .otherwise(F.col("e.value")).alias("value"))


def field(name: str) -> Column:
    """The last entry of that name, as a struct; NULL when there is none."""
    return F.try_element_at(F.filter("entries", lambda e: e["key"] == name), F.lit(-1))

"""Blocks of config files: braces matched in one pass over a batch of texts.

Braces are matched by their running depth: at one depth of one file, opening and closing braces alternate.  All
braces of a batch are matched at once with arrays, and each text is cut once, so the work grows with the
text and not with text times blocks, as it does for a fold that copies its arrays at every brace.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The helpers below travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
BLOCKS = T.StructType([
    T.StructField("locs", T.ArrayType(T.StructType(_text("expr", "modifier", "path", "body") + _long("line", "open", "close")))),
    T.StructField("servers", T.ArrayType(T.StructType(_text("body") + _long("open", "close", "line")))),
    T.StructField("unbalanced", T.BooleanType())])

LOCATION = re.compile(rb"location\s+(.*)\Z", re.DOTALL)
MODIFIED = re.compile(rb"(=|~|~\*|\^~)\s+\S")
PARTS = re.compile(rb"(\S+)\s+(.*)\Z", re.DOTALL)
SERVER = re.compile(rb"\bserver\s*\Z")
WHITE = b" \t\n\r\x0b\x0c"


def matched(at: np.ndarray, opens: np.ndarray, file: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the matched opening and closing braces, among braces in text order; by opening brace."""
    step = np.where(opens, 1, -1)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(file)) + 1]) if len(file) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(at)))

    def depths(s):
        total = np.cumsum(s)
        return total - np.repeat((total - s)[starts], sizes)

    depth = depths(step)
    lost = np.zeros(len(at), bool)
    # A closing brace that takes its file to a new low has no partner.
    for first, size in zip(starts[np.minimum.reduceat(depth, starts) < 0] if len(starts) else [], sizes[np.minimum.reduceat(depth, starts) < 0] if len(starts) else []):
        low = np.minimum.accumulate(np.minimum(depth[first:first + size], 0))
        lost[first:first + size] = low < np.concatenate([[0], low[:-1]])
    kept = np.flatnonzero(~lost)
    depth = depths(np.where(lost, 0, step))[kept]
    level = depth - np.where(opens[kept], 0, -1)
    order = np.lexsort((kept, level, file[kept]))
    a, b = order[:-1], order[1:]
    pair = opens[kept[a]] & ~opens[kept[b]] & (level[a] == level[b]) & (file[kept[a]] == file[kept[b]])
    opened, closed = kept[a[pair]], kept[b[pair]]
    by = np.argsort(opened)
    return opened[by], closed[by]


@F.arrow_udf(BLOCKS)
def file_blocks(texts: pa.Array) -> pa.Array:
    """Location and server blocks of each text, by opening brace; blocks that never close are left out.

    The text between the brace that opened last before a block and its own names the block.  ``open`` and ``close``
    order the blocks of a file.
    """
    rows = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    whole = b"".join(rows)
    octets = np.frombuffer(whole, np.uint8)
    at = np.flatnonzero((octets == 123) | (octets == 125))
    opens = octets[at] == 123
    file = np.searchsorted(offsets, at, side="right") - 1
    lines = np.flatnonzero(octets == 10)
    opened, closed = matched(at, opens, file)
    # Where the name of a block may begin: after the opening brace before it, or at the start of the file.
    all_opens = np.flatnonzero(opens)
    rank = np.searchsorted(all_opens, opened)
    before = all_opens[np.maximum(rank - 1, 0)] if len(all_opens) else rank
    same = (rank > 0) & (file[before] == file[opened]) if len(opened) else rank > 0
    base = offsets[file[opened]]
    head_from = np.where(same, at[before] + 1, base) if len(opened) else base
    out = [{"locs": [], "servers": [], "unbalanced": False} for _ in rows]
    for f, n_open, n_pair, n_all in zip(range(len(rows)), np.bincount(file[opens], minlength=len(rows)),
                                        np.bincount(file[opened], minlength=len(rows)), np.bincount(file, minlength=len(rows))):
        out[f]["unbalanced"] = bool(n_open != n_pair or n_all - n_open != n_pair)
    line_of = lambda place, start: int(np.searchsorted(lines, place) - np.searchsorted(lines, start)) + 1
    for f, start, head_at, o, c in zip(file[opened].tolist(), base.tolist(), head_from.tolist(), at[opened].tolist(), at[closed].tolist()):
        head = whole[head_at:o]
        named = LOCATION.search(head)
        if named:
            expr = named.group(1).rstrip(WHITE).strip(b" ")
            parts = PARTS.match(expr) if MODIFIED.match(expr) else None
            out[f]["locs"].append({
                "expr": expr.decode(), "modifier": parts.group(1).decode() if parts else "", "path": (parts.group(2) if parts else expr).decode(),
                "body": whole[o + 1:c].strip(WHITE).decode(), "line": line_of(head_at + named.start(), start), "open": o + 1 - start, "close": c + 1 - start})
        server = SERVER.search(head)
        if server:
            out[f]["servers"].append({"body": whole[o + 1:c].decode(), "open": o + 1 - start, "close": c + 1 - start,
                                      "line": line_of(head_at + server.start(), start)})
    kind = pa.struct([
        ("locs", pa.list_(pa.struct([(n, pa.string()) for n in ("expr", "modifier", "path", "body")] + [(n, pa.int64()) for n in ("line", "open", "close")]))),
        ("servers", pa.list_(pa.struct([("body", pa.string())] + [(n, pa.int64()) for n in ("open", "close", "line")]))), ("unbalanced", pa.bool_())])
    return pa.array(out, kind)

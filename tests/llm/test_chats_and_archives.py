"""Chat formatting and WARC archives: exact round trips."""

import gzip
import hashlib
import os
import random

from pyspark.sql import functions as F

from palisade.llm import chat_format, warc
from palisade.llm.common import new_folder

CHATS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "</turn>"), (1, 2, "user", "\\"), (1, 3, "assistant", "### user: x</turn>\n### a: b"),
    (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (3, None, "assistant", "é 😀"),
    (None, 0, "user", "nobody's"), (4, 5, "a: b", "\\### Assistant: </turn> ok"), (4, 2, "### ", ": </turn"), (5, 0, "assistant", "x" * 100_000 + "\\</turn>"),
    (6, 0, "us\ner", "\n\n### \\\\"), (7, 0, "</turn>", "<\\/turn>"), (8, 0, "a\\", ": b"),
]


def chats(spark, rows):
    return spark.createDataFrame([(*r, "f", "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, plain string")


def expected_turns(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_turns_come_back(spark):
    found = chat_format.format_chats(chats(spark, CHATS)).withColumn(
        "loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    ).collect()
    turns = expected_turns(CHATS)
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in found} == turns
    for r in found:
        assert r.loss == "".join(t for role, t in turns[r.conv_id] if role == "assistant")
        assert r.formatted.count("</turn>") == len(turns[r.conv_id])
    assert next(r for r in found if r.conv_id == 3).formatted == "### assistant: é 😀</turn>\n"


def test_random_texts_come_back(spark):
    rng = random.Random(9)
    parts = ["\\", "</turn>", "### ", ": ", "\n", "a", "<", "/turn>", "#", " ", "é", "\\/", "\\\\"]
    rows = [(i, t, "".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(150) for t in range(4)]
    found = chat_format.format_chats(chats(spark, rows)).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in found} == expected_turns(rows)


def test_no_chats(spark):
    assert chat_format.format_chats(chats(spark, [])).collect() == []


PAGES = [
    (3, "http://a/3", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, None), (5, "http://a/5", ""), (4, "http://a\r\nX: 1", "é 😀"),
    (None, "http://a/n", "<p>same</p>"), (6, "u", "WARC/1.1\r\n\r\nfake"), (7, "u", "x" * 300_000), (8, "u", "twice"), (8, "u", "twice"), (8, "u", "other"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, kind int")


def expected_records(rows, least=0):
    out, first = [], {}
    for i, _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        digest = warc.base32(hashlib.sha1(data).hexdigest())
        again = data in first and len(data) >= least
        out.append((str(i), digest, "revisit" if again else "response", str(first[data]) if again else "-"))
        first.setdefault(data, i)
    return sorted(out)


def read(spark, folder):
    rows = warc.read_archives(spark, folder).collect()
    ids = {r.record_id: r.page_id for r in rows if r.record_type == "response"}
    return sorted((str(r.page_id), r.payload_digest, r.record_type, str(ids[r.refers_to_id]) if r.refers_to_id else "-") for r in rows), rows


def test_archives_come_back(spark):
    for least in (0, 6):
        folder = new_folder(spark, "test-warc")
        manifest = warc.write_archives(pages(spark, PAGES), folder, least_bytes=least, roll_bytes=300, shard_bytes=1000).collect()
        assert len(manifest) > 3 and sum(m.records for m in manifest) == len(PAGES)
        found, rows = read(spark, folder)
        assert found == expected_records(PAGES, least)
        assert {r.payload for r in rows if r.record_type == "response"} == {t or "" for _, _, t in PAGES}


def test_same_pages_give_the_same_files(spark):
    shas = []
    for n in (1, 7):
        folder = new_folder(spark, "test-warc")
        warc.write_archives(pages(spark, PAGES).repartition(n), folder, roll_bytes=500, shard_bytes=2000)
        shas.append(sorted((m.name, m.sha256) for m in spark.read.parquet(f"{folder}/_manifest").collect()))
    assert shas[0] == shas[1]


def test_files_are_plain_gzip_and_strays_are_not_read(spark):
    folder = new_folder(spark, "test-warc")
    manifest = warc.write_archives(pages(spark, PAGES), folder).collect()
    local = warc.qualified(spark, folder).removeprefix("file://")
    names = [f for f in os.listdir(local) if f.endswith(".warc.gz")]
    assert sorted(names) == sorted(m.name for m in manifest) and not os.path.exists(f"{local}/_temporary")
    with gzip.open(f"{local}/{names[0]}") as file:
        assert file.read().startswith(b"WARC/1.1\r\n")
    with open(f"{local}/stray.warc.gz", "wb") as file:
        file.write(b"not an archive")
    assert read(spark, folder)[0] == expected_records(PAGES)


def test_no_pages(spark):
    folder = new_folder(spark, "test-warc")
    assert warc.write_archives(pages(spark, []), folder).collect() == []
    assert warc.read_archives(spark, folder).collect() == []

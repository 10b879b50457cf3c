import base64
import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from scoreframe.llm import warc_revisit
from scoreframe.llm.files import reading

SCHEMA = "page_id long, url string, html string, record_id string, uid string, digest string"


def table():
    rows = [(k, f"http://a.example/{k} x\r\nEvil: 1", f"<p>{k % 7}é</p>" if k % 3 else f"<p>own {k}</p>") for k in range(60)]
    rows += [(90, None, None), (91, "", ""), (92, "u", None), (None, "n", "null id"), (None, "n", "null id"), (93, "x", "null id")]
    rows += [(94, "d", "twice"), (94, "d", "twice"), (95, "long", "z" * 200_000), (96, "head", "a\r\n\r\nContent-Length: 3\r\n\r\nWARC/1.1")]
    return [(*r, "c", "c", "c") for r in rows]


def brute(rows, least):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2] or ""].append(r[0])
    out = Counter()
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        ranked = sorted(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(ranked):
            revisit = len(data) >= least and n < len(ranked) - 1
            out[(i, len(data), digest, "revisit" if revisit else "response", ranked[-1] if revisit else None)] += 1
    return out


@pytest.mark.parametrize("least, archive_bytes", [(0, 64 << 20), (5, 400)])
def test_round_trip(spark, least, archive_bytes):
    pages = spark.createDataFrame(table(), SCHEMA).repartition(3)
    manifest = warc_revisit.write_archives(pages, min_bytes=least, archive_bytes=archive_bytes)
    got = warc_revisit.resolve(warc_revisit.read_archives(manifest)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(table(), least)
    assert manifest.agg({"records": "sum"}).first()[0] == len(table())


def test_archives_hold_each_payload_once(spark):
    pages = spark.createDataFrame(table(), SCHEMA)
    manifest = warc_revisit.write_archives(pages).collect()
    data = b""
    for m in manifest:
        with reading(m.archive) as raw:
            data += gzip.decompress(raw.read())
    assert data.count(b"<p>1\xc3\xa9</p>") == 1 and data.count(b"z" * 200_000) == 1
    assert b"\r\nEvil: 1" not in data


def test_damage_is_found(spark, tmp_path):
    data = warc_revisit._record("response", "urn:x", "u", 1, b"payload", None, warc_revisit.DATE)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(gzip.decompress(data).replace(b"payload", b"paYload")))
    manifest = spark.createDataFrame([(str(path),)], "archive string")
    with pytest.raises(Exception, match="damaged"):
        warc_revisit.read_archives(manifest).collect()


def test_empty(spark):
    manifest = warc_revisit.write_archives(spark.createDataFrame([], SCHEMA))
    assert warc_revisit.resolve(warc_revisit.read_archives(manifest)).count() == 0

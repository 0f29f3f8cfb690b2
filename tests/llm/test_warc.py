import gzip
import hashlib
import random

import pytest

from tidemark.llm import warc as op
from tidemark.llm.queries import op10_warc


def brute(pages, least=1000):
    best = {}
    for page, _, html in pages:
        if page is not None:
            best[html or ""] = max(best.get(html or "", page), page)
    out = []
    for page, _, html in pages:
        data = (html or "").encode()
        to = best.get(html or "") if len(data) >= least else None
        again = to is not None and page != to
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip_at_every_cut(spark):
    rng = random.Random(6)
    noise = bytes(rng.randrange(256) for _ in range(3000)).decode("latin-1")
    same = "<p>é copied</p>" * 100
    pages = [(i, f"http://x/{i}", same) for i in range(8)] + [(20, "u\r\nX: 1", "short"), (21, None, "short"), (22, "u", None), (None, "u", same), (None, None, "no id " * 300), (None, None, "no id " * 300), (7, "again", same)]
    pages += [(50 + i, "u", noise[i * 20 :] + "\x1f\x8b\x08 WARC/1.0") for i in range(12)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    manifest = op.write_archives(df, archive_bytes=9000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).head()[0] == len(pages)
    for split in (97, 1000, 1 << 20):
        assert rows(op.read_archives(manifest, split_bytes=split)) == brute(pages)
    kept = op.read_archives(op.archives(spark, *[r.path for r in manifest.collect()]), split_bytes=500).where("record_type = 'response'").collect()
    texts = {(p, (h or "").encode()) for p, _, h in pages}
    assert all((r.page_id, bytes(r.payload)) in texts for r in kept)
    uris = {r.page_id: r.target_uri for r in kept}
    assert uris[20] == "u%0D%0AX:%201" and uris[21] is None
    path = manifest.head().path.removeprefix("file:").replace("//", "/")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_damage_is_an_error_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text " * 500)], "page_id long, url string, html string")
    path = op.write_archives(df).head().path.removeprefix("file:").replace("//", "/")
    whole = open(path, "rb").read()
    (tmp_path / "cut.warc.gz").write_bytes(whole[:-30])
    with pytest.raises(ValueError, match="inside a member"):
        list(op.records_in(str(tmp_path / "cut.warc.gz"), 0, len(whole)))
    (tmp_path / "junk.warc.gz").write_bytes(b"junk\x1f\x8b\x08junk" + whole)
    assert len(list(op.records_in(str(tmp_path / "junk.warc.gz"), 0, len(whole) + 20))) == 1
    manifest = op.write_archives(df.limit(0))
    assert manifest.count() == 0 and op.read_archives(manifest).count() == 0


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows(op10_warc(spark, d)) == brute(pages)


def test_very_long_pages_and_splits_that_fall_inside_them(spark):
    rng = random.Random(2)
    long = "".join(chr(rng.randrange(32, 1000)) for _ in range(1_500_000))
    pages = [(1, "u", long), (2, "u", "x" * 999), (3, "u", long), (4, "u", "y" * 2_000_000), (5, "u", "x" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = op.write_archives(df)
    for split in (1 << 16, 1 << 24):
        assert rows(op.read_archives(manifest, split_bytes=split)) == brute(pages)

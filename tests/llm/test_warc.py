"""Archives: round trips through ranges of every size."""

import gzip
import io

import pytest

from conftest_llm import with_clashes
from peerlabel.llm import warc
from peerlabel.llm.common import shared_dir

PAGES = [
    (0, "http://a.org/é?x y", "<p>same</p>"),
    (1, "http://b.org/", "other"),
    (2, "http://c.org/", "<p>same</p>"),
    (3, None, None),
    (4, "http://d.org/", ""),
    (5, "http://e.org/", "x\r\n\r\nWARC/1.1\r\n" * 400),
    (6, "http://f.org/", "long " * 50000),
    (7, "http://b.org/", "other"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id LONG, url STRING, html STRING").repartition(3)


def expected(min_bytes=0):
    first, out = {}, {}
    for i, url, html in PAGES:
        raw = (html or "").encode()
        to = first.setdefault(raw, i) if len(raw) >= min_bytes else i
        out[f"urn:record:{i}"] = (len(raw), warc.digest(raw), "response" if to == i else "revisit", None if to == i else f"urn:record:{to}", raw if to == i else None)
    return out


@pytest.mark.parametrize("range_bytes", [100, 1000, 1 << 20])
@pytest.mark.parametrize("min_bytes", [0, 6])
def test_round_trip(spark, pages, range_bytes, min_bytes):
    writer = warc.WarcWriter(file_bytes=1500, min_bytes=min_bytes)
    rows = warc.archive(with_clashes(pages, "key", "digest", "first", "to"), writer, warc.WarcReader(range_bytes)).collect()
    got = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in rows}
    assert len(rows) == len(PAGES) and got == expected(min_bytes)


def test_files_are_plain_gzip(spark, pages):
    folder = shared_dir(spark, "warc-test")
    manifest = warc.WarcWriter().write(pages, folder).collect()
    assert sum(r.n_records for r in manifest) == len(PAGES)
    for r in manifest:
        with open(r.path.removeprefix("file://").removeprefix("file:"), "rb") as file:
            raw = file.read()
        assert len(raw) == r.n_bytes
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID: <urn:record:") == r.n_records


def test_ranges_own_each_record_once():
    """Every cut of a file with junk and magic bytes that start no record."""
    records = [warc.member("response", f"r{i}", "http://x/", None, bytes([i]) * (40 * i), 6) for i in range(6)]
    junk = warc.MAGIC + b"\x00" * 20
    plain = gzip.compress(b"no record " * 3)
    raw = junk + records[0] + records[1] + plain + records[2] + junk[:2] + records[3] + records[4] + warc.MAGIC + records[5][:30] + records[5]
    for size in (1, 2, 3, 50, 97, 10_000):
        found = []
        for begin in range(0, len(raw), size):
            found += [r[0] for r in warc.records_in(_Source(raw), begin, begin + size, len(raw))]
        assert found == [f"r{i}" for i in range(6)], size


class _Source(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_a_broken_record_is_passed_over_and_a_wrong_digest_fails():
    good = warc.member("response", "good", "http://x/", None, b"abc", 6)
    cut = warc.member("response", "cut", "http://x/", None, b"abc" * 100, 6)[:-20]
    raw = cut + good
    assert [r[0] for r in warc.records_in(_Source(raw), 0, len(raw), len(raw))] == ["good"]
    forged = gzip.compress(gzip.decompress(good).replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records_in(_Source(forged), 0, len(forged), len(forged)))


def test_null_keys_repeated_rows_and_empty_tables(spark, pages):
    rows = spark.createDataFrame([(None, "u", "t"), (None, "u", "t"), (4, "u", "t"), (4, "u", "t"), (9, "u", "t")], "page_id LONG, url STRING, html STRING")
    got = sorted((r.record_type, r.refers_to or "") for r in warc.archive(rows).collect())
    assert got == [("response", "")] * 4 + [("revisit", "urn:record:4")]
    assert warc.archive(pages.limit(0)).count() == 0


def test_the_query_takes_pages_without_an_id_and_repeated_ones(spark, tmp_path):
    from peerlabel.llm.queries import op10_warc

    rows = [(None, "u", "t"), (4, "u", "t"), (4, "u", "t"), (9, "u", "t"), (None, "u", None), (3, None, "")]
    spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in op10_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "response", None, 1), (4, "response", None, 1), (4, "response", None, 1), (9, "revisit", 4, 1), (None, "response", None, 0), (3, "response", None, 0)], key=str)


@pytest.mark.parametrize("most", [0, 500_000])
def test_many_or_few_shared_payloads(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "SMALL_TABLE", most)
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else f"t{i // 4}") for i in range(40)], "page_id LONG, url STRING, html STRING")
    got = {r.record_id: r.refers_to for r in warc.archive(pages.repartition(3)).collect()}
    assert got["urn:record:39"] == "urn:record:1" and got["urn:record:1"] is None and got["urn:record:6"] == "urn:record:4" and len(got) == 40


def test_file_systems():
    for uri in ("file:/tmp/x", "file:///tmp/x"):
        assert warc.store_of(uri)[1] == "/tmp/x"
    assert warc.store_of("dbfs:/a/b")[1] == "/dbfs/a/b"

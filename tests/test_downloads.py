import hashlib

import pytest

from sequor.sources import downloads


def test_links_are_found_or_fail():
    page = '<a href="/x.txt">x</a><a href="data/all.csv?v=2">csv</a>'
    assert downloads.discover(page, "https://example.org/a/", r"\.csv") == "https://example.org/a/data/all.csv?v=2"
    assert downloads.discover(page, "https://example.org/", "zip$", required=False, fallback="f") == "f"
    with pytest.raises(LookupError):
        downloads.discover(page, "https://example.org/", "zip$")


def test_downloads_are_whole(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"hello")
    got = downloads.download(f"file://{tmp_path}/a", str(tmp_path / "b"))
    assert got["sha256"] == hashlib.sha256(b"hello").hexdigest() and got["bytes"] == 5
    row = downloads.inspect(spark, str(tmp_path / "b")).first()
    assert row.sha256 == got["sha256"] and row.bytes == 5
    with pytest.raises(OSError):
        downloads.download(f"file://{tmp_path}/none", str(tmp_path / "c"), attempts=1)
    assert not (tmp_path / "c").exists() and not (tmp_path / "c.part").exists()

"""Packages end where they have grown to their size, and the next one begins; nothing is lost between them."""

import zipfile
from collections import Counter

import pytest
from millrace.llm.common import cut
from millrace.llm.warc_zip import read_packages, round_trip, write_packages

PAGES = [(i, f"http://site/{i}", ("<p>" + str(i % 40) * 50) if i % 7 else None) for i in range(150)] + [(500, "http://site/long", "x" * 30_000)]


@pytest.mark.parametrize("most", [1, 5_000, 64 << 20])
def test_rollover(spark, tmp_path, most):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    packages = cut(write_packages(pages, str(tmp_path), most_bytes=most))
    made = packages.collect()
    assert sum(r["records"] for r in made) == len(PAGES) and len({r["path"] for r in made}) == len(made)
    if most == 1:
        assert {r["records"] for r in made} == {1}
    elif most == 5_000:
        assert 4 < len(made) < len(PAGES)
    for r in made[:5]:
        with zipfile.ZipFile(r["path"]) as z:
            assert z.testzip() is None and len(z.namelist()) == 2
    want = Counter(map(tuple, round_trip(pages).collect()))
    assert Counter(map(tuple, read_packages(packages, str(tmp_path)).collect())) == want and want.total() == len(PAGES)

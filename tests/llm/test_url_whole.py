"""URLs that differ only behind the path or have no scheme."""

import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op06_url_filter as op6  # noqa: E402


def test_models_read_the_whole_url(spark):
    urls = ["http://x.net/p?id=good", "http://x.net/p?id=zzzz", "http://x.net/p#zzzz", "http://x.net/p", "good.net/good", "zzzz.net/zzzz", None]
    urls += [f"http://good{i}.org/good?id=good{i}" for i in range(60)] + [f"http://zzzz{i}.com/de/zzzz?id=zzzz{i}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: r for r in op6.filter_urls(rows).collect()}
    assert len({found[i]["score"] for i in range(4)}) == 4 and found[0]["score"] > found[1]["score"]
    assert (found[4]["verdict"], found[5]["verdict"]) == ("allow", "block")
    assert {(found[i]["host"], found[i]["path"]) for i in range(4)} == {("x.net", "/p")} and (found[4]["host"], found[4]["path"]) == ("", "")

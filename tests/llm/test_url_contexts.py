"""Models with more contexts than the automaton holds, and scores beyond the thresholds."""

import random
import zlib

import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op06_url_filter as op6  # noqa: E402
from tests.llm.test_url_model import model, score  # noqa: E402

#: No URL has so many contexts.
ALL = 10**9


def many_urls():
    rng = random.Random(9)
    word = lambda s, n=12: "".join(rng.choice(s) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    urls = [f"http://{word(letters)}.com/{x}/{word(letters)}" for x in ("fr", "de") for _ in range(200)]
    # Unruled: new words, words of ruled ones (one of them very often), copies, none, odd symbols, a long one.
    urls += [f"http://{word(letters)}.net/{word(letters)}" for _ in range(60)]
    urls += [f"http://{urls[i][-12:]}.net/{urls[-i][-12:]}" for i in range(1, 60)] + [f"http://x.net/{urls[0][7:19]}/{i}" for i in range(150)]
    return [*urls, None, "", "é^$", urls[0], urls[0], "http://x.net/" + "".join(u[7:] for u in urls[:300:7])]


@pytest.mark.parametrize("dense", [1, 300, None])
def test_every_context_counts(spark, dense):
    urls = many_urls()
    kinds = ["allow" if u and ".com/fr/" in u and "x.net" not in u else "block" if u and ".com/de/" in u and "x.net" not in u else None for u in urls]
    counts, kept = model([(v, u) for v, u in zip(kinds, urls, strict=True) if v and zlib.crc32(u.encode()) % 4 != 2], ALL)
    assert len(kept) > 2 * 2048
    rows = spark.createDataFrame([(i if i % 40 else None, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    got = op6.filter_urls(rows, **({} if dense is None else {"dense": dense})).collect()
    found = sorted((-1 if r["page_id"] is None else r["page_id"], r["score"]) for r in got)
    want = sorted((i if i % 40 else -1, score(counts, kept, u)) for i, u in enumerate(urls))
    assert [x[0] for x in found] == [x[0] for x in want]
    assert [x[1] for x in found] == pytest.approx([x[1] for x in want], abs=2e-9)


def test_scores_below_the_lowest_threshold_are_rejected(spark):
    held = spark.createDataFrame([("allow", -5.0), ("allow", 7.0), ("block", -7.25), ("block", -5.000000001)], "verdict string, score double")
    assert op6.calibrate(held).first()["threshold"] == -5.0

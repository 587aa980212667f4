"""Search by postings against search by scan."""

import random

import pytest

from codeloom.operators import search
from tests.rows import symbols


@pytest.mark.parametrize("few", [0, 10**9])
def test_postings_find_what_a_scan_finds(spark, monkeypatch, few):
    rng = random.Random(4)
    parts = ["Order", "order", "XMLParser", "v2", "ΟΔΟΣ", "straße", "İstanbul", "a", "ab", "x_y", "ПриветМир", "N42b", "日本", "__", "É"]
    rows = [(f"s{i:03d}", "".join(rng.choices(parts, k=rng.randint(1, 3))), f"{rng.choice(['src', 'Lib', 'ü'])}/{rng.choice(parts)}.cs") for i in range(150)]
    s = symbols(spark, *rows).cache()
    index = search.index_of(s)
    monkeypatch.setattr(search, "FEW", few)
    monkeypatch.setattr(search, "SHARE", 10**9)
    for query in ("order", "rde", "xmlp v2", "a", "ab", "дом", "мир", "42", "ΔΟ", "stra", "istan", "__", "zzz", "order n4", "日", "é", "y.c"):
        found = {r["id"]: r["score"] for r in search.scored(s, query, index).select("id", "score").collect()}
        want = s.where(search.is_exact(query))
        want = want if not want.isEmpty() else s.where(search.matches(query))
        assert set(found) == {r["id"] for r in want.collect()}, query

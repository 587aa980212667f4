"""The automaton against the models it stands for, computed symbol by symbol, and the calibrated threshold."""

import math
import random
import zlib
from collections import Counter

import pytest

op6 = pytest.importorskip("codeloom.llm.op06_url_filter")


def symbols_of(url):
    out = [op6.START]
    for c in (url or ""):
        c = c.lower() if c.isascii() else c
        out.append(op6.ALPHABET.find(c) + 1 if c not in "^$ " and c in op6.ALPHABET else op6.OTHER)
    return [*out, op6.END]


def model(urls, most):
    """Counts by context, and the contexts that are kept."""
    counts = {v: {} for v in ("allow", "block")}
    for verdict, url in urls:
        s = symbols_of(url)
        for i in range(1, len(s)):
            for k in range(min(i, op6.ORDER) + 1):
                counts[verdict].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    total = Counter()
    for own in counts.values():
        for context, c in own.items():
            total[context] += sum(c.values())
    number = lambda c: sum(x * op6.A**i for i, x in enumerate(reversed(c)))
    ranked = sorted((c for c in total if c), key=lambda c: (-total[c], len(c), number(c)))
    return counts, {(), *ranked[: most - 1]}


def probability(own, kept, context, symbol):
    p = 1 / (len(op6.ALPHABET) - 1)
    for k in range(len(context) + 1):
        c = own.get(context[len(context) - k :])
        if c:
            n, t = sum(c.values()), len(c)
            p = (c[symbol] + t * p) / (n + t)
    return p


def score(counts, kept, url):
    s, total = symbols_of(url), 0.0
    for i in range(1, len(s)):
        context = next(tuple(s[i - k : i]) for k in range(min(i, op6.ORDER), -1, -1) if tuple(s[i - k : i]) in kept)
        total += math.log(probability(counts["allow"], kept, context, s[i])) - math.log(probability(counts["block"], kept, context, s[i]))
    return total / (len(s) - 1)


@pytest.mark.parametrize("most", [1, 40, 2048])
def test_scores_are_those_of_the_models(spark, most):
    rng = random.Random(most)
    urls = [(rng.choice(["allow", "block"]), "".join(rng.choice("abc/?=%é") for _ in range(rng.randint(0, 14)))) for _ in range(60)]
    asked = [u for _, u in urls] + ["zzz", "", None, "A$b^c d", "https://ü.example/x?y=1#z" + "ab/" * 400]
    frame = spark.createDataFrame(urls, "verdict string, url string").select("verdict", op6.symbols(op6.F.col("url")).alias("symbols"))
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, url string").select("i", op6.symbols(op6.F.col("url")).alias("symbols"))
    assert [r["symbols"] for r in rows.orderBy("i").collect()] == [symbols_of(u) for u in asked]
    counts, kept = model(urls, most)
    got = {r["i"]: r["score"] for r in op6.scored(rows, op6.cut(op6.automaton(frame, most))).collect()}
    for i, u in enumerate(asked):
        assert got[i] == pytest.approx(score(counts, kept, u), abs=2e-9)


def test_verdicts_by_brute_force(spark):
    rng = random.Random(1)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(4, 9)))
    urls = [f"http://{word('abcde')}.com/fr/{word('xyz')}?q={word('abc')}" for _ in range(150)] + [f"http://{word('vwxyz')}.com/de/{word('abc')}&r={word('xyz')}" for _ in range(150)]
    urls += [f"http://{word('abcde')}.net/{word('xyz')}?q={word('abc')}" for _ in range(60)] + [f"http://{word('vwxyz')}.net/{word('abc')}&r={word('xyz')}" for _ in range(60)]
    urls += [None, "", "http://x.net/", urls[0], urls[0]]
    rows = [(i if i % 50 else None, u, "r", 0.5) for i, u in enumerate(urls)]
    got = op6.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, score double")).select("rule", "verdict", "score", "host", "path").collect()
    want, train, held = [], [], []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        verdict = "allow" if "/fr/" in rest else "block" if "/de/" in rest else None
        want.append(verdict)
        if verdict:
            (held if zlib.crc32(u.encode()) % 4 == 2 else train).append((verdict, u))
    counts, kept = model(train, op6.MOST_STATES)
    scores = [(v, round(score(counts, kept, u), 9)) for v, u in held]
    rate = lambda t: sum(v == "allow" and s >= t for v, s in scores) / sum(v == "allow" for v, _ in scores) + sum(v == "block" and s < t for v, s in scores) / sum(v == "block" for v, _ in scores)
    grid = [(rate(t / 100), t) for t in range(-500, 501)]
    best = [t for g, t in grid if g == max(grid)[0]]
    threshold = best[(len(best) + 1) // 2 - 1] / 100
    ours = sorted((r["verdict"], r["score"], r["rule"] or "") for r in got)
    theirs = sorted((v or ("allow" if round(score(counts, kept, u), 9) >= threshold else "block"), round(score(counts, kept, u), 9), {"allow": "com/fr/", "block": "com/de/"}.get(v, "")) for v, u in zip(want, urls, strict=True))
    assert [x[0] for x in ours] == [x[0] for x in theirs] and [x[2] for x in ours] == [x[2] for x in theirs]
    assert all(abs(a[1] - b[1]) < 3e-9 for a, b in zip(ours, theirs, strict=True))
    # The models tell unruled URLs of both kinds apart.
    judged = [r["verdict"] for r in op6.filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, score double")).where("host like '%.net' and host <> 'x.net'").orderBy("host").collect()]
    assert judged.count("allow") == 60 and judged[:60].count("allow") == 60


def test_nothing_and_one_kind_only(spark):
    schema = "page_id long, url string"
    assert op6.filter_urls(spark.createDataFrame([], schema)).count() == 0
    got = op6.filter_urls(spark.createDataFrame([(1, f"http://a.com/fr/{i}") for i in range(20)] + [(2, "http://b.net/x")], schema)).collect()
    assert {(r["verdict"], r["score"]) for r in got} == {("allow", 0.0)}

"""License texts and headers longer than a notice."""

import random

import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op10_license_scan as op10  # noqa: E402


def shingles(text):
    w = op10.words_of(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_texts_and_headers_are_found(spark):
    rng = random.Random(5)
    pad = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    names = list(op10.TEXTS)
    rows = [(i, f"{pad(rng.randrange(700))} {op10.TEXTS[n]} {pad(rng.randrange(700))}") for i, n in enumerate(names)]
    rows += [(100, op10.TEXTS["mit-text"].replace("furnished", "given")), (101, " ".join(op10.words_of(op10.TEXTS["mit-text"])[:90])), (102, pad(2000)), (103, None)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in op10.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, m): 1.0 for i, n in enumerate(names) for m in names if shingles(op10.TEXTS[m]) <= shingles(op10.TEXTS[n])}
    long = {k: v for k, v in got.items() if k[1] in op10.TEXTS and k[0] < 100}
    assert long == want and all(n == names[i] for i, n in long)
    assert {k for k in got if k[0] >= 100} == {(100, "mit-text")} and 0.95 <= got[100, "mit-text"] < 1


def test_callers_own_texts(spark):
    text = " ".join(f"word{i}" for i in range(900))
    frame = spark.createDataFrame([(1, "a b c " * 300 + text), (2, "a b c")], "doc_id long, text string")
    got = op10.scan_licenses(frame, {}, texts={"long": text, "short": "a b c"}).collect()
    assert {(r["doc_id"], r["license"], r["containment"]) for r in got} == {(1, "long", 1.0), (1, "short", 1.0), (2, "short", 1.0)}
    with pytest.raises(ValueError):
        op10.scan_licenses(frame, {"x": "one two three"}, texts={"x": "one two three"})


def brute(rows, templates, containment=0.95):
    """All windows of all shelves by exact shares."""
    notices, longer = op10.split_by_length(templates)
    out = {}
    for doc_id, text in rows:
        w = op10.words_of(text or "")
        own = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        if not own:
            continue
        for window, stride, shelf in op10.shelves(notices, longer):
            for start in range(0, max(0, len(own) + 2 - window + stride - 1) + 1, stride):
                held = set(own[start : start + window - 2])
                for name, t in shelf.items():
                    want = shingles(t)
                    share = len(held & want) / len(want)
                    if share >= containment:
                        n, best, first = out.get((doc_id, name), (0, 0.0, start))
                        out[doc_id, name] = n + 1, max(best, share), min(first, start)
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    templates = {f"t{n}": text(n) for n in (3, 5, 12, 13, 14, 40, 75, 200, 410)}
    rows = [(0, None), (1, ""), (2, "v1 v2")]
    for i in range(3, 70):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(list(templates.values())).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            parts += [" ".join(w[: rng.choice([len(w), len(w), len(w) - 1])]), text(rng.randrange(90))]
        rows.append((i, " ".join(parts)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as start", "3 as all")
    got = {(r["doc_id"], r["license"]): (r["windows"], r["containment"], r["first_word"]) for r in op10.scan_licenses(frame, templates).collect()}
    assert got == brute(rows, templates) and len(got) > 20
    assert op10.scan_licenses(frame.limit(0)).count() == 0


def test_a_long_licence_with_edits(spark):
    rng = random.Random(2)
    words = [f"clause{rng.randrange(5000)}" for _ in range(1500)]
    edited, other = list(words), list(words)
    for at in rng.sample(range(1500), 20):
        edited[at] = "changed"
    for at in rng.sample(range(1500), 90):
        other[at] = "changed"
    rows = [(1, "x y z " * 500 + " ".join(edited) + " tail" * 900), (2, " ".join(other)), (3, " ".join(words[:1400])), (4, None), (1, "x"), (None, " ".join(words))]
    got = {r["doc_id"]: r["containment"] for r in op10.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), {"long": " ".join(words)}).collect()}
    assert set(got) == {1, None} and 0.95 <= got[1] < 1 and got[None] == 1


def test_bands_meet_what_has_to_be_found():
    """The probability that all bands miss, at the least similarity of a template wholly in its window."""
    notices, longer = op10.split_by_length(op10.TEMPLATES | op10.TEXTS)
    for window, _, own in op10.shelves(notices, longer):
        for t in own.values():
            least = len(shingles(t)) / (window - 2)
            assert (1 - least) ** op10.BANDS < 1e-6

"""Language, fingerprints and the pipeline against plain versions of their definitions."""

import hashlib
import math
import random
from collections import Counter

import pytest

pytest.importorskip("codeloom.llm")
from codeloom.llm import op04_language_id as op4  # noqa: E402
from codeloom.llm import op07_fingerprint as op7  # noqa: E402


def text_grams(text):
    """Letters with runs of others as one separator, and one at each end: letters, pairs, and triples around a letter."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = " " + " ".join(runs) + " "
    if not runs:
        return Counter()
    out = Counter(c for c in s if c != " ")
    out.update(s[i : i + 2] for i in range(len(s) - 1))
    out.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    return out


def number(gram, of):
    return len(gram), tuple(0 if c == " " else of(c) for c in gram)


def profiles(rows, size):
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(text_grams(text))
    return {k: sorted(c, key=lambda g: (-c[g], number(g, ord)))[:size] for k, c in counts.items()}


def predict(learned, text, size):
    alphabet = {c: i for i, c in enumerate(sorted({c for own in learned.values() for g in own for c in g if c != " "}), 1)}
    # Letters of no profile are one symbol.
    other = chr(0x10FFFD)
    folded = Counter()
    for g, n in text_grams(text or "").items():
        folded["".join(c if c in alphabet or c == " " else other for c in g)] += n
    if not folded:
        return "und", 0.0
    own = sorted(folded, key=lambda g: (-folded[g], number(g, lambda c: alphabet.get(c, 1023))))[:size]
    best = []
    for lang in sorted(learned):
        rank = {g: i for i, g in enumerate(learned[lang])}
        best.append((sum(abs(rank[g] - i) if g in rank else size for i, g in enumerate(own)), lang))
    distance, lang = min(best)
    return lang, 1 - distance / (size * len(own))


@pytest.mark.parametrize("size", [5, 60, 400])
def test_language_by_out_of_place_distance(spark, size):
    rng = random.Random(size)
    letters = {"aa": "abcdeé ", "bb": "acdßöf ", "cc": "абвгд "}
    make = lambda lang, n: "".join(rng.choice(letters[lang] + ".1\n") for _ in range(n))
    rows = [(i, lang, make(lang, rng.randrange(1, 200))) for i in range(40) for lang in letters] + [(900, "aa", None), (901, None, make("bb", 50))]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = op4.learn(frame, size=size)
    plain = profiles([(lang, t) for _, lang, t in rows if lang and t], size)
    asked = [t for _, _, t in rows] + ["", "123", "日本 zzz ﷺ", "é", "a" * 300_000, make("aa", 5000) + make("cc", 4900), None, "aI·ΣςÅ"]
    got = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").select("doc_id", op4.language(learned).alias("p")).collect()
    for r in got:
        lang, score = predict(plain, asked[r["doc_id"]], size)
        assert r["p"]["lang"] == lang and r["p"]["score"] == pytest.approx(score, abs=1e-12)


def test_language_query_on_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, lang_pred string, score string, source string"
    rows = [(i, "the cat sat on the mat " * 3, "en", "x", "y", "s") for i in range(20)] * 2 + [(None, "el gato", "es", "", "", None), (50, None, "en", "", "", ""), (51, "...", None, "", "", "")]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = op4.op4_language_id(spark, str(tmp_path / name)).collect()
        assert len(got) == len(part) and {r["lang_pred"] for r in got if r["doc_id"] is not None} <= {"en", "und"}
    # Spanish is in a row without id only, which teaches nothing.
    assert "es" not in {r["lang_pred"] for r in got}


SCALE = 1 << 16


def entropy(window):
    total = sum(round(n * math.log2(n) * SCALE) for n in Counter(window).values())
    return 1000 - total * 1000 // (6 * 64 * SCALE)


def chosen(data):
    n = len(data) - 63
    rarity = [abs(entropy(data[i : i + 64]) - 620) + 1 for i in range(n)]
    points = Counter()
    for s in range(-63, n):
        row = range(max(0, s), min(n, s + 64))
        points[max(row, key=lambda i: (rarity[i], -i))] += 1
    return [i for i in range(n) if points[i] >= 8]


def filters(data):
    """Bits of each filter, and how many features each has."""
    data = data.ljust(64, b"\0") if data else b""
    seen, mask = [], (1 << 64) - 1
    for i in chosen(data) if data else []:
        h = 0x243F6A8885A308D3
        for k in range(8):
            h = ((h ^ int.from_bytes(data[i + 8 * k : i + 8 * k + 8], "little")) * 0x9E3779B97F4A7C15) & mask
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
        h ^= h >> 32
        if h not in seen:
            seen.append(h)
    out = []
    for lo in range(0, len(seen), 160):
        own = seen[lo : lo + 160]
        out.append(({h >> (11 * k) & 2047 for h in own for k in range(5)}, len(own)))
    return out


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    if (len(a), sum(n for _, n in a)) > (len(b), sum(n for _, n in b)):
        a, b = b, a
    total = 0.0
    for bits, n in a:
        best = 0.0
        for other, _ in b:
            least, most = len(bits) * len(other) / 2048, min(len(bits), len(other))
            low = least + 0.1 * (most - least)
            best = max(best, min(1.0, max(0.0, (len(bits & other) - low) / max(most - low, 1e-9))))
        total += best * n
    return total / sum(n for _, n in a)


def test_fingerprints_by_definition():
    rng = random.Random(3)
    text = lambda n: bytes(rng.choice(b"abcdefgh  .,xyz\xc3\xa9") for _ in range(n))
    texts = [b"", b"a", b"short text", bytes(64), text(63), text(64), text(65), text(700), text(9000), b"ab" * 500, bytes(rng.randrange(256) for _ in range(2000))]
    texts.append(texts[8][:5000] + text(3000))
    plain = [filters(t) for t in texts]
    for t, f, got in zip(texts, plain, [op7.Fingerprint(h) for h in op7.features(texts)], strict=True):
        assert [set(map(int, row.nonzero()[0])) for row in got.bits] == [bits for bits, _ in f], t[:20]
        assert got.counts.tolist() == [n for _, n in f]
    prints = [op7.Fingerprint(h) for h in op7.features(texts)]
    for a, x in zip(prints, plain, strict=True):
        for b, y in zip(prints, plain, strict=True):
            assert op7.likeness(a, b) == pytest.approx(alike(x, y), abs=1e-9)


def test_fingerprints_of_odd_tables(spark):
    schema = "doc_id long, text string, part string, h int, tail string"
    rows = [(3, "same text " * 20, "x", 1, ""), (3, "same text " * 20, "x", 1, ""), (3, "another " * 30, "", 2, ""), (None, "no id", "", 3, ""), (1, None, "", 4, "")]
    got = op7.fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == [(0, 5), (1, 0), (3, 200), (3, 200), (3, 240)]
    assert op7.fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    assert [r["near_next"] for r in op7.fingerprint_documents(spark.createDataFrame(rows[:1], schema)).collect()] == [1.0]


def test_pipeline_against_plain_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers = pytest.importorskip("tokenizers")
    from codeloom.llm.op08_bpe import vocabulary_path

    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [None, "", "123 456", " ", "one", "One"]
    for _ in range(25):
        base = make(rng.randint(5, 150))
        texts.append(base)
        for _ in range(rng.randrange(5)):
            w = base.split()
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, None if k % 4 == 0 else "xx", None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}

    known = sorted((i, t, lang, s) for i, t, lang, s, _ in rows if any(c.isalpha() for c in t or ""))
    sets = []
    for _, t, _, _ in known:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(known)))
    for i in range(len(known)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    kept = [r for i, r in enumerate(known) if parent[i] == i]
    assert set(got) == {i for i, _, _, _ in kept} and len(kept) < len(known)
    encoder = tokenizers.Tokenizer.from_file(vocabulary_path())
    encoder.no_truncation()
    encoder.no_padding()
    for i, t, _, s in kept:
        own = encoder.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(own) and list(got[i]["ids"]) == own and got[i]["source"] == s and got[i]["lang"] == "xx"
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()


def test_pipeline_stages_on_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` long, `a.b` int, mix_slot long"
    rows = [(1, "alpha beta gamma", "en", "s", 3, "r", 1, 1, 5), (1, "alpha beta gamma", "en", "s", 3, "r", 1, 1, 5), (None, "delta", None, None, None, None, None, None, None)]
    for part in (rows, []):
        frame = spark.createDataFrame(part, schema)
        for _, stage in pipeline.STAGES[:-1]:
            made = stage(spark, frame, "")
            assert made.columns == frame.columns
            frame = spark.createDataFrame(made.collect(), frame.schema)
        assert frame.count() == (2 if part else 0)
        assert pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()

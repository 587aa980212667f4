"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("codeloom.llm")
from codeloom.llm import op01_token_files as op1  # noqa: E402
from codeloom.llm import op02_embedding_dedup as op2  # noqa: E402
from codeloom.llm import op03_html_text as op3  # noqa: E402
from codeloom.llm import op04_language_id as op4  # noqa: E402
from codeloom.llm import op05_mixing as op5  # noqa: E402
from codeloom.llm import op06_url_filter as op6  # noqa: E402
from codeloom.llm import op07_fingerprint as op7  # noqa: E402
from codeloom.llm import op08_bpe as op8  # noqa: E402
from codeloom.llm import op09_jaccard_join as op9  # noqa: E402
from codeloom.llm import op10_license_scan as op10  # noqa: E402
from codeloom.llm.common import components  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, mix_slot int, token string"
ODD = [None, "", " \n\t ", "a", "Zoë's don't 12 x", "<|endoftext|>hi <|startoftext|>", "ΟΔΟΣ ß İ é ​🙂🙂", "\x1c\x1f\x85 q", "ab " * 20_000]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None if i % 3 == 0 else f"s{i % 2}", 7, "x") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op8.vocabulary_path())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_token_files(spark, library, tmp_path):
    rng = random.Random(1)
    texts = [*ODD, *[words(rng, rng.randint(0, 200)) for _ in range(40)]]
    folder = f"file://{tmp_path}/files"
    index = op1.write_token_files(docs(spark, texts), folder, op8.vocabulary_path(), length=16, batch=4, docs_per_shard=10).cache()
    index.count()
    found = {r["doc_id"]: r for r in op1.read_token_files(index, folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, op1.END_ID]
        want = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == want
        start += len(ids)
    reader = op1.SequenceReader(folder, op1.shard_name(0))
    own = index.where("shard = 0").agg({"n_tokens": "sum"}).first()[0]
    masks = [m for i in range(len(reader)) for m in reader.sequence(i)[1].to_pylist()]
    assert sum(masks) == own and masks[:own] == [True] * own and len(reader.sequence(0)[0]) == 16
    assert op1.read_token_files(op1.write_token_files(docs(spark, []), folder, op8.vocabulary_path()), folder).count() == 0


def test_bpe_is_the_librarys(spark, library):
    rng = random.Random(2)
    texts = [*ODD, *[words(rng, 50) for _ in range(20)]]
    for r in op8.encode_documents(docs(spark, texts), op8.vocabulary_path(), digest_only=False).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    near = base[:150] + 0.04 * rng.standard_normal((150, 32)) * np.linalg.norm(base[:150], axis=1, keepdims=True) / 5
    hot = base[0] + 0.01 * rng.standard_normal((1500, 32))
    x = np.concatenate((base, near, hot, base[:20]))
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)]
    bad = [(90_000, None, 1), (90_001, [0.0] * 32, 1), (90_002, [float("nan")] * 32, 1), (90_003, [1.0] * 32, None), (90_004, [None] * 32, 1), (90_005, [1.0] * 8, 1)]
    found = {r["vec_id"]: r for r in op2.embedding_links(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.equal.outer(np.arange(len(x)) % 2, np.arange(len(x)) % 2)
    links = (unit @ unit.T >= op2.COSINE) & same & ~np.eye(len(x), dtype=bool)
    assert len(found) == len(rows) + len(bad)
    assert sum(found[i]["n_links"] for i in range(len(x))) >= 0.98 * links.sum()
    assert all(found[i]["n_links"] <= links[i].sum() for i in range(len(x)))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i, _, _ in bad)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html_text(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies here</div><article><h1>A &amp; B</h1>"
        "<p>One <b>two</b>three\n four<br>five<p>Six<aside>advert words here</aside><p>Seven &eacute;ight.<form>name</form></article><section id='comments'><p>I liked this a lot</p></section><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page, 1), (2, "u", None, 1), (3, "u", "", 1), (4, "u", "<nav>only</nav>", 1), (5, "u", page, 1), (6, "u", "<p>" + "long text " * 50_000, 1)]
    found = {r["page_id"]: r for r in op3.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert found[1]["text"] == found[5]["text"] == "A & B One twothree four five Six Seven éight."
    assert [found[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and found[6]["n_chars"] == 10 * 50_000 - 1
    assert op3.best_run([-1.0, 2.0, -1.0, 3.0, -9.0, 3.0]) == (1, 3) and op3.best_run([-1.0]) == (0, -1)


def test_language(spark):
    rng = random.Random(4)
    text = {"aa": lambda: " ".join(rng.choice(["the", "thing", "with", "other"]) for _ in range(30)), "bb": lambda: " ".join(rng.choice(["été", "où", "quand", "même"]) for _ in range(30))}
    rows = [(i, text[lang](), lang, None) for i in range(60) for lang in ("aa", "bb")]
    rows += [(200, None, "aa", None), (201, "12 !!", "bb", None), (202, "", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = op4.learn(frame)
    found = frame.select("doc_id", "lang", op4.language(profiles).alias("p")).collect()
    assert all(r["p"]["lang"] == r["lang"] and 0 <= r["p"]["score"] <= 1 for r in found if r["doc_id"] < 200)
    assert [r["p"]["lang"] for r in found if r["doc_id"] >= 200] == ["und"] * 3
    assert op4.Profiles({}, 10).predict("abc") == ("und", 0.0)


def test_mixing(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 4}", i) for i in range(900)] + [(1, "t1", "s1", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, w long")
    got = op5.mix(frame, {"hot": 0.2, "s1": 0.5, "s2": 0.1, "s3": 0.1, "s0": 0.1}, block_docs=4, period=100).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(rows)))
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["mix_block"]), (r["mix_slot"], r["mix_release"], r["mix_deadline"], r["mix_weight"]))
    slots = {v[0]: k[0] for k, v in blocks.items()}
    assert len(slots) == len(blocks) and all(v[1] <= v[0] < v[2] for v in blocks.values())
    # While no source has run out, each is less than one block off its share.
    first_end = min(max(v[0] for k, v in blocks.items() if k[0] == s) for s in {k[0] for k in blocks})
    for s in {k[0] for k in blocks}:
        w = next(v[3] for k, v in blocks.items() if k[0] == s)
        for t in range(first_end + 1):
            assert abs(sum(slots.get(x) == s for x in range(t + 1)) - (t + 1) * w) < 1
    assert op5.mix(frame.limit(0)).count() == 0


def test_mixing_scales(spark):
    """A source of a million rows, 2,000 sources, and clashing names."""
    rows = spark.range(1_000_000).selectExpr("id as doc_id", "'one' as source").unionByName(spark.range(1_000_000, 1_000_050).selectExpr("id as doc_id", "'two' as source"))
    got = op5.mix(rows, {"one": 0.5, "two": 0.5})
    assert got.agg(F.count_distinct("mix_position"), F.max("mix_position"), F.min("mix_position")).first() == (1_000_050, 1_000_049, 0)
    assert got.where("source = 'two' and mix_slot > 8").count() == 0
    many = spark.range(8_000).selectExpr("id as doc_id", "'s' || id % 2000 as source", "id as mix_slot", "id as mix_slot_of_input")
    got = op5.mix(many)
    assert got.agg(F.count_distinct("mix_position"), F.sum("mix_slot_of_input"), F.count_distinct("mix_slot")).first() == (8_000, sum(range(8_000)), 2_000)
    assert "mix_slot_of_input_" in got.columns
    before = op5.documents_before(op5.source_table(rows, {"one": 0.5, "two": 0.5}))
    assert before[-1][1] == 1_000_050 and [d for _, d in before] == sorted(d for _, d in before)


def test_url_filter(spark):
    urls = [None, "", "no-scheme", "HTTP://A.ORG/x", "https://example.org", "http://x.example.org/es/1?q#f", "http://notexample.org/en/1", "http://example.org/en/12", "http://b.com/de/1", "http://b.com/fr/1", "http://ü.net/\n" + "y" * 9000]
    urls += [f"http://good{i}.org/page/{i}" for i in range(60)] + [f"http://bad{i}.com/de/x{i}" for i in range(60)]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in op6.filter_urls(rows).collect()}
    assert [(found[i]["host"], found[i]["path"], found[i]["rule"]) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.org", "/x", "org/"), ("example.org", "", None), ("x.example.org", "/es/1", "example.org/es/"),
        ("notexample.org", "/en/1", "org/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/de/1", "com/de/"), ("b.com", "/fr/1", "com/fr/")]
    assert {r["verdict"] for r in found.values()} <= {"allow", "block"} and found[5]["verdict"] == "block"
    model = op6.automaton(rows.limit(0).selectExpr("'' as verdict", "array(1) as symbols")).first()
    assert model["next"] == [0] * op6.A and model["ratios"] == [0.0] * op6.A


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = [words(rng, 600), words(rng, 600), None, "", "short", words(rng, 20_000)]
    got = {r["doc_id"]: r for r in op7.fingerprint_documents(docs(spark, [*texts, texts[0]])).collect()}
    order = sorted(got, reverse=True)
    plain = [t or "" for t in [*texts, texts[0]]]
    for k, i in enumerate(order):
        j = order[(k + 1) % len(order)]
        edit = plain[i][: len(plain[i]) - len(plain[i]) // 2] + plain[j][: len(plain[i]) // 2]
        assert got[i]["n_chars"] == len(plain[i]) and got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["fingerprint"] == op7.fingerprints([plain[i]])[0].text()
    assert got[0]["fingerprint"] == got[6]["fingerprint"] and got[1]["near_edited"] > 0.3 > got[1]["near_next"]
    data = np.frombuffer(plain[0].encode()[:500], dtype=np.uint8)
    for i in (0, 100, 400):
        p = np.bincount(data[i : i + 64]) / 64
        assert abs(-(p[p > 0] * np.log2(p[p > 0])).sum() / 6 * 1000 - op7.entropies(data)[i]) <= 1


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 0))} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "num", "most"), [(3, 90, 64), (5, 80, 64), (5, 80, 0)])
def test_jaccard_components(spark, width, num, most):
    rng = random.Random(6)
    passage = words(rng, 60)
    base = [words(rng, rng.randint(1, 120)) for _ in range(12)]
    texts = [None, "", " \t", "One two", "one TWO", "a b c", *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            texts.append(" ".join(w))
    texts += [words(rng, 5) + " " + passage + " " + words(rng, 3) for _ in range(30)] + [passage] * 40
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op9.jaccard_components(docs(spark, texts), width, num, 100, pairs_per_entry=most).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width, num, 100)


def test_jaccard_of_nothing(spark):
    assert op9.jaccard_components(docs(spark, [])).count() == 0
    got = op9.jaccard_components(docs(spark, [None, ""])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(0, 0, 0), (1, 0, 1)]


def test_licenses(spark):
    mit, gpl = op10.TEMPLATES["mit"], op10.TEMPLATES["gpl-3.0"]
    texts = [None, "", "two words", mit, "x " * 11 + mit + " y" * 50, "x " * 40_000 + gpl, "released under the license", mit + " " + mit, "ünder " + gpl.upper()]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in op10.scan_licenses(docs(spark, texts)).collect()}
    assert got == {(3, "mit"): 1.0, (4, "mit"): 1.0, (5, "gpl-3.0"): 1.0, (7, "mit"): 1.0, (8, "gpl-3.0"): 1.0}
    with pytest.raises(ValueError):
        op10.scan_licenses(docs(spark, []), {"short": "two words"})


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(7)
    body = words(rng, 80)
    rows = [(i, body if i < 5 else words(rng, 40), "en", f"s{i % 2}", 1) for i in range(20)] + [(50, "123 !", "en", "s0", 1), (51, None, "en", "s0", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, "").collect(), frame.schema)
        kept[name] = sorted(r["doc_id"] for r in frame.collect())
    assert kept["language_id"] == list(range(20))
    assert kept["jaccard_join"] == kept["mix_sources"] == [0, *range(5, 20)]
    last = pipeline.STAGES[-1][1](spark, frame, "")
    assert last.count() == 16 and json.dumps(last.columns)

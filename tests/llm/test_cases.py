"""Edge cases of every corpus operator, brute force where the results have one, and isolation from the session."""

import random
import zlib
from fractions import Fraction
from math import floor, isfinite

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tideglass.llm import binary, decontaminate, langid, licenses, mixing, near_dedup, sharding, tokencount, topk, toxicity
from tideglass.llm.shared import Scratch, batched, shared_dir

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NAMES = ["score", "predicted", "hits", "items", "n_words", "_m", "_d", "_total", "lang_pred", "shard", "slot", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)


def prose(rng, n):
    return " ".join(rng.choice(["the", "sea", "mere", "tion", "anda", "orle", "kit", "vane", "hom", "lis", "quor"]) + rng.choice(["", "ta", "ne", "li"]) for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing further columns."""
    rng = random.Random(12)
    long = prose(rng, 9000)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, long, "en", "b"), (5, long, "en", "b"), (5, long, "en", "b"), (6, "one", "en", "a"), (6, "two words", "en", None)]
    rows += [(None, prose(rng, 30), None, None), (None, None, None, None), (7, "12 !? ́ 日本", "ja", "c")]
    rows += [(10 + i, prose(rng, 60), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(30)]
    return spark.createDataFrame([(*r, *("x" if k % 2 else None for k in range(len(NAMES)))) for r in rows], SCHEMA).cache()


def model():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        w = prose(rng, 30).split()
        if i % 3 == 0:
            w.insert(rng.randrange(30), "vilefrump")
        rows.append((" ".join(w), int(i % 3 == 0)))
    return toxicity.train(rows)


def test_every_operator_meets_hostile_rows(spark, hostile):
    n = hostile.count()
    bench = spark.createDataFrame([("a", prose(random.Random(1), 20)), (None, None), ("b", ""), ("b", "one")], "item_id string, text string")
    machine = model()
    scored = toxicity.score(hostile, machine)
    assert scored.count() == n and scored.where("predicted = 1").count() == 0
    assert toxicity.clean(hostile, machine).columns == hostile.columns
    assert sharding.layout(hostile).count() == n
    assert mixing.mix(hostile).count() == n and mixing.mixed(hostile).columns == hostile.columns
    near = near_dedup.near_duplicates(hostile).collect()
    assert len(near) == n and {r.component_id for r in near if r.doc_id == 5} == {4}
    assert near_dedup.deduplicated(hostile).columns == hostile.columns
    assert tokencount.count_edited(hostile.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).count() == n
    assert licenses.scan(hostile.select("doc_id", "text")).count() == n
    report = decontaminate.report(hostile, bench)
    assert report.count() == n and {r.doc_id for r in report.where("contaminated").collect()} == {6}
    assert decontaminate.decontaminated(hostile, bench).columns == hostile.columns
    assert langid.identify(hostile, langid.fit(hostile)).count() == n
    assert binary.round_trip(hostile, WORD).count() == n


def test_every_operator_meets_empty_tables(spark, hostile):
    none = hostile.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.score(none, None).count() == 0
    assert sharding.layout(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert topk.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert tokencount.count_edited(none.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN).count() == 0
    assert licenses.scan(none.select("doc_id", "text")).count() == 0
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0
    assert binary.round_trip(none, WORD).count() == 0


def test_top_k_of_ragged_tied_huge_and_repeated_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)] + [(1000 + i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(60)]
    rows += [(2000 + i, [1e300 * (-1) ** i, 0.5]) for i in range(2)] + [(2050, [1e305, 2.0, -1e12]), (2100, [3e7] * 8), (2150, []), (7, [0.1] * 8), (100, [0.2] * 8), (100, [0.1] * 8)]
    rows += [(None, [1.0]), (2200, None), (2250, [float("nan")] * 8), (2300, [None] * 8)] + [(3001 + i, [0.5] * 8) for i in range(30)]
    got: dict = {}
    for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = [(i, [floor(Fraction(x) * 256) for x in e], e) for i, e in rows if i is not None and e is not None and all(x is not None and isfinite(x) for x in e)]
    most, queries = (1 << 63) - 1, {}
    for i, e, raw in v:
        if i % 50 == 0 and (i not in queries or raw < queries[i][1]):
            queries[i] = (e, raw)
    want = {}
    for i, (e, _) in queries.items():
        best = sorted((-sum(a * b for a, b in zip(e, c)), j) for j, c, _ in v if j != i)[:5]
        want[i] = [(j, max(-most, min(most, -s))) for s, j in best]
    assert got == want


def test_kernel_is_the_one_described():
    def features(w):
        w, out = f"\x02{w}\x03", {}
        for a in range(len(w)):
            for b in range(a + 1, len(w)):
                for c in range(b + 1, len(w)):
                    for d in range(c + 1, min(len(w), a + toxicity.SPAN)):
                        k = w[a] + w[b] + w[c] + w[d]
                        out[k] = out.get(k, 0) + toxicity.DECAY ** (d - a + 1)
        return out

    words = ["idiot", "idxiot", "aaaaaaa", "abcabcabc", "zzz", "mere"]
    row, key, v = toxicity._explicit(words)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            p, q = features(x), features(y)
            want = sum(p[k] * q.get(k, 0) for k in p) / (sum(t * t for t in p.values()) * sum(t * t for t in q.values())) ** 0.5
            a, b = dict(zip(key[row == i].tolist(), v[row == i])), dict(zip(key[row == j].tolist(), v[row == j]))
            assert abs(sum(a[k] * b.get(k, 0) for k in a) - want) < 1e-9
    machine = model()
    every = sorted({u for t in ("vilefrump x vile.frump", "the sea mere") for u in toxicity.units(t)})
    above = machine.every(every, above=True)
    assert all(a == b or (a == float("-inf") and b <= machine.bias) for a, b in zip(above, machine.every(every)))


def test_a_shard_is_found_by_the_tree_alone(spark):
    rows = [(i, f"text {i}", i % 7) for i in range(400)] + [(None, None, 0), (3, "text 3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    got = sharding.layout(docs).collect()
    again = {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.layout(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.text_crc32, r.shard, r.slot) for r in got} == again
    for r in got:
        text = None if r.doc_id is None else f"text {r.doc_id}"
        assert r.text_crc32 == zlib.crc32((text or "").encode()) and r.size == len((text or "").encode()) + 1 and 0 <= r.shard < 16
    assert len({r.shard for r in got}) == 16


def test_segments_are_read_by_select():
    t = Tokenizer.from_file(WORD)
    texts = ["a b", "", "don't stop.", "Été İx AΣ. 2024!!", "x" * 40]
    e = binary.WordEncoder(WORD)
    assert e.by_words
    ids, bounds = e.encode([x.encode() for x in texts], 2)
    assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]]
    s = binary.Segment(binary.pack([None, -5, -5, 7, 1 << 40], ids, bounds, 2))
    assert s.doc_ids() == [None, -5, -5, 7, 1 << 40] and s.offsets().tolist() == bounds.tolist()
    assert [s.find(k) for k in (-5, 7, 1 << 40, 8, -6)] == [1, 3, 4, None, None]
    assert s.document(2).tolist() == ids[bounds[2] : bounds[3]].tolist()
    other = binary.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_words
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.encode([x.encode() for x in texts], 2)[0].tolist() == [i for x in texts for i in [*whole.encode(x, add_special_tokens=False).ids, 2]]


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    rng = random.Random(6)
    item = prose(rng, 25)
    texts = {}
    for i in range(300):
        w = prose(rng, 60).split()
        if i % 4 == 0:
            w.insert(rng.randrange(60), "vilefrump")
        texts[i] = " ".join(w)
    base = texts[1].split()
    for i in range(300, 305):
        w = list(base)
        w[rng.randrange(60)] = f"edit{i}"
        texts[i] = " ".join(w)
    texts[305] = texts[2]
    for i in (306, 307):
        texts[i] = prose(rng, 20) + " " + item + " " + prose(rng, 20)
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in texts.items()] + [(400, None, None, None), (401, "", "en", "a"), (None, prose(rng, 50), "en", "b"), (402, prose(rng, 9000), "en", "a"), (402, prose(rng, 40), "en", "a")]
    docs = spark.createDataFrame([(*r, "x", None, "y") for r in rows], "doc_id long, text string, lang string, source string, `_m` string, score string, hits string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("k", item), ("none", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        now = out.cache()
        kept[name] = sorted((r.doc_id for r in now.collect()), key=lambda x: -1 if x is None else x)
    toxic = {i for i in range(0, 300, 4)}
    want = [i for i in [None, *range(308), 400, 401, 402, 402] if i not in toxic]
    assert kept["toxicity"] == want
    want = [i for i in want if i not in range(300, 306)]
    assert kept["near_dedup"] == want
    want = [i for i in want if i not in (306, 307)]
    assert kept["decontamination"] == want and set(kept["mixing"]) <= set(want) and not {400, 401} & set(kept["mixing"])
    t = Tokenizer.from_file(WORD)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = sorted((r.doc_id or -1, len(t.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in now.collect())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == tokens
    assert sorted(r.start for r in got)[0] == 0 and len({r.start for r in got}) == len(got)


def test_the_session_is_left_as_it_was(spark, hostile):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    near_dedup.near_duplicates(hostile)
    binary.round_trip(hostile, WORD)
    topk.nearest(spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<double>"))
    assert spark.conf.get(key, None) == before
    with pytest.raises(ValueError), batched(spark, 3), Scratch(spark) as s:
        s.keep(spark.range(3), "x")
        path = s.paths[0]
        raise ValueError
    assert spark.conf.get(key, None) == before and shared_dir(spark) in path
    with pytest.raises(Exception):
        spark.read.parquet(path).count()

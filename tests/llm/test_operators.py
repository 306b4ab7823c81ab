"""Brute-force, round-trip and edge-case tests of the corpus operators."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideglass.llm import binary, decontaminate, langid, licenses, mixing, near_dedup, queries, sharding, tokencount, topk, toxicity
from tideglass.llm.hashing import shingle_sets
from tideglass.llm.sketch import sketches

DOC = "doc_id long, text string, lang string, source string, shard string, score string, n_words string"
WORD = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n):
    return " ".join(rng.choice(["the", "sea", "mere", "tion", "anda", "orle", "kit", "vane", "hom", "lis", "quor"]) + rng.choice(["", "ta", "ne", "li"]) for _ in range(n))


EDGE = [None, "", "   \n\t ", "one", "one two three four", "One TWO three four", "long " * 5000]


def test_near_duplicates_brute_force(spark):
    rng = random.Random(3)
    texts = list(EDGE)
    base = [prose(rng, 120) for _ in range(12)]
    for b in base:
        texts.append(b)
        for _ in range(5):
            w = b.split()
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            texts.append(" ".join(w))
    hot = [" ".join(w if rng.random() > 0.012 else f"e{rng.random()}" for w in base[0].split()) for _ in range(90)]
    texts += hot
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j])
            if s and 100 * s >= 75 * (len(sets[i]) + len(sets[j]) - s):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert near_dedup.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.RandomState(0)
    a = rng.randint(0, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate((a[:240], rng.randint(0, 1 << 60, 60).astype(np.uint64)))
    s = sketches(np.concatenate((a, b)), np.array([0, 300, 600]))
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15
    one = sketches(a[:1], np.array([0, 1, 1]))
    assert (one[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (one[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    v, bounds = shingle_sets([b"a b c d e f", b"a  b\nc d e f", None])
    assert (v[:2] == v[2:4]).all() and bounds.tolist() == [0, 2, 4, 4]


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    bad = ["grobnik", "vilefrump", "snotrag"]
    texts, toxic = [], []
    for i in range(400):
        w = prose(rng, 40).split()
        if i % 4 == 0:
            w.insert(rng.randrange(40), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    docs = docs_of(spark, texts + [None, ""])
    labels = spark.createDataFrame(list(enumerate(toxic)) + [(9999, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    assert got[400].predicted == got[401].predicted == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_sharding_moves_only_into_the_new_shard(spark):
    rows = sharding.layout(docs_of(spark, EDGE + [f"t{i}" for i in range(500)])).collect()
    assert all(r.shard == r.grown_shard or r.grown_shard == 16 for r in rows)
    assert any(r.grown_shard == 16 for r in rows)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    null = next(r for r in rows if r.doc_id == 0)
    assert (null.size, null.text_crc32) == (1, 0)


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randint(1, 60)) for _ in range(900)] + [None, "", "dup dup dup", "dup dup dup"]
    source = {i: "abc"[i % 3] if i % 7 else None for i in range(len(texts))}
    docs = docs_of(spark, texts, source=source)
    rows = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert {(r.doc_id, r.taken) for r in rows} == again and len(rows) == len(texts)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert own[0].target <= 3 * sum(r.size for r in own) + 1e-6
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed(docs).count() == sum(r.copies for r in rows)


def test_top_k_brute_force(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(400, 8) * 0.3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 8), (7, [0.1] * 8)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    v = [(i, np.floor(256 * np.array(e)).astype(int)) for i, e in rows if e is not None and np.isfinite(e).all()]
    for q, qv in [y for y in v if y[0] % 50 == 0]:
        best = sorted((-int(qv @ c), i) for i, c in v if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_edits_equal_full_counts():
    e = tokencount.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    letters = "  \n\tabc'sre tll!?1 2é don't"
    for _ in range(150):
        d = tokencount.Document("".join(rng.choices(letters, k=rng.randint(0, 600))), e)
        for _ in range(5):
            d.edit(rng.randint(0, 620), rng.randint(0, 40), "".join(rng.choices(letters, k=rng.randint(0, 30))))
            assert d.tokens == len(e.encoding.encode_ordinary(d.text))


def test_licenses(spark):
    texts = [*EDGE, "Some text.\nReleased under the MIT License.\nMore.", "licensed under the apache license version 2.0", "MIT is a school"]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert rows[7].licenses == ["mit"] and rows[7].unit == 2 and rows[7].dice == 1.0
    assert rows[8].license == "apache-2.0" and rows[9].licenses == [] and rows[0].licenses == []


def test_decontamination_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(6, "rare pair"), (7, None), (8, "!!!")]
    texts = [*EDGE]
    for _ in range(40):
        w = prose(rng, 60).split()
        if rng.random() < 0.5:
            src = items[rng.randrange(6)][1].split()
            a = rng.randrange(0, 18)
            w[20:20] = src[a : a + rng.randint(5, 14)]
        texts.append(" ".join(w))
    texts.append("a Rare, PAIR here")
    words = lambda t: [w.decode() for w in decontaminate.words((t or "").encode())]
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, x in items:
            y = words(x)
            for k in range(max(1, len(y) - 9)) if y else ():
                win = y[k : k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(i))
        want[d] = (len(w), len(hit), len(found), decontaminate.digest_of(list(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, bench).collect()}
    assert got == want
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(v[1] == 0 for v in want.values())
    best = {}
    for i, x in items:
        y = words(x)
        for k in range(max(1, len(y) - 9)) if y else ():
            for d, t in enumerate(texts):
                w = words(t)
                for p in range(len(w)):
                    n = 0
                    while k + n < len(y) and p + n < len(w) and y[k + n] == w[p + n]:
                        n += 1
                    if n >= min(10, len(y)):
                        best.setdefault((str(i), k), []).append((-n, d, p))
    found = decontaminate.longest_matches(docs.repartition(5), bench.union(bench)).collect()
    assert {(r.item_id, r.item_at): (-r.n_words, r.doc_id, r.doc_at, r.n_found) for r in found} == {k: (*min(v), len(v)) for k, v in best.items()}
    assert max(r.n_words for r in found) > 10 and decontaminate.longest_matches(docs, bench.limit(0)).count() == 0
    index = decontaminate.Index([("a", items[0][1].encode())])
    shard = decontaminate.Shard([("x y " + items[0][1] + " z").encode()], index)
    assert [(m[1], m[3]) for m in shard.longest(index, [None])] == [(30 - k, 2 + k) for k in range(21)]
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_language_id(spark):
    rng = random.Random(1)
    texts, lang = [], {}
    for i in range(200):
        lang[i] = "ab"[i % 2]
        texts.append(" ".join("".join(rng.choices("kzxq" if i % 2 else "aeiou", k=4)) for _ in range(20)))
    texts += [None, "", "123 !?"]
    docs = docs_of(spark, texts, lang=lang)
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[i].lang_pred == lang[i] and 0 <= got[i].score <= 1 for i in range(200))
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3


def test_language_id_counts_characters_and_joins_groups(spark):
    # the bucket of an n-gram depends on its characters alone, wherever it stands
    texts = ["日本 語", "Été", None, "本 語é"]
    seen = [{} for _ in range(langid.ORDERS)]
    for n, (at, first) in enumerate(langid.grams(texts, langid.BUCKETS)):
        for t, a, b in zip(texts, first[:-1], first[1:]):
            t = f" {t.lower()} " if t else ""
            assert b - a == len(t) and all(at[a + max(0, len(t) - n) : b] == langid.BUCKETS)
            for k in range(len(t) - n):
                assert at[a + k] < langid.BUCKETS and seen[n].setdefault(t[k : k + n + 1], at[a + k]) == at[a + k]
        assert len(set(seen[n].values())) == len(seen[n])
    rng = random.Random(3)
    letters = {"a": "абвгд", "b": "абежз", "c": "日本語字中", "d": "aeiou", "e": "aeixy"}
    lang = {i: "abcde"[i % 5] for i in range(300)}
    texts = [" ".join("".join(rng.choices(letters[lang[i]], k=4)) for _ in range(1 + i % 9)) for i in range(300)] + [None, "", "7!", "zzz", "字" * 60_000]
    docs = docs_of(spark, texts, lang=lang)
    one, many = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, langid.fit(docs, group=g)).collect()} for g in (128, 2))
    assert one == many and [one[i][0] for i in (300, 301, 302, 304)] == ["und"] * 3 + ["c"]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(one[i][0] == lang[i] for i in held) >= 0.9 * len(held)


def test_token_files_round_trip(spark):
    t = Tokenizer.from_file(WORD)
    texts = [*EDGE, "Hello, WORLD. don't", "<|endoftext|> x.", "É. ΑΣ. İ. 日本語!", "Hello, WORLD. don't"]
    got = {r.doc_id: r for r in binary.round_trip(docs_of(spark, texts), WORD).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [1, 2, 700, 5000])
def test_elias_fano(n):
    v = np.sort(np.random.RandomState(n).randint(0, 9 * n, n))
    ef = binary.EliasFano.encode(v, int(v[-1]))
    assert (ef.get_many(np.arange(n)) == v).all() and all(ef.get(i) == v[i] for i in range(0, n, max(1, n // 50)))


def test_stored_trees_take_edits_of_a_table(spark):
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 400))) for i in range(40)] + [(40, None), (41, ""), (42, "it's\n\n  日本 x"), (3, "another text"), (None, "no id"), (5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    put = lambda: rng.choice(["", " ", "\n", "'s", "x", " 12 new words", "é"])
    edits = [(rng.randrange(44), k, rng.choice([None, rng.randrange(2500), -3]), rng.choice([None, 0, 1, 30, 9999]), rng.choice([None, put()])) for k in range(400)] + [(None, 0, 0, 0, "lost"), (99, 0, 0, 0, "lost")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, place int, removed int, put string")
    encoder = tokencount.Encoder(*how)
    now = tokencount.trees(docs, *how)
    want = {(i, t or "", i, t or ""): 2 if t == "same" else 1 for i, t in rows}
    assert now.count() == len(want) == now.select("tree_id").distinct().count()
    for part in (table.where("seq < 200"), table.where("seq >= 200"), table.limit(0)):
        before, now = now, tokencount.apply_edits(now, part, *how)
        todo, next_ = [tuple(r) for r in part.orderBy("seq").collect()], {}
        for (i, t, key, first), n in want.items():
            for j, _, place, removed, new in todo:
                if i is not None and j == i:
                    a = min(max(len(t) if place is None else place, 0), len(t))
                    t = t[:a] + (new or "") + t[a + min(max(removed or 0, 0), len(t) - a) :]
            next_[i, t, key, first] = n
        want = next_
        got = now.collect()
        assert sorted((str(r.doc_id), r.text, r.n_rows, r.n_tokens) for r in got) == sorted((str(i), t, n, sum(encoder.counts(encoder.split(t)))) for (i, t, _, _), n in want.items())
        assert {r.tree_id for r in got} == {r.tree_id for r in before.collect()}
        for r in got:
            assert tokencount.Document.stored(r.text, r.lengths, r.counts, encoder).tokens == r.n_tokens and sum(np.frombuffer(r.lengths, "<u4")) == len(r.text)
    assert sum(r.n_edits for r in got) == 0 and sum(r.n_reencoded for r in got) == 0


def test_edits_of_the_query_are_those_of_the_script(spark):
    docs = spark.createDataFrame([(i, "ab c" * (i % 40)) for i in range(80)] + [(80, None)], "doc_id long, text string")
    got: dict = {}
    for r in queries._script(docs).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.removed, r.put))
    assert got == {i: tokencount.script("ab c" * (i % 40), str(i)) for i in range(80) if i % 40}


def test_words_of_ascii_letters_are_encoded_unread(monkeypatch):
    """Only words with other characters are looked at one by one, and ids stay those of whole texts."""
    import public_tokenizers

    from tideglass.llm import binary

    encoder = binary.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    seen, letters = [], binary._letters
    monkeypatch.setattr(binary, "_letters", lambda w: seen.append(w) or letters(w))
    texts = ["Plain words, zxqvkj wordz and naïve café x1y don't — 名前 <|x|> été", "", "ÀB ça � İi ﬁn"]
    ids, bounds = encoder.encode([t.encode() for t in texts], 2)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert "naïve" in seen and not any(w.isascii() and w.isalpha() for w in seen)

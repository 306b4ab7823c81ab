"""Recall of the corpus operators on disguised and wrapped passages."""

import random
import textwrap

from tideglass.llm import decontaminate, licenses, toxicity

BAD = ["grobnik", "vilump", "snotrag"]
SYLLABLES = ["the", "sea", "mere", "tion", "anda", "orle", "kit", "vane", "hom", "lis", "quor"]


def prose(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(["", "ta", "ne", "li"]) for _ in range(n)]


def disguises(w):
    yield "inserted", [w[:i] + m + w[i:] for i in range(1, len(w)) for m in ".-*"]
    yield "marked", [m.join(w) for m in (".", "-", "*", "--", "..", "._.")]
    yield "spaced", [" ".join(w), "  ".join(w), " \t".join(w), " ".join(w[i : i + 2] for i in range(0, len(w), 2))]
    yield "split", [w[:i] + " " + w[i:] for i in range(1, len(w))]


def test_toxicity_recall_on_disguised_insults():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        w = prose(rng, 40)
        if i % 4 == 0:
            w.insert(rng.randrange(40), rng.choice(BAD))
        rows.append((" ".join(w), int(i % 4 == 0)))
    machine = toxicity.train(rows)

    def toxic(text):
        return machine.probability(machine.values(sorted(toxicity.units(text))).max()) >= 0.5

    tried, found = {}, {}
    for w in BAD:
        for kind, forms in disguises(w):
            for form in forms:
                text = " ".join(prose(rng, 20) + [form] + prose(rng, 20))
                tried[kind] = tried.get(kind, 0) + 1
                found[kind] = found.get(kind, 0) + toxic(text)
    clean = sum(toxic(" ".join(prose(rng, 40))) for _ in range(200))
    print("recall", {k: f"{found[k]} of {tried[k]}" for k in tried}, "false alarms", clean, "of 200")
    assert all(found[k] >= 0.9 * tried[k] for k in tried) and clean <= 2


def test_wrapped_and_shared_line_notices(spark):
    rng = random.Random(8)
    around = lambda x: "\n".join([" ".join(prose(rng, 60)), x, " ".join(prose(rng, 60))])
    full = dict(licenses.TEXTS)
    cases = [("mit", textwrap.fill(licenses._MIT, 76)), ("mit", licenses._MIT.strip()), ("all-rights-reserved", "Copyright 2020 Foo Inc. All rights reserved.")]
    cases += [("mit", "This program is free. Released under the MIT License. See the file for details.")]
    cases += [(name, "\n".join("# " + x for x in textwrap.wrap(text, 70))) for name, text in full.items()]
    texts = [around(x) for _, x in cases] + [None, "", "word", " ".join(prose(rng, 300)), around(cases[2][1]) + around(cases[2][1])]
    rows = sorted(licenses.whole(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for (name, _), r in zip(cases, rows):
        assert max(r.passages, key=lambda m: m.dice).license == name and name in r.licenses
    assert [r.licenses for r in rows[len(cases) : -1]] == [[]] * 4
    assert [(m.license, m.dice) for m in rows[-1].passages] == [("all-rights-reserved", 1.0)] * 2
    old = licenses.scan(spark.createDataFrame(list(enumerate(texts[:4])), "doc_id long, text string")).collect()
    assert all(r.licenses == [] for r in old)


def test_items_without_an_id_hit(spark):
    rng = random.Random(6)
    a, b = " ".join(prose(rng, 14)), " ".join(prose(rng, 12))
    docs = spark.createDataFrame([(0, "x " + a), (1, a + " y " + b), (2, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (None, b), (5, b)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(docs, bench).collect()}
    assert got == {0: (14, 1, decontaminate.digest_of([])), 1: (26, 2, decontaminate.digest_of(["5"])), 2: (0, 0, decontaminate.digest_of([]))}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [2]

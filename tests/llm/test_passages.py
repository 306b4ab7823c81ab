"""Licence passages against a plain search of every window, and their cost in one long text."""

import random
import re
import time

from tideglass.llm import licenses

EVERY = licenses.TEMPLATES + licenses.TEXTS


def plainly(text, t=licenses.THRESHOLD):
    ws = re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()
    grams = [f"{a} {b}" for a, b in zip(ws, ws[1:])]
    out = []
    for name, body in EVERY:
        own, n = set(licenses.bigrams(body)), len(re.sub(r"[^A-Za-z0-9]+", " ", body).split())
        found = []
        for i, x in enumerate(grams):
            w = set(grams[i : i + n - 1])
            if x in own and 2 * len(w & own) >= t * (len(w) + len(own)):
                found.append((2 * len(w & own) / (len(w) + len(own)), -i))
        out += [(-b, n, name, round(d, 9)) for d, b in found if not any(abs(c - b) < n and (e, c) > (d, b) for e, c in found)]
    return sorted(out)


def torn(rng, text):
    """text with some words lost, doubled or replaced."""
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < 0.03 else [w, w] if r < 0.05 else ["quor"] if r < 0.07 else [w]
    return " ".join(out)


def test_passages_equal_a_search_of_every_window(spark):
    rng = random.Random(12)
    filler = lambda k: " ".join(rng.choice(["the", "this", "license", "software", "of", "mere", "is", "under"]) for _ in range(k))
    texts = [None, "", "mit", "Released under the MIT License." * 9, filler(400), licenses._MIT * 3, "x " + licenses._BSD]
    for _ in range(40):
        parts = [torn(rng, rng.choice(EVERY)[1]) + rng.choice([" ", "\n", "\n// ", ""]) + filler(rng.choice([0, 1, 5, 40])) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7])], "doc_id long, text string")
    rows = licenses.whole(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert sorted((m.at, m.n, m.license, round(m.dice, 9)) for m in r.passages) == plainly(texts[r.doc_id]), r.doc_id
    assert sum(len(r.passages) for r in rows) > 100


def test_a_text_of_many_copies_costs_in_proportion(spark):
    took = {}
    for copies in (1, 60, 240):
        docs = spark.createDataFrame([(1, (licenses._MIT + licenses._MIT_END + "\n") * copies)], "doc_id long, text string")
        began = time.time()
        (row,) = licenses.whole(docs).select("passages").collect()
        took[copies] = time.time() - began
        assert sum(m.dice == 1.0 and m.n > 100 for m in row.passages) == copies
    assert took[240] < 4 * took[60] + 5

"""Spelling variants: words one edit apart, found by a rare-first filter over positional bigrams.

All bigrams are ordered by the number of words' places they stand at, rarest first.  One edit touches at most two bigrams
of a word, so of the three rarest bigrams of two words that are one edit apart at least one is common to both and
untouched; the edit then lies wholly behind or wholly before it.  A word is therefore joined by each of its three rarest
bigrams together with the side that the edit leaves alone, which also fixes the bigram's place from that side (its place from the other
side differs by one at most), and with one of two parts of the free side: the NEAR characters next to the bigram, or what
lies beyond them.  Only words that agree in such a key and whose lengths differ by one at most are compared, and every
pair is verified.  No group of words is gathered: the pairs come from a join, which Spark splits where a key is common.

Cases: null and empty texts have no words; a null id counts as an empty one in the hash; rows that repeat an id and text
count each; ties of the best form go to the smallest word in code-point order; very long texts are cut within their task;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import add

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.shared import Scratch, keep, small

#: Least code points of a word, least occurrences, and how many times as common a form must be.
LENGTH, LEAST, TIMES = 7, 2, 10
#: Characters next to the shared bigram that are compared apart from the rest.
NEAR = 3
#: Rows of two words (about 60 bytes each) that may be broadcast.
PAIRS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, length: int = LENGTH) -> Column:
    """The maximal runs of letters that have `length` code points or more, A-Z lower-cased."""
    found = F.regexp_extract_all(text, F.lit(rf"[A-Za-zÀ-ÿ]{{{length},}}+"), F.lit(0))
    return F.transform(found, lambda w: F.translate(w, _UPPER, _LOWER))


def noised(doc_id: Column, run: Column) -> Column:
    """The run, or, where 31 divides the crc32 of `<doc_id>:<run>`, the run without the code point at that hash modulo its length."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n) of all words of docs (doc_id, text) with at least `length` code points and `least` occurrences."""
    # a deletion only shortens, so shorter runs give no word
    rows = docs.select("doc_id", F.explode(runs(F.col("text"), length)).alias("run"))
    rows = rows.select(noised(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bigram_order(table: DataFrame) -> dict[str, int]:
    """Bigrams to their rank, rarest first: at most as many as the squared alphabet of 90 letters has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in it:
            for w in batch.column("word").to_pylist():
                counts.update(map(add, w, w[1:]))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])

    counts = table.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: i for i, r in enumerate(sorted(counts.collect(), key=lambda r: (r.n, r.gram)))}


def keys_of(word: str, rank: dict[str, int]) -> set[tuple[str, int]]:
    """(key, role) of a word; two words one edit apart meet in a key that both hold in role 0, or the longer one in role 1."""
    n = len(word)
    rarest = sorted((rank[word[i : i + 2]], i) for i in range(n - 1))[:3]
    out = set()
    for _, p in rarest:
        e = p + 2
        # the edit lies behind the bigram, not in the next characters; or before it, not in the last ones
        if e + NEAR < n:
            out.add((f"a{word[: e + NEAR]}", 0))
        if p > NEAR:
            out.add((f"b{word[p - NEAR :]}", 0))
        # the edit lies in those characters, of which the longer word has one more; the shorter word's length is told
        for role in (0, 1):
            out.add((f"c{n - role}:{word[:e]}:{word[e + NEAR + role :]}", role))
            out.add((f"d{n - role}:{word[: max(0, p - NEAR - role)]}:{word[p:]}", role))
    return out


def neighbours(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, n_a, b, n_b), a < b: the pairs of words of (word, n) that are exactly one edit apart, each once or more often."""
    rank = bigram_order(table)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for at in range(0, len(words), 2000):
                rows = [(xxhash.xxh3_64_intdigest(k) - (1 << 63), role, w, n) for w, n in zip(words[at : at + 2000], counts[at : at + 2000]) for k, role in keys_of(w, rank)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int8(), pa.string(), pa.int64()))], ["key", "role", "word", "n"])

    keyed = scratch.keep(table.mapInArrow(run, "key long, role byte, word string, n long"), "keys")
    one, two = keyed.where("role = 0").alias("l"), keyed.alias("r")
    met = F.expr("l.key = r.key and (r.role = 1 or l.word < r.word) and abs(length(l.word) - length(r.word)) <= 1 and levenshtein(l.word, r.word, 1) = 1")
    pairs = one.join(two, met).selectExpr("l.word as w", "l.n as m", "r.word as v", "r.n as k")
    swap = F.col("w") < F.col("v")
    pick = lambda x, y, name: F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)
    return pairs.select(pick("w", "v", "a"), pick("m", "k", "n_a"), pick("v", "w", "b"), pick("k", "m", "n_b"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): the last word reached by following forms; every step is at least TIMES as common, so chains are short."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = scratch.keep(now, "roots")
        nxt = small(now.select(F.col("word").alias("root"), F.col("root").alias("_next")), PAIRS)
        step = now.join(nxt, "root", "left")
        if step.where("_next is not null").isEmpty():
            return now
        now = step.select("word", F.coalesce("_next", "root").alias("root"))


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of docs (doc_id, text), as a kept table."""
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.keep(words(docs), "words")
        pairs = neighbours(table, scratch).distinct()
        both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("k")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("k"))))
        near = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
        rows = table.join(near, "word", "left")
        good = F.coalesce(-F.col("best.k") >= times * F.col("n"), F.lit(False))
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n"))
        rows = scratch.keep(rows, "variants")
        last = roots(rows.where("form is not null"), scratch)
        rows = rows.join(small(last, PAIRS), "word", "left")
        return keep(rows.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

The features of a text are all n-grams of 1 to 4 characters (code points) of its lower-cased form,
white space read as one blank each, hashed to BUCKETS numbers.  Training counts them per language over a
bounded sample of labelled rows (SAMPLE per language, in the order of a hash of the id; texts over CHARS
characters are left out of the sample); counts are summed on the executors per slice and added up by key.
The log-probability matrix (languages x BUCKETS) is broadcast in groups of at most GROUP languages
(32 MB each), one pass over the texts per group, and a batch of whole texts is scored in numpy: each
text's sum of the matrix rows its n-grams meet.  What a text needs from a group (its best language, and
the sum over all) adds up over the groups, so any number of languages gives the result of one matrix.

The score is the posterior of the predicted language, from the mean log probability per n-gram
times TEMPER, so that long texts do not all saturate at 1.

Cases: null texts and texts without a letter are `und` with score 0; ties go to the language
first by code point; without labelled rows every text is `und`; repeated rows are scored alike;
empty tables give empty results; very long texts are read whole, one at a time; input columns
lang_pred and score are replaced, further ones stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.hashing import slices
from tideglass.llm.shared import SLICE, Scratch, batched, crc_mod, fresh, keep, lean, small_batches

ORDERS = 4
BUCKETS = 1 << 16
#: Languages per broadcast: 4 * BUCKETS bytes each.
GROUP = 128
SAMPLE, CHARS = 1500, 20_000
SMOOTH, TEMPER = 0.1, 60.0
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether text holds a letter (Unicode category L): numbers such as superscripts and fractions are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text or ""))


def grams(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: (bucket of each n-gram, first n-gram of each text); each text stands between two blanks."""
    data = [f" {t.lower()} ".encode("utf-32-le", "replace") if t else b"" for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data)) // 4
    a = np.frombuffer(b"".join(data), "<u4").copy()
    a[(a >= 9) & (a <= 13)] = 32
    first = np.concatenate(([0], np.cumsum(size)))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    key = np.zeros(len(a), np.uint32)
    for n in range(1, ORDERS + 1):
        # the key of the n characters that begin at each place; those that would cross into the next text go to a spare bucket
        key = key[: max(0, len(a) - n + 1)] * np.uint32(0x01000193) + a[n - 1 :] + np.uint32(1)
        at = (((key + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
        at = np.concatenate((at, np.full(len(a) - len(at), buckets, np.int32)))
        for k in range(1, n):
            over = first[1:] - k
            at[over[over >= first[:-1]]] = buckets
        yield at, first


class Model:
    """A group of languages, their log probabilities by bucket (one spare bucket of value 0) and log priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, prior: np.ndarray):
        self.langs, self.prior = langs, prior
        self.buckets = counts.shape[1]
        self.matrix = np.zeros((len(langs), self.buckets + 1), np.float32)
        for row, c in zip(self.matrix, counts):
            row[:-1] = np.log((c + SMOOTH) / (c.sum() + SMOOTH * self.buckets))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) sums of log probabilities, and the number of n-grams of each text."""
        total = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts))
        for at, first in grams(texts, self.buckets):
            full = np.flatnonzero(np.diff(first))
            if not len(full):
                break
            for k in range(len(self.langs)):
                total[full, k] += np.add.reduceat(self.matrix[k][at], first[full], dtype=np.float64)
            n[full] += np.add.reduceat((at != self.buckets).astype(np.int64), first[full])
        return total, n

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: place of the language of most evidence, that evidence, its tempered form, and the
        logarithm of the sum of all languages' tempered likelihoods."""
        total, n = self.sums(texts)
        whole = total + self.prior
        best = np.argmax(whole, axis=1)
        # the mean evidence, tempered; short texts keep their whole sum
        scaled = total * np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None] + self.prior
        top = scaled.max(axis=1)
        mass = top + np.log(np.exp(scaled - top[:, None]).sum(axis=1))
        row = np.arange(len(texts))
        return best, whole[row, best], scaled[row, best], mass


def fit(docs: DataFrame, sample: int = SAMPLE, chars: int = CHARS, group: int = GROUP) -> list | None:
    """Train on the bounded sample of documents whose crc32(doc_id) mod 4 is not 2 and whose lang is known.

    Gives broadcasts of Models, one for each group of languages in the order of code points; None without labelled rows.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("lang is not null and doc_id is not null")
    known = known.where(crc_mod("doc_id", 4) != 2)
    share = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, docs_of_all = sorted(share), sum(share.values())
    if not langs:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003)) / 1_000_003
    rows = known.withColumn("draw", draw).where(F.length("text") <= chars)

    @lean
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in small_batches(it):
            for part in slices(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()), lambda r: len(r[1] or ""), SLICE // 2):
                names = {lang: k for k, lang in enumerate(dict.fromkeys(r[0] for r in part))}
                code = np.array([names[r[0]] for r in part])
                for at, first in grams([r[1] for r in part], BUCKETS):
                    owner = np.repeat(code, np.diff(first))
                    for lang, k in names.items():
                        total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                        total[lang] += np.bincount(at[owner == k], minlength=BUCKETS + 1)
        for lang, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c[:BUCKETS].tobytes()], pa.binary())], ["lang", "counts"])

    models = []
    for a in range(0, len(langs), group):
        some = langs[a : a + group]
        # as many rows of each language as the bound allows, the same ones on every run: a share by hash
        part = F.create_map(*[x for lang in some for x in (F.lit(lang), F.lit(min(1.0, sample / share[lang])))])
        counts = np.zeros((len(some), BUCKETS))
        place = {lang: k for k, lang in enumerate(some)}
        with Scratch(spark) as scratch, batched(spark):
            for r in scratch.keep(rows.where(F.col("draw") < part[F.col("lang")]).select("lang", "text").mapInArrow(count, "lang string, counts binary"), "counts").toLocalIterator():
                counts[place[r.lang]] += np.frombuffer(bytes(r.counts), np.int64)
        prior = np.log(np.array([share[x] for x in some], float) / docs_of_all)
        models.append(spark.sparkContext.broadcast(Model(some, counts, prior)))
    return models


def identify(docs: DataFrame, models: list | None) -> DataFrame:
    """docs with lang_pred and score added; other columns as they are."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*names)
    state = fresh(names, "lang", "evidence", "tempered", "mass")
    now = docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(state, ("string", "double", "double", "double"))))
    with Scratch(docs.sparkSession) as scratch, batched(docs.sparkSession):
        for k, held in enumerate(models or ()):
            now = now.mapInArrow(_runner(held, names, state), now.schema)
            if k + 1 < len(models):
                now = scratch.keep(now, "group")
        lang, _, tempered, mass = (F.col(c) for c in state)
        score = F.when(lang.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(tempered - mass)))
        return keep(now.select(*names, F.coalesce(lang, F.lit("und")).alias("lang_pred"), score.alias("score")), "languages")


def _runner(held, names: list[str], state: list[str]):
    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in small_batches(it):
            before = [batch.column(c).to_pylist() for c in state]
            out: list[tuple] = []
            texts = batch.column("text").to_pylist()
            for part in slices(texts, lambda t: len(t or ""), SLICE // 4):
                for t, *new in zip(part, *(x.tolist() for x in model.judge(part))):
                    lang, evidence, tempered, mass = (b[len(out)] for b in before)
                    if not has_letter(t):
                        out.append((None, None, None, None))
                    elif lang is None:
                        out.append((model.langs[new[0]], *new[1:]))
                    else:
                        # groups come in the order of their languages: a tie stays with the earlier one
                        best = (model.langs[new[0]], new[1], new[2]) if new[1] > evidence else (lang, evidence, tempered)
                        out.append((*best, float(np.logaddexp(mass, new[3]))))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            found = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], [*names, *state])

    return run

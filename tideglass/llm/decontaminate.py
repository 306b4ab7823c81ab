"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a batch of whole documents read as one sequence of word numbers (numbers of the
benchmark's vocabulary, 0 for other words and between documents).  Its suffix array lists, in
the order of their next words, the positions that can begin a benchmark window; positions whose
next words are the start of no window can match nothing and are left out, which leaves
every answer as it is.  Every test suffix is looked up by binary search: the run of
equal prefixes gives all occurrences of the window at that place of the test item, and the
runs of occurrences along one diagonal the longest verbatim match and its location (longest_matches).
A window is 10 consecutive words of an item, or the whole of a shorter item.

The benchmark's index goes to the executors in parts of at most PART items; each part is one
broadcast of bounded size, and with several parts their hits are united per document.

Cases: null or empty texts have no words and are never hit; an item without words has no
window; repeated rows are treated one by one; an empty benchmark hits nothing; repeated item ids
count as one item; items without an id hit as others do, count as one item and are left out of the digest;
further columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.llm.hashing import slices
from tideglass.llm.shared import SLICE, fresh, keep, lean, small_batches

WINDOW = 10
#: Items of the benchmark, and bytes of their texts, per broadcast.
PART, PART_BYTES = 20_000, 8_000_000
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
_GRAM = 4


def words(text: bytes | None) -> list[bytes]:
    """A-Z lowered; maximal runs of digits, a-z and non-ASCII characters."""
    return text.translate(_KEEP).split() if text else []


class Index:
    """Vocabulary, windows and suffixes of some test items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.window = window
        self.md5 = [hashlib.md5(t or b"").hexdigest() for _, t in items]
        self.vocabulary: dict[bytes, int] = {}
        seqs, owner, self.items = [], [], [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                seqs.append(np.array(ids + [0], np.int64))
                owner.append(np.full(len(ids) + 1, k, np.int64))
        seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.start = start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(seq))) - 1
        # one row per window: its words, padded with 0, and its length
        at = [s + i for s, n in zip(start, size) for i in range(max(1, n - window + 1))]
        length = [min(window, n) for s, n in zip(start, size) for _ in range(max(1, n - window + 1))]
        self.at, self.length = np.array(at, np.int64), np.array(length, np.int64)
        self.owner = own[self.at] if len(at) else np.zeros(0, np.int64)
        self.seq = np.concatenate((seq, np.zeros(window + 1, np.int64)))
        self.rows = self.seq[self.at[:, None] + np.arange(window)] if len(at) else np.zeros((0, window), np.int64)
        self.rows[np.arange(window)[None, :] >= self.length[:, None]] = 0
        #: for 1 to _GRAM leading words: which hashes can begin a window of at least that many words
        self.heads = []
        for g in range(1, _GRAM + 1):
            table = np.zeros(1 << 20, bool)
            table[_head(self.rows, g)[self.length >= g]] = True
            self.heads.append(table)
        self.short = sorted(set(self.length[self.length < _GRAM].tolist()))

    def place(self, w: int) -> tuple[str | None, str, int]:
        """The window's item, the md5 of its text, and its first word there."""
        at, item = int(self.at[w]), int(self.owner[w])
        return self.items[item], self.md5[item], at - int(self.start[np.searchsorted(self.start, at, "right") - 1])


def _head(rows: np.ndarray, g: int) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for k in range(g):
        key = (key + rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(44)).astype(np.int64)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Word rows as byte strings that sort word by word."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Shard:
    """Suffix array of some documents' words, over the positions that can begin a window."""

    def __init__(self, texts: list[bytes | None], index: Index):
        get, parts, sizes = index.vocabulary.get, [], []
        for t in texts:
            ws = words(t)
            sizes.append(len(ws))
            parts.append(np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)))
        self.sizes = np.array(sizes, np.int64)
        pad = np.zeros(1, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.sizes + 1)))
        seq = np.concatenate([x for p in parts for x in (p, pad)] or [pad])
        self.seq = np.concatenate((seq, np.zeros(index.window + 1, np.int64)))
        at = np.flatnonzero(index.heads[0][_head(seq[:, None], 1)] & (seq > 0))
        done = [np.zeros(0, np.int64)]
        for g in range(2, _GRAM + 1):
            if g - 1 in index.short:
                done.append(at)
            at = at[index.heads[g - 1][_head(self.seq[at[:, None] + np.arange(g)], g)]]
        at = np.unique(np.concatenate((*done, at)))
        keys = _keys(self.seq[at[:, None] + np.arange(index.window)]) if len(at) else np.zeros(0, f"S{4 * index.window}")
        order = np.argsort(keys, kind="stable")
        self.array, self.keys = at[order], keys[order]

    def occurrences(self, index: Index) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of every window of the index."""
        out_w, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.array) or not len(index.rows):
            return out_w[0], out_p[0]
        low = _keys(index.rows)
        high = index.rows.copy()
        high[np.arange(index.window)[None, :] >= index.length[:, None]] = 0xFFFFFFFF
        a, b = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, _keys(high), "right")
        n = np.maximum(b - a, 0)
        w = np.repeat(np.arange(len(n)), n)
        p = self.array[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        return w, p

    def lengths(self, index: Index, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Words of the verbatim match that begins at each occurrence of occurrences().

        A match is longer than its window exactly if the next word's window occurs one place on, so it runs as
        far as occurrences follow each other on their diagonal (place in the item less place in the shard).
        """
        at = index.at[w]
        order = np.lexsort((at, at - p))
        at, line = at[order], (at - p)[order]
        follows = (np.diff(at) == 1) & (np.diff(line) == 0) if len(at) else np.zeros(0, bool)
        # the last occurrence of each one's run
        last = np.flatnonzero(np.append(~follows, True)) if len(at) else np.zeros(0, np.int64)
        end = last[np.searchsorted(last, np.arange(len(at)))]
        out = np.zeros(len(at), np.int64)
        out[order] = end - np.arange(len(at))
        return out + index.length[w]

    def longest(self, index: Index, keys: list) -> list[tuple]:
        """(window, words, document's key, place in its words, occurrences) of each test suffix's longest verbatim match.

        Of equal matches the one in the document of the least key (null last) and there the first.
        """
        w, p = self.occurrences(index)
        if not len(w):
            return []
        n = self.lengths(index, w, p)
        doc = np.searchsorted(self.first, p, "right") - 1
        rank = np.empty(len(keys), np.int64)
        rank[sorted(range(len(keys)), key=lambda d: (keys[d] is None, keys[d] or 0))] = np.arange(len(keys))
        order = np.lexsort((p, rank[doc], -n, w))
        first = order[np.flatnonzero(np.diff(np.concatenate(([-1], w[order]))))]
        many = np.bincount(w)
        return [(int(w[o]), int(n[o]), keys[doc[o]], int(p[o] - self.first[doc[o]]), int(many[w[o]])) for o in first]


_FOUND = "n_words long, hits array<struct<at:long,n:long>>, items array<string>"


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in bounded parts, streamed through the driver partition by partition."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text"))
    part: list = []
    size = 0
    for r in rows.toLocalIterator():
        part.append((r.item_id, bytes(r.text) if r.text is not None else None))
        size += len(part[-1][1] or b"")
        if len(part) >= PART or size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, hits (disjoint runs of hit words: first word, number) and items (sorted ids) added."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_words", "hits", "items")]
    docs = docs.select(*names)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_FOUND).fields])
    out = None
    for part in _parts(benchmark):
        held = spark.sparkContext.broadcast(Index(part, window))
        run = _runner(held, names)
        if out is None:
            out = docs.mapInArrow(run, schema)
        else:
            # the next part of a large benchmark: unite with what the earlier parts found
            out = keep(out, "hits", 500).withColumnsRenamed({"hits": "_h", "items": "_i"}).drop("n_words")
            more = T.StructType([*out.schema.fields, *T._parse_datatype_string(_FOUND).fields])
            out = out.mapInArrow(_runner(held, out.columns), more).drop("_h", "_i")
    if out is None:
        out = docs.mapInArrow(_runner(spark.sparkContext.broadcast(Index([], window)), names), schema)
    return out


def _runner(held, names: list[str]):
    kinds = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])), pa.list_(pa.string())

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in small_batches(it):
            texts = list(enumerate(batch.column("text").cast(pa.binary()).to_pylist()))
            for part in slices(texts, lambda r: len(r[1] or b""), SLICE):
                shard = Shard([t for _, t in part], index)
                w, p = shard.occurrences(index)
                doc = np.searchsorted(shard.first, p, "right") - 1
                mark = np.zeros(len(shard.seq) + 1, np.int64)
                np.add.at(mark, p, 1)
                np.add.at(mark, p + index.length[w], -1)
                spans: list[list] = [[] for _ in part]
                items: list[set] = [set() for _ in part]
                for d, i in set(zip(doc.tolist(), index.owner[w].tolist())):
                    items[d].add(index.items[i])
                hit = (np.cumsum(mark) > 0).astype(np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    d = int(np.searchsorted(shard.first, a, "right")) - 1
                    spans[d].append((a - int(shard.first[d]), b - a))
                rows = batch.slice(part[0][0], len(part))
                if "_h" in names:
                    for k, (h, i) in enumerate(zip(rows.column("_h").to_pylist(), rows.column("_i").to_pylist())):
                        spans[k] = _united(spans[k] + [(x["at"], x["n"]) for x in h or []])
                        items[k].update(i or [])
                found = [pa.array(shard.sizes), pa.array([[{"at": a, "n": n} for a, n in s] for s in spans], kinds[0]), pa.array([sorted(s, key=lambda x: (x is None, x or "")) for s in items], kinds[1])]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *found], [*names, "n_words", "hits", "items"])

    return run


_MATCH = "item_id string, item_md5 string, item_at long, n_words long, doc_id long, doc_at long, n_found long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every test suffix that has one of a window or more, over all docs.

    item_id, item_md5 (of the item's text; items without an id and different texts of one id stay apart), item_at (the suffix's first word,
    from 0), n_words, doc_id and doc_at (where the match begins; of equal ones the least doc_id, then place, null last),
    n_found (places where the suffix's window occurs).  A task keeps one row a suffix of the part, whose size is bounded.
    """
    spark = docs.sparkSession
    out = None
    for part in _parts(benchmark.select("item_id", "text").distinct()):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_matcher(spark.sparkContext.broadcast(Index(part, window))), _MATCH)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return keep(spark.createDataFrame([], _MATCH), "matches")
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("doc_at")))
    out = out.groupBy("item_id", "item_md5", "item_at").agg(best.alias("b"), F.sum("n_found").alias("n_found"))
    out = out.select("item_id", "item_md5", "item_at", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_at", "n_found")
    return keep(out, "matches", 500)


def _matcher(held):
    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        best: dict[int, tuple] = {}
        for batch in small_batches(it):
            rows = list(zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()))
            for part in slices(rows, lambda r: len(r[1] or b""), SLICE):
                for w, n, key, at, many in Shard([t for _, t in part], index).longest(index, [k for k, _ in part]):
                    new = (-n, key is None, key or 0, at)
                    old = best.get(w)
                    best[w] = (min(new, old[0]), old[1] + many) if old else (new, many)
        for at in range(0, len(best), 10_000):
            rows = [(*index.place(w), -m[0], None if m[1] else m[2], m[3], many) for w, (m, many) in list(best.items())[at : at + 10_000]]
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
            names = [f.split()[0] for f in _MATCH.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h.n)
    # code point order is Spark's own order of strings
    digest = F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256)
    report = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    return keep(report, "contamination", 500)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of the benchmark; all columns stay."""
    names = docs.columns
    new = dict(zip(names, fresh([*names, "n_words", "hits", "items"], *names)))
    plain = docs.withColumnsRenamed({c: new[c] for c in names if c.lower() in ("n_words", "hits", "items")})
    clean = hits(plain, benchmark).where(F.size("items") == 0).drop("n_words", "hits", "items")
    return keep(clean.withColumnsRenamed({v: k for k, v in new.items()}).select(*names), "clean", 500)


def digest_of(items: list[str]) -> str:
    """The digest report() gives for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

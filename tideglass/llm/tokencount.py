"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The tokenizer's pre-tokeniser cuts a text into pieces that are encoded one by one, so a text's
count is the sum over its pieces.  A document keeps its pieces' lengths and counts in blocks of
about BLOCK pieces, the leaves of a segment tree whose nodes hold the sums of characters and tokens
below.  An edit (place, characters removed, text put in) descends to the touched blocks by the
character sums, reads pieces again from the last piece that the edit, or the pre-tokeniser's
look-ahead of LOOK characters, cannot have changed, until it meets an old boundary behind the edit, encodes only
these, splices them in and updates the sums on the path to the root.

The pre-tokeniser has no state but its position, so equal text from a common boundary on gives
equal pieces: counts after edits equal those of a full encoding.

trees() writes the trees of a table of documents as a table, one for each distinct (doc_id, text), and apply_edits() applies a table
of edits to stored trees: texts are not encoded again beyond what the edits touch, and the result is such a table, ready for
the next edits.  Edits meet their trees by a shuffle of the touched trees alone and run through a task one by one.

Cases: null and empty texts have 0 tokens; an edit outside the text is clipped to it; an
empty edit changes nothing; rows are treated one by one, so repeated ids do no harm; further columns stay.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.hashing import slices
from tideglass.llm.shared import SLICE, keep, lean, semi, small_batches

BLOCK = 64
#: Characters behind a piece that can decide where it ends (a contraction of two letters, one blank more).
LOOK = 3
_CACHE = 150_000

Edit = tuple[int, int, str]


class Encoder:
    """Pre-tokeniser and counts of pieces, each piece encoded once."""

    def __init__(self, ranks: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def pieces(self, text: str, at: int = 0) -> Iterator[str]:
        for m in self.pattern.finditer(text, at):
            yield m.group()

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        self.encoded += len(pieces)
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            for p in set(pieces).difference(known):
                known[p] = len(self.encoding.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))


class Document:
    """A text with the segment tree of its pre-tokens."""

    def __init__(self, text: str, encoder: Encoder):
        self.text, self.encoder = text, encoder
        pieces = encoder.split(text)
        self._build(np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(encoder.counts(pieces), np.int64))

    def _build(self, length: np.ndarray, count: np.ndarray) -> None:
        cut = range(0, max(1, len(length)), BLOCK)
        self.blocks = [(length[a : a + BLOCK], count[a : a + BLOCK]) for a in cut]
        self.leaves = 1 << max(0, len(self.blocks) - 1).bit_length()
        self.tree = np.zeros((2 * self.leaves, 2), np.int64)
        for i, (n, c) in enumerate(self.blocks):
            self.tree[self.leaves + i] = n.sum(), c.sum()
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]

    @classmethod
    def stored(cls, text: str, lengths: bytes, counts: bytes, encoder: Encoder) -> Document:
        """The document whose pieces' lengths and counts pack() gave; nothing is encoded."""
        d = cls.__new__(cls)
        d.text, d.encoder = text, encoder
        d._build(np.frombuffer(lengths, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64))
        return d

    def pack(self) -> tuple[bytes, bytes]:
        """The lengths and counts of all pieces."""
        flat = (np.concatenate([b[i] for b in self.blocks]).astype("<u4").tobytes() for i in range(2))
        return next(flat), next(flat)

    @property
    def tokens(self) -> int:
        return int(self.tree[1, 1])

    def tokens_before(self, place: int) -> int:
        """Tokens of the whole blocks before the one that holds the character."""
        leaf, _ = self._leaf(place)
        i, total = self.leaves + leaf, 0
        while i > 1:
            if i % 2:
                total += int(self.tree[i - 1, 1])
            i //= 2
        return total

    def _leaf(self, place: int) -> tuple[int, int]:
        """(block that holds the character at `place`, the block's first character)."""
        i, start = 1, 0
        place = min(place, max(0, int(self.tree[1, 0]) - 1))
        while i < self.leaves:
            i *= 2
            left = int(self.tree[i, 0])
            if place - start >= left:
                start += left
                i += 1
        return min(i - self.leaves, len(self.blocks) - 1), start

    def _set(self, leaf: int, length: np.ndarray, count: np.ndarray) -> None:
        self.blocks[leaf] = length, count
        i = self.leaves + leaf
        delta = np.array([length.sum(), count.sum()]) - self.tree[i]
        while i:
            self.tree[i] += delta
            i //= 2

    def edit(self, place: int, removed: int, put: str) -> None:
        place = min(max(place, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - place)
        if not removed and not put:
            return
        # the first block whose pieces the edit may change: pieces ending LOOK characters before it are safe
        first, start = self._leaf(max(0, place - LOOK - 1))
        length, _ = self.blocks[first]
        ends = start + np.cumsum(length)
        safe = int(np.searchsorted(ends, place - LOOK, "right"))
        begin = start + int(length[:safe].sum())
        if safe == len(length) and first + 1 < len(self.blocks):
            first, start, safe = first + 1, begin, 0
        old_end = place + removed
        shift = len(put) - removed
        self.text = self.text[:place] + put + self.text[old_end:]
        # read on until a boundary of the old pieces behind the edit is met again
        fresh: list[str] = []
        at, leaf, known = begin, first, int(start)
        bounds = iter(())
        old = None
        stop = None
        for p in self.encoder.pieces(self.text, begin):
            fresh.append(p)
            at += len(p)
            target = at - shift
            if target < old_end:
                continue
            while old is None or old < target:
                old = next(bounds, None)
                while old is None and leaf < len(self.blocks):
                    b = known + np.cumsum(self.blocks[leaf][0])
                    if len(b):
                        known = int(b[-1])
                    bounds = iter([(int(x), leaf, k + 1) for k, x in enumerate(b)])
                    leaf += 1
                    old = next(bounds, None)
                if old is None:
                    break
                old, where = old[0], old[1:]
            if old == target:
                stop = where
                break
        if stop is None:
            stop = len(self.blocks) - 1, len(self.blocks[-1][0])
        last, kept = stop
        new_length = np.fromiter(map(len, fresh), np.int64, len(fresh))
        new_count = np.array(self.encoder.counts(fresh), np.int64)
        head, tail = self.blocks[first], self.blocks[last]
        tail = tail[0][kept:], tail[1][kept:]
        length = np.concatenate((head[0][:safe], new_length, tail[0]))
        count = np.concatenate((head[1][:safe], new_count, tail[1]))
        none = np.zeros(0, np.int64)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, none, none)
        self._set(first, length, count)
        if len(length) > 4 * BLOCK:
            self._build(*(np.concatenate([b[i] for b in self.blocks]) for i in range(2)))


def script(text: str, seed: str) -> list[Edit]:
    """Three edits fixed by the seed: words dropped in the middle, a note put in, an end appended or cut."""
    n, h = len(text), zlib.crc32(seed.encode())
    return [(n // 2, min(n // 2, 20 + h % 60), ""), (h % (n + 1), 0, f" [{h % 9973}] revised "), (n, 0, " The end.") if h % 2 else (max(0, n - 40), 15, "")]


def count_edited(docs: DataFrame, ranks: str, pattern: str, edits=script) -> DataFrame:
    """docs with n_tokens, n_edited (tokens after the edits) and n_reencoded (pieces encoded again) added.

    `edits` gives, from a text and its doc_id as text, the edits to apply one after the other.
    """
    more = ("n_tokens", "n_edited", "n_reencoded")
    names = [c for c in docs.columns if c not in more]
    schema = docs.select(*names).schema
    for c in more:
        schema = schema.add(c, "long")

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in small_batches(it):
            out: list[tuple[int, int, int]] = []
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            for part in slices(rows, lambda r: len(r[1] or ""), SLICE):
                for key, text in part:
                    d = Document(text or "", encoder)
                    before, done = d.tokens, encoder.encoded
                    for e in edits(text or "", str(key)) if text else ():
                        d.edit(*e)
                    out.append((before, d.tokens, encoder.encoded - done))
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *more])

    return keep(docs.select(*names).mapInArrow(run, schema), "counts", 500)


_TREE = "doc_id long, tree_id string, n_rows long, text string, n_tokens long, lengths binary, counts binary"
_EDITED = f"{_TREE}, n_edits long, n_reencoded long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The stored trees of docs (doc_id, text): one for each distinct (doc_id, text), n_rows rows of docs.

    tree_id names a tree for good, whatever edits come; lengths and counts hold the characters and tokens of each
    piece, from which the sums are built when it is read.  A null text is kept as an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("n_rows"))
    rows = rows.select("doc_id", F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), "UTF-8")).alias("tree_id"), "n_rows", "text")

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in small_batches(it):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "tree_id", "n_rows", "text")]
            for part in slices(zip(*columns), lambda r: len(r[3]), SLICE):
                out = []
                for r in part:
                    d = Document(r[3], encoder)
                    out.append((*r, d.tokens, *d.pack()))
                yield _batch(out, _TREE)

    return keep(rows.mapInArrow(run, _TREE), "trees", 500)


def apply_edits(stored: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Stored trees after edits (doc_id, seq, place, removed, put), with n_edits and n_reencoded (pieces encoded again) added.

    The edits of an id are applied to each of its trees in the order of seq (equal ones: place, removed, put); places count
    characters of the text as the edits before have left it.  A null place is the end of the text, a null removed 0,
    a null put nothing.  Edits of ids without a tree and edits without an id do nothing.
    """
    names = [f.split()[0] for f in _TREE.split(", ")]
    stored = stored.select(*names)
    edits = edits.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("seq").cast("long").alias("seq"), F.col("place").cast("long").alias("place"), F.col("removed").cast("long").alias("removed"), "put")
    touched = edits.select("doc_id").distinct()
    n = touched.count()
    whole = stored.where("doc_id is not null")
    rest = semi(whole, touched, "doc_id", anti=True, rows=n).unionByName(stored.where("doc_id is null"))
    some = semi(whole, touched, "doc_id", rows=n)
    # a tree comes before its edits
    order = ["tree_id", "is_edit", "seq", "place", "removed", "put"]
    both = some.withColumn("is_edit", F.lit(False)).unionByName(edits.join(some.select("doc_id", "tree_id"), "doc_id").withColumn("is_edit", F.lit(True)), allowMissingColumns=True)
    both = both.select(*names, *order[1:]).repartition("tree_id").sortWithinPartitions(*order)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        now, of, n, done, out, size = None, None, 0, 0, [], 0

        def closed() -> tuple:
            return (of["doc_id"], of["tree_id"], of["n_rows"], now.text, now.tokens, *now.pack(), n, encoder.encoded - done)

        for batch in small_batches(it, 100):
            for r in batch.to_pylist():
                if r["is_edit"]:
                    now.edit(len(now.text) if r["place"] is None else r["place"], r["removed"] or 0, r["put"] or "")
                    n += 1
                    continue
                if now is not None:
                    out.append(closed())
                    size += len(now.text)
                now, of, n, done = Document.stored(r["text"], r["lengths"], r["counts"], encoder), r, 0, encoder.encoded
                if size > SLICE:
                    yield _batch(out, _EDITED)
                    out, size = [], 0
        if now is not None:
            out.append(closed())
        if out:
            yield _batch(out, _EDITED)

    new = both.mapInArrow(run, _EDITED).unionByName(rest.withColumn("n_edits", F.lit(0).cast("long")).withColumn("n_reencoded", F.lit(0).cast("long")))
    return keep(new, "edited", 500)

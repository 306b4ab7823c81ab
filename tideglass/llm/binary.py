"""Token-id files: a concatenated id array with Elias-Fano encoded document boundaries.

Documents are range partitioned and sorted by doc_id, encoded, and packed into segments.  A
segment is one self-contained file image, held as a binary value of a Parquet table so
that any store Spark can write to will do and a lost task leaves nothing half written.

Segment: magic, header (number of documents, of ids and of null doc ids, width of an id, least doc id), the two
Elias-Fano codes' sizes, ids (u16 or u32, little-endian), Elias-Fano code of the n_docs + 1 boundaries (0 to
n_ids) and of the doc ids above the least: the low `l` bits of each value packed
together, the high parts as a unary bit string, and a sampled select directory (the position of
every SAMPLE-th one).  offset(i) = (select1(i) - i) << l | low(i): 2 + l bits a document where a
plain table takes 64.  One offset is found from the nearest sample on; the reader of whole segments asks for
all of them at once, which selects by byte counts.

Where the tokenizer's description says that it drops white space and cuts before and behind letters, words
between ASCII white space are encoded once per worker and kept: a text's ids are then the concatenation of
its words' ids.  With any other tokenizer whole texts are encoded.

Cases: a null or empty text is the end id alone; a null doc_id sorts first; rows that repeat
a doc_id follow each other, ordered by a hash of the text; an empty table gives no
segment; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.llm.hashing import slices
from tideglass.llm.shared import SLICE, batched, keep, lean, new_path, small_batches

MAGIC = b"TEFS0002"
END = 2
SAMPLE = 256
#: Ids of a segment, about; one document is never cut.
SEGMENT = 1_000_000
_CACHE = 250_000
#: Words handed to the tokenizer at once: its results are large.
_WORDS = 8_000
# Fixed value: the pattern of a pre-tokeniser that takes runs of letters, single digits and runs of other marks.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class EliasFano:
    """Monotone integers values[0..n-1] <= top, with select in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        l = max(0, (top // max(1, n)).bit_length() - 1)  # noqa: E741
        v = values.astype(np.uint64)
        bits = ((v[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, l, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Position of the i-th one of the high part, from the nearest sample on."""
        at = int(self.sample[i // SAMPLE])
        left = i % SAMPLE
        byte, bit = at // 8, at % 8
        word = int(self.high[byte]) >> bit << bit
        while True:
            c = word.bit_count()
            if left < c:
                for _ in range(left):
                    word &= word - 1
                return byte * 8 + (word & -word).bit_length() - 1
            left -= c
            byte += 1
            word = int(self.high[byte])

    def get(self, i: int) -> int:
        low = 0
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            low |= (int(self.low[b // 8]) >> (b % 8) & 1) << k
        return (self.select(i) - i) << self.low_bits | low

    def get_many(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i: selects by the number of ones up to each byte."""
        ones = np.cumsum(_POPCOUNT[self.high])
        byte = np.searchsorted(ones, i, "right")
        rank = i - (ones[byte] - _POPCOUNT[self.high[byte]])
        high = byte * 8 + _SELECT[self.high[byte], rank] - i
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)).astype(np.uint64) << np.uint64(k)
        return out

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.low.tobytes(), self.high.tobytes(), self.sample.astype("<u4").tobytes()


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POPCOUNT = _BITS.sum(axis=1).astype(np.int64)
#: place of the r-th one of a byte
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")


_HEAD = "<4Qq8Q"


def pack(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, width: int) -> bytes:
    """The file image of some documents in ascending order of doc_id; those that are None come first."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    keys = np.array([d - least for d in known], np.uint64)
    codes = EliasFano.encode(bounds, int(bounds[-1])), EliasFano.encode(keys, int(keys[-1]) if known else 0)
    parts = [c.parts() for c in codes]
    sizes = [n for c, p in zip(codes, parts) for n in (c.low_bits, *map(len, p))]
    head = struct.pack(_HEAD, len(doc_ids), len(ids), len(doc_ids) - len(known), width, least, *sizes)
    return b"".join((MAGIC, head, ids.astype(f"<u{width}").tobytes(), *parts[0], *parts[1]))


class Segment:
    """Reader of one file image."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token-id segment")
        n, n_ids, self.nulls, width, self.least, *sizes = struct.unpack_from(_HEAD, blob, 8)
        self.n = n
        at = 8 + struct.calcsize(_HEAD)
        self.ids = np.frombuffer(blob, f"<u{width}", n_ids, at)
        at += width * n_ids
        codes = []
        for count, (l, *lengths) in ((n + 1, sizes[:4]), (n - self.nulls, sizes[4:])):  # noqa: E741
            parts = []
            for kind, m in zip(("u1", "u1", "<u4"), lengths):
                parts.append(np.frombuffer(blob, kind, m // np.dtype(kind).itemsize, at))
                at += m
            codes.append(EliasFano(count, l, *parts))
        self.bounds, self.keys = codes

    def offsets(self) -> np.ndarray:
        """All boundaries."""
        return self.bounds.get_many(np.arange(self.n + 1)).astype(np.int64)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + k for k in self.keys.get_many(np.arange(self.n - self.nulls)).tolist()]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]

    def find(self, doc_id: int) -> int | None:
        """The place of the first document of that id, by binary search over selects."""
        low, high = 0, self.n - self.nulls
        while low < high:
            mid = (low + high) // 2
            if self.least + self.keys.get(mid) < doc_id:
                low = mid + 1
            else:
                high = mid
        return self.nulls + low if low < self.n - self.nulls and self.least + self.keys.get(low) == doc_id else None


_MARKS = b".,;:!?"


def word_wise(tokenizer) -> bool:
    """Whether the ids of a text are those of its words: white space only separates, and letters end at other marks."""
    told = json.loads(tokenizer.to_str())
    steps = lambda x, many: [] if x is None else x[many] if x["type"] == "Sequence" else [x]
    clean = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in steps(told["normalizer"], "normalizers"))
    cuts = steps(told["pre_tokenizer"], "pretokenizers")
    first = cuts[0] if cuts else {}
    cut = first.get("type") == "Split" and first["pattern"] == {"Regex": _PIECES} and first["behavior"] == "Removed" and first["invert"]
    level = all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
    return bool(clean and cut and level and told["post_processor"] is None and told["model"].get("end_of_word_suffix"))


def _letters(w: str) -> bool:
    """Whether w is one run of letters for the tokenizer, however it lowers and composes."""
    if w.isascii():
        return w.isalpha()
    low = w.lower()
    return low.isalpha() and unicodedata.is_normalized("NFC", low)


def _ends_in_letter(w: bytes) -> bool:
    if not w or b"'" in w:
        return False
    if w[-1] < 0x80:
        return 0x61 <= w[-1] <= 0x7A or 0x41 <= w[-1] <= 0x5A
    c = w.decode("utf-8", "replace")[-1]
    # lowering or composing must leave the letter a letter
    return c.isalpha() and c.lower() == c and unicodedata.normalize("NFC", c) == c


class _Numbers(dict):
    """Numbers words as they come; new ones are listed."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        self.new.append(w)
        return n


class WordEncoder:
    """Ids of whole texts through a table of words already encoded.

    New words go to the tokenizer as one text: a result per word would cost more than the encoding itself.  Words
    of letters alone are parted by blanks, and the ids that end a word cut the result; others
    are parted by a special token, whose id does.  When
    the table is full, words met once since the last time are dropped.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.by_words = word_wise(self.tokenizer)
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.cut, self.mark = (special[0][0], special[0][1].content) if special else (None, "")
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        # word 0 stands for the end id
        self.place = _Numbers({b"": 0})
        self.pool, self.start, self.size, self.used = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.ones(1, np.int64)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _ids(self, words: list[bytes], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after the other, number of each)."""
        if letters:
            ids = self._one(b" ".join(words).decode("utf-8", "replace"))
            at = np.flatnonzero(self.last[ids])
            if len(at) == len(words):
                return ids, np.diff(np.concatenate(([-1], at)))
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark and not any(self.mark in t for t in texts):
            ids = self._one(self.mark.join(texts))
            at = np.flatnonzero(ids == self.cut)
            if len(at) == len(texts) - 1:
                return ids[ids != self.cut], np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _shrink(self) -> None:
        """Drop the words met once since the last time, and of the others all but the latest."""
        keep = np.flatnonzero(self.used > 1)
        keep = np.concatenate(([0], keep[keep > 0][-_CACHE // 2 :]))
        words = list(self.place)
        self.place = _Numbers({words[i]: k for k, i in enumerate(keep.tolist())})
        self.size = self.size[keep]
        self.pool, at = self._gather(self.start[keep], self.size)
        self.start, self.used = at, np.ones(len(keep), np.int64)

    def _gather(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pool's ids from each start on, the places where they now begin)."""
        at = np.cumsum(size) - size
        return self.pool[np.arange(size.sum()) + np.repeat(start - at, size)], at

    def _learn(self) -> None:
        """Give the words that have just been numbered their ids."""
        place = self.place
        # a word that ends in one mark behind a letter is its stem's ids and the mark's: the pre-tokeniser cuts there
        stems, whole = [], []
        for w in place.new:
            (stems if w[-1] in _MARKS and _ends_in_letter(w[:-1]) else whole).append(w)
        place.new = []
        parts = np.fromiter((place[x] for w in stems for x in (w[:-1], w[-1:])), np.int64, 2 * len(stems))
        whole += place.new
        place.new = []
        more = np.zeros(len(place) - len(self.size), np.int64)
        self.start, self.size, self.used = (np.concatenate((x, more)) for x in (self.start, self.size, self.used))
        # bytes that are ASCII letters alone need no look at their text
        kinds: tuple[list, list] = ([], [w for w in whole if w.isalpha()])
        for w in whole:
            if not w.isalpha():
                kinds[_letters(w.decode("utf-8", "replace"))].append(w)
        for letters, some in enumerate(kinds):
            for a in range(0, len(some), _WORDS):
                part = some[a : a + _WORDS]
                self._put([place[w] for w in part], *self._ids(part, bool(letters)))
        if stems:
            ids, _ = self._gather(self.start[parts], self.size[parts])
            self._put([place[w] for w in stems], ids, self.size[parts].reshape(-1, 2).sum(axis=1))

    def _put(self, at: list[int], ids: np.ndarray, size: np.ndarray) -> None:
        self.start[at], self.size[at] = len(self.pool) + np.cumsum(size) - size, size
        self.pool = np.concatenate((self.pool, ids))

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id; bounds)."""
        if not self.by_words:
            got = [np.array([*e.ids, end], np.uint32) for e in self.tokenizer.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.cumsum([0, *map(len, got)])
        # the tokenizer lowers letters itself; a text that may hold a special token's string stays as it is
        parts = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts] if self.lowers else [t.split() if t else [] for t in texts]
        for p in parts:
            p.append(b"")
        words = list(chain.from_iterable(parts))
        if len(self.place) > _CACHE:
            self._shrink()
        word = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.new:
            self._learn()
        self.pool[0] = end
        self.used += np.bincount(word, minlength=len(self.used))
        size = self.size[word]
        ids, at = self._gather(self.start[word], size)
        return ids, np.append(at, len(ids))[np.concatenate(([0], np.cumsum([len(p) for p in parts])))]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder: its table of words serves one task after the other."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_SEGMENTS = "part int, seq int, n_docs long, n_ids long, image binary"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, segment: int = SEGMENT) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into a table of segments at path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # ties of doc_id by a hash of the text: reruns agree
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, sizes, seq
            ids, bounds = np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            image = pack(keys, ids, bounds, encoder.width)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_ids", "image"])
            keys, held, sizes, seq = [], [], [], seq + 1
            return out

        for batch in small_batches(it):
            got = zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
            for some in slices(got, lambda r: len(r[1] or b""), SLICE // 2):
                ids, bounds = encoder.encode([t for _, t in some], end)
                keys += [k for k, _ in some]
                held.append(ids)
                sizes.append(np.diff(bounds))
                if sum(map(len, held)) >= segment:
                    yield flush()
        if keys:
            yield flush()

    with batched(docs.sparkSession):
        rows.mapInArrow(run, _SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at path: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(_SEGMENTS).parquet(path)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, seq, image in ((b.column("part")[0].as_py(), b.column("seq")[0].as_py(), b.column("image")[0].as_py()) for b in small_batches([batch], 1)):
                s = Segment(image)
                bounds = s.offsets()
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = s.n
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(s.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = files.select("part", "seq", "image").mapInArrow(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # ids before each segment: totals of the parts first (one row a partition), then within the part
    sizes = files.select("part", "seq", "n_ids")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(W.orderBy("part"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before(W.partitionBy("part").orderBy("seq"))), F.lit(0))
    bases = sizes.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to files in the shared folder and read their documents back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, path, tokenizer)
    return keep(read(spark, path), "token-documents", 4)

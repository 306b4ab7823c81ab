"""The archive, rewrite and spelling operators against plain Python."""

import glob
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow.parquet as pq
import pytest
import zstandard as zstd

from tideglass.llm import queries, rewrite, variants, warc
from tideglass.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, NAMES string"


# --- archives ------------------------------------------------------------------------------------------------------


def archived(rows):
    """What the contract asks for: (page_id, bytes, digest, type, refers_to) of every (page_id, html)."""
    best = {}
    for i, html in rows:
        best[html] = max(best.get(html, -1), -1 if i is None else i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        to = best[html] if len(data) >= 1000 and best[html] >= 0 and best[html] != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def hostile_pages():
    rng = random.Random(4)
    big = ["<p>" + "é" * 500 + str(k) for k in range(4)]
    rows = [(i, f"http://a.example/{i}", rng.choice(big)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x/ä b\r\nWARC-Type: response", "short"), (103, "u", "short"), (None, "n", big[0]), (59, "again", big[1]), (59, "again", big[1])]
    rows += [(200, "long", "x y " * 300_000), (201, "edge", "a" * 999), (202, "edge", "a" * 999), (203, "edge", "b" * 1000), (204, "edge", "b" * 1000)]
    return rows


def test_archive_round_trip(spark):
    rows = hostile_pages()
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, Payload_Bytes string").repartition(3)
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    assert got == archived([(i, html) for i, _, html in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0
    null = spark.createDataFrame([(None, None, "c" * 2000)] * 2, pages.schema.simpleString().removeprefix("struct<").removesuffix(",Payload_Bytes:string>").replace(":", " ").replace(",", ", "))
    assert [(r.record_type, r.refers_to) for r in warc.round_trip(null).collect()] == [("response", None)] * 2


def test_archive_query_equals_brute_force(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op11_dictionary_warc"](spark, SF).collect()), key=str) == archived(rows)


def test_archive_files_hold_a_dictionary_and_one_frame_a_record(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder, date = str(tmp_path / "arc"), "2024-01-01T00:00:00Z"
    with Scratch(spark) as scratch:
        files = warc.write(warc.with_originals(pages.repartition(2), scratch), folder, warc.train(pages, date), date, 15_000).collect()
    assert len(files) > 2 and sorted(f.path for f in files) == sorted(glob.glob(f"{folder}/*")) and not glob.glob(f"{folder}-staging")
    found = 0
    for f in files:
        data = open(f.path, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and 1000 < size <= warc.DICTIONARY
        opened, rest, n = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(data[8 : 8 + size])), data[8 + size :], 0
        while rest:
            frame = opened.decompressobj()
            text = frame.decompress(rest)
            rest = frame.unused_data
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC/1.1\r\n") == 1
            n += 1
        assert n == f.records + 1
        found += f.records
        # a file that is cut off is told
        with pytest.raises((ValueError, zstd.ZstdError)):
            list(warc.frames(io.BytesIO(data[:-5])))
    assert found == pages.count()


# --- rewrite -------------------------------------------------------------------------------------------------------

NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


def expected_files(rows):
    """The final files by plain sorting; rows are tuples in the order of NAMES, equal ids only with equal rows."""
    key = lambda r: (-1, 0) if r[0] is None else (zlib.crc32(str(r[0]).encode()), r[0])
    rows = sorted(rows, key=key)
    size, out = 1 + len(rows) // 250, []
    for file_no in range(math.ceil(len(rows) / size)):
        own = rows[file_no * size : (file_no + 1) * size]
        v = zlib.crc32(b"19:%d" % file_no) % 24
        v = 0 if v > 15 else v
        names = list(NAMES)
        if v & 1:
            names[4], names[5] = "email", "name"
        if v & 4:
            names = [n for n in names if n not in ("nation_id", "segment")]
        if v & 2:
            names[1:] = names[:0:-1]
        lines, nulls = [], 0
        for r in own:
            r = list(r)
            if v & 4:
                r[7], r[8] = -1, "none"
            if v & 8 and r[9] is not None:
                r[9] = struct.unpack("f", struct.pack("f", r[9]))[0]
            nulls += sum(x is None for x in r)
            r[3] = None if r[3] is None else round((r[3] - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
            r[9] = None if r[9] is None else math.floor(1048576 * r[9])
            lines.append("|".join("?" if x is None else str(x) for x in r))
        ids = ",".join("?" if r[0] is None else str(r[0]) for r in own)
        out.append((file_no, v, len(own), nulls, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256("\n".join(lines).encode()).hexdigest(), ",".join(names), ",".join(NAMES), v != 0))
    return out


def facts(df):
    return sorted((r.file_no, r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in df.collect())


def test_rewrite_query_equals_plain_sorting(spark):
    rows = [tuple(r[n] for n in NAMES) for r in spark.read.parquet(f"{SF}/clients.parquet").collect()]
    assert facts(queries.QUERIES["op12_merge_sort_rewrite"](spark, SF)) == expected_files(rows)


@pytest.fixture(scope="module")
def hostile_clients():
    rng = random.Random(8)
    day = datetime(2024, 2, 3, 4, 5, 6, 789)
    rows = [(i, i % 7, "s", day, f"n|{i}", None if i % 5 else "e", "c" * (i % 3), i % 25, None if i % 4 else "x", rng.uniform(-9e5, 9e5), "z") for i in range(900)]
    hot = (4711, 1, None, None, "", "", None, None, "y", 0.1, "z")
    rows += [hot] * 700 + [(None, None, None, None, None, None, None, None, None, None, None)] * 5 + [(-3, 9, "long", day, "w" * 300_000, "", "", 1, "q", None, "z")]
    rng.shuffle(rows)
    return rows


def test_rewrite_of_hot_null_and_long_rows(spark, hostile_clients):
    clients = spark.createDataFrame(hostile_clients, CLIENT).repartition(7)
    got = rewrite.sorted_and_rewritten(clients)
    want = expected_files([r[:10] for r in hostile_clients])
    assert facts(got) == want
    paths = [r.path for r in got.collect()]
    folder = paths[0].rsplit("/", 1)[0]
    assert sorted(glob.glob(f"{folder}/*")) == sorted(paths)
    for p in paths:
        s = pq.read_schema(p)
        assert s.equals(rewrite.schema_of(0)) and [f.metadata[b"PARQUET:field_id"] for f in s] == [str(i).encode() for i in range(1, 11)]
    # merging in rounds gives the same files
    again = rewrite.start_files(clients, f"{folder}-rounds", fan_in=2)
    assert facts(rewrite.described(rewrite.rewritten(again, f"{folder}-rounds"))) == want
    assert rewrite.sorted_and_rewritten(clients.limit(0)).count() == 0
    assert facts(rewrite.sorted_and_rewritten(clients.where("client_id = 3"))) == expected_files([r[:10] for r in hostile_clients if r[0] == 3])


def test_files_of_version_0_stay_untouched_and_drifted_ones_drift(spark, tmp_path, hostile_clients):
    folder = str(tmp_path / "files")
    start = rewrite.start_files(spark.createDataFrame(hostile_clients, CLIENT), folder)
    before = {r.path: open(r.path, "rb").read() for r in start.collect()}
    for r in start.collect():
        s = pq.read_schema(r.path)
        assert ",".join(s.names) == r.start_columns and s.equals(rewrite.schema_of(r.version), check_metadata=False)
    assert {r.version for r in start.collect()} == set(range(16))
    final = rewrite.rewritten(start, folder)
    for r in final.collect():
        assert r.rewritten == (r.version != 0) == (r.path not in before)
        if not r.version:
            assert open(r.path, "rb").read() == before[r.path]


# --- spelling ------------------------------------------------------------------------------------------------------


def spelled(docs):
    """The contract's rows by listing every deletion of every word."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: {v for i in range(len(w) + 1) for v in by.get(w[:i] + w[i + 1 :], ()) if one_edit(w, v)} for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v and n[v] >= 10 * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def test_variants_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_rare_first_variants"](spark, SF)
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()) == spelled(docs)


def test_variants_of_crowded_words(spark):
    rng = random.Random(6)
    words = {"abababab", "babababa", "aaaaaaaaa", "ÿÀÀ÷éééé"}
    for _ in range(5):
        for w in rng.sample(sorted(words), min(len(words), 60)):
            i = rng.randrange(len(w))
            words |= {w[:i] + rng.choice("abÀé") + w[i + rng.randint(0, 1) :] for _ in range(4)} | {w[:i] + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 6)
    weight = {w: rng.choice([1, 2, 2, 3, 25, 260, 2700]) for w in words}
    docs = [(i % 50 if i % 9 else None, " ".join([w] * k) + " x1y") for i, (w, k) in enumerate(weight.items())]
    docs += [(1, None), (2, ""), (3, "1234567"), (4, "UPPERÉcase UPPERÉcase"), (5, "l" * 2000 + " " + "l" * 2000)] + docs[:40]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, Word string, n string").repartition(5)
    got = sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.variants(frame).collect())
    want = spelled(docs)
    assert got == want and sum(r[3] is not None for r in want) > 20 and any(r[3] and r[5] != r[3] for r in want)
    assert variants.variants(frame.limit(0)).count() == 0
    shorter = zlib.crc32(("1:" + "lé" * 150_000).encode()) % 31 == 0
    long = spark.createDataFrame([(1, "lé" * 150_000 + " " + "lé" * 150_000 + " " + "word " * 200_000)], "doc_id long, text string")
    assert [(len(r.word), r.n, r.n_near, r.root == r.word) for r in variants.variants(long).collect()] == [(300_000 - shorter, 2, 0, True)]


def test_words_one_edit_apart_share_a_key():
    rng = random.Random(1)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 14)))
        i = rng.randrange(len(w) + 1)
        v = rng.choice([w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :], w[:i] + w[i + 1 :]])
        if len(v) < 7 or v == w:
            continue
        grams = sorted({x[k : k + 2] for x in (v, w) for k in range(len(x) - 1)})
        rank = {g: k for k, g in enumerate(rng.sample(grams, len(grams)))}
        a, b = sorted((v, w), key=len)
        low, high = variants.keys_of(a, rank), variants.keys_of(b, rank)
        assert {k for k, role in low if role == 0} & {k for k, _ in high}, (a, b)

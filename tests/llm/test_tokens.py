"""Packing (1) and token files (8) against whole-text encoding by the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sleuthframe.llm import packing, token_files
from sleuthframe.llm.common import CachedEncoder, Scratch, default_tokenizer

ROWS = [
    (5, "The quick  brown\tfox, don't stop!!", "a", 1),
    (None, "null id", "a", 1),
    (3, None, "a", 1),
    (2, "", "b", 2),
    (9, "long " * 30_000, "b", 2),
    (9, "a second text of that id", "b", 2),
    (5, "The quick  brown\tfox, don't stop!!", "a", 1),
    (7, "Ünïcode İI ΣΑΣ   x́ <|endoftext|> 12345 %%% ***\x1cz", None, None),
]
COLUMNS = "doc_id long, text string, ids string, length int"


def library(texts, end):
    t = CachedEncoder(default_tokenizer()).tokenizer
    return [np.array([*e.ids, end], "<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_cached_encoder_equals_library(texts):
    assert CachedEncoder(default_tokenizer()).encode(texts) == [x[:-4] for x in library(texts, 0)]


def test_cache_is_bounded():
    e = CachedEncoder(default_tokenizer(), most=3)
    for k in range(20):
        e.encode([f"word{k} and{k} more, things."])
    assert len(e.known) <= 12


def test_cache_keeps_common_words():
    e = CachedEncoder(default_tokenizer(), most=10)
    learnt, learn = [], e._learn
    e._learn = lambda w: (learnt.append(w), learn(w))[1]
    e.known = type(e.known)(e._learn, {})
    texts = [f"common word{k} and{k}. Ünï{k} more, things." for k in range(30)]
    assert e.encode(texts) == [x[:-4] for x in library(texts, 0)]
    assert learnt.count("common") == 1 and len(e.known) <= 20 and len(e.known.before) <= 20


def test_cache_with_repeated_texts():
    e = CachedEncoder(default_tokenizer(), most=2)
    texts = ["", " ", "a", "a, a", "...", "don't stop!! <|endoftext|>x", "x" * 50_000, "\x1cz"] * 3
    assert e.encode(texts) == [x[:-4] for x in library(texts, 0)]


def check_pieces(rows, want):
    """Each id in one piece, sequences gapless, padded only at a power of two."""
    by_seq, got = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(len(w) // 4 for _, w in want)
    return got


def test_pack(spark):
    rows = packing.pack(spark.createDataFrame(ROWS, COLUMNS)).collect()
    want = list(zip([r[0] for r in ROWS], library([r[1] for r in ROWS], 2), strict=True))
    got = check_pieces(rows, want)
    for key, ids in want:
        parts = sorted(got[key, len(ids) // 4])
        times = sum(1 for w in want if w == (key, ids))
        assert b"".join(p[2] for p in parts[::times]) == ids


@pytest.mark.parametrize("seed", range(6))
def test_packer_is_whole(seed):
    r = random.Random(seed)
    p, seen, docs = packing.Packer(), {}, {}
    for d in range(400):
        docs[d] = r.choice([1, r.randrange(1, 600), r.randrange(1, 5000), 4096, 512, 20_001])
        p.add(d, docs[d])
        if r.random() < 0.05 or d == 399:
            pieces, lengths = p.flush(last=d == 399)
            used = [0] * len(lengths)
            for doc, start, length, seq, offset, window in pieces:
                assert offset == used[seq] and length > 0
                used[seq] += length
                seen.setdefault(doc, []).append((start, length))
            assert used == lengths and all(n <= 4096 and n & (n - 1) == 0 for n in lengths)
    for d, n in docs.items():
        at = 0
        for start, length in sorted(seen[d]):
            assert start == at
            at += length
        assert at == n


def test_balance():
    r = random.Random(1)
    lengths = [r.choice([512, 1024, 2048, 4096]) for _ in range(1000)]
    groups = packing.balance(lengths, 1 << 16)
    sums = {}
    for n, g in zip(lengths, groups, strict=True):
        sums[g] = sums.get(g, 0) + n
    assert max(sums.values()) - min(sums.values()) <= 512 and packing.balance([], 10) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert packing.pack(none).count() == 0
    folder = Scratch(spark, "test").root
    assert token_files.read_token_files(token_files.write_token_files(none, folder), folder).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2), st.integers(0, 32), st.floats(0.01, 1), st.integers(0, 99))
def test_blocks_round_trip(blocks, bits, percentile, seed):
    g = np.random.default_rng(seed)
    v = g.integers(0, 1 << bits, 256 * blocks).astype("<u4")
    if len(v):
        v[g.integers(0, len(v), 5)] = 2**32 - 1
    packed = token_files.pack_blocks(v, percentile)
    starts = np.cumsum([0, *map(len, packed)])[:-1]
    assert (token_files.unpack_blocks(b"".join(packed), starts) == v).all()


def test_token_files(spark):
    folder = Scratch(spark, "test").root
    manifest = token_files.write_token_files(spark.createDataFrame(ROWS, COLUMNS), folder)
    rows = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: r.start)
    want = sorted(zip([r[0] for r in ROWS], [r[1] or "" for r in ROWS], library([r[1] for r in ROWS], 1), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    at = 0
    for r, (key, _, ids) in zip(rows, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (key, at, len(ids) // 4, ids)
        at += r.n_tokens


def test_token_files_shuffle_two_bytes_an_id(spark):
    """Ids of random letters hardly compress, so the shuffle's bytes are those of the ids."""
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=20_000)) for _ in range(40)]
    want, folder = library(texts, 1), Scratch(spark, "test").root
    docs, sc = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.sparkContext
    sc.setJobGroup("two-bytes", "")
    manifest = token_files.write_token_files(docs, folder)
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("two-bytes") for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert 0 < shuffled < 2.5 / 4 * sum(map(len, want))
    assert [bytes(x.ids) for x in sorted(token_files.read_token_files(manifest, folder).collect())] == want


def test_few_files_for_a_manifest_and_few_tasks_to_read(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id AS doc_id", "repeat('some words ', int(1 + id % 50)) AS text")
    folder = Scratch(spark, "test").root
    manifest = token_files.write_token_files(docs, folder, shards=40)
    assert manifest.count() == 40 and len(manifest.inputFiles()) == 1
    whole = token_files.read_token_files(manifest, folder)
    assert whole.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 40
    monkeypatch.setattr(token_files, "READ_TOKENS", 1)
    single = token_files.read_token_files(manifest, folder)
    assert single.rdd.getNumPartitions() == 40
    rows, at = sorted(whole.collect()), 0
    assert rows == sorted(single.collect()) and len(rows) == 900
    for r in rows:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("end", [65_535, 65_536, 2**32 - 1])
def test_token_files_with_ids_beyond_two_bytes(spark, end):
    folder = Scratch(spark, "test").root
    manifest = token_files.write_token_files(spark.createDataFrame(ROWS[:5], COLUMNS), folder, end_id=end)
    got = {r.doc_id: bytes(r.ids) for r in token_files.read_token_files(manifest, folder).collect()}
    assert got == dict(zip([r[0] for r in ROWS[:5]], library([r[1] for r in ROWS[:5]], end), strict=True))


def test_batches_are_taken_in_slices():
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["x" * 10_000] * 3000)], names=["a", "b"])
    tracemalloc.start()
    rows = sum(len(texts) for _, texts in token_files.text_slices(token_files.row_slices([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and most < 8e6


def test_any_range_of_a_shard(spark, tmp_path):
    from pyarrow import fs

    g = np.random.default_rng(3)
    where = fs.LocalFileSystem()
    out = where.open_output_stream(str(tmp_path / "x"))
    w = token_files.ShardWriter(out)
    ids = [g.integers(0, 49408, n).astype("<u4") for n in (0, 1, 700, 256, 5000)]
    for k, x in enumerate(ids):
        w.add(k, x.tobytes())
    w.close()
    out.close()
    every = np.concatenate(ids)
    reader = token_files.ShardReader(where.open_input_file(str(tmp_path / "x")))
    for a, n in ((0, 0), (3, 10), (250, 20), (700, 5000), (0, len(every))):
        assert (reader.ids(a, n) == every[a : a + n]).all()
    assert [d[2] for d in reader.documents(most=300)] == [x.tobytes() for x in ids]

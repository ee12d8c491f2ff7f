"""Null and repeated ids, repeated rows, very long texts, empty tables and clashing columns, for every operator and stage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from millrace.llm import decontam, exact_dedup, line_dedup, minhash, packing, quality, sharding, substring, suffix, token_counts
from millrace.llm.common import free_name
from tests.llm.brute import near, repeats
from tests.llm.test_operators import hits

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns that an operator might use itself.
CLASHING = "doc_id long, text string, __mr_id long, __mr_text string, __mr_weight double, t binary, node string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 0.5, b"b", "n", "h") for d, t in rows], CLASHING)


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def mixed_rows():
    rng = random.Random(11)
    a, b, c = text_of(rng, 60), text_of(rng, 60), text_of(rng, 60)
    near_a = a.rsplit(" ", 1)[0] + " other"
    return [(None, a), (None, b), (4, a), (4, c), (5, near_a), (9, "dup"), (9, "dup"), (7, None), (7, None), (8, ""), (None, None)]


def test_near_stage_drops_rows_not_ids(spark):
    left = sorted((str(r.doc_id), r.text or "") for r in minhash.drop_near_copies(frame(spark, mixed_rows())).collect())
    a, b, c = (mixed_rows()[i][1] for i in (0, 1, 3))
    assert left == sorted([("None", b), ("4", a), ("4", c), ("9", "dup"), ("7", ""), ("7", ""), ("8", ""), ("None", "")])


def test_exact_stage_drops_rows_not_ids(spark):
    left = sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_exact_copies(frame(spark, mixed_rows())).collect())
    a, b, c, na = (mixed_rows()[i][1] for i in (0, 1, 3, 4))
    assert left == sorted([("None", b), ("4", a), ("4", c), ("5", na), ("9", "dup"), ("7", "")])


@pytest.mark.parametrize("block", [10**6, 40])
def test_decontamination_by_row(spark, block):
    items = [(1, text_of(random.Random(3), 30)), (2, "just three words"), (3, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[0][1]), (None, "clean"), (6, "x " + items[0][1]), (6, "another clean text"), (6, "just three words"), (2, None), (2, "one"), (2, "one")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in decontam.decontaminate(frame(spark, rows), bench, block_bytes=block).collect())
    want = [(str(d), n, h, tuple(found), h > 0 and 20 * h >= n) for d, t in rows for n, h, found in [hits(t, items)]]
    assert got == sorted(want)
    left = decontam.drop_contaminated(frame(spark, rows), bench, block_bytes=block)
    assert left.columns == frame(spark, rows).columns and sorted(r.text or "" for r in left.collect()) == ["", "another clean text", "clean"]


def test_a_benchmark_item_longer_than_a_block(spark):
    item = text_of(random.Random(4), 200)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    doc = "x " + " ".join(item.split()[77:100]) + " y"
    r = decontam.decontaminate(frame(spark, [(1, doc)]), bench, block_bytes=150).first()
    assert (r.n_words, r.n_hit, r.items) == (25, 23, ["1"])


def test_repeated_ids_are_rows_of_their_own(spark):
    df = frame(spark, mixed_rows())
    n = len(mixed_rows())
    out = minhash.near_duplicates(df, 80).collect()
    assert len(out) == n and {r.component_id for r in out if r.doc_id == 5} == {4} and all(r.kept for r in out if r.doc_id in (7, 8, 9))
    assert len(exact_dedup.exact_dedup(df).collect()) == n
    shards = sharding.shard_documents(df).collect()
    assert len(shards) == n and len({(r.shard, r.slot) for r in shards}) == n
    pieces = packing.pack_documents(df, BPE, 64).collect()
    assert sum(r.piece == 0 for r in pieces) == n and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert token_counts.prefix_counts(df, MODEL).count() == n
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_selected(df, labels)
    assert kept.columns == df.columns and quality.resample(df, labels).count() == n
    for op in (suffix.repeated_strings, substring.substring_dedup, line_dedup.line_dedup):
        assert op(df).count() == n


def test_very_long_texts(spark):
    rng = random.Random(6)
    long = text_of(rng, 190_000)
    assert len(long) > 1 << 20
    rows = [(1, long), (2, text_of(rng, 30) + " " + long[700_000:1_060_000]), (3, long), (4, "a b c")]
    df = frame(spark, rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_strings(df).collect()}
    assert got == repeats(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 85).collect()} == near(rows, 85)
    cut = {r.doc_id: r.n_removed for r in substring.substring_dedup(df).collect()}
    assert cut[1] < 2000 and cut[2] > 350_000 and cut[3] == len(long)
    assert {r.doc_id for r in exact_dedup.exact_dedup(df).collect() if r.kept} == {1, 2, 4}
    lines = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(df).collect()}
    assert lines == {1: 0, 2: 0, 3: 1, 4: 0}
    bench = spark.createDataFrame([(1, long[1_050_000:1_051_000])], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.decontaminate(df, bench).collect()}
    assert found[1].n_hit > 100 and not found[1].contaminated and found[4].n_hit == 0
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in sharding.shard_documents(df).collect()}
    assert sizes == {d: (len(t) + 8, zlib.crc32(t.encode())) for d, t in rows}
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(BPE).encode(long, add_special_tokens=False).ids, 0])
    assert sum(r.length for r in packing.pack_documents(df, BPE).collect() if r.doc_id == 1) == len(ids)
    assert quality.resample(df, spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")).count() == 4


def test_empty_tables(spark):
    empty, labels = frame(spark, []), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (minhash.drop_near_copies(empty), exact_dedup.drop_exact_copies(empty), decontam.drop_contaminated(empty, bench), quality.keep_selected(empty, labels)):
        assert out.columns == empty.columns and out.count() == 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_free_names(spark):
    df = frame(spark, [])
    assert free_name(df, "id") == "__mr_id_" and free_name(df, "other") == "__mr_other"

"""Decontamination, token counts, exact and line dedup, packing, sharding and quality selection on small inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import decontam, exact_dedup, line_dedup, packing, quality, queries, sharding, token_counts
from tests.compare import differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, n_words long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_duckdb(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.SQL[name], SF) == ""


# --- decontamination


def hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    w, covered, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for j in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[j : j + n]:
                    covered |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(covered), sorted(found)


def benchmark_case():
    rng = random.Random(2)
    word = lambda: rng.choice(["Aß", "be", "c3", "é", "zz"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 12, 13, 14, 40, 40])] + [(9, None), (10, "!?"), (3, "Extra words of item three")]
    docs = []
    for d in range(40):
        t = [word() for _ in range(rng.randrange(0, 30))]
        t += rng.choice(items[3:7])[1].upper().replace("É", "é").split()[: rng.randrange(5, 41)] + [word() for _ in range(rng.randrange(0, 60))]
        docs.append((d, ", ".join(t)))
    return items, [*docs, (50, None), (51, ""), (52, "..."), (53, "nothing here")]


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontaminate(spark, block):
    items, docs = benchmark_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in decontam.decontaminate(frame(spark, docs), bench, block_bytes=block).collect()}
    for d, t in docs:
        n, hit, found = hits(t, items)
        r = out[d]
        assert (r.n_words, r.n_hit, r.items, r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
        assert len(" ".join(t[s.start : s.end] for s in r.spans)) >= hit if t else not r.spans


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = frame(spark, [(1, "a b"), (None, None)])
    assert [r.n_hit for r in decontam.decontaminate(df, bench).collect()] == [0, 0]
    assert decontam.decontaminate(frame(spark, []), bench).count() == 0
    kept = decontam.drop_contaminated(df, spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [None]


# --- token counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab the ing  \n\t▁é中😀<s>0xÑ.'　\x00", max_size=60))
def test_every_prefix_has_the_library_count(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = token_counts.counter(MODEL).deltas(text)
    assert [token_counts.tokens_at(d, i) for i in range(len(text) + 1)] == [len(lib.encode(text[:i])) for i in range(len(text) + 1)]


def test_token_counts(spark, pieces):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(None, None), (900, ""), (901, " x" * 9000)]
    out = {r.doc_id: r for r in token_counts.prefix_counts(frame(spark, rows), MODEL).collect()}
    for d, t in rows:
        t, r = t or "", out[d]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(pieces.encode(t)))
        deltas = zlib.decompress(r.prefix_deltas)
        assert len(deltas) == 2 * len(t) and len(pieces.encode(t[: r.fit_chars])) <= 4096
        assert token_counts.longest_prefix(deltas, 10) <= len(t)
    assert token_counts.prefix_counts(frame(spark, []), MODEL).count() == 0


# --- exact dedup


def test_exact_dedup_and_collisions(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a  b"), (1, "xy"), (2, "yx"), (7, None), (8, " \n"), (None, "ab"), (4, "　ab")]
    want = {5: (9, 4), 3: (9, 4), 9: (9, 4), 1: (1, 1), 2: (2, 1), 7: (8, 2), 8: (8, 2), None: (9, 4), 4: (4, 1)}
    for h in (exact_dedup.content_hash, F.char_length):  # the second collides
        out = exact_dedup.exact_dedup(frame(spark, rows), content_hash=h).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in out} == want
        assert {r.doc_id for r in out if r.kept} == {9, 1, 2, 8, 4}
        assert next(r for r in out if r.doc_id == 1).text_sha256 == hashlib.sha256(b"xy").hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, rows)).columns == frame(spark, rows).columns


# --- line dedup


def lines_case():
    rng = random.Random(4)
    line = lambda: rng.choice("abcdefgh") * 3
    rows = [(i, "\n".join(rng.choice([line(), "", " "]) for _ in range(rng.randrange(0, 25)))) for i in range(40)]
    return [*rows, (90, None), (91, "\n\n"), (92, rows[3][1]), (93, rows[3][1])]


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(spark, least):
    rows, seen, out = lines_case(), set(), {}
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for d, t in rows}
    for d in sorted(seqs):
        s, gone = [x for _, x in seqs[d]], set()
        for q in range(len(s) - least + 1):
            block = tuple(s[q : q + least])
            if block in seen:
                gone |= set(range(q, q + least))
            seen.add(block)
        drop = {seqs[d][q][0] for q in gone}
        text = dict(rows)[d] or ""
        out[d] = (len(s), len(gone), sum(q - 1 not in gone for q in gone), "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup.line_dedup(frame(spark, rows), least).collect()}
    assert got == out


def test_line_edges(spark):
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0
    rows = [(1, "a\nb"), (1, "a\nb"), (None, "a\nb"), (2, "a\nb\nc")]
    assert sorted((str(r.doc_id), r.n_removed) for r in line_dedup.line_dedup(frame(spark, rows)).collect()) == [("1", 0), ("1", 0), ("2", 2), ("None", 0)]


def test_long_single_lines(spark):
    long = "x" * 260
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "a"), (5, long[:249]), (6, long[:249])]
    out = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert out == {1: (0, rows[0][1]), 2: (1, "c\nd"), 3: (1, ""), 4: (0, "a"), 5: (0, long[:249]), 6: (0, long[:249])}


# --- packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(spark, docs, length):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(frame(spark, docs), BPE, length).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        ps = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids)
        assert all(p.length == length for p in ps[1:]) and (len(ps) == 1 or len(ids) > length)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in ps)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return len(by_seq), packing.lower_bound(np.array([r.length for r in rows]), length)


def test_packing(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(900, None), (901, "a\tb\n\n c  "), (902, "<|endoftext|> x")]
    n, bound = check_packing(spark, docs, 2048)
    assert n <= bound * 1.03 + 1
    check_packing(spark, docs[:60], 64)
    assert packing.pack_documents(frame(spark, []), BPE).count() == 0


def test_fast_ids_equal_the_library():
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(BPE), packing.IdEncoder(BPE)
    assert e.fast is not None
    ids = lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + list(range(0x3100, 0x110000, 211))
    points = [c for c in points if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b1{chr(c)}2.{chr(c)} {chr(c)}\n" for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    texts += ["", " ", "\n\n", "  a  ", "it's we'll I'M don't", "<|endoftext|>", "a<|endoftext|>b", " " * 5000, "x" * 5000, "\x00\x01", "a\u200bb", "\r\n\t x"]
    assert e.encode(texts) == [ids(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_fast_ids_on_any_text(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    assert packing.encoder(BPE).encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_packing_certificates(spark):
    docs = [(i, "word " * (10 + 7 * i % 90)) for i in range(400)]
    rows = packing.pack_documents(frame(spark, docs), BPE, 128).collect()
    used = len({r.sequence_id for r in rows})
    assert all(r.gap >= 0 for r in rows) and used <= packing.lower_bound(np.array([r.length for r in rows]), 128) * 1.05 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_and_bound(sizes):
    x = np.array(sizes, dtype=np.int64)
    bins = packing.best_fit(x, 50)
    fill = np.bincount(bins, weights=x) if len(x) else np.array([])
    assert (fill <= 50).all() and packing.lower_bound(x, 50) <= len(fill) and (fill > 0).all()


# --- sharding


def test_sharding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(5000, None), (None, "x")]
    rows = sharding.shard_documents(frame(spark, docs)).collect()
    text = dict(docs)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 24 and max(sizes.values()) < 1.8 * len(rows) / 24 and 10 < sum(r.grown_shard == 24 for r in rows) < 80
    again = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, [(d, "other") for d, _ in docs])).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def brute_shard(key, tree):
    """One descent in plain Python."""
    import math

    import xxhash

    def draw(name, weight):
        bits = xxhash.xxh64_intdigest(f"{key}/{name}/17".encode(), seed=42) >> 12
        return -math.log((bits + 0.5) / 2**52) / weight

    total = lambda leaves: sum(w for _, w in leaves)
    _, racks = min(tree, key=lambda r: draw(f"region{r[0]}", sum(total(x) for _, x in r[1])))
    _, leaves = min(racks, key=lambda k: draw(f"rack{k[0]}", total(k[1])))
    return min(leaves, key=lambda s: draw(f"shard{s[0]}", s[1]))[0]


def test_weights_move_only_their_subtree(spark):
    tree, grown = sharding.topology(24), sharding.topology(25, sealed=24)
    heavy = [(r, [(k, [(s, 3.0 if s == 5 else w) for s, w in leaves]) for k, leaves in racks]) for r, racks in tree]
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    for t, out in ((tree, "a"), (heavy, "b"), (grown, "c")):
        df = sharding.placed(df, F.col("k"), t, out)
    rows = df.collect()
    assert all((r.a, r.b, r.c) == tuple(brute_shard(r.k, t) for t in (tree, heavy, grown)) for r in rows)
    assert all(r.c in (r.a, 24) for r in rows)
    region, rack = {s: r for r, racks in tree for _, leaves in racks for s, _ in leaves}, {s: k for _, racks in tree for k, leaves in racks for s, _ in leaves}
    for r in rows:
        if r.a != r.b:  # into the region of the changed shard, or inside it into its rack, or inside that into it
            assert region[r.b] == region[5]
            assert region[r.a] != region[5] or rack[r.b] == rack[5] and (rack[r.a] != rack[5] or r.b == 5)
    assert 2.2 < sum(r.b == 5 for r in rows) / sum(r.a == 5 for r in rows) < 3.6


# --- quality


def quality_case(n=600):
    rng = random.Random(8)
    good = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 120))]
        kind = "toxic" if i % 9 == 0 else "junk" if i % 7 == 0 else "clean"
        if kind == "toxic":
            words[3:3] = ["idiot", "scum", "idiot"]
        if kind == "junk":
            words = [f"{w}%%%" for w in words]
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_quality(spark):
    docs, labels = quality_case()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.resample(frame(spark, docs), lab).collect()}
    bad = {d for d, _ in docs if d % 9 == 0 or d % 7 == 0}
    unseen = [d for d, _ in docs if d % 2]
    wrong = sum(out[d].kept == (d in bad) for d in unseen)
    assert wrong <= 0.05 * len(unseen)
    kept = quality.keep_selected(frame(spark, docs), lab)
    assert kept.columns == frame(spark, docs).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if r.kept}
    brute = sorted((r.gumbel_key for r in out.values()), reverse=True)
    n = sum(r.kept for r in out.values())
    assert all(r.kept == (r.gumbel_key >= brute[n - 1]) for r in out.values())


def test_quality_without_labels_keeps_all(spark):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.resample(frame(spark, [(1, "a"), (None, None), (2, "")]), none).collect()
    assert len(rows) == 3 and all(r.kept and r.log_weight == 0 for r in rows)
    assert quality.resample(frame(spark, []), none).count() == 0


def test_weights_match_plain_counts():
    docs, _ = quality_case(600)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for d, t in docs:
        np.add.at(raw, quality.ngrams(t.encode()), 1)
        if d % 9 and d % 7:
            np.add.at(target, quality.ngrams(t.encode()), 1)
    table = quality.log_ratios(raw, target)
    assert table[quality.ngrams(b"idiot")[0]] < 0 and table[quality.ngrams(b"w1")[0]] == 0


def test_weights_against_plain_sums():
    """Log weights from word counts alone, without the operator's hashing and arrays."""
    docs, labels = quality_case(300)
    good = {d for d, q, t in labels if q == 1 and t == 0}
    bad = {d for d, _, _ in labels} - good
    grams = lambda t: (w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    plain = [(d, t) for d, t in docs if "%" not in t]  # a junk word is two tokens
    raw, target, worse = Counter(), Counter(), Counter()
    arrays = [np.zeros(quality.BUCKETS) for _ in range(3)]
    for d, t in plain:
        for c, x, part in ((raw, arrays[0], True), (target, arrays[1], d in good), (worse, arrays[2], d in bad)):
            if part:
                c.update(grams(t))
                np.add.at(x, quality.ngrams(t.encode()), 1)
    n = [sum(c.values()) for c in (raw, target, worse)]

    def ratio(g):
        ex = [np.log((c[g] + 0.5) / (raw[g] * m / n[0] + 0.5)) for c, m in ((target, n[1]), (worse, n[2]))]
        r = ex[0] - ex[1]
        return np.sign(r) * max(abs(r) - 2.0, 0.0)

    table = quality.log_ratios(*arrays)
    for _, t in plain[:80]:
        g = grams(t)
        want = sum(map(ratio, g)) * (1000 / len(g)) ** 0.5
        assert abs(quality.log_weight(table, t.encode()) - want) < 0.02 * abs(want) + 0.5


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=500), [3.0] * 50, [-1e9, 1e9]))
    df = spark.createDataFrame([(float(v),) for v in x], "key double")
    for k in (1, 2, 30, 77, 300, len(x)):
        assert quality.kth_largest(df, k, few=5, bins=8) == np.sort(x)[::-1][k - 1]

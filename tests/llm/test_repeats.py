import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import substring, suffix
from tests.llm.brute import repeats

SCHEMA = "doc_id long, text string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400)]
    rows = [text(rng.randrange(0, 200)) + rng.choice(shared) + text(rng.randrange(0, 200)) + rng.choice(shared) for _ in range(150)]
    rows += [shared[4], shared[4], shared[4] + shared[4], "ab" * 300, "a" * 500, "é" * 120, "", "short", "x" * 99, "x" * 100, "x" * 101]
    ids = rng.sample(range(10_000), len(rows))
    return [*zip(ids, rows, strict=True), (20_001, None)]


def test_suffix_against_brute_force(spark):
    rows = corpus()
    df = frame(spark, rows).repartition(7)
    assert got(suffix.repeated_strings(df)) == repeats(rows)
    # Triggers of many contexts on both of their special ways.
    assert got(suffix.repeated_strings(df, group_rows=5, many=1)) == repeats(rows)


def test_suffix_other_length(spark):
    rows = corpus()[:60]
    assert got(suffix.repeated_strings(frame(spark, rows), length=40)) == repeats(rows, 40)


def test_suffix_small_chunks(spark, monkeypatch):
    rows = corpus()
    assert got(suffix.repeated_strings(frame(spark, rows).repartition(40), many=2)) == repeats(rows)


def test_suffix_test_data(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got(suffix.repeated_strings(frame(spark, rows))) == repeats(rows)


def test_edge_tables(spark):
    t = "abcdefghij" * 11
    assert got(suffix.repeated_strings(frame(spark, []))) == {} == got(substring.substring_dedup(frame(spark, [])))
    twice = frame(spark, [(1, t[:100]), (1, t[:100]), (None, t[:100]), (2, t[:100])])
    removed = sorted((str(r.doc_id), r.n_removed) for r in suffix.repeated_strings(twice).collect())
    assert removed == [("1", 0), ("1", 0), ("2", 100), ("None", 0)]
    removed = sorted((str(r.doc_id), r.n_removed) for r in substring.substring_dedup(twice).collect())
    assert removed[:2] == [("1", 0), ("1", 0)] and removed[3] == ("None", 0)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 50))
def test_rolled_hashes_tell_strings_apart(raw, n):
    if len(raw) >= n:
        h = suffix.rolled(raw, n)
        strings = [raw[i : i + n] for i in range(len(raw) - n + 1)]
        assert len(h) == len(strings) and len(set(h.tolist())) == len(set(strings))


def test_gear_depends_on_sixteen_bytes():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 3000).astype(np.uint8).tobytes()
    h = 0
    slow = []
    for b in raw:
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFFFFFF
        slow.append(h & 0xFFFF)
    assert (np.array(slow[16:]) == (substring.gear(raw)[16:] & 0xFFFF)).all()
    ends = substring.boundaries(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 3000 and sizes.max() <= 96 and sizes[:-1].min() >= 16


def plain_chunks(raw):
    """Boundaries byte by byte, from the rule alone."""
    at, h = 0, 0
    for i, b in enumerate(raw):
        h = (2 * h + xxhash.xxh32_intdigest(bytes([b]))) % 2**32
        size = i + 1 - at
        if (size >= 16 and not h & 0xF000) or (size >= 64 and not h & 0xC000) or size == 96 or i + 1 == len(raw):
            yield at, i + 1
            at = i + 1


def brute_chunks(rows, min_run):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw, marks = (t or "").encode(), []
        for s, e in plain_chunks(raw):
            if raw[s:e] in seen:
                if marks and marks[-1][1] == s:
                    marks[-1][1] = e
                else:
                    marks.append([s, e])
            seen.add(raw[s:e])
        out[d] = [(s, e) for s, e in marks if e - s >= min_run or e - s == len(raw)]
    return out


@pytest.mark.parametrize("min_run", [1, 80])
def test_chunks_against_brute_force(spark, min_run):
    rows = corpus()
    out = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in substring.substring_dedup(frame(spark, rows).repartition(5), min_run).collect()}
    assert out == brute_chunks(rows, min_run)


def test_chunks_catch_shifted_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(rng.randrange(5, 90))} {passage} {text(rng.randrange(5, 90))}") for i in range(40)] + [(100 + i, text(200)) for i in range(40)]
    out = {r.doc_id: r.n_removed for r in substring.substring_dedup(frame(spark, rows)).collect()}
    assert sum(out[i] > 0 for i in range(1, 40)) >= 37 and not any(out[100 + i] for i in range(40)) and out[0] == 0

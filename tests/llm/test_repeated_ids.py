"""An id that stands for several texts: what is removed is judged by rows, value by value."""

import hashlib
import random

import pytest

from millrace.llm import exact_dedup, line_dedup, substring, suffix
from tests.llm.brute import repeats
from tests.llm.test_edges import frame


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_no_unique_text_is_lost(spark):
    rng = random.Random(1)
    p, q = text_of(rng, 60), text_of(rng, 60)
    rows = frame(spark, [(0, p), (1, q), (1, p), (None, p), (None, q)])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for op in (suffix.repeated_strings, substring.substring_dedup):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in op(rows).collect())
        assert got == sorted([("0", len(p), 0, sha(p)), ("1", len(q), 0, sha(q)), ("1", len(p), len(p), sha("")), ("None", len(p), 0, sha(p)), ("None", len(q), 0, sha(q))])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strings_by_row_against_brute_force(spark, seed):
    """Rows in the order of (id, digest of the text) are judged as documents with the ids 0, 1, 2 and so on."""
    rng = random.Random(seed)
    parts = [text_of(rng, 25) for _ in range(5)]
    rows = list({(rng.randrange(4), " ".join(rng.sample(parts, rng.randrange(1, 4)))) for _ in range(12)})
    order = sorted(rows, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
    want = repeats([(i, t) for i, (_, t) in enumerate(order)])
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeated_strings(frame(spark, rows + rows[:2])).collect())
    listed = [(order[i][0], *w) for i, w in want.items()]
    assert got == sorted(listed + [(r[0], *want[order.index(r)]) for r in rows[:2]])


def test_lines_by_row(spark):
    rows = [(0, "l1\nl2"), (1, "x\ny\nz"), (1, "l1\nl2\nq")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(0, 2, 0, "l1\nl2"), (1, 3, 0, "x\ny\nz"), (1, 3, 2, "q")]


def test_the_longest_text_stays(spark):
    rows = [(3, "ab"), (3, "a  b"), (4, "a b")]
    assert [(r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(frame(spark, rows)).collect()] == [(3, "a  b")]
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.n_codepoints) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect())
    assert got == [(3, 3, 3, False, 2), (3, 3, 3, True, 4), (4, 3, 3, False, 3)]

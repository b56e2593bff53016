"""The removal of copied windows against a plain dictionary of windows; the sketch against exact counts."""

import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from repolens.llm import substring_dedup
from repolens.llm.queries import QUERIES
from tests.conftest import SF001

from .helpers import WORD, clashing, frame, odd_rows, prose


def plain(rows, length):
    words = [WORD.findall(r[1] or "") for r in rows]
    order = [(r[0] is not None, r[0] or 0) for r in rows]
    least = {}
    for w, o in zip(words, order):
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            least[key] = min(least.get(key, o), o)
    out = []
    for r, w, o in zip(rows, words, order):
        gone = set()
        for k in range(len(w) - length + 1):
            if least[tuple(w[k:k + length])] < o:
                gone.update(range(k, k + length))
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return collections.Counter(out)


def planted(n=60, seed=3):
    """Documents that share passages: at their ends, overlapping, twice in one document, by copies, in descending ids."""
    passages = [prose(1000 + s, 70) for s in range(6)]
    out = []
    for i in range(n):
        parts = [prose(seed * 100 + i, 40 + i)]
        if i % 2:
            parts.insert(i % 3 and 1, passages[i % 6])
        if i % 7 == 0:
            parts += [passages[0], passages[0], passages[1][:-9]]
        if i % 11 == 0:
            parts = [prose(77, 300)]
        out.append(((i * 37) % n if i % 13 else None, "\n \t".join(parts), "en", "a", 1))
    return out


def result(df, length=50):
    return collections.Counter(map(tuple, substring_dedup.drop_copied_windows(df, length).collect()))


@pytest.mark.parametrize("length", [50, 7, 1])
def test_odd_rows(spark, length):
    rows = [*odd_rows(), (20, "a b " * 60, "en", "a", 1), (21, "a b " * 60, "en", "a", 1), (22, "b a " * 60, "en", "a", 1)]
    assert result(clashing(frame(spark, rows)), length) == plain(rows, length)
    assert substring_dedup.drop_copied_windows(frame(spark, [])).count() == 0
    assert result(frame(spark, [(1, None, "en", "a", 0)])) == {(1, 0, 0, ""): 1}


@pytest.mark.parametrize("chunk,block,step", [(1 << 24, 1 << 24, 1 << 20), (4000, 50_000, 600)])
def test_planted_passages_over_many_chunks(spark, monkeypatch, chunk, block, step):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("STEP", step), ("RANGE", max(chunk, 5000))):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = planted()
    got = result(frame(spark, rows).repartition(3))
    assert got == plain(rows, 50)
    assert sum(r[2] for r in got) > 1000


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_substring_dedup"](spark, SF001)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = collections.Counter((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in plain(rows, 50).elements())
    assert collections.Counter(map(tuple, got.collect())) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 24), min_size=1, max_size=50).map(sorted))
def test_cells_round_trip(cells):
    assert substring_dedup.decoded(substring_dedup.coded(np.array(cells))).tolist() == cells


def test_estimates_never_fall_below_counts():
    """A tiny sketch: every cell collides, no repeated window is lost."""
    import pyarrow as pa
    import zstandard

    texts = [" ".join(WORD.findall(r[1])) for r in planted(20)]
    plan = substring_dedup.Plan(64, 50)
    chunks = [pa.table({"chunk": [i], "ids": [[i]], "data": [zstandard.compress(t.encode())]}) for i, t in enumerate(texts)]
    sketches = pa.concat_tables([plan.sketch(c) for c in chunks])
    merged = pa.concat_tables([plan.merge(sketches.filter(pa.compute.equal(sketches["block"], b))) for b in (0, 1)])
    counts = collections.Counter(tuple(t.split()[k:k + 50]) for t in texts for k in range(len(t.split()) - 49))
    for i, t in enumerate(texts):
        _, _, places = plan.candidates([t.encode()], merged.filter(pa.compute.equal(merged["chunk"], i)))
        words = t.split()
        assert {k for k in range(len(words) - 49) if counts[tuple(words[k:k + 50])] > 1} <= set(places.tolist())

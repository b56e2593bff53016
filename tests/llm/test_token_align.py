"""The alignment against the libraries and a plain walk over byte ends, its counts against plain counting."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repolens.llm import token_align
from repolens.llm.queries import QUERIES
from tests.conftest import SF001

from .helpers import clashing, frame, odd_rows

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
READER = token_align._readers(BYTES, PIECES)()
SHOWN = {c: b for b, c in enumerate(token_align.byte_symbols())}


def plain_groups(text):
    """Groups as lists of (A ids, B ids), by walking both sequences."""
    if not text:
        return []
    a = [(i, bytes(SHOWN[c] for c in A.id_to_token(i)) if i != 50256 else b"<|endoftext|>")
         for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        m, n = len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while m != n:
            if m < n:
                left.append(a[i])
                m += len(a[i][1])
                i += 1
            else:
                right.append(b[j])
                n += len(b[j][1])
                j += 1
        out.append(([t for t, _ in left], [t for t, _ in right]))
    return out


def show(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain(rows):
    found = [(r[0], plain_groups(r[1])) for r in rows]
    links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in found]
    count = collections.Counter(p for c in links for p in c)
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
             sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
             hashlib.sha256(show(g).encode()).hexdigest() if g else "") for (i, g), c in zip(found, links)]


TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
ODD = st.sampled_from([" ", "  ", "\n ", "\t", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "'s", " don't", "aaaaaaa", "日本語テキスト",
                       "\x00", " ", "　", "é", "ﬁ", "½", "🏳️‍🌈", "https://x.y/z?q=1", "1234567"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(TEXT, ODD), max_size=6).map("".join), max_size=4))
def test_groups_equal_a_walk(many):
    x = READER.align(many)
    want = [plain_groups(t) for t in many]
    assert [s.decode() for s in READER.shown(x)] == [show(g) for g in want]
    assert x["n_groups"].tolist() == [len(g) for g in want]
    text, a, b, times = READER.links(x)
    got = collections.Counter({(t, p, q): n for t, p, q, n in zip(text.tolist(), a.tolist(), b.tolist(), times.tolist())})
    assert got == collections.Counter((t, p, q) for t, g in enumerate(want) for left, right in g for p in left for q in right)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 400)), st.sets(st.integers(1, 400))), max_size=4))
def test_shared_groups_on_any_ends(docs):
    """Long cutless intervals too: few of the random ends agree."""
    ends_a, ends_b, n_a, n_b, want, base = [], [], [], [], [], 0
    for a, b in docs:
        a, b = sorted(a | {400}), sorted(b | {400})
        cuts = [0, *sorted(set(a) & set(b))]
        want += [(sum(n_a) + sum(e <= c for e in a), sum(n_b) + sum(e <= c for e in b)) for c in cuts[:-1]]
        ends_a += [base + e for e in a]
        ends_b += [base + e for e in b]
        n_a.append(len(a))
        n_b.append(len(b))
        base += 400
    got = token_align.shared_groups(*(np.array(x, np.int64) for x in (ends_a, ends_b, n_a, n_b)))
    assert list(zip(got[0].tolist(), got[1].tolist())) == want


def test_wide_groups_count_every_link(monkeypatch):
    monkeypatch.setattr(token_align, "WIDE", 1)
    test_groups_equal_a_walk.hypothesis.inner_test(["日本語テキスト aaaaaaaaa 🏳️‍🌈🏳️‍🌈", "", "x" * 3000])


def test_align_odd_rows(spark):
    rows = [*odd_rows(), (20, "a▁b", "en", "a", 1), (21, "日本語テキスト🏳️‍🌈 ½" * 5, None, None, 1)]
    got = token_align.align(clashing(frame(spark, rows)), BYTES, PIECES).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain(rows))
    assert token_align.align(frame(spark, []), BYTES, PIECES).count() == 0
    assert [tuple(r) for r in token_align.align(frame(spark, [(1, None, "en", "a", 0)]), BYTES, PIECES).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "")]
    shown = {r["doc_id"]: r["groups"] for r in token_align.groups(frame(spark, rows[-2:]), BYTES, PIECES).collect()}
    assert shown == {r[0]: show(plain_groups(r[1])) for r in rows[-2:]}


@pytest.mark.parametrize("chunk", [token_align.CHUNK, 5000])
def test_query_on_the_small_table(spark, monkeypatch, chunk):
    monkeypatch.setattr(token_align, "CHUNK", chunk)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_alignment"](spark, SF001)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain(rows))

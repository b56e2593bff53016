"""The manifest against a plain tree over all rows, and the partition's coordinates against a plain search."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from repolens.llm import merkle
from repolens.llm.queries import QUERIES
from tests.conftest import SF001

from .helpers import clashing, frame, odd_rows


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(shown))


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 8])))
        at //= 8
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    by = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for g in langs}
    trees = {g: plain_tree([leaf_of(*r) for r in by[g]]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    out = []
    for i, g in enumerate(langs):
        for at, r in enumerate(by[g]):
            proof = plain_proof(trees[g], at) + plain_proof(top, i)
            given = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                given = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            h = leaf_of(*given)
            for before, after in proof:
                h = sha(before + h + after)
            root = top[-1][0]
            out.append((r[0], leaf_of(*r), trees[g][-1][0], root, sha("".join(b + a for b, a in proof)), h, h == root))
    return out


def key(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


def checked(df):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.verify_documents(df, tampered, merkle.lower_ascii(F.col("text")))
    siblings = F.concat_ws("", F.transform("proof", lambda p: F.concat(p["before"], p["after"])))
    return sorted((tuple(r) for r in got.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256), "folded_root", "verified").collect()), key=key)


def test_odd_rows(spark):
    assert checked(clashing(frame(spark))) == sorted(plain(odd_rows()), key=key)
    assert checked(frame(spark, [])) == []
    one = [(7, "A lone Row", "en", None, 3)]
    assert checked(frame(spark, one)) == plain(one)
    text = [(i, f"Row {i} Á", None, "a", i) for i in (2, 2, 2, None, None)]
    assert checked(frame(spark, text)) == sorted(plain(text), key=key)


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, SF001)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)
    assert not all(r["verified"] for r in got.collect())


def test_many_groups_and_partitions_of_leaves(spark, monkeypatch):
    """Blocks of 8 leaves: several rounds, fetched coordinates with copies, and a top tree of three levels."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    rows = [(i, f"Text {i}", "big" if i % 3 else f"l{i % 240}", "s", i) for i in range(1, 1000)]
    assert checked(frame(spark, rows)) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 200])
def test_missing_is_sufficient_and_least(size):
    levels = plain_tree([sha(str(i)) for i in range(size)])
    for first in range(0, size, max(size // 7, 1)):
        for last in range(first, size, max(size // 5, 1)):
            need = merkle.missing(first, last, size, 8)
            fetched = {(level, i): levels[level][i] for level, i in need}
            steps = merkle.climb(first, levels[0][first:last + 1], size, 8, 64, fetched)
            assert steps[-1][1] == levels[-1]
            implied = {(level, i // 8 ** level) for i in range(first, last + 1) for level in range(len(levels))}
            assert not implied & set(need) and len(need) == len(set(need))

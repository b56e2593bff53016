"""Token counts of whole texts under a byte-level BPE vocabulary, by rank-synchronous array merging.

Pre-tokens of a batch lie in one flat symbol array with sequence offsets. In
each round every sequence finds its lowest-ranked adjacent pair
(``minimum.reduceat``) and merges all occurrences of it at once; sequences
without a rankable pair leave the array, and what is left of them is their
token count. Merging all occurrences of the lowest pair at once equals the
one-by-one procedure because a pair that holds a merged symbol always ranks
behind the merge that made the symbol.

The vocabulary file is read on the driver and its tables travel with the task
function (a few MB), so executors need no copy of it. There is no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, slices, texts

# The pre-token pattern of byte-level BPE vocabularies; results depend on it.
PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

NO_PAIR = np.iinfo(np.int32).max
#: Words whose counts a task remembers; the memory is emptied when it is full.
REMEMBERED = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such a vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class RankTable:
    """Merges of a vocabulary as sorted pair keys with rank and merged symbol."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.width = max(vocab.values()) + 1
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        end = spec["model"].get("end_of_word_suffix") or ""
        self.base_end = np.array([vocab[c + end] for c in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.of_bytes = self.rank(np.repeat(self.base, 256), np.tile(self.base, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR).astype(np.int32)


def merge_all(sym: np.ndarray, size: np.ndarray, rank: np.ndarray, table: RankTable,
              done: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Merge sequences of ``size`` symbols each until no pair has a rank.

    ``rank`` holds the rank of each symbol with the next. ``done`` gets the
    numbers, sizes and symbols of sequences as they finish.
    """
    live, size = np.arange(len(size)), np.asarray(size, np.int64).copy()
    starts = np.cumsum(size) - size
    rank[starts + size - 1] = NO_PAIR
    while len(live):
        least = np.minimum.reduceat(rank, starts)
        going = least < NO_PAIR
        if not going.all():
            inside = np.repeat(going, size)
            done(live[~going], size[~going], sym[~inside])
            sym, rank, live, size, least = sym[inside], rank[inside], live[going], size[going], least[going]
            if not len(live):
                break
        at = np.flatnonzero(rank == np.repeat(least, size))
        if len(at) > 1 and (np.diff(at) == 1).any():
            # equal symbols in a row: pairs overlap, every second one counts from the left
            opens = np.concatenate([[True], np.diff(at) != 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
        sym[at] = table.made[rank[at]]
        stays = np.ones(len(sym), bool)
        stays[at + 1] = False
        touched = np.zeros(len(sym), bool)
        touched[at] = True
        gone = np.add.reduceat((~stays).astype(np.int64), np.cumsum(size) - size)
        sym, touched, rank = sym[stays], touched[stays], rank[stays]
        size = size - gone
        starts = np.cumsum(size) - size
        again = touched.copy()
        again[:-1] |= touched[1:]
        again[starts + size - 1] = False
        i = np.flatnonzero(again)
        rank[i] = table.rank(sym[i], sym[i + 1])
        rank[starts + size - 1] = NO_PAIR


def merged_lengths(raw: bytes, lengths: np.ndarray, table: RankTable) -> np.ndarray:
    """Symbols left of each sequence (``lengths`` bytes of ``raw`` each, none empty) after all merges."""
    out = np.zeros(len(lengths), np.int64)
    given = np.frombuffer(raw, np.uint8)
    rank = np.full(len(given), NO_PAIR, np.int32)
    rank[:-1] = table.of_bytes[given[:-1].astype(np.int32) * 256 + given[1:]]

    def done(which: np.ndarray, size: np.ndarray, _: np.ndarray) -> None:
        out[which] = size

    merge_all(table.base[given], lengths, rank, table, done)
    return out


def merged_flat(given: np.ndarray, lengths: np.ndarray, table: RankTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all sequences in a row, and how many each has; the last byte of a sequence carries the word end."""
    if not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sym, ends = table.base[given], np.cumsum(lengths) - 1
    sym[ends] = table.base_end[given[ends]]
    rank = np.full(len(sym), NO_PAIR, np.int32)
    rank[:-1] = table.of_bytes[given[:-1].astype(np.int32) * 256 + given[1:]]
    last = ends[lengths > 1] - 1  # pairs whose right symbol carries the word end
    rank[last] = table.rank(sym[last], sym[last + 1])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    merge_all(sym, lengths, rank, table, lambda *part: found.append(part))
    which, size, left = (np.concatenate(x) for x in zip(*found))
    starts, order = np.cumsum(size) - size, np.argsort(which)
    starts, size = starts[order], size[order]
    return left[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(len(left))], size


class Counter:
    """Counts the tokens of texts; remembers the counts of words up to a fixed number.

    ``inner`` holds words that follow one space (the space is part of the
    pre-token), ``whole`` everything else.
    """

    def __init__(self, table: RankTable):
        import re
        import string

        import regex

        self.table, self.inner, self.whole = table, {}, {"": 0}
        self.pretokens = regex.compile(PRETOKEN).findall
        self.special = re.compile("|".join(map(re.escape, table.specials))) if table.specials else None
        self.odd = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S) ").split
        self.marks = string.punctuation.replace("'", "")

    def words(self, text: str) -> list[str]:
        """Parts that tokenize on their own: cut at each space that opens a run of white space."""
        return self.cut(text) if text[:1].isspace() or self.odd(text) else text.split(" ")

    def counts(self, many: list[str]) -> list[int]:
        extra, plan, heads, rest = [], [], set(), set()
        for text in many:
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            extra.append(len(parts) - 1)
            words = [self.words(p) for p in parts]
            plan.append(words)
            for w in words:
                heads.add(w[0])
                rest.update(w[1:])
        if len(self.inner) + len(rest) > REMEMBERED:
            self.inner, self.whole = {}, {"": 0}
        self.learn([w for w in heads if w not in self.whole], self.whole, "")
        self.learn([w for w in rest if w not in self.inner], self.inner, " ")
        inner, whole = self.inner.__getitem__, self.whole.__getitem__
        return [n + sum(whole(w[0]) + sum(map(inner, w[1:])) for w in words) for n, words in zip(extra, plan)]

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens; letters and the marks behind them need no pattern."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        stem = body.rstrip(self.marks)
        if stem.isalpha():
            return [chunk] if len(stem) == len(body) else [chunk[:len(chunk) - len(body) + len(stem)], body[len(stem):]]
        return self.pretokens(chunk)

    def learn(self, words: list[str], known: dict, lead: str, most: int = 100_000) -> None:
        for at in range(0, len(words), most):
            part = words[at:at + most]
            split = [self.split(lead + w) for w in part]
            pieces = list({p for s in split for p in s})
            if not pieces:
                known.update(dict.fromkeys(part, 0))
                continue
            raw = [p.encode("utf-8", "replace") for p in pieces]
            left = merged_lengths(b"".join(raw), np.fromiter(map(len, raw), np.int64, len(raw)), self.table)
            of = dict(zip(pieces, left.tolist())).__getitem__
            known.update((w, sum(map(of, s))) for w, s in zip(part, split))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row of ``docs``.

    ``vocabulary`` is a tokenizer file with a byte-level BPE model. Null and
    empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated
    rows are counted each; an empty table gives no rows; other columns of
    ``docs`` are left out, whatever their names. Special strings inside a text
    count as one token each. Texts of any length are counted whole.
    """
    with open(vocabulary, encoding="utf-8") as f:
        merges = RankTable(json.load(f))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in slices(batches, 1):
            many = texts(batch.column(1))
            n = counter.counts(many)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in many], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Best-fit packing of tokenized documents under several capacities at once.

Every piece is a vector (tokens, documents, attention cost); a sequence is a
bin with a capacity in each of the three. Pieces, longest first, go to the
open bin that takes them under every capacity and leaves the smallest weighted
residual norm (rule ``norm``), or has the largest weighted dot product of
piece and residual (rule ``dot``); a new bin opens where none takes them.

Pieces are spread by hash over packing groups of about ``group_rows`` rows, so
no task holds more than a few thousand pieces whatever the corpus size; a
group wastes a fraction of its last few bins. Only (doc_id, piece, length) is
shuffled, never text or token ids.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices
from repolens.llm.token_counts import RankTable, merged_flat

#: Words outside the plain ones whose ids a task remembers; the memory is emptied when it is full.
REMEMBERED = 100_000
LETTER, MARK = 1, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_kinds() -> np.ndarray:
    """LETTER for Latin letters, MARK for ASCII marks but the apostrophe, 0 for every other byte."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(string.ascii_letters.encode())] = LETTER
    kinds[list(string.punctuation.replace("'", "").encode())] = MARK
    return kinds


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column in a row, and the length of each."""
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]], np.diff(ends).astype(np.int64)


def from_flat(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def ranges(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each start, in a row."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, word by word.

    The vocabulary drops white space and no rule of it looks across white
    space, so a text's ids are those of its words in a row. The distinct words
    of a batch are encoded once. Plain words (Latin letters, then ASCII marks)
    are lower-cased and merged together, as arrays; the library does every
    other word.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.kinds = Tokenizer.from_str(spec), {}, byte_kinds()
        self.table = RankTable(json.loads(spec))
        self.marks = string.punctuation.replace("'", "")

    def by_library(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words or marks that the batches do not merge."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        for w in words:
            if w not in self.known:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4")
        return [self.known[w] for w in words]

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        data, size = flat_bytes(words)
        kind, filled = self.kinds[data], size > 0
        starts = (np.cumsum(size) - size)[filled]
        wrong = kind == 0
        wrong[1:] |= (kind[1:] == LETTER) & (kind[:-1] == MARK)  # a letter behind a mark of the same word
        wrong[starts] = kind[starts] != LETTER
        plain = np.zeros(len(size), bool)
        if len(starts):
            plain[filled] = np.add.reduceat(wrong, starts, dtype=np.int64) == 0
        other = np.flatnonzero(filled & ~plain)
        inside = np.repeat(plain, size)
        letters, marks = inside & (kind == LETTER), inside & (kind == MARK)
        sizes = np.zeros((2, len(size)), np.int64)
        if len(starts):
            sizes[:, filled] = [np.add.reduceat(x, starts, dtype=np.int64) for x in (letters, marks)]
        sizes = sizes[:, plain]

        stem_of, tail_of, whole = [], [], []  # words with letters beyond ASCII, and words for the library
        for i in other.tolist():
            word = words[i].as_buffer().to_pybytes().decode("utf-8", "replace")
            stem = word.rstrip(self.marks)
            # below U+0250 letters are composed and have a lower case of their own, but for the dotted capital I
            if stem.isalpha() and max(stem) < "\u0250" and "\u0130" not in stem:
                stem_of.append((i, stem.lower().encode()))
                tail_of.append(word[len(stem):].encode())
            else:
                whole.append((i, word))
        stemmed = np.concatenate([np.flatnonzero(plain), np.array([i for i, _ in stem_of], np.int64)])
        stems = pa.concat_arrays([from_flat(data[letters] | 32, sizes[0]), pa.array([x for _, x in stem_of], pa.binary())])
        tails = pa.concat_arrays([from_flat(data[marks], sizes[1]), pa.array(tail_of, pa.binary())])
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        parts = self.by_library([x.decode() for x in tails.dictionary.to_pylist()]) + self.by_library([w for _, w in whole])
        merged, merged_size = merged_flat(*flat_bytes(stems.dictionary), self.table)

        # every word is a stem and a tail, or a whole word and nothing
        pool = np.concatenate([merged, *parts])
        n = np.concatenate([merged_size, np.fromiter(map(len, parts), np.int64, len(parts))])
        at = np.cumsum(n) - n
        pair = np.full((len(size), 2), -1)
        pair[stemmed, 0] = stems.indices.to_numpy()
        pair[stemmed, 1] = len(merged_size) + tails.indices.to_numpy()
        pair[[i for i, _ in whole], 0] = np.arange(len(n) - len(whole), len(n))
        at, n = np.append(at, 0), np.append(n, 0)  # place -1: nothing
        return ranges(pool, at[pair].ravel(), n[pair].ravel()), n[pair].sum(axis=1)

    def encode(self, many: list[bytes]) -> list[bytes]:
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array(many, pa.binary()).view(pa.string()))
        coded = split.flatten().dictionary_encode()
        flat, size = self.learn(coded.dictionary)
        at, n = (np.cumsum(size) - size), size
        word = coded.indices.to_numpy()
        ids = ranges(flat, at[word], n[word]).astype("<u4").tobytes()
        ends = 4 * np.concatenate([[0], np.cumsum(n[word])])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def token_pieces(docs: DataFrame, vocabulary: str, most: int = 2048, closing_id: int = 0) -> DataFrame:
    """One row per piece: a document's ids and a closing id, cut where longer than ``most`` tokens.

    A null or empty text is the closing id alone.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = Encoder(spec.value), np.array([closing_id], "<u4").tobytes()
        for batch in slices(batches, 1, 8 << 20):  # words that come again are encoded once a batch
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(raw_texts(batch.column(1)))):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at:at + 4 * most]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECES)


def vector_best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of each item (rows of ``items``, in this order); no bin exceeds ``capacity`` in any column."""
    if (items > capacity).any():
        raise ValueError("an item exceeds a capacity")
    scale = weights / np.maximum(capacity, 1) ** 2
    bins = np.empty(len(items), np.int64)
    least = np.minimum.accumulate(items[::-1], axis=0)[::-1] if len(items) else items
    left = np.empty((256, items.shape[1]))
    name = np.empty(256, np.int64)
    n_open = n_bins = 0
    for i, item in enumerate(items):
        if i % 64 == 0 and n_open:
            useful = np.flatnonzero((left[:n_open] >= least[i]).all(axis=1))  # others take nothing that is still to come
            left[:len(useful)], name[:len(useful)], n_open = left[useful], name[useful], len(useful)
        room = left[:n_open]
        after = room - item
        fits = (after >= 0).all(axis=1)
        if fits.any():
            cost = (after * after) @ scale if rule == "norm" else -(room @ (item * scale))
            best = int(np.argmin(np.where(fits, cost, np.inf)))
            left[best] = after[best]
        else:
            if n_open == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            best = n_open
            left[best], name[best] = capacity - item, n_bins
            n_open += 1
            n_bins += 1
        bins[i] = name[best]
    return bins


def pack(docs: DataFrame, vocabulary: str, most: int = 2048, max_documents: int | None = None,
         max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
         rule: str = "norm", group_rows: int = 8192) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``.

    A sequence holds at most ``most`` tokens, ``max_documents`` pieces and an
    attention cost (sum of squared piece lengths) of ``max_cost``; the defaults
    of the last two never bind before the first. Offsets are gapless from 0.

    Null and empty texts are one piece of one token. Null doc_ids and repeated
    rows are packed like any other row. An empty table gives no rows. Other
    columns of ``docs`` are left out. Texts of any length are cut, never
    shortened. Ties go to the bin opened first.
    """
    pieces = token_pieces(docs, vocabulary, most).checkpoint(eager=True)
    groups = max(1, -(-pieces.count() // group_rows))
    capacity = np.array([most, max_documents or most, max_cost or most * most], float)
    weight = np.array(weights, float)

    def place(table: pa.Table) -> pa.Table:
        p = table.to_pandas().sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable",
                                          ascending=[False, True, True, True])
        length = p["length"].to_numpy()
        bins = vector_best_fit(np.stack([length, np.ones_like(length), length * length], 1).astype(float),
                               capacity, weight, rule)
        p["sequence_id"] = (p["grp"].to_numpy().astype(np.int64) << 24) + bins
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        opens = np.concatenate([[True], np.diff(bins[order]) != 0])
        offset = np.empty(len(p), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(opens, before, 0))
        p["offset"] = offset
        return pa.table({n: pa.array(p[n], t, from_pandas=True) for n, t in (
            ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))})

    spread = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return spread.groupBy("grp").applyInArrow(place, PIECES + ", sequence_id long, offset long")

"""Removal of word windows that also start in an earlier document, behind a distributed count-min prefilter.

1. Documents are packed once into chunks (words joined by one space,
   compressed) and checkpointed, so that all passes see the same chunks.
2. Every chunk sketches its windows: ``ROWS`` hash rows, whose width is the
   number of text bytes, so the load of a cell is the same at every size. A
   partition sketch is stored as the sorted cells it touches, cut into blocks
   of ``BLOCK`` cells. One task per block adds the sketches of all chunks
   (counters stop at 2) and tells each chunk which of its cells reached 2.
3. The second pass reads every chunk again. Only windows all of whose cells
   reached 2 are looked at: an estimate is never below the true count, so no
   repeated window is lost. They are grouped exactly, by the 128-bit BLAKE2b
   digest of their words; a digest is sent once per chunk with the least doc_id
   there, and the answer is one bit: whether a smaller doc_id holds it elsewhere.
4. The last pass repeats the second one and removes the covered words.

The merged sketch is never in one place, nor broadcast: its size grows with
the corpus. A window that stands in a third of all documents is sent at most
once per chunk. Groups are blocks and digest ranges, whose number grows with
the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices

#: Text bytes of a chunk (a longer text is a chunk of its own).
CHUNK = 16 << 20
#: Text bytes hashed at a time (documents stay whole).
STEP = 1 << 20
#: Hash rows of the sketch, and cells of a block.
ROWS, BLOCK = 2, 1 << 24
#: Text bytes for each range of digests.
RANGE = 16 << 20

BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_bytes = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            many = np.full(n, base, np.uint64)
            many[0] = 1
            _powers[i] = np.cumprod(many, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64((salt * BASE) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def ranges_hashed(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of values[start:end] for each range."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


class Words:
    """Words of documents joined by line feeds, and their windows of ``length`` words (never across documents)."""

    def __init__(self, data: bytes, length: int):
        given = np.frombuffer(data, np.uint8)
        gap = (given == 32) | (given == 10)
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        self.data, self.length = data, length
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(np.flatnonzero(given == 10), self.start)
        self.first = np.flatnonzero(self.doc[:-length + 1 or None] == self.doc[length - 1:]) if len(self.doc) >= length else np.zeros(0, np.int64)
        self.given = given

    def hashes(self) -> np.ndarray:
        words = ranges_hashed(_bytes[self.given], self.start, self.end)
        return ranges_hashed(words, self.first, self.first + self.length)

    def digests(self, which: np.ndarray) -> list[bytes]:
        data, blake = self.data, hashlib.blake2b
        first = self.first[which]
        return [blake(data[s:e], digest_size=16).digest()
                for s, e in zip(self.start[first].tolist(), self.end[first + self.length - 1].tolist())]


def steps(documents: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
    """(first document, joined documents, number) in parts of about ``STEP`` bytes."""
    begin = size = 0
    for i, x in enumerate(documents):
        if size and size + len(x) > STEP:
            yield begin, b"\n".join(documents[begin:i]), i - begin
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(documents):
        yield begin, b"\n".join(documents[begin:]), len(documents) - begin


def coded(cells: np.ndarray) -> bytes:
    """Rising integers as steps of one or two bytes; the greatest step value means that the step goes on."""
    gaps = np.diff(cells, prepend=0)
    kind = np.uint8 if cells[-1] < 160 * len(cells) else np.uint16
    top = np.iinfo(kind).max
    more = gaps // top
    out = np.full(len(gaps) + int(more.sum()), top, kind)
    out[np.cumsum(more + 1) - 1] = gaps % top
    return bytes([out.itemsize]) + out.tobytes()


def decoded(blob: bytes) -> np.ndarray:
    kind = np.uint8 if blob[0] == 1 else np.uint16
    steps_ = np.frombuffer(blob, kind, offset=1)
    return np.cumsum(steps_, dtype=np.int64)[steps_ < np.iinfo(kind).max]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for number, batch in enumerate(slices(batches, 1, CHUNK)):
        data = squeeze.compress(b"\n".join(b" ".join(x.split()) for x in raw_texts(batch.column(1))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([(TaskContext.get().partitionId() << 32) | number], pa.int64()),
             pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            names=["chunk", "ids", "data"])


def _documents(chunk: pa.Table) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(chunk["data"][0].as_py()).split(b"\n")


class Plan:
    """Sizes that follow from the number of text bytes."""

    def __init__(self, total: int, length: int):
        self.length, self.width = length, max(total, 1)
        self.blocks, self.ranges = -(-self.width // BLOCK), -(-self.width // RANGE)
        self.block = BLOCK

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (mixed(hashes, row + 1) % np.uint64(self.width)).astype(np.int64)

    def sketch(self, chunk: pa.Table) -> pa.Table:
        """The partition sketch of a chunk: touched cells per block, a cell that is touched again twice."""
        hashes = np.concatenate([Words(data, self.length).hashes() for _, data, _ in steps(_documents(chunk))])
        keys, blobs = [], []
        for row in range(ROWS):
            cells = np.sort(self.cells(hashes, row))
            third = np.zeros(len(cells), bool)
            third[2:] = cells[2:] == cells[:-2]
            cells = cells[~third]
            cuts = np.searchsorted(cells, np.arange(self.blocks + 1) * self.block)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                keys.append(row * self.blocks + i)
                blobs.append(coded(cells[cuts[i]:cuts[i + 1]] - i * self.block))
        n = len(keys)
        return pa.table({"block": pa.array(keys, pa.int64()), "chunk": pa.array([chunk["chunk"][0].as_py()] * n, pa.int64()),
                         "data": pa.array(blobs, pa.binary())})

    def merge(self, sketches: pa.Table) -> pa.Table:
        """Adds the sketches of one block; the cells of each chunk whose sum is 2 or more."""
        counters = np.zeros(self.block, np.uint8)
        for blob in sketches["data"]:
            cells = decoded(blob.as_py())
            twice = cells[1:][cells[1:] == cells[:-1]]
            counters[cells] = np.minimum(counters[cells] + 1, 2)
            counters[twice] = 2
        chunks, blobs = [], []
        for chunk, blob in zip(sketches["chunk"].to_pylist(), sketches["data"]):
            cells = decoded(blob.as_py())
            cells = cells[counters[cells] > 1]
            if len(cells):
                chunks.append(chunk)
                blobs.append(coded(cells))
        n = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "kind": pa.array([0] * n, pa.int32()),
                         "number": pa.array([sketches["block"][0].as_py()] * n, pa.int64()), "data": pa.array(blobs, pa.binary())})

    def candidates(self, documents: list[bytes], answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest, document and first word in its part of every window whose estimate is 2 or more."""
        tests = []
        rows = sorted((n, d) for k, n, d in zip(*(answers[c].to_pylist() for c in ("kind", "number", "data"))) if k == 0)
        for row in range(ROWS):
            own = [decoded(d) + n % self.blocks * self.block for n, d in rows if n // self.blocks == row]
            cells = np.concatenate(own) if own else np.zeros(0, np.int64)
            quick = np.zeros(1 << 24, bool)
            quick[cells & (len(quick) - 1)] = True
            tests.append((cells, quick))
        found, docs, places = [], [], []
        for begin, data, _ in steps(documents):
            words = Words(data, self.length)
            hashes = words.hashes()
            left = np.arange(len(hashes))
            for row, (cells, quick) in enumerate(tests):
                mine = self.cells(hashes[left], row)
                near = quick[mine & (len(quick) - 1)]
                left, mine = left[near], mine[near]
                at = np.minimum(np.searchsorted(cells, mine), max(len(cells) - 1, 0))
                left = left[cells[at] == mine] if len(cells) else left[:0]
            found += words.digests(left)
            docs.append(words.doc[words.first[left]] + begin)
            places.append(words.first[left])
        names = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64)
        return names, np.concatenate(docs), np.concatenate(places)

    def least(self, names: np.ndarray, docs: np.ndarray, ids: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Distinct digests by range and owner, the number of each window's digest, and the least doc_id per digest."""
        ranks = {v: i for i, v in enumerate(sorted(set(ids), key=lambda v: (v is not None, v or 0)))}
        rank = np.array([ranks[v] for v in ids], np.int64)[docs]
        order = np.lexsort((rank, names[:, 1], names[:, 0]))
        opens = np.ones(len(order), bool)
        opens[1:] = (names[order[1:]] != names[order[:-1]]).any(1)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(opens) - 1
        heads = order[opens]
        # by range, then by owner: doc_ids are sent once per run
        sent = np.lexsort((rank[heads], names[heads, 0] % np.uint64(self.ranges)))
        back = np.empty(len(sent), np.int64)
        back[sent] = np.arange(len(sent))
        return heads[sent], back[of] if len(of) else of, rank

    def offer(self, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """Each candidate digest of a chunk once, by range, with the least doc_id of the chunk that holds it."""
        ids = chunk["ids"][0].as_py()
        names, docs, _ = self.candidates(_documents(chunk), answers)
        heads, _, _ = self.least(names, docs, ids)
        ranges = (names[heads, 0] % np.uint64(self.ranges)).astype(np.int64)
        out = {"range": [], "chunk": [], "names": [], "owners": [], "times": []}
        cuts = np.searchsorted(ranges, np.arange(self.ranges + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part = heads[cuts[i]:cuts[i + 1]]
            runs = np.flatnonzero(np.concatenate([[True], np.diff(docs[part]) != 0]))
            out["range"].append(i)
            out["chunk"].append(chunk["chunk"][0].as_py())
            out["names"].append(names[part].tobytes())
            out["owners"].append([ids[d] for d in docs[part][runs].tolist()])
            out["times"].append(np.diff(np.append(runs, len(part))).tolist())
        return pa.table(out, schema=pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()),
                                               ("owners", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))

    @staticmethod
    def match(offers: pa.Table) -> pa.Table:
        """Exact groups of one range: per offered digest one bit, whether another chunk holds it under a smaller doc_id."""
        blobs = [x.as_py() for x in offers["names"]]
        names = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
        owners = [v for x in offers["owners"].to_pylist() for v in x]
        times = np.array([v for x in offers["times"].to_pylist() for v in x], np.int64)
        some = np.repeat(np.array([v is not None for v in owners], bool), times)
        owner = np.repeat(np.array([v or 0 for v in owners], np.int64), times)
        order = np.lexsort((owner, some, names[:, 1], names[:, 0]))
        opens = np.ones(len(order), bool)
        opens[1:] = (names[order[1:]] != names[order[:-1]]).any(1)
        head = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
        smaller = np.zeros(len(order), bool)
        smaller[order] = (owner[order] != owner[head]) | (some[order] != some[head])
        n, cuts = len(blobs), np.cumsum([len(b) // 16 for b in blobs])
        bits = [np.packbits(x).tobytes() for x in np.split(smaller, cuts[:-1])]
        return pa.table({"chunk": offers["chunk"], "kind": pa.array([1] * n, pa.int32()),
                         "number": offers["range"], "data": pa.array(bits, pa.binary())})

    def remove(self, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of a chunk without the words of windows that a smaller doc_id holds."""
        ids, documents = chunk["ids"][0].as_py(), _documents(chunk)
        names, docs, places = self.candidates(documents, answers)
        heads, of, rank = self.least(names, docs, ids)
        said = sorted((n, d) for k, n, d in zip(*(answers[c].to_pylist() for c in ("kind", "number", "data"))) if k == 1)
        ranges = (names[heads, 0] % np.uint64(self.ranges)).astype(np.int64)
        cuts = np.searchsorted(ranges, np.arange(self.ranges + 1))
        smaller = np.zeros(len(heads), bool)
        for i, bits in said:
            n = int(cuts[i + 1] - cuts[i])
            smaller[cuts[i]:cuts[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        goes = smaller[of] | (rank > rank[heads][of])
        docs, places = docs[goes], places[goes]
        n_words, n_removed, kept = [], [], []
        for begin, data, n in steps(documents):
            words = Words(data, self.length)
            here = places[(docs >= begin) & (docs < begin + n)]
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, here, 1)
            np.add.at(cover, here + self.length, -1)
            stays = np.cumsum(cover)[:-1] == 0
            total = np.bincount(words.doc, minlength=n)
            left = np.bincount(words.doc[stays], minlength=n)
            n_words += total.tolist()
            n_removed += (total - left).tolist()
            for text, first, last, k, m in zip(data.split(b"\n"), (np.cumsum(total) - total).tolist(), np.cumsum(total).tolist(),
                                               total.tolist(), left.tolist()):
                kept.append(text if m == k else b" ".join(w for w, s in zip(text.split(b" "), stays[first:last].tolist()) if s))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "text": pa.array(kept, pa.binary()).cast(pa.string())})


def drop_copied_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, joined by one space) of every row of ``docs``.

    A word goes if a window of ``length`` words that covers it has the same
    words as one that starts in a row with a smaller doc_id; windows are judged
    on the input. Words are runs of anything but ASCII white space. Null and
    empty texts have no words and an empty text. A null doc_id is smaller than
    all others; rows that share a doc_id (null included) say nothing of each
    other. An empty table gives no rows; other columns are left out, whatever
    their names. Texts of any length are read whole; the memory of a task grows
    with ``CHUNK`` or the longest text.
    """
    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    plan = Plan(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0, length)
    chunks = (source.mapInArrow(_packed, "chunk long, ids array<long>, data binary")
              .checkpoint(eager=True))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from plan.sketch(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    cells = chunks.mapInArrow(sketches, "block long, chunk long, data binary")
    answers = "chunk long, kind int, number long, data binary"
    repeated = cells.groupBy("block").applyInArrow(lambda part: plan.merge(part), answers).withColumnRenamed("chunk", "of").checkpoint(eager=True)
    offers = chunks.groupBy("chunk").cogroup(repeated.groupBy("of")).applyInArrow(
        lambda chunk, said: plan.offer(chunk, said),
        "range long, chunk long, names binary, owners array<long>, times array<int>")
    matched = offers.groupBy("range").applyInArrow(lambda part: plan.match(part), answers).withColumnRenamed("chunk", "of")
    return chunks.groupBy("chunk").cogroup(repeated.unionByName(matched).groupBy("of")).applyInArrow(
        lambda chunk, said: plan.remove(chunk, said), "doc_id long, n_words long, n_removed long, text string")


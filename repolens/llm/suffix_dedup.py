"""Removal of repeated byte strings by hashed candidate matching on a difference-cover sample.

No suffix is ranked and no suffixes are merged: 64-bit names of hashed bytes
decide (128-bit digests for hot names); the bytes themselves are not compared.

A difference cover modulo v is a set of residues such that for any two
positions i and j some shift d < v puts both i + d and j + d on residues of
the cover. So two equal strings of ``length`` bytes, wherever they start, hold
the same ``length - v + 1`` bytes at two sampled positions.

1. Sort the sample: blocks at sampled positions get 64-bit names, names are
   dealt by value and sorted; equal neighbours mark positions that may lie in
   a repeat. Names that stand alone are done.
2. Narrow the candidates: starts of which no sampled position within v has a
   repeated name cannot open a repeat. The remaining starts of a document are
   cut into runs that share their least inner block name, so equal strings
   meet under one name however they are placed.
3. Match the remaining windows: runs are dealt by that name; inside a task,
   windows of ``length`` bytes are named, and windows with equal names are
   repeats.
4. Removed bytes are the union of the repeats, put together per document.

Sampled names travel packed, a few thousand to a row; names met twice in one
batch are settled there and sent once, which also thins out hot strings. A
name with more than ``hot_runs`` runs has its windows dealt one by one. Texts
travel compressed and only once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, raw_texts, slices

MULTIPLIER = 0x9E3779B97F4A7C15
NO_ID = -(2 ** 63)


def difference_cover(q: int) -> tuple[int, list[int]]:
    """v = q * q + q + 1 and a perfect difference set of q + 1 residues, for a prime q.

    Powers of a root of a cubic over the field of q elements that lie in a
    plane: every difference modulo v occurs exactly once.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                power, found = (0, 0, 1), []
                for i in range(v):
                    if power[0] == 0:
                        found.append(i)
                    high, mid, low = power
                    power = ((mid + a * high) % q, (low + b * high) % q, c * high % q)
                    if len(found) > q + 1:
                        break
                if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
                    return v, found
    raise ValueError(f"no cover for {q}")


class Names:
    """64-bit names of windows of a byte string: a rolling polynomial over random byte values, mixed."""

    def __init__(self, seed: int = 9):
        self.values = np.random.default_rng(seed).integers(1, 2 ** 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, factor in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 2 ** 64))):
                p = np.full(n, np.uint64(factor))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def windows(self, data: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
        """Names of data[i:i + width] for i in ``at`` (increasing; all places if None)."""
        n = len(data)
        self.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        if at is None:
            found = (sums[width:] - sums[:n + 1 - width]) * self.down[:n + 1 - width]
        else:
            found = (sums[at + width] - sums[at]) * self.down[at]
        return mixed(found)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs more than once."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(values) - width + 1
    pad = -len(values) % width
    top = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(top[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(top, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1:width - 1 + n])


def joined_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as disjoint, sorted ranges that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[opens], reach[np.concatenate([opens[1:], [True]])]


class Sample:
    """Sampled positions of texts and their names, in parts of bounded size."""

    def __init__(self, length: int, q: int):
        self.v, residues = difference_cover(q)
        self.width, self.length, self.names = length - self.v + 1, length, Names()
        if self.width < 16:
            raise ValueError("the strings are too short for this cover")
        self.residues = np.array(residues, np.int64)

    def of(self, raw: bytes, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names; nothing for texts under the length."""
        last = len(raw) - self.width
        if len(raw) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = (np.arange(0, last + 1, self.v)[:, None] + self.residues).ravel()
        at = at[at <= last]
        data, found = np.frombuffer(raw, np.uint8), []
        for low in range(0, last + 1, part):
            inside = at[(at >= low) & (at < low + part)]
            if len(inside):
                found.append(self.names.windows(data[low:low + part + self.width], self.width, inside - low))
        return at, np.concatenate(found)


def repeated_samples(docs: DataFrame, length: int, q: int, buckets: int, batch_names: int = 1 << 20) -> DataFrame:
    """id, places: sampled positions (packed 32-bit) of documents whose name occurs more than once in the corpus."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, held, size = Sample(length, q), [], 0
        for batch in slices(batches, 1, 4 << 20):
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                at, names = sample.of(raw)
                if len(at):
                    held.append((doc_id, at, names))
                    size += len(at)
            if size >= batch_names:
                yield dealt(held)
                held, size = [], 0
        if held:
            yield dealt(held)

    def dealt(held: list) -> pa.RecordBatch:
        names = np.concatenate([n for _, _, n in held])
        places = np.concatenate([p for _, p, _ in held]).astype(np.uint32)
        ids = np.repeat(np.array([i for i, _, _ in held], np.int64), [len(p) for _, p, _ in held])
        bucket = (names >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((names, bucket))
        names, places, ids, bucket = names[order], places[order], ids[order], bucket[order]
        same = np.concatenate([[False], names[1:] == names[:-1]])
        twice = same | np.concatenate([same[1:], [False]])
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows: list[list] = [[], [], [], [], [], []]
        for b in range(buckets):
            s = slice(cuts[b], cuts[b + 1])
            if s.start == s.stop:
                continue
            once, known = ~same[s], twice[s]
            # the first of several equal names goes on; all of them are known to repeat
            by_id = np.argsort(ids[s][once], kind="stable")
            for column, value in zip(rows, (
                    b, five_bytes(names[s][once][by_id]), planes(ids[s][once][by_id].view(np.uint64), 8),
                    planes(places[s][once][by_id].astype(np.uint64), 4),
                    planes(ids[s][known].view(np.uint64), 8), planes(places[s][known].astype(np.uint64), 4))):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]],
            names=["bucket", "names", "ids", "places", "known_ids", "known_places"])

    def sort(table: pa.Table) -> pa.Table:
        def column(name: str, width: int) -> np.ndarray:
            return np.concatenate([unplaned(x, width) for x in table.column(name).to_pylist()])

        twice = repeated(column("names", 5))
        ids = np.concatenate([column("ids", 8)[twice], column("known_ids", 8)]).view(np.int64)
        places = np.concatenate([column("places", 4)[twice], column("known_places", 4)]).astype(np.uint32)
        order = np.argsort(ids, kind="stable")
        ids, places = ids[order], places[order]
        opens = np.flatnonzero(np.concatenate([np.ones(min(len(ids), 1), bool), np.diff(ids) != 0]))
        parts = np.split(places, opens[1:]) if len(ids) else []
        return pa.table({"id": pa.array(ids[opens], pa.int64()),
                         "places": pa.array([p.tobytes() for p in parts], pa.binary())})

    packed = docs.mapInArrow(deal, "bucket int, names binary, ids binary, places binary, known_ids binary, "
                                   "known_places binary")
    return packed.groupBy("bucket").applyInArrow(sort, "id long, places binary")


def planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of 64-bit values, byte by byte in planes, so that constant high bytes compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def five_bytes(names: np.ndarray) -> bytes:
    return planes(names, 5)


def unplaned(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


class Runs:
    """Candidate starts of a document, cut into runs that share their least inner block name."""

    def __init__(self, length: int, v: int, inner: int = 32, most: int = 2048):
        self.length, self.v, self.inner, self.most, self.names = length, v, inner, most, Names(11)

    def of(self, raw: bytes, places: np.ndarray) -> list[tuple[int, int, int]]:
        """(first start, number of starts, least name) of each run; ``places``: sampled positions that may repeat."""
        last = len(raw) - self.length
        low, high = joined_ranges(np.maximum(places - self.v + 1, 0), np.minimum(places, last) + 1)
        data, out = np.frombuffer(raw, np.uint8), []
        for a, b in zip(low.tolist(), high.tolist()):
            for at in range(a, b, 1 << 18):
                n = min(b - at, 1 << 18)
                blocks = self.names.windows(data[at:at + n + self.length - 1], self.inner)
                least = sliding_least(blocks, self.length - self.inner + 1)
                opens = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                for i, j in zip(opens.tolist(), [*opens[1:].tolist(), n]):
                    for k in range(i, j, self.most):
                        out.append((at + k, min(j - k, self.most), int(least[i].view(np.int64))))
        return out


def repeated_spans(docs: DataFrame, length: int, q: int = 17, buckets: int = 1024, hot_runs: int = 20_000) -> tuple:
    """(candidates, spans): rows of documents that may hold repeats, and their repeated starts per run."""
    v, _ = difference_cover(q)
    places = repeated_samples(docs.select("id", "text"), length, q, buckets).groupBy("id").agg(
        F.collect_list("places").alias("places"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            raws = raw_texts(batch.column(1))
            long = [i for i, raw in enumerate(raws) if len(raw) >= length]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(long, pa.int64())),
                 pa.array([zlib.compress(raws[i], 1) for i in long], pa.binary())], names=["id", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(length, v)
        for batch in batches:
            keys, tags, packs, found = [], [], [], []
            for doc_id, pack, lists in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = zlib.decompress(pack)
                at = np.unique(np.frombuffer(b"".join(lists), np.uint32).astype(np.int64))
                parts = runs.of(raw, at[at <= len(raw) - (length - v + 1)])
                if parts:
                    keys.append(doc_id)
                    tags.append(hashlib.blake2b(raw, digest_size=16).digest())
                    packs.append(pack)
                    found.append([{"start": s, "n": n, "least": m,
                                   "same": hashlib.blake2b(raw[s:s + n + length - 1], digest_size=16).digest()}
                                  for s, n, m in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(tags, pa.binary()), pa.array(packs, pa.binary()),
                 pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("least", pa.int64()),
                                                     ("same", pa.binary())])))], names=["id", "tag", "packed", "runs"])

    schema = "id long, tag binary, packed binary, runs array<struct<start: int, n: int, least: bigint, same: binary>>"
    packed = docs.select("id", "text").mapInArrow(shrink, "id long, packed binary")
    candidates = packed.join(places, "id").select("id", "packed", "places").mapInArrow(cut, schema).checkpoint(eager=True)
    runs = candidates.select("id", "tag", F.explode("runs").alias("run")).select("id", "tag", "run.*")
    hot = (runs.groupBy("least", "same").agg(F.lit(1).alias("one")).groupBy("least").count()
           .filter(F.col("count") > hot_runs).select("least"))

    def texts_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 4 << 20):
            seen: dict[tuple, list] = {}
            for pack, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(pack)
                for r in parts:
                    entry = seen.setdefault((r["least"], r["same"]), [raw[r["start"]:r["start"] + r["n"] + length - 1], 0])
                    entry[1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.binary()),
                 pa.array([e[0] for e in seen.values()], pa.binary()),
                 pa.array([min(e[1], 2) for e in seen.values()], pa.int32())], names=["least", "same", "bytes", "times"])

    bodies = candidates.select("packed", "runs").mapInArrow(
        texts_of_runs, "least long, same binary, bytes binary, times int")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = Names(13), [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > 2 << 20 and row[0] != held[-1][0]:
                    yield merged(names, held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield merged(names, held)

    def merged(names: Names, held: list) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[2] for r in held), np.uint8)
        sizes = np.array([len(r[2]) for r in held])
        starts, n = np.cumsum(sizes) - sizes, sizes - length + 1
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(np.array([r[0] for r in held], np.int64).view(np.uint64), n)
        twice = repeated(names.windows(data, length, at) ^ mixed(key)) | np.repeat(np.array([r[3] for r in held]) > 1, n)
        return found_starts([r[1] for r in held], twice, n)

    def found_starts(same: list, twice: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Ranges of repeated starts per run, as packed pairs."""
        keys, ranges = [], []
        for digest, part in zip(same, np.split(twice, np.cumsum(n)[:-1])):
            if part.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                keys.append(digest)
                ranges.append(edge.astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ranges, pa.binary())],
                                          names=["same", "ranges"])

    cold = bodies.join(hot, "least", "left_anti").repartition("least").sortWithinPartitions("least", "same")
    starts = cold.mapInArrow(merge, "same binary, ranges binary")
    if not hot.isEmpty():  # names with very many runs: their windows are dealt one by one, by content
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2, 1 << 18):
                same, offset, content, times = [], [], [], []
                for _, digest, body, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    for i in range(len(body) - length + 1):
                        same.append(digest)
                        offset.append(i)
                        content.append(hashlib.blake2b(body[i:i + length], digest_size=16).digest())
                        times.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same, pa.binary()), pa.array(offset, pa.int32()), pa.array(content, pa.binary()),
                     pa.array(times, pa.int32())], names=["same", "offset", "content", "times"])

        every = bodies.join(hot, "least", "left_semi").mapInArrow(
            windows, "same binary, offset int, content binary, times int")
        # one row per run and window: copies of a run in other batches count by their times
        once = every.groupBy("content", "same", "offset").agg(F.sum("times").alias("times"))
        twice = once.groupBy("content").agg(F.sum("times").alias("times")).filter("times > 1").select("content")
        pair = F.col("offset").cast("int")
        starts = starts.unionByName(once.join(twice, "content").select("same", F.unhex(F.concat(
            little(pair), little(pair + 1))).alias("ranges")))
    spans = (runs.join(starts.groupBy("same").agg(F.collect_set("ranges").alias("ranges")), "same")
             .select("id", "tag", "start", "ranges"))
    return candidates.select("id", "tag", "packed"), spans


def little(c: F.Column) -> F.Column:
    """Eight hex digits of a 32-bit integer, least byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(c, s).bitwiseAND(255)), 2, "0") for s in (0, 8, 16, 24)])


def drop_repeats(docs: DataFrame, length: int = 400, q: int = 17, buckets: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also
    starts anywhere else in the corpus, the same document included, judged on
    the input; n_spans counts maximal removed runs, kept_sha256 is of the
    remaining bytes. Null and empty texts, and texts under ``length`` bytes,
    lose nothing. Null doc_ids are documents like others. Repeated rows are
    copies of each other and lose all bytes if long enough. An empty table
    gives no rows. Other columns are left out. Texts are read whole; matches
    never cross documents.
    """
    source = picked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    candidates, spans = repeated_spans(source, length, q, buckets)
    found = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "ranges")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, tag, pack, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = zlib.decompress(pack)
                pairs = [np.frombuffer(r, np.int32).reshape(-1, 2).astype(np.int64) + p["start"]
                         for p in parts for r in p["ranges"]]
                pairs = np.concatenate(pairs)
                low, high = joined_ranges(pairs[:, 0], pairs[:, 1] - 1 + length)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(low.tolist(), high.tolist()):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for column, value in zip(out, (doc_id, tag, int((high - low).sum()), len(low), kept.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                names=["id", "tag", "n_removed", "n_spans", "kept"])

    changed = (candidates.dropDuplicates(["id", "tag"]).join(found, ["id", "tag"]).select("id", "tag", "packed", "spans")
               .mapInArrow(remove, "id long, tag binary, n_removed long, n_spans long, kept string"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            raws = raw_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(r) for r in raws], pa.int64()),
                 pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raws], pa.binary()),
                 pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())],
                names=["doc_id", "id", "n_bytes", "tag", "sha"])

    every = source.mapInArrow(whole, "doc_id long, id long, n_bytes long, tag binary, sha string")
    return every.join(changed, ["id", "tag"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))

"""Alignment of two tokenizers over whole texts, by divide and conquer at shared cuts, with corpus-wide link counts.

Both token sequences of a text cover the same bytes. A byte offset where a
token of either ends is a shared cut. An interval between two shared cuts is
halved at the shared cut nearest its middle, which a bisect of one side's ends
in the other's finds; both halves go on. An interval without an inner shared
cut is a leaf group. All intervals of a chunk of documents take a step at once
in numpy, so the number of steps is logarithmic in the length of a text.

Counting links over the corpus takes one pass over the texts:

1. a chunk (about ``CHUNK`` bytes of text) emits its distinct id pairs with the
   number of its documents that hold them, and per document the places of its
   pairs in that list, as compressed integers; both are checkpointed;
2. pairs are summed over chunks, the highest count per A id is kept (no more
   rows than the vocabulary has ids, so it may be broadcast);
3. each chunk gets the counts of its own pairs back, once each, and sums them
   per document. A pair stands at most once per chunk, so no key is hot.

Nothing but integers is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, slices, texts
from repolens.llm.token_counts import byte_symbols

#: Bytes of text in a chunk (a longer text is a chunk of its own).
CHUNK = 16 << 20
#: Bytes of text that are tokenized at a time.
STEP = 2 << 20
#: Tokens of remembered parts of texts.
REMEMBERED = 2_000_000
#: Groups with more links than this are reduced to distinct ids before their pairs are formed.
WIDE = 256


class ByteTokens:
    """Ids and bytes of a byte-level BPE vocabulary, special strings taken as text.

    Where the merges are in the order of the ids they make, the ranks of the
    vocabulary go to tiktoken; else the tokenizers library reads the file.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        import public_tokenizers
        import tiktoken

        model = json.loads(spec)
        vocab, special = model["model"]["vocab"], {t["content"] for t in model.get("added_tokens", [])}
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(byte[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made == sorted(made) and (not made or made[0] >= 256):
            ranks = {self.bytes[i]: i for token, i in vocab.items() if token not in special}
            coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = coder.encode_ordinary
        else:
            library = Tokenizer.from_str(spec)
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [bytes([int(p[3:5], 16)]) if coder.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, coder.id_to_piece(i)) for i in range(coder.get_piece_size()))]
        self.encode = lambda many: coder.encode(many, num_threads=1)


def shared_groups(ends_a: np.ndarray, ends_b: np.ndarray, tokens_a: np.ndarray, tokens_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A token and first B token of every leaf group, in order.

    ``ends_a`` and ``ends_b`` are rising byte ends over several texts laid end
    to end; ``tokens_a`` and ``tokens_b`` hold the tokens of each text (none is 0).
    """
    a1, b1 = np.cumsum(tokens_a), np.cumsum(tokens_b)
    a0, b0 = a1 - tokens_a, b1 - tokens_b
    reach = np.zeros(len(a0), np.int64)
    found_a, found_b = [], []
    while len(a0):
        # one token on a side, or nothing but what was probed: no cut inside
        closed = (a1 - a0 < 2) | (b1 - b0 < 2)
        middle = (a0 + a1 - 2) // 2
        closed |= (reach > 0) & (middle - reach // 2 <= a0) & (middle + reach // 2 >= a1 - 2)
        if closed.any():
            found_a.append(a0[closed])
            found_b.append(b0[closed])
            a0, a1, b0, b1, reach, middle = (x[~closed] for x in (a0, a1, b0, b1, reach, middle))
            if not len(a0):
                break
        low, high = np.maximum(middle - reach, a0), np.minimum(middle + reach, a1 - 2)
        width = high - low + 1
        first = np.cumsum(width) - width
        probe = np.arange(int(width.sum())) + np.repeat(low - first, width)
        value = ends_a[probe]
        at = np.searchsorted(ends_b, value)
        far = np.abs(probe - np.repeat(middle, width)) * 2 + (probe > np.repeat(middle, width))
        far[ends_b[at] != value] = np.iinfo(np.int64).max
        best = np.minimum.reduceat(far, first)
        hit = best < np.iinfo(np.int64).max
        cut = np.where(best & 1, middle + (best >> 1), middle - (best >> 1))[hit]
        cut_a, cut_b = cut + 1, at[cut - low[hit] + first[hit]] + 1
        miss = ~hit
        none = np.zeros(len(cut_a), np.int64)
        a0, a1, b0, b1, reach = (np.concatenate(x) for x in (
            (a0[hit], cut_a, a0[miss]), (cut_a, a1[hit], a1[miss]), (b0[hit], cut_b, b0[miss]), (cut_b, b1[hit], b1[miss]),
            (none, none, np.maximum(reach[miss] * 2, 1))))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start_a, start_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(start_a, kind="stable")
    return start_a[order], start_b[order]


class Aligner:
    """Tokens of both sides, their groups and the links of a list of texts.

    A text is cut at each space inside it that follows no white space; neither side
    has a token across such a cut, so parts are encoded on their own and
    remembered (up to ``REMEMBERED`` tokens, then the memory is emptied).
    """

    def __init__(self, a: ByteTokens, b: PieceTokens):
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in b.bytes):
            raise ValueError("the piece model has pieces across spaces")
        self.a, self.b = a, b
        self.size_a = np.array([len(x) for x in a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in b.bytes], np.int64)
        self.names_a = [f"{i}{end}".encode() for i in range(len(a.bytes)) for end in ",|"]
        self.names_b = [f"{i}{end}".encode() for i in range(len(b.bytes)) for end in ",;"]
        self.cut = re.compile(r"(?<=\S) (?=.)", re.DOTALL).split
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.pools = [(np.zeros(0, np.int64), np.zeros(1, np.int64)) for _ in "ab"]

    def learn(self, parts: list[str]) -> None:
        """Tokens of new parts; a part that either side does not give back is marked."""
        ids = [self.a.encode(" " + p) for p in parts], self.b.encode(parts)
        good = [b"".join(map(self.a.bytes.__getitem__, x)) == b"".join(map(self.b.bytes.__getitem__, y)) == b" " + p.encode()
                for p, x, y in zip(parts, *ids)]
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.good = np.append(self.good, good)
        for side, many in enumerate(ids):
            pool, ends = self.pools[side]
            sizes = np.cumsum(np.fromiter(map(len, many), np.int64, len(many)))
            self.pools[side] = (np.append(pool, np.fromiter((i for x in many for i in x), np.int64, int(sizes[-1]))),
                                np.append(ends, ends[-1] + sizes))

    def align(self, many: list[str]) -> dict:
        """Flat ids, tokens per text (none where either side does not give it back), and first tokens of the groups."""
        parts = [self.cut(t) if t else [] for t in many]
        if len(self.pools[0][0]) > REMEMBERED:
            self.forget()
        fresh = list({p for x in parts for p in x if p not in self.known})
        if fresh:
            self.learn(fresh)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        part = np.fromiter(map(self.known.__getitem__, (p for x in parts for p in x)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(parts)), n)
        whole = np.bincount(text[~self.good[part]], minlength=len(parts)) == 0
        part, text = part[whole[text]], text[whole[text]]
        (ids_a, n_a), (ids_b, n_b) = (self.gathered(side, part, text, len(parts)) for side in (0, 1))
        some = n_a > 0
        start_a, start_b = shared_groups(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b]), n_a[some], n_b[some])
        ends = np.cumsum(n_a)
        n_groups = np.searchsorted(start_a, ends) - np.searchsorted(start_a, ends - n_a)
        return {"ids_a": ids_a, "ids_b": ids_b, "n_a": n_a, "n_b": n_b, "start_a": start_a, "start_b": start_b, "n_groups": n_groups}

    def gathered(self, side: int, part: np.ndarray, text: np.ndarray, texts_: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, laid end to end, and their number per text."""
        pool, ends = self.pools[side]
        size = ends[part + 1] - ends[part]
        at = np.arange(int(size.sum())) + np.repeat(ends[part] - (np.cumsum(size) - size), size)
        return pool[at], np.bincount(text, weights=size, minlength=texts_).astype(np.int64)

    def shown(self, x: dict) -> list[bytes]:
        """The groups of each text: ``a1,a2|b1;a3|b2,b3``."""
        ids_a, ids_b = x["ids_a"], x["ids_b"]
        if not len(ids_a):
            return [b""] * len(x["n_a"])
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        stop_a, stop_b = (np.append(x[s][1:], len(i)) for s, i in (("start_a", ids_a), ("start_b", ids_b)))
        last_a[stop_a - 1], last_b[stop_b - 1] = 1, 1
        # an A token stands after the B tokens of the groups before, a B token after the A tokens of its group
        before_a, before_b = np.repeat(x["start_b"], stop_a - x["start_a"]), np.repeat(stop_a, stop_b - x["start_b"])
        code = np.zeros(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + before_a] = ids_a * 2 + last_a
        code[np.arange(len(ids_b)) + before_b] = ids_b * 2 + last_b + len(self.names_a)
        names = (self.names_a + self.names_b).__getitem__
        cuts = np.cumsum(x["n_a"] + x["n_b"]).tolist()
        flat = code.tolist()
        return [b"".join(map(names, flat[s:e]))[:-1] for s, e in zip([0, *cuts[:-1]], cuts)]

    def links(self, x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, A id, B id and number of links, one row per distinct pair and text."""
        ids_a, ids_b, start_a, start_b = (x[c] for c in ("ids_a", "ids_b", "start_a", "start_b"))
        k_a, k_b = np.diff(np.append(start_a, len(ids_a))), np.diff(np.append(start_b, len(ids_b)))
        doc = np.searchsorted(np.cumsum(x["n_a"]), start_a, side="right")
        small = k_a * k_b <= WIDE
        n = (k_a * k_b)[small]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        each_b = np.repeat(k_b[small], n)
        parts = [(np.repeat(doc[small], n), ids_a[np.repeat(start_a[small], n) + within // each_b],
                  ids_b[np.repeat(start_b[small], n) + within % each_b], np.ones(len(within), np.int64))]
        for g in np.flatnonzero(~small).tolist():
            u, c = np.unique(ids_a[start_a[g]:start_a[g] + k_a[g]], return_counts=True)
            v, d = np.unique(ids_b[start_b[g]:start_b[g] + k_b[g]], return_counts=True)
            parts.append((np.full(len(u) * len(v), doc[g]), np.repeat(u, len(v)), np.tile(v, len(u)), np.outer(c, d).ravel()))
        text, a, b, times = (np.concatenate(p) for p in zip(*parts))
        bits_a, bits_b = len(self.size_a).bit_length(), len(self.size_b).bit_length()
        key = (text << (bits_a + bits_b)) | (a << bits_b) | b
        if len(parts) == 1:
            key, times = np.unique(key, return_counts=True)
        else:
            key, where = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, times)
            times = total
        return key >> (bits_a + bits_b), (key >> bits_b) & ((1 << bits_a) - 1), key & ((1 << bits_b) - 1), times


def _readers(byte_vocabulary: str, piece_model: str) -> Callable[[], Aligner]:
    """The vocabulary files are read on the driver and travel with the task (some MB)."""
    with open(byte_vocabulary, encoding="utf-8") as f:
        spec = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    return lambda: Aligner(ByteTokens(spec), PieceTokens(model))


def groups(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups and groups (``a1,a2|b1;a3|b2,b3``, empty without tokens) of every row; no shuffle."""
    reader = _readers(byte_vocabulary, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = reader()
        for batch in slices(batches, 1):
            x = aligner.align(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x[c]) for c in ("n_a", "n_b", "n_groups")),
                 pa.array([s.decode() for s in aligner.shown(x)], pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "groups"])

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups string")


CHUNK_FIELDS = [("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()),
                ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))]
CHUNK_SCHEMA = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "links binary, pairs array<long>, holders array<int>")


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    The A side encodes a space and the text, the B side the text (its model
    adds the space). A link is a pair of token occurrences whose byte ranges
    share a group; the count of an id pair is the number of rows that hold it
    linked; n_best counts links whose count is the highest of their A id.
    Texts that are null, empty or not given back by either side (a text with
    U+2581, for one) have zeros and an empty digest. Null doc_ids stay null,
    repeated rows are documents each, an empty table gives no rows, other
    columns are left out whatever their names. Whole texts of any length; the
    memory of a task grows with a chunk, or with the distinct pairs of the
    longest text.
    """
    reader = _readers(byte_vocabulary, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        aligner, squeeze = reader(), zstandard.ZstdCompressor(level=1)
        bits_b = len(aligner.size_b).bit_length()
        for number, batch in enumerate(slices(batches, 1, CHUNK)):
            chunk = (TaskContext.get().partitionId() << 32) | number
            n = batch.num_rows
            shas, sizes, found, done = [], [], [], 0
            for part in slices([batch], 1, STEP):
                x = aligner.align(texts(part.column(1)))
                shas += [hashlib.sha256(s).hexdigest() if s else "" for s in aligner.shown(x)]
                sizes.append([x[c] for c in ("n_a", "n_b", "n_groups")])
                text, a, b, times = aligner.links(x)
                found.append((text + done, a, b, times))
                done += part.num_rows
            text, a, b, times = (np.concatenate(f) for f in zip(*found))
            pairs, where, holders = np.unique((a << bits_b) | b, return_inverse=True, return_counts=True)
            stop = np.searchsorted(text, np.arange(n), side="right").tolist()
            blobs, totals = [], []
            for s, e in zip([0, *stop[:-1]], stop):
                order = np.argsort(where[s:e], kind="stable")
                steps = np.diff(where[s:e][order], prepend=0).astype("<i4")
                blobs.append(squeeze.compress(steps.tobytes() + times[s:e][order].astype("<i8").tobytes()) if e > s else b"")
                totals.append(int(times[s:e].sum()))
            none = [None] * n
            made = [pa.array([chunk] * n, pa.int64()), batch.column(0), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(*sizes)),
                    pa.array(totals, pa.int64()), pa.array(shas, pa.string()), pa.array(blobs, pa.binary()),
                    pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(made, schema=pa.schema(CHUNK_FIELDS))
            if len(pairs):
                lone = [pa.array([chunk], pa.int64()), *(pa.nulls(1, t) for _, t in CHUNK_FIELDS[1:8]),
                        pa.array([pairs], pa.list_(pa.int64())), pa.array([holders.astype(np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(lone, schema=pa.schema(CHUNK_FIELDS))

    source = picked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = source.mapInArrow(run, CHUNK_SCHEMA).checkpoint(eager=True)
    held = rows.filter("pairs IS NOT NULL").select(
        "chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "x")).select(
        F.col("chunk").alias("of"), "place", F.col("x.pairs").alias("pair"), F.col("x.holders").alias("holders"))
    counts = held.groupBy("pair").agg(F.sum("holders").alias("count")).checkpoint(eager=True)
    bits_b = len(reader().size_b).bit_length()
    a_id = F.shiftright("pair", bits_b)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("highest"))
    scored = counts.withColumn("a", a_id).join(F.broadcast(highest), "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = held.select("of", "place", "pair").join(scored, "pair").select("of", "place", "count", "best")
    documents = rows.filter("pairs IS NULL").drop("pairs", "holders")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        order = np.argsort(right["place"].to_numpy())
        count = right["count"].to_numpy()[order]
        best = right["best"].to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for blob in left["links"].to_pylist():
            raw = expand.decompress(blob) if blob else b""
            n = len(raw) // 12
            where = np.cumsum(np.frombuffer(raw, "<i4", n))
            times = np.frombuffer(raw, "<i8", n, 4 * n)
            n_best.append(int((times * best[where]).sum()))
            count_sum.append(int((times * count[where]).sum()))
        return pa.table({"doc_id": left["doc_id"], **{c: left[c] for c in ("n_a", "n_b", "n_groups", "n_links")},
                         "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                         "groups_sha256": left["groups_sha256"]})

    return documents.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

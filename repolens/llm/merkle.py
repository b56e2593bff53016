"""Merkle manifest of a corpus: one tree of leaf digests per group, a tree of subroots above, and a proof per row.

Trees are ``arity``-ary. Nodes are named by coordinates (tree, level, idx);
leaf ``place`` has ancestor ``place // arity ** level`` on each level.

* Positions come from the skew-safe ordinal (a group may hold any share of all
  rows). Blocks of ``arity ** DEPTH`` neighbours are hashed upwards in one
  task, then blocks of what is left, so the number of rounds is the logarithm
  of the rows to base 4096.
* Proofs follow the octopus multiproof. A block of leaves is a leaf partition.
  From its first and last place and the size of its tree it computes the
  smallest set of node coordinates that its leaves do not imply, fetches them
  in one join, derives the interior nodes that its leaves share and expands
  the proof of each leaf in its own task.
* A node near the root is wanted by every partition of its tree. Coordinates
  therefore carry a ``copy``, the number of the requester's stretch of
  ``arity ** (2 * DEPTH)`` leaves, and nodes above that height are repeated for
  the stretches below their parent, so no join key meets more than
  ``arity ** DEPTH`` requests.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked
from repolens.operators.ordinal import ordinal_within
from repolens.plans.session import ensure_checkpoint_dir

#: Levels that one task hashes at a time.
DEPTH = 4
NODE = "tree long, size long, level int, idx long, h string"
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, concatenated as UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows share an encoding; ``-`` is null."""
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def document_leaf(text: Column) -> Column:
    """The leaf of a row of ``documents`` whose text is ``text``."""
    return digest(*[field(c) for c in (F.col("doc_id").cast("long"), F.col("source"), F.col("lang"),
                                       F.col("n_chars").cast("long"), text)])


def lower_ascii(text: Column) -> Column:
    upper = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return F.translate(text, upper, upper.lower())


def height(size: int, arity: int) -> int:
    """Levels above ``size`` leaves until one node remains."""
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def missing(first: int, last: int, size: int, arity: int) -> list[tuple[int, int]]:
    """The fewest (level, idx) that, with leaves ``first`` to ``last``, give every node on their ways to the root."""
    wanted, level = [], 0
    while size > 1:
        low, high = first // arity, last // arity
        end = min((high + 1) * arity, size)
        wanted += [(level, i) for i in (*range(low * arity, first), *range(last + 1, end))]
        first, last, size, level = low, high, -(-size // arity), level + 1
    return wanted


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(first: int, hashes: list[str], size: int, arity: int, levels: int, fetched=None) -> list[tuple[int, list[str]]]:
    """Per level the number of the first run and all runs as joined digests; the last entry is what remains."""
    out, level = [], 0
    while size > 1 and level < levels:
        low, last = first // arity, first + len(hashes) - 1
        end = min((last // arity + 1) * arity, size)
        nodes = [*(fetched[level, i] for i in range(low * arity, first)), *hashes,
                 *(fetched[level, i] for i in range(last + 1, end))]
        runs = ["".join(nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        out.append((low, runs))
        first, hashes, size, level = low, [sha(r) for r in runs], -(-size // arity), level + 1
    out.append((first, hashes))
    return out


def _nodes(leaves: DataFrame, arity: int) -> DataFrame:
    """All nodes of all trees, leaves included: (tree, size, level, idx, h) from rows of level 0."""
    reach = arity ** DEPTH

    def up(table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx").to_pydict()
        tree, size, level, first = (rows[c][0] for c in ("tree", "size", "level", "idx"))
        here = size
        for _ in range(level):
            here = -(-here // arity)
        made = {"tree": [], "size": [], "level": [], "idx": [], "h": []}
        for above, (start, runs) in enumerate(climb(first, rows["h"], here, arity, DEPTH)[:-1], 1):
            k = len(runs)
            made["tree"] += [tree] * k
            made["size"] += [size] * k
            made["level"] += [level + above] * k
            made["idx"] += range(start, start + k)
            made["h"] += [sha(r) for r in runs]
        return pa.table(made, schema=pa.schema([("tree", pa.int64()), ("size", pa.int64()), ("level", pa.int32()),
                                                ("idx", pa.int64()), ("h", pa.string())]))

    most = leaves.agg(F.max("size")).first()[0] or 0
    every = now = leaves
    for round_ in range(-(-height(most, arity) // DEPTH)):
        if round_:
            now = now.filter(F.col("level") == round_ * DEPTH)
        now = (now.withColumn("block", F.expr(f"idx div {reach}")).groupBy("tree", "block")
               .applyInArrow(lambda t: up(t.drop_columns(["block"])), NODE)).checkpoint(eager=True)
        every = every.unionByName(now)
    return every


def _roots(nodes: DataFrame) -> DataFrame:
    """(tree, root): the node of the highest level of each tree."""
    return nodes.groupBy("tree").agg(F.max_by("h", F.struct("level")).alias("root"))


def _fetched(blocks: DataFrame, nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, block, level, idx, h) that each block of leaves needs beside its own, by one join on coordinates."""
    reach = arity ** DEPTH
    span = reach * reach

    def wants(batches):
        for batch in batches:
            made = {"tree": [], "block": [], "copy": [], "level": [], "idx": []}
            for tree, size, block in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "block"))):
                for level, idx in missing(block * reach, min((block + 1) * reach, size) - 1, size, arity):
                    for name, value in zip(made, (tree, block, block // reach, level, idx)):
                        made[name].append(value)
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema(
                [("tree", pa.int64()), ("block", pa.int64()), ("copy", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())]))

    requests = blocks.select("tree", "size", "block").mapInArrow(wants, "tree long, block long, copy long, level int, idx long")
    # leaves below the parent of a node, then the stretches of them
    parent = F.pow(F.lit(arity), F.col("level") + 1).cast("long")
    start = F.expr(f"idx div {arity}") * parent
    end = F.least(start + parent, F.col("size")) - 1
    offered = nodes.filter(F.col("level") >= DEPTH).select(
        "tree", "level", "idx", "h",
        F.explode(F.sequence((start / span).cast("long"), (end / span).cast("long"))).alias("copy"))
    return requests.join(offered, ["tree", "copy", "level", "idx"]).select("tree", "block", "level", "idx", "h")


def prove(leaves: DataFrame, group: str, order: list[str], arity: int = 8) -> DataFrame:
    """The rows of ``leaves`` (with a column ``leaf``) and subroot, root, place and proof.

    Leaves of a ``group`` value ascend by ``order`` (nulls first), then by leaf.
    While several nodes remain, each ``arity`` neighbours (the last run may be
    shorter) become their digest; a lone leaf is its own subroot. Subroots
    ascend by group (null first, then UTF-8 order) and give root likewise.
    ``proof`` holds the siblings of each level up to root as the digests before
    and after the own node; ``folded`` recomputes the root from it. Rows that
    agree in group, order and leaf are interchangeable. An empty table gives no
    rows. Columns of ``leaves`` called like those added are replaced.
    """
    added = ("subroot", "root", "place", "proof")
    rows = leaves.select(F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c not in added]).alias("row"))
    keys = [f"o{i}" for i in range(len(order))]
    rows = rows.select("row", F.col(f"row.`{group}`").alias("g"), F.col("row.leaf").alias("leaf"),
                       *[F.col(f"row.`{c}`").alias(k) for c, k in zip(order, keys)])
    placed = ordinal_within(rows, ["g"], [*keys, "leaf"], "place").select(
        "row", "g", "leaf", (F.col("place") - 1).alias("place")).checkpoint(eager=True)
    groups = ordinal_within(placed.groupBy("g").agg(F.count("*").alias("size")).withColumn("one", F.lit(1)),
                            ["one"], ["g"], "tree").select("g", "size", F.col("tree") - 1).toDF("g", "size", "tree")
    groups = groups.checkpoint(eager=True)
    placed = placed.join(groups, placed["g"].eqNullSafe(groups["g"])).select(
        "row", "leaf", "place", "tree", "size", F.expr(f"place div {arity ** DEPTH}").alias("block"))
    nodes = _nodes(placed.select("tree", "size", F.lit(0).alias("level"), F.col("place").alias("idx"), F.col("leaf").alias("h")), arity)
    roots = _roots(nodes)
    trees = groups.count()
    top = _nodes(roots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"),
                              F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("root").alias("h")), arity).checkpoint(eager=True)
    blocks = (groups.select("tree", "size", F.explode(F.sequence(
        F.lit(0), ((F.col("size") - 1) / arity ** DEPTH).cast("long"))).alias("block")))
    own = _fetched(blocks, nodes, arity).withColumn("above", F.lit(False))
    # the way of each subroot to the root, handed to the blocks of its tree stretch by stretch
    ways = _ways(groups, top, trees, arity)
    stretch = F.expr(f"block div {arity ** DEPTH}")
    ways = ways.join(blocks.groupBy("tree", stretch.alias("stretch")).count().drop("count"), "tree")
    above = blocks.withColumn("stretch", stretch).join(ways, ["tree", "stretch"]).select(
        "tree", "block", "level", "idx", "h", F.lit(True).alias("above"))
    fetched = own.unionByName(above)
    result = placed.schema["row"].dataType.simpleString()

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place")
        tree, size = left["tree"][0].as_py(), left["size"][0].as_py()
        got = ({}, {})
        for over, level, idx, h in zip(*(right[c].to_pylist() for c in ("above", "level", "idx", "h"))):
            got[over][level, idx] = h
        places = left["place"].to_pylist()
        steps = climb(places[0], left["leaf"].to_pylist(), size, arity, 64, got[0])
        subroot = steps[-1][1][0]
        outer = climb(tree, [subroot], trees, arity, 64, got[1])
        root = outer[-1][1][0]

        def siblings(place: int, many: list) -> list:
            out = []
            for low, runs in many[:-1]:
                place, at = divmod(place, arity)
                run = runs[place - low]
                out.append({"before": run[:64 * at], "after": run[64 * at + 64:]})
            return out

        tail = siblings(tree, outer)
        proofs = [siblings(p, steps) + tail for p in places]
        n = len(places)
        return pa.table({"row": left["row"], "place": left["place"], "subroot": pa.array([subroot] * n),
                         "root": pa.array([root] * n),
                         "proof": pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})

    proved = (placed.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
              .applyInArrow(expand, f"row {result}, place long, subroot string, root string, proof {PROOF}"))
    return proved.select("row.*", "subroot", "root", "place", "proof")


def _ways(groups: DataFrame, top: DataFrame, trees: int, arity: int) -> DataFrame:
    """(tree, level, idx, h): the siblings of each subroot on its way to the root."""
    levels = height(trees, arity)
    if not levels:
        return top.select("tree", "level", "idx", "h").limit(0)
    node = F.expr(f"tree div cast(pow({arity}, level) as long)")
    wanted = (groups.select("tree", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
              .withColumn("run", F.expr(f"tree div cast(pow({arity}, level + 1) as long)")).withColumn("node", node))
    offered = top.select(F.col("level"), F.expr(f"idx div {arity}").alias("run"), "idx", "h")
    return wanted.join(offered, ["level", "run"]).filter("idx != node").select("tree", "level", "idx", "h")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def verify_documents(docs: DataFrame, tampered: Column, tampered_text: Column) -> DataFrame:
    """Each row of ``docs`` with its proof, checked against a row whose text was replaced where ``tampered`` holds.

    Returns doc_id, lang, leaf, given_leaf (of the row as received), subroot,
    root, place, proof, folded_root and verified. A row of ``documents`` is a
    leaf by ``document_leaf``, in one tree per lang, ascending by doc_id. Null
    fields have their own encoding, so null and empty text differ; null doc_ids
    come first; repeated rows are leaves each; other columns play no part.
    """
    source = picked(docs, "doc_id", "source", "lang", "n_chars", "text")
    leaves = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                           document_leaf(F.col("text")).alias("leaf"),
                           F.when(tampered, document_leaf(tampered_text)).alias("other"))
    # the range sort reads its input twice: digests are made once
    ensure_checkpoint_dir(docs.sparkSession)
    leaves = leaves.checkpoint(eager=True)
    proved = prove(leaves, "lang", ["doc_id"]).withColumn("given_leaf", F.coalesce("other", "leaf"))
    return (proved.drop("other").withColumn("folded_root", folded(F.col("given_leaf"), F.col("proof")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))

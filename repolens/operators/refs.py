"""Pinned references in workflow files (Q22-Q27).

Workflow texts: ``path, content`` (S9) and the columns named by ``keys``, such
as the checkout they belong to. Names: ``repo, kind ('tag'|'branch'),
name, commit_sha`` (tags and branches of the referenced repositories, all
pages). Optional tag objects: ``repo, tag_sha, target_sha`` for annotated tags.
Renames: ``old_path, new_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.functions import versions as V
from repolens.functions.fixed_values import REF_FORM, SKIP_REFS, USES_PATTERN


def ref_occurrences(files: DataFrame, include: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every ``uses:`` reference with its file and position (V21 exploded)."""
    occ = files.select(*keys, "path", F.posexplode(X.parse_refs("content")).alias("pos", "m"))
    occ = occ.select(*keys, "path", F.col("pos").cast("bigint").alias("pos"), "m.*")
    if include:
        occ = occ.filter(F.col("action_path").contains(include))
    return occ


def collect_refs(files: DataFrame, include: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q22: distinct ``(repo, ref)`` with the comment tag first seen (files in path order).

    ``keys`` (a checkout, say) hold texts apart here and in every later step.
    """
    occ = ref_occurrences(files, include, keys)
    return occ.groupBy(*keys, "repo", "ref").agg(
        F.max("is_sha").alias("is_sha"),
        F.min_by("tag", F.struct("path", "pos")).alias("tag"))


def unpinnable_refs(refs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q26: references pinned to a hash with no version comment: cannot be updated."""
    return refs.filter(F.col("is_sha") & F.col("tag").isNull()).select(*keys, "repo", "ref")


#: Shapes under which a reference looks for names: any name, names of one number (longer names: their first number).
ANY_SHAPE, ONE_NUMBER = "any", "one"


class NameIndex:
    """Tags and branches reduced for every lookup of a plan; nothing is kept in memory.

    ``best``: best candidate per ``(repo, prefix, shape)``: tags before
    branches, then the highest version. ``commits``: the commit of each name,
    tags before branches, annotated tags followed to their target.
    """

    def __init__(self, names: DataFrame, tag_objects: DataFrame | None = None):
        n = (names.filter(F.col("name").rlike(REF_FORM))
             .select("repo", "name", (F.col("kind") == "tag").alias("is_tag"),
                     F.regexp_extract("name", REF_FORM, 1).alias("prefix"),
                     V.dotted_key(F.regexp_extract("name", REF_FORM, 2)).alias("v")))
        own = F.when(F.size("v") == 1, ONE_NUMBER).otherwise(F.element_at("v", 1).cast("string"))
        self.best = n.select("*", F.explode(F.array(F.lit(ANY_SHAPE), own)).alias("shape")) \
            .groupBy("repo", "prefix", "shape").agg(
                F.max_by(F.struct("name", "v"), F.struct("is_tag", "v", F.col("name"))).alias("b"))
        c = names.select("repo", "kind", "name", "commit_sha")
        if tag_objects is not None:
            c = c.join(tag_objects.select("repo", F.col("tag_sha").alias("commit_sha"), "target_sha"),
                       ["repo", "commit_sha"], "left") \
                .withColumn("commit_sha", F.coalesce("target_sha", "commit_sha")).drop("target_sha")
        self.commits = c.groupBy("repo", "name").agg(
            F.min_by("commit_sha", F.struct(F.col("kind") != "tag", F.col("commit_sha"))).alias("commit_sha"))


def _index(names, tag_objects=None) -> NameIndex:
    return names if isinstance(names, NameIndex) else NameIndex(names, tag_objects)


def latest_refs(queries: DataFrame, names: DataFrame, expand: bool = False, col: str = "ref") -> DataFrame:
    """Q23: newest tag or branch name for each versioned reference ``(repo, <col>)``.

    Candidates share the reference's non-digit prefix exactly. A reference
    with a dot matches names with any number of parts, one without matches
    single numbers only, unless ``expand``: then longer names starting with its
    number. Tags are searched first; branches only when no tag is a candidate.
    A best candidate not above the current version gives null.

    The best candidate does not depend on the reference beyond its prefix and
    its shape (any name, one number, or with ``expand`` its number), so names
    are first reduced to one best row per ``(repo, prefix, shape)`` -- a partial
    aggregation -- and each reference joins a single row: no reference-by-name
    pairs.
    """
    idx = _index(names)
    number = F.regexp_extract("query", REF_FORM, 2)
    own = F.element_at("cur", 1).cast("string") if expand else F.lit(ONE_NUMBER)
    q = (queries.select("repo", F.col(col).alias("query")).distinct()
         .filter(~F.col("query").isin(SKIP_REFS) & F.col("query").rlike(REF_FORM))
         .withColumn("prefix", F.regexp_extract("query", REF_FORM, 1))
         .withColumn("cur", V.dotted_key(number))
         .withColumn("shape", F.when(number.contains("."), ANY_SHAPE).otherwise(own)))
    return q.join(idx.best, ["repo", "prefix", "shape"]).select(
        "repo", F.col("query").alias(col), F.when(F.col("b.v") > F.col("cur"), F.col("b.name")).alias("latest"))


def resolve_commits(wanted: DataFrame, names, tag_objects: DataFrame | None = None,
                    col: str = "name") -> DataFrame:
    """Q24: commit of a tag or branch name: tags before branches; annotated tags
    followed to their target. ``names`` may be a ``NameIndex`` built once."""
    idx = _index(names, tag_objects)
    w = wanted.select("repo", F.col(col).alias("name")).distinct()
    return w.join(idx.commits, ["repo", "name"]).withColumnRenamed("name", col)


def plan_ref_updates(refs: DataFrame, names: DataFrame, pin: bool = False, expand: bool = False,
                     mutable: bool = False, tag_objects: DataFrame | None = None,
                     loosen_unresolved: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Q25: ``repo, ref, latest_tag, latest_sha`` per reference.

    Hash refs: need a comment tag; the newer tag (or, with ``mutable``, the
    same dotless tag) is resolved; equal to the ref -> no update. Name refs:
    the newer name; with ``pin`` (newer name or the ref itself) plus its
    commit.

    A hash ref whose new tag has no resolvable commit is left unchanged
    (``unresolved_updates`` reports it): rewriting it to ``@tag`` would turn a
    pin into a moving reference. ``loosen_unresolved=True`` keeps the tag with
    a null hash instead, which rewrites the reference to ``@tag``.
    """
    found = _targets(refs, names, expand, mutable, tag_objects, keep_names=pin)
    is_sha = F.col("is_sha")
    update = ~is_sha | ~F.col("commit_sha").eqNullSafe(F.col("ref"))
    if not loosen_unresolved:
        update = update & (~is_sha | F.col("commit_sha").isNotNull())
    sha = F.col("commit_sha") if pin else F.when(is_sha, F.col("commit_sha"))
    update = F.col("target").isNotNull() & update
    return found.select(*keys, "repo", "ref", F.when(update, F.col("target")).alias("latest_tag"),
                        F.when(update, sha).alias("latest_sha"))


def _targets(refs: DataFrame, names, expand: bool, mutable: bool, tag_objects: DataFrame | None,
             keep_names: bool) -> DataFrame:
    """References with ``target`` (the name they should have) and its ``commit_sha``, looked up together.

    Hash refs are looked up by their comment tag, others by their own name.
    """
    idx = _index(names, tag_objects)
    is_sha = F.col("is_sha")
    asked = refs.withColumn("_asked", F.when(is_sha, F.col("tag")).otherwise(F.col("ref")))
    newer = latest_refs(asked.filter(F.col("_asked").isNotNull()), idx, expand, col="_asked")
    target = F.col("latest")
    if mutable:
        target = F.coalesce(target, F.when(is_sha & ~F.col("tag").contains("."), F.col("tag")))
    if keep_names:
        target = F.coalesce(target, F.when(~is_sha, F.col("ref")))
    found = asked.join(newer, ["repo", "_asked"], "left").withColumn("target", target)
    commits = idx.commits.withColumnRenamed("name", "target")
    return found.join(commits, ["repo", "target"], "left").drop("_asked", "latest")


def unresolved_updates(refs: DataFrame, names: DataFrame, expand: bool = False, mutable: bool = False,
                       tag_objects: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hash refs with a newer tag whose commit cannot be resolved: ``repo, ref, tag, target``."""
    sha_refs = refs.filter(F.col("is_sha") & F.col("tag").isNotNull())
    found = _targets(sha_refs, names, expand, mutable, tag_objects, keep_names=False)
    return found.filter(F.col("target").isNotNull() & F.col("commit_sha").isNull()).select(
        *keys, "repo", "ref", "tag", "target")


def rewrite_refs(files: DataFrame, plan: DataFrame, renames: DataFrame | None = None,
                 keys: tuple[str, ...] = ()):
    """Q27: rewritten texts and the change table.

    Returns ``(texts, changes)``: ``texts`` has ``path, text, new_text`` (and
    ``keys``) for files that change; ``changes`` has ``path, pos, action_path,
    old, new``. Matches are rebuilt from the text between them (``split`` on the
    pattern) and the rewritten matches, joined back in order. Only files with a
    changed match take part in that join.
    """
    occ = ref_occurrences(files, keys=keys)
    updates = plan.filter(F.col("latest_tag").isNotNull()).select(*keys, "repo", "ref", "latest_tag", "latest_sha")
    occ = occ.join(updates, [*keys, "repo", "ref"], "left")
    if renames is not None:
        # user-supplied list: AQE broadcasts it when its measured size is small
        occ = occ.join(renames.withColumnRenamed("old_path", "action_path"), "action_path", "left")
    else:
        occ = occ.withColumn("new_path", F.lit(None).cast("string"))
    new_path = F.coalesce("new_path", "action_path")
    has_update = F.col("latest_tag").isNotNull()
    renamed = F.col("new_path").isNotNull() & (F.col("new_path") != F.col("action_path"))
    repl = (F.when(has_update & F.col("latest_sha").isNotNull(),
                   F.concat("lead", new_path, F.lit("@"), "latest_sha", F.lit(" # "), "latest_tag"))
            .when(has_update, F.concat("lead", new_path, F.lit("@"), "latest_tag"))
            .when(renamed, F.concat("lead", new_path, F.lit("@"), "ref"))
            .otherwise(F.col("whole")))
    change = (F.when(has_update & F.col("latest_sha").isNotNull(),
                     F.struct(new_path.alias("action_path"), F.substring("ref", 1, 12).alias("old"),
                              F.concat(F.substring("latest_sha", 1, 12), F.lit(" ("), "latest_tag", F.lit(")")).alias("new")))
              .when(has_update, F.struct(new_path.alias("action_path"), F.col("ref").alias("old"),
                                         F.col("latest_tag").alias("new")))
              .when(renamed, F.struct(F.col("action_path"), F.col("ref").alias("old"),
                                      F.concat(new_path, F.lit("@"), "ref").alias("new"))))
    occ = occ.withColumn("repl", repl).withColumn("change", change)
    # one file is one group: its matches are bounded by the file's own text
    per_file = occ.groupBy(*keys, "path").agg(
        F.sort_array(F.collect_list(F.struct("pos", "repl", "change"))).alias("r"),
        F.count("change").alias("_changes")).filter(F.col("_changes") > 0)
    full = files.select(*keys, "path", "content").join(per_file, [*keys, "path"])
    full = full.withColumn("gaps", F.split("content", USES_PATTERN, -1)).withColumn(
        "repls", F.concat(F.transform("r", lambda s: s["repl"]), F.array(F.lit(""))))
    full = full.withColumn("new_text", F.array_join(F.zip_with("gaps", "repls", lambda g, r: F.concat(g, r)), ""))
    full = full.filter(F.col("new_text") != F.col("content"))
    texts = full.select(*keys, "path", F.col("content").alias("text"), "new_text")
    changes = (full.select(*keys, "path", F.explode(F.filter("r", lambda s: s["change"].isNotNull())).alias("c"))
               .select(*keys, "path", "c.pos", "c.change.action_path", "c.change.old", "c.change.new"))
    return texts, changes


def workflow_updates(files: DataFrame, names: DataFrame, pin: bool = False, expand: bool = False,
                     mutable: bool = False, include: str | None = None, renames: DataFrame | None = None,
                     tag_objects: DataFrame | None = None, loosen_unresolved: bool = False,
                     keys: tuple[str, ...] = ()) -> dict:
    """The whole update: references, plan, rewritten texts, changes, and the refs that cannot be updated.

    ``keys`` name the checkout of a text: equal paths of two checkouts are two
    files, and a comment tag counts in its own checkout only.
    """
    refs = collect_refs(files, include, keys)
    idx = NameIndex(names, tag_objects)
    plan = plan_ref_updates(refs, idx, pin, expand, mutable, loosen_unresolved=loosen_unresolved, keys=keys)
    texts, changes = rewrite_refs(files, plan, renames, keys)
    return {"refs": refs, "plan": plan, "texts": texts, "changes": changes,
            "unpinnable": unpinnable_refs(refs, keys),
            "unresolved": unresolved_updates(refs, idx, expand, mutable, keys=keys)}

"""Changelog family (Q1-Q9): release windows, changes in them, contributors, document.

Inputs, one row per repository object:

* changes: ``repo, number, title, author, merged_at`` (S1)
* tags: ``repo, tag, prerelease, committed_at, pr_merged_at`` (S2 joined with commits)

Everything runs over many repositories at once; ``repo`` is a key column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.functions.fixed_values import IGNORED_CONTRIBUTORS, SECTIONS
from repolens.operators.ordinal import ordinal_within

WINDOW_KEYS = ["repo", "from_tag", "to_tag"]


def tag_dates(tags: DataFrame, commits: DataFrame | None = None,
              commit_changes: DataFrame | None = None) -> DataFrame:
    """Q1: date of each tag: merge time of its commit's first change request, else commit time.

    Either ``tags`` already carries ``committed_at`` and ``pr_merged_at``, or it
    carries ``sha`` and the dates come from two left equi-joins: ``commits``
    (``repo, sha, committed_at``) and ``commit_changes`` (``repo, sha, number,
    merged_at``; the first change request is the lowest number), unless
    ``commits`` carries ``pr_merged_at`` itself. Tags that carry ``tagged_at``
    are returned as they are, so a dated table can be handed on.
    """
    if "tagged_at" in tags.columns:
        return tags
    if commits is not None:
        first = None
        if commit_changes is not None:
            first = commit_changes.groupBy("repo", "sha").agg(
                F.min_by("merged_at", "number").alias("pr_merged_at"))
        elif "pr_merged_at" in commits.columns:
            first = commits.select("repo", "sha", "pr_merged_at")
        t = tags.join(commits.select("repo", "sha", "committed_at"), ["repo", "sha"], "left")
        t = t.join(first, ["repo", "sha"], "left") if first is not None else \
            t.withColumn("pr_merged_at", F.lit(None).cast("timestamp_ntz"))
        tags = t
    extra = ["api_order"] if "api_order" in tags.columns else []
    return tags.select("repo", "tag", "prerelease", *extra,
                       F.coalesce("pr_merged_at", "committed_at").alias("tagged_at"))


def release_windows(tags: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Q9: release windows ``(repo, from_tag, from_at, to_tag, to_at)``.

    Without ``head``: every pair of adjacent final releases (prereleases left
    out). With ``head`` (``repo, head, head_at``): the default window, from
    the newest final release to the branch head.
    """
    dated = tag_dates(tags).filter(~F.col("prerelease"))
    if head is not None:
        # newest final release: first in API order when the releases carry it, else latest date
        if "api_order" in dated.columns:
            newest = dated.groupBy("repo").agg(
                F.min_by(F.struct("tag", "tagged_at"), F.col("api_order")).alias("t"))
        else:
            newest = dated.groupBy("repo").agg(
                F.max_by(F.struct("tag", "tagged_at"), F.struct("tagged_at", "tag")).alias("t"))
        return (newest.join(head, "repo")
                .select("repo", F.col("t.tag").alias("from_tag"), F.col("t.tagged_at").alias("from_at"),
                        F.col("head").alias("to_tag"), F.col("head_at").alias("to_at")))
    # adjacent releases: position per repository from the skew-safe ordinal,
    # then a self-join of position i with i + 1 (no window over a repository)
    numbered = ordinal_within(dated.select("repo", "tag", "tagged_at"), ["repo"], ["tagged_at", "tag"], name="i")
    a = numbered.select("repo", F.col("tag").alias("from_tag"), F.col("tagged_at").alias("from_at"), "i")
    b = numbered.select("repo", F.col("tag").alias("to_tag"), F.col("tagged_at").alias("to_at"),
                        (F.col("i") - 1).alias("i"))
    return a.join(b, ["repo", "i"]).select("repo", "from_tag", "from_at", "to_tag", "to_at")


def chosen_windows(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q9, chosen pair: windows ``(repo, from_tag, to_tag)`` given by the user, dated by Q1."""
    dated = tag_dates(tags).select("repo", "tag", "tagged_at")
    a = dated.select("repo", F.col("tag").alias("from_tag"), F.col("tagged_at").alias("from_at"))
    b = dated.select("repo", F.col("tag").alias("to_tag"), F.col("tagged_at").alias("to_at"))
    return (pairs.select("repo", "from_tag", "to_tag").join(a, ["repo", "from_tag"]).join(b, ["repo", "to_tag"])
            .select("repo", "from_tag", "from_at", "to_tag", "to_at"))


def prs_in_window(changes: DataFrame, windows: DataFrame) -> DataFrame:
    """Q2: changes merged inside each window, both ends included, no cap.

    The range join is made an equi-join on ``(repo, day)``: every window is
    expanded to the days it spans (a small table, one row per repository-day),
    so a busy repository is not compared change by change with every window
    and the join can split a hot key (AQE skew join) or broadcast the day
    table when its measured size is small.
    """
    days = windows.select(
        *WINDOW_KEYS, "from_at", "to_at",
        F.explode(F.sequence(F.to_date("from_at"), F.to_date("to_at"))).alias("day"))
    dated = changes.withColumn("day", F.to_date("merged_at"))
    joined = dated.join(days, ["repo", "day"]).filter(
        (F.col("merged_at") >= F.col("from_at")) & (F.col("merged_at") <= F.col("to_at")))
    return joined.select(*WINDOW_KEYS, "from_at", "to_at", "number", "title",
                         F.coalesce("author", F.lit("unknown")).alias("author"), "merged_at")


def sections(spark) -> DataFrame:
    rows = [(p, t, i) for i, (p, t) in enumerate(SECTIONS)]
    return spark.createDataFrame(rows, "prefix string, section string, position int")


def categorize_changes(in_window: DataFrame, owner: str = "org") -> DataFrame:
    """Q3: one rendered line per change with its section.

    No prefix -> ``misc``; a prefix outside the known sections is dropped;
    ``!`` rewrites the line to ``- BREAKING CHANGE: ...``.
    """
    spark = in_window.sparkSession
    line = X.change_line("title", "number", F.lit(owner), "repo")
    parsed = in_window.withColumn("line", line).withColumn("p", X.split_change_title("line"))
    rendered = parsed.select(
        *WINDOW_KEYS, "number", "merged_at",
        F.coalesce("p.prefix", F.lit("misc")).alias("prefix"),
        F.when(F.col("p.breaking"), F.concat(F.lit("- BREAKING CHANGE: "), F.expr("substring(line, 3)")))
        .otherwise(F.col("line")).alias("line"))
    # the section table is a fixed 13-row list
    return rendered.join(F.broadcast(sections(spark)), "prefix")


def section_counts(categorized: DataFrame) -> DataFrame:
    """Q3 counts: changes per repository, window and section."""
    return categorized.groupBy(*WINDOW_KEYS, "section", "position").agg(F.count("*").alias("changes"))


def contributors(in_window: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Q4: distinct contributors per window, automation accounts removed."""
    ignored = IGNORED_CONTRIBUTORS if ignored is None else ignored
    people = in_window.select(*WINDOW_KEYS, "from_at", F.col("author").alias("login")).distinct()
    return people.filter(~F.col("login").isin(ignored)) if ignored else people


def first_contributions(changes: DataFrame, people: DataFrame) -> DataFrame:
    """Q5: ``is_new`` when the first created (least number) merged change in the repository merged at or after
    the window start, or there is none (``unknown`` never matches, so is new)."""
    first = (changes.filter(F.col("author").isNotNull())
             .groupBy("repo", F.col("author").alias("login"))
             .agg(F.min_by("merged_at", F.struct("number", "merged_at")).alias("first_merged_at")))
    joined = people.join(first, ["repo", "login"], "left")
    is_new = F.when(F.col("login") == "unknown", True).otherwise(
        F.coalesce(F.col("first_merged_at") >= F.col("from_at"), F.lit(True)))
    return joined.select(*WINDOW_KEYS, "login", is_new.alias("is_new"))


def rank_contributors(flagged: DataFrame, maintainer: str | None = None) -> DataFrame:
    """Q6: new before known, each by lower-cased login, the maintainer last."""
    is_m = (F.col("login") == maintainer) if maintainer else F.lit(False)
    keyed = flagged.withColumn("_m", is_m).withColumn("_known", ~F.col("is_new")) \
        .withColumn("_low", F.lower("login"))
    ranked = ordinal_within(keyed, WINDOW_KEYS, ["_m", "_known", "_low", "login"], name="rank")
    return ranked.drop("_m", "_known", "_low").withColumn("rank", F.col("rank").cast("bigint")) \
        .withColumn("mention", X.mention("login", "is_new"))


def contributor_sentence(ranked: DataFrame, windows: DataFrame) -> DataFrame:
    """Q7: the thanks sentence per window; windows without contributors keep a row."""
    agg = ranked.groupBy(*WINDOW_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("rank", "mention"))).alias("m"))
    m = F.transform(F.coalesce(F.col("m"), F.array()), lambda s: s["mention"])
    n = F.size(m)
    head = F.array_join(F.slice(m, 1, F.greatest(n - 1, F.lit(1))), ", ")
    sentence = (F.when(n == 0, F.lit("No contributors found."))
                .when(n == 1, F.concat(F.lit("Many thanks to "), F.element_at(m, 1),
                                       F.lit(" for their contributions.")))
                .otherwise(F.concat(F.lit("Many thanks to "), head, F.lit(", and "),
                                    F.element_at(m, -1), F.lit(" for their contributions."))))
    return (windows.select(*WINDOW_KEYS).join(agg, WINDOW_KEYS, "left")
            .select(*WINDOW_KEYS, sentence.alias("sentence")))


def changelog_document(changes: DataFrame, tags: DataFrame, owner: str = "org",
                       maintainer: str | None = None, ignored: list[str] | None = None,
                       head: DataFrame | None = None) -> DataFrame:
    """Q8: the whole changelog text per repository and window.

    Lines in a section are ordered by merge time and number. Sections with no
    lines are left out. Each window's document is one row, assembled from
    per-section blocks (partial aggregation per section first).
    """
    windows = release_windows(tags, head)
    in_window = prs_in_window(changes, windows)
    cat = categorize_changes(in_window, owner)
    blocks = cat.groupBy(*WINDOW_KEYS, "section", "position").agg(
        F.sort_array(F.collect_list(F.struct("merged_at", "number", "line"))).alias("lines"))
    blocks = blocks.select(*WINDOW_KEYS, "position", F.concat(
        F.lit("\n### "), F.col("section"), F.lit("\n"),
        F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), F.lit("\n")).alias("block"))
    body = blocks.groupBy(*WINDOW_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("position", "block"))).alias("b"))
    people = first_contributions(changes, contributors(in_window, ignored))
    sentence = contributor_sentence(rank_contributors(people, maintainer), windows)
    doc = F.concat(F.lit("## Changelog ("), F.col("from_tag"), F.lit(".."), F.col("to_tag"), F.lit(")\n\n"),
                   F.col("sentence"), F.lit("\n"),
                   F.coalesce(F.array_join(F.transform("b", lambda s: s["block"]), ""), F.lit("")))
    return sentence.join(body, WINDOW_KEYS, "left").select(*WINDOW_KEYS, doc.alias("changelog"))


def changelog_lines(changes: DataFrame, tags: DataFrame, owner: str = "org", maintainer: str | None = None,
                    ignored: list[str] | None = None, head: DataFrame | None = None) -> DataFrame:
    """Q8 as ordered line rows: ``repo, from_tag, to_tag, position, sub, merged_at, number, line``.

    Sorted by ``(repo, from_tag, to_tag, position, sub, merged_at, number)`` and written one row per
    line, they give the text of ``changelog_document``. No window's document is ever held as one
    value, so K1 can write a window of any size with a range-partitioned sort.
    """
    windows = release_windows(tags, head)
    in_window = prs_in_window(changes, windows)
    cat = categorize_changes(in_window, owner)
    people = first_contributions(changes, contributors(in_window, ignored))
    sentence = contributor_sentence(rank_contributors(people, maintainer), windows)
    heading = F.concat(F.lit("## Changelog ("), F.col("from_tag"), F.lit(".."), F.col("to_tag"), F.lit(")"))

    def placed(df, position, lines):
        """One row per ``(sub, line)`` of a heading; changes stand between them by time and number."""
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("sub"), line.alias("line")) for n, line in lines]))
        return df.select(*WINDOW_KEYS, position.cast("int").alias("position"), rows.alias("r")).select(
            *WINDOW_KEYS, "position", "r.sub", F.lit(None).cast("timestamp_ntz").alias("merged_at"),
            F.lit(None).cast("bigint").alias("number"), "r.line")

    titled = cat.select(*WINDOW_KEYS, "section", "position").distinct()
    changes_ = cat.select(*WINDOW_KEYS, F.col("position").cast("int").alias("position"), F.lit(1).alias("sub"),
                          "merged_at", "number", "line")
    return (placed(sentence, F.lit(-1), enumerate([heading, F.lit(""), F.col("sentence"), F.lit("")]))
            .unionByName(placed(titled, F.col("position"),
                                [(0, F.concat(F.lit("### "), F.col("section"))), (2, F.lit(""))]))
            .unionByName(changes_))


ORDER = [*WINDOW_KEYS, "position", "sub", "merged_at", "number"]


def changelog_pieces(changes: DataFrame, tags: DataFrame, owner: str = "org", maintainer: str | None = None,
                     ignored: list[str] | None = None, head: DataFrame | None = None) -> DataFrame:
    """Q7 and Q8 as text pieces: ``repo, from_tag, to_tag, position, sub, merged_at, number, text``.

    In the order of ``ORDER`` the pieces of a window, laid end to end, are the
    text of ``changelog_document``. The thanks sentence is one piece per
    contributor (``number`` is the rank), so neither a document nor a sentence
    is ever held as one value, whatever the size of a window.
    """
    windows = release_windows(tags, head)
    in_window = prs_in_window(changes, windows)
    cat = categorize_changes(in_window, owner)
    ranked = rank_contributors(first_contributions(changes, contributors(in_window, ignored)), maintainer)
    none = F.lit(None)

    def piece(df: DataFrame, position, sub: int, merged_at, number, text: Column) -> DataFrame:
        return df.select(*WINDOW_KEYS, position.cast("int").alias("position"), F.lit(sub).alias("sub"),
                         merged_at.cast("timestamp_ntz").alias("merged_at"), number.cast("bigint").alias("number"), text.alias("text"))

    window_ = windows.select(*WINDOW_KEYS)
    people = window_.join(ranked.groupBy(*WINDOW_KEYS).agg(F.count("*").alias("_n")), WINDOW_KEYS, "left")
    last = F.col("rank") == F.col("_n")
    thanks = F.concat(F.when(F.col("rank") == 1, "Many thanks to ").when(last, ", and ").otherwise(", "), F.col("mention"),
                      F.when(last, " for their contributions.").otherwise(""))
    title = F.concat(F.lit("## Changelog ("), F.col("from_tag"), F.lit(".."), F.col("to_tag"), F.lit(")\n\n"))
    first = F.lit(-1)
    return (piece(window_, first, 0, none, none, title)
            .unionByName(piece(people.filter("_n IS NULL"), first, 1, none, none, F.lit("No contributors found.")))
            .unionByName(piece(ranked.join(people, WINDOW_KEYS), first, 1, none, F.col("rank"), thanks))
            .unionByName(piece(window_, first, 2, none, none, F.lit("\n")))
            .unionByName(piece(cat.select(*WINDOW_KEYS, "section", "position").distinct(), F.col("position"), 0, none, none,
                               F.concat(F.lit("\n### "), F.col("section"), F.lit("\n"))))
            .unionByName(piece(cat, F.col("position"), 1, F.col("merged_at"), F.col("number"), F.concat("line", F.lit("\n")))))

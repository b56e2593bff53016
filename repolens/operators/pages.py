"""Issue pages to notebooks and scripts (Q31-Q33).

Pages: ``url, html`` (issue pages) or ``url, title, number, html`` for forum
posts (S11). HTML parsing is the only Python step (stdlib ``html.parser`` in
``mapInPandas``, one page in, its blocks out); titles, numbers, documents and
the existence check are native.
"""

from __future__ import annotations

import ast
import warnings
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text as X
from repolens.operators.ordinal import ordinal_within

BLOCKS_SCHEMA = "url string, post bigint, raw_title string, block bigint, code string"
ISSUE_CLASSES = ("highlight", "notranslate")


class _Blocks(HTMLParser):
    """Text of every element picked by ``pick(tag, classes)``, nesting kept."""

    def __init__(self, pick):
        super().__init__(convert_charrefs=True)
        self.pick = pick
        self.stack = []      # (tag, index of the block it opened or None)
        self.blocks = []
        self.open = []
        self.title = None
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        classes = []
        for k, v in attrs:
            if k == "class" and v:
                classes = v.split()
        idx = None
        if self.pick(tag, classes):
            idx = len(self.blocks)
            self.blocks.append([])
            self.open.append(idx)
        self.stack.append((tag, idx))
        if tag == "title" and self.title is None:
            self._in_title, self.title = True, []

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for _, idx in self.stack[i:]:
                    if idx is not None:
                        self.open.remove(idx)
                del self.stack[i:]
                break
        if tag == "title":
            self._in_title = False

    def handle_data(self, data):
        for idx in self.open:
            self.blocks[idx].append(data)
        if self._in_title:
            self.title.append(data)


def _issue_pick(tag, classes):
    return tag == "div" and any(c in ISSUE_CLASSES for c in classes)


def _forum_pick(tag, classes):
    return any("lang-" in c for c in classes)


def _parses(code: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        try:
            ast.parse(code)
            return True
        except (SyntaxError, ValueError):
            return False


def _extract(batches, pick):
    for pdf in batches:
        rows = []
        for url, post, html in zip(pdf["url"], pdf["post"], pdf["html"], strict=True):
            p = _Blocks(pick)
            p.feed(html or "")
            p.close()
            title = "".join(p.title) if p.title is not None else None
            kept = [c for c in ("".join(b) for b in p.blocks) if _parses(c)]
            rows.extend((url, post, title, i, c) for i, c in enumerate(kept))
        yield pd.DataFrame(rows, columns=["url", "post", "raw_title", "block", "code"])


def code_blocks(pages: DataFrame, kind: str = "issue") -> DataFrame:
    """Q31: code blocks that parse as Python, with title, number, repository and file name.

    Issue pages: ``div`` elements of class ``highlight`` or ``notranslate``;
    title ``<title> · Issue #<n> · <owner>/<repo>`` split at `` · ``. Forum
    posts: any element with a ``lang-`` class; title and number are columns.
    Pages with no block yield no rows.
    """
    pick = _issue_pick if kind == "issue" else _forum_pick
    post = F.col("post").cast("bigint") if "post" in pages.columns else F.lit(0).cast("bigint")
    blocks = pages.select("url", post.alias("post"), "html").mapInPandas(lambda it: _extract(it, pick), BLOCKS_SCHEMA)
    if kind == "issue":
        info = F.split("raw_title", " · ")
        blocks = blocks.select(
            "url", "block", "code",
            X.slug(F.try_element_at(info, F.lit(1))).alias("title"),
            F.get(F.split(F.try_element_at(info, F.lit(2)), "#"), F.lit(1)).alias("number"),
            F.concat(F.lit("dev_"), F.get(F.split(F.try_element_at(info, F.lit(3)), "/"), F.lit(1))).alias("repo"))
    else:
        # blocks of all posts of a thread, numbered in (post, block) order
        blocks = ordinal_within(blocks, ["url"], ["post", "block"], name="n") \
            .withColumn("block", F.col("n") - 1).drop("n")
        meta = pages.select("url", X.slug("title").alias("title"), F.col("number").cast("string")).distinct()
        blocks = blocks.join(meta, "url").select("url", "block", "code", "title", "number",
                                                 F.lit("discourse").alias("repo"))
    return blocks.withColumn("filename", F.concat_ws("_", "number", "title"))


def assemble_documents(blocks: DataFrame, as_of: str, prelude: str | None = None) -> DataFrame:
    """Q32: one notebook (JSON) and one script per page.

    Header with source and date; every code line keeps a newline; ``prelude``
    is put before block 1 when that block does not contain it; ``# %%
    Codeblock n`` marks. Cell ids are derived from the url and position.
    """
    code_lines = F.transform(F.split("code", "\n", -1), lambda ln: F.concat(ln, F.lit("\n")))
    cell = F.struct(F.lit("code").alias("cell_type"), F.create_map().alias("metadata"),
                    F.array().cast("array<string>").alias("outputs"), code_lines.alias("source"),
                    F.lit(None).cast("int").alias("execution_count"),
                    F.substring(F.sha2(F.concat_ws("#", "url", F.col("block").cast("string")), 256), 1, 32).alias("id"))
    first_code = F.col("code")
    if prelude:
        first_code = F.when((F.col("block") == 0) & ~F.col("code").contains(prelude),
                            F.concat(F.lit(prelude + "\n"), F.col("code"))).otherwise(F.col("code"))
    script_part = F.concat(F.lit("# %% Codeblock "), (F.col("block") + 1).cast("string"), F.lit("\n"),
                           first_code, F.lit("\n\n"))
    # one page is one group: its blocks are bounded by the page itself
    per_page = blocks.groupBy("url", "repo", "filename").agg(
        F.sort_array(F.collect_list(F.struct(
            "block", F.to_json(cell, {"ignoreNullFields": "false"}).alias("cell"), script_part.alias("part")))).alias("b"))
    info = F.concat(F.lit("Downloaded from "), F.col("url"), F.lit(f" at {as_of}."))
    header = F.struct(F.lit("markdown").alias("cell_type"), F.create_map().alias("metadata"),
                      F.array(info).alias("source"),
                      F.substring(F.sha2(F.col("url"), 256), 1, 32).alias("id"))
    notebook = F.struct(
        F.concat(F.array(F.to_json(header)), F.transform("b", lambda s: s["cell"]))
        .alias("cells"))
    notebook_json = F.concat(
        F.lit('{"cells":['), F.array_join(notebook["cells"], ","),
        F.lit('],"metadata":{"language_info":{"name":"python","pygments_lexer":"ipython3"}},'
              '"nbformat":4,"nbformat_minor":5}'))
    script = F.concat(F.lit("# "), info, F.lit("\n\n"), F.array_join(F.transform("b", lambda s: s["part"]), ""))
    return per_page.select("repo", "filename", "url", notebook_json.alias("notebook"), script.alias("script"),
                           F.size("b").cast("bigint").alias("blocks"))


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: tuple[str, ...] = ("repo", "filename")) -> DataFrame:
    """Q33: documents whose ``keys`` are not stored yet, each once (the least of several new ones)."""
    rest = [c for c in new.columns if c not in keys]
    absent = new.join(existing.select(*keys), [*keys], "left_anti")
    return absent.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_d")).select(
        *[c if c in keys else f"_d.{c}" for c in new.columns])


"""Main text of pages by nearest-URL page differencing, followed by a check of the markup.

1. A page is cut into text lines (blocks) with the part of the page they lie
   in. Lines travel as 64-bit hashes.
2. Distinct line sequences of a host in URL-path order get a skew-safe
   position; each is paired with the neighbour whose path shares the longer
   prefix. Copies inherit what their sequence gets.
3. The two line sequences are aligned by longest common subsequence
   (bit-parallel, whole pages); lines shared with an unlike page are template
   and go. Lines inside an article or main element stay: copies and quotations
   share those, too. Near copies (one page wholly shared, or more than half of the
   lines and three quarters of the characters of the longer page) say nothing
   of each other: a sequence between near copies meets the pages before and
   after its run of near copies. On a host that is one such run nothing can be
   told, and all lines stay.
4. The markup check takes what pairs cannot show (menus that differ from page
   to page, hosts with one page): lines in menus, headers, footers, sidebars,
   notices, adverts, forms and reader comments, and all lines outside the
   article where a page has one.

Page texts are shuffled once, compressed, to meet the positions that go.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.shared import picked, slices, texts
from repolens.operators.ordinal import ordinal_within

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|select|title|object)\b"
    r"(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead title tr ul""".split())
#: Open elements that a start tag ends when their end tags are left out; all blocks but these end a paragraph.
ENDS = {tag: frozenset(["p"]) for tag in BLOCKS - frozenset("html head body title frameset legend caption option optgroup".split())}
ENDS |= {tag: frozenset(f"{others} p".split()) for tags, others in (
    ("li", "li"), ("dt dd", "dt dd"), ("td th", "td th"), ("tr", "tr td th"), ("tbody thead tfoot", "tbody thead tfoot tr td th"))
    for tag in tags.split()}
ENDS |= {"option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and names of classes, ids or roles that say the same of any element.
ASIDE = frozenset("nav aside footer form menu dialog search button".split())
NAMES = frozenset("""ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments complementary
    consent contentinfo cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter
    notice notices notification pagination pager popup promo promoted promotion related respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe toolbar""".split())
#: Openings of names that tell of another element, such as has-sidebar.
ABOUT = frozenset("has no with without is not hide show".split())

MAIN, ARTICLE, OTHER, CHROME = 0, 1, 2, 3
#: Places of a run of near copies that one row is unfolded to.
RUN_PART = 1024
#: Parts in which pages meet the sequence that they repeat.
SALTS = 32


def named_aside(attributes: str) -> bool:
    for _, *values in ATTRIBUTE.findall(attributes):
        for name in "".join(values).split():
            parts = [p.lower() for p in PARTS.findall(name)]
            if parts and parts[0] not in ABOUT and not NAMES.isdisjoint(parts):
                return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space made single, each with the part of the page it lies in."""
    lines: list[tuple[str, int]] = []
    run: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements and the part of the page that they open
    opened: dict[str, int] = {}
    part, at = OTHER, 0

    def close() -> None:
        line = " ".join(html.unescape("".join(run)).split())
        if line:
            lines.append((line, part))
        run.clear()

    def end_implied(tag: str) -> None:
        """End the elements whose end tag may be left out before ``tag``, with the inline ones inside them."""
        nonlocal part
        ends, keep = ENDS.get(tag, ()), len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                keep = i
            elif stack[i][0] in BLOCKS:
                break
        while len(stack) > keep:
            opened[stack.pop()[0]] -= 1
        part = stack[-1][1] if stack else OTHER

    for m in MARKUP.finditer(page):
        run.append(page[at:m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1) and m.group(1).lower() not in ("svg", "math"):
                run.append(" ")
            continue
        if tag == "br":
            run.append(" ")
            continue
        attributes = m.group(4)
        if tag in VOID:
            if tag == "hr":
                close()
                end_implied(tag)
            continue
        block = tag in BLOCKS
        if block:
            close()
        if m.group(2):
            if opened.get(tag):
                close()
                name = ""
                while name != tag:
                    name, _ = stack.pop()
                    opened[name] -= 1
                part = stack[-1][1] if stack else OTHER
            continue
        if attributes.endswith("/"):
            continue
        if block:
            end_implied(tag)
        inner = part
        if part != CHROME:
            if tag in ASIDE or (tag == "header" and part == OTHER) or (
                    attributes and tag not in ("html", "body") and named_aside(attributes)):
                inner = CHROME
            elif tag == "article":
                inner = ARTICLE
            elif part != ARTICLE and (tag == "main" or "role" in attributes and re.search(
                    r"role\s*=\s*[\"']?main\b", attributes, re.I)):
                inner = MAIN
        if inner != part and not block:
            close()
        if block or inner != part:
            stack.append((tag, inner))
            opened[tag] = opened.get(tag, 0) + 1
            part = inner
    run.append(page[at:])
    close()
    return lines


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` that a longest common subsequence with ``b`` pairs (bit-parallel rows, traced back)."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first:len(a) - last], b[first:len(b) - last]
    found = [*range(first), *range(len(a) - last, len(a))]
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for v in x:  # zero bits of a row: where the length of the subsequence grows
        hit = row & places.get(v, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    i, j = len(x), len(y)
    while i and j:
        here = rows[i] >> j - 1 & 1
        if here:
            j -= 1  # no growth at this column
        elif not rows[i - 1] >> j - 1 & 1:
            i -= 1  # the growth was there before this line
        else:
            i, j = i - 1, j - 1
            found.append(first + i)
    return sorted(found)


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def alike(shared: list[int], a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> bool:
    """Whether two pages (hashes and lengths of their lines) are copies or near copies, by the positions that ``a`` shares."""
    if len(shared) == min(len(a[0]), len(b[0])):
        return True  # all of one page stands on the other
    lines, chars = max(len(a[0]), len(b[0])), max(sum(a[1]), sum(b[1]))
    return 2 * len(shared) > lines and 4 * sum(a[1][i] for i in shared) > 3 * chars


def template_positions(own: dict, others: list[dict | None]) -> list[int] | None:
    """Positions of the lines shared with the nearest unlike page by URL path; None where no page is unlike."""
    for other in sorted(filter(None, others), key=lambda p: -common_prefix(own["path"], p["path"])):
        found = shared_lines(own["lines"], other["lines"])
        if not alike(found, (own["lines"], own["sizes"]), (other["lines"], other["sizes"])):
            return found
    return None


def page_keys(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        F.xxhash64("page_id", "url", "html").alias("row_key"), "page_id", "url", "html",
        F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"))


def beyond_runs(placed: DataFrame, told: DataFrame) -> DataFrame:
    """row_key, copies, gone of the sequences of ``told`` without ``gone``, by the pages around their run of near copies.

    A run lies between two places where neighbours are unlike. Runs are narrow
    rows (host, low, high) until they are dealt in parts of ``RUN_PART`` places.
    """
    ends = told.groupBy("host").agg(F.max("nth").alias("last"))
    marks = (told.filter("unlike_next").select("host", "nth").unionByName(ends.select("host", F.col("last").alias("nth")))
             .unionByName(ends.select("host", F.lit(0).cast("long").alias("nth"))).distinct())
    marks = ordinal_within(marks, ["host"], ["nth"], "k")
    runs = marks.select("host", "k", F.col("nth").alias("low")).join(
        marks.select("host", (F.col("k") - 1).alias("k"), F.col("nth").alias("high")), ["host", "k"]).filter("high - low > 1")
    pages = placed.select("host", "nth", F.struct("path", "lines", "sizes").alias("page"))
    around = (runs.join(pages.select("host", F.col("nth").alias("low"), F.col("page").alias("one")), ["host", "low"], "left")
              .join(pages.select("host", (F.col("nth") - 1).alias("high"), F.col("page").alias("two")), ["host", "high"], "left")
              .withColumn("start", F.explode(F.sequence(F.col("low") + 1, F.col("high"), F.lit(RUN_PART).cast("long"))))
              .repartition("host", "start")
              .withColumn("nth", F.explode(F.sequence("start", F.least(F.col("start") + RUN_PART - 1, F.col("high"))))))
    paired = (told.filter("gone IS NULL").select("host", "nth").join(placed, ["host", "nth"])
              .join(around.select("host", "nth", "one", "two"), ["host", "nth"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            gone = [template_positions(row, [row["one"], row["two"]]) or [] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["row_key", "copies", "gone"])

    return paired.select("row_key", "copies", "path", "lines", "sizes", "one", "two").mapInArrow(
        compare, "row_key long, copies long, gone array<int>")


def differences(keyed: DataFrame) -> DataFrame:
    """row_key, gone: positions of the lines that a page shares with the nearest unlike page of its host."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 3):
            every, sizes = [], []
            for page in texts(batch.column(3)):
                lines = page_lines(page)
                every.append(np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t, _ in lines],
                                      np.uint64).view(np.int64))
                sizes.append([len(t) for t, _ in lines])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(every, pa.list_(pa.int64())),
                 pa.array(sizes, pa.list_(pa.int32()))], names=["row_key", "host", "path", "lines", "sizes"])

    hashed = (keyed.select("row_key", "host", "path", "html")
              .mapInArrow(hashes, "row_key long, host string, path string, lines array<long>, sizes array<int>")
              .dropDuplicates(["row_key"]).withColumn("sequence", F.xxhash64("lines"))).checkpoint(eager=True)
    distinct = (hashed.filter(F.size("lines") > 0).groupBy("host", "sequence").agg(
        F.min(F.struct("path", "row_key", "lines", "sizes")).alias("page"), F.count("*").alias("copies"))
        .select("host", "copies", "page.*"))
    placed = ordinal_within(distinct, ["host"], ["path", "row_key"], "nth")
    beside = placed.select("host", F.struct("path", "lines", "sizes").alias("page"), F.explode(F.array(
        F.struct((F.col("nth") + 1).alias("nth"), F.lit(0).alias("side")),
        F.struct((F.col("nth") - 1).alias("nth"), F.lit(1).alias("side")))).alias("to"))
    beside = beside.groupBy("host", F.col("to.nth").alias("nth")).agg(
        *[F.first(F.when(F.col("to.side") == i, F.col("page")), True).alias(name) for i, name in enumerate(("one", "two"))])
    paired = placed.join(beside, ["host", "nth"]).filter("one IS NOT NULL OR two IS NOT NULL")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, unlike = [], []
            for row in batch.to_pylist():
                gone.append(template_positions(row, [row["one"], row["two"]]))
                unlike.append(template_positions(row, [row["two"]]) is not None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], pa.array(gone, pa.list_(pa.int32())), pa.array(unlike, pa.bool_())],
                names=["row_key", "copies", "host", "nth", "gone", "unlike_next"])

    told = paired.select("row_key", "copies", "host", "nth", "path", "lines", "sizes", "one", "two").mapInArrow(
        compare, "row_key long, copies long, host string, nth long, gone array<int>, unlike_next boolean").checkpoint(eager=True)
    found = told.select("row_key", "copies", "gone").filter("gone IS NOT NULL")
    if not told.filter("gone IS NULL").isEmpty():
        found = found.unionByName(beyond_runs(placed, told))
    found = found.filter(F.size("gone") > 0)
    # a sequence that many pages repeat meets them in many tasks
    repeated = (found.filter("copies > 1").join(hashed.select("row_key", "host", "sequence"), "row_key")
                .select("host", "sequence", "gone", F.col("row_key").alias("own"),
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    copies = (hashed.select("row_key", "host", "sequence", F.pmod("row_key", F.lit(SALTS)).cast("int").alias("salt"))
              .join(repeated, ["host", "sequence", "salt"]).filter("row_key != own"))
    return found.select("row_key", "gone").unionByName(copies.select("row_key", "gone"))


def main_text(lines: list[tuple[str, int]], gone: set[int]) -> str:
    """The lines of the innermost part that the page has, without menus and the like and, outside MAIN and ARTICLE, shared lines."""
    left = [(text, part) for i, (text, part) in enumerate(lines)
            if part in (MAIN, ARTICLE) or (part == OTHER and i not in gone)]
    parts = {part for _, part in lines}
    wanted = ARTICLE if ARTICLE in parts else MAIN if MAIN in parts else OTHER
    return "\n".join(text for text, part in left if part == wanted)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    White space inside a block is one space, blocks are joined by a line feed
    in page order, character references are decoded. Null and empty html give
    an empty text; pages without article or main element give all lines that
    are neither shared with an unlike page beside them nor marked as menus and the like.
    Null urls are a host of their own; null page_ids stay null; repeated rows
    are extracted alike. An empty table gives no rows. Other columns are left
    out. Pages of any length are read whole.
    """
    import zlib

    keyed = page_keys(picked(pages, "page_id", "url", "html"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            out = []
            for page in texts(batch.column(3)):
                lines = page_lines(page)
                out.append(zlib.compress("\n".join(f"{part}{t}" if part != CHROME else f"{part}" for t, part in lines).encode(
                    "utf-8", "replace"), 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(out, pa.binary())],
                                             names=["row_key", "page_id", "url", "lines"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                joined = zlib.decompress(raw).decode("utf-8")
                lines = [(x[1:], int(x[0])) for x in joined.split("\n")] if joined else []
                out.append(main_text(lines, set(gone or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    lines = keyed.select("row_key", "page_id", "url", "html").mapInArrow(
        packed, "row_key long, page_id long, url string, lines binary")
    return lines.join(differences(keyed), "row_key", "left").select("page_id", "url", "lines", "gone").mapInArrow(
        finished, "page_id long, url string, text string, n_chars long")

"""Books without markup: from lines of pages to blocks, and from blocks to paragraphs and chapters.

Everything is partitioned by document, whose lines are those of one book. Rules that look back or ahead are windows in
reading order; runs of headings are islands of one paragraph offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, is_chapter_start, is_heading, word_count

# ---- fixed values ----
NOTE = r"^(?i:transcriber['’]s note|produced by)"
PAGE_NUMBER = r"^[0-9ivxlcIVXLC\s\-–—.]+$"
EDGE_LINES, EDGE_PAGES, EDGE_SHARE = 2, 3, 0.3
SHORT_HEADING, SHORT_LINE, USUAL_WIDTH = 0.7, 0.75, 60
MOST_SUBTITLES, FRONT_SHARE, CHAPTERS_OF_A_BOOK = 2, 0.03, 3
# ---- end of fixed values ----

ORDER = ["page", "line"]


def blocks_of_lines(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """doc, i, text: lines (doc, page, line, raw) joined to blocks.

    Running heads and feet (which stand, but for digits, among the outer lines of many pages) and page numbers go, as does
    what lies outside the markers begin and end (patterns), where begin occurs. A block starts after an empty line, at an
    indent, at a heading and after one, and after a short line that ends a sentence. A hyphen at a line's end closes before a
    small letter. Documents without lines have no blocks.
    """
    at, c = F.struct(*ORDER), F.col
    whole, page, read = Window.partitionBy("doc"), Window.partitionBy("doc", "page", "empty"), Window.partitionBy("doc").orderBy(*ORDER)
    told = lines.withColumn("text", clean(c("raw"))).withColumn("empty", c("text") == "").withColumn("mark", F.regexp_replace(F.lower("text"), "[0-9]+", "#"))
    outer = F.least(F.row_number().over(page.orderBy("line")), F.row_number().over(page.orderBy(F.desc("line")))) <= EDGE_LINES
    told = told.withColumn("edge", F.when(outer & ~c("empty"), c("page"))).withColumn("begin", F.min(F.when(F.rlike("text", F.lit(begin)), at)).over(whole))
    told = told.withColumn("end", F.min(F.when(F.rlike("text", F.lit(end)) & (at > c("begin")), at)).over(whole)).withColumn("pages", F.max("page").over(whole) - F.min("page").over(whole) + 1)
    told = told.withColumn("seen", F.size(F.collect_set("edge").over(Window.partitionBy("doc", "mark"))))
    running = ~c("empty") & (c("seen") >= EDGE_PAGES) & (c("seen") >= EDGE_SHARE * c("pages"))
    inside = (c("begin").isNull() | (at > c("begin"))) & (c("end").isNull() | (at < c("end")))
    body = told.where(inside & ~running & ~F.rlike("text", F.lit(PAGE_NUMBER))).withColumn("width", F.length("text"))
    body = body.withColumn("usual", F.coalesce(F.median(F.when(c("width") > 20, c("width"))).over(whole), F.lit(USUAL_WIDTH)))
    body = body.withColumn("heading", is_heading(c("text")) & (c("width") < SHORT_HEADING * c("usual")))
    body = body.withColumn("last", c("empty") | c("heading") | ((c("width") < SHORT_LINE * c("usual")) & F.rlike("text", F.lit('[.!?"”]$'))))
    breaks = c("heading") | F.rlike("raw", F.lit(r"^(?:  |\t)")) | F.coalesce(F.lag("last").over(read), F.lit(True))
    body = body.withColumn("breaks", breaks.cast("int")).withColumn("i", F.sum("breaks").over(read)).where("NOT empty")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*ORDER, "text"))), lambda x: x["text"]), "\n")
    text = F.translate(F.regexp_replace(joined, r"-\n(?=\p{Ll})", ""), "\n", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\b([A-Z]) (?=[A-Z]{2,}\b)", "$1"), r"(?<=[A-Z]{2}) (?=[.,;:])", "")  # small capitals
    return body.groupBy("doc", "i").agg(text.alias("text"))


def books_of_blocks(blocks: DataFrame) -> DataFrame:
    """doc, paragraphs, chapters (title, paragraph_offset) of blocks (doc, i, text).

    Blocks without a letter go. A transcriber's note goes, and if it is a heading or a few words, all up to the next heading.
    Headings without text between them are one chapter with up to MOST_SUBTITLES subtitles, but a chapter's start always
    begins one. Where a book has several chapter starts, a short front before the first with text goes.
    """
    c, whole, read = F.col, Window.partitionBy("doc"), Window.partitionBy("doc").orderBy("i")
    told = blocks.select("doc", "i", clean(c("text")).alias("text")).where(F.rlike("text", F.lit("[A-Za-z]")))
    told = told.select("*", F.rlike("text", F.lit(NOTE)).alias("note"), is_heading(c("text")).alias("heading"), word_count(c("text")).alias("words"))
    skipping = F.last(F.when(c("note"), c("heading") | (c("words") < 6)).when(c("heading"), False), ignorenulls=True).over(read)
    told = told.withColumn("skip", F.coalesce(skipping, F.lit(False))).where("NOT note AND (heading OR NOT skip)")
    told = told.select("doc", "i", "text", "heading", F.when(c("heading"), 0).otherwise(1).alias("one"), F.when(c("heading"), 0).otherwise(c("words")).alias("told"), (c("heading") & is_chapter_start(c("text"))).alias("start"))
    told = told.withColumn("offset", (F.sum("one").over(read) - c("one")).cast("int")).withColumn("before", F.sum("told").over(read) - c("told"))

    # Islands of headings: those of one offset; in them, those from one chapter's start on; in these, some at a time.
    run, island = ["doc", "heading", "offset"], ["doc", "heading", "offset", "group"]
    told = told.withColumn("group", F.sum(c("start").cast("int")).over(Window.partitionBy(*run).orderBy("i"))).withColumn("place", F.row_number().over(Window.partitionBy(*island).orderBy("i")) - 1)
    told = told.withColumn("part", F.floor(c("place") / (MOST_SUBTITLES + 1)))
    titles = F.collect_list("text").over(Window.partitionBy(*island, "part").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    told = told.withColumn("title", F.when(c("heading"), F.array_join(titles, " · "))).withColumn("chapter", c("heading") & (c("place") % (MOST_SUBTITLES + 1) == 0))
    final = F.max(F.when(c("chapter"), c("i"))).over(Window.partitionBy("doc", "offset"))
    told = told.withColumn("filled", c("chapter") & (c("i") == final) & (c("offset") < F.sum("one").over(whole)))

    first = F.min(F.when(c("start") & c("filled"), F.struct("i", "offset", "before"))).over(whole)
    told = told.withColumn("first", first).withColumn("starts", F.sum((c("start") & c("chapter")).cast("int")).over(whole)).withColumn("all", F.sum("told").over(whole))
    front = (c("starts") >= CHAPTERS_OF_A_BOOK) & (c("first.before") < FRONT_SHARE * c("all"))
    told = told.withColumn("cut", F.when(front, c("first"))).where("cut IS NULL OR i >= cut.i").withColumn("offset", c("offset") - F.coalesce("cut.offset", F.lit(0)))
    kept = lambda which, *fields: F.sort_array(F.collect_list(F.when(which, F.struct("i", *fields))))
    both = told.groupBy("doc").agg(kept(~c("heading"), "text").alias("ps"), kept(c("chapter"), "title", "offset").alias("cs"))
    return both.select("doc", F.transform("ps", lambda x: x["text"]).alias("paragraphs"), F.transform("cs", lambda x: F.struct(x["title"].alias("title"), x["offset"].alias("paragraph_offset"))).alias("chapters"))

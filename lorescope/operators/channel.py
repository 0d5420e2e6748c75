"""Support channels: tables of contents, messages and threads (SRC-7..14, CH-1..16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import original_title
from .graph import checkpointed

TITLE_CHARS, MAX_LINES = 500, 500
#: Beginnings of lines that carry no content (CH-3).
NOISE = r"(?i)^\s*(?:from:|to:|sent:|subject:|to unsubscribe|unsubscribe|for additional commands)"


def refresh_toc(known: DataFrame, seen: DataFrame) -> DataFrame:
    """SRC-7: sections known before and those seen now, in order; the last known one is opened again."""
    last = known.agg(F.max("position").alias("last"))
    old = known.crossJoin(F.broadcast(last)).withColumn("downloaded", F.col("downloaded") & (F.col("position") < F.col("last"))).drop("last")  # one row
    new = seen.join(known, "url", "left_anti").withColumn("_n", F.row_number().over(Window.orderBy("position")))
    fresh = new.crossJoin(F.broadcast(last)).select("url", (F.coalesce("last", F.lit(-1)) + F.col("_n")).cast("int").alias("position"), F.lit(False).alias("downloaded"))
    return old.select("url", "position", "downloaded").unionByName(fresh)


def toc_entries(sections: DataFrame, reverse: bool = False) -> DataFrame:
    """SRC-7: entry index 1000 * section + i.  sections: position, urls."""
    urls = F.reverse("urls") if reverse else F.col("urls")
    return sections.select("position", F.posexplode(urls).alias("i", "url")).withColumn("entry", F.col("position") * 1000 + F.col("i"))


def toc_view(entries: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """SRC-13: entries, downloaded ones, and the last index before the first that isn't."""
    first_open = F.min(F.when(~F.col("downloaded"), F.col("entry")))
    return entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("downloaded").alias("n_downloaded"), F.coalesce(first_open - 1, F.max("entry")).alias("last_contiguous"))


def to_download(entries: DataFrame, start: int, end: int, force: bool = False) -> DataFrame:
    """SRC-14: entries of [start, end) that aren't there yet."""
    inside = (F.col("entry") >= start) & (F.col("entry") < end)
    return entries.filter(inside if force else inside & ~F.col("downloaded"))


def clean_author(c: str) -> Column:
    """CH-2: what stands before an address in angle brackets."""
    return F.trim(F.substring_index(F.col(c), "<", 1))


def people(messages: DataFrame, author: str = "author") -> DataFrame:
    """CH-2: one row for each nickname, without locks."""
    return messages.select(clean_author(author).alias("nickname")).filter("nickname <> ''").distinct().withColumn("person_id", F.xxhash64("nickname"))


def clean_title(c: str) -> Column:
    """CH-1: white space collapsed, at most 500 characters."""
    return F.substring(F.trim(F.regexp_replace(F.col(c), r"\s+", " ")), 1, TITLE_CHARS)


def content_lines(c: str) -> Column:
    """CH-3: lines without carriage returns, tabs as blanks, angle brackets unescaped, mail headers and footers left out."""
    text = F.replace(F.replace(F.translate(F.col(c), "\t\r", " "), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NOISE))


def skip_message(paragraphs: str) -> Column:
    """CH-4: over 500 lines in all paragraphs (array of arrays of lines)."""
    return F.aggregate(F.col(paragraphs), F.lit(0), lambda n, p: n + F.size(p)) > MAX_LINES


def assign_threads(messages: DataFrame, channel: str = "channel", title: str = "title", order: tuple[str, ...] = ("msg_date", "message_id")) -> DataFrame:
    """CH-10: messages of a channel with the same title, case and "re:" aside, are one thread, named by its first message in (date, id) order.

    The first message comes from a grouped minimum and is joined back, so a title that a third of all messages have is pre-aggregated.
    """
    keyed = messages.withColumn("thread_title", F.lower(original_title(title)))
    first = keyed.groupBy(channel, "thread_title").agg(F.min(F.struct(*order)).alias("_f")).select(channel, "thread_title", F.col(f"_f.{order[-1]}").alias("thread_id"))
    return keyed.join(first, [channel, "thread_title"])


def index_threads(messages: DataFrame, order: tuple[str, ...] = ("msg_date", "message_id")) -> DataFrame:
    """CH-12: message_index from 0 by date within each thread.

    Messages are sorted by ranges of (thread, date), so a thread that a third of all messages belong to is spread over
    partitions; an index is the number of the thread's messages in the ranges before, plus the rank in its own.
    """
    ranged = checkpointed(messages.repartitionByRange("thread_id", *order).withColumn("_part", F.spark_partition_id()))
    own = ["thread_id", "_part"]
    ahead = Window.partitionBy("thread_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a thread
    before = ranged.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).select(*own, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    return ranged.withColumn("_rank", rank).join(before, own).withColumn("message_index", (F.col("_before") + F.col("_rank")).cast("int")).drop("_part", "_rank", "_before")


def thread_table(messages: DataFrame) -> DataFrame:
    """CH-8, CH-12: thread_id, title of the first message, first and last date, messages."""
    return messages.groupBy("thread_id").agg(F.min_by("title", F.struct("msg_date", "message_id")).alias("title"), F.min("msg_date").alias("first_date"), F.max("msg_date").alias("last_date"), F.count(F.lit(1)).alias("n_messages"))


def drop_repeated_title_refs(refs: DataFrame, messages: DataFrame) -> DataFrame:
    """CH-12: title references (negative index) of messages other than a thread's first are left out."""
    later = messages.filter("message_index > 0").select("message_id")
    return refs.filter("index >= 0").unionByName(refs.filter("index < 0").join(later, "message_id", "left_anti"))


def set_global_context(refs: DataFrame, messages: DataFrame) -> DataFrame:
    """CH-13: the global context of a message's references is its thread."""
    return refs.drop("global_id").join(messages.select("message_id", F.col("thread_id").alias("global_id")), "message_id", "left")


def between(messages: DataFrame, start, end, column: str = "msg_date") -> DataFrame:
    """CH-15: half-open range of dates."""
    return messages.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def traces_json(snippets: DataFrame) -> DataFrame:
    """CH-14: one JSON array [url, text] for each stack trace."""
    return snippets.filter("language = 'jx'").select(F.to_json(F.array("url", "snippet_text")).alias("value"))


def references_with_links(refs: DataFrame, links: DataFrame) -> DataFrame:
    """CH-16: every reference with its best link, null if it has none, and its number of links."""
    best = links.filter("index = 0").select("ref_id", "element_id")
    n = links.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_links"))
    return refs.join(best, "ref_id", "left").join(n, "ref_id", "left").fillna(0, ["n_links"])


# -- dates (CH-9) -------------------------------------------------------------------


def _stamp(c: Column, pattern: str, year: int, month: int, day: int, hour: int, minute: int, half: int | None = None) -> Column:
    from ..functions.text import month_number

    g = lambda i: F.regexp_extract(c, pattern, i)
    num = lambda i: F.try_to_number(g(i), F.lit("9999")).cast("int")
    m = F.coalesce(month_number(F.substring(g(month), 1, 3)), num(month))
    h = num(hour)
    if half is not None:
        late = F.lower(g(half)) == "pm"
        h = F.when(late & (h < 12), h + 12).when(~late & (h == 12), F.lit(0)).otherwise(h)
    return F.when(c.rlike(pattern), F.make_timestamp_ntz(num(year), m, num(day), h, num(minute), F.lit(0)))


def message_date(c: str, layout: str) -> Column:
    """CH-9: the date of a message header; twelve at night is hour 0.  Layouts: mail ("Mon, 05 Jan 2009 21:07:11"), board ("Mon Jan 05, 2009 9:07 pm"), forum ("Mon, 05 January 2009 21:07"), tracker ("2009-01-05 21:07"), news ("2009-01-05 21:07:11 GMT")."""
    c = F.col(c)
    if layout in ("mail", "forum"):
        return _stamp(c, r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\s+(\d{1,2}):(\d{2})", 3, 2, 1, 4, 5)
    if layout == "board":
        return _stamp(c, r"([A-Za-z]{3})\s+(\d{1,2}),\s+(\d{4})\s+(\d{1,2}):(\d{2})\s*([ap]m)", 3, 1, 2, 4, 5, 6)
    return _stamp(c, r"(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2})", 1, 2, 3, 4, 5)

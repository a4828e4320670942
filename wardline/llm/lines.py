"""Line dedup by site-relative frequency. Native only.

Rows are pages of hosts. For every host, a line's ratio is the share of the host's pages that contain it; lines above
``max_ratio`` on at least ``min_pages`` pages are boilerplate and are dropped from all pages of the host. With
``long_words`` the ratio to exceed falls in proportion to a line's words, from ``max_ratio`` for a line without any to zero
for lines of so many words and more: what is long and stands on ``min_pages`` pages is no coincidence. Lines travel as
two 64-bit hashes with partial counts, never as text.

The lines to drop are counted. Up to ``small_table`` of them are broadcast, every host's list dealt over slots by hash, and a
line is looked up in its slot only. More of them never become one list: rows get a number, their line hashes meet the lines
to drop in a join whose hot lines are broadcast (`operators.lookup`), and a row gets back the hashes of its own lines alone.

Defined results: a null or empty text has no lines and stays as it is; a null host is a host of its own; blank lines are
no lines and always stay; a line repeated in a page counts once. A page all of whose lines are boilerplate is a copy of
other pages and no frame around something, so it keeps its text and is left to near-duplicate detection. With
``max_lost`` below 1 so does a near copy, whose lines are shared by copies rather than by the host: lines on more than
``frame_ratio`` of the host's pages are its frame and go whatever their share; a page that would lose more than ``max_lost``
of the characters of its other shown lines keeps its text, and so does one of which less than ``least_left`` would be left.
Repeated rows are pages of their own; a very long text is one page and its lines are looked up like any other. Other columns
are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.lookup import attach_key_facts
from ..session import materialize

SHOWN = r"[^\x20\x09-\x0D]"  # a line with such a character is no blank line
SMALL_TABLE = 500_000  # lines to drop (16 bytes each) up to which their lists are broadcast
#: What is not shown in a page, the tags that end a line, and any other tag.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
LINE_TAG = r"(?i)</?(p|br|li|ul|ol|div|h[1-6]|tr|table|nav|article|section|header|footer|title|body|head|html)\b[^>]*>"
ANY_TAG = r"<[^>]*>"
WORD = r"[^\x20\x09-\x0D]+"
SLOT_KEYS = 16  # lines to drop in a slot of a host's list, on average at most
HOT_LINE = 1000  # a line on fewer pages is never hot


@dataclass(frozen=True)
class Settings:
    max_ratio: float = 0.1
    min_pages: int = 3
    long_words: int | None = None  # words of a line from which min_pages alone decides; without it all lines share max_ratio
    max_lost: float = 1.0  # share of a page's own and copied characters beyond which it is a copy and keeps its text
    frame_ratio: float = 0.5  # lines on more of a host's pages are its frame, whatever max_lost
    least_left: float = 0.1  # a page of which less would be left is a copy too, if max_lost is below 1


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def page_text(html: Column) -> Column:
    """Lines of shown text of a page: block tags end lines, other tags go, runs of blanks become one."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), LINE_TAG, "\n"), ANY_TAG, "")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "), r" ?\n[ \n]*", "\n")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _shown(text: Column) -> Column:
    return F.filter(_lines(text), lambda line: line.rlike(SHOWN))


def _characters(lines: Column) -> Column:
    """Characters of those lines that are not blank."""
    return F.length(F.array_join(F.filter(lines, lambda line: line.rlike(SHOWN)), ""))


def boilerplate(pages: DataFrame, host: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """host, key, pages, ratio of the lines to drop."""
    key_of = lambda line: F.struct(_key(line).alias("key"), _words(line, settings).alias("words"))
    # Lines are made distinct as strings, which a hash set does; structs would be compared pair by pair.
    keys = pages.select(F.col(host).alias("host"), F.transform(F.array_distinct(_shown(F.col(text))), key_of).alias("keys"))
    totals = keys.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    # inline_outer: for inline the optimizer would filter on the size of the keys first and compute them once more for that.
    exploded = keys.select("host", F.inline_outer("keys")).filter(F.col("key").isNotNull())
    counts = exploded.groupBy("host", "key", "words").agg(F.count(F.lit(1)).alias("pages"))
    counts = counts.filter(F.col("pages") >= settings.min_pages)
    totals = totals.select(F.col("host").alias("_host"), "total")
    rated = counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).withColumn("ratio", F.col("pages") / F.col("total"))
    limit = F.lit(settings.max_ratio)
    if settings.long_words:
        limit *= F.greatest(1 - F.col("words") / settings.long_words, F.lit(0.0))
    return rated.filter(F.col("ratio") > limit).select("host", "key", "pages", "ratio")


def _words(line: Column, settings: Settings) -> Column:
    return F.regexp_count(line, F.lit(WORD)) if settings.long_words else F.lit(0)


def _marked(found: DataFrame, settings: Settings) -> DataFrame:
    """host, key, frame: the lines to drop, and whether they belong to the host's frame."""
    return found.select("host", "key", (F.col("ratio") > settings.frame_ratio).alias("frame"))


def _slotted(found: DataFrame) -> DataFrame:
    """host, _drop, _frame: the keys of every host, dealt over slots by their hash; and those of its frame."""
    keys = F.count(F.lit(1)).over(Window.partitionBy("host"))
    sized = found.select("host", "key", "frame", F.ceil(keys / SLOT_KEYS).cast("int").alias("_slots"))
    keyed = sized.select("host", _slot(F.col("key"), F.col("_slots")).alias("slot"), "key", "frame")
    none = F.lit(None).cast(found.schema["key"].dataType).alias("key")
    every = sized.groupBy("host").agg(F.first("_slots").alias("_slots"))
    empty = every.select("host", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)).alias("slot"), none, F.lit(False).alias("frame"))
    of_frame = F.collect_list(F.when(F.col("frame"), F.col("key")))
    slots = keyed.union(empty).groupBy("host", "slot").agg(F.collect_list("key").alias("keys"), of_frame.alias("frames"))
    ordered = F.array_sort(F.collect_list(F.struct("slot", "keys", "frames")))
    lists = slots.groupBy("host").agg(ordered.alias("slots"))
    return lists.select(
        "host",
        F.transform("slots", lambda x: x["keys"]).alias("_drop"),
        F.transform("slots", lambda x: x["frames"]).alias("_frame"),
    )


def _slot(key: Column, slots: Column) -> Column:
    return F.pmod(key["a"], slots).cast("int")


def _by_broadcast(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows with the slots of their host's lists."""
    return rows.join(F.broadcast(_slotted(marked)), F.col("_host").eqNullSafe(F.col("host")), "left").drop("host")


def _by_lines(rows: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """Rows with the slots of those of their own lines that are to be dropped.

    A line of a host may stand on a third of all pages; such lines are few, and `attach_key_facts` broadcasts them.
    """
    numbered = materialize(rows.withColumn("_number", F.monotonically_increasing_id()), "pages")
    own = numbered.select("_number", "_host", F.explode_outer(F.transform(F.array_distinct(_shown(F.col("_text"))), _key)).alias("key"))
    own = own.filter(F.col("key").isNotNull())
    parts = lambda host: F.concat_ws(":", F.col("key.a"), F.col("key.b"), F.xxhash64(host), host)
    own = own.select("_number", "key", parts(F.col("_host")).alias("_line"))
    facts = found.select(parts(F.col("host")).alias("_line"), (F.col("ratio") > settings.frame_ratio).alias("frame"), F.col("pages").alias("copies"))
    hits = attach_key_facts(own, facts, "_line", F.struct("_number", "key"), hot_floor=HOT_LINE).filter("frame is not null")
    lists = _slotted(hits.select(F.col("_number").alias("host"), "key", "frame"))
    return numbered.join(lists, F.col("_number") == F.col("host"), "left").drop("_number", "host")


def drop_boilerplate(
    pages: DataFrame, host: Column, text: str, settings: Settings = Settings(), *, small_table: int = SMALL_TABLE
) -> DataFrame:
    """The pages with their columns; ``text`` without the host's boilerplate lines."""
    names = pages.columns
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), host.alias("_host"), F.col(f"`{text}`").alias("_text"))
    found = materialize(boilerplate(rows, "_host", "_text", settings), "boilerplate")
    if found.count() <= small_table:
        joined = _by_broadcast(rows, _marked(found, settings))
    else:
        joined = _by_lines(rows, found, settings)
    among = lambda slots, key: F.array_contains(F.get(F.col(slots), _slot(key, F.size(slots))), key)
    without = lambda slots: F.filter(_lines(F.col("_text")), lambda line: ~line.rlike(SHOWN) | ~among(slots, _key(line)))
    listed = F.col("_drop").isNotNull()
    changed = joined.withColumn("_kept", F.when(listed, without("_drop")))
    some_left = F.exists("_kept", lambda line: line.rlike(SHOWN))
    if settings.max_lost < 1:
        left, unframed = _characters(F.col("_kept")), _characters(F.when(listed, without("_frame")))
        some_left &= left >= (1 - settings.max_lost) * unframed
        some_left &= left >= settings.least_left * _characters(_lines(F.col("_text")))
    cleaned = F.when(some_left, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    out = {c: F.col("_row").getField(c) for c in names}
    return changed.select(*[(cleaned if c == text else value).alias(c) for c, value in out.items()])

"""Text operators: cleaning, headlines, caps, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Phrases of challenge pages (fixed values).
BLOCK_MARKERS = (
    "you've been blocked by network security",
    "blocked by network security",
    "verify you are human",
    "checking your browser",
    "access denied",
    "just a moment...",
    "enable javascript and cookies to continue",
)


def normalize_name(name: str) -> str:
    """NFKC, case-folded, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", name).casefold().split())


@pandas_udf(StringType())
def _other_names(s):  # type: ignore[no-untyped-def]
    return s.map(lambda x: None if x is None else normalize_name(x))


def normalized_names(column: Column) -> Column:
    """normalize_name as a column: ASCII names stay in the JVM, an Arrow UDF gets the others and nulls."""
    ascii_ = column.rlike(r"^[\x00-\x7f]*$")
    plain = F.trim(F.regexp_replace(F.lower(column), r"[\s\x1c-\x1f]+", " "))
    return F.when(ascii_, plain).otherwise(_other_names(F.when(~ascii_, column)))


#: Ends of lines: those of Java's \\R and the separators of files, groups and records.
LINE = r"\r\n|[\n\x0B\f\r\x85\u2028\u2029\x1c-\x1e]"


def clean_lines(column: Column) -> Column:
    """H1 as an array: lines with single spaces, empty ones left out."""
    squeezed = F.regexp_replace(F.regexp_replace(column, LINE, "\n"), r"[ \t]+", " ")
    lines = F.transform(F.split(squeezed, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def clean_text(column: Column) -> Column:
    return F.array_join(clean_lines(column), "\n")


def without_embedded_lists(column: Column) -> Column:
    """H9: drops recommendation lists between their two marker lines (fixed pattern)."""
    return F.regexp_replace(column, r"(?m)^(?:Recommended Stories\n)?list of \d+ items\n[\s\S]*?^end of list$\n?", "")


def headline(column: Column, most: int = 500) -> Column:
    """One line without the last " | Site" part."""
    one = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.left(F.regexp_replace(one, r" \| (?!.* \| ).*$", ""), F.lit(most))


def blocked(title: Column, body: Column) -> Column:
    """H7: challenge pages by their title, or by the start of a short body."""
    start = F.lower(F.left(body, F.lit(2500)))
    has = lambda text: F.exists(F.array(*[F.lit(m) for m in BLOCK_MARKERS]), lambda m: F.contains(text, m))
    return F.coalesce(has(F.lower(title)), F.lit(False)) | F.coalesce((F.length(start) < 2000) & has(start), F.lit(False))


def capped_segments(texts: Column, budget: int) -> Column:
    """(kept texts, truncated): each kept text costs its length and two; the one that overflows is clipped."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(budget).alias("left"), F.lit(False).alias("cut"))

    def step(acc: Column, text: Column) -> Column:
        clip = F.left(text, F.greatest(acc["left"], F.lit(0)))
        open_ = acc["left"] > 0
        over = open_ & (F.length(text) > acc["left"])
        use = open_ & (clip != "")
        return F.struct(
            F.when(use, F.concat(acc["kept"], F.array(clip))).otherwise(acc["kept"]).alias("kept"),
            F.when(use, acc["left"] - F.length(clip) - 2).otherwise(acc["left"]).alias("left"),
            (acc["cut"] | over).alias("cut"),
        )

    return F.aggregate(texts, start, step, lambda acc: F.struct(acc["kept"].alias("kept"), acc["cut"].alias("truncated")))


def parse_time(column: Column) -> Column:
    """H3: ISO 8601 or RFC 2822 with a zone, as a timestamp; without a zone null. `time_warning` says why one is null."""
    zone = column.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2}|GMT|UTC)\s*$")
    mail = F.regexp_replace(F.regexp_replace(F.trim(column), r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UTC)$", "+0000")
    return F.when(zone, F.coalesce(F.try_to_timestamp(F.trim(column)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))))


def time_warning(column: Column) -> Column:
    """H3: what is noted where a time gives none."""
    local = F.try_to_timestamp(column).isNotNull() & ~column.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2}|GMT|UTC)\s*$")
    unread = F.concat(F.lit("Unparsed publication time: "), F.left(column, F.lit(80)))
    return F.when((column == "") | parse_time(column).isNotNull(), None).when(local, "Publication time has no timezone; retained as raw metadata").otherwise(unread)

"""Removal of repeated multi-line chunks, in DataFrame expressions only.

Lines are hashed and a rolling hash over two line hashes chooses chunk ends: those of the two lines before a gap, or of the
two after it, so that a passage can begin and end a chunk by its own lines. An inserted or deleted line moves only the
chunks around it. Every text is cut once for each of ``FACTORS``: a passage that one cut does not follow is
likely to be a whole chunk of another. A line of ``LONG_LINE`` words or more is a chunk of its own in every cut. Chunks of
at least ``MIN_LINES`` lines, and long lines, whose bytes occur more than once in all documents are kept at their first
place, by (id, mark of the text, first line), and their lines removed everywhere else. All places are judged on the
input, and a line goes only where an earlier place holds the same line, so one copy of each line is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import stage

AVERAGE = 3  # one pair of lines in this many ends a chunk behind it, and one in this many before it
MIN_LINES = 2
LONG_LINE = 50  # words, counted as spaces and one
FACTORS = (31, 101, 1009)  # weight of the line before in the rolling hash of each cut
SHIFT = 8  # low bits of the rolling hash that do not choose


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often a later lambda reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _lines(text: Column) -> Column:
    """The lines of a text; a null one has one empty line, as an empty one has."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def chunked(df: DataFrame, text: str, average: int = AVERAGE, min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` with ``__lines`` and ``__chunks`` (array of first line, number of lines) of every row, those of all cuts in
    one array, without the chunks that are too short to be judged.

    A text of any length is cut in one pass over its lines for each cut.
    """
    lines = _held(df, __lines=_lines(F.col(text)))
    spaces = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    hashed = _held(lines, __hashes=F.transform("__lines", lambda line: F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")),
                   __long=F.transform("__lines", lambda line: spaces(line) + 1 >= LONG_LINE))
    none = F.lit(0).cast("long")
    before = F.concat(F.array(none), F.slice("__hashes", F.lit(1), F.size("__hashes") - 1))
    after = F.concat(F.slice("__long", F.lit(2), F.size("__long")), F.array(F.lit(True)))  # the last line ends a chunk
    ahead = [F.slice("__hashes", F.lit(k), F.size("__hashes")) for k in (2, 3)]  # null past the last line
    zipped = _held(hashed, __zip=F.arrays_zip(F.col("__hashes").alias("now"), before.alias("before"), ahead[0].alias("then"),
                                              ahead[1].alias("last"), F.col("__long").alias("long"), after.alias("next")))

    def ends(factor: int) -> Column:
        rolled = lambda one, two: F.shiftright(two + factor * one, SHIFT) % average
        chosen = lambda x: (rolled(x["before"], x["now"]) == 0) | (rolled(x["then"], x["last"]) == 1)
        marked = F.transform("__zip", lambda x, i: F.when(x["long"] | x["next"] | chosen(x), i + 1))
        return F.filter(marked, lambda e: e.isNotNull())

    cut = _held(zipped, **{f"__ends{k}": ends(factor) for k, factor in enumerate(FACTORS)})

    def chunks(name: str) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(name, F.lit(1), F.size(name) - 1))
        return F.transform(F.arrays_zip(F.col(name).alias("stop"), starts.alias("first")),
                           lambda x: F.struct(x["first"].alias("first"), (x["stop"] - x["first"]).alias("n")))

    every = F.array_distinct(F.concat(*[chunks(f"__ends{k}") for k in range(len(FACTORS))]))
    judged = F.filter(every, lambda x: (x["n"] >= min_lines) | F.get("__long", x["first"]))
    return _held(cut, __chunks=judged).drop("__hashes", "__long", "__zip", *[f"__ends{k}" for k in range(len(FACTORS))])


def _joined(x: Column) -> Column:
    return F.array_join(F.slice("__lines", x["first"] + 1, x["n"]), "\n")


def repeated_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text", average: int = AVERAGE,
                    min_lines: int = MIN_LINES) -> DataFrame:
    """``__id``, ``__mark``, ``__first``, ``__n`` (lines) of every chunk occurrence to remove.

    Hashes only narrow down which chunks are compared, and only those chunks' bytes are written; the comparison is
    by their bytes (grouping and joining on the text itself), so chunks that share a hash alone stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(id).alias("__id"), F.xxhash64(body).alias("__mark"), body.alias("__text"))
    posted = stage(chunked(own, "__text", average, min_lines)
                   .select("__id", "__mark", F.explode(F.transform("__chunks", lambda x: F.struct(
                       x["first"].alias("__first"), x["n"].alias("__n"), F.xxhash64(_joined(x)).alias("__hash")))))
                   .select("__id", "__mark", "col.*").distinct(), "posted")
    common = posted.groupBy("__hash").agg(F.count("*").alias("__c")).filter("__c > 1")
    wanted = (posted.join(common, "__hash", "left_semi").groupBy("__id", "__mark")
              .agg(F.collect_list(F.struct(F.col("__first").alias("first"), F.col("__n").alias("n"), F.col("__hash").alias("hash"))).alias("__wanted"))
              .select(F.col("__id").alias("__wid"), F.col("__mark").alias("__wmark"), "__wanted"))
    both = own.join(wanted, own["__id"].eqNullSafe(F.col("__wid")) & (F.col("__mark") == F.col("__wmark")))
    held = stage(_held(both, __lines=_lines(F.col("__text")))
                 .select("__id", "__mark", F.explode(F.transform("__wanted", lambda x: F.struct(
                     x["first"].alias("__first"), x["n"].alias("__n"), x["hash"].alias("__hash"), _joined(x).alias("__body")))))
                 .select("__id", "__mark", "col.*").distinct(), "chunks")
    place = F.struct("__id", "__mark", "__first")
    lowest = held.groupBy("__hash", "__body").agg(F.min(place).alias("__lowest"), F.count("*").alias("__c")).filter("__c > 1")
    return (held.join(lowest, ["__hash", "__body"]).filter(~place.eqNullSafe(F.col("__lowest")))
            .select("__id", "__mark", "__first", "__n"))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", average: int = AVERAGE,
                min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with the text that is left, plus ``n_lines`` and ``n_lines_removed``; no row is lost.

    Rows that repeat both id and text count as one document. A text from which nothing is removed comes back
    unchanged, a null one stays null. Ids may be null; they sort first. Columns that have the names of the two counts are
    replaced.
    """
    docs = docs.drop("n_lines", "n_lines_removed")
    gone = (repeated_chunks(docs, id, text, average, min_lines).groupBy("__id", "__mark")
            .agg(F.collect_set(F.struct(F.col("__first").alias("first"), F.col("__n").alias("n"))).alias("__gone"))
            .select(F.col("__id").alias("__gid"), F.col("__mark").alias("__gmark"), "__gone"))
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    both = docs.join(gone, docs[id].eqNullSafe(F.col("__gid")) & (mark == F.col("__gmark")), "left").drop("__gid", "__gmark")
    # only rows that lose something are cut into lines again
    changed = F.col("__gone").isNotNull()
    parts = _held(both, __lines=F.when(changed, _lines(F.col(text))))
    removed = F.flatten(F.transform("__gone", lambda x: F.sequence(x["first"], x["first"] + x["n"] - 1)))
    parts = _held(parts, __left=F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), removed))
    kept = F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n")
    whole = F.coalesce(F.col(text), F.lit(""))
    return parts.select(
        *[F.when(changed, kept).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns],
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.when(changed, F.size("__lines") - F.size("__left")).otherwise(0).alias("n_lines_removed"))

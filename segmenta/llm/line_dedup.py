"""Deduplication of repeated passages of whole lines, in DataFrame functions only.

A text falls into lines (a physical line that holds several sentences is split at their ends, so
a passage is found inside a long line as well; empty lines belong to the line before them).  Lines
are compared without the white space at their ends.  A passage is a run of lines with at least
``min_words`` words, whatever its number of lines, that also stands earlier in the corpus.

The shortest run of enough words that starts at a line, and the shortest that ends at it, are the
line's windows.  A line of a repeated passage lies in a window inside that passage: in the one that
starts at the line, or, if too few words follow, in the one that ends with the passage.  So the
passages are the unions of the repeated windows, from their first to their last line, without
comparing pairs of documents.  A window that ends at a line begins with the window that starts at
its first line, and is repeated only if that one is.  Steps:

1. Hashes of the windows that start at the lines are counted over the corpus: a narrow aggregate,
   combined on the map side.
2. Windows of repeated hashes, and the windows of their first lines that end later, are read again
   from the documents and compared by SHA-256 of their bytes, cut to 128 bits; texts that merely share
   a 64-bit hash are told apart.
3. The first occurrence, by ``doc_id`` (nulls last) and position, stays.  The lines of the others
   go; within one text an occurrence that overlaps the first one stays as well.

Written tables are dropped when the next one is made; the runs of lines that go are all that stays.
Documents are keyed by (id, text), so repeated rows are treated alike: a window's first occurrence
stays in each of them.  A hot passage is a few narrow rows per occurrence; AQE splits its joins.
Windows meet the repeated hashes, and digests the first occurrences, in hash joins: the side that is
built has one narrow row per repeated window, and the occurrences are not sorted.

Results for odd input: null text stays null, empty stays empty, a document whose whole text was a
repeat becomes empty; lines are never cut, so a long text without line or sentence ends is one
line and goes only as a whole; nulls in other columns pass through; added columns replace equally
named ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmenta.llm.common import materialize, scratch_tables

LINE_END = r"(?<=\n)(?![^\S\n]*+(?:\n|\z))|(?<=[.!?]\x20{1,3})(?=\S)"
WORD = r"\S++"
SPACES = " \t\n\r\f\x0b"


#: A noncharacter, put at line ends while a text is split; texts that hold it are split by LINE_END.
MARK = "\ufdd0"
#: Where marks go, with what stands before them: a match starts with one of a few characters, so that
#: nothing is looked at around the others.  Further spaces belong to the line before, and so do empty lines.
END = r"[.!?\n](?:(?<!\n)\x20{1,3}+(?![\n\r\t])|(?<=\n)(?![\n\r]))"
#: The white space at the end of a line that is not the last one.  It starts after a word or another line's end.
GAP = (
    r"\s(?:(?<=[.!?]\x20)\x20{0,2}+(?![\n\r\t])"
    r"|(?>(?<!\s\s)|(?<=\n[^\n\r])|(?<=[.!?]\x20{1,3}\s))(?:(?<=\n)|\s*?\n)(?![\n\r]))"
)


#: Bytes of a window's SHA-256 that are kept: shuffled twice and written once, and enough to tell all texts apart.
DIGEST_BYTES = 16


def lines_of(text: Column) -> Column:
    marked = F.regexp_replace(text, END, "$0" + MARK)
    split = F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END, -1)).otherwise(F.split(marked, MARK, -1))
    return F.filter(split, lambda line: line != "")


def _any_of(holds, text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | holds(text, F.lit(part))
    return found


def _marked_bare(text: Column) -> Column:
    """The lines without white space at their ends, with a mark between them; null for texts that
    hold the mark."""
    trimmed = F.when(_any_of(F.endswith, text, SPACES), F.rtrim(text, F.lit(SPACES))).otherwise(text)
    return F.when(~F.contains(text, F.lit(MARK)), F.regexp_replace(trimmed, GAP, MARK))


def bare_lines(text: Column, marked: Column) -> Column:
    """:func:`lines_of`, without white space at their ends; ``marked`` is :func:`_marked_bare`.
    Empty lines at the end of the text are left out."""
    return F.when(marked.isNull(), F.transform(lines_of(text), _bare)).otherwise(F.split(marked, MARK, -1))


def _words(bare: Column) -> Column:
    """The number of words of a line without white space at its ends."""
    other = F.lit(False)
    for space in SPACES[1:]:
        other = other | F.contains(bare, F.lit(space))
    spaced = F.size(F.array_remove(F.split(bare, " "), ""))
    return F.when(other, F.regexp_count(bare, F.lit(WORD))).otherwise(spaced)


def _bare(line: Column) -> Column:
    return F.rtrim(line, F.lit(SPACES))


def _plain_words(bare: Column) -> Column:
    """:func:`_words` of a line whose only white space is single spaces between words."""
    spaces = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare == "", 0).otherwise(spaces + 1)


def with_windows(rows: DataFrame, text: str, min_words: int) -> DataFrame:
    """Adds the array ``windows`` of structs: ``first`` and ``last`` line and ``hash`` of every
    window that starts at a line, and ``reach``, the last line of the windows that end after it
    and begin at the same line (if not before ``last``).  One step per column, each read more than
    once by the next, so that no step is evaluated anew per element."""
    names = rows.columns
    marked = rows.withColumn("_marked", _marked_bare(F.col(text)))
    lined = marked.withColumn("_lines", bare_lines(F.col(text), F.col("_marked")))
    odd = F.col("_marked").isNull() | F.startswith("_marked", F.lit(" "))
    odd = odd | _any_of(F.contains, F.col("_marked"), ["  ", MARK + " ", *SPACES[1:]])
    counted = lined.withColumn("_hashes", F.transform("_lines", lambda line: F.xxhash64(line))).withColumn(
        "_words", F.when(odd, F.transform("_lines", _words)).otherwise(F.transform("_lines", _plain_words))
    ).withColumn(
        # The line of every word.
        "_at",
        F.flatten(F.transform("_words", lambda n, i: F.array_repeat(i, n))),
    )
    words = F.size("_at")
    begun = counted.withColumn(
        # The first word of every line that enough words follow.
        "_first",
        F.when(
            words >= min_words,
            F.filter(
                F.sequence(F.lit(0), F.greatest(words - min_words, F.lit(0))),
                lambda k: (k == 0) | (F.get("_at", k - 1) != F.get("_at", k)),
            ),
        ),
    )

    def window(k: Column, j: Column) -> Column:
        first, last = F.get("_at", k), F.get("_at", k + (min_words - 1))
        later = F.get("_at", F.get("_first", j + 1) + (min_words - 1)) - 1
        return F.struct(
            first.alias("first"),
            last.alias("last"),
            F.coalesce(later, F.size("_hashes") - 1).alias("reach"),
            F.xxhash64(F.slice("_hashes", first + 1, last - first + 1)).alias("hash"),
        )

    made = F.when(F.size("_hashes") > 0, F.transform("_first", window))
    return begun.withColumn("windows", made).select(*names, "windows")


def repeated_windows(docs: DataFrame, min_words: int, written) -> DataFrame:
    """``key, first, last, reach`` of every window whose hash occurs more than once; ``written``
    writes the result (:func:`scratch_tables`)."""
    # The outer form: the plain one infers a filter on the array's size, which is pushed down
    # through the projections of with_windows and evaluates the array within itself.
    seen = with_windows(docs.select("key", "text"), "text", min_words).select("key", F.explode_outer("windows").alias("w"))
    with scratch_tables(docs.sparkSession) as passing:
        seen = passing(seen.select("key", "w.*"), "windows").where("hash is not null")
        often = passing(seen.groupBy("hash").count().where("count > 1").select("hash"), "often")
        return written(seen.join(often.hint("shuffle_hash"), "hash").select("key", "first", "last", "reach"), "repeated")


def window_digests(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``key, doc_id, first, last, digest`` of the repeated windows, and of those that
    end later and begin at the same line."""
    wanted = repeated.groupBy("key").agg(F.collect_set(F.struct("first", "last", "reach")).alias("wanted"))
    texts = docs.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    lined = texts.join(wanted.hint("merge"), "key").withColumn("_marked", _marked_bare(F.col("text")))
    lined = lined.withColumn("_bare", bare_lines(F.col("text"), F.col("_marked")))

    def digest(first: Column, last: Column) -> Column:
        lines = F.slice("_bare", first + 1, last - first + 1)
        return F.unhex(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 2 * DIGEST_BYTES))

    def confirmed(w: Column) -> Column:
        lasts = F.sequence(w["last"], F.greatest(w["last"], w["reach"]))
        lasts = F.filter(lasts, lambda last: F.get("_bare", last) != "")  # windows end with a word
        return F.transform(
            lasts, lambda last: F.struct(w["first"].alias("first"), last.alias("last"), digest(w["first"], last).alias("digest"))
        )

    confirmed_windows = F.when(F.size("_bare") > 0, F.flatten(F.transform("wanted", confirmed)))
    digests = lined.select("key", "doc_id", F.explode_outer(confirmed_windows).alias("w"))
    return digests.select("key", "doc_id", "w.*")


def removed_lines(digests: DataFrame, kept: DataFrame) -> DataFrame:
    """``key, removed, n_removed_lines``: the sorted, disjoint runs of lines that go."""
    span = F.struct("first", "last")
    others = digests.join(kept.hint("shuffle_hash"), "digest").where("not (key = kept_key and first <= kept_last)")
    others = others.select("key", "first", "last").distinct()  # repeated rows have one key
    ordered = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(ordered)
    return (
        others.withColumn("reach", reach)
        .withColumn("island", island)
        .groupBy("key", "island")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("key")
        .agg(
            F.sort_array(F.collect_list(span)).alias("removed"),
            F.sum(F.col("last") - F.col("first") + 1).alias("n_removed_lines"),
        )
    )


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """:func:`removed_lines` of the documents' ``key, row``, written; the tables before it are dropped."""
    spark = docs.sparkSession
    with scratch_tables(spark) as written:
        with scratch_tables(spark) as passing:
            repeated = repeated_windows(docs.select("key", F.col("row.text").alias("text")), min_words, passing)
            digests = written(window_digests(docs, repeated), "digests").where("digest is not null")
        order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "first", "last")
        kept = digests.groupBy("digest").agg(F.min(order).alias("kept"))
        kept = kept.select("digest", F.col("kept.key").alias("kept_key"), F.col("kept.last").alias("kept_last"))
        kept = written(kept, "kept")  # AQE splits a join's hot key only between plain exchanges
        return materialize(removed_lines(digests, kept), "removed")


def dedup_lines(docs: DataFrame, min_words: int = 51) -> DataFrame:
    """``docs`` with ``text`` free of repeated passages, plus ``n_removed_lines`` and
    ``n_removed_chars``."""
    keyed = docs.select(
        F.xxhash64(F.col("doc_id"), F.lit(0), F.col("text")).alias("key"), F.struct(*docs.columns).alias("row")
    )
    removed = repeated_lines(keyed, min_words)
    joined = keyed.join(removed.hint("merge"), "key", "left").withColumn("text", F.col("row.text"))
    lined = joined.withColumn("_lines", F.when(F.col("removed").isNotNull(), lines_of(F.col("text"))))

    def between(run: Column, i: Column) -> Column:
        after = F.coalesce(F.get("removed", i - 1)["last"], F.lit(-1)) + 1
        return F.array_join(F.slice("_lines", after + 1, run["first"] - after), "")

    end = F.element_at("removed", -1)["last"]
    rest = F.array_join(F.slice("_lines", end + 2, F.size("_lines")), "")
    kept = lined.withColumn(
        "_kept", F.when(F.size("_lines") > 0, F.concat(F.array_join(F.transform("removed", between), ""), rest))
    )
    text = F.when(F.col("removed").isNotNull(), F.col("_kept")).otherwise(F.col("text"))
    added = {
        "text": text,
        "n_removed_lines": F.coalesce("n_removed_lines", F.lit(0)).cast("long"),
        "n_removed_chars": (F.length("text") - F.length(text)).cast("long"),
    }
    return kept.select(
        *(F.col("row")[c].alias(c) if c != "text" else text.alias("text") for c in docs.columns if c not in added or c == "text"),
        *(added[c].alias(c) for c in ("n_removed_lines", "n_removed_chars")),
    )

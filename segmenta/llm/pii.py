"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers, by fixed patterns over the whole
   text.  Candidates: all other runs of letters, digits and ``@ _ . + -`` with a digit and at least
   ``MIN_LENGTH`` characters.
2. The word before a seed or candidate, or the part of its own word before it, is its lexical
   pattern.  Patterns and instances (values
   without punctuation) form a bipartite graph of narrow rows.
3. The graph is scored in ``ROUNDS`` rounds: a pattern's confidence is the summed score of the
   instances that follow it over *all* of its occurrences in the corpus, as a word or glued to what
   follows (``email=a@b.c``), whatever follows them, so that common words stay weak; an instance that is no seed gets the chance that not all of its
   patterns are wrong.  A pattern needs ``support`` different instances with a score to count.
4. Candidates whose instance reaches ``threshold`` are reported with the kind ``found``.

Word counts and both sides of a round are aggregates that combine on the map side; a common word or
value is one row per task.  Only values, words and positions are shuffled, no texts.

Positions are code points, end exclusive: a text is split by a pattern, and the lengths of pieces
and matches are added up.  The patterns are written with possessive repeats (they match the same
strings, without recursion), and a run that cannot match is tried once, from its start.

Results for odd input: null and empty texts have no spans; null and repeated ids are rows of their
own; the word before a span is judged by its last ``CONTEXT`` characters; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import materialize, text_or_empty

#: The base kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CANDIDATE = r"(?<![A-Za-z0-9@_.+-])[A-Za-z@_.+-]*+[0-9](?:[@_.+-]*+[A-Za-z0-9])*+"
MIN_LENGTH = 6
FOUND = "found"
CONTEXT = 64
ROUNDS = 3

#: White space as in ``\\s``, for SQL.
SPACES = r"' \t\n\r\f\u000b'"
#: In a word in small letters: the two characters around a place where a span may start.
START = r"^(?:[^a-z0-9].|[^0-9][0-9]|.\+)"
BLOCK = 1024

SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string>>"


def matches_of(text: Column, pattern: str, needs: str | None) -> tuple[Column, Column]:
    """The matches, and the pieces between them, of a text that may have some."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    if needs is None:
        return values, pieces
    some = F.contains(text, F.lit(needs))
    return F.when(some, values).otherwise(F.array().cast("array<string>")), F.when(some, pieces).otherwise(F.array(text))


def _placed(values: str, pieces: str, kind: int) -> Column:
    """The spans with their positions, values and the characters before them in the whole text:
    ``tail`` ends where the match starts, white space at its end is one space."""
    return F.expr(
        f"""aggregate(
          zip_with({values}, slice({pieces}, 1, size({values})), (v, p) -> struct(v, p)),
          struct(0 AS at, '' AS tail, cast(array() AS {SPAN}) AS out),
          (acc, x) -> struct(
            acc.at + length(x.p) + length(x.v) AS at,
            right(concat({_context("acc.tail", "x.p")}, x.v), {CONTEXT}) AS tail,
            concat(acc.out, array(struct(
              acc.at + length(x.p) AS start, {kind} AS kind,
              acc.at + length(x.p) + length(x.v) AS end, x.v AS value,
              {_context("acc.tail", "x.p")} AS before))) AS out),
          acc -> acc.out)"""
    )


def _context(tail: str, piece: str) -> str:
    """The last ``CONTEXT`` characters, and a space if white space follows them."""
    both = f"concat({tail}, {piece})"
    bare = f"rtrim({SPACES}, {both})"
    return f"concat(right({bare}, {CONTEXT}), if(length({bare}) < length({both}), ' ', ''))"


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    numbers = F.filter(numbers, lambda d: d.isNotNull())

    def share(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(numbers, share), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _filtered(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def extracted(docs: DataFrame) -> DataFrame:
    """``row, doc_id, base, candidates``: the seeds of every row and its other candidates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    made, valid = rows, []
    for number, kind in enumerate(KINDS):
        values, pieces = matches_of(F.col("text"), PATTERNS[kind], NEEDS.get(kind))
        made = made.withColumn(f"v{number}", values).withColumn(f"p{number}", pieces)
        placed = _placed(f"v{number}", f"p{number}", number)
        valid.append(_filtered(placed, kind))
    number = len(KINDS)
    values, pieces = matches_of(F.col("text"), CANDIDATE, None)
    made = made.withColumn(f"v{number}", values).withColumn(f"p{number}", pieces)
    both = made.select("doc_id", F.array_sort(F.concat(*valid)).alias("base"), _placed(f"v{number}", f"p{number}", number).alias("all"))
    others = F.expr(
        f"filter(all, c -> length(c.value) >= {MIN_LENGTH} AND NOT exists(base, b -> b.start < c.end AND b.end > c.start))"
    )
    return materialize(
        both.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", others.alias("candidates")), "spans"
    )


def _pattern(before: Column) -> Column:
    word = F.regexp_extract(F.lower(before), r"(\S+)\s*$", 1)
    return F.when(word != "", word)


def _instance(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9@]", "")


def _mentions(spans: DataFrame, column: str, seed: bool) -> DataFrame:
    return spans.select("row", F.explode(column).alias("s")).select(
        "row",
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        _pattern(F.col("s.before")).alias("pattern"),
        _instance(F.col("s.value")).alias("instance"),
        F.lit(seed).alias("seed"),
    )


def _glued(word: str) -> Column:
    """The contexts of all places inside a word where a span may start: the word's characters before
    the place.  A long word is read in blocks, so that the work stays linear in its length."""
    return F.expr(
        f"""flatten(transform(
          transform(
            sequence(0, (length({word}) - 1) div {BLOCK}),
            b -> struct(least(b * {BLOCK}, {CONTEXT}) AS head,
                        substring({word}, b * {BLOCK} - least(b * {BLOCK}, {CONTEXT}) + 1,
                                  {BLOCK} + least(b * {BLOCK}, {CONTEXT}) + 1) AS part)),
          x -> transform(
            filter(sequence(x.head, least(x.head + {BLOCK}, length(x.part) - 1)),
                   q -> q > 0 AND q < length(x.part) AND (x.head = 0 OR q > x.head)
                        AND substring(x.part, q, 2) RLIKE r'(?s){START}'),
            q -> right(left(x.part, q), {CONTEXT}))))"""
    )


def pattern_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, total``: how often each of ``patterns`` occurs in the corpus, as a word or glued to
    what follows."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty()), r"\s+")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    contexts = F.concat(F.array(F.right("word", F.lit(CONTEXT))), _glued("word"))
    counts = counted.where("word != ''").select(F.explode(contexts).alias("pattern"), "n")
    return counts.groupBy("pattern").agg(F.sum("n").alias("total")).join(patterns, "pattern", "left_semi")


def score_instances(edges: DataFrame, totals: DataFrame, support: int, rounds: int = ROUNDS) -> DataFrame:
    """``instance, score`` of the instances that are no seeds.

    ``edges``: ``pattern, instance, n, seed``; seeds have the score 1 throughout."""
    scores = None
    for _ in range(rounds):
        if scores is None:
            rated = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
        else:
            rated = edges.join(scores, "instance", "left")
            rated = rated.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        weights = rated.groupBy("pattern").agg(
            F.sum(F.col("score") * F.col("n")).alias("mass"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("known")
        )
        confident = weights.where(F.col("known") >= support).join(totals, "pattern").select(
            "pattern", F.least(F.col("mass") / (F.col("total") + 1), F.lit(0.999)).alias("confidence")
        )
        opened = edges.where("not seed").join(confident, "pattern")
        chance = opened.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = materialize(chance, "scores")
    return scores


def _text(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in (*KINDS, FOUND)))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_personal_data(docs: DataFrame, threshold: float = 0.5, support: int = 3) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    spans = extracted(docs)
    seeds, others = _mentions(spans, "base", True), _mentions(spans, "candidates", False)
    named = seeds.unionByName(others).where("pattern is not null and instance != ''")
    edges = named.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "edges")
    own = edges.groupBy("pattern").agg(F.sum("n").alias("own"))
    # At least its own spans: an e-mail address right after another starts at no counted place.
    totals = own.join(pattern_counts(docs, own.select("pattern")), "pattern", "left")
    totals = materialize(totals.select("pattern", F.greatest("total", "own").alias("total")), "totals")
    scores = score_instances(edges, totals, support)
    accepted = scores.where(F.col("score") >= threshold).select("instance")
    span = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    added = others.join(accepted, "instance").groupBy("row").agg(F.collect_list(span).alias("added"))

    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    joined = spans.select("row", "doc_id", bare.alias("base")).join(added, "row", "left")
    every = F.array_sort(F.concat(F.col("base"), F.coalesce("added", empty)))
    counts = map(_count, range(len(KINDS)))
    return joined.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(every).alias("spans"))

"""Benchmark decontamination by a distributed positional inverted index (native).

``build_index`` reads the training texts once and stores the postings
(row, term, pos) of every token whose term occurs in the test set - other
postings cannot meet a query - next to one posting per row that carries its id and
length.  Postings stay with the partition of their document, so building
the index shuffles nothing.  Words leave a text by pieces of some ``PIECE`` characters, cut after a
word, so no task holds an array of all words of a text.

Exact phrases: every window of ``window`` consecutive test words is looked up
from its two rarest terms (by training frequency).  A posting of the term at
test offset q, moved back by q, gives the diagonal (row, item, pos - q); a window
can only lie on diagonals that hold both of its rarest terms.  For these the
lists of the remaining terms are intersected: the words the diagonal needs are
joined with the postings on (row, pos, term), and runs of matches that cover a whole
window are occurrences.

Proximity: from the postings of a query's rarest term, every other term must have
a posting at most ``slop`` words away.

Edge cases: null, empty and wordless texts have no words and no hits; null or wordless
items have no window; an item of fewer words than the window is one window; equal
item ids count once; repeated rows and repeated or null document ids keep one
output row each (rows are numbered in the index); further columns are ignored;
empty tables give empty or unhit results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lowdata.llm.common import TO_ASCII_LOWER, ordinal, store

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # all that is not a digit, a-z or beyond ASCII; A-Z are lower-cased later
TEXT_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before lower-casing
WORD = TEXT_BREAK.replace("[", "[^", 1)
PIECE = 2000  # characters of a text split at once; longer by the rest of its last word
WINDOW = 10
ROW_TERM = -1  # term number of the posting that stands for the row itself; its pos is the number of words


def spread_words(src: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., n, pos, word): the words of every text in order, and after them one empty word at pos = n."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{PIECE}}}{WORD[:-1]}*"), F.lit(0))
    edge = lambda p, at: F.substring(p, at, 1).rlike(TEXT_BREAK).cast("int")  # noqa: E731  split gives an empty word there
    count = lambda p: F.size(F.split(p, TEXT_BREAK)) - edge(p, 1) - edge(p, -1)
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))
    sums = F.aggregate("pieces", none, lambda a, p: F.struct(F.array_append(a["starts"], a["n"]).alias("starts"),
                                                             (a["n"] + count(p)).alias("n")))
    last = F.array(F.struct(F.lit(None).cast("string").alias("piece"), F.col("n").alias("start")))
    parts = F.zip_with("pieces", "starts", lambda p, a: F.struct(p.alias("piece"), a.alias("start")))
    words = F.when(F.col("part.piece").isNull(), F.array(F.lit(""))).otherwise(F.array_remove(F.split("part.piece", TEXT_BREAK), ""))
    return (src.select(*keep, pieces.alias("pieces")).select("*", sums.alias("sums"))
            .select(*keep, "pieces", "sums.starts", "sums.n").select(*keep, "n", F.explode(F.concat(parts, last)).alias("part"))
            .select(*keep, "n", F.col("part.start").alias("start"), F.posexplode(words).alias("i", "word"))
            .select(*keep, "n", (F.col("start") + F.col("i")).alias("pos"), "word"))


def _ascii_lower(word):
    """A-Z lower-cased; the built-in ``lower`` where it does the same (pure ASCII)."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, *TO_ASCII_LOWER))


def test_positions(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, q, term, n): the words of the test items in order; item numbers the rows."""
    src = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return (spread_words(src, ["item", "item_id"]).where("word <> ''")
            .select("item", "item_id", "n", F.col("pos").alias("q"), _ascii_lower(F.col("word")).alias("term")))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (row, id, tid, pos) of ``vocabulary(term, tid)`` in ``docs``.

    The text is read and split once; the join with the vocabulary is left to
    Spark, which broadcasts it only below its own size threshold.
    """
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = spread_words(src, ["row", "id"]).select("row", "id", "pos", _ascii_lower(F.col("word")).alias("term"))
    terms = vocabulary.select("term", "tid").unionByName(
        vocabulary.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(ROW_TERM).cast("long").alias("tid")))
    return store(words.join(terms, "term")
                 .select("row", F.when(F.col("tid") == ROW_TERM, F.col("id")).alias("id"), F.col("tid").cast("int").alias("tid"), "pos"),
                 "decon-index")


def vocabulary(positions: DataFrame) -> DataFrame:
    """(term, tid) of the distinct test terms; tid is dense, from 0."""
    return ordinal(positions.select("term").distinct(), [], ["term"], "tid")


def windows(positions: DataFrame, size: int) -> DataFrame:
    """(item, s, len, q, tid, freq): one row per window and its test offset q, rarest first by ``place``."""
    n_windows = F.greatest(F.lit(1), F.col("n") - size + 1)
    first = F.greatest(F.lit(0), F.col("q") - size + 1)
    last = F.least(F.col("q"), n_windows - 1)
    spread = positions.withColumn("s", F.explode(F.sequence(first, F.least(last, F.greatest(last, first)))))
    rank = Window.partitionBy("item", "s").orderBy("freq", "tid", "q")
    return (spread.withColumn("len", F.least(F.lit(size), F.col("n")))
            .withColumn("place", F.row_number().over(rank)))


def phrase_hits(index: DataFrame, positions: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item_id, start, end): maximal covered runs are not merged - one row per item window that occurs."""
    freq = index.where(F.col("tid") != ROW_TERM).groupBy("tid").agg(F.count("*").alias("freq"))
    known = store(positions.join(freq, "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0))), "decon-test", few=True)
    wins = windows(known, window)
    at = lambda place: F.min(F.when(F.col("place") == place, F.col("q")))
    # windows that hold a term the training texts lack cannot occur
    alive = store(wins.groupBy("item", "s", "len").agg(F.min("freq").alias("least"), at(1).alias("q1"), F.coalesce(at(2), at(1)).alias("q2"))
                  .where("least > 0").drop("least"), "decon-windows", few=True)
    lookups = (alive.select("item", F.explode(F.array("q1", "q2")).alias("q")).distinct()
               .join(known.select("item", "q", "tid"), ["item", "q"]).select("tid", "item", "q"))
    # lists of the rarest terms, moved back to diagonals; a window is a candidate on the diagonals that hold both of its rare terms
    diagonals = store(index.join(lookups, "tid").select("row", "item", (F.col("pos") - F.col("q")).alias("d"), "q"), "decon-diagonals")
    first = diagonals.withColumnRenamed("q", "q1").join(alive, ["item", "q1"])
    # stored tables are far smaller than their rows (a candidate is 4 bytes, spread over its words 1500 in memory): both sides of joins
    # with them are dealt, a broadcast chosen by their bytes would put rows that grow with the texts into the driver
    candidates = store(first.join(diagonals.withColumnRenamed("q", "q2").hint("merge"), ["row", "item", "d", "q2"], "left_semi")
                       .select("row", "item", "d", "s", "len"), "decon-candidates")
    offsets = F.explode(F.sequence("s", F.col("s") + F.col("len") - 1)).alias("q")
    # every such word is in the items; a left join, and kept one, can broadcast the items only
    needed = (candidates.select("row", "item", "d", offsets).distinct().join(known.select("item", "q", "tid"), ["item", "q"], "left")
              .select("row", (F.col("d") + F.col("q")).alias("pos"), F.coalesce("tid", F.lit(ROW_TERM - 1)).alias("tid"), "item", "d", "q"))
    # both sides are dealt by word at every size: a long text or a frequent term is many tasks
    matched = needed.join(index.select("row", "pos", "tid").hint("merge"), ["row", "pos", "tid"]).select("row", "item", "d", "q")
    found = (candidates.select("*", offsets).join(matched.hint("merge"), ["row", "item", "d", "q"])
             .groupBy("row", "item", "d", "s", "len").agg(F.count("*").alias("met")).where("met = len"))
    ids = known.select("item", "item_id").distinct()
    return found.join(ids, "item").select("row", "item_id", (F.col("d") + F.col("s")).alias("start"),
                                          (F.col("d") + F.col("s") + F.col("len")).alias("end"))


def proximity_hits(index: DataFrame, positions: DataFrame, slop: int) -> DataFrame:
    """(row, item_id, pos): postings of an item's rarest term with all its other terms at most ``slop`` words away."""
    freq = index.where(F.col("tid") != ROW_TERM).groupBy("tid").agg(F.count("*").alias("freq"))
    terms = positions.select("item", "item_id", "tid").distinct().join(freq, "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    size = Window.partitionBy("item")
    ranked = store(terms.withColumn("n_terms", F.count("*").over(size)).withColumn("least", F.min("freq").over(size))
                   .withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy("freq", "tid"))).where("least > 0"), "decon-near")
    step = slop + 1
    block = lambda c: F.floor(F.col(c) / step)  # noqa: E731  a posting at most slop away lies in the same or a neighbouring block
    rare = (index.join(ranked.where("place = 1").select("tid", "item", "item_id", "n_terms"), "tid")
            .select("row", "item", "item_id", "n_terms", F.col("pos").alias("at"))
            .withColumn("b", F.explode(F.array(block("at") - 1, block("at"), block("at") + 1))))
    others = (index.join(ranked.where("place > 1").select("tid", "item"), "tid")
              .select("row", "item", "tid", "pos", block("pos").alias("b")))
    near = (rare.join(others, ["row", "item", "b"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
            .groupBy("row", "item", "item_id", "at", "n_terms").agg(F.count_distinct("tid").alias("met")))
    single = rare.where("n_terms = 1").select("row", "item_id", F.col("at").alias("pos")).distinct()
    return near.where("met = n_terms - 1").select("row", "item_id", F.col("at").alias("pos")).unionByName(single)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, id, n_words, n_hit, item_ids) per input row; n_hit counts words inside any occurring window."""
    positions = store(test_positions(items, item_id, item_text), "decon-items", few=True)
    terms = store(vocabulary(positions), "decon-vocabulary", few=True)
    positions = positions.join(terms, "term")
    index = build_index(docs, terms, id_col, text_col)
    hits = store(phrase_hits(index, positions, window), "decon-hits")
    spans = hits.select("row", "start", "end").distinct()
    words = (spans.select("row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
             .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    met = hits.select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    rows = index.where(F.col("tid") == ROW_TERM).select("row", "id", F.col("pos").cast("long").alias("n_words"))
    return (rows.join(words.hint("merge"), "row", "left").join(met.hint("merge"), "row", "left")
            .select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))

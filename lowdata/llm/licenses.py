"""Licence scan: a trained paragraph classifier, confirmed by template comparison (native).

A paragraph is a line of a text, or the lines of a wrapped paragraph (``WRAPPED``) joined.  Its features are the word 1- to 3-grams
that stand in any template or unlisted licence, as a sparse binary vector.  Two nested logistic regressions (spark.ml) judge it: one tells
licences from other text, and of licences a multinomial one tells the families and those of other families (the class ``unknown``,
learned from ``UNLISTED``) apart; the probability of a family is the product.  They are trained on
runs of words of licence paragraphs and, for other text, on the corpus' own distinct paragraphs without licence
vocabulary and without four words in a row of a template: one half, by hash, trains and the other calibrates.  The
former weigh ``other_weight`` together, however many they are.  Only the first regression reads them, with one
coefficient a gram instead of one a gram and family, and paragraphs go through the shuffle that makes them distinct as an MD5 and the numbers of their grams, not as texts.

The least probability at which a family is believed is calibrated on held-out families: models fitted without a
quarter of the families judge all of them, and among the claims that a template confirms the probability that best parts
the right ones from those about families the model never saw is taken.  At most ``unknown_rate`` of the other half of
the other text may reach it, and it is at least one half.  A believed family counts only if a template of the
family confirms it: of the shorter one's word pairs, at least ``min_overlap`` are in the other, and these are
``LEAST_SHARED`` pairs or the whole template (a few common words of a notice are none).
What speaks of licences without meeting both conditions is counted as unknown.

Classified are the paragraphs with a word of licence vocabulary (``GATE``) and those that a template
could confirm by its word pairs; no other could count.  Only the former are unknown if no family is confirmed.  All steps are DataFrame operations;
documents without such a paragraph are carried along in the same single pass.

Edge cases: null and empty texts have no paragraph; a paragraph of one word has no word
pair and is never confirmed; repeated rows and ids are scanned each; an empty table
gives an empty result (the classifier then knows the templates only); further columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.llm.common import store
from lowdata.llm.license_texts import TEMPLATES, UNLISTED

# the lookahead changes no match: it passes a place at once where none of the words starts
GATE = r"(?i)(?=[lcpra])(?:licen[sc]|copyright|creative commons|\bcc[ -]?(by|0)|permission is hereby|redistribut|public domain|all rights reserved)"
STEMS = r"licen[sc]|copyright|redistribut"  # each alone passes GATE
OTHER, UNKNOWN = "other", "unknown"
OTHER_WEIGHT, UNKNOWN_RATE, MIN_OVERLAP = 2000.0, 0.01, 0.8
TRAIN_ROWS = 50000  # other paragraphs a task
LEAST_SHARED, SHORT_FORM = 5, 12
FAMILY_FOLDS, PIECE, FIT_STEPS, FOLD_STEPS, PARAGRAPH_WEIGHT = 4, 9, 25, 10, 40.0
# a line of 40 to 120 characters that does not end a sentence, and a next line with a word: one paragraph
WRAPPED = r"(?md)^([^\n]{39,119}[^\n.!?:;\s])[ \t\r]*\n(?=[^\n]*[\p{L}\p{N}])"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_pairs(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1])))


def shared(a, form) -> Column:
    """Of the shorter one's word pairs, the share that is in the other; 0 below LEAST_SHARED pairs and the whole ``form``."""
    def of(both) -> Column:
        share = F.size(both) / F.greatest(F.least(F.size(a), F.size(form)), F.lit(1))
        return F.when(F.size(both) >= F.least(F.size(form), F.lit(LEAST_SHARED)), share).otherwise(F.lit(0.0))
    return F.transform(F.array(F.array_intersect(a, form)), of)[0]  # intersected once


def literal(items: list[str]) -> Column:
    return F.split(F.lit("\n".join(items)), "\n")


def confirmable(text: Column, forms: list[list[str]], min_overlap: float) -> Column:
    """Could a template (its word pairs in ``forms``) confirm this paragraph, though it holds no word of ``STEMS``?

    Exact, but cheap for ordinary text.  Templates with fewer than ``least_of`` pairs without such a word cannot.  Of the
    others, one that confirms shares at least ``need`` pairs: first the paragraph's words are counted that stand in any of them
    (``need`` pairs are more than ``need`` words), then its pairs, and only then templates are met one by one.
    """
    def least_of(form: list[str]) -> int:
        return min(len(form), LEAST_SHARED)

    forms = [f for f in forms if f and sum(not re.search(STEMS, k) for k in f) >= least_of(f)]
    groups = [g for g in ([f for f in forms if low < len(f) <= high] for low, high in ((0, 4), (4, SHORT_FORM), (SHORT_FORM, 1 << 30))) if g]

    def need(n_pairs: Column, group) -> Column:
        return F.greatest(F.lit(float(min(map(least_of, group)))), F.least(n_pairs, F.lit(min(map(len, group)))) * F.lit(min_overlap) - F.lit(1e-9))

    def by_pairs(p: Column, group) -> Column:
        known = F.array(*[literal(f) for f in group])
        every = sorted({k for f in group for k in f})  # isin looks up a hash set made once, array_intersect makes one a row
        return F.when(F.size(F.filter(p, lambda k: k.isin(*every))) >= need(F.size(p), group),
                      F.exists(known, lambda t: shared(p, t) >= min_overlap)).otherwise(F.lit(False))

    def vocabulary(group) -> list[str]:
        return sorted({x for f in group for k in f for x in k.split(" ")})

    def by_words(b: Column) -> Column:
        w, known, n = b["w"], b["known"], b["n"]
        found = F.lit(False)
        for group in groups:
            mine = vocabulary(group)
            hits = F.size(F.filter(known, lambda x: x.isin(*mine)))
            found = found | F.when(hits > need(n - 1, group),
                                   F.exists(F.transform(F.array(w), word_pairs), lambda p: by_pairs(p, group))).otherwise(F.lit(False))
        return found
    every = vocabulary([f for group in groups for f in group])
    # each is bound once: the words, those of any template, and the number of distinct words
    bound = F.transform(F.array(words(text)), lambda w: F.struct(w.alias("w"), F.filter(w, lambda x: x.isin(*every)).alias("known"), F.size(F.array_distinct(w)).alias("n")))
    return F.exists(bound, by_words)


def templates(spark: SparkSession, given=TEMPLATES) -> DataFrame:
    """(family, words, pairs)."""
    return (spark.createDataFrame(list(given), "family string, text string").withColumn("words", words(F.col("text")))
            .withColumn("pairs", word_pairs(F.col("words"))).select("family", "words", "pairs"))


def paragraphs(text_col: str = "text") -> Column:
    """The text's lines, those of a wrapped paragraph joined."""
    return F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WRAPPED, "$1 "), "\n")


def holds_run(text: Column, runs: list[str]) -> Column:
    """Does the text hold one of these runs of four words (a text of fewer: is it one)?"""
    return F.exists(F.array(words(text)), run_among(runs))  # bound once, not once a word


def run_among(runs: list[str]):
    """``holds_run`` of bound words: a run is put together only where its first two words are those of some given run."""
    heads = [(r.split(" ") + [""])[:2] for r in runs]
    first, second = (sorted({h[i] for h in heads}) for i in range(2))

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1)))
        word = lambda i: F.coalesce(F.get(w, i), F.lit(""))
        return F.exists(at, lambda i: word(i - 1).isin(*first) & word(i).isin(*second)  # isin looks up a hash set made once
                        & F.array_join(F.slice(w, i, F.lit(4)), " ").isin(*runs))
    return of


class Grams:
    """The word 1- to 3-grams of given paragraphs: what a paragraph holds of them, as numbers and as a vector."""

    def __init__(self, spark: SparkSession, given: list[list[str]]):
        self.sets = [sorted({" ".join(w[i:i + n]) for w in given for i in range(len(w) - n + 1)}) for n in (1, 2, 3)]
        every = spark.createDataFrame([(g,) for grams in self.sets for g in grams], "g string")
        numbers = sorted({str(r["h"]) for r in every.select(F.hash("g").alias("h")).collect()})  # as many as grams of the fixed licence texts
        self.vectors = CountVectorizerModel.from_vocabulary(numbers, inputCol="grams", outputCol="x").setBinary(True)

    def numbers(self, w: Column) -> Column:
        """The hashes of the given grams that the words hold, each once."""
        return F.transform(F.array(w), self.numbers_of())[0]  # bound once, not once a word

    def numbers_of(self):
        """``numbers`` of bound words."""
        def joined(w: Column, n: int) -> Column:
            """The runs of n words put together, only where each word is known at its place; else null."""
            at = [sorted({g.split(" ")[k] for g in self.sets[n - 1]}) for k in range(n)]

            def of(x: Column, i: Column) -> Column:
                own = [x, *(F.get(w, i + k) for k in range(1, n))]
                return F.when(functools.reduce(operator.and_, (o.isin(*a) for o, a in zip(own, at))), F.concat_ws(" ", *own))
            return F.transform(w, of)

        def of(w: Column) -> Column:
            found = [F.filter(w if n == 1 else joined(w, n), functools.partial(lambda grams, g: g.isin(*grams), grams)) for n, grams in enumerate(self.sets, 1) if grams]
            return F.transform(F.array_distinct(F.concat(*found)), lambda g: F.hash(g))
        return of

    def vector(self, df: DataFrame, numbers: str) -> DataFrame:
        """Adds x, the vector of the column ``numbers``."""
        return self.vectors.transform(df.withColumn("grams", F.col(numbers).cast("array<string>"))).drop("grams")


class Scanner:
    """The fitted classifier, its classes in label order and the calibrated least probability."""

    def __init__(self, grams: Grams, speaks, which, families: list[str], least: float, known: DataFrame):
        self.grams, self.speaks, self.which, self.families, self.least, self.known = grams, speaks, which, families, least, known

    def classify(self, df: DataFrame, hashed: bool = False) -> DataFrame:
        """Adds family and probability to rows with a column ``words``, or ``x`` if their vectors are made already."""
        names = F.array(*[F.lit(f) for f in self.families])
        if not hashed:
            df = self.grams.vector(df.withColumn("numbers_", self.grams.numbers(F.col("words"))), "numbers_")
        out = self.which.transform(self.speaks.transform(df)).withColumn("__s", vector_to_array("speaks_")[1])
        p = F.concat(F.transform(vector_to_array("which_"), lambda q: q * F.col("__s")), F.array(1 - F.col("__s")))
        return (out.withColumn("__p", p).withColumn("probability", F.array_max("__p"))
                .withColumn("family", F.element_at(names, F.array_position("__p", F.array_max("__p")).cast("int")))
                .drop("__p", "__s", "numbers_", "speaks_", "which_", "x"))


def pieces(known: DataFrame, sizes: list, every: int = 1) -> DataFrame:
    """(family, words, weight): runs of words of the paragraphs in ``known``; short runs at their start only, others at each ``every``-th word.

    The runs of a paragraph weigh ``PARAGRAPH_WEIGHT`` together, so that a short notice counts as much as a long one.
    """
    n = F.size("words")

    def of_size(size: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(every)), lambda at: (size <= n) & ((at == 1) | (size >= 6)))
        return F.transform(starts, lambda at: F.struct(at.alias("at"), size.alias("size")))
    spots = known.withColumn("spots", F.flatten(F.transform(F.array_distinct(F.array(*sizes)), of_size)))
    return (spots.select("family", "words", F.explode("spots").alias("s"), (F.lit(PARAGRAPH_WEIGHT) / F.size("spots")).alias("weight"))
            .select("family", F.slice("words", F.col("s.at"), F.col("s.size")).alias("words"), "weight"))


def fit(rows: DataFrame, plain: DataFrame, classes: list[str], known: DataFrame, steps: int, grams: Grams) -> Scanner:
    """The classifier of ``rows(family, x, weight)`` and the other text ``plain(x, weight)``, the last of ``classes``; believes a family from one half."""
    to_label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    rows = rows.select(to_label.cast("double").alias("label"), "x", "weight").coalesce(2)

    def regression(family: str, out: str) -> LogisticRegression:
        return LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family=family, regParam=1e-4, elasticNetParam=0.0, maxIter=steps,
                                  probabilityCol=out, rawPredictionCol="", predictionCol="")
    both = rows.withColumn("label", F.lit(1.0)).unionByName(plain.select(F.lit(0.0).alias("label"), "x", "weight"))
    return Scanner(grams, regression("binomial", "speaks_").fit(both), regression("multinomial", "which_").fit(rows), classes, 0.5, known)


def compared(judged: DataFrame, known: DataFrame) -> DataFrame:
    """Adds pairs and overlap, the best one with a template of the row's family; null for rows without pairs or such a template."""
    per_family = known.groupBy(F.col("family").alias("f")).agg(F.collect_list("pairs").alias("forms"))
    best = F.array_max(F.transform("forms", lambda t: shared("pairs", t)))
    return (judged.withColumn("pairs", word_pairs(F.col("words"))).join(per_family, F.col("family") == F.col("f"), "left")
            .withColumn("overlap", F.when(F.size("pairs") > 0, best)).drop("f", "forms"))


def least_believed(claims: DataFrame) -> float:
    """The probability that best parts true from false claims in ``claims(p, true, weight)``: the least sum of both error rates."""
    by_p = claims.groupBy("p").agg(F.sum(F.when(F.col("true"), F.col("weight")).otherwise(0.0)).alias("t"),
                                   F.sum(F.when(F.col("true"), 0.0).otherwise(F.col("weight"))).alias("f"))
    rows = sorted((r["p"], r["t"], r["f"]) for r in by_p.collect())  # at most 10001 rows: p is rounded to four places
    true, false = sum(t for _, t, _ in rows), sum(f for _, _, f in rows)
    if not true or not false:
        return 0.5
    best, lost, let_in = (1.0, 0.5), 0.0, false
    for p, t, f in rows:
        if p >= 0.5:
            best = min(best, (lost / true + let_in / false, p))
        lost, let_in = lost + t, let_in - f
    return best[1]


def train(docs: DataFrame, text_col: str = "text", given=TEMPLATES, unlisted=UNLISTED, other_weight: float = OTHER_WEIGHT,
          unknown_rate: float = UNKNOWN_RATE, folds: int = FAMILY_FOLDS) -> Scanner:
    """Fit on the templates, unlisted licences and all other paragraphs of ``docs`` (half of them to calibrate)."""
    spark = docs.sparkSession
    known = store(templates(spark, given), "license-templates")
    families = sorted({f for f, _ in given})
    foreign = templates(spark, [(UNKNOWN, t) for t in unlisted]).select("family", "words")
    lines = docs.select(F.explode(paragraphs(text_col)).alias("p")).where(F.trim("p") != "")
    # text that speaks of licences or holds a run of a template is no example of other text
    runs = sorted({" ".join(r["words"][i:i + 4]) for r in known.collect() for i in range(max(len(r["words"]) - 3, 1))})
    grams = Grams(spark, [r["words"] for r in known.select("words").unionByName(foreign.select("words")).collect()])
    # equal paragraphs have one MD5 and the same numbers: what is shuffled is much smaller than the texts
    in_run = run_among(runs)
    numbers = F.transform(F.filter(F.array(words(F.col("p"))), lambda w: ~in_run(w)), grams.numbers_of())  # of one paragraph or none: its words are split once
    others = (lines.where(~F.col("p").rlike(GATE))
              .select(F.unhex(F.md5("p")).alias("md5"), F.explode(numbers).alias("n"), F.pmod(F.xxhash64("p", F.lit(1)), F.lit(2)).cast("byte").alias("i"))
              .distinct())
    others = store(grams.vector(others, "n").select("x", "i"), "license-others")
    plain = others.where("i = 0").select("x")
    n_plain = plain.count()
    plain = plain.withColumn("weight", F.lit(min(1.0, other_weight / max(n_plain, 1)))).coalesce(max(2, n_plain // TRAIN_ROWS))
    n = F.size("words")
    sizes = [n, F.greatest(n - 1, F.lit(3)), F.least(n, F.lit(6)), F.least(n, F.lit(12))]
    taught = known.select("family", "words").unionByName(foreign)
    parts = [pieces(taught, sizes), pieces(taught, sizes, 3), pieces(known, [n, F.least(n, F.lit(PIECE))], 3)]
    parts = functools.reduce(DataFrame.unionByName, [part.withColumn("use", F.lit(use)) for use, part in enumerate(parts)])
    parts = store(grams.vector(parts.coalesce(4).withColumn("n", grams.numbers(F.col("words"))), "n").drop("n"), "license-train")
    classes = [*families, UNKNOWN, OTHER]
    scanner = fit(parts.where("use = 0"), plain, classes, known, FIT_STEPS, grams)

    # families left out in turn: what a model without them says of their paragraphs is a wrong claim,
    # what it says of pieces of the others (of a length it was not trained on) should be a right one
    scored = None
    for fold in range(folds if len(families) >= 2 * folds else 0):
        out = families[fold::folds]
        rest = known.where(~F.col("family").isin(out))
        model = fit(parts.where((F.col("use") == 1) & ~F.col("family").isin(out)), plain,
                    [f for f in families if f not in out] + [UNKNOWN, OTHER], known, FOLD_STEPS, grams)
        judged = compared(model.classify(parts.where("use = 2").withColumnRenamed("family", "truth"), hashed=True), rest)
        judged = judged.where(~F.col("family").isin(OTHER, UNKNOWN) & (F.col("overlap") >= MIN_OVERLAP))
        judged = judged.select(F.round("probability", 4).alias("p"), (F.col("truth") == F.col("family")).alias("true"), "weight")
        scored = judged if scored is None else scored.unionByName(judged)
    # p is rounded up to four places, so that its distinct values are few
    p = F.when(F.col("family").isin(OTHER, UNKNOWN), 0.0).otherwise(F.ceil(F.col("probability") * 10000) / 10000)
    judged = scanner.classify(others.where("i = 1"), hashed=True).select(p.alias("p"))
    limit = judged.agg(F.percentile("p", 1 - unknown_rate).alias("q")).first()["q"]
    scanner.least = max(0.5, float(limit or 0.0), least_believed(scored) if scored is not None else 0.5)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """(row, id, paragraph, text, family, probability, overlap): the paragraphs that speak of licences by position, family null if unknown;
    rows with a null paragraph stand for documents without any and for paragraphs that only seemed to."""
    forms = [r["pairs"] for r in scanner.known.select("pairs").collect()]
    at = F.filter(F.transform(paragraphs(text_col), lambda p, i: F.struct(i.alias("paragraph"), p.alias("text"))),
                  lambda x: x["text"].rlike(GATE) | confirmable(x["text"], forms, min_overlap))
    rows = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), at.alias("at"))  # numbered before, not after, they are exploded
            .select("row", "id", F.explode_outer("at").alias("p"))
            .select("row", "id", F.col("p.paragraph").alias("paragraph"), F.col("p.text").alias("text")).withColumn("words", words(F.col("text"))))
    judged = scanner.classify(rows)
    out = compared(judged, scanner.known)
    sure = ~F.col("family").isin(OTHER, UNKNOWN) & (F.col("probability") >= scanner.least) & (F.coalesce("overlap", F.lit(0.0)) >= min_overlap)
    out = out.withColumn("sure", sure)
    # without a word of the vocabulary and not confirmed: an ordinary paragraph, which leaves only its document's row
    kept = F.col("paragraph").isNotNull() & (F.col("sure") | F.col("text").rlike(GATE))
    return out.select("row", "id", F.when(kept, F.col("paragraph")).alias("paragraph"), F.when(kept, F.col("text")).alias("text"),
                      F.when(kept & F.col("sure"), F.col("family")).alias("family"), "probability", "overlap")


def documents(scanned: DataFrame) -> DataFrame:
    """(id, families, n_license, n_unknown, confidence) per document of ``scan``."""
    return (scanned.groupBy("row").agg(
        F.first("id").alias("id"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.count("family").alias("n_license"), F.count_if(F.col("paragraph").isNotNull() & F.col("family").isNull()).alias("n_unknown"),
        F.max(F.when(F.col("family").isNotNull(), F.col("probability"))).alias("confidence")).drop("row"))

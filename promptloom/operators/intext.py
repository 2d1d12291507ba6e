"""Reports on the sentences of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import rules
from promptloom.functions.clauses import overlap_udf, pairs_within
from promptloom.functions.compress import dedupe_masked_clauses
from promptloom.functions.regex import text_array
from promptloom.functions.staging import evaluate_here
from promptloom.functions.text import fences, protect_fences, restore_fences, strip


def dedupe_clauses(df: DataFrame, level: str, text: str = "text", into: str = "deduped"):
    """Drop sentences that repeat the intent of an earlier kept one; code is left alone."""
    masked = df.withColumn(into, evaluate_here(protect_fences(F.col(text))))
    folded = masked.withColumn(into, dedupe_masked_clauses(F.col(into), level))
    return folded.withColumn(into, restore_fences(F.col(into), fences(F.col(text))))


def overlapping_clauses(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """For each sentence that overlaps an earlier one: the first such sentence and their number.

    The comparison stays inside the row that holds the text: no pairs are shuffled or emitted.
    """
    found = overlap_udf(threshold)(F.col(text))
    return df.select(key, found.alias("_found")).select(
        key, F.explode("_found").alias("r")
    ).select(key, "r.*")


def _bag(sentence: Column) -> Column:
    """The distinct keywords of a sentence."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z]{3,}"), F.lit(0)))
    return F.array_except(words, text_array(sorted(rules.STOPWORDS)))


def clause_bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, first_pos, bag of every sentence with keywords: sentences of one text with the same keywords are one
    class, named by its first place. Equal texts under one key are one text; without a key there is none.

    The keywords travel once, as one string of a sentence: a fraction of what an array of strings takes."""
    parts = F.filter(F.transform(F.split(strip(F.col(text)), r"(?U)(?<=[.!?])\s+"), lambda s: strip(s)), lambda s: s != "")
    rows = df.where(F.col(key).isNotNull()).select(key, parts.alias("_parts")).select(key, F.posexplode("_parts").alias("pos", "_sentence"))
    words = evaluate_here(F.array_join(F.array_sort(_bag(F.col("_sentence"))), " "))
    bags = rows.select(key, "pos", words.alias("_words")).where("_words <> ''")
    first = F.min("pos").over(Window.partitionBy(key, "_words"))
    return bags.withColumn("first_pos", first).select(key, "pos", "first_pos", F.split("_words", " ").alias("bag"))


def overlapping_pairs(bags: DataFrame, key: str, threshold: float, most: int = 4096) -> DataFrame:
    """key, first_pos, second_pos, shared: the pairs of classes of one text (see :func:`clause_bags`) of which the
    smaller shares at least ``threshold`` of its keywords with the larger; ``shared`` is their number.

    The classes are shuffled once, by text, their keywords as one string. A text of up to ``most`` classes is compared
    where it arrives, class by class, by way of its rare keywords; the classes of longer texts spread over all tasks
    (:func:`_spread_pairs`). Both give all pairs.
    """
    kept = bags.where((F.col("pos") == F.col("first_pos")) & F.col(key).isNotNull() & (F.size("bag") > 0))
    classes = kept.select(key, F.col("pos").alias("at"), F.array_join("bag", " ").alias("words"))
    whole = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = classes.withColumn("_classes", F.count(F.lit(1)).over(whole))
    place = bags.schema["pos"].dataType
    pairs = T.StructType([bags.schema[key], T.StructField("first_pos", place), T.StructField("second_pos", place), T.StructField("shared", T.IntegerType())])
    short = sized.where(F.col("_classes") <= most).drop("_classes").sortWithinPartitions(key, "at")
    long = sized.where(F.col("_classes") > most).drop("_classes").repartition(key, "at")  # one exchange that all its readers share
    return short.mapInArrow(pairs_within(threshold, pairs.names), pairs).unionByName(_spread_pairs(long, key, threshold))


def _spread_pairs(classes: DataFrame, key: str, threshold: float) -> DataFrame:
    """The pairs of texts of any length, out of key, at, words.

    Of the n keywords of the smaller class, in any fixed order, one of the first n - need + 1 must be shared, where need
    is that part of n. With the keywords that are rare in the text first, a class looks up those few only, among all
    keywords of the others. Rows are (text, keyword), so one long text spreads over all tasks, and a pair is compared
    where it meets, once for each keyword that led to it.
    """
    bag = F.split("words", " ")
    words = classes.select(key, "at", "words", F.size(bag).alias("n"), F.explode(bag).alias("word"))
    often = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("often"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(threshold) * F.col("n") - 1e-9))
    rare = Window.partitionBy(key, "at", "words").orderBy("often", "word")
    leading = words.join(often, [key, "word"]).withColumn("_rank", F.dense_rank().over(rare)).where(F.col("_rank") <= F.col("n") - need + 1)
    small = leading.select(key, "word", F.col("at").alias("a"), F.col("n").alias("n_a"))
    large = words.select(key, "word", F.col("at").alias("b"), F.col("n").alias("n_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = small.join(large, [key, "word"]).where(smaller).select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(key, F.col("at").alias("a"), bag.alias("bag_a"))
    right = classes.select(key, F.col("at").alias("b"), bag.alias("bag_b"))
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    compared = met.where("a < b").join(left, [key, "a"]).join(right, [key, "b"]).withColumns({"shared": shared, "_least": F.least(F.size("bag_a"), F.size("bag_b"))})
    close = compared.where(F.col("shared") / F.col("_least") >= threshold)
    return close.select(key, F.col("a").alias("first_pos"), F.col("b").alias("second_pos"), "shared")

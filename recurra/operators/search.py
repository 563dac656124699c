"""Ranked search over a table of texts: TF-IDF with exact early termination.

A posting's impact is whole: the word's inverse document frequency in millionths times its count in the text (``CAP`` at most). A query's words
are ordered by the largest impact they can have. Its rarest words alone give a floor: the k-th best partial score, which no final k-th score can be
below. The words at the low end whose largest impacts together stay below the floor are optional: a text that has only these cannot
be among the best. So only postings of the other words are listed; optional words, the long lists, are looked up for the texts
found by (text, word), never read through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

CAP = 5


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))


def build_index(docs: DataFrame, key: str, text: str, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(item, word, impact) and (word, most, df): postings, and for each word its largest impact and number of texts. Both are written.

    With ``queries`` (qid, text) the index has the words they ask for, all others being of no use to them."""
    each = docs.select(F.col(key).alias("item"), F.col(text).alias("t")).repartition("item").select("item", F.explode(words(F.col("t"))).alias("word"))
    if queries is not None:
        each = each.join(materialise(queries.select(F.explode(words(F.col("text"))).alias("word")).distinct()), "word", "left_semi")
    tf = materialise(each.groupBy("item", "word").agg(F.least(F.count(F.lit(1)), F.lit(CAP)).alias("tf")))
    n = docs.count()
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("m"))
    df = df.select("word", "df", F.round(F.log(F.lit(float(n)) / F.col("df")) * 1e6).cast("long").alias("idf"), "m")
    found = tf.join(df.select("word", "idf"), "word").select("item", "word", (F.col("tf") * F.col("idf")).alias("impact"))
    return materialise(found), materialise(df.select("word", (F.col("m") * F.col("idf")).alias("most"), "df"))


def plan_words(queries: DataFrame, lexicon: DataFrame, postings: DataFrame, k: int, seeds: int) -> DataFrame:
    """qid, word, essential. ``queries`` has qid, text."""
    asked = queries.select("qid", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(lexicon, "word").filter("most > 0")
    order = Window.partitionBy("qid").orderBy(F.col("most").desc(), "word")
    asked = materialise(asked.withColumn("place", F.row_number().over(order)))                   # a query's words
    part = asked.filter(F.col("place") <= seeds).join(postings, "word").groupBy("qid", "item").agg(F.sum("impact").alias("s"))
    best = Window.partitionBy("qid").orderBy(F.col("s").desc())
    floor = part.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("qid", F.col("s").alias("floor"))
    rest = Window.partitionBy("qid").orderBy("most", F.col("word").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return asked.join(floor, "qid", "left").withColumn("essential", F.sum("most").over(rest) >= F.coalesce("floor", F.lit(0))).select("qid", "word", "essential")


def search(queries: DataFrame, index: tuple[DataFrame, DataFrame], k: int, seeds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, item, score) of each query's ``k`` best texts with a score above 0, ties to the smaller item; and qid, scored: how many postings
    were added up for it."""
    postings, lexicon = index
    plan = materialise(plan_words(queries, lexicon, postings, k, seeds))
    read = plan.filter("essential").join(postings, "word").select("qid", "item", "impact")
    read = materialise(read.groupBy("qid", "item").agg(F.sum("impact").alias("s"), F.count(F.lit(1)).alias("n")))
    looked = read.select("qid", "item").join(plan.filter("NOT essential").select("qid", "word"), "qid").join(postings, ["item", "word"]).select("qid", "item", F.col("impact").alias("s"), F.lit(1).alias("n"))
    total = read.unionByName(looked, allowMissingColumns=False).groupBy("qid", "item").agg(F.sum("s").alias("score"), F.sum("n").alias("n"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "item")
    top = total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "rank", "item", "score")
    return top, total.groupBy("qid").agg(F.sum("n").alias("scored"))

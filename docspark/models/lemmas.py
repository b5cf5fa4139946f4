"""Lemmas of words that no table lists: suffix rewrites counted from known pairs, the longest suffix wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.lookup import unique_terms
from docspark.session import materialize

#: Letters of a suffix at most, pairs that a rule needs, and letters that a lemma keeps of its form.
LONGEST, LEAST, STEM = 6, 2, 2


def common_start(a: Column, b: Column) -> Column:
    """How many letters two words share from the first on."""
    places = F.sequence(F.lit(0), F.least(F.char_length(a), F.char_length(b)))
    return F.array_max(F.filter(places, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)))


def suffixes(word: Column, longest: int) -> Column:
    """The word's last letters: none, one, and so on, with its whole as the longest."""
    n = F.least(F.char_length(word), F.lit(longest))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.substr(word, F.char_length(word) - k + 1, k))


def suffix_rules(pairs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``suffix, cut, add, n`` from ``form, lemma``: what words with a suffix lose and get instead, most often.

    Each pair counts for all suffixes of its form that hold what it loses. A suffix takes its most frequent
    rewrite, of equal ones the one that cuts least, then adds the first in order; it needs ``least`` pairs.
    Pairs are counted once each; null ones do not count.
    """
    known = pairs.select("form", "lemma").where("form IS NOT NULL AND lemma IS NOT NULL").distinct()
    cut = (F.char_length("form") - F.col("start")).cast("int")
    rows = known.withColumn("start", common_start(F.col("form"), F.col("lemma"))).select("form", cut.alias("cut"), F.expr("substr(lemma, start + 1)").alias("add"))
    each = rows.select("cut", "add", F.explode(suffixes(F.col("form"), longest)).alias("suffix")).where(F.char_length("suffix") >= F.col("cut"))
    counted = each.groupBy("suffix", "cut", "add").agg(F.count("*").alias("n"))
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("best"))
    return best.select("suffix", "best.cut", "best.add", (-F.col("best.n")).alias("n")).where(F.col("n") >= least)


def induced_lemmas(terms: DataFrame, rules: DataFrame, known: DataFrame | None = None, longest: int = LONGEST, stem: int = STEM) -> DataFrame:
    """``term, value`` for distinct ``term``: the known lemma, else by the rule of the longest suffix, else the term.

    Only distinct terms meet the rules, by a join on their suffixes. A rule must leave ``stem`` letters
    of the term. ``known`` is a table ``term, value``; the result serves ``lookup_terms``.
    """
    rows = terms.select("term").where(F.col("term").isNotNull()).distinct()
    asked = rows.select("term", F.explode(suffixes(F.col("term"), longest)).alias("suffix"))
    met = asked.join(rules, "suffix").where(F.char_length("term") - F.col("cut") >= stem)
    best = met.groupBy("term").agg(F.max_by(F.struct("cut", "add"), F.char_length("suffix")).alias("best"))
    ruled = rows.join(best, "term", "left").select(
        "term", F.coalesce(F.concat(F.expr("substr(term, 1, char_length(term) - best.cut)"), F.col("best.add")), "term").alias("value")
    )
    if known is None:
        return ruled
    listed = unique_terms(known).withColumnRenamed("value", "_listed")
    return ruled.join(listed, "term", "left").select("term", F.coalesce("_listed", "value").alias("value"))


def pairs_of_vocabulary(frequencies: DataFrame, endings: list[str]) -> DataFrame:
    """``form, lemma`` where a form is a more frequent word of the vocabulary with one of the ``endings`` behind it.

    ``frequencies`` has ``term, df``. A stand-in for a list of lemmas where there is none.
    """
    words = materialize(frequencies.select("term", "df"), "terms")
    ending = F.explode(F.array(*map(F.lit, endings)))
    cut = words.select(F.col("term").alias("form"), F.col("df").alias("_df"), ending.alias("_ending")).where(F.endswith("form", F.col("_ending")))
    stems = cut.select("form", "_df", F.expr("substr(form, 1, char_length(form) - char_length(_ending))").alias("lemma"))
    return stems.join(words.withColumnRenamed("term", "lemma"), "lemma").where(F.col("df") > F.col("_df")).select("form", "lemma")

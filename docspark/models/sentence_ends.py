"""Sentence ends learned from counts: which periods belong to abbreviations, and which words start sentences.

Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection (2006): log-likelihood ratios of
corpus counts instead of a list of abbreviations.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.lookup import join_back, join_terms
from docspark.session import materialize

# Fixed values of the method: thresholds of abbreviations and starters, and how often an abbreviation bears its period.
ABBREVIATION, STARTER, CERTAIN = 0.3, 30.0, 0.99
#: What may stand around a word, and after its period.
AROUND = r"^[\"'(\[{«“„‘]+|[\"')\]}»”’,;:]+$"
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"^[\p{L}\p{M}.]*\p{L}\.?$"


def bare(token: Column) -> Column:
    """A token without brackets, quotes, commas and the like around it."""
    return F.regexp_replace(token, AROUND, "")


def word_type(token: Column) -> Column:
    """The word in lower case without its last period."""
    return F.lower(F.regexp_replace(bare(token), r"\.$", ""))


def text_tokens(text: Column) -> Column:
    """Words as they stand between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda t: t != "")


def has_mark(token: Column) -> Column:
    """Whether a token may end a sentence; few do, and only those need its patterns."""
    return token.contains(".") | token.contains("!") | token.contains("?")


def type_counts(docs: DataFrame, text: str) -> DataFrame:
    """``type, with_period, plain``: how often every word stands with and without a period at its end.

    Tokens are counted as they stand first, so that types are made of distinct tokens only.
    """
    distinct = docs.select(F.explode(text_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    words = distinct.select(bare(F.col("token")).alias("word"), "n").where(F.col("word").rlike(WORD))
    ends = F.col("word").endswith(".")
    counted = words.groupBy(word_type(F.col("word")).alias("type"))
    return counted.agg(F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("with_period"), F.sum(F.when(ends, 0).otherwise(F.col("n"))).alias("plain"))


def log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of ``k`` hits in ``n`` trials of chance ``p``; nothing where a factor is to the power 0."""
    hits = F.when(k > 0, k * F.log(p)).otherwise(0.0)
    return hits + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def abbreviation_scores(counts: DataFrame, n_words: int, n_periods: int) -> DataFrame:
    """``type, with_period, plain, score`` of the words that ever bear a period.

    The ratio between a period that is nearly always there and one by chance, scaled down by the length of
    the word, up by periods within it, and down by its occurrences without one.
    """
    k, n = F.col("with_period"), F.col("with_period") + F.col("plain")
    chance = F.lit(n_periods / max(n_words, 1))
    ratio = 2 * (log_likelihood(k, n, F.lit(CERTAIN)) - log_likelihood(k, n, chance))
    inner = F.regexp_count("type", F.lit(r"\."))
    length = F.char_length("type") - inner
    score = ratio * F.exp(-length.cast("double")) * (inner + 1) * F.pow(length.cast("double"), -F.col("plain").cast("double"))
    return counts.where(k > 0).withColumn("score", score)


def after_breaks(docs: DataFrame, text: str) -> DataFrame:
    """``type, next, n``: the tokens that follow a token ending in ``.``, ``!`` or ``?``, counted."""
    tokens = docs.select(text_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("tokens") - 2), lambda i: F.struct(F.get("tokens", i).alias("token"), F.get("tokens", i + 1).alias("next")))
    ending = F.filter(pairs, lambda p: has_mark(p["token"]) & bare(p["token"]).rlike(r"[.!?]$"))
    found = tokens.select(F.inline(ending))
    return found.groupBy(word_type(F.col("token")).alias("type"), F.regexp_replace(bare(F.col("next")), r"\.$", "").alias("next")).agg(F.count("*").alias("n"))


class SentenceEnds:
    """Tables of abbreviations (``type``) and sentence starters (``word``), with their scores."""

    def __init__(self, abbreviations: DataFrame, starters: DataFrame):
        self.abbreviations, self.starters = abbreviations, starters

    def save(self, path: str) -> None:
        self.abbreviations.write.mode("overwrite").parquet(f"{path}/abbreviations")
        self.starters.write.mode("overwrite").parquet(f"{path}/starters")

    @classmethod
    def load(cls, path: str) -> SentenceEnds:
        spark = SparkSession.getActiveSession()
        return cls(spark.read.parquet(f"{path}/abbreviations"), spark.read.parquet(f"{path}/starters"))

    def split(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``key, pos, sentence``: the sentences of each text in order, words joined by one space.

        A sentence ends at ``!`` or ``?``, at a period whose word is no abbreviation, and at an abbreviation's
        period if a capitalised starter follows. Only candidate places leave their row, meet the two
        tables by joins, and come back as a list of places. ``key`` is unique; texts without words give no rows.
        """
        rows = docs.select(F.col(key).alias("_key"), text_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
        places = F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t.alias("token"), F.get("tokens", i + 1).alias("next")))
        open_places = rows.select("_key", F.inline(F.filter(places, lambda p: p["token"].contains(".") & bare(p["token"]).rlike(r"\.$") & p["next"].isNotNull())))
        asked = open_places.select("_key", "at", word_type(F.col("token")).alias("type"), F.regexp_replace(bare(F.col("next")), r"\.$", "").alias("next"))
        known = join_terms(asked, self.abbreviations.select("type", F.lit(True).alias("_short")), "type", ["_key", "at"], "left")
        lower = known.withColumn("word", F.when(F.col("_short") & F.col("next").rlike(r"^\p{Lu}"), F.lower("next")))
        found = join_terms(lower, self.starters.select("word", F.lit(True).alias("_starts")), "word", ["_key", "at"], "left")
        inner = found.where(F.col("_short") & F.col("_starts").isNull()).groupBy("_key").agg(F.collect_set("at").alias("_inner"))
        both = join_back(rows, inner, ["_key"]).withColumn("_inner", F.coalesce("_inner", F.array().cast("array<int>")))
        ends = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i == F.size("tokens") - 1) | (has_mark(F.get("tokens", i)) & bare(F.get("tokens", i)).rlike(r"[.!?]$") & ~F.array_contains("_inner", i)))
        marked = both.select("_key", "tokens", ends.alias("_ends"))
        start = lambda k: F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1)  # noqa: E731 (a list of starts would be made anew for every sentence)
        cut = F.transform("_ends", lambda e, k: F.array_join(F.slice("tokens", start(k) + 1, e + 1 - start(k)), " "))
        return marked.select(F.col("_key").alias(key), F.posexplode(cut).alias("pos", "sentence"))


def fit_sentence_ends(docs: DataFrame, text: str) -> SentenceEnds:
    """Learn abbreviations and sentence starters from all texts; only totals reach the driver."""
    counts = materialize(type_counts(docs, text), "types")
    total = counts.agg(F.sum("with_period"), F.sum(F.col("with_period") + F.col("plain"))).first()
    n_periods, n_words = total[0] or 0, total[1] or 0
    scores = abbreviation_scores(counts, n_words, n_periods)
    short = materialize(scores.where(F.col("score") >= ABBREVIATION).select("type", "with_period", "plain", "score"), "abbreviations")
    following = after_breaks(docs, text).where(F.col("next").rlike(r"^[\p{L}\p{M}.]*\p{L}$"))
    breaks = materialize(following.join(short.select("type"), "type", "left_anti").groupBy(F.lower("next").alias("type")).agg(F.sum("n").alias("after")), "starts")
    n_breaks = breaks.agg(F.sum("after")).first()[0] or 0
    k, n = F.col("after"), F.col("with_period") + F.col("plain")
    chance, here, other = n / max(n_words, 1), k / max(n_breaks, 1), (n - k) / max(n_words - n_breaks, 1)
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    rest = F.lit(max(n_words - n_breaks, 1))
    ratio = 2 * (log_likelihood(k, F.lit(n_breaks), clip(here)) + log_likelihood(n - k, rest, clip(other)) - log_likelihood(k, F.lit(n_breaks), clip(chance)) - log_likelihood(n - k, rest, clip(chance)))
    starters = breaks.join(counts, "type").where(here > chance).select(F.col("type").alias("word"), "after", ratio.alias("score")).where(F.col("score") >= STARTER)
    return SentenceEnds(short, materialize(starters, "starters"))

"""The registered queries: each reads whole tables of the given folder through the library."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.clean import clean_text, strip_markup
from docspark.functions.scores import argmax, cross_entropy, decode_label, head_forward, one_hot
from docspark.functions.tokens import as_text, filter_tokens, sentences
from docspark.models.bags import packed, term_places, write_weights
from docspark.models.features import dense_topics, drop_small, fourier_map
from docspark.models.head import fit_head, sequence_scorer
from docspark.models.language import fit_language_model, language_profile
from docspark.models.lemmas import induced_lemmas, pairs_of_vocabulary, suffix_rules
from docspark.models.ngram import fit_ngrams
from docspark.models.sentence_ends import abbreviation_scores, fit_sentence_ends, type_counts
from docspark.models.stepwise import fit_stepwise
from docspark.models.topics import PASSES, TOPICS, fit_topics
from docspark.models.vectors import VECTOR_SIZE, fit_vectors, projected
from docspark.operators import evaluate, labels, training_log, vocabulary
from docspark.operators.lookup import lookup_terms
from docspark.operators.rows import keep_rows
from docspark.plans import classical, sequence, training
from docspark.plans.extraction import clean_segments, rejoin_segments, segments_in_language
from docspark.session import fresh_path, materialize, spread
from docspark.sources.documents import KEYED_COLUMNS, KEYED_SCHEMA, read_documents_csv, write_documents_csv
from docspark.sources.files import extract_units, label_names
from docspark.sources.nesting import first_nested
from docspark.sources.units import scan_trans_units

# What the pages have in place of translation units, and of labels in file names.
PAGE_UNIT = r'(?s)<(?:p|div class="ad")>(.*?)</(?:p|div)>'
PAGE_LABELS = {
    "category": r"^https?://[^/]+/([a-z]{2})/",
    "subcategory": r"[?&]ref=(\w+)",
    "target_id": r"/(\d+)(?:[/?#]|$)",
}
LANGUAGE_NAMES = {"en": "english", "de": "german"}
ENDINGS = ["s", "en", "ing", "er"]
LEMMAS = {"thes": "the", "thats": "that", "onen": "on", "eing": "be", "ering": "er"}
MAX_LEN = 50
LONG_LEN, LONGEST_LEN = 512, 1000
SENTENCE_LEN = 50
TOKEN_LIMIT, CHAR_LIMIT, TERM_LIMIT = 50, 1_000_000, 100_000
CLASSES, WIDTH, INPUTS, FOURIER = 10, 16, 64, 32
BATCH = 50
REPORT_EVERY, PATIENCE = 6, 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Document columns for work on every text."""
    return spread(table(spark, folder, "documents").select(*(columns or ("doc_id", "text"))))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages").select("page_id", "html"))


# ---- extraction -------------------------------------------------------------------------------


def path_labels(spark, folder):
    return label_names(table(spark, folder, "pages"), "url", **PAGE_LABELS).select(
        "page_id", "category", "subcategory", "target_id"
    )


def category_alias(spark, folder):
    named = label_names(table(spark, folder, "pages"), "url", **PAGE_LABELS)
    return named.select("page_id", labels.repair_category(F.col("category"), LANGUAGE_NAMES).alias("category"))


def page_segments(spark, folder):
    return extract_units(pages(spark, folder), "html", PAGE_UNIT, "page_id")


def segment_extract(spark, folder):
    return page_segments(spark, folder)


def segment_filter(spark, folder):
    return page_segments(spark, folder).filter(F.col("segment").rlike(r"<b[\s/>]"))


def strip_html(spark, folder):
    return pages(spark, folder).select("page_id", strip_markup(F.col("html")).alias("text"))


def nested_text(spark, folder):
    """The first paragraph of every article that has a heading, by the tree of its tags."""
    return first_nested(pages(spark, folder), "html", "page_id", unit="article", child="p", having="h1")


def unit_scan(spark, folder):
    """Documents written as files of translation units, labels in the folders' names, and read back in splits.

    Only units of English documents have an alternative translation, so only they come back.
    """
    docs = documents(spark, folder, "doc_id", "source", "lang", "text")
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    other = F.when(F.col("lang") == "en", "<alt-trans/>").otherwise("")
    unit = F.concat(F.lit('<trans-unit id="'), "doc_id", F.lit('"><source>'), escaped, F.lit("</source>"), other, F.lit("</trans-unit>"))
    label = F.concat(F.lit("#category#"), "source", F.lit("#subcategory#"), "lang", F.lit("#"))
    path = fresh_path(spark, "units")
    docs.select(unit.alias("value"), label.alias("file")).write.partitionBy("file").text(path)
    found = label_names(scan_trans_units(spark, path), "file")
    return found.select("category", "subcategory", F.regexp_extract("unit", r'id="(\d+)"', 1).cast("long").alias("doc_id"), "segment")


def clean_documents(spark, folder):
    docs = documents(spark, folder).select("doc_id", clean_text(F.col("text")).alias("text"))
    return keep_rows(docs, lambda row: F.length(row["text"]) > 0)


def english_page_segments(spark, folder):
    docs = documents(spark, folder, "lang", "text").select("lang", clean_text(F.col("text"), "safe").alias("text"))
    model = fit_language_model(docs, "text", "lang")
    return segments_in_language(clean_segments(page_segments(spark, folder)), model, "en", ["page_id", "pos"])


def english_segments(spark, folder):
    return english_page_segments(spark, folder).select("page_id", "pos", "segment")


def rejoined_pages(spark, folder):
    return rejoin_segments(english_page_segments(spark, folder), "page_id")


def rejoin_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    return rejoin_segments(turns, "conv_id", position="turn", segment="text")


def csv_round_trip(spark, folder):
    docs = documents(spark, folder, "doc_id", "lang", "source", "text").withColumn("text", clean_text(F.col("text")))
    docs = keep_rows(docs, lambda row: F.length(row["text"]) > 0)
    path = fresh_path(spark, "documents-csv")
    write_documents_csv(
        docs.select(
            F.col("doc_id").cast("string").alias("doc_id"),
            F.col("text").alias("sources"),
            F.col("lang").alias("categories"),
            F.col("source").alias("subcategories"),
            F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("targetids"),
        ),
        path,
        KEYED_COLUMNS,
    )
    return read_documents_csv(spark, path, KEYED_SCHEMA).withColumn("doc_id", F.col("doc_id").cast("bigint"))


# ---- language ---------------------------------------------------------------------------------


def lang_profile(spark, folder):
    profile = language_profile(documents(spark, folder, "lang", "text"), "text", "lang")
    return profile.withColumn("log_prob", F.round("log_prob", 6))


def predicted_languages(spark, folder):
    docs = documents(spark, folder, "doc_id", "lang", "text")
    return fit_language_model(docs, "text", "lang").transform(docs, "text", keys=["doc_id"], keep=["doc_id", "lang"])


def lang_predict(spark, folder):
    return predicted_languages(spark, folder).select("doc_id", "lang", "prediction")


def lang_report(spark, folder):
    pairs = evaluate.pair_counts(predicted_languages(spark, folder), "lang")
    return rounded_report(evaluate.classification_report(pairs))


def sentence_split(spark, folder):
    rows = sequence.sentence_rows(documents(spark, folder), "doc_id", "text")
    return rows.filter(F.col("sentence").isNotNull())


def abbreviations(spark, folder):
    """Every word that bears a period somewhere, and how much it looks like an abbreviation."""
    counts = materialize(type_counts(documents(spark, folder, "text"), "text"), "types")
    total = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("plain")).alias("words")).first()
    return abbreviation_scores(counts, total.words, total.periods).withColumn("score", F.round("score", 6))


def sentences_learned(spark, folder):
    docs = documents(spark, folder)
    return fit_sentence_ends(docs, "text").split(docs, "doc_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


def sentence_vote(spark, folder):
    docs = documents(spark, folder, "doc_id", "lang", "text")
    model = fit_language_model(docs, "text", "lang")
    return sequence.vote_by_sentence(docs, "doc_id", "text", lambda rows: model.transform(rows, "sentence", "label", ["doc_id", "pos"], ["doc_id", "pos"]))


def ngram_classify(spark, folder):
    docs = documents(spark, folder, "doc_id", "lang", "text")
    return fit_ngrams(docs, "text", "lang").predict(docs, ["doc_id"], "text")


# ---- tokens, vocabulary, sequences --------------------------------------------------------------


def document_tokens(spark, folder):
    return documents(spark, folder).select("doc_id", filter_tokens(F.col("text")).alias("tokens"))


def token_filter(spark, folder):
    """The original's limits are the feature here: the first tokens of the first characters."""
    tokens = filter_tokens(F.col("text"), max_tokens=TOKEN_LIMIT, max_chars=CHAR_LIMIT).alias("tokens")
    return documents(spark, folder).select("doc_id", tokens).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def lemma_lookup(spark, folder):
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "term string, value string")
    found = lookup_terms(document_tokens(spark, folder), ["doc_id"], "tokens", lemmas, "tokens")  # the tokens themselves do not travel along
    return found.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


def vocabulary_rules(spark, folder):
    """Frequencies of all words, and rules from the words that are others of them with an ending."""
    frequencies = materialize(vocabulary.document_frequency(document_tokens(spark, folder)), "frequencies")
    return frequencies, suffix_rules(pairs_of_vocabulary(frequencies, ENDINGS))


def lemma_rules(spark, folder):
    rules = vocabulary_rules(spark, folder)[1]
    return rules.withColumn("cut", F.col("cut").cast("bigint"))


def lemma_induced(spark, folder):
    """A lemma for every word of the documents."""
    frequencies, rules = vocabulary_rules(spark, folder)
    return induced_lemmas(frequencies, materialize(rules, "rules"))


def vocab_df(spark, folder):
    return vocabulary.document_frequency(document_tokens(spark, folder))


def pruned_terms(docs, **limits):
    kept = vocabulary.prune_terms(vocabulary.document_frequency(docs), docs.count(), **limits)
    return vocabulary.number_terms(kept)


def vocab_prune(spark, folder):
    return pruned_terms(document_tokens(spark, folder), keep=TERM_LIMIT)


def vocab_topk(spark, folder):
    return vocabulary.top_terms(vocabulary.document_frequency(document_tokens(spark, folder)), 100)


def bag_of_words(spark, folder):
    docs = materialize(document_tokens(spark, folder), "tokens")
    return vocabulary.bag_of_words(docs, pruned_terms(docs), "doc_id")


def vocabulary_of(spark, folder):
    return sequence.word_vocabulary(documents(spark, folder, "text"), "text")


def sequence_ids(spark, folder):
    docs = documents(spark, folder)
    found = sequence.word_ids(docs, "text", ["doc_id"], vocabulary_of(spark, folder), None)
    return found.select("doc_id", F.array_join("ids", " ").alias("ids"))


def flat_sequences(rows, text, keys, vocabulary, max_len):
    found = sequence.sequence_rows(rows, text, keys, vocabulary, max_len)
    return found.select(*keys, *[F.array_join(part, " ").alias(part) for part in ("ids", "mask", "token_type_ids")])


def sequence_pad(spark, folder):
    items = table(spark, folder, "benchmark")
    return flat_sequences(items, "text", ["item_id"], vocabulary_of(spark, folder), MAX_LEN)


def document_sequences(spark, folder):
    docs = documents(spark, folder)
    return flat_sequences(docs, "text", ["doc_id"], vocabulary_of(spark, folder), MAX_LEN)


def long_sequences(spark, folder):
    docs = documents(spark, folder)
    return flat_sequences(docs, "text", ["doc_id"], vocabulary_of(spark, folder), LONG_LEN)


def sentence_sequences(spark, folder):
    rows = sentence_split(spark, folder)
    return flat_sequences(rows, "sentence", ["doc_id", "pos"], vocabulary_of(spark, folder), SENTENCE_LEN)


def sequence_vote(spark, folder):
    """Sentences as sequences through a scorer with closed-form scores, then the vote per document."""

    def load():
        ranks = np.arange(1, 5)

        def predict(ids, mask, kinds):
            return (np.sin(ids[:, :, None] * ranks) * mask[:, :, None]).sum(axis=1)

        return predict

    vocabulary = vocabulary_of(spark, folder)
    scorer = sequence_scorer(load, SENTENCE_LEN, batch_size=4096)

    def score(rows):
        found = sequence.sequence_rows(rows, "sentence", ["doc_id", "pos"], vocabulary, SENTENCE_LEN)
        return sequence.score_sequences(found, scorer).withColumn("label", argmax(F.col("scores")))

    return sequence.vote_by_sentence(documents(spark, folder), "doc_id", "text", score)


def text_cast(spark, folder):
    """Values of other types as text, with a word for what is missing."""
    value = F.when(F.col("quality") > 0, F.col("quality"))
    return table(spark, folder, "labels").select("doc_id", as_text(value, "nan").alias("text"))


def tokens_persisted(spark, folder):
    """Tokens written once and read by two jobs: their number, and the documents each occurs in."""
    docs = materialize(document_tokens(spark, folder), "tokens")
    counts = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.join(vocabulary.document_frequency(docs), "term")


def feature_concat(spark, folder):
    """Dense topic scores followed by a vector, as the classifier's features are put together."""
    topics = dense_topics(F.array(F.struct(F.pmod("label", F.lit(3)).cast("int"), F.lit(0.5))), 3)
    both = table(spark, folder, "embeddings").withColumn("topics", topics)
    rows = both.select("vec_id", F.posexplode(F.concat("topics", F.col("embedding").cast("array<double>"))).alias("j", "value"))
    return rows.select("vec_id", F.col("j").cast("bigint").alias("j"), F.round("value", 6).alias("value"))


def doc_prefix(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang").orderBy("doc_id").limit(10)


def combined_features(spark, folder):
    docs = documents(spark, folder)
    left = docs.select("doc_id", F.array(F.length("text"), F.size(sentences(F.col("text")))).alias("a"))
    right = table(spark, folder, "labels").select("doc_id", F.array("quality", "toxic").alias("b"))
    both = left.join(right, "doc_id").withColumn("features", F.concat("a", "b"))
    return both.select("doc_id", F.array_join("features", " ").alias("features"))


# ---- labels -----------------------------------------------------------------------------------


def label_index(spark, folder):
    return labels.label_index(table(spark, folder, "documents"), "source")


def class_counts(spark, folder):
    return labels.class_counts(table(spark, folder, "documents"), "lang")


def one_hot_rows(spark, folder):
    docs = table(spark, folder, "documents")
    known = labels.label_array(labels.fit_labels(docs, "lang"))
    row = F.transform(one_hot(F.col("lang"), known), lambda v: v.cast("int"))
    return docs.select("doc_id", F.array_join(row, " ").alias("target"))


# ---- scores and evaluation ----------------------------------------------------------------------


def scored_vectors(spark, folder):
    """``vec_id, label, scores``: all vectors through a head with closed-form weights."""
    j, i, k = np.arange(WIDTH), np.arange(INPUTS), np.arange(CLASSES)
    hidden = np.cos(0.1 * i[None, :] * j[:, None])
    output = np.sin(0.3 * j[None, :] + k[:, None])
    head = head_forward(hidden, output)
    return table(spark, folder, "embeddings").select("vec_id", "label", head("embedding").alias("scores"))


def head_scores(spark, folder):
    long = scored_vectors(spark, folder).select("vec_id", F.posexplode("scores").alias("class", "score"))
    return long.select("vec_id", F.col("class").cast("bigint").alias("class"), F.round("score", 6).alias("score"))


def rbf_features(spark, folder):
    i, j = np.arange(INPUTS), np.arange(FOURIER)
    mapped = fourier_map(np.sin(1.7 * (i[None, :] + 1) * (j[:, None] + 1)), j.astype("float64"))
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode(mapped("embedding")).alias("j", "value"))
    return rows.select("vec_id", F.col("j").cast("bigint").alias("j"), F.round("value", 6).alias("value"))


def decoded(spark, folder):
    """``vec_id, label, prediction`` as category names of the fitted classes."""
    names = labels.label_array([f"class{i}" for i in range(CLASSES)])
    scored = scored_vectors(spark, folder)
    return scored.select(
        "vec_id",
        decode_label(F.col("label"), names).alias("label"),
        decode_label(argmax(F.col("scores")), names).alias("prediction"),
    )


def class_pairs(spark, folder):
    return evaluate.pair_counts(decoded(spark, folder))


def entry_pairs(spark, folder):
    """Truth against the largest of all entries of a vector: most predictions lie outside the truth."""
    vectors = table(spark, folder, "embeddings").select("label", argmax(F.col("embedding")).alias("prediction"))
    return evaluate.pair_counts(vectors)


def argmax_label(spark, folder):
    return decoded(spark, folder)


def losses(spark, folder):
    return scored_vectors(spark, folder).select("vec_id", cross_entropy(F.col("scores"), F.col("label")).alias("loss"))


def cross_entropy_rows(spark, folder):
    return losses(spark, folder).withColumn("loss", F.round("loss", 6))


def validation_loss(spark, folder):
    return evaluate.mean_loss(losses(spark, folder)).withColumn("loss", F.round("loss", 6))


def epoch_loss(spark, folder):
    batches = training_log.file_batches(losses(spark, folder), "vec_id", BATCH)
    return evaluate.epoch_loss(batches).withColumn("loss", F.round("loss", 6))


def accuracy(spark, folder):
    return evaluate.accuracy(class_pairs(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


def confusion_long(spark, folder):
    return evaluate.confusion_matrix(class_pairs(spark, folder), "truth")


def confusion_wide(spark, folder):
    return evaluate.confusion_wide(class_pairs(spark, folder), [f"class{i}" for i in range(CLASSES)], "pred_")


def rounded_report(report):
    return report.withColumns({m: F.round(m, 6) for m in ("precision", "recall", "f1")})


def classification_report(spark, folder):
    return rounded_report(evaluate.classification_report(class_pairs(spark, folder)))


def report_union(spark, folder):
    return rounded_report(evaluate.classification_report(entry_pairs(spark, folder), "union"))


def report_labels(spark, folder):
    return evaluate.report_labels(entry_pairs(spark, folder))


def unseen_predictions(spark, folder):
    return evaluate.unseen_predictions(entry_pairs(spark, folder))


def majority_vote(spark, folder):
    return evaluate.majority_vote(table(spark, folder, "events"), "user_id", "event_type", "event_id")


# ---- training log -------------------------------------------------------------------------------


def minibatch(spark, folder):
    return training_log.shuffled_batches(table(spark, folder, "documents").select("doc_id"), "doc_id", BATCH)


def file_batch(spark, folder):
    return training_log.file_batches(table(spark, folder, "documents").select("doc_id"), "doc_id", BATCH)


def event_log(spark, folder):
    """Events as a training log: a run per user, an epoch per half of the month, a step per event."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.when(F.dayofmonth("ts") > 15, 1).otherwise(0).cast("bigint").alias("epoch"),
        F.col("event_id").alias("place"),
        F.col("value").alias("loss"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("n_correct"),
        F.lit(1).alias("n"),
    )


def epoch_summary(spark, folder):
    return training_log.epoch_summary(event_log(spark, folder), ["run", "epoch"], "loss", "n_correct", "n")


def training_curve(spark, folder):
    return training.curve_of_log(event_log(spark, folder), every=REPORT_EVERY).drop("place")


def early_stop(spark, folder):
    stops = training.stops_of_log(event_log(spark, folder), patience=PATIENCE, every=REPORT_EVERY)
    return stops.select("run", "epoch", "step", "loss", "accuracy", "peak")


# ---- features ---------------------------------------------------------------------------------


def topic_dense(spark, folder):
    """Users' shares of event types as sparse topic scores, made dense."""
    events = table(spark, folder, "events")
    kinds = labels.fit_labels(events, "event_type")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    topic = labels.encode_label(F.col("event_type"), kinds)
    pairs = counts.groupBy("user_id").agg(
        F.collect_list(F.struct(topic.alias("topic"), F.col("n").alias("n"))).alias("pairs"), F.sum("n").alias("total")
    )
    scored = pairs.select(
        "user_id", F.transform("pairs", lambda p: F.struct(p["topic"], p["n"] / F.col("total"))).alias("pairs")
    )
    dense = scored.select("user_id", F.posexplode(dense_topics(F.col("pairs"), len(kinds), 0.2)).alias("topic", "score"))
    return dense.select("user_id", F.col("topic").cast("bigint").alias("topic"), F.round("score", 6).alias("score"))


def held_out(docs, share: int = 4):
    """The fold of the held-out queries: one document in ``share``, by its id, is not learned from."""
    out = F.col("doc_id") % share == 0
    return docs.where(~out), docs.where(out)


def class_rows(predicted, truth: str = "lang", least: float = 0.9, *also: str):
    """``lang, n, accurate`` and what must hold for every row: predictions per class, and whether enough of all are right."""
    right = F.sum(F.when(F.col(truth) == F.col("prediction"), 1).otherwise(0))
    by_class = predicted.groupBy(truth).agg(F.count("*").alias("n"), right.alias("_right"), *[F.bool_and(name).alias(name) for name in also])
    by_class = materialize(by_class, "classes")
    total = by_class.agg(F.sum("_right"), F.sum("n")).first()
    return by_class.select(truth, "n", F.lit((total[0] or 0) >= least * (total[1] or 0)).alias("accurate"), *also)


def document_bags(docs):
    """The pruned vocabulary of ``doc_id, tokens`` and the packed bags."""
    terms = materialize(pruned_terms(docs), "terms")
    return terms, packed(docs, terms, "doc_id")


def document_topics(spark, folder):
    """``doc_id, topics`` of all documents by topics fitted on them; even ones without a known term."""
    docs = materialize(document_tokens(spark, folder), "tokens")
    terms, bags = document_bags(docs)
    model = fit_topics(bags, terms, "doc_id")
    shares = docs.select("doc_id").join(model.shares(bags, "doc_id"), "doc_id", "left")
    return shares.withColumn("topics", F.coalesce("topics", F.array_repeat(F.lit(1.0 / TOPICS), TOPICS))), model


def topic_sums(spark, folder):
    """What fitted topics must satisfy: as many shares as topics, none below zero, adding up to one, per document."""
    scored, _ = document_topics(spark, folder)
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    whole = (F.abs(total - 1) < 1e-9) & (F.array_min("topics") >= 0)
    return scored.select("doc_id", F.size("topics").cast("bigint").alias("n_topics"), whole.alias("whole"))


def topic_bound(spark, folder):
    """Whether each pass over the documents raised the bound on their likelihood."""
    docs = materialize(document_tokens(spark, folder), "tokens")
    terms, bags = document_bags(docs)
    bounds = fit_topics(bags, terms, "doc_id", watch=True).bounds
    rows = [(i, i == 0 or bounds[i] > bounds[i - 1]) for i in range(len(bounds))]
    return spark.createDataFrame(rows, "pass long, rises boolean")


def vector_projection(spark, folder):
    """Documents through term weights with a closed form: what a pass over the bags sums."""
    docs = materialize(document_tokens(spark, folder), "tokens")
    terms, bags = document_bags(docs)
    weights = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.sin(0.7 * (F.col("term_id") + 1) * (j + 1)))
    path = write_weights(term_places(terms).select("block", "id", weights.alias("weights")), "weights")
    blocks = bags.agg(F.max("block")).first()[0]
    rows = projected(bags, "doc_id", path, WIDTH, (blocks or 0) + 1)
    long = rows.select("doc_id", F.posexplode("vector").alias("j", "value"))
    return long.select("doc_id", F.col("j").cast("bigint").alias("j"), F.round("value", 6).alias("value"))


def svm_held_out(spark, folder):
    """Fitted, saved and loaded: predictions of held-out documents, and whether the loaded model gives the same."""
    learn, test = held_out(documents(spark, folder, "doc_id", "lang", "text"))
    model = classical.fit_domain_model(learn, "text", "lang")
    path = fresh_path(spark, "domain-model")
    model.save(path)
    loaded = classical.DomainModel.load(path)
    one, two = (materialize(classical.predict_domains(test, m, "text").select("doc_id", "lang", "prediction"), "predicted") for m in (model, loaded))
    again = two.select("doc_id", (F.col("prediction")).alias("again"))
    both = one.join(again, "doc_id").withColumn("same_after_load", F.col("prediction") == F.col("again"))
    return class_rows(both, "lang", 0.9, "same_after_load")


def head_held_out(spark, folder):
    return class_rows(fitted_head(spark, folder, True))


def sequence_fit(spark, folder, max_len, least):
    """Labels, vocabulary and head fitted, saved, loaded and validated on held-out documents."""
    learn, test = held_out(documents(spark, folder, "doc_id", "lang", "text"))
    model = sequence.fit_sequences(learn, "text", "lang", "doc_id", max_len)
    path = fresh_path(spark, "sequence-model")
    model.save(path)
    one, two = (materialize(m.transform(test, "text", ["doc_id"]), "scores") for m in (model, sequence.SequenceModel.load(path)))
    again = two.select("doc_id", F.col("scores").alias("again"))
    scored = one.join(again, "doc_id").join(test.select("doc_id", "lang"), "doc_id")
    loss = sequence.evaluate_scores(scored, "lang", model.labels)[0].first().loss
    named = scored.select("lang", decode_label(argmax(F.col("scores")), labels.label_array(model.labels)).alias("prediction"), (F.col("scores") == F.col("again")).alias("same_after_load"))
    return class_rows(named, "lang", least, "same_after_load").withColumn("low_loss", F.lit(loss < 0.8))


def sequences_held_out(spark, folder):
    return sequence_fit(spark, folder, MAX_LEN, 0.8)


def long_sequences_held_out(spark, folder):
    """At the length of the long model."""
    return sequence_fit(spark, folder, LONGEST_LEN, 0.8)


def lda_topics(spark, folder):
    scored, _ = document_topics(spark, folder)
    rows = scored.select("doc_id", F.posexplode(drop_small(F.col("topics"))).alias("topic", "score"))
    return rows.withColumn("score", F.round("score", 6))


def document_vectors(docs, learn):
    """``doc_id, vector`` of ``docs`` by directions fitted on ``learn``, both with tokens; zeros without a known term.

    Vectors have a vocabulary of their own, all terms that occur three times or more: the topics' limits on documents are not theirs.
    """
    terms = materialize(vocabulary.number_terms(vocabulary.frequent_terms(learn)), "terms")
    bags = packed(learn, terms, "doc_id")
    model = fit_vectors(bags, terms, "doc_id", learn.count())
    rows = bags if docs is learn else packed(docs, terms, "doc_id")
    found = docs.select("doc_id").join(model.vectors(rows, "doc_id"), "doc_id", "left")
    return found.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), VECTOR_SIZE)))


def doc_vectors(spark, folder):
    docs = materialize(document_tokens(spark, folder), "tokens")
    rows = document_vectors(docs, docs).select("doc_id", F.posexplode("vector").alias("j", "value"))
    return rows.withColumn("value", F.round("value", 6))


def svm_predict(spark, folder, scheme="rest"):
    docs = documents(spark, folder, "doc_id", "lang", "text")
    model = classical.fit_domain_model(docs, "text", "lang", scheme=scheme)
    return classical.predict_domains(docs, model, "text").select("doc_id", "lang", "prediction")


def svm_pairs(spark, folder):
    """A machine for each pair of classes, and the class with the most wins."""
    return svm_predict(spark, folder, "pairs")


def head_stepwise(spark, folder):
    """A head trained step by step on the labelled vectors: its log's curve, and whether it stopped where the rule on the log does.

    The fit decides while it runs; ``early_stop`` decides afterwards from the log alone.
    """
    fit = fit_stepwise(table(spark, folder, "embeddings"), CLASSES, "vec_id", vector="embedding", epochs=8, batch=10, every=2, patience=PATIENCE, rate=0.05)
    log = materialize(fit.log, "log")
    curve = training.curve_of_log(log.drop("step"), every=2)
    stops = training.stops_of_log(log.drop("step"), patience=PATIENCE, every=2).select("epoch", "step", F.lit(True).alias("by_rule"))
    epoch, step = fit.stopped or (None, None)
    live = F.col("epoch").eqNullSafe(F.lit(epoch)) & F.col("step").eqNullSafe(F.lit(step))
    both = curve.join(stops, ["epoch", "step"], "left").select(live.alias("live"), F.coalesce("by_rule", F.lit(False)).alias("by_rule"))
    return both.agg(F.bool_and(F.col("live") == F.col("by_rule")).alias("same_stop"), F.bool_or("live").alias("stopped"))


def head_train(spark, folder):
    return fitted_head(spark, folder, False)


def fitted_head(spark, folder, apart):
    """A head over document vectors: fitted and applied on all documents, or applied on held-out ones."""
    docs = documents(spark, folder, "doc_id", "lang", "text")
    kinds = labels.fit_labels(docs, "lang")
    rows = docs.select(
        "doc_id",
        "lang",
        labels.encode_label(F.col("lang"), kinds).cast("double").alias("label"),
        filter_tokens(F.col("text")).alias("tokens"),
    )
    rows = materialize(rows, "tokens")
    learn = held_out(rows)[0] if apart else rows
    known = rows.drop("tokens")
    vectors = materialize(document_vectors(rows, learn).withColumn("vector", array_to_vector("vector")).join(known, "doc_id"), "vectors")
    learn, test = held_out(vectors) if apart else (vectors, vectors)
    scored = fit_head(learn, len(kinds)).transform(test)
    return scored.select("doc_id", "lang", decode_label(F.col("class"), labels.label_array(kinds)).alias("prediction"))


QUERIES = {
    "path_labels": path_labels,
    "category_alias": category_alias,
    "segment_extract": segment_extract,
    "segment_filter": segment_filter,
    "nested_text": nested_text,
    "unit_scan": unit_scan,
    "strip_html": strip_html,
    "clean_documents": clean_documents,
    "english_segments": english_segments,
    "rejoin_segments": rejoined_pages,
    "rejoin_turns": rejoin_turns,
    "csv_round_trip": csv_round_trip,
    "lang_profile": lang_profile,
    "lang_predict": lang_predict,
    "lang_report": lang_report,
    "sentence_split": sentence_split,
    "abbreviations": abbreviations,
    "sentences_learned": sentences_learned,
    "sentence_vote": sentence_vote,
    "ngram_classify": ngram_classify,
    "token_filter": token_filter,
    "lemma_lookup": lemma_lookup,
    "lemma_rules": lemma_rules,
    "lemma_induced": lemma_induced,
    "vocab_df": vocab_df,
    "vocab_prune": vocab_prune,
    "vocab_topk": vocab_topk,
    "bag_of_words": bag_of_words,
    "sequence_ids": sequence_ids,
    "sequence_pad": sequence_pad,
    "document_sequences": document_sequences,
    "long_sequences": long_sequences,
    "sentence_sequences": sentence_sequences,
    "sequence_vote": sequence_vote,
    "text_cast": text_cast,
    "tokens_persisted": tokens_persisted,
    "feature_concat": feature_concat,
    "doc_prefix": doc_prefix,
    "combined_features": combined_features,
    "label_index": label_index,
    "class_counts": class_counts,
    "one_hot": one_hot_rows,
    "head_forward": head_scores,
    "rbf_features": rbf_features,
    "argmax_label": argmax_label,
    "cross_entropy": cross_entropy_rows,
    "validation_loss": validation_loss,
    "epoch_loss": epoch_loss,
    "accuracy": accuracy,
    "confusion_long": confusion_long,
    "confusion_wide": confusion_wide,
    "classification_report": classification_report,
    "report_union": report_union,
    "report_labels": report_labels,
    "unseen_predictions": unseen_predictions,
    "majority_vote": majority_vote,
    "minibatch": minibatch,
    "file_batch": file_batch,
    "epoch_summary": epoch_summary,
    "training_curve": training_curve,
    "early_stop": early_stop,
    "topic_dense": topic_dense,
    "topic_sums": topic_sums,
    "topic_bound": topic_bound,
    "vector_projection": vector_projection,
    "svm_held_out": svm_held_out,
    "head_held_out": head_held_out,
    "sequences_held_out": sequences_held_out,
    "long_sequences_held_out": long_sequences_held_out,
    "lda_topics": lda_topics,
    "doc_vectors": doc_vectors,
    "svm_predict": svm_predict,
    "svm_pairs": svm_pairs,
    "head_stepwise": head_stepwise,
    "head_train": head_train,
}

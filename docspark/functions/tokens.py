"""Column expressions from text to words, filtered tokens and sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the original preprocessing, for callers that want its limits.
MAX_CHARS = 1_000_000
MAX_TOKENS = 50
NUMBER_TOKEN = "NUM"
NON_WORD = r"[^\p{L}\p{N}]+"
PURE_WORD = r"^(?:\p{L}+|\p{Nd}+)$"
DIGIT_FIRST = r"^\p{Nd}"
#: A run of letters and digits; the group holds it if it is a pure word.
RUN = r"((?>\p{L}+|\p{Nd}+))(?![\p{L}\p{N}])|[\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+[.!?]*"

# Fixed word list: the English list that ships with Spark's StopWordsRemover.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
    """.split()
)


def as_text(value: Column, null_as: str | None = None) -> Column:
    """Any value as a string; nulls stay null unless ``null_as`` names their text (e.g. ``"nan"``)."""
    text = value.cast("string")
    return text if null_as is None else F.coalesce(text, F.lit(null_as))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def grams(text: Column, size: int) -> Column:
    """Overlapping runs of ``size`` characters of the lower-case text, white-space runs as one space."""
    flat = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.regexp_extract_all(flat, F.lit(f"(?s)(?=(.{{{int(size)}}}))"), F.lit(1))


def first_words(text: Column, count: int) -> Column:
    """The first ``count`` of the ``words``, without splitting the rest of the text.

    Only the first piece of a split can be empty, so one spare piece is enough.
    """
    pieces = F.slice(F.split(F.lower(text), NON_WORD, count + 2), 1, count + 1)
    return F.slice(F.array_remove(pieces, ""), 1, count)


def _normal(token: Column, stops: list[str]) -> Column:
    """The form under which a token is kept, or an empty string."""
    return (
        F.when(F.lower(token).isin(stops) | ~token.rlike(PURE_WORD), "")
        .when(token.rlike(DIGIT_FIRST), NUMBER_TOKEN)
        .otherwise(F.lower(token))
    )


def _all_normal(text: Column, stops: list[str]) -> Column:
    """The kept forms of all tokens: one pattern over the text, and one for each token that begins beyond ASCII."""
    pure = F.regexp_extract_all(text, F.lit(RUN), F.lit(1))
    number = lambda tok: (tok < "A") | ((tok > "z") & tok.rlike(DIGIT_FIRST))
    forms = F.transform(pure, lambda tok: F.when((tok != "") & number(tok), NUMBER_TOKEN).otherwise(F.lower(tok)))
    return F.filter(forms, lambda tok: ~tok.isin([*stops, ""]))


def filter_tokens(
    text: Column,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    max_tokens: int | None = None,
    max_chars: int | None = None,
) -> Column:
    """The tokens that survive the filter, or the first ``max_tokens``; a null text gives an empty list.

    Stop words go, runs of digits become ``NUM``, runs of letters are lower-cased, the rest goes;
    only kept tokens count. Words are cut at every character that is neither letter nor digit,
    which differs from a rule-based tokenizer on forms such as ``abc1-x``. Long texts are not split
    to the end when their beginning already yields enough: ``split`` stops after a fixed number of
    pieces and the whole text is taken only if those hold too few kept tokens.
    """
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    stops = sorted({word.lower() for word in stop_words})
    tokens = _all_normal(text, stops)
    if max_tokens is not None:
        head = 4 * max_tokens
        # Kept tokens among the first pieces, with a null at the end if text is left over.
        started = F.filter(
            F.transform(
                F.split(text, NON_WORD, head + 1), lambda tok, i: F.when(i < head, _normal(tok, stops))
            ),
            lambda tok: tok.isNull() | (tok != ""),
        )
        whole = F.slice(tokens, 1, max_tokens)
        # The one-element transform computes ``started`` once for all its uses.
        tokens = F.get(
            F.transform(
                F.array(started),
                lambda kept: F.when(
                    (F.size(kept) <= max_tokens) & F.exists(kept, lambda tok: tok.isNull()), whole
                ).otherwise(F.slice(kept, 1, max_tokens)),
            ),
            F.lit(0),
        )
    return F.coalesce(tokens, F.array().cast("array<string>"))


def sentences(text: Column, protect: Sequence[str] = ()) -> Column:
    """Sentences in order, trimmed, without empty ones: a rule, not a trained sentence model.

    ``protect`` lists abbreviations (``"Dr."``) whose full stops do not end a sentence.
    """
    hidden = "\u0001"
    for abbreviation in protect:
        text = F.replace(text, F.lit(abbreviation), F.lit(abbreviation.replace(".", hidden)))
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    if protect:
        found = F.transform(found, lambda s: F.replace(s, F.lit(hidden), F.lit(".")))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")

"""Column expressions that turn segment markup into clean text.

``clean_text`` and ``strip_markup`` stay inside the JVM. Only ``decode_entities`` may hand rows to
Python, and then only the rows that hold an entity outside the common set.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python calls white space, of which all but a few are also Java's
# Unicode class; the separators U+001C..U+001F are not.
SPACES = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
WHITESPACE = r"[\s\x1c-\x1f]"
SPACE_RUN = rf"(?U){WHITESPACE}{{2,}}"
ANY_SPACE = rf"(?U){WHITESPACE}+"
LEFTOVER_TAG = r"(?d)<.*?>"  # the dot stops at \n only
NOT_PRINTABLE_ASCII = r"[^\x20-\x7E]+"

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TAG = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"

# Entities decoded with plain replacements; the ampersand comes last so that one pass decodes once.
COMMON_ENTITIES = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "#39": "'",
    "nbsp": " ",
    "copy": "©",
    "middot": "·",
    "amp": "&",
}
OTHER_ENTITY = "&(?!(?:" + "|".join(COMMON_ENTITIES) + ");)(?:#[0-9xX]|[a-zA-Z])"


def trim_space(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def clean_text(text: Column, mode: str = "reference") -> Column:
    """Trim, collapse white-space runs, drop leftover tags, literal ``\\r\\n``, non-ASCII, controls.

    ``mode="reference"`` leaves single white-space characters alone until the control step, which
    deletes a lone tab or newline and so joins its neighbours. ``mode="safe"`` turns every
    white-space run, of one character or more, into a single space instead.
    """
    if mode not in ("reference", "safe"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.regexp_replace(trim_space(text), SPACE_RUN if mode == "reference" else ANY_SPACE, " ")
    text = F.regexp_replace(text, LEFTOVER_TAG, "")
    text = F.replace(text, F.lit("\\r\\n"), F.lit(""))
    return F.regexp_replace(text, NOT_PRINTABLE_ASCII, "")  # non-ASCII first, then what controls are left


def decode_entities(text: Column, entities: str = "all", raw: Column | None = None) -> Column:
    """Decode character references once.

    The common named ones are string replacements. With ``entities="all"`` a text that holds any
    other reference (named or numeric) is decoded by ``html.unescape`` in Arrow batches; texts
    without one reach Python as nulls, so the transfer costs next to nothing for them. When
    ``text`` is costly to compute, give the column it comes from as ``raw``: it is searched for
    such references in its place, and ``text`` is computed once on either way.
    """
    common = text
    for name, char in COMMON_ENTITIES.items():
        common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
    if entities == "common":
        return common
    if entities != "all":
        raise ValueError(f"unknown entity set {entities!r}")

    unescape = html.unescape

    @F.pandas_udf("string")
    def decode_all(texts: pd.Series) -> pd.Series:
        return texts.map(unescape, na_action="ignore")

    searched = text if raw is None else raw
    return F.coalesce(decode_all(F.when(searched.rlike(OTHER_ENTITY), text)), common)


def strip_markup(text: Column, entities: str = "all") -> Column:
    """Text of an HTML fragment: comments, scripts, styles and tags removed, entities decoded."""
    raw = text
    for pattern in (COMMENT, SCRIPT, STYLE, TAG):
        text = F.regexp_replace(text, pattern, "")
    return decode_entities(text, entities, raw)

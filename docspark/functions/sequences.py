"""Column expressions that frame id lists as fixed-length model inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed ids of the special pieces; vocabulary ids follow.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
FIRST_ID = 4


def frame_ids(ids: Column, max_len: int, bos: int = BOS, eos: int = EOS) -> Column:
    """Begin marker, the first ``max_len - 2`` ids, end marker; a null list counts as empty."""
    ids = F.coalesce(ids.cast("array<int>"), F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(bos)), F.slice(ids, 1, max_len - 2), F.array(F.lit(eos)))


def pad_sequence(ids: Column, max_len: int, bos: int = BOS, eos: int = EOS, pad: int = PAD) -> Column:
    """Struct ``ids, mask, token_type_ids``, each an array of exactly ``max_len`` integers."""
    if max_len < 2:
        raise ValueError("max_len must leave room for the two markers")
    framed = frame_ids(ids, max_len, bos, eos)
    gap = F.lit(max_len) - F.size(framed)
    return F.struct(
        F.concat(framed, F.array_repeat(F.lit(pad), gap)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(framed)), F.array_repeat(F.lit(0), gap)).alias("mask"),
        F.array_repeat(F.lit(0), max_len).alias("token_type_ids"),
    )

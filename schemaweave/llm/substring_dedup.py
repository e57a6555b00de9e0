"""Removal of words that an earlier window of 20 words has already said.

A word goes if a window of `window` words that covers it also starts earlier: in a document
with a smaller id, or further up in the same one. Windows are judged on the input.

The blocks that are indexed are chosen by content (see repeats.py), not at every tenth
word: probing a fixed-block index with every rolling window moves more than six times the
input, which the README gives figures for. Every rolling window of every block that isn't
unique is still looked up, and hits grow to the whole repeat because windows overlap.

Cases: a null or empty text has no words. Rows with one id, or a null id, are told
apart and ordered by text; null ids come first. Texts shorter than a window keep all their
words. No rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm import repeats


def repeated_words(docs: DataFrame, window: int = 20) -> DataFrame:
    """key, start, end (words) of the windows of docs(key, text) that start earlier too."""
    unit = repeats.Unit(words=True, window=window, k=max(1, window // 4))
    found, groups = repeats.classes(docs, unit)
    copies = repeats.members(found, groups, others_than_first=True)
    return copies.unionByName(repeats.repeated_windows(repeats.window_names(docs, groups, unit), unit, others_than_first=True))


def remove_repeated_words(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    rows = repeats.texts(docs, doc_id, text)
    unit = repeats.Unit(words=True, window=window, k=max(1, window // 4))
    out = repeats.digests(rows, repeated_words(rows, window), unit)
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")

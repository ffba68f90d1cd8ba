"""Quality rules: word counts, repeated windows, and repeated passages by suffix array.

A suffix array over the words of a slice of documents (one unique end mark per document, so no repeat
spans two) is built by prefix doubling on whole arrays; groups that are already distinct leave the work.
Adjacent suffixes' longest common prefixes (LCP) give, for every word, the longest passage starting there
that also occurs elsewhere in the document: the maximal repeated substrings are these LCP intervals. The
union of their spans and the longest one are limited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wearcast.llm.arrow import as_text, by_slice

SYMBOLS = "[#*$%&|<>]"
SCHEMA = ("{key} {key_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, covered_words long, longest_repeat long")


def repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest passage from there that occurs again in its document.

    ``ids``: word ids; ``doc``: ascending document number of each word.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    # Words with a unique end mark after each document.
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    place = np.arange(n) + np.searchsorted(last, np.arange(n), side="left")
    total = n + len(last)
    v = int(ids.max()) + 2
    key = np.empty(total, np.int64)
    key[place] = doc * v + ids
    key[last + np.arange(len(last)) + 1] = doc[last] * v + v - 1
    order = np.argsort(key)
    sa = order
    sorted_key = key[order]
    slots = np.arange(total)
    rank = np.empty(total, np.int64)
    levels, k = [], 1
    while True:
        fresh = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        head = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[sa[slots]] = head
        levels.append(rank.astype(np.int32 if total < 2**31 else np.int64))
        shared = ~fresh | ~np.r_[fresh[1:], True]
        slots = slots[shared]
        if not len(slots):
            break
        at = sa[slots]
        sub = rank[at] * (total + 1) + rank[at + k]  # a repeated prefix holds no end mark, so at + k exists
        order = np.argsort(sub)
        sa[slots] = at[order]
        sorted_key = sub[order]
        k *= 2
    a, b = sa[:-1], sa[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        lcp += np.where(r[a + lcp] == r[b + lcp], 1 << level, 0)
    most = np.zeros(total, np.int64)
    np.maximum.at(most, a, lcp)
    np.maximum.at(most, b, lcp)
    return most[place]


def spans_cover(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated passage of at least ``least`` words."""
    i = np.arange(len(longest))
    return np.maximum.accumulate(np.where(longest >= least, i + longest, 0)) > i if len(i) else i.astype(bool)


def measure(texts: pa.Array, least: int) -> dict[str, np.ndarray]:
    """All counts of the documents in ``texts`` (no nulls)."""
    d = len(texts)
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    doc = np.repeat(np.arange(d), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        flat, doc = flat.filter(pa.array(real)), doc[real]
    total = lambda which, weights=None: np.bincount(which, weights, d).astype(np.int64)
    longest = repeats(flat.dictionary_encode().indices.to_numpy().astype(np.int64), doc)
    lines = pc.split_pattern(texts, "\n")
    line_doc = np.repeat(np.arange(d), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    line = lines.flatten()
    full = pc.match_substring_regex(line, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    line, line_doc = line.filter(pa.array(full)), line_doc[full]
    line_id = line.dictionary_encode().indices.to_numpy().astype(np.int64)
    distinct = np.unique(line_doc * (len(line_id) + 1) + line_id) // (len(line_id) + 1)
    best = np.zeros(d, np.int64)
    np.maximum.at(best, doc, longest)
    return {
        "n_words": total(doc),
        "word_chars": total(doc, pc.utf8_length(flat).to_numpy(zero_copy_only=False)),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": total(line_doc) - total(distinct),
        "n_repeat_words": total(doc[spans_cover(np.where(longest >= 3, 3, 0), 3)]),
        "covered_words": total(doc[spans_cover(longest, least)]),
        "longest_repeat": best,
    }


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_repeat: int = 10,
    max_covered: float = 0.4, max_longest: float = 0.15, longest_words: int = 50,
) -> DataFrame:
    """One row per document: its counts, whether the base rules reject it, and the verdict.

    Kept: at least 50 words, at most half of the words in repeated 3-word windows, at most ``max_covered``
    of the words in repeated passages of ``least_repeat`` words or more, and no repeated passage longer than
    both ``longest_words`` words and ``max_longest`` of the text. Two copies cover twice their share, so only
    below half of ``max_covered`` does ``max_longest`` reject a passage pasted twice on its own.

    A null or empty text has no words and is not kept. Rows are judged one by one: repeated rows give
    repeated results, a null key is passed through, and a text of any length is read whole.
    """
    key_type = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in SCHEMA.format(key="key", key_type="").split(", ")][1:]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = verdicts(as_text(batch.column(1)), least_repeat, max_covered, max_longest, longest_words)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[c]) for c in names)], names=[key, *names])

    return docs.select(key, text).mapInArrow(
        by_slice(work, text), SCHEMA.format(key=f"`{key}`", key_type=key_type))


def verdicts(texts: pa.Array, least_repeat: int, max_covered: float, max_longest: float, longest_words: int):
    """``measure`` with the two verdicts added."""
    m = measure(texts, least_repeat)
    n = m["n_words"]
    m["base_failed"] = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
    bad = (m["covered_words"] > max_covered * n) | (
        (m["longest_repeat"] > longest_words) & (m["longest_repeat"] > max_longest * n))
    m["kept"] = ~m["base_failed"] & ~bad
    return m


def keep_good(docs: DataFrame, text: str = "text", least_repeat: int = 10, max_covered: float = 0.4,
              max_longest: float = 0.15, longest_words: int = 50) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns unchanged; one pass without a join."""
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(
            verdicts(as_text(batch.column(at)), least_repeat, max_covered, max_longest, longest_words)["kept"]))

    return docs.mapInArrow(by_slice(work, text), docs.schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

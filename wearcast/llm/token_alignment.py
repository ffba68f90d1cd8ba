"""Alignment of two tokenizers' tokens through whitespace anchors.

Side A is a byte-level tokenizer that reads a text with a space before it, side B a piece tokenizer that adds that
space itself, so both cover the same bytes. After whole texts are tokenised, a byte offset where tokens of both sides
end and the next token of both starts with a space is an anchor. Anchors cut a document into windows of a few tokens;
a window's alignment depends on its two tuples of ids alone, so it is worked out once per tuple pair and remembered:
whether both sides' bytes agree (which verifies the window's ends), the groups between shared ends, and the links.
The windows' bytes in a row are compared with the document's: where they differ the document has no tokens.

The two tokens of a link end together, so the shorter one's bytes end the longer one's. All pairs of entries for which
that holds can be listed from the vocabularies (some hundreds of thousands); links are stored as numbers of that list,
and nothing the corpus can hold makes a table over pairs longer than it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast.llm.arrow import as_text, by_slice
from wearcast.llm.store import written
from wearcast.llm.tokens import PartEncoder, tokenizer_path

#: Tokens in remembered windows of one worker; it starts anew beyond this.
MEMO_TOKENS = 1_000_000
#: Words that go to the library in one text.
GROUP = 64
#: Added to B's ids in a window's key, above every id.
SIDE_B = 1 << 24
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def joined(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in a row, where each entry starts)."""
    size = np.array([len(x) for x in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... (``size`` of them) of every entry, one entry after the other."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)


def shared_ends(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of the tokens of both sides that end at the same byte."""
    total = int(max(end_a[-1], end_b[-1])) if len(end_a) and len(end_b) else 0
    token = np.full(total + 1, -1, np.int64)
    token[end_b] = np.arange(len(end_b))
    j = token[end_a] if total else token[:0]
    i = np.flatnonzero(j >= 0)
    return i, j[i]


class Sides:
    """Both tokenizers, the bytes of their entries, and the list of possible links."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.parts = PartEncoder(a)
        self.parts.tok.encode_special_tokens = True  # their strings in a text are plain text
        self.model = sentencepiece.SentencePieceProcessor(model_file=b)
        char = byte_alphabet()
        vocab = self.parts.tok.get_vocab_size()
        names = [self.parts.tok.id_to_token(i) or "" for i in range(vocab)]
        self.bytes_a = [bytes(char[c] for c in x) if all(c in char for c in x) else x.encode() for x in names]
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.words_apart = not any(SPACE in x.lstrip(SPACE) for x in pieces)
        raw = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := raw.fullmatch(x)) else x.replace(SPACE, " ").encode()
                        for x in pieces]
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.mark_a, self.mark_b = (np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.raw_a, self.first_a = joined(self.bytes_a)
        self.raw_b, self.first_b = joined(self.bytes_b)
        numbers = [b"%d," % i for i in range(max(len(names), len(pieces)))]
        self.raw_number, self.first_number = joined(numbers)
        self.digits = np.array([len(x) for x in numbers])
        self.links = self._possible_links()
        self.forget()

    def _possible_links(self) -> np.ndarray:
        """Sorted ``a * SIDE_B + b`` of all entries a, b of which one's bytes end the other's."""
        found: list[np.ndarray] = []
        for one, two, as_key in ((self.bytes_a, self.bytes_b, lambda i, j: i * SIDE_B + j),
                                 (self.bytes_b, self.bytes_a, lambda i, j: j * SIDE_B + i)):
            by = defaultdict(list)
            for j, x in enumerate(two):
                by[x].append(j)
            found.append(np.array([as_key(i, j) for i, x in enumerate(one) for k in range(len(x)) for j in by.get(x[k:], ())],
                                  np.int64))
        return np.unique(np.concatenate(found))

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.good: list[bool] = []
        self.text: list[bytes] = []
        self.shown: list[str] = []
        self.pool = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self, keys: list[bytes]) -> None:
        """Align windows that aren't remembered yet, all of them in whole-array steps."""
        ids = np.frombuffer(b"".join(keys), np.uint32)
        of = np.repeat(np.arange(len(keys)), [len(k) // 4 for k in keys])
        on_b = ids >= SIDE_B
        a, b = ids[~on_b].astype(np.int64), ids[on_b].astype(np.int64) - SIDE_B
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # a window's sides are equally long
        raw = self.raw_a[gather(self.first_a[a], self.size_a[a])]
        agree = raw == self.raw_b[gather(self.first_b[b], self.size_b[b])]
        edge = np.concatenate(([0], np.cumsum(np.bincount(of[~on_b], self.size_a[a], len(keys)).astype(np.int64))))
        good = np.logical_and.reduceat(agree, edge[:-1]) if len(keys) else agree
        i, j = shared_ends(end_a, end_b)  # the last tokens of the groups
        held_by = of[~on_b][i]
        pair = a[i] * SIDE_B + b[j]
        link = np.minimum(np.searchsorted(self.links, pair), len(self.links) - 1)
        if not (self.links[link] == pair)[good[held_by]].all():
            raise ValueError("a link outside the list of possible ones")
        # The shown form: each group's ids of A, then of B, every id with the sign that follows it.
        group_a, group_b = (np.cumsum(np.bincount(x + 1, minlength=n + 1))[:n] for x, n in ((i, len(a)), (j, len(b))))
        place_a = np.arange(len(a)) + np.concatenate(([0], j + 1))[group_a]
        place_b = np.arange(len(b)) + (i + 1)[group_b]
        number, sign = np.empty(len(ids), np.int64), np.full(len(ids), ord(","), np.uint8)
        number[place_a], number[place_b] = a, b
        sign[place_a[i]], sign[place_b[j]] = ord("|"), ord(";")
        size = self.digits[number]
        shown = self.raw_number[gather(self.first_number[number], size)]
        last = np.cumsum(size)
        shown[last - 1] = sign
        shown, raw = shown.tobytes().decode(), raw.tobytes()
        stop = np.concatenate(([0], last))[np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(keys)))))].tolist()
        edge = edge.tolist()
        self.shown += [shown[x:y - 1] for x, y in zip(stop[:-1], stop[1:], strict=True)]
        self.text += [raw[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
        self.good += good.tolist()
        self.index.update(zip(keys, range(len(self.count), len(self.count) + len(keys)), strict=True))
        self.pool = np.concatenate([self.pool, link.astype(np.uint32)])
        self.count = np.concatenate([self.count, np.bincount(held_by, minlength=len(keys)).astype(np.int64)])
        self.first = np.cumsum(self.count) - self.count
        self.held += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, A's ids per text, B's ids, B's ids per text) of non-empty texts."""
        one = pa.scalar(" ", pa.large_string())
        a, n_a = self.parts.encode(pc.binary_join_element_wise(one, texts, pa.scalar("", pa.large_string())))
        return a.astype(np.uint32), n_a, *self._pieces(texts)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(B's ids, B's ids per text). No piece holds a space mark behind another character, so a text's ids are those
        of its words, each with the space before it; each distinct word of a slice is encoded once. Texts with other
        spacing, with the mark's own character, or for a vocabulary with such pieces go to the library whole."""
        plain = pc.invert(pc.match_substring_regex(texts, f"^ |  | $|{SPACE}|\x00")).to_numpy(zero_copy_only=False)
        plain &= self.words_apart
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        others = np.flatnonzero(~plain).tolist()
        if others:
            for i, ids in zip(others, self.model.encode(texts.take(pa.array(others)).to_pylist(), num_threads=1), strict=True):
                parts[i] = np.array(ids, np.uint32)
        if not plain.any():
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        each = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        groups = [" ".join(distinct[x:x + GROUP]) for x in range(0, len(distinct), GROUP)]
        pool = np.array([i for ids in self.model.encode(groups, num_threads=1) for i in ids], np.uint32)
        first = np.flatnonzero(self.mark_b[pool])
        size = np.diff(np.r_[first, len(pool)])
        at = coded.indices.to_numpy()
        n = size[at]
        ids = pool[gather(first[at], n)]
        total = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(each)))])
        if not others:
            return ids, total
        for i, x in zip(np.flatnonzero(plain).tolist(), np.split(ids, np.cumsum(total)[:-1]), strict=True):
            parts[i] = x
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def windows(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(remembered window, document) of the windows of documents whose sides have equally many bytes."""
        docs = np.arange(len(n_a))
        doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        i, j = shared_ends(end_a, end_b)
        last = np.r_[doc_a[1:] != doc_a[:-1], True][i]
        spaced = np.r_[self.mark_a[a[1:]], True][i] & np.r_[self.mark_b[b[1:]], True][j]
        anchor = last | spaced
        i, j = i[anchor], j[anchor]
        w_a, w_b = np.diff(np.r_[-1, i]), np.diff(np.r_[-1, j])
        # Keys: each window's ids of A, then of B, as one binary value; Arrow finds the distinct ones.
        key = np.empty(len(a) + len(b), np.uint32)
        key[np.arange(len(a)) + np.repeat(np.cumsum(w_b) - w_b, w_a)] = a
        key[np.arange(len(b)) + np.repeat(np.cumsum(w_a), w_b)] = b + np.uint32(SIDE_B)
        edge = np.concatenate(([0], 4 * np.cumsum(w_a + w_b)))
        keys = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(i), [None, pa.py_buffer(edge), pa.py_buffer(key)]).dictionary_encode()
        distinct = keys.dictionary.to_pylist()
        if self.held > MEMO_TOKENS:
            self.forget()
        known = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(known < 0)
        known[new] = len(self.count) + np.arange(len(new))
        self._learn([distinct[x] for x in new.tolist()])
        return known[keys.indices.to_numpy()], doc_a[i]

    def align(self, texts: pa.Array, digest: bool) -> list:
        """Columns n_a, n_b, n_groups, n_links, groups, links of texts without nulls."""
        total = len(texts)
        raw = texts.cast(pa.large_binary())
        zero = np.zeros(total, np.int64)
        n_a, n_b, groups = zero.copy(), zero.copy(), zero.copy()
        shown, links = [""] * total, [b""] * total
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        live = np.flatnonzero(size > 0)
        if len(live):
            a, each_a, b, each_b = self.encode(texts.take(pa.array(live)))
            k = np.arange(len(live))
            whole = (np.bincount(np.repeat(k, each_a), self.size_a[a], len(k)) == size[live] + 1) & (
                np.bincount(np.repeat(k, each_b), self.size_b[b], len(k)) == size[live] + 1)
            a, b = a[np.repeat(whole, each_a)], b[np.repeat(whole, each_b)]
            live, each_a, each_b = live[whole], each_a[whole], each_b[whole]
        if len(live):
            window, doc = self.windows(a, each_a, b, each_b)
            cut = np.searchsorted(doc, np.arange(len(live) + 1)).tolist()
            many, first, window_list = self.count[window], self.first[window], window.tolist()
            codes = self.pool[gather(first, many)].astype("<u4")
            edge = np.concatenate(([0], np.cumsum(many)))
            for d, at in enumerate(live.tolist()):
                own = window_list[cut[d]:cut[d + 1]]
                if not all(map(self.good.__getitem__, own)):
                    continue
                if b"".join(map(self.text.__getitem__, own)) != b" " + raw[at].as_py():
                    continue
                text = ";".join(map(self.shown.__getitem__, own))
                shown[at] = hashlib.sha256(text.encode()).hexdigest() if digest else text
                links[at] = codes[edge[cut[d]]:edge[cut[d + 1]]].tobytes()
                n_a[at], n_b[at], groups[at] = each_a[d], each_b[d], edge[cut[d + 1]] - edge[cut[d]]
        return [pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(np.array([len(x) // 4 for x in links], np.int64)),
                pa.array(shown), pa.array(links, pa.binary())]


@lru_cache(maxsize=1)
def sides(a: str, b: str) -> Sides:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Sides(a, b)


def align_tokens(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text",
                 digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, links) for every row of ``docs``, written once.

    ``a``: path of a byte-level tokenizer (.json), given a space and the text; ``b``: path of a piece tokenizer
    (.model), given the text. ``groups`` shows the tokens between shared ends as ``a1,a2|b1;a3|b2,b3`` (with
    ``digest`` its lowercase hex sha256 instead); ``links`` numbers the linked pairs (see ``pair_counts``).

    Null and empty texts, and texts whose tokens' bytes on either side aren't the space and the text, have no tokens:
    zeros and ''. Rows are worked on one by one: repeated rows give repeated results, a null key is passed through,
    other columns are not looked at, an empty table gives no rows. A text of any length is tokenised whole, in one task.
    """
    key_type = docs.schema[key].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *sides(a, b).align(as_text(batch.column(1)), digest)], names=["key", *names])

    schema = f"key {key_type}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(by_slice(work), schema)
    return written(rows, "aligned", compression="zstd").withColumnRenamed("key", key)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, count) over the corpus; every task adds up its own links before anything is shuffled."""

    def work(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(total))
            c[: len(total)] += total
            total = c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["link", "count"])

    return (aligned.select("links").mapInArrow(work, "link long, count long")
            .groupBy("link").agg(F.sum("count").alias("count")))


def pair_counts(aligned: DataFrame, a: str, b: str) -> DataFrame:
    """(a_id, b_id, n_links, best): how many links of the corpus hold each id pair, and whether no id of A is linked
    to the pair's B id more often. At most one row a possible link: the list from the vocabularies bounds it."""
    found = link_counts(aligned).toArrow()
    link, count = (found.column(c).to_numpy() for c in ("link", "count"))
    pair = sides(a, b).links[link]
    most = np.zeros(len(sides(a, b).bytes_b), np.int64)
    np.maximum.at(most, pair % SIDE_B, count)
    table = pa.table({"a_id": pair // SIDE_B, "b_id": pair % SIDE_B, "n_links": count, "best": count == most[pair % SIDE_B]})
    schema = "a_id long, b_id long, n_links long, best boolean"
    return aligned.sparkSession.createDataFrame(table, schema)


def with_pair_counts(aligned: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``aligned`` with ``n_best`` (links of a best pair) and ``count_sum`` (the sum of its links' pair counts)."""
    found = pairs.toArrow()
    at = np.searchsorted(sides(a, b).links, found.column("a_id").to_numpy() * SIDE_B + found.column("b_id").to_numpy())
    count, best = np.zeros(len(sides(a, b).links), np.int64), np.zeros(len(sides(a, b).links), bool)
    count[at], best[at] = found.column("n_links").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
    place = aligned.columns.index("links")

    def work(batches):
        for batch in batches:
            sums = []
            for x in batch.column(place):
                codes = np.frombuffer(x.as_buffer(), "<u4")
                sums.append((int(best[codes].sum()), int(count[codes].sum())))
            n_best, total = zip(*sums, strict=True) if sums else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                names=[*batch.schema.names, "n_best", "count_sum"])

    schema = T.StructType([*aligned.schema.fields, T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])
    return aligned.mapInArrow(work, schema)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of ``byte_bpe_50k.json`` and ``piece_bpe_32k.model`` on all ``documents``, with the corpus-wide
    counts of the linked id pairs. Nulls, empty and long texts, repeated rows and empty tables as in ``align_tokens``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    aligned = align_tokens(docs, a, b, digest=True)
    return with_pair_counts(aligned, pair_counts(aligned, a, b), a, b).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))

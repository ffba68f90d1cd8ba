"""Benchmark decontamination: pigeonhole edit matching.

A test item may differ from its copy in a document by at most ``rate`` of its characters (the error budget
k). Split into k + 1 pieces, at least one piece of every such copy is exact; all pieces of a block of items
are found in one pass over each document by an Aho-Corasick automaton. The pieces are the leaves of a binary
tree: if a node with p pieces has at most p - 1 errors, so has one of its halves for its own pieces. A hit
is therefore verified upwards, each node by Myers' bit-parallel distance in a window around the hit, and
chance hits end at the first, short node.

Short items have no room for errors: they are found by their exact words, or, where symbols carry their
meaning (formulas, code, numbers with signs), by their exact words and symbols.

The corpus is read once for all blocks: a task takes a chunk of texts, normalises it and looks for one block
after another, so it holds few automata at a time, however many blocks there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.arrow import as_text, by_slice

#: Items are searched in blocks of about this many characters; each block has an automaton of its own.
BLOCK_CHARS = 500_000
#: One pass over the corpus takes so many characters of items to the tasks at most; more items make further passes.
PASS_CHARS = 20_000_000
#: Automata that a task keeps; of a pass with more blocks it builds the others anew for each chunk of texts.
HELD = 2
#: The chunk's bytes of text: searching it takes several times as long as building an automaton.
CHUNK_BYTES = 16_000_000
#: Words and symbols from which on a short item tells its copies from common speech.
LEAST_WORDS = 3
#: Results of short verifications that a worker remembers.
MEMO = 50_000
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: How an item is searched: with errors, by its exact words, by its exact words and symbols.
EDITS, WORDS, SYMBOLS = range(3)
#: Signs that sentences have; any other one, or any in an item without letters, is part of a formula or of code.
SENTENCE = frozenset(".,;:?!'\"()-\u2010\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u00ab\u00bb\u2026\u00a1\u00bf"
                     "\u3001\u3002\uff0c\uff1f\uff01\uff1a\uff1b\u060c\u061f\u0964")
#: Scripts written without spaces (Thai to Khmer, kana, Han): there a word may begin or end anywhere.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalise(text: str) -> str:
    """Lower-case words with one space between them."""
    return " ".join(WORD.findall(text.lower()))


def with_symbols(text: str) -> str:
    """Lower-case words and single symbols with one space between them."""
    return " ".join(TOKEN.findall(text.lower()))


def searched_form(text: str, min_chars: int) -> tuple[str, int]:
    """(the form in which an item is looked for, EDITS, WORDS or SYMBOLS); a blank item has the form ''."""
    words = normalise(text)
    if words and len(words) >= min_chars:
        return words, EDITS
    signs = set(with_symbols(words and text)) - set(words) - {" "}
    letters = any(c.isalpha() for c in words)
    if words and (signs <= SENTENCE if letters else not signs):
        return words, WORDS
    return with_symbols(text), SYMBOLS


def _words(form: str) -> int:
    """Words and symbols of a searched form; in scripts without spaces, characters."""
    return sum(len(UNSPACED.findall(x)) or 1 for x in form.split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any part of ``text``, end of the first such part)."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best, end


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.nodes: list[list[tuple[int, int, int, int]]] = []  # leaf: (item, from, to, budget) up to the root
        self.leaves: dict[str, list[tuple[int, int]]] = {}  # piece: (leaf, place in the item)
        self.memo: dict[tuple[str, str], tuple[int, int]] = {}
        for number, (_, text) in enumerate(items):
            m, pieces = len(text), int(rate * len(text)) + 1
            cut = [j * m // pieces for j in range(pieces + 1)]
            for leaf in range(pieces):
                path, a, b = [], 0, pieces
                while b - a > 1:
                    path.append((number, cut[a], cut[b], b - a - 1))
                    mid = (a + b) // 2
                    a, b = (a, mid) if leaf < mid else (mid, b)
                path.append((number, cut[leaf], cut[leaf + 1], 0))
                self.leaves.setdefault(text[cut[leaf]:cut[leaf + 1]], []).append((len(self.nodes), cut[leaf]))
                self.nodes.append(path[::-1])
        self.automaton = ahocorasick.Automaton()
        for piece, leaves in self.leaves.items():
            self.automaton.add_word(piece, (len(piece), leaves))
        if self.leaves:
            self.automaton.make_automaton()

    def distance(self, pattern: str, window: str) -> tuple[int, int]:
        found = self.memo.get((pattern, window))
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[pattern, window] = myers(pattern, window)
        return found

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item number: (distance, start, end) of its best copy in ``text``, the first among equals."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.leaves:
            return found
        for last, (size, leaves) in self.automaton.iter(text):
            hit = last + 1 - size
            for leaf, place in leaves:
                number = self.nodes[leaf][0][0]
                whole = self.items[number][1]
                if number in found and found[number][0] == 0:
                    continue
                best, end, first = 0, size, hit
                for _, a, b, budget in self.nodes[leaf]:
                    first = max(0, hit - (place - a) - budget)
                    best, end = self.distance(whole[a:b], text[first:hit + (b - place) + budget])
                    if best > budget:
                        break
                else:
                    # The start: the reversed item in the reversed window ends where the copy begins.
                    window = text[max(first, first + end - len(whole) - best):first + end]
                    _, back = self.distance(whole[::-1], window[::-1])
                    copy = (best, first + end - back, first + end)
                    found[number] = min(copy, found.get(number, copy))
        return found


class Exact:
    """Finds short items in texts of their own form, between spaces (in scripts without spaces anywhere)."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        numbers: dict[str, list[int]] = {}
        for number, text in items:
            numbers.setdefault(text, []).append(number)
        for text, held in numbers.items():
            before, after = ("" if UNSPACED.match(c) else " " for c in (text[0], text[-1]))
            # The text is searched with a space at both ends, so places are one too high.
            self.automaton.add_word(before + text + after, (len(text) + len(after), len(text), held))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item number: (0, start, end) of its first copy in ``text``."""
        found: dict[int, tuple[int, int, int]] = {}
        for last, (back, size, numbers) in self.automaton.iter(f" {text} "):
            if numbers[0] not in found:
                start = last - back
                found.update(dict.fromkeys(numbers, (0, start, start + size)))
        return found


class Finder:
    """Finds all items of one block, (item id, form, way of searching), in raw texts."""

    def __init__(self, items: list[tuple[int, str, int]], rate: float):
        of = lambda way: [(i, x[1]) for i, x in enumerate(items) if x[2] == way]
        self.numbers = [i for i, _ in of(EDITS)]
        self.edits = Matcher(of(EDITS), rate) if self.numbers else None
        self.words, self.symbols = (Exact(of(way)) if of(way) else None for way in (WORDS, SYMBOLS))

    def find(self, plain: str, symbols: str) -> dict[int, tuple[int, int, int]]:
        """item number: (distance, start, end), from a text's forms by ``normalise`` and ``with_symbols``."""
        found: dict[int, tuple[int, int, int]] = {}
        if self.edits:
            found = {self.numbers[i]: copy for i, copy in self.edits.find(plain).items()}
        if self.words:
            found |= self.words.find(plain)
        if self.symbols:
            found |= self.symbols.find(symbols)
        return found


class Search:
    """Looks for the items of all blocks of a pass in chunks of raw texts, one block after another."""

    def __init__(self, blocks: list[list[tuple[int, str, int]]], rate: float):
        self.blocks, self.rate = blocks, rate
        ways = {x[2] for block in blocks for x in block}
        self.plain, self.symbols = bool(ways & {EDITS, WORDS}), SYMBOLS in ways
        self.held: dict[int, Finder] = {}

    def finder(self, b: int) -> Finder:
        found = self.held.get(b)
        if found is None:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            found = self.held[b] = Finder(self.blocks[b], self.rate)
        return found

    def find(self, texts: list[str], one: bool = False) -> list[dict[tuple[int, int], tuple[int, int, int]]]:
        """Per text {(block, item number): (distance, start, end)}; with ``one`` a text that holds an item isn't searched on."""
        plain = [normalise(t) for t in texts] if self.plain else texts
        symbols = [with_symbols(t) for t in texts] if self.symbols else texts
        found: list[dict] = [{} for _ in texts]
        for b in sorted(range(len(self.blocks)), key=lambda b: b not in self.held):
            finder = self.finder(b)
            for row, mine in enumerate(found):
                if not (one and mine):
                    mine |= {(b, number): copy for number, copy in finder.find(plain[row], symbols[row]).items()}
        return found


def item_passes(items: DataFrame, item_key: str, text: str, min_chars: int, block_chars: int, pass_chars: int,
                least_words: int = 1) -> Iterator[list[list[tuple[int, str, int]]]]:
    """For each pass over the corpus its blocks: lists of (item id, searched form, way of searching).

    Passes and blocks hold about ``pass_chars`` and ``block_chars`` characters, or one longer item. Equal items count once;
    blank ones, and ones without room for errors of fewer than ``least_words`` words and symbols, are left out.
    """
    rows = items.select(F.col(item_key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = -(-chars // pass_chars)
    for p in range(passes):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == p).collect()
        kept = sorted(((r["k"], *searched_form(r["t"], min_chars)) for r in part), key=lambda x: (x[0] is None, x))
        blocks, size = [], block_chars
        for item in kept:
            if item[1] and (item[2] == EDITS or _words(item[1]) >= least_words):
                if size + len(item[1]) > block_chars:
                    blocks.append([])
                    size = 0
                blocks[-1].append(item)
                size += len(item[1])
        if blocks:
            yield blocks


def _searching(blocks: list[list[tuple[int, str, int]]], rate: float) -> Callable[[], Search]:
    made: list[Search] = []

    def search() -> Search:
        if not made:
            made.append(Search(blocks, rate))
        return made[0]

    return search


def _by_chunk(work, text: str, blocks: int):
    """A mapInArrow function: ``work`` on slices of texts, or on chunks where automata have to be built for each."""
    if blocks <= HELD:
        return by_slice(work, text)
    cut = by_slice(work, text, CHUNK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches())
                held, size = [], 0
        if held:
            yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches())

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, rate: float = 0.1, min_chars: int = 20, key: str = "doc_id",
    text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """(key, item_key, distance, budget, start, end) for each test item found in each document.

    Texts are compared as lower-case words with one space between; ``start`` and ``end`` count code points
    of that form. An item is found if its edit distance to some part of the document is at most ``rate`` of
    its length. Items under ``min_chars`` in that form are found by exact copies of their whole words (budget
    0); those with symbols beyond sentence marks, or with marks but no letters, by exact copies of their words
    and symbols, whose places count in the form that keeps each symbol as a word. Null and blank items have
    nothing to look for; null documents hold nothing; documents are searched row by row, so repeated rows give
    repeated results, an empty table none; a text of any length is searched whole. The corpus is read once for
    every ``pass_chars`` characters of items (forms as searched), which bounds what tasks hold of them.
    """
    spark = docs.sparkSession
    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, "
              f"`{item_key}` {items.schema[item_key].dataType.simpleString()}, "
              "distance int, budget int, start long, end long")
    out = spark.createDataFrame([], schema)
    arrow = pa.schema([("distance", pa.int32()), ("budget", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    for blocks in item_passes(items, item_key, item_text, min_chars, block_chars, pass_chars):
        search = _searching(blocks, rate)

        def work(batch: pa.RecordBatch, blocks=blocks, search=search) -> pa.RecordBatch | None:
            row, item, spans = [], [], []
            for i, found in enumerate(search().find(as_text(batch.column(1)).to_pylist())):
                for (b, number), (distance, start, end) in sorted(found.items()):
                    name, form, way = blocks[b][number]
                    row.append(i)
                    item.append(name)
                    spans.append((distance, int(rate * len(form)) if way == EDITS else 0, start, end))
            if not row:
                return None
            cols = [pa.array(c, f.type) for c, f in zip(zip(*spans, strict=True), arrow, strict=True)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(item), *cols], names=[key, item_key, *arrow.names])

        out = out.unionByName(docs.select(key, text).mapInArrow(_by_chunk(work, text, len(blocks)), schema))
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, rate: float = 0.1, min_chars: int = 20, text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
    least_words: int = 1, pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item (see ``find_leaks``), all columns unchanged.

    Items without room for errors (under ``min_chars``) that have fewer than ``least_words`` words and symbols say
    nothing about a document ('Yes', '42', 'the'): ``find_leaks`` reports them, but they remove none (``LEAST_WORDS``
    is a sensible bound; 1 removes for any item). In scripts without spaces each character counts as a word. Null texts and
    all rows of a table without other items stay, repeated rows stay or go together, an empty table stays empty, and
    a text of any length is searched whole.
    """
    columns = docs.columns
    at = columns.index(text)
    for blocks in item_passes(items, item_key, item_text, min_chars, block_chars, pass_chars, least_words):
        search = _searching(blocks, rate)

        def work(batch: pa.RecordBatch, search=search) -> pa.RecordBatch:
            clean = [not found for found in search().find(as_text(batch.column(at)).to_pylist(), one=True)]
            return batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(_by_chunk(work, text, len(blocks)), docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

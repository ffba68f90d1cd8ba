"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once.

Both vocabularies cut a text into words before merging, so the ids of a text are those of its parts
between spaces, one after the other, if no white space stands on both sides of a space. Distinct parts are
found by Arrow's dictionary encoding, encoded by the library in groups, and gathered back by numpy. Texts
outside these rules (rare characters, runs of white space, special tokens' strings) go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Threads of their own would fight with the tasks on the other cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts kept between slices of one worker; the cache starts anew beyond this.
CACHE_PARTS = 400_000
GROUP = 500
#: Characters for which cutting at spaces is exact: ASCII without controls, Latin letters (but the dotted
#: capital I, whose small form is two characters), dashes, quotes, euro.
PLAIN = r"\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}"
#: Punctuation that stands apart from words where white space is dropped; the apostrophe may join a word.
APART = r"([^\p{L}\p{N}\s']+)"
START = "\x00"


class PartEncoder:
    """Encodes slices of texts; one object per tokenizer file and worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        # A word's ids may depend on the space before it (byte-level) or not (white space is dropped).
        self.spaced = one(" a b") != one("a b") or one("a") != one(" a")
        self.odd = f"[^{PLAIN}]|<\\|" + (r"|\s \s|\s $" if self.spaced else r"|[^\p{L}\p{N}\s']'|'[^\p{L}\p{N}\s']")
        self.glue = "\t " if self.spaced else " \x01 "
        mark = one("a" + self.glue + "a")[len(one("a")):][:1]
        self.mark = mark[0] if one("a" + self.glue + "b") == one("a") + mark + one(" b") else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget_rare(self) -> None:
        """Keep the parts that came up in several slices."""
        keep = self.uses > 1
        if keep.sum() > CACHE_PARTS // 2:
            return self.clear()
        size, first = self.size[keep], self.first[keep]
        end = np.cumsum(size)
        self.pool = self.pool[np.repeat(first - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
        self.first, self.size, self.uses = end - size, size, np.ones(len(size), np.int64)
        self.index = dict(zip((w for w, k in zip(self.index, keep.tolist(), strict=True) if k), range(len(size))))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: pa.Array) -> None:
        """Add the ids of parts that aren't in the pool yet: groups of them in one text, cut at the mark's id."""
        lead = " " if self.spaced else ""
        odd = pc.match_substring_regex(parts, "^$|\\t|^[\\r\\n\\x00]|[\\r\\n]$" if self.mark is not None else "")
        plain, other = parts.filter(pc.invert(odd)).to_pylist(), parts.filter(odd).to_pylist()
        kept, pool, size = [], [self.pool], [self.size]
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        for group, ids in zip(groups, self.whole([lead + self.glue.join(g) for g in groups]), strict=True):
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(group) - 1:
                kept += group
                pool.append(np.delete(ids, cut))
                size.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
            else:  # a part holds the mark's id itself
                other += group
        rest = self.whole([p[1:] if p[:1] == START else lead + p for p in other])
        kept += other
        self.index.update(zip(kept, range(len(self.size), len(self.size) + len(kept)), strict=True))
        self.size = np.concatenate([*size, np.fromiter(map(len, rest), np.int64, len(rest))])
        self.pool = np.concatenate([*pool, *rest])
        self.first = np.cumsum(self.size) - self.size
        self.uses = np.concatenate([self.uses, np.zeros(len(kept), np.int64)])

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            start, end = pa.scalar(START, pa.large_string()), pa.scalar("", pa.large_string())
            parts = pc.split_pattern(pc.binary_join_element_wise(start, texts, end), " ")
        else:  # capitals and white space don't matter, and words and punctuation are merged apart
            parts = pc.ascii_split_whitespace(
                pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \1 "))
        each = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_PARTS:
            self._forget_rare()
        at = np.fromiter((self.index.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)))
            at[new] = np.fromiter((self.index[words[i]] for i in new.tolist()), np.int64, len(new))
        self.uses[at] += 1
        at = at[coded.indices.to_numpy()]
        size = self.size[at]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(self.first[at] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
        edge = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(each)))]
        return ids, np.diff(edge)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text) for texts without nulls."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._joined(texts) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        n = np.zeros(len(texts), np.int64)
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        even = np.flatnonzero(~odd)
        if len(even):
            ids, n_even = self._joined(texts.take(pa.array(even)))
            for i, x in zip(even.tolist(), np.split(ids, np.cumsum(n_even)[:-1]), strict=True):
                pieces[i] = x
        which = np.flatnonzero(odd).tolist()
        for i, x in zip(which, self.whole(texts.take(pa.array(which)).to_pylist()), strict=True):
            pieces[i] = x
        n[:] = [len(x) for x in pieces]
        return np.concatenate(pieces), n


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; only its path enters a job."""
    import public_tokenizers

    return str(public_tokenizers.path(name))

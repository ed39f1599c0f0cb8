"""Token counts by heap-and-linked-list byte-pair merging; no ids are made.

A word's bytes are a linked list; a heap holds the adjacent pairs that have a
merge, by rank and then place. The lowest is popped, its pair merged and the
two new neighbours pushed, until the heap is empty. The word's tokens are its
bytes less the merges done, in O(n log n) for a word of any length.

Words come from the pre-tokeniser's pattern. A single space between characters
that aren't white space always begins a word, so texts fall apart at such
spaces, and the counts of the stretches between are kept in a table of bounded
size; a text with other white space beside its spaces is split by the pattern
as a whole. Strings of added tokens inside texts are one token each, as the
library has it by default.

Defined results: a null text counts as empty: n_bytes and n_tokens 0. Repeated
rows are counted each on its own. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Kept, documents, map_rows, texts
from .sentencepiece_codec import read_model

#: Fixed value: how byte-level BPE splits a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches kept by a worker, and the longest of them.
KEPT, KEPT_CHARS = 250_000, 64
LIMIT = 1024
#: A heap entry is a rank and below it a place in the word.
PLACE_BITS = 40
PLACES = (1 << PLACE_BITS) - 1


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Counter:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is handled")
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not handled")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        number = {c: b for b, c in enumerate(byte_letters())}
        #: Pair of symbols to rank, moved beyond any place in a word, and the symbol that it makes.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(a + b, len(number))
            self.merge[number[a], number[b]] = rank << PLACE_BITS, made
        self.words = regex.compile(WORDS)
        self.mixed = re.compile(r"\s (?!\S)")
        self.kept = Kept(self.stretch, KEPT, KEPT_CHARS)

    def word(self, word: str) -> int:
        """Tokens of one pre-token."""
        symbols = list(word.encode())
        n = len(symbols)
        if n < 2:
            return n
        merge = self.merge
        right = [*range(1, n), -1]
        left = [*range(-1, n - 1)]
        heap = [m[0] | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (m := merge.get(pair))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & PLACES
            j = right[i]
            if j < 0 or (m := merge.get((symbols[i], symbols[j]))) is None or m[0] != top - i:
                continue  # one of the two has merged since
            merges += 1
            made = symbols[i] = m[1]
            symbols[j] = -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merge.get((made, symbols[k])):
                    heapq.heappush(heap, m[0] | i)
            h = left[i]
            if h >= 0 and (m := merge.get((symbols[h], made))):
                heapq.heappush(heap, m[0] | h)
        return n - merges

    def stretch(self, text: str) -> int:
        return sum(map(self.word, self.words.findall(text)))

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if self.mixed.search(text):
            return self.stretch(text)
        words = text.split(" ")
        first = self.stretch(words[0])
        return first + sum(map(self.kept.__getitem__, [" " + w for w in words[1:]]))

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        return sum(self.plain(t) for t in self.added.split(text)) + len(self.added.findall(text))


@lru_cache(maxsize=2)
def counter_of(data: bytes) -> Counter:
    return Counter(data)


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    data = read_model(path)

    def start():
        count = counter_of(data).count

        def batch(doc_ids, rows):
            n = [count(t) if t else 0 for t in rows]
            return {"doc_id": doc_ids, "n_bytes": [len(t.encode()) for t in rows], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return batch

    return map_rows(texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", start)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(documents(spark, sf_dir), vocabulary_path())

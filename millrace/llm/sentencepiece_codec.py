"""SentencePiece encoding and decoding, exactly, for BPE models.

Encoding walks the text once. An Aho-Corasick automaton over the reachable
pieces gives the longest piece at each position; a piece is taken if it can
stand beside its predecessor, else the next shorter one is tried, else the
predecessor is given up. Two pieces can stand beside each other if merging
their joined text again yields the two: undo the later of the two last merges,
again and again, and look whether a merge across the boundary would have come
first. A bitfield holds the positions from which no encoding goes on, so none
is tried twice and the work stays linear in the text.

No piece has a space mark after another character, so no merge crosses from a
character to a following space mark: a text falls apart there into chunks,
which are encoded once and kept in a table of bounded size. Chunks that are
long are encoded but not kept.

Characters outside the vocabulary become their UTF-8 bytes' pieces. Decoding
joins pieces, reads runs of byte pieces as UTF-8 and takes off the dummy prefix.

Defined results: a null text counts as empty, which has no ids (n_tokens 0) and
decodes to the empty text. Rows that repeat are encoded each on its own. An
empty table gives an empty result. Other columns are ignored. U+2581 in a text
is the space mark itself and decodes to a space, as in the library.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import Kept, documents, map_rows, texts

SPACE = "▁"
#: Chunks kept by a worker, and the longest of them.
KEPT, KEPT_CHARS = 100_000, 48
#: Bits of a failed-position field that is a plain integer.
WORD_BITS = 60
#: Pairs of pieces kept by a worker.
PAIRS = 120_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Bits:
    """A long bitfield: bits >> i & 1 reads, bits |= i sets."""

    def __init__(self, n: int):
        self.data = bytearray(n // 8 + 1)

    def __rshift__(self, i: int) -> int:
        return self.data[i >> 3] >> (i & 7)

    def __ior__(self, i: int) -> Bits:
        self.data[i >> 3] |= 1 << (i & 7)
        return self


class Model:
    """A BPE model's pieces, their merges and the automaton."""

    def __init__(self, data: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("only BPE models with the identity normaliser, spaces kept and no user-defined pieces are handled")
        self.prefix = bool(normal.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.text_of = {i: p.replace(SPACE, " ") for p, i in self.id.items()}
        order = {s: r for r, s in enumerate(sorted({s for p, s, k in pieces if k == NORMAL}, reverse=True))}
        #: Pieces by text: when each merges; equal ranks merge from the left.
        self.rank = {p: order[s] for p, s, k in pieces if k == NORMAL and len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space mark after another character")
        #: The last merge of each reachable piece: its two parts.
        self.parts: dict[str, tuple[str, str]] = {}
        for p in sorted(self.rank, key=len):
            if (pair := self._last_merge(p)) is not None:
                self.parts[p] = pair
        #: What texts are split into, by number: the reachable pieces and the characters that pieces have.
        self.symbols = sorted({c for p in self.id for c in p} | self.parts.keys())
        of = {p: s for s, p in enumerate(self.symbols)}
        self.characters = {p: s for p, s in of.items() if len(p) == 1}
        self.lengths = [len(p) for p in self.symbols]
        #: The next shorter symbol at the same place; -1 for a character.
        self.shorter = [next((of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in of), -1) for p in self.symbols]
        #: Ids by symbol, and all of them as text; None for a character that is no piece.
        self.id_of = [self.id.get(p) for p in self.symbols]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.automaton = ahocorasick.Automaton()
        for p in self.parts:
            self.automaton.add_word(p, of[p])
        self.automaton.make_automaton()
        #: Pairs looked up before, as left * (number of symbols) + right; there are far fewer than words.
        self.fits = Kept(lambda pair: self.compatible(*(self.symbols[s] for s in divmod(pair, len(self.symbols)))), PAIRS)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The merge that completes a piece on its own; None if merging ends in something else."""
        at = list(piece)
        while len(at) > 2:
            best, where = None, -1
            for i in range(len(at) - 1):
                r = self.rank.get(at[i] + at[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                return None
            at[where : where + 2] = [at[where] + at[where + 1]]
        return (at[0], at[1]) if len(at) == 2 else None

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces yields the two again."""
        rank, parts = self.rank, self.parts
        limit = None  # merges across the boundary count while they come before this
        while True:
            r = rank.get(left + right)
            if r is not None and (limit is None or r < limit):
                return False
            a = rank[left] if left in parts else -1
            b = rank[right] if right in parts else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # of equals the left one merged first, and so would one across
                limit, right = b + 1, parts[right][0]

    def split(self, chunk: str) -> list[int]:
        """A chunk's symbols by number; a character that is none stands alone, as ~ its code point."""
        n = len(chunk)
        characters = self.characters
        longest = [characters.get(c, -1) for c in chunk]
        lengths, shorter, fits, many = self.lengths, self.shorter, self.fits, len(self.symbols)
        for end, s in self.automaton.iter(chunk):
            longest[end + 1 - lengths[s]] = s
        dead = Bits(n + 1) if n > WORD_BITS else 0
        out: list[int] = []
        last, at = -1, 0  # last times many, or below 0 where nothing merges with it
        while at < n:
            s = longest[at]
            if s < 0:
                out.append(~ord(chunk[at]))
                last = -1
                at += 1
                continue
            while True:
                end = at + lengths[s]
                if not dead >> end & 1 and (last < 0 or fits[last + s]):
                    out.append(s)
                    last, at = s * many, end
                    break
                less = shorter[s]
                if less >= 0:
                    s = less
                    continue
                dead |= 1 << at if n <= WORD_BITS else at
                s = out.pop()
                at -= lengths[s]
                last = out[-1] * many if out else -1
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        id_of = self.id_of
        split = self.split(chunk)
        found = [id_of[s] if s >= 0 else None for s in split]
        return found if None not in found else self._with_unknown(split)

    def _with_unknown(self, split: list[int]) -> list[int]:
        """Ids where some characters are no pieces: their UTF-8 bytes' pieces, or the unknown piece."""
        ids: list[int] = []
        for s in split:
            i = self.id_of[s] if s >= 0 else None
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids += [self.bytes[b] for b in (self.symbols[s] if s >= 0 else chr(~s)).encode()]
            else:
                ids.append(self.unknown)
        return ids

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; joined, they are the normalised text."""
        if not text:
            return []
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        words = marked.split(SPACE)
        out = [words[0]] if words[0] else []
        marks = 0
        for w in words[1:]:
            marks += 1
            if w:
                out.append(SPACE * marks + w)
                marks = 0
        return [*out, SPACE * marks] if marks else out

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.encode_chunk(c)]

    def plain(self, ids: list[int]) -> str:
        """What ids decode to, with the dummy prefix still on."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            pass
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for n in (1, 2, 3, 4):  # the library puts U+FFFD for each byte that fits in no character
                    try:
                        out.append(run[:n].decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[0]
            if i is None or self.kinds[i] == CONTROL:
                continue
            out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.plain(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.pieces[first].startswith(SPACE) else text


class Texts:
    """Encodes and decodes whole texts by way of kept chunks."""

    def __init__(self, model: Model):
        self.model = model
        self.kept = Kept(self._chunk, KEPT, KEPT_CHARS)
        self.after_space = Kept(lambda word: self._chunk(SPACE + word), KEPT, KEPT_CHARS)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """A chunk's ids, joined by commas, and the text that these decode to.

        A chunk's byte pieces are whole characters, so it decodes by itself to what it does in its text.
        """
        ids = self.model.encode_chunk(chunk)
        return ",".join(map(self.model.digits.__getitem__, ids)), self.model.plain(ids)

    def both(self, text: str) -> tuple[str, str]:
        """The ids, joined by commas, and the text that they decode to."""
        prefix = self.model.prefix
        if not text:
            return "", ""
        if not self.model.bytes:  # what is unknown doesn't come back, and joins with its like
            ids = self.model.encode(text)
            return ",".join(map(str, ids)), self.model.decode(ids)
        if prefix and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text:
            found = [*map(self.after_space.__getitem__, text.split(" "))]
        else:
            found = [*map(self.kept.__getitem__, self.model.chunks(text))]
        return ",".join([ids for ids, _ in found]), "".join([plain for _, plain in found])[1 if prefix else 0 :]


@lru_cache(maxsize=2)
def texts_of(data: bytes) -> Texts:
    return Texts(Model(data))


def codec(data: bytes, with_text: bool = False):
    """For map_rows: digests of ids and decoded text, or (with_text) the ids themselves."""

    def start():
        one = texts_of(data).both

        def digests(doc_ids, rows):
            n, a, b = [], [], []
            for text in rows:
                ids, plain = one(text)
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha256(ids.encode()).hexdigest())
                b.append(sha256(plain.encode()).hexdigest())
            return {"doc_id": doc_ids, "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        def whole(doc_ids, rows):
            both = [one(text) for text in rows]
            return {"doc_id": doc_ids, "ids": [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in both], "decoded": [plain for _, plain in both]}

        return whole if with_text else digests

    return start


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; tasks get the bytes, half a megabyte
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every row."""
    return map_rows(texts(docs), "doc_id long, ids array<int>, decoded string", codec(read_model(path), True))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return map_rows(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", codec(read_model(path)))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), model_path())

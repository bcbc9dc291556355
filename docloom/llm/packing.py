"""Best-fit packing of token sequences by exact complements.

A document longer than a sequence is cut into pieces; every piece has a length of at most the capacity, so the whole corpus
is described by one count per length. The plan is made from those counts alone (at most `capacity` numbers, whatever the
corpus): for the longest piece left, the gap it leaves is looked up among single lengths, pair sums and triple sums; a
combination that fills it exactly is used as often as the counts allow. What finds no exact complement takes the longest
length that still fits, and looks for an exact complement of the rest again. Then each piece, numbered within its length,
finds its sequence and offset in the plan.

Null text counts as empty, an empty document is its end token alone, repeated rows are packed each by itself, and an empty
table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import hold, materialize, trimmed, with_gapless_rank

CAPACITY = 4096
END_ID = 1
#: Words and pieces whose ids a Python worker keeps: about 200 bytes each.
CACHE, PIECE_CACHE = 300_000, 100_000

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Where splitting at white space first could differ from the tokenizer's own course: the whole text goes through it then.
_PLAIN_ONLY = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ", "᠎")


def _byte_letters() -> list[str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, others take the letters from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def split_word(word: str) -> list[str]:
    """The tokenizer's pieces of a text without white space; the two commonest forms need no pattern."""
    word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
    if word.isalpha():
        return [word]
    if word[-1:] in ",.;:!?" and word[:-1].isalpha():
        return [word[:-1], word[-1]]
    return _PIECES.findall(word)


class WordTokens:
    """Ids of a word-BPE tokenizer file as little-endian uint32 bytes, a word at a time with a bounded cache.

    The tokenizer drops white space and never joins over it, so the ids of a text are those of its words in turn.
    """

    def __init__(self, path: str, cache: int = CACHE, piece_cache: int = PIECE_CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.ids = [int(i).to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        owner = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if word.isascii() or word.isalpha() or not any(unicodedata.category(x) == "Cn" for x in word):
                    ids = b"".join(map(owner.pieces.__getitem__, split_word(word)))
                else:  # characters that this Python's tables don't know, but the tokenizer's may
                    ids = owner.whole(word)
                if len(self) < cache:
                    self[word] = ids
                return ids

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                spelt = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(owner.letters)
                ids = b"".join([owner.ids[t.id] for t in owner.model.tokenize(spelt)])
                if len(self) < piece_cache:
                    self[piece] = ids
                return ids

        self.words, self.pieces = Words(), Pieces()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(x in text for x in _PLAIN_ONLY):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


hold("tokens", _tokens.cache_clear)


class _Exact:
    """Combinations of one, two or three available lengths with a given sum."""

    def __init__(self, counts: np.ndarray):
        self.c, self.stale = counts, 0
        self._index()

    def _index(self) -> None:
        lengths = np.flatnonzero(self.c > 0)
        bits, sums = sum(1 << int(x) for x in lengths), 0
        for x in lengths:
            sums |= bits << int(x)
        size = 2 * len(self.c)
        raw = np.frombuffer((sums & ((1 << size) - 1)).to_bytes(size // 8 + 1, "little"), dtype=np.uint8)
        self.pair_sums, self.stale = np.unpackbits(raw, bitorder="little")[:size].astype(bool), 0

    def pair(self, total: int) -> list[int] | None:
        """The pair with the largest member, if any."""
        if total < 2:
            return None
        have = self.c[1:total] > 0
        both = have & have[::-1]
        if total % 2 == 0 and self.c[total // 2] < 2:
            both[total // 2 - 1] = False
        hits = np.flatnonzero(both)
        return [int(hits[-1]) + 1, total - int(hits[-1]) - 1] if len(hits) else None

    def find(self, total: int) -> list[int] | None:
        if self.c[total] > 0:
            return [total]
        if (two := self.pair(total)) is not None:
            return two
        if total < 3:
            return None
        if self.stale > 64:
            self._index()
        firsts = np.flatnonzero((self.c[1 : total - 1] > 0) & self.pair_sums[total - 1 : 1 : -1])[::-1] + 1
        for a in map(int, firsts):
            self.c[a] -= 1
            two = self.pair(total - a)
            self.c[a] += 1
            if two is not None:
                return [a, *two]
            self.stale += 1
        return None


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Where the pieces of each length go, and how many sequences there are.

    counts[n]: pieces of length n. Each entry of the plan has for the pieces of `length` with numbers from `first` on
    (`each` pieces in each of `sequences` sequences from `sequence` on) the offset of the first of them there.
    """
    c = np.zeros(capacity + 1, dtype=np.int64)
    c[: len(counts)] = counts
    taken, left, entries, sequence = np.zeros(capacity + 1, dtype=np.int64), c.copy(), [], 0
    exact = _Exact(left)

    def emit(members: list[int]) -> None:
        nonlocal sequence
        pattern = Counter(members)
        more = min(int(left[x]) // m for x, m in pattern.items())
        n, offset = 1 + more, 0
        for x, m in pattern.items():
            left[x] -= more * m
            entries.append((x, int(taken[x]), n, m, sequence, offset))
            taken[x] += n * m
            offset += x * m
        sequence += n

    for exact_only in (True, False):
        for length in range(capacity, 0, -1):
            while left[length] > 0:
                members, gap = [length], capacity - length
                left[length] -= 1
                while gap > 0:
                    if (rest := exact.find(gap)) is not None:
                        for x in rest:
                            left[x] -= 1
                        members, gap = members + rest, 0
                    elif exact_only:
                        break
                    else:
                        fits = np.flatnonzero(left[1 : gap + 1] > 0)
                        if not len(fits):
                            break
                        x = int(fits[-1]) + 1
                        left[x] -= 1
                        members.append(x)
                        gap -= x
                if gap > 0 and exact_only:
                    left[length] += 1
                    break
                emit(members)
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 6)
    return dict(zip(("length", "first", "sequences", "each", "sequence", "offset"), table.T, strict=True)), sequence


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokens(tokenizer_path), np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows: list[int] = []
                out: list[list[int]] = [[], [], [], []]
                for i, text in enumerate(part.column(1)):
                    ids = tokens.encode(text.as_py() or "") + end
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        rows.append(i)
                        for column, x in zip(out, (k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(id_col, text_col).mapInArrow(trimmed(cut, "tokens"), f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    plan, _ = plan_packing(counts, capacity)
    ranked = with_gapless_rank(pieces, ["length"], [id_col, "piece", "start", "ids_crc32"], "__dl_rank", int(counts.sum()))
    fields = [*pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = plan["length"] << 44 | plan["first"]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "__dl_rank"))
            at = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            i = rank - plan["first"][at]
            bin_, slot = i // plan["each"][at], i % plan["each"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in fields), pa.array(plan["sequence"][at] + bin_), pa.array(plan["offset"][at] + slot * length)],
                names=[*fields, "sequence_id", "offset"],
            )

    return ranked.select(*fields, "__dl_rank").mapInArrow(trimmed(lay, "tokens"), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes, cuts and packs docs: a row per piece with its sequence and place there."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    return place(pieces, capacity, id_col)

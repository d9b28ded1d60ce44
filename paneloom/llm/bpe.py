"""Byte-level BPE encoding and decoding by ranked merges, folded by Spark's higher-order functions.

1. Tasks cut their documents into words (matches of the pattern) and make one row for each batch of documents: the
   words that no earlier batch of the task had, as arrays of bytes (each with the next one), and the numbers of its words.
2. Each new word is folded in place by higher-order functions: the state is the list of pieces with the ranks of their
   pairs; each step joins the leftmost pair of the lowest rank and looks up the two pairs that this makes. Ranks of pairs stand in a double array (``Vocabulary``), which is broadcast as one row of arrays.
3. Ids are decoded by concatenating binary pieces.
4. Tasks note the ids and bytes of new words and put documents together again.

Nothing is shuffled, and a word is folded once in a task: steps 1 and 4 number words alike, since rows stay in the order
of their task. Both start anew after ``most`` words, so memory is bounded by that and by ``batch_chars``. Words longer than
``longest`` bytes (a run of letters without end) would make the fold quadratic; they are merged exactly by a heap
in step 4 instead, as are pieces that merges alone would not reach (the public vocabulary has none).

Defined results: a null text is an empty text: no ids, the checksums of empty strings; repeated rows and equal or null
doc_ids each keep a row; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokenize import _CUT, _DIVIDED

#: White space as Unicode has it, in place of \s, whose meaning differs between regular expression libraries.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: More than any id; pairs without a rank are looked up as larger numbers.
NO_RANK = 1 << 20
_MARKS = frozenset(",.;:!?")


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 piece and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def portable(pattern: str) -> str:
    """The pattern with white space spelled out."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Vocabulary:
    """Ranks of pairs as a double array: the pair (a, b) has the cell ``base[a] + b``, which holds a's number above 20 bits of
    rank if that pair has one. An id is the rank of its piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        if self.size >= NO_RANK:
            raise ValueError("ids have 20 bits at most")
        after: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    after.setdefault(left, {})[right] = rank
        self.after, self.base = after, np.zeros(self.size, np.int32)
        self.cells = self._placed()

    def _placed(self) -> np.ndarray:
        """Rows of pairs, larger ones first, each at a place where all its cells are free."""
        width = max(1 << 10, 4 * sum(map(len, self.after.values())))
        cells, used = np.full(width + self.size, self.size << 20, np.int64), set()
        for left, row in sorted(self.after.items(), key=lambda x: -len(x[1])):
            place = left * 40_503 % width
            while not used.isdisjoint(map(place.__add__, row)):
                place = (place + 7_919) % width
            used.update(map(place.__add__, row))
            self.base[left] = place
            for right, rank in row.items():
                cells[place + right] = left << 20 | rank
        return cells

    def apart(self) -> set[bytes]:
        """Pieces of the vocabulary that merges of their bytes do not end at."""
        return {x for x, rank in self.ranks.items() if self._merged(x) != [rank]}

    def _merged(self, word: bytes) -> list[int]:
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            low, i = min((self.after.get(ids[i], {}).get(ids[i + 1], NO_RANK), i) for i in range(len(ids) - 1))
            if low == NO_RANK:
                break
            ids[i : i + 2] = [low]
        return ids

    def row(self, spark: SparkSession) -> DataFrame:
        """One row of arrays: pieces of two neighbouring bytes, base, cells and the pieces of ids."""
        names: list[bytes | None] = [None] * self.size
        for piece, rank in self.ranks.items():
            names[rank] = piece
        alone = [self.ranks[bytes([i])] for i in range(256)]
        first = [self.ranks.get(bytes([i, j]), NO_RANK) << 42 | alone[i] for i in range(256) for j in range(256)] + [NO_RANK << 42 | x for x in alone]
        lists = {"v_first": (first, pa.int64()), "v_base": (self.base, pa.int32()), "v_cells": (self.cells, pa.int64()), "v_names": (names, pa.binary())}
        return spark.createDataFrame(pa.table({x: pa.array([values], pa.list_(kind)) for x, (values, kind) in lists.items()}))

    def fold(self, word: Column) -> Column:
        """The ids of one word, an array of its bytes, each times 256 with the next one added (the last: 65,536 added). The state is a list of pieces as numbers: the rank of the pair that
        a piece makes with the next (NO_RANK: none) above 22 bits of its place above 20 bits of its id, so that the least
        number is the leftmost pair of the lowest rank."""

        def pair(a: Column, b: Column) -> Column:  # a null neighbour makes no pair
            return F.least(F.get("v_cells", F.get("v_base", a.cast("int")) + b.cast("int")).bitwiseXOR(F.shiftleft(a, 20)), F.lit(NO_RANK).cast("long"))

        def piece(rank: Column, place_and_id: Column) -> Column:
            return F.shiftleft(rank, 42).bitwiseOR(place_and_id)

        def number(x: Column) -> Column:
            return x.bitwiseAND(F.lit(NO_RANK - 1))

        def step(s: Column, _: Column) -> Column:
            return _let(F.array_min(s), lambda low: F.when(low < F.lit(NO_RANK << 42), F.array_remove(F.transform(s, lambda x, i: join(s, x, i, low)), F.lit(-1).cast("long"))).otherwise(s))

        def join(s: Column, x: Column, i: Column, low: Column) -> Column:
            new = F.shiftright(low, 42)
            place = low.bitwiseAND(F.lit((1 << 42) - NO_RANK))
            return (
                F.when(x == low, piece(pair(new, number(F.get(s, i + 2))), place.bitwiseOR(new)))
                .when(F.get(s, i + 1) == low, piece(pair(number(x), new), x.bitwiseAND(F.lit((1 << 42) - 1))))
                .when(F.get(s, i - 1) == low, F.lit(-1).cast("long"))
                .otherwise(x)
            )

        start = F.transform(word, lambda x, i: F.get("v_first", x).bitwiseOR(F.shiftleft(i.cast("long"), 20)))
        return F.aggregate(word, start, step, lambda s: F.transform(s, lambda x: number(x).cast("int")))

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their binary pieces, concatenated."""
        return F.aggregate(ids, F.lit(b""), lambda found, i: F.concat(found, F.get("v_names", i)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word by ranked merges with a heap of pairs, leftmost first among equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    piece: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i] + piece[j])) is not None:
            heapq.heappush(heap, (r, i, len(piece[i]), len(piece[j])))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        if piece[i] is None or (j := after[i]) >= n or len(piece[i]) != a or len(piece[j]) != b:
            continue  # one of the two has grown or gone since
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[x] for x in piece if x is not None]


BATCH = "doc_ids array<long>, counts array<int>, numbers binary, known int, words array<array<int>>, apart_at array<int>, apart array<binary>"
_BATCH = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary()), ("known", pa.int32()), ("words", pa.list_(pa.list_(pa.int32()))), ("apart_at", pa.list_(pa.int32())), ("apart", pa.list_(pa.binary()))])


class _Units(dict):
    """What stands between two safe cuts at spaces, and its words' numbers as bytes. The pattern takes a space and ASCII letters
    as one word, and a mark after them as another."""

    def __init__(self, find, words: dict[str, int]):
        super().__init__()
        self.find, self.words = find, words

    def numbers(self, found: list[str]) -> bytes:
        words = self.words
        return array("i", [words.setdefault(x, len(words)) for x in found]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        text = " " + unit
        if unit.isascii() and unit.isalpha():
            found = [text]
        elif unit.isascii() and unit[-1:] in _MARKS and unit[:-1].isalpha():
            found = [text[:-1], unit[-1]]
        else:
            found = self.find(text)
        self[unit] = numbers = self.numbers(found)
        return numbers


def word_batches(docs: DataFrame, pattern: str, batch_chars: int, longest: int, unmerged: set[bytes], most: int = 400_000, most_units: int = 250_000) -> DataFrame:
    """One row for each batch of documents: the numbers of their words, how many words the task knew before it, and the new
    ones. Words that are not to be folded stand in ``apart`` and leave an empty array in ``words``. The pattern runs over
    each distinct unit about once."""
    spelled = portable(pattern)

    def of(batches: Iterator[pa.RecordBatch]):
        import regex

        find = regex.compile(spelled).findall
        words: dict[str, int] = {}
        units, keys, counts, numbers, known, size = _Units(find, words), [], [], [], 0, 0

        def row():
            new = [x.encode() for x in islice(words, known, None)]
            apart = [i for i, x in enumerate(new) if len(x) > longest or x in unmerged]
            kept = [new[i] for i in apart]
            for i in apart:
                new[i] = b""
            ends = np.zeros(len(new) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, new), np.int32, len(new)), out=ends[1:])
            flat = np.frombuffer(b"".join(new), np.uint8).astype(np.int32)
            codes = flat << 8
            codes[:-1] |= flat[1:]
            last = ends[1:][ends[1:] > ends[:-1]] - 1
            codes[last] = flat[last] + (1 << 16)
            lists = pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)))
            one = [[keys], [counts], [b"".join(numbers)], [known], lists, [apart], [kept]]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(one, _BATCH.types, strict=True)], schema=_BATCH)

        for batch in batches:
            for key, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = x.as_py() or ""
                head, *rest = text.split(" ") if _DIVIDED.search(text) is None else _CUT.split(text)
                found = units.numbers(find(head)) + b"".join(map(units.__getitem__, rest))
                keys.append(key), counts.append(len(found) // 4), numbers.append(found)
                size += len(text)
                if size >= batch_chars:
                    yield row()
                    keys, counts, numbers, known, size = [], [], [], len(words), 0
                    if len(words) >= most:
                        words.clear(), units.clear()
                        known = 0
                if len(units) >= most_units:
                    units.clear()
        if keys:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(of, BATCH)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, batch_chars: int = 5_000_000, longest: int = 200, most: int = 400_000) -> DataFrame:
    """Each batch row with ids and decoded bytes of its new words (empty for those in ``apart``)."""
    vocabulary = Vocabulary(ranks)
    batches = word_batches(docs, pattern, batch_chars, longest, vocabulary.apart(), most)
    folded = batches.crossJoin(F.broadcast(vocabulary.row(docs.sparkSession))).withColumn("ids", F.transform("words", vocabulary.fold))
    kept = [x for x in batches.columns if x != "words"]
    return folded.withColumn("decoded", F.transform("ids", vocabulary.decode)).select(*kept, "ids", "decoded")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(batches_: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, number of ids and the checksums of ids and decoded bytes of every document."""
    shared = batches_.sparkSession.sparkContext.broadcast(ranks)

    def of(batches: Iterator[pa.RecordBatch]):
        pieces = {v: k for k, v in shared.value.items()}
        digits = {i: str(i).encode() for i in pieces}
        written: list[bytes] = []
        decoded: list[bytes] = []
        for batch in batches:
            for r in range(len(batch)):
                row = {x: batch.column(x)[r] for x in batch.schema.names}
                known = row["known"].as_py()
                if known == 0:
                    written, decoded = [], []
                elif known != len(written):
                    raise ValueError("rows of encoded() have to stay in their tasks and in order")
                ids = row["ids"].values
                ends, flat = ids.offsets.to_numpy(), [*map(digits.__getitem__, ids.flatten().to_pylist())]
                written += [b",".join(flat[a:b]) for a, b in pairwise((ends - ends[0]).tolist())]
                decoded += row["decoded"].values.to_pylist()
                for i, word in zip(row["apart_at"].as_py(), row["apart"].as_py(), strict=True):
                    found = merge_long(word, shared.value)
                    written[known + i] = b",".join(map(digits.__getitem__, found))
                    decoded[known + i] = b"".join(map(pieces.__getitem__, found))
                numbers, out, at = np.frombuffer(row["numbers"].as_py(), "<i4"), [], 0
                for key, count in zip(row["doc_ids"].as_py(), row["counts"].as_py(), strict=True):
                    mine = numbers[at : at + count].tolist()
                    at += count
                    text = b",".join(map(written.__getitem__, mine))
                    out.append((key, text.count(b",") + 1 if mine else 0, hashlib.sha256(text).hexdigest(), hashlib.sha256(b"".join(map(decoded.__getitem__, mine))).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)

    return batches_.mapInArrow(of, DIGESTS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Ids of every whole document by ranked merges, decoded again."""
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)

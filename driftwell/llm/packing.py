"""Bounded-space online packing of token ids into sequences.

1. Each partition of documents is read as a stream. A document's ids are cut at the sequence length; what is
   left of it is one piece.
2. OPEN windows at most are open at a time. A piece goes to the open window that it fills best (the least room
   that still holds it). If none holds it and all windows are open, the fullest is emitted; where its room is
   CUT ids or more, the head of the piece fills it first.
3. At the end of a partition its open windows are left over. Leftovers of all partitions meet in buckets of
   about BUCKET windows by a hash, and are packed the same way, in descending length. The windows that are open
   at the end of a bucket are merged, the emptiest into the fullest, so that one at most isn't full.

Ids come from a table of words: a text is cut where no token spans (``words_of``), and each different word is
encoded once while it stays in the worker's table (WORDS at most, then the table is begun anew). The ids are
those of the whole text. The vocabulary must be one that lower-cases and drops white space.

Sequences are rows (sequence_id, offset) of pieces; sequence ids are unique, not gapless: the partition or the
bucket and a running number. The ids of a sequence can be had with ``ids=True``.

Defined results: null and empty texts have the closing id alone; null ids of documents stay null; repeated rows
are packed as often as they occur; other columns are ignored, whatever their names; an empty table gives an
empty result. Documents longer than a window are cut; each id lies in exactly one piece.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialise, worker_cache

LENGTH = 2048
OPEN = 64
CUT = 16
BUCKET = 1024
WORDS = 600_000
#: Between an ASCII letter or digit and the ASCII punctuation that ends its word.
ENDING = re.compile(rb"(?<=[a-z0-9])(?=[!-/:-@\[-`{-~]+(?:\s|$))")
CLOSE = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: A piece: (doc_id, start, ids as little-endian bytes, tokens of its document).
Piece = tuple[object, int, bytes, int]


def words_of(text: str | None) -> list[bytes]:
    """The text's words, fewer different ones without change to their ids.

    The vocabulary lower-cases, and begins anew between a letter or digit and the punctuation after it. Texts
    that may name special tokens are left as they are.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.split() if b"<|" in data else ENDING.sub(b" ", data.lower()).split()


def tokenizer_ids(vocabulary: str, close: int = CLOSE, words: int = WORDS) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit numbers, ``close`` at the end."""
    from tokenizers import Tokenizer

    tokenizer: Tokenizer = worker_cache(f"tokenizer {vocabulary}", lambda: Tokenizer.from_file(vocabulary))
    known: dict[bytes, bytes] = worker_cache(f"words {vocabulary}", dict)
    end = np.array([close], "<u4").tobytes()

    def learn(new: list[bytes]) -> None:
        """Encode the words together; the place of each token in the line tells its word."""
        plain = [w.decode("utf-8", "replace") for w in new]
        found = tokenizer.encode(" ".join(plain), add_special_tokens=False)
        ids, starts = np.array(found.ids, "<u4").tobytes(), np.cumsum([0] + [len(w) + 1 for w in plain])
        of_word = np.searchsorted(starts, np.array([a for a, _ in found.offsets], np.int64), "right") - 1
        bounds = (4 * np.searchsorted(of_word, np.arange(len(new) + 1))).tolist()
        for word, a, b in zip(new, bounds, bounds[1:], strict=False):
            known[word] = ids[a:b]

    def encode(texts: list[str | None]) -> list[bytes]:
        split = [words_of(t) for t in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > words:
            known.clear()
            new = set().union(*split)
        ordered = list(new)
        for at in range(0, len(ordered), 4096):
            learn(ordered[at : at + 4096])
        return [b"".join(map(known.__getitem__, w)) + end for w in split]

    return encode


class Packer:
    """Windows of ``length`` ids, at most ``open_windows`` of them open; ``emit`` gets each that is closed."""

    def __init__(self, length: int, open_windows: int, cut: int, emit: Callable[[list[Piece]], None]) -> None:
        self.length, self.most, self.cut, self.emit = length, open_windows, cut, emit
        self.rooms: list[tuple[int, int]] = []  # (room, number of the window), ascending
        self.windows: dict[int, list[Piece]] = {}
        self.numbers = itertools.count()

    def add(self, piece: Piece) -> None:
        doc, start, ids, tokens = piece
        n = len(ids) // 4
        while n >= self.length:
            self.emit([(doc, start, ids[: 4 * self.length], tokens)])
            start, ids, n = start + self.length, ids[4 * self.length :], n - self.length
        if n:
            self._place((doc, start, ids, tokens), n)

    def _place(self, piece: Piece, n: int) -> None:
        at = bisect.bisect_left(self.rooms, (n, -1))
        if at == len(self.rooms):
            if len(self.rooms) < self.most:
                self._open([piece], self.length - n)
                return
            room, number = self.rooms.pop(0)
            pieces = self.windows.pop(number)
            if room >= self.cut:
                doc, start, ids, tokens = piece
                pieces.append((doc, start, ids[: 4 * room], tokens))
                piece, n = (doc, start + room, ids[4 * room :], tokens), n - room
            self.emit(pieces)
            self._place(piece, n)
            return
        room, number = self.rooms.pop(at)
        self.windows[number].append(piece)
        if room == n:
            self.emit(self.windows.pop(number))
        else:
            bisect.insort(self.rooms, (room - n, number))

    def _open(self, pieces: list[Piece], room: int) -> None:
        number = next(self.numbers)
        self.windows[number] = pieces
        bisect.insort(self.rooms, (room, number))

    def left(self) -> list[list[Piece]]:
        return [self.windows[number] for _, number in self.rooms]

    def pour(self) -> list[list[Piece]]:
        """The open windows, the emptiest cut up to fill the fullest: all but one are full."""
        left = [(self.windows[number], room) for room, number in self.rooms]
        out: list[list[Piece]] = []
        while left:
            pieces, room = left.pop(0)
            while room and left:
                source, free = left[-1]
                doc, start, ids, tokens = source.pop()
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * n], tokens))
                room -= n
                if 4 * n < len(ids):
                    source.append((doc, start + n, ids[4 * n :], tokens))
                left[-1] = (source, free + n)
                if not source:
                    left.pop()
            out.append(pieces)
        return out


def _rows(sequence: int, pieces: list[Piece], ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc, start, data, tokens in pieces:
        n = len(data) // 4
        yield doc, start, n, zlib.crc32(data), tokens, sequence, offset, data if ids else None
        offset += n


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=COLUMNS)
    df["doc_id"] = df["doc_id"].astype("Int64")
    return df


def _pack_stream(encoder: Callable[[], Callable], length: int, open_windows: int, cut: int, ids: bool) -> Callable:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Emitted pieces have a sequence_id; leftover ones have a negative one, and their ids with them."""
        encode, rows, at = encoder(), [], 0
        numbers = itertools.count()

        def emit(pieces: list[Piece]) -> None:
            rows.extend(_rows((at << 32) + next(numbers), pieces, ids))

        packer = Packer(length, open_windows, cut, emit)
        for batch in batches:
            at = int(batch["_at"].iloc[0]) if len(batch) else at
            for low in range(0, len(batch), 256):
                docs = batch["doc_id"].iloc[low : low + 256].tolist()
                for doc, data in zip(docs, encode(batch["text"].iloc[low : low + 256].tolist()), strict=True):
                    packer.add((None if pd.isna(doc) else int(doc), 0, data, len(data) // 4))
            yield _frame(rows)
            rows.clear()
        for n, pieces in enumerate(packer.left()):
            rows.extend(_rows(-1 - ((at << 32) + n), pieces, True))
        yield _frame(rows)

    return pack


def _merge_bucket(length: int, open_windows: int, cut: int, ids: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def merge(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        numbers = itertools.count()

        def emit(pieces: list[Piece]) -> None:
            out.extend(_rows((1 << 62) + (int(key[0]) << 32) + next(numbers), pieces, ids))

        packer = Packer(length, open_windows, cut, emit)
        left = left.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        for doc, start, data, tokens in zip(left["doc_id"], left["start"], left["ids"], left["doc_tokens"], strict=True):
            packer.add((None if pd.isna(doc) else int(doc), int(start), bytes(data), int(tokens)))
        for pieces in packer.pour():
            emit(pieces)
        return _frame(out)

    return merge


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, open_windows: int = OPEN, cut: int = CUT, bucket: int = BUCKET, ids: bool = False) -> DataFrame:
    """The pieces of all documents (doc_id, text): PIECE, ``ids`` filled if asked for."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("_at"))
    stream = _pack_stream(lambda: tokenizer_ids(vocabulary), length, open_windows, cut, ids)
    # Partitions are numbered where they are read, and their windows are kept, so that a task that runs again can't renumber.
    pieces = materialise(thin.mapInPandas(stream, PIECE))
    left = pieces.filter("sequence_id < 0")
    buckets = max(1, -(-left.select("sequence_id").distinct().count() // bucket))
    merged = left.groupBy(F.pmod(F.xxhash64("sequence_id"), F.lit(buckets)).alias("_bucket")).applyInPandas(_merge_bucket(length, open_windows, cut, ids), PIECE)
    return pieces.filter("sequence_id >= 0").unionAll(merged)

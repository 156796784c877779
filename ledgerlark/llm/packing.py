"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows.  A piece goes to the
window that it fills best; when none fits, the fullest window takes the head
of the piece, which fills it, and is emitted.  What is still open at the end
of a partition is merged in a second, much smaller pass; the last window of
that pass is cut at powers of two, so it needs no padding either.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_at_once, settle

WINDOW = 4096
OPEN_WINDOWS = 32
#: Rows of left-over pieces that one task of the second pass takes.
LEFT_OVER_ROWS = 20_000
#: Words that a Python worker met last and, beyond this, as many that it met before them are remembered, about 330 bytes each.
CACHED_WORDS = 200_000
#: Texts that a task hands to Python at a time.
TEXTS_AT_ONCE = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


#: Characters up to here are split into pieces in Python; other words go to the tokenizer itself.
PLAIN_UPTO = "\u024f"
LONGEST_PLAIN = 200


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordTokenizer(dict):
    """Ids of a tokenizer whose pieces never cross white space, by remembered words.

    Maps a word to its ids in bytes.  Equal to encoding the whole text: the
    pre-tokenizer drops white space, so each word is encoded alone.  The
    merges of a word run in a faster library: a word's last symbol is its
    byte and an end mark, which always merge first, and the vocabulary's
    merges follow in their order.  Texts and words that Python might split
    otherwise than the tokenizer go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.earlier = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], _byte_of()
        mark = model["end_of_word_suffix"]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

        def raw(symbol: str) -> bytes:
            ends = symbol.endswith(mark)
            return bytes(byte_of[c] for c in (symbol[: -len(mark)] if ends else symbol)) + b"\xff" * ends

        ranks = {bytes([b, 255]): b for b in range(255)}  # no text has byte 255
        ranks |= {bytes([b]): 255 + b for b in range(256)}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        special = {x["content"] for x in spec["added_tokens"]}
        self.id_of = {ranks[k]: i for s, i in model["vocab"].items() if s not in special and (k := raw(s)) in ranks}
        self.merge = tiktoken.Encoding("words", pat_str="(?s:.)+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.earlier = dict(self)
            self.clear()
        if (known := self.earlier.get(word)) is not None:
            self[word] = known
            return known
        plain = unicodedata.normalize("NFC", word).lower()
        if len(word) > LONGEST_PLAIN or "<|" in word or max(plain, default="") > PLAIN_UPTO:
            ids = self.whole(word)
        elif plain == word and word.isalpha():
            ids = self.piece(word)
        else:
            ids = b"".join([self[x] if x != word else self.piece(x) for x in self.pieces.findall(plain)])
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        return np.array([self.id_of[k] for k in self.merge(piece.encode() + b"\xff")], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return np.frombuffer(self.whole(text), "<u4")
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


class TokenizerOnWorker:
    """A tokenizer, built in each Python worker that uses it.

    Sent as a broadcast value it serves all tasks of a worker, with its
    remembered words; a worker drops it, as other broadcast values, with the
    first task that doesn't use it, so later stages don't carry its memory.
    """

    def __init__(self, path: str):
        self.path, self.built = path, None

    def __getstate__(self):
        return {"path": self.path, "built": None}

    def get(self) -> WordTokenizer:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if self.built is None:
            self.built = WordTokenizer(self.path)
        return self.built


class Packer:
    """Open windows of one task.  A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, window: int = WINDOW, slots: int = OPEN_WINDOWS):
        self.window, self.slots, self.next_id = window, slots, first_id
        self.free: list[tuple[int, int]] = []  # (free tokens, window id), ascending
        self.open: dict[int, list] = {}

    def place(self, doc_id, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Put a piece away; yield the windows that this completes, as lists of pieces."""
        while len(ids) >= self.window:
            yield [(doc_id, start, ids[: self.window], total)]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.free, (len(ids), -1))
            if at == len(self.free) and len(self.free) >= self.slots:
                room, key = self.free.pop(0)  # the fullest
                yield [*self.open.pop(key), (doc_id, start, ids[:room], total)]
                start, ids = start + room, ids[room:]
                continue
            if at == len(self.free):
                room, key = self.window, self.next_id
                self.next_id += 1
                self.open[key] = []
            else:
                room, key = self.free.pop(at)
            self.open[key].append((doc_id, start, ids, total))
            if room == len(ids):
                yield self.open.pop(key)
            else:
                insort(self.free, (room - len(ids), key))
            return

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.open[key] for _, key in self.free]


def powers(pieces: list, window: int) -> Iterator[list]:
    """Cut a run of pieces into full windows and then sequences of powers of two."""
    left = sum(len(p[2]) for p in pieces)
    now, room = [], 0
    for doc_id, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
                left -= room
            now.append((doc_id, start, ids[:room], total))
            start, cut = start + len(ids[:room]), len(ids[:room])
            ids, room = ids[cut:], room - cut
            if not room:
                yield now
                now = []


class Rows:
    """Collects piece rows and hands them out as record batches."""

    def __init__(self, with_ids: bool, many: int = 4096):
        self.with_ids, self.many, self.rows = with_ids, many, []

    def add(self, pieces: list, sequence: int, open_window: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            data = np.ascontiguousarray(ids, "<u4").tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(data), total, sequence, offset)
            self.rows.append((*row, data if open_window else None) if self.with_ids else row)
            offset += len(ids)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            kinds = [pa.int64()] * len(NAMES) + [pa.binary()] * self.with_ids
            names = NAMES + ["ids"] * self.with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names)
            self.rows = []


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, slots: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all rows into windows; one row per piece (``PIECES``).

    A row's ids are its text's ids and then ``end_id``, so a null or empty
    text gives the one id.  Each id lies in exactly one piece.  Every sequence
    has exactly ``window`` tokens or a power of two below it.  Defined cases:
    a null id is packed like others; repeated rows are packed as often as they
    come; an empty table gives no rows; other columns are not looked at.
    """

    sent = docs.sparkSession.sparkContext.broadcast(TokenizerOnWorker(tokenizer_path))  # a path

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, end = sent.value.get(), Rows(True), np.array([end_id], "<u4")
        home = TaskContext.get().partitionId() << 32
        sequence, packer = home, Packer(0, window, slots)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([words.encode(text.as_py() or ""), end])
                for pieces in packer.place(doc_id, 0, ids, len(ids)):
                    rows.add(pieces, sequence)
                    sequence += 1
                yield from rows.batches(4096)
        for pieces in packer.rest():
            rows.add(pieces, sequence, open_window=True)
            sequence += 1
        yield from rows.batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 62) + (TaskContext.get().partitionId() << 32)
        packer, rows = Packer(0, window, slots), Rows(False)
        for r in (r for batch in batches for k in range(0, len(batch), TEXTS_AT_ONCE) for r in batch.slice(k, TEXTS_AT_ONCE).to_pylist()):
            for pieces in packer.place(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]):
                rows.add(pieces, sequence)
                sequence += 1
            yield from rows.batches(4096)
        for pieces in powers([p for x in packer.rest() for p in x], window):
            rows.add(pieces, sequence)
            sequence += 1
        yield from rows.batches()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with rows_at_once(docs.sparkSession, TEXTS_AT_ONCE):
        first = settle(narrow.mapInArrow(online, f"{PIECES}, ids binary"), "packed")
    left = first.filter("ids is not null")
    tasks = -(-left.count() // LEFT_OVER_ROWS) or 1
    again = (
        left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(merge, PIECES)
    )
    return first.filter("ids is null").select(*NAMES).unionByName(again)

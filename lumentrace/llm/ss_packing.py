"""Packing into fixed windows by the sum-of-squares rule.

A window of ``window`` tokens is open while partly filled; N(h) counts the open windows filled to level h. A
document of s tokens goes to the level (or to a new window) after which the sum of N(h) squared is least; only
the array of levels decides, so a document is placed when it is seen and never moved. Documents longer than
a window first fill whole windows of their own, the rest is placed as any other. At the end of a partition the
windows still open are joined whole, the fullest first, each with the fullest others that fit; then the least filled
are cut to fill what gaps the others have, and what is left of the last one is cut into powers of two. So padding comes to
nothing, and all but the few tokens of the windows that are cut (some per cent of those placed) stay as the levels put them.

Every Spark partition packs its own rows: nothing is shuffled, memory holds one batch and the open windows,
and a task that is run again repeats its own sequences only. Sequence ids are the partition's number in the
high bits and a count in the low ones.

Defined results: a null or empty text is the end token alone; a tokenizer's added tokens are taken where their
strings stand in a text; texts of any length and runs of any length are encoded whole; repeated rows are packed each; a null id stays
null in its pieces; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
#: Bits of a sequence id that count within a partition.
LOCAL_BITS = 40
#: White space in a row from which a text is left to the slower library.
LONG_RUN = 50_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Open windows by fill level, and the choice among them."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int, fresh: int) -> tuple[int, int, bool]:
        """Window and offset for ``size`` < window tokens, and whether the window is full now; ``fresh`` is the next new window."""
        n, last = self.count, self.window - size
        # Change of the sum of squares when a window rises from level h to h + size; a full window is no longer counted.
        change = np.empty(last + 1, np.int64)
        change[:last] = 2 * (n[size : self.window] - n[:last]) + 2
        change[last] = 1 - 2 * n[last]
        change[n[: last + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        level = last - int(np.argmin(change[::-1]))  # of equals the fullest
        at = self.open[level].pop() if level else fresh
        n[level] -= level > 0
        if level + size < self.window:
            self.open[level + size].append(at)
            n[level + size] += 1
        return at, level, level + size == self.window


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Takes documents' ids one by one and gives finished pieces."""

    def __init__(self, window: int = WINDOW, base: int = 0):
        self.window, self.next, self.levels = window, base, Levels(window)
        self.held: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        #: Tokens of the windows that ``finish`` has cut.
        self.cut_tokens = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, doc, start, ids, total, sequence, offset) -> None:
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit(doc, start, ids[start : start + self.window], total, self._new(), 0)
        if rest := total - whole:
            at, offset, full = self.levels.place(rest, self.next)
            if at == self.next:
                self._new()
            self.held.setdefault(at, []).append((doc, whole, ids[whole:], total, offset))
            if full:
                for d, start, part, n, off in self.held.pop(at):
                    self._emit(d, start, part, n, at, off)

    def finish(self) -> None:
        """Join the open windows, then cut the least filled ones into the gaps of the others."""
        size = {at: sum(len(p[2]) for p in pieces) for at, pieces in self.held.items()}
        by_level: dict[int, list[int]] = {}
        for at in sorted(self.held, reverse=True):
            by_level.setdefault(size[at], []).append(at)
        levels = sorted(by_level)
        joined: list[list[int]] = []
        while levels:
            group, room = [], self.window
            while levels and (k := bisect_right(levels, room)):
                level = levels[k - 1]
                group.append(by_level[level].pop())
                room -= level
                if not by_level[level]:
                    levels.pop(k - 1)
            joined.append(group)
        filled = [sum(size[at] for at in group) for group in joined]
        order = sorted(range(len(joined)), key=lambda g: (-filled[g], g))
        # From the fullest on, as many stay whole as their gaps can be filled by the rest.
        gaps, left, stay = 0, sum(filled), 0
        for g in order:
            if left - filled[g] < gaps + self.window - filled[g]:
                break
            gaps, left, stay = gaps + self.window - filled[g], left - filled[g], stay + 1
        loose = [p for g in reversed(order[stay:]) for at in joined[g] for p in self.held[at]]
        self.cut_tokens = left
        places: list[tuple[int, int, int]] = []
        for g in order[:stay]:
            at, offset = self._new(), 0
            for window in joined[g]:
                for doc, start, ids, total, _ in self.held[window]:
                    self._emit(doc, start, ids, total, at, offset)
                    offset += len(ids)
            if offset < self.window:
                places.append((at, offset, self.window - offset))
        rest = left - gaps
        fresh = [self.window] * (rest // self.window) + powers(rest % self.window)
        takes = iter([*places, *((None, 0, n) for n in fresh)])
        at, offset, room = None, 0, 0
        for doc, start, ids, total, _ in loose:
            while len(ids):
                if not room:
                    at, offset, room = next(takes)
                    at = self._new() if at is None else at
                part, ids = ids[:room], ids[room:]
                self._emit(doc, start, part, total, at, offset)
                start, room, offset = start + len(part), room - len(part), offset + len(part)
        self.held = {}

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        self.rows = []
        return batch


def load_encoder(ranks_path: str, pattern: str, file_path: str):
    """A function from a text to its list of ids, equal to those of the tokenizers file at ``file_path``.

    The file's ranks and splitting pattern, with its added tokens, give the same ids in a quarter of the time. Texts
    with a run of white space of ``LONG_RUN`` or more, on which that library overflows, are left to the file's own, and
    so are all texts if an added token of the file takes neighbours in or wants whole words.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(file_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    whole = Tokenizer.from_file(file_path)
    plain = not any(t[flag] for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized"))
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def encode(text: str) -> list[int]:
        if not plain or (len(text) >= LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text)):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


def pack(docs: DataFrame, ranks_path: str, pattern: str, file_path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences; columns as in ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(ranks_path, pattern, file_path)
        packer = Packer(window, TaskContext.get().partitionId() << LOCAL_BITS)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end)
                packer.add(doc.as_py(), np.array(ids, "<u4"))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)

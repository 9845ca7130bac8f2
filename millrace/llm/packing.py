"""Harmonic packing of token ids into fixed-length sequences."""

from __future__ import annotations

import zlib

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import Ranked, compiled
from millrace.llm.common import bound_batches, trim

#: Capacity of a sequence, the id that ends each document, and the part of a bin that may stay empty before a length is cut.
CAPACITY, END_ID, SLACK = 2048, 1, 1 / 128
#: Rows of one returned Arrow batch.
OUT_ROWS = 20_000
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cuts(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """Pieces ``(length, class)`` of one document; class k holds lengths of at most capacity / k, k to a bin.

    Full capacities come first. A rest in class k stays whole if k of it nearly fill a bin; else a
    piece of exactly capacity // (k + 1) goes to class k + 1 and the remainder is cut in turn.
    """
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * k >= capacity * (1 - slack) or rest <= capacity // 64:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


class Bins:
    """Open bins of one worker: per class one, which takes as many pieces as the class's number."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << 32
        self.open: dict[int, list] = {}  # class -> [sequence, fill, pieces]

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, piece: tuple, k: int) -> list[tuple]:
        """piece: (doc_id, start, ids, doc_tokens). Returns the rows of a bin that it completes."""
        if k == 1:
            return [self._row(piece, self._sequence(), 0)]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        return self._close(self.open.pop(k)) if len(pieces) == k else []

    @staticmethod
    def _row(piece: tuple, sequence: int, offset: int) -> tuple:
        doc, start, ids, total = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset, sequence = [], 0, self._sequence()
        for p in pieces:
            rows.append(self._row(p, sequence, offset))
            offset += len(p[2]) // 4
        return rows

    def finish(self) -> list[tuple]:
        """Rows of what unfilled bins hold (below one bin per class): laid end to end, the last stretch cut at powers of two, which need no padding."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open, rows, room, pieces = {}, [], 0, []
        todo = sum(len(p[2]) // 4 for p in left)
        for doc, start, ids, total in left:
            at = 0
            while at < len(ids) // 4:
                if not room:
                    room = self.capacity if todo >= self.capacity else 1 << (todo.bit_length() - 1)
                n = min(room, len(ids) // 4 - at)
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + n)], total))
                at, room, todo = at + n, room - n, todo - n
                if not room:
                    rows += self._close(pieces)
                    pieces = []
        return rows


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``capacity`` ids; every document ends with ``end_id``.

    Each task fills its own bins while it reads, so nothing is shuffled and a task holds less than one
    bin per class. A null or empty text is the end id alone; repeated rows are packed each; a long
    text gives many pieces; an empty table gives no rows. Other columns of ``docs`` are ignored.
    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        bpe, bins, rows = compiled(Ranked, path), Bins(TaskContext.get().partitionId(), capacity), []
        end = end_id.to_bytes(4, "little")

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(FIELDS))], list(FIELDS))

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, at = (bpe.encode(text) if text else b"") + end, 0
                total = len(ids) // 4
                for n, k in cuts(total, capacity):
                    rows += bins.put((doc, at, ids[4 * at : 4 * (at + n)], total), k)
                    at += n
                if len(rows) >= OUT_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows + bins.finish())
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{f} long" for f in FIELDS))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pack_documents` over the whole table."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

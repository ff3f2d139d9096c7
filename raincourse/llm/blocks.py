"""Blocks of documents and what the whole corpus says about the entries of their dictionaries.

A block is some documents of one task, about a fixed number of octets, or one longer document. It
lists each entry (a word, a pair of token ids) once, and its documents hold places in that list.
Corpus-wide figures of the entries are joined to the short lists, never to the documents, and
brought back block by block. So no table of all entries has to fit in a task, at any size
of the corpus, and an entry that is everywhere is one row a block.
"""

from __future__ import annotations

import numpy as np


class Numbers:
    """Block numbers that no other task of the stage gives out."""

    def __init__(self):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def __call__(self) -> int:
        self.next += 1
        return self.next - 1


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers as octets that compress well: lowest octets of all, then the next ones, and so on."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes | None) -> np.ndarray:
    planes = np.frombuffer(data or b"", np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def steps(places: np.ndarray) -> np.ndarray:
    """Ascending places as differences, which are small."""
    return np.diff(places, prepend=0)

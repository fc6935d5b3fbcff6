"""Sets of word shingles of whole documents, as arrays of hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemill.llm.textkernel import Piece, Words, mix, spans, starts_of, words


@dataclass
class Sets:
    """Distinct hashes by document: those of document i are ``hash[first[i]:first[i + 1]]``, ascending."""

    hash: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def by_document(owner: np.ndarray, hashes: np.ndarray, docs: int) -> Sets:
    """Sort and make distinct within each document."""
    order = np.argsort(hashes)
    small = np.uint16 if docs < 1 << 16 else np.uint32
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[fresh], hashes[fresh]
    return Sets(hashes, np.searchsorted(owner, np.arange(docs + 1)))


def shingle_sets(piece: Piece, width: int = 5, kind: str = "fold", found: Words | None = None) -> Sets:
    """Runs of ``width`` words; of a document with fewer words, all of them as one."""
    w = found or words(piece, kind)
    counts = np.diff(w.first)
    start, per = starts_of(w.first, width)
    hashes = spans(w.hash, width)[start] if len(start) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(piece.docs), per)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for n in np.unique(counts[short]):
            at = np.flatnonzero(counts[short] == n)
            runs = spans(w.hash, int(n))
            whole[at] = mix(runs[w.first[short[at]]] + np.uint64(n))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    return by_document(owner, hashes, piece.docs)

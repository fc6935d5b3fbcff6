"""Documents that share most of their word shingles: a parity-sketch join.

Hashes of a document's shingles flip bits of a sketch. Two sketches differ in
no more bits than the sets have elements that only one of them has, so a
Hamming distance bounds the symmetric difference from below.

Candidates come by pigeonhole. In each size band the bits are cut into blocks.
A document sends its first D + 1 blocks that any shingle falls into, D being
the largest difference that a linked document may have: at most D of them hold
a difference, so two linked documents send one block with equal content. (The
first D + 1 of either: up to where the earlier one stops, it has D + 1 such
blocks, and one of them has no difference.) Documents with too few such blocks
send single shingles too, D + 1 of them, in a name space of their own.

What comes first may be any order of contents that all documents share. It is
from rare to common, by counts of all contents in a sketch of fixed size:
documents that share a passage and little else mostly send what is theirs alone.
The counts may be too large; that changes which blocks are sent, never what is
found.

Documents with equal sets, which 128 bits tell, are one node: the one with the
smallest id stands for the others and alone sends blocks. Candidates are held
against each other's sizes and sketches, and what is left against the sets
themselves.

Similar documents share many blocks, so each shard of the join would find the
same pair again. Therefore documents that have one of their few least hashes in
common are tried before the join: all pairs of few, and of more the first with
each. What is linked gets its component as a label. Documents send it along, and
the hashes of which all pairs were tried; only pairs that have neither in common
are still open, and with others the join has nothing to do. Blocks with few
documents give all their open pairs. Blocks with more give those with a pivot.
Such blocks with the same smallest id have mostly the same members, so they are
taken together as a group: a member's sketch is sent to the group once, not once
for each pair. There members are held against each other by their sketches, in
tiles of bounded size: first the pairs of a least spanning forest of each tile,
which connect what is linked, then all pairs between components still apart that
the sketches allow. Nothing is capped: each pair of different sets that the
pigeonhole finds is linked, known to be connected, or refuted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id
from tidemill.llm.packing import pack, unpack
from tidemill.llm.shingles import Sets, shingle_sets
from tidemill.llm.textkernel import mix, pieces
from tidemill.operators.components import connected_components
from tidemill.staging import parallelism, release, setting, stage

#: A link: 100 * intersection >= SHARE * union.
SHARE = 75
#: Documents that a block may have for all its pairs to be taken at once: beyond, a group ships fewer sketches than pairs do.
SMALL_RUN = 6
#: Members of a larger block that are held against each other in a task, on average.
TILE = 1 << 14
#: Pairs that a tile holds before it takes their forest.
HELD_PAIRS = 1 << 20
#: 64-bit words of the filter of ids; 8 MB.
FILTER_WORDS = 1 << 20
#: Counters of how many documents have a content, a byte each when sent, and the slices in which tasks' counters are added up.
COUNTERS, SLICES = 1 << 22, 64
#: Bits of a signature beside its shard, bytes of text that a shard stands for at most, and those that are shingled at once to be sent.
KEY_BITS, SHARD_BYTES, SENT_BYTES = 40, 1 << 28, 1 << 20

#: Least hashes of a set by which it is tried before the join: sets that are linked have one in common but in 0.4 % of cases.
LEADS = 4
#: Columns of documents of which something is known before the join: component, and least hashes of which all pairs were tried.
LABEL, TRIED = "label of the node", [f"tried by hash {k}" for k in range(LEADS)]
#: Documents of a larger block up to which its open pairs are counted; they are sent where they are fewer than its documents.
COUNTED_RUN = 32

_ASK = "shard int, ids binary, labels binary, tried binary, sizes binary, keys binary, owners binary"
_SKETCH = "id long, n long, x long, y long, sketch binary, least array<long>"
_FOUND = "large boolean, a long, b long"


def _most(n: np.ndarray, share: int) -> np.ndarray:
    """Elements that a linked set may have more or less than one of n, both ways together."""
    # For sizes a, b the difference is at most (a + b)(100 - share) / (100 + share), and b at most a * 100 / share.
    return n * (100 - share) // share


def _ranks(owner: np.ndarray, signature: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
    """Place of each content among its owner's, common ones last; owners ascend."""
    n, at = len(owner), np.arange(len(owner))
    begin = np.searchsorted(owner, owner)
    if classes is None or not n:
        return at - begin
    order = np.argsort(owner << 8 | classes[signature & np.uint64(COUNTERS - 1)], kind="stable")
    out = np.empty(n, np.int64)
    out[order] = at
    return out - begin


def _blocks(sets: Sets, share: int, classes: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Owners and signatures of the blocks that documents send, or of all that they could send.

    ``classes`` has for the low bits of a signature how common it is; what is
    equally common is ordered by place, the same in all documents.
    """
    n = sets.sizes()
    top, most = n * 100 // share, _most(n, share)
    level = lambda x: np.ceil(np.log2(np.maximum(x, 1)) / 2 - 1e-12).astype(np.int64)
    owners, signatures = [], []

    def add(owner: np.ndarray, signature: np.ndarray) -> None:
        if not every:
            sent = _ranks(owner, signature, classes) <= most[owner]
            owner, signature = owner[sent], signature[sent]
        owners.append(owner)
        signatures.append(signature)

    own_level, last = level(n), level(top)
    for step in range(int((last - own_level).max(initial=0)) + 1):
        use = (n > 0) & (own_level + step <= last)
        lev = own_level + step
        keep = np.repeat(use, n)
        h, o = sets.hash[keep], np.repeat(np.arange(len(n)), n)[keep]
        if not len(h):
            continue
        bits = 2 * lev[o]
        block = np.where(bits > 0, h >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(fresh)
        content, o = np.bitwise_xor.reduceat(mix(h), at), o[at]
        add(o, mix(content + lev[o].astype(np.uint64)))
        few = np.flatnonzero(use & (np.bincount(o, minlength=len(n)) <= most))
        if len(few):
            h = np.concatenate([sets.hash[sets.first[d] : sets.first[d + 1]] for d in few])
            add(np.repeat(few, n[few]), mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(signatures)


def _count(share: int, width: int, text_col: str):
    """Counters of a task's contents, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        for _, piece in pieces(batches, text_col):
            _, sig = _blocks(shingle_sets(piece, width), share, every=True)
            np.add.at(held, (sig & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        yield _slices(held.reshape(SLICES, -1), np.flatnonzero(held.reshape(SLICES, -1).any(axis=1)))

    return run


def _slices(held: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([pack(held[k]) for k in which], pa.binary())], ["slice", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = unpack(counts, np.uint32).astype(np.uint64)
            held[k] = held[k] + own if k in held else own
    if held:
        which = sorted(held)
        for k in which:
            yield _slices(held[k][None, :], np.zeros(1, np.int64)).set_column(0, "slice", pa.array([k], pa.int32()))


def _send(shards: int, share: int, width: int, id_col: str, text_col: str, classes, told=None):
    """Signatures by shard: KEY_BITS of each, ascending, and which of the documents beside them it is of.

    Rows have LABEL and TRIED, or else those that ``told`` lets through are left to where it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, piece in pieces(_asked(batches, id_col, told, without=True), text_col, SENT_BYTES):
            sets = shingle_sets(piece, width)
            ids, sizes = rows.column(id_col).to_numpy(), sets.sizes()
            labels = ids if told else rows.column(LABEL).to_numpy()
            tried = np.zeros((len(ids), LEADS), np.int64) if told else np.stack([rows.column(c).to_numpy() for c in TRIED], axis=1)
            owner, sig = _blocks(sets, share, classes.value)
            shard = ((sig >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            keys = mix(sig) >> np.uint64(64 - KEY_BITS)
            order = np.lexsort((keys, shard))
            owner, keys = owner[order], keys[order]
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            out = []
            for s in np.flatnonzero(np.diff(cut)):
                own = slice(cut[s], cut[s + 1])
                docs, which = np.unique(owner[own], return_inverse=True)
                out.append((int(s), pack(np.diff(ids[docs], prepend=0)), pack(ids[docs] - labels[docs]), pack(tried[docs].ravel()), pack(sizes[docs].astype(np.uint32)), pack(np.diff(keys[own], prepend=np.uint64(0))), pack(which.astype(np.uint16))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int32()), *(pa.array(list(c), pa.binary()) for c in cols[1:])], ["shard", "ids", "labels", "tried", "sizes", "keys", "owners"])

    return run


def _join(share: int):
    """Of a shard: open candidate pairs (a < b), and of large runs with many of them (smallest id, id)."""

    def pairs(i: np.ndarray, j: np.ndarray, ids: np.ndarray, labels: np.ndarray, tried: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(sizes[i], sizes[j]) >= share * np.maximum(sizes[i], sizes[j])) & (labels[i] != labels[j])
        i, j = i[fits], j[fits]
        some = np.flatnonzero(tried[i, 0].astype(bool) & tried[j, 0].astype(bool))  # hashes come first, zeros after
        if len(some):
            fits = np.ones(len(i), bool)
            for k in range(LEADS):
                one = tried[i[some], k]
                for m in range(LEADS):
                    fits[some] &= (one != tried[j[some], m]) | (one == 0)
            i, j = i[fits], j[fits]
        return np.where(ids[i] < ids[j], i * len(ids) + j, j * len(ids) + i)

    def batch(large: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), large)), pa.array(a), pa.array(b)], ["large", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, tried, sizes, keys, refs, base = [], [], [], [], [], [], 0
        for rows in batches:
            for r in rows.to_pylist():
                ids.append(np.cumsum(unpack(r["ids"], np.int64)))
                labels.append(ids[-1] - unpack(r["labels"], np.int64))
                tried.append(unpack(r["tried"], np.int64).reshape(-1, LEADS))
                sizes.append(unpack(r["sizes"], np.uint32).astype(np.int64))
                keys.append(np.cumsum(unpack(r["keys"], np.uint64)))
                refs.append(unpack(r["owners"], np.uint16).astype(np.int64) + base)
                base += len(ids[-1])
        if not ids:
            return
        ids, labels, tried, sizes, keys, refs = map(np.concatenate, (ids, labels, tried, sizes, keys, refs))
        order = np.argsort(keys)
        keys, refs = keys[order], refs[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(begin, len(keys)))
        got = []
        for r in range(2, SMALL_RUN + 1):
            at = begin[length == r]
            i, j = np.triu_indices(r, 1)
            for part in np.array_split(at, max(1, len(at) * len(i) // (1 << 18))):
                members = refs[part[:, None] + np.arange(r)]
                got.append(np.unique(pairs(members[:, i].ravel(), members[:, j].ravel(), ids, labels, tried, sizes)))
        groups: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero(length > SMALL_RUN):
            members = refs[begin[k] : begin[k] + length[k]]
            if (labels[members] == labels[members[0]]).all():
                continue
            if len(members) <= COUNTED_RUN:
                i, j = np.triu_indices(len(members), 1)
                if len(few := pairs(members[i], members[j], ids, labels, tried, sizes)) < len(members):
                    got.append(few)
                    continue
            members = members[np.lexsort((ids[members], sizes[members]))]
            n, at = sizes[members], 0
            while at < len(members):
                upto = int(np.searchsorted(n, n[at] * 100 // share, side="right"))
                got.append(pairs(np.full(upto - at - 1, members[at]), members[at + 1 : upto], ids, labels, tried, sizes))
                at = max(upto, at + 1)
            own = ids[members]
            groups.setdefault(int(own.min()), []).append(own)
        for least, members in groups.items():
            every = np.unique(np.concatenate(members))
            yield batch(True, np.full(len(every), least), every)
        every = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
        for part in np.array_split(every, max(1, len(every) >> 16)):
            yield batch(False, ids[part // len(ids)], ids[part % len(ids)])

    return run


def _sketch(width: int, id_col: str, text_col: str):
    """id, n, 128 bits of the set, a parity sketch of n to 2n bits, a power of two and 64 at least, and the LEADS least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, piece in pieces(batches, text_col):
            sets = shingle_sets(piece, width)
            n = sets.sizes()
            bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            base = np.concatenate([[0], np.cumsum(bits)])
            owner = np.repeat(np.arange(len(n)), n)
            at = base[owner] + (sets.hash & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
            parity = (np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)
            whole = np.packbits(parity, bitorder="little").tobytes()
            cells = [whole[a >> 3 : b >> 3] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
            marks = []
            for salt in (0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets.hash ^ np.uint64(salt)))])
                marks.append(pa.array((total[sets.first[1:]] - total[sets.first[:-1]]).view(np.int64)))
            few = np.minimum(n, LEADS)
            upto = np.concatenate([[0], np.cumsum(few)])
            least = sets.hash[np.arange(upto[-1]) + np.repeat(sets.first[:-1] - upto[:-1], few)].view(np.int64)
            least = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(least))
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(n, pa.int64()), *marks, pa.array(cells, pa.binary()), least], ["id", "n", "x", "y", "sketch", "least"])

    return run


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """The sketches in the rows of x, with fewer words: halves are combined."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _passes(h: np.ndarray, a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    """Whether sets of a and b elements whose difference is h at least may be linked."""
    return (100 + share) * h <= (100 - share) * (a + b)


def _hamming(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            h = np.zeros(batch.num_rows, np.int64)
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            la, lb = np.array([len(x) for x in sa], np.int64), np.array([len(x) for x in sb], np.int64)
            for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
                at = np.flatnonzero((la == x) & (lb == y))
                for part in np.array_split(at, max(1, len(at) * max(x, y) >> 22)):
                    one, two = (np.frombuffer(b"".join(s[i] for i in part), np.uint64).reshape(len(part), -1) for s in (sa, sb))
                    words = min(x, y) // 8
                    h[part] = np.bitwise_count(_fold(one, words) ^ _fold(two, words)).sum(axis=1)
            near = pa.array(_passes(h, na, nb, share))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(h).filter(near)], ["a", "b", "h"])

    return run


def _tile(share: int, nearest: bool):
    """Pairs across components inside a tile that their sketches allow; or a least spanning forest of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id"])
        two_sides = int(rows["i"].iloc[0]) != int(rows["j"].iloc[0])
        ids, n, label, block = (rows[c].to_numpy() for c in ("id", "n", "label", "block"))
        sketches = rows["sketch"].to_numpy()
        words = np.array([len(s) // 8 for s in sketches])
        held: dict[int, tuple[int, np.ndarray]] = {}
        for w in np.unique(words):
            # Rows from w words on, ascending as n is; those of more words are folded.
            lo, hi = np.searchsorted(words, w), np.searchsorted(words, 2 * w, side="right")
            held[w] = (int(lo), np.concatenate([_fold(np.frombuffer(s, np.uint64)[None, :], w) for s in sketches[lo:hi]]))
        top = np.searchsorted(n, n * 100 // share, side="right")
        found, pairs, numbered = [], 0, np.unique(label, return_inverse=True)[1]

        def forest() -> list[np.ndarray]:
            # The forest of all pairs is that of the forests of parts of them.
            i, j, h = np.concatenate(found, axis=1)
            return [np.stack([i, j, h])[:, _forest(numbered, i, j, h / (n[i] + n[j]))]]

        for i in range(len(ids)):
            if nearest and pairs > HELD_PAIRS:
                found, pairs = forest(), 0
            lo, folded = held[words[i]]
            others = np.arange(i + 1, top[i])
            apart = label[others] != label[i]
            if two_sides:
                apart &= block[others] != block[i]
            others = others[apart]
            if len(others):
                h = np.bitwise_count(folded[others - lo] ^ folded[i - lo]).sum(axis=1).astype(np.int64)
                ok = np.flatnonzero(_passes(h, n[i], n[others], share))
                found.append(np.stack([np.full(len(ok), i), others[ok], h[ok]]))
                pairs += len(ok)
        if nearest and found:
            found = forest()
        i, j, h = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "h": h, "ca": label[i], "cb": label[j]})

    return run


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which pairs make a least spanning forest (Kruskal), members of a component being joined from the start."""
    order, root, tree, step, at = np.argsort(cost, kind="stable"), np.arange(label.max(initial=-1) + 1), [], 1024, 0

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while at < len(order):
        part = order[at : at + step]
        flat = np.array([top(x) for x in range(len(root))], np.int64)
        apart = part[flat[label[i[part]]] != flat[label[j[part]]]]
        for k in apart.tolist():
            a, b = top(label[i[k]]), top(label[j[k]])
            if a != b:
                root[max(a, b)] = min(a, b)
                tree.append(k)
        at, step = at + step, step * 2
    return np.array(tree, np.int64)


def _asked(batches: Iterator[pa.RecordBatch], id_col: str, bits, without: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows whose id may be among those asked for: all that are, and few others; or all rows without these."""
    for batch in batches:
        if bits is not None:
            ids, keep = batch.column(id_col).to_numpy(), np.ones(batch.num_rows, bool)
            for k in (0, 1):
                word, bit = _spot(ids, k)
                keep &= (bits.value[word] >> bit & np.uint64(1)).astype(bool)
            batch = batch.filter(pa.array(keep != without))
        yield batch


def _sets(width: int, id_col: str, text_col: str, asked):
    """id and set of each document whose id may be among those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, piece in pieces(_asked(batches, id_col, asked), text_col):
            s = shingle_sets(piece, width)
            whole, first = s.hash.tobytes(), s.first.tolist()
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([whole[8 * a : 8 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "members"])

    return run


def _spot(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(k + 1))
    return (x & np.uint64(FILTER_WORDS - 1)).astype(np.int64), x >> np.uint64(58)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        word, bit = (np.concatenate(x) for x in zip(_spot(ids, 0), _spot(ids, 1), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["word", "mask"])


def _linked(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= share * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, share: int, width: int, id_col: str, text_col: str):
        self.spark, self.share, self.width = docs.sparkSession, share, width
        self.cols = (id_col, text_col)
        self.docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).where(F.col(id_col).isNotNull())
        self.sketches = stage(self.docs.mapInArrow(_sketch(width, *self.cols), _SKETCH), "sketches")
        self.copies, self.equals = self.equal()

    def equal(self) -> tuple[DataFrame, DataFrame]:
        """(node, rep) of documents whose set one with a smaller id has; and of ids that have other sets besides, which stay nodes."""
        key = ["n", "x", "y"]
        some = self.sketches.where("n > 0").select("id", *key)
        # Written, so that the join has an exchange of its own, which may be split where one set is very frequent.
        reps = stage(some.groupBy(*key).agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep != last").select(*key, "rep"), "reps")
        same = stage(some.join(reps, key).where("id != rep").select(F.col("id").alias("node"), "rep").distinct(), "same")
        several = stage(some.distinct().groupBy(F.col("id").alias("node")).count().where("count > 1").select("node"), "several")
        return same.join(several, "node", "left_anti"), same.join(several, "node", "left_semi")

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """Ids in these columns as those of the documents that stand for them."""
        for c in columns:
            df = df.join(self.copies.select(F.col("node").alias(c), F.col("rep").alias(f"rep {c}")), c, "left").withColumn(c, F.coalesce(f"rep {c}", c)).drop(f"rep {c}")
        return df

    def commonness(self):
        """By a content's low bits how common it is: its counter in quarters of a standard deviation, and far above the mean in eighths of a doubling."""
        counts = self.docs.mapInArrow(_count(self.share, self.width, self.cols[1]), "slice int, counts binary")
        held = np.zeros((SLICES, COUNTERS // SLICES), np.float32)
        for row in counts.repartitionById(SLICES, F.col("slice")).mapInArrow(_add_up, "slice int, counts binary").toLocalIterator():
            held[row["slice"]] = unpack(row["counts"], np.uint64)
        mean = float(held.mean(dtype=np.float64))
        z = (held.ravel() - np.float32(mean)) / np.float32(max(1.0, mean**0.5))
        steps = 4 * np.clip(z + 4, 0, 20) + 8 * np.log2(np.maximum(1, z / 16))
        return self.spark.sparkContext.broadcast(np.minimum(steps, 255).astype(np.uint8))

    def shards(self) -> int:
        """Of the hash space: those of the session, or as many as keep a shard's part of the texts bounded."""
        shingles = self.sketches.agg(F.sum("n")).first()[0] or 0
        return max(parallelism(self.spark), -(-8 * shingles // SHARD_BYTES))

    def leads(self) -> tuple[DataFrame, DataFrame]:
        """(a, b, h) with one of their least hashes in common that sizes and sketches allow; (id, tried) with the hashes all of whose pairs these are."""
        some = self.sketches.join(self.copies.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.explode("least").alias("hash"))
        runs = stage(some.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count("*").alias("members")).where("a != last").select("hash", "a", "members"), "runs")
        led = stage(some.join(runs, "hash").select("id", "hash", "a", (F.col("members") <= SMALL_RUN).alias("small")), "led")
        ids = led.where("small").groupBy("hash").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        every = ids.select(F.explode(F.expr("flatten(transform(ids, (x, k) -> transform(slice(ids, k + 2, size(ids)), y -> struct(x AS a, y AS b))))")).alias("pair")).select("pair.*")
        near = self.near(every.unionByName(led.where("NOT small AND id != a").select("a", F.col("id").alias("b"))).distinct())
        # Zero stands for none.
        tried = stage(led.where("small AND hash != 0").groupBy("id").agg(F.slice(F.collect_set("hash"), 1, LEADS).alias("tried")), "hashes")
        release(runs, led)
        return near, tried

    def near(self, pairs: DataFrame) -> DataFrame:
        """(a, b, h) of those pairs that sizes and sketches allow."""
        side = lambda k: self.sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {self.share} * greatest(na, nb)").select("a", "b", "na", "nb", "sa", "sb")
        near = near.mapInArrow(_hamming(self.share), "a long, b long, h long")
        return stage(near.groupBy("a", "b").agg(F.min("h").alias("h")), "near")

    def asks(self, shards: int, classes, told: DataFrame, held) -> DataFrame:
        """What documents send: those that nothing is told about where they are read, the few others with their labels."""
        id_col = self.cols[0]
        send = lambda held: _send(shards, self.share, self.width, *self.cols, classes, held)
        some = self.docs.mapInArrow(lambda batches: _asked(batches, id_col, held), self.docs.schema)
        # Texts stay unsorted, and the plan is the same for every size.
        some = some.join(told.hint("shuffle_hash"), F.col(f"`{id_col}`") == F.col("told id"), "left").where("copy IS NULL OR NOT copy")
        known = [F.coalesce(F.get("tried", F.lit(k)), F.lit(0).cast("long")).alias(c) for k, c in enumerate(TRIED)]
        some = some.select(*(F.col(f"`{c}`") for c in self.cols), F.coalesce(LABEL, F.col(f"`{id_col}`")).alias(LABEL), *known)
        return self.docs.mapInArrow(send(held), _ASK).unionByName(some.mapInArrow(send(None), _ASK))

    def candidates(self, label: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Open (a, b, h) that sizes and sketches allow; (group, id) of larger runs."""
        shards, classes = self.shards(), self.commonness()
        none = F.lit(None)
        copies = self.copies.select(F.col("node").alias("told id"), none.cast("long").alias(LABEL), none.cast("array<long>").alias("tried"), F.lit(True).alias("copy"))
        named = label.where("node != component").select(F.col("node").alias("told id"), F.col("component").alias(LABEL), none.cast("array<long>").alias("tried"), F.lit(False).alias("copy"))
        told = copies.unionByName(named).unionByName(tried.select(F.col("id").alias("told id"), none.cast("long").alias(LABEL), "tried", F.lit(False).alias("copy")))
        told = stage(told.groupBy("told id").agg(F.max(LABEL).alias(LABEL), F.max("tried").alias("tried"), F.max("copy").alias("copy")), "told")
        held = self.filter_of(told.select(F.col("told id").alias("id")))
        found = stage(self.asks(shards, classes, told, held).repartitionById(shards, F.col("shard")).mapInArrow(_join(self.share), _FOUND), "found")
        classes.unpersist()
        held.unpersist()
        near = self.near(found.where("NOT large").select("a", "b").distinct())
        large = stage(found.where("large").select(F.col("a").alias("group"), F.col("b").alias("id")).distinct(), "groups")
        release(found, told)
        return near, large

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a staged table, that are linked, by their sets."""
        held = self.filter_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        asked = stage(self.docs.mapInArrow(_sets(self.width, *self.cols, held), "id long, members binary"), "sets")
        side = lambda k: asked.select(F.col("id").alias(k), F.col("members").alias(f"m{k}"))
        out = stage(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ma", "mb").mapInArrow(_linked(self.share), "a long, b long"), "links")
        held.unpersist()
        release(asked)
        return out

    def filter_of(self, ids: DataFrame):
        """A filter of fixed size that lets all these ids through."""
        words = ids.mapInArrow(_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
        held = np.zeros(FILTER_WORDS, np.uint64)
        held[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
        return self.spark.sparkContext.broadcast(held)

    def across(self, near: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        of = lambda k: label.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        named = near.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return named.select("a", "b", "h", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")

    def tiles(self, large: DataFrame, label: DataFrame, nearest: bool) -> DataFrame:
        """Pairs across components inside groups of larger runs that sizes and sketches allow."""
        named = large.join(label.withColumnRenamed("node", "id"), "id", "left").select("group", "id", F.coalesce("component", "id").alias("label"))
        named = stage(named, "members")
        still = named.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("blocks")).where("lo != hi")
        rows = named.join(still.select("group", "blocks"), "group").join(self.sketches, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "label", "sketch")
        return rows.groupBy("group", "i", "j").applyInPandas(_tile(self.share, nearest), "a long, b long, h long, ca long, cb long")

    def components(self) -> DataFrame:
        """(node, component) of documents that stand for others and have links."""
        tried, hashes = self.leads()
        tried = tried.select("a", "b")
        links = stage(self.verified(tried).unionByName(self.equals.toDF("b", "a")), "links")
        label = stage(connected_components(links.toDF("src", "dst")), "labels")
        near, large = self.candidates(label, hashes)
        for nearest in (True, False):
            still = self.across(near, label).unionByName(self.tiles(large, label, nearest))
            if nearest:
                still = still.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min_by(F.struct("a", "b"), F.struct("h", "a", "b")).alias("pair")).select("pair.*")
            still = stage(still.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "still")
            more = self.verified(still)
            if not more.isEmpty():
                links = stage(links.unionByName(more), "links")
                label = stage(connected_components(links.toDF("src", "dst")), "labels")
            tried = stage(tried.unionByName(still), "tried")
        return label


@any_id("component_id")
def near_duplicates(docs: DataFrame, share: int = SHARE, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set
    has its distinct runs of ``width`` words, or all its words as one run if
    they are fewer; null and empty texts have an empty set and no link. Two
    documents are linked when ``100 * intersection >= share * union``;
    ``component_id`` is the smallest id that links lead to, the own included.
    Rows with the same id are one node. A row with a null id gets n_shingles
    but a null component_id and takes no part. Other columns aren't looked at.
    """
    # Whole texts and sets go to Python: small Arrow batches.
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)):
        join = _Join(docs, share, width, id_col, text_col)
        label = join.components()
    known = join.named(join.sketches.select("id", "n", F.col("id").alias("node")), "node").join(label, "node", "left")
    known = known.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    nameless = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).where(F.col(id_col).isNull())
    nameless = nameless.mapInArrow(_sketch(width, id_col, text_col), _SKETCH)
    return known.unionByName(nameless.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

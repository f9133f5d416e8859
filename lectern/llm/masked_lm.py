"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

The network predicts a word from `window` words on either side: a hidden layer of the context words'
embeddings, scaled by position, then a two-level softmax (class of the unit, unit in its class), with
(1 + y / 256)^256 for exp(y), which costs numpy eight products. Units are words, parts of words and bytes. A word that is frequent by its counts over all documents is one
unit; every other word is spelled, case-folded, without loss: in parts of `PART` bytes that are units if
frequent, and else by their bytes; a part or byte that begins a word differs from one inside. The count
that makes a unit is `SHARE` * (words of the corpus)^(2/3), so units, classes and parameters grow with the
corpus. A document's score is the sum of the log-probabilities of all its units, each given both its sides.

Training is data-parallel. Every document is turned into its units once, in a staged table, and belongs
to one of `parts` parts, by a hash of its id and text; the number of parts is that of the corpus's units,
in millions, to the power 2/3. The parts start alike, each goes over its documents in the order of their
hashes by Adagrad steps, and their parameters are averaged, weighted by the positions they saw. This is
done in `rounds` rounds, each on its own share of the documents, so every position is trained on once.
Neither parts nor order depend on how the table is partitioned, so the scores don't either. What is
gathered grows with the corpus: counts of its words and their parts, and a set of parameters from each
part, averaged in the cluster before the result comes back.

Defined cases
- A document without words (null, empty, only signs) has n_words 0, log_likelihood 0 and a null mean.
- Positions outside the document count as one boundary word.
- Rows that repeat id and text are one document in training, however many there are. Every row gets a
  row of the result, also repeated ones and such without id; extra columns are ignored; an empty table
  gives an empty result (and a network left at its start).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, folded, mix, need, pieces, row_hash, staged, text_buffer, tidy, words

CLASSES = 32
VOCAB = CLASSES * CLASSES  # at least; classes grow with the units
BYTES, FIRST, PART, SHARE = 512, 976, 3, 0.002  # units of single bytes; words that are units at any count
WINDOW, DIM, ROUNDS, STEP, SEED = 3, 24, 2, 0.4, 20_231
#: Positions in a training step, at first and at last; positions that are shuffled together, in segments.
BATCH, LARGE, SHUFFLED, SEGMENT = 512, 8192, 1 << 18, 64
#: Floats that are worked on together, so that they stay in a core's cache from one numpy call to the next.
CACHED = 1 << 16
#: Units of one part of a corpus of a million units.
PART_UNITS = 1_000_000


def _part_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each part of at most PART bytes, of another stream than the words'."""
    key = np.where(first, 1 << 62, 1 << 61)
    for k in range(PART):
        at = start + k
        key += np.where(at < end, b[np.minimum(at, len(b) - 1)].astype(np.int64) + 1, 0) << (9 * k)
    return mix(key.astype(np.uint64))


def _parts(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, start, end, begins its word) of the parts of words."""
    n = -(-(end - start) // PART)
    word = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(word)) - (np.cumsum(n) - n)[word]
    at = start[word] + j * PART
    return word, at, np.minimum(at + PART, end[word]), j == 0


def _find(h: np.ndarray, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The unit of each hash, -1 if there is none."""
    out = np.full(len(h), -1, np.int64)
    if not len(table) or not len(h):
        return out
    # hashes are spread evenly, so their upper bits lead to the few of the sorted table that share them
    bits = min(24, len(table).bit_length() + 2)
    shift = np.uint64(64 - bits)
    first = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount((table >> shift).astype(np.int64), minlength=1 << bits), out=first[1:])
    of = (h >> shift).astype(np.int64)
    at, end = first[of], first[of + 1]
    rows = np.flatnonzero(at < end)
    at, end = at[rows], end[rows]
    while len(rows):
        same = table[at] == h[rows]
        out[rows[same]] = ids[at[same]]
        at += 1
        more = ~same & (at < end)
        rows, at, end = rows[more], at[more], end[more]
    return out


def _units(data: np.ndarray, offs: np.ndarray, table: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, unit offsets by row, words by row): frequent words by their hash, the others spelled."""
    h, start, end, wo = words(data, offs)
    word = _find(h, table, ids)
    rest = np.flatnonzero(word < 0)
    width = np.ones(len(h), np.int64)
    if not len(rest):
        return word, wo, np.diff(wo)
    b = folded(data)
    owner, ps, pe, first = _parts(start[rest], end[rest])
    part = _find(_part_hashes(b, ps, pe, first), table, ids)
    size = np.where(part < 0, pe - ps, 1)
    width[rest] = np.bincount(owner, weights=size).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(at[-1], np.int64)
    out[at[:-1]] = word
    spell = np.repeat(np.arange(len(part)), size)  # the part of every unit of a spelled word
    k = np.arange(len(spell)) - (np.cumsum(size) - size)[spell]
    inner = ~(first[spell] & (k == 0))
    begin = np.cumsum(width[rest]) - width[rest]
    out[np.arange(len(spell)) + (at[rest] - begin)[owner[spell]]] = np.where(part[spell] >= 0, part[spell], b[ps[spell] + np.where(part[spell] >= 0, 0, k)] + 256 * inner)
    return out, at[wo], np.diff(wo)


def _cached(rows: int, wide: int) -> list[tuple[int, int]]:
    """Row ranges [i, j) of about CACHED floats, at least one row each."""
    n = max(1, CACHED // max(1, wide))
    return [(i, min(i + n, rows)) for i in range(0, rows, n)]


class Network:
    """Parameters, their running squares, and the steps on them; float32 throughout.

    Output vectors, their biases and a row of ones are held together, so that one product with a hidden
    row over 256, 1 / 256 and 1 gives 1 + y / 256; p has views of them."""

    def __init__(self, dim: int = DIM, window: int = WINDOW, seed: int = SEED, start: np.ndarray | None = None, classes: int = CLASSES):
        self.dim, self.window, self.seed, self.classes, self.vocab = dim, window, seed, classes, classes * classes
        rng = np.random.default_rng(seed)
        shapes = [(self.vocab + 1, dim), (2 * window, dim), (dim,), (dim, classes), (classes,), (classes, dim, classes), (classes, classes)]
        scales = [0.3, 0.0, 0.0, 0.1, 0.0, 0.1, 0.0]
        self.one, self.each = np.ones((dim + 2, classes), np.float32), np.ones((classes, dim + 2, classes), np.float32)
        self.p = [np.zeros(x, np.float32) for x in shapes[:3]] + [self.one[:dim], self.one[dim], self.each[:, :dim], self.each[:, dim]]
        for held, x, scale in zip(self.p, shapes, scales, strict=True):
            held[...] = rng.normal(0, scale, x) if scale and start is None else 0
        self.p[1] += 0.5
        # embeddings and output vectors have one running square each, the others one for every entry
        self.squares = [np.full(x, 1e-3, np.float32) for x in [(self.vocab + 1, 1), (2 * window, dim), (dim,), (1, classes), (classes,), (classes, 1, classes), (classes, classes)]]
        self.inner = np.empty((classes, dim + 1, classes), np.float32)  # for the gradients of a step; new memory each time costs more than some of the work on it
        if start is not None:
            self.load(start)

    def __reduce__(self):
        return Network, (self.dim, self.window, self.seed, self.flat(), self.classes)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.p, *self.squares)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.p, *self.squares):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def _around(self) -> list[int]:
        """Where the words of a context begin, from the first of `window` words before a position."""
        return [k for k in range(2 * self.window + 1) if k != self.window]

    def _runs(self, floats: int) -> tuple[int, list[tuple[int, int]]]:
        """(longest, ranges [i, j)) of so many floats, cut between positions, of which a few arrays fit a core's cache."""
        most = max(1, CACHED // 4 // self.dim) * self.dim
        return min(most, floats), [(i, min(i + most, floats)) for i in range(0, floats, most)]

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings of all units of rows, hidden layer of all but the outer ones), one row after another.

        The hidden layer goes on over the ends of the rows, where nothing reads it, so all work is on plain runs of floats."""
        x = np.take(self.p[0], rows.ravel(), axis=0).ravel()
        h = np.empty(len(x) - 2 * self.window * self.dim, np.float32)
        most, runs = self._runs(len(h))
        pos, b, t = np.tile(self.p[1], (1, most // self.dim)), np.tile(self.p[2], most // self.dim), np.empty(most, np.float32)
        for i, j in runs:
            z, t = h[i:j], t[: j - i]
            z[:] = b[: j - i]
            for p, k in zip(pos, self._around(), strict=True):
                np.multiply(x[i + k * self.dim : j + k * self.dim], p[: j - i], out=t)
                z += t
            np.abs(z, out=t)
            t += 1
            z /= t
        return x, h

    @staticmethod
    def _weights(y: np.ndarray) -> np.ndarray:
        """From 1 + y / 256 the softmax's numerators (1 + y / 256)^256, in place; their sums by row."""
        if y.min() < 0:
            np.maximum(y, 0, out=y)
        for _ in range(8):
            np.multiply(y, y, out=y)
        return y @ np.ones(y.shape[1], np.float32)

    def _sorted(self, rows: np.ndarray, hidden: np.ndarray, most: int):
        """(places in hidden, hidden rows over 256 with 1 / 256 and 1 after them, classes, places in their class, the classes that occur, blocks) of the units in rows, by class.

        A block is a list of (number of the class among those that occur, from, to), of `most` rows in all."""
        inner = rows[:, self.window : rows.shape[1] - self.window]
        target = inner.ravel()
        real = np.flatnonzero(target < self.vocab)
        c, w = np.divmod(target[real], self.classes)
        order = np.argsort(c.astype(np.uint16), kind="stable")
        c, w, at = c[order], w[order], real[order]
        at += at // max(1, inner.shape[1]) * (2 * self.window)
        h = np.ones((len(at), self.dim + 2), np.float32)
        np.multiply(np.take(hidden.reshape(-1, self.dim), at, axis=0), np.float32(1 / 256), out=h[:, : self.dim])
        h[:, self.dim] = 1 / 256
        cut = np.searchsorted(c, np.arange(self.classes + 1))
        used = np.flatnonzero(np.diff(cut))
        blocks, left = [], 0
        for k, i, j in zip(range(len(used)), cut[used].tolist(), cut[used + 1].tolist(), strict=True):
            while i < j:
                if not left:
                    blocks.append([])
                    left = most
                n = min(left, j - i)
                blocks[-1].append((k, i, i + n))
                i, left = i + n, left - n
        return at, h, c, w, used, blocks

    def _outputs(self, h: np.ndarray, c: np.ndarray, w: np.ndarray, used: list[int], block, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numerators of the classes, then those in the class; their sums; where those of the units are) for the hidden rows of a block, which stay in the processor's cache."""
        start, n = block[0][1], block[-1][2] - block[0][1]
        np.matmul(h[start : start + n], self.one, out=both[:n])
        for k, i, j in block:
            np.matmul(h[i:j], self.each[used[k]], out=both[n + i - start : n + j - start])
        own = np.concatenate([c[start : start + n], w[start : start + n]])
        own += np.arange(0, 2 * n * self.classes, self.classes)
        return both[: 2 * n], self._weights(both[: 2 * n]), own

    def log_p(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of all positions of rows but the outer ones; 0 where the boundary word stands."""
        most = max(1, CACHED // self.classes)
        at, h, c, w, used, blocks = self._sorted(rows, self.hidden(rows)[1], most)
        used = used.tolist()
        out = np.zeros(rows.shape)
        both = np.empty((2 * most, self.classes), np.float32)
        lp = np.empty(len(at))
        log = lambda x: np.log(np.maximum(x, 1e-37).astype(np.float64))
        for block in blocks:
            i, j = block[0][1], block[-1][2]
            f, total, own = self._outputs(h, c, w, used, block, both)
            p = log(f.ravel()[own]) - log(total)
            lp[i:j] = p[: j - i] + p[j - i :]
        out.ravel()[at] = lp
        return out[:, : rows.shape[1] - 2 * self.window]

    def train(self, rows: np.ndarray, step: float | None = None) -> int:
        """One Adagrad step on all positions of rows but the outer ones; the number of them that hold a unit."""
        x, hidden = self.hidden(rows)
        most = max(1, CACHED // 2 // self.classes)  # outputs are gone over more often than for scores
        at, h, c, w, used, blocks = self._sorted(rows, hidden, most)
        if not len(at):
            return 0
        dim, numbers = self.dim, used.tolist()
        both, back, scaled = (np.empty((2 * most, k), np.float32) for k in (self.classes, dim, dim + 1))
        outer, inner = np.zeros((dim + 1, self.classes), np.float32), self.inner[: len(used)]
        dh, plain = np.empty((len(at), dim), np.float32), 256 * h[:, : dim + 1]
        scale = np.float32(1 / math.sqrt(len(at)))
        last = -1  # the class whose gradient has been begun
        for block in blocks:
            i, j = block[0][1], block[-1][2]
            n = j - i
            f, total, own = self._outputs(h, c, w, numbers, block, both)
            f.ravel()[own] -= total  # gradients times total, which is taken out of the narrow factors and products
            by = (scale / total)[:, None]
            for to, each in ((scaled[:n], by[:n]), (scaled[n : 2 * n], by[n:])):
                np.multiply(plain[i:j], each, out=to)
            outer += scaled[:n].T @ f[:n]
            np.matmul(f[:n], self.one[:dim].T, out=back[:n])
            for k, a, b in block:
                a, b = a - i + n, b - i + n
                if k == last:
                    inner[k] += scaled[a:b].T @ f[a:b]
                else:
                    np.matmul(scaled[a:b].T, f[a:b], out=inner[k])
                last = k
                np.matmul(f[a:b], self.each[numbers[k], :dim].T, out=back[a:b])
            back[: 2 * n] *= by
            np.add(back[:n], back[n : 2 * n], out=dh[i:j])
        dz = np.zeros(len(hidden), np.float32)
        dz.reshape(-1, dim)[at] = dh
        g = np.zeros_like(x)
        longest, runs = self._runs(len(dz))
        pos, dpos, db, t = np.tile(self.p[1], (1, longest // dim)), np.zeros((2 * self.window, longest), np.float32), np.zeros(longest, np.float32), np.empty(longest, np.float32)
        for i, j in runs:
            d, t = dz[i:j], t[: j - i]
            np.abs(hidden[i:j], out=t)
            np.subtract(1, t, out=t)  # the slope of z / (1 + |z|) is (1 - |its value|)^2
            t *= t
            d *= t
            db[: j - i] += d
            for p, to, k in zip(pos, dpos, self._around(), strict=True):
                own = np.s_[i + k * dim : j + k * dim]
                np.multiply(d, p[: j - i], out=t)
                g[own] += t
                np.multiply(d, x[own], out=t)
                to[: j - i] += t
        ids = rows.ravel()
        by = np.argsort(ids.astype(np.uint16) if self.vocab < 1 << 16 else ids, kind="stable")
        ids = ids[by]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        step = STEP if step is None else step
        self._descend(0, ids[first], np.add.reduceat(np.take(g.reshape(-1, dim), by, axis=0), first, axis=0), step)
        self._descend(1, slice(None), dpos.reshape(2 * self.window, -1, dim).sum(axis=1), step)
        self._descend(2, slice(None), db.reshape(-1, dim).sum(axis=0), step)
        self._descend(3, slice(None), outer[:-1], step)
        self._descend(4, slice(None), outer[-1], step)
        self._descend_classes(used, inner, step)
        return len(at)

    def _descend(self, k: int, where, grad: np.ndarray, step: float) -> None:
        """The step of parameters p[k][where], of all but the units in their classes; those without a gradient stay as they are."""
        axis = {0: 1, 3: 0}.get(k)  # embeddings and output vectors share a running square
        square = grad * grad if axis is None else np.einsum({0: "vd,vd->v", 3: "dc,dc->c"}[k], grad, grad)[{0: np.s_[:, None], 3: np.s_[None]}[k]] / self.dim
        held = self.squares[k][where] + square
        self.squares[k][where] = held
        self.p[k][where] -= grad * (np.float32(step) / (np.sqrt(held) + np.float32(1e-5)))

    def _descend_classes(self, used: np.ndarray, grad: np.ndarray, step: float) -> None:
        """The same for output vectors and biases of the units in the classes `used`, in ranges of classes without a gap."""
        dim, at = self.dim, 0
        for run in np.split(used, np.flatnonzero(np.diff(used) > 1) + 1):
            for i, j in _cached(len(run), grad[0].size):
                g, to = grad[at + i : at + j], np.s_[run[0] + i : run[0] + j]
                vectors, biases = g[:, :dim], g[:, dim]
                for held, square, part in ((self.squares[5][to, 0], np.einsum("kdc,kdc->kc", vectors, vectors) / dim, vectors), (self.squares[6][to], biases * biases, biases)):
                    held += square
                    rate = np.float32(step) / (np.sqrt(held) + np.float32(1e-5))
                    part *= rate[:, None] if part is vectors else rate
                self.each[to, : dim + 1] -= g
            at += len(run)


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first).astype(np.int64) if len(first) else c


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (part false) and of their parts (part true)."""
    for batch in batches:
        data, offs = text_buffer(batch.column(0))
        found = []
        for i, j in pieces(offs, 1 << 22):
            own = data[offs[i] : offs[j]]
            h, start, end, _ = words(own, offs[i : j + 1] - offs[i])
            order = np.argsort(h)  # any place of a word will do
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            h, at, c = h[first], order[first], np.diff(first, append=len(h))
            word, ps, pe, first = _parts(start[at], end[at])
            found.append((h, c, *(_summed(_part_hashes(folded(own), ps, pe, first), c[word]) if len(word) else (h, c))))
        for part in (0, 1) if found else ():
            h, c = _summed(np.concatenate([f[2 * part] for f in found]), np.concatenate([f[2 * part + 1] for f in found]))
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([bool(part)] * len(h)), pa.array(h.view(np.int64)), pa.array(c)], ["part", "h", "c"])


def _sequences(table, ids, vocab: int):
    """Rows (doc_id, key, once, n_words, n_units, units): the units of every text; once is true for the first of equal keys in a partition."""

    kind = np.uint16 if vocab < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            for i, j in pieces(offs):
                units, uo, n = _units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], table, ids)
                keys = batch.column(1).slice(i, j - i)
                once = []
                for k in keys.to_pylist():
                    once.append(k not in seen)
                    seen.add(k)
                flat, size = units.astype(kind).tobytes(), np.dtype(kind).itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((uo * size).astype(np.int64).tobytes()), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), keys, pa.array(once), pa.array(n), pa.array(np.diff(uo)), packed.cast(pa.binary())], ["doc_id", "key", "once", "n_words", "n_units", "units"])

    return run


def _bounded(packed: list[bytes], vocab: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, where each document begins): documents one after another, with `window` boundary words before, between and after them."""
    kind = np.uint16 if vocab < 1 << 16 else np.int32
    each = [np.frombuffer(b, kind) for b in packed]
    begin = np.cumsum([window] + [len(x) + window for x in each])
    out = np.full(begin[-1], vocab, np.int64)
    for x, at in zip(each, begin, strict=False):
        out[at : at + len(x)] = x
    return out, begin


def _segments(units: np.ndarray, vocab: int, window: int) -> np.ndarray:
    """Rows of SEGMENT positions with `window` more on either side, which together hold each position once."""
    n = len(units) - 2 * window
    rows = -(-n // SEGMENT)
    padded = np.concatenate([units, np.full(rows * SEGMENT - n, vocab, np.int64)])
    return padded[np.arange(rows)[:, None] * SEGMENT + np.arange(SEGMENT + 2 * window)]


class Training:
    """The steps of one part over its documents, in the order in which they come."""

    def __init__(self, net: Network):
        self.net, self.seen, self.waiting, self.size = net, 0, [], 0

    def add(self, packed: bytes) -> None:
        self.waiting.append(packed)
        self.size += len(packed)
        if self.size >= 2 * SHUFFLED:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        net = self.net
        units, _ = _bounded(self.waiting, net.vocab, net.window)
        rows = _segments(units, net.vocab, net.window)
        rows = rows[np.random.default_rng([net.seed, self.seen]).permutation(len(rows))]
        at = 0
        while at < len(rows):
            n = min(max(self.seen // 16, BATCH), LARGE) // SEGMENT
            self.seen += net.train(rows[at : at + n])
            at += n
        self.waiting, self.size = [], 0


_BLOCK = 4096  # parameters that are averaged together


def _local_training(start, classes: int, dim: int, window: int, seed: int):
    """Rows (part, key, units), sorted by part and key: each part trains from `start` and yields its parameters and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, training = None, None, None

        def done() -> pa.RecordBatch:
            training.flush()
            flat = training.net.flat()
            values = [flat[k : k + _BLOCK].tobytes() for k in range(0, len(flat), _BLOCK)]
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([float(training.seen)] * n), pa.array(values, pa.binary())], ["part", "block", "n", "v"])

        for batch in batches:
            for p, k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if training is not None:
                        yield done()
                    part, key, training = p, None, Training(Network(dim, window, seed, start.value, classes))
                if k != key:  # equal keys are one document
                    training.add(packed)
                key = k
        if training is not None:
            yield done()

    return run


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted average of each group's blocks; rows (group, block, part, n, v) sorted by group and block."""

    def row(g, block, n, total):
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([block], pa.int32()), pa.array([n]), pa.array([(total / max(n, 1e-9)).astype(np.float32).tobytes()], pa.binary())], ["part", "block", "n", "v"])

    at, n, total = None, 0.0, None
    for batch in batches:
        for g, block, _, m, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, block) != at:
                if at is not None:
                    yield row(*at, n, total)
                at, n, total = (g, block), 0.0, 0.0
            n, total = n + m, total + m * np.frombuffer(v, np.float32).astype(np.float64)
    if at is not None:
        yield row(*at, n, total)


_STATE = "part bigint, block int, n double, v binary"
#: So many parts' parameters are averaged in one task before the averages are.
FAN_IN = 256


def _mean(local: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """The average parameters by block, summed in a tree of FAN_IN; only the last average reaches the driver."""
    while True:
        grouped = local.select(F.floor(F.col("part") / FAN_IN).alias("g"), "block", "part", "n", "v")
        local = grouped.repartition("g", "block").sortWithinPartitions("g", "block", "part").mapInArrow(tidy(_averages), _STATE)
        parts = -(-parts // FAN_IN)
        if parts == 1:
            found = local.select("block", "v").toArrow()
            return {b: np.frombuffer(v, np.float32) for b, v in zip(*(c.to_pylist() for c in found.columns), strict=True)}


class Model:
    def __init__(self, table: np.ndarray, ids: np.ndarray, net: Network):
        self.table, self.ids, self.net = table, ids, net

    def totals(self, packed: list[bytes]) -> np.ndarray:
        """The summed log-probabilities of documents given by their packed units."""
        w = self.net.window
        units, begin = _bounded(packed, self.net.vocab, w)
        lp = np.zeros(len(units))
        for a in range(w, len(units) - w, 1 << 15):
            b = min(a + (1 << 15), len(units) - w)
            lp[a:b] = self.net.log_p(_segments(units[a - w : b + w], self.net.vocab, w)).ravel()[: b - a]
        c = np.concatenate([[0.0], np.cumsum(lp)])
        return c[begin[1:]] - c[begin[:-1]]

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(words, summed log-probabilities) of each text."""
        batch = pa.RecordBatch.from_arrays([pa.array([None] * len(column), pa.int64()), pa.array([0] * len(column), pa.int64()), column], ["doc_id", "key", "t"])
        found = pa.Table.from_batches(_sequences(self.table, self.ids, self.net.vocab)(iter([batch])))
        return found.column("n_words").to_numpy(), self.totals(found.column("units").to_pylist())


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, their units, classes) from the counts of the words and parts of all documents."""
    text = docs.select(F.col(text_col).alias("t"))
    counts = staged(text.mapInArrow(tidy(_unit_counts), "part boolean, h bigint, c bigint").groupBy("part", "h").agg(F.sum("c").alias("c")), "unit-counts")
    found = counts.where("not part").agg(F.sum("c")).first()[0] or 0
    frequent = counts.where(F.col("c") >= max(2, SHARE * found ** (2 / 3))).select("h", "c").toArrow().to_pylist()
    first = counts.where("not part").orderBy(F.desc("c"), "h").limit(FIRST).select("h", "c").toArrow().to_pylist()
    discard(counts)
    top = sorted({(-r["c"], r["h"]) for r in [*frequent, *first]})
    hashes = np.array([h for _, h in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.int64) + BYTES, max(CLASSES, math.ceil(math.sqrt(BYTES + len(order))))


def _fitted(docs: DataFrame, id_col: str | None, text_col: str, window: int, dim: int, rounds: int, seed: int) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    table, ids, classes = vocabulary(docs, text_col)
    who = F.lit(0) if id_col is None else F.col(id_col)
    rows = docs.select(who.alias("doc_id"), F.xxhash64(who, row_hash(text_col)).alias("key"), F.col(text_col).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    sequences = staged(rows.mapInArrow(tidy(_sequences(table, ids, classes * classes)), f"doc_id {kind}, key bigint, once boolean, n_words bigint, n_units bigint, units binary"), "sequences")
    known = sequences.where("once and n_units > 0")
    total = known.agg(F.sum("n_units")).first()[0] or 0
    parts = max(1, math.ceil((total / PART_UNITS) ** (2 / 3)))
    flat = Network(dim, window, seed, classes=classes).flat()
    for turn in range(rounds):
        share = known.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn)
        own = share.select(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(parts)).alias("part"), "key", "units")
        start = spark.sparkContext.broadcast(flat)
        local = own.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "key").mapInArrow(tidy(_local_training(start, classes, dim, window, seed)), _STATE)
        mean = _mean(local, parts)
        start.unpersist()
        if mean:
            flat = np.concatenate([mean[k] for k in range(len(mean))])
    return Model(table, ids, Network(dim, window, seed, flat, classes)), sequences


def fit(docs: DataFrame, text_col: str = "text", window: int = WINDOW, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, id_col: str | None = None) -> Model:
    """Count the words and parts of all documents and train the network on all positions of them."""
    need(docs, text_col)
    model, sequences = _fitted(docs, id_col, text_col, window, dim, rounds, seed)
    discard(sequences)
    return model


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row; the cases are defined above."""
    need(docs, id_col, text_col)
    model, sequences = _fitted(docs, id_col, text_col, window, dim, rounds, seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = batch.column(1).to_numpy(), shared.value.totals(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    kind = dict(sequences.dtypes)["doc_id"]
    return sequences.select("doc_id", "n_words", "units").mapInArrow(tidy(run), f"doc_id {kind}, n_words bigint, log_likelihood double, mean_log_likelihood double")

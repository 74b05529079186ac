"""Suffix-array dedup: a distributed merge sort of sampled suffixes that keeps common prefixes.

Every 100-byte string has one anchor, the position in it whose 24-byte string has the least hash, so equal strings have
their anchors at the same place. Only suffixes at anchors are sorted (about one byte in 39), each with the bytes before it
that its strings need, and only at anchors whose 24 bytes occur twice. A batch of documents sorts its suffixes into runs,
front-codes them (length of the prefix shared with the suffix before, then the rest) and sends one run to each part. Parts
are ranges of the suffixes between splitters, which come from a bounded sample of the anchors that occur twice and never
part suffixes of one anchor. A part combines its runs with a loser tree whose nodes hold the known common prefixes, so no
known prefix is compared again. The common prefixes of the sorted suffixes, and those of the reversed bytes before them,
tell the classes of equal strings, and with them which strings start earlier elsewhere. A suffix that a batch holds many
times is sent once, with its first place.

An anchor of very many places would make its range one task's work. Its strings are dealt by windows of o, the distance of
a string's start from the anchor: strings with o from a to b share all but b - a of their bytes if they are equal, and those
bytes choose the part. So each window of a suffix is sent, cut to what its strings need, and no match is lost.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

LENGTH, GRAM = 100, 24
PIECE = 1 << 20
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 30) - 1)
#: Anchors of more places than the first number are dealt in so many windows.
HOT = ((1 << 14, 4), (1 << 18, 16))
#: One distinct anchor in RARE + 1 may become a splitter; each bucket offers at most PROPOSED of those that occur twice.
RARE, PROPOSED = 7, 64
_TWICE = np.uint32(1 << 31)
_PLACES, _TEXTS, _HITS, _SAMPLE = 1, 0, 2, 9


def _zip(*arrays: np.ndarray, level: int = 3) -> bytes:
    head = np.array([len(x.tobytes()) for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(x.tobytes() for x in arrays)]))


def _unzip(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = np.cumsum(np.r_[8 + 8 * n, sizes])
    return [np.frombuffer(raw, k, int(s) // np.dtype(k).itemsize, int(a)) for k, s, a in zip(kinds, sizes, at)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Of every `gram` bytes, by joining hashes of shorter strings."""
    h, done, out, got = _TABLE[data], 1, None, 0
    n = len(data) - gram + 1
    factor = 0x9E3779B97F4A7C15
    while True:
        if gram & done:  # the next `done` bytes are hashed in h
            own = h[got : got + n]
            out = own.copy() if out is None else out * np.uint64(0xD6E8FEB86659FD93) + own
            got += done
        if done * 2 > gram:
            break
        factor = (factor * 0x2545F4914F6CDD1D + 2 * done) % 2**64
        h = h[:-done] * np.uint64(factor | 1) + h[done:]
        done *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, hash) of the runs of string starts that have one anchor; strings lie within a document."""
    out = [[], [], [], []]
    width = length - gram + 1
    inner = offsets[1:-1]
    for lo in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[lo : lo + PIECE + length - 1]
        h = gram_hashes(part, gram)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while 2 * w <= width:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < width:
            low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
        at = (low & _LOW).astype(np.int64)
        bad = np.zeros(len(at) + 1, np.int32)
        cut = inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, lo + len(part))] - lo
        np.add.at(bad, np.clip(cut - length + 1, 0, len(at)), 1)
        np.add.at(bad, np.clip(cut, 0, len(at)), -1)
        fine = np.cumsum(bad[:-1]) == 0
        new = np.r_[True, (at[1:] != at[:-1]) | ~fine[:-1]] & fine
        first = np.flatnonzero(new)
        if not len(first):
            continue
        ends = np.r_[True, (at[1:] != at[:-1]) | ~fine[1:]]
        last = np.flatnonzero(np.r_[ends[1:], True] & fine)
        p = at[first]
        for k, x in enumerate((first + lo, last + lo, p + lo, h[p])):
            out[k].append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if k == 3 else np.int64) for k, x in enumerate(out))


def _gather(batches):
    """A batch as one row: its texts, compressed, with ids, hashes and offsets."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in C.pieces(batches, rows=4000, mb=16):
        data, offsets = C.joined_texts(batch.column("text"))
        row = _zip(data, offsets, np.asarray(batch.column("k0")), np.asarray(batch.column("k1")), level=6)
        yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq], pa.int64()), pa.array([row], pa.binary())], names=["batch", "texts"])
        seq += 1


def _texts(blob: bytes):
    return _unzip(blob, np.uint8, np.int64, np.int64, np.int64)


def _ask(buckets: int):
    """Which anchors' hashes occur elsewhere? One request for each distinct hash; its only place, or that it has many."""

    def run(batch: pa.RecordBatch):
        for number, blob in zip(batch.column("batch").to_pylist(), batch.column("texts").to_pylist()):
            data, offsets, _, _ = _texts(blob)
            _, _, p, h = anchors(data, offsets)
            fresh = np.r_[True, p[1:] != p[:-1]] if len(p) else np.zeros(0, bool)  # a run may be cut where a piece ends
            p, h = p[fresh], h[fresh]
            bucket = h % np.uint64(buckets)
            order = np.lexsort((h, bucket))
            h, p, bucket = h[order], p[order], bucket[order]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.r_[start, len(h)])
            place = p[start].astype(np.uint32) | np.where(count > 1, _TWICE, np.uint32(0))
            h, bucket = (h[start] >> np.uint64(32)).astype(np.uint32), bucket[start]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                rare = np.flatnonzero((h[a:b] & RARE) == 0)
                grams = _grams(data, p[start[a:b][rare]])
                more = count[a:b]
                rows.append((int(bucket[a]), number, h[a:b].tobytes(), place[a:b].tobytes(), more[more > 1].astype(np.uint32).tobytes(), grams.tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, kinds)], names=["bucket", "batch", "hashes", "places", "counts", "grams"])

    return run


def _grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchor strings at these places, as fixed-width strings."""
    if not len(at):
        return np.zeros(0, f"S{GRAM}")
    return data[at[:, None] + np.arange(GRAM)].view(f"S{GRAM}").ravel()


def _repeated(hot: tuple[tuple[int, int], ...]):
    """The places of hashes that another batch holds as well; of those with very many places (with kind -windows); and a
    sample of the anchor strings that occur twice, with the number of batches that hold them (of no batch)."""

    def run(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint32) for x in t["hashes"].to_pylist()]
        places = [np.frombuffer(x, np.uint32) for x in t["places"].to_pylist()]
        counts = []
        for p, more in zip(places, t["counts"].to_pylist()):
            count = np.ones(len(p), np.int64)
            count[p >= _TWICE] = np.frombuffer(more, np.uint32)
            counts.append(count)
        every = np.concatenate(hashes)
        known, group = np.unique(every, return_inverse=True)
        total = np.bincount(group, np.concatenate(counts), len(known)).astype(np.int64)
        rows, lo = [], 0
        for number, h, p in zip(t["batch"].to_pylist(), hashes, places):
            n = total[group[lo : lo + len(h)]]
            lo += len(h)
            rows.append((number, _PLACES, p[(n > 1) & (p < _TWICE)].tobytes()))
            levels = [least for least, _ in hot[1:]] + [np.iinfo(np.int64).max]
            rows += [(number, -windows, (p[(n > least) & (n <= most)] & ~_TWICE).tobytes()) for (least, windows), most in zip(hot, levels)]
        rare = [x[(x & RARE) == 0] for x in hashes]
        grams = np.concatenate([np.frombuffer(x, f"S{GRAM}") for x in t["grams"].to_pylist()])
        own, first = np.unique(np.concatenate(rare), return_index=True)
        at = np.searchsorted(known, own)
        n, holders = total[at], np.bincount(group, minlength=len(known))[at]  # a batch sends equal suffixes once
        pick = np.flatnonzero((n > 1) & (n <= hot[0][0]))
        pick = pick[np.argsort(own[pick] >> np.uint32(3), kind="stable")[:PROPOSED]]
        rows.append((C.NULL_ID, _SAMPLE, grams[first[pick]].tobytes() + holders[pick].astype(np.int64).tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["batch", "kind", "data"])

    return run


def splitters(samples: list[bytes], parts: int) -> np.ndarray:
    """At most parts - 1 anchor strings that divide the sampled places evenly."""
    sizes = [len(x) // (GRAM + 8) for x in samples]
    grams = np.concatenate([np.zeros(0, f"S{GRAM}"), *(np.frombuffer(x, f"S{GRAM}", n) for x, n in zip(samples, sizes))])
    weight = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64, n, n * GRAM) for x, n in zip(samples, sizes))])
    order = np.argsort(grams, kind="stable")
    upto = np.cumsum(weight[order])
    if not len(order):
        return grams
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) // parts, "right")
    return np.unique(grams[order][np.minimum(at, len(order) - 1)])


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    n = min(len(a), len(b))
    while known + 16 <= n and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


class Suffixes:
    """The distinct suffixes of a batch in sorted order by part, and the places of each. Both the runs that are sent and
    the places their answers come back to are made from the stored texts by this, so only the texts need a checkpoint."""

    def __init__(self, texts: tuple[np.ndarray, ...], answers: list[tuple[int, bytes]], bounds: np.ndarray, parts: int):
        data, offsets, k0, k1 = texts
        first, last, p, h = anchors(data, offsets)
        wanted = np.zeros(len(data) + 1, bool)
        for kind, x in answers:
            if kind == _PLACES:
                wanted[np.frombuffer(x, np.uint32)] = True
        # what the batch itself holds twice was never in doubt
        order = np.argsort(h, kind="stable")
        hs, ps = h[order], p[order]
        same = (hs[1:] == hs[:-1]) & (ps[1:] != ps[:-1])
        near = np.zeros(len(h), bool)
        near[1:] |= same
        near[:-1] |= same
        group = np.cumsum(np.r_[True, hs[1:] != hs[:-1]]) if len(h) else np.zeros(0, np.int64)
        wanted[ps[np.isin(group, np.unique(group[near]))]] = True
        pick = np.flatnonzero(wanted[p])
        text = data.tobytes()
        doc = np.searchsorted(offsets, p[pick], "right") - 1
        windows = np.ones(len(pick), np.int64)
        at = np.zeros(len(data) + 1, bool)
        for kind, x in answers:
            if kind < 0 and x:
                at[:] = False
                at[np.frombuffer(x, np.uint32)] = True
                windows[np.isin(h[pick], h[at[p]])] = -kind
        found: dict[tuple[int, bytes, int], list[int]] = {}
        where = np.searchsorted(bounds, _grams(data, p[pick]), "right").tolist()
        for i, (a, z, q, part, w) in enumerate(zip(first[pick].tolist(), last[pick].tolist(), p[pick].tolist(), where, windows.tolist())):
            if w == 1:
                found.setdefault((part, text[q : z + LENGTH] + text[a:q][::-1], z + LENGTH - q), []).append(i)
                continue
            for lo, hi in zip(*_windows(w)):  # strings whose starts are lo to hi before the anchor
                begin, end = max(lo, q - z), min(hi, q - a)
                if begin <= end:
                    part = crc32(text[q - lo : q + LENGTH - hi], lo) % parts
                    found.setdefault((part, text[q : q + LENGTH - begin] + text[q - end : q][::-1], LENGTH - begin), []).append(i)
        self.keys = sorted(found)
        # the first place of each distinct suffix: by id, then text hash, then offset
        self.ids, self.hashes, self.inside, self.place = k0[doc], k1[doc], p[pick] - offsets[doc], p[pick]
        rank = _ranks(self.ids, self.hashes, self.inside)
        counts, members, lead, firsts = [], [], [], []
        for key in self.keys:
            own = found[key]
            low = min(own, key=rank.__getitem__)
            counts.append(len(own))
            members += own
            lead += [rank[i] == rank[low] for i in own]
            firsts.append(low)
        self.counts, self.firsts, self.lead = np.array(counts, np.int64), np.array(firsts, np.int64), np.array(lead, bool)
        self.place = self.place[np.array(members, np.int64)]
        self.sizes = np.array([(len(s), r) for _, s, r in self.keys], np.uint8).reshape(-1, 2)

    def runs(self):
        """(part, front-coded run)"""
        lo, keys = 0, self.keys
        while lo < len(keys):
            hi, part = lo, keys[lo][0]
            shared, tails, prev = [], [], b""
            while hi < len(keys) and keys[hi][0] == part:
                s = keys[hi][1]
                n = common_prefix(prev, s, 0)
                shared.append(n)
                tails.append(s[n:])
                prev = s
                hi += 1
            f = self.firsts[lo:hi]
            yield part, _zip(np.array(shared, np.uint8), self.sizes[lo:hi], np.frombuffer(b"".join(tails), np.uint8), self.ids[f], self.hashes[f], self.inside[f])
            lo = hi


def _windows(n: int) -> tuple[list[int], list[int]]:
    """First and last o of n windows that cover all places of an anchor within its string."""
    cut = [(LENGTH - GRAM + 1) * k // n for k in range(n + 1)]
    return cut[:-1], [x - 1 for x in cut[1:]]


def _ranks(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The order of triples; equal ones have one rank."""
    order = np.lexsort((c, b, a))
    out = np.empty(len(order), np.int64)
    if len(order):
        a, b, c = a[order], b[order], c[order]
        out[order] = np.cumsum(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    return out


def _runs(bounds: np.ndarray, parts: int):
    def run(t: pa.Table) -> pa.Table:
        number = t["batch"][0].as_py()
        rows = list(zip(t["kind"].to_pylist(), t["data"].to_pylist()))
        found = Suffixes(_texts(next(x for k, x in rows if k == _TEXTS)), [r for r in rows if r[0] != _TEXTS], bounds, parts)
        out = [(part, number, blob) for part, blob in found.runs()]
        return pa.table([pa.array(c, x) for c, x in zip(zip(*out) if out else ((),) * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["part", "batch", "data"])

    return run


class LoserTree:
    """Merges sorted runs of (string, tie) whose common prefixes with the string before are known. A node holds the loser
    of its match and how much of it is shared with the last winner: of two strings the one that shares more is the smaller,
    and only at a draw are bytes compared, from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int], list[int]]]):
        """(strings, common prefixes, ties) of each run."""
        self.runs, self.at = runs, [0] * len(runs)
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.node = [(-1, 0)] * self.k

    def _beats(self, a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """(winner, its share, loser, its share); -1 is an ended run."""
        if a < 0 or b < 0:
            return (b, hb, a, ha) if a < 0 else (a, ha, b, hb)
        if ha != hb:
            return (a, ha, b, hb) if ha > hb else (b, hb, a, ha)
        i, j = self.at[a], self.at[b]
        x, y = self.runs[a][0][i], self.runs[b][0][j]
        n = common_prefix(x, y, ha)
        if n == len(x) == len(y):
            first = (self.runs[a][2][i], a) < (self.runs[b][2][j], b)
        else:
            first = n == len(x) or n < len(y) and x[n] < y[n]
        return (a, ha, b, n) if first else (b, hb, a, n)

    def _play(self, node: int) -> tuple[int, int]:
        if node >= self.k:
            r = node - self.k
            return (r, 0) if r < len(self.runs) and self.runs[r][0] else (-1, 0)
        a, ha = self._play(2 * node)
        b, hb = self._play(2 * node + 1)
        w, hw, lost, hl = self._beats(a, ha, b, hb)
        self.node[node] = (lost, hl)
        return w, hw

    def merged(self):
        """(run, index in it, common prefix with the string before)."""
        w, h = self._play(1) if self.k > 1 else ((0, 0) if self.runs and self.runs[0][0] else (-1, 0))
        while w >= 0:
            yield w, self.at[w], h
            r = w
            self.at[r] += 1
            i = self.at[r]
            w, h = (r, self.runs[r][1][i]) if i < len(self.runs[r][0]) else (-1, 0)
            node = (self.k + r) // 2
            while node:
                lost, hl = self.node[node]
                w, h, lost, hl = self._beats(w, h, lost, hl)
                self.node[node] = (lost, hl)
                node //= 2


def repeats(shared: np.ndarray, sizes: np.ndarray, lefts: list[bytes], rank: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Of merged suffixes, a bit for each o < length: whether the string that starts o bytes before the anchor starts earlier
    elsewhere; n rows of packed bits, little end first.

    sizes: (bytes of the whole, bytes from the anchor on); rank: order of their places. A suffix has the strings
    length - right <= o <= left. Two strings at the same o are equal if the suffixes share length - o bytes and the
    reversed bytes before them share o.
    """
    n = len(shared)
    right, left = sizes[:, 1].astype(np.int64), sizes[:, 0].astype(np.int64) - sizes[:, 1]
    out = np.zeros((n, (length + 7) // 8), np.uint8)
    if not n:
        return out
    # equal suffixes become one, with the least rank
    equal = np.r_[False, (shared[1:] == sizes[1:, 0]) & (sizes[1:] == sizes[:-1]).all(axis=1)]
    start = np.flatnonzero(~equal)
    one = np.cumsum(~equal) - 1
    least = np.minimum.reduceat(rank, start)
    later = rank > least[one]
    # distinct suffixes with a neighbour of the same anchor string need their classes
    sh = shared[start].astype(np.int64)
    alike = np.r_[False, sh[1:] >= gram]
    mixed = alike | np.r_[alike[1:], False]
    m = np.flatnonzero(mixed)
    found = np.zeros((len(m) + 1, length), bool)  # the last row stands for all others
    row = np.full(len(start), len(m))
    row[m] = np.arange(len(m))
    if len(m):
        # between two kept suffixes the shared prefix is the least on the way; the dropped ones share under `gram` anyway
        lcp = np.where(alike[m], sh[m], 0)
        rt, lt, low = right[start[m]], left[start[m]], least[m]
        texts = [lefts[i] for i in start[m].tolist()]
        order = sorted(range(len(m)), key=texts.__getitem__)
        before = np.array([0, *(common_prefix(texts[a], texts[b], 0) for a, b in zip(order, order[1:]))])
        order = np.array(order)
        lclass = np.empty(len(m), np.int64)
        for o in range(0, length - gram + 1):
            sel = np.flatnonzero((length - rt <= o) & (o <= lt))
            if len(sel) < 2:
                continue
            rclass = np.cumsum(lcp < length - o)
            lclass[order] = np.cumsum(before < o)
            key = rclass[sel] * (len(m) + 1) + lclass[sel]
            by = np.lexsort((low[sel], key))
            ks = key[by]
            lead = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
            best = np.repeat(low[sel][by][lead], np.diff(np.r_[lead, len(ks)]))
            found[sel[by], o] = low[sel][by] > best
    o = np.arange(length)
    for lo in range(0, n, 1 << 16):
        b = slice(lo, lo + (1 << 16))
        hit = found[row[one[b]]] | later[b, None] & (o >= length - right[b, None]) & (o <= left[b, None])
        out[b] = np.packbits(hit, axis=1, bitorder="little")
    return out


def _merge(t: pa.Table) -> pa.Table:
    """Sort a part's suffixes out of its runs, and answer each run with its strings that start earlier elsewhere."""
    runs, places, all_sizes = [], [], []
    for blob in t["data"].to_pylist():
        shared, sizes, tails, k0, k1, inside = _unzip(blob, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int64)
        sizes = sizes.reshape(-1, 2)
        raw, at, prev, strings = tails.tobytes(), 0, b"", []
        for n, size in zip(shared.tolist(), sizes[:, 0].tolist()):
            prev = prev[:n] + raw[at : at + size - n]
            at += size - n
            strings.append(prev)
        runs.append((strings, shared.tolist(), sizes[:, 1].tolist()))
        places.append(np.stack([k0, k1, inside]))
        all_sizes.append(sizes)
    base = np.cumsum([0, *(len(r[0]) for r in runs)])
    index, shared = [], []
    for r, i, h in LoserTree(runs).merged():
        index.append(base[r] + i)
        shared.append(h)
    index = np.array(index, np.int64)
    rank = _ranks(*np.concatenate(places, axis=1))
    sizes = np.concatenate(all_sizes)
    strings = [s for r in runs for s in r[0]]
    lefts = [strings[i][sizes[i, 1] :] for i in index.tolist()]
    bits = np.empty((len(index), (LENGTH + 7) // 8), np.uint8)
    bits[index] = repeats(np.array(shared, np.int64), sizes[index], lefts, rank[index])
    answers = [bits[lo:hi].tobytes() for lo, hi in zip(base[:-1], base[1:])]
    return pa.table({"batch": t["batch"], "part": t["part"], "kind": pa.array([_HITS] * len(answers), pa.int32()), "data": pa.array(answers, pa.binary())})


def _cut(bounds: np.ndarray, parts: int):
    """Of one batch: mark the strings that start earlier elsewhere, and cut out the bytes they cover."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("part").to_pylist()
        texts = _texts(next(r["data"] for r in rows if r["kind"] == _TEXTS))
        marked = np.zeros(len(texts[0]) + 1, bool)
        answers = [np.frombuffer(r["data"], np.uint8) for r in rows if r["kind"] == _HITS]
        if answers:
            found = Suffixes(texts, [(r["kind"], r["data"]) for r in rows if r["kind"] not in (_TEXTS, _HITS)], bounds, parts)
            bits = np.unpackbits(np.concatenate(answers).reshape(-1, (LENGTH + 7) // 8), axis=1, bitorder="little")[:, :LENGTH].astype(bool)
            sizes = found.sizes.astype(np.int64)
            one = np.repeat(np.arange(len(found.counts)), found.counts)
            o = np.arange(LENGTH)
            for lo in range(0, len(one), 1 << 17):
                d, q, f = one[lo : lo + (1 << 17)], found.place[lo : lo + (1 << 17)], found.lead[lo : lo + (1 << 17)]
                r, left = sizes[d, 1], sizes[d, 0] - sizes[d, 1]
                hit = np.where(f[:, None], bits[d], (o >= LENGTH - r[:, None]) & (o <= left[:, None]))
                i, j = np.nonzero(hit)
                marked[q[i] - j] = True
        return _kept(texts, marked)

    return run


def _kept(texts: tuple[np.ndarray, ...], marked: np.ndarray) -> pa.Table:
    """The documents without the bytes covered by strings that start where `marked`."""
    data, offsets, k0, _ = texts
    total = np.cumsum(marked[:-1], dtype=np.int64)
    covered = total > 0
    covered[LENGTH:] = total[LENGTH:] > total[:-LENGTH]
    edge = covered.copy()
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    edge[1:] &= ~covered[:-1] | begins[1:-1]
    ends = covered.copy()
    ends[:-1] &= ~covered[1:] | begins[1:-1]
    a, z = np.flatnonzero(edge), np.flatnonzero(ends) + 1
    owner = np.searchsorted(offsets, a, "right") - 1
    cut = np.searchsorted(owner, np.arange(len(k0) + 1))
    kept, spans, removed = [], [], []
    keep = ~covered
    for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        kept.append(data[lo:hi][keep[lo:hi]].tobytes() if cut[i] < cut[i + 1] else data[lo:hi].tobytes())
        spans.append([{"start": int(x - lo), "stop": int(y - lo)} for x, y in zip(a[cut[i] : cut[i + 1]], z[cut[i] : cut[i + 1]])])
        removed.append(int(hi - lo) - len(kept[-1]))
    return pa.table({
        "doc_id": pa.array(k0, pa.int64(), mask=k0 == C.NULL_ID), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(cut).astype(np.int64)),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
    })


def dedup_repeats(docs: DataFrame, parts: int | None = None, hot: tuple[tuple[int, int], ...] = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans in bytes, kept) for each row of docs (doc_id, text).

    Removed is each byte covered by a 100-byte string that also starts earlier: in a smaller doc_id, or in the same document
    before; strings may overlap, lie within one document, and are judged on the input. kept holds the other bytes (which
    may cut a character). Null is empty; documents under 100 bytes lose nothing; a null doc_id is before all others. Rows
    that repeat id and text are one document and lose the same; rows that repeat an id with other texts count in the order
    of a hash of the text. Other columns are not carried. An empty table gives an empty result. `hot` holds the numbers of
    places from which on an anchor is dealt in windows, and how many; it changes no result.
    """
    spark = docs.sparkSession
    parts = parts or C.shards_for(spark)
    texts = C.stored(docs.select(C.id_key(F.col("doc_id")).alias("k0"), F.xxhash64("text").alias("k1"), "text").mapInArrow(_gather, "batch long, texts binary"))
    asked = C.arrow_map(texts, _ask(parts), "bucket int, batch long, hashes binary, places binary, counts binary, grams binary")
    answers = C.stored(asked.groupBy("bucket").applyInArrow(_repeated(hot), "batch long, kind int, data binary").filter("length(data) > 0"))
    # at most PROPOSED short strings for each part come to the driver
    bounds = splitters([bytes(r["data"]) for r in answers.filter(F.col("kind") == _SAMPLE).select("data").collect()], parts)
    own = texts.select("batch", F.lit(_TEXTS).alias("kind"), F.col("texts").alias("data"))
    held = answers.filter(F.col("kind") != _SAMPLE).unionByName(own)
    runs = held.groupBy("batch").applyInArrow(_runs(bounds, parts), "part int, batch long, data binary")
    hits = runs.groupBy("part").applyInArrow(_merge, "batch long, part int, kind int, data binary")
    back = hits.unionByName(held.withColumn("part", F.lit(-1)))
    return back.groupBy("batch").applyInArrow(_cut(bounds, parts), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_repeats(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A text is cut into overlapping windows of words, all windows are scored, and the highest window decides for the text. A word's
input is its embedding, those of its beginnings, and a character part: the mean of the embeddings of its letter triples, its
ends marked, so that the order of letters counts. Labels are of texts, not windows, so training alternates: the present model
(at first the words' log-odds) picks each toxic text's likeliest window, and they are set against windows of the other texts,
the hardest among them. Every labelled text of the sample takes part.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

WINDOW, STRIDE = 32, 24
WORD, CHAR, HIDDEN, RATE = 8, 4, 8, 0.015
#: Labelled texts that training may take, in the order of a hash of their id, and the words it may know.
SAMPLE, KNOWN = 4000, 20_000
#: Bytes of a word's beginning that have an embedding, too (inflected forms share it).
BEGINNINGS = (4, 6)
#: Embeddings of letter triples, found by a hash; the last stands for bytes that are no letters.
TRIPLES = 4096
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(11)
PAIRS = _RNG.integers(1, 2**32, 65536, dtype=np.uint32)
FIRST = _RNG.integers(1, 2**32, 256, dtype=np.uint32)


class Words:
    """The words (runs of letters) of many texts at once: a 32-bit hash of each word's letter pairs, its letters' place in
    the bytes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        letter = LETTER[low]
        begin = letter.copy()
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        cut = np.zeros(len(data) + 1, bool)
        cut[inner] = True
        begin[1:] &= ~letter[:-1] | cut[1:-1]
        end = letter.copy()
        end[:-1] &= ~letter[1:] | cut[1:-1]
        self.start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.low = low
        self.length = stop - self.start
        if len(self.start):
            after = np.zeros(len(low), np.uint16)
            after[:-1] = low[1:]
            after[stop - 1] = 0
            code = PAIRS[(low.astype(np.uint16) << np.uint16(8)) | after]
            code[~letter] = 0
            self.hash = np.add.reduceat(code, self.start, dtype=np.uint32) + FIRST[low[self.start]]
            self.hash ^= self.hash >> np.uint32(15)
        else:
            self.hash = np.zeros(0, np.uint32)
        self.triple = self._triples(letter, stop)
        self.units = [self.hash, *(self._beginning(k) for k in BEGINNINGS)]

    def _beginning(self, k: int) -> np.ndarray:
        """A hash of each word's first k bytes."""
        h = np.full(len(self.start), k, np.uint32)
        for j in range(k):
            c = self.low[np.minimum(self.start + j, max(0, len(self.low) - 1))].astype(np.uint32)
            h = h * np.uint32(0x01000193) + np.where(j < self.length, c + np.uint32(1), np.uint32(0))
        return h * np.uint32(0x9E3779B1)

    def _triples(self, letter: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of each letter with the letters before and after it in its word (0 at its ends)."""
        low = self.low.astype(np.uint32)
        before, after = np.zeros(len(low), np.uint32), np.zeros(len(low), np.uint32)
        before[1:], after[:-1] = low[:-1], low[1:]
        before[self.start], after[stop - 1] = 0, 0
        h = ((before * np.uint32(0x01000193) + low) * np.uint32(0x01000193) + after) * np.uint32(0x9E3779B1)
        return np.where(letter, h >> np.uint32(20), TRIPLES).astype(np.uint16)

    def chars(self, table: np.ndarray) -> np.ndarray:
        """The mean of each word's letter triples' rows in the table."""
        if not len(self.start):
            return np.zeros((0, table.shape[1]), np.float32)
        sums = np.stack([np.add.reduceat(np.append(table[:TRIPLES, k], table.dtype.type(0))[self.triple], self.start) for k in range(table.shape[1])], axis=1)
        return (sums / np.maximum(self.length, 1)[:, None]).astype(np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, owner text) of every window; a text of few words has one, one without words none."""
        n = np.diff(self.first)
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return self.first[:-1][owner] + k * STRIDE, owner


class Model:
    """known: sorted hashes of the words with an embedding of their own; row 0 is any other word."""

    def __init__(self, known: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.known = known
        self.p = {
            "E": (rng.normal(size=(len(known) + 1, WORD)) * 0.05).astype(np.float32), "C": (rng.normal(size=(TRIPLES, CHAR)) * 0.1).astype(np.float32), "u": w(2 * HIDDEN), "v": w(2 * HIDDEN), "c": np.zeros(1, np.float32),
            "W": np.stack([w(WORD + CHAR, 3 * HIDDEN) for _ in range(2)]), "U": np.stack([w(HIDDEN, 3 * HIDDEN) for _ in range(2)]), "B": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def rows(self, words: Words) -> np.ndarray:
        """(words, units): the embeddings that a word sums up."""
        return np.stack([self._row(u) for u in words.units], axis=1)

    def _row(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0).astype(np.int32)

    @staticmethod
    def _sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def forward(self, rows: np.ndarray, chars: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; all arguments (T, n, ...). Both directions run side by side, the second over the steps reversed;
        a step without a word leaves the state as it is."""
        p, H = self.p, HIDDEN
        x = np.concatenate([p["E"][rows].sum(axis=2), chars], axis=2)
        both, on = np.stack([x, x[::-1]]), np.stack([mask, mask[::-1]])[..., None]
        gates = both @ p["W"][:, None] + p["B"][:, None]
        h = np.zeros((2, x.shape[1], H), x.dtype)
        out = np.empty((2, *x.shape[:2], H), x.dtype)
        U, Un, steps = p["U"][:, :, : 2 * H], p["U"][:, :, 2 * H :], []
        for t in range(len(x)):
            zr = self._sigmoid(gates[:, t, :, : 2 * H] + h @ U)
            z, r = zr[..., :H], zr[..., H:]
            n = np.tanh(gates[:, t, :, 2 * H :] + (r * h) @ Un)
            if keep is not None:
                steps.append((h, z, r, n))
            h = h + on[:, t] * (1 - z) * (n - h)
            out[:, t] = h
        states = np.concatenate([out[0], out[1][::-1]], axis=2)
        a = states @ p["u"] + (mask - 1) * 1e9
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        ctx = np.einsum("tn,tnh->nh", a, states)
        if keep is not None:
            keep |= {"both": both, "on": on, "h": states, "a": a, "ctx": ctx, "steps": steps}
        return ctx @ p["v"] + p["c"]

    def gradients(self, rows: np.ndarray, raw: Letters, chars: np.ndarray, mask: np.ndarray, dlogit: np.ndarray, kept: dict | None = None) -> dict[str, np.ndarray]:
        """Back through time; chars = raw @ C. Of E, the gradient of its rows `rows_of_E`, in their order. kept: what
        `forward` has kept of the same arguments."""
        k: dict = {} if kept is None else kept
        if kept is None:
            self.forward(rows, chars, mask, k)
        p, H = self.p, HIDDEN
        g = {"v": k["ctx"].T @ dlogit, "c": np.array([dlogit.sum()])}
        dctx = dlogit[:, None] * p["v"]
        da = np.einsum("nh,tnh->tn", dctx, k["h"])
        ds = k["a"] * (da - (k["a"] * da).sum(axis=0))
        dh_all = k["a"][:, :, None] * dctx + ds[:, :, None] * p["u"]
        g["u"] = np.einsum("tn,tnh->h", ds, k["h"])
        dh_all = np.stack([dh_all[..., :H], dh_all[::-1, :, H:]])
        din = np.empty((*k["both"].shape[:3], 3 * H), dh_all.dtype)
        dh = np.zeros((2, rows.shape[1], H), dh_all.dtype)
        U, Un = p["U"][:, :, : 2 * H].transpose(0, 2, 1), p["U"][:, :, 2 * H :].transpose(0, 2, 1)
        for t in reversed(range(len(rows))):
            h, z, r, n = k["steps"][t]
            dh = dh + dh_all[:, t]
            m = k["on"][:, t]
            dn = dh * m * (1 - z) * (1 - n * n)
            drh = dn @ Un
            din[:, t, :, :H] = dh * m * (h - n) * z * (1 - z)
            din[:, t, :, H : 2 * H] = drh * h * r * (1 - r)
            din[:, t, :, 2 * H :] = dn
            dh = dh * (1 - m * (1 - z)) + drh * r + din[:, t, :, : 2 * H] @ U
        h, r = (np.stack([x[i] for x in k["steps"]], axis=1) for i in (0, 2))
        flat = lambda x: x.reshape(2, -1, x.shape[-1])
        g["W"] = flat(k["both"]).transpose(0, 2, 1) @ flat(din)
        g["U"] = np.concatenate([flat(h).transpose(0, 2, 1) @ flat(din[..., : 2 * H]), flat(r * h).transpose(0, 2, 1) @ flat(din[..., 2 * H :])], axis=2)
        g["B"] = flat(din).sum(axis=1, keepdims=True)
        dx = din @ p["W"][:, None].transpose(0, 1, 3, 2)
        dx = dx[0] + dx[1][::-1]
        g["rows_of_E"], at = np.unique(rows, return_inverse=True)
        at, n, units = at.ravel(), len(g["rows_of_E"]), rows.shape[2]
        g["E"] = np.stack([np.bincount(at, np.repeat(dx[:, :, j].ravel(), units), n) for j in range(WORD)], axis=1)
        g["C"] = raw.back(dx[:, :, WORD:])
        return g

    def window_logits(self, words: Words, first: np.ndarray, owner: np.ndarray, block: int = 2048) -> np.ndarray:
        rows, chars = self.rows(words), words.chars(self.p["C"])
        last = words.first[1:][owner]
        out = np.zeros(len(first), np.float32)
        for lo in range(0, len(first), block):
            at, mask = _slots(first[lo : lo + block], last[lo : lo + block])
            out[lo : lo + block] = self.forward(rows[at], chars[at], mask)
        return out

    def scores(self, words: Words) -> np.ndarray:
        """0 to 1 for each text; a text without words has the score of no evidence at all."""
        return self._sigmoid(np.clip(self.scale * self.tops(words) + self.shift, -50, 50))

    def tops(self, words: Words) -> np.ndarray:
        first, owner = words.windows()
        top = np.full(len(words.first) - 1, -20.0)
        np.maximum.at(top, owner, self.window_logits(words, first, owner))
        return top


def _slots(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = first + np.arange(WINDOW)[:, None]
    mask = (at < last).astype(np.float32)
    return np.minimum(at, last - 1), mask


def words_of(texts: list[bytes]) -> Words:
    return Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Three quarters of the texts fit the network and the rest its threshold. Empty input, or only one class, gives a
    model that scores everything near 0."""
    toxic = np.asarray(toxic, bool)
    part = np.arange(len(texts)) % 4 == 3
    if not (toxic[part].any() and toxic[~part].any()) or toxic[part].all() or toxic[~part].all():
        part[:] = False
    model = _network([t for t, out in zip(texts, part) if not out], toxic[~part])
    if toxic.any() and not toxic.all():
        side = part if part.any() else ~part
        model.scale, model.shift = _calibrate(model.tops(words_of([t for t, mine in zip(texts, side) if mine])), toxic[side])
    return model


def _network(texts: list[bytes], toxic: np.ndarray, known: int = KNOWN, rounds: int = 4, steps: int = 100, batch: int = 256, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    words = words_of(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    units, df, pos = [], [], []
    for hashes in words.units:
        pairs = np.unique((hashes.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64))
        vocab, which, texts_with = np.unique((pairs >> np.uint64(32)).astype(np.uint32), return_inverse=True, return_counts=True)
        weight = toxic[(pairs & np.uint64(2**32 - 1)).astype(np.int64)] if n else np.zeros(0)
        keep = np.flatnonzero(texts_with >= 5)
        keep = keep[np.argsort(-texts_with[keep], kind="stable")[:known]]
        units.append(vocab[keep])
        df.append(texts_with[keep])
        pos.append(np.bincount(which, weights=weight, minlength=len(vocab))[keep])
    units, at_first = np.unique(np.concatenate(units), return_index=True)
    df, pos = np.concatenate(df)[at_first], np.concatenate(pos)[at_first]
    model = Model(units)
    npos, nneg = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = np.log((pos + 0.2) / (npos + 0.4)) - np.log((df - pos + 0.2) / (nneg + 0.4))
    shrunk = (odds * df / (df + 10)).astype(np.float32)  # a few rare words prove little
    model.p["E"][1:, 0] += shrunk / 4
    first, owner = words.windows()
    if not toxic.any() or toxic.all() or not len(first):
        model.p["v"][:] = 0
        model.shift = -6.0
        return model
    rows = model.rows(words)
    last = words.first[1:][owner]
    at, mask = _slots(first, last)
    evidence = np.concatenate([[0], np.maximum(shrunk, 0)])[rows].max(axis=1)
    score = (evidence[at] * mask).sum(axis=0)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step = 0
    is_toxic = toxic[owner]
    bad = np.flatnonzero(~is_toxic)
    seen = bad
    for round_ in range(rounds):
        order = np.lexsort((-score, owner))
        rank = np.empty(len(owner), np.int64)
        begin = np.r_[0, np.flatnonzero(np.diff(owner[order])) + 1]
        rank[order] = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
        good = np.flatnonzero(is_toxic & (rank == 0))
        hard = seen[np.argsort(-score[seen], kind="stable")[: 3 * len(good)]]
        for _ in range(steps):
            step += 1
            pick = np.concatenate([rng.choice(good, batch // 2), rng.choice(hard, batch // 4), rng.choice(bad, batch // 4)])
            y = np.r_[np.ones(batch // 2), np.zeros(2 * (batch // 4))].astype(np.float32)
            a, m = at[:, pick], mask[:, pick]
            raw = _letters(words, a)
            chars = raw @ model.p["C"]
            kept: dict = {}
            logit = model.forward(rows[a], chars, m, kept)
            g = model.gradients(rows[a], raw, chars, m, ((model._sigmoid(logit) - y) / batch).astype(np.float32), kept)
            g["E"][g["rows_of_E"] == 0] *= 0.1
            for k, v in model.p.items():
                at_rows = g["rows_of_E"] if k == "E" else slice(None)  # a step moves the rows that it read
                m1, m2 = moments[k]
                m1[at_rows] = 0.9 * m1[at_rows] + 0.1 * g[k]
                m2[at_rows] = 0.999 * m2[at_rows] + 0.001 * g[k] ** 2
                v[at_rows] -= RATE * (m1[at_rows] / (1 - 0.9**step)) / (np.sqrt(m2[at_rows] / (1 - 0.999**step)) + 1e-6)
        # the next round's: every window of a toxic text, and of the others' as many as are hard enough to look through
        seen = np.sort(rng.permutation(bad)[: max(len(bad) // 3, 12 * len(good))])
        at_last = round_ == rounds - 1
        for part in () if at_last else (np.flatnonzero(is_toxic), seen):
            score[part] = model.window_logits(words, first[part], owner[part])
    return model


class Letters:
    """The letter triples of words, as shares of each word."""

    def __init__(self, where: np.ndarray, triple: np.ndarray, row: np.ndarray, length: np.ndarray):
        self.where, self.triple, self.row, self.length = where, triple, row, length

    def __matmul__(self, table: np.ndarray) -> np.ndarray:
        sums = np.stack([np.bincount(self.row, table[self.triple, k], len(self.length)) for k in range(table.shape[1])], axis=1)
        return (sums / self.length[:, None]).astype(table.dtype)[self.where]

    def back(self, dx: np.ndarray) -> np.ndarray:
        """The table's gradient from that of the words."""
        flat = self.where.ravel()
        own = np.stack([np.bincount(flat, dx[:, :, k].ravel(), len(self.length)) for k in range(dx.shape[2])], axis=1) / self.length[:, None]
        return np.stack([np.bincount(self.triple, own[self.row, k], TRIPLES) for k in range(dx.shape[2])], axis=1)


def _letters(words: Words, at: np.ndarray) -> Letters:
    """The letters of the words at these places."""
    flat, where = np.unique(at, return_inverse=True)
    n = words.length[flat]
    begin = np.repeat(words.start[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Letters(where.reshape(at.shape), words.triple[begin].astype(np.int64), np.repeat(np.arange(len(flat)), n), n)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Put 0.5 where the fewest training texts are on the wrong side, in the middle of that gap."""
    order = np.argsort(x, kind="stable")
    v, t = x[order], y[order]
    wrong = np.r_[0, np.cumsum(t)] + np.r_[np.cumsum(~t[::-1])[::-1], 0]
    best = np.flatnonzero(wrong == wrong.min())
    cut = best[len(best) // 2]
    border = (v[max(0, cut - 1)] + v[min(cut, len(v) - 1)]) / 2
    return 1.0, -float(border)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most `sample` labelled texts, in the order of a hash of their id, none of them with crc32(doc_id) mod 5
    = 0. Rows with a null id, label or text are left out; an id labelled twice is toxic if any of its rows says so,
    and an id with several texts is learnt from the least of them."""
    ids = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` rows are broadcast
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return train([r["text"].encode() for r in rows], np.array([r["toxic"] == 1 for r in rows], bool))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts, and texts without letters, have no windows and a score near 0. Every window of a text is scored,
    however long it is. Repeated rows score alike; input columns named like outputs are replaced; an empty table gives an
    empty result. The model (its size is bounded by its number of known words) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    carried = docs.drop("score", "predicted")

    def run(batches):
        net: Model = pickle.loads(shared.value)
        for batch in C.pieces(batches, rows=1000, mb=8):
            out = []
            data, offsets = C.joined_texts(batch.column("text"))
            for lo, hi in _groups(offsets, 1 << 21):
                out.append(net.scores(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])))
            s = np.concatenate(out)
            cols = [*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema), "score double, predicted int"])
    return carried.mapInArrow(run, schema)


def _groups(offsets: np.ndarray, most: int):
    """Runs of texts of about `most` bytes together, so that arrays stay small."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")

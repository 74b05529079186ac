"""Personal data: pattern spans, and a skip-chain conditional random field that adds spans to them.

The field's variables are the pattern spans and the words that hold a digit, an @, or an @ or dot spelt out in brackets; all
others can only be of no kind. Neighbours in the text share a chain factor; variables of one document that are equal, or
whose digits are, or that become equal once what is spelt out is written as a sign, share a skip factor, each with its next
occurrence, so a token repeated n times has n - 1 of them. Loopy belief propagation over all documents of a batch at once
brings a document's labels into agreement. Node, chain and skip factors are fitted together, by the pseudo-likelihood of each
variable given its neighbours, on a bounded sample of texts whose pattern spans are the labels.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

KINDS = ("email", "ip", "card", "phone")
#: Texts that training reads, the longest of them in bytes, hashed features, and the share of belief that makes a span.
SAMPLE, LONGEST, FEATURES, CERTAIN = 3000, 20_000, 1 << 14, 0.5
#: How much two equal variables agree before training.
AGREE = 9.0
#: Messages are passed until they change by less than SETTLED. Those that are passed more than PATIENCE times move less and less, so that what swings comes to rest.
SETTLED, PATIENCE, CALM = 1e-4, 256, 0.97
LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARK = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
SPELT = (re.compile(r"[\[({]at[\])}]", re.I), re.compile(r"[\[({]dot[\])}]", re.I))
NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @: the local part is what may stand before it, back to the last match."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if m:
            yield start, m.end()
            done = at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass their tests, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Words with a digit, an @, or an @ or dot spelt out, without the punctuation at their ends."""
    out, upto = [], 0
    n = len(text)
    for m in MARK.finditer(text):
        if m.start() < upto:
            continue
        a = z = m.start()
        while a > upto and not text[a - 1].isspace():
            a -= 1
        while z < n and not text[z].isspace():
            z += 1
        upto = z
        while a < z and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while z > a and not text[z - 1].isalnum():
            z -= 1
        if z > a:
            out.append((a, z))
    return out


def _shape(word: str) -> str:
    out: list[str] = []
    for c in SPELT[1].sub(".", SPELT[0].sub("@", word)):
        k = "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _neighbour(text: str, at: int, step: int) -> str:
    """The letters nearest to a place, at most 12 signs away, and of them the nearest 12."""
    i = at - 1 if step < 0 else at
    while 0 <= i < len(text) and not text[i].isalpha() and abs(i - at) < 12:
        i += step
    j = i
    while 0 <= j < len(text) and text[j].isalpha() and abs(j - i) < 12:
        j += step
    return (text[j + 1 : i + 1] if step < 0 else text[i:j]).lower()


def features(text: str, a: int, z: int) -> list[int]:
    word = text[a:z]
    digits = sum(map(str.isdigit, word))
    named = (f"s{_shape(word)}", f"n{digits}", f"l{min(z - a, 40)}", f"d{word.count('.')}", f"@{word.count('@')}", f"p{word[0]}{'9' if word[-1].isdigit() else 'a'}", f"b{_neighbour(text, a, -1)}", f"f{_neighbour(text, z, 1)}")
    return [zlib.crc32(x.encode()) % FEATURES for x in named]


class Field:
    def __init__(self):
        self.weights = np.zeros((FEATURES, 5))
        self.bias = np.array([0.0, -2, -2, -2, -2])
        self.chain = np.zeros((5, 5))
        self.skip = np.zeros((5, 5))

    @staticmethod
    def edges(texts: list[str], found: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(chain, skip): pairs of token numbers over all texts."""
        chain, skip, base = [], [], 0
        for text, own in zip(texts, found):
            last: dict[str, int] = {}
            for i, (a, z) in enumerate(own):
                if i and a - own[i - 1][1] <= 3:
                    chain.append((base + i - 1, base + i))
                word = text[a:z]
                keys = {SPELT[1].sub(".", SPELT[0].sub("@", word.lower()))}
                if len(d := NOT_DIGIT.sub("", word)) >= 6:
                    keys.add("#" + d)
                for before in {last[k] for k in keys if k in last}:
                    skip.append((base + before, base + i))
                for k in keys:
                    last[k] = i
            base += len(own)
        return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)

    def beliefs(self, index: np.ndarray, chain: np.ndarray, skip: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        """Marginals after loopy message passing; fixed: the label of tokens that a pattern has told, else -1."""
        node = self.weights[index].sum(axis=1) + self.bias
        known = np.flatnonzero(fixed >= 0)
        node[known] = -20
        node[known, fixed[known]] = 20
        node -= node.max(axis=1, keepdims=True)
        edges = np.concatenate([chain, skip])
        if not len(edges):
            p = np.exp(node)
            return p / p.sum(axis=1, keepdims=True)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), 5, 5)), np.broadcast_to(self.skip, (len(skip), 5, 5))])
        src, dst = np.concatenate([edges, edges[:, ::-1]]).T
        pot = np.concatenate([pair, pair.transpose(0, 2, 1)])
        m = np.zeros((len(src), 5))
        e = len(edges)
        other = np.r_[np.arange(e, 2 * e), np.arange(e)]
        total, passed, todo = node.copy(), np.zeros(len(src), np.int64), np.arange(2 * e)
        while len(todo):
            x = (total[src[todo]] - m[other[todo]])[:, :, None] + pot[todo]
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = 0.5 * CALM ** np.maximum(0, passed[todo] - PATIENCE)[:, None] * (new - m[todo])
            m[todo] += step
            np.add.at(total, dst[todo], step)
            passed[todo] += 1
            moved = todo[np.abs(step).max(axis=1) > SETTLED]
            again, reached = np.zeros(len(src), bool), np.zeros(len(node), bool)
            again[moved], reached[dst[moved]] = True, True
            todo = np.flatnonzero(again | reached[src])
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def units(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The field's variables: pattern spans, of overlapping ones the first, and the tokens that touch none; with the kind
    (1 to 4) of the spans, 0 for tokens."""
    own, done = [], 0
    for a, k, z in base:
        if a >= done:
            own.append((a, z, k + 1))
            done = z
    j = 0
    starts = [a for a, _, _ in base]
    reach = np.maximum.accumulate([z for _, _, z in base]).tolist() if base else []
    for a, z in tokens(text):
        while j < len(starts) and starts[j] < z:
            j += 1
        if not j or reach[j - 1] <= a:
            own.append((a, z, 0))
    own.sort()
    return [(a, z) for a, z, _ in own], [k for _, _, k in own]


def train(texts: list[str], epochs: int = 12, seed: int = 1) -> Field:
    """No texts, or none with candidates, give a field that adds nothing."""
    field = Field()
    both = [units(t, base_spans(t)) for t in texts]
    found = [own for own, _ in both]
    rows = [features(t, a, z) for t, own in zip(texts, found) for a, z in own]
    if not rows:
        return field
    y = np.array([k for _, kinds in both for k in kinds])
    index, n = np.array(rows), len(y)
    chain, skip = Field.edges(texts, found)
    # what a variable's neighbours are labelled: before it, after it, and how many of its equals are of each kind
    one = np.eye(5)[y]
    before, after, equal = np.zeros((n, 5)), np.zeros((n, 5)), np.zeros((n, 5))
    np.add.at(before, chain[:, 1], one[chain[:, 0]])
    np.add.at(after, chain[:, 0], one[chain[:, 1]])
    np.add.at(equal, skip[:, 1], one[skip[:, 0]])
    np.add.at(equal, skip[:, 0], one[skip[:, 1]])
    agree = AGREE * np.eye(5)  # beforehand: what is repeated agrees
    field.skip = agree.copy()
    rng = np.random.default_rng(seed)
    grads = {k: np.full(getattr(field, k).shape, 1e-2) for k in ("weights", "chain", "skip", "bias")}
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            i = order[lo : lo + 256]
            s = field.weights[index[i]].sum(axis=1) + field.bias + before[i] @ field.chain + after[i] @ field.chain.T + equal[i] @ field.skip
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            w, same = np.zeros_like(field.weights), equal[i].T @ p
            np.add.at(w, index[i].ravel(), np.repeat(p, index.shape[1], axis=0))
            step = {"weights": w + 1e-5 * field.weights, "bias": p.sum(axis=0), "chain": before[i].T @ p + p.T @ after[i] + 1e-3 * field.chain, "skip": (same + same.T) / 2 + 1e-3 * (field.skip - agree)}
            for k, g in step.items():
                grads[k] += g * g
                setattr(field, k, getattr(field, k) - 0.3 * g / np.sqrt(grads[k]))
    return field


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on at most `sample` texts of at most LONGEST bytes with a digit or an @, those of the least row hashes."""
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= LONGEST))
    rows = C.sampled(some, sample).select("text").collect()
    return train([r["text"] for r in rows])


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its pattern spans, and the spans that the field adds; those overlap no other span."""
    bases = [base_spans(t) for t in texts]
    both = [units(t, b) for t, b in zip(texts, bases)]
    found = [own for own, _ in both]
    rows = [features(t, a, z) for t, own in zip(texts, found) for a, z in own]
    if not rows:
        return [(b, []) for b in bases]
    fixed = np.array([k or -1 for _, kinds in both for k in kinds])
    p = field.beliefs(np.array(rows), *Field.edges(texts, found), fixed)
    best, sure = p.argmax(axis=1), p.max(axis=1) >= CERTAIN
    out, i = [], 0
    for own, b in zip(found, bases):
        more = []
        for a, z in own:
            if fixed[i] < 0 and best[i] and sure[i]:
                more.append((a, int(best[i]) - 1, z))
            i += 1
        out.append((b, more))
    return out


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find_spans(docs: DataFrame, field: Field) -> DataFrame:
    """docs without text, with n_email, n_ip, n_card, n_phone (pattern spans), base (those, as kind:start:end joined by
    commas, in code points, end exclusive) and spans (with what the field adds).

    Null and empty texts have no spans. Texts are read whole; a run of digits or of local-part characters, however long, is
    read a bounded number of times. Repeated rows give equal spans; input columns named like outputs are replaced; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))
    made = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    carried = docs.drop(*made)
    kept = [c for c in carried.columns if c != "text"]

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in C.pieces(batches, rows=1000, mb=8):
            found = find([x or "" for x in batch.column("text").to_pylist()], model)
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in found], pa.int64()) for kind in range(4)]
            cols = [*(batch.column(c) for c in kept), *counts, pa.array([_text(b) for b, _ in found], pa.string()), pa.array([_text(sorted(b + m)) for b, m in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in kept), *(f"n_{k} long" for k in KINDS), "base string, spans string"])
    return carried.mapInArrow(run, schema)


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first."""
    out, at = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, z = s.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
            at = int(z)
    return "".join([*out, text[at:]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_spans(docs, fit(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

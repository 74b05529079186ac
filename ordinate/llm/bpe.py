"""Byte-level BPE by per-prefix dynamic programming.

A suffix automaton over the vocabulary walks a piece once; at each prefix its state and suffix links give every token that
ends there. Exactly one of them can be the last token of the prefix's encoding: the one that the merges keep apart from the
last token of the shorter prefix. That token is stored for each prefix, and the back-pointers give the ids. The pieces are
those of the tokenizer's own splitting pattern; a bounded cache holds the ids of short pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ordinate.llm import common as C

#: The splitting pattern of the vocabulary file (a fixed value of its format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space but the single space and line feed. A text that holds any of it, or two of those two in a row, or one at an end,
#: is not cut at them before the pattern is applied to the parts.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]
#: Entries of each of a worker's caches (up to 0.2 KB each); longer texts are worked out each time.
CACHE, LONGEST = 400_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of() -> dict[str, int]:
    """The format's printable character of each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def refuse_others(spec: dict) -> None:
    """Raise ValueError for a vocabulary file that asks for anything but plain byte-level BPE with PATTERN, as its ids would
    differ from what is worked out here. The decoder must be the byte-level one, too."""
    model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"added token with {k}" for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if spec.get("normalizer"):
        odd.append("normalizer")
    if model.get("type") != "BPE":
        odd.append("model")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        odd.append("pre_tokenizer")
    if decoder.get("type") != "ByteLevel":
        odd.append("decoder")
    if odd:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(odd)}")


def uneven(text: str) -> bool:
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", "\n ", " \n")):
        return True
    return any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE))


class SuffixAutomaton:
    """Of all the vocabulary's tokens, built over their trie level by level."""

    def __init__(self, tokens: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        state = {b"": 0}
        for prefix in sorted({t[:i] for t in tokens for i in range(1, len(t) + 1)}, key=lambda p: (len(p), p)):
            state[prefix] = self._extend(state[prefix[:-1]], prefix[-1])
        self.own: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(tokens):
            if t:
                self.own.setdefault(self.walk(t), []).append((len(t), i))
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.next)

    def walk(self, text: bytes) -> int:
        s = 0
        for c in text:
            s = self.next[s][c]
        return s

    def _copy(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, p: int, c: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(c) == old:
            self.next[p][c] = new
            p = self.link[p]

    def _extend(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            if self.length[q] == self.length[p] + 1:
                return q
            clone = self._copy(q, self.length[p] + 1)
            self.link[q] = clone
            self._redirect(p, c, q, clone)
            return clone
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._copy(q, self.length[p] + 1)
                self.link[q] = self.link[new] = clone
                self._redirect(p, c, q, clone)
        return new

    def suffixes(self, s: int) -> tuple[tuple[int, int], ...]:
        """(length, token) of the tokens that are suffixes of state s's longest string, longest first."""
        found = self.ends[s]
        if found is None:
            out, t = [], s
            while t > 0:
                out += self.own.get(t, ())
                t = self.link[t]
            found = self.ends[s] = tuple(sorted(out, reverse=True))
        return found


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        refuse_others(spec)
        to_byte = byte_of()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(to_byte[c] for c in s)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for s, i in vocab.items():
            if s not in self.special:
                self.tokens[i] = raw(s)
        self.rank = list(range(size))  # of byte tokens: below all merges
        self.parts = [(i, i) for i in range(size)]
        self.merge: dict[tuple[int, int], int] = {}
        base = size
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge[pair] = made
            self.parts[made], self.rank[made] = pair, base + k
        self.automaton = SuffixAutomaton(self.tokens)
        flat = [s.encode() if not t else t for t, s in zip(self.tokens, [""] * size)]
        for s, i in self.special.items():
            flat[i] = s.encode()
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.size = np.array([len(t) for t in flat], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.mark = os.path.commonprefix(list(self.special))  # what every special token's text begins with
        self.head = _Parts(self, "")
        self.tail = _Parts(self, " ")

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep left | right apart: undo the merges of the two tokens from the last on; the merge across
        the border, wherever one exists, must come after the merge that has used up one of its sides."""
        key = left * len(self.tokens) + right
        known = self.apart.get(key)
        if known is not None:
            return known
        rank, parts, merge = self.rank, self.parts, self.merge
        limit, a, b, ok = float("inf"), left, right, True
        while True:
            made = merge.get((a, b))
            if made is not None and rank[made] < limit:
                ok = False
                break
            whole_a, whole_b = parts[a][0] == a, parts[b][0] == b
            if whole_a and whole_b:
                break
            # of the two border tokens the one merged later is undone first; on the right side a merge of the same
            # rank comes second, as equal merges are done from the left
            if whole_b or not whole_a and rank[a] > rank[b]:
                limit = rank[a]
                a = parts[a][1]
            else:
                limit = rank[b] + 0.5
                b = parts[b][0]
        if len(self.apart) > CACHE:
            self.apart.clear()
        self.apart[key] = ok
        return ok

    def reachable(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self.whole.get(token)
        if known is None:
            a, b = self.parts[token]
            known = self.whole[token] = a == token or self.reachable(a) and self.reachable(b) and self._stays(a, b, token)
        return known

    def _stays(self, a: int, b: int, token: int) -> bool:
        """Merging a and b is the first thing that happens across their border."""
        rank, parts, merge = self.rank, self.parts, self.merge
        limit = rank[token]
        while True:
            whole_a, whole_b = parts[a][0] == a, parts[b][0] == b
            if whole_a and whole_b:
                return True
            if whole_b or not whole_a and rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 0.5, parts[b][0]
            made = merge.get((a, b))
            if made is not None and rank[made] < limit:
                return False

    def piece(self, text: str) -> bytes:
        """The ids of one piece, little-endian 32-bit."""
        data = text.encode("utf-8", "surrogatepass")
        sam = self.automaton
        nxt, link, length, ends, apart, size = sam.next, sam.link, sam.length, sam.ends, self.apart, len(self.tokens)
        last = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        s = m = 0
        for i, c in enumerate(data, 1):
            to = nxt[s].get(c)
            while to is None and s:
                s = link[s]
                m = length[s]
                to = nxt[s].get(c)
            s, m = (to, m + 1) if to else (0, 0)
            for n, t in ends[s] or sam.suffixes(s):
                if n > m:
                    continue
                j = i - n
                before = last[j]
                if j:
                    if before < 0:
                        continue
                    fits = apart.get(before * size + t)
                    if fits is None:
                        fits = self.compatible(before, t)
                else:
                    fits = self.reachable(t)
                if fits:
                    last[i], back[i] = t, j
                    break
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i = back[i]
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def known_piece(self, text: str) -> bytes:
        """Pieces share the caches of what stands between spaces: a piece alone is split into itself."""
        cache, part = (self.tail, text[1:]) if text[0] == " " else (self.head, text)
        ids = cache.get(part)
        if ids is None:
            ids = self.piece(text)
            if len(text) <= LONGEST:
                cache[part] = ids
        return ids

    def plain(self, text: str) -> bytes:
        parts = self.split(text)
        return self.piece(text) if len(parts) == 1 else b"".join(map(self.known_piece, parts))

    def encode(self, text: str) -> bytes:
        if self.cut and self.mark in text and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._ordinary(text[at:])])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        for x in (self.head, self.tail):
            if len(x) > CACHE:
                x.clear()
        if uneven(text):
            return b"".join(map(self.known_piece, self.split(text)))
        # no piece reaches over a single line feed, or over the place before a single space and what follows it
        head, tail, newline = self.head, self.tail, self.known_piece("\n")
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            first, *rest = line.split(" ")
            out.append(head[first])
            out += map(tail.__getitem__, rest)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(ids), 1 << 18):
            part = ids[lo : lo + (1 << 18)].astype(np.int64)
            n = self.size[part]
            ends = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.at[part] - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Parts(dict):
    """The ids of what stands between two spaces, worked out when first met."""

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.plain(self.before + part)
        if len(part) <= LONGEST:
            self[part] = ids
        return ids


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """Of this process, built once."""
    return Encoder(path)


def encode_texts(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids (array of int), ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded
    (the ids' text) and decoded_sha256.

    Ids are those of the tokenizers library for the vocabulary file, without special tokens added, truncation or padding; a
    special token's own text becomes its id. Null and empty texts have no ids and decode to "". Repeated rows give equal
    results; input columns named like outputs are replaced; an empty table gives an empty result. with_ids=False leaves out
    ids and decoded. `vocabulary` is a path that every worker can read (by default that of the installed package); a file of
    another kind than plain byte-level BPE is a ValueError.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if with_ids else {})
    carried = docs.drop(*made)
    if "text" in carried.columns and not with_ids:
        kept = [c for c in carried.columns if c != "text"]
    else:
        kept = carried.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in kept), *(f"{k} {v}" for k, v in made.items())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(vocabulary or default_vocabulary())  # where it runs
        n, a, b, ids, texts = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            code = enc.encode(text or "")
            array = np.frombuffer(code, "<u4")
            back = enc.decode(array)
            n.append(len(array))
            a.append(hashlib.sha256(code).hexdigest())
            shown = back.decode("utf-8", "replace")
            b.append(hashlib.sha256(shown.encode()).hexdigest())
            if with_ids:
                ids.append(array.astype(np.int32))
                texts.append(shown)
        cols = [batch.column(c) for c in kept] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        if with_ids:
            flat = np.concatenate(ids)
            at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            cols += [pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*kept, *made])

    return C.arrow_map(carried, run, schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(C.table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

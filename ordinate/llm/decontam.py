"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark items; each text is normalised and
scanned once, and hits are mapped back to words and to offsets in the original text.

The automaton's patterns are the items cut into runs of 7 words (all of an item of under 13 words). Any 13 words of an item
hold one such run whole, so no window is missed, and the automaton is as long as the items and not 13 times that. Where a run
is found, the words on both sides are compared with the item's: 13 or more that agree are windows. Of a run that many items have,
the windows round it are kept in a table, so that a hit takes as many look-ups as windows can lie round it, however many items.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

WINDOW, SHARE = 13, 20
#: Places of a run that are compared one by one; a run of more places goes by its windows.
PLACES = 8
#: Bytes of benchmark text whose runs go into one automaton (about 50 bytes of memory each). A larger benchmark has several; they
#: take turns over the same rows, HELD_BYTES of text at a time, so documents are still read once and a worker holds one of them.
AUTOMATON_BYTES, HELD_BYTES = 8 << 20, 64 << 20
#: A-Z to lower case, other letters, digits and bytes over 0x7F kept, the rest to spaces.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_built: dict[str, Matcher] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Matcher:
    """The automaton over (sorted ids of an item, its words), and the comparison of what surrounds a hit."""

    def __init__(self, items: list[tuple[tuple[str, ...], list[bytes]]], width: int):
        self.items, self.width, self.run = items, width, (width + 1) // 2
        runs: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(items):
            n = len(w) if len(w) < width else self.run
            for at in range(0, len(w) - n + 1, n):
                runs.setdefault(b" ".join(w[at : at + n]), []).append((k, at))
        self.auto = ahocorasick.Automaton()
        self.windows: dict[bytes, list[int]] = {}
        for run, places in runs.items():
            n, crowded = run.count(b" ") + 1, len(places) > PLACES
            if crowded:
                self._keep_windows(places)
                places = [(k, at) for k, at in places if len(items[k][1]) < width]  # one at most: an item that is this run
            self.auto.add_word(f" {run.decode('latin-1')} ", (n, places, crowded))
        if len(self.auto):
            self.auto.make_automaton()

    def _keep_windows(self, places: list[tuple[int, int]]) -> None:
        """The windows that hold a run whole at these places, each with the items that have it."""
        for k, at in places:
            w = self.items[k][1]
            for lo in range(max(0, at - self.width + self.run), min(at, len(w) - self.width) + 1):
                own = self.windows.setdefault(b" ".join(w[lo : lo + self.width]), [])
                if not own or own[-1] != k:
                    own.append(k)

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(runs of hit words, items of which a window occurs) of a text's words."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not len(self.auto) or not w:
            return spans, found
        normal = f" {b' '.join(w).decode('latin-1')} "
        raw = [(end, *value) for end, value in self.auto.iter(normal)]
        if not raw:
            return spans, found
        after = np.cumsum(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32) - 1  # words that end before a byte
        seen: set[int] = set()
        known: set[int] = set()
        for end, n, places, crowded in raw:
            stop = int(after[end])
            for lo in range(max(0, stop - self.width), min(stop - n, len(w) - self.width) + 1) if crowded else ():
                if lo not in seen and (own := self.windows.get(b" ".join(w[lo : lo + self.width]))):
                    spans.append((lo, lo + self.width))
                    if id(own) not in known:
                        known.add(id(own))
                        found.update(own)
                seen.add(lo)
            for k, at in places:
                lo, hi = self._grown(w, stop - n, stop, self.items[k][1], at) if n == self.run else (stop - n, stop)
                if hi - lo >= min(self.width, len(self.items[k][1])):
                    spans.append((lo, hi))
                    found.add(k)
        return spans, found

    def _grown(self, w: list[bytes], lo: int, hi: int, item: list[bytes], at: int) -> tuple[int, int]:
        """The words round w[lo:hi] that agree with the item's; beyond the next run on either side, that run's hit goes on."""
        left, right, most = 0, 0, self.width - self.run
        while left < most and left < lo and left < at and w[lo - left - 1] == item[at - left - 1]:
            left += 1
        end = at + hi - lo
        while right < most and hi + right < len(w) and end + right < len(item) and w[hi + right] == item[end + right]:
            right += 1
        return lo - left, hi + right


def _matcher(block: bytes, width: int) -> Matcher:
    """Of a worker process; one at a time is held."""
    key = hashlib.sha256(block).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(pickle.loads(block), width)
    return _built[key]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about `most` bytes."""
    group, size = [], 0
    for batch in C.pieces(batches):
        group.append(batch)
        size += batch.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    return [{"start": a, "stop": z} for a, z in hit_spans(text.decode("utf-8", "replace"), hit.tobytes())]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = SHARE, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids as strings), hit (a byte a word, null if none), hit_at (runs of hit
    words as offsets of the original text, in code points, end exclusive) and contaminated.

    A window is `width` consecutive words of an item (all its words, if fewer); a document's word inside any occurrence is
    hit; contaminated: n_hit > 0 and share * n_hit >= n_words. Null or empty texts have no words and are clean; items
    without words, and items whose id is null, have no windows. Equal items each count. Repeated rows are judged alike; input
    columns named like outputs are replaced; empty tables give no hits or no rows. Documents are read once, whatever the
    benchmark's size; it is broadcast by blocks of a checked size.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // automaton_bytes))
    shared = []
    for k in range(count):
        same: dict[tuple[bytes, ...], set[str]] = {}
        for r in items.filter(F.expr(f"pmod(xxhash64(text), {count}) = {k}")).toLocalIterator():
            if w := words(r["text"].encode()):
                same.setdefault(tuple(w), set()).add(r["id"])
        shared.append(spark.sparkContext.broadcast(pickle.dumps(sorted((tuple(sorted(ids)), list(w)) for w, ids in same.items()))))
    made = ["n_words", "n_hit", "n_items", "items", "hit", "hit_at", "contaminated"]
    plain = docs.drop(*made)
    at = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), at, pa.bool_()]

    def run(batches):
        for group in _held(batches, HELD_BYTES if count > 1 else 1):
            texts = [C.binary_texts(b.column("text")) for b in group]
            masks: dict[tuple[int, int], tuple[np.ndarray, set[str]]] = {}
            for block in shared:
                matcher = _matcher(block.value, width)
                for i, own in enumerate(texts):
                    for j, text in enumerate(own):
                        w = words(text)
                        spans, found = matcher.hits(w)
                        if spans:
                            mask, ids = masks.setdefault((i, j), (np.zeros(len(w), bool), set()))
                            for lo, hi in spans:
                                mask[lo:hi] = True
                            ids.update(x for k in found for x in matcher.items[k][0])
            for i, batch in enumerate(group):
                out = []
                for j, text in enumerate(texts[i]):
                    n = len(words(text))
                    mask, ids = masks.get((i, j), (None, ()))
                    hit = 0 if mask is None else int(mask.sum())
                    out.append((n, hit, len(ids), sorted(ids), None if mask is None else mask.tobytes(), [] if mask is None else _spans(text, mask), hit > 0 and share * hit >= n))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=[*batch.schema.names, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "n_words long, n_hit long, n_items long, items array<string>, hit binary, hit_at array<struct<start: long, stop: long>>, contaminated boolean"])
    return plain.mapInArrow(run, schema)


def hit_spans(text: str, hit: bytes) -> list[tuple[int, int]]:
    """Maximal runs of hit words as offsets (code points, end exclusive) of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for i, (span, h) in enumerate(zip(at, hit)):
        if h and out and hit[i - 1]:
            out[-1] = (out[-1][0], span[1])
        elif h:
            out.append(span)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH lowered AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
item AS (SELECT id AS item_id, least(13, len(ws)) AS width, unnest(list_transform(range(1, greatest(1, len(ws) - 12) + 1), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS win FROM w WHERE kind = 1 AND len(ws) > 0),
lens AS (SELECT DISTINCT width FROM item),
doc AS (SELECT id AS doc_id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: {'i': i, 'win': array_to_string(ws[i:i + width - 1], ' ')})) AS u FROM w, lens WHERE kind = 0 AND len(ws) >= width),
hit AS (SELECT DISTINCT doc_id, u.i AS i, item.width AS width, item_id FROM doc JOIN item ON u.win = item.win AND doc.width = item.width),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN covered ON w.id = covered.doc_id LEFT JOIN its ON w.id = its.doc_id WHERE kind = 0
"""

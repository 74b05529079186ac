"""Periodic runs of words, found by heavy / light lag counting.

At lag q two places match if the words there are equal. A run of period q needs so many neighbouring matches at lag q that most
lags are ruled out by their number of matches alone. These numbers are exact: frequent words add up their power spectra, of which
one inverse transform is the autocorrelation; rare words add their pairs' differences. Only lags with enough matches that known
runs of shorter periods don't explain get a scan for islands of matches, at first by a few sampled places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm import common as C

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Pairs of places whose differences are held at once.
PAIRS = 1 << 22


def lag_matches(words: np.ndarray, most: int) -> np.ndarray:
    """How many places match at each lag 0 .. most (lag 0 is left at 0). words: an id for each word."""
    out = np.zeros(most + 1, np.int64)
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(words[order]) != 0])
    size = np.diff(np.r_[first, n])
    width = 1 << (n + most).bit_length()
    heavy = size.astype(float) ** 2 > 0.4 * width * np.log2(width)  # more pairs than a transform has steps
    spectrum = np.zeros(width // 2 + 1)
    for at, f in zip(first[heavy], size[heavy]):
        own = np.zeros(width)
        own[order[at : at + f]] = 1.0
        x = np.fft.rfft(own)
        spectrum += x.real**2 + x.imag**2
    if heavy.any():
        out += np.rint(np.fft.irfft(spectrum, width)[: most + 1]).astype(np.int64)
    light = ~heavy & (size > 1)
    first, size = first[light], size[light]
    stop = np.cumsum(size * (size - 1) // 2)
    lo = 0
    while lo < len(size):  # blocks of words with about PAIRS pairs
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + PAIRS, "right")))
        at = np.repeat(first[lo:hi], size[lo:hi]) + _counted(size[lo:hi])
        later = np.repeat(first[lo:hi] + size[lo:hi], size[lo:hi]) - at - 1  # places of the same word behind each place
        a = np.repeat(at, later)
        gap = order[a + 1 + _counted(later)] - order[a]
        out += np.bincount(gap[gap <= most], minlength=most + 1)
        lo = hi
    out[0] = 0
    return out


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _islands(match: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the stretches of at least `least` matches."""
    edge = np.flatnonzero(np.diff(np.r_[0, match.astype(np.int8), 0]))
    start, stop = edge[::2], edge[1::2]
    keep = stop - start >= least
    return start[keep], stop[keep]


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(words)
    most = n // times
    if n < least or not most:
        return []
    need = np.maximum(np.maximum(least, times * np.arange(most + 1)) - np.arange(most + 1), 1)  # neighbouring matches at each lag
    matches = lag_matches(words, most)
    explained = np.zeros(most + 1, np.int64)
    out: list[tuple[int, int, int]] = []
    for q in np.flatnonzero(matches >= need).tolist():
        if q and matches[q] - explained[q] >= need[q]:
            found = _scanned(words, q, int(need[q]), [(s, k) for s, k, p in out if q % p == 0 and k > q])
            out += found
            for _, length, _ in found:  # at a multiple of its period a run has this many matches, which no other run shares
                more = np.arange(2 * q, min(most, length - 1) + 1, q)
                explained[more] += length - more
    return sorted(out, key=lambda r: (r[0], r[2]))


def _scanned(words: np.ndarray, q: int, need: int, known: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The runs of period q, apart from known ones (start, length) of a period that divides q. A run has need neighbouring
    matches, so every step-th place sees need // step of it in a row; only what lies round such rows is read in full."""
    n, step = len(words), max(1, need // 8)
    sample = words[: n - q : step] == words[q::step]
    for start, length in known:
        sample[-(-start // step) : -(-(start + length - q) // step)] = False
    out = []
    for a, z in zip(*_islands(sample, need // step)):
        lo, hi = max(0, (int(a) - 1) * step + 1), min(n - q, int(z) * step)
        for start, stop in zip(*_islands(words[lo:hi] == words[lo + q : hi + q], need)):
            out.append((lo + int(start), int(stop - start) + q, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run the first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with n_runs, runs (array of start, length, period, by start, then period) and collapsed (the words that stay, joined
    by one space).

    Words are what white space (space, tab to carriage return) parts, numbered from 0. A run is a stretch of at least `least`
    words and `times` (two or more) times its smallest period that no neighbouring word extends; a word goes if a run holds it
    behind the run's first period. Null and empty texts have no words and no runs. Rows are judged one by one, so repeated rows
    are judged alike; input columns named like outputs are replaced; an empty table gives an empty result. Memory is that of one
    text, its word numbers and PAIRS differences.
    """
    made = ["n_runs", "runs", "collapsed"]
    plain = docs.drop(*made)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(text: bytes) -> tuple[list, bytes]:
        words = text.split()
        if len(words) < least:
            return [], b" ".join(words)
        ids: dict[bytes, int] = {}
        runs = runs_of(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)), least, times)
        return runs, b" ".join(w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k) if runs else b" ".join(words)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(t) for t in C.binary_texts(b.column("text"))]
        flat = [r for runs, _ in found for r in runs]
        offsets = np.r_[0, np.cumsum([len(runs) for runs, _ in found])].astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(run_type))
        made_of = [pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array([t for _, t in found], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*b.columns, *made_of], names=[*b.schema.names, *made])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema]
    return C.arrow_map(plain, batch, ", ".join([*kinds, "n_runs long, runs array<struct<start: long, length: long, period: long>>, collapsed string"]))


def most_repeated(runs: Column) -> Column:
    """Of runs by start and period the one with the most periods, exactly; the first of equals; null if there is none."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as the query's contract has them: where 10 divides h = crc32(doc_id as text), the words from number
    a = g % n on repeat those from a with period 1 + (n - a) div (3 + g % 8); g = h div 10, n the number of words. Null ids have
    no h, and stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    g, n, a = F.floor(h / 10), F.size("__words"), F.col("__g") % F.size("__words")
    cut = docs.select("doc_id", "text", words.alias("__words"), g.alias("__g"))
    some = cut.withColumn("__a", F.when(n > 0, a)).withColumn("__p", 1 + F.expr("(size(__words) - __a) div (3 + __g % 8)"))
    again = F.transform("__words", lambda w, i: F.when(i >= F.col("__a"), F.element_at("__words", (F.col("__a") + (i - F.col("__a")) % F.col("__p") + 1).cast("int"))).otherwise(w))
    return some.select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(looped(C.table(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))

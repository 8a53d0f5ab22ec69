"""Operator 13, periodic run detection by multi-scale minimizers.

A run is a stretch of consecutive words that repeats with its smallest period three times or more and holds 24 words or
more, extended as far as the period holds. Periods of up to `SHORT` words are found by direct scans: where words a lag
apart agree for long enough, there is a run.

For longer periods there is a scale for each factor of about 1.5. A scale of k-word grams covers periods above the scale
below it, up to k. Grams that are as long as the period recur within a run just at its multiples, and windows a period
apart hold the same grams, so their minima, the minimizers, repeat at the period's distance. A window is chosen so that
two of them fit into the shortest run of the scale. Each pair of equal minimizers that follow each other at a distance of
the scale is a seed, which is extended both ways over the words themselves: hashes may propose, but only words decide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from antigen.llm.common import by_bytes, table
from antigen.llm.shingles import mix

#: A run's words and repetitions at least.
LEAST_WORDS, LEAST_TURNS = 24, 3
#: Periods up to this have their own scan; runs of longer ones hold LEAST_TURNS of it at least.
SHORT = LEAST_WORDS // LEAST_TURNS
_BASE = 0x9E3779B97F4A7C15


def scales(n: int) -> list[tuple[int, int, int]]:
    """(longest shorter period, gram and longest period, window) of each scale for a text of n words."""
    out, below = [], SHORT
    while LEAST_TURNS * (below + 1) <= n:
        gram = min(max(below + 1, below * 3 // 2), n // LEAST_TURNS)
        out.append((below, gram, (LEAST_TURNS - 1) * (below + 1) - gram + 1))
        below = gram
    return out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The places, rising, of each window's least value, the first of equal ones."""
    place = np.arange(len(values) - width + 1)
    if width == 1:
        return place
    # twice as wide each time; a window is two that overlap
    least, at, span = values, np.arange(len(values)), 1
    while 2 * span <= width:
        left = least[:-span] <= least[span:]
        at = np.where(left, at[:-span], at[span:])
        least = np.where(left, least[:-span], least[span:])
        span *= 2
    other = width - span
    if other:
        n = len(place)
        at = np.where(least[:n] <= least[other : other + n], at[:n], at[other : other + n])
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def grams(prefix: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words, from the polynomial hashes of all prefixes."""
    return mix(prefix[length:] - prefix[:-length] * np.uint64(pow(_BASE, length, 1 << 64)))


def prefixes(words: np.ndarray) -> np.ndarray:
    """The polynomial hash of each prefix, by doubling: a step joins each stretch with the one before it."""
    value, span = mix(words.astype(np.uint64) + np.uint64(1)), 1
    while span < len(value):
        step = value.copy()
        step[span:] += value[:-span] * np.uint64(pow(_BASE, span, 1 << 64))
        value, span = step, 2 * span
    return np.concatenate([np.zeros(1, np.uint64), value])


def seeds(prefix: np.ndarray, below: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods and places of equal minimizers that follow each other at a distance above `below`, up to `gram`."""
    h = grams(prefix, gram)
    at = window_minima(h, min(window, len(h)))
    order = np.argsort(h[at], kind="stable")  # places of one value stay rising
    at, h = at[order], h[at[order]]
    far = np.diff(at)
    pair = np.flatnonzero((h[1:] == h[:-1]) & (far > below) & (far <= gram))
    period, place = far[pair], at[pair]
    order = np.lexsort((place, period))
    return period[order], place[order]


def reach(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on agree, forwards (step 1) or backwards from just before them (step -1)."""
    n, size = 0, 64
    room = len(words) - j if step > 0 else i
    while n < room:
        m = min(size, room - n)
        a, b = (words[i + n : i + n + m], words[j + n : j + n + m]) if step > 0 else (words[i - n - m : i - n][::-1], words[j - n - m : j - n][::-1])
        differ = np.flatnonzero(a != b)
        if len(differ):
            return n + int(differ[0])
        n, size = n + m, 2 * size
    return room


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text of word numbers from 0, by start, then period.

    Texts are looked at together, the longest first, with a number of its own behind each, which no run can cross. A scale
    reads only the texts that are long enough for its periods."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    words = np.concatenate([part for k, i in enumerate(order) for part in (texts[i], [-1 - k])]).astype(np.int64) if texts else np.zeros(0, np.int64)
    size = np.array([len(texts[i]) for i in order], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    room = lambda least: int(begin[np.searchsorted(-size, -least, side="right")])
    found: dict[tuple[int, int], int] = {}  # of one stretch the smallest period counts
    part = words[: room(LEAST_WORDS)]
    for p in range(1, SHORT + 1 if len(part) else 0):
        same = np.zeros(len(part) - p + 2, np.int8)
        same[1:-1] = part[p:] == part[:-p]
        edge = np.flatnonzero(np.diff(same))
        start, stop = edge[::2], edge[1::2]
        enough = stop - start + p >= max(LEAST_WORDS, LEAST_TURNS * p)
        for s, e in zip(start[enough].tolist(), stop[enough].tolist()):
            found.setdefault((s, e + p), p)
    steps = scales(int(size.max(initial=0)))
    prefix = prefixes(words[: room(LEAST_TURNS * (SHORT + 1))]) if steps else None
    for below, gram, window in steps:
        part = words[: room(LEAST_TURNS * (below + 1))]
        seen, end = 0, 0
        for p, at in zip(*(x.tolist() for x in seeds(prefix[: len(part) + 1], below, gram, window))):
            if p == seen and at < end:
                continue
            stop = at + p + reach(part, at, at + p, 1)
            start = at - reach(part, at, at + p, -1)
            seen, end = p, stop
            if stop - start >= LEAST_TURNS * p:
                found[start, stop] = min(p, found.get((start, stop), p))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, e), p in found.items():
        k = int(np.searchsorted(begin, s, side="right")) - 1
        out[order[k]].append((s - int(begin[k]), e - s, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def sharpest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length for its period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Equal words get equal numbers from 0; `known` holds those given so far."""
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def row_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The values of OUT for one text."""
    top = sharpest(runs)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = words if not runs else [words[i] for i in np.flatnonzero(collapsed(len(words), runs)).tolist()]
    first = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0, and compare byte by byte. start, length and period are those of the
    sharpest run, null without any; the digests are of all runs, a line `start,length,period` each, and of the words
    that stay when each run keeps its first period, joined by a space. `plan` may rearrange a text before: of an id and
    the number of words it makes the numbers of the words to take, or None for the text as it is. Null, empty and
    wordless texts have no words and no runs. Rows that repeat are looked at each by itself; ids may be null. An empty
    table gives no rows; other columns are not read, so their names cannot clash."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                ids, texts, codes, known = batch.column("doc_id").to_pylist(), [], [], {}
                for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                    words = (text or "").encode().split()  # bytes part at just these six characters
                    code = numbered(words, known)
                    taken = plan(doc_id, len(words)) if plan else None
                    if taken is not None:
                        words, code = [words[i] for i in taken.tolist()], code[taken]
                    texts.append(words)
                    codes.append(code)
                rows = [(i, *row_of(words, runs)) for i, words, runs in zip(ids, texts, find_runs(codes))]
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                names = ["doc_id", *(c.split()[0] for c in OUT.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return own.mapInArrow(run, f"doc_id long, {OUT}").withColumnRenamed("doc_id", id_col)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule: every tenth text by hash ends in a repetition of a part of itself."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plan=planted)

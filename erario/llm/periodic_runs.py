"""Periodic runs of words: suffix trees of a text and its reversal, Lyndon roots as candidates, extended both ways.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(LEAST, 2 q)`` that no neighbouring word extends.  Every such run is found from a
Lyndon root: the longest Lyndon word that starts somewhere, in the order of the words or in
the inverted one.  How far a root's period reaches is two questions for the longest common
extension of two places, one forward and one backward; each is the depth of the lowest
common ancestor of two leaves in a suffix tree, found in constant time in its Euler tour.

Only words that some repeated stretch of ``GRAM`` words covers can be in a run: a run has
length - q >= GRAM words that come again q words later, and these two copies cover it.  The
trees are built for the covered stretches, one by one; each run lies inside one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.llm.common import crc_sql, raw_texts, rows

LEAST = 12
GRAM = LEAST // 2
COVERED = re.compile(b"\1{%d,}" % LEAST)
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)
RUNS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers, read as an Euler tour of its leaves.

    Nodes are rows of arrays: an edge's first and last place, a suffix link.  The sequence is
    closed by -1, which stands before every other number.  After building, ``leaf_at`` has the
    place of each suffix in the tour, and ``tour`` the depth where the tour turns between two
    leaves; the least depth between two leaves is that of their lowest common ancestor.
    """

    def __init__(self, numbers: list[int]):
        text = [*numbers, -1]
        self.size = len(text)
        starts, ends, links, child = self._build(text)
        self._walk(text, starts, ends, child)

    @staticmethod
    def _build(text: list[int]) -> tuple[array, array, array, dict[int, int]]:
        size = len(text)
        width = max(text) + 2
        starts, ends, links = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}  # node * width + number + 1 -> the node below
        find = child.get
        node = edge = length = rest = 0
        for place, number in enumerate(text):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = place
                key = node * width + text[edge] + 1
                below = find(key)
                if below is None:
                    child[key] = len(starts)
                    starts.append(place)
                    ends.append(size)
                    links.append(0)
                    if last:
                        links[last] = node
                        last = 0
                else:
                    start = starts[below]
                    span = min(ends[below], place + 1) - start
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[start + length] == number:
                        if last:
                            links[last] = node
                        length += 1
                        break
                    split = len(starts)
                    child[key] = split
                    starts.append(start)
                    ends.append(start + length)
                    links.append(0)
                    child[split * width + number + 1] = split + 1
                    starts.append(place)
                    ends.append(size)
                    links.append(0)
                    starts[below] = start + length
                    child[split * width + text[start + length] + 1] = below
                    if last:
                        links[last] = split
                    last = split
                rest -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = place - rest + 1
        return starts, ends, links, child

    def _walk(self, text: list[int], starts: array, ends: array, child: dict[int, int]) -> None:
        width, size = max(text) + 2, self.size
        keys = np.fromiter(child, np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # by node, then by the number that the edge starts with
        first = np.searchsorted(keys[order], np.arange(len(starts) + 1, dtype=np.int64) * width).tolist()
        below = below[order].tolist()
        leaves, turns = [], []
        turn = 0
        stack = [(0, 0, first[0])]
        while stack:
            node, depth, at = stack.pop()
            if at + 1 < first[node + 1]:
                stack.append((node, depth, at + 1))
            lower = below[at]
            reach = depth + min(ends[lower], size) - starts[lower]
            turns.append(turn)
            while first[lower] < first[lower + 1]:  # down the first edges to a leaf
                if first[lower] + 1 < first[lower + 1]:
                    stack.append((lower, reach, first[lower] + 1))
                lower = below[first[lower]]
                reach += min(ends[lower], size) - starts[lower]
            leaves.append(size - reach)
            turn = stack[-1][1] if stack else 0
        self.leaf_at = np.empty(size, np.int64)
        self.leaf_at[leaves] = np.arange(size)
        least = [np.array(turns, np.int32)]  # turns[i]: between leaf i - 1 and leaf i
        while 2 << (len(least) - 1) <= size:
            half = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-half], least[-1][half:]))
        self.least = least

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extension of the suffixes at unlike places ``a`` and ``b``: two lookups each."""
        x, y = self.leaf_at[a], self.leaf_at[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for power in np.unique(level):
            own = level == power
            table = self.least[power]
            out[own] = np.minimum(table[low[own]], table[high[own] + 1 - (1 << int(power))])
        return out


def lyndon_roots(rank: list[int]) -> Iterator[tuple[int, int]]:
    """``start, end`` of the longest Lyndon words from each start, in both orders, from the ranks of the suffixes.

    Such a word ends where the next smaller suffix starts.  The end of the text, the last
    rank, is smaller than every suffix in the plain order and greater in the inverted one.
    """
    size = len(rank) - 1
    for sign in (1, -1):
        stack: list[int] = []
        for place in range(size, -1, -1):
            own = sign * rank[place]
            while stack and sign * rank[stack[-1]] > own:
                stack.pop()
            if stack and place < size and (sign > 0 or stack[-1] < size):
                yield place, stack[-1]
            stack.append(place)


def runs_of(numbers: list[int]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of a sequence of numbers from 0, by start and period."""
    size = len(numbers)
    if size < LEAST:
        return []
    forward = SuffixTree(numbers)
    start, end = np.array(list(lyndon_roots(forward.leaf_at.tolist())), np.int64).reshape(-1, 2).T
    period = end - start
    fits = 2 * period <= size
    start, end, period = start[fits], end[fits], period[fits]
    ahead = np.where(end < size, forward.common(start, np.minimum(end, size)), 0)
    del forward
    backward = SuffixTree(numbers[::-1])
    inner = start > 0
    behind = np.zeros(len(start), np.int64)
    behind[inner] = backward.common(size - start[inner], size - end[inner])
    first, length = start - behind, period + ahead + behind
    good = length >= np.maximum(LEAST, 2 * period)
    return sorted(set(zip(first[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)), key=lambda run: (run[0], run[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Equal words have equal numbers, in the order of first sight."""
    known: dict[bytes, int] = {}
    return [known.setdefault(word, len(known)) for word in words]


def covered(numbers: list[int]) -> list[tuple[int, int]]:
    """Stretches of at least ``LEAST`` words in which every word is in a stretch of ``GRAM`` words that the text repeats."""
    size = len(numbers) - GRAM + 1
    if size < 2:
        return []
    ids = np.array(numbers, np.uint64)
    mixed = np.zeros(size, np.uint64)
    for i in range(GRAM):
        mixed = (mixed ^ ids[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]  # unlike stretches of one hash only add words
    if not same.any():
        return []
    change = np.zeros(len(numbers) + 1, np.int64)
    repeated = np.union1d(order[1:][same], order[:-1][same])
    change[repeated] += 1
    change[repeated + GRAM] -= 1
    return [m.span() for m in COVERED.finditer((np.cumsum(change[:-1]) > 0).astype(np.uint8).tobytes())]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of a text's words, by start and period."""
    if len(words) < LEAST:
        return []
    numbers = numbered(words)
    if max(numbers) == len(numbers) - 1:
        return []
    return [(lo + start, length, period) for lo, hi in covered(numbers) for start, length, period in runs_of(numbered(numbers[lo:hi]))]


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth id, by its CRC-32, made periodic from some place on; those of other ids as they are, as of null ids."""
    crc = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if crc % 10 or not words:
        return words
    turn, size = crc // 10, len(words)
    start = turn % size
    period = 1 + (size - start) // (3 + turn % 8)
    return words[:start] + [words[start + k % period] for k in range(size - start)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept)]


def _each(batch: pa.RecordBatch, planted: bool) -> Iterator[tuple[int | None, list[bytes], list[tuple[int, int, int]]]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
        words = text.split()  # bytes part at 09-0D and 20 alone
        words = repeating(doc_id, words) if planted else words
        yield doc_id, words, find_runs(words)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """``doc_id, start, length, period`` of every run of every document; ``planted`` makes some texts periodic first (``repeating``).

    A null or empty text has no runs; repeated rows give their runs each; other columns are not read.
    """

    def find(batches):
        for batch in batches:
            found = [(doc_id, *run) for doc_id, _, runs in _each(batch, planted) for run in runs]
            yield rows(RUNS, **dict(zip(RUNS.names, zip(*found, strict=True), strict=True))) if found else rows(RUNS, **{name: [] for name in RUNS.names})

    return _read(docs).mapInArrow(find, "doc_id long, start long, length long, period long")


def run_digest(docs: DataFrame, planted: bool = True) -> DataFrame:
    """One row a document: the number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the text without repeats.

    A null or empty text has no words, no runs and the digests of nothing; the words of a null
    id are never made periodic; repeated rows count each; other columns are not read.
    """

    def judge(batches):
        for batch in batches:
            out = {name: [] for name in FOUND.names}
            for doc_id, words, runs in _each(batch, planted):
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listing = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
                values = (doc_id, len(runs), start, length, period, length and 1000 * length // period, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())
                for name, value in zip(FOUND.names, values, strict=True):
                    out[name].append(value)
            yield rows(FOUND, **out)

    return _read(docs).mapInArrow(judge, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


RUN_SQL = rf"""
WITH own AS (
  SELECT row_number() OVER () AS r, doc_id, {crc_sql("doc_id")} AS crc, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
parted AS (SELECT *, len(ws) AS n, crc // 10 AS g FROM own),
planted AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM parted WHERE crc % 10 = 0 AND n > 0),
texts AS (
  SELECT r, doc_id, n, list_transform(generate_series(0, n - 1), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS ws FROM planted
  UNION ALL
  SELECT r, doc_id, n, ws FROM parted WHERE crc % 10 <> 0 OR crc IS NULL OR n = 0),
grams AS (SELECT r, i, array_to_string(ws[i + 1:i + 6], ' ') AS gram FROM (SELECT r, ws, unnest(generate_series(0, n - 6)) AS i FROM texts WHERE n >= 12)),
repeats AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 5 AS equal FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM repeats) GROUP BY r, q, island),
runs AS (SELECT r, start, equal + q AS length, min(q) AS period FROM stretches WHERE equal >= q AND equal + q >= 12 GROUP BY r, start, equal + q),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing FROM runs GROUP BY r),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1),
dropped AS (SELECT DISTINCT r, unnest(generate_series(start + period, start + length - 1)) AS i FROM runs),
words AS (SELECT r, unnest(generate_series(0, n - 1)) AS i, unnest(ws) AS word FROM texts WHERE n > 0),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listing, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept USING (r)
"""

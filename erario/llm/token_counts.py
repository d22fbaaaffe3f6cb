"""Token counts by byte-pair merging over a heap and a linked list."""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.llm.common import Memo, rows, texts

# The pre-tokenizer pattern of the byte-level vocabulary (white space by the Unicode property).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: No piece reaches over the end of one of these; ``re`` finds them faster and they repeat often.
STRETCHES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that ``re`` takes for white space and the Unicode property does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the symbols that are left of a text when no pair of the merge list is adjacent any more."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids = model["vocab"]
        self.first = [ids[letter] for letter in byte_letters()]
        pairs = (merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"])
        self.ranks = {ids[a] << 20 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = [token["content"] for token in content["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.stretches = Memo(self.of_stretch)

    def of_piece(self, piece: bytes) -> int:
        """Symbols at first less the merges made; the lowest rank goes first, the leftmost of equals."""
        n = len(piece)
        symbols, ranks, after, before = [self.first[b] for b in piece], self.ranks, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] << 20 | symbols[i + 1]
            if pair in ranks:
                heap.append((ranks[pair][0], i, pair))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << 20 | symbols[j] != pair:
                continue  # one side has gone into another symbol
            symbols[i], symbols[j] = ranks[pair][1], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (new := symbols[i] << 20 | symbols[k]) in ranks:
                    heapq.heappush(heap, (ranks[new][0], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] << 20 | symbols[i]) in ranks:
                heapq.heappush(heap, (ranks[new][0], h, new))
        return n - merges

    def of_stretch(self, stretch: str) -> int:
        return sum(self.of_piece(piece.encode()) for piece in PIECES.findall(stretch))

    def of_text(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            found = PIECES.findall(part) if SEPARATORS.search(part) else STRETCHES.findall(part)
            total += sum(map(self.stretches.__getitem__, found))
        return total


@functools.cache
def counter(path: str) -> MergeCounter:
    """Loaded once in each Python worker."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Texts are cut into the vocabulary's pieces and each piece is merged by rank over a heap
    and a linked list; only counts leave the merge, never identifiers.  Repeated stretches
    are counted once a worker, in a memo of bounded size.  The map has no shuffle, so a lost
    executor costs its own tasks alone.

    A null or empty text has 0 bytes and 0 tokens.  A special string inside a text is one
    token.  Repeated rows and null ids give one row each; other columns are not read.
    """

    def count(batches):
        merger = counter(path)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield rows(SCHEMA, doc_id=batch.column("doc_id"), n_bytes=size, n_tokens=[merger.of_text(text) for text in texts(batch)])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

"""Line deduplication: two Bloom filters find lines that may repeat; only those are shuffled and counted exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.llm.common import TRIMMED, raw_texts, rows
from erario.sources.writers import written

SHORTEST_KEY = 20
LEAST_DOCUMENTS = 3
#: Bits of each filter: it never grows with the data.  A full filter lets more lines through to the exact count, never fewer.
FILTER_BITS = 2**26
CHUNKS = 64
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINES = pa.schema([("doc_id", pa.int64()), ("key", pa.string())])
CLEANED = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])


def keys(text: bytes) -> list[bytes]:
    """The key of each line of a text in UTF-8, where ``lower`` changes A-Z alone."""
    return [line.strip(TRIMMED.encode()) for line in text.lower().split(b"\n")]


def repeatable(text: bytes) -> set[bytes]:
    """The distinct keys of a text that are long enough to be dropped; a character has four bytes at most."""
    return {key for key in keys(text) if len(key) >= SHORTEST_KEY and (len(key) >= 4 * SHORTEST_KEY or len(key.decode()) >= SHORTEST_KEY)}


class Filters:
    """Bits of lines seen once and of lines seen in two documents or more; two places a line, from one hash."""

    def __init__(self, once: np.ndarray | None = None, twice: np.ndarray | None = None):
        self.once = np.zeros(FILTER_BITS // 64, np.uint64) if once is None else once
        self.twice = np.zeros(FILTER_BITS // 64, np.uint64) if twice is None else twice

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([hashes % np.uint64(FILTER_BITS), (hashes >> np.uint64(32)) % np.uint64(FILTER_BITS)])
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    @classmethod
    def holds(cls, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        word, bit = cls.places(hashes)
        return ((bits[word] & bit) != 0).reshape(2, -1).all(axis=0)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of a batch, each once a document."""
        distinct, count = np.unique(hashes, return_counts=True)
        again = distinct[(count > 1) | self.holds(self.once, distinct)]
        for bits, new in ((self.twice, again), (self.once, distinct)):
            word, bit = self.places(new)
            np.bitwise_or.at(bits, word, bit)


def hashed(found: set[bytes] | list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(key) for key in found]


def suspect_bits(docs: DataFrame) -> np.ndarray:
    """The filter of lines seen in two documents or more.

    Each task fills a pair; a bit is set for "twice" if one task saw it twice or two tasks saw
    it.  Pairs travel in compressed chunks and are merged chunk by chunk, so neither a task
    nor the driver holds more than a pair of the fixed size.
    """
    size = FILTER_BITS // 64 // CHUNKS

    def fill(batches):
        own, some = Filters(), False
        for batch in batches:
            found = [h for text in raw_texts(batch) for h in hashed(repeatable(text))]
            if found:
                own.add(np.array(found, np.uint64))
                some = True
        for chunk in range(CHUNKS if some else 0):
            part = slice(chunk * size, (chunk + 1) * size)
            packed = [[zlib.compress(bits[part].tobytes(), 1)] for bits in (own.once, own.twice)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *map(pa.array, packed)], names=["chunk", "once", "twice"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice"), strict=True):
                new = np.frombuffer(zlib.decompress(a.as_py()), np.uint64)
                twice |= (once & new) | np.frombuffer(zlib.decompress(b.as_py()), np.uint64)
                once |= new
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(twice.tobytes(), 1)])], names=["chunk", "twice"])

    pairs = docs.select(F.col("text").cast("string")).mapInArrow(fill, "chunk long, once binary, twice binary")
    merged = pairs.groupBy("chunk").applyInArrow(merge, "chunk long, twice binary").collect()  # CHUNKS rows at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in merged:
        bits[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint64)
    return bits


def suspects(docs: DataFrame) -> DataFrame:
    """``doc_id, key``: once a document, every line that may stand in two or more."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(suspect_bits(docs))  # of the fixed size FILTER_BITS

    def select(batches):
        bits = shared.value
        for batch in batches:
            ids, found, of = batch.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, raw_texts(batch), strict=True):
                own = repeatable(text)
                found.extend(own)
                of.extend([doc_id] * len(own))
            keep = np.flatnonzero(Filters.holds(bits, np.array(hashed(found), np.uint64))) if found else ()
            yield rows(LINES, doc_id=[of[i] for i in keep], key=pa.array([found[i] for i in keep], pa.binary()).cast(pa.string()))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(select, "doc_id long, key string")


def dropped_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, keys``: the line keys that each document loses.

    Suspects are counted by whole key; a key of enough documents stays only in the largest
    doc_id.  The count is summed before the shuffle and stored, so the join back is a plain one
    that Spark splits where a key is hot.
    """
    found = written(suspects(docs), "suspects")
    counted = found.groupBy("key").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper")).filter(F.col("documents") >= LEAST_DOCUMENTS)
    counted = written(counted, "counted")
    lost = found.join(counted, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _with_lost(docs: DataFrame) -> DataFrame:
    lost = dropped_keys(docs).select(F.col("doc_id").alias("__lost_id"), F.col("keys").alias("__lost"))
    return docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost["__lost_id"]), "left").drop("__lost_id")


def rewritten(text: bytes, lost: list[str] | None) -> tuple[int, bytes]:
    """How many lines go, and what stays of a text."""
    if not lost:
        return 0, text
    gone, lines = {key.encode() for key in lost}, text.split(b"\n")
    kept = [line for line, key in zip(lines, keys(text), strict=True) if key not in gone]
    return len(lines) - len(kept), b"\n".join(kept)


def clean_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every document.

    Null and empty texts have one empty line, which stays.  A null doc_id counts as the
    smallest.  Repeated rows are documents of their own: each counts, and rows that share the
    keeping doc_id all keep the line.  Other columns are not read; no rows give no rows.
    """

    def rewrite(batches):
        for batch in batches:
            own = raw_texts(batch)
            done = [rewritten(text, lost) for text, lost in zip(own, batch.column("__lost").to_pylist(), strict=True)]
            yield rows(CLEANED, doc_id=batch.column("doc_id"), n_lines=[text.count(b"\n") + 1 for text in own], n_dropped=[n for n, _ in done], kept_text=pa.array([kept for _, kept in done], pa.binary()).cast(pa.string()))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_lost(own).mapInArrow(rewrite, "doc_id long, n_lines long, n_dropped long, kept_text string")


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns as they are, but texts without the lines that go, and ``n_chars``, where there, counted anew."""

    def rewrite(batches):
        for batch in batches:
            lost = batch.column("__lost").to_pylist()
            batch = batch.drop_columns(["__lost"])
            old = batch.column("text").to_pylist()
            new = [text if text is None or not gone else rewritten(text.encode(), gone)[1].decode() for text, gone in zip(old, lost, strict=True)]
            changed = {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column("n_chars").to_pylist(), strict=True)]
                changed["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([changed.get(name, batch.column(name)) for name in batch.schema.names], schema=batch.schema)

    return _with_lost(docs).mapInArrow(rewrite, docs.schema)


def line_digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH lines AS (SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
               FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY rid
"""

"""Exact deduplication after Grace: records are parted by hash until a bucket fits a table that compares whole contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.llm.common import TRIMMED, raw_texts, rows
from erario.sources.writers import written

BUCKET_BYTES = 16 * 2**20
#: A task folds equal records in a table of so many bytes before they travel.
FOLD_BYTES = 64 * 2**20
DIGEST_BITS = 60
FOLDED = pa.schema([("digest", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("n", pa.int64()), ("best_chars", pa.int64()), ("best_id", pa.int64())])
FOLDED_SQL = "digest string, content binary, size long, n long, best_chars long, best_id long"
KEPT = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("keep_chars", pa.int64()), ("group_size", pa.int64())])


class ContentTable:
    """Open addressing with linear probing; a slot is taken as equal only if the whole contents are."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.digests: list[str] = []
        self.contents: list[bytes] = []
        self.n: list[int] = []
        self.best: list[tuple[int, int | None]] = []
        self.bytes = 0

    def _slot(self, key: int, content: bytes | None) -> int:
        """The slot of the equal content, or the free one where it goes; without content, the first free one."""
        at, last = key & (len(self.slots) - 1), len(self.slots) - 1
        while (entry := self.slots[at]) >= 0:
            if content is not None and self.hashes[entry] == key and self.contents[entry] == content:
                break
            at = (at + 1) & last
        return at

    def add(self, digest: str, content: bytes, n: int, chars: int, doc_id: int | None) -> None:
        key = int(digest[:15], 16)
        at = self._slot(key, content)
        if (entry := self.slots[at]) >= 0:
            self.n[entry] += n
            self.best[entry] = max(self.best[entry], (chars, doc_id), key=_rank)
            return
        self.slots[at] = len(self.contents)
        for column, value in ((self.hashes, key), (self.digests, digest), (self.contents, content), (self.n, n), (self.best, (chars, doc_id))):
            column.append(value)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for entry, key in enumerate(self.hashes):
                self.slots[self._slot(key, None)] = entry


def _rank(best: tuple[int, int | None]) -> tuple:
    """More characters first, then the smaller id, null last."""
    chars, doc_id = best
    return chars, doc_id is not None, -(doc_id or 0)


def folded(docs: DataFrame) -> DataFrame:
    """One row for each distinct content of a task, however often it stands there."""

    def fold(batches):
        table = ContentTable()

        def flush():
            chars, ids = zip(*table.best, strict=True)
            return rows(FOLDED, digest=table.digests, content=table.contents, size=list(map(len, table.contents)), n=table.n, best_chars=chars, best_id=ids)

        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            for doc_id, chars, text in zip(batch.column("doc_id").to_pylist(), lengths, raw_texts(batch), strict=True):
                content = text.translate(None, TRIMMED.encode())
                table.add(hashlib.sha256(content).hexdigest(), content, 1, chars, doc_id)
                if table.bytes > FOLD_BYTES:
                    yield flush()
                    table = ContentTable()
        if table.contents:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fold, FOLDED_SQL)


def bucketed(records: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Records with ``bucket``: bits of the hash, more of them where a bucket would not fit.

    Only sizes and digests are read to part them.  A bucket above the bound with more than
    one digest is parted in four, again and again; one content alone is one table entry.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    bits = max(0, (total // bucket_bytes).bit_length())
    number = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    placed = records.withColumn("bits", F.lit(bits))
    while bits < DIGEST_BITS:
        prefix = F.shiftright(number, DIGEST_BITS - bits)
        sizes = placed.filter(F.col("bits") == bits).groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("bytes"), F.min("digest").alias("least"), F.max("digest").alias("most"))
        large = written(sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("least") < F.col("most"))).select("prefix", F.lit(bits).alias("at_bits")), "large")
        if large.isEmpty():
            break
        placed = placed.join(large, (F.col("bits") == F.col("at_bits")) & (prefix == F.col("prefix")), "left")
        bits += 2
        placed = placed.withColumn("bits", F.when(F.col("at_bits").isNull(), F.col("bits")).otherwise(bits)).drop("prefix", "at_bits")
    return placed.withColumn("bucket", F.concat_ws(":", "bits", F.expr(f"shiftright(conv(substring(digest, 1, 15), 16, 10)::long, {DIGEST_BITS} - bits)")))


def kept_rows(records: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_chars, group_size`` of every distinct content."""

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in ("digest", "content", "n", "best_chars", "best_id")), strict=True):
                table.add(*values)
        chars, ids = zip(*table.best, strict=True)
        yield rows(KEPT, digest=table.digests, keep_id=ids, keep_chars=chars, group_size=table.n)

    return records.select("bucket", *FOLDED.names).groupBy("bucket").applyInArrow(settle, "digest string, keep_id long, keep_chars long, group_size long")


def dedup_exact(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every document.

    Texts are equal when their contents without blanks are.  Tasks fold equal contents before
    anything travels, so a group of copies arrives as one record a task; records are stored,
    parted into buckets of bounded size and compared in full.  Documents then look up their
    content's row by digest; a hot digest is a plain join key that Spark splits.

    A null text equals the empty text.  A null doc_id counts as the largest.  Rows that share
    the keeping doc_id and length are all kept.  Other columns are not read; no rows give none.
    """
    records = bucketed(written(folded(docs), "records"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"), F.sha2(F.translate(text, TRIMMED, ""), 256).alias("text_sha256"))
    groups = kept_rows(records).withColumnRenamed("digest", "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return own.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


EXACT_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (SELECT content, count(*) AS group_size, max(chars) AS most FROM t GROUP BY content),
k AS (SELECT t.content, min(doc_id) AS keep_id FROM t JOIN g ON t.content = g.content AND t.chars = g.most GROUP BY t.content)
SELECT doc_id, keep_id, group_size, coalesce(doc_id IS NOT DISTINCT FROM keep_id AND chars = most, false) AS kept, sha256(t.content) AS text_sha256
FROM t JOIN g USING (content) JOIN k USING (content)
"""

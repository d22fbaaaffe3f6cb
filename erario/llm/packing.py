"""Harmonic packing: pieces of reciprocal-capacity classes, a fixed number of pieces to every bin of a class."""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erario.llm.common import Memo, rows, texts
from erario.llm.token_counts import byte_letters
from erario.sources.writers import written

CAPACITY = 2048
#: What is left of a document below this length stays one piece.
SHORTEST_CUT = 64
#: Pieces of a class are numbered in groups of about so many.
GROUP_PIECES = 4096
#: Separators that Python alone takes for white space; letters that it lower-cases by their place.
ODD = re.compile("[\x1c-\x1f\u03a3\u0130]")
MARKS = ".,;:!?|"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("tail", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tail binary"


class WordIds:
    """Identifiers of whole texts, as little-endian unsigned 32-bit numbers.

    The vocabulary lower-cases, parts words at white space and drops it, so runs without white
    space are encoded by themselves and once a worker.  A run of letters, with or without marks
    after it, is one word of the vocabulary's model and one of marks.  Texts on which Python
    and the vocabulary might part or lower-case unlike each other are encoded whole, and so are
    texts with a special string in any case: the vocabulary finds those before it lower-cases.
    """

    def __init__(self, path: str, last: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.last = Tokenizer.from_file(path), np.array([last], "<u4").tobytes()
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.special = re.compile("|".join(re.escape(token.content.lower()) for token in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.words, self.marks, self.runs = Memo(self.of_word, 300_000), Memo(self.encoded, 10_000), Memo(self.of_run, 150_000)

    def encoded(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def of_word(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([token.id for token in self.model.tokenize(spelled)], "<u4").tobytes()

    def of_run(self, run: str) -> bytes:
        word = run.rstrip(MARKS)
        if not word.isalpha():
            return self.encoded(run)
        return self.words[word] + (self.marks[run[len(word) :]] if len(word) < len(run) else b"")

    def of_text(self, text: str) -> bytes:
        lower = text.lower()
        if ODD.search(text) or self.special.search(lower) or not unicodedata.is_normalized("NFC", text):
            return self.encoded(text) + self.last
        return b"".join([*map(self.runs.__getitem__, lower.split()), self.last])


@functools.cache
def word_ids(path: str, last: int) -> WordIds:
    return WordIds(path, last)


def cuts(n: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids: whole bins, then halves, quarters ... down to
    the shortest cut, then the rest; so every length is a whole fraction of the capacity or short."""
    found, at, size = [], 0, CAPACITY
    while size >= SHORTEST_CUT:
        while n - at >= size:
            found.append((at, size))
            at += size
        size //= 2
    return found + [(at, n - at)] * (at < n)


def pieces(docs: DataFrame, path: str, last: int = 1) -> DataFrame:
    """All pieces of all documents with their checksums; ``tail`` holds the identifiers of short ones, which may be cut again."""

    def cut(batches):
        words = word_ids(path, last)
        for batch in batches:
            out = {name: [] for name in SCHEMA.names}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), map(words.of_text, texts(batch)), strict=True):
                n = len(ids) // 4
                for start, length in cuts(n):
                    part = ids[4 * start : 4 * (start + length)]
                    for name, value in zip(SCHEMA.names, (doc_id, start, length, zlib.crc32(part), n, part if length < SHORTEST_CUT else None), strict=True):
                        out[name].append(value)
            yield rows(SCHEMA, **out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def numbered(cut: DataFrame) -> DataFrame:
    """``place``: the number of a piece within its class (all pieces of one length), from 0, and ``n``, the size of the class.

    A class may hold most pieces, so it is numbered in hashed groups of bounded size; the
    groups' counts, summed up in order, shift each group's own numbers.
    """
    groups = max(1, cut.count() // GROUP_PIECES)
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    counts = cut.groupBy("length", "group").agg(F.count("*").alias("own"))
    in_order = Window.partitionBy("length").orderBy("group")
    counts = counts.withColumn("shift", F.sum("own").over(in_order) - F.col("own")).withColumn("n", F.sum("own").over(Window.partitionBy("length")))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")) - 1
    return cut.withColumn("own_place", own).join(counts.drop("own"), ["length", "group"]).withColumn("place", F.col("shift") + F.col("own_place"))


def harmonic(cut: DataFrame) -> DataFrame:
    """Sequences for pieces: ``floor(capacity / length)`` pieces of a class make a bin, whichever worker holds them.

    A class's last bin, if not full, is split into sequences whose lengths are powers of two,
    which need no padding; short pieces across a border are cut there.
    """
    long = lambda x: F.lit(x).cast("long")
    length, class_base = F.col("length"), F.shiftleft(F.col("length"), 44)
    bin_size = F.floor(long(CAPACITY) / length).cast("long")
    placed = numbered(cut).withColumn("bin", F.floor(F.col("place") / bin_size).cast("long")).withColumn("full", F.floor(F.col("n") / bin_size).cast("long"))
    whole = placed.filter("bin < full").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (class_base + F.col("bin")).alias("sequence_id"), ((F.col("place") - F.col("bin") * bin_size) * length).alias("offset"),
    )
    rest = placed.filter("bin >= full").withColumn("total", (F.col("n") - F.col("full") * bin_size) * length).withColumn("at", (F.col("place") - F.col("full") * bin_size) * length)
    bits = [2**b for b in range(CAPACITY.bit_length() - 1, -1, -1)]
    segments = F.filter(
        F.array(*[F.struct(long(i).alias("no"), (F.floor(F.col("total") / (2 * b)) * (2 * b)).cast("long").alias("from"), long(b).alias("size"), (F.col("total").bitwiseAND(b) > 0).alias("there")) for i, b in enumerate(bits)]),
        lambda s: s["there"] & (s["from"] < F.col("at") + length) & (F.col("at") < s["from"] + s["size"]),
    )
    parted = rest.withColumn("s", F.explode(segments)).withColumn("lo", F.greatest("at", "s.from")).withColumn("hi", F.least(F.col("at") + length, F.col("s.from") + F.col("s.size")))
    part = F.col("hi") - F.col("lo")
    again = F.crc32(F.substring(F.col("tail"), (4 * (F.col("lo") - F.col("at")) + 1).cast("int"), (4 * part).cast("int")))
    parted = parted.select(
        "doc_id", (F.col("start") + F.col("lo") - F.col("at")).alias("start"), part.alias("length"), F.when(part == length, F.col("ids_crc32")).otherwise(again).alias("ids_crc32"), "doc_tokens",
        (class_base + F.col("full") + F.col("s.no")).alias("sequence_id"), (F.col("lo") - F.col("s.from")).alias("offset"),
    )
    return whole.unionByName(parted)


def pack(docs: DataFrame, path: str, last: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: every identifier of every text in one place of one sequence.

    Texts are encoded once; their pieces, without identifiers, are stored in the shared
    folder and numbered from there.  Sequences hold at most 2048 identifiers; the padding is
    at most 62 places in a sequence of short pieces.

    A null or empty text has the closing identifier alone.  Repeated rows are documents of
    their own; null ids are kept; other columns are not read; no rows give no sequences.
    """
    return harmonic(written(pieces(docs, path, last), "pieces"))

"""Top-k of many questions over a large corpus in one pass.

Questions are packed into blocks, one row a block, and stay a table.  Each task packs its
part of the corpus into chunks and meets the blocks by key.  A single block meets the corpus
where it lies.  Several divide the work into a grid: corpus rows are parted by the hash of
their id, blocks into columns of ``HELD_BLOCKS``, and a task joins one part with one column.
A chunk is scored
against a block at a time, and a task keeps the k best rows per question.  The shuffle that
follows carries k rows per question and task.
"""

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from erario.sources.writers import written

BLOCK_QUESTIONS = 2048
CHUNK_CELLS = 2_000_000
CHUNK_ROWS = 2048
#: Blocks whose state a task holds at once; the best rows of the one unused for longest are passed on.
HELD_BLOCKS = 32
#: Pairs that one cell of the grid is to score, and the number below which a search is not divided into ``SMALL_CELLS`` parts.
CELL_PAIRS, SMALL_PAIRS, SMALL_CELLS = 2**30, 2**26, 16
BROADCAST_BYTES = 8 << 20
NOT_A_CANDIDATE = -(2**62)


def _best_per_column(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best candidates per column; equal scores prefer the earlier row."""
    rows, columns = scores.shape
    rank = np.where(scores == NOT_A_CANDIDATE, NOT_A_CANDIDATE, scores * rows) - np.arange(rows)[:, None]
    order = np.argpartition(-rank, min(k, rows) - 1, axis=0)[:k]
    column = np.broadcast_to(np.arange(columns), order.shape)
    keep = scores[order, column] != NOT_A_CANDIDATE
    return order[keep], column[keep]


class _Best:
    """The k best (question, id, score) rows of one block of questions so far."""

    def __init__(self, block: pd.DataFrame, score: Callable, k: int):
        self.labels, self.score, self.k = block["id_consulta"].to_numpy(), score, k
        self.floor = np.full(len(block), NOT_A_CANDIDATE)
        self.pool: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, rows: pa.RecordBatch) -> None:
        step = max(1, CHUNK_CELLS // len(self.labels))
        for start in range(0, rows.num_rows, step):
            chunk = rows.slice(start, step)
            scores = self.score(chunk)
            row, column = np.nonzero((scores >= self.floor) & (scores != NOT_A_CANDIDATE))
            if len(row) > self.k * len(self.labels):
                row, column = _best_per_column(scores, self.k)
                good = scores[row, column] >= self.floor[column]
                row, column = row[good], column[good]
            ids = chunk.column("id").to_numpy(zero_copy_only=False)[row]
            self.pool.append(pd.DataFrame({"q": column, "id": ids, "pontos": scores[row, column]}))
            self.waiting += len(row)
            if self.waiting > 2 * self.k * len(self.labels):
                best = self._pruned()
                full = best.groupby("q")["pontos"].agg(["size", "min"]).query("size == @self.k")
                self.floor[full.index] = full["min"]
                self.pool, self.waiting = [best], 0

    def _pruned(self) -> pd.DataFrame:
        ordered = pd.concat(self.pool).sort_values(["q", "pontos", "id"], ascending=[True, False, True])
        return ordered.groupby("q", sort=False).head(self.k)

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        best = self._pruned()
        columns = [self.labels[best["q"]], best["id"].to_numpy(), best["pontos"].to_numpy()]
        return pa.RecordBatch.from_arrays([pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema)


def _packed(rows: pa.RecordBatch) -> bytes:
    """A batch as one binary value, which Spark moves without looking into it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def _running_topk(scorer: Callable, k: int, schema: pa.Schema) -> Callable:
    """A partition function over (chunk, block) rows that keeps the k best rows per question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, _Best] = OrderedDict()
        for batch in batches:
            blocks = batch.column("_bloco").to_pylist()
            for i, name in enumerate(blocks):
                if name not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield held.popitem(last=False)[1].found(schema)
                    block = _unpacked(batch.column("_perguntas")[i]).to_pandas()
                    held[name] = _Best(block, scorer(block), k)
                held.move_to_end(name)
                held[name].add(_unpacked(batch.column("_linhas")[i]).sort_by("id"))
        for best in held.values():
            yield best.found(schema)

    return run


def _chunks(corpus: DataFrame, parts: int) -> DataFrame:
    """(_parte, _linhas): the rows of each task, packed by the part their id falls in, in chunks of bounded length."""

    def chunk(rows: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        for start in range(0, rows.num_rows, CHUNK_ROWS):
            packed = _packed(rows.slice(start, CHUNK_ROWS).combine_chunks().to_batches()[0])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["_parte", "_linhas"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting)
            part = rows.column("_parte").to_numpy()
            for i in np.unique(part):
                yield from chunk(rows.drop_columns("_parte").take(pa.array(np.flatnonzero(part == i))), int(i))
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= CHUNK_ROWS * min(parts, 16):
                yield from flush()
        if waiting:
            yield from flush()

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return corpus.withColumn("_parte", part).mapInArrow(pack, "_parte int, _linhas binary")


def question_blocks(questions: DataFrame) -> tuple[DataFrame, int, int]:
    """(_coluna, _bloco, _perguntas): the questions in packed blocks of about ``BLOCK_QUESTIONS``, written once; ``id_consulta`` is unique.  With the number of columns and of questions."""
    stored = written(questions, "perguntas")
    number = stored.count()
    blocks = max(1, -(-number // BLOCK_QUESTIONS))
    columns = -(-blocks // HELD_BLOCKS)
    hashed = stored.select(F.pmod(F.xxhash64("id_consulta"), F.lit(blocks)).alias("_bloco"), F.struct("*").alias("_pergunta"))
    gathered = hashed.groupBy("_bloco").agg(F.collect_list("_pergunta").alias("_perguntas"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column("_bloco").to_pylist()):
                block = _packed(pa.RecordBatch.from_struct_array(batch.column("_perguntas")[i].values))
                yield pa.RecordBatch.from_arrays([pa.array([name % columns], pa.int32()), pa.array([name], pa.int64()), pa.array([block], pa.binary())], names=["_coluna", "_bloco", "_perguntas"])

    return written(gathered.mapInArrow(pack, "_coluna int, _bloco long, _perguntas binary"), "blocos"), columns, number


def _met(corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """(_linhas, _bloco, _perguntas): every chunk with every block, a cell of the grid in one task."""
    blocks, columns, number = question_blocks(questions)
    pairs = corpus.count() * number if number > BLOCK_QUESTIONS else 0
    parts = max(-(-pairs // columns // CELL_PAIRS), min(SMALL_CELLS, pairs // SMALL_PAIRS), 1)
    chunks = _chunks(corpus, parts).withColumn("_coluna", F.explode(F.array([F.lit(i) for i in range(columns)])))
    cell = ["_parte", "_coluna"]
    if parts * columns > 1:
        chunks = chunks.repartition(parts * columns, *cell)
    if (blocks.agg(F.sum(F.octet_length("_perguntas"))).first()[0] or 0) <= BROADCAST_BYTES:
        met = chunks.join(F.broadcast(blocks), "_coluna")
    else:
        copies = blocks.withColumn("_parte", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = chunks.join(copies.hint("merge"), cell)
    return met.select("_linhas", "_bloco", "_perguntas")


def ranked_scan(corpus: DataFrame, questions: DataFrame, scorer: Callable[[pd.DataFrame], Callable[[pa.RecordBatch], np.ndarray]], k: int) -> DataFrame:
    """(id_consulta, id, pontos, posicao): the k best corpus rows of every question.

    ``scorer`` turns a question block into a function from a corpus chunk to an
    integer score matrix (rows x questions, NOT_A_CANDIDATE where a pair is out).
    The scan reads the corpus once, however many blocks there are; several also count its rows.
    """
    schema = StructType(
        [
            StructField("id_consulta", questions.schema["id_consulta"].dataType),
            StructField("id", corpus.schema["id"].dataType),
            StructField("pontos", LongType()),
        ]
    )
    found = _met(corpus, questions).mapInArrow(_running_topk(scorer, k, to_arrow_schema(schema)), schema)
    order = Window.partitionBy("id_consulta").orderBy(F.desc("pontos"), F.asc("id"))
    return found.withColumn("posicao", F.row_number().over(order)).filter(F.col("posicao") <= k)

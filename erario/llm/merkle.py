"""A Merkle manifest of a dataset as a persistent tree: a changed leaf makes a version that copies its ancestors alone.

Leaves of one language stand in the order of their ids; every ``FAN`` consecutive nodes have
one parent.  The tree is kept in aligned blocks of ``FAN ** STOREY`` nodes, one row each, and
the roots of the blocks are the nodes of the next storey.  A version of the tree holds a
changed leaf and new ancestors up to the root; all other nodes are those of the first tree.
Its ancestors inside the leaf's block come from that block's row, those above it from the
path of siblings that the upper storeys hand down to the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.llm.common import LOWER, UPPER, crc_sql
from erario.sources.writers import written

FAN, STOREY = 8, 3
BLOCK = FAN**STOREY
#: The tree over the subroots has this name; a language's tree is named "=" and the language, that of null "".
TOP = "top"
STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
CLIMBED = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("path", pa.list_(STEP))])
CLIMBED_DDL = "tree string, place long, block long, size long, digest string, path array<struct<before:string,after:string>>"
NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string())])
ROOT = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
VERSION = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("leaf_place", pa.int64()), ("level", pa.int32()), ("digest", pa.string())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(size: int) -> int:
    """Levels between ``size`` nodes and a single one, at most a storey's."""
    levels, reach = 0, 1
    while reach < size and levels < STOREY:
        levels, reach = levels + 1, reach * FAN
    return levels


def levels(nodes: list[str], size: int) -> list[list[str]]:
    """A block's nodes, their parents and so on, in a storey of ``size`` nodes; the last list holds the block's root."""
    out = [nodes]
    for _ in range(height(size)):
        out.append([digest("".join(out[-1][i : i + FAN])) for i in range(0, len(out[-1]), FAN)])
    return out


def steps(block: list[list[str]], place: int) -> list[tuple[str, str]]:
    """For each level, the siblings before and after a node's ancestor: what a copied path shares with the first tree."""
    out = []
    for level in block[:-1]:
        first = place - place % FAN
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + FAN])))
        place //= FAN
    return out


def copied(leaf: str, path: list[tuple[str, str]]) -> list[str]:
    """The nodes of a version: the leaf and its new ancestors; the last one is the version's root."""
    out = [leaf]
    for before, after in path:
        out.append(digest(before + out[-1] + after))
    return out


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, changed``: digests of the rows as they are and, where 3 divides the CRC-32 of the id, with the text's A-Z lower-cased."""
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    fields = [_field(c) for c in (own, F.col("source"), F.col("lang"), F.col("n_chars").cast("long"))]
    leaf = F.sha2(F.concat(*fields, _field(text)), 256)
    tampered = F.sha2(F.concat(*fields, _field(F.translate(text, UPPER, LOWER))), 256)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), own.alias("doc_id"), leaf.alias("leaf"), F.when(F.crc32(own.cast("string")) % 3 == 0, tampered).alias("changed")
    )


def placed(items: DataFrame, *order: str) -> DataFrame:
    """Stored ``items`` with their ``place`` from 0 in the order of their ``tree`` and the tree's ``size``.

    Ranges of the order are sorted each for itself; a range's first place follows from the
    counts of the ranges before it.  A drawn number parts equal rows over ranges.
    """
    keys = ["tree", *order, F.rand(7)]
    laid = written(items.repartitionByRange(*keys).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "laid").withColumn("range", F.shiftright("at", 33))
    ranges = laid.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("range")) - F.col("n")
    starts = ranges.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return laid.join(starts, ["tree", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def blocks_of(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row for each aligned block: ``tree, block, size, nodes``."""
    own = F.sort_array(F.collect_list(F.struct("place", *carried)))
    return nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("size").alias("size"), own.alias("nodes"))


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that a task holds one block as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the siblings of its ancestors in the block, and the block's root."""
    for row in each(batches):
        block, out = levels([n["digest"] for n in row["nodes"]], row["size"]), []
        for i, node in enumerate(row["nodes"]):
            path = [{"before": before, "after": after} for before, after in steps(block, i)]
            out.append({"tree": row["tree"], "place": node["place"], "block": row["block"], "size": -(-row["size"] // BLOCK), "digest": block[-1][0], "path": path})
        yield pa.RecordBatch.from_pylist(out, CLIMBED)


@dataclass
class Storeys:
    """The storeys above some nodes, the lowest first: their blocks, each tree's root, and every node's ``path`` to it."""

    blocks: list[DataFrame]
    roots: DataFrame
    paths: DataFrame


def grow(nodes: DataFrame) -> Storeys:
    """Storeys above ``tree, place, size, digest`` until each tree has a single root; as many rounds as the largest tree has storeys."""
    blocks, climbed = [], []
    while True:
        blocks.append(written(blocks_of(nodes, "digest"), "upper"))
        climbed.append(written(blocks[-1].mapInArrow(climb, CLIMBED_DDL), "climbed"))
        nodes = climbed[-1].filter(F.col("place") % BLOCK == 0).select("tree", F.col("block").alias("place"), "size", "digest")
        if (nodes.agg(F.max("size")).first()[0] or 1) == 1:
            break
    paths = climbed[-1].select("tree", "place", "path")
    for storey in climbed[-2::-1]:
        above = paths.select("tree", F.col("place").alias("block"), F.col("path").alias("above"))
        paths = storey.join(above, ["tree", "block"]).select("tree", "place", F.concat("path", "above").alias("path"))
    return Storeys(blocks, nodes.select("tree", "digest"), paths)


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in each(batches):
        root = levels([n["leaf"] for n in row["nodes"]], row["size"])[-1][0]
        yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "place": row["block"], "size": -(-row["size"] // BLOCK), "digest": root}], ROOT)


@dataclass
class Manifest:
    """The first tree of a dataset; its versions and proofs are tables worked out from it.

    ``ranks`` has each language's tree and the place of its subroot in the tree ``TOP``.
    """

    leaf_blocks: DataFrame
    upper: Storeys
    top: Storeys
    ranks: DataFrame

    def nodes(self) -> DataFrame:
        """``tree, level, place, digest`` of the first tree; level 0 holds leaves, in the tree ``TOP`` subroots."""
        out = self._nodes(self.leaf_blocks, "leaf", 0, lowest=True)
        for storey, blocks in enumerate(self.upper.blocks):
            out = out.unionByName(self._nodes(blocks, "digest", storey + 1, lowest=False))
        for storey, blocks in enumerate(self.top.blocks):
            out = out.unionByName(self._nodes(blocks, "digest", storey, lowest=storey == 0))
        return out

    @staticmethod
    def _nodes(blocks: DataFrame, name: str, storey: int, lowest: bool) -> DataFrame:
        def spread(batches):
            for row in each(batches):
                start, out = row["block"] * BLOCK, []
                for i, level in enumerate(levels(row["nodes"], row["size"])):
                    if i or lowest:  # the storey below has an upper storey's lowest level
                        out += [{"tree": row["tree"], "level": storey * STOREY + i, "place": start + k, "digest": node} for k, node in enumerate(level)]
                    start //= FAN
                yield pa.RecordBatch.from_pylist(out, NODE)

        return blocks.select("tree", "block", "size", F.col(f"nodes.{name}").alias("nodes")).mapInArrow(spread, "tree string, level int, place long, digest string")

    def _whole(self) -> DataFrame:
        """Leaf blocks with the rest of their paths, their subroot and the root."""
        above = self.upper.paths.select("tree", F.col("place").alias("block"), F.col("path").alias("above"))
        last = self.top.paths.select(F.col("place").alias("rank"), F.col("path").alias("last"), F.col("tree").alias("top"))
        root = self.top.roots.select(F.col("tree").alias("top"), F.col("digest").alias("root"))
        ends = self.upper.roots.withColumnRenamed("digest", "subroot").join(self.ranks, "tree").join(last, "rank").join(root, "top")
        return self.leaf_blocks.join(above, ["tree", "block"]).join(ends, "tree").select("tree", "block", "size", "nodes", F.concat("above", "last").alias("above"), "subroot", "root")

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf."""

        def prove(batches):
            for row in each(batches):
                block = levels([n["leaf"] for n in row["nodes"]], row["size"])
                above = [(s["before"], s["after"]) for s in row["above"]]
                rest, out = "".join(before + after for before, after in above), []
                for i, node in enumerate(row["nodes"]):
                    path = steps(block, i)
                    proof = digest("".join(before + after for before, after in path) + rest)
                    folded = copied(node["changed"] or node["leaf"], path + above)[-1]
                    out.append({"doc_id": node["doc_id"], "leaf": node["leaf"], "subroot": row["subroot"], "root": row["root"], "proof_sha256": proof, "folded_root": folded, "verified": folded == row["root"]})
                yield pa.RecordBatch.from_pylist(out, PROOF)

        return self._whole().mapInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")

    def versions(self) -> DataFrame:
        """``doc_id, tree, leaf_place, level, digest``: the nodes that each changed leaf's version copies; all others are those of the first tree.

        Levels count from the leaf; the last node of a version is its root.
        """

        def version(batches):
            for row in each(batches):
                block = levels([n["leaf"] for n in row["nodes"]], row["size"])
                above, out = [(s["before"], s["after"]) for s in row["above"]], []
                for i, node in enumerate(row["nodes"]):
                    if node["changed"] is not None:
                        path = copied(node["changed"], steps(block, i) + above)
                        out += [{"doc_id": node["doc_id"], "tree": row["tree"], "leaf_place": node["place"], "level": level, "digest": made} for level, made in enumerate(path)]
                yield pa.RecordBatch.from_pylist(out, VERSION)

        return self._whole().mapInArrow(version, "doc_id long, tree string, leaf_place long, level int, digest string")


def build(docs: DataFrame) -> Manifest:
    """The manifest of all ``docs``.

    Null ids stand before others; rows of one id go by their digest.  A null id is never
    tampered with; a null in another column counts as ``-``, which no value gives.  Null and
    empty languages have trees of their own.  Other columns are not read; no rows give none.
    """
    ordered = placed(written(leaves(docs), "leaves"), "doc_id", "leaf")
    leaf_blocks = written(blocks_of(ordered, "doc_id", "leaf", "changed"), "blocks")
    upper = grow(written(leaf_blocks.mapInArrow(_block_roots, "tree string, place long, size long, digest string"), "nodes"))
    ranked = written(placed(written(upper.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("own"), "digest"), "subroots"), "own"), "ranked")
    return Manifest(leaf_blocks, upper, grow(ranked.select("tree", "place", "size", "digest")), ranked.select(F.col("own").alias("tree"), F.col("place").alias("rank")))


def prove_documents(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and the root that its possibly tampered row folds to."""
    return build(docs).proofs()


PROOF_SQL = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, lang, text, {crc_sql('doc_id')} AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS fields
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(fields || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM own),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, p, leaf AS h, n FROM ordered
  UNION ALL
  SELECT tree, level + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, p // 8, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, p, h, n FROM subroots
  UNION ALL
  SELECT level + 1, p // 8, sha256(string_agg(h, '' ORDER BY p)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, p // 8, n),
steps AS (
  SELECT 'tree ' || tree AS tree, level, p, n FROM nodes UNION ALL SELECT 'top', level, p, n FROM tops),
siblings AS (
  SELECT s.tree, s.level, s.p, s.n, coalesce(string_agg(o.h, '' ORDER BY o.p) FILTER (o.p < s.p), '') AS before, coalesce(string_agg(o.h, '' ORDER BY o.p) FILTER (o.p > s.p), '') AS after
  FROM steps s JOIN (SELECT 'tree ' || tree AS tree, level, p, h FROM nodes UNION ALL SELECT 'top', level, p, h FROM tops) o ON o.tree = s.tree AND o.level = s.level AND o.p // 8 = s.p // 8
  WHERE s.n > 1 GROUP BY ALL),
low AS (
  SELECT tree, p AS spot, 0 AS level, p, n, coalesce(changed, leaf) AS h, '' AS proof FROM ordered
  UNION ALL
  SELECT l.tree, spot, l.level + 1, l.p // 8, (l.n + 7) // 8, sha256(before || h || after), proof || before || after
  FROM low l JOIN siblings s ON s.tree = 'tree ' || l.tree AND s.level = l.level AND s.p = l.p WHERE l.n > 1),
high AS (
  SELECT l.tree, spot, 0 AS level, r.p, r.n, l.h, proof FROM low l JOIN subroots r ON r.tree = l.tree WHERE l.n = 1
  UNION ALL
  SELECT l.tree, spot, l.level + 1, l.p // 8, (l.n + 7) // 8, sha256(before || h || after), proof || before || after
  FROM high l JOIN siblings s ON s.tree = 'top' AND s.level = l.level AND s.p = l.p WHERE l.n > 1)
SELECT o.doc_id, o.leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM ordered o JOIN subroots r USING (tree) JOIN tops t ON t.n = 1 JOIN high f ON f.tree = o.tree AND f.spot = o.p AND f.n = 1
"""

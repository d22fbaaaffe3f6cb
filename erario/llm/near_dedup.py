"""MinHash near-deduplication: bottom-k sketches from one hash function, inverted lists, exact verification.

A sketch holds the k smallest hashes of a document's shingles.  Its neighbouring values are
the keys of the inverted lists: runs of three among the first 48, for sets of fewer than ten
shingles runs of two as well.  Larger sets that are alike at just 0.8 share no run of three
with a chance of about 4e-8, which falls fast as texts are more alike.
Lists give candidates in rounds, nodes against hubs, so that groups of copies never give all
their pairs.  Between rounds, nodes are joined as far as two links reach; the components come
from all confirmed links at the end.  What the rounds leave in different components is
compared pair by pair in short lists; in long ones whole sets meet by their rarest shingles,
which loses no link.  This last round asks the whole sets alone, so that what an estimate
ruled out before is tested after all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erario.llm.common import Memo, fresh, raw_texts, rows
from erario.llm.components import near_roots, roots
from erario.sources.writers import written

SKETCH = 64
#: Sketch values whose runs of ``RUN`` neighbours are list keys; sets of fewer than ``TINY`` shingles also have runs of two.
KEYED, RUN, TINY = 48, 3, 10
#: Pairs whose estimate lies so far under the threshold wait for the last round.
SLACK = 0.25
STAR_ROUNDS = 2
#: Lists of up to so many nodes are compared pair by pair at the end, longer ones by their rarest shingles.
SHORT = 16
NODE_BYTES = 12
#: Bits of a set's parities: how often, even or odd, its shingles fall into each of so many hash classes.
PARITIES = 512
SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sketch", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64())), ("parities", pa.list_(pa.int64()))])


class Shingler:
    """Distinct hashes of the word shingles of a text."""

    def __init__(self, width: int):
        self.width = width
        self.word = Memo(lambda word: xxhash.xxh3_64_intdigest(word))

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # on bytes: A-Z alone change, blanks 09-0D and 20 part
        if not words:
            return np.empty(0, np.int64)
        values = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ values[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((mixed ^ (mixed >> np.uint64(31))).view(np.int64))


def node_of(hashes: np.ndarray) -> bytes:
    """The name of a set of shingles: texts with equal sets are one node."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=NODE_BYTES).digest()


def parities(hashes: np.ndarray) -> np.ndarray:
    """One bit for each hash class; the classes in which two sets differ are at most as many as the shingles that only one of them has."""
    odd = np.bincount(hashes & (PARITIES - 1), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, node, sketch`` of every document; without words the node and the sketch are null."""

    def sign(batches):
        shingler = Shingler(width)
        for batch in batches:
            out = {name: [] for name in SIGNED.names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                found = shingler.hashes(text)
                values = (doc_id, len(found), node_of(found), found[:SKETCH]) if len(found) else (doc_id, 0, None, None)
                for name, value in zip(SIGNED.names, values, strict=True):
                    out[name].append(value)
            yield rows(SIGNED, **out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, "doc_id long, n_shingles long, node binary, sketch array<long>")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """``key, node, n_shingles, company``: the lists with two nodes or more; ``company`` is the summed length of a node's lists.

    In a group of copies the text they were made from shares the most runs, so it keeps the most company.
    """
    values = F.slice("sketch", 1, KEYED)

    def runs(length: int) -> Column:
        last = F.size(values) - length
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(values, i + 1, length)))).otherwise(F.array().cast("array<long>"))

    keys = F.when(F.col("n_shingles") < TINY, F.concat(runs(RUN), runs(2))).otherwise(runs(RUN))
    listed = nodes.filter("n_shingles > 1").select("node", "n_shingles", F.explode(keys).alias("key"))
    shared = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    listed = written(listed.join(shared, "key"), "listed")
    company = listed.groupBy("node").agg(F.sum("n").alias("company"))
    return listed.join(company, "node").select("key", "node", "n_shingles", "company")


def likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sizes allow a link and whose union sketch, the k smallest values of both, does not rule it out."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return joined.filter(shared / F.size(union) >= threshold - SLACK).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, shingles, parities``: the whole sets of the wanted nodes, from the text of one document of each."""

    def collect(batches):
        shingler = Shingler(width)
        for batch in batches:
            found = [shingler.hashes(text) for text in raw_texts(batch)]
            yield rows(SETS, node=[node_of(x) for x in found], shingles=found, parities=[parities(x) for x in found])

    ids = nodes.join(wanted, "node").select(F.col("rep").alias("wanted_id")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(ids, own["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")
    return texts.mapInArrow(collect, "node binary, shingles array<long>, parities array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets have ``100 * intersection >= percent * union``."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - shared
    return pairs.join(a, "a").join(b, "b").filter(100 * shared >= percent * union).select("a", "b")


def _ordered_pair(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def star_pairs(lists: DataFrame, labels: DataFrame, tested: DataFrame | None, turn: int) -> DataFrame:
    """Nodes with hubs of their lists in other components.

    At first a list's hub is the node that keeps the most company, and a node takes the best
    of its hubs alone.  Later each component of a list draws one node of it, and these meet
    that of the list's largest component: a pair for each component, not for each node.
    """
    named = lists.join(labels, "node")
    if turn == 0:
        first = F.min(F.struct((-F.col("company")).alias("order"), F.col("node").alias("hub"), F.col("component").alias("hub_component")))
        hubs = written(named.groupBy("key").agg(first.alias("h"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most").select("key", "h.*"), "hubs")
        met = named.join(hubs, "key").filter(F.col("component") != F.col("hub_component")).select("node", "order", *_ordered_pair(F.col("node"), F.col("hub")))
        return met.groupBy("node").agg(F.min(F.struct("order", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("order"), "node"))["node"]
    parts = written(named.groupBy("key", "component").agg(F.count("*").alias("n"), drawn.alias("node")), "parts")
    largest = F.max(F.struct("n", "component", "node")).alias("m")
    hubs = written(parts.groupBy("key").agg(largest, F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("m.component").alias("hub_component"), F.col("m.node").alias("hub")), "hubs")
    met = parts.join(hubs, "key").filter(F.col("component") != F.col("hub_component")).select(*_ordered_pair(F.col("node"), F.col("hub"))).distinct()
    return met if tested is None else met.join(tested, ["a", "b"], "left_anti")


def remaining_pairs(docs: DataFrame, nodes: DataFrame, lists: DataFrame, labels: DataFrame, tested: DataFrame | None, width: int, percent: int) -> DataFrame:
    """The pairs of a list in different components that were not tested: of a short list all, of a long one those that may reach the threshold."""
    named = lists.join(labels, "node")
    mixed = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("length")).filter("least != most").select("key", "length")
    mixed = written(named.join(mixed, "key"), "open")
    short = mixed.filter(F.col("length") <= SHORT)
    other = short.select("key", F.col("node").alias("b"), F.col("component").alias("other"), F.col("n_shingles").alias("n_b"))
    fits = 100 * F.least("n_shingles", "n_b") >= percent * F.greatest("n_shingles", "n_b")
    few = short.withColumnRenamed("node", "a").join(other, "key").filter((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & fits).select("a", "b")
    crowd = mixed.filter(F.col("length") > SHORT).select("node").distinct()
    crowd = written(full_sets(docs, crowd, nodes, width), "crowd").join(labels, "node")
    pairs = few.unionByName(prefix_pairs(crowd, percent)).distinct()
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``node, shingles, component`` in different components whose whole sets may reach the threshold; none that does is missing.

    Shingles are taken in one order, the rarest first.  A pair that reaches the threshold has
    its first common shingle among the rarest of both, so early that enough shingles follow in
    each: a text whose own wording fills more than that is paired with none of its group.
    Parities of the whole sets bound their difference from below, which rules out most pairs
    of a group that differ in more than a link allows.
    """
    single = sets.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = single.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    ordered = single.join(held, "shingle").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("common"))
    own = F.col("n") - F.size("common")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own
    first = ordered.filter(length > 0).select("node", "component", "n", own.alias("own"), F.posexplode(F.slice("common", F.lit(1), length.cast("int"))).alias("place", "c"))
    left = first.select(F.col("c.shingle").alias("shingle"), "node", "component", "n", (F.col("n") - F.col("own") - F.col("place")).alias("left"))
    left = written(left.join(sets.select("node", "parities"), "node"), "prefixes")
    a, b = (left.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "left", "parities")]) for x in "ab")
    both = F.col("n_a") + F.col("n_b")
    enough = F.least("left_a", "left_b") * (100 + percent) >= percent * both
    apart = sum((F.bit_count(F.col("parities_a")[i].bitwiseXOR(F.col("parities_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
    close = (both - apart) * (100 + percent) >= 2 * percent * both
    met = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & enough & close
    return a.join(b, "shingle").filter(met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links as ``a, b`` of the components of their ends."""
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    return links.join(a, "a").join(b, "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def merged(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """The labels with components named after those they were joined to."""
    joined = joined.withColumnsRenamed({"a": "component", "b": "root"})
    return labels.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, first`` and ``node`` of every document; ``first`` marks the node whose smallest doc_id names the component, nulls last."""
    threshold = percent / 100
    signed = written(signatures(docs, width), "signed")
    nodes = written(signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "nodes")
    lists = written(inverted_lists(nodes), "lists")
    labels = written(lists.select("node").distinct().withColumn("component", F.col("node")), "labels")
    tested = links = None
    for turn in range(STAR_ROUNDS + 1):
        last = turn == STAR_ROUNDS
        close = written(remaining_pairs(docs, nodes, lists, labels, tested, width, percent) if last else likely(written(star_pairs(lists, labels, tested, turn), "pairs"), nodes, threshold), "close")
        if close.isEmpty():
            continue
        tested = close if tested is None else tested.unionByName(close)  # what the estimate rules out may come again in the last round
        wanted = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
        linked = written(verified(close, written(full_sets(docs, wanted, nodes, width), "sets"), percent), "linked")
        links = linked if links is None else links.unionByName(linked)
        if not last:
            labels = written(merged(labels, near_roots(between(linked, labels))), "labels")
    if links is not None:
        labels = merged(labels, roots(between(links, labels)))
    named = nodes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "node")).alias("least")
    of_component = written(named.groupBy("component").agg(least), "components")  # stored, so that a hot component's join can be split
    of_node = named.join(of_component, "component").select("node", F.col("least.rep").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first"))
    found = signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "node", component.alias("component_id"), "first")


def link(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents are linked when the Jaccard index of their sets of ``width``-word shingles is
    at least ``percent`` hundredths; ``component_id`` is the smallest doc_id that links lead
    to.  Equal sets are one node from the start, so exact copies are never paired.

    A text with fewer words is one shingle; a null or empty one has none and is linked with
    nothing.  Repeated rows are copies; a null doc_id is larger than any other and a component
    of null ids has a null name.  Other columns are not read; no rows give none.
    """
    found = members(docs, width, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: of each group of near copies the one with the smallest doc_id; all columns as they were.

    Null ids come last.  Where an id stands for one row, or for rows that all go, the id
    decides; rows of other ids, null among them, are told apart by their sets of shingles
    and, where these are equal, by a hash of the row: one stays.  Documents without words
    are in no group and all stay.
    """
    alone = F.col("n_shingles") == 0
    stays = alone | (F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    judged = written(members(docs, width, percent).select("doc_id", "node", alone.alias("alone"), stays.alias("stays")), "judged")
    ids = judged.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.bool_and("stays").alias("all"), F.sum((F.col("stays") & ~F.col("alone")).cast("long")).alias("staying"))
    (judged_id,) = fresh(docs.columns, "judged_id")
    ids = ids.select(F.col("doc_id").alias(judged_id), F.col("some"), (F.col("some") & (~F.col("all") | (F.col("staying") > 1))).alias("unsure"))
    ids = written(ids.filter(F.col("unsure") | ~F.col("some") | F.col(judged_id).isNull()), "ids")
    own = F.col("doc_id").cast("long")
    unnamed = ids.filter(F.col(judged_id).isNull()).first()  # null ids are one row here and join nothing
    named = docs.filter(own.isNotNull()) if unnamed else docs
    decided = ids.filter(F.col(judged_id).isNotNull()).select(judged_id, "unsure")
    unsure = decided.filter("unsure").select(judged_id)
    kept = named.join(decided.select(judged_id), own == F.col(judged_id), "left_anti")
    rest = [] if unsure.isEmpty() else [named.join(unsure, own == F.col(judged_id), "left_semi")]
    if unnamed and unnamed.unsure:
        rest.append(docs.filter(own.isNull()))
    elif unnamed and unnamed.some:
        kept = kept.unionByName(docs.filter(own.isNull()))
    for part in rest:
        kept = kept.unionByName(first_rows(part, judged, width))
    return kept


def first_rows(docs: DataFrame, judged: DataFrame, width: int) -> DataFrame:
    """The documents whose ``doc_id, node`` stays, one of each; those without words all stay."""
    row_node, row_place, staying_id, staying_node = fresh(docs.columns, "row_node", "row_place", "staying_id", "staying_node")
    schema = T.StructType([*docs.schema.fields, T.StructField(row_node, T.BinaryType())])

    def name(batches):
        shingler = Shingler(width)
        for batch in batches:
            found = [shingler.hashes(text) for text in raw_texts(batch)]
            nodes = pa.array([node_of(x) if len(x) else None for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, row_node])

    noded = docs.mapInArrow(name, schema)
    staying = judged.filter("stays AND NOT alone").select(F.col("doc_id").alias(staying_id), F.col("node").alias(staying_node)).distinct()
    own = F.col("doc_id").cast("long")
    worded = noded.join(staying, (F.col(row_node) == F.col(staying_node)) & own.eqNullSafe(F.col(staying_id)), "left_semi")
    content = F.xxhash64("text", *[F.to_json(F.struct(field.name)) for field in docs.schema.fields if field.name != "text"])
    first = worded.withColumn(row_place, F.row_number().over(Window.partitionBy(own, row_node).orderBy(content))).filter(F.col(row_place) == 1)
    return first.select(*docs.columns).unionByName(noded.filter(F.col(row_node).isNull()).select(*docs.columns))


LINK_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS sh FROM w),
nodes AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM sets WHERE len(sh) > 0 GROUP BY sh),
single AS (SELECT rep, n, unnest(sh) AS s FROM nodes),
df AS (SELECT s, count(*) AS c FROM single GROUP BY s),
ranked AS (SELECT rep, n, s, row_number() OVER (PARTITION BY rep ORDER BY c, s) AS r FROM single JOIN df USING (s)),
prefix AS (SELECT rep, n, s FROM ranked WHERE r <= n - (8 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM (SELECT a, b, x.n AS na, y.n AS nb, len(list_intersect(x.sh, y.sh)) AS i FROM cand JOIN nodes x ON x.rep = a JOIN nodes y ON y.rep = b) WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS c FROM nodes UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.a),
comp AS (SELECT a AS rep, min(c) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN nodes n ON n.sh = s.sh LEFT JOIN comp c ON c.rep = n.rep
"""

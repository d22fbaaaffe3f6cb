"""Mixing sources to target weights over fixed-length blocks, with DataFrame operations alone.

The documents of a source, end to end, are a row of words cut into blocks of fixed length.
Output shards draw how many slots each source gets; a source's slots are numbered and mapped
to its blocks by a pseudorandom permutation of the block numbers, a new one for every pass;
the blocks' use is joined back to documents by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erario.llm.common import fresh, hex_number, word_count
from erario.sources.writers import written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix against all documents, as a fraction.
SHARE = (3, 2)
#: No source and no document gives more than so many times its size.
MOST = 2
BLOCK_WORDS = 256
SHARD_SLOTS = 65_536
#: Slots are mapped to blocks in runs of at most so many, dealt out over the tasks.
TASK_SLOTS = 16_384
GROUP_DOCS = 2048
ROUNDS = 6
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source: ``no`` in order of names, documents, words and target words.

    A target is ``level * weight``, or the source's limit where that is less; the level is the
    one at which the targets add up to the mix.  Sources come by limit over weight: those
    before the first that the level does not fill are at their limits.
    """
    one = F.lit(0)  # the table of sources has one row a source, so one task sorts it
    names = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    sources = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).withColumn("no", F.row_number().over(names) - 1)
    sources = sources.withColumn("weight", F.get(weights, F.col("no") % len(WEIGHTS)).cast("double")).withColumn("limit", (F.col("source_size") * MOST).cast("double"))
    by_limit = Window.partitionBy(one).orderBy(F.col("limit") / F.col("weight"), "no")
    everything = Window.partitionBy(one)
    sources = sources.withColumn("mix", F.sum("source_size").over(everything) * SHARE[0] / SHARE[1])
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("try", (F.col("mix") - F.col("full")) / F.col("left"))
    level = F.min(F.when(F.col("try") * F.col("weight") <= F.col("limit"), F.struct("full", "no", "try"))).over(everything)["try"]
    target = F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return sources.select("no", "source", "docs", "source_size", target.alias("target"), F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long").alias("blocks"))


def shuffled(place: Column, n: Column, key: Column) -> Column:
    """A permutation of ``0..n-1`` chosen by ``key``: rounds that swap a place with its partner, or do not, as a hash decides."""

    def swapped(at: Column, turn: Column) -> Column:
        seed = F.concat(key, F.lit(":"), turn.cast("string"), F.lit(":"))
        partner = F.pmod(hex_number(seed, 12) - at, n)
        swap = F.substring(F.md5(F.concat(seed, F.greatest(at, partner).cast("string"))), 1, 1) < "8"
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), place, swapped)


def draws(sources: DataFrame) -> DataFrame:
    """``shard, no, first, slots``: what each output shard draws from each source.

    Shards draw multinomial counts by systematic sampling: one hashed number a shard shifts
    the sources' shares, so that a count's mean is its share and it is within one slot of it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("no")
    exact = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") * 65536)).otherwise(0).cast("long")
    shares = sources.withColumn("part", exact).withColumn("upper", F.sum("part").over(order)).withColumn("sum", F.sum("part").over(Window.partitionBy(F.lit(0))))
    shares = shares.filter("sum > 0 and part > 0").withColumn("total", F.ceil(F.col("sum") / 65536).cast("long"))
    shards = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / SHARD_SLOTS).cast("long"))
    drawn = shares.withColumn("shard", F.explode(shards)).withColumn("width", F.least(F.lit(SHARD_SLOTS).cast("long"), F.col("total") - F.col("shard") * SHARD_SLOTS))
    shift = hex_number(F.concat(F.lit(f"{SEED}:shard:"), F.col("shard").cast("string")), 8) / F.lit(4294967296.0)

    def below(edge: Column) -> Column:
        return F.floor(F.col("width") * (edge / F.col("sum").cast("double")) + shift).cast("long")

    drawn = drawn.withColumn("slots", below(F.col("upper")) - below(F.col("upper") - F.col("part")))
    return drawn.withColumn("first", F.sum("slots").over(Window.partitionBy("no").orderBy("shard")) - F.col("slots")).select("shard", "no", "blocks", "first", "slots")


def mixed_slots(sources: DataFrame) -> DataFrame:
    """``shard, no, slot, block``: the mix itself, a source's block for every slot; no block comes more than ``MOST`` times."""
    last = F.least(F.col("first") + F.col("slots"), F.col("blocks") * MOST) - 1
    words = sources.agg(F.sum("target")).first()[0] or 0
    tasks = max(1, int(words / BLOCK_WORDS / TASK_SLOTS))
    edges = F.sequence(F.col("first"), F.col("last"), F.lit(TASK_SLOTS).cast("long"))
    drawn = draws(sources).withColumn("last", last).filter(F.col("first") <= F.col("last")).withColumn("first", F.explode(edges))
    drawn = drawn.withColumn("last", F.least("last", F.col("first") + TASK_SLOTS - 1)).repartition(tasks, "no", "first")
    slots = drawn.withColumn("slot", F.explode(F.sequence("first", "last")))
    key = F.concat(F.lit(f"{SEED}:"), F.col("no").cast("string"), F.lit(":"), F.floor(F.col("slot") / F.col("blocks")).cast("string"))
    return slots.select("shard", "no", "slot", shuffled(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with ``start``, the number of their first word in their source.

    A source is laid out in hashed groups of about ``GROUP_DOCS`` documents, so a hot source
    is many tasks' work; the groups' sizes, summed up in order, shift each group.
    """
    joined = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    groups = F.floor(F.col("docs") / GROUP_DOCS).cast("long") + 1
    rows = [c for c in ("row", "row_more") if c in sizes.columns]
    name = F.concat_ws(":", F.col("doc_id").cast("string"), *rows)
    spread = joined.withColumn("group", hex_number(name, 8) % groups)
    counts = spread.groupBy("no", "group").agg(F.sum("size").alias("words"))
    shift = F.sum("words").over(Window.partitionBy("no").orderBy("group")) - F.col("words")
    shifted = counts.select("no", "group", shift.alias("shift"))
    own = F.sum("size").over(Window.partitionBy("no", "group").orderBy("doc_id", "size", *rows).rowsBetween(Window.unboundedPreceding, -1))
    return spread.withColumn("own", F.coalesce(own, F.lit(0))).join(shifted, ["no", "group"]).withColumn("start", F.col("shift") + F.col("own"))


def _taken_parts(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents' parts by block with the number of ``uses`` of the block in the mix."""
    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    uses = mixed_slots(sources).groupBy("no", "block").agg(F.count("*").alias("uses"))
    lo, hi = F.greatest("start", F.col("block") * BLOCK_WORDS), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    # The uses come from a table of a few rows that was spread out, so Spark thinks them small; they grow with the documents.
    joined = parts.join(uses.hint("merge"), ["no", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)).cast("long"))
    return joined.withColumn("part_start", lo - F.col("start")).withColumn("part_words", hi - lo)


def _placed(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    sizes = written(sizes, "sizes")
    sources = written(source_targets(sizes), "sources")
    return written(laid_out(sizes, sources), "placed"), sources


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    A null text has no words and gives none; a null source is a source of its own, after all
    others.  Repeated rows and null ids are documents of their own, laid out by size.  Draws
    and permutations come from hashes of fixed keys, so reruns agree.  No rows give no rows;
    other columns are not read.
    """
    placed, sources = _placed(sized(docs))
    columns = ["doc_id", "size", "source_size", "target"]
    some = _taken_parts(placed, sources).groupBy("no", "start", *columns).agg(F.sum(F.col("uses") * F.col("part_words")).alias("taken"))
    none = placed.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return some.select(*columns, "taken").unionByName(none)


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row, 128 bits: rows that share them are taken as equal."""
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    return [F.xxhash64(F.lit(seed), F.col("text").isNull(), "text", others) for seed in (1, 2)]


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each text holds the words that the mix takes, with the blanks before them.

    A document that is taken whole once stays as it is, one that is not taken at all goes, a
    block taken twice stands twice in a row.  ``n_chars``, where there, is counted anew.  Every
    row has a plan of its own, found by hashes of the whole row, so null and repeated ids are
    documents like others; rows equal in all columns share their plans out among them.  A
    text without words stays as it is; no rows give none.
    """
    names = fresh(docs.columns, "row", "row_more", "parts", "kept_text")
    row, row_more, planned, kept_text = names
    keys = _row_keys(docs)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), keys[0].alias("row"), keys[1].alias("row_more"))
    placed, sources = _placed(sizes)
    uses = F.array_sort(F.collect_list(F.struct("part_start", "part_words", "uses")))
    plans = _taken_parts(placed, sources).groupBy("row", "row_more", "no", "start").agg(uses.alias("parts"))
    plans = plans.unionByName(placed.filter("size = 0").select("row", "row_more", "no", "start", F.lit(None).cast(plans.schema["parts"].dataType).alias("parts")))
    plans = written(plans.select(F.col("row").alias(row), F.col("row_more").alias(row_more), F.col("parts").alias(planned)), "plans")
    repeated = written(plans.groupBy(row, row_more).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    own = docs.withColumns({row: keys[0], row_more: keys[1]})
    if repeated.isEmpty():
        joined = own.join(plans, [row, row_more])
    else:  # of equal rows one meets all their plans
        single = own.join(repeated, [row, row_more], "left_anti").join(plans.join(repeated, [row, row_more], "left_anti"), [row, row_more])
        several = own.join(repeated, [row, row_more], "left_semi").dropDuplicates([row, row_more]).join(plans.join(repeated, [row, row_more], "left_semi"), [row, row_more])
        joined = single.unionByName(several)
    parts = F.col(planned)
    joined = joined.filter(parts.isNull() | F.exists(parts, lambda p: p["uses"] > 0))
    whole = parts.isNull() | F.forall(parts, lambda p: p["uses"] == 1)

    def slices(words: Column) -> Column:
        part = lambda p: F.slice(words, (p["part_start"] + 1).cast("int"), p["part_words"].cast("int"))
        return F.array_join(F.flatten(F.transform(parts, lambda p: F.flatten(F.array_repeat(part(p), p["uses"].cast("int"))))), "")

    # A blank before the text lets every word bring one; the result's first blank goes again.
    words = F.regexp_extract_all(F.concat(F.lit("\n"), F.col("text")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    taken = F.transform(F.array(words), slices)[0]  # so that a text is split once, not once a part
    changed = joined.withColumn(kept_text, F.when(~whole, taken)).withColumn("text", F.when(whole, F.col("text")).otherwise(F.substr(kept_text, F.lit(2))))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def _sql_permutation() -> str:
    steps = ["x0 AS (SELECT no, blocks, slot % blocks AS x, 'mix:' || no || ':' || (slot // blocks) AS k FROM slots)"]
    for turn in range(ROUNDS):
        steps.append(
            f"""y{turn} AS (SELECT *, k || ':{turn}:' AS s, ((('0x' || substr(md5(k || ':{turn}:'), 1, 12))::BIGINT - x) % blocks + blocks) % blocks AS p FROM x{turn}),
            x{turn + 1} AS (SELECT no, blocks, k, CASE WHEN substr(md5(s || greatest(x, p)), 1, 1) < '8' THEN p ELSE x END AS x FROM y{turn})"""
        )
    return ",\n".join(steps)


REPORT_SQL = f"""
WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM s0),
s2 AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 3 / 2 AS mix FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS done, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS remaining FROM s2
       WINDOW w AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (mix - done) / remaining AS attempt FROM s3),
lvl AS (SELECT arg_min(attempt, done) AS level FROM s4 WHERE attempt * weight <= cap),
src AS (SELECT no, source, docs, source_size, least(cap, coalesce(level, 0) * weight) AS target, ceil(source_size / 256)::BIGINT AS blocks FROM s4, lvl),
part AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * blocks / source_size * 65536)::BIGINT ELSE 0 END AS part FROM src),
shares AS (SELECT *, (sum(part) OVER (ORDER BY no))::BIGINT AS upper, (sum(part) OVER ())::BIGINT AS total_part, ceil((sum(part) OVER ()) / 65536)::BIGINT AS total FROM part),
shards AS (SELECT *, unnest(generate_series(0, (total - 1) // {SHARD_SLOTS})) AS shard FROM shares WHERE part > 0 AND total_part > 0),
widths AS (SELECT *, least({SHARD_SLOTS}, total - shard * {SHARD_SLOTS}) AS width, ('0x' || substr(md5('mix:shard:' || shard), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM shards),
drawn AS (SELECT *, floor(width * (upper / total_part::DOUBLE) + shift)::BIGINT - floor(width * ((upper - part) / total_part::DOUBLE) + shift)::BIGINT AS slots FROM widths),
runs AS (SELECT no, blocks, (sum(slots) OVER (PARTITION BY no ORDER BY shard))::BIGINT - slots AS first, slots FROM drawn),
slots AS (SELECT no, blocks, unnest(generate_series(first, least(first + slots, blocks * 2) - 1)) AS slot FROM runs),
{_sql_permutation()},
uses AS (SELECT no, x AS block, count(*) AS uses FROM x{ROUNDS} GROUP BY no, x),
d0 AS (SELECT z.doc_id, z.size, s.no, s.source_size, s.target, ('0x' || substr(md5(coalesce(z.doc_id::VARCHAR, '')), 1, 8))::BIGINT % (s.docs // {GROUP_DOCS} + 1) AS grp
       FROM sizes z JOIN src s ON z.source IS NOT DISTINCT FROM s.source),
d1 AS (SELECT *, (sum(size) OVER (PARTITION BY no ORDER BY grp, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start FROM d0),
d2 AS (SELECT *, unnest(generate_series(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS})) AS block FROM d1 WHERE size > 0),
d3 AS (SELECT d2.*, coalesce(uses, 0) * (least(start + size, (d2.block + 1) * {BLOCK_WORDS}) - greatest(start, d2.block * {BLOCK_WORDS})) AS words FROM d2 LEFT JOIN uses USING (no, block))
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken FROM d3 GROUP BY no, start, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0 AS taken FROM d1 WHERE size = 0
"""

"""Deduplication, upsert, author linking and referential checks, all set-based.

Keys may be heavily skewed (a third of all rows can share one code).  Every
operator therefore either reduces each key on the map side before the shuffle
(``row_number() <= 1`` gets a partial group limit, ``groupBy`` a partial
aggregate) or uses a plain equi-join, which AQE can split on skewed keys.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from erario.functions.fixed_values import INVALID_CODE


def _one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_posicao", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_posicao = 1").drop("_posicao")


def _columns(order: list[str] | str) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def is_valid_code(code: str) -> Column:
    return F.coalesce((F.col(code) != "") & (F.col(code) != INVALID_CODE), F.lit(False))


def drop_invalid_codes(df: DataFrame, code: str = "codigo_emenda") -> DataFrame:
    return df.filter((F.col(code) != "") & (F.col(code) != INVALID_CODE))


def dedup_first(df: DataFrame, keys: list[str] | str, order: list[str] | str) -> DataFrame:
    """Keep the first row of every key; ``order`` must be unique within a key."""
    return _one_per_key(df, _columns(keys), [F.col(c).asc() for c in _columns(order)])


def dedup_last(df: DataFrame, keys: list[str] | str, order: list[str] | str) -> DataFrame:
    """Keep the last row of every key."""
    return _one_per_key(df, _columns(keys), [F.col(c).desc() for c in _columns(order)])


def dedup_classification(df: DataFrame, order: list[str] | str) -> DataFrame:
    return dedup_first(df, ["funcao", "subfuncao", "programa"], order)


def new_rows(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the target does not have.

    The target keys are first cut to those of the batch: with a small batch the
    large target is only streamed past a broadcast key set, never shuffled.
    """
    seen = target.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(seen, key, "left_anti")


def insert_if_absent(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target plus the batch rows with new keys; ``batch`` holds one row per key."""
    return target.unionByName(new_rows(target, batch, key), allowMissingColumns=True)


def upsert(target: DataFrame, batch: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New snapshot: supplied columns overwrite, ``keep`` and unsupplied columns stay as stored.

    ``batch`` holds one row per key.  Rows outside the batch only meet its key
    set; the per-column pick runs over the matched rows alone.
    """
    keys = batch.select(key)
    untouched = target.join(keys, key, "left_anti")
    supplied = [c for c in batch.columns if c != key and c not in keep]
    stored = [c for c in target.columns if c != key and c not in supplied]
    current = target.join(keys, key, "left_semi").select(key, *stored)
    fresh = [c for c in batch.columns if c in keep]
    incoming = batch.select(key, *supplied, *[F.col(c).alias(f"_novo_{c}") for c in fresh])
    matched = F.col("_existe")
    changed = incoming.join(current.withColumn("_existe", F.lit(True)), key, "left").withColumns(
        {c: F.when(matched, F.col(c)).otherwise(F.col(f"_novo_{c}")) for c in fresh if c in stored}
        | {c: F.col(f"_novo_{c}") for c in fresh if c not in stored}
    )
    return untouched.unionByName(changed.select(key, *supplied, *dict.fromkeys(stored + fresh)), allowMissingColumns=True)


def upsert_keep(target: DataFrame, batch: DataFrame, key: str, keep: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """Upsert that never replaces stored values of ``keep`` (vectors by default)."""
    return upsert(target, batch, key, keep)


def upsert_stamped(
    target: DataFrame, batch: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("embedding",)
) -> DataFrame:
    """Upsert that sets ``updated_at`` on every batch row and ``created_at`` on the new ones only."""
    stamped = batch.withColumns({"created_at": now, "updated_at": now})
    return upsert(target, stamped, key, (*keep, "created_at"))


def touched_partitions(target: DataFrame, batch: DataFrame, key: str, partition: str) -> DataFrame:
    """Partitions an upsert changes: those of the batch and those its matched rows leave."""
    left = target.select(key, partition).join(batch.select(key), key, "left_semi")
    return batch.select(partition).unionByName(left.select(partition)).distinct()


def link_author(amendments: DataFrame, legislators: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Set ``cod_autor`` to the lowest legislator whose name contains the author name.

    Containment is turned into an equi-join: every legislator name yields its
    substrings, but only of the lengths that occur among the author names.  The
    lowest id per substring is pre-aggregated, so common fragments stay cheap.
    The set of lengths is broadcast: n different lengths need n*n/2 letters of
    names, so it holds some hundred numbers.  An empty author name links to
    nobody.  The names are read from ``named``, rows that have at least all of
    them, where ``amendments`` themselves are costly to compute twice.
    """
    name = F.upper("nome_autor")
    authors = (amendments if named is None else named).select(name.alias("_nome")).filter("_nome <> ''").distinct()
    lengths = authors.select(F.length("_nome").alias("_tamanho")).distinct()
    people = legislators.select("cod_autor", F.upper("nome").alias("_texto")).filter("_texto <> ''")
    sized = people.withColumn("_tamanho", F.explode(F.sequence(F.lit(1), F.length("_texto")))).join(
        F.broadcast(lengths), "_tamanho", "left_semi"
    )
    starts = F.sequence(F.lit(1), F.length("_texto") - F.col("_tamanho") + 1)
    fragments = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_texto"), i, F.col("_tamanho"))))
    lowest = (
        sized.select("cod_autor", F.explode(fragments).alias("_nome"))
        .groupBy("_nome")
        .agg(F.min("cod_autor").alias("cod_autor"))
    )
    links = authors.join(lowest, "_nome")
    rest = amendments.drop("cod_autor").withColumn("_nome", name)
    return rest.join(links, "_nome", "left").drop("_nome")


def load_report(batch: DataFrame, target: DataFrame, order: list[str] | str, key: str = "codigo_emenda") -> DataFrame:
    """Inserted, updated and skipped rows per year.

    Skipped: invalid codes and every repetition of a code after its first row.
    Repetitions are counted per (code, year), not ranked row by row, so a code
    with very many copies never gathers in one task.
    """
    position = F.struct(*_columns(order))
    valid = batch.filter(is_valid_code(key))
    per_year = valid.groupBy(key, "ano").agg(F.count("*").alias("linhas"), F.min(position).alias("_primeira"))
    first = Window.partitionBy(key).orderBy("_primeira")
    marked = per_year.withColumn("_vence", (F.row_number().over(first) == 1).cast("int"))
    seen = target.select(key).join(batch.select(key), key, "left_semi").distinct().withColumn("_existe", F.lit(1))
    counted = (
        marked.join(seen, key, "left")
        .withColumn("_existe", F.coalesce("_existe", F.lit(0)))
        .select(
            "ano",
            (F.col("_vence") * (1 - F.col("_existe"))).cast("long").alias("inseridas"),
            (F.col("_vence") * F.col("_existe")).cast("long").alias("atualizadas"),
            (F.col("linhas") - F.col("_vence")).alias("ignoradas"),
        )
    )
    zero = F.lit(0).cast("long")
    invalid = batch.filter(~is_valid_code(key)).select(
        "ano", zero.alias("inseridas"), zero.alias("atualizadas"), F.lit(1).cast("long").alias("ignoradas")
    )
    totals = [F.sum(c).alias(c) for c in ("inseridas", "atualizadas", "ignoradas")]
    return counted.unionByName(invalid).groupBy("ano").agg(*totals)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows that survive the deletion of the given parents."""
    return child.join(deleted.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")

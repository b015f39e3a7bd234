"""De-duplication and keyed merges of batches into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`; nulls are a key like any other. Unlike dropDuplicates it says which row stays."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the columns `order`."""
    return first_wins(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def insert_unseen(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those rows of the batch whose key it lacks; keys compare null-safe."""
    on = [table[k].eqNullSafe(batch[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return table.unionByName(batch.join(table, condition, "left_anti"), allowMissingColumns=True)


def keyed_merge(table: DataFrame, batch: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), fill: Sequence[str] = (), touch: Sequence[str] = ()) -> DataFrame:
    """Table and batch as one, with `changed`.

    A key in both: columns of `overwrite` take the batch's value if it has one, those of `fill` keep the table's value
    unless it is null or empty, those of `touch` take the greater value without counting as a change; other columns are the
    table's. A key only in the batch is inserted. Both sides must hold a key once.
    """
    columns = [c for c in table.columns if c not in keys]
    old = table.select(*keys, F.struct(*columns).alias("_old"))
    new = batch.select(*keys, F.struct(*[c for c in columns if c in batch.columns]).alias("_new"))
    both = old.join(new, list(keys), "full_outer")
    given = set(batch.columns)

    def merged(c: str) -> Column:
        was, now = F.col(f"_old.{c}"), F.col(f"_new.{c}") if c in given else F.lit(None)
        inserted = F.col("_old").isNull()
        if c in overwrite:
            kept = F.coalesce(now, was)
        elif c in fill:
            kept = F.coalesce(F.when(was.cast("string") != "", was), now, was)
        elif c in touch:
            kept = F.greatest(was, now)
        else:
            kept = was
        return F.when(inserted, now).otherwise(kept).alias(c)

    out = both.select(*keys, "_old", "_new", *[merged(c) for c in columns])
    differs = F.lit(False)
    for c in [*overwrite, *fill]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return out.withColumn("changed", F.col("_old").isNull() | F.col("_new").isNotNull() & differs).drop("_old", "_new")


def replace_children(children: DataFrame, batch: DataFrame, parent: str) -> DataFrame:
    """Children without those of the batch's parents, and the batch."""
    return children.join(batch.select(parent).distinct(), parent, "left_anti").unionByName(batch)


def changed_content(landed: DataFrame, state: DataFrame, key: str, digest: str) -> DataFrame:
    """Landed rows whose digest differs from the state's, or whose key is new."""
    known = state.select(key, F.col(digest).alias("_known"))
    return landed.join(known, key, "left").where(~F.col(digest).eqNullSafe(F.col("_known"))).drop("_known")


def duplicate_rules(rows: DataFrame, ident: str, rules: Sequence[Sequence[Column]]) -> DataFrame:
    """(ident, duplicate_of, rule): for each row the first rule, in their order, by which an earlier id equals it in every column of the rule.

    Each rule is an aggregation by its own key, so an "or" of rules never becomes a nested loop. Null and empty values match nothing.
    """
    found = None
    for number, rule in enumerate(rules, 1):
        names = [f"_k{i}" for i in range(len(rule))]
        keyed = rows.select(ident, *[c.cast("string").alias(n) for c, n in zip(rule, names)])
        for n in names:
            keyed = keyed.where(F.col(n) != "")
        firsts = keyed.groupBy(*names).agg(F.min(ident).alias("duplicate_of"), F.count_distinct(ident).alias("_n")).where("_n > 1")
        hits = keyed.join(firsts, names).where(F.col(ident) > F.col("duplicate_of")).select(ident, F.struct(F.lit(number).alias("rule"), "duplicate_of").alias("_hit"))
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy(ident).agg(F.min("_hit").alias("_hit")).select(ident, "_hit.duplicate_of", "_hit.rule")

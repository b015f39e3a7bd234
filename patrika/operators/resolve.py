"""Matching of records: domains by suffix, titles by similarity within blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patrika.functions.urls import host, host_suffixes


def domain_match(rows: DataFrame, ident: str, url: Column, domains: DataFrame, domain: str) -> DataFrame:
    """(ident, host, matched): the longest listed domain that a URL's host equals or is below; null if none.

    Each host is exploded into its parent domains, which makes the suffix test an equi-join.
    """
    hosts = rows.select(ident, host(url).alias("host"))
    tried = hosts.where("host is not null").select(ident, "host", F.explode(host_suffixes(F.col("host"))).alias("matched"))
    listed = domains.select(F.lower(F.col(domain)).alias("matched")).distinct()
    best = tried.join(listed, "matched").groupBy(ident).agg(F.max_by("matched", F.length("matched")).alias("matched"))
    return hosts.join(best, ident, "left")


def similarity(a: Column, b: Column) -> Column:
    """The Ratcliff-Obershelp ratio of two texts, by Arrow batches; 0 where one is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    return ratio(a, b)


def similar_titles(rows: DataFrame, ident: str, title: str, block: list[Column], least: float = 0.88) -> DataFrame:
    """(id_a, id_b, ratio) of titles of one block that are alike by at least `least`.

    Equal titles are one on either side before pairs are made, and titles whose lengths alone rule the ratio out are not compared.
    Every pair of different titles is given once; copies are found under their title's least id.
    """
    names = [f"_b{i}" for i in range(len(block))]
    keyed = rows.select(F.col(ident).alias("_id"), F.lower(F.trim(F.col(title))).alias("_t"), *[c.alias(n) for c, n in zip(block, names)]).where("_t != ''")
    for n in names:
        keyed = keyed.where(F.col(n).isNotNull())
    once = keyed.groupBy("_t", *names).agg(F.min("_id").alias("_id"))
    a = once.select(*names, F.col("_id").alias("id_a"), F.col("_t").alias("_ta"))
    b = once.select(*names, F.col("_id").alias("id_b"), F.col("_t").alias("_tb"))
    shorter, longer = F.least(F.length("_ta"), F.length("_tb")), F.greatest(F.length("_ta"), F.length("_tb"))
    pairs = a.join(b, names).where((F.col("id_a") < F.col("id_b")) & (2 * shorter >= least * (shorter + longer)))
    return pairs.withColumn("ratio", similarity(F.col("_ta"), F.col("_tb"))).where(F.col("ratio") >= least).select("id_a", "id_b", "ratio")

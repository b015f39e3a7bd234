"""Texts of varying length in containers of fixed capacity, with little space left.

Best fit, largest first, in bulk. Sizes are whole tokens up to the capacity, so all pieces of one size are one class and all
containers with one gap are another; both are kept as runs. A step takes the largest size that is left, sweeps to the
successor among the gaps (the smallest that holds it), and matches ranks of the size class with containers of the gap
class: where more pieces than places compete, the lower ranks win and the others go on to the next gap. Then the gaps
are updated. The plan has as many runs as there are sizes and gaps, however many texts there are: its size depends on the
capacity alone, so it is made from the histogram of sizes and broadcast. Pieces find their container by
their rank within their size, which is counted in salted groups, so no class of sizes is one task.

A text longer than the capacity is split into full pieces and a rest; no other is split.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patrika.session import cut_lineage

TOKENIZERS = os.environ.get("PATRIKA_TOKENIZERS", "/opt/tokenizers")
#: The pre-tokenisation of byte-level BPE, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one size that are ranked in one group.
RANKED = 500_000


def token_counts(texts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, tokens) of `texts` (doc_id, text) by the byte-level BPE vocabulary (tiktoken ranks) at `vocabulary`.

    Null texts are left out, an empty text has no tokens, repeated rows are counted each.
    """
    path = vocabulary or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    # shipped with the job: executors need no such folder
    texts.sparkSession.sparkContext.addFile(path)
    shipped = os.path.basename(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(shipped), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return texts.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, containers). A run (size, rank, pieces, container, per_container) puts `pieces` of one size, ranked from `rank` on, into consecutive containers."""
    gaps: list[int] = []
    held: dict[int, list[list[int]]] = {}
    runs, opened = [], 0

    def give(gap: int, first: int, n: int) -> None:
        if n <= 0 or gap <= 0:
            return
        if gap not in held:
            bisect.insort(gaps, gap)
            held[gap] = []
        if held[gap] and held[gap][-1][0] + held[gap][-1][1] == first:
            held[gap][-1][1] += n
        else:
            held[gap].append([first, n])

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            k = bisect.bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                first, n = held[gap].pop(0)
                if not held[gap]:
                    del held[gap]
                    gaps.pop(k)
            else:
                gap, first, n = capacity, opened, math.ceil(left / (capacity // size))
                opened += n
            per = gap // size
            used = min(left, per * n)
            full, more = divmod(used, per)
            runs.append((size, rank, used, first, per))
            give(gap - per * size, first, full)
            if more:
                give(gap - more * size, first + full, 1)
            give(gap, first + full + (more > 0), n - full - (more > 0))
            rank, left = rank + used, left - used
    return runs, opened


def pack(counts: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity_tokens, container_no, doc_id, piece_no, tokens): where each piece of each text lies, for every capacity.

    `counts` has doc_id and tokens. Pieces are numbered from 0 in the order of the text; a text that fits has one. Texts
    without tokens need no place and are left out; equal ids are packed as the texts they are. Containers are numbered from 0.
    """
    spark = counts.sparkSession
    sized = counts.where("tokens > 0").select("doc_id", F.col("tokens").cast("bigint").alias("all_tokens"))
    c = F.col("capacity_tokens")
    pieces = (
        sized.select("doc_id", "all_tokens", F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(capacities))])).alias("capacity_tokens"))
        .select("doc_id", "all_tokens", "capacity_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("all_tokens") - 1) / c))).alias("piece_no"))
        .select("capacity_tokens", "doc_id", "piece_no", F.least(c.cast("bigint"), F.col("all_tokens") - F.col("piece_no") * c).cast("int").alias("tokens"))
    )
    # at most the sum of the capacities in rows
    rows = pieces.groupBy("capacity_tokens", "tokens").count().collect()
    histograms: dict[int, dict[int, int]] = {}
    for r in rows:
        histograms.setdefault(r.capacity_tokens, {})[r.tokens] = r["count"]
    plan = [(cap, *run) for cap, histogram in histograms.items() for run in best_fit_plan(histogram, cap)[0]]
    runs = spark.createDataFrame(plan, "p_capacity int, p_size int, p_rank bigint, p_pieces bigint, p_container bigint, p_per int")
    salts = max([1, *(math.ceil(n / RANKED) for h in histograms.values() for n in h.values())])
    group = ["capacity_tokens", "tokens", "salt"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "piece_no")).cast("bigint") - 1)
    if salts > 1:
        before = salted.groupBy(*group).count().withColumn("before", F.sum("count").over(Window.partitionBy("capacity_tokens", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        ranked = ranked.join(before.drop("count"), group).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(F.broadcast(runs), (c == F.col("p_capacity")) & (F.col("tokens") == F.col("p_size")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_pieces")))
    container = F.col("p_container") + F.floor((F.col("rank") - F.col("p_rank")) / F.col("p_per"))
    return placed.select("capacity_tokens", container.alias("container_no"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"), "tokens")


def packed_texts(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """pack() of the texts of `documents` for each capacity of `containers` (a bounded list); null or non-positive ones are ignored."""
    capacities = [r[0] for r in containers.select("capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    counts = cut_lineage(token_counts(documents, vocabulary))
    return pack(counts, capacities)


def fill_report(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, containers, pieces, tokens, fill, least_possible): how full the containers are."""
    total = F.sum(F.col("tokens").cast("bigint"))
    out = packed.groupBy("capacity_tokens").agg((F.max("container_no") + 1).alias("containers"), F.count(F.lit(1)).alias("pieces"), total.alias("tokens"))
    return out.select("*", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_possible"))

"""Byte-level transforms of documents, with the standard library."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_jpeg(data: bytes, size: int) -> bytes:
    """A JPEG made exactly `size` bytes long by comment segments after its start marker.

    Returned as it is if it is no JPEG, long enough, or short by fewer bytes than a segment's header has.
    """
    short = size - len(data)
    if data[:2] != b"\xff\xd8" or short < 4:
        return data
    out = bytearray(data[:2])
    while short:
        # a segment has four bytes of header and holds 65533 at most; a rest too small for one is never left
        take = min(short, 65537)
        if 0 < short - take < 4:
            take -= 4
        out += b"\xff\xfe" + struct.pack(">H", take - 2) + b" " * (take - 4)
        short -= take
    return bytes(out + data[2:])


def pad_pdf(data: bytes, size: int) -> bytes:
    """A PDF made `size` bytes long by a comment after its end; shorter wishes leave it as it is."""
    short = size - len(data)
    if data[:5] != b"%PDF-" or short < 3:
        return data
    return data + b"\n%" + b" " * (short - 3) + b"\n"


def padded(content: Column, size: Column, kind: str) -> Column:
    """pad_jpeg or pad_pdf over a column of documents."""
    pad = {"jpeg": pad_jpeg, "pdf": pad_pdf}[kind]

    @F.pandas_udf("binary")
    def apply(data: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else pad(bytes(d), int(s)) if s == s and s is not None else bytes(d) for d, s in zip(data, sizes)])

    return apply(content, size)


def zipped(files: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """(key, name, content): the files of each key as one zip, in the order of their names; a single file passes as it is."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(name, kind="stable")
        if len(rows) == 1:
            return rows[[key, name, content]]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, data in zip(rows[name], rows[content]):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), bytes(data))
        return pd.DataFrame({key: [rows[key].iloc[0]], name: ["files.zip"], content: [out.getvalue()]})

    kept = files.select(key, name, content)
    return kept.groupBy(key).applyInPandas(pack, kept.schema)


def pick_candidate(candidates: DataFrame, key: str, size: str, target: Column, raw: Column) -> DataFrame:
    """For each key the largest candidate within the target, else the smallest not above the raw size; null fields if neither exists."""
    fits, holds = F.col(size) <= target, F.col(size) <= raw
    row = F.struct(*candidates.columns)
    chosen = candidates.groupBy(key).agg(F.coalesce(F.max_by(row, F.when(fits, F.col(size))), F.min_by(row, F.when(holds, F.col(size)))).alias("_c"))
    return chosen.select(key, *[F.col(f"_c.{c}").alias(c) for c in candidates.columns if c != key])


def page_class(pages: DataFrame, doc: str, page: str, text: str, per_page: int = 30, first_pages: int = 3, least: int = 60) -> DataFrame:
    """(doc, text_pages, scanned): pages with text enough, and whether the first pages together have too little."""
    size = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
    return pages.groupBy(doc).agg(
        F.sum(F.when(size >= per_page, 1).otherwise(0)).alias("text_pages"),
        (F.sum(F.when(F.col(page) < first_pages, size).otherwise(0)) < least).alias("scanned"),
    )


def pixels(centimetres: Column, dpi: Column) -> Column:
    """Pixels of a length, rounded half to even, one at least."""
    return F.greatest(F.bround(centimetres * dpi / 2.54, 0).cast("int"), F.lit(1))


def fitted(width: Column, height: Column, to_width: Column, to_height: Column, kind: str) -> Column:
    """(width, height) of a picture fitted into a box: contain, cover or stretch."""
    if kind == "stretch":
        return F.struct(to_width.alias("width"), to_height.alias("height"))
    pick = F.least if kind == "contain" else F.greatest
    scale = pick(to_width / width, to_height / height)
    return F.struct(F.greatest(F.bround(width * scale, 0).cast("int"), F.lit(1)).alias("width"), F.greatest(F.bround(height * scale, 0).cast("int"), F.lit(1)).alias("height"))


def size_floor(raw: Column, profile: str) -> Column:
    """The least size a compressed file may have, so that profiles stay apart: a share of the raw size, greater for small files; 0 for none."""
    small, large = {"balanced": (0.75, 0.65), "high": (0.90, 0.85)}.get(profile, (0.0, 0.0))
    return F.floor(raw * F.when(raw < 20 * 1024, small).otherwise(large)).cast("bigint")


def compressed_size(raw: Column, made: Column, profile: str) -> Column:
    """The size after floors: never below the floor, never above the raw size."""
    return F.least(F.greatest(made, size_floor(raw, profile)), raw)


def best_quality(tries: DataFrame, key: str, quality: str, size: str, most: Column) -> DataFrame:
    """(key, quality, size): the highest quality whose size is within `most`, else the lowest tried."""
    row = F.struct(F.col(quality).alias("quality"), F.col(size).alias("size"))
    best = F.coalesce(F.max_by(row, F.when(F.col(size) <= most, F.col(quality))), F.min_by(row, quality))
    return tries.groupBy(key).agg(best.alias("_b")).select(key, "_b.quality", "_b.size")

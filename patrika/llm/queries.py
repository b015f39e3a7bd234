"""Queries of this subpackage on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrika.llm import boilerplate, leakage, names, packing, scanned, survivor, titles, truncation
from patrika.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_item_id, line_no) of every line that belongs to the notice itself."""
    return boilerplate.main_lines(read_table(spark, folder, "raw_items"))


def p1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """(raw_item_id, main_text): the notice of each page."""
    return boilerplate.main_text(read_table(spark, folder, "raw_items"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, field_name, candidate_id) of the candidates that state the surviving fact of their field in full."""
    rows = survivor.surviving_candidates(read_table(spark, folder, "field_candidates"))
    return rows.where((F.col("ids") > 1) & (F.col("fact") == F.col("winner"))).select("job_id", "field_name", "candidate_id")


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record for each job."""
    return survivor.surviving_records(read_table(spark, folder, "field_candidates"))


def _name_classes(spark: SparkSession, folder: str) -> DataFrame:
    jobs = read_table(spark, folder, "jobs")
    states = [r[0] for r in jobs.select("state").where("state is not null").distinct().collect()]
    field = lambda c: jobs.select(F.lit(c).alias("field_name"), F.col(c).alias("name"))
    return names.name_classes(field("organization").unionByName(field("post_name")), states)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field_name, name_a, name_b) of every two spellings of one body or post."""
    return names.name_pairs(_name_classes(spark, folder))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its occurrences, its class and the number of its links."""
    return _name_classes(spark, folder)


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    jobs = read_table(spark, folder, "jobs").select(F.lit("jobs.title").alias("field_name"), "id", "title")
    items = read_table(spark, folder, "raw_items").select(F.lit("raw_items.title_raw").alias("field_name"), "id", F.col("title_raw").alias("title"))
    return jobs.unionByName(items)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field_name, id_a, id_b) of every two rows of a table that announce the same notice."""
    rows = _titles(spark, folder)
    return titles.notice_pairs(rows, titles.notice_classes(rows))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both tables that has a title, with its class and the number of its links."""
    rows = _titles(spark, folder)
    return titles.notice_members(rows, titles.notice_classes(rows))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    jobs = read_table(spark, folder, "jobs").select(F.lit("detailed_description").alias("field_name"), F.col("id").alias("record_id"), F.col("detailed_description").alias("text"))
    notices = read_table(spark, folder, "raw_notifications").select(F.lit("pdf_text").alias("field_name"), F.col("canonical_key").alias("record_id"), F.col("pdf_text").alias("text"))
    return jobs.unionByName(notices).where(F.col("text").isNotNull())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(field_name, record_id, line_no, defect) of every line of page furniture, split word and misread line."""
    texts = _scans(spark, folder)
    repaired = scanned.repair_scans(texts, scanned.fit_editor(texts))
    return repaired.select("field_name", "record_id", F.explode("defects").alias("d")).select("field_name", "record_id", "d.line_no", "d.defect").distinct()


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """(field_name, record_id, repaired): every text as continuous paragraphs."""
    texts = _scans(spark, folder)
    return scanned.repair_scans(texts, scanned.fit_editor(texts)).select("field_name", "record_id", "repaired")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """(capacity_tokens, container_no, doc_id, piece_no, tokens) of every text for each container size."""
    return packing.packed_texts(read_table(spark, folder, "documents"), read_table(spark, folder, "containers"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each size are."""
    return packing.fill_report(p7_packed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, item_id) of the documents that carry a passage of a test item."""
    return leakage.find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p8_by_item(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents it leaked into."""
    leaks = p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    items = read_table(spark, folder, "eval_items").select("item_id", "suite").distinct()
    return items.join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id) of the documents that stop within a sentence."""
    return truncation.find_truncated(read_table(spark, folder, "documents")).where("cut").select("doc_id")


def p9_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.truncation_by_source(truncation.find_truncated(read_table(spark, folder, "documents")))


QUERIES = {"p1_found": p1_found, "p1_main_text": p1_main_text, "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p4_classes": p4_classes, "p6_found": p6_found, "p6_repaired": p6_repaired, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_by_item": p8_by_item, "p9_found": p9_found, "p9_by_source": p9_by_source}
ORACLES: dict[str, str] = {}

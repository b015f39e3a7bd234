"""Landed sources and file transforms, each query with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.functions import extract
from patrika.operators import binary
from patrika.plans.extraction import _parse_sql, squeezed
from patrika.plans.records import registrar
from patrika.sources import landed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


@query("""SELECT id, sha256(v) AS digest, strlen(v) AS bytes FROM (SELECT DISTINCT id, CASE WHEN trim(raw_html) <> '' THEN raw_html ELSE raw_text END AS v FROM raw_items)""")
def landed_pages(t, spark) -> DataFrame:
    rows = t("raw_items").select("id", landed.page_text(F.col("raw_html"), F.col("raw_text")).alias("v")).distinct()
    return rows.select("id", F.sha2("v", 256).alias("digest"), F.octet_length("v").alias("bytes"))


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN event_type = 'click' THEN props END AS body FROM events),
f AS (SELECT user_id, min(attempt) AS attempt FROM a WHERE attempt <= 3 AND body <> '' GROUP BY user_id) SELECT u.user_id, f.attempt, a.body, coalesce(f.attempt - 1, u.n)::INTEGER AS failed FROM (SELECT user_id, count(*) AS n FROM a WHERE attempt <= 3 GROUP BY user_id) u LEFT JOIN f ON u.user_id = f.user_id LEFT JOIN a ON a.user_id = f.user_id AND a.attempt = f.attempt""")
def fetched_bodies(t, spark) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return landed.last_success(t("events").select("user_id", place.alias("attempt"), F.when(F.col("event_type") == "click", F.col("props")).alias("body")), "user_id")


@query("""SELECT DISTINCT canonical_key, sha256(substr(regexp_replace(replace(replace(CASE WHEN trim(pdf_text) <> '' THEN pdf_text ELSE title END,chr(13),chr(10)),chr(9),' '),'\\n{3,}',chr(10)||chr(10),'g'),1,300000)) AS digest FROM raw_notifications WHERE trim(pdf_text) <> '' OR trim(title) <> ''""")
def document_texts(t, spark) -> DataFrame:
    text = landed.document_text(F.col("pdf_text"), F.col("title"))
    return t("raw_notifications").select("canonical_key", text.alias("v")).where("v is not null").select("canonical_key", F.sha2("v", 256).alias("digest")).distinct()


@query("""WITH r AS (SELECT canonical_key, max(status) AS status, max(CASE WHEN status = 'processed' THEN sha256(title) END) AS sha256, max(pdf_text) AS v FROM raw_notifications GROUP BY 1)
SELECT canonical_key, CASE WHEN sha256 IS NOT NULL THEN status WHEN v IS NOT NULL THEN 'downloaded' ELSE 'error' END AS status, coalesce(sha256, sha256(v)) AS sha256, CASE WHEN v IS NOT NULL THEN strlen(v) END AS bytes, CASE WHEN sha256 IS NULL AND v IS NULL THEN 'not landed' END AS error FROM r""")
def download_states(t, spark) -> DataFrame:
    rows = t("raw_notifications").groupBy("canonical_key").agg(F.max("status").alias("status"), F.max(F.when(F.col("status") == "processed", F.sha2("title", 256))).alias("sha256"), F.max("pdf_text").alias("v"))
    files = rows.where("v is not null").select("canonical_key", F.sha2("v", 256).alias("sha256"), F.octet_length("v").alias("bytes"), F.lit(None).cast("string").alias("error"))
    return landed.download_state(rows.drop("v"), files, "canonical_key")


SEEDS = [("banking_jobs_000", "banking", 95), ("seed_only_001", "police", 70), ("seed_only_002", "court", 50)]


@query("""WITH s(source_key, source_type, priority) AS (VALUES ('banking_jobs_000','banking',95), ('seed_only_001','police',70), ('seed_only_002','court',50)), o AS (SELECT DISTINCT source_key, source_type, priority FROM sources)
SELECT s.source_key, CASE WHEN o.source_key IS NULL THEN 'created' WHEN o.source_type IS NOT DISTINCT FROM s.source_type AND o.priority IS NOT DISTINCT FROM s.priority THEN 'unchanged' ELSE 'updated' END AS change FROM s LEFT JOIN o ON s.source_key = o.source_key""")
def seeded_sources(t, spark) -> DataFrame:
    seed = landed.seeds(spark, SEEDS, "source_key string, source_type string, priority int")
    return landed.seed_changes(t("sources").select("source_key", "source_type", "priority").distinct(), seed, ["source_key"], ["source_type", "priority"])


_NUM = lambda v: f"CASE WHEN regexp_matches(trim({v}),'{extract.TEXT_NUMBER}') THEN 0.0 ELSE TRY_CAST(nullif(regexp_replace(trim({v}),'[^\\d.\\-]','','g'),'') AS DOUBLE) END"


@query(f"""WITH p AS (SELECT job_id, max(value) FILTER (field_name = 'total_vacancies') AS v, max(value) FILTER (field_name = 'salary') AS s, regexp_replace({squeezed("max(value) FILTER (field_name = 'application_end_date')")},',$','') AS d FROM field_candidates GROUP BY job_id),
r AS (SELECT job_id, CASE WHEN {_NUM('v')} BETWEEN 1 AND 1000000 THEN {_NUM('v')} END AS vacancies, nullif({squeezed('s')},'') AS salary, {_parse_sql('d')} AS closing FROM p) SELECT * FROM r WHERE vacancies IS NOT NULL OR salary IS NOT NULL OR closing IS NOT NULL""")
def parsed_details(t, spark) -> DataFrame:
    value = lambda name: F.max(F.when(F.col("field_name") == name, F.col("value")))
    rows = t("field_candidates").groupBy("job_id").agg(value("total_vacancies").alias("vacancies"), value("salary").alias("salary"), value("application_end_date").alias("closing"))
    body = F.to_json(F.struct("vacancies", "salary", "closing"))
    read = extract.read_details(body, {"vacancies": extract.BOUNDS["vacancies"]}, ["salary"], ["closing"])
    return rows.select("job_id", read.alias("r")).where("r is not null").select("job_id", "r.vacancies", "r.salary", "r.closing")


# ------------------------------------------------------------------ files


@query("""SELECT p_partkey, greatest(round_even(w * least(600 / w, 400 / h), 0), 1)::INTEGER AS contain_width, greatest(round_even(h * greatest(600 / w, 400 / h), 0), 1)::INTEGER AS cover_height, greatest(round_even(p_size * 300 / 2.54, 0), 1)::INTEGER AS pixels FROM (SELECT p_partkey, p_size, p_size * 10 + 200 AS w, p_partkey % 50 * 10 + 100 AS h FROM part)""")
def picture_boxes(t, spark) -> DataFrame:
    w, h = F.col("p_size") * 10 + 200, F.col("p_partkey") % 50 * 10 + 100
    contain, cover = (binary.fitted(w, h, F.lit(600), F.lit(400), kind) for kind in ("contain", "cover"))
    return t("part").select("p_partkey", contain["width"].alias("contain_width"), cover["height"].alias("cover_height"), binary.pixels(F.col("p_size").cast("double"), F.lit(300)).alias("pixels"))


@query("""SELECT p_partkey, CASE WHEN target - base < 4 THEN base ELSE target END AS bytes FROM (SELECT p_partkey, 2 + strlen(p_name) AS base, p_size * 5 AS target FROM part)""")
def padded_pictures(t, spark) -> DataFrame:
    content = F.concat(F.unhex(F.lit("FFD8")), F.col("p_name").cast("binary"))
    return t("part").select("p_partkey", binary.padded(content, F.col("p_size") * 5, "jpeg").alias("c")).select("p_partkey", F.octet_length("c").cast("bigint").alias("bytes"))


@query("""SELECT p_partkey, least(greatest(made, floor(raw * CASE WHEN raw < 20480 THEN 0.75 ELSE 0.65 END)), raw)::BIGINT AS balanced, least(greatest(made, floor(raw * CASE WHEN raw < 20480 THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END)), raw)::BIGINT AS high FROM (SELECT p_partkey, p_size * 1000 AS raw, p_partkey % 40 * 1000 AS made FROM part)""")
def compressed_sizes(t, spark) -> DataFrame:
    raw, made = (F.col("p_size") * 1000).cast("bigint"), (F.col("p_partkey") % 40 * 1000).cast("bigint")
    return t("part").select("p_partkey", binary.compressed_size(raw, made, "balanced").alias("balanced"), binary.compressed_size(raw, made, "high").alias("high"))


@query("""WITH f AS (SELECT l_orderkey, max_by(l_linenumber, l_extendedprice) FILTER (l_extendedprice <= 30000) AS a, min_by(l_linenumber, l_extendedprice) FILTER (l_extendedprice <= 60000) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(a, b) AS chosen FROM f""")
def chosen_sizes(t, spark) -> DataFrame:
    tries = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return binary.pick_candidate(tries, "l_orderkey", "l_extendedprice", F.lit(30000), F.lit(60000)).select("l_orderkey", F.col("l_linenumber").alias("chosen"))


@query("""SELECT l_orderkey, coalesce(max(l_linenumber) FILTER (l_extendedprice <= 20000), min(l_linenumber)) AS quality FROM lineitem GROUP BY 1""")
def best_qualities(t, spark) -> DataFrame:
    return binary.best_quality(t("lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", F.lit(20000)).select("l_orderkey", "quality")


@query("""SELECT doc_id, sum(CASE WHEN length(trim(p)) >= 30 THEN 1 ELSE 0 END)::BIGINT AS text_pages, sum(CASE WHEN i < 3 THEN length(trim(p)) ELSE 0 END) < 60 AS scanned FROM (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)||chr(10)) AS l FROM documents)) GROUP BY doc_id""")
def page_classes(t, spark) -> DataFrame:
    pages = t("documents").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page", "body"))
    return binary.page_class(pages, "doc_id", "page", "body")


@query("""SELECT canonical_key, CASE WHEN v IS NULL THEN 'title.txt' ELSE 'files.zip' END AS name FROM (SELECT canonical_key, max(pdf_text) AS v, max(title) AS title FROM raw_notifications GROUP BY 1) WHERE title IS NOT NULL""")
def zipped_notices(t, spark) -> DataFrame:
    rows = t("raw_notifications").groupBy("canonical_key").agg(F.max("pdf_text").alias("v"), F.max("title").alias("title")).where("title is not null")
    parts = F.filter(F.array(F.struct(F.lit("title.txt").alias("name"), F.col("title").cast("binary").alias("content")), F.struct(F.lit("text.txt").alias("name"), F.col("v").cast("binary").alias("content"))), lambda f: f["content"].isNotNull())
    return binary.zipped(rows.select("canonical_key", F.explode(parts).alias("f")).select("canonical_key", "f.name", "f.content"), "canonical_key", "name", "content").select("canonical_key", "name")

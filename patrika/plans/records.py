"""The record operators on whole tables, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patrika.functions import text, urls, values
from patrika.operators import fuse, listing, merge, pages, resolve, sequences
from patrika.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The moment that time-dependent queries look from; they never read the clock.
AS_OF = "2026-06-30 00:00:00"
RAW_FIELDS = ["title", "organization", "advertisement_number", "post_name", "state", "category", "notice_url"]
WANTED, NOISE = "recruitment|notice|result|admit|corrigendum", "sitemap|screen reader|login"


def registrar(queries: dict, oracles: dict[str, str]):
    """A decorator that registers a query under its function's name, with its SQL if it has one."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = lambda spark, folder: f(lambda name: read_table(spark, folder, name), spark)
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return query


query = registrar(QUERIES, ORACLES)


# ------------------------------------------------------------------ listings


@query("""SELECT DISTINCT id, title FROM jobs
WHERE (lower(coalesce(title,'')) LIKE '%forest%' OR lower(coalesce(organization,'')) LIKE '%forest%' OR lower(coalesce(post_name,'')) LIKE '%forest%')
  AND (lower(coalesce(title,'')) LIKE '%guard%' OR lower(coalesce(organization,'')) LIKE '%guard%' OR lower(coalesce(post_name,'')) LIKE '%guard%')""")
def token_search(t, spark) -> DataFrame:
    return listing.token_search(t("jobs"), "Forest, guard", ["title", "organization", "post_name"]).select("id", "title").distinct()


@query("SELECT DISTINCT id FROM jobs WHERE lower(coalesce(title,'')) LIKE '%answer key%' OR lower(coalesce(organization,'')) LIKE '%answer key%'")
def substring_search(t, spark) -> DataFrame:
    return listing.substring_search(t("jobs"), " Answer Key ", ["title", "organization"]).select("id").distinct()


@query("""SELECT id, title, priority, epoch_us(published_at) AS published_us FROM (SELECT DISTINCT id, title, priority, published_at FROM jobs)
ORDER BY published_at DESC NULLS FIRST, priority DESC NULLS FIRST, id LIMIT 50 OFFSET 100""")
def listing_page(t, spark) -> DataFrame:
    rows = t("jobs").select("id", "title", "priority", "published_at").distinct()
    order = [F.col("published_at").desc_nulls_first(), F.col("priority").desc_nulls_first(), F.col("id").asc()]
    return listing.page(rows, order, 50, 100).select("id", "title", "priority", F.unix_micros("published_at").alias("published_us"))


@query("SELECT category, count(*) AS count FROM jobs GROUP BY category")
def category_facets(t, spark) -> DataFrame:
    return listing.facet(t("jobs"), "category")


@query("""SELECT source_type, state, count(*) AS count FROM raw_items r JOIN (SELECT DISTINCT id, source_type, state FROM sources) s ON r.source_id = s.id
GROUP BY source_type, state""")
def facets_by_source(t, spark) -> DataFrame:
    sources = t("sources").select(F.col("id").alias("source_id"), "source_type", "state").distinct()
    return t("raw_items").select("source_id").join(sources, "source_id").groupBy("source_type", "state").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT year(opening_date) AS year, notice_type, count(*) AS notices, count(closing_date) AS dated FROM jobs WHERE opening_date IS NOT NULL GROUP BY 1, 2")
def notices_by_year(t, spark) -> DataFrame:
    return t("jobs").where("opening_date is not null").groupBy(F.year("opening_date").alias("year"), "notice_type").agg(F.count(F.lit(1)).alias("notices"), F.count("closing_date").alias("dated"))


@query("""SELECT source_id, id, title_raw FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_seen_at DESC NULLS LAST, id DESC, title_raw) AS k
FROM (SELECT DISTINCT source_id, id, title_raw, last_seen_at FROM raw_items WHERE source_id IS NOT NULL)) WHERE k = 1""")
def latest_per_source(t, spark) -> DataFrame:
    rows = t("raw_items").where("source_id is not null").select("source_id", "id", "title_raw", "last_seen_at").distinct()
    best = rows.groupBy("source_id").agg(F.max_by(F.struct("id", "title_raw"), F.struct(F.col("last_seen_at").isNotNull(), "last_seen_at", "id")).alias("b"))
    return best.select("source_id", "b.id", "b.title_raw")


@query("""SELECT s.id, r.canonical_key, r.status FROM (SELECT DISTINCT id, source_key FROM sources) s
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY fetched_at DESC NULLS LAST, canonical_key DESC, status) AS k FROM raw_notifications WHERE source_key IS NOT NULL) WHERE k = 1) r
ON s.source_key = r.source_key""")
def latest_notice_of_source(t, spark) -> DataFrame:
    notices = t("raw_notifications").where("source_key is not null").select("source_key", "canonical_key", "status", "fetched_at")
    latest = listing.latest_per_key(notices, ["source_key"], [F.col("fetched_at").desc_nulls_last(), F.col("canonical_key").desc(), F.col("status")])
    return t("sources").select("id", "source_key").distinct().join(latest, "source_key", "left").select("id", "canonical_key", "status")


@query("""SELECT DISTINCT j.id FROM jobs j WHERE EXISTS (SELECT 1 FROM raw_items r JOIN sources s ON r.source_id = s.id WHERE r.id = j.raw_item_id AND s.source_type = 'banking')""")
def jobs_of_banking_sources(t, spark) -> DataFrame:
    sources = t("sources").where("source_type = 'banking'").select(F.col("id").alias("source_id"))
    items = t("raw_items").join(sources, "source_id", "left_semi").select(F.col("id").alias("raw_item_id"))
    return t("jobs").join(items, "raw_item_id", "left_semi").select("id").distinct()


@query("""SELECT s.id, coalesce(c.chunk, 0) AS chunk, count(c.id) AS items, coalesce(string_agg(c.id, ',' ORDER BY c.id), '') AS item_ids FROM (SELECT DISTINCT id FROM sources) s
LEFT JOIN (SELECT source_id, id, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) // 1000 AS chunk FROM (SELECT DISTINCT source_id, id FROM raw_items WHERE id IS NOT NULL)) c
ON c.source_id = s.id GROUP BY s.id, c.chunk""")
def nested_items_of_source(t, spark) -> DataFrame:
    children = t("raw_items").where("id is not null").select(F.col("source_id").alias("sid"), F.col("id").alias("item")).distinct()
    nested = listing.nested_chunks(t("sources").select(F.col("id").alias("sid")).distinct(), children, "sid", ["item"], "items_", 1000)
    return nested.select(F.col("sid").alias("id"), "chunk", F.size("items_").cast("bigint").alias("items"), F.array_join(F.transform("items_", lambda x: x["item"]), ",").alias("item_ids"))


@query("""SELECT job_id, field_name, value, next_confidence FROM (SELECT job_id, field_name, value, lead(confidence) OVER w AS next_confidence, row_number() OVER w AS k
FROM (SELECT DISTINCT job_id, field_name, id, value, confidence FROM field_candidates) WINDOW w AS (PARTITION BY job_id, field_name ORDER BY confidence DESC NULLS LAST, id, value)) WHERE k = 1""")
def best_and_runner_up(t, spark) -> DataFrame:
    rows = t("field_candidates").select("job_id", "field_name", "id", "value", "confidence").distinct()
    best = listing.best_and_runner_up(rows, ["job_id", "field_name"], "confidence", [F.col("id"), F.col("value").asc_nulls_last()])
    return best.select("job_id", "field_name", "value", F.col("next_score").alias("next_confidence"))


@query("SELECT source_key, name FROM sources WHERE source_key = 'banking_jobs_000' OR id = 'banking_jobs_000' ORDER BY (source_key = 'banking_jobs_000') DESC, id LIMIT 1")
def lookup_by_key(t, spark) -> DataFrame:
    return listing.slug_or_id(t("sources"), "banking_jobs_000", "source_key", "id").select("source_key", "name")


# ------------------------------------------------------------------ text and keys


@query("""SELECT id, sha256(lower(trim(regexp_replace(coalesce(title_raw,''),'\\s+',' ','g'))) || '|' || coalesce(url_raw,'')) AS hash FROM (SELECT DISTINCT id, title_raw, url_raw FROM raw_items)""")
def content_hashes(t, spark) -> DataFrame:
    return t("raw_items").select("id", "title_raw", "url_raw").distinct().select("id", text.content_hash(F.col("title_raw"), F.col("url_raw")).alias("hash"))


@query("""SELECT id, CASE WHEN b = '' THEN 'job' ELSE b END || '-' || substr(sha1(id),1,8) AS slug FROM (SELECT id,
substr(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9\\s-]','','g')),'\\s+','-','g'),'-+','-','g'),1,120) AS b FROM (SELECT DISTINCT id, title FROM jobs))""")
def stable_slugs(t, spark) -> DataFrame:
    return t("jobs").select("id", "title").distinct().select("id", text.stable_slug(F.col("title"), F.col("id")).alias("slug"))


@query("""SELECT id, CASE WHEN h <> '' THEN regexp_replace(lower(h),'^www\\.','') END AS host FROM (SELECT id,
regexp_extract(CASE WHEN regexp_matches(trim(url_raw),'^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN trim(url_raw) ELSE 'http://' || trim(url_raw) END,
'^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/@?#]*@)?([^/:?#\\s]+)',1) AS h FROM (SELECT DISTINCT id, url_raw FROM raw_items WHERE url_raw IS NOT NULL))""")
def url_hosts(t, spark) -> DataFrame:
    return t("raw_items").where("url_raw is not null").select("id", "url_raw").distinct().select("id", urls.host(F.col("url_raw")).alias("host"))


@query("""SELECT id, list_max(list_transform(regexp_extract_all(coalesce(title_raw,''),'\\b(20\\d\\d)\\b',1), lambda x: CAST(x AS INTEGER))) AS year FROM (SELECT DISTINCT id, title_raw FROM raw_items)""")
def years_of_titles(t, spark) -> DataFrame:
    return t("raw_items").select("id", "title_raw").distinct().select("id", text.detect_year(F.coalesce("title_raw", F.lit(""))).alias("year"))


@query("""SELECT c.id, TRY_CAST(CASE WHEN m <> '' THEN regexp_replace(m,'^(\\d{1,2})[./-](\\d{1,2})[./-](\\d{4})$','\\3-\\2-\\1') END AS DATE) AS strict
FROM (SELECT DISTINCT id, regexp_extract(coalesce(value,''),'\\d{1,2}[./-]\\d{1,2}[./-]\\d{4}') AS m FROM field_candidates WHERE field_name LIKE '%_date') c""")
def strict_dates(t, spark) -> DataFrame:
    return t("field_candidates").where("field_name like '%_date'").select("id", values.strict_date(F.coalesce("value", F.lit(""))).alias("strict")).distinct()


@query("""SELECT id, CAST(make_date(y,1,1) + to_months(m-1) + to_days(d-1) AS DATE) AS rolled FROM (SELECT id, TRY_CAST(regexp_extract(v,p,1) AS INTEGER) AS d, TRY_CAST(regexp_extract(v,p,2) AS INTEGER) AS m, nullif(TRY_CAST(regexp_extract(v,p,3) AS INTEGER),0) AS y
FROM (SELECT DISTINCT id, coalesce(published_date_raw,'') AS v, '(\\d{1,2})[./-](\\d{1,2})[./-](\\d{4})' AS p FROM raw_items))""")
def rolling_dates(t, spark) -> DataFrame:
    return t("raw_items").select("id", F.coalesce("published_date_raw", F.lit("")).alias("v")).distinct().select("id", values.rolling_date(F.col("v")).alias("rolled"))


@query("""SELECT id, coalesce(TRY_CAST(regexp_extract(v,'(\\d+)',1) AS BIGINT), CASE WHEN regexp_matches(lower(v),'\\b(nil|free|exempted|no fee)\\b') THEN 0 END) AS amount
FROM (SELECT DISTINCT id, replace(coalesce(value,''),',','') AS v FROM field_candidates WHERE field_name = 'application_fee')""")
def fee_amounts(t, spark) -> DataFrame:
    return t("field_candidates").where("field_name = 'application_fee'").select("id", values.first_amount(F.col("value")).alias("amount")).distinct()


@query(f"""SELECT id, coalesce({', '.join(f"TRY_CAST(replace(regexp_extract(v,'{p}',1),',','') AS BIGINT)" for p in values.VACANCIES)}) AS vacancies FROM (SELECT DISTINCT id, coalesce(title,'') AS v FROM jobs)""")
def vacancies_of_titles(t, spark) -> DataFrame:
    return t("jobs").select("id", "title").distinct().select("id", values.vacancy_count(F.col("title")).alias("vacancies"))


@query("""SELECT id, TRY_CAST(l[1] AS INTEGER) AS least, TRY_CAST(l[2] AS INTEGER) AS most FROM (SELECT id, regexp_extract_all(v,'(\\d+)',1) AS l FROM
(SELECT DISTINCT id, coalesce(value,'') AS v FROM field_candidates WHERE field_name = 'age_limit'))""")
def age_ranges(t, spark) -> DataFrame:
    least, most = values.age_range(F.col("value"))
    return t("field_candidates").where("field_name = 'age_limit'").select("id", "value").distinct().select("id", least.alias("least"), most.alias("most"))


@query("""SELECT a.id, round(CASE WHEN greatest(len(x),len(y)) > 0 THEN len(list_intersect(x,y)) / greatest(len(x),len(y)) ELSE 0 END, 6) AS score FROM (SELECT DISTINCT j.id,
list_distinct(list_filter(string_split_regex(lower(coalesce(j.title,'')),'[^a-z0-9]+'), lambda w: len(w) >= 3)) AS x,
list_distinct(list_filter(string_split_regex(lower(coalesce(r.title_raw,'')),'[^a-z0-9]+'), lambda w: len(w) >= 3)) AS y FROM jobs j JOIN raw_items r ON j.raw_item_id = r.id) a""")
def title_overlap(t, spark) -> DataFrame:
    items = t("raw_items").select(F.col("id").alias("raw_item_id"), "title_raw")
    rows = t("jobs").select("id", "title", "raw_item_id").join(items, "raw_item_id").select("id", text.tokens(F.col("title"), 3).alias("x"), text.tokens(F.col("title_raw"), 3).alias("y")).distinct()
    return rows.select("id", F.round(text.token_score(F.col("x"), F.col("y")), 6).alias("score"))


# ------------------------------------------------------------------ de-duplication and merges


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def first_of_equal_texts(t, spark) -> DataFrame:
    return t("documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""SELECT canonical_key, epoch_us(updated_at) AS updated_us FROM (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY updated_at DESC NULLS LAST) AS k FROM raw_notifications) WHERE k = 1""")
def last_delivery(t, spark) -> DataFrame:
    return merge.last_wins(t("raw_notifications"), ["canonical_key"], ["updated_at"]).select("canonical_key", F.unix_micros("updated_at").alias("updated_us"))




@query("""SELECT DISTINCT id, source_id FROM raw_items WHERE status = 'new' UNION ALL SELECT DISTINCT id, source_id FROM raw_items r WHERE notice_type = 'result' AND NOT EXISTS (SELECT 1 FROM raw_items n WHERE n.status = 'new' AND n.id = r.id)""")
def insert_unseen(t, spark) -> DataFrame:
    items = t("raw_items").select("id", "source_id", "status", "notice_type")
    return merge.insert_unseen(items.where("status = 'new'").select("id", "source_id").distinct(), items.where("notice_type = 'result'").select("id", "source_id").distinct(), ["id"])


@query("""SELECT id, job_id FROM field_candidates WHERE source_type <> 'manual' AND job_id NOT IN (SELECT job_id FROM field_candidates WHERE source_type = 'manual' AND job_id IS NOT NULL)
UNION ALL SELECT id, job_id FROM field_candidates WHERE source_type = 'manual'""")
def replace_children(t, spark) -> DataFrame:
    rows = t("field_candidates").select("id", "job_id", "source_type")
    return merge.replace_children(rows.where("source_type <> 'manual'").select("id", "job_id"), rows.where("source_type = 'manual'").select("id", "job_id"), "job_id")


@query("""WITH j AS (SELECT DISTINCT id, lower(trim(post_name)) AS a, lower(trim(organization)) AS o, CAST(closing_date AS VARCHAR) AS d, raw_item_id AS u FROM jobs),
r1 AS (SELECT j.id, f AS duplicate_of, 1 AS rule FROM j JOIN (SELECT a, o, d, min(id) AS f FROM j WHERE a <> '' AND o <> '' AND d <> '' GROUP BY a, o, d) m USING (a, o, d) WHERE j.id > f),
r2 AS (SELECT j.id, f AS duplicate_of, 2 AS rule FROM j JOIN (SELECT u, min(id) AS f FROM j WHERE u <> '' GROUP BY u) m USING (u) WHERE j.id > f)
SELECT id, duplicate_of, rule FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rule, duplicate_of) AS k FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)) WHERE k = 1""")
def duplicate_rules(t, spark) -> DataFrame:
    rows = t("jobs").select("id", F.lower(F.trim("post_name")).alias("a"), F.lower(F.trim("organization")).alias("o"), "closing_date", "raw_item_id").distinct()
    return merge.duplicate_rules(rows, "id", [[F.col("a"), F.col("o"), F.col("closing_date")], [F.col("raw_item_id")]])


# ------------------------------------------------------------------ rival values


_UNPIVOT = " UNION ALL ".join(f"SELECT id, '{f}' AS field_name, {f} AS value FROM jobs WHERE trim({f}) <> ''" for f in RAW_FIELDS)


@query(f"SELECT DISTINCT id, field_name, value FROM ({_UNPIVOT})")
def field_unpivot(t, spark) -> DataFrame:
    return fuse.unpivot_fields(t("jobs"), ["id"], RAW_FIELDS).distinct()


_FIELDS = ["age_limit", "application_end_date", "application_fee", "application_start_date", "qualification", "salary", "selection_process", "total_vacancies"]
_PIVOT = ", ".join(f"min(value) FILTER (field_name = '{f}') AS {f}" for f in _FIELDS)


@query(f"SELECT job_id, {_PIVOT} FROM field_candidates GROUP BY job_id")
def field_pivot(t, spark) -> DataFrame:
    return fuse.pivot_fields(t("field_candidates"), "job_id", _FIELDS)


# What each kind of source counts for.
_PRIORITY = "CASE source_type WHEN 'manual' THEN 700 WHEN 'official_pdf' THEN 600 WHEN 'official_page' THEN 500 WHEN 'apply_page' THEN 400 WHEN 'regex' THEN 300 WHEN 'llm' THEN 200 WHEN 'aggregator' THEN 100 ELSE 0 END"


def _best(t) -> DataFrame:
    rank = F.expr(_PRIORITY) + F.coalesce("confidence", F.lit(0))
    return fuse.best_candidate(t("field_candidates").where("value is not null"), ["job_id", "field_name"], rank, [F.col("id"), F.col("value")])


_BEST_SQL = f"""SELECT job_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, field_name ORDER BY {_PRIORITY} + coalesce(confidence,0) DESC, id DESC, value DESC) AS k
FROM field_candidates WHERE value IS NOT NULL) WHERE k = 1"""


@query(_BEST_SQL)
def best_by_priority(t, spark) -> DataFrame:
    return _best(t)


@query(f"""WITH b AS ({_BEST_SQL}) SELECT c.job_id, c.field_name, b.value AS best_value, count(*) AS candidates, sum(CASE WHEN c.value IS NOT DISTINCT FROM b.value THEN 1 ELSE 0 END)::BIGINT AS agreeing,
round(sum(CASE WHEN c.value IS NOT DISTINCT FROM b.value THEN 1 ELSE 0 END) / count(*), 6) AS ratio, sum(CASE WHEN c.value IS NOT DISTINCT FROM b.value THEN 1 ELSE 0 END) / count(*) < 0.5 AS conflict
FROM field_candidates c JOIN b ON c.job_id = b.job_id AND c.field_name = b.field_name GROUP BY ALL""")
def agreement_ratio(t, spark) -> DataFrame:
    return fuse.agreement(t("field_candidates"), ["job_id", "field_name"], _best(t)).withColumn("ratio", F.round("ratio", 6))


@query("""WITH n AS (SELECT job_id, field_name, value, count(*) AS n FROM field_candidates WHERE value IS NOT NULL GROUP BY ALL)
SELECT a.job_id, a.field_name, a.value AS value_a, b.value AS value_b, a.n AS supporters_a, b.n AS supporters_b FROM n a JOIN n b ON a.job_id = b.job_id AND a.field_name = b.field_name AND a.value < b.value""")
def conflict_pairs(t, spark) -> DataFrame:
    return fuse.conflict_pairs(t("field_candidates"), ["job_id", "field_name"])


_WEIGHT = "CASE source_type WHEN 'manual' THEN 1.0 WHEN 'official_pdf' THEN 0.95 WHEN 'official_page' THEN 0.9 WHEN 'apply_page' THEN 0.8 WHEN 'regex' THEN 0.7 WHEN 'llm' THEN 0.6 ELSE 0.5 END"


@query(f"""WITH c AS (SELECT DISTINCT job_id, field_name, id, value, CAST({_WEIGHT} AS DOUBLE) * confidence / 100.0 AS s FROM field_candidates WHERE value IS NOT NULL AND confidence IS NOT NULL),
n AS (SELECT *, max(s) OVER (PARTITION BY job_id, field_name) - s < 0.01 AS near FROM c),
f AS (SELECT *, first(value) OVER (PARTITION BY job_id, field_name ORDER BY near DESC, id, value) AS fv FROM n),
r AS (SELECT *, CASE WHEN near AND value = fv THEN s * 1.2 ELSE s END AS s2 FROM f)
SELECT job_id, field_name, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, field_name ORDER BY s2 DESC, id, value) AS k FROM r) WHERE k = 1""")
def best_with_near_ties(t, spark) -> DataFrame:
    rows = t("field_candidates").where("value is not null and confidence is not null").select("job_id", "field_name", "id", "value", (F.expr(f"cast({_WEIGHT} as double)") * F.col("confidence") / F.lit(100.0)).alias("score")).distinct()
    return fuse.near_tie_candidate(rows, ["job_id", "field_name"], "score", "value", [F.col("id"), F.col("value")])


@query(f"""WITH b AS ({_BEST_SQL}), l AS (SELECT job_id, field_name, min(value) AS lv FROM field_candidates WHERE source_type = 'manual' GROUP BY ALL)
SELECT b.job_id, b.field_name, CASE WHEN l.job_id IS NOT NULL THEN lv ELSE value END AS value, l.job_id IS NOT NULL AS locked FROM b LEFT JOIN l ON b.job_id = l.job_id AND b.field_name = l.field_name""")
def locked_values(t, spark) -> DataFrame:
    locks = t("field_candidates").where("source_type = 'manual'").groupBy("job_id", "field_name").agg(F.min("value").alias("value"))
    return fuse.locked(_best(t), locks, ["job_id", "field_name"])


# ------------------------------------------------------------------ order within keys


@query("""WITH d AS (SELECT DISTINCT job_id, day FROM (SELECT job_id, datediff('day', DATE '2000-01-01', CAST(created_at AT TIME ZONE 'UTC' AS DATE))::INTEGER AS day FROM field_candidates WHERE job_id IS NOT NULL AND created_at IS NOT NULL)),
g AS (SELECT *, day - row_number() OVER (PARTITION BY job_id ORDER BY day) AS run FROM d) SELECT job_id, min(day) AS first, max(day) AS last FROM g GROUP BY job_id, run""")
def candidate_day_ranges(t, spark) -> DataFrame:
    day = F.datediff(F.to_date(F.timestamp_seconds(F.floor(F.unix_micros("created_at") / 1e6))), F.lit("2000-01-01").cast("date"))
    return sequences.contiguous_ranges(t("field_candidates").where("job_id is not null and created_at is not null").select("job_id", day.alias("day")), ["job_id"], "day")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS ok FROM events), l AS (SELECT user_id, max(struct_pack(a := ts, b := event_id)) FILTER (ok) AS last FROM e GROUP BY user_id)
SELECT e.user_id, sum(CASE WHEN l.last IS NULL OR struct_pack(a := e.ts, b := e.event_id) > l.last THEN 1 ELSE 0 END)::BIGINT AS failures FROM e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id""")
def events_since_purchase(t, spark) -> DataFrame:
    return sequences.failures_since_success(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "failures")


@query(f"""WITH s AS (SELECT DISTINCT id, CASE WHEN coalesce(nullif(priority,0),50) >= 90 THEN 30 WHEN coalesce(nullif(priority,0),50) >= 70 THEN 120 WHEN coalesce(nullif(priority,0),50) >= 50 THEN 360 ELSE 1440 END AS p, coalesce(nullif(crawl_frequency_minutes,0),1440) AS c, coalesce(consecutive_failures,0) AS f, last_crawled_at AS l FROM sources WHERE is_active),
m AS (SELECT *, CASE WHEN f >= 5 THEN greatest(least(coalesce(c,p),p),1440) ELSE least(coalesce(c,p),p) END AS minutes FROM s)
SELECT id, minutes, l IS NULL OR epoch_us(l) + minutes::BIGINT * 60000000 <= epoch_us(TIMESTAMPTZ '{AS_OF}+00') AS due FROM m""")
def due_sources(t, spark) -> DataFrame:
    rows = t("sources").where("is_active").select("id", "priority", "crawl_frequency_minutes", "consecutive_failures", "last_crawled_at").distinct()
    minutes = sequences.crawl_frequency(F.col("priority"), F.col("crawl_frequency_minutes"), F.col("consecutive_failures"))
    as_of = F.lit(f"{AS_OF}+00:00").cast("timestamp")
    return rows.withColumn("minutes", minutes).select("id", "minutes", sequences.due(F.col("last_crawled_at"), F.col("minutes"), as_of).alias("due"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events)""")
def weekly_window_counts(t, spark) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequences.window_counts(t("events").select("event_id", "user_id", seconds.alias("s")), "user_id", "s", 7 * 86400).select("event_id", "in_window")


@query("""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events), g AS (SELECT user_id, list({a: CAST(NULL AS BIGINT), b: CAST(NULL AS BIGINT), s: s, id: event_id, ok: CAST([] AS BIGINT[])} ORDER BY s, event_id) AS l FROM e GROUP BY user_id),
r AS (SELECT user_id, list_reduce(l, lambda x, y: CASE WHEN x.a IS NULL OR x.a <= y.s - 86400 THEN {a: x.b, b: y.s, s: y.s, id: y.id, ok: list_append(x.ok, y.id)} ELSE x END, {a: CAST(NULL AS BIGINT), b: CAST(NULL AS BIGINT), s: CAST(0 AS BIGINT), id: CAST(0 AS BIGINT), ok: CAST([] AS BIGINT[])}).ok AS ok FROM g)
SELECT e.user_id, e.event_id, list_contains(r.ok, e.event_id) AS allowed FROM e JOIN r ON e.user_id = r.user_id""")
def rate_limited(t, spark) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return sequences.rate_limited(t("events").select("event_id", "user_id", seconds.alias("s")), "user_id", "event_id", "s", 2, 86400)


# ------------------------------------------------------------------ pages and payloads


_HREF = "<[aA] [^>]*?href=\"([^\"]*)\"[^>]*>([^<]*)</[aA]>"
_ANCHORS_SQL = f"""SELECT DISTINCT id, pos, href, trim(regexp_replace(replace(replace(replace(label,'&nbsp;',' '),'&gt;','>'),'&amp;','&'),'\\s+',' ','g')) AS label FROM (SELECT id, unnest(h) AS href, unnest(l) AS label, unnest(range(len(h)))::INTEGER AS pos
FROM (SELECT id, regexp_extract_all(raw_html,'{_HREF}',1) AS h, regexp_extract_all(raw_html,'{_HREF}',2) AS l FROM raw_items WHERE raw_html IS NOT NULL))"""


def _anchors(t) -> DataFrame:
    return pages.anchors(t("raw_items"), "id", "raw_html").distinct()


@query(_ANCHORS_SQL)
def page_anchors(t, spark) -> DataFrame:
    return _anchors(t)


@query(f"""WITH a AS ({_ANCHORS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(label), href ORDER BY pos) AS c FROM a WHERE length(label) >= 4
AND regexp_matches(lower(label || ' ' || href),'{WANTED}') AND NOT regexp_matches(lower(label || ' ' || href),'{NOISE}'))
SELECT id, pos, label, href FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM k WHERE c = 1) WHERE n <= 200""")
def notice_links(t, spark) -> DataFrame:
    return pages.notice_links(_anchors(t), "id", WANTED, NOISE)


@query(f"""WITH a AS ({_ANCHORS_SQL}), s AS (SELECT *, CASE WHEN regexp_matches(lower(label),'recruitment') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(lower(label),'result|admit') THEN 2 ELSE 0 END AS score FROM a)
SELECT id, href, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS k FROM s WHERE score > 0) WHERE k = 1""")
def scored_links(t, spark) -> DataFrame:
    label = F.lower("label")
    score = F.when(label.rlike("recruitment"), 4).otherwise(0) + F.when(label.rlike("result|admit"), 2).otherwise(0)
    return pages.scored_link(_anchors(t), "id", score)


@query(f"""WITH a AS ({_ANCHORS_SQL}) SELECT DISTINCT a.id, a.pos, regexp_extract(r.url_raw,'^(https?://[^/?#]+)',1) || a.href AS url FROM a JOIN (SELECT DISTINCT id, url_raw FROM raw_items) r ON a.id = r.id
WHERE a.href LIKE '/%' AND a.href NOT LIKE '//%' AND regexp_extract(r.url_raw,'^(https?://[^/?#]+)',1) <> ''""")
def resolved_links(t, spark) -> DataFrame:
    links = _anchors(t).join(t("raw_items").select("id", "url_raw").distinct(), "id").where(F.col("href").startswith("/") & ~F.col("href").startswith("//"))
    return pages.resolved(links, F.col("url_raw")).select("id", "pos", "url").distinct()


@query("""SELECT DISTINCT id, k AS key, json_extract_string(detected_dates, '$."' || k || '"') AS value FROM (SELECT id, detected_dates, unnest(json_keys(detected_dates)) AS k FROM raw_items WHERE detected_dates IS NOT NULL)""")
def json_entries(t, spark) -> DataFrame:
    return pages.json_values(t("raw_items"), "id", "detected_dates").distinct()


@query("""SELECT event_id, '{' || array_to_string(list_transform(json_keys(props), lambda k: '"' || k || '":"' || json_extract_string(props, '$.' || k) || '"'),',') || '}' AS object FROM events""")
def json_salvage(t, spark) -> DataFrame:
    wrapped = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" end"))
    return t("events").select("event_id", F.to_json(pages.json_salvage(wrapped, "map<string,string>")).alias("object"))


# ------------------------------------------------------------------ matching


@query("""WITH h AS (SELECT DISTINCT id, regexp_replace(lower(regexp_extract(trim(url_raw),'^[A-Za-z]+://(?:[^/@?#]*@)?([^/:?#\\s]+)',1)),'^www\\.','') AS host FROM raw_items WHERE url_raw IS NOT NULL),
d AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(trim(base_url),'^[A-Za-z]+://([^/:?#\\s]+)',1)),'^www\\.','') AS domain FROM sources WHERE base_url IS NOT NULL)
SELECT h.id, h.host, max_by(d.domain, length(d.domain)) AS matched FROM h LEFT JOIN d ON h.host = d.domain OR h.host LIKE '%.' || d.domain GROUP BY h.id, h.host""")
def domain_match(t, spark) -> DataFrame:
    domains = t("sources").where("base_url is not null").select(urls.host(F.col("base_url")).alias("domain"))
    return resolve.domain_match(t("raw_items").where("url_raw is not null").select("id", "url_raw").distinct(), "id", F.col("url_raw"), domains, "domain")


@query()
def similar_titles(t, spark) -> DataFrame:
    block = [F.lower(F.trim("organization")), F.col("opening_date")]
    return resolve.similar_titles(t("jobs").dropDuplicates(["id"]), "id", "title", block)

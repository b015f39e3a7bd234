"""Listings, relations and crawl state on whole tables, each query with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patrika.functions import extract, text, titles
from patrika.operators import feeds, listing, merge, sequences
from patrika.plans.extraction import PREFIXES
from patrika.plans.records import AS_OF, registrar

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

_NOW = f"TIMESTAMPTZ '{AS_OF}+00'"


def _as_of():
    return F.lit(f"{AS_OF}+00:00").cast("timestamp")


_J = "(SELECT DISTINCT id, title, organization, state, status, priority, published_at, opening_date, closing_date, created_at, total_vacancies, category, notice_url, post_name FROM jobs)"


def _jobs(t) -> DataFrame:
    return t("jobs").select("id", "title", "organization", "state", "status", "priority", "published_at", "opening_date", "closing_date", "created_at", "total_vacancies", "category", "notice_url", "post_name").distinct()


# ------------------------------------------------------------------ listings


@query(f"""WITH f AS (SELECT * FROM {_J} WHERE status = 'published' AND (lower(coalesce(title,'')) LIKE '%officer%' OR lower(coalesce(organization,'')) LIKE '%officer%'))
SELECT f.id, f.title, c.total FROM f CROSS JOIN (SELECT count(*) AS total FROM f) c ORDER BY published_at DESC NULLS FIRST, f.id LIMIT 50 OFFSET 10""")
def filtered_page_with_total(t, spark) -> DataFrame:
    rows = feeds.common_filters(_jobs(t), {"status": "published", "state": None}, "officer", ["title", "organization"])
    return feeds.page_with_total(rows, [F.col("published_at").desc_nulls_first(), F.col("id").asc()], 50, 10).select("id", "title", "total")


@query(f"""SELECT id, rank FROM (SELECT *, CASE WHEN closing_date >= DATE '{AS_OF[:10]}' - 5 THEN 0 WHEN closing_date IS NULL AND created_at >= {_NOW} - to_days(120) THEN 1 WHEN status = 'archived' THEN 3 ELSE 2 END AS rank, coalesce(opening_date, closing_date, CAST(published_at AT TIME ZONE 'UTC' AS DATE), CAST(created_at AT TIME ZONE 'UTC' AS DATE)) AS event
FROM {_J}) ORDER BY rank, closing_date ASC NULLS LAST, event DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 200""")
def by_business_order(t, spark) -> DataFrame:
    c = F.col
    rank = feeds.deadline_rank(c("closing_date"), c("created_at"), c("status"), _as_of(), 5, 120)
    event = F.coalesce(c("opening_date"), c("closing_date"), c("published_at").cast("date"), c("created_at").cast("date"))
    rows = _jobs(t).withColumns({"rank": rank, "event": event})
    order = [c("rank").asc(), c("closing_date").asc_nulls_last(), c("event").desc_nulls_first(), c("created_at").desc_nulls_first(), c("id").asc()]
    return listing.page(rows, order, 200).select("id", "rank")


@query(f"""SELECT id, year, published_us FROM (SELECT id, list_max(list_transform(regexp_extract_all(coalesce(title,''),'\\b(20\\d\\d)\\b',1), lambda x: CAST(x AS INTEGER))) AS year, epoch_us(coalesce(published_at, CAST(opening_date AS TIMESTAMP) AT TIME ZONE 'UTC', created_at)) AS published_us FROM {_J})
ORDER BY coalesce(year,0) DESC, coalesce(published_us,0) DESC, id LIMIT 1000""")
def latest_by_year(t, spark) -> DataFrame:
    at = F.unix_micros(F.coalesce("published_at", F.col("opening_date").cast("timestamp"), "created_at"))
    rows = _jobs(t).select("id", text.detect_year(F.coalesce("title", F.lit(""))).alias("year"), at.alias("published_us"))
    return rows.orderBy(F.coalesce("year", F.lit(0)).desc(), F.coalesce("published_us", F.lit(0)).desc(), "id").limit(1000)


@query(f"""SELECT id, section, place FROM (SELECT id, section, row_number() OVER (PARTITION BY section, state ORDER BY closing_date NULLS LAST, id) AS place, count(*) OVER (PARTITION BY section, state) AS n FROM (SELECT *, CASE WHEN opening_date > DATE '{AS_OF[:10]}' THEN 'upcoming' WHEN closing_date < DATE '{AS_OF[:10]}' THEN 'closed' ELSE 'open' END AS section FROM {_J})) WHERE place <= 5""")
def previews_by_section(t, spark) -> DataFrame:
    day = F.lit(AS_OF[:10]).cast("date")
    section = F.when(F.col("opening_date") > day, "upcoming").when(F.col("closing_date") < day, "closed").otherwise("open")
    place = F.row_number().over(Window.partitionBy("section", "state").orderBy(F.col("closing_date").asc_nulls_last(), "id"))
    # the limit of each group is taken before the shuffle too
    return _jobs(t).withColumn("section", section).withColumn("place", place).where("place <= 5").select("id", "section", "place")


_AGENCY = "CASE " + " ".join(f"WHEN starts_with(source_key,'{p}') THEN '{n}'" for p, n in PREFIXES.items()) + " ELSE 'Other' END"
_NOTICES = f"(SELECT canonical_key, title, {_AGENCY} AS agency, coalesce(published_on, fetched_at) AS seen_at FROM (SELECT canonical_key, source_key, max(title) AS title, max(published_on) AS published_on, max(fetched_at) AS fetched_at FROM raw_notifications GROUP BY ALL) WHERE source_key IS NOT NULL)"


def _notices(t) -> DataFrame:
    rows = t("raw_notifications").where("source_key is not null").groupBy("canonical_key", "source_key").agg(F.max("title").alias("title"), F.max("published_on").alias("published_on"), F.max("fetched_at").alias("fetched_at"))
    return rows.select("canonical_key", "title", titles.agency(F.col("source_key"), PREFIXES, "Other").alias("agency"), F.coalesce("published_on", "fetched_at").alias("seen_at"))


@query(f"SELECT agency, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, agency) AS place FROM {_NOTICES} WHERE year(seen_at AT TIME ZONE 'UTC') = 2024 GROUP BY agency")
def agency_facets(t, spark) -> DataFrame:
    return feeds.ordered_facet(_notices(t).where(F.year("seen_at") == 2024), "agency")


@query(f"""WITH n AS (SELECT * FROM {_NOTICES} WHERE year(seen_at AT TIME ZONE 'UTC') = 2024), b AS (SELECT * FROM n WHERE agency = 'Bank'), i AS (SELECT canonical_key, title FROM b ORDER BY canonical_key LIMIT 20 OFFSET 2),
f AS (SELECT agency, count(*) AS count FROM n GROUP BY agency)
SELECT CAST(to_json({{total: coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM b) WHERE (SELECT count(*) FROM i) > 0),0), "limit": 20, "offset": 2, agencies: (SELECT list({{agency: agency, count: count}} ORDER BY count DESC, agency) FROM f), items: coalesce((SELECT list({{canonical_key: canonical_key, title: title}} ORDER BY canonical_key) FROM i),[])}}) AS VARCHAR) AS body""")
def notices_response(t, spark) -> DataFrame:
    year = _notices(t).where(F.year("seen_at") == 2024).select("canonical_key", F.coalesce("title", F.lit("")).alias("title"), "agency")
    page = feeds.page_with_total(year.where("agency = 'Bank'"), [F.col("canonical_key").asc()], 20, 2)
    return feeds.response(page, ["canonical_key"], ["canonical_key", "title"], feeds.ordered_facet(year, "agency"), 20, 2)


@query(f"SELECT canonical_key, coalesce(epoch_us(TIMESTAMPTZ '2024-06-30 00:00:00+00') - epoch_us(seen_at) BETWEEN 0 AND 259200000000, FALSE) AS is_new FROM {_NOTICES}")
def new_notices(t, spark) -> DataFrame:
    as_of = F.lit("2024-06-30 00:00:00+00:00").cast("timestamp")
    return _notices(t).select("canonical_key", feeds.is_new(F.lit(None).cast("timestamp"), F.col("seen_at"), as_of).alias("is_new"))


@query("""SELECT j.id, coalesce(nullif(j.organization,''), d.name, 'Unknown') AS organization, coalesce(nullif(j.total_vacancies,0), d.n) AS vacancies, coalesce(nullif(j.notice_url,''), d.url) AS url FROM (SELECT DISTINCT id, organization, total_vacancies, notice_url, raw_item_id FROM jobs) j
LEFT JOIN (SELECT r.id, min(s.name) AS name, min(r.url_raw) AS url, min(length(r.title_raw)) AS n FROM raw_items r LEFT JOIN sources s ON r.source_id = s.id GROUP BY r.id) d ON j.raw_item_id = d.id""")
def detail_projection(t, spark) -> DataFrame:
    sources = t("sources").select(F.col("id").alias("source_id"), "name").distinct()
    items = t("raw_items").select(F.col("id").alias("raw_item_id"), "source_id", "url_raw", "title_raw").join(F.broadcast(sources), "source_id", "left")
    items = items.groupBy("raw_item_id").agg(F.min("name").alias("name"), F.min("url_raw").alias("url"), F.min(F.length("title_raw")).alias("n"))
    rows = t("jobs").select("id", "organization", "total_vacancies", "notice_url", "raw_item_id").distinct().join(items, "raw_item_id", "left")
    return rows.select("id", F.coalesce(extract.nonempty(F.col("organization")), "name", F.lit("Unknown")).alias("organization"), F.coalesce(F.nullif("total_vacancies", F.lit(0)), "n").alias("vacancies"), F.coalesce(extract.nonempty(F.col("notice_url")), "url").alias("url"))


@query("""SELECT DISTINCT canonical_key, concat_ws(' ', CASE WHEN trim(pdf_url) <> '' THEN 'notification:' || trim(pdf_url) END, CASE WHEN trim(detail_url) <> '' AND trim(detail_url) IS DISTINCT FROM trim(pdf_url) THEN 'notification:' || trim(detail_url) END, CASE WHEN trim(apply_url) <> '' THEN 'apply:' || trim(apply_url) END) AS links,
coalesce(nullif(trim(apply_url),''),'') AS apply FROM raw_notifications""")
def link_arrays(t, spark) -> DataFrame:
    c = F.col
    links = feeds.link_array((c("pdf_url"), "notification", "PDF", True), (c("detail_url"), "notification", "Page", False), (c("pdf_url"), "notification", "PDF again", False), (c("apply_url"), "apply", "Apply", False))
    shown = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["kind"], x["url"])), " ")
    return t("raw_notifications").select("canonical_key", links.alias("l")).select("canonical_key", shown.alias("links"), feeds.link_by_kind(F.col("l"), "apply").alias("apply")).distinct()


# ------------------------------------------------------------------ relations


@query("""WITH w AS (SELECT id, o, seen, list_distinct(list_filter(string_split(h,' '), lambda x: length(x) > 2)) AS k FROM (SELECT DISTINCT id, lower(trim(organization)) AS o, published_at AS seen, trim(regexp_replace(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')) AS h FROM jobs) WHERE o <> ''),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY seen DESC NULLS LAST, id, array_to_string(k,' ')) AS place FROM w) WHERE place <= 50), e AS (SELECT id, o, len(k) AS n, unnest(k) AS x FROM w), f AS (SELECT id, o, len(k) AS n, unnest(k) AS x FROM c),
s AS (SELECT a.id, b.id AS related, count(*) / greatest(a.n, b.n) AS score FROM e a JOIN f b ON a.o = b.o AND a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, related)) SELECT id, related, round(score,6) AS score FROM r WHERE k = 1 AND score >= 0.6 AND score - coalesce(nxt,0) >= 0.12""")
def related_recruitments(t, spark) -> DataFrame:
    """Candidates are the 50 latest of the organisation, as the operator has it: however large one is, a row meets no more."""
    plain = text.squeeze(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^a-z0-9\s]", " "))
    words = F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.length(w) > 2))
    rows = t("jobs").select("id", F.lower(F.trim("organization")).alias("o"), "published_at", words.alias("k")).distinct().where("o != ''")
    place = F.row_number().over(Window.partitionBy("o").orderBy(F.col("published_at").desc_nulls_last(), "id", F.array_join("k", " ")))
    latest = rows.withColumn("_place", place).where("_place <= 50")
    return feeds.related_hint(rows, latest, "o", "id", "k", 0.6, 0.12).withColumn("score", F.round("score", 6))


@query("""WITH n AS (SELECT DISTINCT canonical_key AS k, coalesce(nullif(apply_url,''), nullif(pdf_url,'')) AS u, apply_url AS a, pdf_url AS b FROM raw_notifications), h AS (SELECT k, a AS u FROM n UNION SELECT k, b FROM n)
SELECT n.k AS canonical_key, min(h.k) AS duplicate_of FROM n JOIN h ON n.u = h.u AND h.k <> n.k WHERE h.u <> '' GROUP BY n.k""")
def address_duplicates(t, spark) -> DataFrame:
    return feeds.either_column_duplicates(t("raw_notifications").select("canonical_key", "apply_url", "pdf_url").distinct(), "canonical_key", "apply_url", "pdf_url")


@query("""SELECT r.id AS item, coalesce(j.id, k.id) AS target FROM (SELECT DISTINCT id, title_raw FROM raw_items) r LEFT JOIN (SELECT raw_item_id, min(id) AS id FROM jobs WHERE raw_item_id IS NOT NULL GROUP BY 1) j ON r.id = j.raw_item_id
LEFT JOIN (SELECT lower(trim(title)) AS t, min(id) AS id FROM jobs WHERE title IS NOT NULL GROUP BY 1) k ON lower(trim(r.title_raw)) = k.t""")
def target_jobs(t, spark) -> DataFrame:
    own = t("jobs").where("raw_item_id is not null").groupBy(F.col("raw_item_id").alias("item")).agg(F.min("id").alias("_own"))
    hinted = t("jobs").where("title is not null").groupBy(F.lower(F.trim("title")).alias("t")).agg(F.min("id").alias("_hint"))
    rows = t("raw_items").select(F.col("id").alias("item"), F.lower(F.trim("title_raw")).alias("t")).distinct()
    return rows.join(own, "item", "left").join(hinted, "t", "left").select("item", F.coalesce("_own", "_hint").alias("target"))


@query("""SELECT DISTINCT j.id, r.id AS page, length(r.raw_text) AS chars FROM jobs j JOIN raw_items r ON j.raw_item_id = r.id WHERE r.raw_text IS NOT NULL AND j.detailed_description IS NULL""")
def pages_for_repair(t, spark) -> DataFrame:
    pages = t("raw_items").where("raw_text is not null").select(F.col("id").alias("raw_item_id"), F.length("raw_text").alias("chars"))
    return t("jobs").where("detailed_description is null").select("id", "raw_item_id").join(pages, "raw_item_id").select("id", F.col("raw_item_id").alias("page"), "chars").distinct()


# ------------------------------------------------------------------ fields of a record


@query("""SELECT id, round((CASE WHEN trim(title) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(organization) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(state) <> '' THEN 1 ELSE 0 END + CASE WHEN total_vacancies > 0 THEN 1 ELSE 0 END + CASE WHEN closing_date IS NOT NULL THEN 1 ELSE 0 END) / 5, 2) AS found,
concat_ws(',', CASE WHEN coalesce(trim(organization),'') = '' THEN 'organization' END, CASE WHEN closing_date IS NULL THEN 'closing_date' END) AS missing FROM """ + _J)
def found_fractions(t, spark) -> DataFrame:
    c = F.col
    has = [F.trim(c("title")) != "", F.trim(c("organization")) != "", F.trim(c("state")) != "", c("total_vacancies") > 0, c("closing_date").isNotNull()]
    fraction = sum(F.when(h, 1).otherwise(0) for h in has) / F.lit(5)
    absent = F.filter(F.array(*[F.when(~F.coalesce(h, F.lit(False)), F.lit(n)) for h, n in zip(has, ("title", "organization", "state", "total_vacancies", "closing_date"))]), lambda x: x.isNotNull())
    critical = F.array_intersect(absent, F.array(F.lit("organization"), F.lit("closing_date")))
    return _jobs(t).select("id", F.round(fraction, 2).alias("found"), F.array_join(critical, ",").alias("missing"))


@query("""SELECT job_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(source_type) FILTER (rejected AND source_type IS NOT NULL),[]), coalesce(list(field_name) FILTER (confidence < 40),[])))),',') AS warnings FROM field_candidates GROUP BY job_id""")
def warning_unions(t, spark) -> DataFrame:
    rows = t("field_candidates").groupBy("job_id").agg(F.collect_set(F.when(F.col("rejected"), F.col("source_type"))).alias("a"), F.collect_set(F.when(F.col("confidence") < 40, F.col("field_name"))).alias("b"))
    return rows.select("job_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("warnings"))


@query("""SELECT id, CAST(to_json({id: id, title: title, closing: strftime(closing_date,'%Y-%m-%d'), vacancies: total_vacancies}) AS VARCHAR) AS body FROM """ + _J + " WHERE title IS NOT NULL AND closing_date IS NOT NULL AND total_vacancies IS NOT NULL")
def serialized_records(t, spark) -> DataFrame:
    rows = _jobs(t).where("title is not null and closing_date is not null and total_vacancies is not null")
    return rows.select("id", F.to_json(F.struct("id", "title", F.date_format("closing_date", "yyyy-MM-dd").alias("closing"), F.col("total_vacancies").alias("vacancies"))).alias("body"))


@query("""SELECT event_id, user_id IS NOT DISTINCT FROM lag_user AS same FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS lag_user FROM events)""")
def equal_neighbours(t, spark) -> DataFrame:
    # the neighbour by number is found by a join: ids are consecutive or nothing
    rows = t("events").select("event_id", "user_id")
    ranged = rows.withColumn("_b", F.floor(F.col("event_id") / 10_000))
    w = Window.partitionBy("_b").orderBy("event_id")
    inner = ranged.withColumns({"_k": F.row_number().over(w), "_p": F.lag("user_id").over(w)})
    last = ranged.groupBy("_b").agg(F.max_by("user_id", "event_id").alias("_last"))
    before = last.withColumn("_b2", F.lead("_b").over(Window.orderBy("_b"))).where("_b2 is not null").select(F.col("_b2").alias("_b"), "_last")
    joined = inner.join(F.broadcast(before), "_b", "left")
    return joined.select("event_id", F.col("user_id").eqNullSafe(F.when(F.col("_k") == 1, F.col("_last")).otherwise(F.col("_p"))).alias("same"))


@query("""SELECT DISTINCT id, coalesce(nullif(organization,''), category) AS organization, coalesce(nullif(post_name,''), title) AS post_name FROM jobs""")
def filled_blanks(t, spark) -> DataFrame:
    return feeds.filled_blanks(t("jobs").select("id", "organization", "category", "post_name", "title"), {"organization": "category", "post_name": "title"}).select("id", "organization", "post_name").distinct()


# ------------------------------------------------------------------ state


@query("""SELECT canonical_key, 'processing' AS status FROM (SELECT DISTINCT canonical_key, status, processed_at, updated_at FROM raw_notifications) WHERE processed_at IS NULL AND (status IN ('downloaded','new') OR (status = 'processing' AND updated_at < TIMESTAMPTZ '2024-06-30 00:00:00+00' - INTERVAL 30 MINUTE))""")
def claimed_notices(t, spark) -> DataFrame:
    rows = t("raw_notifications").select("canonical_key", "status", "processed_at", "updated_at").distinct()
    return feeds.claimed(rows, F.lit("2024-06-30 00:00:00+00:00").cast("timestamp")).select("canonical_key", "status")


_DELIVERED = "(SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY updated_at {0}, coalesce(title,''), coalesce(pdf_text,'')) AS k FROM raw_notifications)"


def _delivery(t, last: bool) -> DataFrame:
    """The first or last delivery of every notice."""
    at = F.col("updated_at").desc_nulls_last() if last else F.col("updated_at").asc_nulls_last()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return listing.latest_per_key(t("raw_notifications"), ["canonical_key"], [at, blank("title"), blank("pdf_text")])


_OLD, _NEW = _DELIVERED.format("ASC NULLS LAST"), _DELIVERED.format("DESC NULLS LAST")


@query(f"""SELECT n.canonical_key, sha256(coalesce(n.pdf_text,'') || coalesce(n.status,'') || coalesce(CAST(epoch_us(n.updated_at) AS VARCHAR),'')) AS digest FROM {_NEW} n JOIN {_OLD} o ON n.canonical_key = o.canonical_key WHERE n.k = 1 AND o.k = 1 AND sha256(coalesce(n.pdf_text,'') || coalesce(n.status,'') || coalesce(CAST(epoch_us(n.updated_at) AS VARCHAR),'')) <> sha256(coalesce(o.pdf_text,'') || coalesce(o.status,'') || coalesce(CAST(epoch_us(o.updated_at) AS VARCHAR),''))""")
def changed_content(t, spark) -> DataFrame:
    digest = lambda rows: rows.select("canonical_key", F.sha2(F.concat(F.coalesce("pdf_text", F.lit("")), F.coalesce("status", F.lit("")), F.coalesce(F.unix_micros("updated_at").cast("string"), F.lit(""))), 256).alias("digest"))
    return merge.changed_content(digest(_delivery(t, True)), digest(_delivery(t, False)), "canonical_key", "digest")


@query(f"""SELECT n.canonical_key, coalesce(n.status, o.status) AS status, coalesce(nullif(o.title,''), n.title, o.title) AS title, coalesce(n.status, o.status) IS DISTINCT FROM o.status OR coalesce(nullif(o.title,''), n.title, o.title) IS DISTINCT FROM o.title AS changed
FROM {_NEW} n JOIN {_OLD} o ON n.canonical_key = o.canonical_key WHERE n.k = 1 AND o.k = 1""")
def keyed_merge(t, spark) -> DataFrame:
    fields = lambda rows: rows.select("canonical_key", "status", "title")
    return merge.keyed_merge(fields(_delivery(t, False)), fields(_delivery(t, True)), ["canonical_key"], overwrite=["status"], fill=["title"])


@query(f"""SELECT coalesce(a.canonical_key, b.canonical_key) AS canonical_key, CASE WHEN a.canonical_key IS NULL THEN 'created' WHEN b.canonical_key IS NULL THEN 'removed' ELSE 'changed' END AS action,
CASE WHEN a.canonical_key IS NOT NULL AND b.canonical_key IS NOT NULL THEN concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.pdf_text IS DISTINCT FROM b.pdf_text THEN 'pdf_text' END, CASE WHEN a.updated_at IS DISTINCT FROM b.updated_at THEN 'updated_at' END) ELSE '' END AS changes
FROM (SELECT * FROM {_OLD} WHERE k = 1 AND updated_at < TIMESTAMPTZ '2024-01-01 00:00:00+00') a FULL JOIN (SELECT * FROM {_NEW} WHERE k = 1) b ON a.canonical_key = b.canonical_key
WHERE a.canonical_key IS NULL OR b.canonical_key IS NULL OR a.status IS DISTINCT FROM b.status OR a.pdf_text IS DISTINCT FROM b.pdf_text OR a.updated_at IS DISTINCT FROM b.updated_at""")
def audit_log(t, spark) -> DataFrame:
    before = _delivery(t, False).where("updated_at < timestamp '2024-01-01 00:00:00+00:00'")
    return feeds.audit_rows(before, _delivery(t, True), "canonical_key", ["status", "pdf_text", "updated_at"])


@query("SELECT sha256(pdf_text) || '.pdf' AS name, max(strlen(pdf_text)) AS bytes, count(*) AS \"references\" FROM raw_notifications WHERE pdf_text IS NOT NULL GROUP BY 1")
def stored_texts(t, spark) -> DataFrame:
    return feeds.stored_blobs(t("raw_notifications"), F.col("pdf_text").cast("binary"))


@query("""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type = 'purchase' AS ok FROM events), l AS (SELECT user_id, attempt, ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempt DESC) AS k FROM a) WHERE k = 1)
SELECT user_id, attempt + 1 AS attempt, attempt * 30 AS wait_seconds FROM l WHERE NOT ok AND attempt < 80""")
def retry_plans(t, spark) -> DataFrame:
    rows = t("events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))
    return feeds.retry_plan(rows, "user_id", 80)


@query("""WITH d AS (SELECT DISTINCT user_id, event_type = 'click' AS a, datediff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id, a ORDER BY day) AS run FROM d), r AS (SELECT user_id, a, min(day)::INTEGER AS first, max(day)::INTEGER AS last FROM g GROUP BY user_id, a, run)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first, a DESC) - 1 AS segment, CASE WHEN a THEN 'text' ELSE 'scan' END AS kind, first, last FROM r""")
def merged_segments(t, spark) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date"))
    rows = t("events").select("user_id", (F.col("event_type") == "click").alias("a"), day.alias("day"))
    ranges = lambda part: sequences.contiguous_ranges(part.select("user_id", "day"), ["user_id"], "day")
    return feeds.merged_segments(ranges(rows.where("a")), ranges(rows.where("not a")), ["user_id"], ("text", "scan"))


@query("""SELECT count(*) AS scanned, sum(CASE WHEN status = 'new' THEN 1 ELSE 0 END)::BIGINT AS fresh, sum(CASE WHEN pdf_text_extracted THEN 1 ELSE 0 END)::BIGINT AS extracted, count(DISTINCT canonical_key) AS notices FROM raw_notifications""")
def run_counters(t, spark) -> DataFrame:
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return t("raw_notifications").agg(F.count(F.lit(1)).alias("scanned"), one(F.col("status") == "new").alias("fresh"), one(F.col("pdf_text_extracted")).alias("extracted"), F.countDistinct("canonical_key").alias("notices"))


@query(f"""SELECT 'Rail,Bank' || coalesce(',' || string_agg(agency, ',' ORDER BY agency) FILTER (agency NOT IN ('Rail','Bank')),'') AS agencies FROM (SELECT DISTINCT agency FROM {_NOTICES})""")
def agency_list(t, spark) -> DataFrame:
    """The standing agencies in their order, then those found."""
    found = _notices(t).select("agency").distinct().agg(F.array_sort(F.collect_set("agency")).alias("f"))
    return found.select(F.array_join(F.array_distinct(F.concat(F.array(F.lit("Rail"), F.lit("Bank")), "f")), ",").alias("agencies"))

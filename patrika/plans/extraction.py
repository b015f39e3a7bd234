"""Names, dates, fees, counts and addresses out of titles and texts, each query with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patrika.functions import extract, text, titles, urls
from patrika.plans.records import registrar

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

DOMAINS = ["gov.example"]
PREFIXES = {"banking": "Bank", "railway": "Rail", "police": "Police", "court": "Court", "teaching": "School"}

_PDFS = "(SELECT DISTINCT canonical_key, pdf_text AS v FROM raw_notifications WHERE pdf_text IS NOT NULL)"
_ITEMS = "(SELECT DISTINCT id, coalesce(raw_text,'') AS v FROM raw_items)"


def _pdfs(t) -> DataFrame:
    return t("raw_notifications").where("pdf_text is not null").select("canonical_key", F.col("pdf_text").alias("v")).distinct()


def _items(t) -> DataFrame:
    return t("raw_items").select("id", F.coalesce("raw_text", F.lit("")).alias("v")).distinct()


def rx(column: str, pattern: str, group: int = 1) -> str:
    """SQL of a group of a pattern, null where it is not found."""
    return f"nullif(regexp_extract({column},'{pattern}',{group}),'')"


def first_rx(column: str, patterns: list[str]) -> str:
    return f"coalesce({', '.join(rx(column, p) for p in patterns)})"


def squeezed(sql: str) -> str:
    return f"trim(regexp_replace({sql},'\\s+',' ','g'))"


# ------------------------------------------------------------------ keys and names


@query(f"SELECT canonical_key, sha256(regexp_replace(replace(replace(v,chr(13),chr(10)),chr(9),' '),'\\n{{3,}}',chr(10)||chr(10),'g')) AS digest FROM {_PDFS}")
def pdf_texts_normalized(t, spark) -> DataFrame:
    return _pdfs(t).select("canonical_key", F.sha2(text.pdf_text(F.col("v")), 256).alias("digest"))


@query("""SELECT DISTINCT canonical_key, sha256('{"source":' || to_json(source_key) || ',"anchor":' || to_json(lower(trim(regexp_replace(title,'\\s+',' ','g')))) || '}') AS key FROM raw_notifications WHERE source_key IS NOT NULL AND title IS NOT NULL""")
def canonical_keys(t, spark) -> DataFrame:
    rows = t("raw_notifications").where("source_key is not null and title is not null")
    return rows.select("canonical_key", text.canonical_key(F.col("source_key"), text.norm_title(F.col("title"))).alias("key")).distinct()


@query("""SELECT DISTINCT canonical_key, CASE WHEN source_key LIKE 'banking%' THEN n || '::' || coalesce(strftime(published_on AT TIME ZONE 'UTC','%Y-%m-%d'),'') WHEN source_key LIKE 'police%' THEN n
WHEN source_key LIKE 'railway%' THEN coalesce(exam_id,'') || '::' || n || '::' || coalesce(status,'') ELSE coalesce(detail_url, pdf_url, n) END AS anchor FROM (SELECT *, lower(trim(regexp_replace(coalesce(title,''),'\\s+',' ','g'))) AS n FROM raw_notifications)""")
def dedupe_anchors(t, spark) -> DataFrame:
    key = F.col("source_key")
    kind = F.when(key.startswith("banking"), "dated").when(key.startswith("police"), "titled").when(key.startswith("railway"), "calendar").otherwise("address")
    anchor = text.dedupe_anchor(kind, F.col("title"), F.col("published_on"), F.col("exam_id"), F.col("status"), F.col("detail_url"), F.col("pdf_url"))
    return t("raw_notifications").select("canonical_key", anchor.alias("anchor")).distinct()


@query("""SELECT canonical_key FROM (SELECT canonical_key, row_number() OVER (PARTITION BY lower(trim(regexp_replace(coalesce(title,''),'\\s+',' ','g'))), coalesce(detail_url,''), coalesce(pdf_url,''), coalesce(exam_id,'') ORDER BY canonical_key) AS k
FROM raw_notifications) WHERE k = 1""")
def first_of_equal_notices(t, spark) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    key = [text.norm_title(blank(F.col("title"))).alias("a"), blank(F.col("detail_url")).alias("b"), blank(F.col("pdf_url")).alias("c"), blank(F.col("exam_id")).alias("d")]
    return t("raw_notifications").groupBy(*key).agg(F.min("canonical_key").alias("canonical_key")).select("canonical_key")


@query("""SELECT id, substr(regexp_replace(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),1,80) || '-' || substr(id,1,10) AS slug FROM (SELECT DISTINCT id, title FROM jobs)""")
def short_slugs(t, spark) -> DataFrame:
    return t("jobs").select("id", "title").distinct().select("id", text.short_slug(F.col("title"), F.col("id")).alias("slug"))


@query("""SELECT id, substr(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9\\s-]','','g')),'\\s+','-','g'),'-+','-','g'),1,140) AS slug FROM (SELECT DISTINCT id, title FROM jobs)""")
def slugs(t, spark) -> DataFrame:
    return t("jobs").select("id", "title").distinct().select("id", text.slugify(F.col("title")).alias("slug"))


@query("""SELECT DISTINCT canonical_key, CASE WHEN b = '' THEN 'file' ELSE b END AS base FROM (SELECT canonical_key, substr(regexp_replace(regexp_replace(regexp_replace(coalesce(pdf_url,''),'^.*/',''),'(.)\\.[^.]*$','\\1'),'[^A-Za-z0-9_-]','_','g'),1,80) AS b FROM raw_notifications)""")
def safe_file_bases(t, spark) -> DataFrame:
    return t("raw_notifications").select("canonical_key", text.safe_base(F.col("pdf_url")).alias("base")).distinct()


def _case_sql(sql: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({sql}),'([a-z0-9_]+|[^a-z0-9_]+)',1), lambda p: upper(substr(p,1,1)) || substr(p,2)),'')"


def _year_sql(sql: str) -> str:
    single = f"list_transform(regexp_extract_all(coalesce({sql},''),'\\b(20\\d{{2}})\\b',1), lambda y: CAST(y AS INTEGER))"
    ends = f"list_transform(regexp_extract_all(coalesce({sql},''),'\\b(20\\d{{2}}\\s*[-/]\\s*\\d{{2}})\\b',1), lambda s: {{a: CAST(substr(s,1,4) AS INTEGER), b: CAST(substr(s,1,2) || right(s,2) AS INTEGER)}})"
    return f"list_max(list_concat({single}, list_transform(list_filter({ends}, lambda s: s.b >= s.a AND s.b <= s.a + 5), lambda s: s.b)))"


def _raw_title_sql(sql: str) -> str:
    return squeezed(f"regexp_replace(regexp_replace(coalesce({sql},''),'{titles.CALLS}','','g'),'{titles.TAIL}','')")


def _acronym_sql(sql: str) -> str:
    for name in titles.ACRONYMS:
        sql = f"regexp_replace({sql},'\\b{name.capitalize()}\\b','{name}','g')"
    return sql


_LIKELY = "(length({0}) BETWEEN 6 AND 180 AND NOT regexp_matches({0},'" + titles.NO_NAME + "') AND regexp_matches({0},'[A-Za-z]'))"


@query(f"""WITH j AS (SELECT DISTINCT id, title, organization, post_name, {squeezed("coalesce(post_name,'')")} AS p FROM jobs WHERE title IS NOT NULL AND organization IS NOT NULL),
w AS (SELECT *, CASE WHEN {_LIKELY.format('p')} THEN p END AS wanted FROM j), y AS (SELECT *, coalesce({_year_sql('wanted')}, {_year_sql('title')}) AS year, coalesce(nullif(wanted,''), nullif(title,''), title) AS base FROM w),
o AS (SELECT *, regexp_replace(regexp_replace({_raw_title_sql('base')},'(?i)^\\s*(?:engagement|recruitment)\\s+of\\s+',''),'(?i)^\\s*for\\s+the\\s+post\\s+of\\s+','') AS opened FROM y),
c AS (SELECT *, coalesce(nullif({squeezed(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(opened,'{titles.BRACKETED}','','g'),'{titles.TRAILING}','','g'),'{titles.TAIL}',''),'[.,;:]\\s*$','')")},''), nullif({_raw_title_sql('title')},''), organization || ' Recruitment') AS compact FROM o),
d AS (SELECT *, CASE WHEN regexp_matches(compact,'[A-Z]{{6,}}') THEN {_case_sql('compact')} ELSE compact END AS cased FROM c)
SELECT id, {squeezed(_acronym_sql("(CASE WHEN NOT regexp_matches(cased,'\\b20\\d{2}\\b') AND year IS NOT NULL THEN cased || ' ' || year ELSE cased END)"))} AS name FROM d""")
def exam_names(t, spark) -> DataFrame:
    rows = t("jobs").where("title is not null and organization is not null").select("id", "title", "organization", "post_name").distinct()
    return rows.select("id", titles.exam_name(F.col("title"), F.col("title"), F.col("organization"), F.col("post_name")).alias("name"))


_SCORE = f"(CASE WHEN length(x) BETWEEN 12 AND 180 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x,'{titles.NAMED}') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(x,'{titles.META}') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(x,'{titles.HEADER}') THEN 4 ELSE 0 END)"


@query(f"""WITH l AS (SELECT canonical_key, v, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM (SELECT canonical_key, v, list_slice(list_filter(list_transform(string_split(v,chr(10)), lambda x: {squeezed('x')}), lambda x: x <> ''),1,80) AS lines FROM {_PDFS})),
s AS (SELECT *, {_SCORE} AS score FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY canonical_key, v ORDER BY score DESC, i) AS a FROM s)
SELECT b.canonical_key, CASE WHEN b.score >= 1 THEN b.x ELSE f.x END AS heading FROM (SELECT * FROM k WHERE a = 1) b JOIN (SELECT * FROM s WHERE i = 0) f ON b.canonical_key = f.canonical_key AND b.v = f.v""")
def headings(t, spark) -> DataFrame:
    return _pdfs(t).select("canonical_key", titles.best_heading(F.col("v")).alias("heading")).where("heading is not null")


@query(f"""SELECT id, {squeezed(f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title_raw,'')),'{titles.HINT_WORDS}',' ','g'),'\\b\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{2,4}}\\b',' ','g'),'[^a-z0-9\\s]',' ','g')")} AS hint FROM (SELECT DISTINCT id, title_raw FROM raw_items)""")
def hint_titles(t, spark) -> DataFrame:
    return t("raw_items").select("id", "title_raw").distinct().select("id", titles.hint_title(F.col("title_raw")).alias("hint"))


@query(f"""SELECT id, length(v) BETWEEN 10 AND 220 AND NOT regexp_matches(v,'{titles.MENU}') AND NOT regexp_matches(v,'{titles.ASIDE}') AND (regexp_matches(v,'{titles.EXAM}') OR regexp_matches(v,'\\b20\\d{{2}}\\b')) AS exam,
{_LIKELY.format(squeezed('v'))} AS name FROM (SELECT DISTINCT id, coalesce(title_raw,'') AS v FROM raw_items)""")
def likely_titles(t, spark) -> DataFrame:
    return t("raw_items").select("id", F.coalesce("title_raw", F.lit("")).alias("v")).distinct().select("id", titles.is_likely_exam(F.col("v")).alias("exam"), titles.is_likely_name(F.col("v")).alias("name"))


@query(f"SELECT id, {_year_sql('title')} AS year FROM (SELECT DISTINCT id, title FROM jobs)")
def years_and_spans(t, spark) -> DataFrame:
    return t("jobs").select("id", "title").distinct().select("id", titles.detect_year(F.col("title")).alias("year"))


# ------------------------------------------------------------------ labelled lines and values


_INLINE = lambda sql: f"nullif(trim(regexp_replace(regexp_replace({sql},'\\s+',' ','g'),'^[:\\-.\\s]+','')),'')"


@query(f"SELECT id, {', '.join('coalesce(' + ', '.join(_INLINE(f'''regexp_extract(v,'{p}',1)''') for p in ps) + f') AS {name}' for name, ps in extract.LINE_VALUES.items())} FROM {_ITEMS}")
def line_values(t, spark) -> DataFrame:
    return _items(t).select("id", *[extract.line_value(F.col("v"), ps).alias(name) for name, ps in extract.LINE_VALUES.items()])


@query(f"""SELECT DISTINCT id, CASE WHEN s <> '' AND length(s) <= 220 AND NOT regexp_matches(s,'{extract.REJECTED}') AND regexp_matches(s,'{extract.PAY_WORDS}') THEN s END AS pay,
CASE WHEN s <> '' AND length(s) <= 40 AND NOT regexp_matches(s,'{extract.REJECTED}') THEN s END AS short FROM (SELECT id, {squeezed('value')} AS s FROM field_candidates)""")
def sanitized_values(t, spark) -> DataFrame:
    v = F.col("value")
    return t("field_candidates").select("id", extract.sanitized(v, 220, require=extract.PAY_WORDS).alias("pay"), extract.sanitized(v, 40).alias("short")).distinct()


@query("""SELECT DISTINCT id, array_to_string(list_filter(list_transform(regexp_split_to_array(value,'[,;/\\n]+'), lambda x: trim(x)), lambda x: x <> ''),'|') AS parts FROM field_candidates WHERE field_name = 'selection_process' AND value IS NOT NULL""")
def process_parts(t, spark) -> DataFrame:
    rows = t("field_candidates").where("field_name = 'selection_process' and value is not null")
    return rows.select("id", F.array_join(text.parts(F.col("value")), "|").alias("parts")).distinct()


@query("""SELECT job_id, nullif(concat_ws(' | ', 'Fee: ' || max(value) FILTER (field_name = 'application_fee'), 'Age: ' || max(value) FILTER (field_name = 'age_limit')),'') AS summary FROM field_candidates GROUP BY job_id""")
def fee_age_summaries(t, spark) -> DataFrame:
    last = lambda name: F.max(F.when(F.col("field_name") == name, F.col("value")))
    whole = F.concat_ws(" | ", F.concat(F.lit("Fee: "), last("application_fee")), F.concat(F.lit("Age: "), last("age_limit")))
    return t("field_candidates").groupBy("job_id").agg(whole.alias("_s")).select("job_id", F.nullif("_s", F.lit("")).alias("summary"))


@query("""SELECT id, CASE WHEN length(raw_html) > 0 THEN format('({:.2f} KB)', strlen(raw_html) / 1024.0) ELSE '--' END AS size FROM (SELECT DISTINCT id, raw_html FROM raw_items)""")
def page_size_labels(t, spark) -> DataFrame:
    return t("raw_items").select("id", "raw_html").distinct().select("id", text.size_label(F.octet_length("raw_html")).alias("size"))


@query("SELECT DISTINCT id, coalesce(strftime(closing_date,'%d %b %Y'),'Not decided yet') AS label FROM jobs")
def closing_labels(t, spark) -> DataFrame:
    return t("jobs").select("id", text.date_label(F.col("closing_date")).alias("label")).distinct()


# ------------------------------------------------------------------ dates


def _rolled_sql(y: str, m: str, d: str) -> str:
    return f"CAST(make_date({y},1,1) + to_months({m} - 1) + to_days({d} - 1) AS DATE)"


def _parse_sql(token: str) -> str:
    """SQL of parse_date."""
    plain, before, after = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})$", r"^(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})$", r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$"
    n = lambda p, k: f"TRY_CAST(regexp_extract({token},'{p}',{k}) AS INTEGER)"
    month = lambda p, k: f"list_position({extract.MONTHS!r}, lower(substr(regexp_extract({token},'{p}',{k}),1,3)))"
    worded = lambda p, d, m: f"WHEN {month(p, m)} > 0 AND {n(p, d)} BETWEEN 1 AND 31 THEN {_rolled_sql(n(p, 3), f'CAST({month(p, m)} AS INTEGER)', n(p, d))}"
    year = f"CASE WHEN {n(plain, 3)} < 100 THEN {n(plain, 3)} + 2000 ELSE {n(plain, 3)} END"
    return f"CASE WHEN {n(plain, 3)} IS NOT NULL THEN {_rolled_sql(f'({year})', n(plain, 2), n(plain, 1))} {worded(before, 1, 2)} {worded(after, 2, 1)} END"


@query(f"SELECT id, {_parse_sql('v')} AS day FROM (SELECT DISTINCT id, regexp_replace(trim(value),',$','') AS v FROM field_candidates WHERE field_name LIKE '%_date' AND value IS NOT NULL)")
def parsed_dates(t, spark) -> DataFrame:
    rows = t("field_candidates").where("field_name like '%_date' and value is not null").select("id", F.regexp_replace(F.trim("value"), ",$", "").alias("v")).distinct()
    return rows.select("id", extract.parse_date(F.col("v")).alias("day"))


@query(f"""SELECT id, coalesce({_parse_sql('a')}, {_parse_sql('b')}) AS closing FROM (SELECT id, regexp_extract(v,'{extract.CLOSING[0]}',1) AS a, regexp_extract(v,'{extract.CLOSING[1]}',1) AS b FROM {_ITEMS})""")
def closing_dates_of_texts(t, spark) -> DataFrame:
    return _items(t).select("id", extract.first_date(F.col("v"), extract.CLOSING).alias("closing"))


@query("""SELECT id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i),',') AS days FROM (SELECT id, list_filter(list_transform(regexp_extract_all(v,'\\b(\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})\\b',1),
lambda s: CAST(TRY_CAST(split_part(translate(s,'/','-'),'-',3) || '-' || lpad(split_part(translate(s,'/','-'),'-',2),2,'0') || '-' || lpad(split_part(translate(s,'/','-'),'-',1),2,'0') AS DATE) AS VARCHAR)), lambda x: x IS NOT NULL) AS d FROM """ + _ITEMS + ")")
def strict_dates_of_texts(t, spark) -> DataFrame:
    return _items(t).select("id", F.array_join(extract.strict_dates(F.col("v")).cast("array<string>"), ",").alias("days"))


@query(f"""SELECT id, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i),',') AS days FROM (SELECT id, list_transform(regexp_extract_all(v,'(\\d{{1,2}}[./-]\\d{{1,2}}[./-]\\d{{4}})',1), lambda s: CAST({_parse_sql('s')} AS VARCHAR)) AS d FROM {_ITEMS})""")
def rolling_dates_of_texts(t, spark) -> DataFrame:
    return _items(t).select("id", F.array_join(extract.rolling_dates(F.col("v")).cast("array<string>"), ",").alias("days"))


@query("""SELECT DISTINCT id, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR),2,'0') AS session FROM (SELECT id, year(opening_date) AS y FROM jobs)""")
def sessions(t, spark) -> DataFrame:
    return t("jobs").select("id", extract.session_of(F.year("opening_date")).alias("session")).distinct()


@query("""SELECT DISTINCT r.id, CAST(r.created_at AT TIME ZONE s.time_zone AS DATE) AS day FROM raw_items r JOIN (SELECT DISTINCT id, time_zone FROM sources WHERE time_zone IS NOT NULL) s ON r.source_id = s.id""")
def local_days(t, spark) -> DataFrame:
    zones = t("sources").where("time_zone is not null").select(F.col("id").alias("source_id"), "time_zone").distinct()
    return t("raw_items").join(zones, "source_id").select("id", F.to_date(F.from_utc_timestamp("created_at", F.col("time_zone"))).alias("day")).distinct()


# ------------------------------------------------------------------ amounts and counts


@query(f"""SELECT id, {squeezed(first_rx('v', extract.SALARY))} AS salary, {squeezed(first_rx('v', extract.PAY_LEVEL))} AS pay_level, {squeezed(first_rx('v', extract.FEE))} AS fee FROM {_ITEMS}""")
def pay_and_fee(t, spark) -> DataFrame:
    found = lambda ps: text.squeeze(extract.first_match(F.col("v"), ps))
    return _items(t).select("id", found(extract.SALARY).alias("salary"), found(extract.PAY_LEVEL).alias("pay_level"), found(extract.FEE).alias("fee"))


_MONEY = lambda s: f"coalesce(TRY_CAST(replace(regexp_extract({s},'(\\d{{1,3}}(?:,\\d{{3}})+|\\d+)',1),',','') AS BIGINT), CASE WHEN regexp_matches({s},'{extract.NO_MONEY}') THEN 0 END)"


@query(f"""WITH l AS (SELECT id, list_filter(list_transform(string_split(replace(v,chr(13),''),chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {_ITEMS}),
f AS (SELECT id, array_to_string(list_filter(l, lambda x, i: regexp_matches(x,'(?i)\\bfee\\b') OR (i > 1 AND regexp_matches(l[i-1],'(?i)\\bfee\\b')) OR (i > 2 AND regexp_matches(l[i-2],'(?i)\\bfee\\b'))),chr(10)) AS a FROM l)
SELECT id, {', '.join(f"list_filter(list_transform(regexp_extract_all(a,'(?i)({p}[^\\n]{{0,120}})',1), lambda s: {_MONEY('s')}), lambda m: m IS NOT NULL)[1] AS {name}" for name, p in extract.FEE_CATEGORIES.items())} FROM f""")
def fees_by_category(t, spark) -> DataFrame:
    area = _items(t).select("id", extract.fee_area(F.col("v")).alias("area"))
    return area.select("id", *[extract.amount_for(F.col("area"), p).alias(name) for name, p in extract.FEE_CATEGORIES.items()])


@query(f"""SELECT DISTINCT id, CASE WHEN value = '' THEN NULL WHEN regexp_matches(value,'{extract.ZERO_TOKEN}') THEN 0 ELSE TRY_CAST(regexp_replace(value,'[^\\d]','','g') AS BIGINT) END AS n FROM field_candidates WHERE field_name = 'total_vacancies'""")
def int_tokens(t, spark) -> DataFrame:
    return t("field_candidates").where("field_name = 'total_vacancies'").select("id", extract.int_token(F.col("value")).alias("n")).distinct()


_TOKEN_SQL = f"CASE WHEN regexp_matches(s,'{extract.ZERO_TOKEN}') THEN 0 ELSE TRY_CAST(s AS BIGINT) END"
_ADDED = lambda r: " + ".join(f"coalesce({r}.{k},0)" for k in ("sc", "st", "obc", "ews", "general"))
_CATEGORIES = f"""(SELECT canonical_key, v, list_reduce(rows, lambda b, r: CASE WHEN (coalesce(r.total,0) > 0 AND {_ADDED('r')} > 0 AND abs({_ADDED('r')} - coalesce(r.total,0)) <= 2 AND NOT (coalesce(b.total,0) > 0 AND {_ADDED('b')} > 0)) OR coalesce(r.total,0) > coalesce(b.total,0) THEN r ELSE b END) AS c
FROM (SELECT canonical_key, v, list_transform(list_filter(list_transform(list_filter(list_transform(string_split(v,chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x,'(?i)^total\\b')), lambda x: list_transform(regexp_extract_all(x,'(\\d+|--)',1), lambda s: {_TOKEN_SQL})), lambda f: len(f) >= 5),
lambda f: {{sc: f[1], st: f[2], obc: f[3], ews: CASE WHEN len(f) >= 6 THEN f[4] END, general: CASE WHEN len(f) >= 6 THEN f[5] ELSE f[4] END, total: CASE WHEN len(f) >= 6 THEN f[6] ELSE f[5] END}}) AS rows FROM {_PDFS}) WHERE len(rows) > 0)"""


@query(f"SELECT canonical_key, c.sc, c.st, c.obc, c.ews, c.general, c.total FROM {_CATEGORIES}")
def category_counts(t, spark) -> DataFrame:
    return _pdfs(t).select("canonical_key", extract.category_vacancies(F.col("v")).alias("c")).where("c is not null").select("canonical_key", "c.sc", "c.st", "c.obc", "c.ews", "c.general", "c.total")


@query(f"""SELECT id, coalesce({', '.join(f"CASE WHEN TRY_CAST(replace(regexp_extract(v,'{p}',1),',','') AS BIGINT) > 0 THEN TRY_CAST(replace(regexp_extract(v,'{p}',1),',','') AS BIGINT) END" for p in extract.VACANCY_TOTAL)}) AS vacancies FROM (SELECT DISTINCT id, coalesce(title,'') || chr(10) || coalesce(detailed_description,'') AS v FROM jobs) WHERE NOT regexp_matches(v,'(?i)(^|\\n)\\s*total\\b')""")
def vacancy_totals(t, spark) -> DataFrame:
    rows = t("jobs").select("id", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("detailed_description", F.lit(""))).alias("v")).distinct().where(~F.col("v").rlike(r"(?i)(^|\n)\s*total\b"))
    return rows.select("id", extract.vacancy_total(F.col("v"), extract.category_vacancies(F.col("v"))).alias("vacancies"))


@query(f"""SELECT id, CASE WHEN {rx('v', extract.AGE_RANGE)} IS NOT NULL THEN CAST({rx('v', extract.AGE_RANGE)} AS INTEGER) ELSE CAST({rx('v', extract.AGE_MIN)} AS INTEGER) END AS least,
CASE WHEN {rx('v', extract.AGE_RANGE)} IS NOT NULL THEN CAST({rx('v', extract.AGE_RANGE, 2)} AS INTEGER) ELSE CAST({rx('v', extract.AGE_MAX)} AS INTEGER) END AS most FROM {_ITEMS}""")
def ages_of_texts(t, spark) -> DataFrame:
    least, most = extract.stated_ages(F.col("v"))
    return _items(t).select("id", least.alias("least"), most.alias("most"))


@query(f"""SELECT DISTINCT id, CASE WHEN n BETWEEN 1 AND 1000000 THEN n END AS n, round(least(greatest(confidence / 70.0, 0.0), 1.0), 3) AS confidence FROM (SELECT id, confidence, CASE WHEN regexp_matches(trim(value),'{extract.TEXT_NUMBER}') THEN 0.0 ELSE TRY_CAST(nullif(regexp_replace(trim(value),'[^\\d.\\-]','','g'),'') AS DOUBLE) END AS n
FROM field_candidates WHERE field_name = 'total_vacancies')""")
def bounded_counts(t, spark) -> DataFrame:
    rows = t("field_candidates").where("field_name = 'total_vacancies'")
    return rows.select("id", extract.bounded(extract.to_number(F.col("value")), 1, 1_000_000).alias("n"), extract.clamp(F.col("confidence") / F.lit(70.0)).alias("confidence")).distinct()


# ------------------------------------------------------------------ addresses


@query("""SELECT DISTINCT canonical_key, CASE WHEN regexp_matches(lower(u),'^https?://[^\\s/]+') THEN u END AS url FROM (SELECT canonical_key, regexp_replace(regexp_replace(trim(x),'^[<(\\["'']+',''),'[>)\\]"''.,;]+$','') AS u FROM (SELECT canonical_key, '<' || detail_url || '>, ' AS x FROM raw_notifications WHERE detail_url IS NOT NULL))""")
def unwrapped_urls(t, spark) -> DataFrame:
    rows = t("raw_notifications").where("detail_url is not null")
    return rows.select("canonical_key", urls.http_url(F.concat(F.lit("<"), "detail_url", F.lit(">, "))).alias("url")).distinct()


_TEXT_URLS = """(SELECT DISTINCT canonical_key, 'See ' || coalesce(detail_url,'') || ' (' || coalesce(pdf_url,'') || ') or ' || coalesce(substr(apply_url,9),'') || '.' AS v FROM raw_notifications)"""
_BARE = "(?i)\\b((?:https?://)?(?:www\\.)?(?:gov\\.example)(?:/[^\\s\"''<>]*)?)"


@query(f"""SELECT canonical_key, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i),' ') AS urls FROM (SELECT canonical_key, list_filter(list_transform(list_transform(list_concat(regexp_extract_all(v,'(?i)(https?://[^\\s"''<>]+)',1), regexp_extract_all(v,'{_BARE}',1)),
lambda x: CASE WHEN regexp_matches(x,'(?i)^https?://') THEN x ELSE 'https://' || x END), lambda x: regexp_replace(x,'[>)\\]"''.,;]+$','')), lambda x: regexp_matches(lower(x),'^https?://(?:[^/:?#\\s]+\\.)?gov\\.example(?:[/:?#]|$)')) AS u FROM {_TEXT_URLS})""")
def official_urls_of_texts(t, spark) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    v = F.concat(F.lit("See "), blank(F.col("detail_url")), F.lit(" ("), blank(F.col("pdf_url")), F.lit(") or "), blank(F.expr("substring(apply_url, 9)")), F.lit("."))
    return t("raw_notifications").select("canonical_key", v.alias("v")).distinct().select("canonical_key", F.array_join(urls.urls_of_text(F.col("v"), DOMAINS), " ").alias("urls"))


@query("""SELECT DISTINCT canonical_key, coalesce(nullif(trim(apply_url),''), nullif(trim(pdf_url),''), nullif(trim(detail_url),''),'') AS first, regexp_matches(coalesce(pdf_url,''),'(?i)\\.pdf(?:[/?]|$)') AS document,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(pdf_url,'^[a-zA-Z]+://[^/?#]+([^?#]*)',1),'^.*/',''),'(?i)\\.[a-z0-9]+$',''),'[+_]',' ','g')) AS title FROM raw_notifications""")
def chosen_urls(t, spark) -> DataFrame:
    c = F.col
    return t("raw_notifications").select("canonical_key", urls.first_url(c("apply_url"), c("pdf_url"), c("detail_url")).alias("first"), urls.is_document(c("pdf_url")).alias("document"), urls.title_of_url(c("pdf_url")).alias("title")).distinct()


@query("""SELECT DISTINCT r.id, CASE WHEN regexp_matches(u,'^https?://') THEN u WHEN u LIKE '/%' AND regexp_extract(coalesce(s.base_url,''),'^(https?://[^/?#]+)',1) <> '' THEN regexp_extract(s.base_url,'^(https?://[^/?#]+)',1) || u WHEN u LIKE 'www.%' THEN 'https://' || u ELSE '' END AS url
FROM (SELECT id, source_id, trim(coalesce(url_raw,'')) AS u FROM raw_items) r JOIN (SELECT DISTINCT id, base_url FROM sources) s ON r.source_id = s.id""")
def absolute_urls(t, spark) -> DataFrame:
    bases = t("sources").select(F.col("id").alias("source_id"), "base_url").distinct()
    return t("raw_items").join(bases, "source_id").select("id", urls.ensure_absolute(F.col("url_raw"), F.col("base_url")).alias("url")).distinct()


@query("""SELECT DISTINCT id, array_to_string(list_transform(list_filter(string_split(replace(title,'\\','/'),'/'), lambda p: p <> ''), lambda p: replace(replace(replace(url_encode(p),'%2A','*'),'~','%7E'),'+','%20')),'/') AS path FROM jobs WHERE title IS NOT NULL""")
def attachment_paths(t, spark) -> DataFrame:
    return t("jobs").where("title is not null").select("id", urls.attachment_path(F.col("title")).alias("path")).distinct()


@query("""SELECT event_id, coalesce(trim(split_part(CASE WHEN event_id % 3 = 0 THEN '10.0.' || user_id || '.1, 10.9.9.9' END,',',1)), CASE WHEN event_id % 3 = 1 THEN 'peer-' || user_id END,'unknown') AS client FROM events""")
def client_keys(t, spark) -> DataFrame:
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0."), F.col("user_id").cast("string"), F.lit(".1, 10.9.9.9")))
    peer = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("peer-"), F.col("user_id").cast("string")))
    return t("events").select("event_id", urls.client_key(forwarded, peer).alias("client"))

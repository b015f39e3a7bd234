"""One surviving value for each field of each record, from rival candidates.

Rows are long: one candidate of one field. A candidate's value is brought to a canonical form by the kind of its
field, so that notations of one fact vote together. Its vote is the trust in its source, shifted by how its confidence
compares with what that source usually states, times a decay by how long before the field's last
announcement its value was first announced. The decay starts after `grace_days`, so the first reports of a field count
alike, while a later announcement outvotes what it replaces; it goes down to `floor`, so a lone weak late value does not.
The value with most votes survives (max_by); values that are only the beginning of a fuller rival cannot.

Fields of ordinary size take one shuffle, by record and field. Fields with more than `hot_rows` candidates are counted
beforehand and take a path in which no task holds a whole field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The source's usual confidence in (right, wrong) values and its log-odds of being right.
SOURCE_TRUST = {
    "manual": (96, 82, 3.0), "official_pdf": (87, 75, 3.1), "official_page": (84, 70, 2.8), "apply_page": (78, 63, 2.4),
    "llm": (73, 56, 1.6), "regex": (69, 53, 1.8), "aggregator": (58, 42, 0.8),
}
OTHER_TRUST = (75, 60, 0.8)
SPREAD = 8.5
REJECTED_SHIFT = -2.0

# Kinds of fields.
DATE_FIELDS = ("application_start_date", "application_end_date")
NUMBER_FIELDS = ("application_fee", "total_vacancies")
SPAN_FIELDS = ("age_limit", "salary")
FIELDS = ("age_limit", "application_end_date", "application_fee", "application_start_date", "qualification", "salary", "selection_process", "total_vacancies")

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _iso(text: Column) -> Column:
    """A full date in one of the usual notations, day before month, as YYYY-MM-DD; else null."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, f"{i + 1:02d}")])
    numeric, worded, american = r"^(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})$", r"^(\d{1,2})(?:st|nd|rd|th)?[ \-]([a-z]{3})[a-z]*\.?,?[ \-](\d{4})$", r"^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"
    part = lambda p, k: F.regexp_extract(text, p, k)
    joined = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date").cast("string"))
        .when(text.rlike(numeric), joined(part(numeric, 3), part(numeric, 2), part(numeric, 1)))
        .when(text.rlike(worded), joined(part(worded, 3), F.try_element_at(months, part(worded, 2)), part(worded, 1)))
        .when(text.rlike(american), joined(part(american, 3), F.try_element_at(months, part(american, 1)), part(american, 2)))
    )


def canonical(field: Column, value: Column) -> Column:
    """The fact a value states, alike for all its notations; null for null, blank and unreadable values.

    Dates as YYYY-MM-DD, single amounts as digits, spans as digits joined by "-", other fields as lower-case words.
    """
    text = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    amounts = F.regexp_replace(text, r"(?<=\d),(?=\d)", "")
    digits = F.array_join(F.regexp_extract_all(amounts, F.lit(r"(\d+)"), F.lit(1)), "-")
    words = F.trim(F.regexp_replace(F.regexp_replace(text, "&", " and "), r"[^\p{L}\p{M}\p{N}%]+", " "))
    plain = F.when(field.isin(*DATE_FIELDS), _iso(text)).when(field.isin(*NUMBER_FIELDS, *SPAN_FIELDS), digits).otherwise(words)
    return F.when(plain != "", plain)


def trust(source: Column, confidence: Column, rejected: Column) -> Column:
    """The vote of one candidate before decay, above 0."""
    def pick(k: int) -> Column:
        table = F.create_map(*[F.lit(x) for s, v in SOURCE_TRUST.items() for x in (s, float(v[k]))])
        return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.lit(float(OTHER_TRUST[k])))

    right, wrong = pick(0), pick(1)
    shift = F.coalesce((confidence - (right + wrong) / 2) * (right - wrong) / (SPREAD * SPREAD), F.lit(0.0))
    odds = pick(2) + F.least(F.greatest(shift, F.lit(-4.0)), F.lit(3.0)) + F.when(F.coalesce(rejected, F.lit(False)), REJECTED_SHIFT).otherwise(0.0)
    return F.greatest(odds, F.lit(0.02))


def candidate_votes(candidates: DataFrame) -> DataFrame:
    """(job_id, field_name, candidate_id, value, fact, vote, day): one row a candidate id, its first delivery kept by time and value."""
    rows = candidates.select(
        F.col("job_id").alias("job_id"), F.col("field_name").alias("field_name"), F.col("id").alias("candidate_id"),
        F.struct(F.col("created_at").alias("at"), F.col("value").alias("value"), F.col("source_type").alias("source"), F.col("confidence").alias("confidence"), F.col("rejected").alias("rejected")).alias("c"),
    ).where("job_id is not null and field_name is not null and candidate_id is not null")
    return rows


def _voted(rows: DataFrame) -> DataFrame:
    """Deduplicated by id and given facts and votes."""
    once = rows.groupBy("job_id", "field_name", "candidate_id").agg(F.min("c").alias("c"))
    return once.select(
        "job_id", "field_name", "candidate_id", F.col("c.value").alias("value"), canonical(F.col("field_name"), F.col("c.value")).alias("fact"),
        trust(F.col("c.source"), F.col("c.confidence").cast("double"), F.col("c.rejected")).alias("vote"), (F.unix_micros(F.col("c.at")) / 86400e6).alias("day"),
    )


def _decay(first: Column, last: Column, grace_days: float, half_life_days: float, floor: float) -> Column:
    age = F.greatest(F.coalesce(last - first, F.lit(0.0)) - grace_days, F.lit(0.0))
    return F.lit(floor) + (1 - floor) * F.pow(F.lit(2.0), -age / half_life_days)


def _full(field: Column, fact: Column, longest: Column) -> Column:
    """Whether a fact is whole: both numbers of a span, and for words no rival that goes on after it."""
    return F.when(field.isin(*SPAN_FIELDS), fact.contains("-")).when(field.isin(*DATE_FIELDS, *NUMBER_FIELDS), True).otherwise(~F.exists(longest, lambda x: x.startswith(F.concat(fact, F.lit(" ")))))


def _ordinary(rows: DataFrame, grace_days: float, half_life_days: float, floor: float) -> DataFrame:
    parted = _voted(rows.repartition("job_id", "field_name"))
    by_fact, by_field = Window.partitionBy("job_id", "field_name", "fact"), Window.partitionBy("job_id", "field_name")
    out = parted.withColumns({"votes": F.sum("vote").over(by_fact), "first": F.min("day").over(by_fact)})
    known = F.col("fact").isNotNull()
    out = out.withColumns({
        "last": F.max(F.when(known, F.col("first"))).over(by_field),
        "facts": F.collect_set("fact").over(by_field),
        "ids": F.count(F.lit(1)).over(by_field),
    })
    score = F.col("votes") * _decay(F.col("first"), F.col("last"), grace_days, half_life_days, floor)
    out = out.withColumn("score", F.when(known & _full(F.col("field_name"), F.col("fact"), F.col("facts")), score))
    return out.withColumn("winner", F.max(F.when(F.col("score").isNotNull(), F.struct("score", "fact"))).over(by_field)["fact"]).select(
        "job_id", "field_name", "candidate_id", "value", "fact", "vote", "ids", "winner")


def _hot(rows: DataFrame, grace_days: float, half_life_days: float, floor: float) -> DataFrame:
    key = ["job_id", "field_name"]
    voted = _voted(rows)
    facts = voted.where("fact is not null").groupBy(*key, "fact").agg(F.sum("vote").alias("votes"), F.min("day").alias("first"))
    fields = facts.groupBy(*key).agg(F.max("first").alias("last"))
    # a fact is only a beginning if some fact of its field has it among its own beginnings
    words = F.split("fact", " ")
    begins = (
        facts.where(~F.col("field_name").isin(*DATE_FIELDS, *NUMBER_FIELDS, *SPAN_FIELDS))
        .select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.when(k < F.size(words), F.array_join(F.slice(words, 1, k), " ")))).alias("fact"))
        .where("fact is not null").distinct().withColumn("begins", F.lit(True))
    )
    scored = facts.join(fields, key).join(begins, [*key, "fact"], "left").withColumn("score", F.col("votes") * _decay(F.col("first"), F.col("last"), grace_days, half_life_days, floor))
    whole = F.when(F.col("field_name").isin(*SPAN_FIELDS), F.col("fact").contains("-")).otherwise(F.col("begins").isNull())
    winners = scored.where(whole).groupBy(*key).agg(F.max(F.struct("score", "fact"))["fact"].alias("winner"))
    ids = voted.groupBy(*key).agg(F.count(F.lit(1)).alias("ids"))
    return voted.join(ids, key).join(winners, key, "left").select(*key, "candidate_id", "value", "fact", "vote", "ids", "winner")


def surviving_candidates(candidates: DataFrame, grace_days: float = 3.0, half_life_days: float = 0.5, floor: float = 0.06, hot_rows: int = 100_000) -> DataFrame:
    """(job_id, field_name, candidate_id, value, fact, vote, ids, winner): one row for each candidate id of each field.

    `candidates` has job_id, field_name, id, value, source_type, confidence, rejected and created_at; more columns are
    left out. fact is the candidate's canonical value, winner the surviving one of its field (null if none is whole),
    ids the number of different candidate ids. Rows without job, field or id are dropped: they name no candidate.
    Null and blank values have no fact and no vote; a null source, confidence or time counts as average or as first.
    Repeated rows of one id count once. Ties go to the greater fact.
    """
    rows = candidate_votes(candidates)
    hot = rows.groupBy("job_id", "field_name").count().where(F.col("count") > hot_rows).select("job_id", "field_name")
    if not hot.take(1):
        return _ordinary(rows, grace_days, half_life_days, floor)
    return _ordinary(rows.join(hot, ["job_id", "field_name"], "left_anti"), grace_days, half_life_days, floor).unionByName(
        _hot(rows.join(hot, ["job_id", "field_name"], "left_semi"), grace_days, half_life_days, floor))


def surviving_records(candidates: DataFrame, **settings) -> DataFrame:
    """One row a job with the surviving value of each field, as its most trusted candidate states it (ties: the least value)."""
    held = surviving_candidates(candidates, **settings).where(F.col("fact") == F.col("winner"))
    best = held.groupBy("job_id", "field_name").agg(F.min(F.struct((-F.col("vote")).alias("v"), F.trim("value").alias("value")))["value"].alias("value"))
    return best.groupBy("job_id").pivot("field_name", list(FIELDS)).agg(F.first("value"))

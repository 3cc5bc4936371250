"""Observations to claims to decisions, at an explicit instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopyard.functions import text

#: Days a field stays fresh; strength of a source type by field, for other types and fields.
TTL = {"business_status": 30, "business_hours": 21, "hours": 14, "specials": 14, "address": 90, "phone": 90}
STRENGTH = {
    "business_status": {"own_site": 1.0, "overture": 0.95, "overpass": 0.85, "human": 1.0, "aggregator": 0.25, "social": 0.2},
    "hours": {"own_site": 1.0, "overture": 0.4, "aggregator": 0.45, "human": 1.0, "social": 0.15, "overpass": 0.1},
    "business_hours": {"own_site": 1.0, "overture": 0.5, "aggregator": 0.4, "human": 1.0, "social": 0.1, "overpass": 0.1},
    "specials": {"own_site": 1.0, "aggregator": 0.4, "human": 1.0, "social": 0.2, "overture": 0.05, "overpass": 0.0},
}
OTHER_TTL, OTHER_STRENGTH = 30, 0.3
CLAIMABLE = ("business_status", "hours", "business_hours", "specials", "address", "phone")
CLOSED = ("permanently_closed", "temporarily_closed", "likely_closed")


def parse_time(observed: Column) -> Column:
    """A time with its zone, else the date at the head; null for neither."""
    whole = F.when(observed.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(observed))
    date = F.when(observed.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(F.concat(F.left(observed, F.lit(10)), F.lit("T00:00:00Z"))))
    return F.coalesce(whole, date)


def age_days(observed: Column, as_of: str) -> Column:
    """Days from an ISO time to ``as_of``; 999 if it can't be read, never below 0."""
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(parse_time(observed))) / F.lit(86_400e6)
    return F.coalesce(F.greatest(days, F.lit(0.0)), F.lit(999.0))


def ttl(field: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TTL.items() for x in kv]), field), F.lit(OTHER_TTL))


def strength(field: Column, source_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for f, row in STRENGTH.items() for t, v in row.items() for x in (f"{f}/{t}", v)])
    return F.coalesce(F.element_at(table, F.concat_ws("/", field, source_type)), F.lit(OTHER_STRENGTH))


def claim_weight(field: Column, source_type: Column, observed: Column, as_of: str) -> Column:
    """Strength of the source for the field, times the claim's freshness."""
    return strength(field, source_type) * text.freshness(age_days(observed, as_of), ttl(field))


def is_stale(field: Column, observed: Column, as_of: str) -> Column:
    return age_days(observed, as_of) > ttl(field)


def expires_at(field: Column, observed: Column) -> Column:
    """When a claim ceases to be fresh, in ISO form; null for a time that can't be read."""
    return F.date_format(F.timestamp_add("DAY", ttl(field), parse_time(observed)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unpivot_claims(obs: DataFrame, as_of: str) -> DataFrame:
    """(obs_id, venue_id, field, value, evidence, weight, expires_at, ...): one row for each filled payload field, lists as
    JSON; null, blank and empty values make none."""
    value = lambda f: F.when(F.size(f"payload.{f}") > 0, F.to_json(f"payload.{f}")) if f == "specials" else F.nullif(F.col(f"payload.{f}"), F.lit(""))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in CLAIMABLE])
    rows = obs.select("obs_id", "venue_id", "source_type", "source_family", "observed_at", F.left(F.coalesce("evidence_excerpt", F.lit("")), F.lit(400)).alias("evidence"), F.explode(fields).alias("c"))
    rows = rows.select("*", "c.field", "c.value").drop("c").where("value is not null")
    return rows.withColumn("weight", claim_weight(F.col("field"), F.col("source_type"), F.col("observed_at"), as_of)).withColumn("expires_at", expires_at(F.col("field"), F.col("observed_at")))


def value_key(value: Column) -> Column:
    """What equal values share: a text without case and outer spaces; the first 200 characters of a list or record."""
    return F.when(F.left(value, F.lit(1)).isin("[", "{"), F.left(value, F.lit(200))).otherwise(F.lower(F.trim(value)))


def collapse_by_family(claims: DataFrame, id_: str, weight: str, *rest: str) -> DataFrame:
    """One vote for each source family on a fact: the heaviest claim, the earlier of equals; of two values with equally
    heavy claims the one named first. ``rest``: further columns of that claim."""
    best = F.max(F.struct(F.col(weight).alias("weight"), (-F.col(id_)).alias("_id"), *rest)).alias("b")
    values = claims.groupBy("venue_id", "field", "source_family", "key").agg(best, F.min(id_).alias("_first"))
    first = F.max(F.struct("b.weight", (-F.col("_first")).alias("_first"), "key", "b")).alias("v")
    return values.groupBy("venue_id", "field", "source_family").agg(first).select("venue_id", "field", "source_family", "v.weight", "v.key", *[F.col(f"v.b.{c}").alias(c) for c in rest])


def agree(votes: DataFrame, as_of: str, gap: float = 0.15, enough: float = 0.7) -> DataFrame:
    """A decision for each fact of (venue_id, field, key, weight, source_type, observed_at): conflicted when the two best
    values are within ``gap``, stale when the best value's heaviest vote is, verified from ``enough`` weight on with a
    first-hand source, unverified otherwise. Sums are rounded to 6 places; ties go to the smaller value."""
    top = F.max(F.struct("weight", "observed_at")).alias("top")
    groups = votes.groupBy("venue_id", "field", "key").agg(F.round(F.sum("weight"), 6).alias("w"), F.max(F.col("source_type").isin("own_site", "human")).alias("first_hand"), top)
    w = Window.partitionBy("venue_id", "field").orderBy(F.desc("w"), "key")
    ranked = groups.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("w").over(w)).where("n = 1")
    kind = F.when(F.col("second").isNotNull() & (F.round(F.col("w") - F.col("second"), 6) < gap), "conflicted").when(is_stale(F.col("field"), F.col("top.observed_at"), as_of), "stale")
    return ranked.select("venue_id", "field", "key", "w", kind.when((F.col("w") >= enough) & F.col("first_hand"), "verified").otherwise("unverified").alias("kind"))


def agree_status(votes: DataFrame, as_of: str, strong: float = 0.4) -> DataFrame:
    """(venue_id, kind, value) of votes (venue_id, key, weight, source_type, source_family, observed_at) on whether a place
    is open. A strong sign of closing suppresses; weak ones conflict or ask for a review; open needs a first-hand source
    or two families, and isn't verified when its heaviest vote is stale."""
    closed, open_ = F.col("key").isin(*CLOSED), F.col("key") == "open"
    sure = closed & F.col("source_type").isin("overture", "own_site", "human", "overpass") & (F.col("weight") >= strong)
    best = lambda c: F.max(F.when(c, F.struct("weight", "key", "source_type", "observed_at")))
    v = votes.groupBy("venue_id").agg(
        best(sure).alias("sure"), best(open_).alias("open"), F.count_if(closed & ~sure).alias("weak"), F.count_if(open_).alias("n_open"),
        F.bool_or(open_ & F.col("source_type").isin("own_site", "human")).alias("own"), F.bool_and(F.when(open_, F.col("source_type") == "aggregator")).alias("listed"),
        F.count_distinct(F.when(open_, F.col("source_family"))).alias("families"),
    )
    told = (F.col("sure.source_type") == "human") | (F.col("sure.source_type") == "overture") & (F.col("sure.key") == "permanently_closed")
    verdict = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    unknown, as_open = F.lit("unknown"), F.lit("open")
    alone = F.coalesce(F.col("listed"), F.lit(False)) | ~(F.coalesce(F.col("own"), F.lit(False)) | (F.col("families") >= 2))
    d = (
        F.when(F.col("sure").isNotNull(), verdict("suppressed", F.when(told, F.col("sure.key")).otherwise("likely_closed")))
        .when(F.col("weak") >= 2, verdict("conflicted", F.lit("likely_closed"))).when((F.col("weak") >= 1) & (F.col("n_open") > 0), verdict("conflicted", unknown))
        .when(F.col("weak") == 1, verdict("needs_review", unknown)).when(F.col("n_open") == 0, verdict("unverified", unknown)).when(alone, verdict("unverified", as_open))
        .when(is_stale(F.lit("business_status"), F.col("open.observed_at"), as_of), verdict("stale", as_open)).otherwise(verdict("verified", as_open))
    )
    return v.select("venue_id", d.alias("d")).select("venue_id", "d.kind", "d.value")


def cascade(decisions: DataFrame) -> DataFrame:
    """(venue_id, field, kind, value): where a place's status is suppressed, so are its hours, closing hours and specials;
    specials lose their value. A null venue takes nothing over."""
    shut = decisions.where((F.col("field") == "business_status") & (F.col("kind") == "suppressed")).select("venue_id", F.lit(True).alias("_shut")).distinct()
    hit = F.coalesce("_shut", F.lit(False)) & F.col("field").isin("hours", "specials", "business_hours")
    rows = decisions.join(shut, "venue_id", "left")
    return rows.select("venue_id", "field", F.when(hit, "suppressed").otherwise(F.col("kind")).alias("kind"), F.when(~(hit & (F.col("field") == "specials")), F.col("value")).alias("value"))


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups down before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def failure_streak(df: DataFrame, by: str, order: list[str], ok: Column) -> DataFrame:
    """(by, streak): failures since the last success. Aggregated, without sorting a whole group in one task."""
    at = F.struct(*order)
    last = df.groupBy(by).agg(F.max(F.when(ok, at)).alias("_ok"))
    return df.join(last, by).groupBy(by).agg(F.count_if(~ok & (F.col("_ok").isNull() | (at > F.col("_ok")))).alias("streak"))

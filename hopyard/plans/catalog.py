"""The core queries over the project's tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopyard.functions import hours, text
from hopyard.operators import diff, matching, quality, truth
from hopyard.session import table
from hopyard.sources import in_box, in_categories

AS_OF = "2026-08-05T00:00:00Z"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query(
    r"""
    WITH r AS (SELECT snapshot_no, osm_key, amenity, row_no,
                      trim(regexp_replace(nfc_normalize(name), '\s+', ' ', 'g')) AS name
               FROM overpass WHERE osm_key IS NOT NULL AND osm_key <> '' AND snapshot_no IS NOT NULL),
    k AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, osm_key ORDER BY row_no DESC) AS n FROM r) WHERE n = 1),
    s AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS follows FROM (SELECT DISTINCT snapshot_no FROM overpass WHERE snapshot_no IS NOT NULL)),
    o AS (SELECT s.follows AS snapshot_no, k.osm_key, k.name, k.amenity FROM k JOIN s USING (snapshot_no) WHERE s.follows IS NOT NULL),
    n AS (SELECT k.* FROM k WHERE k.snapshot_no > (SELECT min(snapshot_no) FROM s))
    SELECT coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.osm_key, o.osm_key) AS osm_key,
           CASE WHEN o.osm_key IS NULL THEN 'added' WHEN n.osm_key IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM n FULL JOIN o ON n.snapshot_no = o.snapshot_no AND n.osm_key = o.osm_key
    WHERE o.osm_key IS NULL OR n.osm_key IS NULL OR n.name IS DISTINCT FROM o.name OR n.amenity IS DISTINCT FROM o.amenity
    """
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    values = {"name": diff.clean_name(F.col("name")), "amenity": F.col("amenity")}
    return diff.snapshot_changes(table(spark, folder, "overpass"), "snapshot_no", "osm_key", "row_no", values)


def _latest_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Each venue's newest filled hours and closing hours, and the specials of its newest observation with any."""
    obs = table(spark, folder, "observation").where("venue_id <> 'unassigned'")
    newest = lambda c, ok: F.max(F.when(ok, F.struct("observed_at", "obs_id", F.col(f"payload.{c}").alias("x")))).alias(c)
    best = obs.groupBy("venue_id").agg(newest("hours", F.trim("payload.hours") != ""), newest("business_hours", F.trim("payload.business_hours") != ""), newest("specials", F.size("payload.specials") > 0))
    return best.select("venue_id", F.col("hours.x").alias("hours"), F.col("business_hours.x").alias("business_hours"), F.col("specials.x").alias("specials"))


def _status(spark: SparkSession, folder: str, now: str) -> DataFrame:
    rows = _latest_hours(spark, folder)
    return rows.withColumn("s", hours.status(F.col("hours"), F.col("business_hours"), F.lit(now).cast("timestamp")))


def live_now(spark: SparkSession, folder: str, now: str = "2026-08-04 17:30:00") -> DataFrame:
    """All venues by status: live ones by end, then soon ones by start, then by name; each with its cheapest deal."""
    venues = table(spark, folder, "valid_base_config").select("id", "name")
    deal = F.array_min(F.transform(F.filter("specials", lambda s: s["price"] > 0), lambda s: F.struct(s["price"], s["item"])))
    rows = venues.join(_status(spark, folder, now), F.col("id") == F.col("venue_id"), "left").withColumn("deal", deal)
    kind = F.coalesce("s.kind", F.lit("unknown"))
    rank = F.when(kind == "live", 0).when(kind == "soon", 1).when(kind == "closed", 2).otherwise(3)
    return rows.select("id", "name", kind.alias("kind"), F.col("s.end_min").alias("end_min"), F.col("s.next_start_min").alias("next_start_min"), F.col("deal.price").alias("deal_price"), F.col("deal.item").alias("deal_item")).orderBy(rank, F.coalesce("end_min", "next_start_min", F.lit(9999)), F.lower("name"), "id")


_DAY = "mon|tue|wed|thu|fri|sat|sun"
_LIST = "['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun']"
_TIME = r"(\d{1,2})(?::(\d{2}))?(am|pm)?\s*-\s*"
_END = r"(\d{1,2})(?::(\d{2}))?(am|pm)?"
_MINUTES = "(CASE WHEN {half} = 'am' AND {h} = 12 THEN 0 WHEN {half} = 'pm' AND {h} <> 12 THEN {h} + 12 ELSE {h} END) * 60 + {m}"
_CLOCK = "coalesce(try_cast(regexp_extract(t, '{0}', {1}) AS INT), 0)"


def _clock(pattern: str, i: int) -> str:
    return _CLOCK.format(pattern, i)


def _within(day: int, a: str, b: str) -> str:
    return f"CASE WHEN {b} >= {a} THEN {day} BETWEEN {a} AND {b} ELSE {day} >= {a} OR {day} <= {b} END"


_FULL = f"^{_TIME}(close|{_END})$"
_PART = f"{_TIME}(close|midnight|{_END})"
_LATEST = """latest AS (SELECT venue_id, arg_max(payload.hours, row(observed_at, obs_id)) FILTER (trim(payload.hours) <> '') AS hours,
        arg_max(payload.business_hours, row(observed_at, obs_id)) FILTER (trim(payload.business_hours) <> '') AS business_hours,
        arg_max(payload.specials, row(observed_at, obs_id)) FILTER (len(payload.specials) > 0) AS specials
    FROM observation WHERE venue_id <> 'unassigned' GROUP BY venue_id)"""
#: The grammar of hours over a table ``latest``: segments, the days they carry on, and their windows in order.
_WINDOWS = rf"""
    seg AS (SELECT venue_id, i, trim(regexp_replace(parts[i], '\s+', ' ', 'g')) AS s FROM (SELECT venue_id, parts, unnest(range(1, len(parts) + 1)) AS i
            FROM (SELECT venue_id, string_split_regex(coalesce(hours, ''), '[&,]') AS parts FROM latest))),
    own AS (SELECT *, regexp_matches(f, '^(daily|({_DAY})(-({_DAY}))?)$') AS has FROM (SELECT *, lower(split_part(s, ' ', 1)) AS f FROM seg)),
    txt AS (SELECT *, lower(trim(CASE WHEN has THEN regexp_replace(s, '^\S+\s*', '') ELSE s END)) AS t, CASE WHEN NOT has THEN NULL WHEN f = 'daily' THEN 1 ELSE list_position({_LIST}, left(f, 3)) END AS a,
            CASE WHEN NOT has THEN NULL WHEN f = 'daily' THEN 7 ELSE list_position({_LIST}, right(f, 3)) END AS b FROM own),
    days AS (SELECT venue_id, i, t, coalesce(a, last_value(CASE WHEN t <> '' THEN a END IGNORE NULLS) OVER w) AS start_day, coalesce(b, last_value(CASE WHEN t <> '' THEN b END IGNORE NULLS) OVER w) AS end_day
             FROM txt WINDOW w AS (PARTITION BY venue_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    raw AS (SELECT *, coalesce(nullif(regexp_extract(t, '{_FULL}', 3), ''), 'pm') AS p, coalesce(nullif(regexp_extract(t, '{_FULL}', 7), ''), nullif(regexp_extract(t, '{_FULL}', 3), ''), 'pm') AS q FROM days
            WHERE start_day IS NOT NULL AND (t = 'all day' OR regexp_matches(t, '{_FULL}'))),
    ends AS (SELECT venue_id, i, start_day, end_day, t = 'all day' AS all_day, regexp_extract(t, '{_FULL}', 4) = 'close' AS close,
             CASE WHEN t = 'all day' THEN 0 ELSE {_MINUTES.format(half="p", h=_clock(_FULL, 1), m=_clock(_FULL, 2))} END AS start_min,
             CASE WHEN t = 'all day' OR regexp_extract(t, '{_FULL}', 4) = 'close' THEN 1439 ELSE {_MINUTES.format(half="q", h=_clock(_FULL, 5), m=_clock(_FULL, 6))} END AS e FROM raw),
    windows AS (SELECT venue_id, i, start_day, end_day, start_min, CASE WHEN e <= start_min THEN e + 1440 ELSE e END AS end_min, close, all_day FROM ends)"""
#: Status on a Tuesday at 17:30.
_STATUS = rf"""
    shut AS (SELECT venue_id, i, s, lower(trim(regexp_extract(s, '(?is)^(daily|(?:{_DAY})(?:-(?:{_DAY}))?)\s+(.+)$', 2))) AS t, lower(regexp_extract(s, '(?is)^(daily|(?:{_DAY})(?:-(?:{_DAY}))?)\s+(.+)$', 1)) AS f
             FROM (SELECT venue_id, i, trim(parts[i]) AS s FROM (SELECT venue_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT venue_id, string_split(coalesce(business_hours, ''), ',') AS parts FROM latest)))),
    shuts AS (SELECT venue_id, i, CASE f WHEN 'daily' THEN 1 ELSE list_position({_LIST}, left(f, 3)) END AS a, CASE f WHEN 'daily' THEN 7 ELSE list_position({_LIST}, right(f, 3)) END AS b,
              CASE regexp_extract(t, '{_PART}', 4) WHEN 'midnight' THEN 1440 WHEN 'close' THEN 1439 ELSE {_MINUTES.format(half=f"coalesce(nullif(regexp_extract(t, '{_PART}', 7), ''), nullif(regexp_extract(t, '{_PART}', 3), ''), 'pm')", h=_clock(_PART, 5), m=_clock(_PART, 6))} END AS shut
              FROM shut WHERE f <> '' AND NOT starts_with(t, 'closed') AND regexp_matches(t, '{_PART}')),
    closing AS (SELECT venue_id, arg_max(shut, i) AS shut FROM shuts WHERE {_within(2, "a", "b")} GROUP BY venue_id),
    settled AS (SELECT w.*, CASE WHEN close AND shut IS NOT NULL THEN CASE WHEN shut <= start_min THEN shut + 1440 ELSE shut END ELSE end_min END AS e FROM windows w LEFT JOIN closing USING (venue_id)),
    judged AS (SELECT venue_id, i, start_min, e, {_within(2, "start_day", "end_day")} AS today, e > 1440 AND ({_within(1, "start_day", "end_day")}) AND 1050 < e - 1440 AS spill FROM settled),
    status AS (SELECT l.venue_id, count(j.i) AS n, arg_min(CASE WHEN spill THEN e - 1440 ELSE e END, i) FILTER (spill OR today AND 1050 >= start_min AND 1050 < least(e, 1440)) AS live,
               min(start_min) FILTER (today AND 1050 < start_min AND start_min - 1050 <= 120) AS soon FROM latest l LEFT JOIN judged j USING (venue_id) GROUP BY l.venue_id),
    kinds AS (SELECT venue_id, CASE WHEN n = 0 THEN 'unknown' WHEN live IS NOT NULL THEN 'live' WHEN soon IS NOT NULL THEN 'soon' ELSE 'closed' END AS kind, CASE WHEN n > 0 THEN live END AS end_min,
              CASE WHEN live IS NULL THEN soon END AS next_start_min FROM status)"""


@query(
    f"""
    WITH {_LATEST}, {_WINDOWS}, {_STATUS}
    SELECT v.id, v.name, coalesce(kind, 'unknown') AS kind, end_min, next_start_min, d.price AS deal_price, d.item AS deal_item FROM valid_base_config v LEFT JOIN kinds k ON k.venue_id = v.id
    LEFT JOIN (SELECT venue_id, list_sort(list_transform(list_filter(specials, lambda x: x.price > 0), lambda x: {{'price': x.price, 'item': x.item}}))[1] AS d FROM latest) l ON l.venue_id = v.id
    """
)
def status_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return live_now(spark, folder)


@query(f"WITH {_LATEST}, {_WINDOWS}, {_STATUS} SELECT kind, count(*) AS n FROM kinds GROUP BY kind")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _status(spark, folder, "2026-08-04 17:30:00").groupBy(F.col("s.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LATEST}, {_WINDOWS} SELECT slot, count(DISTINCT venue_id) AS n FROM windows JOIN (SELECT unnest(range(840, 1291, 30))::INT AS slot) ON slot >= start_min AND slot < end_min WHERE {_within(2, 'start_day', 'end_day')} GROUP BY slot")
def live_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """Venues live at each half hour of an afternoon: a range join of windows and slots on the slot's minute."""
    windows = _latest_hours(spark, folder).select("venue_id", F.explode(hours.parse_hours(F.col("hours"))).alias("w")).where(hours.day_in(F.lit(2), F.col("w.start_day"), F.col("w.end_day")))
    slots = windows.select("venue_id", F.explode(F.filter(F.sequence(F.lit(840), F.lit(1290), F.lit(30)), lambda m: (m >= F.col("w.start_min")) & (m < F.col("w.end_min")))).alias("slot"))
    return slots.groupBy("slot").agg(F.count_distinct("venue_id").alias("n"))


@query(f"WITH {_LATEST}, {_WINDOWS} SELECT venue_id, i AS segment, start_day, end_day, start_min, end_min, close, all_day FROM windows".replace("SELECT venue_id, i AS segment", "SELECT venue_id, row_number() OVER (PARTITION BY venue_id ORDER BY i) - 1 AS segment"))
def hours_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _latest_hours(spark, folder).select("venue_id", F.posexplode(hours.parse_hours(F.col("hours"))).alias("segment", "w"))
    return rows.select("venue_id", "segment", "w.start_day", "w.end_day", "w.start_min", "w.end_min", "w.close", "w.all_day")


@query(f"WITH {_LATEST}, {_WINDOWS} SELECT venue_id, hours FROM latest WHERE trim(hours) <> '' AND venue_id NOT IN (SELECT venue_id FROM windows)")
def unreadable_hours(spark: SparkSession, folder: str) -> DataFrame:
    return _latest_hours(spark, folder).where((F.trim("hours") != "") & (F.size(hours.parse_hours(F.col("hours"))) == 0)).select("venue_id", "hours")


@query("SELECT cand_id, name FROM candidate WHERE contains(lower(name), 'bar') AND list_contains(tags, 'trivia')")
def search_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").where(F.contains(F.lower("name"), F.lit("bar")) & F.array_contains("tags", "trivia")).select("cand_id", "name")


@query("SELECT cand_id FROM candidate WHERE list_has_any(tags, ['patio', 'brunch'])")
def any_tag_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").where(F.arrays_overlap("tags", F.array(F.lit("patio"), F.lit("brunch")))).select("cand_id")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM candidate) GROUP BY tag")
def tag_facets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT venue_id, arg_min(item, k) AS item, min(price) AS price FROM (
        SELECT venue_id, s.item AS item, s.price AS price, row(s.price, obs_id, s.item) AS k
        FROM (SELECT venue_id, obs_id, unnest(payload.specials) AS s FROM observation) WHERE s.price > 0) GROUP BY venue_id
    """
)
def cheapest_deal(spark: SparkSession, folder: str) -> DataFrame:
    specials = table(spark, folder, "observation").select("venue_id", "obs_id", F.explode("payload.specials").alias("s")).where("s.price > 0")
    best = specials.groupBy("venue_id").agg(F.min(F.struct("s.price", "obs_id", "s.item")).alias("b"))
    return best.select("venue_id", "b.item", "b.price")


@query(
    r"""
    SELECT obs_id, s.item AS item, CASE WHEN s.price > 0 THEN printf('$%.2f', s.price)
        WHEN regexp_matches(coalesce(s.description, ''), '\$|cents|%|off|discount|half|bogo|special|deal|price|happy\s*hour|2\s*for\s*1|2-4-1|one\s*free', 'i') THEN '—' ELSE 'FREE' END AS label
    FROM (SELECT obs_id, unnest(payload.specials) AS s FROM observation)
    """
)
def price_labels(spark: SparkSession, folder: str) -> DataFrame:
    specials = table(spark, folder, "observation").select("obs_id", F.explode("payload.specials").alias("s"))
    return specials.select("obs_id", "s.item", text.price_label(F.col("s.price"), F.col("s.description")).alias("label"))


_NAME = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '^the ', ''), '^a ', ''), '^an ', ''))"
_NUMBER = r"regexp_extract(coalesce({0}, ''), '^\s*(\d+)', 1)"


@query(f"SELECT cand_id, {_NAME.format('name')} AS norm, {_NUMBER.format('address')} AS number FROM candidate")
def normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select("cand_id", text.norm_name(F.col("name")).alias("norm"), text.street_number(F.col("address")).alias("number"))


@query(f"SELECT min(cand_id) AS cand_id, k FROM (SELECT cand_id, {_NAME.format('name')} || '|' || {_NUMBER.format('address')} AS k FROM candidate) WHERE k IS NOT NULL GROUP BY k")
def dedup_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(text.norm_name(F.col("name")), F.lit("|"), text.street_number(F.col("address")))
    return table(spark, folder, "candidate").withColumn("k", key).where("k is not null").groupBy("k").agg(F.min("cand_id").alias("cand_id"))


_ADDRESS = r"array_to_string(list_filter(string_split(w, ' '), lambda x, i: i = 1 OR x <> string_split(w, ' ')[i - 1]), ' ')"
_WORDS = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[,.\-]+', ' ', 'g'), '\b(mt|montana)\b', '', 'g'), '\b\d{{5}}\b', '', 'g'), '\b(suite|unit|ste|apt)\b', '#', 'g'), '#\s*', '#', 'g'), '\s+', ' ', 'g'))"


def _normal(table_: str, id_: str, name: str, address: str) -> str:
    """SQL of (id, name, number, address), blank ones as null."""
    return f"SELECT id, nullif(n, '') AS name, nullif(k, '') AS number, nullif({_ADDRESS}, '') AS address FROM (SELECT {id_} AS id, {name} AS n, {_NUMBER.format(address)} AS k, {_WORDS.format(address)} AS w FROM {table_})"


@query(f"SELECT id AS cand_id, coalesce(address, '') AS address FROM ({_normal('candidate', 'cand_id', _NAME.format('name'), 'address')})")
def normal_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select("cand_id", text.norm_address(F.col("address")).alias("address"))


@query(f"""
    WITH c AS ({_normal("candidate", "cand_id", _NAME.format("name"), "address")}),
    r AS ({_normal("removed_venues", "tomb_no", f"coalesce(nullif({_NAME.format('name')}, ''), {_NAME.format('norm_name')})", "norm_address")})
    SELECT id AS cand_id FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.name = c.name AND (r.number = c.number OR r.address = c.address))
    """)
def tombstone_anti(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate")
    return rows.select("cand_id").join(matching.removed(rows, "cand_id", table(spark, folder, "removed_venues")), "cand_id", "left_anti")


@query(f"""
    WITH c AS ({_normal("candidate", "cand_id", _NAME.format("name"), "address")}), v AS ({_normal("valid_base_config", "config_no", _NAME.format("name"), "address")})
    SELECT id AS cand_id FROM c WHERE EXISTS (SELECT 1 FROM v WHERE v.name = c.name AND (v.number = c.number OR v.address = c.address) OR v.number = c.number AND v.address = c.address)
    """)
def duplicate_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return matching.duplicates(table(spark, folder, "candidate"), "cand_id", table(spark, folder, "valid_base_config"), "config_no")


#: Age, time to live and strength as the fixed tables give them, over a table ``x`` (field, source_type, observed_at).
_AGED = r"""
    SELECT *, strength * CASE WHEN days <= ttl THEN 1.0 WHEN days >= 2 * ttl THEN 0.0 ELSE 1.0 - (days - ttl) / ttl END AS claim_weight FROM (
        SELECT *, CASE field WHEN 'business_status' THEN 30 WHEN 'business_hours' THEN 21 WHEN 'hours' THEN 14 WHEN 'specials' THEN 14 WHEN 'address' THEN 90 WHEN 'phone' THEN 90 ELSE 30 END AS ttl,
            coalesce(greatest((epoch_us(TIMESTAMPTZ '2026-08-05 00:00:00+00') - epoch_us(seen)) / 86400e6, 0.0), 999.0) AS days,
            coalesce(map_extract_value(MAP {'business_status/own_site': 1.0, 'business_status/overture': 0.95, 'business_status/overpass': 0.85, 'business_status/human': 1.0, 'business_status/aggregator': 0.25, 'business_status/social': 0.2,
                'hours/own_site': 1.0, 'hours/overture': 0.4, 'hours/aggregator': 0.45, 'hours/human': 1.0, 'hours/social': 0.15, 'hours/overpass': 0.1,
                'business_hours/own_site': 1.0, 'business_hours/overture': 0.5, 'business_hours/aggregator': 0.4, 'business_hours/human': 1.0, 'business_hours/social': 0.1, 'business_hours/overpass': 0.1,
                'specials/own_site': 1.0, 'specials/aggregator': 0.4, 'specials/human': 1.0, 'specials/social': 0.2, 'specials/overture': 0.05, 'specials/overpass': 0.0}, field || '/' || source_type), 0.3)::DOUBLE AS strength
        FROM (SELECT *, coalesce(CASE WHEN regexp_matches(observed_at, '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)$') THEN try_cast(observed_at AS TIMESTAMPTZ) END,
            CASE WHEN regexp_matches(observed_at, '^\d{4}-\d\d-\d\d') THEN try_cast(left(observed_at, 10) || 'T00:00:00Z' AS TIMESTAMPTZ) END) AS seen FROM x))"""


@query(
    f"""
    WITH c AS (SELECT obs_id, venue_id, source_type, observed_at, unnest([{{'f': 'business_status', 'v': payload.business_status}}, {{'f': 'hours', 'v': payload.hours}}, {{'f': 'business_hours', 'v': payload.business_hours}},
        {{'f': 'specials', 'v': CASE WHEN len(payload.specials) > 0 THEN 'list' END}}, {{'f': 'address', 'v': payload.address}}, {{'f': 'phone', 'v': payload.phone}}]) AS e FROM observation),
    x AS (SELECT obs_id, venue_id, source_type, observed_at, e.f AS field, e.v AS value FROM c WHERE e.v <> '')
    SELECT obs_id, venue_id, field, value, round(claim_weight, 6) AS weight, strftime(seen::TIMESTAMP + to_days(ttl), '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM ({_AGED})
    """
)
def claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = truth.unpivot_claims(table(spark, folder, "observation"), AS_OF)
    return rows.select("obs_id", "venue_id", "field", F.when(F.col("field") == "specials", "list").otherwise(F.col("value")).alias("value"), F.round("weight", 6).alias("weight"), "expires_at")


@query(f"WITH x AS (SELECT * EXCLUDE (weight) FROM claim) SELECT claim_id, round(claim_weight, 6) AS weight, days > ttl AS stale, strftime(seen::TIMESTAMP + to_days(ttl), '%Y-%m-%dT%H:%M:%SZ') AS expires_at FROM ({_AGED})")
def claim_weights(spark: SparkSession, folder: str) -> DataFrame:
    field, kind, seen = F.col("field"), F.col("source_type"), F.col("observed_at")
    return table(spark, folder, "claim").select("claim_id", F.round(truth.claim_weight(field, kind, seen, AS_OF), 6).alias("weight"), truth.is_stale(field, seen, AS_OF).alias("stale"), truth.expires_at(field, seen).alias("expires_at"))


_VOTES = f"""
    WITH x AS (SELECT * EXCLUDE (weight), CASE WHEN left(value, 1) IN ('[', '{{') THEN left(value, 200) ELSE lower(trim(value)) END AS key FROM claim WHERE value IS NOT NULL),
    aged AS (SELECT *, round(claim_weight, 9) AS w FROM ({_AGED})),
    best AS (SELECT venue_id, field, source_family, key, min(claim_id) AS first_id, max(w) AS w, arg_max(struct_pack(source_type, observed_at), row(w, -claim_id)) AS b FROM aged GROUP BY ALL),
    votes AS (SELECT venue_id, field, source_family, arg_max(key, row(w, -first_id)) AS key, max(w) AS weight, arg_max(b, row(w, -first_id)) AS b FROM best GROUP BY ALL)"""


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "claim").where("value is not null").withColumn("key", truth.value_key(F.col("value")))
    rows = rows.withColumn("weight", F.round(truth.claim_weight(F.col("field"), F.col("source_type"), F.col("observed_at"), AS_OF), 9))
    return truth.collapse_by_family(rows, "claim_id", "weight", "source_type", "observed_at")


@query(f"{_VOTES} SELECT venue_id, field, source_family, key, round(weight, 6) AS weight, b.source_type AS source_type FROM votes")
def family_votes(spark: SparkSession, folder: str) -> DataFrame:
    return _votes(spark, folder).select("venue_id", "field", "source_family", "key", F.round("weight", 6).alias("weight"), "source_type")


_TTL = "CASE field WHEN 'business_status' THEN 30 WHEN 'business_hours' THEN 21 WHEN 'hours' THEN 14 WHEN 'specials' THEN 14 WHEN 'address' THEN 90 WHEN 'phone' THEN 90 ELSE 30 END"
_DAYS_OLD = r"coalesce(greatest((epoch_us(TIMESTAMPTZ '2026-08-05 00:00:00+00') - epoch_us(coalesce(CASE WHEN regexp_matches({0}, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)$') THEN try_cast({0} AS TIMESTAMPTZ) END, CASE WHEN regexp_matches({0}, '^\d{{4}}-\d\d-\d\d') THEN try_cast(left({0}, 10) || 'T00:00:00Z' AS TIMESTAMPTZ) END))) / 86400e6, 0.0), 999.0)"


@query(
    f"""
    {_VOTES}, g AS (SELECT venue_id, field, key, round(sum(weight), 6) AS w, bool_or(b.source_type IN ('own_site', 'human')) AS first_hand, max(row(weight, b.observed_at)) AS top FROM votes WHERE field <> 'business_status' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER q AS n, lead(w) OVER q AS second FROM g WINDOW q AS (PARTITION BY venue_id, field ORDER BY w DESC, key))
    SELECT venue_id, field, key, w, CASE WHEN second IS NOT NULL AND round(w - second, 6) < 0.15 THEN 'conflicted' WHEN {_DAYS_OLD.format("top[2]")} > {_TTL} THEN 'stale' WHEN w >= 0.7 AND first_hand THEN 'verified' ELSE 'unverified' END AS kind
    FROM r WHERE n = 1
    """
)
def agreement(spark: SparkSession, folder: str) -> DataFrame:
    return truth.agree(_votes(spark, folder).where("field <> 'business_status'"), AS_OF)


def _status_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Values are JSON texts; a status is compared without its quotes."""
    return _votes(spark, folder).where("field = 'business_status'").withColumn("key", F.regexp_replace("key", '^"|"$', ""))


@query(
    rf"""
    {_VOTES}, s AS (SELECT venue_id, regexp_replace(key, '^"|"$', '', 'g') AS k, weight, b.source_type AS t, source_family AS fam, b.observed_at AS o FROM votes WHERE field = 'business_status'),
    f AS (SELECT *, k IN ('permanently_closed', 'temporarily_closed', 'likely_closed') AS shut, k = 'open' AS op FROM s),
    h AS (SELECT *, shut AND t IN ('overture', 'own_site', 'human', 'overpass') AND weight >= 0.4 AS sure FROM f),
    v AS (SELECT venue_id, bool_or(sure) AS any_sure, arg_max(struct_pack(k, t), row(weight, k, t, o)) FILTER (sure) AS c, count(*) FILTER (shut AND NOT sure) AS weak, count(*) FILTER (op) AS n_open, bool_or(op AND t IN ('own_site', 'human')) AS own,
          bool_and(t = 'aggregator') FILTER (op) AS listed, count(DISTINCT fam) FILTER (op) AS families, arg_max(o, row(weight, k, t, o)) FILTER (op) AS o FROM h GROUP BY venue_id),
    d AS (SELECT venue_id, CASE WHEN any_sure THEN {{'kind': 'suppressed', 'value': CASE WHEN c.t = 'human' OR c.t = 'overture' AND c.k = 'permanently_closed' THEN c.k ELSE 'likely_closed' END}}
        WHEN weak >= 2 THEN {{'kind': 'conflicted', 'value': 'likely_closed'}} WHEN weak = 1 AND n_open > 0 THEN {{'kind': 'conflicted', 'value': 'unknown'}} WHEN weak = 1 THEN {{'kind': 'needs_review', 'value': 'unknown'}}
        WHEN n_open = 0 THEN {{'kind': 'unverified', 'value': 'unknown'}} WHEN listed OR NOT (own OR families >= 2) THEN {{'kind': 'unverified', 'value': 'open'}} WHEN {_DAYS_OLD.format("o")} > 30 THEN {{'kind': 'stale', 'value': 'open'}} ELSE {{'kind': 'verified', 'value': 'open'}} END AS d FROM v)
    SELECT venue_id, d.kind AS kind, d.value AS value FROM d
    """
)
def status_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return truth.agree_status(_status_votes(spark, folder), AS_OF)


@query(f"WITH x AS (SELECT * EXCLUDE (weight) FROM claim) SELECT claim_id, round(CASE WHEN days <= ttl THEN 1.0 WHEN days >= 2 * ttl THEN 0.0 ELSE 1.0 - (days - ttl) / ttl END, 6) AS fresh FROM ({_AGED})")
def claim_freshness(spark: SparkSession, folder: str) -> DataFrame:
    days = truth.age_days(F.col("observed_at"), AS_OF)
    return table(spark, folder, "claim").select("claim_id", F.round(text.freshness(days, truth.ttl(F.col("field"))), 6).alias("fresh"))


@query("SELECT obs_id, venue_id, source_family FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, source_family ORDER BY observed_at DESC NULLS LAST, obs_id DESC) AS n FROM observation) WHERE n <= 5")
def retention_last_n(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col("observed_at").desc_nulls_last(), F.desc("obs_id")]
    return truth.last_n(table(spark, folder, "observation"), ["venue_id", "source_family"], order, 5).select("obs_id", "venue_id", "source_family")


@query(
    """
    WITH f AS (SELECT url, row(fetched_at, page_id) AS stamp, coalesce(http_status BETWEEN 200 AND 299, false) AS ok FROM fetch_result WHERE url IS NOT NULL),
    l AS (SELECT url, max(stamp) FILTER (WHERE ok) AS last FROM f GROUP BY url)
    SELECT url, count(*) FILTER (WHERE NOT ok AND (last IS NULL OR stamp > last)) AS streak FROM f JOIN l USING (url) GROUP BY url
    """
)
def failure_streak(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    return truth.failure_streak(table(spark, folder, "fetch_result").where("url is not null").select("url", "fetched_at", "page_id", "http_status"), "url", ["fetched_at", "page_id"], ok)


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1) AS title FROM fetch_result WHERE html IS NOT NULL")
def html_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_result").where("html is not null").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1).alias("title"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM fetch_result")
def page_host(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_result").select("page_id", text.host_of(F.col("url")).alias("host"))


_REQUIRED = ("name", "nickname", "address", "phone", "website", "maps", "noise_level", "mood")


@query(
    "SELECT 'bad_id' AS rule, id, id AS detail FROM valid_base_config WHERE id NOT SIMILAR TO '[a-z0-9-]+' UNION ALL "
    + " UNION ALL ".join(f"SELECT 'missing_{c}' AS rule, id, '' AS detail FROM valid_base_config WHERE {c} IS NULL" for c in _REQUIRED)
    + " UNION ALL SELECT 'empty_nickname', id, '' FROM valid_base_config WHERE coalesce(nickname, '') = '' UNION ALL SELECT 'no_tags', id, '' FROM valid_base_config WHERE len(coalesce(tags, [])) = 0"
    + " UNION ALL SELECT 'repeated_id', id, count(*)::VARCHAR FROM valid_base_config GROUP BY id HAVING count(*) > 1"
)
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "valid_base_config")
    rules = {"bad_id": F.col("id").rlike("^[a-z0-9-]+$"), **{f"missing_{c}": F.col(c).isNotNull() for c in _REQUIRED}, "empty_nickname": F.col("nickname") != "", "no_tags": F.size("tags") > 0}
    return quality.violations(rows, "id", rules, {"bad_id": F.col("id")}).unionByName(quality.repeated(rows, "id"))


_CONTEXT = ("free", "complimentary", "no charge", "off", "discount", "half", "bogo", "special", "price", "deal", "cents", "$", "%", "2 for 1", "2-4-1")


@query(
    f"""
    WITH s AS (SELECT obs_id AS id, unnest(payload.specials) AS x FROM observation),
    r AS (SELECT 'no_item' AS rule, id, x FROM s WHERE x.item IS NULL UNION ALL SELECT 'bad_category', id, x FROM s WHERE coalesce(x.category, '') NOT IN ('drinks', 'food') UNION ALL SELECT 'bad_price', id, x FROM s WHERE x.price IS NULL OR x.price < 0
        UNION ALL SELECT 'free_without_a_word', id, x FROM s WHERE x.price = 0 AND NOT ({" OR ".join(f"contains(lower(coalesce(x.description, '')), '{w}')" for w in _CONTEXT)}))
    SELECT rule, id, coalesce(x.item, '') AS detail FROM r
    """
)
def special_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observation").select(F.col("obs_id").alias("id"), F.explode("payload.specials").alias("x"))
    said = F.lit(False)
    for w in _CONTEXT:
        said = said | F.contains(F.lower(F.coalesce("x.description", F.lit(""))), F.lit(w))
    price = F.col("x.price")
    rules = {"no_item": F.col("x.item").isNotNull(), "bad_category": F.col("x.category").isin("drinks", "food"), "bad_price": price >= 0, "free_without_a_word": price.isNull() | (price != 0) | said}
    return quality.violations(rows, "id", rules, dict.fromkeys(rules, F.coalesce("x.item", F.lit(""))))


@query(
    """
    WITH x AS (SELECT venue_id, arg_max(payload.phone, row(observed_at, obs_id)) AS phone FROM observation WHERE trim(payload.phone) <> '' GROUP BY venue_id)
    SELECT id, coalesce(nullif(trim(v.phone), ''), x.phone, '') AS phone FROM valid_base_config v LEFT JOIN x ON v.id = x.venue_id
    """
)
def merge_keep_previous(spark: SparkSession, folder: str) -> DataFrame:
    obs = table(spark, folder, "observation").where("trim(payload.phone) <> ''").groupBy("venue_id").agg(F.max(F.struct("observed_at", "obs_id", "payload.phone")).alias("b"))
    seen = obs.select(F.col("venue_id").alias("id"), F.col("b.phone").alias("seen"))
    return table(spark, folder, "valid_base_config").select("id", "phone").join(seen, "id", "left").select("id", F.coalesce(F.nullif(F.trim("phone"), F.lit("")), "seen", F.lit("")).alias("phone"))


@query(
    """
    SELECT DISTINCT 'only_left' AS rule, venue_id AS id, '' AS detail FROM observation WHERE venue_id IS NOT NULL AND venue_id NOT IN (SELECT id FROM valid_base_config)
    UNION ALL SELECT 'only_right', id, '' FROM valid_base_config WHERE id NOT IN (SELECT venue_id FROM observation WHERE venue_id IS NOT NULL)
    """
)
def id_parity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.parity(table(spark, folder, "observation").select(F.col("venue_id").alias("id")), table(spark, folder, "valid_base_config").select("id"), "id")


_SEEN = "seen AS (SELECT venue_id AS id, b.* FROM (SELECT venue_id, arg_max(struct_pack(name := matched_name, address := matched_address, phone := matched_phone), row(observed_at, obs_id)) AS b FROM observation WHERE venue_id <> 'unassigned' GROUP BY venue_id))"


def _last_seen(spark: SparkSession, folder: str) -> DataFrame:
    """What the newest observation of each venue calls it."""
    rows = table(spark, folder, "observation").where("venue_id <> 'unassigned'")
    b = rows.groupBy(F.col("venue_id").alias("id")).agg(F.max(F.struct("observed_at", "obs_id", "matched_name", "matched_address", "matched_phone")).alias("b"))
    return b.select("id", *[F.col(f"b.matched_{f}").alias(f) for f in ("name", "address", "phone")])


@query(
    f"WITH {_SEEN}, "
    + "j AS (SELECT c.id, c.name AS a_name, s.name AS b_name, c.address AS a_address, s.address AS b_address, c.phone AS a_phone, s.phone AS b_phone FROM valid_base_config c JOIN seen s USING (id)) "
    + " UNION ALL ".join(f"SELECT 'differs' AS rule, id, '{f}' AS detail FROM j WHERE coalesce(a_{f}, '') <> '' AND a_{f} IS DISTINCT FROM b_{f}" for f in ("name", "address", "phone"))
)
def deep_parity(spark: SparkSession, folder: str) -> DataFrame:
    return quality.deep_parity(table(spark, folder, "valid_base_config"), _last_seen(spark, folder), "id", ["name", "address", "phone"])


@query(
    """
    WITH k AS (SELECT snapshot_no, osm_key, arg_max(struct_pack(name, address, amenity), row_no) AS b FROM overpass WHERE coalesce(osm_key, '') <> '' AND snapshot_no IS NOT NULL GROUP BY ALL),
    s AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS follows FROM (SELECT DISTINCT snapshot_no FROM k)),
    o AS (SELECT s.follows AS n, osm_key, b FROM k JOIN s USING (snapshot_no) WHERE follows IS NOT NULL), a AS (SELECT snapshot_no AS n, osm_key, b FROM k WHERE snapshot_no > (SELECT min(snapshot_no) FROM k)),
    j AS (SELECT coalesce(a.n, o.n) AS snapshot_no, o.osm_key AS was, a.osm_key AS is_, o.b AS x, a.b AS y FROM o FULL JOIN a ON o.n = a.n AND o.osm_key = a.osm_key),
    c AS (SELECT snapshot_no, count(was) AS before, count(is_) AS after, count(*) FILTER (is_ IS NULL) AS missing, count(*) FILTER (was IS NULL) AS fresh,
          count(*) FILTER (was IS NOT NULL AND is_ IS NOT NULL AND (x.name IS DISTINCT FROM y.name OR x.address IS DISTINCT FROM y.address OR x.amenity IS DISTINCT FROM y.amenity)) AS changed,
          count(*) FILTER (coalesce(x.address, '') <> '' AND coalesce(y.address, '') = '') AS lost_address, count(*) FILTER (coalesce(x.amenity, '') <> '' AND coalesce(y.amenity, '') = '') AS lost_amenity FROM j GROUP BY snapshot_no)
    SELECT *, CASE WHEN after < before OR missing > 0 OR lost_address > 2 OR lost_amenity > 1 THEN 'fail' WHEN fresh + changed > 5 THEN 'review' ELSE 'pass' END AS verdict FROM c
    """
)
def regression_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each delivered snapshot against the one before it."""
    rows = table(spark, folder, "overpass").where("coalesce(osm_key, '') <> '' and snapshot_no is not null")
    last = diff.latest(rows, ["snapshot_no", "osm_key"], "row_no", {c: F.col(c) for c in ("name", "address", "amenity")})
    before, after = diff.neighbours(last, "snapshot_no")
    return quality.regression(quality.compared(before, after, ["snapshot_no", "osm_key"], ["name", "address", "amenity"]), ["snapshot_no"], {"address": 2, "amenity": 1}, 5)


@query(
    "SELECT row_no, osm_key FROM overpass WHERE lat BETWEEN 45.5 AND 45.9 AND lon BETWEEN -111.5 AND -110.5 AND (amenity ILIKE '%restaurant%' OR amenity ILIKE '%bar%' OR amenity ILIKE '%cafe%' OR amenity ILIKE '%pub%' OR amenity ILIKE '%brewery%' OR amenity ILIKE '%food%')"
)
def bbox_scan(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "overpass").where(in_box(F.col("lat"), F.col("lon"), 45.5, -111.5, 45.9, -110.5) & in_categories(F.col("amenity"))).select("row_no", "osm_key")


@query(
    r"""
    SELECT cand_id, list_filter([CASE WHEN regexp_matches(t, '\b(mon|mondays?)\b') THEN 1 END, CASE WHEN regexp_matches(t, '\b(tue|tuesdays?)\b') THEN 2 END, CASE WHEN regexp_matches(t, '\b(wed|wednesdays?)\b') THEN 3 END,
        CASE WHEN regexp_matches(t, '\b(thu|thursdays?)\b') THEN 4 END, CASE WHEN regexp_matches(t, '\b(fri|fridays?)\b') THEN 5 END, CASE WHEN regexp_matches(t, '\b(sat|saturdays?)\b') THEN 6 END, CASE WHEN regexp_matches(t, '\b(sun|sundays?)\b') THEN 7 END], lambda x: x IS NOT NULL) AS days
    FROM (SELECT cand_id, lower(coalesce(hh_summary, '')) AS t FROM candidate)
    """
)
def weekday_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select("cand_id", text.weekday_mentions(F.col("hh_summary")).alias("days"))


@query("SELECT c_custkey, ((((c_custkey % 2147483647) * 16807) % 2147483647) - 1) / 2147483646.0 AS draw FROM customer WHERE c_custkey > 0")
def seeded_pick(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where("c_custkey > 0").select("c_custkey", text.seeded_draw(F.col("c_custkey")).alias("draw"))


_LETTERS = r"regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\bthe ', '', 'g'), '[^a-z0-9]+', '', 'g')"
_SIDE = r"SELECT {1} AS id, " + _LETTERS.format("name") + r" AS n, regexp_extract(regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]+', '', 'g'), '^(\d+)', 1) AS k, regexp_replace(coalesce(phone, ''), '\D', '', 'g') AS p, coalesce(trim(address), '') = '' AND coalesce(trim(phone), '') = '' AS bare FROM {0}"


@query(
    f"""
    WITH l AS ({_SIDE.format("valid_base_config", "config_no")}), r AS ({_SIDE.format("overture_fixture", "place_no")}),
    m AS (SELECT l.id AS l_id, r.id AS r_id, CASE WHEN len(l.p) >= 7 AND len(r.p) >= 7 AND right(l.p, 10) = right(r.p, 10) THEN 1.0 ELSE 0.8 END AS score FROM l JOIN r
          ON l.n <> '' AND r.n <> '' AND (contains(l.n, r.n) OR contains(r.n, l.n)) AND (len(l.p) >= 7 AND len(r.p) >= 7 AND right(l.p, 10) = right(r.p, 10) OR l.k <> '' AND l.k = r.k OR l.bare AND l.n = r.n))
    SELECT l_id, arg_max(r_id, row(score, -r_id)) AS r_id, max(score)::DOUBLE AS score FROM m GROUP BY l_id
    """
)
def entity_match_best(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda t, i: table(spark, folder, t).select(F.col(i).alias("id"), "name", "address", "phone")
    return matching.best_partner(pick("valid_base_config", "config_no"), pick("overture_fixture", "place_no"))

"""Further core queries: merging, caches, pages and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopyard.functions import hours, text
from hopyard.operators import diff, matching, merge, truth
from hopyard.plans.catalog import _LATEST, _NAME, _SEEN, _WINDOWS, _last_seen, _latest_hours, _within, live_heatmap, query, oracle_sql, queries  # noqa: F401
from hopyard.session import table
from hopyard.sources import poi

_OWNED = ("name", "address", "phone")
_KEEP = "coalesce(nullif(c.{0}, ''), nullif(p.{0}, ''), '') AS {0}"


def _before_last(spark: SparkSession, folder: str) -> DataFrame:
    """The observation before each venue's newest: what was known at the run before."""
    w = Window.partitionBy("venue_id").orderBy(F.desc("observed_at"), F.desc("obs_id"))
    rows = table(spark, folder, "observation").where("venue_id <> 'unassigned'").withColumn("_n", F.row_number().over(w)).where("_n = 2")
    return rows.select(F.col("venue_id").alias("id"), *[F.col(f"matched_{f}").alias(f) for f in _OWNED], "payload.hours", "payload.business_hours", "payload.specials")


@query(
    f"""
    WITH {_LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY observed_at DESC, obs_id DESC) AS n FROM observation WHERE venue_id <> 'unassigned'),
    p AS (SELECT venue_id AS id, matched_name AS name, matched_address AS address, matched_phone AS phone, payload.hours AS hours, payload.business_hours AS business_hours, payload.specials AS specials FROM r WHERE n = 2)
    SELECT c.id, {", ".join(_KEEP.format(f) for f in _OWNED)}, coalesce(nullif(e.hours, ''), nullif(p.hours, ''), '') AS hours, coalesce(nullif(e.business_hours, ''), nullif(p.business_hours, ''), '') AS business_hours,
        len(coalesce(nullif(e.specials, []), nullif(p.specials, []), [])) AS n_specials
    FROM valid_base_config c LEFT JOIN latest e ON e.venue_id = c.id LEFT JOIN p ON p.id = c.id
    """
)
def merged_records(spark: SparkSession, folder: str) -> DataFrame:
    extract = _latest_hours(spark, folder).withColumnRenamed("venue_id", "id")
    rows = merge.keep_previous(table(spark, folder, "valid_base_config"), extract, _before_last(spark, folder), "id", list(_OWNED), ["hours", "business_hours", "specials"])
    return rows.select("id", *_OWNED, "hours", "business_hours", F.size("specials").alias("n_specials"))


@query(f"WITH {_SEEN} SELECT id, name FROM seen UNION ALL SELECT id, name FROM valid_base_config c WHERE id NOT IN (SELECT id FROM seen WHERE id IS NOT NULL)")
def partial_run(spark: SparkSession, folder: str) -> DataFrame:
    return merge.overlay(_last_seen(spark, folder).select("id", "name"), table(spark, folder, "valid_base_config").select("id", "name"), "id")


_CUT = "2026-07-01 00:00:00"


@query(
    f"""
    SELECT DISTINCT venue_id FROM observation n WHERE ingested_at >= TIMESTAMP '{_CUT}' AND EXISTS (SELECT 1 FROM observation o WHERE o.ingested_at < TIMESTAMP '{_CUT}' AND o.venue_id = n.venue_id AND o.content_hash = n.content_hash
        AND (o.payload.hours <> '' OR len(o.payload.specials) > 0))
    """
)
def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    obs = table(spark, folder, "observation")
    usable = (F.coalesce("payload.hours", F.lit("")) != "") | (F.size("payload.specials") > 0)
    cut = F.lit(_CUT).cast("timestamp_ntz")
    return merge.unchanged(obs.where(F.col("ingested_at") < cut), obs.where(F.col("ingested_at") >= cut), "venue_id", usable)


_WEEK = "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']"


@query(
    rf"""
    WITH {_LATEST}, {_WINDOWS}, d AS (SELECT venue_id, d, max(start_min || '-' || end_min) AS h FROM windows, (SELECT unnest(range(1, 8)) AS d) WHERE {_within("d", "start_day", "end_day")} GROUP BY ALL),
    r AS (SELECT *, d - row_number() OVER (PARTITION BY venue_id, h ORDER BY d) AS island FROM d), g AS (SELECT venue_id, h, min(d) AS a, max(d) AS b FROM r GROUP BY venue_id, h, island)
    SELECT venue_id, string_agg({_WEEK}[a] || CASE WHEN b > a THEN '-' || {_WEEK}[b] ELSE '' END || ' ' || h, ', ' ORDER BY a) AS weekly FROM g GROUP BY venue_id
    """
)
def weekly_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _latest_hours(spark, folder).select("venue_id", F.explode(hours.parse_hours(F.col("hours"))).alias("w"))
    days = rows.select("venue_id", "w", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("day")).where(hours.day_in(F.col("day"), F.col("w.start_day"), F.col("w.end_day")))
    return merge.weekly_text(days.withColumn("h", F.concat_ws("-", "w.start_min", "w.end_min")), "venue_id", "day", "h")


@query(
    r"""
    SELECT page_id FROM (SELECT page_id, html, lower(html) AS l FROM fetch_result WHERE html IS NOT NULL) WHERE regexp_matches(l, '<title[^>]*>\s*(?:just a moment|attention required)') OR contains(l, 'cf-browser-verification')
        OR contains(l, 'challenge-platform') AND length(html) < 20000 AND NOT regexp_matches(l, 'happy\s*hour|daily\s+special|menu|hours') OR contains(l, 'enable javascript and cookies to continue') AND length(html) < 15000
    """
)
def challenge_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_result").where(text.is_challenge(F.col("html"))).select("page_id")


@query(r"""SELECT page_id, count(*) AS links, count(DISTINCT u) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]+)"', 1)) AS u FROM fetch_result) GROUP BY page_id""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "fetch_result").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a [^>]*href="([^"]+)"'), F.lit(1))).alias("u"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("u").alias("targets"))


_FLAT = r"regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '', 'g')"


@query(
    f"""
    WITH p AS (SELECT page_id, {_FLAT.format("html")} AS t, {_FLAT.format("regexp_replace(v.name, '[Tt]he ', '', 'g')")} AS n, regexp_extract({_FLAT.format("v.address")}, '^([0-9]+[a-z])', 1) AS k
        FROM fetch_result f JOIN valid_base_config v ON v.id = f.venue_id WHERE html IS NOT NULL)
    SELECT page_id FROM p WHERE NOT (n <> '' AND contains(t, n) AND (k = '' OR contains(t, k)))
    """
)
def contaminated_pages(spark: SparkSession, folder: str) -> DataFrame:
    venues = table(spark, folder, "valid_base_config").select(F.col("id").alias("venue_id"), "name", "address")
    pages = table(spark, folder, "fetch_result").where("html is not null").select("page_id", "venue_id", F.col("html").alias("text")).join(venues, "venue_id")
    return matching.contaminated(pages, F.col("name"), F.col("address"), F.lit(True)).select("page_id")


_SAME = r"nullif(regexp_replace(regexp_replace(lower({0}), '\bthe ', '', 'g'), '[^a-z0-9]+', '', 'g'), '')"
_TOKEN = "nullif(regexp_extract(" + _FLAT + ", '^([0-9]+[a-z])', 1), '')"


@query(
    f"""
    WITH k AS (SELECT snapshot_no, osm_key, arg_max(struct_pack(name, address), row_no) AS b FROM overpass WHERE coalesce(osm_key, '') <> '' AND snapshot_no IS NOT NULL GROUP BY ALL),
    s AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS follows FROM (SELECT DISTINCT snapshot_no FROM k)),
    g AS (SELECT follows, osm_key, {_SAME.format("b.name")} AS n, {_TOKEN.format("b.address")} AS t FROM k JOIN s USING (snapshot_no) WHERE follows IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k l WHERE l.snapshot_no = follows AND l.osm_key = k.osm_key)),
    v AS (SELECT config_no, {_SAME.format("name")} AS n, {_TOKEN.format("address")} AS t FROM valid_base_config)
    SELECT follows || '/' || osm_key AS key, min(config_no) AS venue FROM g JOIN v ON g.n = v.n AND (g.t IS NULL OR v.t IS NULL OR g.t = v.t) GROUP BY ALL
    """
)
def vanished_venues(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "overpass").where("coalesce(osm_key, '') <> '' and snapshot_no is not null")
    before, after = diff.neighbours(diff.latest(rows, ["snapshot_no", "osm_key"], "row_no", {c: F.col(c) for c in ("name", "address")}), "snapshot_no")
    gone = before.join(after.select("snapshot_no", "osm_key"), ["snapshot_no", "osm_key"], "left_anti")
    venues = table(spark, folder, "valid_base_config").select(F.col("config_no").alias("venue"), "name", "address")
    return matching.first_known(gone.select(F.concat_ws("/", "snapshot_no", "osm_key").alias("key"), "name", "address"), venues)


@query(
    """
    SELECT obs_id, CASE WHEN source_type IN ('overture', 'overpass', 'human', 'own_site', 'social') THEN source_type WHEN contains(u, 'mthappyhour.com') THEN 'mthappyhour' WHEN contains(u, 'bozemanmagazine.com') THEN 'local_directory'
        WHEN contains(u, 'visit-bozeman.com') THEN 'local_directory' WHEN contains(u, 'menupix.com') THEN 'menupix' WHEN contains(u, 'yelp.com') THEN 'yelp' WHEN contains(u, 'sellout.io') THEN 'sellout' WHEN contains(u, 'google.com') THEN 'google'
        WHEN contains(u, 'facebook.com') THEN 'facebook' ELSE coalesce(nullif(source_type, ''), 'unknown') END AS family FROM (SELECT obs_id, source_type, lower(coalesce(source_url, '')) AS u FROM observation)
    """
)
def source_families(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "observation").select("obs_id", text.source_family(F.col("source_url"), F.col("source_type")).alias("family"))


_SITES = ("pourfinder.example", "tapledger.example", "valleymag.example", "menuhive.example")
_HOST = r"regexp_replace(lower(regexp_extract(coalesce({0}, ''), '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '')"


@query(
    f"""
    WITH u AS (SELECT id, unnest(list_concat([website], coalesce(scrape_urls, []))) AS u FROM valid_base_config), h AS (SELECT id, {_HOST.format("u")} AS h FROM u WHERE u <> '')
    SELECT id, count(*) AS urls FROM h WHERE NOT ({" OR ".join(f"h = '{s}' OR ends_with(h, '.{s}')" for s in _SITES)}) GROUP BY id
    """
)
def own_sites(spark: SparkSession, folder: str) -> DataFrame:
    urls = F.concat(F.array("website"), F.coalesce("scrape_urls", F.array().cast("array<string>")))
    rows = table(spark, folder, "valid_base_config").select("id", F.explode(urls).alias("u")).where((F.col("u") != "") & ~text.is_aggregator(F.col("u"), _SITES))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("urls"))


@query(
    rf"""
    SELECT cand_id, replace(replace(replace(replace(replace(coalesce(name, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe, trim(split_part(coalesce(address, ''), ',', 1)) AS place,
        left(sha256(coalesce(hh_summary, '')), 16) AS hash, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(name), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'venue') AS slug,
        {_FLAT.format("name")} AS compact, regexp_extract({_FLAT.format("address")}, '^(\d+[a-z])', 1) AS token FROM candidate WHERE name IS NOT NULL
    """
)
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    name, address = F.col("name"), F.col("address")
    return table(spark, folder, "candidate").where("name is not null").select(
        "cand_id", text.escape_html(name).alias("safe"), text.place_label(address).alias("place"), text.content_hash(F.col("hh_summary")).alias("hash"), text.slug(name).alias("slug"), text.compact(name).alias("compact"), text.street_token(address).alias("token")
    )


@query("SELECT cand_id, replace(url_encode(concat_ws(' ', name, city, 'MT')), '%2F', '/') AS q FROM candidate WHERE name IS NOT NULL AND regexp_matches(name, '^[A-Za-z0-9 ./_-]*$') AND regexp_matches(coalesce(city, ''), '^[A-Za-z0-9 ./_-]*$')")
def map_queries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate").where(F.col("name").rlike("^[A-Za-z0-9 ./_-]*$") & F.coalesce("city", F.lit("")).rlike("^[A-Za-z0-9 ./_-]*$"))
    return rows.select("cand_id", text.maps_query(F.col("name"), F.col("city"), F.lit("MT")).alias("q"))


@query(
    r"""
    WITH h AS (SELECT cand_id, trim(regexp_replace(coalesce(hh_summary, ''), '\s+', ' ', 'g')) AS h FROM candidate),
    a AS (SELECT cand_id, regexp_replace(regexp_replace(h, '\bevery\s*day\b', 'Daily', 'gi'), '\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s*-\s*(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b', '\1-\2', 'gi') AS h FROM h),
    b AS (SELECT cand_id, regexp_replace(regexp_replace(h, '\s*a\.?m\.?\b', 'am', 'gi'), '\s*p\.?m\.?\b', 'pm', 'gi') AS h FROM a),
    c AS (SELECT cand_id, regexp_replace(regexp_replace(regexp_replace(h, '\s+to\s+', '-', 'gi'), '\s*[–—]\s*', '-', 'g'), '(\d(?:am|pm)?)\s+-\s+(\d)', '\1-\2', 'gi') AS h FROM b)
    SELECT cand_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\bdaily\b', 'Daily', 'gi'), '\bmon\b', 'Mon', 'gi'), '\btue\b', 'Tue', 'gi'), '\bwed\b', 'Wed', 'gi'),
        '\bthu\b', 'Thu', 'gi'), '\bfri\b', 'Fri', 'gi'), '\bsat\b', 'Sat', 'gi'), '\bsun\b', 'Sun', 'gi') AS hours FROM c
    """
)
def normal_hours(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").select("cand_id", text.normalize_hours(F.col("hh_summary")).alias("hours"))


@query(r"SELECT cand_id FROM candidate WHERE regexp_matches(lower(coalesce(hh_summary, '')), '\b(tue|tuesdays?)\b')")
def named_tuesday(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").where(text.applies_on(F.col("hh_summary"), F.lit(2))).select("cand_id")


@query("SELECT cand_id FROM candidate WHERE contains(lower(coalesce(address, '') || ' ' || coalesce(city, '')), 'branaton') OR contains(lower(coalesce(address, '') || ' ' || coalesce(city, '')), 'four corners') OR contains(lower(coalesce(address, '') || ' ' || coalesce(city, '')), '4 corners')")
def in_cities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate").where(text.in_cities(F.col("address"), F.col("city"), ["Branaton", "Four Corners"])).select("cand_id")


@query("SELECT obs_id, venue_id FROM observation WHERE source_type IN ('own_site', 'aggregator') AND (payload.hours <> '' OR payload.business_hours <> '' OR len(payload.specials) > 0)")
def admitted(spark: SparkSession, folder: str) -> DataFrame:
    some = (F.coalesce("payload.hours", F.lit("")) != "") | (F.coalesce("payload.business_hours", F.lit("")) != "") | (F.size("payload.specials") > 0)
    return table(spark, folder, "observation").where(F.col("source_type").isin("own_site", "aggregator") & some).select("obs_id", "venue_id")


@query("SELECT c.id, d.field, d.kind FROM valid_base_config c LEFT JOIN (SELECT * FROM decision WHERE kind IN ('suppressed', 'conflicted', 'needs_review')) d ON d.venue_id = c.id")
def review_list(spark: SparkSession, folder: str) -> DataFrame:
    open_ = table(spark, folder, "decision").where(F.col("kind").isin("suppressed", "conflicted", "needs_review")).select(F.col("venue_id").alias("id"), "field", "kind")
    return table(spark, folder, "valid_base_config").select("id").join(open_, "id", "left")


@query("SELECT venue_id, field, count(DISTINCT source_family) AS families, bool_or(source_type IN ('own_site', 'human')) AS first_hand, bool_and(source_type = 'aggregator') AS listed FROM claim GROUP BY venue_id, field")
def corroboration(spark: SparkSession, folder: str) -> DataFrame:
    own, listed = F.bool_or(F.col("source_type").isin("own_site", "human")), F.bool_and(F.col("source_type") == "aggregator")
    return table(spark, folder, "claim").groupBy("venue_id", "field").agg(F.count_distinct("source_family").alias("families"), own.alias("first_hand"), listed.alias("listed"))


@query(f"SELECT {_NAME.format('name')} AS norm, count(*) AS n, min(cand_id) AS first_id, max(cand_id) AS last_id FROM candidate WHERE name IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def name_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidate").where("name is not null").groupBy(text.norm_name(F.col("name")).alias("norm"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("first_id"), F.max("cand_id").alias("last_id")).where("n > 1")


@query("SELECT page_id, venue_id FROM (SELECT page_id, venue_id, coalesce(sum(length(html)) OVER (PARTITION BY venue_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM fetch_result WHERE html <> '' AND venue_id IS NOT NULL) WHERE had < 20000")
def enough_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each venue's pages in order until what came before is long enough."""
    w = Window.partitionBy("venue_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, folder, "fetch_result").where("html <> '' and venue_id is not null")
    return rows.withColumn("had", F.coalesce(F.sum(F.length("html")).over(w), F.lit(0))).where("had < 20000").select("page_id", "venue_id")


@query(f"WITH {_LATEST}, {_WINDOWS}, h AS (SELECT slot, count(DISTINCT venue_id) AS n FROM windows JOIN (SELECT unnest(range(840, 1291, 30))::INT AS slot) ON slot >= start_min AND slot < end_min WHERE {_within(2, 'start_day', 'end_day')} GROUP BY slot) SELECT slot, n FROM h ORDER BY n DESC, slot LIMIT 1")
def busiest_slot(spark: SparkSession, folder: str) -> DataFrame:
    return live_heatmap(spark, folder).orderBy(F.desc("n"), "slot").limit(1)


@query(
    """
    WITH s AS (SELECT venue_id, sum(CASE WHEN kind IN ('conflicted', 'needs_review') THEN 3.0 WHEN kind IN ('unverified', 'stale') THEN 1.5 WHEN kind = 'suppressed' THEN 0.5 ELSE 0 END) FILTER (field = 'business_status')
        + count(*) FILTER (field IN ('hours', 'specials') AND kind IN ('conflicted', 'stale')) AS score FROM decision WHERE venue_id IS NOT NULL GROUP BY venue_id)
    SELECT venue_id, score::DOUBLE AS score FROM s WHERE score IS NOT NULL ORDER BY score DESC, venue_id DESC LIMIT 25
    """
)
def most_uncertain(spark: SparkSession, folder: str) -> DataFrame:
    """A top-25 report; equal scores go by id, from the end."""
    kind, status = F.col("kind"), F.col("field") == "business_status"
    points = F.when(kind.isin("conflicted", "needs_review"), 3.0).when(kind.isin("unverified", "stale"), 1.5).when(kind == "suppressed", 0.5).otherwise(0.0)
    more = F.count_if(F.col("field").isin("hours", "specials") & kind.isin("conflicted", "stale"))
    s = table(spark, folder, "decision").where("venue_id is not null").groupBy("venue_id").agg((F.sum(F.when(status, points)) + more).alias("score"))
    return s.where("score is not null").orderBy(F.desc("score"), F.desc("venue_id")).limit(25)


@query("SELECT c_custkey, abs(h) AS h FROM (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: CASE WHEN (a * 31 + x) % 4294967296 >= 2147483648 THEN (a * 31 + x) % 4294967296 - 4294967296 WHEN (a * 31 + x) % 4294967296 < -2147483648 THEN (a * 31 + x) % 4294967296 + 4294967296 ELSE (a * 31 + x) % 4294967296 END) AS h FROM customer)")
def name_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", text.hash_string(F.col("c_name")).alias("h"))


@query(
    """
    WITH s AS (SELECT venue_id, arg_max(kind, field) AS kind FROM decision WHERE field = 'business_status' GROUP BY venue_id)
    SELECT d.venue_id, d.field, CASE WHEN s.kind = 'suppressed' AND d.field IN ('hours', 'specials', 'business_hours') THEN 'suppressed' ELSE d.kind END AS kind,
        CASE WHEN s.kind = 'suppressed' AND d.field = 'specials' THEN NULL ELSE d.value END AS value FROM decision d LEFT JOIN s ON s.venue_id = d.venue_id
    """
)
def cascaded_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return truth.cascade(table(spark, folder, "decision"))


@query(
    "SELECT place_no, coalesce(nullif(operating_status, ''), 'open') AS operating_status, coalesce(name, '') AS name, coalesce(address, '') AS address, coalesce(phone, '') AS phone, coalesce(confidence, 0.0) AS confidence, categories.primary AS category FROM overture_fixture"
)
def poi_layout(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table brought into the nested layout, with names as JSON, and read from there."""
    flat = table(spark, folder, "overture_fixture")
    nested = flat.select(
        F.col("place_no").alias("id"), F.to_json(F.struct(F.col("name").alias("primary"))).alias("names"), F.array(F.struct(F.col("address").alias("freeform"), F.lit(None).cast("string").alias("locality"))).alias("addresses"),
        F.array("phone").alias("phones"), "operating_status", "confidence", "categories",
    )
    return poi(nested).withColumnRenamed("id", "place_no")

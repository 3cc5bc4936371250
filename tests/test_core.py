import pytest
from pyspark.sql import functions as F

from hopyard.functions import hours, text
from hopyard.operators import diff, matching, merge, quality, truth
from hopyard.sources import append_observations, locations, observations_of, poi, read_cache, read_json, salvage_json, save_json

STATUS = [
    ("Daily 3-5pm & 8-9pm", None, "2026-08-02 20:41:00", "live", 1260),
    ("Daily 3-5pm & 8-9pm", None, "2026-08-02 19:00:00", "soon", None),
    ("Daily 3-5pm & 8-9pm", None, "2026-08-02 12:00:00", "closed", None),
    ("Mon 3-close", "Mon-Sun 4pm-10pm", "2026-08-03 17:00:00", "live", 1320),
    ("Mon 3-close", "Mon-Sun 4pm-10pm", "2026-08-03 22:30:00", "closed", None),
    ("Mon 3-close", "Mon-Sun 11am-2am", "2026-08-04 01:30:00", "live", 120),
    ("Mon 3-close", "Mon-Sun 11am-2am", "2026-08-04 02:30:00", "closed", None),
    ("Daily 11am-2am", None, "2026-08-02 05:00:00", "closed", None),
    ("Thu-Sat 4-6pm", None, "2026-08-02 17:00:00", "closed", None),
    ("nonsense", None, "2026-08-02 17:00:00", "unknown", None),
    ("", None, "2026-08-02 17:00:00", "unknown", None),
    (None, None, "2026-08-02 17:00:00", "unknown", None),
]


def test_status(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(STATUS)], "i int, h string, b string, t string, kind string, e int")
    got = df.select("i", hours.status(F.col("h"), F.col("b"), F.to_timestamp("t")).alias("s")).orderBy("i").collect()
    assert [(r.s.kind, r.s.end_min) for r in got] == [(r[3], r[4]) for r in STATUS]


def test_windows_inherit_days_and_business_hours_wrap(spark):
    df = spark.createDataFrame([("Daily 3-6pm, Fri-Sat 10pm-12am & 1-2am", "Mon Closed, Sat-Sun 4pm-Midnight (late)")], "h string, b string")
    r = df.select(hours.parse_hours(F.col("h")).alias("w"), hours.parse_business_hours(F.col("b")).alias("c")).first()
    assert [(w.start_day, w.end_day, w.start_min, w.end_min) for w in r.w] == [(1, 7, 900, 1080), (5, 6, 1320, 1440), (5, 6, 780, 1560)]
    assert r.c == [None] * 5 + [1440, 1440]


@pytest.mark.parametrize("field,value,want", [
    ("name", "The A  Café & Bar!", "cafe bar"), ("name", None, None), ("name", "", ""),
    ("address", "12 Main St, Suite 4, Bozeman, MT 59715", "12 main st #4 bozeman"),
    ("host", "https://WWW.Example.com:80/x", "example.com"), ("host", "junk", ""), ("slug", "Ted's  Café", "ted-s-cafe"), ("slug", "!!", "venue"),
])
def test_normalisers(spark, field, value, want):
    f = {"name": text.norm_name, "address": text.norm_address, "host": text.host_of, "slug": text.slug}[field]
    assert spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0] == want


def test_snapshot_changes(spark):
    rows = [
        (1, 1, "a", "Café", "bar"), (2, 1, "b", "B", None), (3, 1, "b", "B2", None), (4, 1, None, "x", "x"), (5, 1, "", "x", "x"), (6, 1, "d", "D", "pub"),
        (7, 3, "a", " Café ", "bar"), (8, 3, "b", "b2", None), (9, 3, "c", "C", "bar"), (9, 3, "c", "C", "bar"), (10, None, "a", "z", "z"),
    ]
    df = spark.createDataFrame(rows, "row_no long, snapshot_no int, osm_key string, name string, amenity string").withColumn("change", F.lit("extra"))
    values = {"name": diff.clean_name(F.col("name")), "amenity": F.col("amenity")}
    got = diff.snapshot_changes(df, "snapshot_no", "osm_key", "row_no", values)
    assert {tuple(r) for r in got.collect()} == {(3, "b", "changed"), (3, "c", "added"), (3, "d", "removed")}
    assert diff.snapshot_changes(df.limit(0), "snapshot_no", "osm_key", "row_no", values).count() == 0


def test_agreement_and_streak(spark):
    votes = spark.createDataFrame([("v", "hours", "own_site", 0.8, "a", "2026-08-01"), ("v", "hours", "x", 0.3, "b", "2026-08-01"), ("w", "hours", "x", 0.3, "a", "2026-08-01"), ("w", "hours", "y", 0.3, "b", "2026-08-01"), ("s", "hours", "own_site", 0.9, "a", "2026-07-01")], "venue_id string, field string, source_type string, weight double, key string, observed_at string")
    assert {(r.venue_id, r.key, r.kind) for r in truth.agree(votes, "2026-08-05T00:00:00Z").collect()} == {("v", "a", "verified"), ("w", "a", "conflicted"), ("s", "a", "stale")}
    runs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, True)], "id string, n int, ok boolean")
    assert {(r.id, r.streak) for r in truth.failure_streak(runs, "id", ["n"], F.col("ok")).collect()} == {("a", 2), ("b", 1), ("c", 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{broken")
    assert read_json(spark, str(tmp_path / "bad.json"), "a int").collect()[0].a is None
    with pytest.raises(Exception):
        read_json(spark, str(tmp_path / "bad.json"), "a int", strict=True).collect()
    df = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('see {"b": {"c": 2}} end',), ("none",)], "t string")
    assert [r[0] for r in df.select(salvage_json(F.col("t"))).collect()] == ['{"a": 1}', '{"b": {"c": 2}}', None]
    raw = spark.createDataFrame([("1", ("N",), [("1 Main", "Town")], ["555"], None, None, ("bar",))], "id string, names struct<primary:string>, addresses array<struct<freeform:string,locality:string>>, phones array<string>, operating_status string, confidence double, categories struct<primary:string>")
    r = poi(raw).first()
    assert (r.address, r.operating_status, r.confidence) == ("1 Main, Town", "open", 0.0)


def test_streaming_first_arrivals(spark, tmp_path):
    from hopyard.streaming import first_arrivals

    spark.createDataFrame([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:01:00"), (2, "2026-01-01 00:02:00")], "k int, t string").withColumn("t", F.to_timestamp_ntz("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp_ntz").parquet(str(tmp_path / "in"))
    q = first_arrivals(stream, ["k"], "t", "10 minutes").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 2


def test_price_and_days(spark):
    df = spark.createDataFrame([(4.5, "x"), (0.0, "half-price wings"), (None, None)], "p double, d string")
    assert [r[0] for r in df.select(text.price_label(F.col("p"), F.col("d"))).collect()] == ["$4.50", "—", "FREE"]
    df = spark.createDataFrame([("Mon-Fri special, Sundays too",), (None,)], "x string")
    assert [r[0] for r in df.select(text.weekday_mentions(F.col("x"))).collect()] == [[1, 5, 7], []]


def column(spark, expr, *values, kind="string"):
    """The results of an expression of column v over some values."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


def test_price_labels(spark):
    said = ["$1 off wells", "2 for 1 drafts", "half price wings", "BOGO", "happy hour special", "50 cents", "20% less", "on the house", None, ""]
    assert column(spark, text.price_label(F.lit(0.0), F.col("v")), *said) == ["—"] * 7 + ["FREE"] * 3
    assert column(spark, text.price_label(F.lit(4.5), F.col("v")), "half price") == ["$4.50"]


def test_names_beyond_latin_1(spark):
    assert column(spark, text.norm_name(F.col("v")), "Škoda Łódź", "The Café", "A The Inn", "ﬁne Bar", None, "") == ["skoda odz", "cafe", "the inn", "fine bar", None, ""]


@pytest.mark.parametrize(("value", "want"), [("Every day 3 PM to 6 PM", "Daily 3pm-6pm"), ("mon - fri 4pm – 6pm", "Mon-Fri 4pm-6pm"), ("DAILY 4 pm - 6 P.M", "Daily 4pm-6pm"), ("", ""), (None, "")])
def test_normal_hours(spark, value, want):
    assert column(spark, text.normalize_hours(F.col("v")), value) == [want]


def test_guards_pages(spark):
    shell = "<script src=/cdn-cgi/challenge-platform/x></script>"
    pages = ["<title>Just a moment...</title>", "<TITLE> Attention Required</TITLE>", "<p>cf-browser-verification", shell, shell + "our menu", shell + " " * 20_000, "Enable JavaScript and cookies to continue", "<p>captcha</p>", "", None]
    assert column(spark, text.is_challenge(F.col("v")), *pages) == [True, True, True, True, False, False, True, False, False, False]


def test_escape_families_and_maps(spark):
    assert column(spark, text.escape_html(F.col("v")), """<a href="x">'&'</a>""", None) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;", ""]
    assert column(spark, text.source_family(F.col("v"), F.lit("aggregator")), "https://www.yelp.com/x", "https://visit-bozeman.com", "https://other.example", None) == ["yelp", "local_directory", "aggregator", "aggregator"]
    assert column(spark, text.source_family(F.col("v"), F.lit("overture")), "https://www.yelp.com/x") == ["overture"]
    assert column(spark, text.maps_query(F.col("v"), F.lit("MT")), "A/B & C") == ["A/B%20%26%20C%20MT"]


def test_removed_needs_a_name_and_a_place(spark):
    gone = spark.createDataFrame([("Red Fox", None, "12 oak st town"), (None, "blue & owl", "9 elm"), ("No Place", None, None), (None, None, "12 oak st")], "name string, norm_name string, norm_address string")
    rows = [(1, "The Red Fox", "12 Oak Street"), (2, "Red Fox", "14 Oak St"), (3, "Blue & Owl", "9 Elm, MT 59715"), (4, "No Place", ""), (5, "", "12 oak st"), (6, None, None), (7, "Red Fox", "Oak St")]
    df = spark.createDataFrame(rows, "id int, name string, address string")
    assert {r.id for r in matching.removed(df, "id", gone).collect()} == {1, 3}
    assert matching.removed(df, "id", gone.limit(0)).count() == 0 and matching.removed(df.limit(0), "id", gone).count() == 0


def test_duplicates_never_by_name_alone(spark):
    known = spark.createDataFrame([(1, "Plonk", "29 E Main St"), (2, "Wild Rye Distilling", "111 E Oak St"), (3, "Blank", None)], "id int, name string, address string")
    rows = [(1, "Plonk", "322 N Higgins Ave"), (2, "The Plonk", "29 East Main"), (3, "Wildrye Distilling", "111 E. Oak St"), (4, "Blank", None), (5, "Other", "111 W Oak St")]
    assert {r.id for r in matching.duplicates(spark.createDataFrame(rows, "id int, name string, address string"), "id", known, "id").collect()} == {2, 3}


def test_best_partner_equals_all_pairs(spark):
    import random
    import re

    rng = random.Random(3)
    names = ["The Red Fox", "Red Fox Tavern", "Fox", "Bar", "Owl Bar", "Red", "Blue Owl Bar", None, "", "The"]
    make = lambda: [(i, rng.choice(names), rng.choice([None, "", "12 Oak St", "12 Elm", "9 Oak"]), rng.choice([None, "", "(406) 555-1234", "555-1234", "4065559999"])) for i in range(40)]
    left, right = make(), make()
    cols = "id int, name string, address string, phone string"
    got = {(r.l_id, r.r_id, r.score) for r in matching.best_partner(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).collect()}
    flat = lambda s: re.sub("[^a-z0-9]+", "", re.sub(r"\bthe ", "", (s or "").lower()))
    number = lambda s: (re.match(r"\d+", flat(s)) or [""])[0]
    digits = lambda s: d[-10:] if len(d := re.sub(r"\D", "", s or "")) >= 7 else None

    def score(x, y):
        a, b = flat(x[1]), flat(y[1])
        if not a or not b or a not in b and b not in a:
            return 0
        if digits(x[3]) and digits(x[3]) == digits(y[3]):
            return 1.0
        return 0.8 if number(x[2]) and number(x[2]) == number(y[2]) or not x[2] and not x[3] and a == b else 0

    best = {x[0]: max((score(x, y), -y[0]) for y in right) for x in left}
    assert got == {(k, -v[1], v[0]) for k, v in best.items() if v[0]} and got


def test_status_ladder(spark):
    rows = {
        "sure": [("permanently_closed", 0.95, "overture", "overture"), ("open", 0.25, "aggregator", "a")], "told": [("temporarily_closed", 0.9, "own_site", "own_site")], "weak2": [("likely_closed", 0.2, "aggregator", "a"), ("likely_closed", 0.2, "aggregator", "b")],
        "mixed": [("likely_closed", 0.2, "aggregator", "a"), ("open", 0.9, "own_site", "own_site")], "one": [("likely_closed", 0.2, "social", "social")], "listed": [("open", 0.25, "aggregator", "a"), ("open", 0.25, "aggregator", "b")],
        "single": [("open", 0.95, "overture", "overture")], "two": [("open", 0.95, "overture", "overture"), ("open", 0.25, "aggregator", "a")], "own": [("open", 1.0, "own_site", "own_site")], "none": [("varies", 1.0, "own_site", "own_site")],
    }
    votes = [(k, *v, "2026-08-01T00:00:00Z") for k, vs in rows.items() for v in vs] + [("old", "open", 0.0, "own_site", "own_site", "2020-01-01T00:00:00Z")]
    df = spark.createDataFrame(votes, "venue_id string, key string, weight double, source_type string, source_family string, observed_at string")
    got = {r.venue_id: (r.kind, r.value) for r in truth.agree_status(df, "2026-08-05T00:00:00Z").collect()}
    assert got == {
        "sure": ("suppressed", "permanently_closed"), "told": ("suppressed", "likely_closed"), "weak2": ("conflicted", "likely_closed"), "mixed": ("conflicted", "unknown"), "one": ("needs_review", "unknown"), "listed": ("unverified", "open"),
        "single": ("unverified", "open"), "two": ("verified", "open"), "own": ("verified", "open"), "none": ("unverified", "unknown"), "old": ("stale", "open"),
    }


def test_keep_previous_and_overlay(spark):
    cols = "id string, name string, tags array<string>, hours string, specials array<string>"
    config = spark.createDataFrame([("a", "", ["x"]), ("b", "B", []), ("c", None, None)], "id string, name string, tags array<string>")
    extract = spark.createDataFrame([("a", "nonsense", ["s"]), ("b", "", [])], "id string, hours string, specials array<string>")
    previous = spark.createDataFrame([("a", "Old", ["y"], "Daily 4-6pm", []), ("b", "Old", ["y"], "Fri 4-6pm", ["t"]), ("z", "Z", [], "", [])], cols)
    kept = merge.keep_previous(config, extract, previous, "id", ["name", "tags"], ["hours", "specials"], ok=F.size(hours.parse_hours(F.col("hours"))) > 0)
    assert {r.id: tuple(r)[1:] for r in kept.collect()} == {"a": ("Old", ["x"], "Daily 4-6pm", ["s"]), "b": ("B", ["y"], "Fri 4-6pm", ["t"]), "c": ("", [], "", [])}
    assert {(r.id, r.name) for r in merge.overlay(kept, previous, "id").collect()} == {("a", "Old"), ("b", "B"), ("c", ""), ("z", "Z")}


def test_weekly_text_and_cache(spark):
    rows = [("a", d, "11am-10pm") for d in (1, 2, 3, 5)] + [("a", 4, ""), ("a", 7, "9am-5pm"), ("b", 6, None)]
    df = spark.createDataFrame(rows, "id string, day int, h string")
    assert [tuple(r) for r in merge.weekly_text(df, "id", "day", "h").collect()] == [("a", "Mon-Wed 11am-10pm, Fri 11am-10pm, Sun 9am-5pm")]
    cache = spark.createDataFrame([("a", "1", True), ("b", "2", False), (None, "3", True)], "id string, content_hash string, ok boolean")
    fresh = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "3"), ("c", "1")], "id string, content_hash string")
    assert [r.id for r in merge.unchanged(cache, fresh, "id", F.col("ok")).collect()] == ["a"]


def test_violations_and_regression(spark):
    df = spark.createDataFrame([("a b", None), ("c", 1.0), ("c", -1.0)], "id string, price double")
    rules = {"id": F.col("id").rlike("^[a-z]+$"), "price": F.col("price") >= 0}
    assert {tuple(r) for r in quality.violations(df, "id", rules, {"id": F.col("id")}).unionByName(quality.repeated(df, "id")).collect()} == {("id", "a b", "a b"), ("price", "a b", ""), ("price", "c", ""), ("repeated_id", "c", "2")}
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "n int, id string, hours string, tags array<string>")
    before, after = make([("a", "x", ["t"]), ("b", "x", []), ("c", None, None)]), make([("a", "", []), ("c", None, None), ("d", "x", [])])
    states = quality.compared(before, after, ["n", "id"], ["hours", "tags"])
    assert {r.id: (r.state, r.lost) for r in states.collect()} == {"a": ("changed", ["hours", "tags"]), "b": ("missing", ["hours"]), "c": ("same", []), "d": ("new", [])}
    r = quality.regression(states, ["n"], {"hours": 1, "tags": 2}, 5).first()
    assert (r.before, r.after, r.missing, r.fresh, r.changed, r.lost_hours, r.lost_tags, r.verdict) == (3, 3, 1, 1, 1, 2, 1, "fail")
    assert quality.regression(quality.compared(after, after, ["n", "id"], ["hours"]), ["n"], {"hours": 0}, 5).first().verdict == "pass"
    assert {tuple(r) for r in quality.deep_parity(before, after, "id", ["hours", "tags"]).collect()} == {("differs", "a", "hours"), ("differs", "a", "tags")}


def test_poi_as_json_and_missing_parts(spark):
    rows = [("1", '{"primary": "N"}', '[{"freeform": "1 Main", "locality": "Town"}]', '["555"]'), ("2", "Plain", "broken", None), ("3", None, '[{"locality": "Town"}]', "[]"), ("4", "{broken", '[{"freeform": "1 Main, Town", "locality": "Town"}]', "[null]")]
    raw = spark.createDataFrame([(*r, "", None, None) for r in rows], "id string, names string, addresses string, phones string, operating_status string, confidence double, categories string")
    assert [(r.name, r.address, r.phone, r.operating_status) for r in poi(raw).orderBy("id").collect()] == [("N", "1 Main, Town", "555", "open"), ("Plain", "", "", "open"), ("", "Town", "", "open"), ("", "1 Main, Town", "", "open")]


def test_sinks_caches_and_stores(spark, tmp_path):
    path = str(tmp_path / "state" / "x.json")
    for n in (1, 2):
        save_json(spark, path, {"name": "Café", "n": n})
    assert read_json(spark, path, "name string, n int").first() == ("Café", 2)
    assert [p.name for p in (tmp_path / "state").iterdir() if not p.name.endswith(".crc")] == ["x.json"]
    entry = {"content_hash": "h", "sources": ["u"], "extract": {"status": "ok"}}
    for name, doc in (("flat", {"a": entry, "b": {"other": 1}, "updated_at": "x"}), ("deep", {"updated_at": "x", "venues": {"a": entry}})):
        save_json(spark, str(tmp_path / name), doc)
        assert [(r.id, r.content_hash, r.extract.status) for r in read_cache(spark, str(tmp_path / name), "struct<status:string>").collect()] == [("a", "h", "ok")]
    root = str(tmp_path / "store")
    for n in (1, 2):
        append_observations(spark.createDataFrame([("v", n), ("w", n)], "venue_id string, n int"), root)
    assert sorted(r.n for r in observations_of(spark, root, "venue_id string, n int", "v").collect()) == [1, 2] and observations_of(spark, root, "venue_id string, n int").count() == 4
    assert column(spark, locations(F.col("v")), "<urlset><url><loc> http://a </loc></url><loc>b</loc>", "x", None) == [["http://a", "b"], [], []]

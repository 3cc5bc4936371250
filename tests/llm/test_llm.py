"""The operators against brute force, exact round trips and their stated edge cases."""

import itertools
import random

import pytest

pytest.importorskip("hopyard.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from hopyard.llm import addresses, body, discovery, increments, linkage, mixing, places, residue, spans, tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.tiktoken")


TEXTS = ["Hello world, it's 5pm!", "", None, "   ", "naïve Straße 東京 🍺🍺", "Kelenstad Varunlack zzqxjv", "a" * 500, "ab" * 300, "x y\n\n z\t", "same", "same", "don't 'll 're", "\x00\x01|‹›", *["xq" * 63 + "z" * k for k in range(1, 5)], "Kelenstad zzqxjv Kelenstad zzqxjv Kelenstad"]


def test_encode_equals_a_public_encoder_and_decodes_back(spark, ranks):
    import base64

    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("ids", F.lit("clash"))
    got = tokenizer.encode(df, "id", "text", ranks)
    want = {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.id: r.ids for r in got.collect()} == want
    assert {r.id: r.n_tokens for r in tokenizer.count_tokens(df, "id", "text", ranks).collect()} == {i: len(v) for i, v in want.items()}
    back = got.select("id", tokenizer.decode(F.col("ids"), ranks).alias("t")).collect()
    assert {r.id: r.t for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenizer.encode(df.limit(0), "id", "text", ranks).count() == 0


def test_encode_searches_no_array_by_position_and_folds_alike(spark, ranks, monkeypatch):
    plans, real = [], tokenizer.materialize
    monkeypatch.setattr(tokenizer, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df, name))
    tokenizer.encode(spark.createDataFrame([(1, "Kelenstad zzqxjv")], "id long, text string"), "id", "text", ranks)
    assert len(plans) == 2 and not any("array_position(" in p for p in plans)
    rng = random.Random(3)
    words = ["".join(rng.choice("abenrst\u00c3\u00a9 ") for _ in range(n)) for n in [*range(1, 40), 127, 128]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    both = df.select("w", *(tokenizer.with_ranks(ranks, lambda rank, f=f: f(F.col("w"), rank)).alias(f.__name__) for f in (tokenizer.fold_places, tokenizer.fold_pairs)))
    for r in both.collect():
        assert r.fold_places == r.fold_pairs and "".join(r.fold_places) == r.w


def test_mix_keeps_total_and_caps(spark):
    rng = random.Random(1)
    rows = [(i, s, rng.randint(0, 50)) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 6 + ["other"] * 3)] + [(99, None, 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeat int")
    copies, report = mixing.mix(spark.createDataFrame(rows, "id long, source string, size long"), targets)
    got = {r.id: r.copies for r in copies.collect()}
    most = {"a": 1, "b": 2, "c": 3}
    assert len(got) == 100 and all(0 <= got[i] <= most.get(s, 0) for i, s, _ in rows)
    assert all(abs(r.actual_share - r.target_share) < 0.1 for r in report.collect())
    parts = mixing._pivot(list(range(9)), [3.0] * 9, [1 / 3] * 9, 0, True)
    assert set(parts) <= {0.0, 1.0} and sum(parts) == 3


def _longest(a, b, n):
    return any(a[i : i + n] in b for i in range(len(a) - n + 1))


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    span, near = word(230), word(199)
    docs = [span, word(150) + span + word(90), span[:200] + word(40), near + word(60), word(70) + near, span, "-" * 400, "-" * 1000 + word(300), word(900), None, "", "short", word(40) + span[15:215]]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string").withColumn("a", F.lit("clash"))
    found, members = spans.shared_spans(df, "id", "text", (F.col("id") % 3).cast("int"), 3)
    got = {(r.doc_a, r.doc_b) for r in spans.shared_pairs(found, members).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(docs), 2) if a and b and _longest(a, b, 200)}
    assert got == want
    extent = {r.id: (r.n_chars, r.shared_chars) for r in spans.shared_extent(df, "id", "text", found, members).collect()}
    assert extent[0] == (230, 230) and extent[9] == (0, 0) and extent[1] == (470, 230) and extent[8][1] == 0


@pytest.mark.parametrize("a,b,same", [
    ("887 N. Huckleberry Parkway Inganfield, MT 10210", "887 north huckleberry pkwy", True),
    ("Minos Bench, M.T. 10094, 3420 Fenilrill Wy, # 3", "unit 3, 3420 Fenilrill Way", True),
    ("3450 South 13th Avenue Ste. 1, Branaton", "S 13th Avenue, 3450, Unit 3, Branaton", False),
    ("1582 W Cedar Ave, Tamil Creek", "1582 West Cedar St., Tamil Creek", False), ("5 Oak St, Here", "5 Oak St, Elsewhere", False),
    ("Orlavsoll Drive 889 Branaton 10007", "889 Orlavsoll Dr", True), ("77O2 Quinatbury Road", "7702 Quinatbruy Rd", True), ("10 4th St", "10 5th St", False),
])
def test_same_location(a, b, same):
    x, y = places.parse_address(a), places.parse_address(b)
    assert places.same_location(x, y) == same == places.same_location(y, x)


def test_address_join_equals_all_pairs(spark):
    texts = ["12 Oak St, Town, MT 10001", "12 oak street", "Town: 12 Oka St.", "12 Oak St Unit 2, Town", "12 Oak Ave, Town", None, "", "Town", "12 Oak St, Town, MT 10001", "99 Elm Rd", "99 Elm Road, Town"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, address string")
    got = {(r.rec_a, r.rec_b) for r in addresses.expand(*addresses.same_location(df)).collect()}
    parsed = [places.parse_address(t) for t in texts]
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if parsed[i] and parsed[j] and places.same_location(parsed[i], parsed[j])}
    assert addresses.expand(*addresses.same_location(df.limit(0))).count() == 0


def test_link_needs_two_attributes_and_separates_branches(spark):
    cols = "id long, name string, address string, phone string"
    left = [(k, f"Red Fox{k} Tavern", f"{k} Oak St, Town", f"(200) 555-{1000 + k}") for k in range(1, 30)]
    right = [(100 + k, f"The Red Fox{k}", f"{k} Oak Street", f"2005551{k:03d}") for k in range(1, 30)]
    right += [(200, "Red Fox5 Tavern", "77 Elm St, Town", None), (201, "Blue Owl", "5 Oak St, Town", None), (202, "Red Fox5 Tavern", None, ""), (203, None, None, None)]
    got = linkage.link(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(k, 100 + k) for k in range(1, 30)} and all(0.5 <= r.confidence <= 1 for r in got)
    assert linkage.link(spark.createDataFrame([], cols), spark.createDataFrame(right, cols)).count() == 0


def test_batches_repeat_history(spark):
    cols = "id long, name string, address string"
    h = increments.History(spark)
    h.seed(spark.createDataFrame([(-7, -7, "gone bar", "1 oak st"), (-8, -8, "lost cafe", None)], "id long, root long, name string, address string"))
    first = h.add(spark.createDataFrame([(1, "Gone Bar", "1 Oak Street, Town"), (2, "New Pub", "2 Elm Rd"), (3, "New Pub", "2 Elm Road, Town"), (4, "New Pub", ""), (5, "New Pub", "3 Elm Rd"), (6, "Lost Café", "9 Ash Ln")], cols))
    assert {(r.id, r.root) for r in first.collect()} == {(1, -7), (2, 2), (3, 2), (5, 5), (6, -8)}
    second = h.add(spark.createDataFrame([(7, "New Pub", "2 Elm Rd, Town"), (8, "Old Pub", "2 Elm Rd"), (9, None, "2 Elm Rd")], cols))
    assert {(r.id, r.root) for r in second.collect()} == {(7, 2), (8, 8)}
    assert h.add(spark.createDataFrame([], cols)).count() == 0


def test_surviving_claim(spark):
    rows = [
        (1, "v", "phone", '"(200) 555-1000"', "2026-08-01T00:00:00Z", "own_site", 0.9), (2, "v", "phone", '"2005551000"', "2026-08-02T00:00:00Z", "x", 0.95), (3, "v", "phone", '"555-1000"', "2026-08-03T00:00:00Z", "y", 0.99),
        *[(10 + i, "v", "phone", '"200-555-9999"', "2026-05-01T00:00:00Z", "z", 0.3) for i in range(5)], (20, "v", "phone", '"N/A "', None, "own_site", 1.0),
        (30, "w", "hours", '"Mon 3-5pm"', "", "x", None), (31, "w", "hours", '"mon  3–5PM"', "", "x", None), (40, "u", "hours", '"solo"', "", "x", 0.5), (50, "t", "hours", "null", "", "x", 0.5), (51, "t", "hours", '"?"', "", "x", 0.5),
    ]
    df = spark.createDataFrame(rows, "claim_id long, venue_id string, field string, value string, observed_at string, source_family string, weight double")
    got = {(r.venue_id, r.field, r.claim_id) for r in discovery.surviving(df, "2026-08-05T00:00:00Z").collect()}
    assert got == {("v", "phone", 2), ("w", "hours", 30)}
    assert discovery.surviving(df.limit(0), "2026-08-05T00:00:00Z").count() == 0


PAGE = """<html><head><title>t</title></head>
<body><div class="cc-banner"><p>We use cookies to count visits.</p></div>
<div class="q1"><ul>
<li><a href="/a">About</a></li>
</ul></div>
<div class="q2">
<h1>The Fox</h1>
<p>The kitchen of the fox stays open until ten and serves a long list of pies to all who come in, rain or shine.
<p>More text follows here about the music on Friday nights and the garden behind the house.
<li>Pie: $4.00
</div>
<div class="q3"><p>Share this page</p>
<p>Most read this week</p></div></body></html>"""


def test_body_lines():
    assert body.body_lines(PAGE) == [7, 8, 9, 10]
    assert body.body_lines("") == [] and body.body_lines("<div><!-- x") == [] and body.body_lines("<p>404 Not Found</p>") == []


def test_residue_pages(spark):
    real = "<p>A long and real text about the tavern on the corner, its beers, its pies, its music and the people who come here every night of the week, whatever the weather does, and who stay until the lights go out.</p>"
    pages = [
        (1, "http://h/1", PAGE), (2, "http://h/2", "<body><h1>Page not found</h1></body>"), (3, "http://h/3", real + "<p>Hours: {{hours}}</p>"), (4, "http://h/4", None), (5, None, " "),
        (6, "http://h/5", real + "<script>var m='Page not found'</script><noscript>Please enable JavaScript</noscript>"), (7, "http://h/6", real + "<p>Lorem Ipsum IPA is on tap</p>"),
        (8, "http://h/7", "<p>Lorem ipsum dolor sit amet consectetur</p>"), (9, "http://h/8", "<p>Please enable JavaScript to view this page</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    assert {r.page_id for r in residue.residue_pages(df, "page_id", "url", "html").collect()} == {2, 3, 8, 9}
    assert residue.residue_pages(df.limit(0), "page_id", "url", "html").count() == 0


def test_every_branch_of_filler():
    lines = [
        "a test test of it", "Just another demo site: edit or remove this first entry", "just another test page", "placeholder paragraph", "to be written by the owner", "Describe this venue in a few words", "Delete this block", "delete this line", "delete this paragraph",
        *[f"{kind} {what}" for kind in ("dummy", "placeholder", "filler", "sample", "example") for what in ("copy", "text", "content")],
        *[f"{what} goes here" for what in ("text", "copy", "headline", "title", "description", "content", "story")],
        *[f"{verb} your {what}" for verb in ("add", "insert", "enter", "write", "type") for what in ("headline", "title", "text", "copy", "description", "tagline", "content")], "Your headline",
        "Item name, item description", "replace it with", "replace this with", "replace me with", "coming soon: text", "coming soon copy", "texto de ejemplo", "texto de relleno", "texto de muestra", "escriba aquí",
        "texte d'exemple", "texte de remplissage", "texte factice", "votre texte ici", "Saisissez votre adresse", "ici votre texte", "Blindtext", "Platzhalter", "Beispieltext", "Mustertext", "Ihr Text", "hier steht",
    ]
    lines += [x.replace("i", c).replace("s", s) for x in lines for c, s in ("iſ", "ıs", "İs")]
    assert [x for x in lines if residue.FILLER.search(x) and not residue.is_filler(x)] == []
    assert all(map(residue.FILLER.search, lines))
    assert not residue.is_filler("Just another night at the Fox")


def test_short_phones_without_address_equal_all_pairs(spark):
    rng = random.Random(5)
    names = [
        "Nevumvick Mitten Cafe", "Nevumvick Mitten Caffe", "Kesitdale Marmot Smoke House", "Kesitdale Marmot BBQ", "The Marmot Kesitdale", "Red Fox", "Fox Red", "Redfox", "Rde Fox", "Der Fox", "R F", "Red F", "J Smith", "Jon S", "K S",
        "Ab Co", "Ba", "A", "B", "Brandywine", "rBandywien", "Barndywnie", "Xrandywinex", "Blue Owl", "Bleu Owls", "21 Club", "Pub", "Bar", None, "",
    ]
    some = lambda k: [(k + i, n, rng.choice([None, "", "12 Oak St", "40 Elm Rd, Town"]), rng.choice(["555-1227", "206-555-1227", "(406) 555 1227", "555-9999"])) for i, n in enumerate(names * 5)]
    left, right = some(0), some(1000)
    cols = "id long, name string, address string, phone string"
    got = {(r.left_id, r.right_id) for r in linkage.link(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), confidence=0.0).collect()}

    def parts(rows):
        return [(k, " ".join(places.name_words(n)[0]), "|".join(places.parse_address(t) or ()), places.phone_digits(p)) for k, n, t, p in rows]

    def agree(x, y):
        """Two attributes agree, at least in part, and neither name nor address speaks against it."""
        level = linkage.name_level(x[1], y[1]), linkage.address_level(x[2], y[2]), linkage.phone_level(x[3], y[3])
        return sum(v in (linkage.AGREES, linkage.PARTLY) for v in level) >= 2 and level[0] != linkage.DIFFERS and level[1] not in (linkage.DIFFERS, linkage.PARTLY)

    want = {(x[0], y[0]) for x, y in itertools.product(parts(left), parts(right)) if agree(x, y)}
    assert want <= got and want


def test_the_posterior_tells_branches_and_neighbours():
    a, p, m, d = linkage.AGREES, linkage.PARTLY, linkage.MISSING, linkage.DIFFERS
    post = linkage.fit({(a, a, a): 500, (a, a, m): 300, (a, m, a): 100, (d, d, d): 300, (a, d, a): 80, (d, a, d): 60, (d, a, a): 20, (p, a, a): 30, (a, a, d): 15})
    assert all(post[x] > 0.9 for x in ((a, a, a), (a, a, m), (a, m, a), (p, a, a), (m, a, a), (a, a, d)))
    assert all(post[x] < 0.5 for x in ((a, d, a), (d, a, a), (d, a, d), (d, d, d), (a, d, m), (d, a, m), (m, d, a), (d, m, a)))
    empty = linkage.fit({})
    assert empty[a, a, a] > 0.9 and empty[a, d, a] < 0.5 and empty[d, a, a] < 0.5


def test_extent_counts_every_copy_in_a_text(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(k))
    one, two = word(300), word(260)
    many = lambda p, n: "".join(p + word(80) for _ in range(n))
    docs = [many(one, 30) + "-" * 500, word(50) + one + word(50), many(two, 20), word(9) + two, many(one, 21) + two, "-" * 700 + word(40) + "-" * 210, word(700), one[:250] * 25]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    got = {r.id: r.shared_chars for r in spans.shared_extent(df, "id", "text", *spans.shared_spans(df, "id", "text", (F.col("id") % 2).cast("int"), 2)).collect()}
    want = {}
    for i, a in enumerate(docs):
        others = {b[k : k + 200] for j, b in enumerate(docs) if j != i for k in range(len(b) - 199)}
        want[i] = len({p for k in range(len(a) - 199) if a[k : k + 200] in others for p in range(k, k + 200)})
    assert got == want and got[0] >= 9500
    assert spans.grow("-" * 30_000, "-" * 40_000, [(-1, -1)], 200)


def test_address_join_takes_missing_components_for_no_difference(spark):
    pairs = [("12 N Oak St #4", "12 Oak St, Town, MT 10001"), ("12 N Oak #4", "12 Oak St, Town, MT 10001"), ("7 Elm, Unit 3", "7 S Elm Rd, Here, MT 10002"), ("9 W Ash Ln # 2", "9 Ash, There 10003")]
    df = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "id long, address string")
    got = {(r.rec_a, r.rec_b) for r in addresses.expand(*addresses.same_location(df)).collect()}
    parsed = {r.id: places.parse_address(r.address) for r in df.collect()}
    want = {(i, j) for i, j in itertools.combinations(sorted(parsed), 2) if places.same_location(parsed[i], parsed[j])}
    assert got == want and {(0, 1), (1, 2), (4, 5), (6, 7)} <= want


def test_spans_against_a_compacted_run(spark, tmp_path, monkeypatch):
    from hopyard.llm import queries

    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    shared = [word(220) for _ in range(4)]
    docs = [word(30) + shared[i % 4] + word(i) if i % 3 else word(300) for i in range(60)]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    met = []
    places_of = spans.SpanIndex.places

    def watched(self, marks):
        met.append(max((k for k, _ in self.runs), default=0))
        return places_of(self, marks)

    monkeypatch.setattr(spans.SpanIndex, "places", watched)
    got = {(r.doc_a, r.doc_b) for r in queries.p10_found(spark, str(tmp_path)).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(docs), 2) if _longest(a, b, 200)}
    # A batch was matched against a run that four were merged into.
    assert met[-1] >= 1


def test_trust_is_followed_until_it_settles(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(n * 10 + k, f"v{n}", "noise", f'"{rng.choice("ab")}{n}"', "2026-08-01T00:00:00Z", f, 0.5) for n in range(40) for k, f in enumerate("pqrs") if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "claim_id long, venue_id string, field string, value string, observed_at string, source_family string, weight double")
    seen = []

    def watched(frame, name, write=discovery.materialize):
        out = write(frame, name)
        if name == "trust":
            seen.append({r.family: r.trust for r in out.collect()})
        return out

    monkeypatch.setattr(discovery, "materialize", watched)
    discovery.surviving(df, "2026-08-05T00:00:00Z").count()
    assert max(abs(seen[-1][f] - seen[-2][f]) for f in seen[-1]) < 1e-4
    monkeypatch.setattr(discovery, "ROUNDS", 2)
    with pytest.warns(UserWarning, match="after 2 rounds"):
        discovery.surviving(df, "2026-08-05T00:00:00Z")


def test_a_long_chain_in_one_batch_has_one_root(spark):
    names = ["abcdefg"]
    for i in range(7):
        names.append(names[-1][:i] + "x" + names[-1][i + 1 :])
    rows = [(i + 1, n, "5 Oak St, Town") for i, n in enumerate(names)]
    h = increments.History(spark)
    first = h.add(spark.createDataFrame(rows, "id long, name string, address string"))
    assert {(r.id, r.root) for r in first.collect()} == {(i, 1) for i in range(1, 9)}
    seeded = increments.History(spark)
    seeded.seed(spark.createDataFrame([(-3, -3, names[0], "5 oak st")], "id long, root long, name string, address string"))
    assert {r.root for r in seeded.add(spark.createDataFrame(rows, "id long, name string, address string")).collect()} == {-3}


BARE = ["<html><body>", "<div class=x1>", *[f"<p>Offer {c} now</p>" for c in "abcdef"], "</div>", "<div class=x2>", *[f"<p>{w} the stout is poured from four until seven, and the kitchen keeps its snacks at half their price all week long.</p>" for w in ("Here", "Then", "Next")], "</div>", "</body></html>"]


def test_the_smoothed_ratio_selects_the_region(monkeypatch):
    """Boxes that nothing marks: the long lines are the body, though the short ones are more."""
    html = "\n".join(BARE)
    long = [i for i, x in enumerate(BARE, 1) if "stout" in x]
    assert body.body_lines(html) == long
    ratio = body.text_to_tag
    monkeypatch.setattr(body, "text_to_tag", lambda page: ratio(page) * 0 + 1)
    assert body.body_lines(html) != long
    monkeypatch.setattr(body, "text_to_tag", lambda page: 1 / (1 + ratio(page)))
    assert body.body_lines(html) != long


def test_threshold_and_smoothing():
    import numpy as np

    x = np.array([1.0, 2, 1, 50, 60, 55, 2, 1])
    assert 2 < body.threshold(x) < 50 and body.threshold(np.ones(3)) == 1
    assert body.smooth(np.ones(7)).tolist() == pytest.approx([1] * 7) and len(body.smooth(np.zeros(0))) == 0
    assert abs(body.smooth(x).sum() / x.sum() - 1) < 0.2


def test_counting_by_host_decides(spark):
    """A message on all pages of a host is its teaser; the same message on one page is that page's."""
    page = lambda extra, i: f"<html><body><main>\n<h1>Bar {chr(65 + i)}</h1>\n<p>Beer {chr(65 + i)}</p>\n{extra}\n</main></body></html>"
    gone = "<p>Page not found</p>"
    rows = [(i, "http://a.example/x", page(gone, i)) for i in range(6)] + [(10 + i, "http://b.example/x", page("", i)) for i in range(6)] + [(20, "http://b.example/y", page(gone, 25))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = lambda **k: {r.page_id for r in residue.residue_pages(df, "page_id", "url", "html", **k).collect()}
    assert found() == {20}
    assert found(share=9.0) == {*range(6), 20}


def test_long_messages_and_long_texts():
    message = "Please enable JavaScript and cookies in your browser to go on reading, since this site builds every one of its pages with scripts and stores what you chose in a cookie on your own device"
    text = "The kitchen had no error on its slip that night. " + "We drank the stout and ate the fries at the rail. " * 6
    assert len(message) > 140 and residue.is_error(message) and not residue.is_error(text)


@pytest.mark.parametrize(("one", "other", "same"), [
    ("12345 Oak St, Town", "12345 Oak Street", True), ("1234567 Oak St", "1234567 Oak Street, Town", True), ("12345 Oak St, Town, MT 59715", "12345 Oak St, 59715", True),
    ("12 Oak Grove, Town", "12 Oak Grove St, Town", True), ("12 Montana Ave", "12 Montana Avenue", True), ("12 Montana Ave, Town, Montana", "12 N Montana Ave", True),
    ("12 Oak #3, 10001", "12 N Oak St, Town", True), ("12 Oak #3, 10001", "12 N Oak St #4, Town", False), ("12 Oak Grove, Town", "12 Oak Hill, Town", False),
])
def test_locations(one, other, same):
    a, b = map(places.parse_address, (one, other))
    assert (places.same_location(a, b) and addresses.contains(a, b)) is same
    assert not same or set(places.street_keys(a)) & set(places.street_keys(b))


def test_a_tree_of_groups_keeps_shares(spark):
    """Groups of four rows make several levels of the tree; each source still has its share but for one small row."""
    rng = random.Random(8)
    rows = [(i, "abc"[i % 3], rng.randint(1, 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2)], "source string, target_share double, max_repeat int")
    copies, report = mixing.mix(df, targets, total=15_000, group_rows=4)
    got = {r.source: r for r in report.collect()}
    assert all(abs(got[s].size - share * 15_000) <= 40 for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    one = {r.id: r.copies for r in copies.collect()}
    assert len(one) == 1500 and max(one.values()) <= 2
    sizes = {i: n for i, _, n in rows}
    assert sum(sizes[i] * k for i, k in one.items()) == sum(r.size for r in got.values())


def test_compaction_of_many_batches_loses_nothing(spark, monkeypatch):
    """Five batches with compaction by two make two levels of compacted runs; the roots are those of one batch."""
    monkeypatch.setattr(increments, "FANOUT", 2)
    cols = "id long, name string, address string"
    rows = [(i, f"Bar {'abcdefg'[i % 7] * 5}", f"{1 + i % 5} Oak St, Town") for i in range(75)]
    h = increments.History(spark)
    roots = {}
    for n in range(5):
        roots |= {r.id: r.root for r in h.add(spark.createDataFrame(rows[15 * n : 15 * n + 15], cols)).collect()}
    assert sorted(k for k, _ in h.runs) == [0, 2]
    assert roots == {i: i % 35 for i in range(75)}


def test_wide_windows_find_the_same_pairs(monkeypatch):
    """A window searched by keys of names gives the pairs that a walk over all its rows gives."""
    rng = random.Random(9)
    words = ["fox", "fxo", "redfox", "red", "owl", "olw", "publick", "public", "house", "a", "f", "caffe"]
    rows = [increments.Form(" ".join(rng.sample(words, rng.randint(1, 3))), "5|oak||st|||", rng.random() < 0.5, i) for i in range(150)]
    pairs = lambda: {(i, j) for i, j in increments._window(rows) if increments.same_place(rows[i], rows[j])}
    wide = pairs()
    monkeypatch.setattr(increments, "WIDE", 1000)
    assert pairs() == wide and wide

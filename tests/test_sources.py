"""Text functions, extraction, reading, writing and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from venuemill import schemas
from venuemill.functions import geo, text
from venuemill.operators import incremental, serve
from venuemill.sources import articles as A
from venuemill.sources import pages as X
from venuemill.sources import registry, tables
from venuemill.streaming import ingest

NBSP = chr(0xA0)


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


TEXT_CASES = [
    (text.normalize_address, {
        "Adress: Storgatan 1.\nTel: 08": "Storgatan 1", "Gatan 2, tel: 08-32 34 40.": "Gatan 2", "Gatan 3. Tel 08–11": "Gatan 3",
        "Gatan 4, Dalarna / Falun Norra": "Gatan 4", "Gatan 6 / Vägen 19": "Gatan 6 / Vägen 19", "Gatan 7, www": "Gatan 7", "Gatan 8, Lund": "Gatan 8",
        "Gatan 9, Malmö": "Gatan 9, Malmö", f"{NBSP}Gatan{NBSP}{NBSP}5 . ": "Gatan 5", "": "", "  ": "",
    }),
    (text.normalize_city, {" gothenburg ": "Göteborg", "Skåne": "", "Gamla Stan": "Stockholm", "Kalmar": "Kalmar", "": ""}),
    (text.normalize_venue_name, {" ‘Bar’ “X”. ": "'Bar' \"X\"", "A   B.": "A B", f"{NBSP}C{NBSP}": "C"}),
    (text.normalize_price, {"$": "budget", "$$": "mellan", "$$$$": "lyx", "LÅGT": "budget", "Mycket högt": "lyx", "dyrt": "dyrt", "": ""}),
    (text.name_key, {
        "Restaurang Frantzén": "frantzén", "Hotell Hotel X": "hotel x", "Kött & Grill": "kött", "L'Avventura´s": "lavventuras", "Bar": "bar", "Café Bar": "bar",
        "A" + NBSP + "& Bar": "a", "!!!": "",
    }),
    (text.address_key, {"Storgatan 1, Stockholm.": "storgatan 1", "Gatan 2 Malmö": "gatan 2 malmö", "x äsverige": "x ä"}),
    (text.slugify, {"Frantzén & Co Stockholm": "frantzen-co-stockholm", "Ærø Straße": "aero-strasse", "--Å--": "a", "": ""}),
    (text.city_before_postcode, {"Gatan 1, Lund, 111 22, Sweden": "Lund", "Gatan 1, Norra, Lund": "Lund", "Gatan": "", "Gatan 1, 111 22": "111 22"}),
    (text.city_after_postcode, {"Gatan 1, 123 45 Umeå": "Umeå", "Gatan, Dalarna / Falun": "Falun", "Gatan": "Gatan"}),
    (text.city_from_last_part, {"Gatan 1, 11122, Lund": "Lund", "Gatan 1, 114 46 Visby, Schweden": "Visby", "": ""}),
    (text.city_from_place_address, {"Gatan 1, 111 22 Borås, Sverige": "Borås", "Borås, Sweden": "", "x": ""}),
    (text.name_from_title, {"Krogen X: bäst": "Krogen X", "Veckans krog: x": None, "Ab: x": None, "Utan kolon": None, ": x": None, "x" * 50 + ": y": None}),
    (lambda c: text.strip_html(c), {"<p>A &amp;lt; B</p>\r\n\n\n\nC&nbsp;": "A < B\n\nC", "&#39;&mdash;": "'—"}),
    (text.leading_int, {"12abc": 12, " -3 ": -3, "abc": None, "": None}),
    (lambda c: text.clean_guide_address(c, F.lit("Lund")), {"Gatan 1, Lund, 111 22, Sweden": "Gatan 1", "Gatan 1, lund": "Gatan 1", "Gatan 1, Nylund": "Gatan 1, Nylund", "Lund": "Lund"}),
    (lambda c: geo.format_distance(c.cast("double")), {"999.4": "999 m", "1000": "1.0 km", "12345": "12.3 km"}),
]


@pytest.mark.parametrize("fn,cases", TEXT_CASES)
def test_text(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_street_numbers(spark):
    got = apply(spark, text.street_number, ["Storgatan 12 B, Stockholm", "Torget", None])
    assert [tuple(x) if x else x for x in got] == [("storgatan", "12 b"), ("torget", ""), None]


def test_in_country_and_centroid(spark):
    df = spark.createDataFrame([(59.0, 18.0, ""), (59.0, 18.0, "Oslo"), (48.0, 2.0, ""), (55.3, 10.9, "")], "a double, b double, c string")
    assert [r.x for r in df.select(geo.in_country(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [True, False, False, True]
    assert apply(spark, lambda c: geo.city_centroid(c)["lat"], [" MALMÖ", "?"]) == [55.6, 62.0]


def test_registry(spark):
    assert registry.all_sources(spark).count() == 10
    assert registry.enabled_sources(spark).where("id = 'dn-news'").count() == 0
    assert registry.source(spark, "di").first().scale_max == 25.0
    assert registry.source_ids(spark).distinct().count() == 10


def test_matrix_keeps_last_header_and_skips_bad_rows(spark):
    payload = spark.createDataFrame(
        [(["Restaurang", "Totalpoäng", "Ort", "Ort"], [["A", "20", "Lund", "Visby"], ["", "20", "x", "y"], ["B", "x", "x", "y"], ["C", "7p", None, None], ["D"]])],
        "cols array<string>, rows array<array<string>>")
    got = A.decode_matrix(payload).orderBy("pos").collect()
    assert [(r.pos, r.name, r.total_score, r.city) for r in got] == [(0, "A", 20, "Visby"), (3, "C", 7, "")]
    ids = [r.id for r in A.matrix_articles(A.decode_matrix(payload), "t").collect()]
    import hashlib
    assert ids[0] == hashlib.sha256(b"di:di:A").hexdigest()[:12]


def page(spark, *htmls):
    return spark.createDataFrame([(f"u{i}", h) for i, h in enumerate(htmls)], "url string, html string")


def ld(*objs):
    return "".join(f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objs)


def test_list_page_first_graph_and_empty_list(spark):
    graph = lambda *nodes: {"@graph": list(nodes)}
    a, b = {"@id": "#a", "@type": "Hotel", "name": "A"}, {"@id": "#b", "@type": "Restaurant", "name": "B"}
    listed = {"@type": "ItemList", "itemListElement": [{"item": {"@id": "#b"}}, {"item": {}}, {}]}
    pages = page(spark, ld("{bad", {"@graph": "no"}, graph(a, b, listed), graph(a)), ld(graph(a, b)), "<p>none</p>")
    got = sorted((r.url, r.listed, r.pos) for r in X.list_page(pages).select("url", "listed", "pos").collect())
    assert got == [("u0", 1, 0), ("u1", 0, 0), ("u1", 0, 1)]


def test_restaurant_page_last_wins(spark):
    one = {"@type": "Restaurant", "name": "One", "address": {"streetAddress": "G 1"}, "image": {"url": "i"}}
    two = {"@type": "Review", "itemReviewed": {"@type": "BarOrPub", "name": "Two", "address": {"streetAddress": " G 2 "}, "servesCuisine": "Thai, "}}
    got = X.restaurant_page(page(spark, ld([one, two]), ld(one), ld({"@type": "Restaurant", "name": "NoAddress"}))).orderBy("url").collect()
    assert [(r.name, r.address, r.cuisine, r.image, r.rating) for r in got] == [("Two", "G 2", "Thai", "", None), ("One", "G 1", "", "i", None)]


def test_article_text_drops_short_and_walled(spark):
    html = "<article><p>short</p><p class='x'>This one is long enough to stay.<p>Logga in för att läsa resten av texten</p></article><p>Outside the article but long enough</p>"
    assert apply(spark, X.article_text, [html, ""]) == ["This one is long enough to stay.", ""]


def test_article_text_follows_nested_elements(spark):
    a, b, c = (f"Paragraph {x} is long enough to stay." for x in "abc")
    cases = {
        f'<div class="article__body"><div class="ad">x</div><p>{a}</p><div><div><p>{b}</p></div></div><p>{c}</p></div><p>Outside of it, but long enough.</p>': f"{a}\n\n{b}\n\n{c}",
        f'<p class="article-promo">A promotion that is long enough.</p><img class="article-img"><p>{a}</p>': "",
        f"<!-- <article> --><script class='article-data'>'<article>'</script><p>Outside of it, but long enough.</p><article><!-- </article> --><p>{a}</p></article>": a,
        f"<ARTICLE><article><p>{a}</p></article><p>{b}</p></ARTICLE><div class='x'><p>Outside of it, but long enough.</p></div><section class='x article'><p>{c}</section>": f"{a}\n\n{b}\n\n{c}",
        f"text <div class='news-article'><p>{a}</p>": a,
    }
    assert apply(spark, X.article_text, list(cases)) == list(cases.values())
    assert apply(spark, X.article_text, [None]) == [None]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel>" + "".join(
            f"<item><link> https://d/{p}/{i} </link><title>T{i}: x</title><pubDate>Fri, 13 Mar 2026 15:15:17 +0100</pubDate><description>&lt;b&gt;d&lt;/b&gt;</description></item>"
            for i, p in enumerate(["kultur", "sport", "kultur"])) + "</channel></rss>")
    items = A.read_rss(spark, str(tmp_path / "f.xml"))
    known = spark.createDataFrame([("https://d/kultur/0",)], "url string")
    fresh = A.new_feed_items(items, known)
    meta = spark.createDataFrame([("https://d/kultur/2", "", "", "")], "url string, og_title string, og_description string, published_at string")
    row = A.feed_articles(fresh, meta, "t").first()
    assert (row.title, row.published_at, row.body_text, row.content_type, row.venue_name) == ("T2: x", "2026-03-13T14:15:17.000Z", "d", "listing", "")


def test_load_and_save(spark, tmp_path):
    assert tables.load_articles(spark, str(tmp_path / "none")).count() == 0
    assert tables.load_stage(spark, str(tmp_path / "none")) is None
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "source_id": "di", "venue_name": "A", "tags": ["x"]}, {"id": "2", "sub_articles": [{"venue_name": "B"}]}]))
    df = tables.load_articles(spark, str(tmp_path / "a.json"))
    assert [(r.id, r.pos) for r in df.orderBy("pos").collect()] == [("1", 0), ("2", 1)]
    tables.save_articles(df, str(tmp_path / "out"))
    assert tables.load_articles(spark, str(tmp_path / "out"), multi_line=False).count() == 2
    (tmp_path / "many").mkdir()
    for name in "cab":
        (tmp_path / "many" / f"{name}.json").write_text(json.dumps([{"id": f"{name}{i}"} for i in range(3)]))
    many = tables.load_articles(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [(r.id, r.pos) for r in many] == [(f"{name}{i}", k * 3 + i) for k, name in enumerate("abc") for i in range(3)]
    tables.save_stage(df, str(tmp_path / "stage"))
    assert tables.load_stage(spark, str(tmp_path / "stage")).count() == 2
    serving = spark.createDataFrame([(1, "bar", 2), (2, "bar", 1), (3, "fika", 1)], "idx int, category string, rank int")
    tables.save_serving(serving, str(tmp_path / "serve"))
    assert sorted(p.name for p in (tmp_path / "serve").iterdir() if p.is_dir()) == ["category=bar", "category=fika"]
    lines = serve.sitemap_xml(serve.sitemap_rows(serving.withColumn("id", F.col("idx").cast("string")), "https://v", "2024-01-01"))
    tables.save_lines(lines, str(tmp_path / "map"))
    assert spark.read.text(str(tmp_path / "map")).count() == 7


def test_normalize_articles_drops_city_headers(spark):
    given = {"id": "1", "venue_name": "A.", "sub_articles": [("Stockholm ", None, None, None, None, None), ("B ", "Adress: G 1", None, 3.0, "$", "t")]}
    df = spark.createDataFrame([tuple(given.get(f.name) for f in schemas.ARTICLE.fields)], schemas.ARTICLE)
    row = A.normalize_articles(df).first()
    assert row.venue_name == "A" and [tuple(s) for s in row.sub_articles] == [("B", "G 1", None, 3.0, "budget", "t")]


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([("u1", 1), ("u2", 2), ("u1", 3)], "url string, n int")
    df.write.parquet(source)
    spark.createDataFrame([("u2", 0)], df.schema).write.parquet(out)
    stream = spark.readStream.schema(df.schema).parquet(source)
    ingest.append_new(stream, lambda: spark.read.schema(df.schema).parquet(out), out, str(tmp_path / "c1"), order="n").awaitTermination()
    assert sorted((r.url, r.n) for r in spark.read.parquet(out).collect()) == [("u1", 1), ("u2", 0)]
    # a second batch that repeats known rows, then a replay of everything from the start
    spark.createDataFrame([("u3", 9), ("u3", 4), ("u1", 0)], df.schema).write.mode("append").parquet(source)
    for checkpoint in ("c1", "again"):
        ingest.append_new(stream, lambda: spark.read.schema(df.schema).parquet(out), out, str(tmp_path / checkpoint), order="n").awaitTermination()
        assert sorted((r.url, r.n) for r in spark.read.parquet(out).collect()) == [("u1", 1), ("u2", 0), ("u3", 4)]
    q = ingest.first_seen(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("seen").collect()) == ["u1", "u2", "u3"]
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("n")))
    q = ingest.first_seen(timed, event_time="at", delay="1 day").writeStream.format("memory").queryName("bounded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("bounded").collect()) == ["u1", "u2", "u3"]
    looked = spark.createDataFrame([("1", None, "b"), ("2", "p", "a")], "id string, place_id string, queried_at string")
    looked.write.parquet(str(tmp_path / "l"))
    cache, kept = looked.where("id = '1'").withColumn("queried_at", F.lit("a")), {}
    ingest.maintain_lookups(
        spark.readStream.schema(looked.schema).parquet(str(tmp_path / "l")), lambda: cache,
        lambda d, i: kept.setdefault(i, d.orderBy("id").collect()), str(tmp_path / "c2")).awaitTermination()
    assert [tuple(r) for r in kept[0]] == [("1", None, "b"), ("2", "p", "a")]


def test_fingerprint_sees_changes(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    stored = incremental.table_fingerprint(df).first().fingerprint
    assert len(stored) == 16 and not incremental.is_stale(df.repartition(5), stored)
    assert incremental.is_stale(df.withColumn("x", F.col("x") + (F.col("id") == 3).cast("int")), stored)
    assert incremental.is_stale(df.unionByName(df.limit(1)), stored)

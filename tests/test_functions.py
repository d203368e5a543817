from datetime import date

from pyspark.sql import functions as F

from chartspark.functions import parse, text
from chartspark.operators import relational as rel


def one(spark, value, form, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(form(F.col("v")).alias("r")).first().r


def test_names_and_titles(spark):
    assert one(spark, "Beyoncé & JAY-Z", text.name_a) == "beyoncé and jayz"
    assert one(spark, "Beyoncé & JAY-Z", text.name_b) == "beyonce and jay z"
    assert one(spark, "Beyoncé & JAY-Z", text.name_c) == "beyonc  jayz"
    assert one(spark, "Essence (feat. Tems) [Remix]", text.title_form) == "essence remix"
    assert tuple(one(spark, "A - B - C", text.split_artist_title)) == ("A - B", "C")
    assert tuple(one(spark, "NoDash", text.split_artist_title)) == ("", "NoDash")
    assert tuple(one(spark, "Ameno (feat. Nektunez & Goya) - Remix", text.extract_features)) == ("Ameno - Remix", ["Nektunez", "Goya"])
    assert one(spark, "Drake Featuring Rihanna & Jay-Z", text.split_credit) == ["Drake", "Rihanna", "Jay-Z"]
    uk = lambda c: text.split_credit(c, True)
    assert one(spark, "feat. BURNA BOY/ed SHEERAN FT. o'neal", uk) == ["Burna Boy", "ed Sheeran", "O'neal"]
    assert one(spark, "& REMA x, AYRA STARR", uk) == ["Rema X", "Ayra Starr"]
    assert one(spark, "  ", uk) == [""]
    assert one(spark, ["A", "b", "a", "B"], text.dedupe_order, "array<string>") == ["A", "b"]
    assert one(spark, "God's Plan!", lambda c: text.album_slug(c, F.lit("ABCDEFGHIJ"))) == "gods-plan-ABCDEFGH"


def test_numbers_and_dates(spark):
    assert [one(spark, v, parse.signed_number) for v in ("-1,234", "135,361,606", "--")] == [-1234, 135361606, None]
    assert [one(spark, v, parse.unsigned_number) for v in ("-1,234", "")] == [1234, 0]
    assert [one(spark, v, parse.units) for v in ("16x Platinum", "3", "abc")] == [16, 3, None]
    assert [one(spark, v, parse.source_date) for v in ("2026/04/09", "2026/4/9")] == [date(2026, 4, 9), None]
    assert [one(spark, d, parse.friday, "date") for d in (date(2024, 1, 10), date(2024, 1, 5))] == [date(2024, 1, 5)] * 2
    assert tuple(one(spark, "earned RIAA 16x Platinum Award for GOD'S PLAN", parse.award_level)) == ("platinum", 16)
    assert tuple(one(spark, "earned RIAA Platinum Award for GOLD DIGGER", parse.award_level)) == ("platinum", 1)


def test_greedy_insert_and_upsert(spark):
    rows = [("c", "t", date(2024, 1, 5), s, p, i) for i, (s, p) in enumerate([(1, 1), (1, 2), (2, 2)])]
    df = spark.createDataFrame(rows, "chart_name string, chart_territory string, chart_week date, song_id long, position int, seq int")
    assert sorted(r.seq for r in rel.greedy_insert(df).collect()) == [0, 2]
    old = spark.createDataFrame([(1, "a", 1), (None, "b", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "x", 9, 0), (1, "y", 9, 1), (None, "z", 9, 2)], "k int, v string, w int, seq int")
    assert sorted(map(repr, map(tuple, rel.upsert(old, new, ["k"], ["v"], "seq").collect()))) == ["(1, 'y', 1)", "(None, 'b', 1)", "(None, 'z', 9)"]
    assert sorted(map(repr, map(tuple, rel.insert_ignore(old, new, ["k"], "seq").collect()))) == ["(1, 'a', 1)", "(None, 'b', 1)", "(None, 'z', 9)"]


def test_chart_credits(spark):
    assert tuple(one(spark, "Song (Remix feat. A & B) [w/ C]", text.extract_features)) == ("Song", ["Remix A", "B", "C"])
    assert tuple(one(spark, "Love (with D+E x F)", text.extract_features)) == ("Love", ["D", "E", "F"])
    assert tuple(one(spark, "(featherweight) Go", text.extract_features)) == ("(featherweight) Go", [])
    assert tuple(one(spark, "Up (featuring Drake)", text.extract_features)) == ("Up", ["uring Drake"])
    assert tuple(one(spark, "A&B, C feat. D", text.split_artists)) == ("A", ["B", "C"])
    assert tuple(one(spark, "Wizkid ft. Tems", text.split_artists)) == ("Wizkid", [])
    assert tuple(one(spark, "", text.split_artists)) == ("", [])
    assert one(spark, " «A​»  【b】 ", text.normalize_all) == "(A) (b)"
    assert one(spark, "‚a‛ „b‟ «c» ‘d’", text.ascii_quotes) == "'a' \"b\" \"c\" ‘d’"
    assert one(spark, "ＡＢ  ﬁ", text.norm_key) == "ab fi"
    assert one(spark, "Ü １", lambda c: text.track_key(c, F.lit(" X Y "))) == "ü 1::x y"


def test_fused_charts_follow_language_order(spark):
    from chartspark.operators import charts

    rows = [("ng", "spotify", 1, 5, "B", "Éa", None), ("ng", "spotify", 2, 5, "B", "ez", None), ("ng", "apple", 3, 5, "a", "EZ", ["X"]), ("ng", "apple", 4, 5, "A & b", "ez", ["x", "Y"]), ("ng", "apple", 5, 9, "A", "ez", None), ("ng", "apple", 6, 999, "Z", "z", None)]
    df = spark.createDataFrame(rows, "country string, platform string, seq int, rank int, artist string, title string, featured array<string>")
    out = charts.combined(df, ["country"], {"spotify": 1, "apple": 2}, max_rank=10).orderBy("rank").collect()
    assert [(r.rank, r.artist, r.title, r.score, r.apple_rank) for r in out] == [(1, "a", "EZ", 12, 5), (2, "B", "Éa", 6, None), (3, "B", "ez", 6, None)]
    assert out[0].featured == ["X"]


def test_slugs_write_signs_and_letters_out(spark):
    cases = {
        "Simon & Garfunkel": "simon-and-garfunkel", "Straße Æon Œuvre Þór": "strasse-aeon-oeuvre-thor", "Beyoncé  JAŸ-Z": "beyonce-jay-z", "Жанна Агузарова щё": "zhanna-aguzarova-shyo", "50% $tar": "50percent-dollartar",
        "Ψυχή Ώρα θξ": "psyxh-wra-83", "e\u0301te": "ete", "ØłĐ ỗ": "old-o", "東京 x": "x", "--a__b--": "-ab-", "!!": "", "I'm £5 < €6 | ♥": "im-pound5-less-euro6-or-love",
    }
    for raw, want in cases.items():
        assert one(spark, raw, text.slug) == want, raw
    plan = spark.range(1).select(text.slug(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan

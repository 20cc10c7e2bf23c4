import hashlib

from pyspark.sql import functions as F

from tempolog.functions import keys, text, urls


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_hash_keys_keep_empty_parts(spark):
    df = spark.createDataFrame([("a", None, "c")], "a string, b string, c string")
    assert df.select(keys.hash_key(F.col("a"), F.col("b"), F.col("c"))).first()[0] == hashlib.sha256(b"a\x1f\x1fc").hexdigest()


def test_titles(spark):
    found = [tuple(one(spark, text.title_parts, v)) for v in ("3114. Song (Ann)", "$12 : Other", "Plain (a) (Random)", "'Quoted'", "", None)]
    assert found == [("3114", "Song", "Ann"), ("12", "Other", None), (None, "Plain (a)", "Random"), (None, "Quoted", None), (None, None, None), (None, None, None)]


def test_number_prefixes(spark):
    values = ["12abc", "abc", " -7x", "", None, "99999999999999999999"]
    assert [one(spark, keys.number_prefix, v) for v in values] == [12, 0, -7, 0, 0, 2**63 - 1]


def test_urls_of_all_systems(spark):
    cases = {
        "http://api.udon.dance/Api/Songs/play?id=3114": ("wannadance", "3114", "wanna_api", "api_query_id"),
        "http://139.196.46.195:51886/Api/Songs/play?id=5": ("wannadance", "5", "wanna_api", "api_query_id"),
        "http://api.udon.dance/Api/Songs/play?x=1": (None, None, "wanna_api", "missing_query_id"),
        "https://jd.pypy.moe/api/v1/videos/77.mp4": ("pypydance", "77", "pypydance_api", "api_video_file_path"),
        "https://pypy.example/x": (None, None, "pypydance", "unsupported_system"),
        "https://www.dudufit.dance/zh-CN/videos/9/": ("dudu", "9", "dudu", "web_video_path"),
        "https://youtu.be/x": (None, None, "other", "unsupported"),
        "": (None, None, "empty", "none"),
        None: (None, None, "empty", "none"),
    }
    assert {u: tuple(one(spark, urls.classify_url, u)) for u in cases} == cases


def test_contract_is_strict(spark):
    good = {"http://api.udon.dance/Api/Songs/play?id=7": "wannadance:7", "https://api.dudufit.dance:443/api/v1/videos/8": "dudu:8"}
    bad = ["http://api.udon.dance/Api/Songs/Play?id=7", "http://u@api.udon.dance/Api/Songs/play?id=7", "http://api.udon.dance:8080/Api/Songs/play?id=7", "http://api.udon.dance/Api/Songs/play?id=07", "http://api.udon.dance/Api/Songs/play?id=7&id=8", "http://api.udon.dance/Api/Songs/play?id=7 ", None]
    assert {u: one(spark, urls.contract_key, u) for u in [*good, *bad]} == good | dict.fromkeys(bad)


def test_folding_is_unicode_aware(spark):
    assert one(spark, text.folded_text, "  ﬁne  Straße　X ") == "fine strasse x"


def test_null_texts_stay_null(spark):
    for function in (text.clean_name, text.clean_url, text.text_or_null, text.folded_text, text.minutes_seconds):
        assert one(spark, function, None, "double" if function is text.minutes_seconds else "string") is None

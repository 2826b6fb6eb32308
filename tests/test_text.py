from pyspark.sql import functions as F

from murmurline.functions import labels, places, scores, text


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


def test_tokens(spark):
    got = one(spark, "Life doesn't get easier", text.tweet_tokens)
    assert got == ["Life", "doesn't", "get", "easier"]
    assert one(spark, "see http://x.com/a?b=1, ok...", text.tweet_tokens) == ["see", "http://x.com/a?b=1", ",", "ok", "..."]
    assert one(spark, "(hello) U.S.A. at 3:45, 1,234 &amp; up--down", text.tweet_tokens) == [
        "(", "hello", ")", "U.S.A.", "at", "3:45", ",", "1,234", "&amp;", "up", "--", "down"]
    assert one(spark, "my dog's", text.tweet_tokens) == ["my", "dog", "'s"]
    assert one(spark, "   ", text.tweet_tokens) == []


def test_alignment(spark):
    source = "  go   to bla.com. now (\"you\") "
    pairs = one(spark, source, text.aligned_tokens)
    squeezed = " ".join(source.split())
    assert [squeezed[p["start"]:p["start"] + len(p["tok"])] for p in pairs] == [p["tok"] for p in pairs]
    assert [p["start"] for p in pairs] == sorted(p["start"] for p in pairs)


def test_long_alignment_is_whole(spark):
    words = [f"w{i}," for i in range(500)]
    pairs = one(spark, " ".join(words), text.aligned_tokens)
    assert len(pairs) == 1000
    assert pairs[-2]["start"] == len(" ".join(words[:-1])) + 1


def test_cleaning(spark):
    assert one(spark, "hi @a_b!", text.plain_ascii) == "hi -MENTION- b"
    assert one(spark, "\"Soo www.x.org/a @me #Tag  now'", text.normalise_tweet) == "soo URL AT_USER tag now"
    assert one(spark, "soooo coool\n\n\nx", text.cap_repeats) == "soo cool\n\nx"
    assert one(spark, "soooo \"good\", 4ever URL AT_USER", text.feature_words) == ["soo", "good", "url"]


def test_keywords_and_faces(spark):
    assert one(spark, "A BEER, a beer", text.has_keyword) is True
    assert one(spark, "jack daniel's", text.has_keyword) is False  # phrases never equal one token
    assert one(spark, "Beer", lambda c: text.has_keyword(c, lower=False)) is False
    assert one(spark, "drinking", text.starts_with_keyword) is True
    assert one(spark, "some Hookah", text.mentions_shisha) is True
    moods = {"a :) b :(": "BOTH_HS", ":-D": "HAPPY", "=[": "SAD", "^_^": "HAPPY", "no": "NA"}
    for value, mood in moods.items():
        assert one(spark, value, text.emoticon_mood) == mood


def test_ngrams(spark):
    got = one(spark, "aa bb cc", lambda c: text.ngrams_up_to(text.plain_tokens(c)))
    assert got == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert one(spark, "aa", lambda c: text.ngrams(text.plain_tokens(c), 3)) == []


def test_places(spark):
    expect = {"Texas, USA": ("TX", -6), "Austin, TX": ("TX", -6), "Guam, USA": ("GU", 0), "London": ("<Other>", 0), "": ("<Other>", 0)}
    for value, (state, hours) in expect.items():
        assert one(spark, value, places.state_of) == state
        assert one(spark, value, lambda c: places.state_hours(places.state_of(c))) == hours


def test_offset_filter(spark):
    rows = spark.createDataFrame([(o,) for o in (-14400, -28800, -10800, -32400)], "utc_offset int").withColumn(
        "created_at", F.expr("timestamp_ntz'2024-01-02 03:00:00'"))
    got = {r["utc_offset"]: r["local_time"].hour for r in places.with_local_time_by_offset(rows).collect()}
    assert got == {-14400: 23, -28800: 19}


def test_answers(spark):
    rows = spark.createDataFrame([("Not Alcohol Related",), ("First Person - Alcohol::Heavy Drinking",),
                                  ("Alcohol Related::Promotional Content",), ("?",), ("{}",)], "Answer string")
    good, bad = labels.parse_answers(rows)
    got = {r["Answer"]: tuple(r["labels"]) for r in good.collect()}
    assert got["Not Alcohol Related"] == (0, None, None, None, None)
    assert got["First Person - Alcohol::Heavy Drinking"] == (1, 1, 0, None, None)
    assert got["Alcohol Related::Promotional Content"] == (1, 0, None, 1, "Alcohol Related::Promotional Content")
    assert [r["Answer"] for r in bad.collect()] == ["?"]


def test_flags_are_strict(spark):
    row = spark.createDataFrame([(0.6, None)], "a double, b double").select(
        scores.flag("a", 0.6).alias("a"), scores.flag("b", 0.1).alias("b"), scores.flag("a", 0.59).alias("c")).first()
    assert tuple(row) == (0, 0, 1)

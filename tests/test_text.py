import pytest
from pyspark.sql import functions as F

from chalkline.functions import filename, language, responses, text, vectors


def one(spark, expression, given):
    return spark.createDataFrame([(given,)], "x string").select(expression(F.col("x")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("class6_social_science_ch3.pdf", ("6", "social_science", "3")),
        ("class8_science_ch12.pdf", ("8", "science", "12")),
        ("class5_english.pdf", ("5", "", "english")),
        ("foo.pdf", ("foo", "", "foo")),
    ],
)
def test_filename_fields(spark, given, expected):
    row = spark.createDataFrame([(given,)], "filename string").withColumns(
        filename.filename_fields(F.col("filename"))
    )
    assert tuple(row.select("class_num", "subject", "chapter").first()) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a\n\n\n\nb", "a\n\nb"),
        ("a \t\t b", "a b"),
        ("\n x\ty \xa0", "x y"),
        ("a\n\n\n \n\n\nb", "a\n\n \n\nb"),
        ("plain text", "plain text"),
        ("", ""),
    ],
)
def test_clean_page(spark, given, expected):
    assert one(spark, text.clean_page, given) == expected


@pytest.mark.parametrize("given, expected", [("a b\n\tc", 3), ("", 0), ("  ", 0), ("a\xa0b\x1fc", 3)])
def test_word_count(spark, given, expected):
    assert one(spark, text.word_count, given) == expected == len(given.split())


@pytest.mark.parametrize(
    "given, expected",
    [
        ("<b>x</b> **bold** *it* __u__ _v_ ~~s~~ `c`", "x bold it u v s c"),
        ("# Head\n- one\n* two\n12. three\n> quote", "Head one two three quote"),
        ("see [the page](http://x) | now ----", "see the page now"),
        ("a\n\n\tb", "a b"),
        ("**no\nmatch**", "no match"),
    ],
)
def test_speech_text(spark, given, expected):
    assert one(spark, text.speech_text, given) == expected.replace("no match", "**no match**")


def test_plain_speech_text(spark):
    given = "x ```\ncode\n``` `y` [z](u) #1 > a_b | *c*"
    assert one(spark, text.plain_speech_text, given) == "x y z 1 a b c"
    assert len(one(spark, text.plain_speech_text, "a" * 3000)) == 2400


@pytest.mark.parametrize(
    "number",
    [0.0, -0.0, 1.0, -2.5, 0.1, 1e-4, 1.5e-5, 123456.789, 1e7, 12345678.9, 1.2345e15, 1e16, -1.5e300, 1.5e-300],
)
def test_float_text(spark, number):
    row = spark.createDataFrame([(number,)], "x double")
    assert row.select(text.safe_text(F.col("x"), "double").alias("out")).first()["out"] == str(number)


def test_safe_text_of_missing_values(spark):
    row = spark.createDataFrame([(None, float("nan"), True, None)], "a string, b double, c boolean, d int")
    kinds = {f.name: f.dataType.typeName() for f in row.schema}
    out = row.select(*[text.safe_text(F.col(n), k).alias(n) for n, k in kinds.items()]).first()
    assert tuple(out) == ("", "", "True", "")


@pytest.mark.parametrize(
    "given, expected",
    [
        ("hello", "en"),
        ("", "en"),
        ("வணக்கம் नमस्ते", "hi"),
        ("வணக்கம்", "ta"),
        ("నమస్కారం", "te"),
        ("ನಮಸ್ಕಾರ", "kn"),
        ("നമസ്കാരം", "ml"),
        ("নমস্কার", "bn"),
        ("привет", "en"),
    ],
)
def test_detect_language(spark, given, expected):
    assert one(spark, language.detect_language, given) == expected


@pytest.mark.parametrize(
    "given, code, name",
    [("hi-IN", "hi-IN", "Hindi"), ("od", "od-IN", "Odia"), ("fr", "en-IN", "fr"), ("", "en-IN", ""), (None, "en-IN", None)],
)
def test_language_lookups(spark, given, code, name):
    assert one(spark, language.speech_code, given) == code
    assert one(spark, language.language_name, given) == name


@pytest.mark.parametrize(
    "given, thinking, answer, spoken",
    [
        ("plain ", None, "plain ", "plain"),
        ("<think> a\nb </think> yes", "a\nb", "yes", "yes"),
        ("<think>a</think>x<think>b</think>y", "a", "xy", "xy"),
        ("<think>open", None, "<think>open", "<think>open"),
    ],
)
def test_thinking(spark, given, thinking, answer, spoken):
    assert one(spark, responses.thinking, given) == thinking
    assert one(spark, responses.answer, given) == answer
    assert one(spark, responses.without_thinking, given) == spoken


@pytest.mark.parametrize(
    "given, expected",
    [
        ('{"choices": [{"message": {"content": " hi "}}]}', " hi "),
        ('{"choices": []}', None),
        ('{"error": 1}', None),
        ("not json", None),
    ],
)
def test_chat_content(spark, given, expected):
    assert one(spark, responses.chat_content, given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ('{"translated_text": " a "}', "a"),
        ('{"translated_text": " ", "output": "b"}', "b"),
        ('{"translated_text": null, "text": 5}', "5"),
        ("{}", None),
    ],
)
def test_translation(spark, given, expected):
    assert one(spark, responses.translation, given) == expected


def test_transcript_defaults(spark):
    assert one(spark, responses.transcript_text, "{}") == ""
    assert one(spark, responses.transcript_language, "{}") == "en"


@pytest.mark.parametrize(
    "given, expected", [("data:audio/wav;base64,aGk=", b"hi"), ("aGk=", b"hi"), ("!!", None)]
)
def test_payload(spark, given, expected):
    out = one(spark, responses.data_url_bytes, given)
    assert (None if out is None else bytes(out)) == expected


def test_l2_normalize(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0, 0.0],)], "v array<float>")
    out = [r["u"] for r in rows.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()]
    assert out[0] == pytest.approx([0.6, 0.8], abs=1e-6)
    assert out[1:] == [[0.0, 0.0], None, [1.0, 0.0]]


def test_products(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<float>, b array<float>")
    out = row.select(
        vectors.inner_product(F.col("a"), F.col("b")), vectors.squared_distance(F.col("a"), F.col("b"))
    ).first()
    assert tuple(out) == (13.0, 13.0)

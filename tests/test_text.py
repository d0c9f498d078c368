import pytest
from pyspark.sql import functions as F

from hustings.functions import fixed, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, kept, sorted_forms",
    [
        ("Mr. Chairman, I rise", "I rise", "I rise"),
        ("Thank you, Mr. Chairman.", "Thank you, Mr. Speaker.", "Thank you, Mr. Speaker."),
        # The short form is rewritten first and spoils these two, as is to be kept.
        ("Thank you, Madam Chairman.", "Thank you, Mr. Speakerman.", "Thank you, Mr. Speaker."),
        ("Thank you, Madam Chairwoman.", "Thank you, Mr. Speakerwoman.", "Thank you, Mr. Speaker."),
        ("Mr. Speaker, I yield myself 2 minutes.  Mr. Speaker, hello", "hello", "hello"),
        ("a \n\t b", "a b", "a b"),
    ],
)
def test_clean_speech(spark, raw, kept, sorted_forms):
    assert value(spark, text.clean_speech(F.lit(raw))) == kept
    assert value(spark, text.clean_speech(F.lit(raw), fixed_order=True)) == sorted_forms


@pytest.mark.parametrize(
    "raw, out",
    [
        ("Introduction of the  Clean Air Act of 2021.", "clean air act"),
        ("Supporting the introduction of the X Act", "x act"),
        ("Report on Rule 5, Motion to Y, Act of 1999", "motion to y act"),
        ("motion to proceed", "motion to proceed"),
        ("Authorizing the Clerk to make corrections", None),
        ("Motion to, authorizing the clerk", None),
        ("Farm Bill--Continued", "farm bill"),
        ("Farm Act; and for other purposes.", "farm act"),
        ("Farm Act, and for other purposes; and for other purposes", "farm act"),
        ("Farm Act (Executive Calendar) (Executive Session)", "farm act"),
        ("Farm Act (Executive Session) (Executive Calendar)", "farm act executive session"),
        ("Farm Act, 2021", "farm act"),
        ("Farm act of", "farm act"),
        ("...", None),
        ("", None),
        ("x;,", "x"),
    ],
)
def test_standardize_title(spark, raw, out):
    assert value(spark, text.standardize_title(F.lit(raw))) == out


def test_null_title(spark):
    assert value(spark, text.standardize_title(F.lit(None).cast("string"))) is None


def test_words_are_unicode(spark):
    assert value(spark, text.normalize_text(F.lit("Ça va — élan_1!"))) == "ça va élan_1"
    assert value(spark, text.words(F.lit(" a b\x1dc "))) == ["a", "b", "c"]
    assert value(spark, text.normalize_text(F.lit("see http://x.y/z 42 now"), urls=True, digits=True)) == "see now"


@pytest.mark.parametrize(
    "html, out",
    [
        ("<p>a<b>b</b></p>", "a b"),
        ("x<script>var a='<p>';</script>y", "x y"),
        ("a<!-- no --><br/>b", "a b"),
        ("&lt;tag&gt; &#233;&amp;amp;", "<tag> é&amp;"),
        ("1 < 2", "1 < 2"),
        (None, ""),
    ],
)
def test_strip_html(spark, html, out):
    assert value(spark, text.strip_html(F.lit(html).cast("string"))) == out


def test_speaker_parts(spark):
    got = value(spark, text.parse_speaker(F.lit("Mr. JOHNSON of Ohio")))
    assert (got["lastname"], got["state"]) == ("JOHNSON", "Ohio")
    got = value(spark, text.parse_speaker(F.lit("SCHUMER")))
    assert (got["lastname"], got["state"]) == ("SCHUMER", None)
    assert value(spark, text.remove_salutation(F.lit("Ms. JACKSON LEE"))) == "JACKSON LEE"
    assert value(spark, text.remove_salutation(F.lit("CHAIR"))) == "CHAIR"
    assert value(spark, text.display_name(F.lit("O'BRIEN-SMITH,ann"))) == "O'Brien-Smith, Ann"


def test_dates_and_names(spark):
    assert str(value(spark, text.parse_date(F.lit("2021-03-04T10:00:00Z")))) == "2021-03-04"
    assert str(value(spark, text.parse_date(F.lit("soon"), fixed.EPOCH))) == fixed.EPOCH
    assert value(spark, text.names_from_json(F.lit('[{"name": "a"}, {"other": 1}]'))) == ["a"]
    assert value(spark, text.names_from_json(F.lit("[oops"))) == []
    assert value(spark, text.label_key(F.lit("Health"), F.lit(None).cast("string"))) is None


def test_references_and_quoted_signs(spark):
    cases = {
        "a &#x27;b&#39; &eacute;&notin; &amp;lt; &unknown; &amp": "a 'b' é∉ &lt; &unknown; &amp",
        "&#9999999; &#55357; &#0; &#99999999999999; &#xFFFFFFFFF;": "\ufffd \ufffd \ufffd \ufffd \ufffd",
        "<a title='x > y'>in</a><b c=\"q>\">b</b>": "in b", "&#128512;&#x1F600;": "\U0001f600\U0001f600", None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "c string, want string")
    for r in df.withColumn("got", text.strip_html("c")).collect():
        assert r.got == r.want

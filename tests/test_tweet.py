"""The tweet normaliser against literal expected outputs, rule by rule."""

import pytest

from equitext.functions.text import normalise_tweet

NBSP, WIDE = " ", "　"

CASES = [
    # links
    ("see https://a.example/x?y=1 now", "see <url> now"),
    ("at www.site.example/page ok", "at <url> ok"),
    # users
    ("ask @some_one today", "ask <user> today"),
    # faces
    ("fine :) then", "fine <smile> then"),
    ("well ;p", "well <lolface>"),
    ("oh :( no", "oh <sadface> no"),
    ("so :| then", "so <neutralface> then"),
    # slashes
    ("this/that", "this / that"),
    # hearts
    ("all <3 here", "all <heart> here"),
    # numbers
    ("paid 12.50 or -3", "paid <number> or <number>"),
    # hashtags: words, capitals, and spaces of every kind as their end
    ("a #newDay b", "a <hashtag> new day b"),
    ("a #LOUD b", "a  loud  b"),
    (f"#AB{NBSP}cd", f" ab {NBSP}cd"),
    (f"#tag{WIDE}Word x", f"<hashtag> tag{WIDE}word x"),
    # repeated marks
    ("what??? yes!!", "what? <repeat> yes! <repeat>"),
    # lengthened words
    ("sooo heyyyy", "so <elong> hey <elong>"),
    # capitals
    ("it is GREAT", "it is great <allcaps>"),
    ("plain words stay", "plain words stay"),
    ("", ""),
]


def test_literal_outputs(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalise_tweet("t").alias("n")).collect()}
    wrong = [(s, got[i], want) for i, (s, want) in enumerate(CASES) if got[i] != want]
    assert not wrong, wrong


@pytest.mark.parametrize("value", [None, ""])
def test_missing_text(spark, value):
    assert spark.createDataFrame([(value,)], "t string").select(normalise_tweet("t")).first()[0] == ""

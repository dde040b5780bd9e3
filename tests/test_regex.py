import pytest

from sluice.functions.regex import RegexError, translate_pattern, translate_replacement


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "\\1", "a**", "a++", "(?U)a", "[",
                                     "(", ")", "\\C", "\\Z", "x{1001}", "*a", "(?P<n>a)(?P<n>b)"])
def test_rejected_like_re2(pattern):
    with pytest.raises(RegexError):
        translate_pattern(pattern)


def test_translation_rules():
    assert translate_pattern("c$").pattern == "(?d)c\\z"
    assert translate_pattern("(?m)c$").pattern.endswith("c$")
    assert translate_pattern("\\bx").pattern == "(?d)(?<!\\w)x"          # one-sided next to a literal
    assert "(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w)" in translate_pattern("\\b\\w").pattern
    assert translate_pattern("\\s").pattern == "(?d)[\\t\\n\\f\\r ]"
    assert translate_pattern("a{,3}").pattern == "(?d)a\\{,3\\}"
    assert translate_pattern("[[:alpha:]]").pattern == "(?d)[\\p{Alpha}]"
    assert translate_pattern("(?i)x").pattern == "(?d)(?iu)x"
    t = translate_pattern("(?P<first_name>\\w+) (\\w+)")
    assert t.groups == 2 and t.names == {"first_name": 1}


def test_replacement_template():
    t = translate_pattern("(a)")
    assert translate_replacement("$1x", t) == ""          # group named "1x": empty
    assert translate_replacement("${1}x", t) == "${g1}x"
    assert translate_replacement("$$", t) == "\\$"
    assert translate_replacement("$9", t) == ""            # out of range: empty
    assert translate_replacement("a\\b", t) == "a\\\\b"   # backslash literal
    assert translate_replacement("$", t) == "\\$"


@pytest.mark.parametrize("text,pattern,repl,expected", [
    ("hello world", r"(\w+) (\w+)", "$2 $1", "world hello"),
    ("cab", "(a)", "$1x", "cb"),
    ("cab", "(a)", "${1}x", "caxb"),
    ("cab", "(a)", "$$", "c$b"),
    ("abc\n", "c$", "X", "abc\n"),
    ("abc", "c$", "X", "abX"),
    ("éth th", r"\bth", "X", "éX X"),
    ("Ab_cd", r"(?P<first_part>[A-Z])(?P<rest>\w+)", "${rest}-${first_part}", "b_cd-A"),
])
def test_regex_replace_node(spark, text, pattern, repl, expected):
    from sluice.feed import Feed
    from sluice.operators.fields import regex_replace
    f = Feed.from_table(spark.createDataFrame([(1, text)], "i int, t string"), "i")
    assert regex_replace(f, "t", pattern, repl, spark).df.first()["t"] == expected


def test_regex_node_raises_on_bad_pattern(spark):
    from sluice.feed import Feed
    from sluice.operators.fields import regex_replace
    f = Feed.from_table(spark.createDataFrame([(1, "x")], "i int, t string"), "i")
    with pytest.raises(RegexError):
        regex_replace(f, "t", "(?=x)", "y", spark)


def test_regex_leaves_numbers(spark):
    from sluice.feed import Feed
    from sluice.operators.fields import regex_replace
    f = Feed.from_table(spark.createDataFrame([(1, 5)], "i int, t int"), "i")
    assert regex_replace(f, "t", "5", "6", spark).df.first()["t"] == 5


@pytest.mark.parametrize("text,pattern,expected", [
    ("éth th xth", r"\bth", "éX X xth"),
    ("ing thing ing_", r"ing\b", "X thX ing_"),
    ("ab b", r"\Bb", "aX b"),
    ("ab ba", r"b\B", "ab Xa"),
    ("x y", r"\bx?y", "x X"),
])
def test_one_sided_boundaries_keep_re2_semantics(spark, text, pattern, expected):
    from sluice.feed import Feed
    from sluice.operators.fields import regex_replace
    f = Feed.from_table(spark.createDataFrame([(1, text)], "i int, t string"), "i")
    assert regex_replace(f, "t", pattern, "X", spark).df.first()["t"] == expected

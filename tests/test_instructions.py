import pytest
from pyspark.sql import functions as F

from tallyloom.functions.instructions import CHECKERS

CASES = [
    ("keywords:frequency", {"keyword": "a", "frequency": 2}, "a b a", "a b"), ("keywords:letter_frequency", {"letter": "z", "frequency": 1, "relation": "less than"}, "abc", "zed"), ("length_constraints:number_sentences", {"n": 2}, "One. Two.", "One."),
    ("length_constraints:nth_paragraph_first_word", {"total": 2, "n": 2, "word": "Then"}, "A b.\n\nthen c.", "A b.\n\nnow c."), ("length_constraints:number_paragraphs", {"n": 2}, "a *** b", "a"), ("detectable_format:json_format", {}, '{"a": 1}', "{a"), ("detectable_format:title", {}, "<<T>> x", "T"),
    ("count:word_count_range", {"low": 1, "high": 2}, "a b", "a b c"), ("count:unique_word_count", {"n": 2}, "a b", "a a"), ("count:numbers", {"n": 2}, "1 and 2.5", "1"), ("count:conjunctions", {"n": 2}, "x and y or z", "and and"), ("count:pronouns", {"n": 1}, "it is", "is"),
    ("words:alphabet", {}, "ant bee cat", "ant cat"), ("words:palindrome", {"n": 1}, "a level", "a leveled"), ("words:prime_lengths", {}, "to the", "four"), ("words:repeats", {"n": 1}, "a b", "a a"), ("words:last_first", {}, "I see you. You see me.", "I see you. He sees."),
    ("words:no_consecutive", {}, "a b a", "a apple"), ("words:words_position", {"word": "x", "start": 2, "end": 2}, "a x b x c", "a b x"), ("sentence:keyword", {"word": "cat", "n": 2}, "One. The cat.", "The cat. One."), ("sentence:increment", {"step": 1}, "A. A b. A b c.", "A. A b c."),
    ("format:parentheses", {"depth": 2}, "(a [b])", "(a) (b)"), ("format:newline", {}, "a\nb", "a b"), ("format:line_indent", {}, "a\n b\n  c", "a\nb"), ("format:list", {"mark": "->"}, "-> a\n-> b", "- a"), ("format:sub-bullets", {}, "* a\n  - b", "* a\n* b"), ("format:title_case", {}, "Some Good Text", "Some good text"),
    ("format:no_whitespace", {}, "ab", "a b"), ("repeat:repeat_simple", {"phrase": "x y"}, "X y ", "x"), ("ratio:stop_words", {"percent": 50.0}, "the cat", "the of"), ("punctuation:no_comma", {}, "a b", "a, b"), ("startend:quotation", {}, '"a"', "a"),
]


def test_checkers(spark):
    columns = [CHECKERS[i](F.lit(t), **k).alias(f"c{n}_{j}") for n, (i, k, *texts) in enumerate(CASES) for j, t in enumerate(texts)]
    row = spark.range(1).select(*columns).first()
    for n, (i, *_) in enumerate(CASES):
        assert (row[f"c{n}_0"], row[f"c{n}_1"]) == (True, False), i


@pytest.mark.parametrize("name", [i for i, k, *_ in CASES])
def test_nulls_and_empty(spark, name):
    k = next(k for i, k, *_ in CASES if i == name)
    df = spark.createDataFrame([(None,), ("",)], "c string")
    assert {r["x"] for r in df.select(CHECKERS[name](F.col("c"), **k).alias("x")).collect()} <= {True, False, None}

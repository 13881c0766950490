"""Text projections, answer filters and parsers as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = "[invalid]"
_BLANK = " \t\n\r\x0b\x0c"

#: Answer filters by name: each takes the column and its own options.
FILTERS: dict[str, Callable[..., Column]] = {}


def register_filter(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Adds a filter to the registry; a name can be taken once."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in FILTERS:
            raise ValueError(f"filter {name} exists")
        FILTERS[name] = f
        return f

    return add


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@register_filter("regex")
def regex(c: Column, pattern: str, group: int = 1, select: int = 0, fallback: str = INVALID) -> Column:
    """The match number ``select`` of all matches (negative: from the end), trimmed, or ``fallback``."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    # try_element_at counts from 1, and from -1 at the end
    return F.coalesce(stripped(F.try_element_at(found, F.lit(select + 1 if select >= 0 else select))), F.lit(fallback))


FILTERS["extract"] = regex


@register_filter("regex_pos")
def regex_pos(c: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group joined by blanks."""
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), " ")


@register_filter("remove_whitespace")
def remove_whitespace(c: Column) -> Column:
    return F.ltrim(c, F.lit(_BLANK))


@register_filter("remove_until")
def remove_until(c: Column, delimiter: str) -> Column:
    """What follows the first delimiter; the whole text where there is none."""
    at = F.instr(c, delimiter)
    return F.when(at > 0, F.substring(c, at + len(delimiter), F.char_length(c))).otherwise(c)


@register_filter("take_first")
def take_first(answers: Column) -> Column:
    return F.slice(answers, 1, 1)


@register_filter("take_first_k")
def take_first_k(answers: Column, k: int) -> Column:
    """The first k answers; an error where there are fewer."""
    return F.when(F.size(answers) >= k, F.slice(answers, 1, k)).otherwise(F.raise_error(F.lit(f"fewer than {k} answers")))


@register_filter("majority_vote")
def majority_vote(answers: Column) -> Column:
    """The most frequent answer; of equally frequent ones the first seen. Null of an empty list."""
    counted = F.transform(F.array_distinct(answers), lambda a: F.struct(F.size(F.filter(answers, lambda x: x.eqNullSafe(a))).alias("n"), (-F.array_position(answers, a)).alias("p"), a.alias("a")))
    return F.array_max(counted)["a"]


def chain(c: Column, steps: Sequence[tuple[str, dict]]) -> Column:
    """Filters from left to right."""
    return reduce(lambda acc, s: FILTERS[s[0]](acc, **s[1]), steps, c)


def choices(c: Column) -> Column:
    """A choice list from a text: split at commas if there are any, else at blanks; trimmed."""
    parts = F.when(F.contains(c, F.lit(",")), F.split(c, ",")).otherwise(F.split(stripped(c), r"\s+"))
    return F.transform(parts, stripped)


def letter(i: Column) -> Column:
    """A, B, .. Z and then 1, 2, .. for 0-based indexes."""
    return F.when(i < 26, F.char(i + 65)).otherwise((i - 25).cast("string"))


def choice_lines(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda x, i: F.concat(letter(i), F.lit(") "), x)), "\n")


def chosen_letter(c: Column, last: str = "D") -> Column:
    """A multiple-choice answer: after ``ANSWER:`` at a line's start, then anywhere, then the last lone capital; else null."""
    span = f"A-{last}"
    forms = [rf"(?mi)^\s*ANSWER\s*:\s*([{span}])(?:[^A-Za-z0-9]|$)", rf"(?i)ANSWER\s*:\s*([{span}])(?:[^A-Za-z0-9]|$)"]
    found = [F.when((m := F.regexp_extract(c, p, 1)) != "", F.upper(m)) for p in forms]
    lone = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?:^|[^A-Za-z])([{span}])(?=$|[^A-Za-z])"), F.lit(1)), F.lit(-1))
    return F.coalesce(*found, lone)


def without_reasoning(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def reasoning(c: Column) -> Column:
    """What stands in the first <think> block, or null."""
    m = F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)
    return F.when(F.regexp_like(c, F.lit(r"(?s)<think>.*?</think>")), stripped(m))


def tagged_answer(c: Column) -> Column:
    """<answer> tag, else the field ``answer`` of JSON, else the trimmed text."""
    tag = F.regexp_extract(c, r"(?is)<answer>(.*?)</answer>", 1)
    return F.coalesce(F.when(F.regexp_like(c, F.lit(r"(?is)<answer>.*?</answer>")), stripped(tag)), F.when(F.ltrim(c).startswith("{"), F.get_json_object(c, "$.answer")), stripped(c))


def qa_normalised(c: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks; in this order."""
    low = F.regexp_replace(F.lower(c), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"\b(a|an|the)\b", " "), r"\s+", " "))


def words(c: Column, by: str = "letters") -> Column:
    """Tokens in lower case; empty for null and ''.

    ``letters``: runs of letters and digits of any script, each Chinese character by itself; ``blanks``: what stands
    between blanks; ``characters``: each character that is no blank.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    if by == "characters":
        return F.filter(F.split(F.regexp_replace(low, r"\s+", ""), ""), lambda w: w != "")
    apart = F.split(low, r"\s+") if by == "blanks" else F.split(F.regexp_replace(low, "([㐀-鿿])", " $1 "), r"[^\p{L}\p{M}\p{N}]+")
    return F.filter(apart, lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row: a lambda's variable holds it, where the plain expression
    would be evaluated anew for each of its uses, and inside another lambda for each element."""
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; empty where there are fewer."""
    if n == 1:
        return tokens
    none = F.array().cast("array<string>")

    def runs(t: Column) -> Column:
        return F.when(F.size(t) < n, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))

    return once(tokens, runs)

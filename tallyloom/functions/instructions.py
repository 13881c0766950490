"""Instruction checkers as boolean expressions; each is strict, and ``loose`` accepts any of a text's usual rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import scoring, text


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def at_least_words(c: Column, n: int) -> Column:
    return F.size(text.words(c)) >= n


def at_most_words(c: Column, n: int) -> Column:
    return F.size(text.words(c)) <= n


def at_least_sentences(c: Column, n: int) -> Column:
    return _count(c, r"[.!?](?:\s|$)") >= n


def at_least_bullets(c: Column, n: int) -> Column:
    return _count(c, r"(?m)^\s*[-*] ") >= n


def exact_bullets(c: Column, n: int) -> Column:
    return _count(c, r"(?m)^\s*[-*] ") == n


def paragraphs(c: Column, n: int) -> Column:
    return F.size(F.filter(F.split(c, r"\n\s*\n"), lambda p: text.stripped(p) != "")) == n


def sections(c: Column, n: int, mark: str = "Section") -> Column:
    return _count(c, rf"(?m)^\s*{mark}\s+\d+") >= n


def placeholders(c: Column, n: int) -> Column:
    return _count(c, r"\[[^\[\]]+\]") >= n


def highlights(c: Column, n: int) -> Column:
    return _count(c, r"\*[^\n*]+\*") >= n


def has_keywords(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.lower(c), F.lit(w.lower()))
    return out


def without_keywords(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & ~F.regexp_like(F.lower(c), F.lit(rf"\b{w.lower()}\b"))
    return out


def keyword_times(c: Column, word: str, n: int) -> Column:
    return _count(F.lower(c), rf"\b{word.lower()}\b") >= n


def letter_times(c: Column, letter: str, n: int) -> Column:
    return _count(F.lower(c), letter.lower()) >= n


def lowercase(c: Column) -> Column:
    return c == F.lower(c)


def uppercase(c: Column) -> Column:
    return c == F.upper(c)


def capital_words(c: Column, n: int) -> Column:
    return _count(c, r"\b[A-Z]{2,}\b") >= n


def without(c: Column, mark: str) -> Column:
    return ~F.contains(c, F.lit(mark))


def is_json(c: Column) -> Column:
    """Well-formed JSON of an object or a list, fences aside not removed."""
    return F.coalesce(F.try_parse_json(c).isNotNull() & F.regexp_like(c, F.lit(r"(?s)^[\[{]")), F.lit(False))


def starts_with(c: Column, phrase: str) -> Column:
    return text.stripped(c).startswith(phrase)


def ends_with(c: Column, phrase: str) -> Column:
    return text.stripped(c).endswith(phrase)


def quoted(c: Column) -> Column:
    t = text.stripped(c)
    return t.startswith('"') & t.endswith('"') & (F.char_length(t) > 1)


def has_title(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"<<[^\n]+>>"))


def has_postscript(c: Column, mark: str = "P.S.") -> Column:
    return F.contains(F.upper(c), F.lit(mark.upper()))


def two_responses(c: Column, mark: str = r"\*{6}") -> Column:
    return F.size(F.filter(F.split(c, mark), lambda p: text.stripped(p) != "")) == 2


def repeats_prompt(c: Column, prompt: Column) -> Column:
    return F.lower(text.stripped(c)).startswith(F.lower(text.stripped(prompt)))


def loose(check: Callable[[Column], Column], c: Column) -> Column:
    """Whether the text, or one of its rewrites without its first line, its last line and asterisks, passes."""
    lines = F.split(c, "\n")
    n = F.size(lines)
    body = lambda a, b: F.array_join(F.slice(lines, a, F.greatest(b, F.lit(0))), "\n")
    forms = [c, body(2, n - 1), body(1, n - 1), body(2, n - 2)]
    forms += [F.replace(f, F.lit("*"), F.lit("")) for f in forms]
    out = F.lit(False)
    for f in forms:
        out = out | (F.coalesce(check(f), F.lit(False)) & (text.stripped(f) != ""))
    return out


def _compare(n: Column, limit: int, relation: str) -> Column:
    """``at least`` or ``less than`` a number, as instructions put it."""
    return n < limit if relation == "less than" else n >= limit


def nth_paragraph_starts(c: Column, total: int, n: int, word: str) -> Column:
    p = F.filter(F.split(c, r"\n\s*\n"), lambda x: text.stripped(x) != "")
    first = F.lower(F.regexp_extract(text.stripped(F.get(p, F.lit(n - 1))), r"^[\"']*([\w-]+)", 1))
    return (F.size(p) == total) & F.coalesce(first == word.lower(), F.lit(False))


def one_of(c: Column, options: list[str]) -> Column:
    out = F.lit(False)
    for o in options:
        out = out | F.contains(c, F.lit(o))
    return out


def unique_words(c: Column, n: int) -> Column:
    return F.size(F.array_distinct(text.words(c))) >= n


def word_range(c: Column, low: int, high: int) -> Column:
    return F.size(text.words(c)).between(low, high)


def number_count(c: Column, n: int) -> Column:
    return _count(c, r"\d+(?:\.\d+)?") == n


def conjunctions(c: Column, n: int) -> Column:
    """How many different coordinating conjunctions occur."""
    return F.size(F.array_distinct(F.filter(text.words(c), lambda w: w.isin("for", "and", "nor", "but", "or", "yet", "so")))) >= n


def pronouns(c: Column, n: int) -> Column:
    return F.size(F.filter(text.words(c), lambda w: w.isin(*"i me my mine you your yours he him his she her hers it its we us our ours they them their theirs".split()))) >= n


def palindromes(c: Column, n: int) -> Column:
    return F.size(F.filter(text.words(c), lambda w: (F.char_length(w) >= 5) & (w == F.reverse(w)))) >= n


def prime_lengths(c: Column) -> Column:
    return F.forall(text.words(c), lambda w: F.char_length(w).isin(2, 3, 5, 7, 11, 13, 17, 19, 23, 29))


def all_punctuation(c: Column, marks: str = ".,!?;:") -> Column:
    out = F.lit(True)
    for m in marks:
        out = out & F.contains(c, F.lit(m))
    return out


def no_consecutive_initials(c: Column) -> Column:
    w = text.words(c)
    first = F.transform(w, lambda x: F.substring(x, 1, 1))
    return ~F.exists(F.zip_with(F.slice(first, 1, F.greatest(F.size(first) - 1, F.lit(0))), F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)


def alphabet_initials(c: Column) -> Column:
    """Each word begins with the letter after the one before it, z followed by a."""
    code = F.transform(F.filter(text.words(c), lambda w: F.regexp_like(w, F.lit("^[a-z]"))), lambda w: F.ascii(w))
    n = F.greatest(F.size(code) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(code, 1, n), F.slice(code, 2, n), lambda a, b: F.pmod(b - a, F.lit(26)) == 1), lambda x: x)


def repeats_at_most(c: Column, n: int) -> Column:
    return scoring.once(text.words(c), lambda ws: F.forall(ws, lambda w: F.size(F.filter(ws, lambda x: x == w)) <= n))


def word_a_line(c: Column) -> Column:
    return F.forall(F.filter(F.split(text.stripped(c), "\n"), lambda x: x != ""), lambda x: ~F.regexp_like(text.stripped(x), F.lit(r"\s")))


def last_is_first(c: Column) -> Column:
    """Each sentence begins with the word that ended the one before it."""
    s = F.transform(F.filter(F.split(c, r"[.!?]+"), lambda x: text.stripped(x) != ""), lambda t: text.words(t))
    n = F.greatest(F.size(s) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.try_element_at(a, F.lit(-1)) == F.get(b, F.lit(0))), lambda x: F.coalesce(x, F.lit(False)))


def growing_sentences(c: Column, step: int) -> Column:
    n = F.transform(F.filter(F.split(c, r"[.!?]+"), lambda x: text.stripped(x) != ""), lambda x: F.size(text.words(x)))
    m = F.greatest(F.size(n) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(n, 1, m), F.slice(n, 2, m), lambda a, b: b - a == step), lambda x: x)


def stair_indent(c: Column) -> Column:
    d = F.transform(F.filter(F.split(c, "\n"), lambda x: text.stripped(x) != ""), lambda x: F.char_length(x) - F.char_length(F.ltrim(x)))
    n = F.greatest(F.size(d) - 1, F.lit(0))
    return F.forall(F.zip_with(F.slice(d, 1, n), F.slice(d, 2, n), lambda a, b: b > a), lambda x: x)


def sub_bullets(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"(?m)^\* [^\n]*\n(?:\s+- [^\n]*)"))


def marked_list(c: Column, mark: str) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.ltrim(x).startswith(mark))) >= 2


def keyword_in_sentence(c: Column, word: str, n: int) -> Column:
    s = F.filter(F.split(c, r"[.!?]+"), lambda x: text.stripped(x) != "")
    return F.coalesce(F.array_contains(text.words(F.get(s, F.lit(n - 1))), word.lower()), F.lit(False))


def word_at(c: Column, word: str, start: int, end: int) -> Column:
    """``word`` at place ``start`` from the beginning and ``end`` from the end."""
    w = text.words(c)
    return F.coalesce((F.get(w, F.lit(start - 1)) == word.lower()) & (F.try_element_at(w, F.lit(-end)) == word.lower()), F.lit(False))


def title_case(c: Column) -> Column:
    return F.forall(F.filter(F.split(c, r"\s+"), lambda w: F.regexp_like(w, F.lit("^[A-Za-z]{4,}"))), lambda w: F.regexp_like(w, F.lit("^[A-Z]")))


def no_whitespace(c: Column) -> Column:
    return ~F.regexp_like(text.stripped(c), F.lit(r"\s"))


def output_template(c: Column) -> Column:
    return F.contains(c, F.lit("My Answer:")) & F.contains(c, F.lit("My Conclusion:")) & F.contains(c, F.lit("Future Outlook:"))


def repeats(c: Column, phrase: str, times: int = 1) -> Column:
    return F.lower(text.stripped(c)) == F.lower(F.lit("\n".join([phrase] * times)))


def nested_brackets(c: Column, depth: int = 5) -> Column:
    """Brackets within brackets to at least a depth."""
    steps = F.transform(F.split(c, ""), lambda x: F.when(x.isin("(", "[", "{"), 1).when(x.isin(")", "]", "}"), -1).otherwise(0))
    deep = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")))
    return deep["most"] >= depth


def stop_word_share(c: Column, percent: float) -> Column:
    w = text.words(c)
    stops = F.filter(w, lambda x: x.isin(*"a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()))
    return F.coalesce(F.try_divide(F.size(stops) * 100.0, F.size(w)) <= percent, F.lit(True))


#: Checkers by instruction id; each takes the text and the instruction's own arguments.
CHECKERS: dict[str, Callable[..., Column]] = {
    "keywords:existence": has_keywords,
    "keywords:frequency": lambda c, keyword, frequency, relation="at least": _compare(_count(F.lower(c), rf"\b{keyword.lower()}\b"), frequency, relation),
    "keywords:forbidden_words": without_keywords,
    "keywords:letter_frequency": lambda c, letter, frequency, relation="at least": _compare(_count(F.lower(c), letter.lower()), frequency, relation),
    "length_constraints:number_sentences": lambda c, n, relation="at least": _compare(_count(c, r"[.!?](?:\s|$)"), n, relation),
    "length_constraints:number_paragraphs": lambda c, n: F.size(F.filter(F.split(c, r"\s?\*\*\*\s?"), lambda p: text.stripped(p) != "")) == n,
    "length_constraints:number_words": lambda c, n, relation="at least": _compare(F.size(text.words(c)), n, relation),
    "length_constraints:nth_paragraph_first_word": nth_paragraph_starts,
    "detectable_content:number_placeholders": placeholders,
    "detectable_content:postscript": has_postscript,
    "detectable_format:number_bullet_lists": exact_bullets,
    "detectable_format:constrained_response": one_of,
    "detectable_format:number_highlighted_sections": highlights,
    "detectable_format:multiple_sections": sections,
    "detectable_format:json_format": is_json,
    "detectable_format:title": has_title,
    "combination:two_responses": two_responses,
    "combination:repeat_prompt": repeats_prompt,
    "startend:end_checker": ends_with,
    "startend:quotation": quoted,
    "change_case:capital_word_frequency": lambda c, n, relation="at least": _compare(_count(c, r"\b[A-Z]{2,}\b"), n, relation),
    "change_case:english_capital": uppercase,
    "change_case:english_lowercase": lowercase,
    "punctuation:no_comma": lambda c: without(c, ","),
    "count:word_count_range": word_range,
    "count:unique_word_count": unique_words,
    "count:numbers": number_count,
    "count:conjunctions": conjunctions,
    "count:pronouns": pronouns,
    "count:punctuation": all_punctuation,
    "ratio:stop_words": stop_word_share,
    "words:alphabet": alphabet_initials,
    "words:palindrome": palindromes,
    "words:prime_lengths": prime_lengths,
    "words:repeats": repeats_at_most,
    "words:last_first": last_is_first,
    "words:no_consecutive": no_consecutive_initials,
    "words:words_position": word_at,
    "sentence:keyword": keyword_in_sentence,
    "sentence:increment": growing_sentences,
    "format:parentheses": nested_brackets,
    "format:options": one_of,
    "format:newline": word_a_line,
    "format:line_indent": stair_indent,
    "format:list": marked_list,
    "format:sub-bullets": sub_bullets,
    "format:title_case": title_case,
    "format:output_template": output_template,
    "format:no_whitespace": no_whitespace,
    "repeat:repeat_simple": repeats,
}

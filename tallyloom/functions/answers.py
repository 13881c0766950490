"""Answer extraction and comparison beyond what column expressions reach: Arrow functions, one batch at a time.

The native parts stay native: callers filter to the rows that need these first.
"""

from __future__ import annotations

import itertools
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and what is taken off an answer.
_NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_UNITS = re.compile(r"(?i)\s*(?:degrees?|cm|km|m|kg|g|mm|inch(?:es)?|feet|miles?|dollars?|cents?|percent|points?|units?|hours?|minutes?|seconds?|days?|years?)\.?$")


def boxed(t: str) -> str | None:
    """The content of the last \\boxed{...}, its braces matched; also \\boxed x. Null without one."""
    at = max(t.rfind("\\boxed"), t.rfind("\\fbox"))
    if at < 0:
        return None
    i = t.find("{", at)
    if i < 0 or t[at:i].strip() not in ("\\boxed", "\\fbox"):
        return (t[at:].split(None, 1)[1:] or [""])[0].split("$")[0].strip() or None
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j] == "{") - (t[j] == "}")
        if not depth:
            return t[i + 1 : j]
    return None


def extracted(t: str | None) -> str:
    """The answer that a solution states: boxed, after "answer is" or "ANSWER:", else its last number, else ''."""
    if not t:
        return ""
    if (b := boxed(t)) is not None:
        return normalised(b)
    for p in (r"(?is).*(?:final answer|the answer|answer)\s+is:?\s*\$?([^\n]*)", r"(?is).*answer\s*[:：]\s*([^\n]*)", r"(?s).*(?:答案是|答案为|答案[:：])\s*([^\n]*)"):
        if m := re.match(p, t):
            found = m.group(1).strip().rstrip(".。").strip("$ ")
            if found:
                return normalised(found)
    numbers = re.findall(r"-?\d[\d,]*(?:\.\d+)?", t)
    return normalised(numbers[-1]) if numbers else ""


def normalised(t: str) -> str:
    """An answer without typesetting: fractions as a/b, roots as sqrt(x), no units, signs of money, thousands' commas."""
    s = t.strip().replace("\n", "").rstrip(".")
    for old, new in (("\\!", ""), ("\\,", ""), ("\\ ", " "), ("\\$", ""), ("$", ""), ("\\%", ""), ("%", ""), ("\\left", ""), ("\\right", ""), ("dfrac", "frac"), ("tfrac", "frac"), ("^{\\circ}", ""), ("^\\circ", ""), ("\\cdot", "*"), ("\\times", "*"), ("−", "-")):
        s = s.replace(old, new)
    s = re.sub(r"\\(?:text|mbox|mathrm|textbf|mathbf)\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", lambda m: f"{_wrap(m[1])}/{_wrap(m[2])}", s)
    s = re.sub(r"\\frac\s*(\d)\s*(\d)", r"\1/\2", s)
    s = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", s)
    s = re.sub(r"\\sqrt\s*(\w)", r"sqrt(\1)", s)
    s = re.sub(r"^[a-zA-Z]\s*=\s*", "", s)
    s = _UNITS.sub("", s)
    s = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", s)
    s = _NUMBER_WORDS.get(s.lower().strip(), s)
    s = re.sub(r"(\d)\.0+(?!\d)", r"\1", s)
    return s.replace(" ", "")


def _wrap(t: str) -> str:
    return t if re.fullmatch(r"\w+", t.strip()) else f"({t})"


def _value(t: str) -> float | None:
    t = t.replace(",", "").rstrip("%").strip("()") if re.fullmatch(r"\(?-?[\d.,/%]+\)?", t) else t
    try:
        return float(t)
    except ValueError:
        pass
    if m := re.fullmatch(r"(-?\d+(?:\.\d+)?)/(-?\d+(?:\.\d+)?)", t):
        return float(m[1]) / float(m[2]) if float(m[2]) else None
    if m := re.fullmatch(r"(-?\d*(?:\.\d+)?)\*?sqrt\((\d+(?:\.\d+)?)\)", t):
        return (float(m[1]) if m[1] not in ("", "-") else float(m[1] + "1")) * float(m[2]) ** 0.5
    return None


def equal(a: str | None, b: str | None, tolerance: float = 1e-4) -> bool:
    """Whether two answers are the same: as text, as a choice, as numbers or percentages of each other, or part by part
    as tuples and intervals."""
    if a is None or b is None:
        return False
    if len(b.strip()) == 1 and b.strip() in "ABCDE":
        letters = re.findall(r"\b([A-E])\b", a.upper())
        return bool(letters) and letters[-1] == b.strip()
    a, b = normalised(a), normalised(b)
    if a.lower() == b.lower():
        return True
    x, y = _value(a), _value(b)
    if x is not None and y is not None:
        return any(abs(x - z) <= tolerance * max(1e-12, abs(z)) for z in (y, y / 100, y * 100))
    if re.fullmatch(r"[(\[{].*[)\]}]", a) and re.fullmatch(r"[(\[{].*[)\]}]", b):
        p, q = _split(a[1:-1]), _split(b[1:-1])
        return len(p) == len(q) > 1 and all(equal(i, j, tolerance) for i, j in zip(p, q, strict=True))
    if a.count("=") == b.count("=") == 1:
        return all(equal(i, j, tolerance) for i, j in zip(a.split("="), b.split("="), strict=True))
    return False


def _split(t: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(t):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(t[at:i])
            at = i + 1
    return [*out, t[at:]]


_AROUND = "".join(c for c in string.punctuation if c not in "-.")


def _number(w: str) -> str | None:
    """A number's one spelling, so that 7 is 7.0; None for what is no number."""
    try:
        return str(float(w))
    except ValueError:
        return None


def bag_f1(predicted: list[str], gold: list[str]) -> float:
    """The mean F1 of the best one-to-one matching of answer spans, by bags of words; numbers must agree. Rounded to 2."""
    def bag(s: str) -> set[str]:
        words = []
        for w in re.split(r"[\s-]+", s.lower()):
            number = _number(w.strip(_AROUND))
            words.append(number if number is not None else "".join(c for c in w if c not in string.punctuation))
        return {w for w in words if w and w not in ("a", "an", "the")}

    def f1(p: set[str], g: set[str]) -> float:
        numbers = {w for w in g if _number(w) is not None}
        if numbers and not numbers & p or not p or not g:
            return float(not p and not g)
        n = len(p & g)
        return 2 * n / (len(p) + len(g)) if n else 0.0

    ps, gs = [bag(s) for s in predicted], [bag(s) for s in gold]
    size = max(len(ps), len(gs))
    if not size:
        return 0.0
    score = [[f1(ps[i], gs[j]) if i < len(ps) and j < len(gs) else 0.0 for j in range(size)] for i in range(size)]
    return round(_assign(score) / size, 2)


def _assign(score: list[list[float]]) -> float:
    """The highest total of a one-to-one assignment (Hungarian method on negated scores)."""
    n = len(score)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            delta, j1 = float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = -score[match[j0] - 1][j - 1] - u[match[j0]] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(score[match[j] - 1][j - 1] for j in range(1, n + 1))


def entities(tags: list[str]) -> set[tuple[str, int, int]]:
    """(type, start, end) of the spans in BIO tags; an I without its B opens a span."""
    out, kind, start = set(), None, 0
    for i, t in enumerate([*tags, "O"]):
        name = t[2:] if t[:2] in ("B-", "I-") else None
        if kind is not None and (t[:2] == "B-" or name != kind):
            out.add((kind, start, i))
            kind = None
        if name is not None and kind is None:
            kind, start = name, i
    return out


def tags_of(tokens: list[str], marked: str) -> list[str]:
    """BIO tags of tokens from a text in which spans stand in tags such as <person>...</person>; spans that aren't in
    the tokens, in order, are left out."""
    tags, at = ["O"] * len(tokens), 0
    low = [t.lower() for t in tokens]
    for m in re.finditer(r"(?s)<(\w+)>(.*?)</\1>", marked or ""):
        words = m.group(2).lower().split()
        for i in itertools.chain(range(at, len(low) - len(words) + 1), range(0, min(at, max(0, len(low) - len(words) + 1)))):
            if words and low[i : i + len(words)] == words and all(t == "O" for t in tags[i : i + len(words)]):
                tags[i : i + len(words)] = [f"B-{m.group(1).upper()}"] + [f"I-{m.group(1).upper()}"] * (len(words) - 1)
                at = i + len(words)
                break
    return tags


#: What a transcript has in brackets, and what is neither letter, digit nor blank.
_ASIDES = r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)"
_SIGNS = r"[\p{M}\p{P}\p{S}]"


def plain(c: Column) -> Column:
    """A speech transcript to compare: compatibility forms in lower case, without asides in brackets; signs are blanks,
    and blanks are single. Only the compatibility forms need a function."""
    bare = F.regexp_replace(F.lower(_compatible(c)), _ASIDES, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, _SIGNS, " "), r"\s+", " "))


def greedy_distinct(vectors: list[list[float]], threshold: float = 0.6) -> list[int]:
    """The positions kept when each item in turn stays only if its cosine to all that stayed is below the threshold."""
    import numpy as np

    kept: list[int] = []
    m = np.array(vectors, dtype=float)
    if not len(m):
        return kept
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    for i in range(len(m)):
        if not kept or float((m[kept] @ m[i]).max()) < threshold:
            kept.append(i)
    return kept


# Words that don't tell ideas apart.
_EMPTY_WORDS = frozenset("a an the of for to and with in on at from by as into via using use used be is are was were this that these those your their our its".split())


def idea_words(t: str) -> list[str]:
    """The words that tell an idea apart: without marks and empty words, plurals as singulars."""
    bare = "".join(c for c in unicodedata.normalize("NFKC", t) if not unicodedata.combining(c)).lower()
    out = []
    for w in re.findall(r"[^\W_]+", bare):
        if w not in _EMPTY_WORDS:
            plural = w.endswith("s") and not w.endswith("ss") and len(w) > 3
            out.append(w[:-3] + "y" if w.endswith("ies") and len(w) > 4 else w[:-1] if plural else w)
    return out


def near_duplicate(a: str, b: str) -> bool:
    """Whether two short ideas are one: equal by idea_words(), 0.84 alike, three quarters of the words shared, one word
    added to at least two, or one's beginning that is four fifths of it. Ideas without words are like nothing."""
    import difflib

    x, y = idea_words(a), idea_words(b)
    if not x or not y:
        return False
    s, t = " ".join(x), " ".join(y)
    p, q = sorted((set(x), set(y)), key=len)
    short, long = sorted((s, t), key=len)
    shared = len(p & q) / len(p | q) >= 0.75
    qualified = p <= q and len(p) >= 2 and len(q) - len(p) <= 1
    begins = long.startswith(short) and len(short) >= 0.8 * len(long)
    return s == t or shared or qualified or begins or difflib.SequenceMatcher(None, s, t).ratio() >= 0.84


def new_ideas(ideas: list[str] | None, history: list[str] | None = None) -> list[str]:
    """The ideas, in order, that are no near_duplicate() of the history or of an idea kept before; blank ones go."""
    kept: list[str] = []
    for x in ideas or []:
        if x and x.strip() and not any(near_duplicate(x, y) for y in [*(history or []), *kept]):
            kept.append(x)
    return kept


def arrow(f: Callable, kind: str) -> Callable[..., Column]:
    """A Python function of one or two values as an Arrow function of columns; lists come as lists."""
    as_list = lambda v: list(v) if hasattr(v, "tolist") else v

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([f(as_list(x)) for x in b])

    def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([f(as_list(x), as_list(y)) for x, y in zip(a, b, strict=True)])

    return lambda *c: F.pandas_udf(one if len(c) == 1 else two, kind)(*c)


_compatible = arrow(lambda t: None if t is None else unicodedata.normalize("NFKC", t), "string")
extract_answer = arrow(extracted, "string")
math_equal = arrow(lambda a, b: float(equal(a, b)), "double")
drop_f1 = arrow(lambda p, g: bag_f1(p if p is not None else [], g if g is not None else []), "double")


def corpus_bleu(rows, prediction: Column, reference: Column, by: list[str], orders: int = 4):
    """(*by, bleu): corpus BLEU from sums of clipped and possible n-gram counts, 0 where an order has no match."""
    from tallyloom.functions import scoring, text

    base = rows.select(*by, text.words(prediction).alias("p"), text.words(reference).alias("r"))
    cols = []
    for n in range(1, orders + 1):
        cols.append(scoring._overlap(text.ngrams(F.col("p"), n), text.ngrams(F.col("r"), n))["n"].alias(f"m{n}"))
        cols.append(F.greatest(F.size("p") - n + 1, F.lit(0)).alias(f"t{n}"))
    sums = base.select(*by, F.size("p").alias("lp"), F.size("r").alias("lr"), *cols).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ["lp", "lr", *[f"{a}{n}" for n in range(1, orders + 1) for a in "mt"]]])
    logs = sum((F.log(F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}"))) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    brevity = F.when(F.col("lp") > F.col("lr"), 0.0).otherwise(1 - F.try_divide("lr", "lp"))
    return sums.select(*by, F.coalesce(F.exp(logs + brevity), F.lit(0.0)).alias("bleu"))



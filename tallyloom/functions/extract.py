"""Code, JSON, choices and tool calls out of answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import once, stripped

_FENCE = r"(?s)```([\w+#-]*)[ \t]*\r?\n(.*?)```"
_OPEN_FENCE = r"(?s)```[\w+#-]*[ \t]*\r?\n(.*)$"


def fenced_code(c: Column, language: str | None = None) -> Column:
    """The code of the first fenced block (of a language, where one is given and has a block), else of a block that is
    never closed, without blanks at its end; null where there is no fence."""
    tags, bodies = F.regexp_extract_all(c, F.lit(_FENCE), F.lit(1)), F.regexp_extract_all(c, F.lit(_FENCE), F.lit(2))

    def pick(x: Column) -> Column:
        first = F.get(x["bodies"], F.lit(0))
        if language is None:
            return first
        at = F.array_position(F.transform(x["tags"], lambda t: F.lower(t)), language.lower())
        return F.coalesce(F.when(at > 0, F.get(x["bodies"], (at - 1).cast("int"))), first)

    closed = once(F.struct(tags.alias("tags"), bodies.alias("bodies")), pick)
    unclosed = F.when(F.regexp_like(c, F.lit(_OPEN_FENCE)), F.regexp_extract(c, _OPEN_FENCE, 1))
    return F.regexp_replace(F.coalesce(closed, unclosed), r"\s+$", "")


def lenient_json(c: Column) -> Column:
    """The JSON object or list in an answer, as text: all of it, a fenced block, an <answer> tag, or from the first brace
    to the last; the first of these that parses, else null."""
    candidates = [
        stripped(c), F.when(F.regexp_like(c, F.lit(_FENCE)), stripped(F.regexp_extract(c, _FENCE, 2))), F.when(F.regexp_like(c, F.lit(r"(?is)<answer>.*?</answer>")), stripped(F.regexp_extract(c, r"(?is)<answer>(.*?)</answer>", 1))),
        F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")),
    ]
    return F.coalesce(*[F.when(F.regexp_like(x, F.lit(r"^\s*[\[{]")) & F.try_parse_json(x).isNotNull(), x) for x in candidates])


def chosen_letters_zh(c: Column, options: int = 4) -> Column:
    """The letters after 答案：, as a sorted array without repeats; empty where one of them is no option, null without the mark."""
    said = F.regexp_extract(c, r"答案\s*[:：]\s*([A-Za-z0-9,，]+)", 1)
    letters = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(said, "[,，]", ""), ""), lambda x: x != "")))
    allowed = F.array(*[F.lit(chr(65 + i)) for i in range(options)])
    return F.when(said != "", F.when(F.size(F.array_except(letters, allowed)) == 0, letters).otherwise(F.array().cast("array<string>")))


def shuffled_choices(choices: Column, target: Column, key: Column, seed: int = 42) -> Column:
    """struct<choices, target>: the choices in an order that depends on ``key`` and ``seed`` only, and the 0-based place
    where the choice at the 0-based ``target`` now stands; null where there is no such choice."""
    ranked = F.transform(choices, lambda x, i: F.struct(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)), i.cast("string"))).alias("r"), i.alias("i"), x.alias("x")))

    def remap(s: Column) -> Column:
        at = F.array_position(F.transform(s, lambda e: e["i"]), target.cast("int"))
        return F.struct(F.transform(s, lambda e: e["x"]).alias("choices"), F.when(at > 0, (at - 1).cast("int")).alias("target"))

    return once(F.array_sort(ranked), remap)


def tool_call_scores(predicted: Column, expected: Column, tools: Column) -> Column:
    """struct<plan_em, action_em, f1, hallucinated> of two calls, each struct<plan, action, arguments map>.

    An argument counts 1 where name and value agree and a half where only the name does; F1 is of these points by the
    arguments of either side, 1 where neither call has any, and 0 for another action. A call is hallucinated where its
    action is none of ``tools``. A missing plan, action or argument map agrees with a missing one only.
    """
    none = F.create_map().cast("map<string,string>")

    def score(x: Column) -> Column:
        same = x["p"]["action"].eqNullSafe(x["e"]["action"])
        a, b = F.coalesce(x["p"]["arguments"], none), F.coalesce(x["e"]["arguments"], none)
        points = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.when(~F.map_contains_key(b, k), 0.0).when(F.element_at(a, k).eqNullSafe(F.element_at(b, k)), 1.0).otherwise(0.5))
        f1 = F.when(~same, 0.0).when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2 * points / (F.size(a) + F.size(b)))
        plan = x["p"]["plan"].eqNullSafe(x["e"]["plan"])
        unknown = x["p"]["action"].isNotNull() & ~F.coalesce(F.array_contains(x["t"], x["p"]["action"]), F.lit(False))
        return F.struct(plan.cast("double").alias("plan_em"), same.cast("double").alias("action_em"), f1.alias("f1"), unknown.cast("double").alias("hallucinated"))

    return once(F.struct(predicted.alias("p"), expected.alias("e"), tools.alias("t")), score)


def call_fits(arguments: Column, schema: dict[str, tuple[str, bool]]) -> Column:
    """Whether a JSON object of arguments fits ``schema``, which has a type (string, number, boolean, object or array) and
    whether it is required by name; other names don't fit. False for what is no object."""
    json = F.try_parse_json(arguments)
    kinds = {"string": "STRING", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
    names = F.json_object_keys(arguments)
    ok = F.coalesce(F.size(F.array_except(names, F.array(*map(F.lit, schema)))) == 0, F.lit(False))
    for name, (kind, required) in schema.items():
        is_a = F.regexp_like(F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant")), F.lit(f"^(?:{kinds[kind]})$"))
        ok = ok & F.when(F.array_contains(names, name), F.coalesce(is_a, F.lit(False))).otherwise(F.lit(not required))
    return F.coalesce(F.when(F.ltrim(arguments).startswith("{") & json.isNotNull(), ok), F.lit(False))


def keyword_overlap(answer: Column, keywords: Column) -> Column:
    """The share of the keywords that stand in the answer, in any case; 0 without keywords or answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.filter(keywords, lambda k: F.contains(low, F.lower(k)))
    return F.coalesce(F.try_divide(F.size(found), F.size(keywords)), F.lit(0.0))


def read_input(c: Column) -> Column:
    """A record's input; an error where it is null or ''."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.raise_error(F.lit("a record without input"))).otherwise(c)


def read_target(c: Column) -> Column:
    """A record's target as a list of texts; null is one ''."""
    return F.array(F.coalesce(c.cast("string"), F.lit("")))

"""Texts cut off by field limits or in transfer.

Method: every message's length is computed anew under alternative encodings (code points, UTF-8 and UTF-16, entity
and JSON escapes, CRLF line ends). Grouped by each, lengths at which texts stop unfinished far more often than elsewhere
expose the hidden limits of what stored them; grouped by output tokens they expose the models' own. Then the endings are
inspected. How a text ends, whether it stands at a limit, and its stop reason and output tokens are evidence of
different weight: a label model (labelmodel.py) learns the weights from all texts and gives each the probability of
having been cut. A text that ends whole is no case, whatever its length and stop reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import endings, labelmodel
from tallyloom.session import durable

#: Stop reasons that name a limit; the others but these two say that the model came to its end.
_AT_LENGTH = ("length", "max_tokens", "model_length")
_SAYS_NOTHING = ("", "unknown")

#: Expected rates of the evidence in texts cut at a limit, cut in transfer, and whole; see evidence() for the letters.
_ENDS = {"c": 0.0005, "p": 0.001, "q": 0.01, "k": 0.0005, "n": 0.002, "s": 0.001, "u": 0.1, "y": 0.0001, "e": 0.05, "o": 0.45, "b": 0.3, "m": 0.05}
_STOPS = {"L": 0.002, "l": 0.005, "t": 0.01, "s": 0.983}
_AT_A_LIMIT = [_ENDS, {"1": 0.8, "0": 0.2}, {"L": 0.25, "l": 0.15, "t": 0.1, "s": 0.5}]
_IN_TRANSFER = [_ENDS, {"1": 0.03, "0": 0.97}, _STOPS]
_WHOLE = [{"c": 0.92, "p": 0.03, "q": 0.002, "k": 0.03, "n": 0.001, "s": 0.0005, "u": 0.0002, "y": 0.005, "e": 0.0001, "o": 0.0001, "b": 0.0001, "m": 0.00002}, {"1": 0.03, "0": 0.97}, _STOPS]

MEASURES = ("chars", "utf8", "utf16", "html", "json", "json_ascii", "crlf", "text_chars", "text_utf8")

#: A plain text that surely ends with a sentence needs no closer look: no list of parts, no JSON, code or tags,
#: no mark of a cut, no ellipsis, no bare list number at its end.
_PLAIN = r"""(?s)^(?!\s*[\[{])(?!.*(?:```|~~~|<(?:think|answer|result|final|output|response|reasoning)))(?=.*[^\W\d_]{2}).*[^.\n…\s][.!?。！？]["'”’»]*\s*$"""
_BARE_NUMBER = r"(?:^|\n)\s*\d{1,3}[.)]\s*$"


def lengths(c: Column) -> Column:
    """A text's length by measure: map-like struct of the first seven of MEASURES."""
    n, utf8 = F.char_length(c), F.octet_length(c)
    count = lambda s: F.char_length(c) - F.char_length(F.replace(c, F.lit(s), F.lit("")))
    quotes, lines = count('"'), count("\n")
    ascii_only = utf8 == n
    astral = F.when(ascii_only, 0).otherwise(n - F.char_length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "")))
    beyond = F.when(ascii_only, 0).otherwise(n - F.char_length(F.regexp_replace(c, r"[^\x00-\x7F]", "")))
    json = n + quotes + lines + count("\\")
    return F.struct(
        n.alias("chars"), utf8.alias("utf8"), (n + astral).alias("utf16"), (n + quotes * 5 + count("&") * 4 + count("<") * 3 + count(">") * 3).alias("html"),
        json.alias("json"), (json + beyond * 5 + astral * 6).alias("json_ascii"), (n + lines).alias("crlf"),
    )


def _inspect(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in contents:
        rows = []
        for content in batch:
            text, _ = endings.parts(content)
            code, key, items = endings.ending(text)
            rows.append((code, key, items, len(text), len(text.encode("utf-8", "replace"))))
        yield pd.DataFrame(rows, columns=["code", "key", "items", "text_chars", "text_utf8"])


def surely_whole(c: Column) -> Column:
    return c.rlike(_PLAIN) & ~c.rlike(_BARE_NUMBER)


def inspected(predictions: DataFrame) -> DataFrame:
    """(rec_id, msg_pos, role, model, run_dir, stop_reason, output_tokens, h, last, len, code, key, items, text_chars,
    text_utf8) of the messages of role user and assistant that have a content. Positions count null messages.

    ``h`` tells different texts apart, ``last`` is the last word. A message's stop reason is that of the choice with its
    id; messages that are no choice have neither stop reason nor tokens.
    """
    m = predictions.select(
        "rec_id", "run_dir", F.col("model_output.model").alias("model"), F.col("model_output.choices").alias("choices"), F.col("model_output.usage.output_tokens").alias("tokens"),
        F.posexplode_outer(F.arrays_zip(F.col("messages.id").alias("id"), F.col("messages.role").alias("role"), F.col("messages.content").alias("content"))).alias("msg_pos", "m"),
    ).filter("m.role in ('user', 'assistant') and m.content is not null and m.content <> ''")
    mine = F.get(F.filter("choices", lambda c: c["message"]["id"] == F.col("m.id")), F.lit(0))
    word = F.regexp_replace(F.lower(F.substring_index(F.rtrim("m.content"), " ", -1)), r"[^\p{L}\p{N}]+", "")
    m = m.select("rec_id", "msg_pos", "run_dir", "model", F.col("m.role").alias("role"), F.col("m.content").alias("content"), "tokens", word.alias("last"), mine.alias("c"))
    m = m.select("*", F.col("c.stop_reason").alias("stop_reason"), F.when(F.col("c").isNotNull(), F.col("tokens")).alias("output_tokens"), F.xxhash64("content").alias("h"))
    keep = ["rec_id", "msg_pos", "run_dir", "model", "role", "stop_reason", "output_tokens", "h", "last"]
    m = m.withColumn("whole", surely_whole(F.col("content")))
    empty = F.array().cast("array<string>")
    plain = m.filter("whole").select(*keep, lengths(F.col("content")).alias("len"), F.lit(endings.COMPLETE).alias("code"), F.lit("").alias("key"), empty.alias("items"), F.char_length("content").alias("text_chars"), F.octet_length("content").alias("text_utf8"))
    closer = m.filter("not whole").select(*keep, lengths(F.col("content")).alias("len"), F.pandas_udf(_inspect, "code int, key string, items array<string>, text_chars int, text_utf8 int")("content").alias("x")).select(*keep, "len", "x.*")
    return plain.unionByName(closer)


def _is_open() -> Column:
    return F.col("code").isin(endings.CUT, endings.ITEM, endings.ELLIPSIS)


def _measured(seen: DataFrame, *keep: str | Column) -> DataFrame:
    """(*keep, measure, length): a row for each measure of text that ``seen`` has."""
    whole = [(m, F.col(f"len.{m}")) for m in MEASURES[:-2]] if "len" in seen.columns else []
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("bigint").alias("length")) for m, c in [*whole, ("text_chars", F.col("text_chars")), ("text_utf8", F.col("text_utf8"))]]))
    return seen.select(*keep, each.alias("v")).select(*keep, "v.*")


def hidden_limits(seen: DataFrame, share: float = 0.5, chance: float = 0.01) -> DataFrame:
    """(measure, length, n, n_open): lengths at which ``share`` of the different texts stop unfinished, and so many more
    than at other lengths that the ratio of likelihoods excludes ``chance``, allowing for all lengths tried.

    ``output_tokens`` is one of the measures, of different pairs of text and tokens. Copies of a text count once.
    """
    unfinished = F.max(_is_open().cast("int")).alias("o")
    sizes = [c for c in ("len", "text_chars", "text_utf8") if c in seen.columns]
    by = _measured(seen.groupBy("h").agg(*[F.first(c).alias(c) for c in sizes], unfinished), "o")
    if "output_tokens" in seen.columns:
        by = by.unionByName(seen.filter("output_tokens is not null").groupBy("h", "output_tokens").agg(unfinished).select("o", F.lit("output_tokens").alias("measure"), F.col("output_tokens").alias("length")))
    by = by.groupBy("measure", "length").agg(F.count("*").alias("n"), F.sum("o").alias("n_open"))
    whole = by.groupBy("measure").agg(F.sum("n").alias("_n"), F.sum("n_open").alias("_o"), F.count("*").alias("_tried"))  # a row a measure
    q, base = F.col("n_open") / F.col("n"), (F.col("_o") - F.col("n_open") + 0.5) / (F.col("_n") - F.col("n") + 1)
    some = lambda n, a, b: F.when(n > 0, n * F.ln(a / b)).otherwise(0.0)
    ratio = some(F.col("n_open"), q, base) + some(F.col("n") - F.col("n_open"), 1 - q, 1 - base)
    tried = F.ln(F.col("_tried") * len(MEASURES) / chance)
    return by.join(F.broadcast(whole), "measure").filter((q >= share) & (q > base) & (ratio >= tried)).select("measure", "length", "n", "n_open")


def at_limit(seen: DataFrame, ids: list[str], limits: DataFrame) -> DataFrame:
    """(*ids, at_limit=true): the texts that don't end with a sentence whose length by some measure is a hidden limit."""
    doubtful = seen.filter(_is_open() | (F.col("key") != ""))
    return _measured(doubtful, *ids).join(limits.select("measure", "length"), ["measure", "length"], "left_semi").select(*ids).distinct().withColumn("at_limit", F.lit(True))


def _halves(c: str, first: str, second: str) -> list[Column]:
    return [F.substring_index(c, "\x01", 1).alias(first), F.substring_index(c, "\x01", -1).alias(second)]


def evidence(seen: DataFrame, ids: list[str], keep: list[str], corpus: DataFrame | None = None, rare: float = 0.05) -> DataFrame:
    """(*ids, *keep, h, ending, limit, stop): what speaks for and against a cut, a letter each. Empty texts don't come out.

    ``ending``: c a whole sentence or block; p, q a phrase whose last word other texts end with or not; of an
    unpunctuated last list item, asked of the items inside lists: k its kind (its first words) has its last words; n its kind
    hasn't, and often has new ones; s its kind hasn't, and less than ``rare`` of its items have words of their own; u no item
    has them; y, e an ellipsis after words that different texts have before theirs or not; m a mark of a cut; b an open
    code or JSON block, tag or number; o an open line. ``limit``: 1 at a hidden limit, 0 not, - a whole sentence.
    ``stop``: L a stop reason of length and tokens at a limit; l only the reason; t only the tokens; s another reason; -
    nothing said. Rates rather than counts decide, so a table's size doesn't change what they say. ``seen`` must
    be written already, as it is read several times; ``corpus`` (``seen``) is what is asked.
    """
    corpus = seen if corpus is None else corpus
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    limits = durable(hidden_limits(corpus), "limits")
    stop = F.lit("-")
    if "output_tokens" in seen.columns:
        most = limits.filter("measure = 'output_tokens'").select(F.col("length").alias("output_tokens"), F.lit(True).alias("_most"))
        seen = seen.join(most, "output_tokens", "left")
        said, full = F.lower(F.trim(F.coalesce("stop_reason", F.lit("")))), F.coalesce("_most", F.lit(False))
        stop = F.when(said.isin(*_AT_LENGTH), F.when(full, "L").otherwise("l")).when(full, "t").when(said.isin(*_SAYS_NOTHING), "-").otherwise("s")
    own = [*ids, *keep, "h", stop.alias("stop")]
    done = lambda df, letter: df.select(*ids, *keep, "h", "stop", letter.alias("ending"))

    lists = corpus.filter(F.size("items") > 0).groupBy("h").agg(F.first("items").alias("items")).select(F.explode("items").alias("k")).select(*_halves("k", "head", "tail"))
    both = lists.groupBy("head", "tail").agg(F.count("*").alias("n_both"))
    heads = both.groupBy("head").agg((F.sum(F.when(F.col("n_both") == 1, 1).otherwise(0)) / F.sum("n_both")).alias("new"))
    tails = both.groupBy("tail").agg(F.sum("n_both").alias("n_tail"))
    ask = seen.filter(F.col("code") == endings.ITEM).select(*own, *_halves("key", "head", "tail"))
    asked = ask.join(tails, "tail", "left").join(heads, "head", "left").join(both, ["head", "tail"], "left")
    items = done(asked, F.when(zero("n_both") > 0, "k").when(zero("n_tail") == 0, "u").when(F.coalesce("new", F.lit(1.0)) < rare, "s").otherwise("n"))

    texts = corpus.filter(F.col("code") == endings.ELLIPSIS).select(*_halves("key", "end", "text")).distinct()
    total = texts.agg(F.count("*").alias("_all"))  # one row
    others, trials = F.col("n") - 1, F.greatest(F.col("_all") - 1, F.lit(1))
    rate, z2 = others / trials, 3.84
    least = (rate + z2 / (2 * trials) - F.sqrt(z2 * (rate * (1 - rate) / trials + z2 / (4 * trials * trials)))) / (1 + z2 / trials)  # the share of the other texts with that end, at the low side of 95 %
    style = texts.groupBy("end").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter((others > 0) & (least >= 0.02)).select("end", F.lit(True).alias("style"))
    dots = seen.filter(F.col("code") == endings.ELLIPSIS).select(*own, F.substring_index("key", "\x01", 1).alias("end"))
    dotted = done(dots.join(style, "end", "left"), F.when(F.col("style"), "y").otherwise("e"))

    known = corpus.filter((F.col("code") == endings.COMPLETE) & (F.col("key") == "") & (F.col("last") != "")).select("last").distinct().withColumn("_known", F.lit(True))
    phrases = seen.filter((F.col("code") == endings.COMPLETE) & (F.col("key") != "")).select(*own, F.substring_index("key", "\x01", -1).alias("last_word"))
    phrased = done(phrases.join(known.withColumnRenamed("last", "last_word"), "last_word", "left"), F.when(F.col("_known") | (F.char_length("last_word") < 2) | F.col("last_word").rlike("[0-9]"), "p").otherwise("q"))

    sure = seen.filter((F.col("code") == endings.CUT) | ((F.col("code") == endings.COMPLETE) & (F.col("key") == "")))
    rest = done(sure.select(*own, "code", "key"), F.when(F.col("code") == endings.COMPLETE, "c").otherwise(F.substring("key", 1, 1)))
    every = rest.unionByName(items).unionByName(dotted).unionByName(phrased)
    return every.join(at_limit(seen, ids, limits), ids, "left").withColumn("limit", F.when(F.col("ending") == "c", "-").when(F.col("at_limit"), "1").otherwise("0")).drop("at_limit")


def settle(seen: DataFrame, ids: list[str], keep: list[str]) -> DataFrame:
    """(*ids, *keep, ending, limit, stop, probability, is_cut) of every text that isn't empty, decided by all evidence.

    The weights are learnt by the label model from the counts of the patterns, at most 180. See evidence().
    """
    voted = durable(evidence(seen, ids, keep), "evidence")
    pattern = F.concat("ending", "limit", "stop")
    different = voted.select("h", pattern.alias("p")).distinct()  # copies of a text say nothing more
    counts = {r["p"]: r["n"] for r in different.groupBy("p").agg(F.count("*").alias("n")).collect()}
    posterior = labelmodel.fit(counts, _AT_A_LIMIT, _WHOLE, also=[_IN_TRANSFER], anchor=[None, 0.02, 0.02])  # what endings mean is given, what limits and stops are worth is learnt
    # as few rows as there are patterns, so safe to broadcast
    weighed = seen.sparkSession.createDataFrame(sorted(posterior.items()), "_p string, probability double")
    return voted.withColumn("_p", pattern).join(F.broadcast(weighed), "_p").drop("_p", "h").withColumn("is_cut", F.col("probability") >= 0.5)


def cut_messages(predictions: DataFrame) -> DataFrame:
    """(rec_id, msg_pos, role, model, run_dir, stop_reason, output_tokens, ending, limit, stop, probability, is_cut) of
    every message with a text.

    Cut: a word, sentence, list, quotation, tag, code or JSON block stays open at the end, a mark of a cut aside.
    Null, empty and bare placeholder texts are no cases, nor are texts that end whole, whatever their stop reason
    and length. Records stored twice count under each of their ids.
    """
    seen = durable(inspected(predictions), "endings")
    return settle(seen, ["rec_id", "msg_pos"], ["role", "model", "run_dir", "stop_reason", "output_tokens"])


def cut_rates(messages: DataFrame, by: str) -> DataFrame:
    """(by, n_records, n_cut, cut_share, n_length_stops): records with a cut message, among the records with a text."""
    stopped = F.lower(F.trim(F.coalesce("stop_reason", F.lit("")))).isin(*_AT_LENGTH)
    rec = messages.groupBy(by, "rec_id").agg(F.max(F.col("is_cut").cast("int")).alias("c"), F.max(stopped.cast("int")).alias("s"))
    return rec.groupBy(by).agg(F.count("*").alias("n_records"), F.sum("c").alias("n_cut"), F.avg("c").alias("cut_share"), F.sum("s").alias("n_length_stops"))

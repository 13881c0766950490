"""Broken prompt and response pairs.

Method: for each defect several noisy labelling functions vote, each on evidence of its own and abstaining where it has
none, and an expectation-maximization label model (see labelmodel.py) turns their votes into posteriors. A pair keeps
every defect whose posterior exceeds that defect's cutoff, validated on defects planted in every sound pair; where one label
is wanted, the likeliest counts.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import endings, labelmodel, truncation
from tallyloom.session import durable

DEFECTS = ("empty", "copied_input", "refusal", "truncated", "other_language")

#: Expected rates at which each function votes 1 with and without the defect; see votes() for the functions.
_RATES = {
    "empty": ([0.6, 0.9, 0.95, 0.8], [0.0005, 0.002, 0.002, 0.2]),
    "copied_input": ([0.7, 0.95, 0.95, 0.95, 0.95, 0.95], [0.0005, 0.004, 0.02, 0.02, 0.1, 0.05]),
    "refusal": ([0.6, 0.6, 0.6, 0.97, 0.9, 0.9, 0.95], [0.01, 0.02, 0.02, 0.01, 0.3, 0.02, 0.02]),
    "other_language": ([0.95, 0.9, 0.95, 0.9, 0.02], [0.01, 0.02, 0.01, 0.03, 0.6]),
}
#: Of truncated: the ending's letter and the limit's by truncation.evidence(), a last line without a stop, odd delimiters.
_CUT = ([truncation._ENDS, {"1": 0.5, "0": 0.5}, 0.9, 0.3], [truncation._WHOLE[0], {"1": 0.03, "0": 0.97}, 0.08, 0.005])

# Frequent words of the languages, and how a prompt asks for one of them.
_STOP = {
    "en": "the of and to is it with this that for each in at an how would what when from without was on by could can one only so not but its which they are be or as my your i you we he she".split(),
    "es": "el la las los de que y en un una con por para del sin al se cómo qué no porque solo sería muy más nadie quien hasta desde mi su es lo como pero".split(),
    "de": "der die das den dem des und ist mit ein eine einen einem einer zu von auf im wird für nicht man dass damit kann am beim wie nur auch zum als wer wenn es ich sich aus bei".split(),
    "fr": "le la les de des et un une est dans pour avec que du au aux qui plus il sur ne par sans même d l on où si serait je ce cette pas".split(),
}
_LANGUAGE_NAMES = {
    "en": "english|inglés|ingles|anglais|englisch|英文|英语",
    "es": "spanish|español|espanol|castellano|espagnol|spanisch|西班牙语|西班牙文",
    "de": "german|alemán|aleman|allemand|deutsch|德语|德文",
    "fr": "french|francés|frances|français|francais|französisch|法语|法文",
    "zh": "chinese|chino|chinois|chinesisch|mandarin|中文|汉语|漢語",
}
_ANY = "|".join(_LANGUAGE_NAMES.values())
_SOME = rf"(?:{_ANY})(?:\s*(?:,|/|、|\b(?:and|or|y|e|o|u|und|oder|et|ou)\b|和|或)\s*(?:{_ANY}))*"
_ASKS = re.compile(rf"(?i)(?:\b(?:in|into|en|auf|ins|to|au)\s+{_SOME}|(?:用|以|译成|翻译成)\s*{_SOME}|{_SOME}\s*(?:translation|version|回答))")

# How the languages negate ability or will, decline outright, give norms as a reason, speak of the
# conversation itself, and are courteous. Each list is a function's own evidence; none is a phrase of any text.
_UNABLE = re.compile(
    r"(?i)\b(?:can(?:no|['’]?)t|can not|could(?: not|n['’]t)|won['’]t|will not|wouldn['’]t|would not|must not|may not|do(?: not|n['’]t)|(?:am|are|is|be) (?:not|un)\s?(?:able|willing|permitted|allowed|possible|going)|not (?:able|willing|permitted|allowed|possible)|unable|unwilling|isn['’]t|aren['’]t|not something|(?:not|nothing) (?:an? |the )?(?:\w+ )?(?:that |which )?(?:i|we) (?:can|could|may|will|would|am|are))\b"
    r"|\bno (?:puedo|podemos|podré|daré|debo|quiero|voy|se puede|(?:me |nos )?es posible|responder[éá]|escribir[éá]|estoy en condiciones)"
    r"|\b(?:ne|n['’])\s?(?:peux|puis|pourrai|souhaite|vais|veux|dois|suis|peut|donnerai|y \w+|\w+rai)\b"
    r"|\b(?:kann|könnte|möchte|werde|darf|will|können|dürfen|möglich|gebe)\b(?:[^.!?]*\b)?(?:nicht|keine?n?|leider)\b|\b(?:nicht|keine?)\b[^.!?]*\b(?:möglich|können|dürfen|werden|geben)\b"
    r"|无法|不能|不可以|没办法|帮不了|不会|不愿|不便|不可能"
)
_DECLINES = re.compile(
    r"(?i)\b(?:declin(?:e|es|ed|ing)|refus(?:e|es|ed|ing|al)|reject(?:ed)?|abstain|(?:will|have to|must|to) (?:pass|skip)|(?:would|['’]d) (?:rather|prefer) not|not (?:produce|continue|comply|discuss|engage|go there))\b"
    r"|\b(?:declin(?:o|ar|amos)|rech(?:azo|azar|azada)|(?:prefiero|preferimos) no|tener que pasar|negarme|me niego|abstener\w*)\b"
    r"|\b(?:refus(?:er|e|ons|ée?)|décline\w*|préfère ne|(?:je|dois|vais) passer?|m['’]abstien\w*|donne\w* pas suite)\b"
    r"|\b(?:ablehnen|lehne|verweiger\w*|verzichte\w*|tabu|absagen|äußern)\b"
    r"|拒绝|婉拒|选择不|不回答|不作答|谢绝|恕"
)
_NORMS = re.compile(
    r"(?i)\b(?:guidelines?|polic(?:y|ies)|rules?|principles|permit(?:ted)?|allowed|appropriate|inappropriate|harmful|unsafe|sensitive|comfortable|outside|beyond|scope|against|not something|material of (?:this|that) kind|off limits)\b"
    r"|\b(?:normas?|reglas|políticas?|directrices|principios|apropiad[oa]s?|adecuad[oa]s?|fuera de|en contra|dañin[oa]|sensible)\b"
    r"|\b(?:règles|politiques?|directives|principes|convenable|appropriée?s?|contraire|cadre|hors de|sensible)\b"
    r"|\b(?:richtlinien|regeln|grundsätze\w*|angebracht|angemessen|verstößt|gegen meine|außerhalb|heikel|tabu)\b"
    r"|超出|范围|违反|规定|政策|准则|不合适|不当|敏感|不便|有害"
)
_TALK = re.compile(
    r"(?i)\b(?:help|assist(?:ance)?|requests?|requested|questions?|topics?|subject|answer(?:ing)?|reply|respond|response|respon\w+|provide|content|material|task|write|discuss|support|this one|with that|(?:this|that|do|for) (?:here|kind))\b"
    r"|\b(?:ayud\w+|petici[oó]n|solicitud|pregunt\w+|tema|respuesta|responder\w*|escribir\w*|tarea|esto|eso)\b"
    r"|\b(?:aid\w+|demande|question|sujet|répon\w+|réponse|suite|écrire|tâche|point)\b"
    r"|\b(?:helfen|hilfe|anfrage|frage|thema|antwort\w*|beantworten|bearbeiten|aufgabe|schreiben|dazu|dabei|weiterhelfen)\b"
    r"|请求|问题|话题|回答|帮助|协助|任务|内容|提问|要求|主题"
)
_COURTESY = re.compile(
    r"(?i)^\W*(?:hello|hi|hey|dear|sorry|apologies|unfortunately|i (?:apologi[sz]e|understand|appreciate|hope)|i['’]?m (?:very |so )?(?:sorry|afraid)|thank(?:s| you)|let me know|please|feel free|as an? (?:ai|assistant|language)|while i|regrettably|(?:is there|if you|you (?:may|can|could))\b"
    r"|hola|gracias|por favor|lo (?:siento|lamento)|lamento|perd[oó]n|disculp\w+|desafortunadamente|como (?:asistente|modelo)|si (?:quieres|deseas|necesitas)"
    r"|bonjour|merci|désolée?|pardon|malheureusement|en tant qu|n['’]hésitez|hallo|danke|bitte|leider|tut mir|es tut mir leid|entschuldigung|als (?:assistent|ki)"
    r"|你好|您好|谢谢|感谢|抱歉|对不起|很遗憾|请|如果您?还|作为)"
)
#: Every phrase of the three lists above has one of these; a text is searched for all of them at once, and only the
#: sentences that have one are held against the lists.
_HINTS = ahocorasick.Automaton()
for _hint in (
    "cant", "n't", "n’t", "not", "unable", "unwilling", "no puedo", "no podemos", "no podré", "no daré", "no debo", "no quiero", "no voy", "no se puede", "no me es", "no nos es", "no es posible", "no respond", "no escrib", "no estoy", "ne ", "ne\n", "nep", "n'", "n’", "nicht", "kein", "leider",
    "declin", "refus", "reject", "abst", "abstien", "pass", "skip", "rechaz", "prefiero no", "preferimos no", "negarme", "niego", "décline", "préfère ne", "donne", "ablehn", "lehne", "verweiger", "verzicht", "tabu", "absagen", "äußern",
    "guideline", "polic", "rule", "principle", "permit", "allowed", "appropriate", "harmful", "unsafe", "sensitive", "comfortable", "outside", "beyond", "scope", "against", "material of", "off limits", "norma", "regla", "política", "politica", "directric", "principio", "apropiad", "adecuad", "fuera de", "en contra", "dañin",
    "sensible", "règle", "politique", "directive", "principe", "convenable", "appropri", "contraire", "cadre", "hors de", "richtlinie", "regeln", "grundsätz", "angebracht", "angemessen", "verstößt", "gegen meine", "außerhalb", "heikel",
    "无法", "不能", "不可", "没办法", "帮不了", "不会", "不愿", "不便", "拒", "选择不", "不回答", "不作答", "谢绝", "恕", "超出", "范围", "违反", "规定", "政策", "准则", "不合适", "不当", "敏感", "有害",
):
    _HINTS.add_word(_hint, True)
_HINTS.make_automaton()
_BREAK = re.compile(r"[.!?。！？][\"'”’)\]]*(?:\s+|(?=[一-鿿]))|\n+")  # from a sentence's stop on
_LISTED = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+\S")
_ROLE = re.compile(r"(?i)^\W*(?:user|human|prompt|question|input|instruction|usuario|utilisateur|benutzer|用户)\W*[:：]\W*|^[#*\s]*(?:user|human|prompt)[#*\s]*\n")
_CJK = re.compile(r"[㐀-鿿]")


def body(prediction: str | None) -> str:
    """A prediction's answer: the text of its parts, without thoughts."""
    text, _ = endings.parts(prediction)
    closed = endings.without_thoughts(text)
    return closed.strip("​﻿ \t\r\n")


_LABELS = re.compile(r"(?i)\b(?:final|answer|response|output|result|solution|antwort|respuesta|réponse|boxed|none|null|nan|n/?a|invalid|empty)\b|答案|回答")
_TAGS = re.compile(r"</?[a-zA-Z]+/?>|```[\w-]*|\\[a-z]+")
_ALNUM = re.compile(r"[^\W_]")
_NOT_ALNUM = re.compile(r"[\W_]+")
_UNITS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_CHOICE = re.compile(r"[A-Z0-9一-鿿]")


def _without_role(t: str) -> str:
    m = _ROLE.match(t)
    return t[m.end() :] if m else t


def prose(t: str) -> str:
    """What has a language: without code, JSON, tags and numbers."""
    if "```" in t:
        t = re.sub(r"(?s)```.*?(?:```|$)", " ", t)
    if t.lstrip()[:1] in ("[", "{"):
        t = " ".join(re.findall(r'"((?:[^"\\]|\\.)*)"', t)) if re.search(r'"[^"]*\s[^"]*\s[^"]*\s[^"]*"', t) else " "
    return _MARKUP.sub(" ", t) if "<" in t or "\\" in t or "://" in t else t


_MARKUP = re.compile(r"<[^<>]{1,30}>|\\boxed\{[^}]*\}|https?://\S+")
_LETTERS = {c: k for k, cs in (("es", "ñ¿¡áíó"), ("de", "äöüß"), ("fr", "èêàçùîôœ’")) for c in cs}
_MARKED = re.compile(f"[{''.join(_LETTERS)}]")


class Languages:
    """What three functions say of a text's language: stop words, letters, and naive Bayes over words.

    ``counts`` has the number of labelled prompts with a word by (language, word); without any the last abstains.
    """

    def __init__(self, counts: dict[tuple[str, str], int]) -> None:
        self.order = list(_STOP)
        by: dict[str, list[int]] = {}
        for (k, w), n in counts.items():
            if k in _STOP:
                by.setdefault(w, [0] * len(self.order))[self.order.index(k)] += n
        total = [sum(c[i] for c in by.values()) for i in range(len(self.order))]
        stops: dict[str, list[int]] = {}
        for i, k in enumerate(self.order):
            for w in _STOP[k]:
                stops.setdefault(w, []).append(i)
        self.stops = {w: tuple(x) for w, x in stops.items()}  # the languages it is a stop word of
        self.odds: dict[str, tuple[int, float]] = {}  # the likeliest language, how much likelier
        for w, seen in by.items():
            logs = [math.log((n + 0.1) / (t + 0.1 * len(by))) if t else -math.inf for n, t in zip(seen, total, strict=True)]
            first, second = sorted(logs, reverse=True)[:2]
            if second > -math.inf and first > second:
                self.odds[w] = (logs.index(first), first - second)

    def __call__(self, low: str, words: list[str]) -> tuple[str | None, str | None, str | None]:
        """Of a text in lower case and its words."""
        if not low.isascii() and (cjk := len(_CJK.findall(low))) >= 2 and cjk * 3 > len(re.findall(r"[a-zà-ÿ]", low)):
            return "zh", "zh", "zh"
        hits, odds = [0] * 4, [0.0] * 4
        for stops in filter(None, map(self.stops.get, words)):
            for i in stops:
                hits[i] += 1
        known = [*filter(None, map(self.odds.get, words))]
        for likely, odd in known:
            odds[likely] += odd
        first, second = sorted(hits, reverse=True)[:2]
        by_stops = self.order[hits.index(first)] if first >= 2 and first > second else None
        marks = Counter(_LETTERS[c] for c in _MARKED.findall(low)) if not low.isascii() else {}
        by_letters = "en" if not marks and low.count("th") >= 2 else None  # a pair of letters that the others hardly have
        if marks:
            k, n = marks.most_common(1)[0]
            by_letters = k if n >= 2 and sum(marks.values()) - n < n else None
        return by_stops, by_letters, self.order[odds.index(max(odds))] if len(known) >= 3 else None


_NAMES = ahocorasick.Automaton()
for _name in _ANY.split("|"):
    _NAMES.add_word(_name, True)
_NAMES.make_automaton()


def asked_languages(prompt: str) -> set[str]:
    low = prompt.lower()
    if next(_NAMES.iter(low), None) is None:
        return set()
    asked = " ".join(m.group().lower() for m in _ASKS.finditer(prompt))
    return {k for k, names in _LANGUAGE_NAMES.items() if any(n in asked for n in names.split("|"))}


def _vote(x: bool | None) -> str:
    return "-" if x is None else "1" if x else "0"


def _between(x: float, low: float, high: float) -> str:
    """1 from ``high`` on, 0 up to ``low``; between them nothing is said."""
    return "1" if x >= high else "0" if x <= low else "-"


def _copied(pw: list[str], aw: list[str], wanted: dict[str, int]) -> str:
    """The votes on whether the answer's words are the prompt's, which ``wanted`` counts."""
    if not pw or not aw:
        return "------"
    if pw == aw:
        return "111111"
    p, a = "".join(pw), "".join(aw)
    times, over = divmod(len(a), len(p))
    same = times >= 1 and not over and a == p * times
    shared, left, open_ = 0, len(aw), dict(wanted)
    for w in filter(open_.get, aw):
        open_[w] -= 1
        shared += 1
    whole = max(1, round(left / len(pw)))
    new = left - whole * shared  # no fewer than that
    if whole > 1 and 1 - new / left > 0.7:
        new = left - sum(min(n, wanted.get(w, 0) * whole) for w, n in Counter(aw).items())
    if 2 * shared < 0.8 * (len(pw) + len(aw)):  # the ratio can't be higher
        order = "0" if times < 2 else "-"
        run = None
    else:
        blocks = difflib.SequenceMatcher(None, pw, aw, autojunk=False).get_matching_blocks()
        order = _between(2 * sum(b.size for b in blocks) / (len(pw) + len(aw)), 0.8, 0.87)
        run = max((y.b - x.b - x.size for x, y in zip(blocks, blocks[1:], strict=False)), default=0)
        run = max(run, blocks[0].b)
    size = left / len(pw)
    near = abs(size - round(size)) <= 0.06 * max(1, round(size)) and size >= 0.9
    return _vote(same) + order + _between(shared / len(pw), 0.6, 0.8) + _between(1 - new / left, 0.7, 0.92) + _vote(near if not 0.8 < size < 1.25 else True) + ("-" if run is None else _between(-run, -4, -2))


def _refused(low: str) -> str:
    """The votes on whether the answer, in lower case, declines; see votes()."""
    at = [end for end, _ in _HINTS.iter(low)]
    unable = declines = norms = useful = total = 0
    other = first = False  # whether the sentence at hand has something else to say, and whether the first one declines or is courteous
    late = None  # that sentence, where nobody has asked yet
    start = 0
    for m in [*_BREAK.finditer(low), None]:
        begin, end = start, len(low) if m is None else m.start() + (low[m.start()] != "\n")
        start, s = m.end() if m else end, low[begin:end]
        if not s or s.isspace():
            continue
        total += 1
        i = bisect.bisect_left(at, begin)
        if i == len(at) or at[i] >= end:  # nothing of the lists: it is courteous or of use
            late = s if useful and total > 1 else None
            if late is None:
                c = bool(_COURTESY.match(s))
                first = c if total == 1 else first
                other = not (c and len(s) <= 120 and not _LISTED.match(s))
                useful += other
            elif i == len(at) and total > 8 and not (unable or declines or norms):
                break  # what follows changes no vote
            continue
        late = None
        u, d, n = bool(_UNABLE.search(s)), bool(_DECLINES.search(s)), bool(_NORMS.search(s))
        talk = (u or n) and bool(_TALK.search(s))
        c = bool(_COURTESY.match(s))
        if total == 1:
            first = u or d or n or c
        if not u and _LISTED.match(s):
            useful, other = useful + 1, True
            continue
        unable += u and talk
        declines += d
        norms += n and (talk or u or d)
        other = not ((u and (talk or n)) or d or (n and talk) or (c and len(s) <= 120))
        useful += other
    if not total:
        return "-------"
    if late is not None:
        other = not (len(late) <= 120 and _COURTESY.match(late) and not _LISTED.match(late))
    said = unable + declines + norms
    return (
        _vote(unable > 0) + _vote(declines > 0) + _vote(norms > 0) + _vote(not useful) + ("1" if total <= 3 else "-" if total <= 8 or not useful else "0")
        + _between(said / total, 0.15, 0.4) + _vote(bool(said) and first and not other)
    )


class Asked:
    """What the votes need of a prompt, whatever the answer."""

    def __init__(self, prompt: str, languages: Languages) -> None:
        self.own = own = _without_role(prompt).lower()
        self.words = _UNITS.findall(own)
        self.counts = Counter(self.words)
        self.named = asked_languages(prompt)
        self.spoken = languages(own, self.words)
        self.known = {w for w in self.words if len(w) >= 4 or w >= "㐀"}


def _spoken(own: str, words: list[str], languages: Languages) -> tuple[str | None, str | None, str | None]:
    text = prose(own)
    return languages(text, words if text is own else _UNITS.findall(text))


def _emptiness(answer: str, extracted: str | None) -> str:
    bare = _TAGS.sub("", answer) if "<" in answer or "`" in answer or "\\" in answer else answer
    visible = bool(_ALNUM.search(bare))
    placeholder = endings.is_empty(answer)
    short = len(answer) < 40 and len(rest := _NOT_ALNUM.sub("", _LABELS.sub("", bare))) < 2 and not _CHOICE.fullmatch(rest)
    return _vote(not visible) + _vote(placeholder) + _vote(short) + _vote(extracted is None or extracted.strip() in ("", "[invalid]"))


def _differs(asked: Asked, mine: tuple[str | None, str | None, str | None], words: list[str], stated: str | None) -> str:
    """The votes on whether an answer's languages and words aren't the prompt's."""
    differs = ["0" if x in asked.named else "-" if x is None or y is None else _vote(x != y) for x, y in zip(mine, asked.spoken, strict=True)]
    best = mine[2] or mine[0]
    against = "0" if best in asked.named else "-" if stated not in _LANGUAGE_NAMES or best is None else _vote(stated != best)
    return "".join(differs) + against + ("-" if len(words) < 6 or len(asked.known) < 3 else _vote(len(asked.known.intersection(words)) >= 2))


def votes(prompt: str, prediction: str | None, extracted: str | None, stated: str | None, languages: Languages) -> dict[str, str]:
    """The pattern of each defect but truncated, whose functions need the corpus.

    empty: no letter or digit outside tags; nothing but placeholders and labels by endings.is_empty; fewer than two
    letters or digits beside labels, and no lone choice; extraction failed.
    copied_input: the prompt's letters, once or repeated; its words in order; how many of its words are there; how many
    words are not the prompt's; a length of the prompt's once or more times; no long run of words of its own.
    refusal: a sentence negates ability or will and speaks of the request; one declines outright; one names norms; none
    has anything else to say; few sentences; the share of such sentences; the first one is of these or courteous, and the
    last has nothing else to say.
    other_language: stop words; letters; the word model; the record's stated language against the answer's; words that
    answer and prompt share. An answer in a language that the prompt asks for doesn't differ.
    Each function abstains where it has nothing to go by, as all do on a defect that needs an answer where there is none.
    """
    return looked_at(Asked(prompt, languages), prediction, extracted, stated, languages)[0]


def looked_at(asked: Asked, prediction: str | None, extracted: str | None, stated: str | None, languages: Languages) -> tuple[dict[str, str], tuple[str | None, str | None, str | None], list[str]]:
    """The votes(), and the answer's languages and words."""
    answer = body(prediction)
    empty = _emptiness(answer, extracted)
    if "1" in empty[:2]:
        return {"empty": empty, "copied_input": "------", "refusal": "-------", "other_language": "-----"}, (None, None, None), []
    own = _without_role(answer).lower()
    words = _UNITS.findall(own)
    mine = _spoken(own, words, languages)
    return {"empty": empty, "copied_input": _copied(asked.words, words, asked.counts), "refusal": _refused(own), "other_language": _differs(asked, mine, words, stated)}, mine, words


def _stated(metadata: str | None) -> str | None:
    try:
        v = json.loads(metadata) if metadata else None
        return v.get("lang") if isinstance(v, dict) else None
    except ValueError:
        return None


# What is planted to validate the cutoffs.
_BLANKS = ("", " ", "\n\t", "N/A", "null", "None", "<answer></answer>", "Answer:", "{}", "```\n```", "\\boxed{}", "...")
_REFUSALS = {
    "en": ("I am afraid this is not a request I can help with.", "My rules do not allow an answer to this question.", "I have to refuse; such content would be harmful.", "Apologies, I am unable to respond to that topic.", "I would prefer not to discuss this subject."),
    "es": ("Me temo que no puedo responder a esta pregunta.", "Debo rechazar esta solicitud, pues mis reglas no la permiten.", "Perdón, no voy a escribir sobre ese tema."),
    "de": ("Diese Frage kann ich leider nicht beantworten.", "Ich lehne diese Anfrage ab, denn meine Regeln erlauben keine Antwort.", "Entschuldigung, zu diesem Thema darf ich nichts schreiben und keine Hilfe geben."),
    "fr": ("Je ne peux pas répondre à cette question.", "Je refuse cette demande, contraire à mes règles.", "Pardon, je ne vais pas écrire sur ce sujet."),
    "zh": ("很遗憾,我无法回答这个问题。", "我拒绝这个请求,因为它违反规定。", "对不起,这个话题我不能讨论。"),
}


_COPIES = (
    str.upper, str.lower, lambda t: f'"{t}"', lambda t: f"{t}\n{t}", lambda t: " ".join((w := t.split(" "))[:-2] + w[-1:]), lambda t: f"> {t}", lambda t: t,
)
_INSIDE = re.compile(r"(?<=[^\W\d_])[^\W\d_]")


@functools.cache
def _fixed(defect: str, text: str) -> str:
    """The votes on a planted text that is the same for all pairs."""
    empty = _emptiness(body(text), None if defect == "empty" else text)
    return empty if defect == "empty" else "-------" if "1" in empty[:2] else _refused(_without_role(body(text)).lower())


def planted(key: int, prompt: str, answer: str, asked: Asked, foreign: tuple[tuple[str | None, str | None, str | None], list[str]] | None, language: str | None, stated: str | None) -> tuple[dict[str, str], str | None]:
    """The votes on a sound pair's answer with each defect but truncated planted, and the truncated answer; which form
    of a defect, the key says. ``foreign`` has the languages and words of an answer in another language."""
    n = xxhash.xxh32_intdigest(str(key))
    said = _REFUSALS.get(language or "en", _REFUSALS["en"])
    out = {"empty": _fixed("empty", _BLANKS[n % len(_BLANKS)]), "refusal": _fixed("refusal", said[n % len(said)])}
    copy = body(text := _COPIES[n % len(_COPIES)](_without_role(prompt)))
    own = _without_role(copy).lower()
    words = asked.words if own == asked.own else _UNITS.findall(own)
    out["copied_input"] = "------" if "1" in _emptiness(copy, text)[:2] else _copied(asked.words, words, asked.counts)
    if foreign:
        out["other_language"] = _differs(asked, *foreign, stated)
    begin, end = len(answer) // 3, len(answer) - 1
    inside = (_INSIDE.search(answer, begin + n % (end - begin), end) or _INSIDE.search(answer, begin, end)) if end > begin else None
    return out, answer[: inside.start()] if inside and inside.start() else None


_FIELDS = ("review_id bigint, plant string, h bigint, last string, empty string, copied_input string, refusal string, other_language string, no_stop string, unbalanced string, "
           "code int, key string, items array<string>, text_chars int, text_utf8 int, n int")  # fmt: skip


def word_counts(slim: DataFrame) -> dict[tuple[str, str], int]:
    """How many of the prompts with a stated language have a word, by (language, word).

    All prompts count, on the executors; words of one prompt only say nothing and are left out. What reaches the driver
    is the vocabulary of the languages that have stop words.
    """
    stated = slim.filter("metadata is not null and input is not null").select("input", F.lower(F.get_json_object("metadata", "$.lang")).alias("lang")).filter(F.col("lang").isin(*_STOP))
    words = stated.select("lang", F.explode(F.array_distinct(F.split(F.lower("input"), r"[^\p{L}]+"))).alias("word")).filter("word <> ''")
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n")).filter("n > 1")
    return {(r["lang"], r["word"]): r["n"] for r in counted.collect()}


def inspected(reviews: DataFrame) -> DataFrame:
    """The votes and endings of every pair, and those of the same pairs with planted defects (``plant`` names the defect).

    The word model is fitted on all prompts whose metadata states a language. Every defect is planted in every sound pair,
    another language only where the answer's is plain and one in another was read before it. Planted pairs of the same votes and ending are one row, ``n`` says of how many; their ids tell the rows apart only.
    """
    score = F.col("sample_score.score")
    slim = reviews.select("review_id", "input", score.getField("prediction").alias("prediction"), score.getField("extracted_prediction").alias("extracted"), F.col("sample_score.sample_metadata").alias("metadata"))
    send = reviews.sparkSession.sparkContext.broadcast(Languages(word_counts(slim)))
    columns = [f.split(" ")[0] for f in _FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 7, pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.int32()] * 3]

    def ended(text: str, gone: bool) -> tuple[str, str, int, str, list[str], int, int]:
        """no_stop, unbalanced, code, key, items, text_chars, text_utf8."""
        code, key, items = (endings.EMPTY, "", []) if gone else endings.ending(text)
        answer = text.rstrip()
        line = answer[answer.rfind("\n") + 1 :]
        odd = answer.count("```") % 2 or answer.count("{") != answer.count("}") or answer.count("[") != answer.count("]") or answer.count('"') % 2
        paired = bool(odd) if odd or "`" in answer or "{" in answer or "[" in answer or '"' in answer else None
        return _vote(not endings._sentence_end(line)), _vote(paired), code, key, items, len(text), len(text) if text.isascii() else len(text.encode("utf-8", "replace"))

    def last_word(text: str) -> str:
        answer = text.rstrip()
        for part in reversed(answer[answer.rfind("\n") + 1 :].split()):  # no word spans a blank
            if word := endings.words(part, 1, True):
                return word
        return ""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, context = send.value, TaskContext.get()
        seen: dict[str, tuple] = {}  # the languages and words of the last longer answer in each language
        made: Counter[tuple] = Counter()
        names = (context.partitionId() << 33) if context else 0

        def counted() -> pa.RecordBatch:
            nonlocal names
            rows = []
            for (d, vote, *rest), n in made.items():
                names += 1
                own = [vote if d == x else None for x in ("empty", "copied_input", "refusal", "other_language")]
                no_stop, unbalanced, code, key, chars, utf8 = rest or (None, None, endings.EMPTY, "", 0, 0)
                rows.append((names, d, None, None, *own, no_stop, unbalanced, code, key, [], chars, utf8, n))
            made.clear()
            return packed(rows)

        for b in batches:
            rows = []
            for i, prompt, prediction, extracted, metadata in zip(*[c.to_pylist() for c in b.columns], strict=True):
                prompt, stated = prompt or "", _stated(metadata)
                asked = Asked(prompt, languages)
                v, mine, words = looked_at(asked, prediction, extracted, stated, languages)
                text = endings.parts(prediction)[0]
                end = ended(text, v["empty"][1] == "1")
                h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63
                rows.append((i, None, h, last_word(text), v["empty"], v["copied_input"], v["refusal"], v["other_language"], *end, 1))
                if prediction and prompt and end[2:4] == (endings.COMPLETE, "") and "1" not in v["empty"][:3] + v["copied_input"][0] + v["refusal"][:3] + v["other_language"][:4]:
                    answer, language = body(prediction), mine[0]
                    foreign = next((x for k, x in seen.items() if k != language), None) if language else None
                    plants, cut = planted(i, prompt, answer, asked, foreign, language, stated)
                    made.update(plants.items())
                    if cut:
                        no_stop, unbalanced, code, key, _, *sizes = ended(endings.parts(cut)[0], "</" in cut and endings.is_empty(body(cut)))
                        made["truncated", None, no_stop, unbalanced, code, key, *sizes] += 1
                    if language and len(answer) >= 40:
                        seen = {language: (mine, words)} | {k: x for k, x in seen.items() if k != language}
            yield packed(rows)
            if len(made) > 50_000:
                yield counted()
        yield counted()

    return slim.mapInArrow(look, _FIELDS)


def patterns(reviews: DataFrame) -> DataFrame:
    """(review_id, plant, n, defect, pattern): every pair's votes for every defect, and the votes on ``n`` planted pairs for
    their own; of truncated the corpus's endings have their say."""
    seen = durable(inspected(reviews), "pairs")
    own = ["n", "empty", "copied_input", "refusal", "other_language", "no_stop", "unbalanced"]
    voted = F.col("plant").isNotNull() & (F.col("plant") != "truncated")  # these have no ending
    found = truncation.evidence(seen.filter(~voted), ["review_id", "plant"], own, seen.filter("plant is null"))
    # a stop is expected of sentences only; a length that is no limit tells nothing
    whole = F.concat("ending", F.when(F.col("limit") == "1", "1").otherwise("-"), F.when(F.col("ending").isin("c", "o", "b"), F.col("no_stop")).otherwise("-"), "unbalanced")
    said = found.select("review_id", "plant", *own, whole.alias("truncated"))
    none = seen.filter(voted | (F.col("code") == endings.EMPTY)).select("review_id", "plant", *own, F.lit("----").alias("truncated"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS]))
    return said.unionByName(none).select("review_id", "plant", "n", each.alias("x")).select("review_id", "plant", "n", "x.*").filter("plant is null or plant = defect")


def defects(reviews: DataFrame) -> DataFrame:
    """(review_id, defect, posterior, cutoff, pattern): every defect of every pair whose posterior passes its cutoff.

    A pair may have several. Null predictions are empty; null inputs can't be copied or answered in another
    language. Reviews stored twice count under each of their ids. An empty table gives no rows.
    """
    voted = durable(patterns(reviews), "votes")
    counts: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    plants: dict[str, dict[str, int]] = {d: {} for d in DEFECTS}
    for r in voted.groupBy(F.col("plant").isNotNull().alias("made"), "defect", "pattern").agg(F.sum("n").alias("n")).collect():  # at most 3^k patterns for a defect's k functions
        (plants if r["made"] else counts)[r["defect"]][r["pattern"]] = r["n"]
    rows = []
    for d, c in counts.items():
        model = labelmodel.estimate(c, *_CUT, anchor=[None, 0.02, 0.02, 0.02]) if d == "truncated" else labelmodel.estimate(c, *_RATES[d])
        at = labelmodel.validated_cutoff(c, model, plants[d])
        rows += [(d, p, float(x), float(at)) for p, x in model.posterior.items() if x >= at]
    # as few rows as there are patterns, so safe to broadcast
    chosen = reviews.sparkSession.createDataFrame(rows, "defect string, pattern string, posterior double, cutoff double")
    return voted.filter("plant is null").join(F.broadcast(chosen), ["defect", "pattern"]).select("review_id", "defect", "posterior", "cutoff", "pattern")


def main_defect(found: DataFrame) -> DataFrame:
    """(review_id, defect): the likeliest defect of each pair; of equal ones (to two digits) the first in DEFECTS."""
    rank = F.create_map(*[x for i, d in enumerate(DEFECTS) for x in (F.lit(d), F.lit(-i))])
    best = F.max(F.struct(F.round("posterior", 2).alias("p"), F.element_at(rank, F.col("defect")).alias("r"), "defect"))
    return found.groupBy("review_id").agg(best.alias("b")).select("review_id", F.col("b.defect").alias("defect"))

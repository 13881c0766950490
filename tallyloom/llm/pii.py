"""Personal information inside free text, found by weak supervision and replaced by typed placeholders.

Method: pattern labelers, context labelers and gazetteer labelers vote on candidate spans. Expectation-maximization
(labelmodel.py) estimates their reliabilities from the agreement of their votes and gives each candidate a
probability, and a final span classifier is trained on it that also sees the span's shape and neighbouring words.
The gazetteers of given names and surnames aren't given: they are what the texts themselves name in places where only
a name can stand, counted over all documents. Cues are general words of the languages; which other words stand by an item,
the classifier learns.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import labelmodel
from tallyloom.session import durable

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

#: Expected rates of the labelers' votes for and against; see candidates() for what each of them is.
_RATES = {
    "EMAIL": ([0.97, 0.95, 0.9], [0.1, 0.1, 0.2]),
    "PHONE": ([0.95, 0.8, 0.98, 0.9], [0.2, 0.03, 0.4, 0.1]),
    "ID_NUMBER": ([0.95, 0.85, 0.98, 0.9], [0.15, 0.02, 0.4, 0.1]),
    "ADDRESS": ([0.97, 0.9, 0.98, 0.7], [0.2, 0.1, 0.3, 0.05]),
    "NAME": ([0.6, 0.93, 0.93, 0.97, 0.5, 0.3, 0.8], [0.02, 0.03, 0.03, 0.5, 0.02, 0.005, 0.4]),
}

_DIMS = 2**12

# ---- fixed values: shapes of the types and words that stand by them -------------------------------------------
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9À-ÿ_.+%-])[A-Za-z0-9À-ÿ_.+%-]*[A-Za-z0-9À-ÿ_](?:[ ]?(?:[@＠]|\(at\)|\[at\]|\{at\})[ ]?| at (?=[\w-]+ dot ))(?:[\w-]*[^\W\d][\w-]*(?:\.|[ ]?(?:\[dot\]|\(dot\)|\{dot\})[ ]?| dot ))+[A-Za-z]{2,}\b(?![@＠])", re.I
)
_EMAIL_DOTTED = re.compile(r"(?:\.|\[dot\]|\(dot\)|\sdot\s)\s?[A-Za-z]{2,}$", re.I)
_NUMBERS = re.compile(r"(?<![A-Za-z0-9_@./#+＋(（-])(?<!\d[,:])(?:[+＋]\s?\d|[(（]\s?\d|\d)(?:\d|[ \t.\-/()（）]{1,2}(?=[\d(（)）]))*\d(?![A-Za-z0-9_@]|[.:]\d)")
_PHONES = [re.compile(p) for p in (
    r"(?:\+?1[ .-]?)?(?:\(\d{3}\)\s?|\d{3}[ .-])\d{3}[ .-]\d{4}", r"\+1\d{10}", r"\d{3}-\d{4}", r"\+44\s?(?:\(0\)\s?)?\d{2,4}[ ]?\d{3,4}[ ]?\d{3,4}", r"\+44\d{10}", r"0\d{2,4} \d{3,4} \d{3,4}", r"07\d{3} ?\d{6}", r"0\d{10}",
    r"(?:\+34|0034)\s?\d{3}\s?\d{3}\s?\d{3}", r"\d{3} \d{3} \d{3}", r"(?:\+33|0033)\s?\(?0?\)?\s?\d(?:[ .]?\d{2}){4}", r"0\d(?:[ .]?\d{2}){4}", r"0\d{3} \d{2} \d{4}", r"(?:(?:\+49|0049)\s?\(?0?\)?\s?\d{2,4}|\(0\d{2,4}\)|0\d{2,4})[ /-]?\d{3,8}(?:[ -]\d{1,5})?",
    r"(?:\+86|0086)[ -]?1\d{2}[ -]?\d{4}[ -]?\d{4}", r"1\d{2}[ -]?\d{4}[ -]?\d{4}", r"[（(]0\d{2,3}[）)]\s?\d{4} ?\d{3,4}", r"0\d{2,3}-\d{7,8}", r"\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){2,3}",
)]
_IDS = re.compile(
    r"(?<![A-Za-z0-9_@.+＋(（-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]\d{7,8}|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]|[A-Z]\d[A-Z]\d{2}[A-Z]\d{2}[A-Z]|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}[A-Z]?\d?|[A-Z]\d[A-Z0-9]{6}[A-Z0-9]|\d{17}[\dXx]|\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{9}|\d{2} \d{3} \d{3} \d{3}|\d{11}|[1-9] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![A-Za-z0-9_@]|[.:-]\d)"
)
_SURE_ID = re.compile(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|\d{17}[\dXx]|[XYZ]-?\d{7}-?[A-Z]|\d{3}-\d{2}-\d{4}|[1-9] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[1-9]\d{14}|\d{8}-?[A-Z]|[A-Z]\d{8}|[A-Z]\d[A-Z]\d{2}[A-Z]\d{2}[A-Z]|[A-Z](?=[A-Z0-9]*[A-Z])\d[A-Z0-9]{7}")
_PHONE_CUE = re.compile(r"(?i)(?:phone|tel|tél|fax|mobile|cell|call(?:back)?|ring|dial|text me|whatsapp|reach me|contact|teléfono|móvil|llama|encuentras|joindre|appel|erreichbar|anruf|ruf|mobil|rufnummer|电话|手机|拨|打|联系)[^\n]{0,24}$")
_ID_CUE = re.compile(r"(?i)(?:\bSSN|social security|passport|\bID\b|identity|insurance|licen[cs]e|permit|tax|(?<!phone )\bnumber (?:is|was|as)|dni|nie|documento|número de|pièce|sécu|numéro de|ausweis|steuer|versicherung|证件|身份证|护照|号码)[^\n]{0,26}$")
_NOT_PERSON = re.compile(r"(?i)(?:\b(?:seed|hash|key|job|build|ticket|checkpoint|batch(?:es)?(?: of)?|sample|candidate|version|run|log|retries|row|table|chapter|section|page|port|step|order|semilla|graine|startwert|protokoll|journal|registro|lote|lot|lauf)|种子|批次|日志|版本|第)[^\w\n]{0,3}[\w-]{0,12}[^\w\n]{0,2}$")
_COUNTED = re.compile(r"(?i)-\d|[a-z]|\s?(?:errors?|tokens?|rows?|items?|samples?|times|requests?|errores|filas|erreurs|lignes|fehler|zeilen|次|个|行)\b")
_CITY = r"[A-ZÀ-Ý][\w'’-]+(?:[ -](?:[a-zà-ÿ]{1,3}[ -])?[A-ZÀ-Ý][\w'’-]+){0,2}"
_SEP = r"(?:[ \t]*,[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*)"
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Way|Close|Place|Pl|Terrace|Crescent|Square|Sq|Boulevard|Blvd|Gardens|Grove|Row|Walk|Parade|Mews)"
_NEXT = r"(?=\s*(?:[,.;)\n]|$)|\s+[A-ZÀ-Ý][\wà-ÿ]* [a-zà-ÿ\d])"
_POSTCODE = r"(?:\d{4,5}(?!\d)|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b)"
_TAIL_EN = rf"(?:{_SEP}{_CITY}(?:(?:(?:,? |{_SEP})[A-Z]{{2}})?(?: |{_SEP}){_POSTCODE}|{_NEXT}))?"
_ADDRESSES = [re.compile(p) for p in (
    rf"(?:(?:Flat|Apartment|Apt|Unit|Suite)\.? \d+\w?{_SEP})?(?<![\w.:-])\d{{1,5}}[A-Z]? (?:[NSEW]\.? )?(?:[A-Z][\w'’-]+ ){{1,3}}{_STREET}\b\.?(?:{_SEP}(?:Apt|Apartment|Unit|Suite|Flat|#)\.? ?\w+)?{_TAIL_EN}",
    rf"(?i:P\.? ?O\.? ?Box) \d+{_TAIL_EN}",
    rf"(?<!\w)(?:C\.|C/|Calle|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Cuesta)[ \t]?(?:(?:de(?:l| la| los| las)?) )?[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+(?: (?:de(?:l| la| los| las)? )?[A-ZÁÉÍÓÚÑ][\wáéíóúñ]+){{0,2}},? (?:n[.ºo°]* ?)?\d{{1,4}}(?: ?[a-z])?(?:{_SEP}\d{{1,2}} ?[.º°ª]{{1,2}}(?: ?[A-Z])?)?(?:{_SEP}\d{{5}} {_CITY})?",
    rf"(?<![\w.:-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|impasse|boulevard|bd|place|allée|chemin|quai|cours|route|passage|square|sentier|ruelle) (?:(?:de la|de l['’]|des|du|de|d['’]|aux?) ?)?[A-ZÀ-Ýa-z][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]+){{0,3}}(?:{_SEP}\d{{5}} {_CITY})?",
    rf"(?<!\w)(?:(?:Am|An der|An den|Im|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der) (?:[A-ZÄÖÜ][\wäöüß]+ ){{1,2}}|(?:[A-ZÄÖÜ][\wäöüß-]+(?:er|en) )?(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|graben|chaussee)|(?<= )(?:Straße|Str\.|Weg|Gasse|Allee|Platz)) )\d{{1,4}} ?[a-z]?\b(?:{_SEP}\d{{5}} {_CITY})?",
    rf"(?<![\w.:-])\d{{1,5}}[a-z]? (?:[a-z'’-]+ ){{1,2}}(?:street|st|road|rd|lane|ln|avenue|ave|drive|boulevard|blvd)\b\.?(?:{_SEP}(?!the |please |not )[a-z'’-]+(?: (?!the |please |not )[a-z'’-]+)?(?: \d{{4,5}}(?!\d)|(?=\s*(?:[,.;)\n]|$)|\s+[A-Z])))?",
    r"(?:(?<=[在到于至往址居：: \t-])[一-鿿]{2,4}?|(?:(?<=[^一-鿿])|^)[一-鿿]{2,4}?|[一-鿿]{2})(?:省|市|县|区)(?:[一-鿿]{2,3}(?:区|县|镇))?[一-鿿]{1,6}?(?:路|街|巷|大道|道|弄|里)\d+号(?:\d+(?:单元|栋|幢|楼|座))?(?:\d+[室层])?",
)]
#: What each address pattern can't do without, looked for first.
_STREETS = [re.compile(p) for p in (
    rf"\b{_STREET}\b", r"(?i)\bbox\b", r"C\.|C/|Calle|Av|Plaza|Pza|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Cuesta", r"\b(?:rue|avenue|av\.|impasse|boulevard|bd|place|allée|chemin|quai|cours|route|passage|square|sentier|ruelle) ",
    r"(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|graben|chaussee|Straße|Str\.|Weg|Gasse|Allee|Platz|Am|An|Im|Zum|Zur|Auf|Unter|Hinter) ", r"\b(?:street|st|road|rd|lane|ln|avenue|ave|drive|boulevard|blvd)\b", r"\d号",
)]
#: Pieces of text that those patterns, greetings and Chinese speech have, all looked for in one pass: a bit for each.
_PIECES = ahocorasick.Automaton()
for _bit, _pieces in enumerate((
    [f" {w}" for w in "Street St Road Rd Lane Ln Avenue Ave Drive Dr Court Ct Way Close Place Pl Terrace Crescent Square Sq Boulevard Blvd Gardens Grove Row Walk Parade Mews".split()], ["Box", "box", "BOX"],
    ["C.", "C/", "Calle", "Av", "Plaza", "Pza", "Paseo", "P.º", "Camino", "Ronda", "Travesía", "Carretera", "Cuesta"], [f"{w} " for w in "rue avenue av. impasse boulevard bd place allée chemin quai cours route passage square sentier ruelle".split()],
    ["straße", "strasse", "str.", *[f"{w} " for w in "weg gasse allee platz ufer damm ring steig graben chaussee Straße Str. Weg Gasse Allee Platz Am An Im Zum Zur Auf Unter Hinter".split()]],
    ["street", "road", "lane", "avenue", "drive", "boulevard", *[f" {w}{e}" for w in ("st", "rd", "ln", "ave", "blvd") for e in " .,;)\n"]], ["号"],
    ["Hi ", "Hello ", "Hey ", "Dear ", "Hola ", "Estimad", "Querid", "Bonjour ", "Salut ", "Cher", "Hallo ", "Liebe", "Guten Tag", "Moin ", "你好"], ["说"],
)):
    for _piece in _pieces:
        _PIECES.add_word(_piece, _PIECES.get(_piece, 0) | 1 << _bit)
_PIECES.make_automaton()
_GREETS, _SAYS = 1 << 7, 1 << 8
_ADDRESS_CUE = re.compile(r"(?i)(?:address|label|(?:go|goes|went|moved?|ship(?:ped)?|sent|delivered) to|home is|lives? (?:at|in)|lived (?:at|in)|dirección|vivo en|vive en|adresse|anschrift|j[’']habite|habite au|wohn(?:e|t|haft)(?: in)?|gehen an|地址|寄到|住在)\W{0,4}$")
_NOT_ADDRESS = re.compile(r"(?i)(?:section|chapter|split|set|dataset|conjunto|jeu|satz|table|the|page)\s?$")
_NOT_ADDRESS_AFTER = re.compile(r"(?i)^\s?(?:scenes?|splits?|(?:data|sub)?set\b|prompts?|chapters?|sections?|has\b|was\b|is\b)")

_TOK = r"(?:[A-ZÀ-Ý]\.|(?:[dDlLO]['’])?[A-ZÀ-Ý][\wà-ÿ]*(?:['’-][A-ZÀ-Ýa-z][\wà-ÿ]*)*)"
_PARTICLE = r"(?: (?:de|del|de la|la|von|van|der|den|di|da|du|le|bin|al|y))?"
_FULL = rf"(?:{_TOK}{_PARTICLE} {_TOK}(?: {_TOK})?)"
_TITLE = re.compile(r"^(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Sir|Sr|Sra|Srta|Don|Doña|Dra|Herr|Frau|Hr|Fr|Mme|Mlle|Monsieur|Madame|Dott|Ing)\.? (?=[A-ZÀ-Ý][\wà-ÿ]+)")
_ZH = r"[一-鿿]{2,4}"
_NAME_FIELD = re.compile(r"(?mi)^[ \t]*(?:full name|name|nombre|nom|vorname|nachname|contact name|姓名|名字|联系人)[ \t]*(?::|：|-|–|\t|=)[ \t]*([^\n;|<(]{2,60}?)[ \t]*(?=$|[;|<(]|, ?(?:mail|tel|phone))")
_GREETING = re.compile(rf"(?:Hi|Hello|Hey|Dear|Hola|Estimad[oa]|Querid[oa]|Bonjour|Salut|Cher|Chère|Hallo|Liebe[r]?|Guten Tag|Moin) ({_TOK}(?: {_TOK})?)(?=\s?[,!:，])|你好({_ZH})[，,]")
# Words before and after which the languages put names: roles, thanks, copies and sources; acts of speech, mail addresses.
_BEFORE_NAME = re.compile(
    r"(?:\b(?:[Rr]eviewers?|[Aa]nnotators?|[Rr]aters?|[Jj]udges?|[Aa]uthors?|[Ee]ditors?|[Cc]olleagues?|[Mm]anager|[Dd]octor|[Pp]rofessor|[Tt]eacher|[Nn]ame(?: is)?|signed by|written by|started by|reported by|Thanks to|thanks to|thank you,|[Cc][Cc]|Regards,|regards,|Sincerely,|According to|according to|says|said|met with|asked|ask|call|Contact)"
    r"|\b(?:[Rr]evisora?|[Aa]utora?|[Nn]ombre|[Ss]egún|[Gg]racias a|[Cc]opia (?:para|a)|[Ss]aludos,)|\b(?:[Rr]electrice|[Rr]electeur|[Aa]uteure?|[Nn]om|[Dd][’']après|[Gg]râce à|[Cc]opie à|[Cc]ordialement,)|\b(?:[Gg]utachter(?:in)?|[Aa]utor(?:in)?|[Dd]ank|[Ll]aut|[Kk]opie an|von))[ \t]?[:：–-]?[ \t]$"
    r"|(?:^|\n)[ \t]*(?:(?:[Kk]ind |[Bb]est )?[Rr]egards|[Bb]est|[Tt]hanks|[Cc]heers|[Ss]incerely|[Yy]ours|(?:[Uu]n )?[Ss]aludos?|[Gg]racias|[Cc]ordialement|[Mm]erci|(?:[Vv]iele |[Mm]it freundlichen )?Grü(?:ß|ss)en?|[Dd]anke|谢谢|此致|祝好)[,.!，。]?[ \t]*\n+[ \t]*$"
    r"|\b(?:Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Sr|Sra|Srta|Don|Doña|Dra|Herr|Frau|Mme|Mlle|Monsieur|Madame)\.? $"
)
_AFTER_NAME = re.compile(r"(?:,? (?:says?|said|asks?|asked|writes?|wrote|told|replied|answered|called|signed|agree[ds]?|disagree[ds]?|noted|explained|suggested|pide|dijo|escribió|preguntó|a demandé|a écrit|demande|fragte|schrieb|sagt|bittet)\b|\s?[;,]?\s?[<(]?\s?(?:e?-?mail:? )?[\w.+%-]+\s?(?:@|＠|\(at\)|\[at\]))")
_PAIRED = re.compile(rf"(?: and | y | et | und )$"), re.compile(rf"(?: and | y | et | und ){_FULL}")
_CHINESE = [re.compile(p) for p in (rf"(?:评审员|审稿人|作者|多亏|感谢|抄送|联系人|来自)[:：]?({_ZH}?)(?=要求|找到|表示|认为|说|和|。|，|,|$)", rf"(?<=和)({_ZH})(?=。|$)", rf"({_ZH})(?=\s?[<(]\s?[\w.+%-]+\s?(?:@|＠|\(at\)|\[at\]| at ))")]
_CHINESE_SAYS = re.compile(rf"(?:^|(?<=[^一-鿿]))({_ZH}?)(?=说)")
_LONE = re.compile(rf"(?m)^[ \t]*({_FULL}|{_TOK}, {_TOK}|{_ZH})[ \t]*(?=$|;\s?[\w.+%-]+\s?(?:@|＠|\(at\)|\[at\]| at ))")
_SHAPE = re.compile(rf"(?<![\w.]){_TOK}(?:{_PARTICLE} {_TOK})+(?![\w])")
#: Function words, labels and other words that begin sentences and fields but no names.
_COMMON = frozenset(
    "The A An And But Or If In On At By Of To For With From Near Nobody Nothing Later When What Who How Why One Two It This That These Those There Here Then Only Also Let Set See Log Write List Name Explain Describe Compare Suppose Final Verdict Decision Answer Ideas Uses Ticket Sample Section Street Road Lane Avenue Annotator Reviewer Judge Author Editor Address Phone Mail Email Text Home Since Please Contact Delete Tax My You We I He She They Our Your Call Thanks Dear Hi Hello Hey Cc CC Re Fwd SSN ID PO Box Flat Apt Apartment Unit Suite According Regards Sincerely Yes No Not "
    "El La Los Las Un Una De Del Al Si Con Por Para Y En Nadie Quien También Según Gracias Copia Lo Como Le Les Une Des Du Et Il Elle On Avec Plus Personne Parmi Dans Grâce Copie D’après D'après Der Die Das Ein Eine Einen Von Mit Wer Wenn Am Im Zum Zur Und Oder Es Ich Könnte Niemand Laut Dank Kopie Straße Gasse Weg Platz Plaza Calle Rue".split()
)


def _is_common(word: str) -> bool:
    """Whether a word is no part of a name; a capital with a full stop is an initial."""
    return word.strip(".,") in _COMMON and not (len(word) == 2 and word[1] == ".")


def _is_capital(word: str) -> bool:
    return word[0].isupper() or word[1:2] in ("'", "’") and word[2:3].isupper()


def _norm(t: str) -> str:
    return t.strip(".,;:").lower()


def _split_name(text: str) -> tuple[str, str]:
    """A name's given name and surname, in lower case; initials and missing parts are ''."""
    if re.match(r"[一-鿿]", text):
        surname = text[:2] if len(text) == 4 else text[:1]
        return text[len(surname) :], surname
    if "," in text:
        last, _, first = text.partition(",")
        parts = [*first.split(), *last.split()]
    else:
        parts = text.split()
    first, last = _norm(parts[0]), _norm(parts[-1]) if len(parts) > 1 else ""
    return ("" if len(first) <= 1 else first), ("" if len(last) <= 1 else last)


def _vote(x: bool | None) -> str:
    return "-" if x is None else "1" if x else "0"


def _context(text: str, start: int, end: int, kind: str, span: str) -> list[int]:
    """Hashed features of a candidate: its shape, and the words before and after it."""
    before, after = re.findall(r"\w+|[^\w\s]", text[max(0, start - 40) : start])[-3:], re.findall(r"\w+|[^\w\s]", text[end : end + 40])[:3]
    shape = re.sub(r"[一-鿿]+", "汉", re.sub(r"\d+", lambda m: f"9{min(len(m.group()), 12)}", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Ý]{2,}", "AA", span))))[:24]
    named = [f"s:{shape}", *[f"b{len(before) - i}:{w.lower()}" for i, w in enumerate(before)], *[f"a{i}:{w.lower()}" for i, w in enumerate(after)]]
    return [xxhash.xxh32_intdigest(f"{kind}|{x}") % _DIMS for x in named]


class _Spans:
    """Disjoint spans in order, so that a new one is only held against its neighbours."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def candidates(text: str) -> list[tuple[str, int, int, str, str, str, list[int]]]:
    """(type, start, end, votes, given, surname, features) of every span that some labeler proposes.

    EMAIL: a plain @; a domain with a dot; no code mark beside it. PHONE and ID_NUMBER: a known format; a cue beside
    it; no cue of runs, tickets, seeds and the like before it; for a phone a prefix or separators, for an identity
    number a form that hardly anything else has. ADDRESS: it goes on after house and street; a cue before it; no cue
    of sections and data sets; a postal code. NAME: a word before it that takes names; two gazetteer votes that are
    filled in later, as they are counted over all documents; no common word; a word after it that takes names; a mail
    address in the text has a part of it; it doesn't begin a sentence.
    """
    out = []
    taken = _Spans()

    def add(kind: str, a: int, b: int, votes: str, given: str = "", surname: str = "") -> None:
        out.append((kind, a, b, votes, given, surname, _context(text, a, b, kind, text[a:b])))

    low = text.lower()
    mails, pieces = "", 0
    for _, bit in _PIECES.iter(text + "\n"):
        pieces |= bit
    if "@" in text or "＠" in text or "(at)" in low or "[at]" in low or "{at}" in low or " at " in low and " dot " in low:
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            at_word = re.search(r"\s(?:at|AT)\s", m.group())
            if at_word and not re.search(r"\s(?:dot|DOT)\s", m.group()):
                continue
            add("EMAIL", a, b, _vote(bool(re.search(r"[@＠]|[(\[]at[)\]]", m.group(), re.I)) or bool(at_word)) + _vote(bool(_EMAIL_DOTTED.search(m.group()))) + _vote("@@" not in m.group() and text[a - 1 : a] != "@"))
            taken.add(a, b)
            mails += m.group().lower() + " "
    if re.search(r"\d", text):
        for i, (gate, pattern) in enumerate(zip(_STREETS, _ADDRESSES, strict=True)):
            if not pieces >> i & 1 or not gate.search(text):
                continue
            for m in pattern.finditer(text):
                a, b = m.span()
                while b > a and text[b - 1] in " \n,":
                    b -= 1
                if not taken.free(a, b):
                    continue
                before, after = text[max(0, a - 40) : a], text[b : b + 30]
                span = text[a:b]
                bad = bool(_NOT_ADDRESS.search(before) or _NOT_ADDRESS_AFTER.search(after))
                cue = bool(_ADDRESS_CUE.search(before)) or bool(re.search(r"(?:^|\n)\s*$", before)) and bool(re.match(r"\s*(?:\n|$)", after))
                add("ADDRESS", a, b, _vote(bool(re.search(r"[,\n]|号|\d$|[a-z]$", span))) + _vote(cue) + _vote(not bad) + _vote(True if re.search(r"(?<!\d)\d{5}(?!\d)|号|[A-Z]\d[A-Z\d]? ?\d[A-Z]{2}$", span) else None))
                taken.add(a, b)
        ids = {}
        for m in _IDS.finditer(text):
            a, b = m.span()
            if taken.free(a, b):
                ids[a, b] = m.group()
        phones = {}
        for m in _NUMBERS.finditer(text):
            a, b = m.span()
            if b - a >= 7 and sum(c.isdigit() for c in m.group()) >= 7 and taken.free(a, b):
                phones[a, b] = m.group()
        for (a, b), span in phones.items():
            before, after = text[max(0, a - 40) : a], text[b : b + 30]
            known = any(p.fullmatch(span) for p in _PHONES)
            called = bool(_PHONE_CUE.search(before))
            if not known and not called:
                continue
            alone = bool(re.search(r"(?:^|\n|[;=])\s*$", before)) and bool(re.match(r"\s*(?:\n|;|$| state=)", after))
            other = bool(_ID_CUE.search(before))
            bad = bool(_NOT_PERSON.search(before)) or other or bool(_COUNTED.match(after))
            add("PHONE", a, b, _vote(known) + _vote((called or alone) and not other) + _vote(not bad) + _vote(bool(re.match(r"[+＋(（]|00", span)) or (bool(re.search(r"\d[ .\-/]\d", span)) or None)))
        for (a, b), span in ids.items():
            before, after = text[max(0, a - 40) : a], text[b : b + 30]
            cue = bool(_ID_CUE.search(before))
            alone = bool(re.search(r"(?:^|\n|[;=]|\n\W{0,3})\s*$", before)) and bool(re.match(r"\s*(?:\n|;|$)", after))
            bad = (bool(_NOT_PERSON.search(before)) or bool(_PHONE_CUE.search(before)) or bool(_COUNTED.match(after))) and not cue
            sure = bool(_SURE_ID.fullmatch(span))
            add("ID_NUMBER", a, b, _vote(sure or cue) + _vote(cue) + _vote(not bad) + _vote(sure or (None if cue or alone else False)))
    names: dict[tuple[int, int], bool | None] = {}

    def name(a: int, b: int, cued: bool | None) -> None:
        """Notes a span; ``cued`` None asks the words before it."""
        while b > a and text[b - 1] in " ,;:\t":
            b -= 1
        while m := _TITLE.match(text[a:b]):
            a, cued = a + m.end(), True
        while (m := re.search(r"\s+(\S+)$", text[a:b])) and _is_common(m.group(1)):  # the next sentence's first word
            b = a + m.start()
        if b > a and taken.free(a, b):
            names[a, b] = cued or names.get((a, b))

    for m in _NAME_FIELD.finditer(text):
        parts = m.group(1).split()
        if 1 <= len(parts) <= 5 and not re.search(r"\d|@", m.group(1)):
            name(*m.span(1), True)
    for m in _GREETING.finditer(text) if pieces & _GREETS else ():
        if m.group(2) or re.search(r"(?:^|[.!?。:]\s|\n)$", text[max(0, m.start() - 2) : m.start()]):
            name(*m.span(1 if m.group(1) else 2), True)
    if not text.isascii():
        for i, p in enumerate((*_CHINESE, *([_CHINESE_SAYS] if pieces & _SAYS else []))):
            for m in p.finditer(text):
                name(*m.span(1), i < len(_CHINESE))
    for m in _LONE.finditer(text):
        if not any(map(_is_common, m.group(1).split())):
            name(*m.span(1), False)
    for m in _SHAPE.finditer(text):
        run: list[tuple[int, int, str]] = []
        for w in [*re.finditer(r"\S+", m.group()), None]:  # words that are common with a capital part a row of capitals
            if w and not _is_common(w.group()) and not (w.group() == "y" and sum(_is_capital(x[2]) for x in run) >= 2):
                run.append((w.start() + m.start(), w.end() + m.start(), w.group()))
                continue
            while run and not _is_capital(run[0][2]):
                run.pop(0)
            while run and not _is_capital(run[-1][2]):
                run.pop()
            capitals = [i for i, x in enumerate(run) if _is_capital(x[2])]
            if len(capitals) >= 2:
                name(run[0][0], run[capitals[min(2, len(capitals) - 1)]][1], None)
            run = []
    kept = _Spans()
    for (a, b), cued in sorted(names.items(), key=lambda x: (not x[1], x[0][0] - x[0][1])):
        if not kept.free(a, b):
            continue
        kept.add(a, b)
        given, surname = _split_name(text[a:b])
        common = any(map(_is_common, text[a:b].split()))
        before, after = text[max(0, a - 40) : a], text[b : b + 60]
        led = cued or bool(_BEFORE_NAME.search(before))
        followed = bool(_AFTER_NAME.match(after)) or bool(_PAIRED[0].search(before)) or bool(_PAIRED[1].match(after))
        mailed = any(len(x) >= 4 and x in mails for x in (given, surname)) if mails else None
        begins = not led and bool(re.search(r"(?:^|[.!?:。\n]\s*)$", before))
        add("NAME", a, b, _vote(led) + "??" + _vote(not common) + _vote(followed) + _vote(mailed) + _vote(not begins), given, surname)
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, n, *c[:3], text[c[1] : c[2]], *c[3:]) for i, n, text in zip(b["doc_id"], b["_n"], b["text"], strict=True) for c in candidates(text)]
        yield pd.DataFrame(rows, columns=["doc_id", "_n", "pii_type", "start", "end", "pii_text", "votes", "given", "surname", "features"])


def _gazetteer(names: DataFrame, part: str, share: float) -> DataFrame:
    """(part, <part>_known): the parts that stand where only a name can in ``share`` of the texts that have them in a
    name's shape, at the low side of 95 %. Copies of a text count once."""
    cued = ((F.substring("votes", 1, 1) == "1") & ~F.substring("votes", 4, 1).eqNullSafe("0")).cast("int")
    by = names.filter(F.col(part) != "").groupBy("_n", part).agg(F.max(cued).alias("c")).groupBy(part).agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    rate, n, z2 = F.col("c") / F.col("n"), F.col("n"), 3.84
    low = (rate + z2 / (2 * n) - F.sqrt(z2 * (rate * (1 - rate) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    return by.filter((F.col("c") > 0) & (low >= share)).select(part, F.lit(True).alias(f"{part}_known"))


def _apart(rows: pd.Series) -> pd.Series:
    """Of each text's spans, as (p, start, end) with the best first, the places of those that overlap no better one."""
    out = []
    for spans in rows:
        kept, places = _Spans(), []
        for i, x in sorted(enumerate(spans), key=lambda y: (-y[1]["p"], y[1]["start"] - y[1]["end"], y[1]["start"], y[1]["t"])):
            if kept.free(x["start"], x["end"]):
                kept.add(x["start"], x["end"])
                places.append(i)
        out.append(sorted(places))
    return pd.Series(out)


def spans(documents: DataFrame, share: float = 0.2, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, _n, pii_type, start, end, pii_text, probability) of every span found; offsets are code points.

    ``share`` is how often a gazetteer's entry must stand where only a name can; the classifier is trained on about
    ``sample_rows`` candidates of each type, taken by hash. Null and empty texts hold nothing. Rows that repeat a
    doc_id are told apart by ``_n``. Spans of a text that overlap are settled by the classifier's probability, then by
    length.
    """
    spark = documents.sparkSession
    texts = documents.filter("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("_n"), "text")
    kind = "doc_id bigint, _n bigint, pii_type string, start int, end int, pii_text string, votes string, given string, surname string, features array<int>"
    found = durable(texts.mapInPandas(_scan, kind), "candidates")
    names = found.filter("pii_type = 'NAME'")
    heard = lambda part: F.when(F.col(part) == "", "-").when(F.col(f"{part}_known"), "1").otherwise("0")
    # a name without a part gets a key of its own, or all of them would meet in one task
    key = lambda part: F.when(F.col(part) == "", F.concat(F.lit("\x01"), F.xxhash64("doc_id", "start"))).otherwise(F.col(part))
    known = names.withColumn("_g", key("given")).withColumn("_s", key("surname"))
    known = known.join(_gazetteer(names, "given", share).withColumnRenamed("given", "_g"), "_g", "left").join(_gazetteer(names, "surname", share).withColumnRenamed("surname", "_s"), "_s", "left")
    voted = known.withColumn("votes", F.concat(F.substring("votes", 1, 1), heard("given"), heard("surname"), F.substring("votes", 4, 4)))
    columns = ["doc_id", "_n", "pii_type", "start", "end", "pii_text", "votes", "features"]
    every = durable(found.filter("pii_type <> 'NAME'").select(*columns).unionByName(voted.select(*columns)), "pii-votes")
    counts: dict[str, dict[str, int]] = {t: {} for t in TYPES}
    for r in every.groupBy("pii_type", "votes").agg(F.count("*").alias("n")).collect():  # at most 3^7 patterns a type
        counts[r["pii_type"]][r["votes"]] = r["n"]
    soft = {(t, p): x for t, c in counts.items() for p, x in labelmodel.fit(c, *_RATES[t], prior=0.6 if t in ("EMAIL", "ADDRESS") else 0.4, anchor=0.2).items()}
    model = _train(every, soft, {t: max(1, math.ceil(sum(c.values()) / sample_rows)) for t, c in counts.items()})
    cut = {t: labelmodel.cutoff(c, {p: soft[t, p] for p in c}, least=0.5, most=0.9) for t, c in counts.items()}
    send = spark.sparkContext.broadcast((model, soft, cut))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, labels, least_p = send.value
        for b in batches:
            p = [_probability(weights, labels, t, v, f) for t, v, f in zip(b["pii_type"], b["votes"], b["features"], strict=True)]
            b = b.assign(probability=p)
            yield b[[x >= least_p[t] for x, t in zip(p, b["pii_type"], strict=True)]][["doc_id", "_n", "pii_type", "start", "end", "pii_text", "probability"]]

    likely = every.mapInPandas(classify, "doc_id bigint, _n bigint, pii_type string, start int, end int, pii_text string, probability double")
    # the spans of one text are as many as it has room for
    by_text = likely.distinct().groupBy("doc_id", "_n").agg(F.collect_list(F.struct("start", "end", "pii_type", "pii_text", "probability")).alias("s"))
    slim = F.transform("s", lambda x: F.struct(F.round(x["probability"], 2).alias("p"), x["start"].alias("start"), x["end"].alias("end"), x["pii_type"].alias("t")))
    places = F.when(F.size("s") > 1, F.pandas_udf(_apart, "array<int>")(slim)).otherwise(F.array(F.lit(0)))
    return by_text.select("doc_id", "_n", F.explode(F.transform(places, lambda i: F.get("s", i))).alias("x")).select("doc_id", "_n", "x.pii_type", "x.start", "x.end", "x.pii_text", "x.probability")


def _columns(kind: str, votes: str, features: list[int]) -> list[int]:
    """A candidate's non-zero features: its type's bias, its votes, its hashed context."""
    t = TYPES.index(kind)
    own = [_DIMS + t, *[_DIMS + len(TYPES) + t * 21 + i * 3 + "01-".index(v) for i, v in enumerate(votes)]]
    return own + [int(f) for f in features]


def _train(every: DataFrame, soft: dict, one_in: dict[str, int]) -> np.ndarray:
    """Logistic regression of the label model's probabilities on votes and context, on one in so many candidates of
    each type."""
    size = _DIMS + len(TYPES) * 22
    w = np.zeros(size)
    step = F.element_at(F.create_map(*[F.lit(x) for t in TYPES for x in (t, one_in[t])]), F.col("pii_type"))
    rows = every.filter(F.pmod(F.xxhash64("doc_id", "start", "end", "pii_type"), step) == 0).select("pii_type", "votes", "features").collect()
    if not rows:
        return w
    x = [np.array(_columns(r["pii_type"], r["votes"], r["features"])) for r in rows]
    y = np.array([soft[r["pii_type"], r["votes"]] for r in rows])
    flat, at = np.concatenate(x), np.concatenate([[0], np.cumsum([len(i) for i in x])[:-1]])
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    seen = np.full(size, 1e-8)
    for _ in range(150):  # full-batch AdaGrad
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], at), -30, 30)))
        g = np.bincount(flat, weights=(p - y)[row], minlength=size) / len(x) + 1e-6 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def _probability(weights: np.ndarray, soft: dict, kind: str, votes: str, features: list[int]) -> float:
    """The classifier's probability, averaged in log odds with the label model's, so that a context that the sample
    lacks can't overrule the votes alone."""
    z = float(weights[_columns(kind, votes, features)].sum())
    q = min(max(soft[kind, votes], 1e-4), 1 - 1e-4)
    return 1 / (1 + np.exp(-(z + np.log(q / (1 - q))) / 2))


def items(found: DataFrame) -> DataFrame:
    """(doc_id, pii_type, pii_text): each distinct item of a document once."""
    return found.select("doc_id", "pii_type", "pii_text").distinct()


def redacted(documents: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, redacted): every document, with [EMAIL] and the like for the spans; null texts stay null."""
    per = found.groupBy("doc_id", "_n").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("_s"))
    joined = documents.select("doc_id", F.xxhash64("text").alias("_n"), F.col(text).alias("_t")).join(per, ["doc_id", "_n"], "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    def step(acc: Column, s: Column) -> Column:  # noqa: E306
        between = F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["done"], between, F.lit("["), s["pii_type"], F.lit("]")).alias("done"), s["end"].alias("at"))

    whole = F.aggregate("_s", start, step, lambda acc: F.concat(acc["done"], F.substring(F.col("_t"), acc["at"] + 1, F.char_length("_t"))))
    return joined.select("doc_id", F.when(F.col("_s").isNull(), F.col("_t")).otherwise(whole).alias("redacted"))

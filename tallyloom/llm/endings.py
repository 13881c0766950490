"""How a text ends: whole, cut, or in a way that only the corpus can settle."""

from __future__ import annotations

import hashlib
import json
import re

COMPLETE, CUT, ITEM, ELLIPSIS, EMPTY = 0, 1, 2, 3, 4

# Marks that cutters append, placeholders of missing answers, and what may follow a sentence's end.
_MARK = re.compile(r"\[\s*(?:truncated|cut|snip|snipped|clipped|more|continued|\.{3}|…)[^\]\n]*\]|<\s*(?:snip|cut|truncated|more|clipped)\s*/?>|\(\s*(?:more|cont(?:inued|'d)?|truncated|cut|snip)\.?\s*\)", re.I)
_OPENERS = {"]": "[", ">": "<", ")": "("}
_PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|nan|n/?a|undefined|empty|todo|tbd|no answer|no response|\[?(?:invalid|empty|blank)\]?|[-–—_.…*#?!\"'“”‘’`~|/\\\s]*)$")
_BARE_LABEL = re.compile(r"(?i)^[\W_]*(?:final\s+)?(?:answer|response|output|result|solution|assistant|antwort|respuesta|réponse|答案|回答)[\W_]*$")
_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00A0, 0xAD], " ")
_BLANK = "".join(map(chr, _INVISIBLE)) + " \t\r\n\f\v"
_ENDS = ".!?。！？؟।"
_CLOSERS = "\"'”’»›)]}*_`）】」』 \t"
_LIST = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s+(?=\S)")
_ONLY_BULLET = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)]?)\s*$")
_FENCE = re.compile(r"(?m)^\s*(?:```|~~~)|```")
_FIELD = re.compile(r"^\s*[*_]{0,2}[^\W\d][\w ]{0,30}[*_]{0,2}\s*[:：][*_]{0,2}\s*[\w.,%/+-]{1,20}$")
_TAG_OPEN = re.compile(r"<(answer|result|final|output|response|think|thinking|reasoning)>", re.I)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_PROSE = re.compile(r"(?:^|[ \n])[^\W\d_]{2,}[ ,][^\W\d_]+ [^\W\d_]{2,}|[㐀-鿿]{12}")
_WHOLE_TAG = re.compile(r"</?\w+>")
_OPEN_TAG = re.compile(r"<[a-z/]{0,12}")
_OPEN_COMMAND = re.compile(r"\\[a-z]*")
_BOXED = re.compile(r"\\boxed\{[^{}]*\}\W*")
_decoder = json.JSONDecoder()


def without_thoughts(t: str) -> str:
    return re.sub(r"(?is)<(think|thinking|reasoning)>.*?</\1>", "", t) if "</" in t else t


def parts(content: str | None) -> tuple[str, bool]:
    """A stored content's text, and whether it was a list of parts: the joined text parts, else the reasoning."""
    if content is None:
        return "", False
    s = content.strip()
    if s[:1] == "[" and s[-1:] == "]":
        try:
            v = json.loads(content)
        except ValueError:
            return content, False
        if isinstance(v, list) and all(x is None or (isinstance(x, dict) and "type" in x) for x in v):
            text = "".join(x["text"] for x in v if x and x.get("type") == "text" and isinstance(x.get("text"), str))
            if text or any(x and x.get("type") == "text" for x in v):
                return text, True
            return "".join(x["reasoning"] for x in v if x and isinstance(x.get("reasoning"), str)), True
    return content, False


def is_empty(t: str) -> bool:
    """No answer: blank, markup only, a placeholder, or a bare label."""
    if len(t) > 120 and _PROSE.search(t):
        return False
    t = (t if t.isascii() else t.translate(_INVISIBLE)).strip()
    if not t or _PLACEHOLDER.match(t) or _BARE_LABEL.match(t):
        return True
    bare = re.sub(r"(?s)```[\w-]*\s*```|\\boxed\{\s*\}|<[^<>]{1,30}>|</?[a-z]+/?>|[\[\]{}()*_#>\-`\"':：.\s]", "", t)
    return not bare or bool(_PLACEHOLDER.match(bare) or _BARE_LABEL.match(bare))


def _open_json(t: str) -> bool | None:
    """Of a text that begins as JSON: whether it stops before its end; None if it is no JSON."""
    s = t.strip()
    if s[:1] not in ("{", "[") or not re.match(r"\s*(?:\{\s*(?:\"|$)|\[\s*(?:[\[{\"\d]|null|$))", t):
        return None
    try:
        _, end = _decoder.raw_decode(s)
    except ValueError as e:
        if not isinstance(e, json.JSONDecodeError):
            return None
        if e.msg.startswith("Unterminated string") or e.pos >= len(s) - 1:
            return True
        rest = s[e.pos :]
        return True if re.fullmatch(r"(?:t|tr|tru|f|fa|fal|fals|n|nu|nul|-|\\u?[0-9a-fA-F]{0,4})", rest) or e.msg.startswith("Invalid \\") and e.pos > len(s) - 8 else None
    return False if end >= len(s) else None


def words(line: str, n: int, last: bool) -> str:
    w = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", line.lower())
    return " ".join(w[-n:] if last else w[:n])


def _item_key(line: str) -> str:
    body = _LIST.sub("", line)
    return f"{words(body, 2, False)}\x01{words(body, 2, True)}"


def _ellipsis_key(body: str, text: str) -> str:
    """The last words and the text's hash, as copies say nothing more."""
    return f"{words(' '.join(body.rsplit(None, 3)[-3:]), 2, True)}\x01{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=8).hexdigest()}"


def without_marks(t: str) -> tuple[str, bool]:
    """The text before the marks of a cut at its end, and whether there are any."""
    at = len(t)
    while at and (opener := _OPENERS.get(t[at - 1])) and (start := t.rfind(opener, 0, at)) >= 0 and _MARK.fullmatch(t, start, at):
        at = len(t[:start].rstrip())
    body = t[:at].rstrip()
    if at < len(t) and body.endswith(("..", "…")):  # the dots are the mark's own
        body = body.rstrip(".…").rstrip()
    return body, at < len(t)


def _sentence_end(line: str) -> bool:
    bare = line.rstrip(_CLOSERS)
    return bool(bare) and bare[-1] in _ENDS and not bare.endswith("..")


def ending(text: str) -> tuple[int, str, list[str]]:
    """(code, key, items): how the text ends.

    For ITEM and ELLIPSIS the key is what the corpus is asked about; for CUT it is ``broken`` (a code or JSON block, tag
    or list number stays open), ``marked`` or ``open`` (a line that stops); for COMPLETE it is ``phrase``, ``\\x01`` and the
    last word where a lone line without a stop may be a whole phrase, else ''. Of a list without full stops ``items``
    has the keys of all items but the last, which are known to be whole.
    """
    t = text.rstrip(_BLANK)
    if is_empty(t):
        return EMPTY, "", []
    if t[-1] == "�":
        return CUT, "broken", []
    t, marked = without_marks(t)
    if not t:
        return EMPTY, "", []
    opened = _open_json(t)
    if opened is not None:
        return (CUT, "broken", []) if opened else (COMPLETE, "", [])
    if ("```" in t or "~~~" in t) and len(_FENCE.findall(t)) % 2:
        return CUT, "broken", []
    low = t.lower()
    for tag in {m.lower() for m in _TAG_OPEN.findall(t)} if "<" in t else ():
        if low.rfind(f"<{tag}>") > low.rfind(f"</{tag}>"):
            return CUT, "broken", []
    angle, slash = t[max(0, t.rfind("<")) :], t[max(0, t.rfind("\\")) :]
    boxed = t[t.rfind("\\boxed") :] if "\\boxed" in t else ""
    if t.endswith("```") or _WHOLE_TAG.fullmatch(angle) or _BOXED.fullmatch(boxed):
        return COMPLETE, "", []
    if _OPEN_TAG.fullmatch(angle) or _OPEN_COMMAND.fullmatch(slash) or boxed and "}" not in boxed:
        return CUT, "broken", []
    lines = t.split("\n")
    last = lines[-1]
    if len(lines) > 1 and _ONLY_BULLET.match(last):
        return CUT, "broken", []
    bare = t.rstrip("\"'”’»)]")
    if bare.endswith(("..", "…")):
        body = bare.rstrip(".…")
        return (CUT, "marked", []) if marked or _CJK.search(body[-3:]) else (ELLIPSIS, _ellipsis_key(body, t), [])
    if _sentence_end(last):
        return COMPLETE, "", []
    if marked:
        return CUT, "marked", []
    items = [x for x in lines[:-1] if _LIST.match(x)]
    if _LIST.match(last) and items:
        if sum(map(_sentence_end, items)) * 2 > len(items):
            return CUT, "open", []
        return ITEM, _item_key(last), [_item_key(x) for x in items]
    if last.endswith((":", "：")):
        return CUT, "open", []
    if _FIELD.match(last) or (last.endswith((")", "）")) and last.count("(") + last.count("（") == last.count(")") + last.count("）")):
        return COMPLETE, "", []
    n, cjk = len(last.split()), bool(_CJK.search(last))
    if len(lines) == 1 and not last.endswith((",", ";", "，", "；", "、")) and (len(last) <= 5 if cjk else n <= 3 or t == low):
        return COMPLETE, f"phrase\x01{words(last, 1, True)}", []  # a term, or lower case without stops, as of a query
    return CUT, "open", []

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import endings as E
from tallyloom.llm import labelmodel, pairs, truncation

LONG = "The method starts from the novelty of each idea and ends at the workshop. "


@pytest.mark.parametrize(
    "text, code",
    [
        (LONG, E.COMPLETE), (LONG + "It is less obvious that a br", E.CUT), (LONG + "Two of the", E.CUT), (LONG + "Pai... [cut]", E.CUT), (LONG + "the wind…(more)", E.CUT), (LONG + "u�", E.CUT), ("", E.EMPTY), ("  ​", E.EMPTY), ("N/A", E.EMPTY), ("ANSWER: ", E.EMPTY),
        ("<answer></answer>", E.EMPTY), ("\\boxed{}", E.EMPTY), ("```\n```", E.EMPTY), ("A", E.COMPLETE), ("ANSWER: B", E.COMPLETE), ("tent peg", E.COMPLETE), ("<answer>cook</answer>", E.COMPLETE), ("<answer>coo", E.CUT), ("\\boxed{12}", E.COMPLETE),
        ("```python\nx = 1\n```", E.COMPLETE), ("```python\nx = 1\nfor ro", E.CUT), ('{"a": [1, 2]}', E.COMPLETE), ('{"a": ["b", "c', E.CUT), ('["a", "b"]', E.COMPLETE), ('[{"type": "text", "text": "abc d', E.CUT), ("[draft] " + LONG, E.COMPLETE), (LONG + "**Word count:** 80", E.CUT),
        (LONG + "\n\n**Word count:** 80", E.COMPLETE), ("写一个短故事。 (answer in French)", E.COMPLETE), ("如果木勺比较脆弱,最好先固定再", E.CUT), ("如果用铜铃来顶住房门,会怎么样呢?", E.COMPLETE), ("Ideas:\n1. One thing.\n2.", E.CUT), ("Ideas:\n- One thing.\n- Two thi", E.CUT), ("Ideas:\n- One thing\n- Two thi", E.ITEM),
        ("Who knows what comes next...", E.ELLIPSIS), ('The tailor only said: "Not today."', E.COMPLETE), ('"I cannot open the gate,"', E.CUT), ("list 19 unusual uses for a wheelbarrow", E.COMPLETE), ("Here are some ideas for the cork board:", E.CUT), (LONG * 20_000 + "Two of", E.CUT), ("<think>hm</think>\nYES.", E.COMPLETE),
        ("<think>and so", E.CUT),
    ],
)
def test_endings(text, code):
    assert E.ending(text)[0] == code


KIND = "rec_id bigint, run_dir string, model string, len string, model_output struct<model:string,choices:array<struct<message:struct<id:string>,stop_reason:string>>,usage:struct<output_tokens:bigint>>, messages array<struct<id:string,role:string,content:string>>"


def records(*texts):
    return [(i, "r", "m", "clash", None if i % 2 else ("m", [(("0",), "length"), (("3",), "stop")], (5,)), [None, ("1", "system", "cut of"), ("2", "user", "Ask me."), ("3", "assistant", t)]) for i, t in enumerate(texts)]


def test_cut_messages(spark):
    item = lambda last: f"Uses:\n- Tie to a jar lid and draw circles in sand\n- Stand-in for a spoon\n- {last}"
    texts = [LONG, LONG + "Two of the", item("Stand-in for a jar lid"), item("Stand-in for a sp"), item("Stand-in for a spoon"), *[f"Day {i}. And who knows what comes next..." for i in range(3)], LONG + "It was obvio...", None, "", '[{"type":"text","text":"All is well."},{"type":"text","text":"Not he"}]', '[{"type":"text","text":"All is well."}]']
    m = truncation.cut_messages(spark.createDataFrame(records(*texts), KIND))
    got = {(r["rec_id"], r["msg_pos"]) for r in m.filter("is_cut").collect()}
    assert got == {(1, 3), (2, 3), (3, 3), (8, 3), (11, 3)}  # (2, 3) is an item that no list has inside
    assert {r["role"] for r in m.collect()} == {"user", "assistant"}
    rates = {r["run_dir"]: (r["n_records"], r["n_cut"]) for r in truncation.cut_rates(m, "run_dir").collect()}
    assert rates == {"r": (13, 5)}
    empty = spark.createDataFrame([], KIND)
    assert truncation.cut_messages(empty).count() == 0 and truncation.cut_rates(truncation.cut_messages(empty), "model").count() == 0


def test_copies_make_no_style(spark):
    cut, style = LONG + "With a little wire, the mirr…", "Then the piper sat down and waited..."
    texts = [*[cut] * 40, *[f"{LONG}Day {i}. {style}" for i in range(4)], LONG + "It can weigh down a tablecl..."]
    for part in (texts, texts[-5:] + [cut] * 2):
        m = truncation.cut_messages(spark.createDataFrame(records(*part), KIND)).filter("is_cut")
        assert {(r["rec_id"], r["msg_pos"]) for r in m.collect()} == {(i, 3) for i, t in enumerate(part) if t == cut or t.endswith("tablecl...")}


def test_limits_and_stops_decide_open_endings(spark):
    """Endings alone can't tell these: the same last item, a kind that often has new ends, with and without a limit."""
    items = [f"Uses:\n- Paint the gate number {i} blue\n- Wash a shed number {i} green\n- Paint the gate number {i} blue" for i in range(300)]
    ask = "Uses:\n- Paint the gate number 1 blue\n- Wash a shed number 1 green\n- Paint the number {} green"
    full, whole = [(f"{i} " + LONG * 9)[:512] for i in range(40)], [LONG * (i % 7 + 1) for i in range(600)]
    doubtful = [(ask.format(2), "length", 160), (ask.format(2), "stop", 77), ("list uses of a whe", "length", 160), ("list uses of a wheel", "stop", 8)]
    rows = [*[(t, "stop", 40 + i % 90) for i, t in enumerate(items + whole)], *[(t, "length", 160) for t in full], *doubtful]
    df = spark.createDataFrame([(i, "r", "m", "clash", ("m", [(("3",), s)], (n,)), [("3", "assistant", t)]) for i, (t, s, n) in enumerate(rows)], KIND)
    got = {r["rec_id"]: r for r in truncation.cut_messages(df).collect()}
    n = len(items) + len(whole)
    assert all(got[i]["is_cut"] for i in range(n, n + 40)) and not any(got[i]["is_cut"] for i in range(n))
    a, b, c, d = (got[n + 40 + i] for i in range(4))
    assert a["ending"] == b["ending"] and (a["is_cut"], b["is_cut"]) == (True, False) and (a["stop"], b["stop"]) == ("L", "s")
    assert c["ending"] == d["ending"] == "q" and (c["is_cut"], d["is_cut"]) == (True, False)


def test_stop_reason_of_its_own_choice(spark):
    m = truncation.inspected(spark.createDataFrame(records(LONG, LONG), KIND))
    assert {(r["rec_id"], r["role"]): (r["stop_reason"], r["output_tokens"]) for r in m.collect()} == {(0, "user"): (None, None), (0, "assistant"): ("stop", 5), (1, "user"): (None, None), (1, "assistant"): (None, None)}


def test_hidden_limits_and_lengths(spark):
    c = 'a<&"\n\\é😀'
    r = spark.createDataFrame([(c,)], "c string").select(truncation.lengths(F.col("c")).alias("l")).first()["l"]
    import html
    import json

    assert (r["chars"], r["utf8"], r["utf16"]) == (len(c), len(c.encode()), len(c.encode("utf-16-le")) // 2)
    assert r["html"] == len(html.escape(c, quote=True)) and r["json"] == len(json.dumps(c, ensure_ascii=False)) - 2 and r["json_ascii"] == len(json.dumps(c)) - 2 and r["crlf"] == len(c.replace("\n", "\r\n"))
    cut = [(LONG * 3 + f"{i} and so on and so on and so on")[:240] for i in range(12)]
    found = truncation.hidden_limits(truncation.inspected(spark.createDataFrame(records(*cut, *[LONG * k for k in range(1, 9)]), KIND)))
    assert ("chars", 240) in {(x["measure"], x["length"]) for x in found.collect()}


REVIEW = "review_id bigint, input string, defect string, sample_score struct<score:struct<prediction:string,extracted_prediction:string>,sample_metadata:string>"
EN, ES = "Explain why a heavy spoon could be useful in the attic and what it is for.", "Explica por qué una cuchara pesada sería útil en el sótano y para qué sirve."
GOOD, BIEN = "The spoon is of use because it is heavy and can hold the door for an hour.", "La cuchara es útil porque es pesada y puede sujetar la puerta durante una hora sin mucho esfuerzo."


def test_defects(spark):
    cases = [(EN, GOOD, None), (ES, BIEN, None), (EN, None, "empty"), (EN, "<think>so it is</think>", "empty"), (EN, "**Answer**:", "empty"), (EN, "A", None), (EN, EN.lower(), "copied_input"), (EN, EN + "\n" + EN, "copied_input"), (EN, EN + "\n\n" + GOOD + " " + GOOD, None),
             (EN, GOOD + " Then the", "truncated"), (EN, "I'm sorry, but I can't help with that.", "refusal"), (EN, "Hello! I cannot assist with this request. Let me know if there is anything else.", "refusal"), (EN, "I can't say which is best, but these stand out. " + GOOD, None), (ES, "Lo siento, no puedo ayudar con esa petición.", "refusal"),
             (EN, BIEN, "other_language"), (ES, GOOD, "other_language"), (EN + " Please answer in Spanish.", BIEN, None), (EN, "42", None), (None, GOOD, None), ("", "", "empty"), (EN, "word " * 50_000 + "end.", None)]
    cases += [(EN, GOOD.replace("spoon", f"spoon{i}"), None) for i in range(60)]
    rows = [(i, p, "clash", ((a, a), '{"lang":"es"}' if p == ES else None)) for i, (p, a, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, REVIEW)
    found = pairs.defects(df)
    assert {r["review_id"]: r["defect"] for r in pairs.main_defect(found).collect()} == {i: d for i, (*_, d) in enumerate(cases) if d}
    assert found.filter("posterior < cutoff").count() == 0
    assert pairs.defects(df.limit(0)).count() == 0


def test_long_refusals(spark):
    long = "Hello!\n" + "\n".join(f"- I cannot help with part {i} of this." for i in range(12)) + "\nPlease ask me for something else."
    cases = [(long, "refusal"), (long + "\n" + GOOD, None), *[(GOOD.replace("spoon", f"spoon{i}"), None) for i in range(60)], *[("I'm sorry, but I can't help with that.", "refusal")] * 4, (" ".join([GOOD] * 12), None)]
    df = spark.createDataFrame([(i, EN, "clash", ((a, a), None)) for i, (a, _) in enumerate(cases)], REVIEW)
    assert {r["review_id"]: r["defect"] for r in pairs.main_defect(pairs.defects(df)).collect()} == {i: d for i, (_, d) in enumerate(cases) if d}


@pytest.mark.parametrize(
    "prompt, asked", [(EN, set()), (EN + " Please answer in French.", {"fr"}), ("Translate from Spanish into German or English: hola", {"de", "en"}), ("请用英文回答。", {"en"}), ("Responde en francés y alemán.", {"fr", "de"}), ("Describe a French door.", set())]
)
def test_asked_languages(prompt, asked):
    assert pairs.asked_languages(prompt) == asked


def test_other_than_the_asked_language():
    words = {(k, w): 2 for k, t in (("en", EN), ("es", ES)) for w in t.lower().split()}
    votes = lambda p, a: pairs.votes(p, a, a, "en", pairs.Languages(words))["other_language"][:4]
    assert votes(EN + " Please answer in French.", BIEN)[0] == "1" and votes(EN + " Please answer in French.", "如果木勺比较脆弱,最好先固定再使用。") == "1-11"
    assert "1" not in votes(EN + " Please answer in Spanish.", BIEN) + votes(EN + " Please answer in Spanish or French.", BIEN) + votes(EN + " Please answer in French.", GOOD)


#: Worded unlike the given tables and the planted phrases.
REFUSED = [
    "Sadly, that falls outside the scope of what I can talk about.", "I won't be able to assist you with this one.", "I must decline to write that.", "This topic is off limits for me, so I cannot respond.", "Apologies, but providing such content is against our policy.",
    "Disculpa, pero no puedo ayudarte con ese tema.", "Me niego a responder a esa pregunta.", "Pardon, mais je ne peux pas traiter cette demande.", "Je dois décliner cette question.", "Entschuldigung, diese Anfrage kann ich nicht beantworten.", "Ich verweigere eine Antwort auf diese Frage.", "对不起,我不能回答您的问题。", "该内容违反规定,我拒绝协助。",
]
NOT_REFUSED = [
    "I can't decide between the two. " + GOOD + " It also keeps the rain out, and nobody has to carry it home.", "Sorry for the wait! " + GOOD + " " + GOOD, "The guard refused to open the door. He said that the rules were old. Then the spoon fell.", "No one could help the baker, so he asked the captain for a rope.", "It is against the wall, beyond the gate.",
    "I do not like to guess, so I counted: 1. Stir paint. 2. Dig holes. 3. Ring bells.", "Nadie pudo abrir la puerta y el panadero se fue a casa.", "Er konnte das Tor nicht öffnen und ging nach Hause.",
]


def test_reworded_refusals(spark):
    cases = [(EN, a, True) for a in REFUSED] + [(EN, a, False) for a in NOT_REFUSED] + [(EN, GOOD.replace("spoon", f"spoon{i}"), False) for i in range(200)]
    df = spark.createDataFrame([(i, p, "clash", ((a, a), None)) for i, (p, a, _) in enumerate(cases)], REVIEW)
    found = {r["review_id"] for r in pairs.defects(df).filter("defect = 'refusal'").collect()}
    want = {i for i, (*_, d) in enumerate(cases) if d}
    assert len(found & want) >= len(want) - 1 and not found - want, ([cases[i][1] for i in want - found], [cases[i][1] for i in found - want])


def test_hints_miss_no_phrase():
    """Sentences without a hint match none of the lists that the hints stand for."""
    said = [*REFUSED, *NOT_REFUSED, *[x for xs in pairs._REFUSALS.values() for x in xs]]
    for s in [x.lower() for x in said]:
        for part in (s[:k] + tail for k in range(4, len(s), 3) for tail in ("", ".", " i could")):
            if any(p.search(part) for p in (pairs._UNABLE, pairs._DECLINES, pairs._NORMS)):
                assert next(pairs._HINTS.iter(part), None) is not None, part


def test_no_single_function_decides():
    """Of the patterns of real and planted defects, few change sides when any one function is silenced."""
    for name in ("copied_input", "refusal", "other_language"):
        hit, false = pairs._RATES[name]
        k = len(hit)
        full = {"1" * k: 40, "0" * k: 1800} | {"0" * i + "1" + "0" * (k - i - 1): 5 for i in range(k)} | {"1" * i + "0" + "1" * (k - i - 1): 5 for i in range(k)}
        model = labelmodel.estimate(full, hit, false)
        flips = 0
        for i in range(k):
            for p, n in full.items():
                silent = p[:i] + "-" + p[i + 1 :]
                flips += n * ((labelmodel.score(model, silent) >= 0.5) != (model.posterior[p] >= 0.5))
        assert flips <= 0.02 * k * sum(full.values())


def test_validated_cutoff():
    c = {"11": 50, "10": 30, "00": 920}
    m = labelmodel.estimate(c, [0.9, 0.8], [0.01, 0.02])
    assert labelmodel.validated_cutoff(c, m, {"11": 60, "10": 40}) <= m.posterior["10"] < m.posterior["11"]
    assert labelmodel.validated_cutoff({}, m, {}) == 0.5


def test_models_and_cutoffs_come_from_all_pairs(spark, monkeypatch):
    words, planted, n = {}, {}, 4_500
    count, validate = pairs.word_counts, labelmodel.validated_cutoff
    monkeypatch.setattr(pairs, "word_counts", lambda *a: words.update(count(*a)) or words)
    monkeypatch.setattr(labelmodel, "validated_cutoff", lambda c, m, made: planted.setdefault(len(planted), made) and validate(c, m, made))
    rows = [(i, EN if i % 2 else ES, "clash", ((a := (GOOD if i % 2 else BIEN) + f" That is true of {i}.", a), '{"lang":"en"}' if i % 2 else '{"lang":"es"}')) for i in range(n)]
    assert pairs.defects(spark.createDataFrame(rows, REVIEW)).count() == 0
    assert words["en", "spoon"] == words["es", "cuchara"] == n // 2
    made = {d: sum(x.values()) for d, x in zip(pairs.DEFECTS, planted.values(), strict=True)}
    assert [made[d] for d in pairs.DEFECTS[:4]] == [n] * 4 and n - 8 <= made["other_language"] <= n  # a partition's first ones have no answer in another language before them


def test_label_model_learns_reliabilities():
    import random

    rng, counts, truth = random.Random(2), {}, {}
    for _ in range(5000):
        t = rng.random() < 0.1
        p = "".join("-" if rng.random() < 0.1 else str(int(rng.random() < (h if t else f))) for h, f in ((0.9, 0.02), (0.8, 0.05), (0.7, 0.3)))
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(t)
    post = labelmodel.fit(counts, [0.8, 0.8, 0.8], [0.1, 0.1, 0.1])
    cut = labelmodel.cutoff(counts, post)
    tp = sum(sum(truth[p]) for p in counts if post[p] >= cut)
    chosen, real = sum(counts[p] for p in counts if post[p] >= cut), sum(map(sum, truth.values()))
    assert 2 * tp / (chosen + real) > 0.75
    assert labelmodel.fit({}, [0.9], [0.1]) == {} and labelmodel.cutoff({}, {}) == 0.5

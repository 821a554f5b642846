import html
import random

import pytest

from graphloom.llm import leak

R = random.Random(11)
NAMES = [f"{a}{b}{c}" for a in ("open", "store", "walk") for b in ("Queue", "Shard", "Scene", "Token") for c in ("Fast", "Slow", "Cold")]


def question(r):
    a, b, c = r.sample(NAMES, 3)
    return f"Which step of {a} runs before {b} when the {r.choice(['lazy', 'final'])} binding has {r.randrange(100, 999)} waiting secrets? If somebody renames {c} to resolve_{r.choice('abc')}_layer, then {r.randrange(100, 999)} signed matrices and the test of {r.choice(NAMES)} break at once."


ITEMS = {k: question(R) for k in range(40)}
SPAN = " ".join(ITEMS[3].split()[:24])


def changed(text, every):
    words = text.split()
    return " ".join("other" if k % every == every - 1 else w for k, w in enumerate(words))


FORMS = {
    "whole": ITEMS[3],
    "inside": f"Lorem ipsum dolor.\n\n{SPAN} and then nothing else of it.",
    "case": SPAN.upper(),
    "layout": SPAN.replace(" ", "\n> "),
    "markup": "<p>" + " ".join(f"<b>{w}</b>" for w in SPAN.split()) + "</p>",
    "markdown": " ".join(f"**{w}**" if k % 3 else f"`{w}`" for k, w in enumerate(SPAN.split())),
    "json": '{"text": "' + SPAN.replace(" ", "\\n") + '"}',
    "entities": html.escape(SPAN).replace(" ", "&nbsp;"),
    "numeric entities": "".join(f"&#{ord(c)};" for c in SPAN),
    "unicode escapes": SPAN.replace("e", "\\u0065"),
    "invisible": "".join(c + "\u200b" if c == "e" else c + "\u00ad" if c == "n" else c for c in SPAN),
    "hyphens": SPAN.replace("waiting", "wai-\nting").replace("before", "be-\n   fore"),
    "full width": "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in SPAN),
    "quotes": SPAN.replace(" ", "\u00a0").replace("?", "\u2019 \u2014 "),
    "changed": changed(SPAN, 8),
    "left out": " ".join(w for k, w in enumerate(ITEMS[3].split()) if k % 9 != 4),
    "added": " ".join(w + (" really" if k % 7 == 3 else "") for k, w in enumerate(ITEMS[3].split())),
    "long": "word " * 60_000 + SPAN + " word" * 60_000,
}
OTHERS = {
    "quote": " ".join(ITEMS[3].split()[:9]),
    "same build": question(random.Random(99)),
    "symbols": " ".join(f"Does {n} still need it?" for n in NAMES),
    "scattered": " ".join(w + " x y z" for w in ITEMS[3].split()),
    "null": None,
    "empty": "",
    "blank": " \n\t ",
}


def table(spark, texts):
    return spark.createDataFrame([(n, t, "x") for n, t in texts.items()], "doc_id string, text string, item_id string")


def items(spark):
    return spark.createDataFrame([(k, t) for k, t in ITEMS.items()] + [(3, ITEMS[3]), (777, None), (778, ""), (779, "!!!")], "item_id long, query_text string")


def test_forms(spark):
    got = sorted((r.doc_id, r.item_id) for r in leak.find_leaks(table(spark, FORMS | OTHERS), items(spark)).collect())
    assert got == sorted((n, 3) for n in FORMS)


def test_passes_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(leak, "PASS_CHARS", 2000)
    got = sorted((r.doc_id, r.item_id) for r in leak.find_leaks(table(spark, FORMS), items(spark)).collect())
    assert got == sorted((n, 3) for n in FORMS)


def test_items_that_share_all_words(spark):
    same = spark.createDataFrame([(k, ITEMS[5]) for k in range(9)], "item_id long, query_text string")
    got = leak.find_leaks(spark.createDataFrame([(1, ITEMS[5])], "doc_id long, text string"), same)
    assert sorted(r.item_id for r in got.collect()) == list(range(9))


def test_short_items_and_empty_tables(spark):
    short = spark.createDataFrame([(1, "rename openQueueFast before the lazy shard of walkSceneCold breaks")], "item_id long, query_text string")
    docs = spark.createDataFrame([(1, "We rename openQueueFast before the lazy shard of walkSceneCold breaks."), (2, "rename openQueueFast before")], "doc_id long, text string")
    assert [r.doc_id for r in leak.find_leaks(docs, short).collect()] == [1]
    assert leak.find_leaks(docs.limit(0), short).count() == 0 and leak.find_leaks(docs, short.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_search_finds_what_comparison_of_all_runs_finds(seed):
    import numpy as np

    r = random.Random(seed)
    pool = [f"w{k}" for k in range(60)]
    own = {k: " ".join(r.choice(pool) for _ in range(30)) for k in range(6)}
    docs = [" ".join(r.choice(pool) for _ in range(300)) if k % 2 else " ".join(r.choice(pool) for _ in range(50)) + " " + own[k % 6] + " tail" for k in range(12)]
    table = leak.Patterns.build(list(own.items()))
    raw = [d.encode() for d in docs]
    found = leak.search_chunk(table, np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.cumsum([0, *(len(x) + 1 for x in raw)]), 20, 0.8, 3)
    want = {(t, k) for t, d in enumerate(docs) for k, q in own.items() if f" {q} " in f" {d} "}
    assert {(t, table.names[i]) for t, i, *_ in found} == want and want


@pytest.mark.parametrize("many", [3, 4, 10, 100])
def test_passages_that_many_items_share(spark, many):
    r = random.Random(many)
    words = [f"{a}{b}" for a in ("river", "market", "winter", "engine", "garden") for b in ("", "s", "like", "side", "ward", "hood", "ing", "ed")]
    passage = " ".join(r.choice(words) for _ in range(60))
    own = spark.createDataFrame([(k, f"{passage} Question {k}: which {r.choice(words)} of number {k} did the {r.choice(words)} see in year {1700 + k}?") for k in range(many)], "item_id long, query_text string")
    docs = spark.createDataFrame([(1, f"Before it. {passage} After it."), (2, "Before. " + " ".join(passage.split()[10:34]) + " after."), (3, "Question 2: which garden of number 2 did nobody see"), (4, " ".join(passage.split()[:9]))], "doc_id long, text string")
    got = sorted((x.doc_id, x.item_id) for x in leak.find_leaks(docs, own).collect())
    assert got == sorted((d, k) for d in (1, 2) for k in range(many))


def altered(r, words, rate):
    """Words with each changed, left out or followed by another one at a rate."""
    out = []
    for w in words:
        x = r.random()
        out += [r.choice(("certain", "minor", "maybe"))] if x < rate / 3 else [] if x < 2 * rate / 3 else [w, r.choice(("rather", "quite"))] if x < rate else [w]
    return out


def test_recall_of_random_alterations_not_used_for_tuning(spark):
    r = random.Random(2024)
    verbs, things = "opens closes moves keeps drops sorts merges copies".split(), "buffer ticket ledger bridge packet corner letter window signal harbor".split()
    sentence = lambda: f"The {r.choice(things)} of unit {r.randrange(9999)} {r.choice(verbs)} every {r.choice(things)} that {r.choice(('Ada', 'Bo', 'Cy', 'Di'))}{r.randrange(99)} left near {r.choice(things)} {r.randrange(999)}."
    own = {k: " ".join(sentence() for _ in range(4)) for k in range(300)}
    docs, want = [], {}
    for d in range(400):
        k, rate = r.randrange(300), (0.05, 0.1, 0.15)[d % 3]
        words = own[k].split()
        cut = r.randrange(0, len(words) - 30)
        docs.append((d, " ".join([sentence() for _ in range(3)] + altered(r, words[cut : cut + 30], rate) + [sentence() for _ in range(3)])))
        want[d] = (k, rate)
    docs += [(1000 + d, " ".join(sentence() for _ in range(12))) for d in range(400)]
    found = {(x.doc_id, x.item_id) for x in leak.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(own.items()), "item_id long, query_text string")).collect()}
    recall = {rate: sum((d, k) in found for d, (k, x) in want.items() if x == rate) / sum(x == rate for _, x in want.values()) for rate in (0.05, 0.1, 0.15)}
    wrong = [x for x in found if want.get(x[0], (None,))[0] != x[1]]
    print("recall", recall, "wrong", len(wrong), "of", len(found))
    assert min(recall[0.05], recall[0.1]) >= 0.9 and sum((d, k) in found for d, (k, _) in want.items()) >= 0.9 * len(want)
    assert len(wrong) <= 0.02 * len(found)  # sentences of one build that agree in most of their content


def test_prose_in_comments_and_attributes(spark):
    docs = spark.createDataFrame([(1, f"<p>x</p><!-- {SPAN} -->"), (2, f'<img src="a.png" alt="{SPAN}">'), (3, f'<a href="https://{"x/" * 200}">' + SPAN.replace(" ", f' <i data-a="{"y" * 300}">&nbsp;</i>'))], "doc_id long, text string")
    assert sorted({(r.doc_id, r.item_id) for r in leak.find_leaks(docs, items(spark)).collect()}) == [(1, 3), (2, 3), (3, 3)]


def test_shifts_skip_and_lose_nothing():
    import numpy as np

    r = random.Random(4)
    pool = [f"w{k}" for k in range(300)]
    table = leak.Patterns.build([(k, " ".join(r.choice(pool) for _ in range(40))) for k in range(5)])
    assert set(np.unique(table.shift).tolist()) == {0, 1, 2}
    words = [w for k in range(5) for w in table.words(k)] + [r.choice(pool) for _ in range(5000)]
    raw = np.frombuffer(" ".join([*words, ""]).encode(), np.uint8)
    edge = np.cumsum([0, *(len(w) + 1 for w in words)])
    h = leak.word_hashes(raw, edge[:-1], edge[1:] - 1)
    begin, where = table.occurrences(leak.blocks(h), h)
    runs = {tuple(table.words(k)[i : i + 3]) for k in range(5) for i in range(38)}
    assert begin.tolist() == [i for i in range(len(words) - 2) if tuple(words[i : i + 3]) in runs]

import random

import pytest

from inspectra.llm import leakage as k

PASSAGE = "No chalky socket rivalled the coastal vat below a second damp crock unless every pickled ferment steamed another amber funnel. Their parsley tainted another feral waiver."


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "no long, body string, text string")
    e = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(items)], "it long, passage string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in k.leaked_items(d, e, doc_id="no", text="body", item_id="it", passage="passage", **kw).collect()}


@pytest.mark.parametrize("text", [
    PASSAGE.upper(), PASSAGE.replace(" ", "\n"), PASSAGE.replace("coastal", "coas-\ntal"), "<p>" + PASSAGE.replace("second", "<b>second</b>") + "</p>", PASSAGE.replace(".", "").replace("chalky", "“chálky”"), "Before. " + PASSAGE + " After.",
    PASSAGE.replace("pickled", "pick­led").replace("&", "&amp;"), " ".join(PASSAGE.split()[:12]),
])
def test_forms_of_a_passage(spark, text):
    assert _leaks(spark, [text], [PASSAGE]) == {(0, 0)}


def test_too_little_or_too_scattered(spark):
    words = PASSAGE.split()
    scattered = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    assert _leaks(spark, [" ".join(words[:9]), scattered, "", None, "nothing of it"], [PASSAGE, "", None, "three words only"]) == set()


def test_runs_add_up_and_repeats_count_once(spark):
    w = PASSAGE.split()
    assert _leaks(spark, [" ".join(w[:6] + ["x"] + w[8:13] + ["y"]), " ".join(w[:5] + ["x"]) * 4], [PASSAGE]) == {(0, 0)}


def test_long_texts_cross_windows_and_blocks(spark, monkeypatch):
    filler = "filler word of no use " * 6000
    docs = [filler + PASSAGE + filler, filler]
    items = [PASSAGE, "Another passage that is also looked for in every single document of the corpus", PASSAGE]
    assert _leaks(spark, docs, items, block_chars=100) == {(0, 0), (0, 2)}


def test_empty(spark):
    assert _leaks(spark, [], [PASSAGE]) == set() and _leaks(spark, [PASSAGE], []) == set()


def test_against_brute_force():
    rng = random.Random(3)
    vocab = ["a", "bb", "ccc", "the", "of", "pan", "lid", "oven"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 14)))) for i in range(25)]
    index = k.ItemIndex(items)
    for _ in range(60):
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        want = {}
        for i, text in items:
            own = text.split()
            mask = [False] * len(own)
            for s in range(len(own) - k.RUN + 1):
                if any(own[s : s + k.RUN] == doc[j : j + k.RUN] for j in range(len(doc) - k.RUN + 1)):
                    mask[s : s + k.RUN] = [True] * k.RUN
            if any(mask):
                want[i] = mask
        assert {index.ids[n]: list(m) for n, m in index.search(doc).items()} == want

import random

from inspectra.llm import spam

TALK = [
    "The inspector opened the prep line and found that the soup had passed its date.", "Guests at the long bench noticed nothing of it.",
    "A neighbour wrote that the back yard smelled of gas for three weeks.", "After the second visit the owner kept a log of the ice room.",
    "The licence of the corner house moved to a new holder this spring.", "Nobody could say why the hand sink of the bar had no soap.",
    "We ate there last August, and the fish was better than the rice.", "By ten in the evening a cook had ordered a new gasket for the cooler.",
    "Keep raw stock and cream apart, since one of them is eaten without cooking.", "The district lists seven places with an open follow-up.",
    "My landlord thinks that the rule about melon is more work than planned.", "Two citations were marked critical during the first walk through the store.",
]
KEYS = ["sushi", "pizza", "coupon", "takeout", "brunch", "vegan", "ramen", "catering"]
rng = random.Random(1)


def _words(n, f):
    return [f(rng.choice(KEYS), rng.choice(KEYS)) for _ in range(n)]


def _talk(n):
    """Running text that changes its numbers, dates and things, as reports do."""
    thing = lambda: rng.choice("ladle hatch drawer basin shelf ladder kettle bucket oven crate tray counter lamp mixer grill slab rack".split())
    return " ".join(f"{rng.choice(TALK)[:-1]} near the {thing()} and the {thing()}." for _ in range(n))


SPAM = {
    "tags": " ".join(_words(60, lambda a, b: f"#{a}{b}life #{a}")),
    "links": "\n".join(_words(40, lambda a, b: f"https://www.{b}menus.test/{a}/{b}{rng.randint(1, 99)}")),
    "anchors": " ".join(_words(30, lambda a, b: f'<a href="http://x{rng.randint(1, 99)}.test/{a}">{b} Lakeside</a>')),
    "sentences": " ".join(f"Our sushi in Lakeside is sushi for everyone in Lakeside. Call sushi Lakeside now. Best sushi Lakeside, sushi near Lakeside, sushi Lakeside {k}." for k in KEYS * 2),
    "list": "; ".join(_words(90, lambda a, b: a)), "joined": " ".join(_words(60, lambda a, b: a.title() + b.title())),
    "products": ", ".join(_words(60, lambda a, b: f"golden {a} set sku{rng.randint(100, 999)}")),
    "unseen": " ".join(rng.choice("zorp quax mivel trane blosh kerd wimp fyle".split()) for _ in range(200)),
    "mixed": _talk(4) + "\n\n" + " ".join(_words(90, lambda a, b: f"#{a} #{b}")),
}
FINE = {
    "few tags": _talk(8) + "\n\n#sushi #pizza https://x.test/sushi",
    "table": "Code | Finding | Flag | Points\n" + "\n".join(f"0{i}A | {rng.choice(TALK)[4:40]} | Not Critical | {i}" for i in range(30)),
    "checklist": "Opening checklist\n" + "\n".join(f"[ ] {rng.choice(TALK)[4:36]} (station {i})" for i in range(30)),
    "guidance": " ".join(f"Record the {s} of the {p} before opening, and write the {s} next to the {q}." for s, p, q in zip(
        "sanitiser heat time date".split() * 3, "bench line room yard store cellar".split() * 2, "tofu rice soup ham fish cream butter".split() * 2)),
    "upper": _talk(6).upper(), "empty": "", "null": None, "signs": "... !!! ???",
} | {f"talk {i}": _talk(rng.randint(3, 24)) for i in range(150)}


def _docs(spark, texts):
    return spark.createDataFrame([(n, t, "clash") for n, t in texts], "name string, body string, doc_id string")


def test_spam_and_pages_that_inform(spark):
    got = {r["doc_id"] for r in spam.spam_pages(_docs(spark, [*SPAM.items(), *FINE.items()]), "name", "body").collect()}
    assert got == set(SPAM)


def test_compression_alone_finds_pages_of_words_seen_nowhere_else(spark):
    docs = _docs(spark, [*SPAM.items(), *FINE.items()])
    got = {r["doc_id"] for r in spam.spam_pages(docs, "name", "body", words=False).collect()}
    assert {"unseen", "list", "sentences", "tags"} <= got <= set(SPAM)


def test_a_sample_of_documents_suffices_for_the_words(spark):
    docs = _docs(spark, [(f"{k} {i}", t) for i in range(6) for k, t in [*SPAM.items(), *FINE.items()]])
    got = {r["doc_id"] for r in spam.spam_pages(docs, "name", "body", sample_docs=300).collect()}
    assert {g.rsplit(" ", 1)[0] for g in got} <= set(SPAM) and len(got) >= 0.9 * 6 * len(SPAM)


def test_words_are_learnt_from_every_document(spark):
    """More documents than the 20,000 that words were once learnt from."""
    long = spark.range(20_400).selectExpr("id AS i", "concat('The cook kept a log of the ice room on day x', translate(id, '0123456789', 'abcdefghij'), '. It was fine.') AS t")
    redundant = spark.createDataFrame([(-1, SPAM["unseen"])], "i long, t string")
    each = spam.measured_blocks(long.unionByName(redundant), "i", "t")
    assert each.where("terms IS NULL").count() == 0 and each.count() == 20_401
    weights = spam.word_weights(each.selectExpr("*", "IF(doc_id < 0, 0.1, 1.0) AS relative"))
    seen = {spam.slot("x" + str(i).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(20_400)}
    assert all(weights[s] != 0 for s in seen)


def test_empty_table_and_repeated_rows(spark):
    assert spam.spam_pages(spark.createDataFrame([], "i long, t string"), "i", "t").count() == 0
    docs = spark.createDataFrame([(1, SPAM["unseen"])] * 2 + [(2, _talk(9))] + [(i, _talk(12)) for i in range(3, 60)], "i long, t string")
    assert [r["doc_id"] for r in spam.spam_pages(docs, "i", "t").collect()] == [1]


def test_long_text_without_breaks(spark):
    docs = spark.createDataFrame([(1, "word" * 50_000), (2, "a b c " * 30_000)], "i long, t string")
    assert spam.spam_blocks(docs, "i", "t").count() > 300


def test_blocks_hold_all_words():
    text = "\n\n".join([_talk(3), "x " * 700, "one. two. three.", "OneTwoThree" * 200, "- : -"])
    found = spam.blocks(text)
    assert [w for _, ws, _ in found for w in ws] == spam.words_of(text)
    assert all(len(ws) <= spam.BLOCK_WORDS for _, ws, _ in found)


def test_words():
    assert spam.words_of("GradeADeal http://shop.x-eats.test/late-night48 DÉJÀ vu №7") == ["grade", "a", "deal", "link", "late", "night", "déjà", "vu"]
    assert spam.language("la casa de la luz".split()) != "en" and spam.language("zorp quax".split()) == "und"

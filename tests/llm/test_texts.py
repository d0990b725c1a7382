import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lumenfold.llm import leaks, mixing, quality

DOCS = "doc_id long, text string, source string"
ITEMS = "item_id long, item_text string"


def item(n, name, number):
    return f"Review: the operator named {name} claims {number} copies of anvil {n} were sealed carefully although the sawmill logs from {name} disagree."


def test_leaks(spark, tables):
    items = [(1, item(1, "Ulnar", 52)), (2, "too short an item"), (3, None), (4, item(1, "Ulnar", 52) + " And then more words follow here."), (5, "Zed Yod Xan 1 2 3 Wim Vor Uth 4 5 6 Tol Sib")]
    a = items[0][1]
    docs = [
        (1, "before\r\n" + a.upper().replace(" ", "\n\t") + " after"), (2, item(1, "Bexpi", 99)), (3, item(1, "Bexpi", 99).replace("from Bexpi", "from Quakawem")), (4, " ".join(re.findall(r"\w+", a)[3:15])), (5, " ".join(re.findall(r"\w+", a)[3:14])),
        (6, None), (7, ""), (8, "x " * 300_000 + a), (9, a), (10, a), (11, "zed yod xan 1 2 3 wim vor uth 4 5 6 tol"), (12, "aaa bbb ccc 1 2 3 ddd eee fff 4 5 6 ggg hhh"), (13, "Kelvin " + a),
    ]
    tables("eval_items", items, ITEMS)
    tables("documents", [(i, t, "s") for i, t in docs], DOCS)
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    want = sorted((i, d) for i, t in items for d, x in docs if grams(t) & grams(x))
    assert sorted(rows(leaks.p7_found(spark, tables.dir))) == want and (1, 8) in want and (5, 11) in want
    templates = {(r.item_id, r.doc_id): r for r in leaks.p7_templates(spark, tables.dir).collect()}
    assert (1, 2) in templates and templates[(1, 2)].slots == 2 and (1, 3) not in templates and (1, 9) not in templates and (5, 12) not in templates


QUESTION = "A train leaves {a} at noon and travels {n} {u} before it reaches the station in {b}. The driver of the train then returns to {a} by the same road, which takes {m} hours longer. How far is the station from the sea if {a} lies {n} {u} away?"


def test_other_values_in_a_question(spark, tables):
    """Planted copies with other numbers, units and names are found, those whose values do not map one to one are not."""
    ask = lambda **v: QUESTION.format(**{"a": "Ulnar", "b": "Bexpi", "n": "12", "u": "km", "m": "3"} | v)
    planted = [
        (1, ask(n="15", m="4")), (2, ask(n="twelve", u="miles")), (3, ask(n="3.5", m="twenty two")), (4, ask(a="Zemost Dra", b="Quakawem")), (5, ask(n="15", u="").replace("15 ", "15km")),
        (6, "Some words before. " + ask(n="40", a="Zemost Dra Quakawem").upper()), (7, ask()), (8, ask(a="Bexpi")), (9, ask(n="15").replace("lies 15", "lies 16")), (10, ask(n="15").replace("train", "coach")), (11, None),
    ]
    tables("documents", [(i, t, "s") for i, t in planted], DOCS)
    tables("eval_items", [(1, ask()), (2, ask(n="12kg", u="of flour"))], ITEMS)
    got = {r.doc_id: r for r in leaks.p7_templates(spark, tables.dir).filter("item_id = 1").collect()}
    assert {1, 2, 3, 4, 5, 6} <= set(got) and not {7, 8, 9, 11} & set(got)
    assert got[1].slots == 2 and got[4].slots == 2
    # What a word stands for does not depend on the items.
    plain = leaks.plain_words(mixing.tokenizer_path())
    slots = [leaks.Canon(plain).slot(w) for w in ("12", "twelve", "12kg", "kg", "12x", "ulnar", "station", "paris")]
    assert slots == [leaks.NUMBER, leaks.NUMBER, leaks.MEASURE, leaks.UNIT, leaks.NAME, leaks.NAME, 0, leaks.NAME]


def test_leaks_blocks_and_empty(spark, tables, monkeypatch):
    tables("eval_items", [(i, item(i, "Ulnar", i)) for i in range(30)], ITEMS)
    tables("documents", [(i, item(i, "Ulnar", i), "s") for i in range(40)], DOCS)
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 50)  # more items than one pass holds
    assert sorted(rows(leaks.p7_found(spark, tables.dir))) == [(i, i) for i in range(30)]
    monkeypatch.setattr(leaks, "SMALL_WINDOWS", 10)  # and more than are broadcast
    assert sorted(rows(leaks.p7_found(spark, tables.dir))) == [(i, i) for i in range(30)]
    tables("documents", [], DOCS)
    assert rows(leaks.p7_found(spark, tables.dir)) == []
    tables("eval_items", [], ITEMS)
    tables("documents", [(1, item(1, "a", 1), "s")], DOCS)
    assert rows(leaks.p7_found(spark, tables.dir)) == [] and rows(leaks.p7_templates(spark, tables.dir)) == []


PROSE = "The people of the town and their friends went to the market in the morning, and it was a good day for all of them. " * 3


def test_quality(spark, tables):
    texts = {
        1: PROSE, 2: None, 3: "", 4: " \t\r\n ", 5: "word", 6: "\n".join("| %d | %s | %d |" % (i, "ab" * (i % 3 + 1), i) for i in range(12)), 7: "\n".join(f"- item {i} of the list" for i in range(12)),
        8: "def f(x):\n    return g(x)[0]\n\nclass A:\n    def h(self):\n        self.x = {}\n    def k(self):\n        return self.x['a'] + 1\n", 9: "###~~~***" * 5000, 10: PROSE.replace(" ", "\r\n"), 11: PROSE * 2000, 12: "the " * 24 + "end.", 13: "the " * 23 + "end.", 14: "\u00a0" + PROSE,
    }
    tables("documents", [(i, t, "s") for i, t in texts.items()], DOCS)
    tables("common_words", [("en", w) for w in "the of and in to it was a for all them their".split()] + [("en", None), (None, "")], "lang string, word string")
    kinds = {r.doc_id: r.kind for r in quality.p9_kinds(spark, tables.dir).collect()}
    assert [kinds[i] for i in (1, 2, 3, 4, 6, 7, 8, 9, 11)] == ["prose", "empty", "empty", "empty", "table", "list", "code", "junk", "prose"]
    found = {r[0] for r in rows(quality.p9_found(spark, tables.dir))}
    assert found == {2, 3, 4, 5, 6, 7, 8, 9, 10, 13}
    extra = quality.statistics(spark.createDataFrame([(1, PROSE, "x", 5.0)], "doc_id long, text string, kind string, n_words double"), "text", spark.createDataFrame([("the",)], "w string"), "w").first()
    assert extra.kind == "mixed" and extra.n_words == 75
    tables("documents", [], DOCS)
    assert rows(quality.p9_found(spark, tables.dir)) == []


def test_layout_figures():
    import numpy as np

    assert quality.period(np.array([0, 4, 0, 4, 0, 4, 0, 4.0])) > 0.6 and quality.period(np.zeros(9)) == 0.0
    assert quality.alignment(["a,b,c", "d,e,f", "g,h,i"]) == 1.0 and quality.alignment(["a", "b"]) == 0.0
    wide = ",".join("x" * i for i in range(1, 200))
    assert quality.alignment([wide, "yy" + wide, wide]) == 1.0  # delimiters beyond any number count
    assert [quality.marker(s) for s in ("- a", "  * b", "12. c", "9) d", "[x] e", "-flag", "2024 was", "", "(a) f", "• g")] == [("-", 0), ("*", 2), (".", 1), (")", 1), ("[", 0), None, None, None, None, ("•", 0)]


def test_kinds_of_planted_layouts(spark):
    """Tables and lists are told by their layout, whatever their delimiters and markers; prose with such marks inside is not one."""
    word = lambda i: "abcdefghij"[: 2 + i % 7]
    texts = {
        "table": ["\n".join(f"{word(i)};{i};{word(i + 3)};x" for i in range(20)), "\n".join(f"{word(i)}\t{i * 7}\t{word(i)}" for i in range(9)), "\n".join(f"| {word(i):10} | {i:4} |" for i in range(30))],
        "list": ["\n".join(f"{i + 1}. {word(i)} {word(i + 2)}" for i in range(14)), "\n".join(f"{'  ' * (i % 3)}* {word(i)}" for i in range(12)), "To do\n" + "\n".join(f"[{'x' if i % 2 else ' '}] {word(i)} {word(i + 1)}" for i in range(8)), "\n".join(f"• {word(i)}" for i in range(10))],
        "prose": [PROSE, "- " + PROSE, PROSE.replace("town", "town, city")],
    }
    rows_ = [(k, t) for k, ts in texts.items() for t in ts]
    common = spark.createDataFrame([(w,) for w in "the of and in to it was a for all them their".split()], "w string")
    for all_ in (True, False):
        got = quality.statistics(spark.createDataFrame(rows_, "want string, text string"), "text", common, "w", all_).select("want", "kind").collect()
        assert all(r.want == r.kind for r in got) and len(got) == len(rows_)


@pytest.fixture
def corpus():
    random.seed(1)
    sources = ["big"] * 300 + ["Mid "] * 80 + ["small"] * 12 + [None] * 3
    return [(i, " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(random.randint(1, 120))), s) for i, s in enumerate(sources)] + [(9000, "", "small"), (9001, None, "big"), (9002, "y " * 50_000, "long")]


TARGETS = "mix_id int, source string, target_share double, max_repeats int"


def test_mixing(spark, tables, corpus):
    tables("documents", corpus, DOCS)
    tables("mix_targets", [(1, "BIG", 50.0, 1), (1, "mid", 30.0, None), (1, " small", 20.0, 4), (2, "big", 0.5, 2), (2, "none", 0.3, 2), (2, "mid", 0.5, None), (3, "small", None, 2), (3, "big", 1.0, 0)], TARGETS)
    copies = mixing.p8_repeats(spark, tables.dir).cache()
    report = {(r.mix_id, r.source): r for r in mixing.p8_shares(spark, tables.dir).collect()}
    total = {s: sum(r.tokens for r in mixing.token_counts(spark.createDataFrame(corpus, DOCS).filter(F.trim(F.lower("source")) == s), "text", mixing.tokenizer_path(), mixing.tokenizer_pattern()).collect()) for s in ("big", "mid", "small")}
    assert all(report[(1, s)].available_tokens == t for s, t in total.items())
    small = report[(1, "small")]
    assert small.max_copies == 4 and small.mixed_tokens == 4 * total["small"]  # wanted more than its cap allows
    assert {r.copies for r in copies.filter("mix_id = 1 AND source = 'small'").collect()} == {4} and copies.filter("copies > 1 AND mix_id = 1 AND source = 'big'").count() == 0
    assert abs(report[(2, "big")].actual_share - 0.5) < 0.06 and report[(2, "none")].mixed_tokens == 0 and report[(2, "none")].target_share == 0
    assert (3, "small") in report and copies.filter("mix_id = 3").count() == 0
    assert copies.filter("doc_id IN (9000, 9001)").count() == 0
    assert sorted(rows(copies)) == sorted(rows(mixing.p8_repeats(spark, tables.dir)))
    assert all(all(r[3:]) for r in rows(mixing.p8_checked(spark, tables.dir)))


def test_scale_fills_the_wanted_tokens(spark):
    """c by running sums is the root that halving an interval finds, with and without documents at the cap."""
    from collections import namedtuple

    target = namedtuple("Target", "mix_id source share cap available wanted")
    sizes = [1, 1, 2, 3, 5, 8, 13, 400, 400, 90_000]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(sizes)], "doc_id long, source string, tokens long").withColumn("weight", F.pow("tokens", F.lit(0.5)))
    for mix, (cap, wanted) in enumerate([(1.0, 500.0), (2.0, 181_000.0), (3.0, 3.0), (float("inf"), 1e7), (1.0, 90_833.0), (4.0, 1e9)]):
        got = mixing.scale(docs, [target(mix, "s", 1.0, cap, sum(sizes), wanted)])[mix, "s"]
        filled = sum(min(cap, got * t**0.5) * t for t in sizes)
        assert abs(filled - min(wanted, cap * sum(sizes))) < 1e-6 * wanted


def test_inclusion_odds(spark):
    """Over many seeds every document is drawn about as often as its inclusion odds say, and the sample size is fixed."""
    docs = spark.createDataFrame([(i, "s", 10 * (1 + i % 4)) for i in range(40)] + [(100 + i, "t", 30) for i in range(60)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "s", 0.15, 9), (1, "t", 0.85, 9)], TARGETS)
    seen, sizes = {}, set()
    for seed in range(12):
        out = mixing.repeats(docs, targets, seed=seed, exponent=0.5)[0].filter("source = 's'").collect()
        sizes.add(sum(r.copies for r in out))
        for r in out:
            seen[r.doc_id % 4] = seen.get(r.doc_id % 4, 0) + r.copies
    assert len(sizes) == 1 and seen[0] < seen[3]


def test_tokens_of_long_texts(spark):
    text = "some words " * 150_000
    df = spark.createDataFrame([(1, text, "s")], DOCS)
    n = mixing.token_counts(df, "text", mixing.tokenizer_path(), mixing.tokenizer_pattern()).first().tokens
    assert n == 300_001 or n == 300_000
    assert list("".join(mixing.pieces(text))) == list(text)


def test_mixing_empty(spark, tables):
    tables("documents", [], DOCS)
    tables("mix_targets", [(1, "a", 1.0, 1)], TARGETS)
    assert rows(mixing.p8_repeats(spark, tables.dir)) == [] and len(rows(mixing.p8_shares(spark, tables.dir))) == 1
    tables("mix_targets", [], TARGETS)
    assert rows(mixing.p8_shares(spark, tables.dir)) == []

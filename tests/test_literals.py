"""The index of literals gives what the expressions give, for any number of rules and domains."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import literals, rules

RULES = "kind string, category string, subcategory string, pattern string, priority int"
WORDS = "orlen shell stacja paliw biedronka lidl kredyt raty pozyczka zaklad casino bet kantor bitcoin szkola apteka karta blik".split()


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("orlen", ["orlen"]), ("(?:orlen|shell)", ["orlen", "shell"]), (r"\bnetflix\b", ["netflix"]), ("a|bcd", None), ("ab", None), (r"kod \d+ blik", [" blik"]), ("(abc)?def", ["def"]), ("(abc)+x", ["abc"]),
        (r"\p{L}+", None), (".*", None), ("", None), ("[abc]def", ["def"]), ("x{0,3}stacja", ["stacja"]), ("(?:ab|cd)efg(?:hi|jk)", ["efg"]), ("Łódź", ["łódź"]), ("(?<n>abc)", None), ("(unclosed", None),
    ],
)
def test_necessary_literals(pattern, want):
    assert literals.necessary(pattern) == want


def test_every_match_contains_a_necessary_literal():
    rng = random.Random(1)
    bits = ["orl", "en", "she?ll", "[ab]", r"\d", ".", "bet", "(?:raty|kredyt)", "(lidl)?", "x+", r"\s", "|", "stacja", "^", "$"]
    for _ in range(4000):
        p = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        text = "".join(rng.choice(["orlen", "shell", "shel", "a", "b", "7", "bet", "raty", "kredyt", "lidl", "xx", " ", "stacja"]) for _ in range(rng.randint(0, 6)))
        need = literals.necessary(p)
        if need and re.search(p, text, re.IGNORECASE):
            assert any(s in text for s in need), (p, text)


def notes(spark, n=400):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([*WORDS, "Żabka", "KREDYT", "łódź", "7"]) for _ in range(rng.randint(0, 5))), rng.choice([None, "blacklist", "whitelist"]), [f"https://www.shop{rng.randrange(6000)}.example/x" for _ in range(rng.randrange(3))]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None, None)], "tx_id long, title string, label string, urls array<string>").repartition(4)


def some_rules(rng, n):
    word = lambda: rng.choice(WORDS)
    pattern = lambda: rng.choice([word(), f"{word()}|{word()}", f"{word()} {word()}", word()[:2], rf"\b{word()}\b", f"{word()[:4]}.*{word()[:3]}", rf"\d {word()}"])
    return [(rng.choice(["category", "category", "risk"]), rng.choice("abcd"), rng.choice("xyz"), pattern(), rng.randrange(9)) for _ in range(n)]


def test_both_ways_of_the_rule_engine_agree(spark):
    rng, t = random.Random(3), notes(spark)
    own = spark.createDataFrame(some_rules(rng, 60), RULES)
    sites = spark.createDataFrame([(f"shop{i}.example", rng.choice("abe"), "online") for i in range(0, 150)] + [("shop1.example", "a", "other"), (None, "x", "y")], "domain string, category string, subcategory string")
    shops = spark.createDataFrame([(rng.choice(WORDS), f"name{i}", rng.choice("mn"), "s", rng.randrange(5)) for i in range(20)], "pattern string, name string, category string, subcategory string, priority int")
    run = lambda few: rules.classify(t, own, "tx_id", "title", {"A": 7, "RISK_B": 5}, "urls", sites, shops, "label", few=few)
    one, two = (sorted(map(tuple, run(few).collect())) for few in (10_000, 0))
    assert one == two and len(one) == 401 and len({r[1] for r in one}) > 4


def test_both_ways_of_labels_and_merchants_agree(spark):
    rng, t = random.Random(4), notes(spark)
    own = spark.createDataFrame([(rng.choice("abcde"), rng.choice(["company", "", None]), r[3]) for r in some_rules(rng, 40)], "label string, entity_type string, pattern string")
    shops = spark.createDataFrame([(rng.randrange(3), f"name{i}", "c", rng.choice([w, w.upper(), w[:2]])) for i, w in enumerate(WORDS)], "priority int, name string, category string, pattern string")
    for run in (lambda few: rules.all_labels(t, own, "tx_id", "title", few=few), lambda few: rules.merchant_of(t, shops, "tx_id", "title", few=few)):
        one, two = (sorted(map(str, run(few).collect())) for few in (10_000, 0))
        assert one == two and len(one) == 401


def test_thousands_of_domains_and_rules(spark):
    """No domain and no rule is left out, however many there are."""
    n = 5_200
    t = spark.range(n).select(F.col("id").alias("tx_id"), F.concat(F.lit("payment code"), F.col("id").cast("string"), F.lit("z")).alias("title"), F.array(F.concat(F.lit("https://www.shop"), F.col("id").cast("string"), F.lit(".example/x"))).alias("urls"))
    sites = spark.range(n).select(F.concat(F.lit("shop"), F.col("id").cast("string"), F.lit(".example")).alias("domain"), F.lit("shopping").alias("category"), F.lit("online").alias("subcategory"))
    own = spark.createDataFrame([("category", "coded", f"s{i}", f"code{i}z", i) for i in range(2_000)] + [("risk", "any", "", r"\d{4}", 1)], RULES)
    began = time.time()
    got = {r["tx_id"]: r for r in rules.classify(t, own, "tx_id", "title", {}, "urls", sites).collect()}
    assert time.time() - began < 40
    assert all(r["tags"] == ("coded," if i < 2000 else "") + ("RISK:any," if i >= 1000 else "") + "shopping" for i, r in got.items()) and len(got) == n
    assert got[1234]["subcategory"] == "coded:s1234" and got[4321]["subcategory"] == "shopping:online"
    labels = sites.select("domain", F.concat(F.lit("l-"), "domain").alias("label"))
    few = rules.all_labels(t, spark.createDataFrame([], "label string, entity_type string, pattern string"), "tx_id", "title", "urls", labels)
    assert few.where("labels = concat('l-shop', tx_id, '.example')").count() == n

"""Small tables on both sides of each threshold, nulls and ties included."""

import datetime as dt
import random
import re
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracewell.functions import geo
from tracewell.functions import text as T
from tracewell.operators import bank, calls, exchange, household, ledger, places, reconcile, references, segments
from tracewell.operators.rules import city_of, classify, merchant_of
from tracewell.plans.exchange import QUERIES
from tracewell.sources import tables as sources

TX = "tx_id long, account_id long, booking_date date, amount decimal(18,2), direction string, channel string, category string, counterparty string"


def tx(spark, rows):
    """rows: (account, day, amount, direction, channel, name)"""
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d) if d is not None else None
    from decimal import Decimal

    return spark.createDataFrame([(i, a, day(d), Decimal(str(x)), di, ch, "everyday", cp) for i, (a, d, x, di, ch, cp) in enumerate(rows)], TX)


def test_text_functions(spark):
    df = spark.createDataFrame([("  ab \t c ", "Łódź ĄĆ")], "a string, b string")
    r = df.select(T.clean_text(F.col("a")).alias("c"), T.strip_diacritics(F.col("b")).alias("d"), T.strip_diacritics(F.col("b"), True).alias("e")).first()
    assert (r["c"], r["d"], r["e"]) == ("AB C", "Łodz AC", "Lodz AC")
    rows = [("GB82WEST12345698765432", True), ("GB82 WEST 1234 5698 7654 32", True), ("GB83WEST12345698765432", False), ("PL61109010140000071219812874", True), ("x", False), (None, False)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "a string").select(T.iban_valid(F.col("a")).alias("v")).collect()
    assert [r["v"] for r in got] == [v for _, v in rows]
    got = spark.createDataFrame([("490154203237518",), ("490154203237519",), ("49-015420-323751-8",)], "a string").select(T.luhn_valid(F.col("a")).alias("v")).collect()
    assert [r["v"] for r in got] == [True, False, True]
    phones = [("0048 600 100 200", "+48600100200"), ("600100200", "+48600100200"), ("48600100200", "+48600100200"), ("+49 30 1", "+49301")]
    got = spark.createDataFrame([(a,) for a, _ in phones], "a string").select(T.phone(F.col("a")).alias("v")).collect()
    assert [r["v"] for r in got] == [v for _, v in phones]
    got = spark.createDataFrame([("1:02:03",), ("2:05",), ("7",)], "a string").select(T.duration_seconds(F.col("a")).alias("v")).collect()
    assert [r["v"] for r in got] == [3723, 125, 7]
    ch = [("P.BLIK", "przelew na telefon", "", "BLIK_P2P"), ("P.BLIK", "zakup", "", "BLIK_MERCHANT"), ("", "wypłata gotówki bankomat", "", "CASH"), ("TR.KART", "x", "", "CARD"), (None, None, None, "OTHER"), ("", "zwrot", "", "REFUND")]
    got = spark.createDataFrame(ch, "a string, b string, c string, d string").select(T.channel(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()
    assert [r["v"] for r in got] == [c[3] for c in ch]
    got = spark.createDataFrame([("see https://www.Shop.pl:80/a?b, http://x.io",)], "a string").select(T.urls(F.col("a")).alias("u"), T.url_domain(F.element_at(T.urls(F.col("a")), 1)).alias("d")).first()
    assert got["u"] == ["https://www.Shop.pl:80/a?b", "http://x.io"] and got["d"] == "shop.pl"


def test_coordinates(spark):
    got = spark.createDataFrame([("52.5",), ("523000",), ("0",), ("999",), ("x",), ("-21,25",)], "a string").select(F.round(geo.coordinate(F.col("a")), 6).alias("v")).collect()
    assert [r["v"] for r in got] == [52.5, 52.5, None, None, None, -21.25]
    m = spark.range(1).select(geo.haversine(F.lit(52.0), F.lit(21.0), F.lit(53.0), F.lit(21.0)).alias("m")).first()["m"]
    assert abs(m - 111_194.9) < 1


def test_outlier_and_bursts(spark):
    df = tx(spark, [(1, i, 50, "DEBIT", "CARD", "a") for i in range(20)] + [(1, 30, 50_000, "DEBIT", "CARD", "b")])
    assert [(r["tx_id"], r["severity"]) for r in bank.large_outliers(df).collect()] == [(20, "high")]
    four = [(1, d, 10, "DEBIT", "BLIK_P2P", "a") for d in (0, 2, 4, 6)]
    assert bank.first_burst(tx(spark, four), "BLIK_P2P", 7, 5).count() == 0
    r = bank.first_burst(tx(spark, [*four, (1, 7, 10, "DEBIT", "BLIK_P2P", "a"), (1, 9, 1, "DEBIT", "BLIK_P2P", "a")]), "BLIK_P2P", 7, 5).first()
    assert (r["first_day"], r["tx_count"], r["total"]) == (dt.date(2024, 1, 1), 5, 50.0)


def test_baseline_edges(spark):
    r = bank.monthly_baseline(tx(spark, [(1, None, 5, "DEBIT", "CARD", None)])).first()
    assert (r["month"], r["tx_count"], r["std_amount"], r["p95_amount"], r["counterparties"]) == ("unknown", 1, 0.0, 5.0, 0)
    assert bank.monthly_baseline(tx(spark, []).limit(0)).count() == 0


def test_null_names_and_channels_keep_their_groups(spark):
    df = tx(spark, [(1, 0, 5, "DEBIT", None, None), (1, 1, 6, "DEBIT", None, None), (None, 2, 7, "CREDIT", "CARD", "a")])
    edges = bank.flow_edges(df).collect()
    assert sorted((r["edge_type"] or "", r["n"], r["tx_ids"]) for r in edges) == [("", 2, "0,1"), ("CARD", 1, "2")]
    base = {r["account_id"]: (r["channels"], r["categories"]) for r in bank.monthly_baseline(df).collect()}
    assert base == {1: ({"unclassified": 2}, {"everyday": 11.0}), None: ({"CARD": 1}, {"everyday": 7.0})}
    many = spark.range(100).selectExpr("1 as account_id", "if(id % 2 = 0, 'x', null) as tag", "id as tx_id", "1.0D as amount")
    assert sorted((r["tag"] or "", r["n"], len(r["tx_ids"].split(","))) for r in bank.evidence(many, n=10).collect()) == [("", 50, 10), ("x", 50, 10)]


def test_new_counterparty_and_spending(spark):
    df = tx(spark, [(1, 0, 100, "DEBIT", "CARD", "old"), (1, 40, 100, "DEBIT", "CARD", "old"), (1, 41, 31, "DEBIT", "CARD", "new"), (1, 42, 30, "DEBIT", "CARD", "newer")])
    got = bank.new_counterparty_large(df, F.lit("2024-02-01").cast("date"))
    assert [r["tx_id"] for r in got.collect()] == [2]
    m = bank.spending_over_income(tx(spark, [(1, 0, 100, "CREDIT", "CARD", "a"), (1, 1, 120, "DEBIT", "CARD", "a"), (2, 0, 100, "CREDIT", "CARD", "a"), (2, 1, 151, "DEBIT", "CARD", "a")]))
    assert [(r["account_id"], r["severity"]) for r in m.collect()] == [(2, "high")]


def test_internal_transfers(spark):
    df = tx(spark, [(1, 5, 70, "DEBIT", "TRANSFER", "x"), (2, 6, 70, "CREDIT", "TRANSFER", "x"), (2, 5, 70, "CREDIT", "TRANSFER", "x"), (1, 5, 70, "CREDIT", "TRANSFER", "x"), (3, 7, 70, "CREDIT", "TRANSFER", "x")])
    r = bank.internal_by_amount(df).collect()
    assert [(x["debit_id"], x["credit_id"], float(x["confidence"])) for x in r] == [(0, 2, 0.7)]


def test_reconcile_numbers_duplicates(spark):
    a = tx(spark, [(1, 0, 5, "DEBIT", "CARD", "a")] * 2).select("tx_id", "booking_date", "amount")
    b = tx(spark, [(1, 0, 5, "DEBIT", "CARD", "a")] * 3).select("tx_id", "booking_date", "amount")
    got = sorted(r["status"] for r in reconcile.reconcile(a, b, ["booking_date"]).collect())
    assert got == ["match", "match", "right_only"]


def test_balance_chain(spark):
    rows = [(1, 1, 10.0, 110.0), (1, 2, 5.0, None), (1, 3, 5.0, 120.0), (1, 4, 1.0, 130.0)]
    got = household.balance_chain(spark.createDataFrame(rows, "account_id long, seq int, amount double, balance double")).orderBy("seq").collect()
    assert [(r["seq"], r["holds"], r["difference"]) for r in got] == [(3, True, 0.0), (4, False, 9.0)]


def test_recurrence(spark):
    df = tx(spark, [(1, 0, 101, "DEBIT", "CARD", "gym"), (1, 30, 99, "DEBIT", "CARD", "gym"), (1, 3, 101, "DEBIT", "CARD", "day"), (1, 4, 101, "DEBIT", "CARD", "day")])
    assert [r["counterparty"] for r in household.monthly_recurrence(df).collect()] == ["gym"]


def test_rules(spark):
    rules = spark.createDataFrame(
        [("category", "a", "one", "x", 2), ("category", "a", "one", "xx", 1), ("category", "b", "two", "y|ó", 3), ("category", "a", "three", "x", 4), ("risk", "cash", "", "z", 5), ("risk", "cash", "", "zz", 6)],
        "kind string, category string, subcategory string, pattern string, priority int",
    )
    rows = spark.createDataFrame([(1, "XX y", "neutral"), (2, "z", "blacklist"), (3, "q", "whitelist"), (4, None, None), (5, "o", "neutral"), (6, "shop", "neutral")], "id long, t string, label string")
    shops = spark.createDataFrame([("shop", "Shop", "retail", "any", 1), ("y", "Y", "never", "any", 2)], "pattern string, name string, category string, subcategory string, priority int")
    got = {r["id"]: tuple(r)[1:] for r in classify(rows, rules, "id", "t", {"A": 60, "B": 70, "CASH": 5, "BLACKLISTED": 7}, merchants=shops, label="label").collect()}
    assert got[1] == ("a", "a:one", "a,b", 100, "category:a:one|xx|a;category:b:two|y|ó|b;category:a:three|x|a")
    assert got[2] == ("unclassified", "", "RISK:cash,BLACKLISTED", 42, "risk:cash|z|cash;memory:blacklist||blacklist")
    assert got[3] == ("unclassified", "", "", 0, "memory:whitelist||whitelist") and got[4] == ("unclassified", "", "", 0, "")
    assert got[6] == ("retail", "any", "", 0, "merchant_db:retail|Shop|retail")
    many = spark.range(6000).selectExpr("'category' as kind", "'a' as category", "'b' as subcategory", "'x' as pattern", "cast(id as int) as priority")
    assert {r["id"]: r["category"] for r in classify(rows, many, "id", "t", {"A": 1}).collect()} == {i: "a" if i == 1 else "unclassified" for i in range(1, 7)}


def test_rules_see_texts_without_their_marks(spark):
    rules = spark.createDataFrame([("category", "loans", "x", "pozyczk", 1)], "kind string, category string, subcategory string, pattern string, priority int")
    rows = spark.createDataFrame([(1, "Pożyczka"), (2, "poży")], "id long, t string")
    assert {r["id"]: r["category"] for r in classify(rows, rules, "id", "t", {"LOANS": 1}).collect()} == {1: "loans", 2: "unclassified"}


def test_merchants_by_priority_then_length(spark):
    rules = spark.createDataFrame([(2, "Shop", "s", "(?i)shop"), (2, "Shop One", "s1", "(?i)shop one"), (1, "Lender", "l", "(?i)loan")], "priority int, name string, category string, pattern string")
    rows = spark.createDataFrame([(1, "SHOP one"), (2, "shop loan"), (3, None)], "id long, t string")
    assert {r["id"]: (r["merchant"], r["category"]) for r in merchant_of(rows, rules, "id", "t").collect()} == {1: ("Shop One", "s1"), 2: ("Lender", "l"), 3: (None, "none")}
    cities = spark.createDataFrame([("shop in Nowy Targ",), ("Targówek",), ("targ!",)], "t string").select(city_of(F.col("t"), ["targ", "nowy targ"]).alias("c")).collect()
    assert [r["c"] for r in cities] == ["nowy targ", None, "targ"]


def test_accounts_in_texts(spark):
    rows = [
        ("x PL61 1090 1014 0000 0712 1981 2874 y", ["61109010140000071219812874"]), ("PL62109010140000071219812874", []), ("61 1090 1014 0000 0712 1981 2874", ["61109010140000071219812874"]),
        ("62 1090 1014 0000 0712 1981 2874", []), ("73 1140 2004 0000 3002 0135 5387", ["73114020040000300201355387"]), ("ref 61109010140000071219812874", []), ("IBAN: 61109010140000071219812874", ["61109010140000071219812874"]),
        ("to DE89370400440532013000 and DE88370400440532013000", ["DE89370400440532013000"]), (None, []),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", references.accounts_in(F.col("t"), ["1140"]).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == [a for _, a in rows]


def test_name_relations(spark):
    rows = [("Jan Kowalski", "own"), ("KOWALSKI JAN; UL. DŁUGA 5; 00-001", "own"), ("Anna Kowalska", "family"), ("Jan Nowak", "family"), ("Piotr Nowak", None), ("Kowalski", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(rows)], "i int, n string").select("i", references.name_relation(F.col("n"), F.lit("Jan Kowalski")).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [r for _, r in rows]


def test_cards_take_back_rows_without_a_number(spark):
    title = ["karta 4246 xxxx xxxx 9674", "płatność kartą *9674", "karta nr 9674", "zapłata kartą", "zapłata kartą", "karta 5500XXXXXXXX1111", "przelew 9674"]
    rows = [(1, i, dt.date(2024, 1, 1), "DEBIT" if i != 4 else "CREDIT", 10.0 + i, "food", "OTHER", t, "Shop", "") for i, t in enumerate(title)]
    df = spark.createDataFrame(rows, "account_id long, tx_id long, booking_date date, direction string, amount double, category string, channel string, title string, payee string, city string")
    got = {r["card"]: (r["n"], r["largest"]) for r in references.card_discovery(df).collect()}
    assert got == {"4246**9674": (3, 12.0), "****": (2, 14.0), "5500**1111": (1, 15.0)}


def test_statement_findings(spark):
    d = lambda x: dt.date(2024, 1, x)
    rows = [(1, "s1", "A", "B", "h", d(1), d(5), 0.0, 10.0, d(1), d(5), 3, 3), (1, "s2", "A", "B", "h", d(6), d(9), 10.01, 5.0, d(5), d(10), 3, 4), (1, "s3", "X", "B", "", d(9), d(12), 5.02, 1.0, None, None, 3, None), (2, "t", None, None, None, None, None, None, None, None, None, 0, 0)]
    cols = "case_id long, statement_id string, account_number string, bank_id string, file_hash string, period_from date, period_to date, opening double, closing double, tx_min date, tx_max date, tx_count int, declared int"
    got = sorted((r["statement_id"] or "", r["type"], r["detail"]) for r in bank.validate_statements(spark.createDataFrame(rows, cols)).collect())
    assert got == [("", "account_mismatch", "2"), ("s2", "balance_break", "-0.02"), ("s2", "duplicate", "h"), ("s2", "tx_after_period", "2024-01-10"), ("s2", "tx_before_period", "2024-01-05"), ("s2", "tx_incomplete", "1")]


def test_entities_where_all_names_share_a_word(spark):
    """A hot word pairs nothing by itself; the result is that of all pairs."""
    import random

    rng = random.Random(3)
    word = lambda: rng.choice(["alfa", "beta", "gama", "delta", "omega"])
    known = list(dict.fromkeys(f"firma {word()} {word()} {word()}" for _ in range(60))) + ["biedronka", "x"]
    names = list(dict.fromkeys(f"{rng.choice(['firma', 'Firma', 'biuro'])} {word()} {word()} {word()}{rng.choice(['', ' z', '1'])}" for _ in range(80))) + ["biedronka123", "iedronk", "x"]
    import re

    def best(name):
        x, tries = name.lower(), []
        for e, alias in enumerate(known):
            y = alias.lower()
            a, b = (set(re.findall(r"\w+", v)) for v in (x, y))
            part, ratio = min(len(x), len(y)) / max(len(x), len(y)), len(a & b) / max(len(a), len(b))
            if x == y:
                tries.append((1, -1.0, e))
            elif (x in y or y in x) and part >= 0.7:
                tries.append((2, -part, e))
            elif ratio >= 0.8:
                tries.append((3, -ratio, e))
        return (min(tries)[2], {1: "exact", 2: "part", 3: "fuzzy"}[min(tries)[0]]) if tries else (None, "new")

    got = bank.resolve_entities(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(e, a) for e, a in enumerate(known)], "entity_id long, name string")).collect()
    assert {r["name"]: (r["entity_id"], r["how"]) for r in got} == {n: best(n) for n in names}


CDR = "event_id long, subscriber long, ts timestamp, record_type string, contact string, duration_seconds long, place string, k int"


def cdr(spark, rows):
    return spark.createDataFrame([(i, s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), ty, c, d, p, 0) for i, (s, h, ty, c, d, p) in enumerate(rows)], CDR)


def test_calls(spark):
    r = cdr(spark, [(1, 0, "CALL_OUT", "a", 5, "H"), (1, 12, "CALL_OUT", "a", 3601, "H"), (1, 23.9, "SMS_IN", "b", 0, "H"), (1, 36, "DATA", None, 0, "X"), (1, 49, "DATA", None, 0, "X")])
    assert [x["gap_s"] for x in calls.inactivity_gaps(r).orderBy("event_id").collect()] == [43200, 43560, 46800]
    assert sorted(x["kind"] for x in calls.long_and_late(r).collect()) == ["long"]
    assert calls.hour_frame(r).count() == 24 and calls.one_time_contacts(r).count() == 1
    s = calls.overnight_stays(r).collect()
    assert [(x["place"], x["nights"]) for x in s] == [("X", 1)]


def test_crossings_and_clusters(spark):
    r = cdr(spark, [(1, h, "DATA", "a", 0, "p") for h in range(8)]).withColumn("roaming", F.col("event_id").isin(2, 3, 5, 7))
    c = places.crossings(r)
    assert [x["n"] for x in c.orderBy("from_ts").collect()] == [2, 1]
    assert [(x["n"], x["parts"]) for x in places.merge_crossings(c).collect()] == [(3, 2)]
    pts = cdr(spark, [(1, h, "DATA", "a", 0, "p") for h in range(9)]).withColumn("lat", F.lit(50.0) + F.when(F.col("event_id") < 5, 0.0).when(F.col("event_id") < 7, 0.005).otherwise(1.0)).withColumn("lon", F.lit(20.0))
    assert [(x["n"], x["cells"]) for x in places.clusters(pts).collect()] == [(7, 2)]


def test_ledger_pairs(spark):
    rows = [(1, 0, "o", "w", 5.0, "BTC", "deposit"), (2, 1800, "o", "w", 5.0, "ETH", "withdrawal"), (3, 1801, "o", "w", 5.0, "ETH", "withdrawal"), (4, 0, "o", "w", 5.0, "ETH", "withdrawal"), (5, 300, "o", "w", 5.0, "BTC", "buy"), (6, 600, "o", "w", 5.0, "BTC", "sell"), (7, 901, "o", "w", 5.0, "BTC", "buy")]
    x = spark.createDataFrame(rows, "transfer_id long, ts_s long, from_address string, to_address string, amount double, token string, tx_type string")
    assert ledger.rapid_conversion(x, 30, 1).first()["chains"] == 1
    assert ledger.pass_through(x).count() == 3


def test_segments(spark):
    turns = spark.createDataFrame([(1, 0, "a", 0.0, 10.0), (1, 1, "b", 10.0, 200.0)], "conv_id long, turn long, speaker string, t0 double, t1 double")
    segs = spark.createDataFrame([(1, 0, 5.0, 15.0), (1, 1, 9.0, 300.0), (1, 2, 500.0, 510.0)], "conv_id long, seg long, s0 double, s1 double")
    got = {r["seg"]: (r["speaker"], r["overlap"]) for r in segments.best_overlap(segs, turns).collect()}
    assert got == {0: ("a", 5.0), 1: ("b", 190.0), 2: ("UNKNOWN", 0.0)}
    docs = spark.createDataFrame([(1, "a b. c d e! f"), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["chunk"], r["words"]) for r in segments.sentence_chunks(docs, 4).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 2), (1, 1, 4)]


def test_sources(spark, tmp_path):
    assert sources.format_of(["UTC_Time", "Account", "Coin", "x"]) == "binance" and sources.format_of(["a", "b"]) == "generic"
    assert all(sources.format_of([h.title() for h in hs]) == k for k, hs in sources.SIGNATURES.items())
    df = spark.createDataFrame([("2024-01-01 10:00:00", "acc", "Deposit", "btc", "-1,5 USD"), (None, "acc", "Buy", "BTC", "x"), ("1704103200", "a", "fee", "BTC", "€2")], "UTC_Time string, Account string, Operation string, Coin string, Change string")
    r = sources.transfers_of(df).collect()
    assert [(float(x["amount"]), x["token"], x["tx_type"]) for x in r] == [(1.5, "BTC", "deposit"), (0.0, "BTC", "swap"), (2.0, "BTC", "fee")] and r[0]["ts"] == r[2]["ts"] and r[1]["ts"] is None
    w = spark.createDataFrame([("2024-01-01 00:00", "s", "2", "0", "", "t"), ("x", "", "", "3", "d", "u"), ("x", "s", "", "", "d", "v")], "date string, `received from` string, `received amount` string, `sent amount` string, `sent to` string, transaction string")
    assert sorted((x["tx_type"], float(x["amount"]), x["from_address"], x["to_address"]) for x in sources.transfers_of(w, "me").collect()) == [("deposit", 2.0, "s", "me"), ("withdrawal", 3.0, "me", "d")]
    old = spark.createDataFrame([("A", 1), ("b", 1)], "address string, v int")
    assert sorted(map(tuple, sources.merge_watchlist(old, spark.createDataFrame([("a", 2)], "address string, v int")).collect())) == [("a", 2), ("b", 1)]
    up = sources.upsert(spark.createDataFrame([(1, 1, "x")], "id int, at int, v string"), spark.createDataFrame([(1, 2, "y")], "id int, at int, v string"), ["id"], "at")
    assert [r["v"] for r in up.collect()] == ["y"]
    p = str(tmp_path / "c.csv")
    with open(p, "w", encoding="windows-1250") as f:
        f.write("a;b\n1;zażółć\nx;y\n")
    assert [(r["a"], r["b"]) for r in sources.read_delimited(spark, p, "a int, b string").collect()] == [(1, "zażółć")]
    m = sources.merge_subscribers([spark.createDataFrame([(1, 5, None, "n1")], "subscriber int, records int, msisdn string, name string"), spark.createDataFrame([(1, 2, "600", None)], "subscriber int, records int, msisdn string, name string")]).first()
    assert (m["records"], m["msisdn"], m["name"]) == (7, "600", "n1")


def test_resolve_entities(spark):
    known = spark.createDataFrame([(1, "Alfa Beta Sp"), (2, "Gamma")], "entity_id long, name string")
    names = spark.createDataFrame([("alfa beta sp",), ("Alfa Beta Sp z",), ("sp beta alfa",), ("delta",)], "name string")
    got = {r["name"]: (r["entity_id"], r["how"]) for r in bank.resolve_entities(names, known).collect()}
    assert got == {"alfa beta sp": (1, "exact"), "Alfa Beta Sp z": (1, "part"), "sp beta alfa": (1, "fuzzy"), "delta": (None, "new")}


def test_transit(spark):
    at = {"H": (0.0, 0.0), "W": (0.0, 1.0), "T": (0.0, 0.5), "F": (9.0, 9.0)}
    rows = [("H", d, h) for d in range(4) for h in (23, 2)] + [("W", d, h) for d in range(4) for h in (9, 14)] + [("T", d, 7) for d in range(3)] + [("F", 0, h) for h in (10, 11, 12, 13)]
    r = spark.createDataFrame([(1, i, p, dt.datetime(2024, 1, 1 + d, h), *at[p]) for i, (p, d, h) in enumerate(rows)], "subscriber long, event_id long, place string, ts timestamp, lat double, lon double")
    got = {x["place"]: (x["score"], x["transit"]) for x in places.transit(r, spark.createDataFrame([(1, "H", "W")], "subscriber long, home string, work string")).collect()}
    assert got == {"T": (100, True), "F": (0, False)}


def test_profiles_on_both_sides_of_their_thresholds(spark):
    base = dict(
        owner="o", n=100, span_days=100, swaps=50, deposits=5, withdrawals=5, tokens=3, mean_amount=500.0, max_amount=5000.0, volume=9000.0, large=0, max_fiat=0.0, fiat_volume=0.0, large_fiat=0, active_days=50, mean_held_h=100.0, median_held_h=100.0,
        leverage=False, rewards=0, card=0, privacy=0, airdrops=0, rapid=0, internal=0, max_per_day=5, same_day=0, per_day=1.0, per_week=25.0, per_active_day=2.0, activity=0.25,
    )
    cases = [
        ("retail_hodler", {}, 10), ("retail_hodler", {"per_day": 0.99}, 20), ("retail_hodler", {"per_day": 0.49, "span_days": 181, "swaps": 49, "median_held_h": 720.1, "large": 10, "activity": 0.09}, 100),
        ("retail_hodler", {"median_held_h": 720.0}, 20), ("retail_hodler", {"median_held_h": 168.0}, 10), ("retail_hodler", {"large": 11}, 10), ("scalper", {"rapid": 10}, 0), ("scalper", {"rapid": 11}, 15), ("scalper", {"rapid": 51, "max_per_day": 51, "per_day": 10.1, "max_amount": 2499.0}, 85),
        ("scalper", {"max_per_day": 50}, 10), ("day_trader", {"per_day": 3.0, "same_day": 6, "median_held_h": 23.9, "leverage": True, "activity": 0.31}, 90), ("day_trader", {"same_day": 5}, 10), ("swing_trader", {"median_held_h": 336.0, "per_week": 20.0}, 60),
        ("swing_trader", {"median_held_h": 47.9, "leverage": True}, 25), ("staker_validator", {"rewards": 5, "swaps": 19, "per_day": 0.9}, 55), ("staker_validator", {"rewards": 6, "swaps": 20}, 35), ("whale", {"max_fiat": 50_000.0, "fiat_volume": 500_001.0, "large_fiat": 6}, 70),
        ("whale", {"max_amount": 100_001.0, "volume": 1_000_001.0, "large": 6}, 85), ("institutional", {"volume": 500_001.0, "activity": 0.61, "per_day": 5.1, "same_day": 21, "leverage": True, "swaps": 101}, 85), ("institutional", {"volume": 500_001.0, "fiat_volume": 1.0, "activity": 0.51}, 0),
        ("alpha_hunter", {"tokens": 31, "airdrops": 4, "mean_amount": 99.0}, 75), ("alpha_hunter", {"tokens": 16, "airdrops": 3}, 25), ("meme_trader", {"activity": 0.19, "per_active_day": 5.1, "median_held_h": 11.9, "tokens": 17}, 60), ("bagholder", {"span_days": 91, "swaps": 0, "withdrawals": 0, "per_day": 0.09, "activity": 0.04}, 95),
        ("bagholder", {"span_days": 181, "swaps": 4}, 20),
    ]
    rows = [{**base, **change, "owner": f"o{i}"} for i, (_, change, _) in enumerate(cases)]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds[type(v)]}" for k, v in rows[0].items()))
    got = {(r["owner"], r["profile"]): r["score"] for r in exchange.profiles(df).collect()}
    for i, (profile, change, score) in enumerate(cases):
        assert got.get((f"o{i}", profile), 0) == score, (profile, change)


def test_holding_times_and_velocity(spark):
    rows = [(1, 0, "A", "deposit", ""), (2, 3600, "A", "withdrawal", ""), (3, 3600, "A", "buy", ""), (4, 9000, "A", "swap", "SELL"), (5, 10_000, "B", "deposit", ""), (6, 10_000, "B", "withdrawal", "")]
    df = spark.createDataFrame([(i, "o", t, k, 1.0, ty, s) for i, t, k, ty, s in rows], "row_id long, owner string, ts_s long, token string, amount double, tx_type string, side string")
    for c, kind in (("fiat_value", "double"), ("category", "string"), ("sheet", "string"), ("internal", "boolean")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    m = exchange.behaviour(df).first()
    assert m["median_held_h"] == 1.5 and abs(m["mean_held_h"] - 1.25) < 1e-9 and m["span_days"] == 1  # held 1 h and 1.5 h; B is sold in the same second, not later
    v = {r["token"]: (r["mean_h"], r["hot"]) for r in exchange.velocity(df).collect()}
    assert v == {"A": (1.0, False)}


def test_special_numbers(spark):
    rows = [("112", "emergency"), ("+48112", "emergency"), ("Facebook", "social"), ("FACEBOOK-otp", "social"), ("roaming", "alphanumeric"), ("ing", "bank"), ("*100#", "ussd"), ("+48801123456", "premium"), ("+48600100200", None), ("600100200", None), ("375295434940", None), ("1234567", "short_code"), ("", None), (None, None)]
    kind = calls.special_kind(F.col("c"), {"112": "emergency"}, {"facebook": "social", "ing": "bank"}, [(r"\*|#", "ussd"), (r"\+?48[78]0\d", "premium")])
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, c string").select("i", kind.alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == [k for _, k in rows]


def test_travel_modes(spark):
    rows = [(6.0, 2.9, "bts_hop"), (60.0, 9.9, "bts_hop"), (130.0, 14.9, "bts_hop"), (201.0, 59.0, "plane"), (450.0, 110.0, "plane"), (100.0, 60.0, "car"), (10.0, 60.0, "car"), (10.0, 100.0, "unknown")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, km double, m double")
    got = df.select("i", places.travel_mode(F.col("km"), F.col("m"), F.col("km") / (F.col("m") / 60)).alias("mode")).orderBy("i").collect()
    assert [r["mode"] for r in got] == [m for _, _, m in rows]


def test_border_crossings(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 0, "x"), (1, 5, "DE"), (1, 8, "CZ"), (1, 9, "x"), (1, 20, "US"), (2, 0, "x"), (2, 47, "x"), (2, 95, "x"), (3, 0, "DE"), (3, 1, "x")]
    df = spark.createDataFrame([(i, s, at(h), c != "x", None if c == "x" else c, 52.0, 21.0) for i, (s, h, c) in enumerate(rows)], "event_id long, subscriber long, ts timestamp, roaming boolean, country string, lat double, lon double")
    got = places.border_crossings(df)
    assert sorted((r["subscriber"], r["absence_hours"], r["records"], r["countries"], r["back_ts"] is None) for r in got.collect()) == [(1, 9.0, 2, "CZ,DE", False), (1, 11.0, 1, "US", True), (2, 48.0, 0, "", False), (3, 0.0, 1, "DE", False)]
    air = spark.createDataFrame([("A", 52.1, 21.0)], "airport string, alat double, alon double")
    mode = {(r["subscriber"], r["absence_hours"]): r["mode"] for r in places.crossing_mode(got, air, ["DE", "CZ"]).collect()}
    assert mode == {(1, 9.0): "plane", (1, 11.0): "plane", (2, 48.0): "unknown", (3, 0.0): "walk"}
    path = [(r["step"], r["first_ts"]) for r in places.last_day_path(got.where("subscriber = 1"), df.where("subscriber = 1")).collect()]
    assert sorted(path) == [(1, at(0)), (1, at(0))]


def test_greedy_clusters_like_a_loop(spark):
    """Random grids with ties: seeds, members, sums and order are those of visiting cell by cell."""
    rng = random.Random(8)
    step, rows = 500 / 111_000, []
    for who in range(12):
        for _ in range(60):
            cy, cx = rng.randrange(1, 9), rng.randrange(1, 9)
            rows += [(who, cy, cx)] * rng.choice([1, 1, 2, 3, 5])
    rows = [(i, who, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), (cy + 0.5) * step, (cx + 0.5) * step) for i, (who, cy, cx) in enumerate(rows)]
    r = spark.createDataFrame(rows, "event_id long, subscriber long, ts timestamp, lat double, lon double").repartition(5)
    rounds = []
    got = {(x["subscriber"], x["cluster"]): (x["n"], x["cells"], x["seed_y"], x["seed_x"]) for x in places.clusters(r, log=rounds).collect()}
    want = {}
    for who in range(12):
        cells = {}
        for i, w, _, lat, lon in rows:
            if w == who:
                cells.setdefault((int(lat / step), int(lon / step)), []).append(i)
        visited, found = set(), []
        for key, ids in sorted(cells.items(), key=lambda x: (-len(x[1]), x[1][0])):
            if key in visited or len(ids) < 3:
                continue
            mine = [k for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (k := (key[0] + dy, key[1] + dx)) in cells and k not in visited]
            visited |= set(mine)
            found.append((sum(len(cells[k]) for k in mine), len(mine), *key))
        found.sort(key=lambda x: -x[0])
        want |= {(who, n + 1): f for n, f in enumerate(found[:30])}
    assert got == want and rounds == sorted(rounds, reverse=True) and len(rounds) > 1


def test_clusters_and_trips_broadcast_nothing_that_grows(spark, monkeypatch):
    """Tables of cells, seeds and places grow with the records: small files as they are, none is broadcast; records without a subscriber end the rounds too."""
    r = spark.range(400).selectExpr("id as event_id", "if(id % 10 = 9, null, id % 10) as subscriber", "timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 5 as int)) as ts", "50 + 0.3 * (id % 3) + 0.004 * (id % 2) as lat", "20 + 0.5 * (id % 4) as lon").withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})
    plans, kept = [], places.stash

    def stash(df, name):
        plans.append(df)
        return kept(df, name)

    monkeypatch.setattr(places, "stash", stash)
    near = places.nearest_of(r, c := places.clusters(r))
    trips = places.cluster_trips(r, c)
    assert trips.where("subscriber is null").count() == 0 < trips.count() and near.count() == 360
    assert len(plans) >= 4 and not [p for df in (*plans, near, trips) if "Broadcast" in (p := df._jdf.queryExecution().executedPlan().toString())]


def test_period_anomalies_at_the_edge_of_the_band(spark):
    """A week right at 1.5 deviations is inside in any order of the weeks and any split of the sums; against whole numbers."""
    edge = [(20, 14, 16, 12, 8), (2, 4, 6, 7, 11, 11, 14, 17, 18), (3, 5, 5, 17, 18, 24), (2, 4, 5, 7, 8, 11, 14, 15, 15), (6, 8, 13, 13, 16, 17, 23, 24), (5, 8, 8, 10, 11, 18, 24, 24), (12, 13, 19, 21, 21, 22), (9, 11, 12, 13, 15)]
    beyond = [(20, 14, 16, 12, 7), (1, 1, 1, 1, 9), (9, 9, 9, 9, 1), (3, 3, 3, 3, 1), (1, 1, 1, 1, 1, 7), (4,), (1, 3)]
    rng, counts, want = random.Random(3), [], []
    for c in (edge + beyond) * 60:
        counts.append(rng.sample(c, len(c)))
    for who, c in enumerate(counts):
        w, total, squares = len(c), sum(c), sum(x * x for x in c)
        off = [(x, x * w - total) for x in c]
        want += [(who, x, "high" if d > 0 else "low") for x, d in off if w > 1 and 4 * d * d > 9 * (w * squares - total * total) and abs(d) > w and (d > 0 or total > 2 * w)]
    assert {who % len(edge + beyond) for who, _, _ in want} == {8, 9, 10, 11, 12}
    weeks = spark.createDataFrame([(who, week, x) for who, c in enumerate(counts) for week, x in enumerate(c)], "subscriber long, week int, n int")
    r = weeks.select("subscriber", F.expr("timestamp '2024-01-01' + make_interval(0, 0, week)").alias("ts"), F.explode(F.sequence(F.lit(1), "n")))
    got = calls.period_anomalies(r).collect()
    assert sorted((x["subscriber"], x["n"], x["kind"]) for x in got) == sorted(want)
    assert {x["mean"] for x in got if x["subscriber"] == len(edge)} == {13.8}


def test_chunks_of_a_very_long_text(spark):
    rng = random.Random(4)
    texts = ["", " ", "One. Two! Three?", " ".join(f"{'w ' * rng.randint(1, 90)}e." for _ in range(3000)), "word. " * 100_000, f"{'long ' * 500}end. short. short.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["chunk"]): (r["words"], r["sentences"]) for r in segments.sentence_chunks(df, page=8).collect()}
    assert time.time() - began < 60
    want = {}
    for d, text in enumerate(texts):
        chunk, n, k = 0, 0, 0
        for s in [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip(" ")]:
            size = len(re.split(r"\s+", s.strip(" ")))
            if n and n + size > 400:
                chunk, n, k = chunk + 1, 0, 0
            n, k = n + size, k + 1
            want[d, chunk] = (n, k)
    assert got == want


EXCHANGE = "row_id long, owner string, ts_s long, token string, amount double, tx_type string, side string, market string, fiat_value double, sheet string, internal boolean"


def records(spark, rows):
    names = EXCHANGE.replace(",", "").split()[::2]
    return spark.createDataFrame([tuple({"row_id": i, "owner": "u", "ts_s": 0, "token": "BTC", "amount": 1.0, "tx_type": "swap"}.get(c) if c not in r else r[c] for c in names) for i, r in enumerate(rows)], EXCHANGE)


def test_wash_trades_are_of_one_owner_and_market(spark):
    s = lambda ts, side, market="M", owner="u": {"ts_s": ts, "side": side, "market": market, "owner": owner}
    rows = [s(0, "BUY"), s(300, "SELL"), s(301, "SELL"), s(10, "SELL", "N"), s(10, "SELL", owner="v"), s(5, None), s(6, "SELL", None), s(7, "BUY", owner="v")]
    rows += [{**s(20, "SELL"), "tx_type": "sell"}]
    got = {(r["owner"], r["first_id"], r["second_id"], r["seconds"]) for r in exchange.wash_trades(records(spark, rows)).collect()}
    assert got == {("u", 0, 5, 5), ("u", 0, 1, 300), ("u", 5, 1, 295), ("u", 5, 2, 296), ("v", 7, 4, 3)}
    far = records(spark, [s(0, "BUY")] + [s(1, "BUY", "N") for _ in range(18)] + [s(2, "SELL"), s(2, "SELL")])
    assert {(r["first_id"], r["second_id"]) for r in exchange.wash_trades(far, block=4).collect()} == {(0, 19)}  # the 20th after it is not looked at
    m = records(spark, [{**s(0, "BUY"), "amount": 100.0}, {**s(1, "SELL"), "amount": 95.0}, {**s(2, "BUY", "N"), "amount": 1.0}, {**s(0, "SELL", owner="v"), "amount": 99.0}])
    assert [(r["owner"], r["market"], r["ratio"]) for r in exchange.wash_markets(m).collect()] == [("u", "M", round(5 / 195, 6))]


def test_one_busy_owner_like_a_loop(spark):
    rng = random.Random(5)
    rows = [{"ts_s": rng.randrange(4000), "side": rng.choice(["BUY", "SELL", None]), "market": rng.choice("MN")} for _ in range(700)]
    order = sorted(range(700), key=lambda i: (rows[i]["ts_s"], i))
    want = set()
    for a, i in enumerate(order):
        for j in order[a + 1 : a + 20]:
            x, y = rows[i], rows[j]
            if y["ts_s"] - x["ts_s"] <= 300 and x["market"] == y["market"] and (x["side"] or "") != (y["side"] or ""):
                want.add((i, j))
    assert {(r["first_id"], r["second_id"]) for r in exchange.wash_trades(records(spark, rows), block=64).collect()} == want


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_all_trades_of_the_window_like_a_loop(spark, block):
    rng = random.Random(8)
    rows = [{"ts_s": rng.randrange(-400, 2000), "side": rng.choice(["BUY", "BUY", "BUY", "SELL", None]), "market": rng.choice("MN"), "owner": rng.choice("uuuv")} for _ in range(400)]
    rows += [{"ts_s": 5000, "side": "BUY", "market": "M"} for _ in range(60)] + [{"ts_s": 5300, "side": "SELL", "market": "M"}]  # the 60th before it too
    rows += [{"ts_s": 9000, "side": "BUY", "market": "M"} for _ in range(50)] + [{"ts_s": 9000, "side": "SELL", "market": ""}, {"ts_s": 9301, "side": "SELL", "market": "M"}, {"ts_s": None, "side": "SELL", "market": "M"}]
    rows += [{"ts_s": 9301, "side": "BUY", "market": "M", "owner": None}, {"ts_s": 9302, "side": "SELL", "market": "M", "owner": None}]
    want = []
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if None not in (x["ts_s"], y["ts_s"], x.get("owner", "u")) and (x["ts_s"], i) < (y["ts_s"], j) and y["ts_s"] - x["ts_s"] <= 300:
                if x["market"] and x["market"] == y["market"] and x.get("owner", "u") == y.get("owner", "u") and (x["side"] or "") != (y["side"] or ""):
                    want.append((i, j, y["ts_s"] - x["ts_s"]))
    got = exchange.wash_trades(records(spark, rows), ahead=None, block=block).collect()
    assert sorted((r["first_id"], r["second_id"], r["seconds"]) for r in got) == sorted(want)
    assert len([w for w in want if w[2] == 300 and w[1] == 460]) == 60


def test_wash_trades_query_takes_the_whole_window(spark):
    rows = [{"side": "BUY", "market": "M"}, *({"ts_s": 1, "side": "BUY", "market": "N"} for _ in range(18)), *({"ts_s": 2, "side": "SELL", "market": "M"} for _ in range(2))]
    got = QUERIES["x33_wash_trades"](SimpleNamespace(exchange=records(spark, rows))).collect()
    assert {(r["first_id"], r["second_id"]) for r in got} == {(0, 19), (0, 20)}


def test_fiat_ramp_of_every_currency(spark):
    rows = [
        {"tx_type": "fiat_deposit", "token": "EUR", "amount": 10.0, "ts_s": 7200}, {"tx_type": "fiat_deposit", "token": "PLN", "amount": 5.5, "ts_s": 9000}, {"tx_type": "fiat_withdrawal", "token": "USD", "amount": 4.0, "ts_s": 0},
        {"tx_type": "withdrawal", "ts_s": 3600, "internal": True}, {"tx_type": "withdrawal", "ts_s": 10800}, {"tx_type": "deposit", "token": "PLN", "amount": 99.0}, {"sheet": "P2P", "owner": "v"},
    ]
    got = {r["owner"]: r for r in exchange.fiat_ramp(records(spark, rows)).collect()}
    u = got["u"]
    assert (u["fiat_in"], u["fiat_out"], u["net"], u["deposits"], u["withdrawals"], u["hours"], u["p2p"]) == (15.5, 4.0, 11.5, 2, 1, 1.0, 0)
    assert (got["v"]["fiat_in"], got["v"]["hours"], got["v"]["p2p"]) == (0.0, None, 1)
    assert {(r["token"], r["fiat_in"], r["fiat_out"]) for r in exchange.fiat_currencies(records(spark, rows)).collect()} == {("EUR", 10.0, 0.0), ("PLN", 5.5, 0.0), ("USD", 0.0, 4.0)}


def test_exchange_flow_by_owner(spark):
    rows = [{"tx_type": "buy", "fiat_value": -5.0}, {"tx_type": "SELL", "fiat_value": 2.0}, {"tx_type": "withdrawal"}, {"tx_type": "staking_reward", "fiat_value": 1.0, "token": None}, {"tx_type": "deposit", "fiat_value": 9.0}, {"tx_type": "buy", "owner": "v", "fiat_value": 3.0}]
    got = {(r["owner"], r["src"], r["dst"]): (r["n"], r["total"]) for r in exchange.exchange_flow(records(spark, rows)).collect()}
    assert got == {("u", "FIAT:PLN", "TOKEN:BTC"): (1, 5.0), ("u", "TOKEN:BTC", "FIAT:PLN"): (1, 2.0), ("u", "TOKEN:BTC", "EXTERNAL"): (1, 0.0), ("u", "STAKING", "TOKEN:UNKNOWN"): (1, 1.0), ("v", "FIAT:PLN", "TOKEN:BTC"): (1, 3.0)}
    nodes = {(r["owner"], r["node"]): (r["n"], r["total_in"], r["total_out"], r["kind"]) for r in exchange.exchange_flow_nodes(exchange.exchange_flow(records(spark, rows))).collect()}
    assert nodes["u", "TOKEN:BTC"] == (3, 5.0, 2.0, "token") and nodes["u", "EXTERNAL"] == (1, 0.0, 0.0, "external")


def test_watch_lists(spark):
    tx = spark.createDataFrame([(1, "0xA", "x", None), (2, "0xb ", "0xa", None), (3, "p", "q", "0XC"), (4, "p", "0xc", None), (5, "p", "0xd", None), (6, "p", None, None)], "transfer_id long, from_address string, to_address string, via string")
    watch = spark.createDataFrame([("0xa", "court"), ("0xa", "a Mixer"), ("0XB", "court"), (None, "mixer")], "address string, kind string")
    known = spark.createDataFrame([("0xc", "Blend", "mixer"), ("0xd", "Game", "game"), ("x", "Bridge", "bridge")], "address string, name string, category string")
    got = {r["transfer_id"]: (r["tags"], r["risk_score"], r["counterparty"]) for r in ledger.watch_matches(tx, watch, known, "via").collect()}
    assert got == {1: ("bridge,mixer,sanctioned", 100, "Bridge"), 2: ("mixer,sanctioned", 100, None), 3: ("mixer", 80, "Blend"), 4: ("mixer", 80, "Blend"), 5: ("", 0, "Game")}


def test_headers_in_three_stages(spark):
    expected = spark.createDataFrame(
        [("f", 1, "amount", ["amount", "sum"], ["^amt"], True), ("f", 2, "day", ["booking date"], ["date"], True), ("f", 3, "title", ["title"], [], True), ("f", 4, "rest", ["remark"], [], False)],
        "format string, ord int, name_of string, names array<string>, patterns array<string>, required boolean",
    )
    files = {
        "exact": ["SUM", " Amount", "value date", "Title"], "drift": ["amt", "Booking_Date", "titles"], "partial": ["amuont", "date 1", "date 2", ""], "failed": ["xyz", "qqq"],
        "greedy": ["date amt", "amt date"],
    }
    rows = [(f, "f", i, h) for f, hs in files.items() for i, h in enumerate(hs)] + [("none", "g", 0, "amount")]
    headers = spark.createDataFrame(rows, "file string, format string, position int, header string")
    m = segments.header_matches(headers, expected)
    got = {(r["file"], r["name_of"]): (r["header"], r["how"], r["confidence"]) for r in m.collect()}
    assert got["exact", "amount"] == (" Amount", "exact", 1.0) and got["exact", "day"] == ("value date", "pattern", 1.0)  # the first name goes before the first header
    assert got["drift", "amount"] == ("amt", "pattern", 1.0) and got["drift", "title"] == ("titles", "fuzzy", round(10 / 11, 4))
    assert got["drift", "day"] == ("Booking_Date", "pattern", 1.0)
    assert got["partial", "amount"] == ("amuont", "fuzzy", round(10 / 12, 4)) and got["partial", "day"] == ("date 1", "pattern", 1.0)
    assert got["greedy", "amount"] == ("amt date", "pattern", 1.0) and got["greedy", "day"] == ("date amt", "pattern", 1.0)
    levels = {r["file"]: (r["level"], r["missing"], r["extra"]) for r in segments.drift_levels(m, headers, expected).collect()}
    assert levels == {"exact": ("exact", 0, 1), "drift": ("drift", 0, 0), "partial": ("partial", 2, 2), "failed": ("failed", 3, 2), "greedy": ("partial", 1, 0), "none": ("failed", 0, 1)}


def test_block_ratio_is_what_a_hand_computes(spark):
    """abcd, bcde: bcd. ab, ba: one of them. abxcd, abycd: ab and cd. Czas trwania: plain forms are equal."""
    rows = [("abcd", "bcde", 0.75), ("ab", "ba", 0.5), ("abxcd", "abycd", 0.8), ("", "", 1.0), ("abc", "xyz", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").withColumn("r", segments.block_ratio(F.col("a"), F.col("b"))).collect()
    assert all(r["r"] == r["want"] for r in got)
    pairs = spark.createDataFrame([("czas_trwania", "Czas trwania"), ("początek", "poczatek"), ("data i godz", "data i godzina polaczenia")], "name string, header string")
    sure = {r["name"]: r["confidence"] for r in segments.header_confidence(pairs).collect()}
    assert sure["czas_trwania"] == sure["początek"] == 1.0 and abs(sure["data i godz"] - (0.5 + 0.4 * 11 / 25)) < 1e-9


def test_entities_by_name_alias_and_part(spark):
    e = spark.createDataFrame([("project", "Alfa", "north", 1), ("global", "North", "alfa", 2), ("global", "Biedronka", None, 3), ("project", "ab", None, 4), ("global", "Beta", "beta", 6), ("project", "zzz", "gamma", 5)], "scope string, name string, alias string, entity long")
    names = ["north", "ALFA ", "biedronka 12", "xabx", "beta", "Gamma", "ied", "", None, "qqq", "a"]
    got = {r["name"]: (r["entity"], r["scope"], r["how"]) for r in references.entity_lookup(spark.createDataFrame([(n,) for n in names], "name string"), e).collect()}
    assert got["north"] == (2, "global", "name")  # a global name goes before a project's alias
    assert got["ALFA "] == (1, "project", "name") and got["biedronka 12"] == (3, "global", "part") and got["xabx"] == (4, "project", "part") and got["beta"] == (6, "global", "name")
    assert got["Gamma"] == (5, "project", "alias") and got["ied"] == (3, "global", "part") and got["a"] == (1, "project", "part")
    assert got[""] == got[None] == got["qqq"] == (None, "none", None)


def test_own_transfers_are_surer(spark):
    rows = [(1, 0, 5, "DEBIT", "TRANSFER", "a"), (2, 0, 5, "CREDIT", "TRANSFER", "b"), (1, 3, 7, "DEBIT", "TRANSFER", "a"), (2, 4, 7, "CREDIT", "TRANSFER", "b"), (1, 9, 8, "DEBIT", "TRANSFER", "a"), (2, 11, 8, "CREDIT", "TRANSFER", "b")]
    t = tx(spark, rows).withColumn("title", F.element_at(F.array(F.lit("Przelew wlasny"), F.lit(None), F.lit("między rachunkami")), (F.col("tx_id") / 2 + 1).cast("int")))
    assert {(r["debit_id"], r["credit_id"]): (r["confidence"], r["method"]) for r in bank.internal_by_amount(t, title="title").collect()} == {(0, 1): (0.95, "title_match"), (2, 3): (0.6, "amount_date")}


def test_channels_by_codes(spark):
    rows = [("xIK01 VE02", "041", "", "", "KARTA"), ("", "041", "prowizja", "", "BLIK"), ("00", "1", "Płatność kartą", "", "KARTA"), (None, None, None, "Przelew na telefon", "PRZELEW_TELEFON"), ("", "", "wypłata gotówki", "", "GOTOWKA_ATM"), ("", "", "x", None, "INNE")]
    df = spark.createDataFrame(rows, "r string, m string, t string, n string, want string")
    assert all(x["c"] == x["want"] for x in df.withColumn("c", references.channel_by_codes(*map(F.col, "rmtn"))).collect())


def test_a_batch_of_labels_is_checked(spark):
    now = spark.createDataFrame([(1, "neutral", "old"), (2, "suspicious", "old")], "tx_id long, label string, note string")
    batch = spark.createDataFrame([(1, "monitoring", "a", 1), (1, "legitimate", None, 2), (2, "bad", "x", 3), (3, None, "new", 4), (None, "neutral", "", 5)], "tx_id long, label string, note string, seq long")
    after, refused = bank.set_labels(now, batch)
    assert {tuple(r) for r in after.collect()} == {(1, "legitimate", ""), (2, "suspicious", "old"), (3, "neutral", "new")}
    assert {(r["seq"], r["reason"]) for r in refused.collect()} == {(3, "invalid label bad"), (5, "no transaction")}


def test_places_in_a_rectangle(spark):
    r = spark.createDataFrame([(1, 1.0, 179.5), (2, 1.0, -179.5), (3, 1.0, 0.0), (4, 9.0, 179.9)], "event_id long, lat double, lon double")
    ids = lambda *box: sorted(x["event_id"] for x in places.in_rectangle(r, *box).collect())
    assert ids(0, 179, 2, -179) == [1, 2] and ids(0, -1, 1, 1) == [3] and ids(0, 0, 9, 180) == [1, 3, 4]


def test_report_in_two_passes_is_each_group_by_itself(spark):
    """G32 on random records, nulls and repeated times included, against G18 to G31 one by one."""
    rng = random.Random(7)
    numbers = ["48600100200", "+48700123456", "375291112233", "+4915112345", "+881612345678", "", None, "600100201", "whatsapp"]
    rows = []
    for i in range(900):
        at = None if i % 90 == 0 else dt.datetime(2024, 1, 1 + rng.randrange(20), rng.choice([0, 3, 4, 12, 13, 22, 23]), rng.choice([0, 1, 2, 30]))
        at = dt.datetime(2024, 2, 1, 12, i % 40) if 100 < i < 300 else at
        kind = rng.choice(["CALL_OUT", "CALL_IN", "SMS_OUT", "DATA", "CALL_FORWARDED", None])
        own = f"s{i % 3}"
        abroad = rng.choice([(None, None), ("", ""), ("DE", "netA"), ("DE", None), ("BY", "telegram net")])
        rows.append((own, i, at, kind, rng.choice(numbers) if i % 3 else f"4860{i}", rng.choice([None, 5, 20, 4000]), rng.choice(["a", "b", None]), own, own, rng.choice(numbers), *abroad, "Viber" if i == 5 else None, rng.choice([None, "", own, "77"])))
    schema = "subscriber string, event_id long, ts timestamp, record_type string, contact string, duration_seconds int, place string, own string, caller string, callee string, country string, network string, service string, related string"
    r = spark.createDataFrame(rows, schema).cache()
    prefixes = spark.createDataFrame([("48", "PL"), ("375", "BY"), ("4", "XX"), ("49", "DE")], "prefix string, country string")
    satellites = [("Iridium", r"\+8816", "8816")]
    messengers = [("WhatsApp", "messenger", "whatsapp"), ("Telegram", "messenger", "telegram"), ("Viber", "messenger", "viber")]
    late = F.col("record_type").startswith("CALL") & (F.hour("ts") < 5) & (F.col("duration_seconds") >= 10)
    foreign = calls.foreign_contacts(r, prefixes).where("country not in ('PL', 'unknown')")
    each = {
        "long_call": calls.long_and_late(r).where("kind = 'long'"), "late_night_calls": r.where(late), "night_activity": calls.night_ratio(r).where("flag"),
        "night_movement": calls.night_movement(r), "burst_activity": calls.bursts(r.where("record_type like 'CALL%' or record_type like 'SMS%'").where("ts is not null")),
        "premium_number": r.where(F.col("contact").rlike(calls.PREMIUM)).select("subscriber", "contact").distinct(), "roaming": calls.roaming(r), "foreign_contacts": foreign,
        "forwarded_calls": calls.forwarded_calls(r, "related"), "one_time_contacts": calls.one_time_contacts(r.where("contact <> ''")),
        "satellite_numbers": calls.satellite_numbers(r, satellites), "social_media": calls.platforms(r, messengers, ["caller", "callee", "network", "service"]), "inactivity_gap": calls.inactivity_gaps(r),
    }
    want = {(x["subscriber"], k): x["count"] for k, df in each.items() for x in df.groupBy("subscriber").count().collect()}
    got = calls.anomaly_report(r, prefixes, satellites, messengers, critical=["BY"]).collect()
    assert {(x["subscriber"], x["type"]): x["n"] for x in got} == want and len(got) == len(want)
    assert {k for _, k in want} >= {"night_movement", "burst_activity", "inactivity_gap", "one_time_contacts", "roaming", "foreign_contacts"}
    critical = {x["subscriber"] for x in calls.foreign_contacts(r, prefixes).where("country = 'BY'").collect()}
    for x in got:
        assert x["severity"] == ("critical" if x["type"] == "foreign_contacts" and x["subscriber"] in critical else calls.SEVERITY[x["type"]])
    assert calls.anomaly_report(r.limit(0), prefixes, satellites, messengers).count() == 0


def test_country_by_the_longest_prefix(spark):
    """One to five digits, a plus or none; what no prefix fits has none."""
    p = spark.createDataFrame([("1", "US"), ("1242", "BS"), ("12421", "B5"), ("124211", "no"), ("x", "no")], "prefix string, country string")
    r = spark.createDataFrame([("+12425",), ("12421999",), ("1300",), ("x5",), ("",), (None,), ("4",)], "contact string")
    assert {x["contact"]: x["country"] for x in calls.with_country(r, p).collect()} == {"+12425": "BS", "12421999": "B5", "1300": "US", "x5": None, "": None, None: None, "4": None}

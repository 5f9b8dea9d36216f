"""References inside bank texts: accounts, cards, merchants, labels, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iban_valid
from .bank import CREDIT, DEBIT, KEY, first_ids, money, ranked, when_sum
from .rules import first_of
from .running import numbered


#: Codes inside a statement's raw field, in the order in which they are looked for.
RAW_CODES = {
    "VE02": "KARTA", "VE03": "GOTOWKA_ATM", "VE09": "PROWIZJA", "IK01": "BLIK", "IKZ1": "BLIK_ZWROT", "IBCG": "PRZELEW", "IBCB": "PRZELEW_WLASNY", "ZKCG": "ZLECENIE_STALE",
    "EXGC": "PRZELEW_PRZYCHODZACY", "DECC": "WPLATOMAT", "WDW5": "PRZELEW_TELEFON",
}
#: Message codes.
MESSAGE_CODES = {"073": "KARTA", "041": "BLIK", "020": "PRZELEW", "034": "PRZELEW_PRZYCHODZACY", "074": "ZLECENIE_STALE", "042": "GOTOWKA_ATM", "036": "PROWIZJA", "076": "PRZELEW_TELEFON"}
#: Patterns of titles and names, in order.
TITLE_CHANNELS = [
    (r"p[lł]atno[sś][cć]\s*kart[aą]|nr\s*karty", "KARTA"), (r"blik|nr\s*transakcji", "BLIK"), (r"przelew\s*na\s*telefon", "PRZELEW_TELEFON"), (r"wyp[lł]at.*got[oó]wk", "GOTOWKA_ATM"),
    (r"wp[lł]atomat", "WPLATOMAT"), (r"zleceni|umowa\s*na\s*kredyt", "ZLECENIE_STALE"), (r"prowizj", "PROWIZJA"),
]


def channel_by_codes(raw: Column, message: Column, title: Column, name: Column) -> Column:
    """By the first code that the raw field holds, else the message code, else the title and name."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))
    cases = [(raw.contains(k), v) for k, v in RAW_CODES.items()] + [(message == k, v) for k, v in MESSAGE_CODES.items()] + [(text.rlike(p), v) for p, v in TITLE_CHANNELS]
    return first_of(cases, "INNE")


def accounts_in(text: Column, sorts: list[str] | None = None) -> Column:
    """Distinct account numbers in order of their kinds: with the home country's code, in groups
    after two digits, 26 digits behind a word that says what they are, then foreign ones. Home numbers
    are their 26 digits, valid by check digits or of a known sort code (except with a code, where check
    digits decide); foreign ones keep their country and must be valid."""
    x = F.upper(F.coalesce(text, F.lit("")))
    plain = lambda c: F.transform(c, lambda v: F.regexp_replace(v, r"\s", ""))
    good = lambda v: iban_valid(F.concat(F.lit("PL"), v))
    known = lambda v: good(v) | F.substring(v, 3, 4).isin(*(sorts or [""]))
    coded = F.transform(plain(F.regexp_extract_all(x, F.lit(r"\bPL\s?\d{2}(?:\s?\d{4}){6}\b"), 0)), lambda v: F.substr(v, F.lit(3)))
    spaced = plain(F.regexp_extract_all(x, F.lit(r"\b\d{2}(?:\s\d{4}){6}\b"), 0))
    named = F.regexp_extract_all(x, F.lit(r"(?:NR\s+RACHUNKU|RACHUNK\w*|KONT[OA]|IBAN|NRB)[:\s]+(\d{26})\b"), 1)
    foreign = F.regexp_extract_all(x, F.lit(r"\b(?!PL)[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), 0)
    return F.array_distinct(F.concat(F.filter(coded, good), F.filter(F.concat(spaced, named), known), F.filter(foreign, iban_valid)))


def classify_accounts(accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """Country and bank of account numbers by the four digits of the sort code; 8 and 9 are
    cooperative banks."""
    a = accounts.withColumn("sort", F.substring("account", 5, 4)).withColumn("country", F.substring("account", 1, 2))
    out = a.join(banks, "sort", "left")
    coop = F.substring("sort", 1, 1).isin("8", "9")
    return out.select("account", "country", F.coalesce("bank", F.when(coop, "cooperative"), F.lit("unknown")).alias("bank"))


def propagate_labels(counterparties: DataFrame, decisions: DataFrame) -> DataFrame:
    """An analyst's suspicious or cleared transaction labels its name; suspicion wins."""
    d = decisions.groupBy("counterparty").agg(F.max(F.when(F.col("decision") == "suspicious", 2).when(F.col("decision") == "cleared", 1).otherwise(0)).alias("d"))
    out = counterparties.join(d, "counterparty", "left")
    return out.select("counterparty", F.when(F.col("d") == 2, "blacklist").when(F.col("d") == 1, "whitelist").otherwise(F.col("label")).alias("label"))


def learned_category(tx: DataFrame, known: DataFrame) -> DataFrame:
    """The name's learned category where the rules found none."""
    return tx.join(known, "counterparty", "left").select("tx_id", F.coalesce("category", "learned", F.lit("unclassified")).alias("category"))


#: What loans, cash and transfers between persons are called.
LOAN = r"(?i)po[żz]yczk|kredyt|rata\b|raty\b|chwil[óo]wk|loan|credit|sp[łl]ata"
CASH = r"(?i)bankomat|\batm\b|got[óo]wk|cash|wp[łl]atomat"
PERSON = r"(?i)przelew\s*(?:na|z)\s*telefon|blik|\bp2p\b|phone"


def keyword_kinds(text: Column) -> Column:
    """Which keyword groups a text has, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(text.rlike(p), k) for k, p in (("cash", CASH), ("loan", LOAN), ("person", PERSON))))), ",")


#: Words of salaries, own transfers, transfers to a telephone, and of companies.
SALARY = r"(?i)wynagrodz|pensja|premia|zap[łl]ata|wyp[łl]ata|salary|za\s+prac[ęe]|umowa\s+o\s+prac[ęe]|umowa\s+zleceni[ae]|umowa\s+o\s+dzie[łl]o"
OWN_TRANSFER = r"(?i)przelew\s+w[łl]asny|w[łl]asny|mi[ęe]dzy\s+rachunkami|own\s+transfer"
TO_PHONE = r"(?i)przelew\s*(?:na|z)\s*telefon"
COMPANY = r"sp\.|s\.a|z o\.o|zoo|ltd|gmbh|inc|corp|sklep|market|urząd|zakład|firma|bank|ubezpiecz|fundusz|stowarzysz"
PERSON_NAME = r"^\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+(?:\s+\p{Lu}\p{Ll}+)?$"


def name_words(c: Column) -> Column:
    """Words of a name in lower case, without what follows the second semicolon, numbers and parts of addresses."""
    n = F.array_join(F.slice(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), ";"), 1, 2), " ")
    return F.filter(F.split(F.trim(n), r"\s+"), lambda w: (F.length(w) >= 2) & ~w.rlike(r"\d") & ~F.rtrim(w, F.lit(".")).isin("ul", "al", "os", "pl", "nr", "lok", "kl"))


def name_relation(name: Column, holder: Column) -> Column:
    """own: the same words up to the surname's ending, or two in common; family: a surname in common
    beside other words; null: nothing of both, or fewer than two words."""
    stem = lambda ws: F.array_sort(F.array_distinct(F.transform(ws, lambda w: F.regexp_replace(w, r"(?<=sk|ck|dzk|ńsk)[ia]$", ""))))
    a, b = name_words(name), name_words(holder)
    sa, sb = stem(a), stem(b)
    both = F.array_intersect(sa, sb)
    one = lambda ws: F.filter(ws, lambda w: ~F.array_contains(both, F.regexp_replace(w, r"(?<=sk|ck|dzk|ńsk)[ia]$", "")))
    ra, rb = F.array_sort(F.array_distinct(one(a))), F.array_sort(F.array_distinct(one(b)))
    rel = F.when((sa == sb) | (F.size(F.array_intersect(a, b)) >= 2), "own").when((F.size(both) > 0) & (F.size(ra) > 0) & (F.size(rb) > 0) & (ra != rb), "family").when((F.size(both) > 0) & (F.size(ra) == 0) & (F.size(rb) == 0), "own")
    return F.when((F.size(a) >= 2) & (F.size(b) >= 2), rel)


def account_discovery(refs: DataFrame, names: int = 5) -> DataFrame:
    """Each account that an account's texts name, with sums, days, its most frequent names and whose
    it is: the holder's own (by number, by name, or half of its transfers are own ones and not to a
    telephone), family, an employer (only credits, a salary among them), a friend (a transfer to the
    telephone of a person), else a third party.

    refs: account_id, own_number, referenced, direction, amount, booking_date, payee, holder, title.
    """
    by = [KEY, "referenced"]
    named = F.when(F.col("payee") != "", F.substring("payee", 1, 60))
    r = refs.withColumns({"name": named, "text": F.concat_ws(" ", "title", "payee")})
    g = r.groupBy(*by).agg(
        when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"), F.count_if(F.expr(CREDIT)).alias("credits"), F.count_if(F.expr(DEBIT)).alias("debits"), F.count("*").alias("n"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day"),
        F.max(F.col("referenced").eqNullSafe(F.col("own_number"))).alias("same"), F.count_if(F.col("text").rlike(OWN_TRANSFER)).alias("own"), F.count_if(F.col("text").rlike(TO_PHONE)).alias("phone"), F.count_if(F.col("title").rlike(SALARY)).alias("salary"),
    )
    c = r.where("name is not null").groupBy(*by, "name", "holder").agg(F.count("*").alias("k")).withColumn("rel", name_relation(F.col("name"), F.col("holder")))
    hint = c.groupBy(*by).agg(F.min_by("rel", F.when(F.col("rel").isNotNull(), F.struct(-F.col("k"), "name"))).alias("rel"), F.min_by("name", F.struct(-F.col("k"), "name")).alias("top"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k"), "name"))).where(F.col("r") <= names)
    listed = c.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("names"))
    person = F.col("top").rlike(PERSON_NAME) & ~F.lower("top").rlike(COMPANY)
    own = F.col("same") | F.col("rel").eqNullSafe("own") | (~F.col("rel").eqNullSafe("family") & (F.col("own") > 0) & (F.col("own") * 2 >= F.col("n")) & ~((F.col("phone") > 0) & (F.col("phone") >= F.col("own"))))
    owner = F.when(own, "own").when(F.col("rel") == "family", "family").when((F.col("debits") == 0) & (F.col("credits") > 0) & (F.col("salary") > 0), "employer").when((F.col("phone") > 0) & person, "friend").otherwise("third_party")
    return g.join(hint, by, "left").join(listed, by, "left").select(*by, "credit", "debit", "credits", "debits", "first_day", "last_day", F.coalesce("names", F.lit("")).alias("names"), owner.alias("ownership"))


def card_of(text: Column) -> Column:
    """A masked card number as first four, two stars, last four; stars and last four of a short one; '' without."""
    full = F.regexp_extract(text, r"\b(\d{4})[ -]?(?:[xX*]{2,4}[ -]?){2,4}(\d{4})\b", 0)
    last = F.regexp_extract(text, r"(?<![\dxX*])\*{1,4} ?(\d{4})\b", 1)
    return F.when(full != "", F.concat(F.substring(full, 1, 4), F.lit("**"), F.right(full, F.lit(4)))).when(last != "", F.concat(F.lit("****"), last)).otherwise("")


#: Words that show that a card paid.
CARD_WORDS = r"(?i)kart[ąay]\b|\bkarta\b|\bcard\b|p[łl]atno[śs][ćc] kart"


def card_discovery(tx: DataFrame, top: int = 6, shops: int = 5, cities: int = 8) -> DataFrame:
    """Each card of an account: sums, largest amount, days, categories, shops, cities and months.

    tx: account_id, tx_id, booking_date, direction, amount, category, channel, title, payee, city. Rows of
    a card channel or with its words take part if they show a number or the words. A number that shows
    its last four only, or none, is the account's card whose last four stand in the text, if there is
    one (the first of several). What stays without a number is one card, dropped if it is hardly used
    (at most one debit, more credits, under three rows).
    """
    words = F.col("title").rlike(CARD_WORDS)
    t = tx.withColumn("card", card_of(F.col("title"))).where(((F.col("channel") == "CARD") | words) & ((F.col("card") != "") | words))
    t = t.withColumn("card", F.when(F.col("card") == "", "****").otherwise(F.col("card")))
    known = t.where("card not like '****%'").select(KEY, F.right("card", F.lit(4)).alias("last"), F.col("card").alias("full")).distinct().groupBy(KEY, "last").agg(F.min("full").alias("full"))
    seen = t.where("card like '****%'").select(KEY, "tx_id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(?<!\d)\d{4}(?!\d)"), 0))).alias("last"))
    moved = seen.join(known, [KEY, "last"]).groupBy("tx_id").agg(F.min("full").alias("full"))
    t = t.join(moved, "tx_id", "left").withColumn("card", F.coalesce("full", "card"))
    by = [KEY, "card"]
    g = t.groupBy(*by).agg(F.count("*").alias("n"), when_sum(CREDIT).alias("credit"), when_sum(DEBIT).alias("debit"), F.count_if(F.expr(DEBIT)).alias("debits"), F.max(F.abs("amount")).cast("double").alias("largest"), F.min("booking_date").alias("first_day"), F.max("booking_date").alias("last_day"))
    g = g.where("not (card = '****' and debits <= 1 and n - debits > debits and n < 3)")

    def best(c: str, n: int, value: Column, name: str) -> DataFrame:
        k = t.where(F.col(c) != "").groupBy(*by, c).agg(value.alias("v"))
        k = k.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v"), c))).where(F.col("r") <= n)
        return k.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]), ",").alias(name))

    months = t.groupBy(*by, F.date_format("booking_date", "yyyy-MM").alias("m")).agg(F.sum(F.abs("amount")).alias("v")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", F.col("v").cast("double"))))).alias("months"))
    parts = [best("category", top, F.sum(F.abs("amount")), "categories"), best("payee", shops, F.sum(F.abs("amount")), "shops"), best("city", cities, F.count("*"), "cities"), months]
    for p in parts:
        g = g.join(p, by, "left")
    return g.withColumns({c: F.coalesce(c, F.lit("")) for c in ("categories", "shops", "cities")})


def edge_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The strongest label of the transactions of each edge. edges: src, dst, tx_id."""
    order = F.when(F.col("label") == "blacklist", 2).when(F.col("label") == "suspicious", 1).otherwise(0)
    j = edges.join(labels, "tx_id", "left").withColumn("label", F.coalesce("label", F.lit("neutral")))
    return j.groupBy("src", "dst").agg(F.max(F.struct(order.alias("o"), "label")).alias("m"), F.count("*").alias("n")).select("src", "dst", F.col("m.label").alias("label"), "n")


def grams(c: Column, n: Column) -> Column:
    """The different pieces of n characters of a text that has as many."""
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(c, i, n)))


def containing(names: DataFrame, known: DataFrame) -> DataFrame:
    """(x, y): names and known names of which one contains the other, equal ones aside. names: x; known: y;
    different texts, not empty.

    What a text is contained in holds all its pieces. So each text asks for its rarest piece of three
    characters on the other side (a shorter one for itself), and what that finds is compared: a piece
    that all names share pairs nothing, and no name meets names of its own side.
    """

    def pairs(small: DataFrame, big: DataFrame) -> DataFrame:
        held = big.select("big", F.explode(F.concat(*(grams(F.col("big"), F.lit(n)) for n in (1, 2, 3)))).alias("w")).where(F.length("big") >= F.length("w")).distinct()
        asked = small.select("small", F.explode(grams(F.col("small"), F.least(F.length("small"), F.lit(3)))).alias("w"))
        often = asked.join(held.groupBy("w").agg(F.count("*").alias("f")), "w")  # a piece that the other side lacks ends the search
        whole = asked.groupBy("small").agg(F.count("*").alias("n"))
        rare = often.groupBy("small").agg(F.min_by("w", F.struct("f", "w")).alias("w"), F.count("*").alias("found")).join(whole, "small").where("n = found")
        return rare.select("small", "w").join(held, "w").where(F.col("big").contains(F.col("small")) & (F.col("big") != F.col("small"))).select("small", "big").distinct()

    one = pairs(names.toDF("small"), known.toDF("big")).select(F.col("small").alias("x"), F.col("big").alias("y"))
    two = pairs(known.toDF("small"), names.toDF("big")).select(F.col("big").alias("x"), F.col("small").alias("y"))
    return one.unionByName(two)


def entity_lookup(names: DataFrame, entities: DataFrame) -> DataFrame:
    """the entity of a name: by its own name, else by an alias, else by a name that contains it or that
    it contains; each stage in the project before the global ones, of several the smallest entity.

    entities: scope (project or global), name, alias, entity. Names are compared without case and outer
    blanks; an empty name has no entity.
    """
    plain = lambda c: F.lower(F.trim(c))
    n = names.select("name", plain("name").alias("x"))
    asked = n.select("x").where("x <> ''").distinct()
    scope = F.when(F.col("scope") == "project", 0).otherwise(1)
    e = entities.select(scope.alias("s"), "entity", plain("name").alias("name"), plain("alias").alias("alias"))
    direct = [e.where(f"{c} <> ''").select(F.col(c).alias("x"), F.struct(F.lit(how).alias("how"), "s", "entity").alias("r")) for how, c in enumerate(("name", "alias"))]
    exact = direct[0].unionByName(direct[1]).join(asked, "x", "left_semi").groupBy("x").agg(F.min("r").alias("r"))
    rest = asked.join(exact, "x", "left_anti")
    near = containing(rest, e.where("name <> ''").select("name").distinct()).join(e.select(F.col("name").alias("y"), "s", "entity"), "y")
    near = near.groupBy("x").agg(F.min(F.struct(F.lit(2).alias("how"), "s", "entity")).alias("r"))
    out = n.join(exact.unionByName(near), "x", "left")
    how = F.when(F.col("r.how") == 0, "name").when(F.col("r.how") == 1, "alias").when(F.col("r.how") == 2, "part")
    return out.select("name", F.col("r.entity").alias("entity"), F.when(F.col("r.s") == 0, "project").when(F.col("r.s") == 1, "global").otherwise("none").alias("scope"), how.alias("how"))


def entity_stats(tx: DataFrame) -> DataFrame:
    """how many accounts and transactions a name has, their sum, and its last category."""
    return tx.groupBy("counterparty").agg(F.countDistinct(KEY).alias("accounts"), F.count("*").alias("n"), money("amount").alias("total"), F.max_by("category", F.struct("booking_date", "tx_id")).alias("last_category"))


def search_names(tx: DataFrame, aliases: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Names that contain the pattern, or have an alias (counterparty, alias) that does, the most seen first."""
    like = f"%{pattern.lower()}%"
    by_alias = aliases.where(F.lower("alias").like(like)).select("counterparty")
    seen = tx.groupBy("counterparty").agg(F.count("*").alias("times_seen"))
    hit = seen.where(F.lower("counterparty").like(like)).select("counterparty").unionByName(by_alias).distinct()
    return seen.join(hit, "counterparty").orderBy(F.desc("times_seen"), "counterparty").limit(limit)


def masked(account: Column) -> Column:
    """Stars and the last four characters."""
    return F.concat(F.lit("****"), F.right(account, F.lit(4)))


def account_hash(account: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the number without spaces, in capitals."""
    return F.substring(F.sha2(F.upper(F.regexp_replace(account, r"[\s-]", "")).cast("binary"), 256), 1, 16)


def holder_label(name: Column) -> Column:
    """The first letters of a name's words, each with a dot."""
    return F.array_join(F.transform(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def sequence_labels(accounts: DataFrame, kind: str, order: list[str | Column]) -> DataFrame:
    """The kind and a running number within it, by any columns in order (ties included, nulls first).
    A kind's accounts are numbered part by part, so that no task has to hold a whole kind."""
    out = numbered(accounts, [kind], order, "__number")
    return out.withColumn("label", F.concat(kind, F.lit("-"), F.col("__number").cast("string"))).drop("__number")


def geographic_share(rows: DataFrame, samples: int = 3) -> DataFrame:
    """Each city's share of an account's rows that name one, the main city, and ids of the first rows
    elsewhere. rows: account_id, tx_id, amount, city ('' or null: none)."""
    r = rows.where("city <> ''")
    g = ranked(r, [KEY, "city"]).groupBy(KEY, "city").agg(F.count("*").alias("n"), money(F.abs("amount")).alias("total"), first_ids(samples, "ids"))
    w = Window.partitionBy(KEY)
    g = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "city"))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("primary_city", F.col("rank") == 1)
    return g.withColumn("away_ids", F.when(F.col("primary_city"), "").otherwise(F.col("ids"))).drop("ids")

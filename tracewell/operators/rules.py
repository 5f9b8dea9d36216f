"""Pattern rules over texts: a table of analysts' rules against any number of rows.

The rule tables are read on the driver (a table of patterns, in their order). Up to ``FEW`` patterns
become expressions, the patterns of one group one alternation, and no row is joined. More go through an
index of literals (``literals``): a row is tried with the patterns alone that it may match. Domains
beyond ``FEW`` are joined by host. All ways give the same results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_diacritics, url_domain
from .literals import BROADCAST, matches

#: Patterns or domains up to which expressions are made of them.
FEW = 200


def read(rules: DataFrame, *order: str) -> list:
    return rules.orderBy(*order).collect()


def either(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def grouped(rules: list, *by: str) -> list[tuple[tuple, list[str]]]:
    """Groups in the order in which their first rule stands, each with its patterns in order."""
    out: dict[tuple, list[str]] = {}
    for r in rules:
        out.setdefault(tuple(r[b] for b in by), []).append(r["pattern"])
    return list(out.items())


def first_of(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    return reduce(lambda out, c: F.when(c[0], F.lit(c[1])).otherwise(out), reversed(cases), F.lit(default).cast("string"))


CATEGORY, RISK = "array<struct<category:string,subcategory:string,pattern:string>>", "array<struct<category:string,pattern:string>>"
DOMAIN, MERCHANT = "array<struct<domain:string,category:string,subcategory:string>>", "struct<category:string,subcategory:string,name:string>"


def _groups_by_expression(t: DataFrame, groups: list, risks: list, has) -> dict[str, Column]:
    """Of each group that a row has, the first of its patterns; only groups that are there are looked into."""
    first = lambda ps: F.element_at(F.filter(F.array(*map(F.lit, ps)), lambda p: has(F.concat(F.lit("(?i)"), p))), 1)
    one = lambda ps: F.lit(ps[0]) if len(ps) == 1 else first(ps)
    cat = [F.when(has(F.lit(either(ps))), F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"), one(ps).alias("pattern"))) for (c, s), ps in groups]
    risk = [F.when(has(F.lit(either(ps))), F.struct(F.lit(r).alias("category"), one(ps).alias("pattern"))) for (r,), ps in risks]
    pick = lambda cases, kind: F.array_compact(F.array(*cases)).cast(kind) if cases else F.array().cast(kind)
    return {"_cat": pick(cat, CATEGORY), "_risk": pick(risk, RISK)}


def _groups_by_index(t: DataFrame, key: str, groups: list, risks: list) -> DataFrame:
    """The same, for any number of patterns: (key, _cat, _risk)."""
    numbered = [(kind, i, *(own if kind else (own[0], None)), p) for kind, gs in ((1, groups), (0, risks)) for i, (own, ps) in enumerate(gs) for p in ps]
    found = matches(t, key, ["_t", "_a"], [p for *_, p in numbered])
    table = t.sparkSession.createDataFrame([(n, k, i, c, s, p) for n, (k, i, c, s, p) in enumerate(numbered)], "number int, kind int, place int, category string, subcategory string, pattern string")
    hit = found.join(F.broadcast(table) if len(numbered) <= BROADCAST else table, "number")
    one = hit.groupBy(key, "kind", "place").agg(F.min(F.struct("number", "category", "subcategory", "pattern")).alias("g"))
    sort = lambda kind, *cols: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "g.category", "g.subcategory", "g.pattern")))), lambda g: F.struct(*(g[c].alias(c) for c in cols)))
    return one.groupBy(key).agg(sort(1, "category", "subcategory", "pattern").cast(CATEGORY).alias("_cat"), sort(0, "category", "pattern").cast(RISK).alias("_risk"))


def _domains_of(rows: DataFrame, key: str, urls: str, domains: DataFrame, values: list[str]) -> DataFrame:
    """(key, _dom): what is known about the hosts of a row's urls, in their order. Of several rows of one
    domain the first by its values counts."""
    known = domains.where("domain is not null").groupBy("domain").agg(F.min(F.struct(*values)).alias("d"))
    e = rows.select(key, F.posexplode(urls).alias("_at", "_url")).select(key, "_at", url_domain(F.col("_url")).alias("domain"))
    hit = e.join(known, "domain")
    own = F.array_sort(F.collect_list(F.struct("_at", "domain", *(F.col(f"d.{v}").alias(v) for v in values))))
    return hit.groupBy(key).agg(F.transform(own, lambda x: F.struct(x["domain"].alias("domain"), *(x[v].alias(v) for v in values))).alias("_dom"))


def _domain_expression(urls: str, domains: list, values: list[str]) -> Column:
    table = {}
    for r in sorted(domains, key=lambda r: tuple(r[v] or "" for v in values), reverse=True):
        table[r["domain"]] = r
    m = F.create_map(*(x for k, r in sorted(table.items()) for x in (F.lit(k), F.struct(F.lit(k).alias("domain"), *(F.lit(r[v]).cast("string").alias(v) for v in values)))))
    host = F.transform(F.coalesce(urls, F.array().cast("array<string>")), url_domain)
    return F.array_compact(F.transform(host, lambda x: m[x]))


def _with_domains(t: DataFrame, key: str, urls: str, domains: DataFrame, values: list[str]) -> DataFrame:
    few = domains.where("domain is not null").limit(FEW + 1).collect()
    kind = f"array<struct<domain:string,{','.join(f'{v}:string' for v in values)}>>"
    if len(few) <= FEW:
        return t.withColumn("_dom", _domain_expression(urls, few, values).cast(kind) if few else F.array().cast(kind))
    return t.join(_domains_of(t, key, urls, domains, values), key, "left").withColumn("_dom", F.coalesce("_dom", F.array().cast(kind)))


def classify(rows: DataFrame, rules: DataFrame, key: str, text: str, weights: dict[str, int], urls: str | None = None, domains: DataFrame | None = None, merchants: DataFrame | None = None, label: str | None = None, few: int = FEW) -> DataFrame:
    """A10: (key, category, subcategory, tags, risk_score, explains). key: one row each.

    rules: kind (category or risk), category, subcategory, pattern, priority. A group (subcategory, or
    risk) counts once, by the first of its patterns that the lower-cased text has, with or without its
    diacritics; the first group's category is the row's. Tags are the categories in order, RISK:x for
    risks, and categories of the domains (domain, category, subcategory) of the row's urls. Only a row
    without a category asks the merchants (pattern, name, category, subcategory, priority). A
    whitelisted label takes 10 points off, a blacklisted one adds 30 and a tag. weights: points by
    tag in capitals, with or without RISK_. The sum is kept within 0 to 100.
    """
    own = read(rules, "priority", "pattern")
    t = rows.withColumn("_t", F.lower(F.coalesce(text, F.lit("")))).withColumn("_a", strip_diacritics(F.col("_t")))
    has = lambda p: F.rlike("_t", p) | F.rlike("_a", p)
    groups = grouped([r for r in own if r["kind"] == "category"], "category", "subcategory")
    risks = grouped([r for r in own if r["kind"] == "risk"], "category")
    if len(own) <= few:
        t = t.withColumns(_groups_by_expression(t, groups, risks, has))
    else:
        t = t.join(_groups_by_index(t, key, groups, risks), key, "left")
        t = t.withColumns({"_cat": F.coalesce("_cat", F.array().cast(CATEGORY)), "_risk": F.coalesce("_risk", F.array().cast(RISK))})
    no = F.array().cast("array<string>")
    with_urls = urls is not None and domains is not None
    t = _with_domains(t, key, urls, domains, ["category", "subcategory"]) if with_urls else t.withColumn("_dom", F.array().cast(DOMAIN))
    one = F.coalesce(F.try_element_at("_cat", F.lit(1))["category"], F.try_element_at("_dom", F.lit(1))["category"])
    t = t.withColumn("_mer", F.lit(None).cast(MERCHANT))
    if merchants is not None:
        m = read(merchants, "priority", "pattern")
        worth = lambda r: F.struct(*(F.lit(r[c]).cast("string").alias(c) for c in ("category", "subcategory", "name")))
        if len(m) <= few:
            pick = reduce(lambda out, r: F.when(has(F.lit(f"(?i){r['pattern']}")), worth(r)).otherwise(out), reversed(m), F.lit(None).cast(MERCHANT))
            t = t.withColumn("_mer", F.when(one.isNull(), pick))
        else:
            table = t.sparkSession.createDataFrame([(i, r["category"], r["subcategory"], r["name"]) for i, r in enumerate(m)], "number int, category string, subcategory string, name string")
            first = matches(t.where(one.isNull()), key, ["_t", "_a"], [r["pattern"] for r in m]).groupBy(key).agg(F.min("number").alias("number"))
            first = first.join(F.broadcast(table) if len(m) <= BROADCAST else table, "number").select(key, F.struct("category", "subcategory", "name").cast(MERCHANT).alias("_mer"))
            t = t.drop("_mer").join(first, key, "left")
    c1, d1, both = F.try_element_at("_cat", F.lit(1)), F.try_element_at("_dom", F.lit(1)), lambda x: F.concat_ws(":", x["category"], x["subcategory"])
    category = F.coalesce(c1["category"], d1["category"], F.col("_mer.category"))
    subcategory = F.when(c1["category"].isNotNull(), both(c1)).when(d1["category"].isNotNull(), both(d1)).otherwise(F.col("_mer.subcategory"))
    names = F.concat(F.array_distinct(F.transform("_cat", lambda x: x["category"])), F.transform("_risk", lambda x: F.concat(F.lit("RISK:"), x["category"])))
    tags = F.array_distinct(F.concat(names, F.transform("_dom", lambda x: x["category"]))) if with_urls else names
    explains = [
        F.transform("_cat", lambda x: F.concat(F.lit("category:"), x["category"], F.lit(":"), x["subcategory"], F.lit("|"), x["pattern"], F.lit("|"), x["category"])),
        F.transform("_risk", lambda x: F.concat(F.lit("risk:"), x["category"], F.lit("|"), x["pattern"], F.lit("|"), x["category"])),
        F.transform("_dom", lambda x: F.concat(F.lit("url_domain:"), x["domain"], F.lit("||"), x["category"], F.lit(":"), x["subcategory"])),
        F.when(F.col("_mer.category").isNotNull(), F.array(F.concat(F.lit("merchant_db:"), "_mer.category", F.lit("|"), "_mer.name", F.lit("|"), "_mer.category"))).otherwise(no),
    ]
    t = t.withColumns({"category": category, "subcategory": subcategory, "tags": tags})
    points = F.lit(0)
    if label:
        black, white = F.col(label).eqNullSafe("blacklist"), F.col(label).eqNullSafe("whitelist")
        t = t.withColumn("tags", F.when(black, F.concat("tags", F.array(F.lit("BLACKLISTED")))).otherwise(F.col("tags")))
        points = F.when(white, weights.get("WHITELIST_MATCH", -10)).when(black, weights.get("BLACKLIST_MATCH", 30)).otherwise(0)
        explains.append(F.when(white, F.array(F.lit("memory:whitelist||whitelist"))).when(black, F.array(F.lit("memory:blacklist||blacklist"))).otherwise(no))
    of = F.create_map(*(F.lit(x) for k, v in sorted(({"": 0} | weights).items()) for x in (k, v)))
    worth = lambda x: F.coalesce(of[F.replace(F.upper(x), F.lit(":"), F.lit("_"))], of[F.replace(F.replace(F.upper(x), F.lit(":"), F.lit("_")), F.lit("RISK_"), F.lit(""))], F.lit(0))
    score = points + F.aggregate("tags", F.lit(0), lambda a, x: a + worth(x))
    return t.select(
        key, F.coalesce("category", F.lit("unclassified")).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory"), F.array_join("tags", ",").alias("tags"),
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("risk_score"), F.array_join(F.concat(*explains), ";").alias("explains"),
    )


def all_labels(rows: DataFrame, rules: DataFrame, key: str, text: str, urls: str | None = None, domains: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """every label whose patterns fit, those of the urls' domains too, sorted; and what the row is
    (the entity type of the first label that has one). rules: label, entity_type, pattern. key: one row
    each."""
    own = read(rules, "label", "pattern")
    t = rows.withColumn("_t", F.lower(F.coalesce(text, F.lit(""))))
    groups = grouped(own, "label", "entity_type")
    kind = "array<struct<label:string,entity_type:string>>"
    if len(own) <= few:
        hit = [F.when(F.rlike("_t", F.lit(either(ps))), F.struct(F.lit(g[0]).alias("label"), F.lit(g[1]).cast("string").alias("entity_type"))) for g, ps in groups]
        t = t.withColumn("_hit", F.array_compact(F.array(*hit)).cast(kind) if hit else F.array().cast(kind))
    else:
        flat = [(i, *g, p) for i, (g, ps) in enumerate(groups) for p in ps]
        table = t.sparkSession.createDataFrame([(n, i, label, what) for n, (i, label, what, _) in enumerate(flat)], "number int, place int, label string, entity_type string")
        found = matches(t, key, ["_t"], [p for *_, p in flat]).join(F.broadcast(table) if len(flat) <= BROADCAST else table, "number").select(key, "place", "label", "entity_type").distinct()
        found = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "entity_type"))), lambda x: F.struct(x["label"].alias("label"), x["entity_type"].alias("entity_type"))).cast(kind).alias("_hit"))
        t = t.join(found, key, "left").withColumn("_hit", F.coalesce("_hit", F.array().cast(kind)))
    labels = F.transform("_hit", lambda x: x["label"])
    if urls and domains is not None:
        t = _with_domains(t, key, urls, domains, ["label"])
        labels = F.concat(labels, F.transform("_dom", lambda x: x["label"]))
    typed = F.try_element_at(F.filter("_hit", lambda x: F.coalesce(x["entity_type"], F.lit("")) != ""), F.lit(1))["entity_type"]
    return t.select(key, F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), F.coalesce(typed, F.lit("none")).alias("entity_type"))


def merchant_of(rows: DataFrame, rules: DataFrame, key: str, text: str, few: int = FEW) -> DataFrame:
    """The first rule whose pattern fits, by priority (lenders before all others), the longer
    name on ties. rules: priority, name, category, pattern. key: one row each."""
    m = sorted(read(rules, "priority", "name"), key=lambda r: (r["priority"], -len(r["name"]), r["name"]))
    t = rows.withColumn("_t", F.coalesce(text, F.lit("")))
    if len(m) <= few:
        cases = [(F.col("_t").rlike(r["pattern"]), r) for r in m]
        return t.select(key, first_of([(c, r["name"]) for c, r in cases]).alias("merchant"), first_of([(c, r["category"]) for c, r in cases], "none").alias("category"))
    table = t.sparkSession.createDataFrame([(i, r["name"], r["category"]) for i, r in enumerate(m)], "number int, merchant string, category string")
    first = matches(t, key, ["_t"], [r["pattern"] for r in m], exact=True).groupBy(key).agg(F.min("number").alias("number"))
    first = first.join(F.broadcast(table) if len(m) <= BROADCAST else table, "number")
    return t.select(key).join(first, key, "left").select(key, "merchant", F.coalesce("category", F.lit("none")).alias("category"))


def city_of(text: Column, cities: list[str]) -> Column:
    """The city that a text names as a word, the longest name first."""
    return first_of([(F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}]){c}(?![\p{{L}}\p{{N}}])"), c) for c in sorted(cities, key=lambda c: (-len(c), c))])

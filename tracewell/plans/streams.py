"""The streamed detectors as queries: what is there now, through a stream, to a table.

Each gives what its batch counterpart gives, so SQL holds them to account where state does not
stay open at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import watch_matches
from ..streaming import detectors as D
from . import ledger, notes
from .calls import _DEV, _GAP
from .tables import BANK_TX, CDR, NOTES, TRANSFERS, WITH_C, WITH_X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stream(t, name: str) -> DataFrame:
    """The base table as a stream of files. A stream reads folders and globs."""
    schema = t(name).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{t.dir}/{name}.parquet*")


def _cdr(t) -> DataFrame:
    return t.spark.sql(CDR, events=_stream(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _transfers(t) -> DataFrame:
    return t.spark.sql(TRANSFERS, orders=_stream(t, "orders"))


def _table(t, stream: DataFrame) -> DataFrame:
    at = t.scratch()
    D.run_to_table(stream, f"{at}/out", f"{at}/state")
    return t.spark.read.schema(stream.schema).parquet(f"{at}/out")


query("st1_deduplicate", f"{WITH_C} SELECT subscriber, contact, count(*) AS n FROM c GROUP BY 1, 2")(
    lambda t: _table(t, D.deduplicate((lambda c: c.unionByName(c))(_cdr(t)), ["event_id"])).groupBy("subscriber", "contact").agg(F.count("*").alias("n"))
)


def _alerts(t, run) -> DataFrame:
    at = t.scratch()
    run(f"{at}/out", f"{at}/state")
    return t.spark.read.parquet(f"{at}/out").drop("batch")


#: Windows and sessions come out once the watermark, a day behind the newest record, has passed their end.
_END = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM c)"
_NTZ = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})
query("st2_daily_activity", f"{WITH_C} SELECT subscriber, date_trunc('day', ts) AS from_ts, count(*) AS n FROM c GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_END}")(lambda t: _NTZ(_table(t, D.tumbling(_cdr(t), "subscriber")), "from_ts"))
query("st3_sliding_bursts", f"""{WITH_C}, w AS (SELECT subscriber, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * unnest(range(6)) AS from_ts FROM c)
SELECT subscriber, from_ts, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2 AND from_ts + INTERVAL 30 MINUTE <= {_END}""")(lambda t: _NTZ(_table(t, D.sliding_bursts(_cdr(t), "subscriber", 2)), "from_ts"))
query("st4_sessions", f"""{WITH_C}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY subscriber ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM c), s AS (SELECT *, sum(new) OVER (PARTITION BY subscriber ORDER BY ts) AS session FROM g)
SELECT subscriber, min(ts) AS from_ts, max(ts) + INTERVAL 12 HOUR AS to_ts, count(*) AS n FROM s GROUP BY subscriber, session HAVING max(ts) + INTERVAL 12 HOUR <= {_END}""")(lambda t: _NTZ(_table(t, D.sessions(_cdr(t), "subscriber")), "from_ts", "to_ts"))
query("st5_inactivity_alerts", f"{WITH_C}, {_GAP} SELECT subscriber, event_id, gap_s FROM e WHERE gap_s >= 43200")(lambda t: _alerts(t, lambda out, state: D.inactivity_alerts(_cdr(t), "subscriber", "event_id", out, state)))
query("st6_pass_through", f"""{WITH_X} SELECT d.from_address, d.transfer_id AS deposit_id, w.transfer_id AS withdrawal_id FROM x d JOIN x w ON d.from_address = w.from_address AND w.ts_s - d.ts_s BETWEEN 0 AND 86400 WHERE d.tx_type = 'deposit' AND w.tx_type = 'withdrawal'""")(
    lambda t: _table(
        t,
        D.pass_through(
            _transfers(t).where("tx_type = 'deposit'").select("from_address", F.col("transfer_id").alias("deposit_id"), F.timestamp_seconds("ts_s").alias("t1")),
            _transfers(t).where("tx_type = 'withdrawal'").select("from_address", F.col("transfer_id").alias("withdrawal_id"), F.timestamp_seconds("ts_s").alias("t2")),
            "from_address",
        ),
    )
)
query("st7_enrich", f"{WITH_X} SELECT transfer_id, n_name AS watched FROM x LEFT JOIN nation ON to_address = concat('w', CAST(n_nationkey AS VARCHAR))")(
    lambda t: _table(t, D.enrich(_transfers(t), t("nation").select(F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("to_address"), F.col("n_name").alias("watched")), "to_address").select("transfer_id", "watched"))
)
def _devices(t) -> DataFrame:
    return _cdr(t).withColumns({"device": F.when(F.col("k") % 5 != 0, F.concat(F.lit("dev"), (F.col("k") % 3).cast("string"))), "domain": F.when(F.col("record_type") == "DATA", "data").otherwise("voice")})


query("st8_device_changes", f"{_DEV}, l AS (SELECT *, lag(device) OVER (PARTITION BY subscriber, domain ORDER BY ts, event_id) AS b FROM d WHERE k % 5 <> 0) SELECT subscriber, domain, event_id, b AS from_device, device AS to_device FROM l WHERE b <> device")(
    lambda t: _alerts(t, lambda out, state: D.device_change_alerts(_devices(t), "subscriber", "event_id", out, state))
)


#: Fixed lists of this query: points by tag.
RISK_WEIGHTS = [("PRIVACY", 30.0), ("OUT", 12.5), ("LARGE", 25.0), ("UNUSED", 50.0)]


def _tagged(rows: DataFrame) -> DataFrame:
    tag = lambda c, name: F.when(F.expr(c), name)
    tags = F.array_compact(F.array(tag("token = 'XMR'", "privacy"), tag("tx_type = 'withdrawal'", "out"), tag("tx_type = 'withdrawal'", "OUT"), tag("amount > 300000", "Large"), tag("token = 'ETH'", "no weight")))
    return rows.select("from_address", "amount", F.col("transfer_id").alias("tx_id"), tags.alias("tags"))


@query("st9_rolling_risk", f"""{WITH_X}, w(tag, weight) AS (VALUES {", ".join(map(str, RISK_WEIGHTS))}), a AS (SELECT from_address, CAST(sum(amount) AS DOUBLE) AS total FROM x GROUP BY 1),
t AS (SELECT from_address, 'PRIVACY' AS tag, amount FROM x WHERE token = 'XMR' UNION ALL SELECT from_address, 'OUT', amount FROM x WHERE tx_type = 'withdrawal' UNION ALL SELECT from_address, 'LARGE', amount FROM x WHERE amount > 300000),
g AS (SELECT from_address, tag, CAST(sum(amount) AS DOUBLE) / max(total) * 100 AS pct FROM t JOIN a USING (from_address) GROUP BY 1, 2),
r AS (SELECT from_address, round(least(sum(CASE WHEN pct < 10 THEN least(weight, weight * pct / 10) ELSE weight END), 100), 4) AS score, count(*) AS reasons FROM g JOIN w USING (tag) GROUP BY 1)
SELECT from_address, coalesce(score, 0) AS score, coalesce(reasons, 0) AS reasons FROM a LEFT JOIN r USING (from_address)""")
def st9(t):
    at = t.scratch()
    weights = t.spark.createDataFrame(RISK_WEIGHTS, "tag string, weight double")
    D.rolling_risk(_tagged(_transfers(t)), "from_address", weights, f"{at}/out", f"{at}/state")
    return D.latest_risk(t.spark, f"{at}/out", "from_address").drop("version")


def _by_rules(t, stream: DataFrame, tables: dict[str, DataFrame], found) -> DataFrame:
    """The stream against the first version of each table."""
    at = t.scratch()
    for name, df in tables.items():
        D.put_version(df, f"{at}/{name}")
    D.by_rules(stream, f"{at}/out", f"{at}/state", {name: f"{at}/{name}" for name in tables}, found)
    return t.spark.read.parquet(f"{at}/out").drop("batch", *(f"{name}_version" for name in tables))


@query("st7_rules", notes.SQL["a10_rule_engine"])
def st7_rules(t):
    rows = t.spark.sql(NOTES, bank=t.spark.sql(BANK_TX, orders=_stream(t, "orders")))
    return _by_rules(t, notes.rule_rows(rows), notes.rule_tables(t.spark), lambda df, now: notes.classified(df, now))


@query("st7_watch", ledger.SQL["x1_watch_matches"])
def st7_watch(t):
    watch, contracts, column = ledger._lists(t)
    return _by_rules(t, ledger.with_contract(_transfers(t)), {"watch": watch, "contracts": contracts}, lambda df, now: watch_matches(df, now["watch"], now["contracts"], column))

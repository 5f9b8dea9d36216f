"""The canonical tables, made from the base tables by one SQL text that Spark and the oracle share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

BANK_TX = """SELECT o_orderkey AS tx_id, CAST((o_custkey - o_custkey % 64) / 64 AS BIGINT) AS account_id,
  DATE '2024-01-01' + CAST((o_orderkey * 7919) % 365 AS INT) AS booking_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction,
  CASE o_orderkey % 7 WHEN 0 THEN 'CARD' WHEN 1 THEN 'TRANSFER' WHEN 2 THEN 'BLIK_P2P'
    WHEN 3 THEN 'BLIK_MERCHANT' WHEN 4 THEN 'CASH' WHEN 5 THEN 'FEE' ELSE 'OTHER' END AS channel,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'gambling' WHEN '2-HIGH' THEN 'loans'
    WHEN '3-MEDIUM' THEN 'crypto' WHEN '5-LOW' THEN 'risky' ELSE 'everyday' END AS category,
  concat('CP', CAST(CAST((o_custkey - o_custkey % 256) / 256 AS BIGINT) * 97 + (o_orderkey * 31 + o_custkey) % 97 AS STRING)) AS counterparty
FROM {orders}"""

CDR = """SELECT event_id, user_id AS subscriber, ts, value,
  CASE event_type WHEN 'click' THEN 'CALL_OUT' WHEN 'signup' THEN 'CALL_IN' WHEN 'view' THEN 'SMS_OUT'
    WHEN 'purchase' THEN 'SMS_IN' ELSE 'DATA' END AS record_type,
  concat('+48', CAST(500000000 + CAST((user_id - user_id % 50) AS BIGINT) * 4 + (event_id * 7919) % 40 AS STRING)) AS contact,
  CAST(FLOOR(value * 20) AS BIGINT) AS duration_seconds,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  concat('BTS-', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 12 AS STRING)) AS place
FROM {events}"""

#: Located records: twelve sites some tens of kilometres apart; two of three subscribers roam now and then.
MOVES = """SELECT event_id, user_id AS subscriber, ts, k, CAST(50 + 0.7 * (k % 4) + 0.004 * (k % 3) AS DOUBLE) AS lat, CAST(19 + 0.9 * (CAST((k - k % 4) / 4 AS INT) % 3) + 0.003 * (k % 2) AS DOUBLE) AS lon,
  user_id % 3 <> 0 AND k >= 80 AS roaming, CASE WHEN user_id % 3 <> 0 AND k >= 80 THEN CASE k % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' ELSE 'CZ' END END AS country
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e"""

#: Billing records with both ends, as an operator delivers them: some without direction, forwarded, to special numbers.
BILLING = """SELECT event_id, subscriber, ts, own, CASE WHEN event_id % 2 = 0 THEN own ELSE other END AS caller, CASE WHEN event_id % 2 = 0 THEN other ELSE own END AS callee, other AS contact,
  CASE event_type WHEN 'click' THEN 'CALL' WHEN 'signup' THEN 'CALL_IN' WHEN 'view' THEN 'SMS' WHEN 'purchase' THEN 'SMS_IN' WHEN 'error' THEN 'CALL_FORWARDED' ELSE 'DATA' END AS record_type,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 1.5 END AS cost, duration_seconds, concat(CASE k % 5 WHEN 0 THEN '35332208' WHEN 1 THEN '35332299' WHEN 2 THEN '86012304' WHEN 3 THEN '99000001' ELSE '01234567' END, '123456') AS imei,
  CASE k % 9 WHEN 0 THEN 'Vodafone DE' WHEN 1 THEN 'T-Mobile' ELSE 'Orange' END AS network, CASE WHEN k % 11 = 4 THEN CASE WHEN k % 2 = 0 THEN 'DE' ELSE 'CZ' END END AS country,
  CASE k % 13 WHEN 0 THEN 'WhatsApp call' WHEN 1 THEN 'telegram message to viber' WHEN 2 THEN 'internet' END AS service, CASE WHEN k % 17 = 3 THEN '+48500999888' WHEN k % 17 = 4 THEN own END AS related,
  concat(CASE k % 4 WHEN 0 THEN 'Warszawa' WHEN 1 THEN 'Łódź' WHEN 2 THEN 'Gdańsk' ELSE 'Radom' END, ', ul. ', CAST(k % 6 AS STRING)) AS place, k
FROM (SELECT event_id, user_id AS subscriber, ts, event_type, concat('+48', CAST(700000000 + user_id AS STRING)) AS own, CAST(FLOOR(value * 90) AS BIGINT) AS duration_seconds, k,
    CASE k % 25 WHEN 0 THEN '112' WHEN 1 THEN 'internetipv6' WHEN 2 THEN '+48801123456' WHEN 3 THEN '*100#' WHEN 4 THEN '+881612345678' WHEN 5 THEN '+870773112233' WHEN 6 THEN 'Facebook' WHEN 7 THEN '375295434940' WHEN 8 THEN 'mBank24'
      WHEN 9 THEN '+48700123456' WHEN 10 THEN '1234567' WHEN 11 THEN '+491701234567' WHEN 12 THEN CAST(NULL AS STRING) ELSE concat('+48', CAST(500000000 + CAST((user_id - user_id % 50) AS BIGINT) * 4 + event_id * 7919 % 30 AS STRING)) END AS other
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e) b"""

TRANSFERS = """SELECT o_orderkey AS transfer_id, 1704067200 + (o_orderkey * 483059) % 31536000 AS ts_s,
  concat('w', CAST(CAST((o_custkey - o_custkey % 32) / 32 AS BIGINT) AS STRING)) AS from_address,
  concat('w', CAST(CAST((o_orderkey - o_orderkey % 320) / 320 AS BIGINT) + o_orderkey % 3 AS STRING)) AS to_address,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE o_orderkey % 6 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'PEPE' WHEN 3 THEN 'XMR'
    WHEN 4 THEN 'PLN' ELSE 'USDT' END AS token,
  CASE (o_orderkey + o_custkey) % 5 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'buy'
    WHEN 3 THEN 'sell' ELSE 'transfer' END AS tx_type
FROM {orders}"""

#: Bank transactions with what a statement says of them: title, payee, the bank's code, the holder.
NOTES = """SELECT b.*, CASE tx_id % 20 WHEN 0 THEN 'Orlen stacja 7 Kraków' WHEN 1 THEN 'BLIK przelew na telefon' WHEN 2 THEN 'blik zakup w internecie Biedronka' WHEN 3 THEN 'Biedronka 112 Warszawa'
    WHEN 4 THEN 'Lidl Gdańsk' WHEN 5 THEN 'spłata raty pożyczki' WHEN 6 THEN 'zakład https://www.bet.example/p?x=1 oraz http://shop.example' WHEN 7 THEN 'Shell Łódź' WHEN 8 THEN 'blik kod 123'
    WHEN 9 THEN 'karta 4246 xxxx xxxx 9674 Warszawa' WHEN 10 THEN 'płatność kartą *9674' WHEN 11 THEN 'rachunek PL61109010140000071219812874 czynsz' WHEN 12 THEN 'wynagrodzenie 73 1140 2004 0000 3002 0135 5387'
    WHEN 13 THEN 'karta 5500XXXXXXXX1111' WHEN 14 THEN 'Orlen Warszawa' WHEN 15 THEN 'nr rachunku: 10105000997603123456789123 przelew na telefon' WHEN 16 THEN 'ref 61109010140000071219812874'
    WHEN 17 THEN 'przelew DE89370400440532013000 własny' WHEN 18 THEN 'płatność kartą bez numeru' ELSE 'przelew zwykły' END AS title,
  CASE tx_id % 7 WHEN 0 THEN 'Jan Kowalski' WHEN 1 THEN 'Anna Kowalska' WHEN 2 THEN 'Kowalski Jan; ul. Długa 5' WHEN 3 THEN 'Firma Sp. z o.o.' WHEN 4 THEN 'Piotr Nowak' WHEN 5 THEN 'Maria Wiśniewska' ELSE 'Sklep 24' END AS payee,
  CASE tx_id % 11 WHEN 0 THEN 'P.BLIK' WHEN 1 THEN 'ST.ZLEC' WHEN 2 THEN 'TR.KART' ELSE '' END AS bank_category, 'Jan Kowalski' AS holder
FROM {bank} b"""

#: An exchange's records. g: the owner's number; owners differ in tokens, kinds of records, pace and amounts.
EXCHANGE = """SELECT row_id, concat('u', CAST(g AS STRING)) AS owner, 1704067200 + (row_id * 483059) % (86400 * (10 + 70 * (g % 6))) AS ts_s,
  CASE WHEN g % 5 = 0 THEN CASE row_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'XMR' ELSE 'PLN' END ELSE concat('T', CAST(row_id % (3 + 9 * (g % 5)) AS STRING)) END AS token,
  CAST(CASE WHEN g % 4 = 1 THEN FLOOR(price / 4000) ELSE FLOOR(price) END AS DECIMAL(18,2)) AS amount,
  CASE WHEN g % 7 = 3 THEN CASE WHEN row_id % 5 = 0 THEN 'staking_reward' ELSE 'deposit' END ELSE
    CASE (row_id * 7 + o_custkey) % 11 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal' WHEN 2 THEN 'buy' WHEN 3 THEN 'sell' WHEN 7 THEN 'fiat_deposit' WHEN 8 THEN 'fiat_withdrawal' WHEN 9 THEN 'transfer' ELSE 'swap' END END AS tx_type,
  CASE (row_id * 3 + g) % 4 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN '' END AS side,
  CASE WHEN row_id % 9 <> 0 THEN concat('M', CAST(row_id % 13 AS STRING)) END AS market, CASE WHEN row_id % 8 <> 0 THEN concat('Q', CAST(row_id % 3 AS STRING)) END AS quote_token,
  CAST(FLOOR(price / 7) AS DECIMAL(18,2)) AS total_value, CASE WHEN g % 3 <> 0 THEN CAST(FLOOR(price / CASE WHEN g % 2 = 0 THEN 100 ELSE 5 END) AS DECIMAL(18,2)) END AS fiat_value,
  CASE row_id % 37 WHEN 0 THEN 'Airdrop' WHEN 1 THEN 'interest' END AS category,
  CASE WHEN g % 6 = 5 AND row_id % 9 = 0 THEN 'Margin Order' WHEN row_id % 17 = 0 THEN 'Card Transaction' WHEN row_id % 19 = 0 THEN 'P2P' WHEN row_id % 11 = 0 THEN 'Pay' ELSE 'Ledger' END AS sheet,
  CASE WHEN row_id % 4 = 0 THEN CAST(row_id % 23 AS DECIMAL(18,2)) END AS fee, CASE row_id % 3 WHEN 0 THEN 'BNB' WHEN 1 THEN 'BTC' END AS fee_coin,
  CASE row_id % 6 WHEN 0 THEN 'TRX' WHEN 1 THEN 'ETH' WHEN 2 THEN 'bep20' END AS network, CASE WHEN row_id % 3 <> 1 THEN concat('c', CAST(g + row_id % 7 AS STRING)) END AS counterparty,
  CASE WHEN row_id % 2 = 0 THEN 'IN' ELSE 'OUT' END AS direction, CASE row_id % 5 WHEN 0 THEN 'bank' WHEN 1 THEN 'cash' END AS payment_method,
  CASE row_id % 3 WHEN 0 THEN 'FILLED' WHEN 1 THEN 'CANCELED' ELSE 'NEW' END AS status, CASE WHEN row_id % 5 <> 0 THEN concat('0xA', CAST(g + row_id % 4 AS STRING)) END AS from_address, row_id % 7 = 0 AS internal
FROM (SELECT o_orderkey AS row_id, o_custkey, o_totalprice AS price, CAST((o_custkey - o_custkey % 32) / 32 AS BIGINT) AS g FROM {orders}) o"""

TURNS = """SELECT conv_id, turn, role AS speaker, turn * 10.0 AS t0, turn * 10.0 + 4 + length(text) % 9 AS t1
FROM {conversations}"""

#: For the oracle: the canonical tables as common table expressions.
WITH_B = f"WITH b AS ({BANK_TX.format(orders='orders')})"
WITH_C = f"WITH c AS ({CDR.format(events='events')})"
WITH_M = f"WITH p AS ({MOVES.format(events='events')})"
WITH_L = f"WITH l AS ({BILLING.format(events='events')})"
WITH_X = f"WITH x AS ({TRANSFERS.format(orders='orders')})"
WITH_N = f"WITH n AS ({NOTES.format(bank=f"({BANK_TX.format(orders='orders')})")})"
WITH_E = f"WITH e AS ({EXCHANGE.format(orders='orders')})"
WITH_T = f"WITH t AS ({TURNS.format(conversations='conversations')})"


class Tables:
    """Base tables by name, canonical ones as attributes; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def scratch(self) -> str:
        """A new folder that driver and executors share."""
        return new_folder(self.spark, "plans")

    @cached_property
    def bank(self) -> DataFrame:
        return self.spark.sql(BANK_TX, orders=self("orders"))

    @cached_property
    def cdr(self) -> DataFrame:
        return self.spark.sql(CDR, events=self("events")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    @cached_property
    def billing(self) -> DataFrame:
        return self.spark.sql(BILLING, events=self("events")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    @cached_property
    def moves(self) -> DataFrame:
        return self.spark.sql(MOVES, events=self("events")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    @cached_property
    def transfers(self) -> DataFrame:
        return self.spark.sql(TRANSFERS, orders=self("orders"))

    @cached_property
    def notes(self) -> DataFrame:
        return self.spark.sql(NOTES, bank=self.bank)

    @cached_property
    def exchange(self) -> DataFrame:
        return self.spark.sql(EXCHANGE, orders=self("orders"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.spark.sql(TURNS, conversations=self("conversations"))

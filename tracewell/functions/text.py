"""Scalar expressions over text: cleaning, identifiers, hashes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and what they are without their marks (the stroked l has none).
MARKED, PLAIN = "ĄĆĘŃÓŚŹŻąćęńóśźż", "ACENOSZZacenoszz"


def clean_text(c: Column) -> Column:
    """Upper case, no white space at the ends, single spaces; null is empty."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def strip_diacritics(c: Column, fold_l: bool = False) -> Column:
    return F.translate(c, MARKED + "Łł", PLAIN + "Ll") if fold_l else F.translate(c, MARKED, PLAIN)


def tx_hash(date: Column, amount: Column, counterparty: Column, title: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of date, amount and the texts' beginnings."""
    key = F.concat_ws("|", date.cast("string"), amount.cast("string"), F.substring(counterparty, 1, 50), F.substring(title, 1, 100))
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?i)https?://[^\s,;\"'<>]+"), 0)


def url_domain(c: Column) -> Column:
    """Host without scheme, port and www."""
    host = F.regexp_replace(F.lower(c), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(host, r"[/:?#].*$", ""), r"^www\.", "")


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found, in the order given."""
    out = F.lit(default)
    for label, p in reversed(patterns):
        out = F.when(text.rlike(p), F.lit(label)).otherwise(out)
    return out


#: Bank codes and text patterns of the channels, in order.
BANK_CODES = [("CARD", "TR.KART"), ("TRANSFER", "PRZELEW"), ("BLIK", "P.BLIK"), ("BLIK_MERCHANT", "TR.BLIK"), ("TRANSFER", "ST.ZLEC"), ("FEE", "OPŁATA"), ("FEE", "OPLATA"), ("FEE", "PROWIZJA"), ("FEE", "ODSETKI")]
PHONE_TRANSFER = r"przelew\s*(na|z)\s*telefon"
CHANNEL_PATTERNS = [
    ("CARD", r"kart[aąy]|card|visa|mastercard|maestro"),
    ("CASH", r"bankomat|atm|wyp[łl]ata\s*got[oó]wk|wp[łl]ata\s*got[oó]wk"),
    ("REFUND", r"zwrot|refund|korekta"),
    ("FEE", r"op[łl]ata|prowizja|odsetki|fee|commission"),
    ("TRANSFER", r"przelew|transfer|zleceni"),
]


def channel(bank_code: Column, title: Column, counterparty: Column) -> Column:
    """Bank code first, then the texts; BLIK is person to person only for transfers to a phone."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(counterparty, F.lit(""))))
    blik = F.when(text.rlike(PHONE_TRANSFER), "BLIK_P2P").otherwise("BLIK_MERCHANT")
    out = F.when(text.contains("blik"), blik).otherwise(first_match(text, CHANNEL_PATTERNS, "OTHER"))
    code = F.upper(F.coalesce(bank_code, F.lit("")))
    for label, c in reversed(BANK_CODES):
        out = F.when(code.contains(c), blik if label == "BLIK" else F.lit(label)).otherwise(out)
    return out


def iban_valid(c: Column) -> Column:
    """MOD-97 by a fold over the digits of the rearranged number."""
    n = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    digits = F.split(F.concat(F.substring(n, 5, 40), F.substring(n, 1, 4)), "")
    code = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0), lambda a, x: F.when(code(x) > 9, (a * 100 + code(x)) % 97).otherwise((a * 10 + code(x)) % 97))
    return F.coalesce(n.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def luhn_valid(c: Column) -> Column:
    """Check digit of a 15-digit device number (or any digits) by a fold from the right."""
    d = F.reverse(F.regexp_replace(c, r"\D", ""))
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)), F.lit(0)))
    return (F.length(d) > 0) & (total % 10 == 0)


def phone(c: Column) -> Column:
    """Digits and a leading plus; 00 becomes +, nine digits or a leading 48 are Polish."""
    n = F.regexp_replace(c, r"[^0-9+]", "")
    n = F.regexp_replace(n, r"^00", "+")
    return F.when(n.rlike(r"^[0-9]{9}$"), F.concat(F.lit("+48"), n)).when(n.rlike(r"^48[0-9]{9}$"), F.concat(F.lit("+"), n)).otherwise(n)


def duration_seconds(c: Column) -> Column:
    """Seconds of h:mm:ss, m:ss or plain seconds."""
    p = F.split(F.trim(c), ":")
    n = F.size(p)
    at = lambda i: F.try_element_at(p, F.lit(i)).cast("int")
    return F.when(n == 3, at(1) * 3600 + at(2) * 60 + at(3)).when(n == 2, at(1) * 60 + at(2)).otherwise(at(1))

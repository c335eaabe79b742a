"""Synthetic labelled messages from templates, reproducible for a seed.

Every choice is a hash of (row id, seed, slot), so rows can be made in any order
on any number of executors and always come out the same.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.literals import str_array

# Own wording; slots in braces are filled from SLOTS.
SCAM_TEMPLATES: dict[str, list[str]] = {
    "job_scam": ["You have been selected for a remote post at {company}. Send the {fee} registration fee first.",
                 "Work from home and earn up to {amount} a week, no experience needed. Reply on WhatsApp."],
    "banking_scam": ["{bank}: your card will be blocked. Verify your account within {hrs} hours: {url}",
                     "{bank} needs your KYC again. Enter the one-time code at {url}"],
    "investment_scam": ["Guaranteed returns of {pct}% daily on {crypto}. Minimum investment {amount}, deposit now.",
                        "Double your money with our {crypto} plan, closing soon."],
    "delivery_scam": ["Your parcel from {platform} is on hold. Pay the {fee} delivery fee: {url}",
                      "Failed delivery by {platform}. Confirm your address within {hrs} hours at {url}"],
    "lottery_scam": ["Congratulations {name}, you have won {amount}. Pay the {fee} claim fee to {email}.",
                     "Winner of the lucky draw: claim your prize of {amount} today."],
    "tech_support_scam": ["Virus detected on your computer. Call {phone} immediately.",
                          "{platform}: we need remote access, install this app from {url}"],
    "romance_scam": ["My darling, I am on an oil rig and need {amount} by western union.",
                     "I love you, help me with {amount} for visa fees."],
    "account_takeover": ["Unusual activity on your {platform} account. Reset your password at {url}",
                         "A new device was used. Verify your identity at {url}"],
    "crypto_scam": ["Enter your recovery phrase at {url} to keep your {crypto}.", "Send BTC to join the mining pool and get {amount}."],
    "advance_fee": ["An inheritance of {amount} awaits. Pay the {fee} legal fee to {email}.",
                    "Your {amount} payout needs a {fee} transfer fee first."],
}
BENIGN_TEMPLATES = [
    "Hi {name}, our meeting is at 10am on {date}.",
    "Your order from {company} has shipped. See {url}",
    "Lunch with the {company} team next Tuesday?",
    "Reminder: dentist on {date}. Call {phone} to move it.",
    "Thanks for joining the {platform} newsletter.",
]
SLOTS: dict[str, list[str]] = {
    "name": ["Ana Ruiz", "Ben Frost", "Chloe Wu", "Dele Ade"],
    "company": ["Alder Ltd", "Birch Co", "Cedar Inc", "Dune Works"],
    "platform": ["PayPal", "Microsoft", "Apple", "DHL"],
    "bank": ["Harbor Bank", "Summit Bank", "Valley Credit Union"],
    "crypto": ["Bitcoin", "Ethereum", "USDT"],
    "amount": ["$2,450", "$500", "$9,999", "$150"],
    "fee": ["$49", "$99", "$120"],
    "pct": ["5", "9", "12", "20"],
    "hrs": ["6", "12", "24"],
    "phone": ["+1-555-0100", "555-0167"],
    "email": ["desk@agency.example", "claims@office.example"],
    "date": ["3 May", "14 June", "22 July"],
}
SCAM_HOSTS = ["verify-account.example", "parcel-info.example", "prize-claim.example"]
BENIGN_HOSTS = ["example.com", "news.example.org", "shop.example.net"]
SHORT_HOSTS = ["bit.ly", "tinyurl.com", "is.gd"]


def draw(row: Column, seed: int, slot: str, size: int) -> Column:
    """A number in 0..size-1 fixed by row, seed and slot."""
    text = F.concat(row.cast("string"), F.lit(f":{seed}:{slot}"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(size))


def _pick(row: Column, seed: int, slot: str, values: list[str]) -> Column:
    return F.element_at(str_array(values), (draw(row, seed, slot, len(values)) + 1).cast("int"))


def generate_synthetic(rows: DataFrame, seed: int = 7, key: str = "id", scam: dict[str, list[str]] = SCAM_TEMPLATES,
                       benign: list[str] = BENIGN_TEMPLATES) -> DataFrame:
    """One labelled message per row of ``rows`` (for example ``spark.range(n)``).

    Ten scam categories in equal shares, benign rows at 1.6 times a category's
    share; 85 % of scam and 20 % of benign rows carry a URL, of which 30 % are
    shortened and 30 % plain http; half of the scam texts are in capitals.
    """
    row = F.col(key)
    cats = list(scam)
    parts = 10 * len(cats) + 16
    df = rows.select(row, draw(row, seed, "class", parts).alias("_c"))
    df = df.withColumn("category", F.when(F.col("_c") >= 10 * len(cats), F.lit("benign")).otherwise(
        F.element_at(str_array(cats), (F.floor(F.col("_c") / 10) + 1).cast("int"))))
    text = _pick(row, seed, "t:benign", benign)
    for c in cats:
        text = F.when(F.col("category") == c, _pick(row, seed, f"t:{c}", scam[c])).otherwise(text)
    is_scam = F.col("category") != "benign"
    has_url = draw(row, seed, "has_url", 100) < F.when(is_scam, 85).otherwise(20)
    host = F.when(draw(row, seed, "short", 100) < 30, _pick(row, seed, "short_host", SHORT_HOSTS)).when(
        is_scam, _pick(row, seed, "scam_host", SCAM_HOSTS)).otherwise(_pick(row, seed, "benign_host", BENIGN_HOSTS))
    scheme = F.when(draw(row, seed, "plain", 100) < 30, "http://").otherwise("https://")
    url = F.when(has_url, F.concat(scheme, host, F.lit("/login?u="), (draw(row, seed, "u", 9000) + 1000).cast("string"))).otherwise(
        F.lit("our site"))
    df = df.withColumns({"text": text, "_url": url})
    filled = F.replace(F.col("text"), F.lit("{url}"), F.col("_url"))
    for slot, values in SLOTS.items():
        filled = F.replace(filled, F.lit("{" + slot + "}"), _pick(row, seed, slot, values))
    loud = is_scam & (draw(row, seed, "loud", 2) == 0)
    df = df.withColumn("text", filled)
    return df.select(key, F.when(loud, F.upper("text")).otherwise(F.col("text")).alias("text"),
                     F.when(is_scam, "scam").otherwise("benign").alias("label"), "category")

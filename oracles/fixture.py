"""The ``messages`` view over the driver's tables, in Spark and in DuckDB SQL.

The raw tables hold no scam wording, so each event is joined to one of a few
dozen templates (own wording) by ``event_id`` and its slots are filled from the
event.  Documents, conversation turns and page URLs join the view whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lureframe.operators.reputation import estimated_bytes

# (is_scam, category, minimum level, text or None, urls separated by blanks, note)
TEMPLATES: list[tuple[bool, str, str, str | None, str, str]] = [
    (True, "job_scam", "MEDIUM", "You have been selected for an online job. No experience needed, earn up to ${amt} daily. Pay the registration fee of ${n} to confirm your seat. Reply on WhatsApp.", "", ""),
    (True, "job_scam", "MEDIUM", "Your CV was shortlisted! Only a few openings, limited seats. Send the refundable deposit of ${amt} within {hrs} hours and contact us on whatsapp.", "", "HARD POSITIVE short"),
    (True, "banking_scam", "HIGH", "Alder Bank alert: your card will be blocked and your account will be suspended. Verify your account within 24 hours at https://alder-bank-secure{n}.example/verify and enter the one-time code {code}.", "", ""),
    (True, "banking_scam", "MEDIUM", "KYC notice: complete your KYC and update your details now at http://kyc-update.example/u{n} or your account will be frozen. Reply with the OTP {code}.", "", ""),
    (True, "banking_scam", "LOW", "Good news, a refund of ${amt} is ready. Credit back takes {hrs} hours. Login verification is required: provide your bank details.", "", ""),
    (True, "investment_scam", "MEDIUM", "Our plan guarantees {hrs}% monthly returns with zero risk. Minimum investment is ${amt}, deposit now, the offer closes tonight. Your personal manager will call.", "", ""),
    (True, "investment_scam", "MEDIUM", "Guaranteed high returns! Double your money with a risk-free investment, limited time, act now. Join the signal group and top up your initial deposit of {amt} USD.", "", ""),
    (True, "payment_scam", "MEDIUM", "Purchase a $200 Amazon gift card and send us the redemption code {code} immediately. Do not tell anyone.", "", "HARD POSITIVE gift card"),
    (True, "payment_scam", "LOW", "I overpaid you by {amt} EUR by mistake. Please send the difference by wire before 12:30. An advance payment of the shipping fee is also due.", "", ""),
    (True, "romance_scam", "LOW", "My darling, I love you. I am deployed on an oil rig overseas and can't afford the visa fees. Please wire me ${amt} via Western Union.", "", ""),
    (True, "romance_scam", "LOW", "Sweetheart, marry me. I need money for the flight and the hospital bills, help me with {amt} dollars. Send it via MoneyGram.", "", ""),
    (True, "tech_support_scam", "MEDIUM", "Virus detected: your computer is infected, error code {code}. Call Windows support on {phone} and install this app for remote access with AnyDesk.", "", ""),
    (True, "tech_support_scam", "LOW", "Your subscription renewal failed. Renew your license for Windows Defender, pay the renewal fee of ${amt} and download apk from www.support-download.example.", "", ""),
    (True, "impersonation_scam", "MEDIUM", "This is the police legal department. A warrant for your arrest was issued by the government. Pay the penalty of ${amt} immediately, call {phone}.", "", ""),
    (True, "impersonation_scam", "MEDIUM", "Hi, this is the CEO. I have an urgent favor: buy gift cards worth {amt} dollars and send me the codes. The executive team must not know.", "", ""),
    (True, "delivery_scam", "LOW", "Your parcel could not be delivered and will be returned to sender. Confirm your address and pay the redelivery fee of $2.{n} at http://track-parcel.example/{n} within 48 hours.", "", ""),
    (True, "delivery_scam", "LOW", "DHL: your package waits at customs. Pay to receive it, delivery fee ${amt}. Track your package with tracking number {code} at https://dhl-redelivery{n}.example.net/pay", "", ""),
    (True, "lottery_scam", "MEDIUM", "Congratulations! You have won ${amt},000 in the lucky draw. Claim your prize now: pay the tax and the processing fee to release it. Email claims{n}@lucky-draw.example.org", "", ""),
    (True, "lottery_scam", "LOW", "Winner! Your lucky number won a jackpot and a bonus. Release your winnings with a claim fee of {amt} pounds by 12/05/2026.", "", ""),
    (True, "account_takeover", "MEDIUM", "Unusual activity: someone tried a sign-in attempt from a new device. Verify your identity and reset your password at http://login-secure-verify{n}.xyz/account?token={code}", "", ""),
    (True, "account_takeover", "LOW", "Your account was recently logged in from abroad, unauthorized access. Secure your account now: enter your password on our page.", "", ""),
    (True, "identity_theft", "MEDIUM", "To proceed, upload your ID card and a selfie with your passport number. Also provide your date of birth, full name and home address, mother's maiden name and SSN.", "", ""),
    (True, "identity_theft", "LOW", "We need a bank statement and your driver's license. Submit your routing number and social security number by 3rd May 2026.", "", ""),
    (True, "advance_fee", "MEDIUM", "An inheritance from the estate of a client was left for you. Your share of {amt},000,000 USD is unclaimed. Send the legal fee and transfer fee of ${n} to start.", "", ""),
    (True, "advance_fee", "LOW", "Your funds need a tax clearance and a processing charge. Pay the administration fee of ${amt} on May 12, 2026.", "", ""),
    (True, "crypto_scam", "MEDIUM", "Enter your recovery phrase and private key to import your wallet at https://wallet-verify.example/restore/{n} or you will lose your coins permanently.", "", ""),
    (True, "crypto_scam", "LOW", "Send 0.05 BTC to our crypto address bc1 and get BTC back. Mining pool, trading bot, airdrop and staking rewards. Double your bitcoin, first {hrs} people only.", "", ""),
    (True, "phishing", "MEDIUM", "Dear customer, suspicious activity was found. Click here to verify your details: http://paypa1-login{n}.example.com/webscr?email=u{n}@mail.example", "", ""),
    (True, "phishing", "LOW", "A shared document has been prepared in the document portal. Access it at https://docs-share{n}.example.com/view?token={code}. The link is valid for one day.", "", "HARD POSITIVE document"),
    (True, "phishing", "LOW", "Urgent action required: your mailbox expires. Log in to update your information, last warning, final notice.", "", ""),
    (True, "phishing", "MEDIUM", None, "http://paypa1-secure-login{n}.example.com/account/verify", ""),
    (True, "phishing", "MEDIUM", None, "https://xn--80ak6aa92e.com/login?next={n}", "HARD POSITIVE punycode"),
    (True, "phishing", "MEDIUM", None, "http://185.199.108.{hrs}/login/{n}", ""),
    (True, "phishing", "LOW", None, "https://secure-login.account-verify.billing-update.shop{n}.example.com/confirm  http://amaz0n-order-{n}.tk/signin?redirect=a&password=b", ""),
    (True, "phishing", "LOW", "please look", "http://microsooft-login.example/{n} https://netflix.billing-{n}.example.org/update/..%2f/@x", ""),
    (False, "unknown", "LOW", None, "https://www.paypal.com/account/login?n={n}", "HARD NEGATIVE official"),
    (False, "unknown", "LOW", None, "https://bit.ly/x{n}", "HARD NEGATIVE shortener"),
    (False, "unknown", "LOW", None, "https://docs.example.co.uk/a/b/c/{n}.html?q={n}#top HTTPS://User:pw@Sub.Example.COM.:8080/Path;v=1?a=1&b=&c", ""),
    (False, "unknown", "LOW", None, "ftp://files.example.org/{n} http://my_host.example.net/a?b=1 not-a-url-{n} http://localhost/x", ""),
    (False, "unknown", "LOW", "Hi Tom, the review moved to 3pm on 14/0{n}/2026. See you there, bring the {n} slides.", "", "HARD NEGATIVE small talk"),
    (False, "unknown", "LOW", "Alder Bank: never share your OTP or PIN with anyone. We will never ask for your password. Report calls to {phone}.", "", "HARD NEGATIVE warning"),
    (False, "unknown", "LOW", "Your Nova verification code is {code}. It expires in 10 minutes. If you did not request it, ignore this message.", "", "HARD NEGATIVE two-factor"),
    (False, "unknown", "LOW", "A new device was used to log in at 9:14. If this was you, no action is needed.", "", "HARD NEGATIVE reassurance"),
    (False, "unknown", "LOW", "Receipt: your subscription payment of $14.99 was received. The invoice {n} is at https://cloud.example/invoices/{n}", "", "HARD NEGATIVE receipt"),
    (False, "unknown", "LOW", "Your order from Leaf Books is out for delivery. Track it at https://www.dhl.com/tracking?id={code}", "", "HARD NEGATIVE carrier"),
    (False, "unknown", "LOW", "Important notice: investing involves risk and the value may fall. Past performance is no promise of future results.", "", "HARD NEGATIVE disclaimer"),
    (False, "unknown", "LOW", "Reminder: dentist on {hrs} June at 09:30. Call {phone} or +44 20 7946 0{n} to move it.", "", "HARD NEGATIVE appointment"),
    (False, "unknown", "LOW", "Payroll: a salary of $3,{n} was deposited. The payslip is on the intranet.", "", "HARD NEGATIVE salary"),
    (False, "unknown", "LOW", "Weekend sale: {hrs}% off lattes this Saturday. Menu: (https://cafe.example/menu), www.cafe.example/menu.", "", "HARD NEGATIVE promotion"),
    (False, "unknown", "LOW", "Hi, write to Team{n}@Example.org or team{n}@example.org. Google and Apple sent the files; Royal Mail, HSBC and HMRC items too.", "", "HARD NEGATIVE names"),
    (False, "unknown", "LOW", "Check   this.\n\tSecond line  here ", "", "HARD NEGATIVE sparse"),
    (False, "unknown", "LOW", "Hey, the museum at hxxp://old[.]example[.]org/{n} is lovely, 20% more rooms.", "", "HARD NEGATIVE obfuscated"),
    (False, "unknown", "LOW", "Thanks for your ticket #{code}. We reply within one business day. If you didn't request this you can safely ignore it, no further action.", "", "HARD NEGATIVE support"),
    (False, "unknown", "LOW", "   ", " ", "empty"),
    (False, "unknown", "LOW", "too many links", " ".join(f"https://a{i}.example/" for i in range(21)), "too many"),
]

K = len(TEMPLATES)
SOURCES = {"click": "sms", "error": "email", "purchase": "chat", "signup": "social", "view": "web"}


def _sql(v) -> str:
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'"


def templates_sql() -> str:
    rows = ",\n".join(f"({i}, " + ", ".join(_sql(v) for v in t) + ")" for i, t in enumerate(TEMPLATES))
    return f"SELECT * FROM (VALUES\n{rows}\n) t(tpl_id, is_scam, category, min_level, text_pattern, url_pattern, note)"


def messages_sql() -> str:
    fill = lambda c: (
        f"replace(replace(replace(replace(replace({c}, '{{amt}}', CAST(100 + e.event_id % 900 AS VARCHAR)),"
        f" '{{hrs}}', CAST(2 + e.event_id % 27 AS VARCHAR)), '{{n}}', CAST(e.event_id % 10 AS VARCHAR)),"
        f" '{{code}}', CAST(100000 + (e.event_id * 7) % 900000 AS VARCHAR)),"
        f" '{{phone}}', '555-01' || lpad(CAST(e.event_id % 100 AS VARCHAR), 2, '0'))"
    )
    source = "CASE e.event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items()) + " END"
    none = "CAST(NULL AS BOOLEAN) AS is_scam, CAST(NULL AS VARCHAR) AS expected_category, CAST(NULL AS VARCHAR) AS min_level, CAST(NULL AS VARCHAR) AS note"
    return f"""
SELECT e.event_id AS msg_id, e.user_id, e.ts, {source} AS source_label,
       CASE WHEN e.event_id % 5 = 0 THEN 'Case ' || CAST(e.event_id AS VARCHAR) END AS title,
       {fill('t.text_pattern')} AS text, string_split({fill('t.url_pattern')}, ' ') AS urls,
       t.is_scam, t.category AS expected_category, t.min_level, t.note
FROM events e JOIN templates t ON e.event_id % {K} = t.tpl_id
UNION ALL
SELECT 1000000000 + doc_id, doc_id % 97, TIMESTAMP '2024-02-01 08:00:00' + to_hours(CAST(doc_id % 600 AS INTEGER)), source, NULL, text,
       CAST([] AS VARCHAR[]), {none} FROM documents
UNION ALL
SELECT 2000000000 + conv_id * 1000 + turn, conv_id % 97, TIMESTAMP '2024-02-10 08:00:00' + to_hours(CAST(conv_id % 300 AS INTEGER)), 'chat', NULL, text,
       CAST([] AS VARCHAR[]), {none} FROM conversations
UNION ALL
SELECT 3000000000 + page_id, page_id % 97, TIMESTAMP '2024-02-20 08:00:00' + to_hours(CAST(page_id % 200 AS INTEGER)), 'web', NULL, NULL,
       [url], {none} FROM pages"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, *inputs: DataFrame) -> DataFrame:
    """Even out a small input over all cores; an input with work for every core is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if sum(map(estimated_bytes, inputs)) < cores * 128 * 1024 * 1024 else df


def from_events(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    tpl = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(TEMPLATES)],
        "tpl_id long, is_scam boolean, category string, min_level string, text_pattern string, url_pattern string, note string")
    i = F.col("event_id")
    slots = {
        "{amt}": (i % 900 + 100).cast("string"), "{hrs}": (i % 27 + 2).cast("string"), "{n}": (i % 10).cast("string"),
        "{code}": ((i * 7) % 900000 + 100000).cast("string"), "{phone}": F.concat(F.lit("555-01"), F.lpad((i % 100).cast("string"), 2, "0")),
    }

    def fill(c):
        for k, v in slots.items():
            c = F.replace(c, F.lit(k), v)
        return c

    source = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])
    joined = events.withColumn("tpl_id", i % K).join(F.broadcast(tpl), "tpl_id")  # a fixed few dozen rows
    return joined.select(
        i.alias("msg_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), source[F.col("event_type")].alias("source_label"),
        F.when(i % 5 == 0, F.concat(F.lit("Case "), i.cast("string"))).alias("title"), fill(F.col("text_pattern")).alias("text"),
        F.split(fill(F.col("url_pattern")), " ").alias("urls"), "is_scam", F.col("category").alias("expected_category"), "min_level", "note")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    made = from_events(events)
    no_urls = F.expr("cast(array() as array<string>)")
    blank = [F.lit(None).cast("boolean").alias("is_scam"), *[F.lit(None).cast("string").alias(c) for c in ("expected_category", "min_level", "note")]]
    at = lambda start, hours: (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))).cast("timestamp").alias("ts")
    nothing = F.lit(None).cast("string")
    doc, conv, page = (table(spark, sf_dir, t) for t in ("documents", "conversations", "pages"))
    d = doc.select((F.col("doc_id") + 1000000000).alias("msg_id"), (F.col("doc_id") % 97).alias("user_id"),
                   at("2024-02-01 08:00:00", F.col("doc_id") % 600), F.col("source").alias("source_label"), nothing.alias("title"),
                   "text", no_urls.alias("urls"), *blank)
    c = conv.select((F.col("conv_id") * 1000 + F.col("turn") + 2000000000).alias("msg_id"), (F.col("conv_id") % 97).alias("user_id"),
                    at("2024-02-10 08:00:00", F.col("conv_id") % 300), F.lit("chat").alias("source_label"), nothing.alias("title"),
                    "text", no_urls.alias("urls"), *blank)
    p = page.select((F.col("page_id") + 3000000000).alias("msg_id"), (F.col("page_id") % 97).alias("user_id"),
                    at("2024-02-20 08:00:00", F.col("page_id") % 200), F.lit("web").alias("source_label"), nothing.alias("title"),
                    nothing.alias("text"), F.array("url").alias("urls"), *blank)
    return spread(made.unionByName(d).unionByName(c).unionByName(p), "msg_id", events, doc, conv, page)

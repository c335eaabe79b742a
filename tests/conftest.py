import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("lureframe-tests").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def assessed(spark):
    """Assessment of a few hand-written messages (own wording), keyed by name."""
    from lureframe.plans.triage import triage

    rows = [
        ("meeting", "Hi Ana, the call moves to 3pm. Bring the slides, please.", []),
        ("warning", "Alder Bank: never share your OTP with anyone. We will never ask for your password.", []),
        ("two_factor", "Your Nova verification code is 482913. If you did not request it, ignore this message.", []),
        ("receipt", "Receipt: your payment of $14.99 was received, see https://cloud.example/invoices/7", []),
        ("otp_scam", "Security alert: your card will be blocked. Reply with the one-time code 123456 immediately and verify your account.", []),
        ("gift_card", "Purchase an Amazon gift card worth $200 and send us the redemption code within 24 hours, it is urgent.", []),
        ("lookalike", None, ["http://paypa1-secure-login.example.com/account/verify"]),
        ("punycode", None, ["https://xn--80ak6aa92e.com/login"]),
        ("official", None, ["https://www.paypal.com/account/login"]),
        ("anchored", "Is this fine? http://paypa1-login.example.com/webscr", []),
        ("parcel_notice", "Your parcel is on its way and will arrive on Friday.", []),
        ("parcel_scam", "Your parcel could not be delivered. Pay the redelivery fee within 24 hours.", []),
        ("document", "The shared document is in the document portal.", []),
        ("document_link", "The shared document is at https://docs.example.org/view", []),
        ("sparse", "Check this.", []),
        ("empty", "  ", ["  "]),
        ("long_scam", "filler words " * 16_000 + "Reply with the one-time code 123456 immediately and verify your account.", []),
        ("many_urls", "look", [f"http://paypa1-login.example.com/{i}" for i in range(50)]),
    ]
    df = spark.createDataFrame(rows, "msg_id string, text string, urls array<string>").repartition(4, "msg_id")
    return {r["msg_id"]: r for r in triage(df).collect()}

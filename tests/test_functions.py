"""Column functions against brute force in plain Python."""
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lureframe import lexicon as lx
from lureframe.functions import text as tx, urls as uf
from lureframe.functions.steps import derive, derive_array
from lureframe.operators import entities as en

TEXTS = [
    "Act now! Your account will be closed; account will be reviewed. risk-free, no risk.",
    "the otp code is 1234, otp-code 5678 OTP: 99999999 and pin 4321 but pinned 1111",
    "Call (555) 010-1234 or +1-555-0100, +44 20 7946 0958; id 123456789012345678, 12/05/2026",
    "never share your otp; do not enter it. please share the code\nnever\n give it",
    "$1,200.50 and 300 USD, 20 Euros, €5 ,₹ 7; 1,000 usd", "", "   ", "ünïcödé enter", "préinput", "12th May 2026 and May 3, 2026 or 3 jun",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, t.lower()) for i, t in enumerate(TEXTS)], "i int, body string, lower_body string")


def rows(df):
    return [r[1] for r in sorted(df.collect())]


def test_counts_of_the_dimensions():
    assert len(lx.RULES) == 42 and sum(len(r.keywords) for r in lx.RULES) == 312
    assert sum(len(p) for p in lx.PHRASE_GROUPS.values()) == 282
    assert len(lx.BRANDS) == 81 and len(lx.FEATURES) == 18


def test_keywords_stand_in_rule_order():
    of = {r.id: r.keywords for r in lx.RULES}
    assert of["bank_card_blocked"] == (
        "card will be blocked", "card has been blocked", "card was blocked", "your card is blocked", "card blocked",
        "card will be frozen", "card has been frozen", "debit card blocked")
    assert of["bank_otp_request"][:4] == ("otp", "otp code", "one-time code", "one time code") and of["bank_otp_request"][-1] == "enter the code"
    assert of["crypto_wallet_drain"] == (
        "private key", "seed phrase", "wallet address", "send btc", "send usdt", "recovery phrase", "import your wallet", "bc1", "btc to",
        "crypto address")
    assert of["impersonation_executive"][0] == "the ceo" and of["impersonation_executive"][-1] == "the executive"


def test_term_hits_equal_one_regex_per_term(texts):
    terms = lx.DEFAULT.terms()
    got = rows(texts.select("i", F.array_sort(tx.term_hits(F.col("lower_body"), terms))))
    want = [sorted(t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", x.lower())) for x in TEXTS]
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab -", min_size=1, max_size=6).filter(lambda s: s.strip() == s), min_size=1, max_size=8),
       st.lists(st.text(alphabet="ab -", max_size=14), min_size=1, max_size=10))
def test_term_hits_on_random_terms(spark, terms, samples):
    terms = sorted(set(terms))
    df = spark.createDataFrame(list(enumerate(samples)), "i int, x string")
    got = rows(df.select("i", F.array_sort(tx.term_hits(F.col("x"), terms))))
    assert got == [sorted(t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", x)) for x in samples]


def test_pattern_hits_and_gates(texts):
    patterns = list(dict.fromkeys(p for ps in lx.GROUP_PATTERNS.values() for p in ps))
    got = rows(texts.select("i", tx.pattern_hits(F.col("lower_body"), patterns)))
    assert got == [[p for p in patterns if re.search(p, x.lower())] for x in TEXTS]


def test_requestive_ignores_negated_verbs(texts):
    negated = re.compile(rf"({'|'.join(lx.NEGATIONS)})\s*$")

    def brute(x):
        return any(not negated.search(x[max(0, m.start() - 24): m.start()]) for p in lx.REQUESTIVE_PATTERNS for m in re.finditer(p, x))

    got = rows(texts.select("i", tx.requestive(F.col("lower_body"), lx.REQUESTIVE_PATTERNS, lx.NEGATIONS, lx.NEGATION_REACH)))
    assert got == [brute(x.lower()) for x in TEXTS]


def brute_context(pattern, x, reach):
    return [(m.group(0).strip(), x[max(0, m.start() - reach): m.end() + reach].replace("\n", " ")) for m in re.finditer(pattern, x)]


def test_phones_with_context(texts):
    want = []
    for x in TEXTS:
        seen = {}
        for value, ctx in brute_context(rf"(?<![\d+]){en.PHONE}(?!\d)", x, 40):
            if 7 <= len(re.sub(r"\D", "", value)) <= 15:
                seen.setdefault(value, ctx)
        want.append(list(seen.items()))
    got = [[(p["value"], p["context"]) for p in ps] for ps in rows(en.extract_phones(texts).select("i", "phones"))]
    assert got == want and any(want)


def test_amounts_dates_codes(texts):
    money = [list(dict.fromkeys(v for v, _ in brute_context(f"(?i){en.MONEY}", x, 40))) for x in TEXTS]
    assert [[a["value"] for a in xs] for xs in rows(en.extract_amounts(texts).select("i", "amounts"))] == money
    date = re.compile(en.DATE.replace("(?iU)", "(?i)"))
    assert rows(en.extract_dates(texts).select("i", "dates")) == [list(dict.fromkeys(m.group(0) for m in date.finditer(x))) for x in TEXTS]
    want = []
    for x in TEXTS:
        seen = {}
        for m in re.finditer(f"(?i){en.CODE_TRIGGER}", x):
            for n in re.findall(en.CODE, x[max(0, m.start() - 25): m.end() + 25]):
                seen.setdefault(n, f"near '{m.group(0)}'")
        want.append(list(seen.items()))
    got = [[(c["value"], c["context"]) for c in xs] for xs in rows(en.extract_codes(texts).select("i", "codes"))]
    assert got == want and any(want)


def test_normalize_and_whitespace(spark):
    assert len(set(tx.WHITESPACE)) == len(tx.WHITESPACE) and tx.WHITESPACE.strip() == ""
    df = spark.createDataFrame([("  a \t b\n c ",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.normalize(F.col("t"))).collect()] == ["a b\n c", ""]


URLS = [
    "http://192.168.1.1/login", "https://example.com/path?q=1&token=abc", "https://bit.ly/abc", "www.x.com", "http://user:pw@Sub.Example.co.uk:80/p;x?a",
    "https://xn--mnchen-3ya.de/", "https://xn--fiqs8s.cn", "https://xn--80ak6aa92e.com/login", "https://xn--!!.com", "", "http://[2001:db8::1]/x",
]


@pytest.fixture(scope="module")
def facts(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "raw_url string")
    return {r["raw_url"]: r for r in derive(df, uf.url_steps()).collect()}


def test_url_anatomy(facts):
    assert facts[URLS[0]]["is_ip"] and facts[URLS[0]]["host"] == "192.168.1.1"
    assert (facts[URLS[1]]["domain"], facts[URLS[1]]["tld"], facts[URLS[1]]["params"]) == ("example.com", "com", ["q", "token"])
    assert facts[URLS[2]]["is_shortener"] and facts[URLS[2]]["risk"] >= 0.2
    assert (facts[URLS[4]]["host"], facts[URLS[4]]["domain"], facts[URLS[4]]["path"]) == ("sub.example.co.uk", "example.co.uk", "/p")
    assert facts[URLS[10]]["is_ip"]


def test_punycode_matches_the_python_codec(facts):
    for u in URLS[5:8]:
        host = facts[u]["host"]
        want = ".".join(lb[4:].encode().decode("punycode") if lb.startswith("xn--") else lb for lb in host.split("."))
        table = str.maketrans(lx.LEET_FROM + lx.GLYPH_FROM, lx.LEET_TO + lx.GLYPH_TO)
        assert facts[u]["latin"] == want.translate(table)
    assert facts[URLS[7]]["lookalike"] == "apple" and facts[URLS[8]]["latin"] == "xn--!!.com"


def test_array_form_equals_table_form(spark, facts):
    df = spark.createDataFrame([(URLS,)], "us array<string>")
    arr = derive_array(F.transform("us", lambda u: F.struct(u.alias("raw_url"))), uf.url_steps(), uf.URL_FIELDS)
    for item in df.select(arr.alias("a")).head()[0]:
        assert all(item[f] == facts[item["raw_url"]][f] for f in uf.URL_FIELDS)


def test_lookupable(spark):
    good = ["http://example.com", "https://a.b-c.example/x?y=1", "http://10.0.0.1/x", "http://[::1]/"]
    bad = ["", "example.com", "ftp://example.com", "http://localhost", "http://a b.com", "https://", "http://-a.com", "http://x_y.example.com", "http://" + "a" * 2000 + ".com"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert {r[0]: r[1] for r in df.select("u", uf.lookupable(F.col("u"))).collect()} == {**{u: True for u in good}, **{u: False for u in bad}}


def test_lookup_key(spark):
    import base64

    urls = ["http://a.example/?x=1>>", "http://" + "long" * 40 + ".example/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(uf.lookup_key(F.col("u"))).collect()] == [base64.urlsafe_b64encode(u.encode()).decode().rstrip("=") for u in urls]

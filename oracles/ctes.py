"""DuckDB SQL for every stage, written relationally and independently of the Spark plan.

RE2 has no look-around, so boundaries are consuming groups and negated verbs
are removed before verbs are searched.  ``low`` is the lower-cased body;
``loww`` the same with non-ASCII letters replaced by ``_``, so that RE2's ASCII
``\\b`` sees the word boundaries of the original.
"""
from __future__ import annotations

import re

from lureframe import lexicon as lx
from lureframe.functions.text import WHITESPACE
from lureframe.functions.urls import _lookalike_names
from lureframe.operators import entities as en

from .fixture import messages_sql, templates_sql


def s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def lst(values) -> str:
    return "([" + ", ".join(s(v) for v in values) + "]::VARCHAR[])"


WS = s(WHITESPACE)
trim = lambda c: f"trim({c}, {WS})"
norm = NORM = lambda c: trim(f"regexp_replace(coalesce({c}, ''), '[ \\t]+', ' ', 'g')")
uniq = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
found_in = lambda values, hits: f"list_filter({lst(values)}, lambda p: list_contains({hits}, p))"
rnd = lambda c, n: f"round_even(CAST({c} AS DOUBLE), {n})"


def cases(pairs) -> str:
    return "list_filter([" + ",\n".join(f"CASE WHEN {c} THEN {s(v)} END" for c, v in pairs) + "], lambda x: x IS NOT NULL)"


def term_case(col: str, term: str, boundary: str = "a-z0-9") -> str:
    rx = f"(^|[^{boundary}]){re.escape(term)}([^{boundary}]|$)".replace("\\'", "'")
    return f"contains({col}, {s(term)}) AND regexp_matches({col}, {s(rx)})"


ALL_PATTERNS = list(dict.fromkeys(
    [p for ps in lx.GROUP_PATTERNS.values() for p in ps] + [p for r in lx.RULES for p in r.patterns]))
VERBS = "|".join(lx.REQUESTIVE_PATTERNS)
URL_RX = en.URL.replace("(?iU)", "(?i)")
urls_of = lambda c: (
    f"list_transform(list_transform(regexp_extract_all({c}, {s(URL_RX)}), lambda u: regexp_replace(u, '[.,;:!?]+$', '')), "
    f"lambda u: CASE WHEN starts_with(lower(u), 'www.') THEN 'http://' || u ELSE u END)"
)
BRANDS_BY_LENGTH = sorted(lx.BRANDS, key=lambda b: len(b[0]), reverse=True)
KIND = {k: kind for k, kind, _ in lx.BRANDS}
BUCKET = {"company": "companies", "bank": "banks", "government": "organizations"}


def brand_value(key: str) -> str:
    return key.upper() if KIND[key] != "company" and len(key) <= 4 else key.title()


def rules_sql() -> str:
    rows = ",\n".join(
        f"({i}, {s(r.id)}, {s(r.category)}, {r.weight}e0, {s(r.severity)}, {r.confidence}e0, {'url' in r.required_entities}, "
        f"{r.needs_request}, {r.id in lx.ALARM_RULES}, {lst(r.keywords)}, {lst(r.patterns)})" for i, r in enumerate(lx.RULES))
    return (f"SELECT * FROM (VALUES {rows}) t(ord, id, category, weight, severity, confidence, needs_url, needs_request, alarm, "
            "keywords, patterns)")


def bump_sql() -> str:
    bumps = [
        ("NOT is_https", "0.05e0", "0.9e0"), ("url_length > 100", "0.05e0", "0.9e0"), ("url_length > 200", "0.05e0", "0.9e0"),
        ("is_ip", "0.35e0", "0.9e0"), ("is_punycode", "0.15e0", "0.9e0"), ("n_labels > 4", "0.1e0", "0.9e0"),
        ("n_hyphens >= 4", "0.1e0", "0.9e0"), ("lookalike IS NOT NULL", "0.4e0", "0.95e0"), ("length(path) > 60", "0.05e0", "0.9e0"),
        ("leaked", "0.15e0", "0.9e0"), ("len(keywords) > 0", "least(0.25e0, 0.06e0 * len(keywords))", "0.9e0"),
        ("len(symbols) > 0", "0.1e0", "0.9e0"), ("is_shortener", "0.2e0", "0.9e0"), ("digit_heavy", "0.1e0", "0.9e0"),
        ("risky_tld", "0.1e0", "0.9e0"),
    ]
    r = "0e0"
    for c, a, cap in bumps:
        r = f"least(CASE WHEN {c} THEN {cap} ELSE 1e0 END, {r} + CASE WHEN {c} THEN {a} ELSE 0e0 END)"
    return rnd(r, 3)


CHANNELS = list(lx.CHANNEL_WEIGHTS.items())
APPLIES = {"consistency": "TRUE", "url_risk": "has_url", "threat_intel": "has_url AND intel_informative"}
clamp01 = lambda c: f"greatest(0e0, least(1e0, {c}))"


def on_sql(k: str) -> str:
    applies = APPLIES.get(k, "has_text")
    if k == "consistency":
        return "TRUE"
    return f"({applies} AND (NOT (url_anchor AND has_url) OR {clamp01(k)} >= 0.2e0))"


WEIGHT_SUM = " + ".join(["0e0"] + [f"CASE WHEN {on_sql(k)} THEN {w}e0 ELSE 0e0 END" for k, w in CHANNELS])
BASE_SUM = " + ".join(["0e0"] + [f"CASE WHEN {on_sql(k)} THEN {w}e0 * {clamp01(k)} ELSE 0e0 END" for k, w in CHANNELS if k != "consistency"])

REJECT = "CASE WHEN " + trim("coalesce(text, '')") + " = '' AND len(urls) = 0 THEN 'no_content' END"
#: Limits of the input form, as p4 asks for them.
FORM_LIMITS = {"max_text": 50_000, "max_urls": 20, "max_title": 255, "max_label": 64}
LIMIT_FLAGS = cases([("length(coalesce(text, '')) > 50000", "text_too_long"), ("len(urls) > 20", "too_many_urls"),
                     ("length(title) > 255", "title_too_long"), ("length(source_label) > 64", "source_label_too_long")])

CODE_WORDS = en.CODE_TRIGGER.removeprefix(r"\b").removesuffix(r"\b")
NO_WORD = r"[^\p{L}\p{M}\p{N}_]"

CTES: dict[str, tuple[list[str], str]] = {
    "templates": ([], templates_sql()),
    "messages": (["templates"], messages_sql()),
    "checked": (["messages"], f"""
SELECT *, {REJECT} AS reject_reason, {norm('text')} AS body FROM (
 SELECT * REPLACE (list_filter(list_transform(coalesce(urls, []::VARCHAR[]), lambda u: {trim('u')}), lambda u: u <> '') AS urls) FROM messages)"""),
    "acc": (["checked"], "SELECT * FROM checked WHERE reject_reason IS NULL"),
    "txt": (["acc"], r"SELECT msg_id, body, lower(body) AS low, regexp_replace(lower(body), '[^\x00-\x7F\P{L}]', '_', 'g') AS loww FROM acc"),
    "hits": (["txt"], f"SELECT msg_id, {cases((term_case('low', t), t) for t in lx.DEFAULT.terms())} AS hits FROM txt"),
    "pats": (["txt"], "SELECT msg_id, " + cases((f"regexp_matches(loww, {s(p)})", p) for p in ALL_PATTERNS) + " AS pats,\n"
             f"regexp_matches(regexp_replace(loww, {s('(never|do not|don' + chr(39) + '?t|won' + chr(39) + '?t|should not|must not|will never)' + chr(92) + 's*(?:' + VERBS + ')')}, '\\1 ', 'g'), {s(VERBS)}) AS ask FROM txt"),
    "grp": (["hits", "pats"], "SELECT msg_id, hits, pats, ask, " + ",\n".join(
        (f"{found_in(ps, 'hits')} || {found_in(lx.GROUP_PATTERNS[g], 'pats')}" if g in lx.GROUP_PATTERNS else found_in(ps, "hits")) + f" AS g_{g}"
        for g, ps in lx.PHRASE_GROUPS.items()) + " FROM hits JOIN pats USING (msg_id)"),
    "sig": (["grp"], """SELECT *, least(1e0, 0.25e0 * len(g_urgency)) AS urgency_score, least(1e0, 0.25e0 * len(g_fear_threat)) AS fear_threat_score,
 least(1e0, 0.25e0 * len(g_reward)) AS reward_score, least(1e0, 0.25e0 * len(g_pressure)) AS pressure_score,
 len(g_payment) > 0 OR (len(g_payment_mention) > 0 AND ask) AS payment_request, len(g_credential) > 0 AND ask AS credential_request,
 len(g_otp) > 0 AND ask AS otp_request, len(g_sensitive) > 0 AND ask AS sensitive_request, len(g_instructions) > 0 AS instructions,
 len(g_authority) > 0 AS authority, len(g_protective) > 0 AS protective, len(g_reassurance) > 0 AS reassurance FROM grp"""),
    "urls0": (["acc"], f"SELECT msg_id, urls, {uniq(urls_of('body'))} AS found FROM acc"),
    "urls1": (["urls0"], f"SELECT msg_id, found || list_transform(list_filter(urls, lambda u: NOT list_contains(found, u)), "
              f"lambda u: coalesce(({urls_of('u')})[1], u)) AS all_urls, found FROM urls0"),
    "uraw": (["urls1"], "SELECT msg_id, unnest(all_urls) AS raw_url, generate_subscripts(all_urls, 1) - 1 AS ord FROM urls1"),
    "names": ([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, {s(n)}, {s(k)})" for i, (n, k) in enumerate(_lookalike_names(lx.DEFAULT).items())) + ") t(ord, name, key)"),
    "official": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {s(k)}, {lst(h)})" for i, (k, _, h) in enumerate(lx.BRANDS)) + ") t(ord, key, hosts)"),
    "udist": (["uraw"], f"SELECT DISTINCT raw_url FROM uraw"),
    "u1": (["udist"], f"""SELECT raw_url, url, rtrim(lower(CASE WHEN starts_with(bare, '[') THEN regexp_extract(bare, '^\\[([^\\]]*)', 1) ELSE split_part(bare, ':', 1) END), '.') AS host
FROM (SELECT *, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS bare
FROM (SELECT raw_url, CASE WHEN regexp_matches(lower({trim('raw_url')}), '^https?://') THEN {trim('raw_url')} ELSE 'http://' || {trim('raw_url')} END AS url FROM udist))"""),
    "u2": (["u1"], f"""SELECT *, CASE WHEN p = '' THEN '/' ELSE p END AS path, string_split(host, '.') AS labels,
 CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END AS suffixes,
 list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' '))) AS params,
 starts_with(lower(url), 'https:') AS is_https, length(url) AS url_length,
 {cases((term_case('lower(url)', k, 'a-z'), k) for k in lx.URL_KEYWORDS)} AS keywords,
 list_filter({lst(lx.URL_SYMBOLS)}, lambda x: contains(url, x)) AS symbols,
 translate(translate(replace(host, 'xn--80ak6aa92e', 'аррӏе'), '{lx.LEET_FROM}', '{lx.LEET_TO}'), '{lx.GLYPH_FROM}', '{lx.GLYPH_TO}') AS latin,
 regexp_matches(host, '^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$') AS is_ip,
 contains(host, 'xn--') AS is_punycode, length(host) - length(replace(host, '-', '')) AS n_hyphens,
 length(regexp_replace(host, '[^0-9]', '', 'g')) / greatest(length(host), 1) > 0.4e0 AS digit_heavy,
 length(regexp_replace(url, '[^_@%*&!-]', '', 'g')) AS special_chars
FROM (SELECT *, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p FROM u1)"""),
    "look": (["u2", "names", "official"], """SELECT host, arg_min(key, ord) AS lookalike FROM (
 SELECT DISTINCT h.host, n.ord, n.key FROM (SELECT DISTINCT host, suffixes, unnest(regexp_split_to_array(latin, '[.-]+')) AS token FROM u2) h
 JOIN names n ON (starts_with(h.token, n.name) OR ends_with(h.token, n.name)) AND length(h.token) <= length(n.name) + 6
 JOIN official o ON o.key = n.key WHERE NOT list_has_any(h.suffixes, o.hosts)) GROUP BY host"""),
    "uf": (["u2", "look"], f"""SELECT *, {bump_sql()} AS risk, {cases([('NOT is_https', 'no_https'), ('is_ip', 'ip_address_url'), ('is_punycode', 'punycode'), ('n_labels > 4', 'excessive_subdomains'), ('n_hyphens >= 4', 'many_hyphens'), ('lookalike IS NOT NULL', 'brand_lookalike'), ('length(path) > 60', 'long_path'), ('leaked', 'sensitive_query_params'), ('len(symbols) > 0', 'suspicious_symbols'), ('is_shortener', 'url_shortener'), ('risky_tld', 'risky_tld')])} AS signals FROM (
SELECT u2.*, look.lookalike, len(suffixes) AS n_labels, list_has_any(list_transform(params, lambda p: lower(p)), {lst(lx.SENSITIVE_PARAMS)}) AS leaked,
 CASE WHEN len(suffixes) = 0 THEN '' WHEN len(suffixes) <= 2 THEN suffixes[1] WHEN list_contains({lst(lx.MULTI_SUFFIXES)}, suffixes[-2]) THEN suffixes[-3] ELSE suffixes[-2] END AS domain,
 CASE WHEN len(suffixes) >= 2 AND list_contains({lst(lx.MULTI_SUFFIXES)}, suffixes[-2]) THEN suffixes[-2] ELSE coalesce(suffixes[-1], '') END AS tld,
 list_has_any(suffixes, {lst(lx.SHORTENERS)}) AS is_shortener,
 list_contains({lst(lx.RISKY_TLDS)}, CASE WHEN len(suffixes) >= 2 AND list_contains({lst(lx.MULTI_SUFFIXES)}, suffixes[-2]) THEN suffixes[-2] ELSE coalesce(suffixes[-1], '') END) AS risky_tld
FROM u2 LEFT JOIN look ON u2.host = look.host)"""),
    "mu": (["uraw", "uf"], "SELECT r.msg_id, r.ord, f.* FROM uraw r JOIN uf f USING (raw_url)"),
    "brand_dim": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {s(k)}, {s(kind)}, {s(BUCKET[kind])}, {s(brand_value(k))})" for i, (k, kind, _) in enumerate(BRANDS_BY_LENGTH)) + ") t(ord, key, kind, bucket, value)"),
    "bnames": (["txt"], "SELECT msg_id, loww, " + cases(
        (f"contains(loww, {s(k)}) AND regexp_matches(loww, {s(chr(92) + 'b' + k + chr(92) + 'b')})", k) for k, _, _ in BRANDS_BY_LENGTH) + " AS keys FROM txt"),
    "brands": (["bnames", "brand_dim"], "SELECT b.msg_id, d.ord, d.key, d.kind, d.bucket, d.value FROM (SELECT msg_id, unnest(keys) AS key FROM bnames) b JOIN brand_dim d USING (key)"
               " UNION ALL SELECT msg_id, 1000 + ord, key, kind, 'companies', alias FROM (SELECT b.msg_id, a.*, row_number() OVER (PARTITION BY b.msg_id, a.key ORDER BY a.ord) AS rn FROM bnames b, (VALUES "
               + ", ".join(f"({i}, {s(a)}, {s(k)}, {s(KIND[k])}, {s(chr(92) + 'b' + a + chr(92) + 'b')})" for i, (a, k) in enumerate(lx.BRAND_ALIASES))
               + ") a(ord, alias, key, kind, rx) WHERE NOT list_contains(b.keys, a.key) AND contains(b.loww, a.alias) AND regexp_matches(b.loww, a.rx)) WHERE rn = 1"),
    "rules": ([], rules_sql()),
    "raw_matches": (["sig", "rules"], """SELECT * FROM (SELECT s.msg_id, r.* EXCLUDE (keywords, patterns), list_filter(r.keywords, lambda k: list_contains(s.hits, k)) AS kws,
 list_filter(r.patterns, lambda k: list_contains(s.pats, k)) AS pts FROM sig s CROSS JOIN rules r) WHERE len(kws) + len(pts) > 0"""),
    "gates": (["sig", "urls1"], """SELECT msg_id, len(all_urls) > 0 AS has_url_entity,
 payment_request OR credential_request OR otp_request OR sensitive_request OR instructions OR urgency_score > 0 OR fear_threat_score > 0 AS request_context,
 (protective OR reassurance) AND NOT (credential_request OR otp_request OR sensitive_request) AS alarm_silenced FROM sig JOIN urls1 USING (msg_id)"""),
    "matches": (["raw_matches", "gates"], """SELECT m.* FROM raw_matches m JOIN gates g USING (msg_id)
 WHERE (NOT needs_url OR has_url_entity) AND (NOT needs_request OR request_context) AND NOT (alarm AND alarm_silenced)"""),
    "votes": (["matches", "sig"], """SELECT msg_id, category, weight, len(kws) + len(pts) AS n, ord FROM matches
 UNION ALL SELECT msg_id, 'banking_scam', 1e0, 0, 1001 FROM sig WHERE otp_request UNION ALL SELECT msg_id, 'phishing', 0.75e0, 0, 1002 FROM sig WHERE credential_request
 UNION ALL SELECT msg_id, 'payment_scam', 0.5e0, 0, 1003 FROM sig WHERE payment_request"""),
    "ranking": (["votes"], """SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, n DESC, ord) AS rk, count(*) OVER (PARTITION BY msg_id) AS cats, sum(score) OVER (PARTITION BY msg_id) AS total
 FROM (SELECT msg_id, category, sum(weight) AS score, sum(n) AS n, min(ord) AS ord FROM votes GROUP BY ALL)"""),
    "cls": (["acc", "ranking"], f"""SELECT a.msg_id, coalesce(r.category, 'unknown') AS primary_category, coalesce(alt.alternatives, []::VARCHAR[]) AS alternatives,
 CASE WHEN r.category IS NULL THEN 0e0 WHEN r.cats = 1 THEN least(0.9e0, 0.4e0 + 0.1e0 * r.score) ELSE {rnd('least(0.95e0, r.score / r.total)', 2)} END AS confidence
 FROM acc a LEFT JOIN (SELECT * FROM ranking WHERE rk = 1) r USING (msg_id)
 LEFT JOIN (SELECT msg_id, list(category ORDER BY rk) AS alternatives FROM ranking WHERE rk > 1 GROUP BY msg_id) alt USING (msg_id)"""),
    "claims": (["acc", "mu"], f"""SELECT msg_id, count(*) FILTER (WHERE risk >= 0.4e0) AS strong, bool_or(lookalike IS NOT NULL OR (NOT trusted AND (list_has_any(keywords, {lst(lx.CREDENTIAL_INTENT)}) OR risk >= 0.5e0))) AS claimed,
 arg_min(coalesce(lookalike, domain), ord) FILTER (WHERE lookalike IS NOT NULL OR (NOT trusted AND (list_has_any(keywords, {lst(lx.CREDENTIAL_INTENT)}) OR risk >= 0.5e0))) AS claim
 FROM (SELECT mu.*, len(list_filter({lst(lx.TRUSTED_DOMAINS)}, lambda d: domain = d OR ends_with(domain, '.' || d))) > 0 AS trusted FROM mu JOIN acc USING (msg_id) WHERE acc.body = '') GROUP BY msg_id"""),
    "ucls": (["claims"], f"SELECT msg_id, claim, {rnd('least(0.75e0, 0.45e0 + 0.15e0 * strong)', 2)} AS confidence FROM claims WHERE claimed"),
    "refined": (["cls", "ucls"], """SELECT c.msg_id, CASE WHEN ambiguous AND u.msg_id IS NOT NULL THEN 'phishing' ELSE primary_category END AS primary_category,
 CASE WHEN ambiguous AND u.msg_id IS NOT NULL THEN u.confidence ELSE c.confidence END AS confidence, ambiguous AND u.msg_id IS NOT NULL AND primary_category <> 'phishing' AS changed
 FROM (SELECT *, primary_category IN ('unknown', 'other') OR confidence < 0.5e0 AS ambiguous FROM cls) c LEFT JOIN ucls u USING (msg_id)"""),
    "imp": (["brands", "mu", "official"], """SELECT msg_id, key, host, ord, CASE WHEN host_brand = key THEN 'brand_lookalike_host' ELSE 'brand_mention_in_host' END AS signal FROM (
 SELECT b.msg_id, b.key, u.host, u.ord, o.hosts, u.suffixes,
  coalesce((SELECT arg_min(o2.key, o2.ord) FROM official o2 WHERE list_has_any(u.suffixes, o2.hosts)), (SELECT arg_min(o3.key, o3.ord) FROM official o3 WHERE contains(u.host, o3.key))) AS host_brand
 FROM (SELECT DISTINCT msg_id, key FROM brands) b JOIN mu u USING (msg_id) JOIN official o ON o.key = b.key WHERE u.host <> '')
 WHERE NOT list_has_any(suffixes, hosts) AND (coalesce(host_brand, '') = key OR contains(host, key))"""),
    "intel": (["mu"], f"""SELECT msg_id, ord, url, host, CASE WHEN listed THEN 'suspicious' ELSE 'unknown' END AS verdict, CASE WHEN listed THEN 0.85e0 ELSE 0e0 END AS risk_score
 FROM (SELECT *, list_has_any(suffixes, {lst(lx.DEMO_BLOCKLIST)}) AS listed FROM mu)"""),
    "emails": (["acc"], f"""SELECT msg_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS emails
 FROM (SELECT msg_id, list_transform(regexp_extract_all(body, {s(en.EMAIL.replace('(?iU)', '(?i)'))}), lambda x: rtrim(x, '.')) AS e FROM acc)"""),
    "amounts": (["acc"], f"""SELECT msg_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS amounts
 FROM (SELECT msg_id, list_transform(regexp_extract_all(body, {s('(?i)' + en.MONEY)}), lambda x: {trim('x')}) AS e FROM acc)"""),
    "dates": (["acc"], f"""SELECT msg_id, list_filter(e, lambda x, i: list_position(list_transform(e, lambda y: lower(y)), lower(x)) = i) AS dates
 FROM (SELECT msg_id, regexp_extract_all(body, {s(en.DATE.replace('(?iU)', '(?i)'))}) AS e FROM acc)"""),
}



def _feature_sql() -> str:
    size = "greatest(length(body), 1)"
    return f"""SELECT a.msg_id, CAST(length(body) AS DOUBLE) AS message_length, CAST(len(list_filter(regexp_split_to_array(body, '[\\s\\x0b\\x1c-\\x1f\\x85\\xA0]+'), lambda w: w <> '')) AS DOUBLE) AS word_count,
 length(regexp_replace(body, '[^_@%*&!]', '', 'g')) / {size} AS special_char_frequency, length(regexp_replace(body, '[^\\p{{Lu}}]', '', 'g')) / {size} AS uppercase_ratio,
 urgency_score, fear_threat_score, reward_score, pressure_score, least(1e0, 0.25e0 * len(g_authority)) AS authority_score,
 CAST(payment_request AS INTEGER)::DOUBLE AS payment_request, CAST(credential_request AS INTEGER)::DOUBLE AS credential_request, CAST(otp_request AS INTEGER)::DOUBLE AS otp_request,
 CAST(sensitive_request AS INTEGER)::DOUBLE AS sensitive_info_request, CAST(len(emails) > 0 AS INTEGER)::DOUBLE AS has_email, CAST(p.msg_id IS NOT NULL AS INTEGER)::DOUBLE AS has_phone, CAST(len(amounts) AS DOUBLE) AS amount_count,
 CAST(coalesce(m.n, 0) AS DOUBLE) AS scam_keyword_hits, length(regexp_replace(body, '[^.,;:!?]', '', 'g')) / {size} AS punctuation_ratio
 FROM acc a JOIN sig USING (msg_id) JOIN emails USING (msg_id) JOIN amounts USING (msg_id) LEFT JOIN (SELECT msg_id, count(*) AS n FROM matches GROUP BY msg_id) m USING (msg_id) LEFT JOIN (SELECT DISTINCT msg_id FROM phones) p USING (msg_id)"""


HEURISTIC = ("greatest(0e0, least(1e0, 0.22e0 * scam_keyword_hits * 0.33e0 + 0.2e0 * payment_request + 0.2e0 * credential_request + 0.15e0 * otp_request + 0.1e0 * sensitive_info_request"
             " + 0.08e0 * fear_threat_score + 0.05e0 * urgency_score + 0.05e0 * reward_score + 0.05e0 * pressure_score + 0.04e0 * authority_score))")
SEV = "CASE {c} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
THEME = "CASE source " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in lx.THEME_OF_SOURCE.items()) + " ELSE source END"
THEME_LABEL = THEME_LABEL_SQL = "CASE theme " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in lx.THEME_LABELS.items()) + " END"

CTES |= {
    # RE2 has no look-around: possible starts are listed, matched at their place, and walked from one match to the next behind it
    "phone_at": (["acc"], f"""SELECT msg_id, body, s, s + length(v) AS e, v FROM (SELECT msg_id, body, s, regexp_extract(substr(body, s, 60), {s("^(" + en.PHONE + ")(?:[^0-9]|$)")}, 1) AS v FROM (
 SELECT msg_id, body, unnest(list_filter(range(1, len(ch) + 1), lambda i: regexp_matches(ch[i], '[0-9(+]') AND (i = 1 OR NOT regexp_matches(ch[i - 1], '[0-9+]')))) AS s
 FROM (SELECT msg_id, body, string_split(body, '') AS ch FROM acc WHERE regexp_matches(body, '[0-9]')))) WHERE v <> ''"""),
    "phone_next": (["phone_at"], """SELECT a.msg_id, a.s, min(b.s) AS n FROM phone_at a JOIN phone_at b ON a.msg_id = b.msg_id AND b.s >= a.e GROUP BY ALL"""),
    "phone_walk": (["phone_next"], """SELECT msg_id, min(s) AS s FROM phone_at GROUP BY msg_id UNION ALL SELECT x.msg_id, x.n FROM phone_walk w JOIN phone_next x ON x.msg_id = w.msg_id AND x.s = w.s"""),
    "phones": (["phone_walk"], f"""SELECT msg_id, value, context FROM (SELECT msg_id, s, {trim('v')} AS value,
 replace(substr(body, greatest(1, s - 40), least(40, s - 1)) || v || substr(body, e, 40), chr(10), ' ') AS context, row_number() OVER (PARTITION BY msg_id, {trim('v')} ORDER BY s) AS rn
 FROM phone_walk JOIN phone_at USING (msg_id, s) WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) WHERE rn = 1"""),
    "code_at": (["acc"], f"""SELECT msg_id, body, s, s + length(v) AS e, v FROM (SELECT msg_id, body, s, regexp_extract(substr(body, s, 60), {s("(?i)^(" + CODE_WORDS + ")(?:" + NO_WORD + "|$)")}, 1) AS v FROM (
 SELECT msg_id, body, unnest(list_filter(range(1, len(ch) + 1), lambda i: contains('ovsapcl', lower(ch[i])) AND (i = 1 OR regexp_matches(ch[i - 1], {s(NO_WORD)})))) AS s
 FROM (SELECT msg_id, body, string_split(body, '') AS ch FROM acc WHERE regexp_matches(body, '[0-9][0-9][0-9][0-9]')))) WHERE v <> ''"""),
    "code_next": (["code_at"], """SELECT a.msg_id, a.s, min(b.s) AS n FROM code_at a JOIN code_at b ON a.msg_id = b.msg_id AND b.s >= a.e GROUP BY ALL"""),
    "code_walk": (["code_next"], """SELECT msg_id, min(s) AS s FROM code_at GROUP BY msg_id UNION ALL SELECT x.msg_id, x.n FROM code_walk w JOIN code_next x ON x.msg_id = w.msg_id AND x.s = w.s"""),
    "codes": (["code_walk"], """SELECT msg_id, value, context FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, value ORDER BY s, i) AS rn FROM (
 SELECT msg_id, s, 'near ''' || v || '''' AS context, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM (
 SELECT *, list_filter(regexp_extract_all(substr(body, greatest(1, s - 25), least(25, s - 1)) || v || substr(body, e, 25), '[0-9]+'), lambda x: length(x) BETWEEN 4 AND 8) AS found
 FROM code_walk JOIN code_at USING (msg_id, s)))) WHERE rn = 1"""),
    "feat": (["acc", "sig", "emails", "amounts", "matches", "phones"], _feature_sql()),
    "ml": (["feat"], f"SELECT msg_id, {rnd(HEURISTIC, 4)} AS probability, CASE WHEN {HEURISTIC} >= 0.55e0 THEN 'scam' ELSE 'benign' END AS label FROM feat"),
    "lang": (["sig"], " UNION ALL ".join(
        f"SELECT msg_id, {i} AS i, {s(sig)} AS signal, {s(sev)} AS severity, {conf} AS confidence FROM sig WHERE {cond}"
        for i, (sig, sev, conf, cond) in enumerate([
            ("urgency_language", "medium", "urgency_score", "urgency_score >= 0.5e0"), ("fear_threat_language", "high", "fear_threat_score", "fear_threat_score >= 0.5e0"),
            ("payment_request", "high", "0.8e0", "payment_request"), ("credential_request", "high", "0.8e0", "credential_request"),
            ("otp_request", "critical", "0.9e0", "otp_request"), ("sensitive_info_request", "high", "0.75e0", "sensitive_request"),
            ("suspicious_instructions", "high", "0.7e0", "instructions"), ("reward_language", "medium", "reward_score", "reward_score >= 0.5e0")]))),
    "uev": (["mu"], "SELECT msg_id, ord AS i, CASE WHEN risk >= 0.4e0 THEN 'url_risk' ELSE 'url_checked' END AS signal, CASE WHEN risk >= 0.7e0 THEN 'critical' WHEN risk >= 0.4e0 THEN 'high' WHEN risk < 0.15e0 THEN 'low' ELSE 'medium' END AS severity, least(0.95e0, 0.4e0 + risk) AS confidence FROM mu"),
    "ev": (["acc", "matches", "lang", "imp", "refined", "ml", "uev", "intel"], """SELECT msg_id, (row_number() OVER (PARTITION BY msg_id ORDER BY part, i, j)) - 1 AS ord, source, signal, severity, confidence FROM (
 SELECT msg_id, 0 AS part, 0 AS i, 0 AS j, 'input_parser' AS source, 'input_received' AS signal, 'info' AS severity, 1e0 AS confidence FROM acc WHERE body <> ''
 UNION ALL SELECT msg_id, 1, ord, 0, 'scam_pattern', id, severity, confidence FROM matches
 UNION ALL SELECT msg_id, 2, i, 0, 'text_analysis', signal, severity, confidence FROM lang
 UNION ALL SELECT i.msg_id, 3, b.ord, i.ord, 'entity_analysis', signal, CASE WHEN signal = 'brand_lookalike_host' THEN 'high' ELSE 'medium' END, CASE WHEN signal = 'brand_lookalike_host' THEN 0.8e0 ELSE 0.6e0 END FROM imp i JOIN (SELECT msg_id, key, min(ord) AS ord FROM brands GROUP BY ALL) b USING (msg_id, key)
 UNION ALL SELECT msg_id, 4, 0, 0, 'url_classification', 'classification_refined', 'info', greatest(confidence, 0.4e0) FROM refined WHERE changed
 UNION ALL SELECT msg_id, 5, 0, 0, 'ml_classifier', CASE WHEN probability >= 0.5e0 THEN 'ml_probability_high' ELSE 'ml_probability_low' END, CASE WHEN probability >= 0.5e0 THEN 'medium' ELSE 'info' END, least(0.9e0, 0.4e0 + probability) FROM ml
 UNION ALL SELECT msg_id, 6, i, 0, 'url_analysis', signal, severity, confidence FROM uev
 UNION ALL SELECT msg_id, 7, ord, 0, 'threat_intelligence', 'threat_intel_' || verdict, CASE WHEN verdict = 'suspicious' THEN 'high' ELSE 'info' END, least(0.95e0, 0.3e0 + risk_score) FROM intel)"""),
    "uniq_ev": (["ev"], "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, source, signal ORDER BY ord) AS rn FROM ev) WHERE rn = 1"),
    "themes": (["uniq_ev"], f"SELECT msg_id, {THEME} AS theme, max({SEV.format(c='severity')}) AS worst, count(*) AS items, min(ord) AS ord FROM uniq_ev GROUP BY msg_id, {THEME}"),
    "corr": (["acc", "themes", "intel"], f"""SELECT a.msg_id, coalesce(t.labels, []::VARCHAR[]) AS corroborating, CASE WHEN coalesce(t.n, 0) = 0 THEN 0.4e0 WHEN t.n = 1 THEN 0.75e0 WHEN t.n = 2 THEN 0.9e0 ELSE 1e0 END AS consistency
 FROM acc a LEFT JOIN (SELECT msg_id, count(*) AS n, list({THEME_LABEL} ORDER BY ord) AS labels FROM themes WHERE worst >= 2 GROUP BY msg_id) t USING (msg_id)"""),
    "inputs": (["acc", "sig", "ml", "corr", "mu", "intel", "matches", "imp", "ev"], """SELECT a.msg_id, ml.probability AS ml_score, coalesce(u.risk, 0e0) AS url_risk, coalesce(t.risk, 0e0) AS threat_intel,
 least(1e0, coalesce(m.w, 0e0) / 4e0) AS pattern_score, least(1e0, coalesce(i.n, 0) / 2e0) AS entity_impersonation, greatest(urgency_score, fear_threat_score, pressure_score) AS urgency,
 payment_request::INTEGER::DOUBLE AS payment_request, credential_request::INTEGER::DOUBLE AS credential_request, otp_request::INTEGER::DOUBLE AS otp_request,
 sensitive_request::INTEGER::DOUBLE AS sensitive_info, instructions::INTEGER::DOUBLE AS suspicious_instructions, corr.consistency, corr.corroborating,
 coalesce(e.n, 0) AS evidence_count, coalesce(e.high, 0) AS high_severity_count, coalesce(e.src, 0) AS distinct_sources, a.body <> '' AS has_text, coalesce(u.n, 0) > 0 AS has_url,
 coalesce(t.sus, 0) > 0 AS intel_informative, coalesce(u.n, 0) > 0 AND (coalesce(u.risk, 0e0) >= 0.4e0 OR coalesce(t.sus, 0) > 0) AS url_anchor
 FROM acc a JOIN sig USING (msg_id) JOIN ml USING (msg_id) JOIN corr USING (msg_id)
 LEFT JOIN (SELECT msg_id, max(risk) AS risk, count(*) AS n FROM mu GROUP BY msg_id) u USING (msg_id)
 LEFT JOIN (SELECT msg_id, max(risk_score) AS risk, count(*) FILTER (WHERE verdict = 'suspicious') AS sus FROM intel GROUP BY msg_id) t USING (msg_id)
 LEFT JOIN (SELECT msg_id, sum(weight) AS w FROM matches GROUP BY msg_id) m USING (msg_id)
 LEFT JOIN (SELECT msg_id, count(*) AS n FROM imp GROUP BY msg_id) i USING (msg_id)
 LEFT JOIN (SELECT msg_id, count(*) AS n, count(*) FILTER (WHERE severity IN ('high', 'critical')) AS high, count(DISTINCT source) AS src FROM ev GROUP BY msg_id) e USING (msg_id)"""),
    "scored": (["inputs"], f"""SELECT *, {rnd('raw_score', 1)} AS score, CASE WHEN raw_score >= 75 THEN 'CRITICAL' WHEN raw_score >= 50 THEN 'HIGH' WHEN raw_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 CASE WHEN suff < 0.35e0 THEN 'INSUFFICIENT' WHEN suff < 0.6e0 THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS sufficiency, {rnd('greatest(0e0, least(0.97e0, 0.2e0 + 0.8e0 * suff))', 2)} AS confidence
 FROM (SELECT *, CASE WHEN wsum > 0 THEN (base + 0.05e0 * (consistency - 0.5e0) * 2e0 * (base / 100e0)) / wsum * 100e0 ELSE 0e0 END AS raw_score FROM (
  SELECT *, {WEIGHT_SUM} AS wsum, {BASE_SUM} AS base, greatest(0e0, least(1e0, 0.3e0 * least(1e0, evidence_count / 6e0) + 0.25e0 * least(1e0, distinct_sources / 5e0) + 0.2e0 * least(1e0, high_severity_count / 2e0)
   + 0.15e0 * consistency)) AS suff FROM inputs))"""),
}


def query(final: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """``final`` with every CTE it needs in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for n in needs:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in (extra or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}" if parts else final

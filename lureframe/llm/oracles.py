"""DuckDB counterparts of the queries that SQL can express."""

from ..lexicon import MULTI_SUFFIXES

_SUFFIXES = ", ".join(f"'{x}'" for x in MULTI_SUFFIXES)
_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BLANKS = r"'[\x20\x09-\x0D]'"

OP4 = rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, {_WORDS.format("t")} ws, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {_BLANKS}, '', 'g') <> '') ls from d),
p as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
r as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) gap from (select *, count(*) over (partition by doc_id, g) c from p) where c > 1),
c as (select doc_id, sum(least(8, coalesce(gap, 8)))::bigint covered from r group by doc_id),
m as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, {_BLANKS}, '', 'g'))::bigint word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
    coalesce(covered, 0)::bigint n_repeat_words, len(ls)::bigint n_lines, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::bigint n_capitals
    from w left join c on w.doc_id = c.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_capitals,
    not (base_failed or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words or word_chars > 14 * n_words
        or 10 * n_capitals > 6 * word_chars or 10 * n_dup_lines > 3 * n_lines) kept
from (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
"""


def _weight(name: str, groups: str, parent: str) -> str:
    """The prior weight of a level as a one-row table."""
    return f"""{name} as (select case when s is null or den <= 0 or (s - k) / den <= 0 then 1000.0
        else least(1000.0, greatest(1.0, (1 - (s - k) / den) / ((s - k) / den))) end w from (
    select sum((b2 - p * p * pn) / (p * (1 - p))) s, sum(k1 - 1) k, sum(pn - n2 / pn - (k1 - 1)) den from (
        select sum(n) pn, sum(bad) pb, count(*) k1, sum(n * n) n2, sum(bad * bad / n) b2, sum(bad) / sum(n) p
        from {groups} where n > 0 group by {parent}) where k1 > 1 and pb > 0 and pb < pn))"""


OP8 = rf"""
with u as (select page_id, case when contains(url, '://') then url[strpos(url, '://') + 3:] else '' end rest from pages),
v as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
l as (select doc_id page_id, count(*) n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels
    where quality = 0 or toxic = 1 or (quality is not null and toxic is not null) group by doc_id),
h0 as (select host, coalesce(sum(n), 0)::double n, coalesce(sum(bad), 0)::double bad from v left join l using (page_id) group by host),
bare as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') name from h0),
two as (select *, array_to_string(string_split(name, '.')[-2:], '.') t2, array_to_string(string_split(name, '.')[-3:], '.') t3,
    string_split(name, '.')[-1] t1, regexp_full_match(name, '[0-9]+([.][0-9]+){{3}}') or starts_with(name, '[') address from bare),
hosts as (select host, n, bad, case when address then name when t2 in ({_SUFFIXES}) then t3 else t2 end domain,
    case when address then 'ip' when t2 in ({_SUFFIXES}) then t2 else t1 end suffix from two),
domains as (select domain, suffix, sum(n) n, sum(bad) bad from hosts group by all),
suffixes as (select suffix, 0 everything, sum(n) n, sum(bad) bad from domains group by suffix),
{_weight("ws", "suffixes", "everything")},
{_weight("wd", "domains", "suffix")},
{_weight("wh", "hosts", "domain")},
s as (select suffix, (ws.w * (select (sum(bad) + 1) / (sum(n) + 2) from suffixes) + bad) / (ws.w + n) m from suffixes, ws),
d as (select domain, (wd.w * s.m + bad) / (wd.w + n) m from domains join s using (suffix), wd),
h as (select host, (wh.w * d.m + bad) / (wh.w + n) m, wh.w + n size from hosts join d using (domain), wh),
j as (select page_id, v.host, path, m - 1.645 * sqrt(m * (1 - m) / (size + 1)) low,
    case when (v.host = 'example.net' or v.host like '%.example.net') and path like '/en/%' then 'example.net/en/'
        when (v.host = 'example.com' or v.host like '%.example.com') and path like '/de/%' then 'example.com/de/'
        when (v.host = 'org' or v.host like '%.org') and path like '/fr/%' then 'org/fr/'
        when (v.host = 'net' or v.host like '%.net') and path like '/%' then 'net/' end rule
    from v join h on v.host = h.host)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when low > 0.5 then 'block' else 'allow' end verdict from j
"""


def op10_sql(masks: tuple[str, ...], min_score: int) -> str:
    def seeds(source: str) -> str:
        parts = []
        for m, mask in enumerate(masks):
            taken = " || ' ' || ".join(f"ws[i + {k}]" for k, c in enumerate(mask) if c == "1")
            parts.append(f"select id, {m} m, i, {taken} g from (select id, ws, unnest(range(1, len(ws) - {len(mask) - 2})) i from {source} where len(ws) >= {len(mask)})")
        return " union all ".join(parts)

    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+')"
    return f"""
with a as (select doc_id id, {words} ws from documents), b0 as (select item_id id, {words} ws from benchmark),
b as (select * from b0 where len(ws) >= {min_score}), sa as ({seeds("a")}), sb as ({seeds("b")}),
hit as (select distinct sa.id doc_id, sb.id item_id, sa.i - sb.i shift from sa join sb using (m, g)),
al as (select doc_id, item_id, shift, k, case when a.ws[k + shift] = b.ws[k] then 1 else -1 end v from hit join a on a.id = doc_id join b on b.id = item_id,
    unnest(range(greatest(1, 1 - shift), least(len(b.ws), len(a.ws) - shift) + 1)) x(k)),
su as (select *, sum(v) over (partition by doc_id, item_id, shift order by k) total from al),
lo as (select *, least(0, coalesce(min(total) over (partition by doc_id, item_id, shift order by k rows between unbounded preceding and 1 preceding), 0)) low from su),
short as (select a.id doc_id, b0.id item_id, len(b0.ws)::int score from b0, a where len(b0.ws) between 1 and {min_score} - 1
    and contains(' ' || array_to_string(a.ws, ' ') || ' ', ' ' || array_to_string(b0.ws, ' ') || ' '))
select doc_id, item_id, max(total - low)::int score from lo group by doc_id, item_id having max(total - low) >= {min_score}
union all select doc_id, item_id, score from short
"""


OP12 = """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end) label,
    list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, a.label = b.label same, b.vec_id id, list_dot_product(a.v, b.v)::bigint score
    from v a join v b on a.vec_id % 100 = 0 and len(a.v) = len(b.v)),
p as (select *, row_number() over (partition by anchor_id order by score desc, id) r from s where same and id <> anchor_id),
n as (select p.anchor_id, p.id positive_id, s.id negative_id, p.score positive_score, s.score negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) rank
    from p join s on p.anchor_id = s.anchor_id and r <= 5 and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank::int rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

OP13 = rf"""
with d as (select coalesce(source, '') part, doc_id, coalesce(text, '') t from documents),
w as (select *, {_WORDS.format("t")} ws from d), f as (select t, min(doc_id) least from d group by t),
l as (select doc_id, max((quality = 1)::int) g, max((toxic = 1)::int) x from labels group by doc_id),
m as (select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(w.doc_id > least, false)::int mask, coalesce(g, 0) g, coalesce(x, 0) x
    from w join f using (t) left join l on w.doc_id = l.doc_id),
c as (select part, mask, count(*) n, sum(g) g, sum(x) x from m group by all),
b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, b)),
o as (select p.l || q.l || r.l || s.l || u.l filter_order, [p.b, q.b, r.b, s.b, u.b] bits from b p, b q, b r, b s, b u
    where len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
k as (select filter_order, step, bits[step] bit, coalesce(list_sum(bits[1:step - 1]), 0)::int state from o, range(1, 6) x(step)),
e as (select part, filter_order, step::int step, bit,
    sum(case when mask & state = 0 and mask & bit = 0 then n else 0 end)::bigint kept,
    sum(case when mask & state = 0 and mask & bit <> 0 then n else 0 end)::bigint removed,
    sum(case when mask & state <> 0 and mask & bit <> 0 then n else 0 end)::bigint redundant,
    sum(case when mask = bit then n else 0 end)::bigint unique_fails,
    sum(case when mask & state = 0 and mask & bit <> 0 then g else 0 end)::bigint good_lost,
    sum(case when mask & state = 0 and mask & bit <> 0 then x else 0 end)::bigint toxic_lost
    from c, k group by part, filter_order, step, bit)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) over (partition by part, bit)::bigint shapley from e
"""

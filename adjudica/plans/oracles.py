"""DuckDB SQL for the queries that SQL can express, written from the operators' definitions."""

from __future__ import annotations

import re

PROFILE = {"fast": (850, 200), "standard": (750, 150), "deep": (650, 100)}

EVIDENCE = """
options as (select event_type, cast(row_number() over (order by event_type) - 1 as integer) as option from (select distinct event_type from events)),
counted as (select user_id, event_type, count(*) as n from events group by all),
wholes as (select user_id, {of}(n) as whole from counted group by user_id),
evidence as (select user_id, option, cast(1000 * n // whole as integer) as c from counted join wholes using (user_id) join options using (event_type)),
scores as (
    select user_id, o.option, coalesce(max(e.c), 0) as c
    from (select distinct user_id from events) cross join options o left join evidence e using (user_id, option) group by user_id, o.option)"""


def gate(scores: str, key: str, profile: str, shape: str = "choice") -> str:
    """From a CTE (key, option, c) named *scores*: the flat form of an answer."""
    low, margin = PROFILE[profile]
    return f"""
order_of as (select *, row_number() over (partition by {key} order by c desc, option) as r from {scores}),
best as (
    select {key}, max(case when r = 1 then option end) as option, max(case when r = 1 then c end) as top, coalesce(max(case when r = 2 then c end), 0) as second,
        string_agg(option || ':' || c, ',' order by r) as ranked
    from order_of group by {key}),
gated as (select *, case when top < {low} then 'low_confidence' when top - second < {margin} then 'low_margin' end as why from best)
select {key}, case when why is null then '{shape}' else 'abstain' end as answer, cast(case when why is null then option end as integer) as chosen, cast(case when why is null then top end as integer) as confidence,
    why, cast(case why when 'low_confidence' then top when 'low_margin' then top - second end as integer) as why_value,
    cast(case why when 'low_confidence' then {low} when 'low_margin' then {margin} end as integer) as why_min, ranked
from gated"""


def events_gate(profile: str, of: str = "max") -> str:
    return f"with {EVIDENCE.format(of=of)}, {gate('scores', 'user_id', profile)}"


def arbitration_ctes(levels: list[int], weights: list[list[int]], incumbent: bool) -> str:
    """CTEs kept (user_id, persisted, bonus) and final (user_id, option, urge, drive, c)."""
    rows = ", ".join(f"({d}, {o}, {level * w // 1000})" for d, (level, row) in enumerate(zip(levels, weights)) for o, w in enumerate(row))
    held = "user_id % 5" if incumbent else "null"
    return f"""
with {EVIDENCE.format(of="max")},
pulls(drive, option, pull) as (values {rows}),
best as (select option, max(pull) as pull, arg_min(drive, -pull * 100 + drive) as drive from pulls group by option),
urges as (select user_id, option, cast(pull * c // 1000 as integer) as urge, case when pull > 0 then drive end as drive, cast({held} as integer) as held from scores join best using (option)),
kept as (select user_id, max(case when option = held and urge >= 750 then held end) as persisted, max(case when option = held and urge >= 750 then least(1000, urge + 150) - urge end) as bonus from urges group by user_id),
final as (select u.*, persisted, bonus, urge + case when option = persisted then bonus else 0 end as c from urges u join kept using (user_id))"""


def arbitration(levels: list[int], weights: list[list[int]], incumbent: bool) -> str:
    return f"""{arbitration_ctes(levels, weights, incumbent)},
ordered as (select *, row_number() over (partition by user_id order by c desc, option) as r from final),
two as (
    select user_id, max(case when r = 1 then option end) as option, max(case when r = 1 then c end) as top, max(case when r = 2 then c end) as second, max(case when r = 1 then drive end) as drive,
        string_agg(cast(urge as varchar), ',' order by option) as urges, string_agg(coalesce(cast(drive as varchar), '-'), ',' order by option) as dominant, max(persisted) as persisted, max(bonus) as bonus
    from ordered group by user_id)
select user_id, urges, dominant, cast(persisted as integer) as persisted, cast(bonus as integer) as bonus, case when top >= 750 and top - second >= 150 then 'choice' else 'abstain' end as answer,
    cast(case when top >= 750 and top - second >= 150 then option end as integer) as option, cast(case when top >= 750 and top - second >= 150 then top end as integer) as confidence,
    cast(case when top >= 750 and top - second >= 150 then drive end as integer) as winner_drive
from two"""


#: Seeds by 64-bit arithmetic in wider integers, then the stream's words.
SEED = """
raw as (select p_partkey, p_name, p_brand, {name} as symbol from part),
bytes as (
    select *, [7, 0, 0, 0, 0, 0, 0, 0] || [cast(ascii(x) as integer) for x in string_split('pua-hv1', '')] || [5, 0, 0, 0, 0, 0, 0, 0] || [cast(ascii(x) as integer) for x in string_split('parts', '')]
        || [length(symbol), 0, 0, 0, 0, 0, 0, 0] || [cast(ascii(x) as integer) for x in string_split(symbol, '')] || [4, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0] as b from raw),
seeded as (
    select p_partkey, p_name, p_brand, symbol, list_reduce([cast(x as uhugeint) for x in b], lambda h, x: cast(xor(h, x) * 1099511628211 % 18446744073709551616 as uhugeint), cast(14695981039346656037 as uhugeint)) as seed from bytes)"""
STREAM = """
z0 as (select *, [cast((seed + cast(i + 1 as uhugeint) * cast(11400714819323198485 as uhugeint)) % cast(18446744073709551616 as uhugeint) as uhugeint) for i in range(16)] as z from seeded),
z1 as (select * replace ([xor(x, x >> 30) * cast(13787848793156543929 as uhugeint) % cast(18446744073709551616 as uhugeint) for x in z] as z) from z0),
z2 as (select * replace ([xor(x, x >> 27) * cast(10723151780598845931 as uhugeint) % cast(18446744073709551616 as uhugeint) for x in z] as z) from z1),
vectors as (select p_partkey, p_name, p_brand, symbol, [cast(xor(x, x >> 31) as ubigint) for x in z] as v from z2)"""
SIGNED = "cast(case when {x} >= 9223372036854775808 then cast({x} as hugeint) - 18446744073709551616 else cast({x} as hugeint) end as bigint)"

WL = """
with nodes as (
    select cast(n_nationkey as bigint) * 4 as v, 0 as label from nation union all select c_custkey * 4 + 1, 1 from customer union all select s_suppkey * 4 + 2, 2 from supplier union all select o_orderkey * 4 + 3, 3 from orders),
adjacent as (
    select c_custkey * 4 + 1 as v, cast(c_nationkey as bigint) * 4 as u, 0 as way from customer union all select cast(c_nationkey as bigint) * 4, c_custkey * 4 + 1, 0 from customer
    union all select s_suppkey * 4 + 2, cast(s_nationkey as bigint) * 4, 0 from supplier union all select cast(s_nationkey as bigint) * 4, s_suppkey * 4 + 2, 0 from supplier
    union all select o_orderkey * 4 + 3, o_custkey * 4 + 1, 1 from orders union all select o_custkey * 4 + 1, o_orderkey * 4 + 3, 2 from orders),
c0 as (select v, cast(label as varchar) as colour from nodes),
s1 as (select a.v, string_agg(way || ':' || colour, ',' order by way, colour) as around from adjacent a join c0 on c0.v = a.u group by a.v),
c1 as (select c0.v, md5(colour || '|' || coalesce(around, '')) as colour from c0 left join s1 using (v)),
s2 as (select a.v, string_agg(way || ':' || colour, ',' order by way, colour) as around from adjacent a join c1 on c1.v = a.u group by a.v),
c2 as (select c1.v, md5(colour || '|' || coalesce(around, '')) as colour from c1 left join s2 using (v))
select v, min(v) over (partition by colour) as class from c2"""


def sql(levels: list[int], weights: list[list[int]]) -> dict[str, str]:
    names = {"seed": f"with {SEED.format(name='p_name')} select p_partkey, {SIGNED.format(x='seed')} as seed from seeded"}
    vectors = f"with {SEED.format(name='p_name')}, {STREAM}"
    named = f"{SEED.format(name='p_name')}, {STREAM}"
    branded = re.sub(r"\b(raw|bytes|seeded|z0|z1|z2|vectors)\b", r"\1_b", f"{SEED.format(name='p_brand')}, {STREAM}")
    both = f"with {named}, {branded}"
    apart = "list_sum(list_transform(list_zip({a}, {b}), lambda x: bit_count(xor(x[1], x[2]))))"
    standard, deep = (f"select * from ({events_gate(p)})" for p in ("standard", "deep"))
    customers = """
counted as (select o_custkey, option, count(*) as n from (select o_custkey, cast(substr(o_orderpriority, 1, 1) as integer) - 1 as option from orders) group by all),
most as (select o_custkey, max(n) as most from counted group by 1),
scores as (select k.o_custkey, o.option, coalesce(max(1000 * n // most), 0) as c from most k cross join range(5) o(option) left join counted c on c.o_custkey = k.o_custkey and c.option = o.option group by all)"""
    answers = """
yes as (select o_custkey, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as yes, count(*) as n from orders group by 1),
scores as (select o_custkey, 0 as option, 1000 * (n - yes) // n as c from yes union all select o_custkey, 1, 1000 * yes // n from yes)"""
    noul = gate("scores", "o_custkey", "deep", "noul")
    return {
        "gate_fast": events_gate("fast"),
        "gate_standard": events_gate("standard"),
        "gate_deep": events_gate("deep"),
        "gate_low_confidence": events_gate("deep", "sum"),
        "noul_gate": f"with {answers}, {noul}",
        "score_gate": f"with {customers}, {gate('scores', 'o_custkey', 'standard', 'score')}",
        "sum_scorer": "with s as (select user_id, cast(event_id % 4 as integer) as option, least(1000, 40 * count(*)) as c, 25 * count(*) filter (event_id % 10 = 0) as off from events group by all) select user_id, option, cast(greatest(0, c - off) as integer) as c from s",
        "raise_to": "select user_id, cast(event_id % 4 as integer) as option, cast(greatest(0, least(1000, max(cast(floor(value) as integer)))) as integer) as c from events group by all",
        "candidate_chosen": """
with n as (select o_custkey, o_orderstatus as candidate, count(*) as n from orders group by all),
s as (select o_custkey, candidate, cast(1000 * n // max(n) over (partition by o_custkey) as integer) as c from n),
o as (select *, row_number() over (partition by o_custkey order by c desc, candidate) as r from s),
two as (select o_custkey, max(case when r = 1 then candidate end) as candidate, max(case when r = 1 then c end) as top, coalesce(max(case when r = 2 then c end), 0) as second from o group by 1)
select o_custkey, case when top >= 750 and top - second >= 150 then candidate end as chosen, top, cast(top - second as integer) as margin from two""",
        "arbitrate": arbitration(levels, weights, False),
        "arbitrate_incumbent": arbitration(levels, weights, True),
        "canonical_turns": r"select conv_id, turn, trim(regexp_replace(lower(nfc_normalize(text)), '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as canonical from conversations",
        "sentence_counts": r"select conv_id, turn, cast(len(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.!?] ')) + 1 as integer) as sentences from conversations",
        "protected_urls": "select page_id, case when regexp_matches(lower(url), '^(https?://|ftp://|file://|www\\.)') or contains(url, '://') then 'url' end as kind, cast(1 as integer) as n from pages",
        "decision_diff": f"""
with a as ({standard}), b as ({deep})
select * from (
    select coalesce(a.user_id, b.user_id) as user_id, a.answer is distinct from b.answer as answer_changed, a.chosen is distinct from b.chosen as chosen_changed, a.why is distinct from b.why as why_changed,
        b.user_id is null as only_before, a.user_id is null as only_after
    from a full join b on a.user_id = b.user_id) where answer_changed or chosen_changed or why_changed or only_before or only_after""",
        "hdc_seed": names["seed"],
        "hdc_encode": f"{vectors} select p_partkey, {SIGNED.format(x='v[1]')} as first_word, {SIGNED.format(x='v[16]')} as last_word, cast(list_sum([bit_count(x) for x in v]) as integer) as ones from vectors",
        "hdc_nearest": f"""
{both}, book as (select symbol as id, any_value(v) as bv from vectors_b group by symbol),
sims as (select p_partkey, id, cast((1024 - 2 * {apart.format(a="v", b="bv")}) * 1000 // 1024 as integer) as sim from vectors cross join book),
ordered as (select *, row_number() over (partition by p_partkey order by sim desc, id) as r from sims)
select p_partkey, max(case when r = 1 then id end) as id, max(case when r = 1 then sim end) as similarity, cast(least(1000, max(case when r = 1 then sim end) - max(case when r = 2 then sim end)) as integer) as margin
from ordered group by p_partkey""",
        "hdc_bind": f"""
{both}, bound as (select a.p_partkey, a.v, b.v as bv, list_transform(list_zip(a.v, b.v), lambda x: xor(x[1], x[2])) as w from vectors a join vectors_b b using (p_partkey))
select p_partkey, cast((1024 - 2 * {apart.format(a="w", b="v")}) * 1000 // 1024 as integer) as to_name, cast({apart.format(a="list_transform(list_zip(w, bv), lambda x: xor(x[1], x[2]))", b="v")} as integer) as left_over, -1000 as to_negative from bound""",
        "hdc_bundle": f"""
with {named}, bits as (select p_partkey, p_brand, w, b, cast((v[w + 1] >> b) & 1 as integer) as bit from vectors cross join range(16) t(w) cross join range(64) u(b)),
bundles as (select p_brand, w, b, case when sum(1 - 2 * bit) < 0 then 1 else 0 end as bit from bits group by all),
likeness as (select p_partkey, bits.p_brand, (1024 - 2 * count(*) filter (bits.bit <> bundles.bit)) * 1000 // 1024 as s from bits join bundles using (p_brand, w, b) group by all)
select p_brand, cast(sum(s) as bigint) as similarity, count(*) as n from likeness group by p_brand""",
        "wl_colours": WL,
    }

"""DuckDB SQL for the registered queries on values, arbitration records, hypervectors and graphs."""

from __future__ import annotations

from . import oracles
from .oracles import SEED, SIGNED, STREAM

#: Published recall of bundles of 1, 5, 15, 50, 100 and 200 members in thousandths (by decoding, by one look at the signs), by dimension and entries.
CAPACITY = {
    1024: {64: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 972)], 256: [(1000, 1000), (1000, 1000), (1000, 993), (1000, 926), (1000, 875), (1000, 910)], 1024: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 860), (1000, 750), (984, 664)]},
    2048: {64: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 996)], 256: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 988), (1000, 953), (1000, 955)], 1024: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 980), (1000, 900), (1000, 813)]},
    4096: {64: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 1000)], 256: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 1000), (1000, 991), (1000, 981)], 1024: [(1000, 1000), (1000, 1000), (1000, 1000), (1000, 1000), (1000, 984), (1000, 933)]},
}
BUNDLES = (1, 5, 15, 50, 100, 200)

NODES = "nodes as (select cast(n_nationkey as bigint) * 4 as v, 0 as label from nation union all select c_custkey * 4 + 1, 1 from customer union all select s_suppkey * 4 + 2, 2 from supplier union all select o_orderkey * 4 + 3, 3 from orders)"
ADJACENT = """adjacent as (
    select c_custkey * 4 + 1 as v, cast(c_nationkey as bigint) * 4 as u, 0 as way from customer union all select cast(c_nationkey as bigint) * 4, c_custkey * 4 + 1, 0 from customer
    union all select s_suppkey * 4 + 2, cast(s_nationkey as bigint) * 4, 0 from supplier union all select cast(s_nationkey as bigint) * 4, s_suppkey * 4 + 2, 0 from supplier
    union all select o_orderkey * 4 + 3, o_custkey * 4 + 1, 1 from orders union all select o_custkey * 4 + 1, o_orderkey * 4 + 3, 2 from orders)"""


def _rounds(n: int) -> str:
    """CTEs c0 to cn (v, colour), by any hash."""
    out = ["c0 as (select v, cast(label as varchar) as colour from nodes)"]
    for k in range(1, n + 1):
        out.append(f"s{k} as (select a.v, string_agg(way || ':' || colour, ',' order by way, colour) as around from adjacent a join c{k - 1} c on c.v = a.u group by a.v)")
        out.append(f"c{k} as (select c.v, md5(colour || '|' || coalesce(around, '')) as colour from c{k - 1} c left join s{k} using (v))")
    return ", ".join(out)


def _summed(h: str) -> str:
    return ", ".join(f"sum(cast('0x' || substr({h}, {8 * i + 1}, 8) as bigint)) as s{i}" for i in range(8))


SUMS = ", ".join(f"s{i}" for i in range(8))


def _hashed_rounds(n: int) -> str:
    """CTEs d0 to dn (v, colour), with sums of hashes."""
    out = ["d0 as (select v, sha256('init|' || label) as colour from nodes)"]
    for k in range(1, n + 1):
        out.append(f"n{k} as (select a.v, way, colour, count(*) as n from adjacent a join d{k - 1} c on c.v = a.u group by all)")
        out.append(f"h{k} as (select v, count(*) as n, {_summed('h')} from (select v, sha256('0:0:' || way || ':' || colour || ':' || n) as h from n{k}) group by v)")
        out.append(f"d{k} as (select c.v, sha256(colour || '|' || case when h.v is null then '' else concat_ws(',', n, {SUMS}) end) as colour from d{k - 1} c left join h{k} h using (v))")
    return ", ".join(out)


def _chains(tag: str, signature: str) -> str:
    """Fingerprints of conversations' chains, byte by byte in hexadecimal; *signature* is a query (g, p, around) over colours c (g, p, colour)."""
    small = lambda x, width: f"lpad(lower(hex({x})), 2, '0') || '{'00' * (width - 1)}'"
    name = tag.encode().hex()
    out = [
        "turns as (select conv_id as g, turn as t, min(case when role = 'user' then 1 else 2 end) as label from conversations group by all)",
        "placed as (select g, label, row_number() over (partition by g order by t) as p, count(*) over (partition by g) as n from turns)",
        f"k0 as (select g, p, n, sha256(unhex('{name}' || '{b'init'.hex()}' || {small('label', 8)})) as colour from placed)",
    ]
    for k in range(1, 4):
        out.append(f"a{k} as ({signature.format(c=f'k{k - 1}', one=small(1, 1))})")
        out.append(f"k{k} as (select c.g, c.p, c.n, sha256(unhex('{name}' || colour || {small('coalesce(a.m, 0)', 8)} || coalesce(a.around, ''))) as colour from k{k - 1} c left join a{k} a using (g, p))")
    # the mode, a fixed number of rounds, the rounds run, the nodes, and the colours in order
    return f"""with {', '.join(out)} select g, sha256(unhex('{name}' || '0003' || '03000000' || {small('any_value(n)', 8)} || string_agg(colour, '' order by colour))) as fingerprint,
    cast(count(distinct colour) as integer) as classes, cast(3 as integer) as rounds from k3 group by g"""


#: Fixed values of BLAKE3: the initial words and the order in which a round takes the words of the last one's message.
BLAKE3_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
BLAKE3_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)


def _blake3(source: str, keep: str) -> str:
    """CTEs from a query *source* (*keep*, data: at most 64 bytes) to digest (*keep*, h0 to h7): BLAKE3 of one block, a half round a CTE."""
    word = lambda i: "cast('0x' || " + " || ".join(f"substr(h, {8 * i + k}, 2)" for k in (7, 5, 3, 1)) + " as bigint)"
    turned = lambda x, n: f"(({x} >> {n}) | (({x} << {32 - n}) & 4294967295))"
    # start, end and root of the tree at once
    start = [*BLAKE3_IV, *BLAKE3_IV[:4], 0, 0, "octet_length(data)", 1 + 2 + 8]
    out = [
        f"padded as (select {keep}, data, rpad(lower(hex(data)), 128, '0') as h from ({source}))",
        f"q0 as (select {keep}, {', '.join(f'{word(i)} as m{i}' for i in range(16))}, {', '.join(f'cast({x} as bigint) as v{i}' for i, x in enumerate(start))} from padded)",
    ]
    order, held = list(range(16)), ", ".join(f"m{i}" for i in range(16))
    for half in range(14):
        lanes = [(i, 4 + (i + s) % 4, 8 + (i + 2 * s) % 4, 12 + (i + 3 * s) % 4) for s in [half % 2] for i in range(4)]
        cells: list[str] = []
        for k, (a, b, c, d) in enumerate(lanes):
            x, y = (order[8 * (half % 2) + 2 * k + j] for j in (0, 1))
            cells += [
                f"(v{a} + v{b} + m{x}) & 4294967295 as a{k}", f"{turned(f'xor(v{d}, a{k})', 16)} as d{k}", f"(v{c} + d{k}) & 4294967295 as c{k}", f"{turned(f'xor(v{b}, c{k})', 12)} as b{k}",
                f"(a{k} + b{k} + m{y}) & 4294967295 as w{a}", f"{turned(f'xor(d{k}, w{a})', 8)} as w{d}", f"(c{k} + w{d}) & 4294967295 as w{c}", f"{turned(f'xor(b{k}, w{c})', 7)} as w{b}",
            ]
        out.append(f"p{half + 1} as (select {keep}, {held}, {', '.join(f'v{i}' for i in range(16))}, {', '.join(cells)} from q{half})")
        out.append(f"q{half + 1} as (select {keep}, {held}, {', '.join(f'w{i} as v{i}' for i in range(16))} from p{half + 1})")
        if half % 2:
            order = [order[i] for i in BLAKE3_ORDER]
    out.append(f"digest as (select {keep}, {', '.join(f'xor(v{i}, v{i + 8}) as h{i}' for i in range(8))} from q14)")
    return ", ".join(out)


def _node_labels() -> str:
    part = lambda x: f"lpad(lower(hex(strlen({x}))), 2, '0') || '00000000000000' || lower(hex(encode({x})))"
    source = f"select n_nationkey, unhex('{b'pua-graph/label/1'.hex()}' || {part(chr(39) + 'nation' + chr(39))} || {part('n_name')}) as data from nation"
    return f"with {_blake3(source, 'n_nationkey')} select n_nationkey, {oracles.SIGNED.format(x='(cast(h1 as uhugeint) * cast(4294967296 as uhugeint) + cast(h0 as uhugeint))')} as label from digest"


WL_SIGNATURE = """select g, p, count(*) as m, string_agg('00' || '0000000000000000' || way || colour, '' order by way, colour) as around from (
    select a.g, a.p, '01' as way, b.colour from {c} a join {c} b on a.g = b.g and b.p = a.p + 1 union all select a.g, a.p, '02', b.colour from {c} a join {c} b on a.g = b.g and b.p = a.p - 1) group by g, p"""
SPD_SIGNATURE = """select g, p, count(*) as m, string_agg(lpad(lower(hex(far)), 2, '0') || '000000' || colour, '' order by far, colour) as around from (
    select a.g, a.p, abs(a.p - b.p) as far, b.colour from {c} a join {c} b on a.g = b.g and a.p <> b.p) group by g, p"""


def _decoded(rounds: int) -> str:
    """The event types that users' sums are made of, one after another."""
    seeds = SEED.format(name="p_name").replace("select p_partkey, p_name, p_brand, p_name as symbol from part", "select 0 as p_partkey, '' as p_name, '' as p_brand, event_type as symbol from (select distinct event_type from events)")
    seeds = seeds.replace("[5, 0, 0, 0, 0, 0, 0, 0] || [cast(ascii(x) as integer) for x in string_split('parts', '')]", "[6, 0, 0, 0, 0, 0, 0, 0] || [cast(ascii(x) as integer) for x in string_split('events', '')]")
    out = [
        seeds, STREAM,
        "entry as (select symbol as id, row_number() over (order by symbol) as idx, v from vectors)",
        "comp as (select id, idx, w * 64 + b as i, 1 - 2 * cast((v[w + 1] >> b) & 1 as integer) as s from entry cross join range(16) t(w) cross join range(64) u(b))",
        "weight as (select user_id, event_type as id, count(*) as n from events group by all)",
        "t0 as (select user_id, i, sum(n * s) as total from weight join comp using (id) group by all)",
        "r0 as (select distinct user_id, cast([] as varchar[]) as used, true as open from weight)",
    ]
    for k in range(1, rounds + 1):
        before = f"t{k - 1}"
        out.append(f"dots{k} as (select user_id, id, idx, sum(total * s) as dot from {before} join comp using (i) group by all)")
        out.append(f"norm{k} as (select user_id, greatest(1, sum(abs(total))) as l1 from {before} group by all)")
        out.append(f"""best{k} as (select * from (
            select d.user_id, d.id, d.dot, cast(sign(d.dot) * (abs(d.dot) * 1000 // l1) as bigint) as score, row_number() over (partition by d.user_id order by cast(sign(d.dot) * (abs(d.dot) * 1000 // l1) as bigint) desc, idx) as place
            from dots{k} d join norm{k} using (user_id) join r{k - 1} r on r.user_id = d.user_id and r.open and not list_contains(r.used, d.id)) where place = 1 and score >= 100)""")
        out.append(f"r{k} as (select r.user_id, case when b.id is null then used else list_append(used, b.id) end as used, b.id is not null as open from r{k - 1} r left join best{k} b using (user_id))")
        out.append(f"t{k} as (select t.user_id, t.i, t.total - coalesce(cast(sign(dot) * ((2 * abs(dot) + 1024) // 2048) as bigint) * s, 0) as total from {before} t left join best{k} b using (user_id) left join comp c on c.id = b.id and c.i = t.i)")
    found = " union all ".join(f"select user_id, cast({k} as integer) as rank, id, cast(score as integer) as similarity from best{k}" for k in range(1, rounds + 1))
    return f"with {', '.join(out)} {found}"


def sql(levels: list[int], weights: list[list[int]], drives: list[str]) -> dict[str, str]:
    named = f"{SEED.format(name='p_name')}, {STREAM}"
    branded = f"{SEED.format(name='p_brand')}, {STREAM}"
    bits = "bits as (select p_partkey, p_brand, w * 64 + b as i, w, b, cast((v[w + 1] >> b) & 1 as integer) as bit from vectors cross join range(16) t(w) cross join range(64) u(b))"
    places = [0, 1, 63, 69, 70, 71, 500, 1023, 1030]
    capacity = ", ".join(f"({n}, {dim}, {k}, {a}, {b})" for dim, books in CAPACITY.items() for n, cells in books.items() for k, (a, b) in zip(BUNDLES, cells))
    named_drives = "[" + ", ".join(f"'{x}'" for x in drives) + "]"
    return {
        "arbitration_trail": f"""{oracles.arbitration_ctes(levels, weights, True)},
records as (
    select user_id, option as place, urge as millis, 'option ' || option || ' urge ' || urge || ' dominant ' || {named_drives}[cast(drive + 1 as integer)] as "text" from final where urge > 0 and drive is not null
    union all select user_id, 99, bonus, 'persist option ' || persisted || ' +' || bonus from kept where persisted is not null)
select user_id, cast(row_number() over (partition by user_id order by place) as integer) as step, 'arbitration' as stage, cast(millis as integer) as millis, "text" from records""",
        "bounded_values": """
with e as (select event_id, cast(event_id % 4001 - 2000 as integer) as x from events), c as (select *, greatest(0, least(1000, x)) as c from e)
select event_id, greatest(-1000, least(1000, x)) as millis, c as confidence, c // 2 as halved, least(1000, c + 700) as added, greatest(0, c - 700) as taken, x between 0 and 1000 as valid, cast(x // 7 as bigint) as seventh from c""",
        "span_values": r"""
with s as (select doc_id, text, cast(doc_id % 11 as integer) as a, cast(doc_id % 17 as integer) as b, cast(doc_id % 7 as integer) as c, cast(doc_id % 7 + doc_id % 5 as integer) as d from documents)
select doc_id, case when a > b then 'start after end' end as fault, c || '..' || d as shown, substr(regexp_replace(text, '[^\x00-\x7f]', '~', 'g'), c + 1, d - c) as cut, a < d and c < b as overlap, a <= c and d <= b as contains, least(a, c) || '..' || greatest(b, d) as cover from s""",
        "label_values": """
with l as (select p_partkey, case p_partkey % 7 when 0 then p_name || ' ' when 1 then '  ' when 2 then repeat(p_name, 20) when 3 then null else p_name end as label from part)
select p_partkey, case when label is null or trim(label) = '' then 'empty' when trim(label) <> label then 'untrimmed' when strlen(label) > 256 then 'too long' end as fault from l""",
        "profile_thresholds": "select * from (values ('fast', cast(850 as integer), cast(200 as integer)), ('standard', 750, 150), ('deep', 650, 100)) t(profile, least, margin)",
        "option_numbers": "select o_custkey, o_orderstatus as candidate, cast(row_number() over (partition by o_custkey order by o_orderstatus) - 1 as integer) as option from (select distinct o_custkey, o_orderstatus from orders)",
        "abstentions": f"""with answered as ({oracles.events_gate('standard')})
select user_id, answer = 'abstain' as abstains, chosen, case why when 'low_confidence' then 'low confidence ' || why_value || ' < ' || why_min when 'low_margin' then 'low margin ' || why_value || ' < ' || why_min end as reason, cast(5 as integer) as options from answered""",
        "hdc_permute": f"""
with {named}, {bits}, moved as (select p_partkey, (i + 70) % 1024 as i, bit from bits), places(k, i) as (values {", ".join(f"({k}, {i % 1024})" for k, i in enumerate(places))}),
apart as (select p_partkey, count(*) filter (m.bit <> b.bit) as apart from moved m join bits b using (p_partkey, i) group by 1)
select p_partkey, string_agg(1 - 2 * bit, ',' order by k) as components, any_value(apart) as apart from moved join places using (i) join apart using (p_partkey) group by p_partkey""",
        "hdc_dimensions": f"with {SEED.format(name='p_name')}, {STREAM.replace('range(16)', 'range(64)')} select p_partkey, cast(list_sum([bit_count(x) for x in v[1:32]]) as integer) as ones_a, cast(list_sum([bit_count(x) for x in v]) as integer) as ones_b, {SIGNED.format(x='v[32]')} as last_a, {SIGNED.format(x='v[64]')} as last_b from vectors",
        "hdc_cleanup": f"select * from ({oracles.sql(levels, weights)['hdc_nearest']}) where similarity >= 60",
        "hdc_codebook": f"with {branded}, book as (select symbol as id, any_value(v) as v from vectors group by symbol) select cast(row_number() over (order by id) - 1 as integer) as idx, id, {SIGNED.format(x='v[1]')} as first_word from book",
        "hdc_weighted": f"""
with {named}, {bits}, total as (select p_brand, i, cast(sum((p_partkey % 5 - 2) * (1 - 2 * bit)) as bigint) as s from bits group by all)
select p_brand, cast(sum(abs(s)) as bigint) as l1, cast(max(s) as integer) as top, cast(min(s) as integer) as bottom, cast(max(case when i = 77 then s end) as integer) as one, cast(count(*) filter (s < 0) as integer) as negative from total group by p_brand""",
        "hdc_decode": _decoded(3),
        "hdc_resonate": "select cast(n_nationkey as bigint) as n_nationkey, true as converged, r_name as a, n_name as b from nation join region on n_regionkey = r_regionkey",
        "hdc_capacity": f'select cast(entries as integer) as entries, cast(dim as integer) as dim, cast(k as integer) as k, cast("decode" as integer) as "decode", cast("sign" as integer) as "sign" from (values {capacity}) t(entries, dim, k, "decode", "sign")',
        "graph_fingerprint": f"""
with {NODES}, {ADJACENT}, {_hashed_rounds(2)}, sizes as (select colour, count(*) as n from d2 group by colour),
total as (select count(*) as classes, cast(sum(n) as bigint) as nodes, {_summed('h')} from (select n, sha256(colour || ':' || n) as h from sizes))
select classes, nodes, sha256(concat_ws(',', classes, nodes, {SUMS})) as fingerprint from total""",
        "wl_stable_classes": f'with {NODES}, {ADJACENT}, {_rounds(6)} select "class", count(*) as n from (select min(v) over (partition by colour) as "class" from c6) group by "class"',
        "node_labels": _node_labels(),
        "wl_fingerprints": _chains("wl-v1", WL_SIGNATURE),
        "spd_wl_fingerprints": _chains("spd-wl-v1", SPD_SIGNATURE),
    }

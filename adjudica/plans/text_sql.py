"""The text operators once more, as DuckDB SQL written from their definitions: canonical text, protected spans, tokens, look-alikes,
questions, lexicon scans with typo repair, rules, decisions and trails.

The SQL is exact for texts of Latin letters, with what the registered queries put into them: spans that don't lie across one another,
and Greek or Cyrillic letters only within Latin words. Specifications go in as VALUES.
"""

from __future__ import annotations

import string

from ..kernels.lexicon import Lexicon
from ..kernels.rules import SLOTS, RuleSet

SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def quoted(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def collapsed(x: str) -> str:
    """Runs of one repeated ASCII mark as one."""
    for mark in string.punctuation:
        held, one = ("\\" + mark).replace("'", "''"), mark.replace("\\", r"\\").replace("'", "''")
        x = f"regexp_replace({x}, '(?:{held}){{2,}}', '{one}', 'g')"
    return x


def analysis(source: str, collapse: bool = False) -> str:
    """CTEs from a query *source* with columns doc and text: segs (with canonical text, kinds and byte offsets), pieces, toks, asked and texts."""
    plus = "+" if collapse else ""
    word = rf"(?:\p{{L}}(?:(?:''{plus}|\.{plus}|:{plus})?\p{{L}})*|[0-9](?:(?:''{plus}|\.{plus}|,{plus}|;{plus})?[0-9])*|_+)+"
    free = (lambda x: f"case when regexp_matches({x}, '[[:punct:]]{{2}}') then {collapsed(x)} else {x} end") if collapse else (lambda x: x)
    return rf"""
src as ({source}),
cut as (select doc, regexp_extract_all(nfc_normalize(text), '(?s:```.*?(?:```|\z)|`[^`]*`|"[^"]*"|“[^”]*”|[{SPACE}]+|[^{SPACE}`"“]+|.)') as ss, strlen(text) - strlen(nfc_normalize(text)) as moved from src where text is not null),
segs0 as (select doc, moved, len(ss) as n, unnest(ss) as seg, generate_subscripts(ss, 1) as i from cut),
segs1 as (
    select *, case when starts_with(seg, '```') then 'fenced_code' when length(seg) > 1 and seg[1] = '`' then 'inline_code' when length(seg) > 1 and seg[1] in ('"', '“') then 'quoted' when regexp_full_match(seg, '[{SPACE}]+') then 'space' else 'chunk' end as sort,
        regexp_extract(seg, '^[(\[<{{]*') as pre, regexp_extract(seg, '[.,;:!?)\]}}''">]*$') as post from segs0),
segs2 as (select *, case when sort = 'chunk' then substr(seg, length(pre) + 1, greatest(0, length(seg) - length(pre) - length(post))) else '' end as core from segs1),
segs3 as (
    select *, case when sort in ('fenced_code', 'inline_code', 'quoted') then sort when core = '' then null when regexp_matches(core, '^(?i:https?://|ftp://|file://|www\.)') or contains(core, '://') then 'url'
        when regexp_matches(core, '^(~/|\.\.?/)') or ((contains(core, '/') or contains(core, '\')) and regexp_matches(core, '[\p{{L}}\p{{N}}]')) then 'path' when regexp_full_match(core, '[vV]?[0-9]+(\.[0-9]+)+') then 'number' end as zone from segs2),
segs4 as (
    select *, case when sort = 'space' then case when i in (1, n) then '' else ' ' end when sort <> 'chunk' then seg when zone is null then {free("lower(seg)")} else {free("pre")} || core || {free("post")} end as canon,
        coalesce(lead(sort) over (partition by doc order by i) = 'space' and i + 1 < n, false) as before_space from segs3),
segs as (
    select *, coalesce(sum(strlen(seg)) over before, 0) as spot, coalesce(sum(strlen(canon)) over before, 0) as canon_at from segs4 window before as (partition by doc order by i rows between unbounded preceding and 1 preceding)),
pieces0 as (select doc, i, moved, spot, zone, sort, pre, core, before_space, unnest(ps) as piece, generate_subscripts(ps, 1) as k, len(ps) as m from (select *, regexp_extract_all(seg, '{word}|(?s:.)') as ps from segs where sort <> 'space')),
pieces1 as (
    select *, regexp_matches(piece, '[\p{{L}}\p{{N}}]') as is_word, spot + coalesce(sum(strlen(piece)) over inside, 0) as start, coalesce(sum(length(piece)) over inside, 0) as off,
        piece in ('.', '!', '?') and coalesce(case when k = m then before_space else lead(piece) over (partition by doc, i order by k) = ' ' end, false) as ends
    from pieces0 window inside as (partition by doc, i order by k rows between unbounded preceding and 1 preceding)),
pieces as (select *, cast(coalesce(sum(cast(ends as integer)) over (partition by doc order by i, k rows between unbounded preceding and 1 preceding), 0) as integer) as sentence from pieces1),
toks0 as (
    select doc, cast(row_number() over (partition by doc order by i, k) - 1 as integer) as pos, case when zone is null then {free("lower(piece)")} else piece end as word, sentence, zone,
        cast(start + case when start > 0 then moved else 0 end as integer) as start, cast(start + strlen(piece) + moved as integer) as stop from pieces where is_word),
toks1 as (select *, case when regexp_matches(word, '[α-ωа-я]') then 'MixedScript' end as confusable from toks0),
toks as (
    select *, zone is null as free, zone is null and confusable is null as plain, case when confusable is not null then replace(translate(word, 'οα' || 'а', 'oaa'), 'm', 'rn') end as skeleton from toks1),
marks as (
    select doc, piece, zone is null or off < length(pre) or (sort = 'chunk' and off >= length(pre) + length(core)) as free, max(case when is_word then sentence end) over before as said, min(case when is_word then sentence end) over after as next from pieces
    window before as (partition by doc order by i, k rows between unbounded preceding and 1 preceding), after as (partition by doc order by i, k rows between 1 following and unbounded following)),
asked as (select distinct doc, said as sentence from marks where piece = '?' and free and said is not null and said is distinct from next),
texts as (
    select doc, coalesce(c.canonical, '') as canonical, coalesce(p.sentences, 1) as sentences, coalesce(t.n, 0) as n_tokens, coalesce(t.mixed, 0) as n_confusable, coalesce(z.n, 0) as n_protected, coalesce(z.spans, '') as protected
    from (select doc from src where text is not null) left join (select doc, string_agg(canon, '' order by i) as canonical from segs group by doc) c using (doc)
    left join (select doc, cast(1 + sum(cast(ends as integer)) as integer) as sentences from pieces group by doc) p using (doc)
    left join (select doc, cast(count(*) as integer) as n, count(confusable) as mixed from toks group by doc) t using (doc)
    left join (select doc, count(*) as n, string_agg(zone || ':' || cast(spot + length(lead_of) as integer) || ':' || cast(spot + length(lead_of) + strlen(body) as integer), ',' order by i) as spans
        from (select *, case when sort = 'chunk' then pre else '' end as lead_of, case when sort = 'chunk' then core else seg end as body from segs where zone is not null) group by doc) z using (doc))"""


def repair_cost(word: str, term: str) -> str:
    """The least cost of an optimal string alignment as one number: 10000 an edit, 100 one that no neighbouring key explains, 1 one that is no transposition."""
    touching = []
    for r, row in enumerate(KEYS):
        touching += [a + b for a, b in zip(row, row[1:])]
        if r + 1 < len(KEYS):
            touching += [row[c] + KEYS[r + 1][d] for c in range(len(row)) for d in (c - 1, c) if 0 <= d < len(KEYS[r + 1])]
    pairs = "|" + "|".join(sorted(touching + [p[::-1] for p in touching])) + "|"
    x, y = f"{word}[e[1][1]]", f"{term}[j[1]]"
    options = f"""acc[2][j[1]] + case when {x} = {y} then 0 when contains('{pairs}', '|' || {x} || {y} || '|') then 10001 else 10101 end, acc[2][j[1] + 1] + 10101, r[j[1]] + 10101,
        case when e[1][1] > 1 and j[1] > 1 and {x} <> {y} and {x} = {term}[j[1] - 1] and {word}[e[1][1] - 1] = {y} then acc[1][j[1] - 1] + 10100 else 1000000 end"""
    return f"""list_reduce([[[i]] for i in range(1, length({word}) + 1)], lambda acc, e:
        [acc[2], list_reduce([[j] for j in range(1, length({term}) + 1)], lambda r, j: list_append(r, least({options})), [e[1][1] * 10101])],
        [[0], [j * 10101 for j in range(0, length({term}) + 1)]])[2][length({term}) + 1]"""


def scan(lexicon: Lexicon) -> str:
    """CTEs from toks: hits (doc, pos, width, term, tag, kind, edits, penalty, start, stop) of the greedy scan, and flags."""
    rows = [(i, e.term, e.tag, e.substring, *(e.term.split(" ") + [None, None])[:3], e.term.count(" ") + 1) for i, e in enumerate(lexicon.entries)]
    guards = ", ".join(map(quoted, lexicon.guards)) or "null"
    edits = "case when length(term) <= 4 then 1 else 2 end"
    repairs = f"""
    select word, arg_min(id, cost * 1000 + id) as id, min(cost) // 10000 as edits
    from (select word, id, term, {repair_cost("word", "term")} as cost from (
        select word, id, term from words join terms on width = 1 and abs(length(word) - length(term)) <= {edits} and damerau_levenshtein(regexp_replace(word, '[^\\x00-\\x7f]', '~', 'g'), term) <= {edits}
        where length(word) >= 4 and word not in (select term from terms) and coalesce(word not in ({guards}), true)))
    where cost > 0 and cost // 10000 <= {edits} group by word"""
    if lexicon.penalty is None:
        repairs = "select null as word, null as id, null as edits where false"
    return f"""
terms(id, term, tag, part, w1, w2, w3, width) as {values(rows)},
grams0 as (select *, lead(plain) over w as plain1, lead(plain, 2) over w as plain2, lead(sentence) over w as s1, lead(sentence, 2) over w as s2, lead(word) over w as x1, lead(word, 2) over w as x2, lead(stop) over w as stop1, lead(stop, 2) over w as stop2 from toks window w as (partition by doc order by pos)),
grams as (select *, case when plain1 and s1 = sentence then x1 end as n1, case when plain1 and s1 = sentence and plain2 and s2 = sentence then x2 end as n2 from grams0),
exact as (
    select doc, pos, arg_max(id, width) as id, max(width) as width, 'exact' as kind, 0 as edits from grams join terms on plain and word = w1 and (width = 1 or (width = 2 and n1 = w2) or (width = 3 and n1 = w2 and n2 = w3)) group by doc, pos),
words as (select distinct word from toks where plain),
parts as (select word, arg_min(id, id) as id from (select word, id, rank() over (partition by word order by strlen(term) desc, term) as r from words join terms on part and strlen(word) > strlen(term) and contains(word, term)) where r = 1 group by word),
repairs as ({repairs}),
met as (
    select doc, pos, id, width, kind, edits from exact
    union all select doc, pos, p.id, 1, 'substring', 0 from toks join parts p using (word) where plain and (doc, pos) not in (select (doc, pos) from exact)
    union all select doc, pos, r.id, 1, 'repaired', r.edits from toks join repairs r using (word) where plain and (doc, pos) not in (select (doc, pos) from exact) and word not in (select word from parts)),
kept as (
    select doc, unnest(list_reduce(list([pos, pos + width] order by pos), lambda a, x: case when x[1] >= a[1] then [x[2]] || a[2:] || [x[1]] else a end, [0])[2:]) as pos from met group by doc),
hits as (
    select m.doc, m.pos, width, t.id, t.term, t.tag, m.kind, cast(m.edits as integer) as edits, cast(least(1000, m.edits * {lexicon.penalty or 0}) as integer) as penalty, g.start, case width when 1 then g.stop when 2 then g.stop1 else g.stop2 end as stop
    from met m join kept using (doc, pos) join terms t using (id, width) join grams g using (doc, pos)),
flags as (select doc, pos, term, confusable as kind, start, stop from toks join terms on skeleton = term where free and confusable is not null)"""


def rules(spec: RuleSet, lexicon: bool = False) -> str:
    """CTEs from toks, asked and (with *lexicon*) hits: matches (doc, s, e, rule, class, status, question, penalty, effective, start, stop) and class_scores."""
    rows = []
    for r in spec.rules:
        items = spec.items[r.id]
        first = next(k for k, w in enumerate(items) if w not in SLOTS)
        rows.append((r.id, r.rule_class, r.weight, items, len(items), first, items[first], "negation" in r.requires, "negation" in r.forbids, "question" in r.requires, "question" in r.forbids))
    negators = [(i, n, len(n), n[0]) for i, n in enumerate(spec.negators)] or [(0, [""], 1, "")]
    read = "toks.*, coalesce(h.term, word) as eff, coalesce(h.penalty, 0) as penalty from toks left join (select doc, pos, term, penalty from hits where kind = 'repaired') h using (doc, pos)" if lexicon else "*, word as eff, 0 as penalty from toks"
    return f"""
rules(rule, class, weight, items, n, first, literal, needs_negation, bars_negation, needs_question, bars_question) as {values(rows)},
classes(option, class, scorer) as {values([(i, c.name, c.scorer) for i, c in enumerate(spec.classes)])},
negators(id, items, n, first) as {values(negators)},
view as (select {read}),
tried as (select v.doc, v.pos - first as s, v.sentence, rule, unnest(items) as item, generate_subscripts(items, 1) - 1 as k from view v join rules on v.plain and v.eff = literal),
fits as (
    select t.doc, t.s, t.sentence, t.rule, count(*) as n, sum(v.penalty) as penalty, min(v.start) as start, max(v.stop) as stop from tried t join view v on v.doc = t.doc and v.pos = t.s + t.k and v.free and v.sentence = t.sentence
        and (item = '{{word}}' or (item = '{{gerund}}' and v.plain and length(v.eff) >= 5 and v.eff like '%ing') or (v.plain and v.eff = item)) group by all),
raw as (select f.doc, s, s + r.n as e, f.sentence, rule, class, weight, cast(least(1000, f.penalty) as integer) as penalty, needs_negation, bars_negation, needs_question, bars_question, start, stop from fits f join rules r using (rule) where f.n = r.n),
no_tried as (select v.doc, v.pos as s, v.sentence, id, unnest(items) as item, generate_subscripts(items, 1) - 1 as k from view v join negators on v.free and v.word = negators.first),
no as (select t.doc, t.s, t.s + any_value(g.n) as e, t.sentence from no_tried t join negators g using (id) join view v on v.doc = t.doc and v.pos = t.s + t.k and v.free and v.sentence = t.sentence and v.word = item group by t.doc, t.s, t.sentence, id having count(*) = any_value(g.n)),
ranges as (select distinct doc, s, e from raw),
inside as (select distinct a.doc, a.s, a.e from ranges a join ranges b on a.doc = b.doc and b.s <= a.s and a.e <= b.e and (a.s <> b.s or a.e <> b.e)),
negated as (select distinct r.doc, r.s, r.e from ranges r join raw w using (doc, s, e) join no on no.doc = r.doc and no.sentence = w.sentence and no.s >= r.s - {spec.window} and no.e <= r.s),
judged as (
    select r.*, a.doc is not null as question, case when i.doc is not null then 'suppressed' when g.doc is not null and bars_negation then 'negated'
        when (needs_negation and g.doc is null) or (needs_question and a.doc is null) or (bars_question and a.doc is not null) then 'context_unmet' else 'counted' end as status
    from raw r left join inside i on r.doc = i.doc and r.s = i.s and r.e = i.e left join negated g on r.doc = g.doc and r.s = g.s and r.e = g.e left join asked a on r.doc = a.doc and r.sentence = a.sentence),
matches as (select *, cast(case when status = 'counted' then greatest(0, case when question and not needs_question then weight // 2 else weight end - penalty) else 0 end as integer) as effective from judged),
class_scores as (
    select doc, class, option, cast(case any_value(scorer) when 'max' then max(effective) else least(1000, sum(effective)) end as integer) as c from matches join classes using (class) group by doc, class, option),
all_scores as (select t.doc, c.option, c.class, coalesce(s.c, 0) as c from texts t cross join classes c left join class_scores s on s.doc = t.doc and s.option = c.option)"""

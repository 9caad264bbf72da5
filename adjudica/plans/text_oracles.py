"""DuckDB SQL for the registered queries on texts, put together from text_sql."""

from __future__ import annotations


from ..kernels.decide import REASONS
from ..kernels.text import ALGORITHM_TAG
from . import delivery, oracles, recorded
from .text_sql import SPACE, analysis, quoted, rules, scan, values

#: Fixed value: the data version of the recorded decisions.
RECORDED_VERSION = "3253fa30ea7d20d8d0313503d27f77a521c3236b94c085cc3585317ca408bfbd"

DOCUMENTS, TURNS = "select doc_id as doc, text from documents", "select conv_id * 100 + turn as doc, text from conversations"
DIGEST = "sha256(coalesce(string_agg({row}, chr(10) order by {by}), ''))"


def fingerprint(parts: list[bytes]) -> str:
    """SHA-256 of framed parts, their lengths worked out in SQL."""
    blobs = ", ".join(f"({i}, unhex('{p.hex()}'))" for i, p in enumerate(parts))
    return f"""(select sha256(unhex(string_agg(f, '' order by i))) from (
        select i, string_agg(lpad(hex((octet_length(p) >> (8 * k)) & 255), 2, '0'), '' order by k) || hex(any_value(p)) as f from (values {blobs}) t(i, p) cross join range(8) u(k) group by i))"""


def sql() -> dict[str, str]:
    from .registry import CUES, DECOMPOSED, PARTS, asking_rules, corpus_lexicon, corpus_rules

    messages = f"select conv_id * 100 + turn as doc, ({quoted(CUES)})[cast((conv_id * 3 + turn) % {len(CUES)} + 1 as integer)] || ' ' || coalesce(text, '') as text from conversations"
    delivered = delivery.classifier()
    on_documents, on_messages = analysis(DOCUMENTS), analysis(messages, True)
    summary = "sha256(canonical) as canonical_sha256, n_tokens, sentences, protected from texts"
    token = "pos || ' ' || word || ' ' || start || ' ' || stop || case when zone is null then ' ' || sentence else '' end || ' ' || coalesce(zone, '-') || ' ' || coalesce(confusable, '-') || ' ' || coalesce(skeleton, '-')"
    tokens = f"select doc, count(*) as n, count(zone) as zoned, count(confusable) as confusable, {DIGEST.format(row=token, by='pos')} as tokens_sha256 from toks group by doc"
    hit = "pos || ' ' || pos + width || ' ' || start || ' ' || stop || ' ' || term || ' ' || tag || ' ' || kind || ' ' || edits || ' ' || penalty"
    corpus = f"with {on_documents}, {scan(corpus_lexicon())}"
    parts_only = type(corpus_lexicon())([e for e in corpus_lexicon().entries if e.substring])
    matched = f"with {on_documents}, {rules(corpus_rules())}"
    asking = f"with {on_messages}, {scan(delivered.lexicon)}, {rules(asking_rules(), True)}"
    decided = f"{on_messages}, {scan(delivered.lexicon)}, {rules(delivered.rules, True)}"
    letters = "text"
    for whole, two in DECOMPOSED:
        letters = f"replace({letters}, '{whole}', '{two}')"
    return {
        "canonical_documents": f"with {analysis(DOCUMENTS, True)} select doc as doc_id, {summary}",
        "canonical_messages": f"with {analysis(messages)} select doc as id, {summary}",
        "canonical_decomposed": f"with {analysis(TURNS)}, words as (select doc, string_agg(word, ' ' order by pos) as said from toks group by doc) select cast(doc // 100 as bigint) as conv_id, cast(doc % 100 as bigint) as turn, canonical, sha256({letters.replace('text', 'said')}) as originals_sha256 from texts join words using (doc)",
        "to_original_turns": rf"""
with chars as (select conv_id, turn, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from conversations where length(text) > 60),
placed as (select *, regexp_full_match(c, '[{SPACE}]') as blank, coalesce(sum(strlen(c)) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0) as spot from chars),
runs as (select *, blank and coalesce(lag(blank) over (partition by conv_id, turn order by i), true) as inner_blank from placed),
canon as (select *, case when inner_blank then 0 when blank then 1 else strlen(lower(c)) end as size from runs),
ended as (select *, coalesce(sum(size) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0) as from_byte from canon),
spans as (select *, spot + strlen(c) as stop, from_byte + size as to_byte from ended),
wide as (select conv_id, turn, from_byte, to_byte, spot, coalesce((select min(n.spot) from spans n where n.conv_id = s.conv_id and n.turn = s.turn and n.i > s.i and not n.inner_blank and s.blank), stop) as stop from spans s where size > 0)
select conv_id, turn, cast(min(spot) as integer) as first, cast(max(stop) as integer) as last from wide where from_byte < 40 and to_byte > 10 group by conv_id, turn""",
        "tokens_documents": f"with {analysis(DOCUMENTS, True)} {tokens}",
        "tokens_messages": f"with {on_messages} {tokens}",
        "refused_inputs": "select r_regionkey, cast(16777214 + r_regionkey as integer) as bytes, r_regionkey > 2 as refused, 'abstain' as answer, case when r_regionkey > 2 then 'input_too_long' else 'low_confidence' end as why from region",
        "lexicon_phrases": f"{corpus} select doc, term, kind, count(*) as n, cast(sum(penalty) as bigint) as penalty from hits group by all",
        "lexicon_greedy": f"{corpus} select doc, count(*) as n, {DIGEST.format(row=hit, by='pos')} as hits_sha256 from hits group by doc",
        "lexicon_substrings": f"with {on_documents}, {scan(parts_only)} select doc, term, count(*) as n from hits where kind = 'substring' group by all",
        "lexicon_repairs": f"{corpus} select word, term, cast(edits as integer) as edits from repairs join terms using (id)",
        "lexicon_lookup": f"""with {on_messages}, {scan(delivered.lexicon)},
found as (select doc, string_agg(term || ':' || tag || ':' || kind || ':' || edits || ':' || penalty || ':' || start || ':' || stop, ',' order by pos) as hits from hits group by doc),
flagged as (select doc, string_agg(term || ':' || kind || ':' || start || ':' || stop, ',' order by pos) as flags from flags group by doc)
select doc as id, coalesce(hits, '') as hits, coalesce(flags, '') as flags from texts left join found using (doc) left join flagged using (doc)""",
        "overlap_candidates": f"""with {on_documents}, have as (select distinct doc, word from toks where plain and length(word) >= 3),
{_renamed(analysis("select item_id as doc, text from benchmark"))}, wanted as (select distinct doc as candidate, word from toks_b where free and length(word) >= 3),
sizes as (select candidate, count(*) as n from wanted group by 1),
shared as (select doc, candidate, count(*) as k from have join wanted using (word) group by all)
select doc, candidate, cast(1000 * k // n as integer) as c from shared join sizes using (candidate) where 1000 * k // n >= 550""",
        "overlap_texts": f"""with {analysis(messages)}, have as (select distinct doc, word from toks where plain and length(word) >= 3), wanted as (select distinct doc, word from toks where free and length(word) >= 3),
pairs as (select doc, lead(doc) over (partition by doc // 100 order by doc) as next from texts),
sizes as (select doc, count(*) as n from wanted group by doc)
select p.doc as id, cast(coalesce(1000 * count(h.word) // any_value(n), 0) as integer) as c from pairs p left join sizes s on s.doc = p.next left join wanted w on w.doc = p.next left join have h on h.doc = p.doc and h.word = w.word where p.next is not null group by p.doc""",
        "rule_matches": f"{matched} select doc, rule, status, count(*) as n, cast(sum(effective) as bigint) as effective from matches group by all",
        "rule_class_scores": f"{matched} select doc, class, option, c from class_scores",
        "rule_decisions": f"{matched}, {oracles.gate('all_scores', 'doc', 'deep')}",
        "rule_questions": f'{asking} select doc, cast(row_number() over (partition by doc order by s, rule, e) - 1 as integer) as pos, rule, class, cast(s as integer) as "start", cast(e as integer) as "end", start as first, stop as last, status, question, penalty, effective from matches',
        "rule_question_scores": f"{asking} select doc, string_agg(c, ',' order by option) as scores from all_scores group by doc",
        "classifier_decide": _decision(decided, "standard", "abstain"),
        "classifier_ignore": _decision(decided, "deep", "ignore"),
        "classifier_trails": f"""with {decided}, {_trail("standard", "abstain")} select doc as id, string_agg(lpad(cast(step as varchar), 2, ' ') || ' ' || rpad(stage, 10, ' ') || coalesce(' ' || rule_id, '') || coalesce(' @' || first || '..' || last, '')
    || case when millis <> 0 then ' ' || case when millis > 0 then '+' else '' end || millis else '' end || coalesce(' [' || scorer || ']', '') || ' ' || said || chr(10), '' order by step) as trail from trail group by doc""",
        "classifier_records": f'with {decided}, {_trail("standard", "abstain")} select doc as id, step, stage, rule_id, scorer, first, last, millis, said as "text" from trail',
        "data_versions": _versions(delivered),
        "specification": f"select cast(n as integer) as n, rule, class, pattern, cast(weight as integer) as weight, 'negation' as forbids, cast(1 as integer) as version from {values([(i, *c) for i, c in enumerate(delivery.CUES)])} t(n, rule, class, pattern, weight)",
        "journal_round_trip": """
with damaged as (select case (conv_id * 100 + turn) % 7 when 1 then 'deserialize' when 2 then 'schema_mismatch' when 3 then 'input_hash_mismatch' end as error from conversations)
select error, case when error is null then true end as same, count(*) as n from damaged group by error""",
        "journal_lines": f"""with {decided}, {_trail("standard", "abstain")},
steps as (
    select doc, string_agg('{{"step":' || step || ',"stage":"' || stage || '"' || coalesce(',"rule_id":"' || rule_id || '"', '') || coalesce(',"scorer":"' || scorer || '"', '') || coalesce(',"span":{{"start":' || first || ',"end":' || last || '}}', '') || ',"millis":' || millis || ',"text":' || to_json(said) || '}}', ',' order by step) as steps from trail group by doc),
orders as (select doc, string_agg('[' || option || ',' || c || ']', ',' order by c desc, option) as pairs from given group by doc),
shown as (select doc, case when why is null then '{{"answer":"choice","option":' || option || ',"confidence":' || top || ',"ranked":[' || pairs || ']}}'
    else '{{"answer":"abstain","why":{{"kind":"' || why || '"' || case why when 'low_confidence' then ',"top":' || top || ',"min":750' when 'low_margin' then ',"margin":' || top - second || ',"min":150' else '' end || '}},"ranked":[' || pairs || ']}}' end as answer from gated join orders using (doc))
select doc as id, sha256('{{"schema":1,"input_hash":"","input":{{"message":' || to_json(text) || ',"profile":"standard"}},"decision":{{"answer":' || answer || ',"profile":"standard","data_version":"{RECORDED_VERSION}","trail":[' || steps || ']}}}}') as line_sha256
from shown join steps using (doc) join src using (doc)""",
        "recorded_journal": f"select * from {values(recorded.JOURNAL)} t(message, profile, input_hash, line_sha256)",
        "replay_other_version": f"""with {decided}, flagged as (select distinct doc from flags)
select doc as id, false as same, true as data_version, false as profile, f.doc is not null as answer, f.doc is not null as trail from texts left join flagged f using (doc)""",
    }


def _renamed(ctes: str) -> str:
    """The CTEs of an analysis under other names, for two in one statement."""
    import re

    names = "src|cut|segs0|segs1|segs2|segs3|segs4|segs|pieces0|pieces1|pieces|toks0|toks1|toks|marks|asked|texts"
    return re.sub(rf"\b({names})\b(?! by)", r"\1_b", ctes)


def _gated(profile: str, on_confusable: str) -> str:
    """CTEs given (doc, option, c) and gated (doc, flagged, option, top, second, why)."""
    low, margin = oracles.PROFILE[profile]
    flagged = "doc in (select doc from flags)" if on_confusable == "abstain" else "false"
    return f"""
given as (select doc, option, class, case when {flagged} then 0 else c end as c from all_scores),
placed as (select *, row_number() over (partition by doc order by c desc, option) as r from given),
best as (select doc, max(case when r = 1 then option end) as option, max(case when r = 1 then class end) as label, max(case when r = 1 then c end) as top, max(case when r = 2 then c end) as second, string_agg(option || ':' || c, ',' order by r) as ranked from placed group by doc),
gated as (select *, case when {flagged} then 'confusable' when top < {low} then 'low_confidence' when top - second < {margin} then 'low_margin' end as why from best),
told as (
    select *, case why when 'confusable' then {quoted(REASONS["confusable"])} when 'low_confidence' then 'low confidence ' || top || ' < {low}' when 'low_margin' then 'low margin ' || (top - second) || ' < {margin}' end as reason from gated)"""


def _decision(decided: str, profile: str, on_confusable: str) -> str:
    version = f"'{RECORDED_VERSION}'" if on_confusable == "abstain" else quoted(delivery.classifier(on_confusable, unicode=(17, 0, 0)).data_version)
    return f"""with {decided}, {_trail(profile, on_confusable)}, counted as (select doc, cast(count(*) as integer) as steps from trail group by doc)
select doc as id, case when why is null then 'choice' else 'abstain' end as answer, cast(case when why is null then option end as integer) as option, case when why is null then label end as label, cast(case when why is null then top end as integer) as confidence,
    why, cast(case why when 'low_confidence' then top when 'low_margin' then top - second end as integer) as why_value, reason, ranked, '{profile}' as profile, {version} as data_version, steps from told join counted using (doc)"""


def _trail(profile: str, on_confusable: str) -> str:
    """A CTE trail (doc, step, stage, rule_id, scorer, first, last, millis, said)."""
    none = "cast(null as varchar)"
    stops = "and doc not in (select doc from flags)" if on_confusable == "abstain" else ""
    return f"""{_gated(profile, on_confusable)},
notes as (
    select doc, 0 as part, 0 as a, '' as b, 0 as c, 'normalize' as stage, {none} as rule_id, {none} as scorer, cast(null as integer) as first, cast(null as integer) as last, 0 as millis, 'nfc; ' || n_protected || ' protected; ' || n_tokens || ' tokens; ' || n_confusable || ' confusable' as said from texts
    union all select doc, 1, pos, '', 0, 'lexicon', null, null, start, stop, -penalty, case when kind = 'repaired' then 'repair → ''' || term || ''' (edits ' || edits || ', penalty ' || penalty || ')' else kind || ' ''' || term || '''' end from hits
    union all select doc, 2, pos, '', 0, 'lexicon', null, null, start, stop, 0, 'confusable ' || kind || ' ~ ''' || term || '''' from flags
    union all select doc, 3, s, rule, e, 'rules', rule, scorer, start, stop, effective, status || ' ' || class || case when question then ' (question)' else '' end from matches join classes using (class) where true {stops}
    union all select doc, 4, 0, '', 0, 'decide', null, null, null, null, 0, case when why is null then label || ' confidence ' || top else 'abstain: ' || reason end from told),
trail as (select *, cast(row_number() over (partition by doc order by part, a, b, c) as integer) as step from notes)"""


def _versions(c) -> str:
    """The fingerprints, laid out anew from the specification; the data version as recorded."""
    config = f"{ALGORITHM_TAG};fold=unicode_lower;punct=collapse".encode()
    entries = sorted((t.encode(), tag.encode()) for tag, terms in delivery.TERMS.items() for t in terms)
    lexicon = [b"pua-lexicon-v1", config] + [x for t, tag in entries for x in (t, tag, b"tok")] + [b"guards", *sorted(map(str.encode, delivery.GUARDS)), b"repair=typos;penalty=150"]
    held = [b"pua-rules-v1", config] + [x for name in ("queue", "steer", "interrupt") for x in (name.encode(), b"max")] + [b"negators", *(" ".join(n).encode() for n in sorted(n.split() for n in delivery.NEGATORS)), bytes([3])]
    for rule, name, pattern, weight in sorted(delivery.CUES):
        # no requirement, negation forbidden, version 1
        held += [rule.encode(), name.encode(), *map(str.encode, pattern.split()), weight.to_bytes(2, "little"), bytes([0, 0, 1, 0]), (1).to_bytes(4, "little")]
    profiles = "".join(f"{name}\x1f".encode().hex() + a.to_bytes(2, "little").hex() + b.to_bytes(2, "little").hex() for name, (a, b) in oracles.PROFILE.items())
    return f"""select 'config' as part, sha256({quoted(config.decode())}) as digest union all select 'lexicon', {fingerprint(lexicon)} union all select 'rules', {fingerprint(held)}
union all select 'profiles', sha256(unhex('{profiles}')) union all select 'data_version', '{RECORDED_VERSION}'"""

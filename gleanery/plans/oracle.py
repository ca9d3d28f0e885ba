"""The registered queries again, as DuckDB SQL over the same tables.

Written from the semantics, not from the Spark plans: joins are flattened,
folds are recursive queries, windows replace the two-step forms.
"""

from __future__ import annotations

from gleanery import fixed_values as V

W = V.SPACE
JAN_1 = 1704067200000000
FEB_1 = 1706745600000000


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def blank(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def words(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))"


def tokens(x: str) -> str:
    runs = f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"list_filter({runs}, lambda t: length(t) > 1)"


def prefix(x: str) -> str:
    t = tokens(x)
    return f"case when len({t}) >= 3 then array_to_string(({t})[1:3], ' ') end"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?]){W}+', '\\1\x01', 'g'), '\x01')"
    return f"list_filter(list_transform({cut}, lambda s: {collapse('s')}), lambda s: s <> '')"


def round_to(x: str, places: int) -> str:
    return f"(floor(({x}) * {10**places}.0::double + 0.5::double) / {10**places}.0::double)"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def label(x: str) -> str:
    return f"strftime({x}, '%b %-d, %Y, %-I:%M %p')"


def minutes(base: int, x: str) -> str:
    return f"make_timestamp({base} + ({x}) * 60000000)"


def seconds(base: int, x: str) -> str:
    return f"make_timestamp({base} + ({x}) * 1000000)"


def cut(x: str, limit: int) -> str:
    return (
        f"case when length({x}) <= {limit} then {x} else "
        f"concat(regexp_replace(substring({x}, 1, {limit - 1}), '{W}+$', ''), '…') end"
    )


def labelled(text: str, title: str) -> str:
    return (
        f"(starts_with(lower({text}), lower({title})) and regexp_matches(substring({text}, "
        f"length({title}) + 1), '^{W}*[:\\-–—]{W}+'))"
    )


def echo(text: str, title: str) -> str:
    return f"({title} <> '' and (lower({text}) = lower({title}) or {labelled(text, title)}))"


GREETING = r"(?i)^(hi|hello|hey|good (morning|afternoon|evening)|dear)\b"
PROMOTION = r"(?i)^listen to this update\b"


def dull(text: str) -> str:
    return f"(regexp_matches({text}, '{GREETING}') or regexp_matches({text}, '{PROMOTION}'))"


def entities(x: str) -> str:
    for raw, plain in V.ENTITIES:
        plain = plain.replace("'", "''")
        x = f"regexp_replace({x}, '{raw}', '{plain}', 'gi')"
    return x


def to_text(x: str) -> str:
    block = "(?i)</?(?:p|div|section|article|br|li|ul|ol|h[1-6])\\b[^>]*>"
    body = f"regexp_replace({strip(x)}, '{block}', chr(10), 'g')"
    body = entities(f"regexp_replace({body}, '<[^>]+>', ' ', 'g')")
    body = f"regexp_replace(replace({body}, chr(13), ''), '[ \\t]+', ' ', 'g')"
    lines = f"list_filter(list_transform(string_split({body}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    return f"nullif(array_to_string({lines}, chr(10) || chr(10)), '')"


FEED = "(doc_id % 48 - doc_id % 16)"
TITLE = (
    "case when doc_id % 11 <> 4 then concat(case doc_id % 11 when 0 then 'Benchmark report '"
    " when 1 then 'Product launch ' when 2 then 'How to guide ' when 3 then 'Weekly news roundup '"
    " else '' end, substring(flat, 1, 60)) end"
)

# One flat row per document: item, current enrichment, source and topic title.
FX = f"""
fx0 as (
  select d.*, l.quality, l.toxic, regexp_replace(d.text, '[ \\t\\r\\n]+', ' ', 'g') as flat,
    'Topic ' || (d.doc_id % 96 - d.doc_id % 16) as topic
  from documents d left join labels l on l.doc_id = d.doc_id
),
fx as (
  select doc_id as item_id, doc_id % 16 as audience, lang, text as content_text, flat, topic,
    {TITLE} as title,
    case when doc_id % 3 = 0 then 'https://example.com/a/' || (doc_id % 150) end as canonical_url,
    case when doc_id % 21 = 1 then 'https://Example.com/a/' || (doc_id % 150) end as canonical_url_conflict,
    case when doc_id % 7 = 2 then 'author ' || (doc_id % 5) end as author,
    case when doc_id % 13 <> 5 then {minutes(JAN_1, 'doc_id * 37')} end as published_at,
    {seconds(FEB_1, 'doc_id')} as created_at,
    case when doc_id % 19 = 7 then 'new' else 'processed' end as status,
    case when doc_id % 23 = 4 then doc_id - 1 end as duplicate_of,
    case when doc_id % 17 <> 3 then 'feed ' || {FEED} end as source_name,
    case when doc_id % 17 <> 3 then case lang when 'en' then 'AI' when 'fr' then 'Systems'
      when 'es' then 'Research' end end as source_topic,
    case when doc_id % 29 <> 6 then ((doc_id * 37) % 101) / 100.0::double end as imp,
    ((doc_id * 53) % 101) / 100.0::double as nov,
    case doc_id % 7 when 1 then null when 0 then 'Quick note' else substring(flat, 61, 140) end as summary_short,
    case when doc_id % 4 = 1 then substring(flat, 201, 300) end as summary_long,
    [substring(flat, 1, 40), substring(flat, 41, 40), substring(flat, 81, 40)] as key_points,
    case when doc_id % 10 <> 9 then ['t' || (doc_id % 3), lang] else [] end as tags,
    case doc_id % 5 when 0 then 'research' when 1 then 'tutorial' when 2 then 'news' else 'general' end as label,
    case when doc_id % 5 <> 0 then 'Useful background for the weekly topic review.' end as why,
    case when toxic = 1 then 'discard' when quality = 1 then 'keep' when quality = 0 then 'review' end as advice,
    case doc_id % 9 when 4 then '  Draft about ' || substring(flat, 1, 30) || '  '
      when 5 then '# Own heading' || chr(10) || chr(10) || 'See [the source](https://example.com) for *more*.'
      end as note_draft,
    case when doc_id % 4 <> 0 then topic end as group_title,
    concat('e-', case when doc_id % 17 = 3 then 'manual' else {FEED} || '-' || lang end) as entry_id
  from fx0
)"""

ROUNDUP = "(?i)(roundup|linkdump|daily digest|weekly digest|briefing)"

SCORED = f"""
s1 as (
  select *, {collapse("coalesce(title, '')")} as t, {collapse("coalesce(summary_short, summary_long, '')")} as s,
    {collapse("coalesce(content_text, '')")} as c, {collapse("coalesce(why, '')")} as w from fx
),
s2 as (
  select *, length(c) >= 280 and {words('substring(c, 1, 360)')} >= 40 as body_ok,
    length(s) >= 40 and {words('s')} >= 6 and not {echo('s', 't')} and not {dull('s')} as summary_ok,
    length(w) >= 24 and {words('w')} >= 4 as why_ok,
    greatest(0, least(1, {round_to('coalesce(imp, 0)', 3)})) as importance,
    greatest(0, least(1, {round_to('coalesce(nov, 0)', 3)})) as novelty from s1
),
s3 as (
  select *, case when summary_ok then 0.02::double else 0.0::double end
    + case when why_ok then 0.04::double else 0.0::double end
    + case when group_title is not null then 0.02::double else 0.0::double end
    - case when not summary_ok then 0.04::double else 0.0::double end
    - case when regexp_matches(t, '{ROUNDUP}') then 0.12::double else 0.0::double end
    - case when s <> '' and t <> '' and lower(s) = lower(t) then 0.04::double else 0.0::double end as adj from s2
),
scored as (
  select *, {round_to('adj', 3)} as quality_adjustment,
    {round_to('importance * 0.65::double + novelty * 0.35::double + adj', 3)} as total from s3
),
judged as (
  select *, list_filter([
    case when duplicate_of is not null then 'duplicate_item' end,
    case when advice = 'discard' then 'discarded_by_enrichment' end,
    case when t = '' then 'missing_title' end,
    case when not summary_ok and not body_ok then 'no_meaningful_visible_content' end,
    case when imp is null or nov is null then 'missing_signal_scores' end,
    case when coalesce(imp, 0) < 0.4::double and coalesce(nov, 0) < 0.45::double then 'low_signal_scores' end,
    case when total < 0.62::double then 'below_review_threshold' end,
    case when regexp_matches(t, '{ROUNDUP}') and total < 0.72::double then 'roundup_low_review_value' end
  ], lambda r: r is not null) as filters,
  list_filter([
    case when total >= 0.85::double then 'top_review_value' end,
    case when importance >= 0.7::double then 'high_importance' end,
    case when novelty >= 0.6::double then 'high_novelty' end,
    case when summary_ok then 'meaningful_summary' end,
    case when why_ok then 'why_it_matters_present' end,
    case when group_title is not null then 'topic_grouped' end,
    case when source_name is not null then 'source_attributed' end
  ], lambda r: r is not null) as merits from scored
)"""

RANKED = """
ranked as (
  select * from (
    select *, row_number() over (partition by audience order by
      coalesce(imp, 0) * 0.65::double + coalesce(nov, 0) * 0.35::double desc, published_at desc nulls first,
      created_at desc, item_id) as candidate_rank
    from judged where status = 'processed') where candidate_rank <= 64
)"""


def selection(name: str, budget: int = 8, topic: int = 2, source: int = 3) -> str:
    """Sequential walk over each audience's eligible candidates."""
    return f"""
{name}_queue as (
  select *, {prefix('title')} as head, lower(coalesce(group_title, topic)) as topic_key, lower(source_name) as source_key,
    row_number() over (partition by audience order by total desc,
      coalesce(published_at, make_timestamp(0)) desc, candidate_rank) as pos
  from ranked where len(filters) = 0
),
{name}_walk as (
  select audience, 0::bigint as pos, 0 as n, []::varchar[] as topics, []::varchar[] as sources,
    []::varchar[] as heads, null::bigint as item_id, null::varchar as obstacle, null::int as topic_slot,
    null::int as source_slot from (select distinct audience from {name}_queue)
  union all
  select audience, pos, n + case when obstacle is null then 1 else 0 end,
    case when obstacle is null and topic_key is not null then list_append(topics, topic_key) else topics end,
    case when obstacle is null and source_key is not null then list_append(sources, source_key) else sources end,
    case when obstacle is null and head is not null then list_append(heads, head) else heads end,
    item_id, obstacle,
    case when obstacle is null then tc + 1 end, case when obstacle is null then sc + 1 end
  from (
    select *, case when n >= {budget} then 'selection_budget_reached'
      when coalesce(list_contains(heads, head), false) then 'near_duplicate_title'
      when tc >= {topic} then 'topic_diversity_limit'
      when sc >= {source} then 'source_diversity_limit' end as obstacle
    from (
      select w.n, w.topics, w.sources, w.heads, q.*,
        case when q.topic_key is not null then len(list_filter(w.topics, lambda k: k = q.topic_key)) end as tc,
        case when q.source_key is not null then len(list_filter(w.sources, lambda k: k = q.source_key)) end as sc
      from {name}_walk w join {name}_queue q on q.audience = w.audience and q.pos = w.pos + 1))
),
{name} as (
  select r.*, case when len(r.filters) > 0 then 'hard_filter' when w.obstacle = 'selection_budget_reached' then 'budget'
      when w.obstacle is not null then 'diversity' else 'selected' end as stage,
    len(r.filters) = 0 and w.obstacle is null as selected,
    array_to_string(case when len(r.filters) > 0 then r.filters when w.obstacle is not null then [w.obstacle]
      else list_concat(case when len(r.merits) = 0 then ['ranked_for_relevance'] else r.merits end, list_filter([
        'topic_slot_' || w.topic_slot, 'source_slot_' || w.source_slot, 'selection_rank_' || w.n],
        lambda x: x is not null)) end, '|') as reasons,
    w.topic_slot, w.source_slot, case when len(r.filters) = 0 and w.obstacle is null then w.n end as selection_rank
  from ranked r left join {name}_walk w on w.item_id = r.item_id
)"""


BASE = f"with recursive {FX}, {SCORED}, {RANKED}"
PICKED = f"{BASE}, {selection('picked')}"


def display_summary() -> str:
    def first(value: str) -> str:
        return (
            f"list_filter({sentences(value)}, lambda p: length(p) >= 12 and not {dull('p')} and not {echo('p', 't')})[1]"
        )

    ok = f"({collapse(chr(99) + 'oalesce(summary_short, ' + chr(39) * 2 + ')')})"
    fallback = f"coalesce({first(collapse('coalesce(summary_long, ' + chr(39) * 2 + ')'))}, {first('c')})"
    return f"""
shown as (
  select *, {ok} as stored, {fallback} as fallback from picked where selected
),
shown2 as (
  select *, case when stored <> '' and not {echo('stored', 't')} then stored
    when length(fallback) <= 180 then fallback
    when length(fallback) > 180 then concat(rtrim(case when
      length(regexp_extract(substring(fallback, 1, 181), '^(.*) [^ ]*$', 1)) < 80 then substring(fallback, 1, 180)
      else regexp_extract(substring(fallback, 1, 181), '^(.*) [^ ]*$', 1) end), '…') end as summary from shown
)"""


AI = "(ai|llm|model|agent|openai|anthropic)"
RULES = V.CLASSIFICATION_RULES

SCORE = f"""
points as (
  select *, length({strip('content_text')}) as len,
    lower(concat_ws(' ', coalesce(title, ''), coalesce(content_text, ''))) as hay from fx
),
rules as (
  select item_id, [
    case when regexp_matches(coalesce(title, ''), '[^\\s]') then 'title_present' end,
    case when len >= 280 then 'substantive_content' end,
    case when len >= 1200 then 'long_form' end,
    case when date_diff('microsecond', published_at, timestamp '2024-01-25 00:00:00') <= 7 * 86400000000 then 'recent' end,
    case when source_topic is not null then 'source_topic_present' end,
    case when regexp_matches(hay || ' ' || lower(coalesce(source_topic, '')), '{AI}') then 'high_signal_ai_topic' end,
    case when regexp_matches(hay, '(summary|roundup|linkdump)') then 'aggregated_content_penalty' end
  ] as r from points
),
rule_scores as (
  select item_id, (30 + case when r[1] is null then 0 else 10 end + case when r[2] is null then 0 else 15 end
    + case when r[3] is null then 0 else 10 end + case when r[4] is null then 0 else 10 end
    + case when r[5] is null then 0 else 10 end + case when r[6] is null then 0 else 10 end) / 100.0::double
    as importance_score,
    case when r[7] is null then 75 else 60 end / 100.0::double as novelty_score,
    array_to_string(list_filter(r, lambda x: x is not null), '|') as rationale from rules
)"""


def _classify() -> str:
    def test(rule):
        return f"regexp_matches(hay, '\\b({'|'.join(rule[3])})\\b')"

    number = " ".join(f"when {test(rule)} then {i}" for i, rule in enumerate(RULES))
    pick = lambda f: "case rule " + " ".join(f"when {i} then {f(rule)}" for i, rule in enumerate(RULES)) + " end"
    cut_title = strip(f"regexp_replace(title, '[|:]{W}.+$', '')")
    return f"""
hays as (
  select *, lower(concat_ws(' ', source_topic, case when regexp_matches(title, '[^ ]') then title end, content_text)) as hay
  from fx
),
ruled as (select *, case {number} end as rule, {cut_title} as cut_title from hays),
topical as (
  select *, coalesce({pick(lambda r: repr(r[1]))}, source_topic, nullif(case when length(cut_title) > 80
    then rtrim(substring(cut_title, 1, 80)) else cut_title end, '')) as topic_out from ruled
),
classified as (
  select item_id, created_at, coalesce({pick(lambda r: repr(r[0]))}, case when source_topic is not null
      then 'topic-tracked' else 'general' end) as classification,
    topic_out as topic,
    list_filter(list_concat(coalesce({pick(lambda r: str(list(r[2])))}, []::varchar[]),
      [replace({slug('topic_out')}, '-', '_'), 'lang_' || lang]), lambda x: x is not null) as tag_list
  from topical
)"""


CLASSIFY = _classify()
# First occurrence of each tag, order kept.
TAGS_OUT = "list_filter(tag_list, lambda x, i: list_position(tag_list, x) = i)"

KEYED = f"""
keyed as (
  select *, coalesce('url:' || lower(coalesce({blank('canonical_url')}, {blank('canonical_url_conflict')})),
    'text:' || {slug(collapse(f"coalesce({blank('title')}, {blank('substring(content_text, 1, 120)')}, item_id::varchar)"))})
    as dedupe_key from fx
),
found as (
  select *, count(*) over (partition by dedupe_key) as key_copies,
    first_value(item_id) over (partition by dedupe_key order by created_at, item_id) as first_id from keyed
)"""

TOPIC_TIMES = f"""
times as (
  select item_id, case item_id % 6 when 2 then 'RESEARCH!' when 3 then ' ' else topic end as topic, created_at as at_time
  from fx
  union all
  select item_id, case when item_id % 10 = 1 then ' ' else topic end, created_at + interval 1 day from classified
),
assigned as (
  select item_id, at_time, {blank('topic')} as topic, {slug(blank('topic'))} as tag from times
)"""


def group_id(tag: str) -> str:
    return f"sha256('topic:' || {tag})"


def _notes() -> str:
    nl = "chr(10)"
    first_two = f"array_to_string(({sentences(strip('content_text'))})[1:2], ' ')"
    title = f"coalesce({blank('title')}, {blank('summary_short')}, {blank('topic')}, 'Preserved note')"
    cleaned = f"list_filter(list_transform(raw, lambda v: {collapse('v')}), lambda v: v is not null and v <> '')"
    return f"""
worth as (
  select *, {title} as note_title, {collapse(f"coalesce(nullif({first_two}, ''), content_text)")} as ex0
  from fx where duplicate_of is null and advice = 'keep'
),
worth2 as (select *, {cut('ex0', 320)} as ex from worth),
worth3 as (select *, list_concat(list_concat([summary_short, why], key_points), [ex, topic]) as raw from worth2),
worth4 as (select *, {cleaned} as kept from worth3),
notes as (
  select item_id, sha256('note:' || item_id) as note_id, note_title as title, created_at, published_at, source_name,
    topic, tags,
    case when label in ('research', 'tutorial') then 'summary' else 'reference' end as note_type,
    case when note_draft is not null then
      case when starts_with({strip('note_draft')}, '# ') then {strip('note_draft')}
        else '# ' || note_title || {nl} || {nl} || {strip('note_draft')} end
    else array_to_string(list_filter(list_concat(list_concat([
      '# ' || note_title, '', summary_short, '', case when summary_long <> '' then '## Summary' end, summary_long, '',
      '## Why it matters', '', why, '', '## Key points', ''], list_transform(key_points, lambda p: '- ' || p)), [
      '', '## Preservation context', '', '- Importance score: ' || printf('%.2f', imp),
      '- Novelty score: ' || printf('%.2f', nov), '- Baseline score heuristic: 0.30', '- Deduped as duplicate: no',
      '- Classification: ' || label, '- Topic: ' || topic, '', case when ex is not null then '## Source excerpt' end,
      case when ex is not null then '' end, ex, '', '[Original source](' || canonical_url || ')'
    ]), lambda x: x is not null), {nl}) end as body_md,
    array_to_string(list_filter(kept, lambda v, i: list_position(kept, v) = i)[1:4], '|') as highlights,
    floor((floor(imp * 100 + 0.5) + floor(nov * 100 + 0.5) + 1) / 2) / 100.0::double as review_weight
  from worth4
)"""


NOTES = _notes()
DESTS = """
dests as (
  select 'd' || r_regionkey as destination_id, 'notion' as destination_type, r_name as name,
    'notion://' || lower(replace(r_name, ' ', '-')) as target_ref,
    case when r_regionkey = 1 then 'disabled' else 'active' end as status from region
  union all
  select 'default-obsidian', 'obsidian', 'Obsidian Knowledge', 'obsidian://gleanery/default', 'active'
)"""
SYNCED = f"""
synced as (
  select n.note_id, n.item_id, d.destination_id, d.destination_type, d.target_ref,
    case when d.destination_type = 'notion' then d.target_ref || '/page/' || sl else d.target_ref || '/' || sl || '.md' end
      as external_ref,
    'Prepared ' || case when d.destination_type = 'notion' then 'Notion page' else 'Obsidian note' end
      || ' payload for ' || n.title || '.' as message,
    'success' as status, n.created_at as synced_at
  from (select *, coalesce(nullif({slug('title')}, ''), note_id) as sl from notes) n, dests d where d.status = 'active'
)"""


def preview(x: str) -> str:
    body = f"regexp_replace({x}, '(?m)^# .+\\n+', '')"
    body = f"regexp_replace({body}, '\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1', 'g')"
    return collapse(f"regexp_replace({body}, '[*_`>#-]', ' ', 'g')")


# ------------------------------------------------------------------ pages
ARTICLE = f"""
cleaned as (
  select *, regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<nav\\b[^>]*>.*?</nav\\s*>|<aside\\b[^>]*>.*?</aside\\s*>|<!--.*?-->', ' ', 'g') as clean_html
  from {{table}}
),
regions as (
  select *, coalesce(nullif(regexp_extract(clean_html, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1), ''),
    nullif(regexp_extract(clean_html, '(?is)<main\\b[^>]*>(.*)</main\\s*>', 1), ''),
    nullif(regexp_extract(clean_html, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1), ''),
    regexp_replace(clean_html, '(?is)<head\\b.*?</head\\s*>', ' ', 'g')) as content_html from cleaned
),
articles as (
  select *, {collapse(to_text('content_html'))} as content_text,
    nullif({collapse(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))}, '') as title,
    nullif({collapse(entities("regexp_extract(html, '(?is)<html[^>]* lang=.([a-zA-Z-]+)', 1)"))}, '') as language,
    nullif({collapse(entities("regexp_replace(regexp_extract(content_html, '(?is)<p>(.*?)</p>', 1), '<[^>]+>', ' ', 'g')"))}, '') as excerpt
  from regions
)"""

FETCH = f"""
log as (
  select page_id, url as submitted_url, case when page_id % 11 = 6 then url || '/moved' else url end as final_url,
    case page_id % 11 when 1 then null when 2 then 302 when 3 then 301 when 4 then 404 when 5 then 500 else 200 end as st,
    case page_id % 11 when 1 then null when 5 then 'application/json' when 7 then 'application/pdf' when 8 then null
      when 9 then 'application/xhtml+xml' else 'text/html; charset=utf-8' end as ct,
    case page_id % 11 when 1 then null when 10 then '<html><body><script>1</script></body></html>' else html end as html,
    {iso(seconds(FEB_1, 'page_id'))} as fetched
  from pages
),
coded as (
  select *, case page_id % 11 when 1 then 'network_error' when 2 then 'invalid_redirect'
    when 3 then 'redirect_limit_exceeded' when 4 then 'response_error' when 5 then 'response_error'
    when 7 then 'non_html_response' when 8 then 'non_html_response' when 10 then 'extract_failed' end as code from log
),
fetched as (
  select *, case when code is null then 'succeeded' else 'failed' end as outcome,
    case when code = 'extract_failed' or page_id % 11 = 4 then html end as failed_body,
    case code when 'network_error' then 'URL fetch failed for ' || submitted_url || '.'
      when 'invalid_redirect' then 'URL redirect response from ' || final_url || ' did not include a location header.'
      when 'redirect_limit_exceeded' then 'URL fetch exceeded 5 redirects.'
      when 'response_error' then 'URL fetch failed for ' || submitted_url || ' with status ' || st || '.'
      when 'non_html_response' then 'URL ingest expected HTML but received ' || coalesce(ct, 'an unknown content type') || '.'
      when 'extract_failed' then 'URL ingest could not extract article-like content.' end as message from coded
)"""

ASSETS = f"""
assets as (
  select 'p-' || page_id as item_id, page_id, 'e-' || (page_id % 23) as capture_entry_id,
    case when page_id % 29 <> 8 then regexp_extract(url, '^https?://[^/]+', 0) end as url,
    case page_id % 31 when 3 then null when 4 then '  ' when 5 then 'plain ' || page_id else html end as raw,
    page_id % 17 = 5 as failed, {seconds(FEB_1, 'page_id * 7 % 101')} as created_at
  from pages
)"""

# ------------------------------------------------------------------ capture
ENTRIES = f"""
n0 as (select doc_id, ((doc_id % 1024 - doc_id % 16) // 16) as s, doc_id - doc_id % 1024 as batch_id from documents),
ent as (
  select doc_id as row_id, doc_id % 16 as source_id, batch_id, doc_id as pos, s % 5 = 0 and s < 32 as stored,
    case when doc_id % 10 <> 9 then 'g' || ((s * s) % 41) || '-' || batch_id end as external_id,
    case when doc_id % 14 <> 13 then 'https://example.com/p/' || ((s * 11 + s * s * 3) % 47) || '-' || batch_id end as url,
    case when doc_id % 7 <> 3 and doc_id % 16 <> 5
      then {minutes(JAN_1, '(doc_id % 5) * 1440 + (batch_id // 1024) * 60')} end as published_at
  from n0
)"""
CAPTURE = f"""with recursive {ENTRIES},
fresh as (
  select e.*, exists (select 1 from ent s where s.stored and s.source_id = e.source_id and s.external_id = e.external_id)
    or exists (select 1 from ent s where s.stored and s.source_id = e.source_id and s.url = e.url) as known
  from ent e where not e.stored
),
line as (
  select *, row_number() over (partition by source_id, batch_id order by pos) as k from fresh where not known
),
walk as (
  select source_id, batch_id, 0::bigint as k, []::varchar[] as seen, null::bigint as row_id, false as kept
  from (select distinct source_id, batch_id from line)
  union all
  select source_id, batch_id, k, case when hit then seen else list_concat(seen, keys) end, row_id, not hit from (
    select l.source_id, l.batch_id, l.k, w.seen, l.row_id, l.keys, list_has_any(w.seen, l.keys) as hit from walk w
    join (select *, list_filter(['e:' || external_id, 'u:' || url], lambda x: x is not null) as keys from line) l
      on l.source_id = w.source_id and l.batch_id = w.batch_id and l.k = w.k + 1)
),
decided as (
  select f.row_id, f.source_id, f.batch_id,
    case when f.known then 'known' when w.kept then 'kept' else 'batch_duplicate' end as decision
  from fresh f left join walk w on w.row_id = f.row_id
)"""
MEMBERS = f"""with {ENTRIES},
live as (
  select *, max(published_at) over (partition by source_id, batch_id) as latest,
    min(pos) over (partition by source_id, batch_id) as head from ent
),
at_latest as (select * from live where published_at = latest or (latest is null and pos = head)),
members as (
  select source_id, batch_id, kind, value, min(pos) as first_pos, any_value(latest) as latest from (
    select source_id, batch_id, pos, latest, 'externalId' as kind, external_id as value from at_latest
    union all select source_id, batch_id, pos, latest, 'url', url from at_latest)
  where value is not null group by all
)"""

OUTCOMES = f"""
log as (
  select user_id % 20 as source_id, ts as at_time, event_id as seq, event_type <> 'error' as ok,
    case when event_type = 'error' then 'fetch failed ' || event_id || ' ' || repeat('x', event_id % 600) end as message
  from events
),
state as (
  select source_id, max(at_time) as synced, max(at_time) filter (ok) as success,
    arg_max(ok, (at_time, seq)) as last_ok, arg_max(coalesce(message, ''), (at_time, seq)) as last_message
  from log group by source_id
),
states as (
  select source_id, synced, success, case when not last_ok then synced end as error_at,
    case when not last_ok then case when length(last_message) <= 500 then last_message
      else substring(last_message, 1, 497) || '...' end end as error_message,
    case when last_ok then 'active' else 'error' end as source_status from state
),
srcs as (
  select user_id % 26 as source_id, min(ts) as created_at, max(ts) as updated_at from events group by 1
)"""

REGISTER = f"""
req as (
  select page_id as request_id, page_id % 13 = 5 as unnamed, page_id % 10 as kind,
    lower(regexp_extract(url, '^https?://[^/]+', 0)) as host,
    case when page_id % 4 <> 0 then 'Topic' end as topic, {seconds(FEB_1, 'page_id * 7 % 101')} as at_time from pages
),
req2 as (
  select *, case when kind in (2, 3, 7) then null when kind = 1 and starts_with(host, 'http://') then host || ':443/'
      else host || '/' end as ref,
    case when kind = 3 then 'RSS URLs must use http or https.' when kind in (2, 7) then 'Enter a valid RSS URL.'
      when unnamed then 'Source name is required.' end as problem from req
),
req3 as (
  select *, case when problem is null then row_number() over (partition by ref, problem is null order by at_time, request_id) end
    as turn from req2
),
req4 as (
  select *, coalesce(problem, case when turn > 1 or ref in (select ref from req2 where kind = 5)
    then 'That RSS source is already registered.' end) as rejection from req3
)"""

COMMANDS = """
cmd as (
  select event_id as command_id, case when user_id % 50 = 7 then null else 'src-' || user_id end as source_id, ts as at_time,
    case event_type when 'signup' then 'register' when 'error' then 'delete' when 'click' then 'reactivate' else 'pause' end
      as action from events
),
cmd2 as (
  select *, last_value(case action when 'register' then true when 'delete' then false end ignore nulls)
    over (partition by source_id order by at_time, command_id rows between unbounded preceding and 1 preceding) as before from cmd
),
checked as (
  select *, case when source_id is null then 'Source id is required.'
    when action = 'register' and before then 'That RSS source is already registered.'
    when action <> 'register' and not coalesce(before, false) then 'Source not found.' end as rejection from cmd2
)"""


def _rss() -> str:
    shared = "doc_id as payload_id, doc_id % 16 as source_id"
    feed = (
        "'Feed ' || (doc_id % 16) as feed_title, 'https://example.com/' as feed_site_url, lang as feed_language,"
        " null::varchar as feed_description"
    )
    when = "case when doc_id % 6 <> 2 then '2026-04-' || lpad((1 + doc_id % 28)::varchar, 2, '0') || 'T10:30:00.000Z' end"
    return f"""with {FX}
select {shared}, 0 as pos, case when doc_id % 4 = 1 then 'https://example.com/r/' || doc_id else 'g' || doc_id end
    as external_id, {blank('substring(flat, 1, 50)')} as title,
  case doc_id % 3 when 0 then 'Ann' when 1 then 'Bob' end as author, 'https://example.com/r/' || doc_id as url,
  {when} as published_at, case when doc_id % 7 = 0 then 'full text' else '<p>' || text || '</p>' end as raw_content, {feed}
from fx0
union all
select {shared}, 1, 'i' || doc_id, null, null, null, '2026-04-14T03:00:00.000Z', {blank('text')}, {feed}
from fx0 where doc_id % 5 <> 0"""


ATOM = f"""with {FX}
select doc_id as payload_id, doc_id % 16 as source_id, 0 as pos,
  case when doc_id % 4 = 1 then case when doc_id % 3 <> 2 then 'https://example.com/t/' || doc_id end
    else 'urn:' || doc_id end as external_id,
  {blank('substring(flat, 1, 50)')} as title, case when doc_id % 2 = 0 then 'Eve' end as author,
  case when doc_id % 3 <> 2 then 'https://example.com/t/' || doc_id end as url,
  case when doc_id % 5 = 0 then '2026-04-14T03:00:00.000Z' else '2026-04-12T08:30:00.000Z' end as published_at,
  {blank('text')} as raw_content, 'Atom ' || (doc_id % 16) as feed_title, 'https://example.com/home' as feed_site_url,
  lang as feed_language, 'Sub' as feed_description from fx0"""

DISPATCH = """
select doc_id as payload_id, case doc_id % 6 when 0 then 'rss' when 1 then 'atom' end as feed_kind,
  case doc_id % 6 when 0 then 'g' || doc_id when 1 then 'e' || doc_id end as external_id,
  case doc_id % 6 when 2 then 'Unsupported RSS document shape' when 3 then 'RSS parsing failed'
    when 4 then 'RSS channel is missing' when 5 then 'RSS parsing returned no document' end
    || ' for source ' || (doc_id % 16) || '.' as error from documents"""


def _validate() -> str:
    clean = lambda x: f"replace(replace(replace({x}, '\\', ' '), '\"', ' '), chr(10), ' ')"
    return f"""with {FX},
outs as (
  select item_id, item_id % 23 as f, {blank(clean('substring(flat, 61, 140)'))} as short,
    {blank(clean("coalesce(title, 'x')"))} as said, {collapse("coalesce(title, '')")} as t, title,
    case when item_id % 46 <> 30 then true else false end as drafted from fx
),
errs as (
  select *, case
    when f in (0, 22) then 'Knowledge enrichment output must be an object.'
    when f = 1 then 'summary must be an object.'
    when f = 5 then 'classification must be an object.'
    when f = 19 then 'preserve_recommendation must be one of discard, keep, or review.'
    when f = 6 then 'classification.label must be a string.'
    when f = 7 then 'classification.topic must be a string.'
    when f in (15, 16) then 'importance_score must be a number between 0 and 1.'
    when f = 8 then 'key_points must contain at least 3 entries.'
    when f = 9 then 'key_points must contain at most 5 entries.'
    when f = 10 then 'key_points[2] must be a string.'
    when f = 11 then 'key_points[1] must not be empty.'
    when f = 12 then 'key_points must be an array of strings.'
    when not drafted then 'note_draft must be a string.'
    when f = 17 then 'novelty_score must be a number between 0 and 1.'
    when f = 4 then 'summary.long must be a string.'
    when f = 2 then 'summary.short must be a string.'
    when f = 3 or (f not in (20, 21) and short is null) then 'summary.short must not be empty.'
    when f = 13 then 'tags must contain at least 1 entries.'
    when f = 14 then 'tags[0] must be a string.'
    when f = 18 then 'why_it_matters must be a string.'
    when f = 20 and t <> '' and lower({collapse('said')}) = lower(t) then 'summary.short must not repeat the item title verbatim.'
    when f = 21 and t <> '' and starts_with(lower({collapse('said')}), lower(t))
      then 'summary.short must not repeat the item title as a prefixed label.'
    when f not in (20, 21) and {echo(collapse('short'), 't')} and lower({collapse('short')}) = lower(t)
      then 'summary.short must not repeat the item title verbatim.'
    when f not in (20, 21) and {echo(collapse('short'), 't')} then 'summary.short must not repeat the item title as a prefixed label.'
    end as error from outs
)
select item_id, error, case when error is null then case f when 20 then said when 21 then lower(said) || ' - more' else short end end
    as summary_short,
  case when error is null and f not in (20, 21) and item_id % 2 = 1 then 'Long.' end as summary_long,
  case when error is null then 'research' end as classification, case when error is null then 'AI' end as topic,
  case when error is null then {round_to('(item_id % 101) / 100.0::double', 2)} end as importance_score,
  case when error is null then 0.46::double end as novelty_score, case when error is null then 'a|b|c' end as key_points
from errs"""


VERSIONS = f"""
versions as (
  select item_id, v as version_id, {seconds(FEB_1, 'item_id + v * 86400')} as created_at,
    case when v = 0 then 0.5::double else imp end as importance_score
  from (select *, unnest(case when item_id % 6 = 2 then [0, 1] else [1] end) as v from fx)
)"""


def history(table: str) -> str:
    nxt = "lead(created_at) over (partition by item_id order by created_at, version_id)"
    return (
        f"select item_id, version_id, importance_score, {iso('created_at')} as created_at, {iso(nxt)} as superseded_at,"
        f" {nxt} is null as is_current from {table}"
    )


def _integrity() -> str:
    return f"""with {FX}, its as (select item_id, case when item_id % 50 = 7 then 'a-7' else 'a-' || item_id end as raw_asset_id, canonical_url
  from fx where item_id % 31 <> 5)
select 'unique items(raw_asset_id)' as check_name, raw_asset_id as key_text, count(*) as row_count from its group by all having count(*) > 1
union all select 'unique items(canonical_url)', canonical_url, count(*) from its where canonical_url is not null group by all having count(*) > 1
union all select 'reference enrichments.item_id', item_id::varchar, case when item_id % 6 = 2 then 2 else 1 end from fx where item_id % 31 = 5
union all select 'reference item_group_members.item_id', item_id::varchar, case when item_id % 8 = 0 then 2 else 1 end
  from fx where item_id % 31 = 5 and item_id % 8 <> 4"""


SQL: dict[str, str] = {
    "inbox_candidates": f"""{BASE} select audience, item_id, candidate_rank, title, canonical_url, source_name, source_topic,
  topic, group_title as topic_group_title, imp as importance_score, nov as novelty_score, advice as preserve_recommendation,
  array_to_string(tags, '|') as tags, {iso('published_at')} as published_at from ranked""",
    "content_quality": f"""with {FX}, {SCORED} select item_id, body_ok as body_meaningful, summary_ok as summary_meaningful,
  why_ok as why_meaningful from judged""",
    "inbox_scores": f"""with {FX}, {SCORED} select item_id, importance, novelty, quality_adjustment, total as total_score
  from judged""",
    "inbox_hard_filters": f"""with {FX}, {SCORED} select item_id, total as total_score,
  array_to_string(filters, '|') as reasons from judged""",
    "inbox_select": f"""{PICKED} select audience, item_id, candidate_rank, stage, selected, total as relevance_score, reasons,
  topic_slot, source_slot, selection_rank, 'v2' as policy_version, quality_adjustment, body_ok as visible_body,
  summary_ok as visible_summary, source_name from picked""",
    "selection_summary": f"""{PICKED} select audience, 'v2' as policy_version, count(*) as candidate_count,
  count(*) filter (selected) as selected_count from picked group by audience""",
    "selection_history": f"""{PICKED}, {selection('strict', 4, 1, 3)}
select 1 as run_id, audience, item_id, 'v1' as policy_version, selected, false as is_current from strict
union all select 2, audience, item_id, 'v2', selected, true from picked""",
    "inbox_view": f"""{PICKED}, {display_summary()}
select audience, item_id, coalesce({blank('title')}, 'Untitled item') as title, canonical_url as url, source_name, source_topic,
  case when source_name is not null then 'RSS' end as source_type_label, summary as summary_short,
  {label('published_at')} as published_at_label,
  case when source_name is not null then 'F' || substring(string_split(source_name, ' ')[2], 1, 1)
    else 'T' || substring(string_split(topic, ' ')[2], 1, 1) end as preview_label,
  label as classification, topic, group_title as topic_group_title, array_to_string(tags, '|') as tags,
  total as relevance_score, total as total_score, reasons, 'v2' as policy_version from shown2""",
    "inbox_counters": f"""{PICKED} select count(*) as visible, count(duplicate_of) as duplicates, count(group_title) as grouped,
  count(distinct topic) as topics from picked where selected""",
    "near_duplicate_titles": f"""with {FX}, t as (select item_id, created_at, {prefix('title')} as title_key from fx),
r as (select *, count(*) over (partition by title_key) as copies,
  first_value(item_id) over (partition by title_key order by created_at, item_id) as first_item_id from t where title_key is not null)
select item_id, title_key, first_item_id, copies from r where item_id <> first_item_id""",
    "html_to_text": f"select page_id, {to_text('html')} as content_text from pages",
    "page_article_extract": f"""with {ARTICLE.replace('{table}', 'pages')} select page_id, title, null::varchar as author, language,
  excerpt, null::varchar as site_name, null::varchar as published_at, length(content_html) as html_length, content_text,
  content_text <> '' as has_content from articles""",
    "fetch_outcomes": f"""with {FETCH} select page_id, outcome, code, message, length(failed_body) as failed_body_length,
  ct as content_type, coalesce(st, 0) as http_status, outcome as extraction_status, fetched as fetch_timestamp from fetched""",
    "page_assets": f"""with {FETCH}, {ARTICLE.replace('{table}', 'fetched')} select final_url as url,
  case when outcome = 'succeeded' then 'article' else 'url' end as asset_type,
  case when outcome = 'succeeded' then 'new' else 'failed' end as status,
  case when outcome = 'succeeded' then title end as title,
  length(case when outcome = 'succeeded' then content_html else failed_body end) as content_length,
  submitted_url, coalesce(st, 0)::varchar as http_status,
  case when outcome = 'succeeded' then length(content_text)::varchar end as text_length,
  case when outcome = 'failed' then message end as failure_message,
  case when outcome = 'succeeded' then language end as language
from articles where outcome = 'succeeded' or failed_body is not null""",
    "url_normalize": r"""select page_id, concat(lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)),
  case when regexp_matches(url, '^https?://[^/?#]+/') then '' else '/' end,
  regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)) as normalized, null::varchar as problem from pages""",
    "normalize_items": f"""with {ASSETS} select item_id, 'Page ' || page_id as title, url as canonical_url,
  case when page_id % 4 = 0 then 'fr' else 'en' end as language, {to_text('raw')} as content_text, 'new' as status,
  'rss' as connector_type, case when page_id % 2 = 0 then 'x' || page_id end as external_id,
  coalesce(length({to_text('raw')}), 0) as content_length,
  case when raw <> '' then 'raw_content' else 'metadata_only' end as content_source,
  case when regexp_matches(raw, '<[^>]+>') then 'html' else 'text' end as text_format,
  case when page_id % 3 <> 0 then 200.0::double end as http_status, 'Feed ' || (page_id % 5) as feed_title,
  null::varchar as feed_url from assets where not failed and page_id % 10 <> 7""",
    "canonical_conflicts": f"""with {ASSETS}, n as (select *, row_number() over (partition by url order by created_at, item_id) as k,
  url in (select url from assets where page_id % 9 = 0 and url is not null) as taken from assets where page_id % 9 <> 0)
select item_id, case when k = 1 and not taken then url end as canonical_url,
  case when k > 1 or taken then url end as canonical_url_conflict from n""",
    "entry_completion": f"""with {ASSETS} select capture_entry_id, count(*) as asset_count,
  count(*) filter (not failed and raw is not null) as normalized_count,
  count(*) filter (failed or raw is null) as failed_count,
  min(case when raw is null then 'no content in ' || item_id end) as failure_message,
  case when bool_and(not failed and raw is not null) then 'normalized' else 'failed' end as entry_status,
  case when bool_and(not failed and raw is not null) then 'completed' else 'failed' end as phase
from assets group by capture_entry_id""",
    "item_failures": f"""with {FX} select item_id, status, case when status = 'new' then 'failed' end as processing_status,
  case when status = 'new' then 'failed on ' || item_id end as last_error,
  case when status = 'new' then {iso('created_at')} end as failed_at from fx""",
    "item_context": f"""with {FX} select item_id, entry_id as capture_entry_id, '  ' || source_name || ' ' as source_name,
  source_topic, case when source_name is not null then 'rss' end as source_type from fx""",
    "pending_items": f"""with {FX} select item_id, status from fx where status = 'new' or item_id % 31 = 9
  or item_id in (select doc_id from labels where toxic = 1)""",
    "score_items": f"with {FX}, {SCORE} select * from rule_scores",
    "dedupe_items": f"""with {FX}, {KEYED} select item_id, case when item_id <> first_id then 0.0::double else nov end as novelty_score,
  case when item_id <> first_id then 'discard' else advice end as preserve_recommendation, dedupe_key, key_copies,
  case when item_id <> first_id then first_id end as duplicate_of_item_id from found""",
    "dedupe_matches": f"""with {FX}, {KEYED} select dedupe_key, item_id, {iso('created_at')} as created_at
  from found where key_copies > 1""",
    "classify_items": f"""with {FX}, {CLASSIFY} select item_id, classification, topic, array_to_string({TAGS_OUT}, '|') as tags
  from classified""",
    "topic_groups": f"""with {FX}, {CLASSIFY}, {TOPIC_TIMES}, g as (select tag, arg_max(topic, (at_time, item_id)) as title,
  min(at_time) as c, max(at_time) as u from assigned where topic is not null group by tag)
select tag, title, 'Items related to ' || title || '.' as summary, {iso('c')} as created_at, {iso('u')} as updated_at from g""",
    "topic_members": f"""with {FX}, {CLASSIFY}, {TOPIC_TIMES}, m as (select *, row_number() over (partition by item_id order by at_time desc)
  as k from assigned) select item_id, tag from m where k = 1 and topic is not null""",
    "group_batches": f"""with {FX}, {CLASSIFY}, {TOPIC_TIMES}, g as (select tag, arg_max(topic, (at_time, item_id)) as title,
  min(at_time) as c, max(at_time) as u from assigned where topic is not null group by tag)
select tag, title, 'Items related to ' || title || '.' as summary, {iso('c')} as created_at, {iso('u')} as updated_at from g""",
    "member_batches": f"""with {FX}, {CLASSIFY}, {TOPIC_TIMES}, m as (select *, row_number() over (partition by item_id order by at_time desc)
  as k from assigned) select item_id, tag from m where k = 1 and topic is not null""",
    "dedupe_batches": f"""with {FX}, {KEYED}, firsts as (
  select dedupe_key, m, arg_min(item_id, (created_at, item_id)) as first_id
  from keyed join (values (0), (1), (2)) t(m) on item_id % 3 <= m group by all)
select item_id, k.dedupe_key, case when first_id <> item_id then first_id end as duplicate_of_item_id
from keyed k join firsts f on f.dedupe_key = k.dedupe_key and f.m = k.item_id % 3""",
    "capture_batches": f"""with recursive {ENTRIES},
line as (
  select *, (row_id // 16) % 3 as batch, row_number() over (partition by source_id order by (row_id // 16) % 3, pos) as k,
    list_filter(['e:' || external_id, 'u:' || url], lambda x: x is not null) as keys from ent
),
walk as (
  select source_id, 0::bigint as k, []::varchar[] as seen, null::bigint as row_id, false as kept from (select distinct source_id from line)
  union all
  select source_id, k, case when hit then seen else list_concat(seen, keys) end, row_id, not hit from (
    select l.source_id, l.k, w.seen, l.row_id, l.keys, list_has_any(w.seen, l.keys) as hit from walk w
    join line l on l.source_id = w.source_id and l.k = w.k + 1)
),
kept as (select l.* from line l join walk w on w.row_id = l.row_id where w.kept)
select l.row_id, l.source_id, l.batch as batch_id,
  case when k.row_id is not null then 'kept'
    when exists (select 1 from kept o where o.source_id = l.source_id and o.batch < l.batch and o.external_id = l.external_id)
      or exists (select 1 from kept o where o.source_id = l.source_id and o.batch < l.batch and o.url = l.url) then 'known'
    else 'batch_duplicate' end as decision
from line l left join kept k on k.row_id = l.row_id""",
    "nested_flags": """select doc_id as item_id, case doc_id % 7 when 0 then 'item-' || doc_id when 4 then ' ' end as duplicate_of_item_id
  from documents""",
    "curation_integrity": _integrity(),
    "curation_integrity_delta": _integrity(),
    "run_counters": f"""{CAPTURE}, checked as ({_validate()})
select source_id, batch_id, count(*) as persisted_count, count(*) filter (row_id % 11 <> 4) as normalized_count,
  count(*) filter (error is null) as processed_count, count(*) filter (error is not null) as quarantined_count
from decided join checked on item_id = row_id where decision = 'kept' group by all""",
    "membership_replace": f"""with {FX}, {CLASSIFY}, {TOPIC_TIMES}, m as (select *, row_number() over (partition by item_id
  order by at_time desc) as k from assigned where item_id in (select doc_id from labels)),
old as (select item_id, unnest(case when item_id % 8 = 0 then [topic, 'Second topic'] when item_id % 8 = 4 then []
  else [topic] end) as title from fx where item_id not in (select doc_id from labels))
select item_id, {group_id('tag')} as group_id from m where k = 1 and topic is not null
union all select item_id, {group_id(slug('title'))} from old""",
    "topic_titles": f"""with {FX} select item_id, case when item_id % 8 <> 0 then topic end as topic_group_title
  from fx where item_id % 8 <> 4""",
    "published_dates": """select page_id, case when page_id % 9 = 7 then null
  when page_id % 2 = 0 and page_id % 9 >= 4 then '2020-01-01T00:00:00.000Z' when page_id % 9 = 8 then null
  else '2024-01-0' || (page_id % 9 + 1) || 'T03:00:00.000Z' end as published_at from pages""",
    "notes_build": f"""with {FX}, {NOTES} select item_id, title, note_type, body_md, highlights,
  array_to_string(tags, '|') as tags, review_weight from notes""",
    "note_sync": f"""with {FX}, {NOTES}, {DESTS}, {SYNCED} select note_id, item_id, destination_id, destination_type,
  external_ref, message, status, {iso('synced_at')} as synced_at from synced""",
    "note_sync_rollup": f"""with {FX}, {NOTES}, {DESTS}, {SYNCED} select item_id, count(*)::int as synced_destination_count,
  max(destination_id) filter (destination_type = 'notion') as notion_destination,
  max(external_ref) filter (destination_type = 'obsidian') as obsidian_ref,
  {iso('max(synced_at)')} as last_succeeded_at from synced group by item_id""",
    "destination_status": f"""with {FX}, {NOTES}, {DESTS}, {SYNCED}, k as (select *, row_number() over (partition by note_id,
  destination_type order by destination_id desc) as k from synced)
select note_id, item_id, destination_type, external_ref, message, status, {iso('synced_at')} as synced_at from k where k = 1""",
    "destination_list": f"with {DESTS} select destination_id, name, status, target_ref, destination_type from dests",
    "knowledge_view": f"""with {FX}, {NOTES}, p as (select *, {preview('body_md')} as pv from notes)
select item_id, title, case when note_type = 'summary' then 'Summary note' else 'Reference note' end as type_label,
  {cut('pv', 220)} as body_preview, coalesce(printf('%.2f', review_weight), 'n/a') as review_weight_label,
  {label('published_at')} as published_at_label, source_name, topic, array_to_string(tags, '|') as tags,
  2 as destination_count from p""",
    "markdown_preview": f"""with p as (select doc_id, {preview("'# ' || substring(text, 1, 20) || chr(10) || chr(10) || '[x](y) *' || text || '*'")}
  as pv from documents) select doc_id, {cut('pv', 220)} as preview from p""",
    "feed_rss_assets": _rss(),
    "feed_atom_assets": ATOM,
    "feed_dispatch": DISPATCH,
    "capture_dedupe": f"{CAPTURE} select row_id, source_id, batch_id, decision from decided",
    "capture_dedupe_rounds": f"{CAPTURE} select row_id, source_id, batch_id, decision from decided",
    "capture_dedupe_chain": """with ent as (select event_id as row_id, event_id // 2500 as source_id, 1::bigint as batch_id,
    'c' || ((event_id + 1) // 2) as external_id, case when event_id % 97 <> 50 then 'd' || (event_id // 2) end as url from events),
known as (select e.*, exists (select 1 from ent s where s.row_id % 2500 = 1200 and s.source_id = e.source_id
    and s.external_id = e.external_id) as known from ent e),
linked as (select *, not known and not coalesce(lag(known) over w, true)
    and coalesce(external_id = lag(external_id) over w or url = lag(url) over w, false) as linked
  from known window w as (partition by source_id order by row_id)),
runs as (select *, sum(case when linked then 0 else 1 end) over (partition by source_id order by row_id) as run from linked),
placed as (select *, row_number() over (partition by source_id, run order by row_id) as place from runs)
select row_id, source_id, batch_id, case when known then 'known' when place % 2 = 1 then 'kept' else 'batch_duplicate' end as decision
from placed""",
    "capture_runs": f"""{CAPTURE}, c as (select source_id, batch_id, count(*) as fetched_count,
  count(*) filter (decision = 'kept') as persisted_count, count(*) filter (decision <> 'kept') as skipped_count
  from decided group by all)
select *, 'completed' as phase, case when persisted_count = 0 then 'normalized' else 'captured' end as entry_status,
  case when persisted_count = 0 then 'skipped' end as normalization_phase,
  case when persisted_count = 0 then 'no_new_raw_assets' end as normalization_reason from c""",
    "sync_cursor": f"""{MEMBERS}, b as (select source_id, batch_id, max(published_at) as latest from live group by all),
j as (select b.source_id, b.batch_id, b.latest, count(m.value) as member_count,
  coalesce(list(m.value order by m.first_pos) filter (m.kind = 'externalId'), []) as ids,
  coalesce(list(m.value order by m.first_pos) filter (m.kind = 'url'), []) as urls
  from b left join members m on m.source_id = b.source_id and m.batch_id = b.batch_id group by all)
select source_id, batch_id, {iso('latest')} as latest_published_at, member_count,
  to_json({{'latestExternalIds': ids, 'latestPublishedAt': {iso('latest')}, 'latestUrls': urls}})::varchar as cursor from j""",
    "sync_cursor_members": f"""{MEMBERS} select source_id, batch_id, kind, value, first_pos, {iso('latest')} as latest_published_at
  from members""",
    "identity_keys": f"""with {ENTRIES} select distinct source_id, 'externalId' as kind, external_id as value from ent
  where external_id is not null union select distinct source_id, 'url', url from ent where url is not null""",
    "sync_state": f"""with {OUTCOMES} select source_id, {iso('synced')} as last_synced_at, {iso('success')} as last_success_at,
  {iso('error_at')} as last_error_at, error_message as last_error_message, source_status from states""",
    "source_status": f"""with {OUTCOMES}, j as (select s.source_id, s.created_at, t.synced, t.success, t.error_at, t.error_message,
  case s.source_id % 5 when 3 then 'paused' when 4 then 'error' else 'active' end as status
  from srcs s left join states t on t.source_id = s.source_id)
select source_id, 'Source ' || source_id as name, status,
  case when status = 'paused' then 'Paused RSS sources cannot be synced.'
    when source_id % 9 = 8 then 'RSS source URL is required for sync.' end as refusal,
  case status when 'paused' then 'Paused' when 'error' then 'Error' else 'Active' end as badge_label,
  case status when 'paused' then 'muted' else status end as badge_tone,
  case when synced is null then 'Sync state has not been initialized yet.'
    when status = 'paused' then coalesce('Paused. Last successful sync ' || {label('success')} || '.', 'Paused before the first sync.')
    when status = 'error' then coalesce('Last sync error ' || {label('error_at')} || coalesce(': ' || nullif(error_message, ''), '.'),
      'An error state is recorded for this source.')
    else coalesce('Last successful sync ' || {label('success')} || '.', 'Last sync attempt ' || {label('synced')} || '.') end as detail
from j""",
    "sync_state_batches": f"""with {OUTCOMES} select source_id, {iso('synced')} as last_synced_at, {iso('success')} as last_success_at,
  {iso('error_at')} as last_error_at, error_message as last_error_message, source_status from states""",
    "sync_state_backfill": f"""with {OUTCOMES} select coalesce(t.source_id, s.source_id) as source_id, {iso('synced')} as last_synced_at,
  {iso('success')} as last_success_at, error_message as last_error_message
from states t full join srcs s on s.source_id = t.source_id""",
    "source_register": f"""with {REGISTER} select request_id, case when not unnamed then 'Feed ' || request_id end as name, ref as source_ref,
  topic, case when rejection is null then sha256('rss:' || ref) end as source_id, rejection from req4""",
    "source_commands": f"with {COMMANDS} select command_id, action, rejection from checked",
    "source_table": f"""with {COMMANDS}, ok as (select * from checked where rejection is null),
l as (select source_id, arg_max(action, (at_time, command_id)) as action, max(at_time) as u,
  max(at_time) filter (action = 'register') as c from ok group by source_id)
select source_id, case action when 'pause' then 'paused' else 'active' end as status, {iso('c')} as created_at,
  {iso('u')} as updated_at from l where action <> 'delete'""",
    "cascade_deletes": f"""with {COMMANDS}, ok as (select * from checked where rejection is null),
l as (select source_id, arg_max(action, (at_time, command_id)) as action from ok group by source_id),
alive as (select source_id from l where action <> 'delete')
select 'entry' as kind, c.command_id as entry_id, a.source_id from cmd c left join alive a on a.source_id = c.source_id
union all select 'state', c.command_id, c.source_id from cmd c join alive a on a.source_id = c.source_id""",
    "enrichment_validate": _validate(),
    "enrichment_rules": f"""with {FX}, {SCORE}, {CLASSIFY},
r as (select s.*, c.classification, c.topic, c.tag_list, {sentences('x.content_text')} as lead,
  {collapse("coalesce(x.title, '')")} as t from rule_scores s join classified c on c.item_id = s.item_id join fx x on x.item_id = s.item_id),
q as (select *, {collapse("coalesce(lead[2], 'Notes on ' || coalesce(topic, 'this topic'))")} as short from r)
select item_id, importance_score, novelty_score, classification, topic,
  case when importance_score >= 0.6::double and novelty_score >= 0.6::double then 'keep' else 'review' end as preserve_recommendation,
  array_to_string(({TAGS_OUT})[1:8], '|') as tags, least(5, greatest(len(lead), 3))::int as key_point_count
from q where not coalesce({echo('short', 't')}, false)""",
    "model_requests": f"""with {FX} select item_id, to_json({{'item': {{'author': author, 'canonical_url': canonical_url,
  'content_text': content_text, 'id': item_id::varchar, 'language': lang, 'published_at': {iso('published_at')},
  'source_topic': source_topic, 'title': title}}}})::varchar as request from fx""",
    "model_responses": """select conv_id, turn, case when (conv_id + turn) % 7 < 4 and trim(replace(text, chr(10), ' ')) <> ''
  then replace(replace(replace(text, '\\', ' '), '"', ' '), chr(10), ' ') end as output_text from conversations""",
    "enrichment_history": f"with {FX}, {VERSIONS} {history('versions')}",
    "enrichment_rewrite": f"""with {FX}, {VERSIONS}, both_v as (select * from versions union all
  select doc_id, 2, {seconds(FEB_1, 'doc_id + 3 * 86400')}, 0.25::double from labels) {history('both_v')}""",
    "history_batches": f"""with {FX}, {VERSIONS}, both_v as (select * from versions union all
  select doc_id, 2, {seconds(FEB_1, 'doc_id + 3 * 86400')}, 0.25::double from labels) {history('both_v')}""",
    "current_batches": f"""with {FX}, {VERSIONS}, both_v as (select * from versions union all
  select doc_id, 2, {seconds(FEB_1, 'doc_id + 3 * 86400')}, 0.25::double from labels), closed as ({history('both_v')})
select item_id, version_id, importance_score, created_at from closed where is_current""",
    "processing_record": f"""with {FX}, {KEYED}, {DESTS} select item_id, 'score|dedupe|summarize|classify|group|preserve' as step_order,
  'processed' as status, case when item_id = first_id and advice = 'keep' then 'created' else 'skipped' end as note_status,
  dedupe_key, topic, {group_id(slug('topic'))} as group_id, 3 as key_point_count,
  case when item_id = first_id and advice = 'keep' then sha256('note:' || item_id) end as note_id,
  case when item_id = first_id and advice = 'keep' then (select count(*)::int from dests where status = 'active') else 0 end
    as synced_count from found""",
    "insert_missing": f"""with {FX}, {VERSIONS}
select item_id, title, 0 as revision from fx where item_id % 3 = 0
union all select v.item_id, x.summary_short, max(v.version_id) + 1 from versions v join fx x on x.item_id = v.item_id
  where v.item_id % 3 <> 0 group by all""",
    "fetch_runs": """with f as (select user_id % 20 as source_id, event_id as batch_id, event_id % 7 = 0 as failed,
  event_id % 5 = 0 as empty, 'status ' || event_type as message from events)
select source_id, batch_id, 'started' as phase, 'captured' as entry_status, null::bigint as fetched_count,
  null::bigint as persisted_count, null::bigint as skipped_count, null::varchar as normalization_phase,
  null::varchar as normalization_reason, null::varchar as message from f
union all select source_id, batch_id, 'failed', 'failed', null, null, null, null, null, message from f where failed
union all select source_id, batch_id, 'completed', case when empty or batch_id % 2 = 1 then 'normalized' else 'captured' end,
  (not empty)::bigint, (not empty and batch_id % 2 = 0)::bigint, (not empty and batch_id % 2 = 1)::bigint,
  case when empty or batch_id % 2 = 1 then 'skipped' end, case when empty or batch_id % 2 = 1 then 'no_new_raw_assets' end,
  null from f where not failed""",
    "upsert_notes": f"""with {FX}, {VERSIONS}, d as (select v.item_id + 40 as item_id, x.summary_short as title,
  v.version_id + 1 as revision, v.created_at as at_time, row_number() over (partition by v.item_id order by v.created_at desc) as k
  from versions v join fx x on x.item_id = v.item_id)
select item_id, title, revision, {iso('at_time')} as updated_at from d where k = 1
union all select item_id, title, 0, {iso('created_at')} from fx where item_id not in (select item_id from d)""",
    "integrity_report": """
select 'unique orders(customer,date)' as check_name, o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as key_text,
  count(*) as row_count from orders group by o_custkey, o_orderdate having count(*) > 1
union all select 'unique lineitem(order,line)', l_orderkey || '|' || l_linenumber, count(*) from lineitem
  group by l_orderkey, l_linenumber having count(*) > 1
union all select 'unique documents(text)', md5(text), count(*) from documents group by text having count(*) > 1
union all select 'reference lineitem.orderkey', l_orderkey::varchar, count(*) from lineitem
  where l_orderkey not in (select o_orderkey from orders) group by l_orderkey
union all select 'reference orders.custkey', o_custkey::varchar, count(*) from orders
  where o_custkey not in (select c_custkey from customer) group by o_custkey
union all select 'reference documents.doc_id', doc_id::varchar, count(*) from documents
  where doc_id not in (select doc_id from labels) group by doc_id""",
}

"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from tribunal.llm.line_quality import BOILERPLATE, LineRules, SYMBOLS
from tribunal.llm.mixing import OTHER, pfair_slots
from tribunal.llm.queries import MIXTURE

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RULES = LineRules()

WARC = """
with p as (select page_id, coalesce(html, '') body from pages),
r as (select page_id, strlen(body) n, sha256(body) d from p),
k as (select d, min(page_id) keeper from r where n >= 100 group by d)
select page_id, n::bigint payload_bytes, r.d payload_digest,
       case when keeper is distinct from page_id and keeper is not null then 'revisit' else 'response' end record_type,
       case when keeper is distinct from page_id then keeper end refers_to
from r left join k on r.d = k.d and r.n >= 100
"""


def _mixture(block: int = 16) -> str:
    """Ranks inside each source, dealt into the slots of the fixed schedule."""
    parts = MIXTURE | {OTHER: 1}
    sizes = ", ".join(f"('{s}', {p})" for s, p in parts.items())
    slots = ", ".join(f"('{s}', {j}, {t})" for s, j, t in pfair_slots({f"={s}": p for s, p in MIXTURE.items()} | {OTHER: 1}))
    return f"""
with sizes(name, parts) as (values {sizes}),
slots(name, turn, place) as (values {slots.replace("('=", "('")}),
ranked as (
  select doc_id, source, coalesce(name, '{OTHER}') name,
         row_number() over (partition by coalesce(name, '{OTHER}') order by md5(concat_ws('#', doc_id, text))) - 1 k
  from documents left join sizes on source = name),
placed as (
  select doc_id, source, k, k // {block} as block, parts, name from ranked join sizes using (name))
select doc_id, source, block, (block // parts) * {sum(parts.values())} + place as slot,
       ((block // parts) * {sum(parts.values())} + place) * {block} + k % {block} as position
from placed p join slots s on p.name = s.name and p.block % p.parts = s.turn
"""


QUALITY = f"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
words as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) pos from d),
windows as (
  select doc_id, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' '
         || lead(word, 3) over o || ' ' || lead(word, 4) over o five
  from words window o as (partition by doc_id order by pos)),
twice as (select doc_id, five from windows where five is not null group by all having count(*) > 1),
hits as (select doc_id, pos from windows join twice using (doc_id, five)),
gaps as (select doc_id, least(5, coalesce(pos - lag(pos) over (partition by doc_id order by pos), 5)) n from hits),
repeats as (select doc_id, sum(n)::bigint n_repeat_words from gaps group by doc_id),
lines as (
  select doc_id, line, rtrim(regexp_replace(line, '[\\x09-\\x0D]', ' ', 'g'), ' ') plain
  from (select doc_id, unnest(string_split(t, chr(10))) line from d)
  where translate(line, {_BLANKS}, '') <> ''),
counted as (
  select *, len(string_split(trim(regexp_replace(plain, ' +', ' ', 'g'), ' '), ' ')) n,
         length(translate(line, {_BLANKS}, '')) chars
  from lines),
judged as (
  select doc_id, line, chars,
         (not regexp_matches(plain, '[.!?:;…。！？]["''”’»)\\]]*$') and n < {_RULES.short_words})
         or 100 * (length(plain) - length(translate(plain, '|»›•·', ''))) >= {_RULES.separator_percent} * n + 100
         or 100 * (length(plain) - length(translate(plain, '{SYMBOLS}', ''))) > {3 * _RULES.symbol_percent} * n
         or 100 * (length(plain) - length(replace(plain, '!', ''))) > {2 * _RULES.exclamation_percent} * n + 200
         or regexp_matches(lower(plain), '{"|".join(BOILERPLATE)}') as fails
  from counted),
per_doc as (
  select doc_id, coalesce(sum(chars) filter (fails), 0)::bigint lost_chars,
         count(*) - count(distinct line) n_dup_lines
  from judged group by doc_id),
base as (
  select d.doc_id, len(ws)::bigint n_words, length(translate(t, {_BLANKS}, ''))::bigint word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
         coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
         coalesce(lost_chars, 0) lost_chars
  from d left join per_doc using (doc_id) left join repeats using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
       and not 100 * lost_chars > {_RULES.lost_percent} * word_chars as kept
from base
"""

PASSAGES = f"""
with d as (
  select doc_id, text,
         regexp_extract_all(text, '(?:^[\\x20\\x09-\\x0D]*)?[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') pieces
  from documents),
words as (select *, list_transform(pieces, lambda x: trim(x, {_BLANKS})) ws from d),
placed as (
  select doc_id, unnest(pieces) piece, generate_subscripts(pieces, 1) pos, ws from words),
windows as (
  select doc_id, pos, piece, case when pos + 50 <= len(ws) then array_to_string(ws[pos:pos + 50], ' ') end passage from placed),
firsts as (select passage, min(doc_id) holder from windows where passage is not null group by passage),
judged as (
  select doc_id, pos, piece,
         coalesce(max((holder <> doc_id)::int) over (
           partition by doc_id order by pos rows between 50 preceding and current row), 0) = 1 gone
  from windows left join firsts using (passage)),
opened as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) opens from judged),
cleaned as (
  select doc_id, coalesce(string_agg(piece, '' order by pos) filter (not gone), '') kept,
         count(*) filter (gone) removed_words, count(*) filter (opens)::int n_spans
  from opened group by doc_id)
select doc_id, coalesce(kept, text) "text", coalesce(removed_words, 0) removed_words, coalesce(n_spans, 0) n_spans
from documents left join cleaned using (doc_id)
"""

LINES = f"""
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, unnest(ls) line, generate_subscripts(ls, 1) pos from d),
k as (
  select *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
common as (select key from k where key <> '' group by key having count(distinct r) >= 10),
judged as (select k.*, common.key is not null as gone from k left join common using (key))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from judged join d using (r) group by r, doc_id
"""

_TERMS = (
    "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term"
)
LEXICAL = f"""
with t as (select r, doc_id, {_TERMS} from (select row_number() over () r, * from documents)),
postings as (select r, doc_id, term, count(*) tf from t group by all),
lengths as (select r, sum(tf)::bigint n from postings group by r),
corpus as (select count(*) big_n, sum(n)::bigint big_l from lengths),
asked as (select distinct i, item_id, term
          from (select i, item_id, {_TERMS} from (select row_number() over () i, * from benchmark))),
weights as (select term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint w
            from postings, corpus group by term, big_n),
scored as (
  select i, item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint score
  from asked join postings using (term) join weights using (term) join lengths using (r), corpus group by all),
ranked as (
  select item_id, row_number() over (partition by i order by score desc, doc_id)::int as "rank", doc_id, score
  from scored where score > 0)
select * from ranked where "rank" <= 50
"""


def _repair() -> str:
    """Turn by turn, the cheapest edits that end in each of four states, with the text so far."""
    far = "{'c': 1000000000, 'a': '', 't': null::varchar}"

    def way(state: str, cost: str, edit: str, said: str | None = None) -> str:
        text = f"{state}.t" if said is None else f"coalesce({state}.t || chr(10), '') || {said}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}}"

    def turn(state: str, role: str) -> str:
        return (f"case when forced then {far} when initial = '{role[0]}' then {way(state, 'late', 'K', 'said')} "
                f"else {way(state, '2 + late', 'R', f"'{role}:' || text")} end")

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    gone = [way(f"s{n}", "3", "D") for n in range(4)]
    system = f"case when forced or initial <> 's' then {far} else {way('s0', 'late', 'K', 'said')} end"
    user = [way(s, "2", "I", "'user:'") for s in ("d0", "d1", "d3")]
    answer = way("i2", "2", "I", "'assistant:'")
    plain = f"rtrim(text, {_BLANKS})"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = "list_transform(string_split(key, ''), lambda x: ord(x)::bigint)"
    return f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
hashed as (
  select *, xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {bits}), 4294967295) % 20 kind from keyed),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from hashed, range(2) copies(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (
  select *, left(role, 1) initial, role || ':' || text said, {plain} plain,
         row_number() over (partition by conv_id order by turn nulls first, role, text) pos,
         row_number() over (partition by conv_id, role, text order by turn nulls first) nth,
         lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) ahead
  from damaged),
marked as (
  select *, plain = '' or nth > 1 forced,
         (plain <> '' and nth = 1 and right(plain, 1) not in ('.', '!', '?'))::bigint late
  from placed),
faults as (
  select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
         count(*) filter (plain = '') blank, count(*) filter (plain <> '' and nth > 1) duplicate,
         sum(late)::bigint truncated, count(*) filter (ahead || initial not in ('su', 'ua', 'au')) illegal
  from marked group by conv_id),
walk as (
  select conv_id, 0::bigint pos, {{'c': 0::bigint, 'a': '', 't': null::varchar}} s0,
         {{'c': 1000000000::bigint, 'a': '', 't': null::varchar}} s1, {{'c': 2::bigint, 'a': 'I', 't': 'user:'}} s2,
         {{'c': 4::bigint, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} s3
  from (select distinct conv_id from conversations)
  union all
  select conv_id, pos, d0, d1, i2, {least('d3', answer)}
  from (
    select conv_id, pos, d0, d1, d3, {least('d2', *user)} i2
    from (
      select m.conv_id, m.pos, {gone[0]} d0, {least(gone[1], system)} d1,
             {least(gone[2], *[turn(s, 'user') for s in ('s0', 's1', 's3')])} d2,
             {least(gone[3], turn('s2', 'assistant'))} d3
      from walk w join marked m on w.conv_id is not distinct from m.conv_id and m.pos = w.pos + 1))),
ends as (
  select w.conv_id, f.* exclude (conv_id), {least('s0', 's3')} best
  from walk w left join faults f on w.conv_id is not distinct from f.conv_id where w.pos = coalesce(f.n, 0))
select conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
       coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, best.c as cost, best.a as audit,
       sha256(coalesce(best.t, '')) repaired_sha256
from ends
"""


ORACLE: dict[str, str] = {
    "op4_chunked_warc": WARC,
    "op8_gear_chunks": PASSAGES,
    "op9_pfair_mixture": _mixture(),
    "op10_line_quality": QUALITY,
    "op11_line_runs": LINES,
    "op12_interval_repair": _repair(),
    "op13_max_sketches": LEXICAL,
}

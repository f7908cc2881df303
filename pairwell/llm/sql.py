"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pairwell.llm import quality_ledger, secret_ledger

SPACE = r"[\x20\x09-\x0D]"
_BASE = "(n_words < 20 or 100 * n_repeat_words > 30 * n_words)"
_SYMBOLS = r"[#*$%&|<>]"

QUALITY_MEASURES = rf"""
texts as (select doc_id, coalesce(text, '') as t from documents),
split as (
  select doc_id, t, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from texts),
windows as (
  select doc_id, p, array_to_string(w[p:p + 7], ' ') as k
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from split where len(w) >= 8)),
twice as (
  select doc_id, unnest(range(p, p + 8)) as place
  from (select doc_id, p, count(*) over (partition by doc_id, k) as n from windows) where n > 1),
repeated as (select doc_id, count(distinct place) as n from twice group by doc_id),
measured as (
  select s.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '{_SYMBOLS}'))::bigint as n_symbols,
         len(l)::bigint as n_lines,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words
  from split s left join repeated r using (doc_id)),
bits as (
  select *, {" + ".join(f"case when {r.fails} then {1 << r.bit} else 0 end" for r in quality_ledger.RULES)} as b
  from measured)
"""

QUALITY = f"""
with {QUALITY_MEASURES}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} as base_failed,
       (b & {quality_ledger.PRODUCTION.mask()}) = 0 as kept, b::bigint as fail_bits
from bits
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(number: int, kind: secret_ledger.Kind) -> str:
    """Matches of one kind with places: text between matches, and matches, summed up."""
    p = _quoted(kind.pattern)
    size = f"length(regexp_extract(m[i], {p}, {kind.group}))" if kind.group else "length(m[i])"
    return f"""
  select doc_id, {number} as o, '{kind.name}' as kind, i,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as s,
         length(m[i]) as size, {size} >= {kind.least} as counts
  from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i
        from (select doc_id, regexp_extract_all(t, {p}) as m, string_split_regex(t, {p}) as g from texts))"""


SECRETS = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(_spans(n, k) for n, k in enumerate(secret_ledger.KINDS))}),
named as (
  select doc_id, o, kind, s::bigint as s, kind || ':' || s::bigint || ':' || (s + size)::bigint as span
  from spans where counts),
joined as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(span, ',' order by s, o) filter (o < 3) as base, string_agg(span, ',' order by s, o) as spans
  from named group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
       coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (doc_id)
"""

CHAT = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
turns as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as n,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) as size,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) as role_size
  from given),
sums as (
  select *, sum(24 + role_size + size) over (partition by conv_id order by n) as upto,
         n = max(n) over (partition by conv_id) as final
  from turns)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
       coalesce(sum(upto) filter (role = 'assistant' or final), 0)::bigint as formatted_chars,
       count(*) filter (role = 'assistant')::bigint as n_examples
from sums group by conv_id
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def decontamination(documents: str = "documents") -> str:
    """CTEs ending in ``judged``: doc_id, n_words, n_hit and the items of hits."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{word}')"
    return f"""
dw as (select doc_id, {words} as w from {documents}),
iw as (select item_id::varchar as item, {words} as w from benchmark where item_id is not null),
pieces as (
  select item, case when len(w) < 10 then len(w) else 10 end as size, w, unnest(range(1, greatest(len(w) - 8, 2))) as p
  from iw where len(w) > 0),
item_windows as (select distinct item, size, array_to_string(w[p:p + size - 1], ' ') as k from pieces),
sizes as (select distinct size from item_windows),
places as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as p from dw, sizes where len(w) >= size),
found as (
  select q.doc_id, q.p, q.size, i.item
  from (select doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') as k from places) q
  join item_windows i on i.size = q.size and i.k = q.k),
covered as (
  select doc_id, count(distinct place) as n
  from (select doc_id, unnest(range(p, p + size)) as place from (select distinct doc_id, p, size from found)) group by doc_id),
named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from found) group by doc_id),
judged as (
  select dw.doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items,
         sha256(coalesce(m.items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
  from dw left join covered c using (doc_id) left join named m using (doc_id))"""


DECONTAMINATION = f"with {decontamination()} select * from judged"

#: Kind, pattern and the condition on a match ``x``; group 1 where a cue comes first.
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = (
    "list_sum(list_transform(string_split(reverse(d), ''), lambda c, j: "
    "case when j % 2 = 1 then c::int when c::int > 4 then c::int * 2 - 9 else c::int * 2 end)) % 10 = 0")
_MOD97 = (
    "list_reduce(list_transform(string_split(a[5:] || a[1:4], ''), lambda c: case when c between '0' and '9' "
    "then [10, c::int] else [100, ascii(c) - 55] end), lambda u, v: [10, (u[2] * v[1] + v[2]) % 97], [10, 0])[2] = 1")
PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0,
     "len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 or coalesce(try_cast(y as int), 256) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0,
     f"length({_DIGITS}) between 16 and 19 and {_LUHN.replace('reverse(d)', f'reverse({_DIGITS})')}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) between 8 and 15"),
    ("url", r"(?:https?|ftp)://[^\x00-\x20\"'<>\x7f-\xa0]+", 0, "length(regexp_replace(rtrim(x, '.,;:!?)]}'), '^[a-z]+://', '')) > 0"),
    ("iban", r"(?:IBAN|Iban|iban)[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})", 1, _MOD97.replace("a[", "replace(g, ' ', '')[")),
    ("account", r"(?:account|Account|ACCOUNT|acct|Acct)(?: (?:no|number|nr)\.?)?[ :#]{1,3}([0-9][0-9-]{4,20}[0-9])", 1, "true"),
)


def pii(documents: str = "documents") -> str:
    """CTEs ending in ``spans``: doc_id, o, kind, s, e (code points, end exclusive)."""
    def one(number: int, kind: str, pattern: str, group: int, holds: str) -> str:
        p = _quoted(pattern)
        end = "length(rtrim(x, '.,;:!?)]}'))" if kind == "url" else "length(x)"
        return f"""
  select doc_id, {number} as o, '{kind}' as kind, (s + length(x) - length(g))::bigint as s, (s + {end})::bigint as e
  from (select doc_id, m[i] as x, {f"regexp_extract(m[i], {p}, 1)" if group else "m[i]"} as g,
               list_sum(list_transform(b[1:i], lambda y: length(y)))
               + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) as s
        from (select doc_id, m, b, unnest(range(1, len(m) + 1)) as i
              from (select doc_id, regexp_extract_all(t, {p}) as m, string_split_regex(t, {p}) as b from texts)))
  where {holds}"""

    return f"""
texts as (select doc_id, coalesce(text, '') as t from {documents}),
spans as ({" union all ".join(one(n, *k) for n, k in enumerate(PII_KINDS))})"""


PII = f"""
with {pii()},
joined as (
  select doc_id, {", ".join(f"count(*) filter (o = {n}) as n_{k[0]}" for n, k in enumerate(PII_KINDS[:4]))},
         string_agg(kind || ':' || s || ':' || e, ',' order by o, s) filter (o < 4) as base,
         string_agg(kind || ':' || s || ':' || e, ',' order by o, s) as spans
  from spans group by doc_id)
select doc_id, {", ".join(f"coalesce(n_{k[0]}, 0)::bigint as n_{k[0]}" for k in PII_KINDS[:4])},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (doc_id)
"""



def near_copies(words: int, percent: int, documents: str = "documents") -> str:
    """CTEs ending in ``near``: doc_id, n_shingles, component_id, kept."""
    return f"""
ndw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{SPACE}+'), lambda x: x <> '') as w
  from {documents}),
shingled as (
  select distinct doc_id, array_to_string(w[p:p + least({words}, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) as p from ndw where len(w) > 0)),
sized as (select doc_id, count(*) as n from shingled group by doc_id),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as n
  from shingled x join shingled y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from shared s join sized p on p.doc_id = s.a join sized q on q.doc_id = s.b
  where 100 * s.n >= {percent} * (p.n + q.n - s.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from ndw
  union
  select r.a, l.b from reach r join both_ways l on l.a = r.b),
near as (
  select ndw.doc_id, coalesce(z.n, 0)::bigint as n_shingles, m.c as component_id, m.c = ndw.doc_id as kept
  from ndw left join sized z using (doc_id) join (select a, min(b) as c from reach group by a) m on m.a = ndw.doc_id)"""


NEAR_COPIES = f"with recursive {near_copies(2, 80)} select * from near"

NGRAM_JOIN = f"with recursive {near_copies(5, 80)} select doc_id, n_shingles, component_id from near"

# CRC-32 bit by bit: each step shifts, and adds the polynomial if the lowest bit and the message's differ.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(4 * length(x)), lambda i:
    ((instr('0123456789ABCDEF', x[2 * (i // 8) + if(i % 8 < 4, 2, 1)]) - 1) >> (i % 4)) & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""

SPELLING = f"""
with recursive runs as (
  select doc_id, run, count(*) as k from (
    select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_UPPER.lower()}') as run
    from documents) where length(run) >= 6 group by all),
hashed as (
  select run, k, {_CRC} as h from (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs)),
words as (
  select word, sum(k)::bigint as n from (
    select k, case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from hashed)
  where length(word) >= 6 group by 1 having sum(k) >= 5),
cut as (
  select word, i, word[:i - 1] || word[i + 1:] as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct c.word as a, w.word as b from cut c join words w on w.word = c.rest),
near as (
  select a, b from shorter union select b, a from shorter
  union select x.word, y.word from cut x join cut y on x.i = y.i and x.rest = y.rest and x.word <> y.word),
best as (
  select a, count(*) as n_near, arg_min(b, struct_pack(less := -w.n, b := b)) as form, max(w.n) as form_n
  from near join words w on w.word = b group by a),
formed as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 5 * n then form end as form,
         case when form_n >= 5 * n then form_n end as form_n
  from words left join best on a = word),
walk as (
  select word, word as last, 0 as steps from formed
  union all
  select k.word, f.form, k.steps + 1 from walk k join formed f on f.word = k.last where f.form is not null)
select word, form, root, n, n_near, form_n from formed join (select word, arg_max(last, steps) as root from walk group by 1) using (word)"""

HARD_NEGATIVES = """
with points as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from points a join points b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positive as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
ranked as (
  select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank,
         other as negative_id, positive_score, score as negative_score
  from positive p join scored s on s.anchor_id = p.anchor_id and not same
  where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10"""

ORACLE = {
    "op11_ngram_join": NGRAM_JOIN,
    "op12_spelling_variants": SPELLING,
    "op13_hard_negatives": HARD_NEGATIVES,
    "op5_minhash_near_dedup": NEAR_COPIES,
    "op4_benchmark_decontamination": DECONTAMINATION,
    "op9_pii": PII,
    "op6_quality_rules": QUALITY,
    "op7_secret_scans": SECRETS,
    "op10_chat_formatting": CHAT,
}

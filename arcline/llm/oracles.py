"""SQL that the registered queries must equal, for the operators that SQL can express."""

from __future__ import annotations

from .queries import URL_RULES

RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}', '{host}{path}')" for host, path, verdict in URL_RULES)

OP2 = rf"""
with rules(rule_host, rule_path, verdict, rule) as (values {RULE_ROWS}),
parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
best as (
  select host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from (select distinct host, path from parts) p
  join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  group by host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join best using (host, path)
"""

MIX = r"""
sizes as (
  select doc_id, source, case when source is null then 'N' else 'A' || source end as mix_key,
    cast(len(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from {docs}),
per as (
  select mix_key, cast(sum(size) as bigint) as source_size, count(*) as source_rows from sizes group by mix_key),
weighted as (
  select *, row_number() over (order by mix_key) as place, source_size * 2.0::double as cap,
    (sum(source_size) over ())::double * 1.5::double as total
  from per),
leveled as (
  select *, list_value(5.0::double, 2.0::double, 1.0::double)[((place - 1) % 3 + 1)::int] as weight from weighted),
levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level
  from leveled),
targets as (
  select mix_key, source_size, source_rows, least(cap, weight * max(level) over ()) as target,
    case when source_size > 0 then least(cap, weight * max(level) over ()) / source_size else 0 end as expected,
    ('0x' || substr(md5('mix' || mix_key), 1, 4))::int / 65536.0::double as start
  from levels),
ranked as (
  select doc_id, source, size, source_size, target, expected, start, row_number() over (
    partition by mix_key
    order by case when size > 0 then length(ltrim(bin(size), '0')) else 0 end,
      coalesce(doc_id, 0) % cast(ceil(source_rows / 250000.0) as bigint), size, doc_id) as place
  from sizes join targets using (mix_key))
select {columns},
  cast(floor(expected * place + start) - floor(expected * (place - 1) + start) as bigint) * size as taken
from ranked
"""
OP8 = "with " + MIX.format(text="text", docs="documents", columns="doc_id, size, source_size, target")

# {docs} has doc_id and text; one row per document with what the contract asks.
HITS = r"""
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from {docs}),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as span, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
spans as (select distinct span from windows),
grams as (
  select doc_id, span, i, array_to_string(w[i : i + span - 1], ' ') as win
  from (select doc_id, w, span, unnest(range(1, len(w) - span + 2)) as i from words, spans where len(w) >= span)),
found as (select doc_id, span, i, item_id from grams join windows using (span, win)),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + span)) as p from (select distinct doc_id, span, i from found)) group by doc_id),
named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id),
judged as (
  select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
  from words left join hit using (doc_id) left join named using (doc_id))
"""
OP9 = "with " + HITS.format(docs="documents") + "select * from judged"

# {docs} has doc_id and text.
KEPT = r"""
kwords as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from {docs}),
kwindows as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as win
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from kwords where len(w) >= 13)),
kfirst as (select win, min(doc_id) as least from kwindows group by win having min(doc_id) < max(doc_id)),
kgone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p
  from (select doc_id, i from kwindows join kfirst using (win) where doc_id > least)),
klists as (select doc_id, list(p) as gone from kgone group by doc_id),
kept as (
  select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
    case when gone is null then array_to_string(w, ' ')
      else array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i)), ' ') end as kept_text
  from kwords left join klists using (doc_id))
"""
OP1 = "with " + KEPT.format(docs="documents") + "select doc_id, n_words, n_removed, sha256(kept_text) as kept_sha256 from kept"

# {docs} has doc_id and text.
SIMILAR = r"""
swords as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from {docs}),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from swords where len(w) > 0)),
ssizes as (select doc_id, count(*) as n from shingles group by doc_id),
slinks as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join ssizes x on x.doc_id = a.doc_id join ssizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 7 * count(*) >= 3 * (x.n + y.n)),
reached(doc_id, other) as (
  select doc_id, doc_id from swords union select r.doc_id, l.b from reached r join slinks l on l.a = r.other),
joined as (
  select s.doc_id, coalesce(z.n, 0) as n_shingles, min(r.other) as component_id
  from swords s join reached r using (doc_id) left join ssizes z using (doc_id) group by s.doc_id, z.n)
"""
OP6 = "with recursive " + SIMILAR.format(docs="documents") + "select * from joined"

OP7 = """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as s
  from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from raw where length(h) >= 100)),
earliest as (select s, min(doc_id) as least from windows group by s having min(doc_id) < max(doc_id)),
gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from windows join earliest using (s) where doc_id > least),
counted as (
  select doc_id, count(*) as n_removed, count(*) filter (where before is null or before < p - 1) as n_spans
  from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from gone) group by doc_id),
bytes as (
  select doc_id, p, substr(h, 2 * p + 1, 2) as b
  from (select doc_id, h, unnest(range(0, length(h) // 2)) as p from raw where doc_id in (select doc_id from counted))),
rest as (
  select doc_id, string_agg(b, '' order by p) as h
  from bytes anti join gone using (doc_id, p) group by doc_id)
select raw.doc_id, length(raw.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_removed is null then raw.h else coalesce(rest.h, '') end)) as kept_sha256
from raw left join counted using (doc_id) left join rest using (doc_id)
"""

CHECKS = {
    "op7_suffix_array_dedup": OP7,
    "op6_ngram_jaccard_join": OP6,
    "op1_substring_dedup": OP1,
    "op2_url_filters": OP2,
    "op8_mixing_sources": OP8,
    "op9_benchmark_decontamination": OP9,
}


def _codes_sql(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Part codebooks in plain joins: every part against every entry, round by round."""

    def nearest(k: int) -> str:
        away = "cast(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as bigint)"
        return f"""near{k} as (select row_id, part, x, min(struct_pack(d := {away}, e := entry)) as best
            from cut join book{k} using (part) group by row_id, part, x)"""

    steps = [
        """kept as (select row_number() over (order by vec_id nulls last) as row_id, vec_id, label,
            list_transform(embedding, lambda x: floor(4096 * cast(x as double))) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""cut as (select row_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x
            from kept, range({parts}) r(part))""",
        f"book0 as (select part, row_id - 1 as entry, x as c from cut where row_id <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            nearest(k),
            f"""sums{k} as (select part, entry, place, floor(sum(value) / count(*)) as value from
                (select part, best.e as entry, unnest(x) as value, unnest(range(len(x))) as place from near{k}) group by all)""",
            f"mean{k} as (select part, entry, list(value order by place) as c from sums{k} group by part, entry)",
            f"""book{k + 1} as (select b.part, b.entry, coalesce(m.c, b.c) as c from book{k} b
                left join mean{k} m on m.part = b.part and m.entry = b.entry)""",
        ]
    steps += [
        nearest(rounds),
        f"""coded as (select row_id, string_agg(printf('%02x', best.e), '' order by part) as code,
            cast(sum(best.d) as bigint) as error from near{rounds} group by row_id)""",
        f"""digest as (select sha256(string_agg(cast(cast(value as bigint) as varchar), ',' order by part, entry, place)) as hash from
            (select part, entry, unnest(c) as value, unnest(range(len(c))) as place from book{rounds}))""",
    ]
    return f"""with {", ".join(steps)}
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, hash as codebooks_sha256
        from coded join kept using (row_id), digest"""


CHECKS["op13_vector_code_compression"] = _codes_sql()


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, folded byte by byte over the table of the polynomial."""

    def entry(value: int) -> int:
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    table = "[" + ", ".join(str(entry(i)) for i in range(256)) + "]::bigint[]"
    digit = "(instr('0123456789ABCDEF', substr(x, %s, 1)) - 1)"
    steps = f"list_concat([4294967295::bigint], list_transform(range(length(x) // 2), lambda i: {digit % '2 * i + 1'} * 16 + {digit % '2 * i + 2'}))"
    folded = f"list_reduce({steps}, lambda a, b: xor(a >> 8, ({table})[(xor(a, b) & 255) + 1]))"
    return f"(select xor({folded}, 4294967295) from (select hex(encode({text})) as x))"


CHECKS["op12_spelling_variant_grouping"] = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\\x{{00C0}}-\\x{{00FF}}]{{7,}}')) as run from documents),
own as (select run, count(*) as k, {_crc32_sql("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from runs group by doc_id, run),
cut as (
  select k, case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from own),
words as (select word, cast(sum(k) as bigint) as n from cut where length(word) >= 7 group by word having sum(k) >= 2),
gaps as (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
  from (select word, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as near from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select gaps.word, words.word from gaps join words on words.word = gaps.rest
  union select words.word, gaps.word from gaps join words on words.word = gaps.rest),
best as (
  select word, count(*) as n_near, arg_min(near, struct_pack(a := -n, b := near)) as near, max(n) as near_n
  from (select pairs.word, near, words.n from pairs join words on words.word = near) group by word),
judged as (
  select words.word, words.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * words.n then near end as form,
    case when near_n >= 10 * words.n then near_n end as form_n from words left join best using (word)),
way as (
  select word, word as at, 0 as steps from judged
  union all select way.word, judged.form, steps + 1 from way join judged on judged.word = way.at where judged.form is not null)
select word, form, arg_max(way.at, steps) as root, n, n_near, form_n from judged join way using (word) group by word, form, n, n_near, form_n
"""

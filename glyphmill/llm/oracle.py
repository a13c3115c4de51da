"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

_WINDOW = 400

#: A string's bytes are told apart by MD5 here; runs are merged and the bytes between them put together as hexadecimal digits.
REPEATS = f"""
with t as materialized (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
places as (select r, b, unnest(range(1, octet_length(b) - {_WINDOW - 2})) as s from t where octet_length(b) >= {_WINDOW}),
strings as materialized (select r, s, md5(hex(array_slice(b, s, s + {_WINDOW - 1}))) as h from places),
again as (select h from strings group by h having count(*) > 1),
hit as (select r, s, case when s <= lag(s) over (partition by r order by s) + {_WINDOW} then 0 else 1 end as opens from strings semi join again using (h)),
numbered as (select r, s, sum(opens) over (partition by r order by s) as run from hit),
runs as (select r, run, min(s) as a, max(s) + {_WINDOW} as z from numbered group by r, run),
gaps as (
  select r, a as k, coalesce(lag(z) over (partition by r order by a), 1) as a, a as z from runs
  union all select t.r, octet_length(t.b) + 1, coalesce(max(z), 1), octet_length(t.b) + 1 from t left join runs using (r) group by t.r, t.b),
kept as (select g.r, string_agg(hex(array_slice(t.b, g.a, g.z - 1)), '' order by g.k) as h from gaps g join t using (r) where g.z > g.a group by g.r),
sums as (select r, sum(z - a) as n_removed, count(*) as n_spans from runs group by r)
select t.doc_id, cast(octet_length(t.b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.h, ''))) as kept_sha256
from t left join kept using (r) left join sums using (r)
"""

LINKED_VECTORS = """
with recursive u as materialized (
  select vec_id, cast(embedding as double[]) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = len(embedding) and len(list_filter(embedding, lambda v: v <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on len(a.x) = len(b.x) and a.vec_id <> b.vec_id where case when len(a.x) = len(b.x) then list_cosine_similarity(a.x, b.x) end >= 0.95::double),
r as (select vec_id as a, vec_id as b from u union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as least from r group by a),
n as (select a, count(*) as n from l group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(c.least, e.vec_id) as component_id, coalesce(c.least, e.vec_id) = e.vec_id as kept
from embeddings e left join c on c.a = e.vec_id left join n on n.a = e.vec_id
"""


def _level(name: str, of: str, parent: str) -> str:
    """The shares of the rows of ``of`` (parent's keys, name, weight, capacity, budget): ``name`` has them as share."""
    by = f"partition by {parent}"
    return f"""
{name}_1 as (select *, capacity / weight as fill from {of}),
{name}_2 as (select *, coalesce(sum(capacity) over ({by} order by fill, name rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over ({by} order by fill, name rows between current row and unbounded following) as rest from {name}_1),
{name}_3 as (select *, fill * rest + before <= budget as covered from {name}_2),
{name} as (select *, case when covered then cast(capacity as double) else weight * max(case when not covered then (budget - before) / rest end) over ({by}) end as share from {name}_3)"""


def _weights(column: str, weights: dict[str, float]) -> str:
    listed = " ".join(f"when '{name}' then {weight}::double" for name, weight in weights.items())
    return f"case {column} {listed} else 1.0::double end" if listed else "1.0::double"


def mix_sql(weights: dict[str, dict[str, float]], budget: float, epochs: int, seed: int) -> str:
    return f"""
with d as (
  select doc_id, coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
    try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int) as number,
    cast(ceil(octet_length(encode(coalesce(text, ''))) / 4.0) as bigint) as n_tokens from documents),
rows_ as (select doc_id, case when number = 0 then 'crawl' when number < 10 then 'reference' when number >= 10 then 'forum' else 'other' end as domain, lang, source, n_tokens from d),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as n_tokens, cast(sum(n_tokens) * {epochs} as bigint) as capacity from rows_ group by all),
langs as (select domain, lang, cast(sum(capacity) as bigint) as capacity from leaves group by all),
domains as (
  select domain, domain as name, {_weights("domain", weights["domain"])} as weight, cast(sum(capacity) as bigint) as capacity,
    (select cast(sum(n_tokens) as double) from leaves) * {budget}::double as budget from langs group by domain),
{_level("top", "domains", "1")},
in_domain as (select l.domain, l.lang, l.lang as name, {_weights("l.lang", weights["lang"])} as weight, l.capacity, top.share as budget from langs l join top using (domain)),
{_level("middle", "in_domain", "domain")},
in_lang as (select f.domain, f.lang, f.source, f.source as name, {_weights("f.source", weights["source"])} as weight, f.capacity, f.n_tokens, m.share as budget from leaves f join middle m using (domain, lang)),
{_level("bottom", "in_lang", "domain, lang")},
budgets as (select domain, lang, source, n_tokens, cast(floor(share + 1e-6::double) as bigint) as given from bottom),
plan as (select domain, lang, source, given, n_tokens as held, case when n_tokens > 0 then cast(floor(given / n_tokens) as bigint) else 0 end as epochs from budgets),
placed as (select r.*, p.epochs, p.given - p.epochs * p.held as rest, md5('{seed}|' || p.epochs || '|' || coalesce(cast(doc_id as varchar), '')) as place from rows_ r join plan p using (domain, lang, source)),
running as (select *, sum(n_tokens) over (partition by domain, lang, source order by place) as upto from placed)
select doc_id, domain, lang, source, n_tokens, cast(epochs + case when upto <= rest then 1 else 0 end as int) as times from running
"""

#: CRC-32 of a string whose code points are below U+0800, as an expression over its code points.
_CRC_TABLE = "crc as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) t)"


def _crc(text: str) -> str:
    codes = f"flatten(list_transform(string_split({text}, ''), lambda s: case when ord(s) < 128 then [ord(s)] else [192 + ord(s) // 64, 128 + ord(s) % 64] end))"
    return f"xor(list_reduce({codes}, lambda a, b: xor(t[xor(a, b) % 256 + 1], a >> 8), 4294967295::bigint), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

VARIANTS = f"""
with recursive {_CRC_TABLE},
runs as materialized (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) run from documents),
kinds as (select doc_id, translate(run, '{_UPPER}', '{_LOWER}') run, count(*) n from runs group by all),
summed as (select run, n, {_crc("coalesce(doc_id::varchar, '') || ':' || run")} h from kinds, crc),
made as (select case when h % 97 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end word, n from summed),
v as materialized (select word, cast(sum(n) as bigint) n from made where length(word) >= 5 group by word having sum(n) >= 3),
holes as materialized (select word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) hole, left(word, i - 1) || substr(word, i + 1) less from (select *, unnest(range(1, length(word) + 1)) i from v)),
gone as materialized (select distinct h.word, h.n, h.less, v.n m from holes h join v on v.word = h.less),
near as materialized (
  select a.word, b.word other, b.n m from holes a join holes b on a.hole = b.hole and a.word <> b.word
  union all select word, less, m from gone union all select less, word, n from gone),
best as (select word, count(*) n_near, min_by(other, (-m, other)) other, max(m) m from near group by word),
told as materialized (select v.word, v.n, coalesce(n_near, 0) n_near, case when m >= 2 * n then other end form, case when m >= 2 * n then m end form_n from v left join best using (word)),
chain as (select word, form last from told where form is not null union all select c.word, t.form from chain c join told t on t.word = c.last where t.form is not null),
ends as (select c.word, c.last from chain c join told t on t.word = c.last where t.form is null)
select told.word, told.n, cast(n_near as bigint) n_near, form, form_n, coalesce(ends.last, told.word) root from told left join ends using (word)
"""


def _tree(name: str, of: str, group: str, height: int) -> str:
    """Levels of trees of width eight over ``of`` (group, pos, size, digest), each node with what lies left and right of it, and their tops."""
    parts, before = [], of
    for k in range(height):
        by = f"over (partition by {group}, pos // 8 order by pos rows between"
        parts.append(f"""{name}_{k} as materialized (select {group}, pos, digest, size, coalesce(string_agg(digest, '') {by} unbounded preceding and 1 preceding), '') l, coalesce(string_agg(digest, '') {by} 1 following and unbounded following), '') r from {before}),
{name}_up_{k} as (select {group}, pos // 8 pos, cast(ceil(max(size) / 8.0) as bigint) size, sha256(string_agg(digest, '' order by pos)) digest from {name}_{k} where size > 1 group by {group}, pos // 8)""")
        before = f"{name}_up_{k}"
    ends = " union all ".join(f"select {group}, digest from {t} where size = 1" for t in [of, *[f"{name}_up_{k}" for k in range(height)]])
    return ",\n".join([*parts, f"{name}_top as ({ends})"])


def _climb(name: str, of: str, tree: str, group: str, height: int) -> str:
    """Folds ``of`` (r, group, pos, cur, beside) up the tree, level by level; what has no siblings on a level stays as it is."""
    parts, before = [], of
    for k in range(height):
        up = "t.size > 1"
        parts.append(f"{name}_{k} as (select f.r, f.{group}, f.pos // 8 pos, case when {up} then sha256(t.l || f.cur || t.r) else f.cur end cur, case when {up} then f.beside || t.l || t.r else f.beside end beside from {before} f left join {tree}_{k} t on t.{group} = f.{group} and t.pos = f.pos)")
        before = f"{name}_{k}"
    return ",\n".join(parts)


def manifest_sql(fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), leaf_levels: int = 7, group_levels: int = 3) -> str:
    """The manifest for at most 8 ** leaf_levels documents of a language and 8 ** group_levels languages."""
    of = lambda v: f"coalesce(octet_length(encode({v}::varchar)) || ':' || {v}::varchar, '-')"
    leaf = " || ".join(of(f) for f in fields)
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    tampered = " || ".join(of(low if f == "text" else f) for f in fields)
    last, first = f"climb_{leaf_levels - 1}", f"over_{group_levels - 1}"
    return f"""
with {_CRC_TABLE},
d as materialized (select row_number() over () r, doc_id, coalesce('=' || lang, '') g, sha256({leaf}) leaf, case when {_crc("doc_id::varchar")} % 3 = 0 then sha256({tampered}) end tampered from documents, crc),
n as materialized (select r, doc_id, g, leaf, tampered, leaf digest, row_number() over (partition by g order by doc_id nulls first, leaf, r) - 1 pos, count(*) over (partition by g) size from d),
{_tree("low", "n", "g", leaf_levels)},
s as materialized (select 1 one, g, digest, row_number() over (order by g) - 1 pos, count(*) over () size from low_top),
{_tree("high", "s", "one", group_levels)},
start as (select r, g, pos, coalesce(tampered, leaf) cur, '' beside from n),
{_climb("climb", "start", "low", "g", leaf_levels)},
then_ as (select c.r, 1 one, s.pos, c.cur, c.beside from {last} c join s on s.g = c.g),
{_climb("over", "then_", "high", "one", group_levels)}
select n.doc_id, n.leaf, s.digest subroot, t.digest root, sha256(o.beside) proof_sha256, o.cur folded_root, o.cur = t.digest verified
from n join {first} o using (r) join s on s.g = n.g, high_top t
"""


def line_rules_sql(min_docs: int = 10, min_share: float = 0.01, min_left: float = 0.5) -> str:
    blank = r"[\x20\x09-\x0D]"
    chars = f"length(regexp_replace({{}}, '{blank}', '', 'g'))"
    return f"""
with d as materialized (select row_number() over () r, doc_id, coalesce('=' || source, '') host, coalesce(text, '') t from documents),
w as materialized (select r, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
windows as (select r, i, array_to_string(words[i:i + 4], ' ') five from (select r, words, unnest(range(1, len(words) - 3)) i from w where len(words) >= 5)),
again as (select r, i from (select r, i, count(*) over (partition by r, five) n from windows) where n > 1),
repeated as (select r, sum(least(5, coalesce(step, 5))) n from (select r, lead(i) over (partition by r order by i) - i step from again) group by r),
each as materialized (select r, host, md5(t) copy, trim(regexp_replace(regexp_replace(lower(line), '[1-9]', '0', 'g'), '{blank}+', ' ', 'g')) norm, {chars.format("line")} chars from (select r, host, t, unnest(lines) line from d join w using (r))),
hosts as (select host, count(distinct md5(t)) docs from d group by host),
often as (select host, norm from (select host, norm, count(distinct copy) n from each group by host, norm) join hosts using (host) where n > {min_docs} and n > docs * {min_share}::double),
gone as (select r, sum(chars) n from each semi join often using (host, norm) group by r),
told as (select doc_id, cast(len(words) as bigint) n_words, cast({chars.format("t")} as bigint) word_chars, cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) n_dup_lines, cast(coalesce(repeated.n, 0) as bigint) n_repeat_words, cast(coalesce(gone.n, 0) as bigint) n_host_chars
  from d join w using (r) left join repeated using (r) left join gone using (r)),
failed as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from told)
select *, not base_failed and word_chars - n_host_chars >= word_chars * {min_left}::double kept from failed
"""

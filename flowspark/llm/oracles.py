"""DuckDB SQL for the contracts that SQL can state; the other queries are tested against brute force."""

from __future__ import annotations

from .quality_rules import ENDS, NOTICES

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}'), lambda w: w <> '')"


OP1 = f"""with recursive d as (select doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) x from d),
n as (select doc_id, count(*) n from s group by all), sets as (select doc_id, md5(string_agg(x, chr(10) order by x)) k from s group by all), reps as (select k, min(doc_id) r from sets group by all),
t as (select s.doc_id, x from s where s.doc_id in (select r from reps)), c as (select a.doc_id a, b.doc_id b, count(*) c from t a join t b using (x) where a.doc_id < b.doc_id group by all),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)), e as (select a, b from l union all select b, a from l),
reach(a, b) as (select r, r from reps union select reach.a, e.b from reach join e on e.a = reach.b), comp as (select a, min(b) m from reach group by all)
select doc_id, coalesce(n.n, 0) n_shingles, coalesce(m, doc_id) component_id from documents left join n using (doc_id) left join sets using (doc_id) left join reps using (k) left join comp on comp.a = r"""

LINE_OK = f"""not (len(x) - len(translate(x, '|»›>', '')) >= 3 or (k <= 12 and len(x) - len(translate(x, '|»›>', '')) >= 2) or (k <= 40 and regexp_matches(x, {quoted(NOTICES)}))
 or 10 * (len(x) - len(translate(x, '#*$%&|<>!', ''))) > len(x) or (k < 6 and not regexp_matches(rtrim(x, ' '), {quoted(ENDS)})))"""
OP2 = f"""with d as (select doc_id, coalesce(text, '') t, {words("coalesce(text, '')")} w from documents),
ln as (select doc_id, x, len({words('x')}) k from (select doc_id, unnest(string_split(t, chr(10))) x from d)), lost as (select doc_id, sum(k) filter (not ({LINE_OK}))::bigint n_lost from ln where k > 0 group by all),
dup as (select doc_id, count(*) - count(distinct x) n_dup_lines from ln where k > 0 group by all),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)), many as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
rep as (select doc_id, count(distinct i + o) n_repeat_words from many, range(3) r(o) group by all),
a as (select d.doc_id, len(w)::bigint n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_lost, 0) n_lost
 from d left join lost using (doc_id) left join dup using (doc_id) left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_lost <= 50 * n_words kept, n_lost from a"""

NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NORMAL}') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NORMAL}') w from benchmark),
p as (select distinct item_id, least(13, len(w)) size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') x from (select *, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from b where len(w) > 0)),
v as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') x from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from d, (select distinct size from p))),
m as (select doc_id, item_id, v.size, i from v join p using (size, x)), h as (select doc_id, count(distinct i + o) n_hit from m, range(13) r(o) where o < size group by all),
t as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct doc_id, item_id from m) group by all)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated from d left join h using (doc_id) left join t using (doc_id)"""

OP9 = f"""with d as (select doc_id, {words("coalesce(text, '')")} w from documents), v as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) x from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
f as (select x, min(doc_id) least from v group by all), gone as (select distinct doc_id, i + o p from v join f using (x), range(13) r(o) where least < doc_id),
e as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p from d), k as (select doc_id, count(*) kept, string_agg(x, ' ' order by p) s from e anti join gone using (doc_id, p) group by all)
select doc_id, len(w)::bigint n_words, len(w)::bigint - coalesce(kept, 0) n_removed, sha256(coalesce(s, '')) kept_sha256 from d left join k using (doc_id)"""

HOSTILE = r"'\### Assistant: </turn> ok'"
OP10 = f"""with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations union all select -7, 0, 'user', {HOSTILE} union all select -7, 1, 'assistant', {HOSTILE})
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256, sum(case when r = 'assistant' then length(t) else 0 end)::bigint loss_chars,
sha256(coalesce(string_agg(case when r = 'assistant' then t end, '' order by turn, r, t), '')) loss_sha256,
sum(14 + length(r) + length(r) - length(translate(r, '\\<#:', '')) + length(t) + length(t) - length(translate(t, '\\<#', '')))::bigint formatted_chars from c group by all"""


def _tree(name: str, start: str, levels: int = 9) -> str:
    """CTEs of a tree over ``start`` (t, p, h): at level k nodes with their number c and what stands before (b) and after (a) them in their run."""
    out = [f"{name}0n as ({start})"]
    for k in range(levels):
        run = "over (partition by t, p // 8 order by p rows between"
        out.append(f"{name}{k} as (select *, count(*) over (partition by t) c, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') b, coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') a from {name}{k}n)")
        out.append(f"{name}{k + 1}n as (select t, p // 8 p, case when max(c) > 1 then sha256(string_agg(h, '' order by p)) else max(h) end h from {name}{k} group by t, p // 8)")
    return ", ".join(out)


def _path(name: str, start: str, levels: int = 9) -> str:
    """CTEs that take ``start`` (id, leaf, t, p, f, proof) up a tree: f becomes the folded digest, proof the siblings so far."""
    out = [f"{name}p0 as ({start})"]
    for k in range(levels):
        out.append(f"{name}p{k + 1} as (select x.* exclude (p, f, proof), x.p // 8 p, case when c > 1 then sha256(b || f || a) else f end f, case when c > 1 then proof || b || a else proof end proof from {name}p{k} x join {name}{k} y on x.t = y.t and x.p = y.p)")
    return ", ".join(out)


def _crc32(text: str) -> str:
    """Of the ASCII text of an integer: a bit at a time, as SQL has no such function."""
    bit = "lambda x, y: xor(x // 2, 3988292384::ubigint * (x % 2))"
    byte = f"lambda c, v: list_reduce(list_prepend(xor(c, v), list_transform(range(8), lambda z: z::ubigint)), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::ubigint)), {byte}), 4294967295::ubigint)"


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::varchar)) || ':' || ({value})::varchar, '-')"


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"
OP11 = f"""with d as (select doc_id id, coalesce('1' || lang, '0') t, sha256({" || ".join(map(_framed, FIELDS))}) leaf, sha256({" || ".join(_framed(_LOWERED if c == "text" else c) for c in FIELDS)}) lowered, {_crc32("doc_id::varchar")} % 3 = 0 tampered from documents),
o as (select *, row_number() over (partition by t order by id nulls first, leaf) - 1 p from d), {_tree("l", "select t, p, leaf h from o")}, r as (select t, max(h) h from l9n group by t),
{_tree("r", "select 'all' t, row_number() over (order by t) - 1 p, h from r")}, {_path("l", "select id, leaf, t, p, case when tampered then lowered else leaf end f, '' proof from o")},
{_path("r", "select id, leaf, r.h subroot, 'all' t, g.p, f, proof from lp9 join r using (t) join (select t, row_number() over (order by t) - 1 p from r) g using (t)")}
select id doc_id, leaf, subroot, h.h root, sha256(proof) proof_sha256, f folded_root, f = h.h verified from rp9 join r9n h using (t)"""

OP13 = """with e as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda v: floor(256 * v::double)::bigint::double) x from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
s as (select a.id a, e.id o, a.label = e.label same, list_inner_product(a.x, e.x)::bigint s from e a join e on a.id % 50 = 0 and a.id <> e.id),
p as (select a, o p, s ps from (select *, row_number() over (partition by a order by s desc, o) n from s where same) where n <= 5),
n as (select a, p, ps, o, s, row_number() over (partition by a, p order by s desc, o) n from p join s using (a) where not same and 50 * ps <= 100 * s and 100 * s <= 95 * ps)
select a anchor_id, p positive_id, n::int rank, o negative_id, ps positive_score, s negative_score from n where n <= 3"""

ORACLE_SQL = {"op1_jaccard_join": OP1, "op2_quality_rules": OP2, "op8_decontaminate": OP8, "op9_substring_dedup": OP9, "op10_chat_format": OP10, "op11_merkle": OP11, "op13_hard_negatives": OP13}

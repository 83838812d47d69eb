"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from sextant.llm.rules import CHAR_CLASSES, COMMON

WORD = "[^\\x20\\x09-\\x0D]+"

_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr({x}, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::int, 1)), '')"""

OP1 = f"""with p as (select page_id, coalesce(html, '') h from pages), f as (select h, min(page_id) m from p group by h)
select page_id, strlen(h)::bigint payload_bytes, {_BASE32.format(x="sha1(h)")} payload_digest, case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to, 0::bigint archive_gaps from p join f using (h)"""

OP2 = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
s as (select doc_id, i, array_to_string(w[i:i+19], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 18)) i from d)),
c as (select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 again from s),
p as (select doc_id, j, w[j] x from (select doc_id, w, unnest(range(1, len(w) + 1)) j from d)),
g as (select p.doc_id, p.j, p.x, coalesce(bool_or(c.again) over (partition by p.doc_id order by p.j rows between 19 preceding and current row), false) gone from p left join c on c.doc_id = p.doc_id and c.i = p.j),
r as (select doc_id, count(*) n, count(*) filter (gone) m, sha256(coalesce(string_agg(x, ' ' order by j) filter (not gone), '')) h from g group by doc_id)
select d.doc_id, coalesce(n, 0) n_words, coalesce(m, 0) n_removed, coalesce(h, sha256('')) kept_sha256 from d left join r on r.doc_id = d.doc_id"""

OP3 = f"""with e as (select *, md5(concat_ws(':', coalesce(doc_id::varchar, '-'), coalesce(source, '-'), coalesce(md5(text), '-'))) g from documents),
n as (select *, row_number() over (partition by g) - 1 again from e),
d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint size, ('0x' || substr(case when again > 0 then md5(g || ':' || again) else g end, 1, 15))::bigint h from n),
p as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double w, source_size * 2.0::double cap from p),
o as (select *, 1.5::double * sum(source_size) over () total, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) cb, coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) wb, sum(w) over () wt from w),
q as (select *, cap * (wt - wb) <= (total - cb) * w capped from o),
t as (select source, source_size, round(case when capped then cap else (total - sum(case when capped then cap else 0 end) over ()) / (wt - sum(case when capped then w else 0 end) over ()) * w end, 6) target from q),
x as (select d.*, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end whole, sum(size) over (partition by d.source order by h) upto, sum(size) over (partition by d.source, h) grp from d join t on d.source is not distinct from t.source),
b as (select *, target - whole * source_size budget from x)
select doc_id, size, source_size, target, (size * (whole + case when target > whole * source_size and (upto <= budget or (upto - grp <= budget and (budget - (upto - grp)) * 2 >= grp)) then 1 else 0 end))::bigint taken from b"""

OP7 = f"""with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w from documents),
s as materialized (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end) g from d),
n as materialized (select doc_id, count(*) n from s group by doc_id),
l as materialized (select a.doc_id a, b.doc_id b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen),
c as (select node, min(seen) component_id from r group by node)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept from d left join n on n.doc_id = d.doc_id join c on c.node = d.doc_id"""

OP10 = """with d as (select doc_id, hex(coalesce(text, '')) x, strlen(coalesce(text, ''))::bigint n from documents),
p as (select doc_id, unnest(range(1, n + 1)) j, unnest(list_transform(range(1, n + 1), lambda j: case when j <= n - 99 then md5_number(substr(x, (2 * j - 1)::int, 200)) end)) k, unnest(list_transform(range(1, n + 1), lambda j: substr(x, (2 * j - 1)::int, 2))) y from d),
f as (select k, min(doc_id * 1000000000 + j) first from p where k is not null group by k),
g as (select doc_id, j, y, bool_or(coalesce(doc_id * 1000000000 + j > first, false)) over (partition by doc_id order by j rows between 99 preceding and current row) gone from p left join f using (k)),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by j), false) opens from g),
r as (select doc_id, count(*) filter (gone) m, count(*) filter (opens) s, coalesce(string_agg(y, '' order by j) filter (not gone), '') k from e group by doc_id)
select d.doc_id, n n_bytes, coalesce(m, 0) n_removed, coalesce(s, 0) n_spans, sha256(unhex(coalesce(k, ''))) kept_sha256 from d left join r on r.doc_id = d.doc_id"""


def _rules() -> str:
    n, m = len(CHAR_CLASSES) + 1, COMMON + 1
    counts = ", ".join(f"len(regexp_extract_all(t, '{p}')) c_{k}" for k, p in CHAR_CLASSES.items())
    rest = " - ".join(["length(t)", *[f"c_{k}" for k in CHAR_CLASSES]])
    js = lambda p, q, n: (f"(case when list_sum({p}) > 0 and list_sum({q}) > 0 then sqrt(greatest(0, list_sum(list_transform(range(1, {n + 1}), lambda i: case when {p}[i] > 0 then {p}[i] / list_sum({p}) * log2({p}[i] / list_sum({p}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0 end"  # noqa: E731
                          f" + case when {q}[i] > 0 then {q}[i] / list_sum({q}) * log2({q}[i] / list_sum({q}) / (({p}[i] / list_sum({p}) + {q}[i] / list_sum({q})) / 2)) else 0 end)) / 2)) else 0 end)")
    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{i}]), 0)::double" for i in range(1, n + 1)) + "]"
    return f"""with d as (select doc_id, coalesce('l' || lang, '') lk, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
k as (select doc_id, i, array_to_string(w[i:i+4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) > 1 again from k), z as (select distinct doc_id, unnest(range(i, i + 5)) j from c where again), y as (select doc_id, count(*) n from z group by doc_id),
u as (select lk, word, count(*) n from (select lk, unnest(list_distinct(w)) word from d) group by all), v as (select lk, word, row_number() over (partition by lk order by n desc, word) r from u qualify r <= {COMMON}), cw as (select lk, list(word order by r) words from v group by lk),
b as (select d.doc_id, d.lk, t, w, words, len(w)::bigint n_words, coalesce(y.n, 0)::bigint n_repeat_words, {counts}, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d left join y on y.doc_id = d.doc_id left join cw on cw.lk = d.lk),
f as (select *, list_transform(range(1, {m}), lambda i: len(list_filter(w, lambda x: x = words[i]))) cc from b),
e as (select *, [{', '.join(f'c_{x}' for x in CHAR_CLASSES)}, {rest}] chars, list_append(cc, n_words - coalesce(list_sum(cc), 0)::bigint) common, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from f),
r as (select lk, sum(n_words) rw, {sums('chars', n)} rc, {sums('common', m)} ro from e where not base_failed group by 1)
select doc_id, n_words, (length(t) - c_space)::bigint word_chars, c_symbol::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, n_repeat_words, base_failed,
not base_failed and not (n_words >= 50 and coalesce(rw, 0) >= 1000 and ({js('chars', 'rc', n)} > 0.22 or {js('common', 'ro', m)} > 0.30)) kept from e left join r on r.lk = e.lk"""


ORACLE: dict[str, str] = {"op1_warc": OP1, "op2_substring_dedup": OP2, "op3_mixing": OP3, "op7_near_duplicates": OP7, "op8_quality_rules": _rules(), "op10_suffix_dedup": OP10}

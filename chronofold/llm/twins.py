"""DuckDB twins of the operators that SQL can run over the whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

REPEATS = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
    win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h
            from w, unnest(range(1, len(ws) - 48)) as r(i)),
    first as (select h, min(doc_id) as f from win group by 1),
    gone as (select distinct doc_id, i + j as pos from win join first using (h),
                    unnest(range(0, 50)) as r(j) where f < doc_id),
    word as (select doc_id, pos, ws[pos] as word from w, unnest(range(1, len(ws) + 1)) as r(pos)),
    kept as (select doc_id, string_agg(word, ' ' order by pos) as text
             from word anti join gone using (doc_id, pos) group by 1),
    lost as (select doc_id, count(*) as n from gone group by 1)
    select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(lost.n, 0) as n_removed,
           sha256(coalesce(kept.text, '')) as kept_sha256
    from w left join lost using (doc_id) left join kept using (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as ws from documents),
    s as (select distinct doc_id, md5(array_to_string(ws[i:i + 3], ' ')) as h
          from w, unnest(range(1, greatest(len(ws) - 2, 2))) as r(i) where len(ws) > 0),
    n as (select doc_id, count(*) as n from s group by 1),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (h)
          where a.doc_id <> b.doc_id group by 1, 2),
    l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * c >= 85 * (x.n + y.n - c)),
    reach as (select a, b from l union select reach.a, l.b from reach join l on l.a = reach.b),
    low as (select a as doc_id, min(b) as low from reach group by 1)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, low.low) as component_id
    from w left join n using (doc_id) left join low using (doc_id)"""

_RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
_SUMS = ", ".join(f"sum({r}::int) as {r}" for r in _RULES)


def _prior(rule: str) -> str:
    """Mean and strength of the beta prior of one rule, as in ``quality``."""
    return f"""p_{rule} as (select m, case when m * (1 - m) <= 0 or v <= 0 then 1e6
            else least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) end as s
          from (select sum({rule}) / sum(n) as m,
                       sum({rule} * {rule} / n) / sum(n) - power(sum({rule}) / sum(n), 2)
                       - (sum({rule}) / sum(n)) * (1 - sum({rule}) / sum(n)) * count(*) / sum(n) as v
                from (select n::double as n, {rule}::double as {rule} from hosts)))"""


QUALITY = rf"""with w as (select doc_id, source, coalesce(text, '') as text,
            regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
    chars as (select doc_id, sum(length(x)) as word_chars from w, unnest(ws) as r(x) group by 1),
    five as (select doc_id, i, md5(array_to_string(ws[i:i + 4], ' ')) as h
             from w, unnest(range(1, len(ws) - 3)) as r(i)),
    twice as (select doc_id, h from five group by 1, 2 having count(*) > 1),
    rep as (select doc_id, count(distinct i + j) as n from five join twice using (doc_id, h),
            unnest(range(0, 5)) as r(j) group by 1),
    line as (select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n
             from w, unnest(string_split(text, chr(10))) as r(x)
             where regexp_matches(x, '{_WORD}') group by 1),
    m as (select w.doc_id, w.source, cast(len(ws) as bigint) as n_words,
            cast(coalesce(word_chars, 0) as bigint) as word_chars,
            cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
            coalesce(line.n, 0) as n_dup_lines, coalesce(line.n_lines, 0) as n_lines,
            coalesce(rep.n, 0) as n_repeat_words
          from w left join chars using (doc_id) left join line using (doc_id) left join rep using (doc_id)),
    c as (select *, n_words < 10 as few_words, 100 * n_repeat_words > 20 * n_words as repeats,
            100 * n_symbols > 50 * n_words as symbols, 100 * n_dup_lines > 50 * n_lines as dup_lines,
            not word_chars::double / greatest(n_words, 1) between 2 and 20 as word_length,
            nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(source)),
              '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', ''), '^www\.', ''), '') as host from m),
    hosts as (select host, count(*) as n, {_SUMS} from c where host is not null group by 1),
    {", ".join(_prior(r) for r in _RULES)},
    bad as (select host, greatest({", ".join(f"(hosts.{r} + p_{r}.m * p_{r}.s) / (n + p_{r}.s)" for r in _RULES)})
              > 0.5 as host_rejected from hosts, {", ".join(f"p_{r}" for r in _RULES)})
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           few_words or repeats as base_failed,
           not (few_words or repeats) and not coalesce(host_rejected, false) as kept,
           coalesce(host_rejected, false) as host_rejected
    from c left join bad using (host)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""with t as (select doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from documents),
    tf as (select doc_id, term, count(*) as tf from t group by all),
    n as (select doc_id, count(*) as n from t group by 1),
    all_ as (select count(*) as docs, cast(sum(n) as bigint) as length from n),
    df as (select term, count(*) as df from tf group by 1),
    i as (select item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) as term from benchmark),
    q as (select item_id, term, count(*) as times from i group by all),
    s as (select item_id, doc_id, cast(sum(times * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
                 * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length))))) as bigint) as score
          from q join tf using (term) join df using (term) join n using (doc_id), all_ group by all),
    r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank,
                 doc_id, score from s where score > 0)
    select * from r where rank <= 10"""

_DIGEST = """sha256(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))"""
#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::ubigint],
        list_transform(string_split(cast(c as varchar), ''), lambda d: ascii(d)::ubigint)),
        lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: i::ubigint)),
            lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1)))))"""

PREFIX_TRIE = f"""with t as (select conv_id as c, {_DIGEST} as d, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as words,
              row_number() over (partition by conv_id order by turn nulls first, {_DIGEST}) - 1 as pos
         from conversations where conv_id is not null),
    k as (select c, count(*) as own, c - c % 20 as base, cast({_CRC} % 4 as bigint) as h from t group by c),
    m as (select k.*, least(k.h, coalesce(g.own, 0)) as head from k left join k g on g.c = k.base),
    r as (select m.c, t.pos, t.d, t.words from m join t on t.c = m.base where t.pos < m.h
          union all
          select m.c, t.pos - m.h + m.head, t.d, t.words from m join t on t.c = m.c where t.pos >= m.h),
    p as (select c, pos + 1 as depth, words, string_agg(d, '') over (partition by c order by pos) as path from r
          union all select c, 0, 0, '' from k),
    top as (select c, max(depth) as length from p group by 1),
    node as (select path, depth, min(p.c) as conv_id, count(*) as n, min(words) as words,
                    string_agg(cast(p.c as varchar), ',' order by p.c) filter (where length = depth) as ends
             from p join top using (c) group by 1, 2),
    kids as (select left(path, length(path) - 64) as path, count(*) as n_children from node where depth > 0 group by 1),
    full_ as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (path)),
    up as (select p.path, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves,
                  sum((f.n - 1) * f.words) as saved
           from full_ f join p on p.c = f.conv_id and p.depth <= f.depth group by 1)
    select f.conv_id, f.depth, parent.conv_id as parent_conv_id, f.n as n_convs, f.n_children,
           cast(up.n_leaves as bigint) as n_leaves, cast(up.saved as bigint) as saved_tokens,
           sha256(coalesce(f.ends, '')) as ends_sha256
    from full_ f join up using (path)
    left join node parent on f.depth > 0 and parent.path = left(f.path, length(f.path) - 64)"""

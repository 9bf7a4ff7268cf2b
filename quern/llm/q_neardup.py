"""Queries of problem 1."""

from quern.llm.common import table
from quern.llm.neardup import groups, row_pairs, similar_classes


def p1_found(spark, sf_dir):
    links, members = similar_classes(table(spark, sf_dir, "stream_stack_all", "seq", "content"))
    return row_pairs(links, members)


def p1_groups(spark, sf_dir):
    return groups(*similar_classes(table(spark, sf_dir, "stream_stack_all", "seq", "content")))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

#: White space but the newline, for the oracle's dialect.
_BLANK = r"\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The exact join by prefix filter: pairs at the threshold share one of the rarest 15 % of either text's substrings.
SQL = {
    "p1_found": rf"""
with n as (select seq, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(content), '[{_BLANK}]+', ' ', 'g'), '^[{_BLANK}\n]+', ''), '[{_BLANK}\n]+$', '') as t from stream_stack_all where content is not null),
s as (select seq, unnest(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) as g from n where length(t) >= 100),
f as (select g, count(*) as df from s group by g),
r as (select seq, g, row_number() over (partition by seq order by df, g) as k, count(*) over (partition by seq) as size from s join f using (g)),
p as (select seq, g, size from r where k <= size - ceil(0.85 * size) + 1),
c as (select distinct a.seq as a, b.seq as b, a.size as x, b.size as y from p a join p b on a.g = b.g and a.seq < b.seq where least(a.size, b.size) >= 0.85 * greatest(a.size, b.size)),
j as (select a, b, any_value(x) as x, any_value(y) as y, count(*) as shared from c join s u on u.seq = c.a join s v on v.seq = c.b and v.g = u.g group by a, b)
select a as seq_a, b as seq_b from j where shared / cast(x + y - shared as double) >= cast(0.85 as double)
"""
}

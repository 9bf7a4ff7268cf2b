"""Queries of problem 5."""

from quern.llm.mixture import mix, quotas, shares, sources


def _inputs(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sizes = sources(
        read("stream_stack_all"),
        read("stream_stackoverflow"),
        read("fetch_repo_py_files"),
        read("curated_repos"),
    )
    return sizes, read("mixture_targets")


def p5_mix(spark, sf_dir):
    return mix(*_inputs(spark, sf_dir))


def p5_shares(spark, sf_dir):
    sizes, targets = _inputs(spark, sf_dir)
    return shares(mix(sizes, targets), sizes, targets)


def p5_quotas(spark, sf_dir):
    return quotas(*_inputs(spark, sf_dir))


QUERIES = {"p5_mix": p5_mix, "p5_shares": p5_shares, "p5_quotas": p5_quotas}

SQL = {
    "p5_quotas": r"""
with q as (
  select AcceptedAnswerId as answer_id, arg_max(length(Body), seq) as n from stream_stackoverflow
  where PostTypeId = 1 and coalesce(Score, 0) >= 5 and AcceptedAnswerId is not null and coalesce(Body, '') <> ''
    and len(list_filter(coalesce(Tags, []), lambda t: contains(lower(coalesce(t, '')), 'python'))) > 0
  group by 1),
s as (
  select 'stack' as source, length(content) as size from stream_stack_all
  where regexp_matches(content, '[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') and (max_stars_repo_name is null or max_stars_repo_name not in (select repo from curated_repos))
  union all
  select 'stackoverflow', length(a.Body) + q.n + 20 from stream_stackoverflow a join q on a.Id = q.answer_id where a.PostTypeId = 2 and coalesce(a.Body, '') <> ''
  union all
  select r.tag, length(f.content) from fetch_repo_py_files f join (select distinct repo, tag from curated_repos) r using (repo)
  where regexp_matches(f.content, '[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')),
h as (select source, count(*) as n, cast(sum(size) as bigint) as c from s group by 1),
t as (select m.source, m.target_share, m.max_repeats, coalesce(h.n, 0) as available_rows, coalesce(h.c, 0) as available_chars from mixture_targets m left join h using (source)),
w as (select available_chars / target_share as total from t where source = 'stack'),
x as (select t.*, cast(round(target_share * total) as bigint) as quota_chars from t, w)
select source, target_share, max_repeats, available_rows, available_chars, quota_chars, quota_chars > available_chars * max_repeats as capped from x
"""
}

"""The core queries: operators over the tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.catalog import query
from quern.functions import tokens as tok
from quern.functions.pyast import python_features
from quern.functions.text import WS, function_name, indented_prompt, inserted, joined_parts, line_stats, lines, newline_count, normalised, strip, truncated
from quern.operators import curriculum, dedup, evaluation, packing, quality, training, vectors
from quern.operators.qa import accepted_pairs, documents
from quern.plans.durable import fresh_path
from quern.sources import packed, tables
from quern.sources.tables import spread, table

# Classes of the same characters in the dialect of the oracle.
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HWS = _WS.replace(r"\n", "", 1)


def _lines(c: str) -> str:
    return f"(select case when p[len(p)] = '' then p[1:len(p)-1] else p end from (select regexp_split_to_array({c}, '{_BREAK}') as p))"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{_WS}]+', ''), '[{_WS}]+$', '')"


def _solid(c: str) -> str:
    return f"regexp_matches({c}, '[^{_WS}]')"


def _stack(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "stream_stack_all")


# -- scans ------------------------------------------------------------------------------------------------------------
@query("""
select seq, coalesce(max_stars_repo_name, '') as repo, length(content) as n_chars from stream_stack_all
where coalesce(content, '') <> '' and coalesce(max_stars_repo_name, '') not in (select repo from curated_repos)
""")
def scan_stack(spark, sf_dir):
    """The general code scan without empty contents and without the repositories that are fetched directly."""
    rows = tables.code_rows(_stack(spark, sf_dir).select("seq", "content", "max_stars_repo_name"), table(spark, sf_dir, "curated_repos"))
    return rows.select("seq", "repo", F.length("content").alias("n_chars"))


@query("""
select seq, length(content) as n_chars from stream_stack_all
where coalesce(content, '') <> '' and coalesce(max_stars_repo_name, '') not in (select repo from curated_repos) order by seq limit 500
""")
def scan_stack_limit(spark, sf_dir):
    """O1: the first accepted rows in scan order; the limit is the operator."""
    return scan_stack(spark, sf_dir).select("seq", "n_chars").orderBy("seq").limit(500)


@query("""
select repo, count(*) as files, cast(sum(length(content)) as bigint) as chars from (
  select coalesce(max_stars_repo_name, '') as repo, content from stream_stack_all where coalesce(content, '') <> '')
where repo not in (select repo from curated_repos) group by repo
""")
def repo_sizes(spark, sf_dir):
    """J2 with an aggregate: files and characters by repository; the null and the empty name are one."""
    return scan_stack(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query("select seq, length(content) as n_chars from stream_stack_all where lang = 'Python' and length(content) >= 50")
def scan_language(spark, sf_dir):
    """Rows of one language with at least 50 characters."""
    return tables.corpus_rows(_stack(spark, sf_dir), "Python").select("seq", F.length("content").alias("n_chars"))


@query("""
select count(*) filter (ok) as files_collected, count(*) filter (not right_lang) as skipped_language, count(*) filter (right_lang and not ok) as skipped_short,
  cast(coalesce(sum(n) filter (ok), 0) as bigint) as total_chars, round_even(coalesce(avg(n) filter (ok), 0), 1) as avg_chars
from (select lang = 'Python' as right_lang, coalesce(lang = 'Python' and length(content) >= 50, false) as ok, length(content) as n from stream_stack_all)
""")
def corpus_stats(spark, sf_dir):
    """What the corpus scan collects and skips, in one pass."""
    right = F.col("lang") == "Python"
    ok = F.coalesce(right & (F.length("content") >= 50), F.lit(False))
    n = F.length("content")
    return _stack(spark, sf_dir).agg(
        F.count(F.when(ok, 1)).alias("files_collected"),
        F.count(F.when(~right, 1)).alias("skipped_language"),
        F.count(F.when(right & ~ok, 1)).alias("skipped_short"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("total_chars"),
        F.bround(F.coalesce(F.avg(F.when(ok, n)), F.lit(0.0)), 1).alias("avg_chars"),
    )


def _quota_sql(tag: str, limit: int, parts: int) -> str:
    return f"""
select repo, file_seq, rank from (
  select f.repo, f.file_seq, row_number() over (partition by f.repo order by f.file_path, f.file_seq) as rank
  from fetch_repo_py_files f join (select distinct repo from curated_repos where tag = '{tag}') r using (repo)
  where f.content is not null and {_solid("f.content")})
where rank <= {max(1, limit // parts)} order by repo, rank limit {limit}
"""


@query(_quota_sql("curated", 300, 5))
def curated_quota(spark, sf_dir):
    """Files of the curated repositories, a fifth of the limit each; the quota is the operator."""
    return tables.quota(table(spark, sf_dir, "fetch_repo_py_files"), table(spark, sf_dir, "curated_repos"), "curated", 300, 5).select("repo", "file_seq", "rank")


@query(_quota_sql("stdlib", 500, 2))
def stdlib_quota(spark, sf_dir):
    """S3: files of the standard-library repositories, half of the limit each."""
    return tables.quota(table(spark, sf_dir, "fetch_repo_py_files"), table(spark, sf_dir, "curated_repos"), "stdlib", 500, 2).select("repo", "file_seq", "rank")


@query("select distinct repo from (select repo from curated_repos where tag = 'curated' union all select repo from curated_repos where tag = 'stdlib')")
def skip_repos(spark, sf_dir):
    """The union of the repositories fetched directly."""
    repos = table(spark, sf_dir, "curated_repos")
    return repos.filter("tag = 'curated'").select("repo").union(repos.filter("tag = 'stdlib'").select("repo")).distinct()


_QA = """
with q as (select AcceptedAnswerId as answer_id, arg_max(Body, seq) as question from stream_stackoverflow
  where PostTypeId = 1 and coalesce(Score, 0) >= 5 and AcceptedAnswerId is not null and coalesce(Body, '') <> ''
    and len(list_filter(coalesce(Tags, []), lambda t: contains(lower(coalesce(t, '')), 'python'))) > 0 group by 1),
d as (select a.seq, 'Question:' || chr(10) || q.question || chr(10) || chr(10) || 'Answer:' || chr(10) || a.Body as text
  from stream_stackoverflow a join q on a.Id = q.answer_id where a.PostTypeId = 2 and coalesce(a.Body, '') <> '')
"""


def _qa(spark, sf_dir) -> DataFrame:
    return documents(accepted_pairs(table(spark, sf_dir, "stream_stackoverflow")))


@query(_QA + "select seq, length(text) as n_chars, md5(text) as digest from d")
def qa_documents(spark, sf_dir):
    """Accepted answers with the last question that names them, in their template."""
    return _qa(spark, sf_dir).select("seq", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("""
select answer_id, count(*) as questions, max(seq) as last_seq from (
  select AcceptedAnswerId as answer_id, seq from stream_stackoverflow where PostTypeId = 1 and AcceptedAnswerId is not null) group by 1
""")
def qa_last_wins(spark, sf_dir):
    """J1, build side: how many questions name an answer and which came last."""
    posts = table(spark, sf_dir, "stream_stackoverflow").filter("PostTypeId = 1 and AcceptedAnswerId is not null")
    return posts.groupBy(F.col("AcceptedAnswerId").alias("answer_id")).agg(F.count(F.lit(1)).alias("questions"), F.max("seq").alias("last_seq"))


_TAGGED = f"""
, u as (
  select 0 as rank, file_seq as id, f.content as text, 'curated' as tag from fetch_repo_py_files f join (select distinct repo from curated_repos where tag = 'curated') r using (repo) where {_solid("f.content")}
  union all select 1, file_seq, f.content, 'stdlib' from fetch_repo_py_files f join (select distinct repo from curated_repos where tag = 'stdlib') r using (repo) where {_solid("f.content")}
  union all select 2, seq, content, 'stack' from stream_stack_all where coalesce(content, '') <> '' and coalesce(max_stars_repo_name, '') not in (select repo from curated_repos)
  union all select 3, seq, text, 'stackoverflow' from d)
"""


def tagged(spark, sf_dir) -> DataFrame:
    """(rank, id, text, tag): the four sources in their order; (rank, id) is the order of the stream."""
    repos = table(spark, sf_dir, "curated_repos")
    files = table(spark, sf_dir, "fetch_repo_py_files").filter(F.col("content").isNotNull() & F.col("content").rlike(f"[^{WS}]"))
    own = files.join(F.broadcast(repos.filter(F.col("tag").isin("curated", "stdlib")).select("repo", "tag").distinct()), "repo")
    out = own.select(F.when(F.col("tag") == "curated", 0).otherwise(1).alias("rank"), F.col("file_seq").alias("id"), F.col("content").alias("text"), "tag")
    stack = tables.code_rows(_stack(spark, sf_dir).select("seq", "content", "max_stars_repo_name"), repos)
    out = out.unionByName(stack.select(F.lit(2).alias("rank"), F.col("seq").alias("id"), F.col("content").alias("text"), F.lit("stack").alias("tag")))
    return out.unionByName(_qa(spark, sf_dir).select(F.lit(3).alias("rank"), F.col("seq").alias("id"), "text", F.lit("stackoverflow").alias("tag")))


@query(_QA + _TAGGED + "select rank, id, tag, length(text) as n_chars from u")
def tagged_union(spark, sf_dir):
    return tagged(spark, sf_dir).select("rank", "id", "tag", F.length("text").alias("n_chars"))


# -- quality ----------------------------------------------------------------------------------------------------------
@query("select seq, length(content) as n_chars, length(content) - length(replace(content, chr(10), '')) as newlines from stream_stack_all where content is not null")
def newline_counts(spark, sf_dir):
    """F1, X1, X2."""
    rows = _stack(spark, sf_dir).filter("content is not null")
    return rows.select("seq", F.length("content").alias("n_chars"), newline_count("content").alias("newlines"))


@query(f"""
select seq, n_lines, long_lines, n_lines > 0 and long_lines / greatest(n_lines, 1) <= 0.2 as ok from (
  select seq, len(ls) as n_lines, len(list_filter(ls, lambda x: length(x) > 80)) as long_lines from (select seq, {_lines("content")} as ls from stream_stack_all where content is not null))
""")
def long_line_fraction(spark, sf_dir):
    """F2, X3 with 80 characters as the limit, so that values vary."""
    rows = spread(_stack(spark, sf_dir).filter("content is not null").select("seq", "content")).select("seq", line_stats("content", 80).alias("s"))
    return rows.select("seq", F.col("s.lines").alias("n_lines"), F.col("s.long").alias("long_lines"), quality.line_lengths_ok(F.col("s")).alias("ok"))


_COMMENTS = f"""len(list_filter(ls, lambda x: regexp_matches(x, '[^{_WS}]'))) as solid, len(list_filter(ls, lambda x: regexp_matches(x, '^[{_WS}]*#'))) as comments"""


@query(f"""
select seq, solid, comments, solid > 0 and comments / greatest(solid, 1) >= cast(0.01 as double) and comments / greatest(solid, 1) <= cast(0.8 as double) as ok
from (select seq, {_COMMENTS} from (select seq, {_lines("content")} as ls from stream_stack_all where content is not null))
""")
def comment_ratio(spark, sf_dir):
    """F3."""
    rows = spread(_stack(spark, sf_dir).filter("content is not null").select("seq", "content")).select("seq", line_stats("content").alias("s"))
    return rows.select("seq", F.col("s.solid").alias("solid"), F.col("s.marked").alias("comments"), quality.comment_ratio_ok(F.col("s")).alias("ok"))


_REASON = f"""
, f as (select tag, n, nl, len(ls) as k, len(list_filter(ls, lambda x: length(x) > 1000)) as longs, {_COMMENTS}
  from (select tag, length(text) as n, length(text) - length(replace(text, chr(10), '')) as nl, {_lines("text")} as ls from u)),
g as (select tag, case when n < 100 or nl < 5 then 'length' when k = 0 or longs / greatest(k, 1) > 0.2 then 'line_length'
  when solid = 0 or comments / greatest(solid, 1) < cast(0.01 as double) or comments / greatest(solid, 1) > cast(0.8 as double) then 'comment_ratio' else 'passed' end as reason from f)
"""


@query(_QA + _TAGGED + _REASON + "select tag, reason, count(*) as n from g group by all")
def quality_reason_counts(spark, sf_dir):
    """The first cheap predicate that a text fails, by source."""
    return quality.with_cheap_reason(spread(tagged(spark, sf_dir).select("tag", "text")), "text").groupBy("tag", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_QA + _TAGGED + _REASON + "select count(*) as total, count(*) filter (reason = 'passed') as passed, count(*) filter (reason = 'passed') * cast(100 as double) / greatest(count(*), 1) as pass_pct from g")
def quality_pass_rate(spark, sf_dir):
    """A1: the pass rate of the cheap predicates."""
    ok = F.count(F.when(F.col("reason") == "passed", 1))
    n = F.count(F.lit(1))
    return quality.with_cheap_reason(spread(tagged(spark, sf_dir).select("text")), "text").agg(n.alias("total"), ok.alias("passed"), (ok * F.lit(100.0) / F.greatest(n, F.lit(1))).alias("pass_pct"))


@query()
def quality_cascade(spark, sf_dir):
    """The whole cascade with syntax and the docstring that only texts of the tag stack need."""
    return quality.cascade(spread(tagged(spark, sf_dir)), "text", "tag").groupBy("tag", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def ast_features(spark, sf_dir):
    """One parse a row."""
    rows = spread(_stack(spark, sf_dir).filter("lang = 'Python' and content is not null").select("seq", "content"))
    return rows.select("seq", python_features(F.col("content")).alias("f")).select("seq", "f.*")


# -- normal forms and duplicates --------------------------------------------------------------------------------------
_NORMAL = _strip(f"regexp_replace(nfc_normalize(content), '[{_HWS}]+', ' ', 'g')")


@query(f"select seq, length(t) as n_chars, md5(t) as digest from (select seq, {_NORMAL} as t from stream_stack_all where content is not null)")
def normalize_text(spark, sf_dir):
    """Normal form C, runs of blanks to one, stripped."""
    rows = spread(_stack(spark, sf_dir).filter("content is not null").select("seq", "content")).select("seq", normalised("content").alias("t"))
    return rows.select("seq", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"select md5(t) as digest, min(seq) as first, count(*) as copies from (select seq, {_NORMAL} as t from stream_stack_all where content is not null) group by 1")
def exact_dedup(spark, sf_dir):
    """Distinct normalised texts, the first row of each."""
    return dedup.exact_dedup(spread(_stack(spark, sf_dir).select("seq", "content")))


@query(f"""
select seq, case when length(t) < 5 then 1 else len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5)))) end as shingles
from (select seq, {_NORMAL} as t from stream_stack_all where content is not null)
""")
def shingle_counts(spark, sf_dir):
    """Distinct 5-character substrings."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(shingles=[len(dedup.shingles(t)) for t in pdf["content"]])[["seq", "shingles"]].astype({"shingles": "int32"})

    return spread(_stack(spark, sf_dir).filter("content is not null").select("seq", "content")).mapInPandas(run, "seq long, shingles int")


@query()
def minhash_signatures(spark, sf_dir):
    """M: 128 minima of each text."""
    return dedup.signatures(spread(_stack(spark, sf_dir).select("seq", "content")))


@query()
def near_dedup_keep(spark, sf_dir):
    """Which rows the greedy keep-first removal keeps."""
    return dedup.near_dedup(spread(_stack(spark, sf_dir).select("seq", "content")))


@query()
def dedup_stats(spark, sf_dir):
    """A2."""
    return dedup.stats(near_dedup_keep(spark, sf_dir))


# -- curriculum -------------------------------------------------------------------------------------------------------
# Features that both dialects can count: lines, deepest indentation in fours, distinct words.
_SURROGATE = f"""
, s as (select rank, id, tag, n_lines, deep, words, 0.5e0 * (1 + n_lines / 50e0) + 0.3e0 * deep + 0.2e0 * (words / 20e0) as composite from (
  select rank, id, tag, len(ls) as n_lines, coalesce(list_max(list_transform(ls, lambda x: (length(x) - length(ltrim(x, ' '))) // 4)), 0) as deep,
    len(list_distinct(regexp_extract_all(text, '[A-Za-z_]+'))) as words from (select rank, id, tag, text, {_lines("text")} as ls from u))),
g as (select *, case when tag in ('curated', 'stdlib') then 3 when composite <= 5 then 1 else 2 end as stage from s)
"""


def _surrogate(spark, sf_dir) -> DataFrame:
    rows = spread(tagged(spark, sf_dir)).withColumn("ls", lines("text"))
    deep = F.coalesce(F.array_max(F.transform("ls", lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 4))), F.lit(0))
    words = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), F.lit(0))))
    rows = rows.select("rank", "id", "tag", "text", F.size("ls").alias("n_lines"), deep.alias("deep"), words.alias("words"))
    rows = rows.withColumn("composite", F.lit(0.5) * (1 + F.col("n_lines") / F.lit(50.0)) + F.lit(0.3) * F.col("deep") + F.lit(0.2) * (F.col("words") / F.lit(20.0)))
    return rows.withColumn("stage", curriculum.stage(F.col("composite"), F.col("tag")))


@query(_QA + _TAGGED + _SURROGATE + "select rank, id, stage, round(composite, 9) as composite from g")
def stage_rule(spark, sf_dir):
    """X15, X16 over features that SQL can count."""
    return _surrogate(spark, sf_dir).select("rank", "id", "stage", F.round("composite", 9).alias("composite"))


@query(_QA + _TAGGED + _SURROGATE + "select stage, count(*) as n, count(*) * cast(100 as double) / (select count(*) from g) as pct from g group by stage")
def stage_counts(spark, sf_dir):
    """A3."""
    return curriculum.counts(_surrogate(spark, sf_dir).select("stage"))


@query(_QA + _TAGGED + _SURROGATE + "select stage, pass, rank, id from (select *, unnest(case when stage = 3 then [0, 1, 2] else [0] end) as pass from g)")
def curriculum_order(spark, sf_dir):
    """Every row with the pass in which it comes; (stage, pass, rank, id) is the order."""
    return curriculum.ordered(_surrogate(spark, sf_dir).select("stage", "rank", "id")).select("stage", "pass", "rank", "id")


_TOKENS = "len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda x: x <> '')) + 1"


def _words(c: str = "text"):
    return F.size(F.filter(F.split(c, r"[ \n\t\r]+", -1), lambda x: x != "")) + 1


@query(_QA + _TAGGED + _SURROGATE.replace("select rank, id, tag, n_lines", f"select rank, id, tag, n_tokens, n_lines").replace("as words from (select", f"as words, {_TOKENS} as n_tokens from (select") + """
, b as (select stage, cast(sum(n_tokens) * max(case when stage = 3 then 3 else 1 end) as bigint) as tokens from g group by stage)
select stage, tokens, cast(sum(tokens) over (order by stage) as bigint) as end_token from (select cast(s.stage as int) as stage, coalesce(b.tokens, 0) as tokens from (select unnest([1, 2, 3]) as stage) s left join b on s.stage = b.stage)
""")
def stage_boundaries(spark, sf_dir):
    """A4, A5: where the stages end, counted in white-space words and an end mark a text."""
    return curriculum.boundaries(_surrogate(spark, sf_dir).select("stage", _words().cast("long").alias("n_tokens")))


@query()
def complexity_stages(spark, sf_dir):
    """Stages by the syntax trees."""
    rows = curriculum.scored(spread(tagged(spark, sf_dir).select("rank", "id", "tag", "text")), "text")
    return rows.select("rank", "id", "tag", "cyclomatic", "max_nesting", "unique_identifiers", "composite", curriculum.stage(F.col("composite"), F.col("tag")).alias("stage"))


# -- packing ----------------------------------------------------------------------------------------------------------
_PACK = _QA + _TAGGED + f", t as (select rank, id, {_TOKENS} as n_tokens from u), o as (select rank, id, n_tokens, cast(coalesce(sum(n_tokens) over (order by rank, id rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos from t), z as (select cast(sum(n_tokens) as bigint) as total from t)"


def _placed(spark, sf_dir) -> DataFrame:
    rows = tagged(spark, sf_dir).select("rank", "id", _words().cast("long").alias("n_tokens"))
    return packing.offsets(rows, ["rank", "id"])


@query(_PACK + " select rank, id, n_tokens, start_pos from o")
def token_offsets(spark, sf_dir):
    """The position of each text in the packed stream, by two-phase sums."""
    return _placed(spark, sf_dir).select("rank", "id", "n_tokens", "start_pos")


@query(_PACK + " select count(*) as total_files, cast(sum(n_tokens) as bigint) as total_tokens, sum(n_tokens) * cast(2 as double) / 1073741824 as size_gb, count(*) * 512 as estimated_tokens from t")
def pack_totals(spark, sf_dir):
    """A6, X17."""
    rows = tagged(spark, sf_dir).select(_words().cast("long").alias("n_tokens"))
    return rows.agg(F.count(F.lit(1)).alias("total_files"), F.sum("n_tokens").alias("total_tokens"), (F.sum("n_tokens") * F.lit(2.0) / 1073741824).alias("size_gb"), (F.count(F.lit(1)) * 512).alias("estimated_tokens"))


@query(_PACK + " select rank, id, start_pos // 2048 as first_chunk, least((start_pos + n_tokens - 1) // 2048, total // 2048 - 1) as last_chunk from o, z where start_pos // 2048 < total // 2048")
def chunk_assign(spark, sf_dir):
    """The chunks that each text reaches into; the remainder is dropped."""
    placed = _placed(spark, sf_dir)
    total = placed.agg(F.sum("n_tokens")).first()[0] or 0
    return packing.chunk_span(placed, total).select("rank", "id", "first_chunk", "last_chunk")


def _chunks(spark, sf_dir) -> int:
    return (tagged(spark, sf_dir).agg(F.sum(_words())).first()[0] or 0) // packing.CHUNK


_SPLIT = _PACK + ", c as (select unnest(range(0, total // 2048)) as chunk_id from z), k as (select chunk_id, row_number() over (order by md5(chunk_id || '-42'), chunk_id) as r, count(*) over () as n from c)"


@query(_SPLIT + " select chunk_id from k where r <= greatest(1, cast(floor(n * cast(0.05 as double)) as bigint))")
def val_split(spark, sf_dir):
    """An exact-size sample of the chunks by hash order."""
    return packing.chunk_split(spark, _chunks(spark, sf_dir)).filter("split = 'val'").select("chunk_id")


@query(_SPLIT + " select chunk_id from k where r > greatest(1, cast(floor(n * cast(0.05 as double)) as bigint))")
def train_split(spark, sf_dir):
    """U4: all other chunks."""
    return packing.chunk_split(spark, _chunks(spark, sf_dir)).filter("split = 'train'").select("chunk_id")


@query("""
with b(stage, lo, hi) as (values (1, 0, 700), (2, 700, 1500), (3, 1500, 2400)) select c.chunk_id, b.stage from (select unnest(range(0, 2400)) as chunk_id) c join b on c.chunk_id >= b.lo and c.chunk_id < b.hi
""")
def stage_of_chunk(spark, sf_dir):
    """The stage of a position by a range join with a table of three rows."""
    b = F.broadcast(spark.createDataFrame([(1, 0, 700), (2, 700, 1500), (3, 1500, 2400)], "stage int, lo long, hi long"))
    c = spark.range(2400).select(F.col("id").alias("chunk_id"))
    return c.join(b, (F.col("chunk_id") >= F.col("lo")) & (F.col("chunk_id") < F.col("hi"))).select("chunk_id", "stage")


@query(_PACK + """, n as (select total, (total - 1) // 1024 as per from z)
select g as row, g // 8 as batch, g // per as epoch, (g % per) * 1024 as start from (select unnest(range(0, 3 * per)) as g, per from n)""")
def batch_rows(spark, sf_dir):
    """Three epochs of training rows in closed form."""
    total = tagged(spark, sf_dir).agg(F.sum(_words())).first()[0]
    return packing.batch_rows(spark, total, 1024, 3 * ((total - 1) // 1024), 8)


@query()
def packed_roundtrip(spark, sf_dir):
    """Texts encoded with an end mark, written as 16-bit ids in stream order, and read again."""
    packed.register(spark)
    rows = packed.arranged(tagged(spark, sf_dir).select("rank", "id", "text"), ["rank", "id"])
    folder = fresh_path(spark, "packed").removeprefix("file://")
    said = packed.write(rows.select("rank", "id", tok.encode(F.col("text"), add_eof=True).alias("ids")), "ids", folder)
    got = spark.read.format("packed_tokens").option("path", folder).load()
    end = tok.special_ids()["eof"]
    out = got.agg(F.count(F.lit(1)).alias("tokens_read"), F.sum((F.col("token") == end).cast("int")).alias("end_marks"), (F.max("pos") + 1).alias("positions"))
    return out.select("*", F.lit(said["total_tokens"]).alias("tokens_written"), F.lit(said["total_files"]).alias("files"), F.lit(packed.token_count(folder)).alias("tokens_by_size"))


# -- tokenizer --------------------------------------------------------------------------------------------------------
@query()
def encoded_lengths(spark, sf_dir):
    """Token counts with the end mark."""
    rows = spread(tagged(spark, sf_dir).select("rank", "id", "text"))
    return rows.select("rank", "id", F.size(tok.encode(F.col("text"), add_eof=True)).alias("n_tokens"))


@query()
def decode_roundtrip(spark, sf_dir):
    """How many texts come back as they were (all do)."""
    rows = spread(_stack(spark, sf_dir).filter("content is not null").select("content"))
    return rows.select((tok.decode(tok.encode(F.col("content"))) == F.col("content")).alias("same")).groupBy("same").agg(F.count(F.lit(1)).alias("n"))


@query()
def vocabulary_lookup(spark, sf_dir):
    """How often each id occurs, with its token."""
    ids = spread(_stack(spark, sf_dir).filter("content is not null").select("content")).select(F.explode(tok.encode(F.col("content"))).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(tok.vocabulary(spark)), "id").select("id", "token", "n")


@query("select word, count(*) as n from (select unnest(regexp_extract_all(content, '[A-Za-z_]+')) as word from stream_stack_all where content is not null) group by word")
def word_counts(spark, sf_dir):
    """A22, first half: the words of the corpus and how often each occurs."""
    words = _stack(spark, sf_dir).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""
with w as (select word, count(*) as n from (select unnest(regexp_extract_all(content, '[A-Za-z_]+')) as word from stream_stack_all where content is not null) group by word)
select pair, cast(sum(n) as bigint) as n from (select unnest(list_transform(range(1, length(word)), lambda i: substring(word, i, 2))) as pair, n from w where length(word) > 1) group by pair
""")
def bpe_pair_counts(spark, sf_dir):
    """A22, second half: adjacent pairs weighted by the words' counts; the pairs are made of the distinct words only."""
    w = word_counts(spark, sf_dir).filter(F.length("word") > 1)
    pairs = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


# -- perplexity -------------------------------------------------------------------------------------------------------
@query("""
select seq, b as begin, least(b + 256, n) as end, case when b = 0 then least(b + 256, n) - b - 1 else least(64, least(b + 256, n) - b - 1) end as n_new
from (select seq, n, unnest(range(0, n - 1, 64)) as b from (select seq, length(content) as n from stream_stack_all where lang = 'Python' and length(content) >= 2))
where b = 0 or b - 64 + 256 < n
""")
def ppl_windows(spark, sf_dir):
    """Windows of 256 characters every 64; the last window counts some targets again."""
    rows = _stack(spark, sf_dir).filter("lang = 'Python'").select("seq", F.length("content").cast("long").alias("n"))
    return evaluation.windows(rows, "n", 256, 64).select("seq", "begin", "end", "n_new")


@query("""
select seq, n, case when n <= 256 then n - 1 else 255 + 64 * cast(ceil((n - 256) / cast(64 as double)) as bigint) end as scored
from (select seq, length(content) as n from stream_stack_all where lang = 'Python' and length(content) >= 2) where n <= 256 or true
""")
def ppl_token_total(spark, sf_dir):
    """How many targets the windows score; the oracle is the closed form (the last window is as long as any other's tail)."""
    rows = _stack(spark, sf_dir).filter("lang = 'Python'").select("seq", F.length("content").cast("long").alias("n"))
    return evaluation.windows(rows, "n", 256, 64).groupBy("seq", "n").agg(F.sum("n_new").alias("scored"))


_NLL = "select file_seq, cast(length(content) as bigint) as tokens, length(content) * (1 + (file_seq % 7) / 10e0) as nll from fetch_repo_py_files where content is not null"


def _nll(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "fetch_repo_py_files").filter("content is not null")
    n = F.length("content")
    rows = rows.select("file_seq", n.cast("long").alias("tokens"), (n * (1 + (F.col("file_seq") % 7) / F.lit(10.0))).alias("nll"))
    return rows.withColumn("perplexity", evaluation.perplexity(F.col("nll"), F.col("tokens")))


@query(f"select file_seq, tokens, round(exp(nll / tokens), 9) as perplexity from ({_NLL}) where tokens > 0")
def doc_perplexity(spark, sf_dir):
    """A15, F18 over a synthetic loss."""
    return _nll(spark, sf_dir).filter(~F.isnan("perplexity")).select("file_seq", "tokens", F.round("perplexity", 9).alias("perplexity"))


@query(f"select count(*) as files, cast(sum(tokens) as bigint) as tokens, round(exp(sum(ln(exp(nll / tokens)) * tokens) / sum(tokens)), 9) as perplexity from ({_NLL}) where tokens > 0")
def corpus_perplexity(spark, sf_dir):
    """A16."""
    return evaluation.corpus_perplexity(_nll(spark, sf_dir)).withColumn("perplexity", F.round("perplexity", 9))


@query("""
select cast(r // 20 as bigint) as evaluation, count(*) as batches, round(avg(value), 9) as loss from (
  select value, row_number() over (order by event_id) - 1 as r from events where value is not null) group by 1
""")
def eval_loss(spark, sf_dir):
    """The mean loss of each evaluation over the next 20 batches; the cursor goes on from one to the next."""
    rows = table(spark, sf_dir, "events").filter("value is not null").select("event_id", "value")
    return evaluation.eval_losses(rows, ["event_id"], "value", 20).select("evaluation", "batches", F.round("loss", 9).alias("loss"))


# -- evaluation -------------------------------------------------------------------------------------------------------
@query("select task_id, cast(split_part(task_id, '/', 2) as int) as n, length(prompt) as prompt_chars, entry_point from humaneval_problems")
def humaneval_load(spark, sf_dir):
    """The problems in the order of their numbers."""
    n = F.split("task_id", "/")[1].cast("int")
    return table(spark, sf_dir, "humaneval_problems").select("task_id", n.alias("n"), F.length("prompt").alias("prompt_chars"), "entry_point").orderBy("n")


@query("select task_id, length(text) as n_chars, len(test_list) as tests, coalesce(test_setup_code, '') as setup from mbpp")
def mbpp_load(spark, sf_dir):
    """S13."""
    return table(spark, sf_dir, "mbpp").select("task_id", F.length("text").alias("n_chars"), F.size("test_list").alias("tests"), F.coalesce("test_setup_code", F.lit("")).alias("setup"))


_COUNTS = """
with p as (select task_id, sample_idx, bool_or(coalesce(passed, false)) as passed from outcomes group by all),
c as (select s.task_id, count(*) as n, cast(coalesce(sum(cast(p.passed as int)), 0) as bigint) as c from humaneval_samples s left join p using (task_id, sample_idx) group by 1)
"""
_PASS = _COUNTS + ", r as (select task_id, n, c, k, case when n - c < k then 1e0 else 1 - (select product((n - c - i) / cast(n - i as double)) from range(0, k) t(i)) end as p from c, (select unnest([1, 2, 4, 10]) as k) where k <= n)"


def _counts(spark, sf_dir) -> DataFrame:
    return evaluation.outcome_counts(table(spark, sf_dir, "humaneval_samples"), table(spark, sf_dir, "outcomes"))


@query(_COUNTS + "select task_id, n, c from c")
def outcome_counts(spark, sf_dir):
    """J3, A10, S18."""
    return _counts(spark, sf_dir)


@query(_PASS + "select task_id, n, c, cast(k as int) as k, round(p, 9) as p from r")
def pass_at_k(spark, sf_dir):
    """A11, F17."""
    return evaluation.pass_rates(_counts(spark, sf_dir), [1, 2, 4, 10]).select("task_id", "n", "c", "k", F.round("p", 9).alias("p"))


@query(_PASS + "select cast(k as int) as k, coalesce(tasks, 0) as tasks, coalesce(p, 0) as p from (select unnest([1, 2, 4, 10, 100]) as k) left join (select k, count(*) as tasks, round(avg(p), 9) as p from r group by k) using (k)")
def mean_pass_at_k(spark, sf_dir):
    """Means over the eligible tasks; a k without tasks gives 0."""
    return evaluation.mean_pass_rates(_counts(spark, sf_dir), [1, 2, 4, 10, 100]).select("k", "tasks", F.round("p", 9).alias("p"))


@query(_COUNTS + "select count(*) as tasks, count(*) filter (c > 0) as solved from c")
def solved_tasks(spark, sf_dir):
    """A18."""
    return _counts(spark, sf_dir).agg(F.count(F.lit(1)).alias("tasks"), F.count(F.when(F.col("c") > 0, 1)).alias("solved"))


_SOLVED = _COUNTS + ", s as (select split_part(h.entry_point, '_', 1) as lib, c.c > 0 as solved from c join humaneval_problems h using (task_id))"


@query(_SOLVED + "select coalesce(lib, 'overall') as lib, cast(sum(cast(solved as int)) as bigint) as correct, count(*) as total, sum(cast(solved as int)) / cast(count(*) as double) as accuracy from s group by grouping sets ((lib), ())")
def accuracy_rollup(spark, sf_dir):
    """Any sample passed, by group and overall."""
    problems = table(spark, sf_dir, "humaneval_problems").select("task_id", F.split("entry_point", "_")[0].alias("lib"))
    solved = _counts(spark, sf_dir).join(F.broadcast(problems), "task_id").select("lib", (F.col("c") > 0).alias("solved"))  # problems: a fixed benchmark
    return evaluation.accuracy(solved, "lib")


@query("""select p.task_id, count(s.task_id) as samples, count(o.passed) as judged from humaneval_problems p left join (select distinct task_id, sample_idx from humaneval_samples) s using (task_id)
left join (select task_id, sample_idx, bool_or(passed) as passed from outcomes group by all) o on s.task_id = o.task_id and s.sample_idx = o.sample_idx group by 1""")
def sample_coverage(spark, sf_dir):
    """Distinct samples of each problem and how many have an outcome."""
    samples = table(spark, sf_dir, "humaneval_samples").select("task_id", "sample_idx").distinct()
    got = table(spark, sf_dir, "outcomes").groupBy("task_id", "sample_idx").agg(F.max("passed").alias("passed"))
    joined = table(spark, sf_dir, "humaneval_problems").select("task_id").join(samples, "task_id", "left").join(got, ["task_id", "sample_idx"], "left")
    return joined.groupBy("task_id").agg(F.count("sample_idx").alias("samples"), F.count("passed").alias("judged"))


@query("""select h.task_id, s.sample_idx, md5(s.prompt || s.completion || chr(10) || chr(10) || h.test || chr(10) || chr(10) || 'check(' || h.entry_point || ')') as digest
from humaneval_samples s join humaneval_problems h using (task_id)""")
def humaneval_scripts(spark, sf_dir):
    """Prompt, completion, tests and the check, as one script a sample."""
    problems = table(spark, sf_dir, "humaneval_problems").select("task_id", "test", "entry_point")
    joined = table(spark, sf_dir, "humaneval_samples").join(F.broadcast(problems), "task_id")  # a fixed benchmark
    script = F.concat("prompt", "completion", F.lit("\n\n"), "test", F.lit("\n\ncheck("), "entry_point", F.lit(")"))
    return joined.select("task_id", "sample_idx", F.md5(script).alias("digest"))


_NAME = f"coalesce(list_filter(list_transform({_lines('code')}, lambda l: case when starts_with({_strip('l')}, 'def ') then {_strip('split_part(substring(' + _strip('l') + ', 5), chr(40), 1)')} else '' end), lambda x: x <> '')[1], 'solution')"


@query(f"select task_id, {_NAME} as name from mbpp")
def function_names(spark, sf_dir):
    """X9."""
    return table(spark, sf_dir, "mbpp").select("task_id", function_name("code").alias("name"))


@query(f"""
select task_id, md5(array_to_string(list_concat(['# ' || {_strip("text")}, '# Tests:'], list_transform(test_list[1:3], lambda t: '# ' || t), ['def ' || {_NAME} || '(']), chr(10))) as digest from mbpp
""")
def mbpp_prompts(spark, sf_dir):
    """The description, the first three tests as hints, and the head of the function."""
    parts = F.concat(F.array(F.concat(F.lit("# "), strip("text")), F.lit("# Tests:")), F.transform(F.slice("test_list", 1, 3), lambda t: F.concat(F.lit("# "), t)), F.array(F.concat(F.lit("def "), function_name("code"), F.lit("("))))
    return table(spark, sf_dir, "mbpp").select("task_id", F.md5(F.array_join(parts, "\n")).alias("digest"))


@query("""select task_id, md5(array_to_string(list_filter([coalesce(test_setup_code, ''), code, array_to_string(test_list, chr(10))], lambda x: x <> ''), chr(10) || chr(10))) as digest from mbpp""")
def mbpp_scripts(spark, sf_dir):
    """X11: set-up, code and tests, parts that are there, a blank line between."""
    return table(spark, sf_dir, "mbpp").select("task_id", F.md5(joined_parts(F.coalesce("test_setup_code", F.lit("")), F.col("code"), F.array_join("test_list", "\n"))).alias("digest"))


_INDENT = f"""case when ends_with(b, ':') or ends_with(b, '\"\"\"') or ends_with(b, chr(39) || chr(39) || chr(39)) or not ends_with(p, '    ') then b || chr(10) || '    ' else p end"""


@query(f"select task_id, sample_idx, md5({_INDENT}) as digest from (select task_id, sample_idx, raw_prompt as p, regexp_replace(raw_prompt, '[{_WS}]+$', '') as b from humaneval_samples)")
def prompt_indent(spark, sf_dir):
    """X12."""
    return table(spark, sf_dir, "humaneval_samples").select("task_id", "sample_idx", F.md5(indented_prompt("raw_prompt")).alias("digest"))


@query("select task_id, sample_idx, length(ltrim(completion, ' ')) as n_chars, md5(ltrim(completion, ' ')) as digest from humaneval_samples")
def completion_ltrim(spark, sf_dir):
    """Spaces only."""
    c = F.ltrim("completion")
    return table(spark, sf_dir, "humaneval_samples").select("task_id", "sample_idx", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))


_STOPS = ["\ndef ", "\nclass ", "\nif __name__", "\n# ---"]
_CUT = "case " + " ".join(f"when instr(content, chr(10) || '{s[1:]}') > 0 then substring(content, 1, instr(content, chr(10) || '{s[1:]}') - 1)" for s in _STOPS) + " else content end"


@query(f"select seq, md5({_CUT}) as digest, length({_CUT}) as n_chars from stream_stack_all where content is not null")
def stop_truncate(spark, sf_dir):
    """Up to the first listed stop string that occurs."""
    t = truncated("content", _STOPS)
    return _stack(spark, sf_dir).filter("content is not null").select("seq", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


@query("""select task_id, sample_idx, md5(case when contains(t, '[insert]') then replace(t, '[insert]', completion) else t || chr(10) || completion end) as digest, split_part(t, '[insert]', 1) = t as appended
from (select task_id, sample_idx, completion, case when sample_idx % 2 = 0 then raw_prompt || '[insert]' || chr(10) || 'END' else raw_prompt end as t from humaneval_samples)""")
def insert_marker(spark, sf_dir):
    """The completion in place of a marker, or after a template without one."""
    t = F.when(F.col("sample_idx") % 2 == 0, F.concat("raw_prompt", F.lit("[insert]\nEND"))).otherwise(F.col("raw_prompt"))
    rows = table(spark, sf_dir, "humaneval_samples").withColumn("t", t)
    return rows.select("task_id", "sample_idx", F.md5(inserted("t", "completion")).alias("digest"), (F.substring_index("t", "[insert]", 1) == F.col("t")).alias("appended"))


@query("select task_id, length(raw_prompt) as chars, substring(raw_prompt, greatest(1, length(raw_prompt) - 99), 100) as tail from (select distinct task_id, raw_prompt from humaneval_samples)")
def prompt_tail(spark, sf_dir):
    """The last part of a prompt that fits."""
    rows = table(spark, sf_dir, "humaneval_samples").select("task_id", "raw_prompt").distinct()
    return rows.select("task_id", F.length("raw_prompt").alias("chars"), F.substring("raw_prompt", F.greatest(F.lit(1), F.length("raw_prompt") - 99), F.lit(100)).alias("tail"))


# -- vectors ----------------------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))


_V = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings"
_SOFT = f"select vec_id, label, v, list_transform(e, lambda x: x / list_sum(e)) as p from (select vec_id, label, v, list_transform(v, lambda x: exp((x - list_max(v)) / cast(0.2 as double))) as e from ({_V}))"


@query(f"select vec_id, cast(unnest(range(0, 64)) as int) as i, round(unnest(p), 6) as p from ({_SOFT})")
def softmax_temperature(spark, sf_dir):
    """W8."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.softmax(F.col("v"), 0.2)).alias("i", "p"))
    return rows.select("vec_id", "i", F.round("p", 6).alias("p"))


@query(f"""
select vec_id, count(*) as kept, round(sum(p), 6) as mass from (
  select vec_id, p, coalesce(sum(p) over (partition by vec_id order by p desc, i rows between unbounded preceding and 1 preceding), 0) as before
  from (select vec_id, unnest(range(0, 64)) as i, unnest(p) as p from ({_SOFT}))) where before <= cast(0.95 as double) group by vec_id
""")
def nucleus_filter(spark, sf_dir):
    """The tokens before which less than the given mass lies; a partition is one vector."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.softmax(F.col("v"), 0.2)).alias("i", "p"))
    before = F.coalesce(F.sum("p").over(W.partitionBy("vec_id").orderBy(F.desc("p"), "i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("before", before).filter(F.col("before") <= F.lit(0.95)).groupBy("vec_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("p"), 6).alias("mass"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as token from embeddings")
def argmax_token(spark, sf_dir):
    """O9."""
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.argmax(F.col("embedding")).alias("token"))


@query(f"select vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label % 64 + 1], 6) as loss from ({_V})")
def cross_entropy(spark, sf_dir):
    """M7."""
    return _vectors(spark, sf_dir).select("vec_id", F.round(vectors.cross_entropy(F.col("v"), F.col("label") % 64), 6).alias("loss"))


@query(f"select vec_id, cast(unnest(range(0, 64)) as int) as i, round(unnest(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / 64 + cast(0.000001 as double)))), 6) as x from ({_V})")
def rms_norm(spark, sf_dir):
    """M1."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.rms_norm(F.col("v"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("x"))


@query(f"select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: v[i] / (1 + exp(-v[i])) * v[i + 32])), 6) as y from ({_V})")
def swiglu(spark, sf_dir):
    """M4: the gated sum of the two halves."""
    v = F.col("v")
    y = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), lambda a, i: a + vectors.silu(F.element_at(v, i)) * F.element_at(v, i + 32))
    return _vectors(spark, sf_dir).select("vec_id", F.round(y, 6).alias("y"))


@query(f"""
select vec_id, cast(i as int) as i, round(v[i + 1] * cos(a) + (case when i < 32 then -v[i + 33] else v[i - 31] end) * sin(a), 6) as x
from (select *, (vec_id % 128) / pow(10000e0, (i % 32) * 2e0 / 64) as a from (select vec_id, v, unnest(range(0, 64)) as i from ({_V})))
""")
def rope_rotate(spark, sf_dir):
    """M2."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vectors.rope(F.col("v"), (F.col("vec_id") % 128).cast("double"))).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("x"))


# -- training ---------------------------------------------------------------------------------------------------------
@query("""
select step, round(case when step < 0 then 0 when step < 500 then step / 500e0 else 0.1e0 + 0.9e0 * 0.5e0 * (1 + cos(pi() * least(1e0, greatest(0e0, (step - 500) / 9500e0)))) end, 12) as scale
from (select unnest(range(-10, 10500)) as step)
""")
def lr_schedule(spark, sf_dir):
    """X18, M10."""
    steps = spark.range(-10, 10500).select(F.col("id").alias("step"))
    return steps.select("step", F.round(training.lr_scale(F.col("step"), 500, 10000, 0.1), 12).alias("scale"))


@query("select run, budget, per_step, budget // per_step as steps from (values ('pilot', 2000000000, 2 * 8 * 2048), ('full', 10000000000, 4 * 16 * 2048)) t(run, budget, per_step)")
def steps_estimate(spark, sf_dir):
    """Optimizer steps of a token budget."""
    rows = spark.createDataFrame([("pilot", 2_000_000_000, 2 * 8 * 2048), ("full", 10_000_000_000, 4 * 16 * 2048)], "run string, budget long, per_step long")
    return rows.withColumn("steps", F.floor(F.col("budget") / F.col("per_step")))


_CKPT = """(select case when i % 50 = 0 then 'step_' || lpad(cast(i * 20 as varchar), 6, '0') || '.tmp' when i % 33 = 0 then 'crash_' || lpad(cast(i as varchar), 6, '0') when i % 29 = 0 then 'step_abc' else 'step_' || lpad(cast(i * 20 as varchar), 6, '0') end as name, i % 41 <> 0 as is_dir from range(1, 400) t(i)),
k as (select name, cast(regexp_extract(name, 'step_([0-9]+)$', 1) as bigint) as step from c where is_dir and not ends_with(name, '.tmp') and regexp_matches(name, 'step_[0-9]+$'))"""


def _checkpoints(spark) -> DataFrame:
    i = F.col("id")
    pad = F.lpad((i * 20).cast("string"), 6, "0")
    name = F.when(i % 50 == 0, F.concat(F.lit("step_"), pad, F.lit(".tmp"))).when(i % 33 == 0, F.concat(F.lit("crash_"), F.lpad(i.cast("string"), 6, "0"))).when(i % 29 == 0, "step_abc").otherwise(F.concat(F.lit("step_"), pad))
    return tables.checkpoints(spark, spark.range(1, 400).select(name.alias("name"), (i % 41 != 0).alias("is_dir")))


@query(f"with c as {_CKPT} select arg_max(name, step) as name, max(step) as step from k")
def checkpoint_latest(spark, sf_dir):
    """S21, O6, X23."""
    return training.latest(_checkpoints(spark))


@query(f"with c as {_CKPT} select name, step, row_number() over (order by step desc, name) <= 3 as kept from k")
def checkpoint_retention(spark, sf_dir):
    """O7."""
    return training.retention(_checkpoints(spark), 3)


@query("select event_type as tag, event_id as step, round(value, 6) as value, event_type || '/value' as key from events where value is not null")
def metrics_by_tag(spark, sf_dir):
    """Metric rows keyed by their tag."""
    rows = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), F.create_map(F.lit("value"), "value").alias("m"))
    keyed = rows.withColumn("m", F.transform_keys("m", lambda k, v: F.concat("tag", F.lit("/"), k)))
    return keyed.select("tag", "step", F.explode("m").alias("key", "value")).select("tag", "step", F.round("value", 6).alias("value"), "key")


@query("""
with r as (select event_type as tag, event_id as step, case when event_id % 3 = 0 then ['a', 'value'] when event_id % 3 = 1 then ['value'] else ['b', 'value'] end as ks, cast(event_id % 5 as varchar) as x from events),
f as (select tag, arg_min(ks, step) as columns from r group by tag)
select tag, step, list_transform(columns, lambda c: case when list_contains(ks, c) then x else '' end) as vals from r join f using (tag)
""")
def metrics_locked(spark, sf_dir):
    """A tag's first row fixes its columns."""
    i = F.col("event_id")
    x = (i % 5).cast("long")
    m = F.when(i % 3 == 0, F.create_map(F.lit("a"), x, F.lit("value"), x)).when(i % 3 == 1, F.create_map(F.lit("value"), x)).otherwise(F.create_map(F.lit("b"), x, F.lit("value"), x))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), i.alias("step"), m.alias("m"))
    return training.locked(rows, "tag", ["step"], "m").select("tag", "step", F.col("values").alias("vals"))


@query("select event_id, case when (abs(x) > 0 and abs(x) < 0.001e0) or abs(x) > 10000 then printf('%.2e', x) else printf('%.4f', x) end as shown from (select event_id, round(value * pow(10e0, (event_id % 12) - 6), 8) as x from events where value is not null)")
def metric_format(spark, sf_dir):
    """K12."""
    x = F.round(F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 12 - 6).cast("double")), 8)
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", training.metric_text(x).alias("shown"))


_PARAMS = """(select 'token_emb.weight' as name, 2 as ndim, 32000 * 512 as numel union all select 'blocks.' || l || '.' || n, d, s from range(0, 24) b(l), (values ('attn.q.weight', 2, 512 * 512), ('attn.k.weight', 2, 512 * 256), ('attn.v.weight', 2, 512 * 256), ('attn.o.weight', 2, 512 * 512), ('ffn.gate.weight', 2, 512 * 1365), ('norm.weight', 1, 512)) p(n, d, s))"""


@query(f"with p as {_PARAMS} select case when ndim >= 2 and not ends_with(name, 'token_emb.weight') then 'matrix' else 'adaptive' end as optimizer, count(*) as tensors, cast(sum(numel) as bigint) as elements from p group by 1")
def parameter_groups(spark, sf_dir):
    """F20, A21."""
    kinds = [("attn.q.weight", 2, 512 * 512), ("attn.k.weight", 2, 512 * 256), ("attn.v.weight", 2, 512 * 256), ("attn.o.weight", 2, 512 * 512), ("ffn.gate.weight", 2, 512 * 1365), ("norm.weight", 1, 512)]
    rows = [("token_emb.weight", 2, 32000 * 512)] + [(f"blocks.{b}.{n}", d, s) for b in range(24) for n, d, s in kinds]
    return training.parameter_groups(spark.createDataFrame(rows, "name string, ndim int, numel long"))


# -- JSON and events --------------------------------------------------------------------------------------------------
@query("select count(*) as loaded, cast((select count(*) from humaneval_samples where sample_idx % 4 = 0) as bigint) as skipped from humaneval_samples")
def jsonl_roundtrip(spark, sf_dir):
    """Rows written as JSON lines among broken and incomplete ones, and read again."""
    path = fresh_path(spark, "jsonl")
    rows = table(spark, sf_dir, "humaneval_samples")
    good = rows.select(F.to_json(F.struct(F.col("prompt").alias("source"), F.col("task_id").alias("tag"))).alias("value"))
    bad = rows.filter("sample_idx % 4 = 0").select(F.when(F.length("prompt") % 2 == 0, F.lit('{"source": "cut')).otherwise(F.to_json(F.struct(F.col("prompt").alias("source")))).alias("value"))
    blank = rows.filter("sample_idx % 7 = 0").select(F.lit("   ").alias("value"))
    good.unionByName(bad).unionByName(blank).write.text(path)
    loaded = tables.jsonl(spark, path).agg(F.count(F.lit(1)).alias("loaded"))
    return loaded.withColumn("skipped", F.lit(tables.jsonl_report(spark, path).first()["skipped"]))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_field(spark, sf_dir):
    """X22, X27."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_tumbling(spark, sf_dir):
    """Extension (the source has no event time): tumbling windows of an hour, as the streaming operator computes them."""
    by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")

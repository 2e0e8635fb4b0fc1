"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, common, decontaminate, html_extract, language_id, license_scan, packing, quality_rules, secret_scan, simhash_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of every document, the base test, and the learned list's verdict (quality_rule: the rejecting rule)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules).drop("text")
    return judged.select("doc_id", *(f"quality_stats.{c}" for c in quality_rules.COUNTS), "base_failed", "kept", "quality_rule")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, paragraph or line that is a known licence text or notice: other documents have no row."""
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "license", "unit", "ordinal")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out; rejected marks scores below the threshold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    told = language_id.predict(docs.select("doc_id", "text"), model).drop("text")
    return told.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document, with counts and a digest of the base spans."""
    found = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter(spans, lambda x: x.kind != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), count("guess"))


#: The conversation that every run formats besides the table's own.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back from the formatted string and its loss spans."""
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = chat_format.format_chats(rows).withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP5_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped as (
  select *, lag(role) over w is distinct from role as opens,
    length(role) + len(regexp_extract_all(role, '\\|<\|[A-Za-z_0-9]+\|>|</?s>|\[/?INST\]|<</?SYS>>')) as role_chars,
    length(text) + len(regexp_extract_all(text, '\\|<\|[A-Za-z_0-9]+\|>|</?s>|\[/?INST\]|<</?SYS>>')) as text_chars
  from rows window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when opens then 12 + role_chars + 10 + 10 else 11 end)::bigint as formatted_chars
from escaped group by conv_id
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048: one row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives, then read back from them."""
    path = common.scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, with_payload=False).drop("url")


OP7_SQL = """
with rows as (select page_id, encode(coalesce(html, '')) as payload from pages),
told as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from rows),
heads as (select payload_digest, max(page_id) as largest from told where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when largest > page_id then 'revisit' else 'response' end as record_type,
  case when largest > page_id then largest end as refers_to
from told left join heads using (payload_digest)
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


#: Holds where a page's article is one plain element, as in the tables; other markup is tested against fixtures.
OP8_SQL = r"""
with found as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) as body from pages),
blocks as (select page_id, url, [trim(regexp_replace(regexp_replace(b, '<[^>]*(>|\z)', ' ', 'g'), '\s+', ' ', 'g'), ' ') for b in string_split_regex(body, '</?(?:p|h1)>')] as b from found),
texts as (select page_id, url, array_to_string([regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;?', chr(39), 'g'), '&amp;?', '&', 'g') for x in b if x <> ''], chr(10)) as text from blocks)
select page_id, url, text, length(text)::bigint as n_chars from texts
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_dedup.cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark passage in a document: clean documents have no row."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op1 and its base test, which SQL can tell alike."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return judged.select("doc_id", *(f"quality_stats.{c}" for c in quality_rules.COUNTS), "base_failed")


QUALITY_COUNTS_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
words as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs)),
windows as (select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from words window o as (partition by r order by i)),
twice as (select r, unnest(list(i)) as i from windows where w3 is not null group by r, w, w2, w3 having count(*) > 1),
repeated as (select r, count(distinct i + d) as n from twice, range(3) as t(d) group by r),
counted as (select r, count(*) as n, sum(length(w))::bigint as chars from words group by r),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
told as (
  select doc_id, coalesce(c.n, 0)::bigint as n_words, coalesce(c.chars, 0)::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words
  from docs d left join counted c on c.r = d.r left join lines l on l.r = d.r left join repeated p on p.r = d.r)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from told
"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns' spans of op4, which SQL can tell alike."""
    return op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_ASSIGN_SQL = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, order: int, pattern: str, keep: str) -> str:
    """Places of a pattern's matches: they stand between the parts that it splits the text into."""
    return f"""{kind} as (
  select r, {order} as k, '{kind}' as kind, list_sum([length(x) for x in parts[:i]]) + coalesce(list_sum([length(x) for x in found[:i - 1]]), 0) as s, length(found[i]) as n
  from (select r, string_split_regex(text, '{pattern}') as parts, regexp_extract_all(text, '{pattern}') as found from docs), unnest(range(1, len(found) + 1)) as t(i) where {keep})"""


SECRET_BASE_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as text, row_number() over () as r from documents),
{_spans_sql("assign", 0, _ASSIGN_SQL, f"length(regexp_extract(found[i], '{_ASSIGN_SQL}', 2)) >= 6")},
{_spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(found[i]) >= 20")},
{_spans_sql("hex", 2, "[0-9a-f]+", "length(found[i]) >= 24")},
spans as (select * from assign union all select * from access union all select * from hex),
told as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, k) as joined from spans group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(joined, '')) as base_sha256 from docs left join told using (r)
"""


def queries() -> dict:
    return {f.__name__: f for f in (quality_counts, secret_base_spans, op1_quality_rules, op2_license_scans, op3_language_id, op4_secret_scans, op5_chat_formatting, op6_packing, op7_warc, op8_html_extraction, op9_simhash_near_dedup, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"quality_counts": QUALITY_COUNTS_SQL, "secret_base_spans": SECRET_BASE_SQL, "op2_license_scans": license_scan.sql(), "op5_chat_formatting": OP5_SQL, "op7_warc": OP7_SQL, "op8_html_extraction": OP8_SQL}

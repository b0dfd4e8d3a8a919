"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweir.llm import best_fit, chat_format, decontaminate, html_text, language_id, ngram_join, perplexity, toxicity, url_rules, warc
from feedweir.llm.common import table, prepare_workers

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", mark), (-1, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat_format.format_conversations(turns)
    turns = chat_format.parsed_turns(F.col("formatted"))
    read = out.select("conv_id", turns.alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; a document's `lang` is its declared language and its `source` its host."""
    docs = table(spark, sf_dir, "documents")
    pages = language_id.page_records(table(spark, sf_dir, "pages"), url_rules.host_of(F.col("url")))
    records = docs.select("doc_id", "text", F.col("lang").alias("markup"), F.col("source").alias("host")).unionByName(pages, allowMissingColumns=True)
    return language_id.identify(records, *language_id.train(docs)).select("doc_id", "page_id", "lang", "confidence", "text_lang", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True)


_QUERIES = {f.__name__: f for f in (
    op1_html_extraction, op2_warc_writer, op3_ngram_jaccard_join, op4_toxicity, op5_quality_rules,
    op6_chat_formatting, op7_best_fit_packing, op8_language_id, op9_url_filter, op10_decontamination,
)}

_ORACLES: dict[str, str] = {}

_ORACLES["op2_warc_writer"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, sha1(html) as payload_digest, cast(octet_length(encode(html)) as bigint) as payload_bytes from p),
m as (select payload_digest, max(page_id) as top from d where payload_bytes >= 1000 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when m.top is not null and d.page_id is distinct from m.top then 'revisit' else 'response' end as record_type,
       case when m.top is not null and d.page_id is distinct from m.top then m.top end as refers_to
from d left join m on d.payload_digest = m.payload_digest and d.payload_bytes >= 1000
"""

_ORACLES["op3_ngram_jaccard_join"] = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, top) as (select doc_id, doc_id from documents union select e.b, r.top from r join e on e.a = r.doc_id and r.top < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(top) from r where r.doc_id = d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id
"""

_ORACLES["op6_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (
  select *, length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '%3C|')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 as chars from t),
g as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum(chars) as formatted_chars,
    string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' when 'tool' then 't' else 'x' end, '' order by turn nulls first, role, text) as turns
  from e group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
  sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars,
  regexp_full_match(turns, 's?ua(ua|t+a)*') as valid from g
"""

_ORACLES["op9_url_filter"] = r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rule_host, rule_path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
k as (select row_number() over () as k, * from u),
m as (
  select k.*, r.rule_host || r.rule_path as rule, r.verdict,
    row_number() over (partition by k.k order by length(r.rule_host || r.rule_path) desc nulls last) as nth
  from k left join r on (k.host = r.rule_host or ends_with(k.host, '.' || r.rule_host)) and starts_with(k.path, r.rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where nth = 1
"""

_ORACLES["op10_decontamination"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark),
m(mask) as (values ([0, 1, 3, 4, 7, 9]), ([0, 2, 3, 5, 8, 9])),
dp as (select doc_id, w, unnest(range(0, len(w) - 9)) as pos from d),
bp as (select item_id, w, unnest(range(0, len(w) - 9)) as pos from b),
ds as (select doc_id, pos, mask, list_transform(mask, lambda k: w[pos + k + 1]) as seed from dp, m),
bs as (select item_id, pos, mask, list_transform(mask, lambda k: w[pos + k + 1]) as seed from bp, m),
hit as (select distinct ds.doc_id, bs.item_id, ds.pos - bs.pos as shift from ds join bs on ds.mask = bs.mask and ds.seed = bs.seed),
tok as (
  select h.doc_id, h.item_id, h.shift, len(b.w) as n, j, d.w[h.shift + j + 1] = b.w[j + 1] as same
  from hit h join d on d.doc_id = h.doc_id join b on b.item_id = h.item_id, unnest(range(0, len(b.w))) as u(j)
  where h.shift + j >= 0 and h.shift + j < len(d.w)),
run as (select *, sum(case when same then 1 else -2 end) over o as total, sum(case when same then 2 else -1 end) over o as halves from tok window o as (partition by doc_id, item_id, shift order by j)),
low as (
  select *, least(0, coalesce(min(total) over o, 0)) as floor, least(0, coalesce(min(halves) over o, 0)) as halves_floor
  from run window o as (partition by doc_id, item_id, shift order by j rows between unbounded preceding and 1 preceding)),
best as (
  select doc_id, item_id, n, max(total - floor) as score, max(halves - halves_floor) as halves from low where n >= 10 group by doc_id, item_id, shift, n
  union all select d.doc_id, b.item_id, len(b.w), len(b.w), 0 from d join b on contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
  where len(b.w) between 1 and 9)
select doc_id, item_id, cast(max(score) as bigint) as score, cast(max(n) as bigint) as item_words from best
where score >= least(13, ceil(0.6 * n)) or halves >= greatest(15, least(26, n)) group by doc_id, item_id
"""


def queries() -> dict:
    def with_workers(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_workers(spark)
            return f(spark, sf_dir)

        return run

    return {name: with_workers(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

"""The queries of the operators and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import alignment, decontaminate, exact_dedup, langid, lm, mixing, near_dedup, pii, quality, spelling, text, token_file, toxicity, warc
from tidemill.session import table

LEVELS = ["domain", "lang", "source"]
SEED, EPOCHS = 7, 4


def domain() -> Column:
    """The domain of a source: its number modulo 4 (sources src0, src1, …); any other source is of no domain."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]+)$", 1).try_cast("bigint")
    return F.when(number.isNull(), F.lit("none")).otherwise(F.concat(F.lit("d"), (number % 4).cast("string")))


# Target weights of the three levels: a domain, a language in its domain, a source in its language.
def weights() -> dict[str, Column]:
    return {
        "domain": F.when(F.col("domain") == "d0", 4).when(F.col("domain") == "d1", 3).when(F.col("domain") == "d2", 2).otherwise(1),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang") == "de", 3).otherwise(2),
        "source": F.length(F.coalesce("source", F.lit(""))),
    }


def mixed(docs: DataFrame) -> DataFrame:
    """Documents mixed to the target weights within a budget of as many tokens as there are."""
    rows = docs.select("doc_id", "lang", "source", domain().alias("domain"), text.word_count(F.col("text")).alias("n_tokens"))
    return mixing.mix(rows, LEVELS, weights(), lambda total: total, EPOCHS, SEED)


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents"))


def _share(level: int) -> str:
    """One level of the tree in SQL: nodes n{level} to shares s{level}."""
    path = LEVELS[:level + 1]
    parent = ", ".join(path[:-1]) or "root"
    node, name = f"partition by {parent}", path[-1]
    return f"""
      a{level} as (select *, sum(weight) over ({node}) w,
          coalesce(sum(weight) over ({node} order by capacity::double / weight nulls last, {name} nulls first rows between unbounded preceding and 1 preceding), 0) wb,
          coalesce(sum(capacity) over ({node} order by capacity::double / weight nulls last, {name} nulls first rows between unbounded preceding and 1 preceding), 0) cb
          from n{level}),
      b{level} as (select *, capacity::hugeint * (w - wb) <= weight * (budget::hugeint - cb) is_full from a{level}),
      c{level} as (select *, sum(case when is_full then capacity else 0 end) over ({node}) taken,
          sum(case when is_full then 0 else weight end) over ({node}) remaining from b{level}),
      s{level} as (select {', '.join(path)}, greatest(least(case when is_full then capacity
          when remaining > 0 then (weight * (budget::hugeint - taken)) // remaining else 0 end, capacity), 0)::bigint share from c{level})"""


def _nodes(level: int) -> str:
    path = LEVELS[:level + 1]
    weight = {"domain": "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end",
              "lang": "case lang when 'en' then 5 when 'de' then 3 else 2 end", "source": "length(coalesce(source, ''))"}[path[-1]]
    if not level:
        return f"n0 as (select domain, 0 root, {weight} weight, sum(able) * {EPOCHS} capacity, (select sum(tokens) from leaf) budget from leaf group by domain)"
    on = " and ".join(f"l.{c} is not distinct from s.{c}" for c in path[:-1])
    columns = ", ".join(f"l.{c}" for c in path)
    return f"""n{level} as (select {columns}, {weight.replace(path[-1], 'l.' + path[-1], 1)} weight, l.capacity, s.share budget
      from (select {', '.join(path)}, sum(able) * {EPOCHS} capacity from leaf group by all) l join s{level - 1} s on {on})"""


OP1_SQL = rf"""
with rows_ as (
  select doc_id, lang, source,
    case when regexp_matches(coalesce(source, ''), '^src[0-9]+$') then 'd' || (substr(source, 4)::bigint % 4) else 'none' end as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::bigint n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens, sum(case when length(coalesce(source, '')) > 0 then n_tokens else 0 end)::bigint able from rows_ group by all),
{_nodes(0)},{_share(0)},
{_nodes(1)},{_share(1)},
{_nodes(2)},{_share(2)},
plan as (select l.domain, l.lang, l.source, s.share, case when tokens > 0 then least(s.share // tokens, {EPOCHS}) else 0 end whole,
    case when tokens > 0 and s.share // tokens < {EPOCHS} then s.share - (s.share // tokens) * tokens else 0 end rest
  from leaf l join s2 s on l.domain is not distinct from s.domain and l.lang is not distinct from s.lang and l.source is not distinct from s.source
  where s.share > 0),
ordered as (select r.*, p.whole, p.rest, sum(n_tokens) over (partition by r.domain, r.lang, r.source
    order by md5('{SEED}:' || p.whole || ':' || coalesce(doc_id::varchar, '')), n_tokens rows unbounded preceding) running
  from rows_ r join plan p on r.domain is not distinct from p.domain and r.lang is not distinct from p.lang and r.source is not distinct from p.source)
select doc_id, domain, lang, source, n_tokens, (whole + case when running <= rest then 1 else 0 end)::bigint epochs
from ordered where whole + case when running <= rest then 1 else 0 end > 0"""


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_pages(table(spark, folder, "pages"))
    return warc.resolved(warc.read_packages(manifest.select("path")))


OP2_SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, octet_length(encode(html)) payload_bytes, sha256(html) payload_digest from p),
f as (select payload_digest, min(page_id) first_id from d where payload_bytes >= 100 group by 1)
select page_id, payload_bytes::bigint payload_bytes, d.payload_digest,
  case when first_id is not null and first_id is distinct from page_id then 'revisit' else 'response' end record_type,
  case when first_id is not null and first_id is distinct from page_id then first_id end refers_to
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100"""


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, folder, "documents"), percent=85)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin("email", "ip", "card", "phone"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in ("email", "ip", "card", "phone")), F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("found")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


OP7_SQL = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{text.UPPER}', '{text.LOWER}')) text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size,
  doc_id = max(doc_id) over (partition by text_sha256) kept, text_sha256 from d"""


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_id(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learn = labels.filter(text.fold(F.col("doc_id"), 3) != 1)
    found = quality.quality(docs, learn)
    return found.select("doc_id", (text.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


# crc32 by its table of 256 remainders, each from eight steps of the polynomial; near words by equal remainders after one deleted code point.
OP11_SQL = rf"""
with recursive steps as (select i, i::bigint r, 0 k from range(256) t(i)
  union all select i, case when r % 2 = 1 then xor(r >> 1, 3988292384) else r >> 1 end, k + 1 from steps where k < 8),
remainders as (select list(r order by i) t from steps where k = 8),
runs as (select coalesce(doc_id::varchar, '') id, translate(unnest(regexp_extract_all(text, '{spelling.LETTERS}+')), '{text.UPPER}', '{text.LOWER}') run from documents),
seen as (select id, run, count(*) n from runs group by all),
keyed as (select *, id || ':' || run as key, hex(encode(id || ':' || run)) as bytes from seen),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, (2 * i + 1)::int, 2))::bigint)),
    lambda h, b: xor(h >> 8, t[xor(h % 256, b) + 1])), 4294967295) h from keyed, remainders),
words as (select case when h % {spelling.CUT} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, sum(n)::bigint n
  from hashed group by 1 having length(word) >= {spelling.SHORTEST} and sum(n) >= {spelling.LEAST}),
less as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) rest from (select *, unnest(range(length(word))) i from words)),
pairs as (select a.word, b.word near, b.n near_n from less a join less b on a.rest = b.rest and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) n_near, min((-near_n, near)) first from pairs group by 1),
formed as (select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when -first[1] >= {spelling.TIMES} * w.n then first[2] end form,
    case when -first[1] >= {spelling.TIMES} * w.n then -first[1] end form_n from words w left join best b on w.word = b.word),
chains as (select word, word at_ from formed union all select c.word, f.form from chains c join formed f on c.at_ = f.word where f.form is not null),
roots as (select c.word, c.at_ root from chains c join formed f on c.at_ = f.word where f.form is null)
select f.word, form, root, n, n_near, form_n::bigint form_n from formed f join roots r on f.word = r.word"""


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


def op13_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return token_file.read_documents(token_file.write_tokens(table(spark, folder, "documents")))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_toxicity, op4_decontamination, op5_near_dedup, op6_pii, op7_exact_dedup, op8_lm_scores,
                                   op9_language_id, op10_quality, op11_spelling, op12_alignment, op13_token_file)}
ORACLE = {"op1_mixing": OP1_SQL, "op2_warc": OP2_SQL, "op7_exact_dedup": OP7_SQL, "op11_spelling": OP11_SQL}

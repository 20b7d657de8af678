"""The thin queries over the operators, with production parameters and whole tables.

Each reads ``<sf_dir>/<table>.parquet`` with Spark's reader only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import collocations, decontaminate, infilling, jaccard_join, license_scan, nearest, packing, pii, quality_rules, secret_scan, sharding, substring_dedup, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_lines(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "documents"))
    return decontaminate.report(decontaminate.search(index, _table(spark, sf_dir, "benchmark")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "kept_chars", "base_failed", "kept"]
    return quality_rules.judge(_table(spark, sf_dir, "documents"), ["doc_id"], wanted)


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.transform(_table(spark, sf_dir, "documents"))
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = nearest.search(nearest.build_index(vectors), vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", "vec_id", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_infilling": op11_infilling,
    "op12_nearest": op12_nearest,
    "op13_collocations": op13_collocations,
}
#: Shingle sets by list functions, overlaps by a join on shingles, components by recursion.
JACCARD_SQL = r"""
with recursive
w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
),
s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as grams
  from w
),
n as (select doc_id, len(grams) as n from s),
e as (select doc_id, unnest(grams) as gram from s),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from e a join e b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)),
linked as (select u, v from l union all select v, u from l),
r(node, root) as (select doc_id, doc_id from n union select linked.v, r.root from r join linked on r.node = linked.u)
select n.doc_id, n.n::bigint as n_shingles, min(r.root) as component_id from n join r on r.node = n.doc_id group by n.doc_id, n.n
"""

#: Cuts by ranks of code points, from the digest of the id.
INFILLING_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
u as (
  select doc_id, t, n, ('0x' || h[1:8])::bigint % (n + 1) as x, ('0x' || h[9:16])::bigint % (n + 1) as y,
    ('0x' || h[17:24])::bigint % 100 as p, ('0x' || h[25:32])::bigint % 100 as q from d
),
c as (
  select doc_id, t, n, least(x, y) as a, greatest(x, y) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or p >= 90 then 'plain' when q < 20 then 'spm' else 'psm' end as form from u
),
o as (
  select *, case form when 'plain' then t
    when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end as output from c
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(output) as output_sha256, sha256(t) as restored_sha256 from o
"""
#: All n-grams of the pieces by lead, cuts by joins, extensions by an anti-join.
COLLOCATIONS_SQL = r"""
with pieces as materialized (
  select lang, row_number() over () as id, piece from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents)
),
split as (select lang, id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
w as (select lang, id, unnest(ws) as w1, generate_subscripts(ws, 1) as i from split),
l as (select lang, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3, lead(w1, 3) over p as w4, lead(w1, 4) over p as w5 from w window p as (partition by id order by i)),
f as materialized (
  select lang, 1 as words, w1 as phrase, count(*) as f from l group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from l where w2 is not null group by all having count(*) >= 100
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from l where w3 is not null group by all having count(*) >= 100
  union all select lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) from l where w4 is not null group by all having count(*) >= 100
  union all select lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, count(*) from l where w5 is not null group by all having count(*) >= 100
),
totals as (select lang, sum(f)::hugeint as n from f where words = 1 group by lang),
c as (select lang, words, phrase, f as a, string_split(phrase, ' ') as ws from f where words > 1),
cuts as (select c.*, k from c join (select unnest([1, 2, 3, 4]) as k) on k < words),
h as (select lang, words, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail from cuts),
s as (
  select h.lang, h.words, h.phrase, a, k, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
  from h join f x on x.lang = h.lang and x.phrase = h.head join f y on y.lang = h.lang and y.phrase = h.tail join totals on totals.lang = h.lang
),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as cut from s) where cut = 1),
e as (
  select lang, array_to_string(ws[2:], ' ') as held, a as longer from c where words > 2
  union all select lang, array_to_string(ws[1:words - 1], ' '), a from c where words > 2
),
kept as (select * from b where not exists (select 1 from e where e.lang = b.lang and e.held = b.phrase and e.longer = b.a))
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000
"""

ORACLES: dict[str, str] = {"op9_jaccard_join": JACCARD_SQL, "op11_infilling": INFILLING_SQL, "op13_collocations": COLLOCATIONS_SQL}

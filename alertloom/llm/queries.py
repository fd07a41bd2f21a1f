"""One registered query per operator, over whole tables, each next to its SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm import (
    best_fit, conversation_repair, feistel_shards, licenses, line_blocks, mixture_packing, rare_features, relative_lz, simhash,
    toxicity, url_filter, walsh_clusters, wu_manber)
from alertloom.llm.rows import hex64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), length=2048)


def op3_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = relative_lz.repeated_words(_table(spark, sf_dir, "documents"), window=50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


URL_RULES = [url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
             url_filter.Rule("block", "net", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks.extract(_table(spark, sf_dir, "pages"))


def op8_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.edit_report(_table(spark, sf_dir, "documents"))


MIX = 0.7  # stated target: a source's ids to this power, so that small sources are lifted until they run dry


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(_table(spark, sf_dir, "documents"), length=2048, temper=MIX, with_ids=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh_clusters.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")), absent_col="absent")


SHARDS, SHUFFLE_SEED = 40, 1


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards.assign(_table(spark, sf_dir, "documents"), SHARDS, SHUFFLE_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_best_fit": op2_best_fit,
    "op3_relative_lz": op3_relative_lz,
    "op4_toxicity": op4_toxicity,
    "op5_url_filter": op5_url_filter,
    "op6_wu_manber": op6_wu_manber,
    "op7_line_blocks": op7_line_blocks,
    "op8_rare_features": op8_rare_features,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_licenses": op10_licenses,
    "op11_walsh_clusters": op11_walsh_clusters,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_feistel_shards": op13_feistel_shards,
}

# A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters.
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP6_SQL = f"""
with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
 b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
 patterns as (select distinct item, least(10, len(w)) as m, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') as k
   from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
 lengths as (select distinct m from patterns),
 places as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p from d, lengths where len(w) >= m),
 found as (select doc_id, p, x.m, item from (select *, array_to_string(w[p:p + m - 1], ' ') as k from places) x
   join patterns on x.m = patterns.m and x.k = patterns.k),
 hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + m)) as q from found) group by 1),
 items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as s
   from found group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

OP3_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
 windows as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as k
   from (select *, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
 again as (select doc_id, p from windows join (select k, min(doc_id) as low from windows group by k) using (k) where low < doc_id),
 gone as (select distinct doc_id, unnest(range(p, p + 50)) as i from again),
 words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
 kept as (select doc_id, count(g) as n_removed, string_agg(word, ' ' order by i) filter (g is null) as t
   from words left join (select doc_id, i, true as g from gone) using (doc_id, i) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)"""

# CRC-32 of the UTF-8 of a column ``text``, byte by byte with a table.
_CRC_TABLE = """crc_table as (select list(c order by b) as steps from (select b, list_reduce(range(8),
   lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b::bigint) as c from range(256) r(b)))"""
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint),
   lambda a, x: xor(a >> 8, steps[1 + (xor(a, x) & 255)]), 4294967295::bigint), 4294967295)"""

ORACLES: dict[str, str] = {
    "op3_relative_lz": OP3_SQL,
    "op5_url_filter": url_filter.judge_sql(URL_RULES),
    "op6_wu_manber": OP6_SQL,
    "op10_licenses": licenses.scan_sql(licenses.BASE + licenses.NOTICES, _WORDS),
    "op11_walsh_clusters": walsh_clusters.cluster_sql(16, 3, 1),
    "op12_conversation_repair": conversation_repair.repair_sql(_CRC_TABLE, _CRC),
    "op13_feistel_shards": feistel_shards.assign_sql(SHARDS, SHUFFLE_SEED, _CRC_TABLE, _CRC),
}

"""Queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontamination, html_extraction, importance, language_id, lexical_search, mixing, near_duplicates, packing, quality_model, quality_rules, sharding, suffix_dedup, warc
from rollcall.llm._frames import table


def remainder_is(key: str, n: int, wanted: int) -> Column:
    """Whether crc32 of the key as text leaves that remainder; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n == wanted, F.lit(False))


def tokenizer_path() -> str:
    """The vocabulary file of the packing query, where the public_tokenizers package has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record", "problem")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in 400-byte repeats; n_run_words counts the words in runs of 51 words or more that repeat, however few their bytes."""
    out = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), words=51, cut_words=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_run_words")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.filter(~remainder_is("doc_id", 4, 2)).select("doc_id", F.col("quality").alias("label"))
    order = F.xxhash64("doc_id")
    model = quality_model.fit(quality_model.labelled(docs, seen, "doc_id", order), order=order)
    out = quality_model.score(docs, model, ["doc_id"])
    return out.select("doc_id", remainder_is("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder_is("doc_id", 5, 0))
    profiles = language_id.prototypes(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, profiles, ["doc_id", "held_out"])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_decontamination": op2_decontamination,
        "op3_warc_derivatives": op3_warc_derivatives,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_sharding": op6_sharding,
        "op7_quality_model": op7_quality_model,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_language_id": op10_language_id,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_source_mixing": op12_source_mixing,
        "op13_lexical_search": op13_lexical_search,
    }


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(source: str, key: str, word: str, k: int) -> str:
    """Distinct shingles of each row: key, sh."""
    cut = f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    return f"""select distinct {key}, sh from (select {key}, unnest(case when len(w) >= {k} then {cut} when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh
 from (select {key}, regexp_extract_all({_LOW}, '{word}') as w from {source}))"""


def oracle_sql() -> dict[str, str]:
    """SQL for queries whose whole result it can express; here words are compared as they are, without fingerprints."""
    letters, blanks = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+", r"[^\x20\x09-\x0D]+"
    words = lambda of, key: f"select {key} as id, unnest(regexp_extract_all({_LOW}, '{letters}')) as w from {of}"
    hexed = lambda text, n: f"substr(sha256({text}), 1, {n})"
    unit = lambda digits: f"(('0x' || {digits})::bigint::double)"
    return {
        "op2_decontamination": f"""with d as ({_shingles('documents', 'doc_id', letters, 5)}), b as ({_shingles('benchmark', 'item_id', letters, 5)})
 select doc_id, item_id, n_item, n_shared, n_shared / n_item as containment from (select doc_id, item_id, count(*) as n_shared from d join b using (sh) group by all)
 join (select item_id, count(*) as n_item from b group by 1) using (item_id) where 10 * n_shared >= 8 * n_item""",
        "op5_near_duplicates": f"""with recursive s as materialized ({_shingles('documents', 'doc_id', blanks, 4)}), n as (select doc_id, count(*) as n from s group by 1),
 pairs as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
 links as materialized (select x, y from pairs join n p on x = p.doc_id join n q on y = q.doc_id where 100 * i >= 80 * (p.n + q.n - i)),
 edges as materialized (select x, y from links union all select y, x from links),
 reach(x, y) as (select x, y from edges union select r.x, e.y from reach r join edges e on r.y = e.x)
 select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(c, doc_id)) as component_id, least(doc_id, coalesce(c, doc_id)) = doc_id as kept
 from documents left join n using (doc_id) left join (select x as doc_id, min(y) as c from reach group by 1) using (doc_id)""",
        "op11_importance_resampling": f"""with tab as materialized (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
  from (select unnest(range(256)) as i))),
 words as materialized (select 'd' as side, * from ({words('documents', 'doc_id')}) union all select 'b', * from ({words('benchmark', 'item_id')})),
 hashed as materialized (select w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) % 10000 as bucket
  from (select distinct w from words), tab),
 counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from words join hashed using (w) group by 1),
 sums as (select coalesce(sum(s), 0)::double as ss, coalesce(sum(t), 0)::double as tt from counts),
 gain as materialized (select bucket, floor(1000 * ln((t + 1)::double * (ss + 10000) / ((s + 1)::double * (tt + 10000))))::bigint as g from counts, sums),
 weights as (select id, count(*) as n, floor(sum(g)::double / count(*))::bigint as weight from words join hashed using (w) join gain using (bucket) where side = 'd' group by 1),
 scored as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln(({unit(hexed("concat('2024:', doc_id)", 8))} + 0.5) / 4294967296)))::bigint as score from documents left join weights on id = doc_id),
 placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from scored where n_features >= 20)
 select doc_id, n_features, weight, score, case when place <= total * 10 // 100 then place end as rank from scored left join placed using (doc_id)""",
        "op12_source_mixing": f"""with rows as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{blanks}')) as size, {hexed("concat('0:', doc_id)", 16)} as h from documents),
 sources as (select source, sum(size)::double as n, row_number() over (order by source nulls last) as pos from rows group by 1),
 heavy as (select *, [5, 2, 1][1 + (pos - 1) % 3]::double as w from sources),
 tried as (select *, coalesce(sum(2 * n) over before, 0) as held, sum(w) over () - coalesce(sum(w) over before, 0) as free, sum(n) over () as everything from heavy window before as (order by 2 * n / w, pos rows between unbounded preceding and 1 preceding)),
 level as (select * from (select *, 1.5 * everything - held as over_all from tried) where w * over_all / free <= 2 * n order by 2 * n / w, pos limit 1),
 plan as materialized (select heavy.source, heavy.n, coalesce(least(2 * heavy.n, heavy.w * (select over_all from level) / (select free from level)), 2 * heavy.n) as target from heavy),
 placed as (select rows.*, plan.n, plan.target, case when plan.n > 0 then plan.target / plan.n else 0 end as r, row_number() over (partition by rows.source order by size, h, doc_id) - 1 as k,
   {unit(hexed("concat('0:source ', coalesce('+' || rows.source, '-'))", 8))} / 4294967296 as u from rows join plan on rows.source is not distinct from plan.source),
 taken as (select *, (floor(r) + least(1, floor((k + 1) * (r - floor(r)) + u) - floor(k * (r - floor(r)) + u)))::bigint as copies from placed)
 select doc_id, size, n::bigint as source_size, target, copies * size as taken, source, copies from taken""",
        "op13_lexical_search": f"""with d as materialized (select id as doc_id, w, count(*) as tf from ({words('documents', 'doc_id')}) group by all),
 lengths as (select doc_id, sum(tf)::bigint as n from d group by 1), total as (select count(*) as nn, sum(n)::bigint as ll from lengths),
 q as (select distinct id as item_id, w from ({words('benchmark', 'item_id')})),
 weights as (select w, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)))::bigint as weight from (select w, count(*) as df from d where w in (select w from q) group by 1), total),
 impacts as (select doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) as impact from d join weights using (w) join lengths using (doc_id), total),
 scores as (select item_id, doc_id, sum(impact)::bigint as score from impacts join q using (w) group by all having sum(impact) > 0)
 select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores) where rank <= 10""",
    }

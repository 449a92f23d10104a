"""Queries of problems 1, 4, 7, 8 and 9 over the test tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvaq.llm.clusters import density_clusters, describe_clusters
from sylvaq.llm.mixing import balanced_mix, share_report, tidy_source
from sylvaq.llm.packing import fill_report, pack, pack_check
from sylvaq.llm.sketch import RANK_ERROR, SPARSE, Sketch, build_sketches, merge_sketches, quantiles
from sylvaq.llm.textstats import common_words, document_stats, text_types, vote_report
from sylvaq.llm.tokens import token_counts
from sylvaq.plans.records import DENSE, RADIUS, located_trees
from sylvaq.plans.records_sql import LOCATED
from sylvaq.scratch import checkpointed

PROBS = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]
FIELDS = ["Annual_Carbon_Growth", "avg_LST"]
LOW = -1000.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _carbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "tree_carbon_updated7_spatial")


def _load_sketches(spark: SparkSession, sf_dir: str, sparse: int = SPARSE) -> DataFrame:
    """One sketch per species, load and field, written once; everything else comes from these."""
    parts = build_sketches(_carbon(spark, sf_dir), ["Species", "load_id"], FIELDS, LOW, sparse)
    return checkpointed(merge_sketches(parts, ["Species", "load_id"]))


def _percentiles(per_load: DataFrame) -> DataFrame:
    loads = quantiles(per_load, ["Species", "load_id"], PROBS)
    every = quantiles(merge_sketches(per_load, ["Species"]), ["Species"], PROBS)
    return loads.withColumn("scope", F.lit("load")).unionByName(every.withColumns({"load_id": F.lit(None).cast("int"), "scope": F.lit("all")}))


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per species and load (scope 'load') and per species over all loads (scope 'all', load_id NULL)."""
    p = _percentiles(_load_sketches(spark, sf_dir))
    return p.select("scope", "Species", "load_id", "field", "n", "prob", "value", F.lit(RANK_ERROR).alias("rank_error"))


def p1_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles held against the exact ranks of all values: whether each lies within the stated error.

    All but the smallest parts are shipped and merged as counters here, not as counts of codes.
    """
    p = checkpointed(_percentiles(_load_sketches(spark, sf_dir, sparse=64)))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in FIELDS])).alias("c")
    values = _carbon(spark, sf_dir).select(F.col("Species").alias("s"), F.col("load_id").alias("l"), cells).select("s", "l", F.col("c.field").alias("f"), F.col("c.v").alias("v"))
    values = values.where(~F.isnan("v") & (F.col("v") >= LOW) & (F.col("v") < float("inf")))
    counted = values.groupBy("s", "l", "f", "v").agg(F.count(F.lit(1)).alias("cnt"))
    scoped = counted.withColumn("scope", F.explode(F.array(F.lit("load"), F.lit("all"))))
    on = F.col("s").eqNullSafe(F.col("Species")) & (F.col("f") == F.col("field")) & (p["scope"] == scoped["scope"]) & ((p["scope"] == "all") | F.col("l").eqNullSafe(F.col("load_id")))
    below, upto = F.sum(F.when(F.col("v") < F.col("value"), F.col("cnt")).otherwise(0)), F.sum(F.when(F.col("v") <= F.col("value"), F.col("cnt")).otherwise(0))
    ranks = p.join(scoped, on).groupBy(p["scope"], "Species", "load_id", "field", "n", "prob").agg(below.alias("below"), upto.alias("upto"), F.sum("cnt").alias("total"))
    off = F.greatest(F.lit(0.0), F.col("below") - F.col("prob") * F.col("n"), F.col("prob") * F.col("n") - F.col("upto"))
    # one rank is the least step of a small group
    return ranks.select("scope", "Species", "load_id", "field", "n", "prob", ((F.col("total") == F.col("n")) & (off <= RANK_ERROR * F.col("n") + 1)).alias("within"))


def p1_without_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion: the sketch over all loads less that of the last load, against the sum of the other loads."""
    per = _load_sketches(spark, sf_dir)
    last = per.agg(F.max("load_id")).first()[0]
    every, rest, gone = merge_sketches(per, ["Species"]), merge_sketches(per.where(F.col("load_id") != F.lit(last)), ["Species"]), per.where(F.col("load_id") == F.lit(last))
    name = lambda d, n: d.select("Species", "field", F.col("sketch").alias(n))

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same = [], []
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc")):
                x = Sketch.from_bytes(a).densify()
                if b is not None:
                    x.merge(Sketch.from_bytes(b), -1)
                y = (Sketch.from_bytes(c) if c is not None else Sketch()).densify()
                n.append(x.n)
                same.append(bool((x.top == y.top).all() and (x.cells == y.cells).all()))
            yield pa.RecordBatch.from_arrays([batch.column("Species"), batch.column("field"), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], names=["Species", "field", "n", "same"])

    key = lambda d: F.concat_ws("/", F.coalesce(d["Species"].cast("string"), F.lit("-")), d["field"])
    a, b, c = (name(d, n).withColumn("k", key(d)) for d, n in ((every, "a"), (gone, "b"), (rest, "c")))
    joined = a.join(b.select("k", "b"), "k", "left").join(c.select("k", "c"), "k", "left")
    return joined.select("Species", "field", "a", "b", "c").mapInArrow(less, f"Species {per.schema['Species'].dataType.simpleString()}, field string, n bigint, same boolean")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_clusters(located_trees(spark, sf_dir), RADIUS, DENSE).select("cluster_key", F.col("id").alias("tree_id"))


def p4_stands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands with size, typical members, dominant species and the stored label and regime most of the members carry.

    Regimes are compared trimmed and in lower case.
    """
    raw = _table(spark, sf_dir, "cluster_analysis_data").where(F.col("tree_id").isNotNull())
    # of repeated rows the last updated one counts; equal times: the larger label
    last = raw.groupBy("tree_id").agg(F.max(F.struct("updated_at", "Species", "Cluster_ID", F.lower(F.trim("Regime")).alias("Regime"))).alias("r"))
    last = last.select(F.col("tree_id").alias("id"), F.col("r.Species").alias("kind"), F.col("r.Cluster_ID").alias("cluster"), F.col("r.Regime").alias("regime"))
    members = checkpointed(density_clusters(located_trees(spark, sf_dir), RADIUS, DENSE).join(last, "id", "left"))
    out = describe_clusters(members.drop("kind", "cluster", "regime"), members.select("id", "kind"))
    for stored in ("cluster", "regime"):
        n = members.where(F.col(stored).isNotNull()).groupBy("cluster_key", stored).agg(F.count(F.lit(1)).alias("n"))
        top = F.min_by(stored, F.struct((-F.col("n")).alias("n"), F.col(stored))).alias(f"stored_{stored}")
        out = out.join(n.groupBy("cluster_key").agg(top, F.max("n").alias(f"{stored}_members")), "cluster_key", "left")
    return out.select(
        "cluster_key", "size", "dense_members", "cells", "typical", F.col("dominant").alias("dominant_species"), F.round("dominant_share", 6).alias("dominant_share"),
        "stored_cluster", F.col("cluster_members").alias("stored_members"), "stored_regime", "regime_members",
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]).withColumnRenamed("doc_id", "id"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss-bearing are the tokens behind the first line, which serves as the prompt."""
    return _tokens(spark, sf_dir).select("id", "tokens", F.col("head_tokens").alias("loss_from"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers under limits on tokens, segments and loss-bearing tokens (packing.SEGMENT_TOKENS, LOSS_SHARE)."""
    packed = pack(_items(spark, sf_dir), _table(spark, sf_dir, "container_kind"))
    return packed.select("kind_id", "container", F.col("id").alias("doc_id"), "piece", "tokens", "loss")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _table(spark, sf_dir, "container_kind")
    return fill_report(pack(_items(spark, sf_dir), kinds), kinds)


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each kind's containers hold every document with text once and whole, keep the limits and are full."""
    items, kinds = _items(spark, sf_dir), _table(spark, sf_dir, "container_kind")
    check = pack_check(checkpointed(pack(items, kinds)), items, kinds)
    return check.select("kind_id", F.col("items").alias("documents"), "whole", "within", "full")


def p7_token_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill where tokens alone are limited."""
    kinds = _table(spark, sf_dir, "container_kind")
    return fill_report(pack(_items(spark, sf_dir), kinds, segment_tokens=1, loss_share=1.0), kinds)


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = balanced_mix(_tokens(spark, sf_dir), _table(spark, sf_dir, "mix_target"))
    return mix.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _tokens(spark, sf_dir), _table(spark, sf_dir, "mix_target")
    return share_report(balanced_mix(docs, targets), docs, targets)


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: whether no document has more copies than allowed, and whether the tokens reached are
    those of the target share among the sources that hold documents, but for the largest document of each source."""
    docs, targets = _tokens(spark, sf_dir), _table(spark, sf_dir, "mix_target")
    r = share_report(checkpointed(balanced_mix(docs, targets)), docs, targets)
    largest = docs.groupBy(tidy_source(F.col("source")).alias("source")).agg(F.max("tokens").alias("largest"))
    w = Window.partitionBy()  # a row per listed source
    live = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
    r = r.join(largest, "source", "left").withColumn("goal", live / F.sum(live).over(w) * F.sum("tokens").over(w))
    off = F.abs(F.col("tokens") - F.col("goal"))
    return r.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"), (off <= F.sum(F.coalesce("largest", F.lit(0))).over(w)).alias("share_reached"))


def _document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents by the common words learned from them; the languages are those the documents state."""
    docs = _table(spark, sf_dir, "documents")
    return document_stats(docs, "doc_id", "text", common_words(docs, "text", "lang"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(checkpointed(_document_stats(spark, sf_dir))).where(F.col("text_type") == "other").select("doc_id")


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics the problem asks for; sizes and two of the shares are compared with SQL."""
    shares = [F.round(c, 6).alias(c) for c in ("mean_word_length", "punctuated_line_share")]
    return _document_stats(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines", *shares)


def p9_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_types(checkpointed(_document_stats(spark, sf_dir)))


def p9_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote_report(checkpointed(_document_stats(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_percentiles, p1_rank_check, p1_without_load, p4_found, p4_stands, p7_containers, p7_fill, p7_check, p7_token_fill, p8_selection, p8_shares, p8_check, p9_found, p9_stats, p9_types, p9_votes,
        )
    }


_CLUSTER = f"""{LOCATED}, dense AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 10
), link AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN dense d ON near.a = d.id SEMI JOIN dense e ON near.b = e.id
), reach(id, root) AS (
  SELECT id, id FROM dense
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON reach.id = link.a WHERE reach.root < link.b
), core AS (SELECT id, min(root) AS root FROM reach GROUP BY id
), member AS (
  SELECT id, root, TRUE AS dense FROM core
  UNION ALL
  SELECT near.a, min(core.root), FALSE FROM near JOIN core ON near.b = core.id WHERE near.a NOT IN (SELECT id FROM dense) GROUP BY near.a
), found AS (SELECT min(id) OVER (PARTITION BY root) AS cluster_key, id, dense FROM member)"""

_VALUES = """
v AS (
  SELECT Species, load_id, 'Annual_Carbon_Growth' AS field, Annual_Carbon_Growth AS v FROM tree_carbon_updated7_spatial
  UNION ALL SELECT Species, load_id, 'avg_LST', avg_LST FROM tree_carbon_updated7_spatial
), ok AS (SELECT * FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v >= -1000 AND v < 'Infinity'::DOUBLE
), g AS (
  SELECT 'load' AS scope, Species, load_id, field, count(*) AS n FROM ok GROUP BY ALL
  UNION ALL SELECT 'all', Species, NULL, field, count(*) FROM ok GROUP BY ALL
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rank_check": f"WITH {_VALUES} SELECT scope, Species, load_id, field, n, CAST(prob AS DOUBLE) AS prob, TRUE AS within FROM g, (VALUES (0.01), (0.25), (0.5), (0.75), (0.95), (0.99)) p(prob)",
        "p1_without_load": f"WITH {_VALUES} SELECT Species, field, CAST(sum(CASE WHEN load_id < (SELECT max(load_id) FROM v) THEN n ELSE 0 END) AS BIGINT) AS n, TRUE AS same FROM g WHERE scope = 'load' GROUP BY Species, field",
        "p4_found": f"WITH RECURSIVE {_CLUSTER} SELECT cluster_key, id AS tree_id FROM found",
        "p4_stands": f"""WITH RECURSIVE {_CLUSTER}, grid AS (SELECT id, CAST(floor(x / (25 / sqrt(2) * (1 - 1e-9))) AS BIGINT) AS gx, CAST(floor(y / (25 / sqrt(2) * (1 - 1e-9))) AS BIGINT) AS gy FROM pts
), last AS (
  SELECT tree_id AS id, Species AS kind, Cluster_ID AS stored, lower(trim(Regime)) AS regime FROM cluster_analysis_data
  QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY updated_at DESC NULLS LAST, Species DESC NULLS LAST, Cluster_ID DESC NULLS LAST, lower(trim(Regime)) DESC NULLS LAST) = 1
), m AS (SELECT found.*, gx, gy, kind, stored, regime FROM found JOIN grid USING (id) LEFT JOIN last USING (id)
), c AS (SELECT cluster_key, gx, gy, count(*) AS n, sum(CAST(dense AS INTEGER)) AS d FROM m GROUP BY ALL
), s AS (SELECT cluster_key, CAST(sum(n) AS BIGINT) AS size, CAST(sum(d) AS BIGINT) AS dense_members, count(*) AS cells, arg_min((gx, gy), (-n, gx, gy)) AS top FROM c GROUP BY cluster_key
), t AS (SELECT cluster_key, m.id, row_number() OVER (PARTITION BY cluster_key ORDER BY m.id) AS r FROM m JOIN s USING (cluster_key) WHERE (gx, gy) = top
), tt AS (SELECT cluster_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS typical FROM t WHERE r <= 3 GROUP BY cluster_key
), k AS (SELECT cluster_key, kind, count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY ALL
), kk AS (SELECT cluster_key, arg_min(kind, (-n, kind)) AS dominant_species, round(max(n) / sum(n), 6) AS dominant_share FROM k GROUP BY cluster_key
), o AS (SELECT cluster_key, stored, count(*) AS n FROM m WHERE stored IS NOT NULL GROUP BY ALL
), oo AS (SELECT cluster_key, arg_min(stored, (-n, stored)) AS stored_cluster, max(n) AS stored_members FROM o GROUP BY cluster_key
), e AS (SELECT cluster_key, regime, count(*) AS n FROM m WHERE regime IS NOT NULL GROUP BY ALL
), ee AS (SELECT cluster_key, arg_min(regime, (-n, regime)) AS stored_regime, max(n) AS regime_members FROM e GROUP BY cluster_key)
SELECT cluster_key, size, dense_members, cells, typical, dominant_species, dominant_share, stored_cluster, stored_members, stored_regime, regime_members FROM s LEFT JOIN tt USING (cluster_key) LEFT JOIN kk USING (cluster_key) LEFT JOIN oo USING (cluster_key) LEFT JOIN ee USING (cluster_key)""",
        "p7_check": "SELECT CAST(kind_id AS BIGINT) AS kind_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, TRUE AS whole, TRUE AS within, TRUE AS \"full\" FROM container_kind",
        "p8_check": r"SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, TRUE AS repeats_kept, TRUE AS share_reached FROM mix_target",
        "p9_stats": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\s\x0b\x1c-\x1f\x85\xa0]+'), lambda x: x <> '') AS w,
         list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\s\x0b\x85\xa0]+$', '')), lambda x: x <> '') AS l FROM d)
SELECT doc_id, length(t) AS n_chars, len(w) AS n_words, len(l) AS n_lines, CASE WHEN len(w) > 0 THEN round(CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) / len(w), 6) ELSE 0 END AS mean_word_length,
       CASE WHEN len(l) > 0 THEN round(CAST(len(list_filter(l, lambda x: regexp_matches(x, '([.!?…]|[.!?]["]|[.][''])$|[.!?][)]$'))) AS DOUBLE) / len(l), 6) ELSE 0 END AS punctuated_line_share FROM w""",
    }

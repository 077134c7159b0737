"""Catalog tables derived from the driver tables.

Each view is one SQL text that Spark and DuckDB read alike (numbers in E-notation, so both see DOUBLE). Which rows
a side table covers follows from order attributes; every view reads its whole source table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skyfold.session import tune

# Rows without a temperature are those of status 'P'; the prediction tables cover subsets of them.
VIEWS = {
    "v_catalog": """
SELECT o_orderkey AS source_id,
  1e1 + o_totalprice/5e4 AS g,
  1e1 + o_totalprice/5e4 + 2e-1 + (o_custkey % 97)/1e2 AS bp,
  1e1 + o_totalprice/5e4 - 3e-1 - (o_custkey % 53)/1e2 AS rp,
  CASE WHEN o_orderstatus = 'P' THEN -999e0 ELSE 25e2 + o_totalprice*4e-2 END AS teff_gaia,
  CASE WHEN o_orderpriority = '5-LOW' THEN -999e0 ELSE 5e-1 + (o_custkey % 50)/1e1 END AS logg_gaia,
  o_orderpriority AS model_type,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS teff_gspphot_flag,
  1e0/(1e0 + o_custkey % 50) AS frequency,
  ((o_orderkey*37) % 36000)/1e2 AS ra,
  ((o_orderkey*53) % 18000)/1e2 - 9e1 AS dec
FROM orders""",
    "v_ebv": """
SELECT o_orderkey AS source_id, (o_custkey % 30)/1e2 AS ebv_sandf, (o_custkey % 30)/1e2*86e-2 AS ebv_sfd
FROM orders WHERE o_orderpriority <> '2-HIGH'""",
    "v_params": """
SELECT o_orderkey AS source_id, 1e0*(o_custkey % 1000) AS global_ranking, 1e0/(1e0 + o_custkey % 50) AS frequency,
  1e0*(o_custkey % 3) AS geom_model_reference_level, o_orderpriority AS model_type
FROM orders WHERE o_orderstatus <> 'O'""",
    "v_pred_clustering": """
SELECT o_orderkey AS source_id, 4e3 + o_totalprice*1e-2 AS value, 1e2 + o_custkey % 83 AS unc
FROM orders WHERE o_orderstatus = 'P'""",
    "v_pred_log": """
SELECT o_orderkey AS source_id, 41e2 + o_totalprice*1e-2 AS value, 9e1 + o_custkey % 101 AS unc
FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'""",
    "v_pred_flag1": """
SELECT o_orderkey AS source_id, 42e2 + o_totalprice*1e-2 AS value, 5e1 + o_custkey % 211 AS unc
FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'""",
    "v_pred_chain": """
SELECT o_orderkey AS source_id, 43e2 + o_totalprice*1e-2 AS value,
  CASE WHEN o_custkey % 61 = 0 THEN 0e0 ELSE 12e1 + o_custkey % 61 END AS unc
FROM orders WHERE o_orderpriority <> '3-MEDIUM'""",
    "v_test_pred": """
SELECT o_orderkey AS source_id, 25e2 + o_totalprice*4e-2 AS y_true,
  (25e2 + o_totalprice*4e-2)*(1e0 + ((o_custkey % 41) - 20)/1e2) AS y_pred,
  5e-1 AS gmm_weight_0, 3e-1 AS gmm_weight_1, 2e-1 AS gmm_weight_2,
  (25e2 + o_totalprice*4e-2)*(95e-2 + ((o_custkey % 41) - 20)/1e2) AS gmm_mean_0,
  (25e2 + o_totalprice*4e-2)*(1e0 + ((o_custkey % 41) - 20)/1e2) AS gmm_mean_1,
  (25e2 + o_totalprice*4e-2)*(106e-2 + ((o_custkey % 41) - 20)/1e2) AS gmm_mean_2,
  5e1 + o_custkey % 40 AS gmm_sigma_0, 1e2 + o_custkey % 70 AS gmm_sigma_1, 3e2 + o_custkey % 90 AS gmm_sigma_2
FROM orders""",
    "v_detections": """
SELECT l_orderkey AS original_ext_source_id,
  CASE WHEN l_linenumber = 7 THEN -999e0 ELSE 14e0 + l_quantity/1e1 END AS gPSFMag,
  CASE WHEN l_partkey % 9 = 0 THEN -999e0 ELSE 138e-1 + l_quantity/1e1 - l_discount*5e0 END AS rPSFMag,
  CASE WHEN l_partkey % 4 = 0 THEN -999e0 ELSE 135e-1 + l_quantity/1e1 - l_discount*8e0 END AS iPSFMag,
  CASE WHEN l_suppkey % 3 = 0 THEN -999e0 ELSE 133e-1 + l_quantity/1e1 - l_discount*9e0 END AS zPSFMag,
  1e-2 + l_tax AS gPSFMagErr, 2e-2 + l_tax AS rPSFMagErr, 2e-2 + l_discount AS iPSFMagErr, 3e-2 + l_tax AS zPSFMagErr
FROM lineitem""",
    "v_components": """
SELECT o_orderkey AS source_id,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN -999e-2 ELSE 35e-1 + o_totalprice/5e5 END AS logT1,
  CASE WHEN o_orderpriority = '2-HIGH' THEN -999e-2 ELSE 34e-1 + o_totalprice/5e5 END AS logT2,
  2e-1 + (o_custkey % 300)/1e1 AS Pday
FROM orders WHERE o_orderstatus = 'O'""",
}
# Array views: the two engines spell array functions differently.
SPARK_ARRAYS = {
    "v_trees": """
SELECT vec_id AS source_id, transform(embedding, x -> 6e3 + 1e4*CAST(x AS DOUBLE)) AS tree_preds, label
FROM embeddings""",
    "v_cutouts": """
SELECT vec_id AS source_id, transform(sequence(0,3), b -> transform(slice(embedding, b*16+1, 16),
  x -> CAST(x AS DOUBLE))) AS bands, CAST(label AS DOUBLE) AS target FROM embeddings""",
    "v_outputs": """
SELECT vec_id AS source_id, transform(slice(embedding, 1, 63), x -> CAST(x AS DOUBLE)) AS raw,
  CAST(embedding[63] AS DOUBLE) AS y FROM embeddings""",
}
DUCK_ARRAYS = {
    "v_trees": """
SELECT vec_id AS source_id, list_transform(embedding, lambda x: 6e3 + 1e4*CAST(x AS DOUBLE)) AS tree_preds, label
FROM embeddings""",
    "v_cutouts": """
SELECT vec_id AS source_id, list_transform(range(4), lambda b: list_transform(embedding[b*16+1 : b*16+16],
  lambda x: CAST(x AS DOUBLE))) AS bands, CAST(label AS DOUBLE) AS target FROM embeddings""",
    "v_outputs": """
SELECT vec_id AS source_id, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS raw,
  CAST(embedding[64] AS DOUBLE) AS y FROM embeddings""",
}


class Tables:
    """The views of one scale as DataFrames: ``t.catalog``, ``t.trees`` …"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = tune(spark), sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _source(self) -> dict[str, DataFrame]:
        return {n: self.raw(n) for n in ("orders", "lineitem", "embeddings")}

    def __getattr__(self, name: str) -> DataFrame:
        view = f"v_{name}"
        text = VIEWS.get(view) or SPARK_ARRAYS.get(view)
        if text is None:
            raise AttributeError(name)
        source = next(n for n in ("orders", "lineitem", "embeddings") if f"FROM {n}" in text)
        return self.spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: self._source[source]})


def duck(body: str, *views: str) -> str:
    """A DuckDB statement with the named views (all that the text mentions, if none are named) in front."""
    both = {**VIEWS, **DUCK_ARRAYS}
    names = views or [v for v in both if v in body]
    ctes = [f"{v} AS ({both[v].strip()})" for v in names]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name`` with its SQL twin."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql is not None:
            ORACLES[name] = duck(sql)
        return fn
    return register

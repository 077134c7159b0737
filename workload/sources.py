"""Round trips through the file formats: written by Spark from the given tables, read back."""

from pyspark.sql import functions as F

from skyfold.session import scratch_path
from skyfold.sources import ecsv, tables
from workload.standin import query


@query("s2_csv_scan", "SELECT source_id, g, bp, model_type FROM v_catalog")
def _(t):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.catalog.select("source_id", "g", "bp", "model_type"), path)
    return tables.read_csv(t.spark, path, "source_id long, g double, bp double, model_type string")


@query("s8_csv_sink", "SELECT source_id, logT1, Pday FROM v_components")
def _(t):
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.components.select("source_id", "logT1", "Pday"), path)
    return tables.read_csv(t.spark, path, "source_id long, logT1 double, Pday double")


@query("s7_parquet_sink", "SELECT source_id, g, teff_gaia FROM v_catalog")
def _(t):
    path = scratch_path(t.spark, "table")
    tables.write_parquet(t.catalog.select("source_id", "g", "teff_gaia"), path)
    return t.spark.read.parquet(path)


@query("s7_replace_table", "SELECT source_id, g, g*2e0 AS g2 FROM v_catalog")
def _(t):
    path = scratch_path(t.spark, "table")
    tables.write_parquet(t.catalog.select("source_id", "g"), path)
    tables.replace_table(t.spark.read.parquet(path).withColumn("g2", F.col("g") * F.lit(2.0)), path)
    return t.spark.read.parquet(path)


KINDS = {"source_id": "datatype: int64", "frequency": "unit: 1 / d, datatype: float64", "model_type": "datatype: string"}


@query("s3_ecsv_scan", "SELECT source_id, frequency, '# ' || model_type AS model_type FROM v_params")
def _(t):
    path = scratch_path(t.spark, "ecsv")
    rows = t.params.select("source_id", "frequency", F.concat(F.lit("# "), "model_type").alias("model_type")).repartition(3, "source_id")

    def lines(batches):
        # Each part file carries its own header; files order their columns differently, and rows may start with "# ".
        import pandas as pd
        from pyspark import TaskContext
        names = list(KINDS) if TaskContext.get().partitionId() % 2 else ["model_type", "source_id", "frequency"]
        yield pd.DataFrame({"value": ["# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:", *(f"# - {{name: {n}, {KINDS[n]}}}" for n in names), ",".join(names)]})
        for pdf in batches:
            cells = [pdf[n].map(repr) if n == "frequency" else pdf[n].astype(str) for n in names]
            yield pd.DataFrame({"value": [",".join(c) for c in zip(*cells)]}, columns=["value"])

    rows.mapInPandas(lines, "value string").write.text(path)
    return ecsv.read_ecsv(t.spark, path).select("source_id", "frequency", "model_type")


@query("s14_model_round_trip", "SELECT source_id, TRUE AS same, 'bp_rp,g_bp,g_rp' AS features FROM v_catalog")
def _(t):
    from skyfold.operators import forests
    from skyfold.sources import artifacts
    from workload.learning import FEATURES, SMALL, colours, rows
    model = forests.fit_forest(rows(t), FEATURES, "teff_gaia", **SMALL)
    path = artifacts.save_model(t.spark, model, scratch_path(t.spark, "models"), "rf_demo", {"features": FEATURES})
    loaded, meta = artifacts.load_model(t.spark, path)
    before = forests.predict(model, colours(t)).withColumnRenamed("prediction", "before")
    return forests.predict(loaded, before).select("source_id", (F.col("prediction") == F.col("before")).alias("same"), F.lit(",".join(meta["features"])).alias("features"))


def _fits_bytes(pdf):
    """A minimal file with one binary table: a long, two doubles, a string of 16 bytes, an unsigned and a scaled integer."""
    import numpy as np
    rows = np.zeros(len(pdf), dtype=[("source_id", ">i8"), ("g", ">f8"), ("teff_gaia", ">f8"), ("model_type", "S16"), ("code", ">i2"), ("scaled", ">i4")])
    stored = {"model_type": pdf["model_type"].str.encode("ascii"), "code": pdf["code"] - 32768}
    for name in rows.dtype.names:
        rows[name] = stored.get(name, pdf[name])
    def unit(cards):
        text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
        return text.ljust(-(-len(text) // 2880) * 2880).encode()
    table = [("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.itemsize), ("NAXIS2", len(rows)),
             ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 6)]
    for i, (name, form) in enumerate(zip(rows.dtype.names, ("K", "D", "D", "16A", "I", "J")), 1):
        table += [(f"TTYPE{i}", f"'{name}'"), (f"TFORM{i}", f"'{form}'")]
    table += [("TZERO5", 32768), ("TSCAL6", "0.5"), ("TZERO6", "1.0D1")]
    data = rows.tobytes()
    return unit([("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)]) + unit(table) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")


@query("s4_fits_scan", """SELECT source_id, g, teff_gaia, model_type, (40000 + teff_gspphot_flag)::INT AS code, 1e1 + 5e-1*(source_id % 1000) AS scaled FROM v_catalog""")
def _(t):
    from skyfold.sources import fits
    path = scratch_path(t.spark, "fits")

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext
        pdf = pd.concat(list(batches))  # one partition
        fs, local = fits.file_system(path)
        fs.create_dir(local)
        name = f"{local}/part-{TaskContext.get().partitionId():06d}.fits"  # a task that runs twice writes one file
        with fs.open_output_stream(name) as out:
            out.write(_fits_bytes(pdf))
        yield pd.DataFrame({"rows": [len(pdf)]})

    rows = t.catalog.select("source_id", "g", "teff_gaia", "model_type", (F.col("teff_gspphot_flag") + 40000).alias("code"),
                            (F.col("source_id") % 1000).alias("scaled")).repartition(3, "source_id")
    rows.mapInPandas(write, "rows long").agg(F.sum("rows")).first()
    return fits.read_fits(t.spark, path, rows_per_partition=1000)

"""File formats."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F

from skyfold.sources import artifacts, ecsv, fits, tables


def card(key, value):
    text = f"'{value}'" if isinstance(value, str) else ("T" if value else "F") if isinstance(value, bool) else str(value)
    return f"{key:<8}= {text:>20}".ljust(80)


def header(cards):
    text = "".join(card(k, v) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def write_fits(path, array, forms, nulls=()):
    data = array.tobytes()
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", array.dtype.itemsize), ("NAXIS2", len(array)),
             ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(forms, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    cards += [(f"TNULL{i}", v) for i, v in nulls]
    primary = header([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 1), ("NAXIS1", 100)]) + bytes(2880)
    path.write_bytes(primary + header(cards) + data.ljust(-(-len(data) // 2880) * 2880, b"\x00"))


def test_fits_round_trip(spark, tmp_path):
    n = 2500
    a = np.zeros(n, dtype=[("source_id", ">i8"), ("teff", ">f8"), ("kind", "S6"), ("flag", ">i4"), ("ok", "S1"), ("pix", ">f4", (3,))])
    a["source_id"] = np.arange(n) + 2 ** 40
    a["teff"] = np.where(np.arange(n) % 10 == 0, np.nan, np.arange(n) * 1.5)
    a["kind"], a["ok"] = b"star", np.where(np.arange(n) % 2, b"T", b"F")
    a["flag"] = np.where(np.arange(n) % 5 == 0, -1, np.arange(n))
    a["pix"] = np.arange(n)[:, None] + np.arange(3)
    path = tmp_path / "t.fits"
    write_fits(path, a, [("source_id", "K"), ("teff", "D"), ("kind", "6A"), ("flag", "J"), ("ok", "L"), ("pix", "3E")], [(4, -1)])
    df = fits.read_fits(spark, str(path), rows_per_partition=600)
    assert df.rdd.getNumPartitions() == 5
    out = fits.ingest_fits(spark, f"file://{path}", str(tmp_path / "p"))
    rows = out.orderBy("source_id").collect()
    assert len(rows) == n and [r["source_id"] for r in rows] == a["source_id"].tolist()
    assert rows[10]["teff"] is None and rows[11]["teff"] == 16.5 and rows[5]["flag"] is None and rows[6]["flag"] == 6
    assert rows[7]["kind"] == "star" and rows[7]["ok"] is True and rows[8]["ok"] is False and rows[7]["pix"] == [7.0, 8.0, 9.0]


def test_fits_without_table(spark, tmp_path):
    (tmp_path / "x.fits").write_bytes(header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]))
    with pytest.raises(ValueError):
        fits.read_layout(str(tmp_path / "x.fits"))


def test_ecsv(spark, tmp_path):
    text = """# %ECSV 1.0
# ---
# datatype:
# - {name: SOURCE_ID, datatype: int64, description: Unique id}
# - {name: logT1, unit: dex, datatype: float64}
# - name: 'model type'
# - {name: model_type, datatype: string}
SOURCE_ID logT1 model_type
123456789012345678 3.75 "two words"
2 nan ""
"""
    (tmp_path / "t.ecsv").write_text(text.replace("# - name: 'model type'\n", ""))
    df = ecsv.ingest_ecsv(spark, str(tmp_path / "t.ecsv"), str(tmp_path / "p"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string"]
    assert [tuple(r) for r in df.orderBy(F.desc("SOURCE_ID")).collect()] == [(123456789012345678, 3.75, "two words"), (2, None, None)]
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        ecsv.read_ecsv(spark, str(tmp_path / "plain.csv"))


def test_folder_of_ecsv_files(spark, tmp_path):
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# - {name: id, datatype: int64}\n# - {name: note, datatype: string}\nid,note\n"
    for k in range(3):
        (tmp_path / f"{k}.ecsv").write_text(head + f"{k},#{k}\n{k + 10},\n")
    (tmp_path / "3.ecsv").write_text(head.replace("# ---", "# ---\n# meta: more") + "#9,x\n3,#3\n")
    got = sorted((r["id"], r["note"]) for r in ecsv.read_ecsv(spark, str(tmp_path), "PERMISSIVE").where("id is not null").collect())
    assert got == [(0, "#0"), (1, "#1"), (2, "#2"), (3, "#3"), (10, None), (11, None), (12, None)]


def test_replace_table_reads_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    for k in (2, 3):
        tables.replace_table(spark.read.parquet(path).withColumn(f"c{k}", F.col("id") * k), path)
    out = spark.read.parquet(path)
    assert out.columns == ["id", "c2", "c3"] and out.agg(F.sum("c3")).first()[0] == 135
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_registry(spark):
    names = ["m/rf_a_20240101_000000", "m/rf_a_20250101_120000", "m/rf_b_20230101_000000_metadata.json", "m/rf_a_clustering_20260101_000000"]
    reg = artifacts.parse_registry(spark.createDataFrame([(n,) for n in names], "path string"))
    assert artifacts.latest_model(reg, "rf_a") == names[1] and artifacts.latest_model(reg, "rf_b") == names[2]
    with pytest.raises(FileNotFoundError):
        artifacts.latest_model(reg, "rf_c")


def test_bucketed_tables_join_without_shuffle(spark):
    a = spark.range(1000).withColumnRenamed("id", "source_id").withColumn("x", F.rand(1))
    for name in ("cat_a", "cat_b"):
        tables.write_bucketed(a, name, buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("cat_a").join(spark.table("cat_b"), "source_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan


def test_ecsv_files_of_different_order(spark, tmp_path):
    head = "# %ECSV 1.0\n# ---\n# delimiter: ','\n# datatype:\n"
    (tmp_path / "1.ecsv").write_text(head + "# - {name: id, datatype: int64}\n# - {name: s, datatype: string}\nid,s\n1,x\n2,y\n")
    (tmp_path / "2.ecsv").write_text(head + "# - {name: s, datatype: string}\n# - {name: id, datatype: int64}\n# - {name: extra, datatype: float64}\ns,id,extra\nw,4,0.5\n# z,3,\n")
    (tmp_path / "3.ecsv").write_text("# %ECSV 1.0\n# meta: made by hand\n" + head.split("\n", 1)[1] + "# - {name: id, datatype: int64}\n# - {name: s, datatype: string}\nid,s\n5,# v\n")
    got = sorted((r["id"], r["s"], r["extra"]) for r in ecsv.read_ecsv(spark, str(tmp_path)).collect())
    assert got == [(1, "x", None), (2, "y", None), (3, "# z", None), (4, "w", 0.5), (5, "# v", None)]
    (tmp_path / "4.ecsv").write_text(head + "# - {name: id, datatype: int64}\n# - {name: s, datatype: string}\nid,s\nsix,u\n")
    with pytest.raises(Exception):
        ecsv.read_ecsv(spark, str(tmp_path)).collect()


def test_fits_scaling_and_unsigned_columns():
    raw = {"B": np.array([0, 255], "u1"), "I": np.array([-32768, 32767], ">i2"), "J": np.array([-(1 << 31), (1 << 31) - 1], ">i4"), "K": np.array([-(1 << 63), (1 << 63) - 1], ">i8")}
    zero = {"B": -128, "I": 1 << 15, "J": 1 << 31, "K": 1 << 63}
    want = {"B": [-128, 127], "I": [0, 65535], "J": [0, (1 << 32) - 1], "K": [0, (1 << 64) - 1]}
    for letter, values in raw.items():
        field = fits.Field("x", letter, 1, zero=Decimal(zero[letter]))
        kind = to_arrow_type(field.type())
        assert [int(v) for v in fits._column(values, field, kind).to_pylist()] == want[letter]
    field = fits.Field("x", "I", 1, null=-5, scale=Decimal("0.25"), zero=Decimal(3))
    assert fits._column(np.array([4, -5], ">i2"), field, to_arrow_type(field.type())).to_pylist() == [4.0, None]
    layout = fits.TableLayout(5760, 10, 100, [])
    assert layout.rows_from(0, 5760) == range(0, 0) and layout.rows_from(0, 5761) == range(0, 1) and layout.rows_from(5765, 10**9) == range(1, 100)


def test_scratch_folders_are_discarded(spark, monkeypatch):
    import os
    from skyfold import session
    monkeypatch.setattr(session, "_made", [])
    table = session.stored(spark.range(3), "mine")
    path = session._made[0]
    assert table.count() == 3 and os.path.isdir(path)
    session.discard_scratch(spark)
    assert not os.path.exists(path) and not session._made

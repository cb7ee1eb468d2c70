from vigil.sources import tables as T


def digests(spark, rows, path):
    spark.createDataFrame(rows, "k long, v string").coalesce(1).write.parquet(str(path))
    return T.file_digests(spark.read.parquet(str(path))).first()


def test_values_order_and_nulls_change_the_digest(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(10_000)]
    first = digests(spark, rows, tmp_path / "a")
    assert (first["rows"], first["columns"]) == (10_000, 2)
    assert digests(spark, rows, tmp_path / "b")["digest"] == first["digest"]
    changed = [*rows[:7000], (7000, "other"), *rows[7001:]]
    swapped = [rows[1], rows[0], *rows[2:]]
    none = [(0, None), *rows[1:]]
    shifted = [(0, "v"), *rows[1:]]
    found = {digests(spark, r, tmp_path / str(i))["digest"] for i, r in enumerate([changed, swapped, none, shifted, rows[:-1]])}
    assert len(found) == 5 and first["digest"] not in found


def test_manifest_of_files_with_different_columns(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(1, "x"), (2, None)], "k long, v string").coalesce(1).write.parquet(f"{tmp_path}/b")
    found = T.file_manifest(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).where("rows is not null").collect()
    assert sorted((r["rows"], r["columns"]) for r in found) == [(2, 2), (10, 1)] and all(r["bytes"] > 0 for r in found)

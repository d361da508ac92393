from oracle import DATA

from stowage.llm import queries


def test_queries_on_null_and_empty_tables(spark, tmp_path):
    for name in ("output_files", "blobs", "documents", "eval_items"):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        blank = spark.createDataFrame([(1,)], "i int").selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in t.schema])
        t.limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
        blank.union(blank).write.parquet(str(tmp_path / "null" / f"{name}.parquet"))
    for kind in ("empty", "null"):
        for name, q in queries.QUERIES.items():
            n = q(spark, str(tmp_path / kind)).count()
            assert n == (2 if kind == "null" and name == "p6_ids" else 0), (kind, name, n)

DOCS = "doc_id long, text string"


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def docs_frame(spark, rows):
    """Documents with columns whose names operators use for their own."""
    wide = [(*r, "src", 0.5, "x") for r in rows]
    return spark.createDataFrame(wide, f"{DOCS}, source string, score double, fingerprint string")

"""Small tables for the operator tests."""

DOCS = "doc_id long, text string"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}

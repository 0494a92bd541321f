"""The derived corpus: one SQL text that Spark and DuckDB both run on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORPUS_SQL = """
SELECT doc_id AS id,
       CASE WHEN doc_id % 10 < 8 THEN 1 WHEN doc_id % 10 = 8 THEN 2 ELSE 3 END AS dataset_id,
       concat('Doc ', CAST(doc_id AS STRING)) AS title,
       source,
       CASE WHEN doc_id % 10 = 7 THEN 'computer_science'
            WHEN doc_id % 10 = 6 AND doc_id % 4 = 0 THEN ''
            WHEN CAST(floor(doc_id / 10) AS BIGINT) % 4 = 0 THEN 'India'
            WHEN CAST(floor(doc_id / 10) AS BIGINT) % 4 = 1 THEN 'United States'
            WHEN CAST(floor(doc_id / 10) AS BIGINT) % 4 = 2 THEN 'Germany'
            ELSE 'Australia' END AS topic,
       CASE WHEN doc_id % 23 = 0 THEN NULL
            WHEN doc_id % 29 = 0 THEN '12 Mar 2021'
            ELSE concat(CAST(2010 + (doc_id * 7 + CAST(floor(doc_id / 40) AS BIGINT)) % 16 AS STRING), '-',
                        lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-',
                        lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END AS created_at,
       CASE WHEN doc_id % 46 = 0 THEN '2020-06-01' ELSE NULL END AS published_at,
       concat(text,
              CASE WHEN doc_id % 5 = 0 THEN ' It is important to note that various factors matter. In conclusion, this article provides a comprehensive overview.'
                   WHEN doc_id % 5 = 1 THEN ' In conclusion it ends.'
                   WHEN doc_id % 5 = 2 THEN ' It should be noted that we delve into it.' ELSE '' END,
              CASE WHEN doc_id % 20 = 0 THEN ' We delve into it.' ELSE '' END,
              CASE WHEN doc_id % 7 = 0 THEN ' The clinical patient.' WHEN doc_id % 7 = 1 THEN ' The software.' WHEN doc_id % 7 = 2 THEN ' The empire.'
                   WHEN doc_id % 7 = 3 THEN ' A quantum.' WHEN doc_id % 7 = 4 THEN ' The genome.' ELSE '' END) AS text
FROM documents
"""
DATASETS_SQL = (
    "SELECT * FROM (VALUES (1, 'Wikipedia', 'WIKIPEDIA_SAMPLE', '2024-01-01'), (2, 'GDELT', 'GDELT', '2024-01-02'), "
    "(3, 'uploads', 'USER_UPLOAD', '2024-01-03'), (4, 'old subset', 'WIKIPEDIA_SUBSET', '2024-01-04')) AS t(dataset_id, name, kind, created_at)"
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CORPUS_SQL.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def datasets(spark: SparkSession) -> DataFrame:
    return spark.sql(DATASETS_SQL)

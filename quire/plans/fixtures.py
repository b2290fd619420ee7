"""Views that give the test tables the shape of recognised pages. Each is one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: documents as pages of books: one book for each source and thousand ids, so that no book grows with the table.
PAGES = """
select book_id, page_num, doc_id,
  600 + doc_id * 13 % 2000 as w, 800 + doc_id * 17 % 2400 as h,
  '<|det|>header[10, 10, 990, 40]<|/det|> ' || book_id || ' ' || chr(10)
  || case when page_num % 7 = 1 then '<|det|>title[100, 50, 900, 120]<|/det|>Chapter ' || cast(page_num as string) || chr(10) || chr(10) else '' end
  || case when page_num % 5 = 2 then '<|det|> heading [100, 50, 900, 120]<|/det|>Part ' || cast(page_num as string) || chr(10) || chr(10) else '' end
  || case when page_num % 11 = 3 then '<|det|>subtitle[100, 50, 900, 120]<|/det|>Sub ' || cast(page_num as string) || chr(10) || chr(10) else '' end
  || replace(replace(text, ', ', '-' || chr(10)), '. ', '”  ' || chr(10) || chr(10) || chr(10))
  || case when doc_id % 3 = 0 then chr(10) || '<|det|>figure[' || cast(doc_id * 37 % 500 as string) || ', ' || cast(doc_id * 53 % 500 as string) || ', '
       || cast(doc_id * 37 % 500 + doc_id * 11 % 400 as string) || ', ' || cast(doc_id * 53 % 500 + doc_id * 7 % 400 as string) || ']<|/det|>' else '' end
  || case when doc_id % 4 = 1 then '<|det|>table[5, 6, ' || cast(6 + doc_id * 3 % 40 as string) || ', 900]<|/det|>' else '' end
  || case when doc_id % 5 = 0 then '<|bbox|1|2|300|400|table|>' else '' end
  || case when doc_id % 6 = 1 then '<|bbox| 7 | 8 | 300 | 401 |>' else '' end
  || case when doc_id % 6 = 0 then '<image>' || chr(10) || chr(10) || chr(10) || '<|image|> <image_1>' || chr(10) else '' end
  || '<|det|>page_number[10, 960, 990, 990]<|/det|>'
  || '<|det|>footer[10, 960, 990, 990]<|/det|> page ' || cast(page_num as string) || ' ' || chr(10) as raw_text
from (
  select book_id, doc_id, text, row_number() over (partition by book_id order by doc_id) as page_num
  from (select source || '-' || cast(cast(floor(doc_id / 1000) as bigint) as string) as book_id, doc_id, text from {documents})
)
"""

#: lineitem as boxes on pages.
BOXES = """
select l_orderkey as k, l_linenumber as n, cast(l_partkey % 1000 as bigint) as x1, cast(l_suppkey % 1000 as bigint) as y1, cast(l_orderkey % 1001 as bigint) as x2,
  cast(l_linenumber * 131 % 1001 as bigint) as y2, cast(600 + l_orderkey * 13 % 2000 as bigint) as w, cast(800 + l_partkey * 17 % 2400 as bigint) as h
from {lineitem}
"""

#: events as a log of jobs.
LOG = """
select user_id as job_id, event_id as seq, ts, event_type as phase, 'event ' || cast(event_id as string) as message,
  cast(event_id % 4 as bigint) * 25 as total, cast(event_id * 7 % 101 as double) as percent, event_id % 3 = 0 as transient, props
from {events}
"""


def view(spark: SparkSession, sf_dir: str, sql: str, **tables: str) -> DataFrame:
    return spark.sql(sql, **{k: spark.read.parquet(f"{sf_dir}/{v}.parquet") for k, v in tables.items()})


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGES, documents="documents")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BOXES, lineitem="lineitem")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LOG, events="events")


def for_oracle(sql: str) -> str:
    return sql.replace("{", "").replace("}", "")

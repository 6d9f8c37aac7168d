"""op8: main text of ``pages``. The scan is not expressible in SQL; tested against the marked content of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.catalog import query
from quayside.llm.main_text import learn, main_texts
from quayside.llm.shared import table


@query("op8_html_extraction")
def html_extraction(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "pages")
    return main_texts(pages, learn(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

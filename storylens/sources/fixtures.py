"""News tables derived from the driver's TPC-H-like tables.

Story = order, article = line item, outlet = supplier; documents are text articles and
embeddings are article vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def outlets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey as outlet_id",
        "s_name as nombre",
        "lower(replace(s_name, '#', '-')) as slug",
        """case s_nationkey % 7 when 0 then 'izquierda' when 1 then 'centro-izquierda'
           when 2 then 'centro' when 3 then 'desconocido' when 4 then 'centro'
           when 5 then 'centro-derecha' else 'derecha' end as sesgo""",
        """case s_suppkey % 5 when 0 then 'alta' when 1 then 'media-alta' when 2 then 'media'
           when 3 then 'media-baja' else 'baja' end as factualidad""",
        "concat('group-', cast(s_suppkey % 8 as string)) as ownership",
        "cast(1 + s_suppkey % 5 as int) as prioridad",
        "s_acctbal >= 0 as active",
    )


def articles(spark: SparkSession, folder: str, titles: bool = True) -> DataFrame:
    """Articles; without ``titles`` the lookup of part names is left out of the plan.

    Names grow with the articles and their file says little of their size in memory, so they are never broadcast.
    """
    lines = table(spark, folder, "lineitem").selectExpr(
        """concat_ws('/', cast(l_orderkey as string), cast(l_linenumber as string),
           cast(l_partkey as string), cast(l_suppkey as string)) as url""",
        "l_orderkey as story_id",
        "l_suppkey as outlet_id",
        "l_partkey",
        "l_shipdate as fecha_pub",
        """case when l_linenumber % 3 <> 0 then concat('img/', cast(l_orderkey as string), '-',
           cast(l_linenumber as string)) end as imagen_url""",
    )
    if not titles:
        return lines.drop("l_partkey")
    names = table(spark, folder, "part").selectExpr("p_partkey as l_partkey", "p_name as titulo")
    return lines.join(names.hint("merge"), "l_partkey", "left").select(
        "url", "story_id", "outlet_id", "titulo", "fecha_pub", "imagen_url"
    )


def follows(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .filter("event_type = 'signup'")
        .selectExpr("user_id", "cast(event_id % 10 as bigint) as outlet_id")
        .distinct()
    )


def subscribers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey as subscriber_id",
        "case when c_custkey % 2 = 0 then 'daily' else 'weekly' end as frequency",
        "case when c_custkey % 5 <> 0 then timestamp '2024-01-01 00:00:00' end as verified_at",
        "case when c_custkey % 3 <> 0 then timestamp '2024-01-29 22:30:00' end as last_digest_sent_at",
    )


def text_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: title is the whole first line, summary the whole text."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "cast(floor(doc_id / 4) as bigint) as story_id",
        "doc_id % 20 as outlet_id",
        "split_part(text, chr(10), 1) as titulo",
        "text as resumen",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 7919 % 10080 as int)) as fecha_pub",
        "source",
        "lang",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def vector_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as articles of 20 outlets over seven days, titled after their label."""
    return vectors(spark, folder).selectExpr(
        "vec_id as article_id",
        "vec_id % 20 as outlet_id",
        "concat('Caso Protagonista', cast(label as string)) as titulo",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(vec_id * 7919 % 10080 as int)) as fecha_pub",
        "embedding",
        "cast(floor(vec_id / 4) as bigint) as story_id",
    )


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def latest(df: DataFrame, column: str = "fecha_pub"):
    """Newest timestamp of a table as a scalar subquery: the tables' own ``as_of``."""
    return df.agg(F.max(column)).scalar()

"""Literature-shaped views over the star-schema tables: papers, edges, authorship, texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Plain SQL of each view; Spark and DuckDB both run it.
SQL = {
    "lit_papers": """select p.p_partkey as paper_id, p.p_name as title, p.p_brand as venue, 1975 + p.p_size as year,
       case when p.p_partkey % 17 = 0 then null else coalesce(c.n, 0) end as citation_count
from part p left join (select l_partkey, count(distinct l_orderkey) as n from lineitem group by l_partkey) c on c.l_partkey = p.p_partkey""",
    "lit_refs": "select distinct l_orderkey as citing_id, l_partkey as cited_id from lineitem",
    "lit_dag": "select distinct least(a, b) as src, greatest(a, b) as dst from (select l_partkey as a, l_suppkey * 37 + l_orderkey as b from lineitem) t where a <> b",
    "lit_cyc": "select distinct l_partkey as src, l_suppkey * 37 + l_orderkey as dst from lineitem",
    # some lines only, for what needs a matrix of all vertices
    "lit_dag_folded": """select distinct least(a, b) as src, greatest(a, b) as dst from (
  select l_partkey % 300 as a, (l_suppkey * 37 + l_orderkey) % 300 as b from lineitem where l_linenumber = 1 and l_orderkey % 10 = 0) t where a <> b""",
    "lit_authorship": "select distinct l_partkey as paper_id, l_suppkey as author_id from lineitem",
    "lit_abstracts": "select doc_id as paper_id, split_part(text, '\n', 1) as title, text as abstract, lang, source as venue from documents",
    "lit_vectors": "select vec_id as paper_id, embedding, label from embeddings",
}
_TABLES = {"lit_papers": ("part", "lineitem"), "lit_abstracts": ("documents",), "lit_vectors": ("embeddings",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES.get(name, ("lineitem",))}
    sql = SQL[name]
    # DataFrames as arguments: no temporary view is left behind
    for t in tables:
        sql = sql.replace(f"from {t}", "from {" + t + "}")
    return spark.sql(sql, **tables)


def with_views(body: str, *names: str) -> str:
    """SQL for DuckDB: body with the named views in front."""
    head = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {head},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[len('with '):]}"
    return f"with {head}\n{body}"

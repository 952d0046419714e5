"""Labels of a graph's papers by a model, and the annotated graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_label
from .acquire import labels, salvage
from .output import write_graphml
from .verdicts import maker

#: What a model is told; the instruction says what the label should be.
TASK = 'You label papers. For each paper reply {"results": [{"index": number, "label": text}]}.'


def _parsed(reply: str) -> dict[int, str]:
    """Labels by index of a reply; entries without a whole index or a text are left out."""
    rows = (salvage(reply) or {}).get("results")
    out: dict[int, str] = {}
    for r in rows if isinstance(rows, list) else []:
        if isinstance(r, dict) and isinstance(r.get("label"), str):
            try:
                out.setdefault(int(r.get("index")), r["label"])
            except (TypeError, ValueError):
                pass
    return out


def _ask(model: str, instruction: str, batch: int):
    make = maker(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def reply(titles: list[str], abstracts: list[str]) -> dict[int, str]:
            papers = [f"Paper index={i}\nTitle: {t}\nAbstract: {a}" for i, (t, a) in enumerate(zip(titles, abstracts), 1)]
            try:
                return _parsed(call(TASK, instruction + "\n\n" + "\n\n".join(papers), 0))
            except Exception:  # these papers are asked about singly, then keep their titles
                return {}

        for f in frames:
            titles, abstracts = f["title"].fillna("").tolist(), f["abstract"].fillna("").tolist()
            got: list[str | None] = []
            for i in range(0, len(f), batch):
                t, a = titles[i : i + batch], abstracts[i : i + batch]
                found = reply(t, a)
                got += [found.get(k) or (reply([t[k - 1]], [a[k - 1]]).get(1) if len(t) > 1 else None) for k in range(1, len(t) + 1)]
            yield pd.DataFrame({"paper_id": f["paper_id"], "label": pd.Series(got, dtype=object)})

    return run


def model_labels(papers: DataFrame, instruction: str, model: str = "stub", batch: int = 20) -> DataFrame:
    """(paper_id, label) that a model gives papers (paper_id, title, abstract) by the instruction, cleaned, null where it gives none.

    Papers go in batches; those that a reply leaves out are asked about once more, singly. No id is shown,
    so none can come back as a label.
    """
    kind = dict(papers.dtypes)["paper_id"]
    got = papers.select("paper_id", "title", "abstract").mapInPandas(_ask(model, instruction, max(1, batch)), f"paper_id {kind}, label string")
    return got.select("paper_id", F.nullif(clean_label("label"), F.lit("")).alias("label"))


def annotate(vertices: DataFrame, instruction: str, model: str = "stub", batch: int = 20, limit: int | None = None) -> DataFrame:
    """Vertices (id, attrs) with the attribute `label`, and the title, where there is one, as `original_title` too.

    With a limit only the first papers by id are asked about. A paper without a model's label has the first 40
    characters of its title, or `?`.
    """
    title = F.coalesce(F.try_element_at("attrs", F.lit("title")), F.lit(""))
    p = vertices.select(F.col("id").alias("paper_id"), title.alias("title"), F.coalesce(F.try_element_at("attrs", F.lit("abstract")), F.lit("")).alias("abstract"))
    asked = p if limit is None else p.orderBy("paper_id").limit(limit)
    got = labels(p, model_labels(asked, instruction, model, batch)).select(F.col("paper_id").alias("id"), F.coalesce(F.nullif("label", F.lit("")), F.lit("?")).alias("label"))
    more = F.map_from_arrays(F.array(F.lit("label")), F.array("label"))
    titled = F.when(F.map_contains_key("attrs", "title"), F.map_from_arrays(F.array(F.lit("original_title")), F.array(F.try_element_at("attrs", F.lit("title"))))).otherwise(F.map_filter("attrs", lambda k, v: F.lit(False)))
    kept = F.map_filter("attrs", lambda k, v: ~k.isin("label", "original_title"))
    return vertices.join(got, "id").select("id", F.map_concat(kept, titled, more).alias("attrs"))


def with_columns(df: DataFrame) -> DataFrame:
    """attrs as one column a name, in the order of names; their names reach the driver."""
    names = [r[0] for r in df.select(F.explode(F.map_keys("attrs"))).distinct().orderBy("col").collect()]
    return df.select(*(c for c in df.columns if c != "attrs"), *(F.try_element_at("attrs", F.lit(n)).alias(n) for n in names if n not in df.columns))


def write_annotated(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    write_graphml(with_columns(vertices), with_columns(edges), path)


def summary(graph: str, weight: str, search: str, cycles: str, arcs: DataFrame, vertices: DataFrame, n_vertices: int, n_edges: int) -> DataFrame:
    """Lines of a JSON summary of a main path: a line that says how it was made and its counts, then a line for each paper in order of level and id.

    arcs (src, dst, w as digits), vertices (id, role, level, attrs); n_vertices and n_edges are of the graph that it comes from.
    """
    spark = arcs.sparkSession
    size = F.struct(F.char_length("w"), "w")  # digits compare by their number first
    most = arcs.agg(F.max_by("w", size)).first()[0]
    head = {
        "input_graph": graph, "weight_variant": weight, "search_variant": search, "cycle_policy": cycles,
        "stats": {"n_input_nodes": n_vertices, "n_input_edges": n_edges, "n_mainpath_nodes": vertices.count(), "n_mainpath_edges": arcs.count(), "max_weight": most},
    }
    of = lambda n: F.nullif(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    line = F.to_json(F.struct(F.col("id").alias("paper_id"), "role", "level", of("title").alias("title"), of("year").try_cast("int").alias("year"), of("venue").alias("venue")))
    rows = vertices.select(F.col("level").alias("at"), "id", line.alias("line"))
    first = spark.createDataFrame([(json.dumps(head),)], "line string").select(F.lit(-1).alias("at"), F.lit("").alias("id"), "line")
    return first.union(rows).orderBy("at", "id").select("line")

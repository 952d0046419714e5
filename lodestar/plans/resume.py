"""State of a run after each step, so that a broken run goes on and a later run starts from what an earlier one found.

A state is a folder of tables and a `state` file that is written last; without that file the state does not
exist. A table that a step did not change is named by its path and not written again.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Attributes of a run that are one table, lists of tables, and tables by name.
ONE, LISTS, NAMED = ("collection", "seen", "rejected", "quotes", "resolved", "alias"), ("judged",), ("clusters", "names")
#: Attributes that are values.
VALUES = ("shape", "events", "tokens", "requests", "iteration")
#: What a paper of an earlier run was expanded by.
WAYS = ("forward", "backward", "pdf")


def chain(run, steps: list[dict]) -> list[str]:
    """A digest for each step that covers it, the steps before it, the settings, and the corpus.

    Of the corpus its `version`, columns and numbers of papers and edges count: changed rows of the same number need another version.
    """
    s, c = run.settings, run.corpus
    about = {
        "seeds": [vars(p) for p in s.seed_papers], "blocks": s.blocks, "model": s.screening_model, "topic": s.topic_description,
        "corpus": [c.version, c.papers.columns, c.papers.count(), c.edges.count()], "given": run.given,
    }
    at, out = hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest(), []
    for spec in steps:
        at = hashlib.sha256(json.dumps([at, spec], sort_keys=True, default=str).encode()).hexdigest()
        out.append(at)
    return out


class States:
    """The states of runs below one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._kept: dict[int, tuple[DataFrame, str]] = {}  # the tables themselves too, so that no id is used twice

    def _lines(self, path: str) -> list[str] | None:
        try:
            return [r[0] for r in self.spark.read.text(path, wholetext=True).collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _write(self, df: DataFrame, path: str) -> dict:
        if id(df) not in self._kept:
            df.write.mode("overwrite").parquet(path)
            self._kept[id(df)] = (df, path)
        return {"path": self._kept[id(df)][1], "schema": df.schema.json()}

    def _read(self, ref: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        df = self.spark.read.schema(StructType.fromJson(json.loads(ref["schema"]))).parquet(ref["path"])
        self._kept[id(df)] = (df, ref["path"])
        return df

    def save(self, digest: str, run, signal: DataFrame, ended: bool) -> None:
        """The run after a step; ended tells that no further step but the last is due."""
        at = f"{self.base}/{digest}"
        tables = {"signal": signal} | {n: getattr(run, n) for n in ONE}
        for n in LISTS:
            tables |= {f"{n}/{i}": t for i, t in enumerate(getattr(run, n))}
        for n in NAMED:
            tables |= {f"{n}/{k}": t for k, t in getattr(run, n).items()}
        # of the corpus, what steps have changed
        for f in fields(run.corpus):
            now, old = getattr(run.corpus, f.name), getattr(run.original, f.name)
            if isinstance(now, DataFrame) and now is not old:
                tables[f"corpus/{f.name}"] = now
            elif isinstance(now, list) and now is not old:
                tables |= {f"corpus/{f.name}/{i}/{name}": t for i, (name, t) in enumerate(now)}
        refs = {k: self._write(t, f"{at}/table-{i}") for i, (k, t) in enumerate(tables.items()) if t is not None}
        state = {"tables": refs, "ended": ended, "done": sorted(run.done)} | {v: getattr(run, v) for v in VALUES}
        self.spark.createDataFrame([(json.dumps(state, default=str),)], "line string").coalesce(1).write.mode("overwrite").text(f"{at}/state")
        self.spark.createDataFrame([(digest,)], "line string").coalesce(1).write.mode("overwrite").text(f"{self.base}/newest")

    def load(self, digest: str) -> dict | None:
        lines = self._lines(f"{self.base}/{digest}/state")
        return json.loads("".join(lines)) if lines else None

    def newest(self) -> dict | None:
        lines = self._lines(f"{self.base}/newest")
        return self.load("".join(lines).strip()) if lines else None

    def restore(self, run, state: dict) -> DataFrame:
        """The run as it was; gives the signal."""
        t = {k: self._read(r) for k, r in state["tables"].items()}
        for n in ONE:
            setattr(run, n, t.get(n))
        for n in LISTS:
            setattr(run, n, [t[k] for k in sorted((k for k in t if k.startswith(f"{n}/")), key=lambda k: int(k.split("/")[1]))])
        for n in NAMED:
            setattr(run, n, {k.split("/", 1)[1]: x for k, x in t.items() if k.startswith(f"{n}/")})
        for v in VALUES:
            setattr(run, v, state[v])
        run.done = set(state["done"])
        changed: dict = {}
        for k, x in t.items():
            if k.startswith("corpus/"):
                _, name, *more = k.split("/", 3)
                if more:
                    changed.setdefault(name, []).append((int(more[0]), more[1], x))
                else:
                    changed[name] = x
        run.corpus = replace(run.corpus, **{n: [(name, x) for _, name, x in sorted(v, key=lambda r: r[0])] if isinstance(v, list) else v for n, v in changed.items()})
        return t["signal"]


def continue_from(run, base: str) -> None:
    """The newest state below base as what the run already knows: its papers are in the collection and expanded, all it saw stays seen, its rejections and aliases hold.

    No step counts as done.
    """
    states = States(run.spark, base)
    old = states.newest()
    if old is None:
        raise ValueError(f"no state of a run below {base}")
    read = lambda n: states._read(old["tables"][n]) if n in old["tables"] else None
    for n in ("collection", "seen", "rejected", "quotes", "alias"):
        setattr(run, n, read(n))
    for way in WAYS:
        run.clusters[f"_{way}"] = run.collection.select("paper_id")
    run.iteration = old["iteration"] + 1
    run.given = f"{base}#{run.iteration}"

"""Settings, the pipeline's parts by name, and static checks of a configuration."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from ..operators import screening as S

SECRET_KEYS = ("api_key", "s2_api_key", "openai_api_key", "gemini_api_key")
ENV = {"LODESTAR_MAX_PAPERS": ("max_papers", int), "LODESTAR_MAX_TOKENS": ("max_tokens", int), "LODESTAR_MAX_REQUESTS": ("max_requests", int), "LODESTAR_MODEL": ("screening_model", str), "LODESTAR_DATA_DIR": ("data_dir", str)}


class ConfigError(ValueError):
    pass


@dataclass
class SeedPaper:
    paper_id: int | str | None = None
    title: str = ""
    abstract: str | None = None


@dataclass
class ModelEndpoint:
    """How a registered model is reached; the key's environment variable is named, never the key."""

    name: str
    base_url: str | None = None
    api_key_env: str | None = None
    reasoning_effort: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Settings:
    screening_model: str = "stub"
    data_dir: str = "out"
    topic_description: str = ""
    max_papers: int = 2000
    max_tokens: int = 10**9
    max_requests: int = 10**9
    llm_batch_size: int = 20
    reply_memo: str = ""
    state_dir: str = ""
    start_from: str = ""
    seed_papers: list[SeedPaper] = field(default_factory=list)
    models: dict[str, ModelEndpoint] = field(default_factory=dict)
    blocks: dict[str, dict] = field(default_factory=dict)
    pipeline: list[dict] = field(default_factory=list)

    def screener(self, name: str | dict) -> S.Block:
        return build_block(name, self.blocks)


def load_settings(source: str | dict, overrides: dict | None = None) -> Settings:
    """From YAML or a dict; overrides win over the file, environment variables over both. Keys in the file are an error."""
    if isinstance(source, str):
        import yaml

        with open(source) as f:
            raw = yaml.safe_load(f) or {}
    else:
        raw = dict(source)
    if found := [k for k in SECRET_KEYS if raw.get(k)]:
        raise ConfigError(f"secrets belong in the environment, not in the file: {found}")
    raw |= overrides or {}
    for var, (key, kind) in ENV.items():
        if os.environ.get(var):
            raw[key] = kind(os.environ[var])
    if unknown := set(raw) - set(Settings.__dataclass_fields__):
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    raw["seed_papers"] = [SeedPaper(**p) if isinstance(p, dict) else SeedPaper(paper_id=p) for p in raw.get("seed_papers", [])]
    raw["models"] = {k: ModelEndpoint(name=k, **v) for k, v in raw.get("models", {}).items()}
    out = Settings(**raw)
    for name in out.blocks:
        build_block(name, out.blocks)
    check(out)
    return out


_ATOMS = {"YearFilter": S.YearFilter, "CitationFilter": S.CitationFilter, "VenueIn": S.VenueIn, "VenuePreset": S.VenuePreset, "CitAtLeast": S.CitAtLeast, "YearAtLeast": S.YearAtLeast}
_KEYWORDS = {"TitleKeywordFilter": "title", "AbstractKeywordFilter": "abstract", "VenueKeywordFilter": "venue"}
#: Fixed value: the embedder that stands for the vectors stored with the papers.
STORED = "s2"
_MEASURES = {"RefSim": S.RefSim, "CitSim": S.CitSim, "SemanticSim": S.SemanticSim}


def build_block(spec: str | dict, named: dict[str, dict], above: tuple[str, ...] = ()) -> S.Block:
    """A screener's block from its name or inline spec {type, ...}; names are looked up when met, and circles are an error."""
    if isinstance(spec, str):
        if spec in above:
            raise ConfigError(f"blocks refer to each other in a circle: {' > '.join((*above, spec))}")
        if spec not in named:
            raise ConfigError(f"unknown block {spec!r}")
        return build_block({"name": spec} | named[spec], named, (*above, spec))
    spec = dict(spec)
    kind = spec.pop("type", None)
    inner = lambda x: build_block(x, named, above)
    try:
        if kind in _ATOMS:
            tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items()}
            if kind == "CitationFilter" and "reference_year" not in tuples:
                raise ConfigError("CitationFilter needs reference_year: results must not depend on the clock")
            name = tuples.pop("name", None)
            block = _ATOMS[kind](**tuples)
            if name and kind in ("VenueIn", "VenuePreset", "CitAtLeast", "YearAtLeast"):
                block.name = name
            return block
        if kind in _KEYWORDS:
            return S.KeywordFilter(_KEYWORDS[kind], **spec)
        if kind == "LLMFilter":
            name = spec.get("name", "llm")
            return S.Verdict(f"verdict_{name}", name)
        if kind == "Sequential":
            return S.Sequential([inner(x) for x in spec.get("layers", [])], spec.get("name", "sequential"))
        if kind == "Any":
            return S.AnyOf([inner(x) for x in spec.get("layers", [])], spec.get("name", "any"))
        if kind == "Not":
            return S.Not(inner(spec["layer"]))
        if kind == "Route":
            cases = [(inner(c["if"]), inner(c["pass_to"])) for c in spec.get("routes", []) if "if" in c]
            rest = [c["default"] for c in spec.get("routes", []) if "default" in c]
            return S.Route(cases, inner(rest[0]) if rest else None, spec.get("name", "route"))
        if kind == "SimilarityFilter":
            measures = []
            for m in spec.get("measures", []):
                m = {"type": m} if isinstance(m, str) else dict(m)
                embedder = m.pop("embedder", STORED)
                if embedder != STORED:
                    raise ConfigError(f"embedder {embedder!r}: only the corpus's own vectors ({STORED!r}) are known")
                measures.append(_MEASURES[m.pop("type")](**m))
            return S.SimilarityFilter(measures, spec.get("threshold", 0.10), spec.get("on_no_data", "pass"), spec.get("name", "similarity"))
    except (TypeError, KeyError) as e:
        raise ConfigError(f"bad block {kind}: {e}") from e
    raise ConfigError(f"unknown block type {kind!r}")


def walk(spec: str | dict, named: dict[str, dict]):
    """All specs below one, names resolved."""
    spec = named.get(spec, {}) if isinstance(spec, str) else spec
    yield spec
    for k in ("layers", "routes"):
        for x in spec.get(k, []):
            for y in [x] if k == "layers" else [v for v in x.values()]:
                yield from walk(y, named)
    if "layer" in spec:
        yield from walk(spec["layer"], named)


SOURCELESS = ("ExpandBySearch", "ExpandBySemantics", "ExpandByAuthor", "ExpandByPDF", "ReScreen")


def warnings(settings: Settings) -> list[str]:
    """Steps whose candidates have no source, but whose screener compares with one."""
    out = []
    for i, step in enumerate(settings.pipeline):
        if step.get("step") in SOURCELESS and step.get("screener") is not None:
            if any(s.get("type") == "SimilarityFilter" for s in walk(step["screener"], settings.blocks)):
                out.append(f"step {i} ({step['step']}): similarity to a source has no data here and its on_no_data decides")
    return out


def check(settings: Settings) -> None:
    """Every model that a step or block names must be registered or an endpoint."""
    from ..operators.verdicts import _models

    known = set(_models) | set(settings.models)
    for s in [x for b in settings.blocks for x in walk(b, settings.blocks)] + settings.pipeline:
        for m in (s.get("model"), (s.get("agent") or {}).get("model")):
            if m and m not in known:
                raise ConfigError(f"unknown model {m!r}")
    for step in settings.pipeline:
        if step.get("screener") is not None:
            build_block(step["screener"], settings.blocks)

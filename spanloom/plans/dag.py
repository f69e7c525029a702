"""Named DataFrame steps composed into pipelines: a spec says which keys each step reads and writes.

Composing builds one logical plan; nothing runs until the result is used.  Steps fire in order of their inputs,
so a spec's order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import Head, combine_models, route, score_all, skipped, threshold_tags

Step = Callable[..., object]
_steps: dict[str, Step] = {}
_macros: dict[str, Callable[[list[str], list[str], list["Model"]], list["Node"]]] = {}


def step(name: str):
    """O-111: register a function of the input values; it returns a value, or a tuple for several outputs."""

    def add(f: Step) -> Step:
        _steps[name] = f
        return f

    return add


def macro(name: str):
    """O-115: register a function that expands one node into several."""

    def add(f):
        _macros[name] = f
        return f

    return add


@dataclass
class Model:
    """D7: a scoring model: rows of (media_id, frame_index, frame) to (media_id, frame_index, model, scores)."""

    name: str
    identifier: int
    version: float
    categories: list[str]
    score: Callable[[DataFrame], DataFrame]
    tags: DataFrame
    mappings: DataFrame
    threshold: float = 0.5
    image_size: int = 224
    normalisation: int = 0
    type: str = "tag"
    head: Head | None = None  # where all models of a call have one, they share a pass over the frames


@dataclass
class Node:
    name: str
    inputs: list[str]
    outputs: list[str]
    run: Step


def _strings(x) -> bool:
    return isinstance(x, list) and bool(x) and all(isinstance(i, str) for i in x)


@dataclass
class Pipeline:
    """O-114: a validated spec with its models."""

    spec: dict
    models: list[Model] = field(default_factory=list)

    def __post_init__(self):
        s = self.spec
        if not _strings(s.get("inputs")):
            raise ValueError("inputs must be a list of strings, not empty")
        if not s.get("output") or not s.get("short_name") or s.get("version") is None:
            raise ValueError("output, short_name and version must be given")
        if not isinstance(s.get("models"), list):
            raise ValueError("models must be a list")
        check_models(self.models)
        self.nodes: list[Node] = []
        for m in s["models"]:
            if not m.get("name") or not _strings(m.get("inputs")):
                raise ValueError("each model needs a name and inputs")
            name, inputs, outputs = m["name"], m["inputs"], m.get("outputs") or []
            if name in _macros:
                self.nodes += _macros[name](inputs, outputs, self.models)
            elif name in _steps:
                self.nodes.append(Node(name, inputs, outputs, _steps[name]))
            else:
                raise ValueError(f"no step is called {name!r}")

    def run(self, *values):
        """The output key's value, for the inputs in the spec's order."""
        if len(values) != len(self.spec["inputs"]):
            raise ValueError(f"{len(self.spec['inputs'])} inputs are needed, {len(values)} given")
        have = dict(zip(self.spec["inputs"], values))
        todo = list(self.nodes)
        while self.spec["output"] not in have:
            ready = next((n for n in todo if all(i in have for i in n.inputs)), None)
            if ready is None:
                raise ValueError(f"nothing produces {self.spec['output']!r}; missing {sorted({i for n in todo for i in n.inputs} - set(have))}")
            todo.remove(ready)
            got = ready.run(*(have[i] for i in ready.inputs))
            have.update(zip(ready.outputs, got if isinstance(got, tuple) else (got,)))
        return have[self.spec["output"]]

    def model_rows(self) -> list[dict]:
        """D7, O-122: what the pipeline's models are."""
        return [{"name": m.name, "identifier": m.identifier, "version": m.version, "categories": m.categories, "type": m.type} for m in self.models]


def check_models(models: list[Model]) -> None:
    """O-85, O-86: no category twice, one picture size and normalisation."""
    categories = [c for m in models for c in m.categories]
    if len(set(categories)) < len(categories):
        raise ValueError("two models claim one category")
    if len({(m.image_size, m.normalisation) for m in models}) > 1:
        raise ValueError("models must agree on image size and normalisation")


class Registry:
    """O-113, O-121: pipelines by name; an unknown name is an error."""

    def __init__(self):
        self._pipelines: dict[str, Pipeline] = {}

    def add(self, name: str, pipeline: Pipeline) -> None:
        self._pipelines[name] = pipeline

    def get(self, name: str) -> Pipeline:
        if name not in self._pipelines:
            raise ValueError(f"no pipeline is called {name!r}")
        return self._pipelines[name]

    def names(self) -> list[str]:
        return sorted(self._pipelines)


def score_frames(frames: DataFrame, models: list[Model], threshold: float | None, skip: list[str], with_confidence: bool) -> DataFrame:
    """O-41 to O-44, O-48, O-72: detections of all models that are not skipped, in long form.

    The skip list is known when the plan is built, so a skipped model is not in it at all.
    """
    parts, used = [], [m for m in models if not set(m.categories) <= set(skip)]
    if used and all(m.head for m in used):
        found = score_all(frames, [m.head for m in used], threshold).drop("model")
        return found if with_confidence else found.withColumn("confidence", F.lit(None).cast("double"))
    for m in used:
        found = route(threshold_tags(m.score(frames), m.tags, threshold, m.threshold), m.mappings)
        parts.append(found if with_confidence else found.withColumn("confidence", F.lit(None).cast("double")))
    if not parts:
        kinds = "media_id long, category string, tag string, frame_index double, confidence double"
        return frames.sparkSession.createDataFrame([], kinds)
    return combine_models(*parts)


@macro("score_media")
def _score_media(inputs: list[str], outputs: list[str], models: list[Model]) -> list[Node]:
    """frames, threshold, with_confidence, skip to detections."""
    return [Node("score_media", inputs, outputs, lambda frames, threshold, confident, skip: score_frames(frames, models, threshold, skip or [], confident))]


def skipped_models(models: DataFrame, skip: list[str]) -> DataFrame:
    """O-48 on a table of models."""
    return models.where(skipped(F.col("categories"), F.array(*map(F.lit, skip)).cast("array<string>")))

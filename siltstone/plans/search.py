"""Parameter search and validation on the driver: run configurations, grids, the experiment log."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from itertools import product

# What a run may set: kind, smallest and largest value or the choices.
SPACE = {
    "retriever": (str, ("dense", "hybrid", "graph", "hybrid_graph", "unified", "unified_graph")), "k": (int, (3, 15)), "dense_weight": (float, (0.1, 0.9)), "use_reranker": (bool, (False, True)),
    "candidates": (int, (2, 8)), "expand": (bool, (False, True)), "prompt_version": (int, (1, 3)),
}
TARGETS = {"keyword_recall": 0.67, "word_f1": 0.30, "citation_faithfulness": 0.95}


# What counts as yes, and the model backends with their default first.
TRUTHY = ("1", "true", "yes", "on")
BACKENDS = ("copilot", "cerebras")


def truthy(value: str | None, default: bool = False) -> bool:
    """A switch from the environment: unset is the default, anything but a yes is no."""
    return default if value is None else value.strip().lower() in TRUTHY


def backend(name: str | None = None, configured: str | None = None) -> str:
    """The model backend that was asked for, else the configured one, else the first."""
    chosen = (name or configured or BACKENDS[0]).strip().lower()
    if chosen not in BACKENDS:
        raise ValueError(f"unknown backend {chosen!r}, not one of {', '.join(sorted(BACKENDS))}")
    return chosen


@dataclass(frozen=True)
class RunConfig:
    retriever: str = "hybrid"
    k: int = 8
    dense_weight: float = 0.3
    use_reranker: bool = False
    candidates: int = 4
    expand: bool = False
    prompt_version: int = 3

    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, validated(f.name, getattr(self, f.name)))

    @property
    def weights(self) -> tuple[float, float]:
        return self.dense_weight, round(1 - self.dense_weight, 2)

    def label(self) -> str:
        parts = [self.retriever, f"k{self.k}", "rerank" if self.use_reranker else "", "qexp" if self.expand else "", f"p{self.prompt_version}"]
        return "_".join(p for p in parts if p)


def validated(name: str, value):
    """The value in its kind; whole floats pass as ints and ints as floats. Anything out of range is an error."""
    kind, allowed = SPACE[name]
    if kind is int and isinstance(value, float) and value.is_integer():
        value = int(value)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise ValueError(f"{name} must be {kind.__name__}, not {value!r}")
    if kind in (str, bool):
        ok = value in allowed
    else:
        ok = allowed[0] <= value <= allowed[1]
    if not ok:
        raise ValueError(f"{name}={value!r} is not within {allowed}")
    return value


def grid(**choices: list) -> Iterator[RunConfig]:
    for point in product(*choices.values()):
        yield RunConfig(**dict(zip(choices, point, strict=True)))


def composite(metrics: dict) -> float:
    f1 = metrics.get("word_f1")
    kw = metrics.get("keyword_recall") or 0.0
    return round(kw if f1 is None else 0.5 * kw + 0.5 * f1, 4)


def reached(metrics: dict) -> bool:
    return all((metrics.get(n) or 0.0) >= t for n, t in TARGETS.items())


def search(configs: Iterator[RunConfig], evaluate: Callable[[RunConfig], dict], budget: int) -> list[dict]:
    """Log rows of the runs made: until the targets are reached or the budget is spent. A failing run is logged and passed over."""
    log: list[dict] = []
    for i, config in enumerate(configs, 1):
        if i > budget:
            break
        try:
            metrics = evaluate(config)
            row = {"exp_id": i, **asdict(config), **metrics, "score": composite(metrics), "status": "ok", "reason": ""}
        except Exception as e:  # a run's failure is a result of the search
            row = {"exp_id": i, **asdict(config), "score": None, "status": "failed", "reason": str(e)[:200]}
        log.append(row)
        if row["status"] == "ok" and reached(row):
            break
    return log


def best(log: list[dict]) -> dict | None:
    done = [r for r in log if r["status"] == "ok"]
    return max(done, key=lambda r: (r["score"], -r["exp_id"]), default=None)

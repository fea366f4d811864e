"""The experiment engine: fitness of propagation parameters, hill climbing, review of plateaus."""

from __future__ import annotations

import json
import math
import os
import re
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.confidence import clamp

from .chain import ChainWriter
from .graph import Graph
from .stats import graph_density

# Parameters, their defaults and bounds.
DEFAULTS = {"confidence_threshold": 0.75, "max_depth": 5.0, "attenuation_factor": 0.85}
BOUNDS = {"confidence_threshold": (0.01, 0.99), "attenuation_factor": (0.1, 2.0), "max_depth": (1.0, 20.0)}
SAMPLE = 10
PLATEAU, RESTART_AT, BASE_SCALE = 10, 3, 0.1
#: Fitness values this close count as equal, so that stability decides.
EQUAL = 1e-4


def sampled_symbols(graph: Graph) -> DataFrame:
    """The first symbols with a span, by address: the sample that fitness is taken over."""
    return graph.nodes.where("kind = 'Symbol' and span is not null").orderBy("address").limit(SAMPLE).select(F.col("address").alias("node"))


def impact_accuracy(graph: Graph, params: dict[str, float]) -> float:
    """Mean score that siblings of the sampled symbols get from their common parent, all parents in one loop."""
    picked = sampled_symbols(graph)
    contains = graph.edges.where("relation = 'Contains'").select(F.col("source").alias("root"), F.col("target").alias("sibling"))
    held = contains.withColumnRenamed("sibling", "node").join(F.broadcast(picked), "node")  # the sample's few rows
    scores = graph.attenuated(held.select(F.col("root").alias("node")).distinct(), params["attenuation_factor"], params["confidence_threshold"])
    pairs = contains.join(held, "root").where("sibling <> node")
    got = pairs.join(scores.select("root", F.col("node").alias("sibling"), "score"), ["root", "sibling"], "left")
    return got.agg(F.avg(clamp(F.coalesce("score", F.lit(0.0))))).first()[0] or 0.0


def stability(graph: Graph, params: dict[str, float]) -> float:
    """1 less the mean change of scores when the attenuation falls by a tenth; 1 for nothing reached."""
    picked = sampled_symbols(graph)
    runs = [graph.attenuated(picked, params["attenuation_factor"] * f, params["confidence_threshold"]).withColumnRenamed("score", f"s{i}") for i, f in enumerate((1.0, 0.9))]
    both = runs[0].join(runs[1], ["root", "node"], "full_outer")
    change = both.agg(F.avg(F.abs(F.coalesce("s0", F.lit(0.0)) - F.coalesce("s1", F.lit(0.0))))).first()[0]
    return 1.0 if change is None else 1.0 - change


def propagation_depth(graph: Graph, params: dict[str, float]) -> float:
    """Mean of the reached nodes over max_depth, at most 1."""
    reached = graph.attenuated(sampled_symbols(graph), params["attenuation_factor"], params["confidence_threshold"]).groupBy("root").count()
    return reached.agg(F.avg(F.least(F.col("count") / F.lit(params["max_depth"]), F.lit(1.0)))).first()[0] or 0.0


def density(graph: Graph, params: dict[str, float]) -> float:
    return graph_density(graph.nodes, graph.edges).first().density


def cycle_time(graph: Graph, params: dict[str, float]) -> float:
    began = time.monotonic()
    impact_accuracy(graph, params)
    return max(0.0, 1 - (time.monotonic() - began) * 1000 / 5000)


#: Fitness functions by name; callers may add their own.  Unknown names score 0.
FITNESS: dict[str, Callable[[Graph, dict[str, float]], float]] = {
    "ImpactAccuracy": impact_accuracy,
    "Stability": stability,
    "PropagationDepth": propagation_depth,
    "GraphDensity": density,
    "CycleTime": cycle_time,
}


@dataclass(frozen=True)
class Result:
    fitness: float
    stability: float
    cycle_ms: int
    status: str
    params: dict[str, float]


def run_experiment(graph: Graph, params: dict[str, float], fitness: str) -> Result:
    """Fail for a fitness that is no number, inconclusive for zero, else pass."""
    began = time.monotonic()
    score = FITNESS.get(fitness, lambda g, p: 0.0)(graph, params)
    steady = stability(graph, params)
    status = "fail" if not math.isfinite(score) else "inconclusive" if score == 0 else "pass"
    return Result(score, steady, int((time.monotonic() - began) * 1000), status, params)


def better(new: Result, best: Result | None) -> bool:
    """More fitness, however little, or about as much and more stability."""
    if best is None:
        return new.status != "fail"
    return new.fitness > best.fitness or (abs(new.fitness - best.fitness) < EQUAL and new.stability > best.stability)


def kept_log(runs: DataFrame, run: str = "run", order: str = "iteration") -> DataFrame:
    """`runs` with kept: whether each row beats the best of its log so far by more fitness.

    This is the hill-climb decision replayed over logs, all of them at once; the first row of a log is its baseline.
    """
    w = Window.partitionBy(run).orderBy(order)
    best = F.max("fitness").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("kept", best.isNull() | (F.col("fitness") > best))


def perturb(params: dict[str, float], scale: float, rng: np.random.Generator) -> dict[str, float]:
    """Each parameter moved by at most `scale`, within its bounds."""
    return {k: float(np.clip(v + rng.uniform(-scale, scale), *BOUNDS.get(k, (-math.inf, math.inf)))) for k, v in params.items()}


def random_params(rng: np.random.Generator) -> dict[str, float]:
    return {k: float(rng.uniform(*BOUNDS[k])) for k in DEFAULTS}


@dataclass
class Review:
    """Counts iterations without more fitness: ten widen the search, the third time in a row restarts it."""

    idle: int = 0
    widened: int = 0
    best: float = -math.inf

    def assess(self, fitness: float) -> tuple[str, float | None]:
        """(action, new scale); None leaves the scale as it is."""
        if fitness > self.best:
            self.best, self.idle, self.widened = fitness, 0, 0
            return "Continue", None
        self.idle += 1
        if self.idle < PLATEAU:
            return "Continue", None
        self.idle = 0
        self.widened += 1
        if self.widened >= RESTART_AT:
            self.widened = 0
            return "Restart", BASE_SCALE
        return "Widen", BASE_SCALE * 2**self.widened


def review_log(runs: DataFrame) -> DataFrame:
    """(run, iteration, action): the review replayed over logs with ordered windows, many runs at once."""
    order = Window.partitionBy("run").orderBy("iteration")
    best = F.max("fitness").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("up", best.isNull() | (F.col("fitness") > best))
    eras = marked.withColumn("era", F.count_if(F.col("up")).over(order))
    idle = F.count_if(~F.col("up")).over(Window.partitionBy("run", "era").orderBy("iteration"))
    action = F.when((F.col("idle") == 0) | (F.col("idle") % PLATEAU != 0), "Continue").when((F.col("idle") / PLATEAU) % RESTART_AT == 0, "Restart").otherwise("Widen")
    return eras.withColumn("idle", idle).select("run", "iteration", action.alias("action"))


# Advice of a language model is read by keywords; the model itself is any callable.

# The fitness functions that advice may name, and the answers it is asked for.
ADVISED = ("ImpactAccuracy", "PropagationDepth", "CycleTime", "GraphDensity")
ANSWERS = ("WIDEN (increase search range)", "RESTART (random parameters)", "CONTINUE (no change)")
ADVISED_SCALE = 0.4
HISTORY = 20


def parse_advice(text: str) -> tuple[str, str | float | None]:
    """SWITCH_FITNESS(name), else widen, else restart, else nothing, wherever the words stand."""
    if (m := re.search(r"switch_fitness\(([^)]*)\)", text, re.I)) and m[1].strip():
        return "Switch", m[1].strip()
    if re.search("widen", text, re.I):
        return "Widen", ADVISED_SCALE
    return ("Restart", None) if re.search("restart", text, re.I) else ("Continue", None)


def advice_prompt(history: list[dict], available: tuple[str, ...] = ADVISED) -> str:
    """What a model is asked: the last results, newest first, and the answers it may give."""
    past = [f"{r['iteration']}\t{r['fitness']:.4f}\t{r['stability']:.4f}\t{r['cycle_ms']}\t{r['description']}" for r in history[::-1][:HISTORY]]
    choices = [*(f"SWITCH_FITNESS({name})" for name in available), *ANSWERS]
    return "\n".join(["Recent experiments on a code graph, newest first (iteration, fitness, stability, cycle_ms, description):", *past, "", "Answer with exactly one of:", *(f"- {c}" for c in choices)])


def advise(model: Callable[[str], str] | None, history: list[dict], available: tuple[str, ...] = ADVISED) -> tuple[str, str | float | None]:
    """Ask a model about the last results; any failure means going on."""
    if model is None:
        return "Continue", None
    try:
        return parse_advice(model(advice_prompt(history, available)))
    except Exception:  # noqa: BLE001  advice is optional
        return "Continue", None


@dataclass
class Checkpoint:
    # The names of the stored fields.
    iteration: int = 0
    params: dict[str, float] = field(default_factory=lambda: dict(DEFAULTS))
    fitness_fn: str = "ImpactAccuracy"
    best_fitness: float = 0.0
    best_stability: float = 0.0
    scale: float = BASE_SCALE
    plateau_count: int = 0
    widen_count: int = 0
    last_chain_hash: str = ""

    def save(self, path: str) -> None:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump(self.__dict__, f, indent=2, sort_keys=True)
        os.replace(f"{path}.tmp", path)

    @classmethod
    def load(cls, path: str) -> Checkpoint | None:
        try:
            with open(path, encoding="utf-8") as f:
                return cls(**json.load(f))
        except FileNotFoundError:
            return None


LOG_COLUMNS = ["iteration", "fitness", "stability", "cycle_ms", "status", "params_json", "description"]


def log_iteration(number: int, label: str, got: Result) -> None:
    """A line of progress for whoever watches."""
    print(f"[{number}] {label}: fitness={got.fitness:.4f} stability={got.stability:.4f} ({got.cycle_ms} ms)", file=sys.stderr, flush=True)


def described(params: dict[str, float]) -> str:
    return ", ".join(f"{k}={v:.3f}" for k, v in sorted(params.items())) or "default"


def run_continuous(graph: Graph, log: str, iterations: int, fitness: str = "ImpactAccuracy", seed: int = 0, model: Callable[[str], str] | None = None) -> Result | None:
    """Hill-climb for some iterations, each logged in the chain and checkpointed; goes on from an earlier checkpoint.

    The first row of a new log is the baseline.  A restart asks the model, if there is one, what to do instead.
    """
    spark = graph.edges.sparkSession
    state = Checkpoint.load(f"{log}.checkpoint.json")
    history: list[dict] = []
    if state and os.path.exists(log):
        from cairn.sources.logs import read_log, tail

        history = [r.asDict() for r in tail(read_log(spark, log, "experiment", verify=True), HISTORY).collect()]
    fresh = state is None
    state = state or Checkpoint(fitness_fn=fitness)
    writer, rng = ChainWriter(log, "experiment", LOG_COLUMNS), np.random.default_rng(seed + state.iteration)
    review = Review(state.plateau_count, state.widen_count, -math.inf if fresh else state.best_fitness)
    best = None if fresh else Result(state.best_fitness, state.best_stability, 0, "pass", state.params)
    for _ in range(iterations):
        trial = dict(state.params) if best is None and fresh else perturb(state.params, state.scale, rng)
        got = run_experiment(graph, trial, state.fitness_fn)
        baseline, improved = fresh, fresh or better(got, best)
        fresh = False
        action, scale = review.assess(got.fitness)
        note = "baseline" if baseline else described(trial)
        if action == "Restart" and model is not None:
            action, value = advise(model, history)
            scale = value if action == "Widen" else BASE_SCALE if action in ("Restart", "Switch") else None
            if action == "Switch":
                if value != state.fitness_fn:  # scores of another function can't be compared
                    best, review.best = None, -math.inf
                state.fitness_fn, note = str(value), f"SWITCH_FITNESS: {value}"
        if action == "Restart":
            state.params, note = random_params(rng), "RESTART: random params"
        elif action == "Widen":
            note = f"widen: scale={scale:.3f}"
        state.scale = state.scale if scale is None else float(scale)
        if improved and not baseline:
            note = f"KEEP: {described(trial)}"
        if improved and action != "Switch":
            best, state.params = got, trial
        log_iteration(state.iteration, note, got)
        state.last_chain_hash = writer.append(state.iteration, got.fitness, got.stability, got.cycle_ms, got.status, json.dumps(trial, sort_keys=True), note)
        history.append({"iteration": state.iteration, "fitness": got.fitness, "stability": got.stability, "cycle_ms": got.cycle_ms, "description": note})
        state.iteration += 1
        state.plateau_count, state.widen_count = review.idle, review.widened
        if best:
            state.best_fitness, state.best_stability = best.fitness, best.stability
        state.save(f"{log}.checkpoint.json")
    return best

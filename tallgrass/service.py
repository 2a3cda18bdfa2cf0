"""The engine's front door: modes, cache, history, progress, plans, benchmark."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from dataclasses import asdict, dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.controller import LEAST_ROWS, Answer, Controller, Look
from tallgrass.plans import autocorrect, inspect
from tallgrass.plans.frontend import AqpQuery, Unsupported, parse
from tallgrass.sources.tables import Populations, data_version, payload

APPROXIMATE = ("approx", "fast", "balanced", "accurate")


class Cache:
    """Results by statement, mode, target and version of the data, for some seconds."""

    def __init__(self, seconds: float = 30.0, clock=time.monotonic):
        self.seconds, self.clock, self._kept, self._lock = seconds, clock, {}, Lock()

    @staticmethod
    def key(sql: str, mode: str, target, version: str) -> str:
        return hashlib.sha256("\0".join((sql.strip(), mode, str(target), version)).encode()).hexdigest()

    def get(self, key: str):
        with self._lock:
            until, value = self._kept.get(key, (0, None))
            if until <= self.clock():
                self._kept.pop(key, None)
                return None
            return value

    def put(self, key: str, value) -> None:
        with self._lock:
            self._kept[key] = (self.clock() + self.seconds, value)

    def clear(self) -> int:
        with self._lock:
            n = len(self._kept)
            self._kept.clear()
            return n


class Progress:
    """Looks of running and finished queries, by id."""

    def __init__(self, most: int = 200):
        self._of: dict[str, dict] = {}
        self.most = most

    def start(self, id_: str) -> None:
        while len(self._of) >= self.most:
            self._of.pop(next(iter(self._of)))
        self._of[id_] = {"status": "running", "looks": []}

    def look(self, id_: str, look: Look) -> None:
        self._of[id_]["looks"].append(asdict(look))

    def finish(self, id_: str, status: str = "done") -> None:
        self._of[id_]["status"] = status

    def get(self, id_: str) -> dict | None:
        return self._of.get(id_)


@dataclass
class Engine:
    """Runs statements exactly or approximately."""

    spark: SparkSession
    cache: Cache = field(default_factory=Cache)
    history: deque = field(default_factory=lambda: deque(maxlen=50))
    progress: Progress = field(default_factory=Progress)
    populations: Populations = field(default_factory=Populations)
    least_rows: int = LEAST_ROWS

    def parse(self, sql: str) -> AqpQuery:
        return parse(self.spark, sql)

    def exact(self, sql: str) -> DataFrame:
        """Any statement that Spark SQL takes; typing errors are repaired only after Spark has refused it."""
        return autocorrect.run(self.spark, sql)[0]

    def approximate(self, sql: str, mode: str = "balanced", target: float | None = None, on_look=None, **options) -> Answer:
        options.setdefault("least_rows", self.least_rows)
        mode = "balanced" if mode == "approx" else mode
        return Controller(self.populations).run(self.parse(sql), mode, target, on_look=on_look, **options)

    def execute(self, sql: str, mode: str = "exact", target: float | None = None, id_: str | None = None) -> dict:
        """Payload of a statement in a mode; an unknown mode is exact. Equal calls on unchanged data are answered from the cache."""
        _, sql = autocorrect.run(self.spark, sql)
        key = Cache.key(sql, mode, target, self.version(sql))
        if (kept := self.cache.get(key)) is not None:
            return kept | {"cached": True}
        id_ = id_ or key[:16]
        self.progress.start(id_)
        try:
            if mode == "benchmark":
                result = self.benchmark(sql, target=target)
            elif mode in APPROXIMATE:
                began = time.perf_counter()
                answer = self.approximate(sql, mode, target, on_look=lambda x: self.progress.look(id_, x))
                result = payload(answer.wide) | answer.report() | {"time": time.perf_counter() - began}
                if answer.cells is not None:
                    result["cells"] = payload(answer.cells)
                answer.close()
            else:
                result = payload(self.exact(sql)) | {"approx": False}
        except Exception:
            self.progress.finish(id_, "failed")
            raise
        self.progress.finish(id_)
        result |= {"id": id_, "mode": mode, "sql": sql, "cached": False}
        self.cache.put(key, result)
        self.history.append({"sql": sql, "mode": mode, "time": result.get("time"), "at": time.time()})
        return result

    def version(self, sql: str) -> str:
        """Changes with the files under a statement's tables."""
        return hashlib.sha256(data_version(self.spark.sql(sql))[0].encode()).hexdigest()

    def clear_history(self) -> int:
        """Forget the statements run so far; how many there were."""
        n = len(self.history)
        self.history.clear()
        return n

    def plan(self, sql: str, run: bool = True) -> dict:
        return inspect.get_plan(self.spark, autocorrect.run(self.spark, sql)[1], run)

    def sampled_plan(self, sql: str, fraction: float = 0.01) -> dict:
        """Plan of the first look that the controller would take."""
        from tallgrass.operators import estimators, joins, sampling

        query = self.parse(sql)
        rows = joins.joined(sampling.bernoulli(query.fact, fraction).rows, query.joins)
        df = estimators.statistics(rows, [c.alias(k) for k, c in query.keys.items()], query.aggs, query.where)
        tree = inspect.plan_tree(df)
        return {"tree": tree, "explanation": inspect.explain_tree(tree)}

    def benchmark(self, sql: str, mode: str = "balanced", target: float | None = None) -> dict:
        """Exact against approximate: seconds, speed-up, and the mean relative error over cells that both have."""
        began = time.perf_counter()
        true = self.exact(sql).persist()
        true.count()
        exact_s = time.perf_counter() - began
        began = time.perf_counter()
        answer = self.approximate(sql, mode, target)
        wide = answer.wide.persist()
        wide.count()
        approx_s = time.perf_counter() - began
        query = self.parse(sql)
        error = mean_relative_error(true, wide, list(query.keys), [a.alias for a in query.aggs])
        true.unpersist()
        wide.unpersist()
        answer.close()
        return {"exact_seconds": exact_s, "approx_seconds": approx_s, "speedup": exact_s / approx_s if approx_s else None, "error_percent": None if error is None else 100 * error, **answer.report()}

    def register_csv(self, path: str, name: str | None = None) -> str:
        from tallgrass.sources.tables import register_csv

        self.cache.clear()
        return register_csv(self.spark, path, name)[0]

    def suggest(self, sql: str) -> list[str]:
        try:
            self.spark.sql(sql)
            return []
        except Exception as e:
            return autocorrect.suggestions(self.spark, e)


def mean_relative_error(true: DataFrame, found: DataFrame, keys: list[str], values: list[str]) -> float | None:
    """Mean over the cells of groups that both results have; None without any."""
    a = true.select(*(F.col(k).alias(f"a_{k}") for k in (*keys, *values)))
    b = found.select(*(F.col(k).alias(f"b_{k}") for k in (*keys, *values)))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    both = a.join(b, on) if keys else a.crossJoin(b)  # two single rows
    errors = [F.when(F.col(f"a_{v}") != 0, F.abs(F.col(f"b_{v}") - F.col(f"a_{v}")) / F.abs(F.col(f"a_{v}"))).when(F.col(f"b_{v}") == 0, 0.0) for v in values]
    return both.select(F.explode(F.array(*errors)).alias("e")).agg(F.avg("e")).first()[0]


__all__ = ["Cache", "Engine", "Progress", "Unsupported", "mean_relative_error"]

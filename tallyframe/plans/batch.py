"""Runs whose datasets are computed apart, so that a failure, also one while running, stays with its own dataset.

Every dataset is one attempt: its frames are written to a folder of their own, by jobs that carry the dataset's tag, and then
one row in the run's manifest commits them. Several datasets run at the same time. Readers go by the manifest alone: what an
attempt that failed or was lost has left behind is never read, and a later attempt replaces an earlier one by its row. A
failure becomes a row as well, and so a result with status ``ERROR`` beside the others' results.

The driver holds names and the state of each dataset, never rows of a comparison.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.compare import FRAMES, Diff, compare_tables, error_result
from tallyframe.plans.rules import CompareRules, DatasetSpec, spec_for
from tallyframe.session import scratch_path

Pair = tuple[DataFrame, DataFrame]
COMMIT = (
    "dataset string, kind string, attempt string, status string, frames array<string>, folder string, error string,"
    " started timestamp_ntz, finished timestamp_ntz"
)


def reason(problem: BaseException) -> str:
    """One line that says why a job failed: the innermost cause that Spark names, else the exception itself."""
    java = getattr(problem, "java_exception", None) or getattr(problem, "_origin", None)
    text, seen = "", 0
    while java is not None and seen < 20:
        try:
            text, java, seen = java.getMessage() or text, java.getCause(), seen + 1
        except Exception:  # the JVM's exception is gone; what was found so far counts
            break
    lines = [x.strip() for x in (text or str(problem) or type(problem).__name__).splitlines() if x.strip()]
    return lines[0] if lines else type(problem).__name__


@dataclass(frozen=True)
class Run:
    """A run below ``path``, as its manifest tells it."""

    spark: SparkSession
    path: str

    def attempts(self) -> DataFrame:
        """Every committed attempt, failed ones too."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.path}/manifest/*")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def datasets(self) -> DataFrame:
        """The latest attempt of each dataset."""
        last = F.max_by(F.struct("*"), F.struct("finished", "attempt")).alias("last")
        return self.attempts().groupBy(F.col("dataset").alias("_of")).agg(last).select("last.*")

    def frame(self, name: str) -> DataFrame | None:
        """One frame of all datasets that have it; in ``results``, failed datasets have a row each."""
        if name not in FRAMES:
            raise ValueError(f"no such frame: {name}")
        rows = self.datasets().orderBy("dataset").collect()
        parts = [self.spark.read.parquet(f"{r['folder']}/{name}") for r in rows if r["status"] == "ok" and name in r["frames"]]
        if name == "results":
            by = ", ".join(f"`{c}` {t}" for c, t in (parts[0].dtypes[: parts[0].columns.index("dataset")] if parts else []))
            parts += [error_result(self.spark, r["dataset"], r["kind"], r["error"], by) for r in rows if r["status"] != "ok"]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def diff(self) -> Diff:
        """All frames, each read when it is asked for."""
        kept = {n for r in self.datasets().collect() for n in (["results"] if r["status"] != "ok" else r["frames"])}
        return Diff(**{n: (lambda n=n: self.frame(n)) for n in FRAMES if n in kept})


def run_isolated(
    spark: SparkSession,
    tables: Mapping[str, Pair | Callable[[], Pair]],
    path: str | None = None,
    rules: CompareRules | None = None,
    specs: Mapping[str, DatasetSpec] | None = None,
    by: Sequence[str] = ("emp_id",),
    together: int = 4,
    timeout_s: float | None = None,
    resume: bool = False,
) -> Run:
    """Compare the datasets of a run, ``together`` at a time, and commit each below ``path``.

    A side may be given by a function, whose failure is its dataset's failure. A dataset that takes longer than
    ``timeout_s`` is cancelled by its tag and counts as failed. With ``resume``, datasets that are committed already are
    left as they are. Excluded datasets are left out.
    """
    rules = rules or CompareRules()
    run = Run(spark, (path or scratch_path(spark, "run")).rstrip("/"))
    names = sorted(n for n in tables if not rules.is_excluded(n))
    if resume:
        done = {r["dataset"] for r in run.datasets().where("status = 'ok'").select("dataset").collect()}
        names = [n for n in names if n not in done]

    @inheritable_thread_target(spark)
    def attempt(name: str) -> None:
        spec = (specs or {}).get(name) or spec_for(name)
        _attempt(run, name, tables[name], spec, rules, by, timeout_s)

    with ThreadPoolExecutor(max_workers=max(1, together)) as pool:
        for future in [pool.submit(attempt, name) for name in names]:
            future.result()  # raises only if a commit itself could not be written
    return run


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _attempt(run: Run, name: str, pair, spec: DatasetSpec, rules: CompareRules, by: Sequence[str], timeout_s: float | None) -> None:
    own, started, context = uuid.uuid4().hex, _now(), run.spark.sparkContext
    folder, tag, late = f"{run.path}/data/{own}", f"tallyframe-{own}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop) if timeout_s else None
    context.addJobTag(tag)
    frames, error = [], None
    try:
        if timer:
            timer.start()
        primary, replicated = pair() if callable(pair) else pair
        diff = compare_tables(primary, replicated, name, spec, rules, by, stored=True)
        for frame in diff.names():
            if late.is_set():
                raise TimeoutError
            getattr(diff, frame).write.parquet(f"{folder}/{frame}")
            frames.append(frame)
    except Exception as problem:  # whatever it is, it is this dataset's own
        error = f"not done within {timeout_s} s" if late.is_set() else reason(problem)
    finally:
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
    row = (name, spec.kind, own, "error" if error else "ok", [] if error else frames, folder, error, started, _now())
    run.spark.createDataFrame([row], COMMIT).coalesce(1).write.parquet(f"{run.path}/manifest/{own}")

"""Supersteps over stores: processes with their own clocks, steps that follow changes.

Stores are DataFrames, so a process that was invoked holds its snapshot for free: later changes make
new DataFrames.  All updates of one moment are united, reconciled and applied in one join per
store; every ``every`` moments the stores are written to shared storage, which cuts their lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaweave.functions.names import unused
from deltaweave.operators import delta
from deltaweave.runtime import stage

#: More moments than this in one run mean a clock that doesn't advance.
MOST_MOMENTS = 100_000


@dataclass(frozen=True)
class Store:
    """Rows by key with one changing column; ``additive`` or replaced by the last update."""

    rows: DataFrame
    keys: tuple[str, ...]
    value: str
    additive: bool = True


@dataclass(frozen=True)
class Change:
    """What a process does to a store: ``changed`` has keys and value, ``added`` whole rows, ``removed`` keys."""

    changed: DataFrame | None = None
    added: DataFrame | None = None
    removed: DataFrame | None = None


Update = Callable[[dict[str, DataFrame], float], dict[str, Change]]


@dataclass(frozen=True)
class Process:
    """Invoked with a view and its interval; what it returns is applied when the interval has passed.

    ``interval`` may be a function of the view that gives a number: a clock that the state drives.
    """

    name: str
    reads: tuple[str, ...]
    update: Update
    interval: float | Callable[[dict[str, DataFrame]], float] = 1.0


@dataclass(frozen=True)
class Step:
    """Runs when a store it reads, or one above or below it by path, has changed; within a layer higher ``priority`` goes first.

    The result of a step with ``cached`` is kept by the engine's cache, if it has one.
    """

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    update: Update
    priority: float = 0.0
    cached: bool = False


def related(a: str, b: str) -> bool:
    """Equal paths, or one above the other."""
    one, other = a.split("/"), b.split("/")
    n = min(len(one), len(other))
    return one[:n] == other[:n]


@dataclass
class StepCache:
    """Results of steps as Parquet under ``path``, by the version of what they were made from.

    A result of another version, or of a step in ``forced``, is stale, and so is everything that
    follows a step whose result was stale.
    """

    path: str
    version: str
    forced: frozenset[str] = frozenset()
    stale: set[str] = field(default_factory=set)

    def folder(self, step: str) -> str:
        safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in step)
        return f"{self.path.rstrip('/')}/{self.version}/{safe}"

    def result(self, step: Step, made: Callable[[], dict[str, Change]], view: dict[str, DataFrame]) -> dict[str, Change]:
        """The kept result if it is fresh, else that of ``made``, which is kept."""
        spark = next(iter(view.values())).sparkSession
        jvm, conf, folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), self.folder(step.name)
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_done")
        files = done.getFileSystem(conf)
        if step.name in self.forced or set(step.reads) & self.stale or not files.exists(done):
            self.stale |= set(step.writes)
            kinds = []
            for store, change in made().items():
                for part in ("changed", "added", "removed"):
                    if (frame := getattr(change, part)) is not None:
                        frame.write.mode("overwrite").parquet(f"{folder}/{store}/{part}")
                        kinds.append((store, part))
            spark.createDataFrame(kinds or [("", "")], "store string, part string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_kinds")
            files.create(done, True).close()
        out: dict[str, dict[str, DataFrame]] = {}
        for store, part in sorted(map(tuple, spark.read.parquet(f"{folder}/_kinds").collect())):
            if store:
                out.setdefault(store, {})[part] = spark.read.parquet(f"{folder}/{store}/{part}")
        return {store: Change(**parts) for store, parts in out.items()}


def joined(frames: Iterable[DataFrame | None]) -> DataFrame | None:
    """All rows of the frames that there are."""
    given = [f for f in frames if f is not None]
    if len(given) > 1:  # Spark 4.1 takes such a union for partitioned by key even where it only concatenates its parts
        given[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, given) if given else None


def apply_changes(store: Store, changes: list[Change]) -> Store:
    """All changes of one moment.

    Rows are removed, then added, then changed; a change of a key that the same moment removes is
    void, even where the key is added again.  Of equal added keys the last wins.
    """
    keys, value = list(store.keys), store.value
    removed = joined(c.removed.select(*keys) if c.removed is not None else None for c in changes)
    seq, whole, total = unused("seq", store.rows), unused("row", store.rows), unused("total", store.rows)
    numbered = lambda part: joined(f.withColumn(seq, F.lit(i)) for i, c in enumerate(changes) if (f := getattr(c, part)) is not None)
    changed, added, rows = numbered("changed"), numbered("added"), store.rows
    if removed is not None:
        rows = rows.join(removed.distinct(), keys, "left_anti")
        changed = delta.void_removed(changed, removed, keys) if changed is not None else None
    if added is not None:
        newest = F.max_by(F.struct(*[c for c in added.columns if c not in (*keys, seq)]), seq).alias(whole)
        last = added.groupBy(*keys).agg(newest).select(*keys, f"{whole}.*")
        rows = rows.join(last.select(*keys), keys, "left_anti").unionByName(last)
    if changed is not None and store.additive:
        rows = delta.apply_add(rows, delta.reconcile_sum(changed, keys, value, total), keys, value, total)
    elif changed is not None:
        rows = delta.apply_replace(rows, delta.reconcile_last(changed, keys, value, [seq], total), keys, value, total)
    return Store(rows.select(*store.rows.columns), store.keys, value, store.additive)


def layers(steps: list[Step]) -> list[list[Step]]:
    """Steps in an order in which readers follow writers; steps of a cycle run together, at the end."""
    left, out = list(steps), []
    while left:
        free = [s for s in left if not any(o is not s and any(related(w, r) for w in o.writes for r in s.reads) for o in left)]
        out.append(sorted(free or left, key=lambda s: -s.priority))
        left = [s for s in left if s not in out[-1]]
    return out


@dataclass
class Engine:
    """Stores, processes and steps under one clock."""

    stores: dict[str, Store]
    processes: list[Process] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    every: int = 8
    now: float = 0.0
    moments: int = 0
    cache: StepCache | None = None
    #: Changes of these stores are kept in ``captured``; those of ``conduits`` are not applied here.
    capture: set[str] = field(default_factory=set)
    conduits: set[str] = field(default_factory=set)
    captured: dict[str, list[Change]] = field(default_factory=dict)
    #: The most rows of a store, looked at whenever stores are written.
    most_rows: int | None = None
    _waiting: dict[str, tuple[float, dict[str, Change]]] = field(default_factory=dict)

    def __post_init__(self):
        for part in (*self.processes, *self.steps):
            unknown = set(part.reads) - set(self.stores)
            if unknown:
                raise KeyError(f"{part.name} reads unknown stores: {sorted(unknown)}")
        for process in self.processes:
            if not callable(process.interval) and process.interval <= 0:
                raise ValueError(f"{process.name} has no positive interval")

    def view(self, names: tuple[str, ...]) -> dict[str, DataFrame]:
        """The rows of these stores as they are now."""
        return {n: self.stores[n].rows for n in names}

    def add_process(self, process: Process) -> None:
        """From the next moment on this process runs too."""
        self.processes.append(process)
        self.__post_init__()

    def remove_process(self, name: str) -> None:
        """The process runs no more; what it was about to do is void."""
        self.processes = [p for p in self.processes if p.name != name]
        self._waiting.pop(name, None)

    def add_step(self, step: Step) -> None:
        """From the next change on this step runs too."""
        self.steps.append(step)
        self.__post_init__()

    def add_store(self, name: str, store: Store) -> None:
        """A further store; one of that name must not exist."""
        if name in self.stores:
            raise KeyError(f"there is a store {name}")
        self.stores[name] = store

    def extend(self, name: str, defaults: dict[str, Column]) -> None:
        """Columns that the rows of a store don't have yet, with their default values."""
        store = self.stores[name]
        new = {c: v for c, v in defaults.items() if c not in store.rows.columns}
        self.stores[name] = Store(store.rows.withColumns(new) if new else store.rows, store.keys, store.value, store.additive)

    def replace_rows(self, name: str, rows: DataFrame) -> None:
        """The rows of a store, set from outside."""
        store = self.stores[name]
        self.stores[name] = Store(rows.select(*store.rows.columns), store.keys, store.value, store.additive)

    def _interval(self, process: Process) -> float:
        interval = process.interval(self.view(process.reads)) if callable(process.interval) else process.interval
        if not interval > 0:
            raise ValueError(f"{process.name} has no positive interval")
        return float(interval)

    def _apply(self, updates: list[dict[str, Change]]) -> set[str]:
        touched = {n for u in updates for n in u}
        unknown = touched - set(self.stores) - self.conduits
        if unknown:
            raise KeyError(f"update of unknown stores: {sorted(unknown)}")
        for name in touched:
            changes = [u[name] for u in updates if name in u]
            if name in self.capture:
                self.captured.setdefault(name, []).extend(changes)
            if name not in self.conduits:
                self.stores[name] = apply_changes(self.stores[name], changes)
        return touched

    def _result(self, step: Step) -> dict[str, Change]:
        view = self.view(step.reads)
        made = lambda: step.update(view, 0.0)
        return self.cache.result(step, made, view) if self.cache is not None and step.cached else made()

    def settle(self, changed: set[str]) -> None:
        """Steps that follow a change, layer by layer, each once; a layer reads one snapshot."""
        changed = set(changed)
        for layer in layers(self.steps):
            due = [s for s in layer if any(related(r, c) for r in s.reads for c in changed)]
            changed |= self._apply([self._result(s) for s in due])

    def run(self, duration: float) -> dict[str, DataFrame]:
        """Let time pass.  A process whose next event lies beyond the end is not invoked."""
        end = self.now + duration
        while True:
            for process in self.processes:
                if process.name not in self._waiting:
                    interval = self._interval(process)
                    if self.now + interval <= end:
                        self._waiting[process.name] = (self.now + interval, process.update(self.view(process.reads), interval))
            times = [t for t, _ in self._waiting.values() if t <= end]
            if not times:
                break
            self.now, self.moments = min(times), self.moments + 1
            if self.moments > MOST_MOMENTS:
                raise RuntimeError("the clock does not advance")
            due = [p.name for p in self.processes if p.name in self._waiting and self._waiting[p.name][0] <= self.now]
            self.settle(self._apply([self._waiting.pop(n)[1] for n in due]))
            if self.moments % self.every == 0:
                self.cut()
        self.now = end
        return self.view(tuple(self.stores))

    def cut(self) -> None:
        """Write all stores, which cuts their lineage."""
        self.stores = {n: Store(stage(s.rows, n.replace("/", "_")), s.keys, s.value, s.additive) for n, s in self.stores.items()}
        for name, store in self.stores.items():
            if self.most_rows is not None and store.rows.count() > self.most_rows:
                raise RuntimeError(f"{name} has more than {self.most_rows} rows")

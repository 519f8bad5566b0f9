"""Composites and topologies: processes made by name, wired by path, nested, and found in documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from deltaweave.plans.schedule import Change, Engine, Process, Step, Store, joined

#: Where processes may run: all of these deal a process's rows over the executors.
PROTOCOLS = ("local", "parallel")
#: Controls of nodes that stand for processes and steps; emitters are seen and left out.
KINDS, EMITTER = ("link", "process", "step"), "RAMEmitter"


@dataclass
class Factory:
    """Makers of processes and steps, by name: ``maker(name, config, inputs, outputs)`` with ports as store names."""

    makers: dict[str, Callable[..., Process | Step]] = field(default_factory=dict)

    def register(self, name: str, maker: Callable[..., Process | Step]) -> None:
        self.makers[name] = maker

    def __contains__(self, name: str) -> bool:
        return name in self.makers

    def names(self) -> list[str]:
        return sorted(self.makers)

    def create(self, address: str | dict, name: str, config: dict | None = None, inputs: dict[str, str] | None = None, outputs: dict[str, str] | None = None) -> Process | Step:
        """The process or step of an address: a name, ``protocol:name`` or ``{"protocol": ..., "data": ...}``."""
        if isinstance(address, str):
            protocol, _, data = address.rpartition(":")
            protocol = protocol or "local"
        else:
            protocol, data = address.get("protocol", "local"), address.get("data")
        if protocol not in PROTOCOLS:
            raise ValueError(f"no protocol {protocol}; there are {PROTOCOLS}")
        if data not in self.makers:
            raise KeyError(f"no maker {data}; there are {self.names()}")
        return self.makers[data](name, config or {}, inputs or {}, outputs or {})

    def missing(self, state: dict) -> list[str]:
        """Addresses in a state that nothing is registered for."""
        data = lambda n: n["address"].get("data") if isinstance(n["address"], dict) else n["address"].rpartition(":")[2]
        return sorted({data(n) for _, n in links(state)} - set(self.makers) - {EMITTER})


def resolve_wire(wire: list, process: tuple[str, ...]) -> tuple[str, ...]:
    """The path that a wire leads to from a process.

    It starts in the process's container; ``..`` goes one up, and a first ``%`` starts at the process
    itself instead.
    """
    steps = [str(int(s)) if isinstance(s, float) else str(s) for s in wire]
    base = list(process) if steps[:1] == ["%"] else list(process[:-1])
    for step in steps[1:] if steps[:1] == ["%"] else steps:
        if step == "..":
            base = base[:-1]
        else:
            base.append(step)
    return tuple(base)


def resolve_wires(wires: Any, process: tuple[str, ...], prefix: str = "") -> dict[str, tuple[str, ...]]:
    """Ports and the paths they lead to; ports in ports are named with dots."""
    if isinstance(wires, list):
        return {prefix: resolve_wire(wires, process)}
    out: dict[str, tuple[str, ...]] = {}
    for port, target in (wires or {}).items():
        out |= resolve_wires(target, process, f"{prefix}.{port}" if prefix else port)
    return out


def links(state: Any, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], dict]]:
    """Every node of a state that stands for a process or step, with its path."""
    if not isinstance(state, dict):
        return
    if state.get("_type") in KINDS and "address" in state:
        yield path, state
        return
    for key, child in state.items():
        if not key.startswith("_"):
            yield from links(child, (*path, key))


def discover(state: dict, factory: Factory) -> dict[str, Process | Step]:
    """The processes and steps that a state holds, by their paths; stores are named by the wires' paths."""
    out = {}
    for path, node in links(state):
        address = node["address"]
        if (address.get("data") if isinstance(address, dict) else address.rpartition(":")[2]) == EMITTER:
            continue
        ports = [{p: "/".join(at) for p, at in resolve_wires(node.get(side) or {}, path).items()} for side in ("inputs", "outputs")]
        name = "/".join(path)
        out[name] = factory.create(address, name, node.get("config"), *ports)
    return out


def refresh(engine: Engine, state: dict, factory: Factory) -> tuple[list[str], list[str]]:
    """Bring an engine in line with a state: new nodes run from now on, vanished ones no more.  Returns both lists of names."""
    found = discover(state, factory)
    held = {p.name for p in (*engine.processes, *engine.steps)}
    gone = sorted(held - set(found))
    for name in gone:
        engine.remove_process(name)
        engine.steps = [s for s in engine.steps if s.name != name]
    new = [n for n in found if n not in held]
    for name in new:
        (engine.add_step if isinstance(found[name], Step) else engine.add_process)(found[name])
    return new, gone


def united(changes: list[Change]) -> Change:
    """The changes of one store in one, their parts one after the other."""
    parts = {}
    for part in ("changed", "added", "removed"):
        parts[part] = joined(getattr(c, part) for c in changes)
    return Change(**parts)


def composite(name: str, inner: Engine, inputs: dict[str, str], outputs: dict[str, str], interval: float = 1.0) -> Process:
    """An engine as a process of another one.

    ``inputs`` leads outer stores to inner ones, whose rows they replace before the inner engine runs;
    ``outputs`` leads inner stores to outer ones: what happened to them inside is passed on as it is,
    not as a difference of states.  An inner name that has no store is a conduit: its changes are only
    passed on.
    """

    def update(view: dict[str, DataFrame], dt: float) -> dict[str, Change]:
        for outer, own in inputs.items():
            inner.replace_rows(own, view[outer])
        inner.capture, inner.conduits = set(outputs), {n for n in outputs if n not in inner.stores}
        inner.captured = {}
        if not inner.processes:
            inner.settle(set(inputs.values()))
        inner.run(dt)
        told, inner.captured, inner.capture = inner.captured, {}, set()
        return {outputs[own]: united(changes) for own, changes in told.items()}

    return Process(name, tuple(inputs), update, interval)


def engine_of(stores: dict[str, Store], state: dict, factory: Factory, **settings: Any) -> Engine:
    """An engine over these stores with the processes and steps that a document's state holds."""
    if lost := factory.missing(state):
        raise KeyError(f"nothing is registered for {lost}")
    found = discover(state, factory).values()
    return Engine(stores, [p for p in found if isinstance(p, Process)], [s for s in found if isinstance(s, Step)], **settings)

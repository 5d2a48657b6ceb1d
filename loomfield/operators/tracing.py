"""Spans of work with attributes and events, handed to sinks when they end, and as rows of a table."""

from __future__ import annotations

import itertools
import json
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SPAN = "id string, parent_id string, name string, started double, ended double, attributes map<string,string>, events array<struct<name:string,at:double,attributes:map<string,string>>>"
Sink = Callable[["Span"], None]
_NUMBERS = itertools.count(1)


def _told(values: dict) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in values.items()}


@dataclass
class Span:
    name: str
    attributes: dict = field(default_factory=dict)
    parent_id: str | None = None
    id: str = field(default_factory=lambda: f"span-{next(_NUMBERS)}")
    started: float = field(default_factory=time.time)
    ended: float | None = None
    events: list[tuple[str, float, dict]] = field(default_factory=list)

    def event(self, name: str, **attributes) -> None:
        self.events.append((name, time.time(), attributes))

    def row(self) -> tuple:
        return (self.id, self.parent_id, self.name, self.started, self.ended, _told(self.attributes), [(n, t, _told(a)) for n, t, a in self.events])


@dataclass
class Tracer:
    """Opens spans; ``attributes`` are on each of them, which tells items of a batch apart."""

    sinks: tuple[Sink, ...] = ()
    attributes: dict = field(default_factory=dict)

    @contextmanager
    def span(self, name: str, parent: Span | None = None, **attributes) -> Iterator[Span]:
        """A span that ends, and goes to the sinks, when the block is left; an error is an event of it."""
        span = Span(name, {**self.attributes, **attributes}, parent.id if parent else None)
        try:
            yield span
        except Exception as e:
            span.event("error", type=type(e).__name__, message=str(e))
            raise
        finally:
            span.ended = time.time()
            for sink in self.sinks:
                sink(span)


class MemorySink(list):
    """Keeps ended spans; ``table`` gives them as rows."""

    def __call__(self, span: Span) -> None:
        self.append(span)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([s.row() for s in self], SPAN)


def console_sink(span: Span, out=None) -> None:
    """A line for the span and one for each event."""
    out = out or sys.stderr
    took = (span.ended or time.time()) - span.started
    print(f"[{span.name}] {took * 1000:.0f} ms {json.dumps(_told(span.attributes), ensure_ascii=False)}", file=out)
    for name, _, attributes in span.events:
        print(f"  {name} {json.dumps(_told(attributes), ensure_ascii=False)}", file=out)

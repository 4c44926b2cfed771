"""Where each part of theta lies: the model's parameters, then each dataset's, in order."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Block:
    name: str
    offset: int
    length: int
    labels: tuple[str, ...]

    def columns(self, theta: Column) -> list[Column]:
        """The block's parameters; Spark arrays count from 0 by getItem."""
        return [theta[self.offset + i] for i in range(self.length)]

    def slice(self, theta: Column) -> Column:
        return F.slice(theta, self.offset + 1, self.length)


@dataclass(frozen=True)
class ParamLayout:
    blocks: tuple[Block, ...]

    @property
    def size(self) -> int:
        return sum(b.length for b in self.blocks)

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(x for b in self.blocks for x in b.labels)

    def __getitem__(self, name: str) -> Block:
        return next(b for b in self.blocks if b.name == name)

    @classmethod
    def of(cls, model: tuple[int, Sequence[str] | None], datasets: Sequence[tuple[str, int, Sequence[str] | None]]) -> ParamLayout:
        """From the model's count and labels and each dataset's name, count and labels; missing labels are x0, x1, ..."""
        blocks, at = [], 0
        for name, count, labels in (("model", *model), *datasets):
            if labels is None:
                labels = tuple(f"x{at + i}" for i in range(count))
            if len(labels) != count:
                raise ValueError(f"{name}: {len(labels)} labels for {count} parameters")
            blocks.append(Block(name, at, count, tuple(labels)))
            at += count
        return cls(tuple(blocks))


def parameter_count(model: object, for_transform: bool = False) -> int:
    """npars_ptform where a sampler needs transforms, else npars, else what the model's call takes besides itself."""
    names = ("npars_ptform", "npars") if for_transform else ("npars",)
    for name in names:
        if getattr(model, name, None) is not None:
            return int(getattr(model, name))
    if hasattr(model, "labels"):
        return len(model.labels)
    call: Callable = model if inspect.isfunction(model) else type(model).__call__
    return len([p for p in inspect.signature(call).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]) - (0 if inspect.isfunction(model) else 1)


def run_name(model: str, data: Sequence[str], sampler: str, style: str = "full", stamp: str = "") -> str:
    """Names of runs: full, short, stamp or model."""
    if style == "full":
        return "_".join((stamp, sampler, model, "-".join(data)))
    if style == "short":
        return "_".join((stamp, sampler))
    if style == "stamp":
        return stamp
    if style == "model":
        return "_".join((stamp, model))
    raise ValueError(f"no naming style {style!r}")

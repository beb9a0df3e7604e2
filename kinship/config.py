"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LinkConfig:
    """How candidate pairs are proposed. *_top: targets kept for each source record; *_min: cosines must be above it; min_df and max_df
    bound the target records that a gram may occur in, as a number and a share; max_group bounds the targets of an exact key."""

    name_top: int = 40
    addr_top: int = 40
    num_top: int = 20
    name_min: float = 0.25
    addr_min: float = 0.30
    num_min: float = 0.30
    min_df: int = 2
    max_df: float = 0.5
    gram: int = 3
    max_group: int | None = 100
    min_key: int = 4
    use_numbers: bool = False


@dataclass(frozen=True)
class DecideConfig:
    """threshold is inclusive; gate, if above it, is what an entity's best candidate must reach."""

    threshold: float = 0.675
    gate: float | None = None
    exclusive: bool = True

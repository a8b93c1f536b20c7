"""A registry of scheduled functions: what runs in which ticks, by stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

STAGES = ("first", "early", "late")


@dataclass
class Block:
    """A function of the state, active from one tick to another."""

    block_id: str
    stage: str
    start: int
    end: int
    action: Callable[[Any], Any]
    active: bool = True


@dataclass
class Schedule:
    blocks: dict[str, Block] = field(default_factory=dict)
    finished: bool = False

    def register(self, block_id: str, stage: str, action: Callable[[Any], Any], start: int = 1, end: int | None = None) -> Block:
        if stage not in STAGES:
            raise ValueError(f"no stage {stage}")
        if block_id in self.blocks:
            raise ValueError(f"block {block_id} is there already")
        self.blocks[block_id] = Block(block_id, stage, start, start if end is None else end, action)
        return self.blocks[block_id]

    def deregister(self, block_id: str) -> None:
        del self.blocks[block_id]

    def reschedule(self, block_id: str, start: int, end: int) -> None:
        self.blocks[block_id].start, self.blocks[block_id].end = start, end

    def last_tick(self) -> int:
        return max((b.end for b in self.blocks.values()), default=0)

    def finish(self) -> None:
        self.finished = True

    def run(self, state: Any, tick: int) -> Any:
        """All active blocks of a tick, stage by stage, in the order of their registration."""
        for stage in STAGES:
            for b in list(self.blocks.values()):
                if b.stage == stage and b.active and b.start <= tick <= b.end:
                    state = b.action(state)
        return state

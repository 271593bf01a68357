"""Settings of the engine, validated as a whole."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from pagemill.errors import ConfigError


@dataclass(frozen=True)
class Config:
    scan_lines: int = 3
    min_repeats: int = 3
    repeat_share: float = 0.15
    chunk_size: int = 900
    chunk_overlap: int = 150
    min_chunk: int = 50
    top_k: int = 8
    dense_k: int = 20
    lexical_k: int = 20
    rrf_k: int = 60
    boost: float = 0.05
    budget_chars: int = 12_000
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    min_figure: int = 32
    max_decorative: int = 120
    figure_band: float = 60.0
    context_band: float = 170.0
    embed_batch: int = 64
    #: Questions up to this many are sent to every task; more are joined by shuffle.
    max_broadcast_questions: int = 10_000

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be smaller than chunk_size")
        if not 1 <= self.top_k <= min(self.dense_k, self.lexical_k):
            raise ConfigError("top_k must not exceed the candidate windows")
        if self.scan_lines < 1 or self.min_chunk < 0 or self.rrf_k < 1 or self.boost < 0:
            raise ConfigError("scan_lines, min_chunk, rrf_k or boost is out of range")

    def limit(self, top_k: int | None) -> int:
        """A request's top_k, or the default where none (or 0) is given."""
        return top_k or self.top_k

    @classmethod
    def from_env(cls, prefix: str = "PAGEMILL_") -> Config:
        given = {f.name: type(f.default)(json.loads(v)) for f in fields(cls) if (v := os.environ.get(prefix + f.name.upper()))}
        return replace(cls(), **given)


DEFAULT = Config()

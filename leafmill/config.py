"""Settings of the pipeline: fixed defaults, overridable per call; and a deep merge for nested settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_max_token: int = 600
    chunk_min_token: int = 200
    overlap_tokens: int = 80
    image_token_estimate: int = 300
    token_budget: int = 2000
    max_pages_per_batch: int = 15
    rrf_constant: int = 60
    rrf_top_k: int = 20
    vector_limit: int = 30
    text_limit: int = 30
    max_images_per_call: int = 3
    chars_per_token: float = 3.56
    tokens_per_word: float = 1.3
    vector_threshold: float = 0.4
    heading_threshold: int = 90
    citation_threshold: int = 80
    intent_threshold: float = 0.51
    history: int = 10
    json_retries: int = 3

    @property
    def window_chars(self) -> int:
        return int(self.chunk_max_token * self.chars_per_token)

    @property
    def overlap_chars(self) -> int:
        return int(self.overlap_tokens * self.chars_per_token)

    @property
    def step_chars(self) -> int:
        step = self.window_chars - self.overlap_chars
        return step if step > 0 else self.window_chars

    @property
    def overlap_words(self) -> int:
        return int(self.overlap_tokens / self.tokens_per_word)


@dataclass(frozen=True)
class Compat:
    """Behaviours kept only for comparison; all off by default."""

    drop_flushed_sentence: bool = False  # the sentence that triggers a flush is lost
    drop_inner_text: bool = False  # text before an inner node's first child is not chunked
    glue_main_heading: bool = False  # a main heading is glued to the text before it
    free_images: bool = False  # images cost nothing in the token budget


DEFAULT = Settings()


def deep_merge(base: dict, over: dict) -> dict:
    """Nested dictionaries merged key by key; other values are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(path: str, seen: frozenset[str] = frozenset()) -> Settings:
    """Settings from a YAML file; ``chunk_config`` names a file whose values lie beneath this one's."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    under = raw.pop("chunk_config", None)
    if under and under not in seen:
        low = yaml.safe_load((Path(path).parent / under).read_text(encoding="utf-8")) or {}
        raw = deep_merge(low, raw)
    names = {f.name for f in fields(Settings)}
    return replace(DEFAULT, **{k: v for k, v in raw.items() if k in names})

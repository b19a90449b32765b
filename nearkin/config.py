"""Settings of the engine and their checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

METRICS = ("cosine", "dot", "l2")
INDEX_TYPES = ("flat", "ivf", "hnsw")
#: Settings that ``set_variable`` may change on a running engine.
MUTABLE = ("cache_enabled", "cache_min_query_cost_ms", "cache_ttl_seconds", "logging_level", "logging_json")


class EngineError(ValueError):
    """A request or a setting that the engine refuses."""


@dataclass(frozen=True)
class EngineConfig:
    # Defaults of the settings.
    ctx_buffer_size: int = 50
    max_contexts: int = 0
    max_neighbors_per_item: int = 0
    min_support: float = 0.0
    decay_interval_sec: int = 3600
    decay_alpha: float = 0.99
    dedup_window_sec: int = 60
    dedup_cache_size: int = 10000
    temporal_cooccurrence: bool = False
    temporal_half_life_sec: float = 86400.0
    negative_signals: bool = False
    negative_weight: float = 0.5
    default_dimension: int = 768
    distance_metric: str = "cosine"
    default_top_k: int = 100
    max_top_k: int = 1000
    fusion_alpha: float = 0.6
    fusion_beta: float = 0.4
    sample_size: int = 0
    adaptive_fusion: bool = False
    adaptive_min_alpha: float = 0.2
    adaptive_max_alpha: float = 0.9
    adaptive_maturity: int = 50
    index_type: str = "flat"
    ivf_nlist: int = 256
    ivf_nprobe: int = 8
    ivf_train_threshold: int = 10000
    ivf_seal_threshold: int = 100000
    snapshot_retain: int = 3
    cache_enabled: bool = True
    cache_max_entries: int = 1024
    cache_min_query_cost_ms: float = 10.0
    cache_ttl_seconds: float = 3600.0
    logging_level: str = "info"
    logging_json: bool = False

    def validate(self) -> EngineConfig:
        """Itself, or an ``EngineError`` that names every bad setting."""
        bad = []
        for name in ("ctx_buffer_size", "default_dimension", "default_top_k", "max_top_k", "ivf_nprobe", "decay_interval_sec"):
            if getattr(self, name) < 1:
                bad.append(f"{name} must be at least 1")
        for name in ("max_contexts", "max_neighbors_per_item", "min_support", "dedup_window_sec", "dedup_cache_size", "negative_weight", "sample_size", "ivf_nlist", "snapshot_retain", "fusion_alpha", "fusion_beta", "adaptive_maturity", "ivf_train_threshold", "ivf_seal_threshold"):
            if getattr(self, name) < 0:
                bad.append(f"{name} must not be negative")
        if not 0 <= self.decay_alpha <= 1:
            bad.append("decay_alpha must be from 0 to 1")
        if self.temporal_half_life_sec <= 0:
            bad.append("temporal_half_life_sec must be positive")
        if self.default_top_k > self.max_top_k:
            bad.append("default_top_k must not exceed max_top_k")
        if not 0 <= self.adaptive_min_alpha <= self.adaptive_max_alpha <= 1:
            bad.append("adaptive alphas must be ordered and from 0 to 1")
        if self.distance_metric not in METRICS:
            bad.append(f"distance_metric must be one of {', '.join(METRICS)}")
        if self.index_type not in INDEX_TYPES:
            bad.append(f"index_type must be one of {', '.join(INDEX_TYPES)}")
        if bad:
            raise EngineError("; ".join(bad))
        return self

    def with_variable(self, name: str, text: str) -> EngineConfig:
        """A copy with one of the settings that may change at run time."""
        key = name.replace(".", "_")
        if key not in MUTABLE:
            raise EngineError(f"{name} can't be set at run time")
        kind = type(getattr(self, key))
        try:
            value = {"true": True, "on": True, "1": True, "false": False, "off": False, "0": False}[text.lower()] if kind is bool else kind(text)
        except (KeyError, ValueError):
            raise EngineError(f"{text!r} is no value for {name}") from None
        return replace(self, **{key: value}).validate()

    def variables(self, prefix: str = "") -> dict[str, str]:
        shown = {k.replace("cache_", "cache.", 1).replace("logging_", "logging.", 1): v for k, v in asdict(self).items()}
        return {k: str(v) for k, v in sorted(shown.items()) if k.startswith(prefix)}

    @classmethod
    def help(cls) -> dict[str, str]:
        """Each setting's type and default, and whether it may change at run time."""
        return {f.name: f"{f.type}, {f.default!r} by default{', may change at run time' if f.name in MUTABLE else ''}" for f in fields(cls)}

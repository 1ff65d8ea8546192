"""Settings of the engine; fixed values are those a user of the original system expects."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    ideal_chunk_size: int = 1000
    overlap: float = 0.05
    initial_documents_k: int = 200
    #: Accepted and reported, but never applied: up to initial_documents_k documents feed the chunk search.
    final_documents_k: int = 50
    initial_chunks_k: int = 10
    final_chunks_k: int = 10
    max_rounds: int = 3
    context_tokens: int = 24_000
    answer_tokens: int = 3_000
    k1: float = 1.5
    b: float = 0.75
    suggestions: bool = False
    safety_gate: bool = False

    def __post_init__(self) -> None:
        for name in ("ideal_chunk_size", "initial_documents_k", "initial_chunks_k", "final_chunks_k", "max_rounds", "context_tokens"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")


#: Formats a conversion may ask for.
OUTPUT_FORMATS = ("markdown", "text", "html", "json")


def validate_worker(config: dict) -> dict:
    """Fills defaults of a worker's configuration (sections flattened) and checks it."""
    flat: dict = {}
    for key, value in config.items():
        flat |= value if isinstance(value, dict) else {key: value}
    flat = {"batch_size": 1, "output_format": "markdown"} | flat
    missing = [k for k in ("metadata_path", "output_dir") if not flat.get(k)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    if not isinstance(flat["batch_size"], int) or isinstance(flat["batch_size"], bool) or flat["batch_size"] <= 0:
        raise ValueError("batch_size must be a positive integer")
    if flat["output_format"] not in OUTPUT_FORMATS:
        raise ValueError(f"output_format must be one of {', '.join(OUTPUT_FORMATS)}")
    return flat


def load_worker(path: str, overrides: dict | None = None) -> dict:
    """A worker's configuration from a YAML file on the driver, checked; what is given beside it counts more than the file."""
    import yaml  # only a driver that reads such a file needs it

    with open(path, encoding="utf-8") as f:
        held = yaml.safe_load(f) or {}
    if not isinstance(held, dict):
        raise ValueError(f"{path} holds no sections")
    flat: dict = {}
    for key, value in held.items():
        flat |= value if isinstance(value, dict) else {key: value}
    return validate_worker(flat | {k: v for k, v in (overrides or {}).items() if v is not None})

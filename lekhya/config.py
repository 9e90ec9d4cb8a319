"""Settings of the pipelines; none is required, none names a server."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Where things are and how much of them; environment variables override."""

    input_dir: str = "input_pdfs"
    dataset_dir: str = "extracted_jsons"
    collection_dir: str = "collections"
    collection: str = "acts"
    recreate: bool = False
    search_type: str = "hybrid"
    top_k: int = 5
    rerank: bool = True
    dim: int = 64
    use_windowing: bool = False
    batch_size: int | None = None
    provider: str = "auto"
    model_host: str = "http://localhost:11434"
    model: str = ""
    run_extract: bool = False
    run_ingest: bool = False

    @classmethod
    def from_env(cls, prefix: str = "LEKHYA_") -> Settings:
        """Settings with the variables PREFIX + NAME in the place of defaults."""
        out = {}
        for name, kind in cls.__annotations__.items():
            raw = os.environ.get(prefix + name.upper())
            if raw is not None:
                out[name] = raw.lower() in ("1", "true", "yes", "on") if kind == "bool" else int(raw) if "int" in kind else raw
        return cls(**out)

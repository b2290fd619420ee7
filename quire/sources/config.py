"""Settings of a recognition run, as a value that becomes reader or adapter options."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from enum import Enum
from pathlib import PurePath

# The labels that layout recognition knows.
LAYOUT_LABELS = ("image", "figure", "table", "caption", "header", "footer", "title", "subtitle", "heading", "paragraph", "list")


class Quantization(str, Enum):
    NONE = "none"
    INT8 = "int8"
    INT4 = "int4"


@dataclass(frozen=True)
class Recognition:
    model: str = ""
    quantization: Quantization = Quantization.NONE
    device: str = "auto"
    pages_per_batch: int = 20
    most_pages: int = 30
    target_size: int = 1024
    cache: PurePath | None = None

    def batch_size(self) -> int:
        return min(self.most_pages, max(1, self.pages_per_batch))

    def options(self) -> dict[str, str]:
        """All settings as text; enumerations by value, what is unset left out."""
        return {k: str(v.value if isinstance(v, Enum) else v) for k, v in asdict(self).items() if v is not None}


def model_available(folder: str) -> bool:
    """Whether a model's index and all the shards that it names are in a folder; any error means no."""
    import json
    import os

    try:
        have = set(os.listdir(folder))
        index = [n for n in have if n.endswith(".index.json")]
        if "config.json" not in have:
            return False
        if index:
            with open(os.path.join(folder, index[0])) as f:
                return set(json.load(f)["weight_map"].values()) <= have
        return any(n.endswith(".safetensors") for n in have)
    except (OSError, ValueError, KeyError, AttributeError):
        return False

"""What training keeps between rounds: margins in the shared folder, models in any store."""

from __future__ import annotations

import json

from ..functions.storage import read_file, write_file
from ..functions.storage import stored as fold_margin  # noqa: F401


def save_checkpoint(model, round_: int, objective: str, path: str) -> None:
    from ..sources.models import to_native

    write_file(path, json.dumps({"round": round_, "objective": objective, "model": to_native(model)}).encode())


def load_checkpoint(path: str):
    """(model, round, objective)."""
    from ..sources.models import from_native

    d = json.loads(read_file(path))
    return from_native(d["model"]), d["round"], d["objective"]

"""Run settings: YAML with overrides, and global seeds."""

from __future__ import annotations

import json
import random
from pathlib import Path
from typing import Any

import numpy as np
import yaml

from .operators.losses import LossWeights

Config = dict[str, dict[str, Any]]

#: fixed values: the settings a run starts from
DEFAULTS: Config = {
    "run": {"seed": 2026, "output_dir": "outputs"},
    "data": {"train_dir": "data/train", "val_dir": "data/val", "raw_dataset_root": None, "image_size": [224, 224], "local_window": 25},
    "model": {"input_dim": 4, "hidden_dim": 128, "num_types": 4, "text_layers": 2, "dropout": 0.1},
    "train": {"epochs": 200, "batch_size": 8, "lr": 3e-4, "min_lr": 1e-5, "weight_decay": 1e-4, "grad_clip": 1.0},
    "loss_weights": {"point": 1.0, "seg": 1.0, "type": 1.0, "evidence": 0.5, "bc": 1.0, "cons": 0.2, "tv": 0.05},
}


def load(path: str | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """Defaults, then the file, then ``overrides`` by "section.key"; None leaves a value as it was."""
    out = {section: dict(values) for section, values in DEFAULTS.items()}
    layers = [{f"{s}.{k}": v for s, part in (yaml.safe_load(Path(path).read_text()) or {}).items() for k, v in part.items()}] if path else []
    for layer in [*layers, overrides or {}]:
        for name, value in layer.items():
            section, _, key = name.partition(".")
            if value is not None:
                out.setdefault(section, {})[key] = value
    return out


def loss_weights(config: Config) -> LossWeights:
    return LossWeights(**config["loss_weights"])


def uses_augmentation(config: Config, training: bool = True) -> bool:
    """The augmented branch is planned only for training with a positive weight."""
    return training and config["loss_weights"]["bc"] > 0


def set_seed(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed % 2**32)


def write_json(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False))


def write_yaml(value: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(value, sort_keys=False))

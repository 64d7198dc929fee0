"""Training curves: the data as DataFrames, and a picture where matplotlib is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.history import bc_visible, best_epoch


def curve_panels(history: DataFrame, include_bc: bool | None = None) -> dict[str, list[str]]:
    """Columns of the three panels. Without a word on it, boundary consistency shows if it was ever on."""
    if include_bc is None:
        include_bc = bc_visible(history).head()[0]
    return {"loss": ["train_loss", "val_loss"], "parts": ["train_point", "train_seg", "train_type", *(["train_bc"] if include_bc else [])], "scores": ["val_point_f1", "val_event_f1"]}


def save_curves(history: DataFrame, path: str, title: str = "training", include_bc: bool | None = None) -> None:
    """A three-panel picture with the best epoch marked. A history is a row an epoch, so it is drawn on the driver."""
    rows = history.orderBy("epoch").collect()
    if not rows:
        raise ValueError("the history is empty")
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    panels = curve_panels(history, include_bc)
    best = best_epoch(history).head()["epoch"]
    figure, axes = plt.subplots(len(panels), 1, figsize=(8, 10), sharex=True)
    for axis, (name, columns) in zip(axes, panels.items(), strict=True):
        for c in columns:
            axis.plot([r["epoch"] for r in rows], [r[c] for r in rows], label=c)
        axis.axvline(best, linestyle="--", linewidth=1)
        axis.set_title(f"{title}: {name}")
        axis.legend()
    figure.savefig(path)
    plt.close(figure)

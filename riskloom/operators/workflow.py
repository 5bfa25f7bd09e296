"""From a raw table to evaluated models in one call: clean, binarise, describe, split, train."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..session import settle
from .models import MODELS, Training, train
from .profile import class_balance, clean_features, feature_meta, table_summary
from .target import binarize_target, check_target, stratified_split

TARGET = "__target__"
SPLIT = "split"


@dataclass
class Outcome:
    """What each step of a run gave; ``rows`` are the cleaned rows with 0/1 target and split."""

    dropped: dict[str, str]
    rows: DataFrame
    balance: DataFrame
    features: DataFrame
    summary: DataFrame
    balance_by_split: DataFrame
    training: Training

    def release(self) -> None:
        self.training.release()


def run_workflow(
    df: DataFrame, target: str, keys: Sequence[str], positive_class=None, threshold: float | None = None, seed: int = 42,
    models: Sequence[str] = tuple(MODELS), params: Mapping[str, Mapping] | None = None, sizes: Mapping[str, float] | None = None,
) -> Outcome:
    """Drop what is no feature, make the target 0/1, describe the features, split by class, train and score.

    ``keys`` identify a row; they decide its split and are neither cleaned nor features. ``positive_class`` and ``threshold`` are
    those of ``binarize_target``, ``sizes`` those of ``stratified_split``, ``params`` those of ``train``. The split rows are written
    to the shared folder once, as all later steps read them.
    """
    names = [c for c in df.columns if c not in keys]
    if target not in names:
        raise ValueError(f"target column {target!r} not found")
    _, dropped = clean_features(df.select(*names), target, list(keys) if set(keys) <= set(names) else ())
    binary = binarize_target(df.drop(*dropped), target, positive_class, threshold, out=TARGET)
    split = stratified_split(binary, TARGET, keys, seed, out=SPLIT, **(sizes or {}))
    rows = settle(split, "workflow")
    check_target(rows, TARGET)
    columns = [c for c in rows.columns if c not in (*keys, TARGET, SPLIT)]
    described = rows.select(*columns, TARGET, SPLIT)
    return Outcome(
        dropped, rows, class_balance(described, TARGET), feature_meta(rows.select(*columns), columns),
        table_summary(described, TARGET, [SPLIT]), class_balance(described, TARGET, [SPLIT]),
        train(rows, TARGET, SPLIT, models, params, keep=keys, seed=seed))

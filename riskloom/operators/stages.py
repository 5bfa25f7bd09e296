"""The encoders as MLlib stages: fitted in a ``Pipeline``, saved with it, loaded and applied to raw rows.

``WOEStage``, ``TargetStage`` and ``SmartStage`` are estimators over the encoders of ``operators.encode``.
What a fit has learned is tables and small facts; a saved model is its parameters and facts as metadata and
its tables as parquet, partitioned by feature.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.rows import BROADCAST_ROWS, local_table
from .encode import SmartEncoder, SmartModel, TargetEncoder, TargetModel, WOEEncoder, WOEModel

TABLES = "tables"


class _EncoderParams(HasInputCols, HasLabelCol):
    """``inputCols`` are encoded, each into a column named with ``suffix`` (smart encoding replaces them)."""

    suffix = Param(Params._dummy(), "suffix", "ending of the encoded columns' names", TypeConverters.toString)

    def getSuffix(self) -> str:
        return self.getOrDefault(self.suffix)

    def outputs(self) -> list[str]:
        """Names of the encoded columns."""
        return [c + self.getSuffix() for c in self.getInputCols()]


class _EncoderStage(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    def _fit(self, dataset: DataFrame) -> _EncoderModel:
        fitted = self._encoder().fit(dataset, self.getInputCols(), self.getLabelCol())
        return self._copyValues(self._model_class()._of(fitted))


# -- state ------------------------------------------------------------------------

def _woe_state(m: WOEModel) -> tuple[dict, dict]:
    return {"edges": m.edges, "kinds": m.kinds, "sizes": m.sizes, "fills": m.fills}, {"bins": m.bins}


def _woe_of(state: dict, tables: dict) -> WOEModel:
    return WOEModel(tables["bins"], **state)


def _target_state(m: TargetModel) -> tuple[dict, dict]:
    return {"global_mean": m.global_mean, "features": m.features, "sizes": m.sizes, "separate": m.separate}, {"table": m.table}


def _target_of(state: dict, tables: dict) -> TargetModel:
    return TargetModel(tables["table"], **state)


def _smart_state(m: SmartModel) -> tuple[dict, dict]:
    state: dict = {"strategies": m.strategies, "levels": m.levels, "nulls": m.nulls, "woe": None, "target": None}
    tables: dict = {}
    for name, part, of in (("woe", m.woe, _woe_state), ("target", m.target, _target_state)):
        if part is not None:
            state[name], held = of(part)
            tables |= held
    return state, tables


def _smart_of(state: dict, tables: dict) -> SmartModel:
    woe = _woe_of(state["woe"], tables) if state["woe"] else None
    target = _target_of(state["target"], tables) if state["target"] else None
    return SmartModel(state["strategies"], state["levels"], state["nulls"], woe, target)


class _StateWriter(MLWriter):
    def __init__(self, instance: _EncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        state, tables = self.instance._state_of(self.instance.fitted)
        for name, table in tables.items():
            table.repartition("feature").write.mode("overwrite").partitionBy("feature").parquet(f"{path}/{TABLES}/{name}")
        schemas = {name: table.schema.json() for name, table in tables.items()}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"state": state, "schemas": schemas})


class _StateReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> _EncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {
            name: _read(self.sparkSession, f"{path}/{TABLES}/{name}", StructType.fromJson(json.loads(schema)))
            for name, schema in metadata["schemas"].items()}
        model = self.cls._of(self.cls._fitted_of(metadata["state"], tables))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A saved table; held locally where a fit would have held it so."""
    table = spark.read.schema(schema).parquet(path).select(schema.names)
    return local_table(spark, table.collect(), schema) if table.count() <= BROADCAST_ROWS else table


class _EncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """``fitted`` is the encoder's model with its tables, reports and so on."""

    @classmethod
    def _of(cls, fitted):
        model = cls()
        model.fitted = fitted
        return model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getSuffix())

    def copy(self, extra=None):
        again = super().copy(extra)
        again.fitted = self.fitted
        return again

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


# -- weight of evidence -----------------------------------------------------------

class WOEStageModel(_EncoderModel):
    _state_of, _fitted_of = staticmethod(_woe_state), staticmethod(_woe_of)


class WOEStage(_EncoderStage):
    nBins = Param(Params._dummy(), "nBins", "quantile bins of a number", TypeConverters.toInt)
    regularization = Param(Params._dummy(), "regularization", "added to both counts", TypeConverters.toFloat)
    handleMissing = Param(Params._dummy(), "handleMissing", "separate, or anything else for the mode", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "label", suffix: str = "_woe", nBins: int = 10,
                 regularization: float = 0.5, handleMissing: str = "separate"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", suffix="_woe", nBins=10, regularization=0.5, handleMissing="separate")

    def _encoder(self) -> WOEEncoder:
        of = self.getOrDefault
        return WOEEncoder(of(self.nBins), of(self.regularization), of(self.handleMissing))

    def _model_class(self) -> type:
        return WOEStageModel


# -- target encoding --------------------------------------------------------------

class TargetStageModel(_EncoderModel):
    _state_of, _fitted_of = staticmethod(_target_state), staticmethod(_target_of)


class TargetStage(_EncoderStage):
    """Scores of raw rows; for training rows see ``TargetEncoder.fit_transform``, which leaves out each row's own fold."""

    smoothing = Param(Params._dummy(), "smoothing", "rows that the mean of all counts for", TypeConverters.toFloat)
    handleMissing = Param(Params._dummy(), "handleMissing", "separate or global_mean", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "label", suffix: str = "_te", smoothing: float = 1.0,
                 handleMissing: str = "global_mean"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", suffix="_te", smoothing=1.0, handleMissing="global_mean")

    def _encoder(self) -> TargetEncoder:
        return TargetEncoder(self.getOrDefault(self.smoothing), handle_missing=self.getOrDefault(self.handleMissing))

    def _model_class(self) -> type:
        return TargetStageModel


# -- by cardinality ---------------------------------------------------------------

class SmartStageModel(_EncoderModel):
    _state_of, _fitted_of = staticmethod(_smart_state), staticmethod(_smart_of)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def outputs(self) -> list[str]:
        m = self.fitted
        hot = [f"{f}_{v}" for f, levels in m.levels.items() for v in [*levels, *(["null"] if m.nulls[f] else [])]]
        return hot + [f for f, s in m.strategies.items() if s != "onehot"]


class SmartStage(_EncoderStage):
    """One-hot, weight of evidence or target encoding by number of values; the columns are replaced."""

    low = Param(Params._dummy(), "low", "most values for one-hot columns", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "most values for weight of evidence", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, labelCol: str = "label", suffix: str = "", low: int = 5, high: int = 50):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", suffix="", low=5, high=50)

    def _encoder(self) -> SmartEncoder:
        return SmartEncoder(self.getOrDefault(self.low), self.getOrDefault(self.high))

    def _model_class(self) -> type:
        return SmartStageModel

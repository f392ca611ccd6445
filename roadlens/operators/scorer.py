"""One persisted scorer: contract check, vocabulary remap, encoding, ensemble mean and calibration as stages of a single PipelineModel.

It is saved and loaded with MLlib's own `write().save` and `PipelineModel.load`.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.rules import platt
from roadlens.operators.contracts import Contract


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose settings are params, so that MLlib saves and loads it."""

    def _take(self, settings: dict) -> None:
        self._set(**{k: v for k, v in settings.items() if v is not None})


class ContractCheck(_Stage):
    """Rows as they are; raises on missing, extra or misplaced columns and on wrong types before anything runs."""

    contract = Param(Params._dummy(), "contract", "contract as JSON", TypeConverters.toString)
    carried = Param(Params._dummy(), "carried", "columns beside the features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, contract: str | None = None, carried: list[str] | None = None) -> None:
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        Contract.from_json(self.getOrDefault(self.contract)).check(rows, self.getOrDefault(self.carried))
        return rows


class VocabularyRemap(_Stage):
    """Values of columns replaced by a vocabulary; values that it lacks pass through, so applying it twice is applying it once
    where no new value is an old one."""

    vocabulary = Param(Params._dummy(), "vocabulary", "{column: {old: new}} as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, vocabulary: str | None = None) -> None:
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        changed = {}
        for column, terms in json.loads(self.getOrDefault(self.vocabulary)).items():
            table = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
            changed[column] = F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)) if terms else F.col(column)
        return rows.withColumns(changed)


class MeanProbability(_Stage):
    """raw: the mean of the positive class over the members' probability columns, held inside 1e-8 and 1 - 1e-8; the members' columns go."""

    members = Param(Params._dummy(), "members", "number of models", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, members: int | None = None) -> None:
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        n = self.getOrDefault(self.members)
        mean = sum((vector_to_array(f"_p{i}")[1] for i in range(n)), F.lit(0.0)) / n
        raw = F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), mean))
        return rows.withColumn("raw", raw).drop(*[f"_{c}{i}" for c in "pry" for i in range(n)])


class PlattCalibrator(_Stage):
    """calibrated: the sigmoid of the raw score, rounded to 4."""

    slope = Param(Params._dummy(), "slope", "slope", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, slope: float | None = None, intercept: float | None = None) -> None:
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("calibrated", F.round(platt(F.col("raw"), self.getOrDefault(self.slope), self.getOrDefault(self.intercept)), 4))


def build_scorer(
    contract: Contract, carried: list[str], vocabulary: dict[str, dict[str, str]], prepared: PipelineModel, models: list, slope: float, intercept: float
) -> PipelineModel:
    """The scorer of fitted parts: prepared makes `features` from the contract's columns, models are boosted ensembles over it."""
    members = []
    for i, model in enumerate(models):
        member = model.copy()
        members.append(member.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}"))
    return PipelineModel(
        [
            ContractCheck(contract=contract.to_json(), carried=carried),
            VocabularyRemap(vocabulary=json.dumps(vocabulary)),
            *prepared.stages,
            *members,
            MeanProbability(members=len(models)),
            PlattCalibrator(slope=slope, intercept=intercept),
        ]
    )

"""Feature contracts: an ordered list of features with types, defaults and flags, kept as JSON beside a matrix and enforced at selection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.operators.relational import contract_problems

#: What a contract may call a column, and the Spark types that fit.
KINDS = {"float": ("float", "double", "decimal"), "int": ("tinyint", "smallint", "int", "bigint"), "categorical": ("string",)}


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    default: object = 0
    source: str = ""
    prediction_time_available: bool = True
    window_bounded: bool = False
    description: str = ""


@dataclass(frozen=True)
class Contract:
    """version, features in order, and the first day of the histories that window-bounded features count over."""

    version: str
    features: tuple[Feature, ...]
    window_start: str | None = None
    dropped: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        names = self.names
        if repeated := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"repeated features: {sorted(repeated)}")
        if unknown := [f.name for f in self.features if f.dtype not in KINDS]:
            raise ValueError(f"features of unknown types: {unknown}")
        if found := sorted(set(self.dropped) & set(names)):
            raise ValueError(f"dropped features are in the contract: {found}")
        if self.window_start is None and (bounded := [f.name for f in self.features if f.window_bounded]):
            raise ValueError(f"window-bounded features without a window: {bounded}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    @property
    def categories(self) -> list[str]:
        return [f.name for f in self.features if f.dtype == "categorical"]

    @classmethod
    def of(cls, rows: DataFrame, version: str, window_start: str | None = None, **flags: dict) -> Contract:
        """The contract that a matrix has; flags: other fields of single features by name."""
        kind = lambda t: next((k for k, types in KINDS.items() if t.startswith(types)), t)
        made = (Feature(**{"name": n, "dtype": kind(t), "default": "UNKNOWN" if t == "string" else 0} | flags.get(n, {})) for n, t in rows.dtypes)
        return cls(version, tuple(made), window_start)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Contract:
        spec = json.loads(text)
        return cls(spec["version"], tuple(Feature(**f) for f in spec["features"]), spec["window_start"], tuple(spec["dropped"]))

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Contract:
        return cls.from_json(spark.read.text(folder, wholetext=True).first()[0])

    def check(self, rows: DataFrame, carried: list[str] | None = None) -> None:
        """Raise unless the columns of rows, without the carried ones, are the features in order and of fitting types."""
        own = rows.drop(*(carried or []))
        problems: list[tuple] = list(contract_problems(own, self.names))
        kinds = dict(own.dtypes)
        problems += [(f.name, f"is {kinds[f.name]}, not {f.dtype}") for f in self.features if f.name in kinds and not kinds[f.name].startswith(KINDS[f.dtype])]
        if problems:
            raise ValueError(f"columns differ from contract {self.version}: {problems}")

    def select(self, rows: DataFrame, carried: list[str] | None = None, at_prediction: bool = True) -> DataFrame:
        """The carried columns and the features in order, nulls replaced by the defaults.

        Raises on missing columns and, at prediction, on features that are not known by then. Other columns are left out on purpose here;
        `check` is the gate that lets none pass.
        """
        if at_prediction and (late := [f.name for f in self.features if not f.prediction_time_available]):
            raise ValueError(f"features that prediction cannot have: {late}")
        if missing := [n for n in self.names if n not in rows.columns]:
            raise ValueError(f"features that rows lack: {missing}")
        filled = [F.coalesce(F.col(f.name), F.lit(f.default)).alias(f.name) if f.default is not None else F.col(f.name) for f in self.features]
        return rows.select(*(carried or []), *filled)


def write_matrix(rows: DataFrame, contract: Contract, carried: list[str], path: str, partition: str) -> None:
    """A matrix under path/rows, partitioned by a carried column, with its contract under path/contract."""
    contract.check(rows, carried)
    rows.write.partitionBy(partition).parquet(f"{path}/rows")
    contract.save(rows.sparkSession, f"{path}/contract")


def read_matrix(spark: SparkSession, path: str, carried: list[str]) -> tuple[DataFrame, Contract]:
    """The matrix, held against its contract, with the carried columns first."""
    contract = Contract.load(spark, f"{path}/contract")
    rows = spark.read.parquet(f"{path}/rows").select(*carried, *contract.names)
    contract.check(rows, carried)
    return rows, contract

"""What a training loop needs to go on after its driver was lost.

A journal is a folder. Each closed round appends one row to a table there, with the
states of the members, the voters that changed and the rows of the history. Spark's committer
makes a row visible as a whole or not at all, so a round that was cut short is run anew.
Voters are stored by value; models of ``pyspark.ml`` in folders of their own, by
Spark's own writers. A journal holds pickled objects: resume only from folders you trust.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from peerlabel.config import CoTrainConfig
from peerlabel.operators.members import ClassifierVoter, Voter
from peerlabel.sources.shared import exists

SCHEMA = "round INT, payload BINARY"
BEFORE = -1  # the round of the first voters


@dataclass(frozen=True)
class Entry:
    """A closed round: the voters it changed, by member, and everyone's states after it."""

    round_no: int
    voters: dict[int, Voter]
    states: list
    rounds: list[dict]
    updated: list[int]


class Journal:
    def __init__(self, spark: SparkSession, path: str, config: CoTrainConfig, sizes: Sequence[float]):
        self.spark, self.path = spark, path.rstrip("/")
        self.told = {"config": config, "sizes": list(sizes)}

    def entries(self) -> list[Entry]:
        """The closed rounds so far, in order; fails if they are of another job."""
        if not exists(self.spark, f"{self.path}/rounds"):
            return []
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rounds").collect()
        found = []
        for row in sorted(rows, key=lambda r: r["round"]):
            payload = pickle.loads(bytes(row["payload"]))
            if payload["told"] != self.told:
                raise ValueError(f"the journal at {self.path} is of a job with other settings or tables")
            entry = payload["entry"]
            found.append(replace(entry, voters={k: self._restored(v) for k, v in entry.voters.items()}))
        return found

    def append(self, entry: Entry) -> None:
        kept = replace(entry, voters={k: self._kept(v) for k, v in entry.voters.items()})
        payload = pickle.dumps({"told": self.told, "entry": kept})
        row = self.spark.createDataFrame([(entry.round_no, bytearray(payload))], SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/rounds")

    def _kept(self, voter: Voter):
        if not isinstance(voter, ClassifierVoter):
            return voter
        place = f"{self.path}/models/{uuid.uuid4().hex}"
        voter.model.write().save(place)
        return replace(voter, model=_Stored(place))

    def _restored(self, voter: Voter):
        if isinstance(voter, ClassifierVoter) and isinstance(voter.model, _Stored):
            return replace(voter, model=DefaultParamsReader.loadParamsInstance(voter.model.path, self.spark.sparkContext))
        return voter


@dataclass(frozen=True)
class _Stored:
    path: str

"""The whole cascade: patterns, two entity stages, four corrections, risk."""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.config import EngineConfig, expand_types
from cloakframe.functions import spanlist
from cloakframe.functions.batches import entity_array, with_columns
from cloakframe.functions.spanlist import Entity
from cloakframe.operators.passes import names_behind_addresses, structural_orgs, without_parts_of_names, without_topics
from cloakframe.operators.recognizers import PLACES, Gazetteer, Nothing, Recognizer, guard, routed, trace
from cloakframe.operators.risk import risks
from cloakframe.schema import ENTITIES


class Found(NamedTuple):
    confirmed: list[Entity]
    uncertain: list[Entity]
    skipped: list[Entity]
    #: Distinct types of confirmed, before types are switched off.
    types: list[str]


class Cascade:
    """The stages with their settings; works on one text at a time and travels to the workers."""

    def __init__(self, config: EngineConfig = EngineConfig(), recognizer: Recognizer | None = None, second: Recognizer | None = None):
        self.config, self.recognizer, self.second = config, recognizer or Gazetteer(), second or Nothing()
        self.off = frozenset(expand_types(config.pii_off))

    def find(self, text: str | None, skip: Collection[str] | None = None, service: bool | None = False) -> Found:
        """`skip`: values that the patterns leave alone; `service`: places are skipped, whatever they are.

        Types that are switched off are dropped from confirmed and uncertain last, so risks and skipped places still have them.
        """
        if not text:
            return Found([], [], [], [])
        config = self.config
        found = spanlist.scan(text, skip=skip)
        masked = spanlist.mask(text, found)
        high, low = routed(trace(masked, found, self.recognizer), config)
        hidden: list[Entity] = []
        free = lambda xs: [e for e in xs if e.type not in PLACES] if service else xs
        if service:
            hidden = [e for e in high + low if e.type in PLACES]
        high, low = free(high), free(low)
        if config.guard_enabled:
            sure, unsure = guard(spanlist.mask(masked, high), low, self.second, config)
        else:
            sure, unsure = [e for e in low if e.score >= config.fallback_threshold], []
        confirmed, unsure = found + high + free(sure), free(unsure)
        confirmed = confirmed + structural_orgs(text, confirmed)
        confirmed, unsure = (without_parts_of_names(names_behind_addresses(x)) for x in (confirmed, unsure))
        if service:
            skipped = hidden
        else:
            confirmed, topics = without_topics(confirmed, text)
            unsure, more = without_topics(unsure, text)
            skipped = topics + more
        types = list(dict.fromkeys(e.type for e in confirmed))
        if self.off:
            confirmed, unsure = ([e for e in x if e.type not in self.off] for x in (confirmed, unsure))
        return Found(confirmed, unsure, skipped, types)


def cascade(df: DataFrame, text: str = "text", config: EngineConfig = EngineConfig(), recognizer: Recognizer | None = None, second: Recognizer | None = None, skip: str | None = None, service: str | None = None) -> DataFrame:
    """Adds confirmed, uncertain, skipped (arrays of entities) and risks to each row, in one pass over the texts.

    `skip` names an array column of values that the patterns leave alone; `service` a Boolean column: where
    it holds, places are skipped. Null texts have no entities.
    """
    stages = Cascade(config, recognizer, second)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).to_pylist()
        left = batch.column(skip).to_pylist() if skip else [None] * len(texts)
        asks = batch.column(service).to_pylist() if service else [False] * len(texts)
        found = [stages.find(t, s, a) for t, s, a in zip(texts, left, asks)]
        return [*(entity_array([f[k] for f in found]) for k in range(3)), pa.array([f.types for f in found], pa.list_(pa.string()))]

    out = with_columns(df, {"confirmed": ENTITIES, "uncertain": ENTITIES, "skipped": ENTITIES, "__types": "array<string>"}, run)
    return out.withColumn("risks", risks(F.col("__types"))).drop("__types")

"""Surrogates for entities, and texts rewritten with them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.config import EngineConfig
from cloakframe.functions import spanlist
from cloakframe.functions.batches import PAIR_TYPE, entity_array, list_array, map_rows, to_entities, with_columns
from cloakframe.functions.spanlist import Claimed, Entity
from cloakframe.functions.surrogates import REPEATABLE, draw, pairs_of
from cloakframe.operators.cascade import Cascade, Found
from cloakframe.operators.risk import risks
from cloakframe.operators.service import asks_for_service, moved_addresses
from cloakframe.schema import ENTITIES, PAIRS

#: Salted attempts at an unused surrogate in a session before a suffix makes it one.
ATTEMPTS = 4


def replaced(text: str, pairs: dict[str, str]) -> str:
    """Each original replaced by its surrogate, one pair after the other, longest original first."""
    for o in sorted(pairs, key=len, reverse=True):
        text = text.replace(o, pairs[o])
    return text


def mask(df: DataFrame, session: str, text: str = "text", config: EngineConfig = EngineConfig(), known: str | None = None, skip_fuzzed: bool = True, errors: str | None = None, **stages: object) -> DataFrame:
    """Adds is_service, fuzzed, confirmed, uncertain, skipped, risks, pairs and sanitized; one pass, no shuffle.

    Requests for a service keep their places, and their addresses move next door. Surrogates depend on the session and the original
    alone, so all rows of a session agree without meeting, unless two originals of different rows draw the same one: `surrogate_rows`
    settles those. `known` names an array column of pairs that are kept. Moved addresses are left alone with `skip_fuzzed`. Null texts stay null.
    `errors` names a column for what a recogniser raised on a row, which then has no entities and no sanitized text; without it the task fails.
    """
    engine, salt = Cascade(config, **stages), config.salt

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found, pairs, clean, services, moves, raised = [], [], [], [], [], []
        olds = batch.column(known).to_pylist() if known else [None] * batch.num_rows
        for own, name, old in zip(batch.column(text).to_pylist(), batch.column("__key").to_pylist(), olds):
            service, name = asks_for_service(own), name or ""
            moved = moved_addresses(own, name) if service else {}
            work = replaced(own or "", moved)
            try:
                f, error = engine.find(work, moved.values() if skip_fuzzed else None, service), None
            except Exception as e:
                if not errors:
                    raise
                f, error = Found([], [], [], []), f"{type(e).__name__}: {e}"
            f = f._replace(confirmed=spanlist.best_by_text(f.confirmed))
            kept = {p["original"]: p["surrogate"] for p in old or ()}
            p = pairs_of([(e.type, e.text) for e in f.confirmed], name, salt, kept)
            found.append(f)
            services.append(service)
            moves.append(list(moved.items()))
            pairs.append([x for x in p.items() if x[0] not in kept])
            clean.append(None if own is None or error else replaced(work, p))
            raised.append(error)
        types = pa.array([f.types for f in found], pa.list_(pa.string()))
        return [*(entity_array([f[k] for f in found]) for k in range(3)), types, list_array(pairs, PAIR_TYPE), pa.array(clean, pa.string()), pa.array(services, pa.bool_()), list_array(moves, PAIR_TYPE), *([pa.array(raised, pa.string())] if errors else [])]

    new = {"confirmed": ENTITIES, "uncertain": ENTITIES, "skipped": ENTITIES, "__types": "array<string>", "pairs": PAIRS, "sanitized": "string", "is_service": "boolean", "fuzzed": PAIRS} | ({errors: "string"} if errors else {})
    out = with_columns(df.withColumn("__key", F.col(session).cast("string")), new, run)
    return out.withColumn("risks", risks(F.col("__types"))).drop("__types", "__key")


def with_pairs(df: DataFrame, session: str, entities: str = "entities", text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds pairs (original, surrogate) of the row's entities, and masked: the text with the surrogates."""
    salt = config.salt

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        names = batch.column(session).cast(pa.string()).to_pylist()
        made = [pairs_of([(e.type, e.text) for e in own], name or "", salt) for own, name in zip(to_entities(batch.column(entities)), names)]
        clean = [None if t is None else replaced(t, p) for t, p in zip(batch.column(text).to_pylist(), made)]
        return [list_array([list(p.items()) for p in made], PAIR_TYPE), pa.array(clean, pa.string())]

    return with_columns(df, {"pairs": PAIRS, "masked": "string"}, run)


def surrogate_rows(entities: DataFrame, session: str, config: EngineConfig = EngineConfig(), known: DataFrame | None = None) -> DataFrame:
    """(session, type, original, surrogate) of distinct originals, from one row for each entity (session, type, text).

    Within a session no two originals share a surrogate: the first by original keeps it, the others draw again (a window by
    session and surrogate for each attempt, so a large session isn't one task), at last with a suffix of their rank. Originals in
    `known` (session, original, surrogate) keep theirs, and what it holds is taken.
    """
    salt, kind = config.salt, dict(entities.dtypes)[session]
    rows = entities.select(session, "type", F.trim("text").alias("original")).filter("original <> ''").groupBy(session, "original").agg(F.min("type").alias("type"))
    old = known.select(F.col("session").cast(kind).alias(session) if "session" in known.columns else F.col(session), "original", F.col("surrogate").alias("kept")) if known is not None else None
    named = rows.withColumn("__s", F.col(session).cast("string"))

    def tries(_, own: str | None, type_: str, original: str):
        yield _, type_, original, [draw(type_, original, own or "", salt, k) for k in range(ATTEMPTS)]

    out = map_rows(named, [session, "__s", "type", "original"], f"`{session}` {kind}, type string, original string, tries array<string>", tries)
    if old is None:
        out = out.withColumn("kept", F.lit(None).cast("string"))
    else:
        # What is known takes part in every round, so that nobody else gets it.
        out = out.join(old, [session, "original"], "full_outer").withColumns({"new": F.col("type").isNotNull(), "type": F.coalesce("type", F.lit(""))})
    if "new" not in out.columns:
        out = out.withColumn("new", F.lit(True))
    may = F.col("kept").isNull() & ~F.col("type").isin(*sorted(REPEATABLE))
    out = out.withColumn("surrogate", F.coalesce("kept", F.col("tries")[0]))
    by_surrogate = Window.partitionBy(session, "surrogate").orderBy(F.col("kept").isNull(), "original")
    for k in range(1, ATTEMPTS):
        out = out.withColumn("r", F.row_number().over(by_surrogate))
        out = out.withColumn("surrogate", F.when(may & ((F.col("r") > 1) | (F.col("surrogate") == F.col("original"))), F.col("tries")[k]).otherwise(F.col("surrogate")))
    out = out.withColumn("r", F.row_number().over(by_surrogate))
    digits = F.lower(F.hex("r"))
    suffix = F.concat(F.lit("_"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 4 - F.length(digits))), digits)
    out = out.withColumn("surrogate", F.when(may & (F.col("r") > 1), F.concat("surrogate", suffix)).otherwise(F.col("surrogate")))
    return out.filter("new").select(session, "type", "original", "surrogate")


def inverted(pairs: Column) -> Column:
    """Surrogate -> original; the last pair of a surrogate wins."""
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.exists(F.slice(pairs, x["i"] + 2, F.size(pairs)), lambda q: q["surrogate"] == x["p"]["surrogate"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["p"]["surrogate"], x["p"]["original"])))


def anonymise(df: DataFrame, session: str, text: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """The rows with `text` rewritten, and nothing else added."""
    return mask(df, session, text, config).withColumn(text, F.col("sanitized")).select(*df.columns)


def baseline_of(found: list[Entity], text: str) -> list[Entity]:
    """Entities of another engine: positions within the text, trimmed, scores of two digits; where they overlap the higher score stays."""
    taken, kept = Claimed(), []
    fitted = []
    for e in found:
        a, b = max(0, e.start), min(len(text), e.end)
        if own := text[a:b].strip():
            fitted.append(Entity(own, a, b, e.type, round(e.score, 2), e.source))
    for e in sorted(fitted, key=lambda e: -e.score):
        if taken.free(e.start, e.end):
            taken.add(e.start, e.end)
            kept.append(e)
    return sorted(kept, key=lambda e: e.start)


def baseline_entities(df: DataFrame, candidates: str, text: str = "text", out: str = "baseline") -> DataFrame:
    """Adds the fitted entities of another engine, from a column with what it found; null where it found nothing to tell."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        fitted = [baseline_of(e, t or "") for e, t in zip(to_entities(batch.column(candidates)), batch.column(text).to_pylist())]
        return [entity_array(fitted)]

    return with_columns(df, {out: ENTITIES}, run)


def redacted(df: DataFrame, text: str = "text", entities: str = "entities", out: str = "redacted") -> DataFrame:
    """Adds the text with each entity's span replaced by its type in brackets."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([None if t is None else spanlist.redact(t, e) for t, e in zip(batch.column(text).to_pylist(), to_entities(batch.column(entities)))], pa.string())]

    return with_columns(df, {out: "string"}, run)

"""Calling translators from a stage of Arrow batches, with retries; a failure keeps the row and says why."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks

Call = Callable[[str], str]

#: Attempts and waits (seconds) of machine and of model translation, and what a connection is tried with.
ATTEMPTS = {"mt": (4, 1.0, 8.0), "llm": (6, 2.0, 30.0)}
PROBE = "Hello"


@dataclass(frozen=True)
class Engine:
    """make() gives a task its client. limit: characters of a request, no limit if None; kind: how it is retried."""

    name: str
    make: Callable[[], Call]
    limit: int | None = None
    kind: str = "mt"


#: Size limits of the engines' requests. A model gets its prompt whole.
LIMITS: dict[str, int | None] = {"llm": None, "google": 2000, "microsoft": 1000}
OTHER_LIMIT = 4000
_ENGINES: dict[str, Engine] = {}


def register(name: str, make: Callable[[], Call], limit: int | None = OTHER_LIMIT, kind: str = "") -> Engine:
    """Makes an engine known by its name; those of LIMITS have their own limit."""
    engine = Engine(name, make, LIMITS.get(name, limit), kind or ("llm" if name == "llm" else "mt"))
    _ENGINES[name] = engine
    return engine


def engine_of(name: str) -> Engine:
    if name not in _ENGINES:
        raise ValueError(f"no such engine: {name}; there are {sorted(_ENGINES)}")
    return _ENGINES[name]


class HardError(Exception):
    """An error that another attempt won't mend."""


def with_retries(call: Call, text: str, kind: str = "mt", sleep: Callable[[float], None] = time.sleep, engine: str = "", probe: bool = False) -> str:
    """probe: a tiny request that asks whether a model answers; it isn't repeated."""
    attempts, wait, most = ATTEMPTS[kind]
    attempts = 1 if probe and kind == "llm" else attempts
    for k in range(attempts):
        try:
            return call(text)
        except HardError:
            raise
        except Exception as e:
            if k == attempts - 1:
                raise RuntimeError(f"{engine or kind}: {e}") from e
            sleep(min(most, wait * 2**k))
    raise AssertionError


def preflight(*engines: Engine, sleep: Callable[[float], None] = time.sleep) -> None:
    """One tiny request to each engine that a job needs (its translator, its reviewer), each once: a wrong key or address
    fails here and not in every row."""
    for engine in dict.fromkeys(engines):
        try:
            with_retries(engine.make(), PROBE, engine.kind, sleep, engine.name, probe=True)
        except Exception as e:
            raise RuntimeError(f"no connection to {engine.name}: {e}") from e


def translated(rows: DataFrame, engine: Engine, per_second: float | None = None, workers: int | None = None) -> DataFrame:
    """rows (source) with draft and error. Texts are cut to the engine's limit at sentence ends, and the pieces' translations
    joined without a space, as Chinese is. per_second limits all calls together: it is shared among `workers` tasks, or
    those that there are."""
    share = 1
    if per_second:
        rows = rows.repartition(workers) if workers else rows
        share = workers or rows.rdd.getNumPartitions()
    pieces = chunks.split_text("source", engine.limit) if engine.limit else F.array("source")
    pause = share / per_second if per_second else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = engine.make()
        for f in frames:
            drafts, errors = [], []
            for text, parts in zip(f["source"], f["_pieces"], strict=True):
                try:
                    if text is None or not text.strip():
                        drafts.append(text)
                    else:
                        done = []
                        for part in parts:
                            started = time.time()
                            done.append(with_retries(call, part, engine.kind, engine=engine.name))
                            time.sleep(max(0.0, pause - (time.time() - started)))
                        drafts.append("".join(done))
                    errors.append(None)
                except Exception as e:
                    drafts.append(None)
                    errors.append(str(e))
            yield f.drop(columns="_pieces").assign(draft=drafts, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.withColumn("_pieces", pieces).mapInPandas(run, f"{fields}, draft string, error string")


def exit_status(results: DataFrame) -> int:
    """1 if any row or file failed; the others were done all the same."""
    return int(not results.where("error IS NOT NULL").isEmpty())

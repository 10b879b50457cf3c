"""Planning of prediction runs: task grid, keys, resume and the user's model call."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_fences


def expand_rounds(items: DataFrame, n: int, models: Sequence[str] | None = None) -> DataFrame:
    """Items x rounds 1..n, and x model names when given.

    The number of tasks is the product by definition; it is made in place from
    two short arrays per item, without a join.
    """
    tasks = items.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if models is None:
        return tasks
    names = [F.lit(m) for m in dict.fromkeys(models)]
    return tasks.withColumn("model", F.explode(F.array(*names)))


def _printed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def unique_key(*parts: Column | str) -> Column:
    """md5 of the parts joined by ``__``; a missing part prints as ``None``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("__", *[_printed(c) for c in cols]))


def schema_key(
    new_id: Column, item_id: Column, function_ids: Column, question_en: Column,
    question: Column, round_no: Column,
) -> Column:
    """Key of a schema-level task: new id or id, function ids joined by ``,``, question."""
    text = F.coalesce(
        F.nullif(question_en, F.lit("")), F.nullif(question, F.lit("")), F.lit("")
    )
    return unique_key(F.coalesce(new_id, item_id), F.array_join(function_ids, ","), text, round_no)


def stable_key(unique: Column, item_id: Column, round_no: Column, model: Column) -> Column:
    """The stored key when there is one, else md5 of id, round and model."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(
        F.nullif(unique, F.lit("")),
        F.md5(F.concat_ws("__", blank(item_id), blank(round_no), blank(model))),
    )


def pending(
    tasks: DataFrame,
    done: DataFrame,
    key: str | Sequence[str] = "unique_key",
    done_filter: Column | None = None,
) -> DataFrame:
    """Tasks whose key is not stored yet.

    Stored keys are reduced to one row each before they move, so a key stored
    very often weighs no more than any other.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if done_filter is not None:
        done = done.where(done_filter)
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def _retryable(message: str) -> bool:
    message = message.lower()
    return "timeout" in message or "connection error" in message


def _attempt(call: Callable[[], object], retries: int, delay: float) -> tuple[object, str | None]:
    """Result of ``call`` or the text of its failure; only network trouble is tried again."""
    for left in range(retries - 1, -1, -1):
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001 - a row's failure is data, not the job's failure
            if not _retryable(str(e)):
                return None, f"{type(e).__name__}: {e}"
            if not left:
                return None, f"failed after {retries} attempts: {e}"
            time.sleep(delay)
    return None, "no attempt allowed"


PREDICTION_FIELDS = [
    T.StructField("response", T.StringType()),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("thread_id", T.LongType()),
]


def batch_predict(
    df: DataFrame,
    fn: Callable[[str], tuple[str, int] | str],
    prompt: str = "prompt",
    retries: int = 3,
    delay: float = 10.0,
    in_flight: int = 16,
) -> DataFrame:
    """Call ``fn(prompt)`` for every row and add text, tokens, error and timing.

    ``fn`` returns text or (text, tokens) and is called from ``in_flight`` threads of each task, so
    one that waits for a server doesn't hold up the others; rows keep their order. A failing call
    becomes the row's ``error``. Calls are not repeatable: store the result with ``append_runs`` and
    resume with ``pending``.
    """
    schema = T.StructType([*df.schema.fields, *PREDICTION_FIELDS])
    names = [f.name for f in PREDICTION_FIELDS]

    def one(text: str) -> tuple:
        start = time.time()
        out, error = _attempt(lambda: fn(text), retries, delay)
        end = time.time()
        answer, tokens = out if isinstance(out, tuple) else (out, 0)
        return answer or "", tokens or 0, error, start, end, end - start, threading.get_ident()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                made = pd.DataFrame(list(pool.map(one, batch[prompt])), columns=names, index=batch.index)
                yield pd.concat([batch, made], axis=1)

    return df.mapInPandas(run, schema)


def as_stored(df: DataFrame) -> DataFrame:
    """Predictions in stored form: the outer fence of the response is removed."""
    return df.withColumn("pred_sql", strip_fences("response")).drop("response")


EMBEDDING_FIELDS = [
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("embed_tokens", T.LongType()),
    T.StructField("embed_error", T.StringType()),
]


def batch_embed(
    df: DataFrame,
    fn: Callable[[list[str]], tuple[list[list[float]], int] | list[list[float]]],
    text: str = "text",
    retries: int = 3,
    delay: float = 10.0,
    batch_size: int = 64,
) -> DataFrame:
    """Call ``fn(texts)`` for up to ``batch_size`` rows at a time and add one vector per row.

    A call that fails is made again with each half of its texts, down to single ones, so a text
    that can't be embedded costs its own row only. ``embed_tokens`` has the tokens of a call in its
    first row.
    """
    schema = T.StructType([*df.schema.fields, *EMBEDDING_FIELDS])

    def embed(texts: list[str]) -> list[tuple]:
        out, error = _attempt(lambda: fn(texts), retries, delay)
        if error is None:
            vectors, tokens = out if isinstance(out, tuple) else (out, 0)
            if len(vectors) == len(texts):
                return [(v, (tokens or 0) if k == 0 else 0, None) for k, v in enumerate(vectors)]
            error = f"{len(vectors)} vectors for {len(texts)} texts"
        if len(texts) == 1:
            return [(None, 0, error)]
        half = len(texts) // 2
        return embed(texts[:half]) + embed(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch[text])
            rows = [r for at in range(0, len(texts), batch_size) for r in embed(texts[at : at + batch_size])]
            if rows:
                vectors, tokens, errors = (list(c) for c in zip(*rows))
                errors = pd.Series(errors, index=batch.index, dtype=object)
                yield batch.assign(vector=vectors, embed_tokens=tokens, embed_error=errors)

    return df.mapInPandas(run, schema)

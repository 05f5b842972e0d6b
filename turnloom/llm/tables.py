"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.session import checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read back: no lineage, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def any_columns(*read: str) -> Callable:
    """For an operator on `docs` that reads the columns `read` and adds some: the others may have any name.

    Inside they are numbered, so that none meets a name of the operator's own or needs
    quoting; `keep` lists are translated. A column called like one that the operator adds
    is replaced by it.
    """

    def wrap(operator: Callable) -> Callable:
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            inside = {c: c if c in read else f"c{i}" for i, c in enumerate(docs.columns)}
            bound = inspect.signature(operator).bind(docs.toDF(*inside.values()), *args, **kwargs)
            if "keep" in bound.arguments:
                bound.arguments["keep"] = [inside[c] for c in bound.arguments["keep"]]
            out = operator(*bound.args, **bound.kwargs)
            before = {v: c for c, v in inside.items()}
            added = {c for c in out.columns if c not in before}
            return out.select(*[F.col(c).alias(before.get(c, c)) for c in out.columns if before.get(c) not in added])

        return run

    return wrap

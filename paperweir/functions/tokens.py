"""Token counts by a local vocabulary, where one is given, else by estimate; and wording of counts and spans of time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.functions.text import tokens_estimate


def count_tokens(rows: DataFrame, tokenizer: str | None = None, text: str = "text", fidelity: str = "exact") -> DataFrame:
    """rows with tokens and token_fidelity. tokenizer is the path of a tokenizers file, on every executor; special tokens do not
    count. `approximate` is for another provider's vocabulary. Without a path a quarter of the characters is `estimated`."""
    if tokenizer is None:
        return rows.withColumns({"tokens": tokens_estimate(F.coalesce(F.col(text), F.lit(""))), "token_fidelity": F.lit("estimated")})
    schema = T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType())])
    at = rows.columns.index(text)

    def run(batches):
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(tokenizer)
        for batch in batches:
            found = encode.encode_batch([t or "" for t in batch.column(at).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x.ids) for x in found], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("token_fidelity", F.lit(fidelity))


def plural(n: int, one: str, many: str | None = None) -> str:
    return one if n == 1 else many or one + "s"


def count(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {plural(n, one, many)}"


def duration(seconds: float | None) -> str:
    """A span in the unit that reads best, from milliseconds to days."""
    if seconds is None:
        return "—"
    for below, each, form in ((1, 0.001, "{:.0f}ms"), (90, 1, "{:.1f}s"), (5400, 60, "{:.0f}m"), (172_800, 3600, "{:.1f}h")):
        if seconds < below:
            return form.format(seconds / each)
    return f"{seconds / 86_400:.1f} days"

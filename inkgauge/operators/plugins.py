"""Where users plug in their own functions: samplers of counterfactuals, metrics of groups and embeddings of texts.

All run Arrow-batched on the executors; state that is dear to load, such as a model, belongs into the first call of an
iterator, which serves all batches of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkgauge.functions.types import row

SAMPLES = row(pair_id="long", slot="int", cf_prompt="string", cf_output="string")
#: A sampler maps batches of pair_id, prompt and output to batches with the columns of SAMPLES.
Sampler = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def with_sampler(pairs: DataFrame, sampler: Sampler) -> DataFrame:
    """(pair_id, slot, cf_prompt, cf_output) that sampler draws for pairs (pair_id, prompt, output); other columns are ignored."""
    return pairs.select("pair_id", "prompt", "output").mapInPandas(sampler, SAMPLES)


def template_sampler(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two prompts for each output without a model: a template around its first 50 words, and one around its longest words."""
    for batch in batches:
        found = []
        for pair, output in zip(batch["pair_id"], batch["output"]):
            words = (output or "").split()
            longest = sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))[:5]
            found += [(pair, 0, "Write about: " + " ".join(words[:50]), output), (pair, 1, "Topic words: " + ", ".join(longest), output)]
        yield pd.DataFrame(found, columns=SAMPLES.names)


def with_embedding(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], to: str = "embedding") -> DataFrame:
    """rows with the vectors of embed, which maps a list of texts to as many vectors; null texts have none."""
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch[text].notna()
            vectors = iter(embed(batch.loc[known, text].tolist()))
            yield batch.assign(**{to: [list(map(float, next(vectors))) if k else None for k in known]})

    return rows.mapInPandas(run, schema)


def with_metric(rows: DataFrame, keys: list[str], metric: Callable[[pd.DataFrame], float], to: str = "value") -> DataFrame:
    """keys and the value of metric for the rows of each group; a group must fit one task, as an item of few levels does."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(to, T.DoubleType())])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, metric(group))], columns=[*keys, to])

    return rows.groupBy(*keys).applyInPandas(run, schema)

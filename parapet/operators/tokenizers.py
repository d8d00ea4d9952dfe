"""Callers' tokenizers as Columns: set up once in a worker, fed with Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[Sequence[str]], Sequence[Sequence[int]]]


def tokenizer(make: Callable[[], Encode]) -> Callable[[Column], Column]:
    """A function of a text Column that returns its token ids, for ``shape_sequences``.

    ``make`` builds the tokenizer and is called once for each task; what it returns takes a list of
    texts and gives a list of ids for each. A null text has null ids and is not passed on. Ids that come
    as numpy arrays stay arrays, so no id becomes a Python object.
    """

    def plain(found: Sequence[int]) -> Sequence[int]:
        whole = isinstance(found, np.ndarray) and found.ndim == 1 and found.dtype.kind in "iu"
        return found if whole else list(map(int, found))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            known = texts[texts.notna()]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if len(known):
                out.loc[known.index] = pd.Series(
                    [plain(x) for x in encode(known.tolist())], index=known.index, dtype=object
                )
            yield out

    return ids


def byte_tokenizer(first_id: int = 2) -> Callable[[Column], Column]:
    """Every byte of the UTF-8 text is a token: its value plus ``first_id``."""

    def make() -> Encode:
        return lambda texts: [np.frombuffer(t.encode(), np.uint8) + np.int32(first_id) for t in texts]

    return tokenizer(make)


def file_tokenizer(path: str) -> Callable[[Column], Column]:
    """A tokenizer from a JSON file of the ``tokenizers`` library, which every worker must see."""

    def make() -> Encode:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in loaded.encode_batch(list(texts), add_special_tokens=False)]

    return tokenizer(make)

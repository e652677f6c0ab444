"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text
from .tokens import DEFAULT_TOKENIZER, encoder


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n tokens: full pieces of `longest`, then the binary digits of the rest, largest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_power_of_two(docs: DataFrame, tokenizer: str | None = None, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by `end_id`, into pieces of power-of-two lengths.

    Every piece is a sequence of its own and pieces of one length form a bucket (`bucket` is
    log2 of it), so no sequence crosses documents and none has padding: a batch takes
    sequences of one bucket. `longest` must be a power of two.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket), with
    `with_ids` also the ids themselves. A null or empty text is the one id `end_id`. Repeated
    rows are packed each for itself; sequence ids stay unique, since they number the rows of
    the scan, not the document ids. No shuffle; an empty table gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    path = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)
    close = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids = enc.encode(text) + close
                n, start = len(ids) // 4, 0
                for length in binary_pieces(n, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), n, part if with_ids else None))
                    start += length
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
            yield out if with_ids else out.drop(columns="ids")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, kind = as_text(rows, "doc_id")
    schema = "doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else "")
    pieces = rows.mapInPandas(run, schema)
    return pieces.withColumns({"doc_id": F.col("doc_id").cast(kind), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"), "bucket": F.log2("length").cast("int")})

"""Token counts of whole texts, lengths only, in Arrow functions.

The tokenizer never joins text across white space, so a space, tab or line end is a safe boundary: a text of any length
is split there, each distinct part is encoded once, and counts are added. Parts go to the library in batches of equal
bytes rather than rows; their counts are kept in a bounded table per worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, pieces

LIMIT = 2048
#: Bytes of text handled at once, bytes in a batch for the library, and parts whose counts a worker keeps.
PIECE_BYTES, BATCH_BYTES, KEPT_PARTS = 4 << 20, 256 << 10, 600_000
#: Longer parts are counted each time they occur in a piece, not kept: a worker's table holds KEPT_PARTS * KEPT_BYTES at the utmost.
KEPT_BYTES = 64

_loaded: dict[str, tuple] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = (tok, {})
    return _loaded[path]


def _encode(tok, parts: list[bytes], counts: dict[bytes, int]) -> None:
    """Adds the counts of `parts`, encoded in batches of about BATCH_BYTES; one longer part makes its own batch."""
    parts.sort(key=len)
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= BATCH_BYTES):
            size += len(parts[to])
            to += 1
        encoded = tok.encode_batch_fast([p.decode() for p in parts[at:to]], add_special_tokens=False)
        counts.update(zip(parts[at:to], map(len, encoded), strict=True))
        at = to


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, counts = _tokenizer(path)
        for batch in pieces(batches, "text", PIECE_BYTES):
            data, off = flat(batch.column("text"))
            raw, at = data.tobytes(), off.tolist()
            texts = [raw[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
            distinct = set().union(*texts)
            if len(counts) > KEPT_PARTS:
                kept = {p: counts[p] for p in distinct if p in counts}
                counts.clear()
                counts.update(kept)
            new = [p for p in distinct if p not in counts]
            _encode(tok, new, counts)
            n = [sum(map(counts.__getitem__, t)) for t in texts]
            for p in new:
                if len(p) > KEPT_BYTES:
                    del counts[p]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off)), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens for each row. Null texts count as empty, with no tokens; repeated rows stay repeated.

    Keys are integers. `path` is the file of a tokenizer that splits at white space before it encodes, as word_bpe_49k.json does.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_counter(path), "id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all whole documents, and which have more than LIMIT."""
    counted = count_tokens(documents(spark, sf_dir))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

"""SentencePiece encoding and decoding through a table of distinct chunks.

A space becomes a marker, and one more marker stands before the text. Where no piece of the model holds a marker after
another sign, no merge can cross from one marked word to the next. So a normalised text is cut before each run of
markers, each distinct chunk is segmented once by the library, and the ids of a text are its chunks' ids in order of
position. Texts of any length are whole: what is held beside a text is its own ids and a bounded table per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces

MARK = "▁"
#: Bytes of text handled at once, chunks whose ids a worker keeps, and the longest chunk that is kept, in signs.
PIECE_BYTES, KEPT_CHUNKS, KEPT_LENGTH = 4 << 20, 400_000, 64
#: Chunks in a call of the library, and signs of a long text that are cut into chunks at once.
BATCH, SLICE = 20_000, 1 << 20
#: A run of markers and what follows it.
_CHUNK, _CUT = re.compile(f"{MARK}+[^{MARK}]*"), re.compile(f"(?<=[^{MARK}]){MARK}")

_loaded: dict[str, tuple] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _model(path: str):
    """The library's processor and the worker's table of chunks. Models whose pieces can cross markers are refused."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        names = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError(f"pieces of {path} cross whitespace markers; its texts cannot be cut into chunks")
        probe = "  aéﬁ é Ａ\t "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK) or sp.piece_to_id(MARK) == sp.unk_id():
            raise ValueError(f"{path} normalises texts or has no marker piece; chunks are cut for models that do neither")
        _loaded[path] = (sp, {})
    return _loaded[path]


def _code(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _slices(text: str, most: int) -> Iterator[str]:
    """The marked form of a text in slices of some more than `most` signs, each of which starts with a run of markers."""
    marked, at = MARK + text.replace(" ", MARK) if text else "", 0
    while at < len(marked):
        cut = _CUT.search(marked, at + most)
        to = cut.start() if cut else len(marked)
        yield marked[at:to]
        at = to


def _segment(sp, chunks: list[str], table: dict[str, bytes]) -> None:
    """Adds the ids of chunks. The library puts the first marker itself, but not before an empty text."""
    for at in range(0, len(chunks), BATCH):
        some = chunks[at : at + BATCH]
        found = sp.encode([c[1:] for c in some], num_threads=1)
        table.update(zip(some, map(_code, found), strict=True))
    if MARK in table:
        table[MARK] = _code([sp.piece_to_id(MARK)])


def _ids(sp, table: dict[str, bytes], slices: list[str]) -> list[bytes]:
    """The ids of each slice, from the table, to which new chunks are added first; long ones do not stay in it."""
    rows = [_CHUNK.findall(x) for x in slices]
    distinct = set().union(*rows)
    if len(table) > KEPT_CHUNKS:
        kept = {c: table[c] for c in distinct if c in table}
        table.clear()
        table.update(kept)
    new = [c for c in distinct if c not in table]
    _segment(sp, new, table)
    out = [b"".join(map(table.__getitem__, row)) for row in rows]
    for c in new:
        if len(c) > KEPT_LENGTH:
            del table[c]
    return out


def _text(sp, codes: list[bytes]) -> str:
    """What the ids of a text's slices give; of each slice but the first the library leaves out a space in front."""
    return " ".join(sp.decode(np.frombuffer(c, "<u4").tolist()) for c in codes)


def _codec(path: str, ends: bool, ids: bool, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, table = _model(path)
        first, last = (_code([sp.bos_id()]), _code([sp.eos_id()])) if ends else (b"", b"")
        for batch in pieces(batches, "text", PIECE_BYTES):
            texts = batch.column("text").to_pylist()
            if len(texts) == 1:  # it may be long: one slice at a time
                codes = [[_ids(sp, table, [x])[0] for x in _slices(texts[0] or "", SLICE)]]
            else:
                codes = [[c] for c in _ids(sp, table, ["".join(_slices(t or "", PIECE_BYTES)) for t in texts])]
            whole = [b"".join([first, *c, last]) for c in codes]
            out = [batch.column("id"), pa.array([len(c) // 4 for c in whole], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in whole])]
            if ids:
                flat = np.frombuffer(b"".join(whole), "<i4")
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) // 4 for c in whole)]), pa.int32()), pa.array(flat)))
            if text:
                out.append(pa.array([_text(sp, c) for c in codes], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "n_tokens", "ids_sha256", *["ids"] * ids, *["decoded"] * text])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ends: bool = True, ids: bool = True, decoded: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 for each row and, if asked for, ids (array<int>) and decoded, the text that these ids give.

    The ids are the library's for the whole text, between begin and end ids if `ends`. Null texts count as empty, which
    have no other ids; repeated rows stay repeated; other columns are not read. Keys are integers. Very long texts are
    encoded whole. A literal marker sign counts as a space, as in the library.
    """
    path = path or model_path()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return rows.mapInArrow(_codec(path, ends, ids, decoded), schema)


def decode(encoded: DataFrame, key: str = "id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """id and the text of each row's ids, by the library. A null list gives an empty text; ids beyond the model are an error."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(path)
        for batch in batches:
            texts = [sp.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{ids}`").cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole documents, with begin and end, and the text that they give back, as digests."""
    coded = encode(documents(spark, sf_dir), ids=False, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

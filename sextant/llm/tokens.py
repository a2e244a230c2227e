"""Encoding of a corpus with a public byte-level BPE tokenizer.

Texts are divided into overlapping chunks that are pre-tokenised independently; two neighbouring chunks are stitched at the
first place in their overlap at which every scan has a boundary, whatever came before. The pieces between the stitches
are encoded and their ids concatenated. The chunks of a very long text are spread over tasks, those of all others are handled
where the row lies. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("SEXTANT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text before the merges of the vocabulary byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 4096, 256
#: Texts with more chunks than this are spread over tasks.
SPREAD_CHUNKS = 64
#: A vocabulary file above this size is refused, as its bytes go to every executor.
MAX_VOCABULARY_BYTES = 64 << 20

_cache: dict = {}


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to id, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _encoder(name: str, data: bytes):
    if name not in _cache:
        import tiktoken

        _cache[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=load_ranks(data), special_tokens={})
    return _cache[name]


#: A blank or line end after a character that isn't white space: every scan has a boundary before it.
_STITCH = re.compile(r"\S(?=[ \n])")


def _stitch(text: str, i: int) -> int:
    """The first stitch at i or after it, but not at the text's beginning; the text's length where there is none."""
    m = _STITCH.search(text, max(i - 1, 0))
    return m.end() if m else len(text)


def windows(text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Overlapping chunks of a text: (number, window, core, last).

    A window has one character before its chunk (but for the first), the chunk, and an overlap that reaches past the first stitch at the chunk's end or
    after it. ``core`` is the place in the window where the chunk ends. Each stitch is looked for once and carried forward; chunks without one,
    as in a long text without blanks, give no window, since the chunk before them covers them. So the windows together are at
    most about twice as long as the text, whatever it holds.
    """
    n, c, s, start = len(text), 0, 0, 0
    while True:
        e, lead = min(s + chunk, n), int(c > 0)
        end = n if e >= n else start if start >= e else _stitch(text, e)
        if end > start or c == 0:
            yield c, text[s - lead : min(max(end, min(e + overlap, n)) + 1, n)], e - s + lead, end >= n
        if end >= n:
            return
        c, s, start = c + 1, e, end


def piece(window: str, number: int, core: int, last: bool) -> str:
    """The part of a window that belongs to its chunk: from the first stitch in the chunk or after it to the first stitch at its end or after it.

    The window is pre-tokenised. Both neighbours of a stitch find it by their own scans, so pieces neither overlap nor leave a gap.
    """
    import regex

    if number == 0 and last:
        return window
    scan = _cache.get("scan") or _cache.setdefault("scan", regex.compile(PATTERN))
    stitches = [i for m in scan.finditer(window) if (i := m.start()) and window[i] in " \n" and not window[i - 1].isspace()]
    start = next(iter(stitches), len(window)) if number else 0
    end = len(window) if last else next((i for i in stitches if i >= core), len(window))
    return window[start:end]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP, spread_chunks: int = SPREAD_CHUNKS) -> DataFrame:
    """Ids of every row's text: the id column and ``ids`` (array of int), one row per row of ``docs``.

    Null and empty texts have an empty list. Strings that look like special tokens are plain text. Rows with a null id are kept.
    Extra columns are ignored. Texts of up to ``chunk`` * ``spread_chunks`` characters stay where they are, in Arrow batches; only longer ones are
    shuffled, by chunk and then by row (told apart by id and a hash of the text). The vocabulary's file is read on the driver and sent to the executors, its size is checked.
    """
    path = os.path.join(tokenizer_dir, f"{vocabulary}.tiktoken")
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ints = pa.list_(pa.int32())

    def here(batches):
        enc = _encoder(vocabulary, ranks.value)
        for b in batches:
            out = [[i for c, w, core, last in windows(t, chunk, overlap) for i in enc.encode_ordinary(piece(w, c, core, last))] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, ints)], names=["k", "ids"])

    def split(batches):
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in windows(t, chunk, overlap):
                    whole = [b.column(0).slice(i, 1), b.column(2).slice(i, 1)]
                    yield pa.RecordBatch.from_arrays(whole + [pa.array([x], y) for x, y in zip(w, (pa.int32(), pa.string(), pa.int32(), pa.bool_()))], names=["k", "h", "c", "w", "core", "last"])

    def encode(batches):
        enc = _encoder(vocabulary, ranks.value)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (3, 2, 4, 5)]
            out = [enc.encode_ordinary(piece(w, c, core, last)) for w, c, core, last in zip(*cols)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(out, ints)], names=["k", "h", "c", "ids"])

    long = F.length("t") > chunk * spread_chunks
    a = d.where(~long).mapInArrow(here, f"k {kind}, ids array<int>")
    x = d.where(long).select("k", "t", F.xxhash64("t").alias("h"))
    x = x.mapInArrow(split, f"k {kind}, h long, c int, w string, core int, last boolean").repartition("k", "h", "c")
    x = x.mapInArrow(encode, f"k {kind}, h long, c int, ids array<int>")
    # a repeated row gives each of its chunks again; chunk 0 tells how often
    x = x.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.struct("c", "ids"))).alias("p"), F.count(F.when(F.col("c") == 0, 1)).alias("n"))
    b = x.select("k", F.flatten(F.transform("p", lambda q: q["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("k", "ids")
    return a.unionByName(b).select(F.col("k").alias(id_col), "ids")


def decode(ids: list[int], data: bytes) -> str:
    """The text of ids: their bytes concatenated, then read as UTF-8."""
    back = {i: b for b, i in load_ranks(data).items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")

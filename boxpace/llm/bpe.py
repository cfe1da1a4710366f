"""Byte-level BPE encoding and decoding with the tiktoken library (operator 1).

The rank file is read once by the driver and shipped to the tasks as a
broadcast (its size is checked), so executors need no copy of it. Each task
builds one ``tiktoken.Encoding``.

tiktoken's pattern engine runs out of stack on very long white-space runs and
holds one text's matches at a time, so long texts are first cut at *safe
boundaries*: places where no match of the pattern can reach across, whatever
stands on either side.

* Before a white-space character that follows anything else: no alternative of
  the pattern contains white space after its first character, unless it
  consists of white space alone.
* Before the last character of a white-space run that is followed by more
  text: there ``\\s+(?!\\S)`` takes all but that character.

The pieces' ids in order are the ids of the whole text. Decoding joins the raw
bytes of the ids and assumes no valid UTF-8 within an id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, texts

MAX_RANK_FILE_BYTES = 64 << 20
CHUNK_CHARS = 1 << 16
LONG_BLANKS = 4096


def load_ranks(spark: SparkSession, path: str):
    """Broadcast of the rank file's bytes; files over MAX_RANK_FILE_BYTES are refused."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE_BYTES + 1)
    if len(data) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encoding(data: bytes, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import base64

    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, chunk: int = CHUNK_CHARS, long_blanks: int = LONG_BLANKS):
    """Yield (piece, is_blank_run): cuts of ``text`` at safe boundaries, in order.

    Blank runs of ``long_blanks`` or more come alone, without the last character if
    more text follows; each is one match of the pattern. Other pieces are
    about ``chunk`` characters, longer only where no safe boundary exists.
    """
    import regex
    if len(text) <= min(chunk, long_blanks):
        yield text, False
        return
    runs = regex.compile(r"\p{White_Space}{%d,}" % long_blanks)
    edge = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
    start = 0
    cuts = [(m.start(), m.end() if m.end() == len(text) else m.end() - 1) for m in runs.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        while a - start > chunk:
            m = edge.search(text, start + chunk, a)
            cut = m.start() if m else a
            yield text[start:cut], False
            start = cut
        if a > start:
            yield text[start:a], False
        if b > a:
            yield text[a:b], True
        start = b


def encode_text(enc, text: str, chunk: int = CHUNK_CHARS, long_blanks: int = LONG_BLANKS):
    """Ids of a whole text as a little-endian uint32 array."""
    import numpy as np
    out = []
    for piece, blank in safe_pieces(text, chunk, long_blanks):
        ids = enc._encode_single_piece(piece) if blank else enc.encode_to_numpy(piece, disallowed_special=())
        out.append(np.asarray(ids, dtype="<u4"))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids[, decoded]) for every row of ``docs``.

    ``token_ids`` holds the ids as little-endian unsigned 32-bit integers;
    :func:`ids_array` unpacks them. ``decoded`` is the byte string the ids give
    when decoded again. A NULL or empty text has no ids, a NULL doc_id stays
    NULL, and repeated rows are encoded each; an empty table gives no rows.
    Strings that look like special tokens are ordinary text. Bytes that are no
    valid UTF-8 count as U+FFFD.
    """
    ranks = load_ranks(docs.sparkSession, rank_path)

    def run(batches):
        import pyarrow as pa
        enc = encoding(ranks.value, pattern)
        for b in batches:
            n, ids, dec = [], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                a = encode_text(enc, raw.decode("utf-8", errors="replace"))
                n.append(len(a))
                ids.append(a.tobytes())
                if with_decoded:
                    dec.append(enc.decode_bytes(a.tolist()))
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "token_ids": pa.array(ids, pa.binary())}
            if with_decoded:
                cols["decoded"] = pa.array(dec, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)
    schema = "doc_id long, n_tokens long, token_ids binary" + ", decoded binary" * with_decoded
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, decoded binary): the bytes of packed ids as :func:`encode` makes them.

    NULL ids give the empty byte string. An id without a rank raises KeyError.
    """
    bound_batches(tokens.sparkSession)
    ranks = load_ranks(tokens.sparkSession, rank_path)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        enc = encoding(ranks.value, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "decoded": pa.array(out, pa.binary())})
    src = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("token_ids"))
    return src.mapInArrow(run, "doc_id long, decoded binary")


def ids_array(tokens: DataFrame, ids_col: str = "token_ids", out: str = "ids") -> DataFrame:
    """Add ``out``: the packed ids as array<long>."""
    hexed = F.hex(ids_col)

    def value(i):
        at = i * 8 + 1
        return F.conv(F.concat(*[F.substring(hexed, at + k, F.lit(2)) for k in (6, 4, 2, 0)]), 16, 10).cast("long")
    n = (F.octet_length(ids_col) / 4).cast("int")
    return tokens.withColumn(out, F.when(n == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), value)))

"""Cost-balanced packing of documents into token sequences (operator 12).

Each task encodes its documents and packs them in groups of about ``group_tokens`` tokens, so a group is
bounded, nothing is shuffled and no document meets more than one group. In a group, documents longer than a
sequence are cut into full sequences and a rest. Pieces are then taken in descending length, each
to the sequence of lowest cost that has room for all of it; cost is a linear term per token plus a
quadratic one for attention inside the piece. A piece without such a sequence is cut: what fits goes
to the sequence of lowest cost that has any room, the rest goes back among the pieces.

Room is what the group needs and no more: full sequences, and for the tokens left over sequences of
powers of two, which need no padding. So every sequence is filled to its last token.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import encode_text, safe_pieces
from .common import texts

GROUP_TOKENS = 1 << 20
MAX_TOKENIZER_BYTES = 64 << 20
# Letters, digits, marks and ideographs whose classes have not changed between versions of Unicode.
SETTLED = r"[\t-\r -~¡-ɏА-я‐-‧‰-›ぁ-んァ-ヶ一-龥가-힣]*"


def byte_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE file whose merges stand in the order of their tokens' ids.

    The file writes a byte as the printable character of that number, or as the next one from U+0100 on.
    """
    import json
    model = json.loads(data)["model"]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    vocab = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(ranks) != len(merged) + 256:
        raise ValueError("the merges are not in the order of the ids")
    return ranks


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file, special strings as ordinary text.

    Texts of settled characters go through tiktoken with the same file's tokens, which gives the same ids in a
    fraction of the time; the two libraries know different versions of Unicode, so other texts go through
    tokenizers itself. Long texts are cut at safe boundaries.
    """

    def __init__(self, data: bytes, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        self.exact = Tokenizer.from_buffer(data)
        self.exact.encode_special_tokens = True
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks(data), special_tokens={})
        self.settled = regex.compile(SETTLED)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        import numpy as np
        if self.settled.fullmatch(text):
            return encode_text(self.fast, text).tobytes()
        ids = [i for piece, _ in safe_pieces(text) for i in self.exact.encode(piece, add_special_tokens=False).ids]
        return np.array(ids, dtype="<u4").tobytes()


def room_for(tokens: int, max_tokens: int) -> list[int]:
    """Sizes of the sequences that hold ``tokens`` tokens exactly: full ones, then descending powers of two."""
    left = tokens % max_tokens
    powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    return [max_tokens] * (tokens // max_tokens) + powers


def assign(lengths, max_tokens: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; ``lengths`` are the documents' tokens, none 0.

    Documents are taken in descending length, equal ones in the given order.
    """
    import heapq

    import numpy as np
    sizes = np.array(room_for(int(sum(lengths)), max_tokens), dtype=np.int64)
    room, cost, out = sizes.copy(), np.zeros(len(sizes)), []
    queue = []
    full = 0

    def place(doc, start, n, seq):
        out.append((doc, start, n, int(seq), int(sizes[seq] - room[seq])))
        room[seq] -= n
        cost[seq] = cost[seq] + linear * n + quadratic * n * n if room[seq] else np.inf  # full: out of the search
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= max_tokens:
            place(doc, at, max_tokens, full)
            at, full = at + max_tokens, full + 1
        if n > at:
            queue.append((at - int(n), doc, at))
    heapq.heapify(queue)
    while queue:
        n, doc, at = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        seq = fits.argmin()
        if fits[seq] == np.inf:
            seq = cost.argmin()
            heapq.heappush(queue, (int(room[seq]) - n, doc, at + int(room[seq])))
            n = int(room[seq])
        place(doc, at, n, seq)
    return out


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, max_tokens: int = 2048,
         group_tokens: int = GROUP_TOKENS, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    A document's tokens are the ids of its text and ``end_id``; NULL and empty texts have ``end_id`` alone.
    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers, ``start`` is its place in the
    document, ``offset`` its place in the sequence. Sequences have at most ``max_tokens`` (a power of
    two) tokens; all are full, or shorter and of a power of two. Very long texts are cut over many sequences and groups of
    ``group_tokens`` tokens keep what one task holds bounded. Equal lengths keep the rows' order, repeated rows
    are packed each, a NULL doc_id stays NULL, an empty table gives no rows, other columns are not read.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens is not a power of two")
    with open(tokenizer_path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {MAX_TOKENIZER_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encoder = Encoder(sent.value, pattern)
        # Each task numbers its own sequences.
        ids, blobs, held, number = [], [], 0, TaskContext.get().partitionId() << 40

        def packed():
            nonlocal number
            lengths = [len(x) // 4 for x in blobs]
            rows = assign(lengths, max_tokens, linear, quadratic)
            for a in range(0, len(rows), 4096):
                doc, start, n, seq, offset = zip(*rows[a:a + 4096])
                long = pa.int64()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[d] for d in doc], long), "start": pa.array(start, long),
                    "length": pa.array(n, long), "doc_tokens": pa.array([lengths[d] for d in doc], long),
                    "sequence_id": pa.array([number + s for s in seq], long), "offset": pa.array(offset, long),
                    "ids": pa.array([blobs[d][4 * s:4 * (s + m)] for d, s, m in zip(doc, start, n)], pa.binary())})
            number += len(room_for(sum(lengths), max_tokens))
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids.append(i)
                blobs.append(encoder.encode(raw.decode("utf-8", errors="replace")) + end)
                held += len(blobs[-1]) // 4
                if held >= group_tokens:
                    yield from packed()
                    ids, blobs, held = [], [], 0
        if blobs:
            yield from packed()
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return texts(docs, id_col, text_col).mapInArrow(run, schema)

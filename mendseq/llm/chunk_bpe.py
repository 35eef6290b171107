"""BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the bytes cuts texts into chunks, so equal passages give equal
chunks wherever they stand. Chunks that occur more than once are encoded once. A join
between two chunks may lie inside a word: the text from the last safe cut before it to
the first one after it is encoded again, over as many chunks as it takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendseq.llm.common import arrow_map, row_numbers, rows_of
from mendseq.llm.tokens import unit_ids, word_ids
from mendseq.session import materialize

# A cut on average every 2**CUT_BITS bytes, and no chunk but the last below LEAST.
CUT_BITS, LEAST, SEED = 10, 128, 11
# Bits of the filter that tells which chunks may be shared: 16 a chunk, between these bounds.
FILTER_BITS = 1 << 12, 1 << 26

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 ``data``; each depends only on the 16 bytes before it."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, older ones shifted
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint32(step))
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at < len(data) and data[at] & 0xC0 == 0x80:  # not inside a character
            at += 1
        if at - last >= LEAST and at < len(data):
            ends.append(at)
            last = at
    return [*ends, len(data)]


def chunks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogatepass")


def encode_chunk(chunk: bytes, units) -> tuple[str, bytes | None, str]:
    """(head, ids, tail): ids of the words that certainly end inside the chunk.

    ``head`` and ``tail`` reach to the first and from the last blank; without a blank
    all is head and there are no ids.
    """
    text = _text(chunk)
    places = [p for p in (text.find(" "), text.find("\n")) if p >= 0]
    if not places:
        return text, None, ""
    first, last = min(places), max(text.rfind(" "), text.rfind("\n"))
    return text[:first], word_ids(text[first:last + 1], units), text[last + 1:]


def join_chunks(parts: Iterator[tuple[str, bytes | None, str]], units) -> bytes:
    """The ids of a text from those of its chunks, joins encoded anew."""
    out, pending = [], ""
    for head, ids, tail in parts:
        pending += head
        if ids is not None:
            out += [word_ids(pending, units), ids]
            pending = tail
    out.append(word_ids(pending, units))
    return b"".join(out)


class Finisher:
    """Digests of a text's ids and of what they decode to."""

    def __init__(self, vocabulary: str):
        self.units = unit_ids(vocabulary, "H")
        size = self.units.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words = [(self.units.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def decoded(self, ids: bytes) -> bytes:
        """The tokens with a blank between them: this vocabulary has no decoder of its own."""
        return b" ".join(map(self.words.__getitem__, np.frombuffer(ids, "<u2").tolist()))

    def result(self, ids: bytes) -> tuple[int, str, str]:
        wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        return len(ids) // 2, hashlib.sha256(wide).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(chunk): digests of the chunks that occur more than once."""
    def start():
        def work(batch):
            found: dict[bytes, int] = {}
            for text in batch.column("text").to_pylist():
                for chunk in chunks(text or ""):
                    key = digest(chunk)
                    found[key] = found.get(key, 0) + 1
            return {"chunk": list(found), "n": list(found.values())}

        return work

    return arrow_map(docs.select("text"), start, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")) \
        .where(F.col("n") > 1).select("chunk")


class Filter:
    """Whether a chunk may be shared: bits of a fixed number of digests, some by chance."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 64 - 1

    def __contains__(self, key: bytes) -> bool:
        at = int.from_bytes(key[:8], "little") & self.mask
        return bool(int(self.bits[at >> 6]) >> (at & 63) & 1)


def may_be_shared(shared: DataFrame) -> Filter:
    """The filter of ``shared``; at most 8 MiB whatever the number of chunks.

    Some chunks of a single text pass by chance, more of them beyond that size. They
    take the way of the shared ones, which is longer but gives the same ids.
    """
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (16 * shared.count()).bit_length()))

    def start():
        def work(batch):
            keys = np.frombuffer(b"".join(k[:8] for k in batch.column("chunk").to_pylist()), "<u8") & np.uint64(size - 1)
            return {"word": pa.array((keys >> np.uint64(6)).astype(np.int64)),
                    "bits": pa.array((np.uint64(1) << (keys & np.uint64(63))).view(np.int64))}

        return work

    words = arrow_map(shared, start, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


def encode_shared(docs: DataFrame, near: Filter, vocabulary: str) -> DataFrame:
    """(chunk, head, ids, tail) of every chunk in the filter, each encoded once."""
    def start():
        def work(batch):
            found = {}
            for text in batch.column("text").to_pylist():
                for chunk in chunks(text or ""):
                    key = digest(chunk)
                    if key in near:
                        found[key] = chunk
            return {"chunk": list(found), "data": list(found.values())}

        return work

    once = arrow_map(docs.select("text"), start, "chunk binary, data binary").dropDuplicates(["chunk"])

    def encoder():
        units = unit_ids(vocabulary, "H")

        def work(batch):
            keys, data = rows_of(batch, "chunk", "data")
            done = [encode_chunk(d, units) for d in data]
            return {"chunk": keys, "head": [d[0].encode("utf-8", "surrogatepass") for d in done],
                    "ids": [d[1] for d in done], "tail": [d[2].encode("utf-8", "surrogatepass") for d in done]}

        return work

    return arrow_map(once, encoder, "chunk binary, head binary, ids binary, tail binary")


_PART = "struct<place: int, chunk: binary, head: binary, ids: binary, tail: binary>"
_FIRST = f"row long, doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, parts array<{_PART}>"


def _first_pass(docs: DataFrame, near: Filter, vocabulary: str) -> DataFrame:
    """Texts without a shared chunk are done; of the others, the chunks of their own are encoded."""
    def start():
        finish, number = Finisher(vocabulary), row_numbers()

        def work(batch):
            ids, texts = rows_of(batch, "doc_id", "text")
            done, waiting = [], []
            for text in texts:
                parts, open_ = [], False
                for place, chunk in enumerate(chunks(text or "")):
                    key = digest(chunk)
                    if key in near:
                        open_ = True
                        parts.append({"place": place, "chunk": key})
                    else:
                        head, own, tail = encode_chunk(chunk, finish.units)
                        parts.append({"place": place, "head": head.encode("utf-8", "surrogatepass"), "ids": own,
                                      "tail": tail.encode("utf-8", "surrogatepass")})
                if open_:
                    done.append((None, None, None))
                    waiting.append(parts)
                else:
                    done.append(finish.result(join_chunks(_read(parts), finish.units)))
                    waiting.append(None)
            return {"row": number(len(ids)), "doc_id": ids, "n_tokens": [d[0] for d in done],
                    "ids_sha256": [d[1] for d in done], "decoded_sha256": [d[2] for d in done], "parts": waiting}

        return work

    return arrow_map(_texts(docs), start, _FIRST)


def _read(parts: list[dict]) -> Iterator[tuple[str, bytes | None, str]]:
    for part in parts:
        yield _text(part["head"]), part.get("ids"), _text(part["tail"])


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text).

    A null text is an empty one: no ids, digests of nothing. Repeated rows each get a
    row, other columns are left out, an empty table gives no rows.
    """
    shared = materialize(shared_chunks(docs), "shared-chunks")
    near = may_be_shared(shared)
    encoded = materialize(encode_shared(docs, near, vocabulary), "encoded-chunks")
    first = materialize(_first_pass(docs, near, vocabulary), "encoded-texts")
    waiting = first.where(F.col("parts").isNotNull())
    asked = waiting.select("row", F.explode("parts").alias("p")).where(F.col("p.chunk").isNotNull()) \
        .select("row", "p.place", "p.chunk")
    answers = asked.join(encoded, "chunk").groupBy("row").agg(
        F.collect_list(F.struct("place", "chunk", "head", "ids", "tail")).alias("answers"))
    joined = waiting.join(answers, "row").select("doc_id", F.concat(
        F.filter("parts", lambda p: p["chunk"].isNull()), F.col("answers")).alias("parts"))

    def start():
        finish = Finisher(vocabulary)

        def work(batch):
            ids, parts = rows_of(batch, "doc_id", "parts")
            done = [finish.result(join_chunks(_read(sorted(p, key=lambda x: x["place"])), finish.units)) for p in parts]
            return {"doc_id": ids, "n_tokens": [d[0] for d in done], "ids_sha256": [d[1] for d in done],
                    "decoded_sha256": [d[2] for d in done]}

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    done = first.where(F.col("parts").isNull()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return done.union(arrow_map(joined, start, schema))

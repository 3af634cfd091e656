"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is normalised as the model asks (a space before it, spaces as U+2581) and cut into
segments; in each, the adjacent symbol pairs whose union is a piece wait in an agenda
ordered by score and then by position; the best is merged and its new neighbours join the
agenda. Symbols outside the vocabulary become byte pieces. Decoding joins the pieces, turns
byte pieces back into UTF-8 and drops the first space.

Segments repeat, so their encodings are kept in a bounded cache; in every Arrow batch each
segment that was new is also encoded and decoded by the sentencepiece library, and any
difference raises an error.

Defined cases: a null text is empty; an empty text has no pieces and decodes to an empty
text; equal texts give equal ids; an empty table gives an empty result; extra columns are
ignored. Models that normalise in other ways, are not of the merge type, or have
user-defined pieces are refused.
"""

from __future__ import annotations

import hashlib
import heapq
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pactline.llm._segments import Memo, segments
from pactline.llm._spark import in_batches, table, unused

MARK = "▁"
CACHED = 250_000  # segments of a generation that a worker keeps
FRESH = 20_000  # new segments that are compared with the library together
_NONE = float("inf")


class Codec:
    """A merge-type vocabulary; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        special = {i for i in range(len(self.pieces)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.special = special - set(self.bytes.values())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items() if not sp.is_unused(i)}
        self.value_of_byte = {i: b for b, i in self.bytes.items()}
        self.plain_from = max(special, default=-1) + 1  # ids from here on are ordinary pieces
        self.decimals = [str(i) for i in range(len(self.pieces))]
        probe = " A  Å\n①x "
        if sp.normalize(probe) != (MARK + probe).replace(" ", MARK) or len(self.bytes) != 256:
            raise ValueError("only models with byte pieces, identity normalisation and a space put first are supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("a piece runs over the start of a word or over a line end")
        self.memo = Memo(self._entry, CACHED)
        self.fresh: dict[str, tuple[list[int], str]] = {}

    def _merged(self, text: str) -> list[str]:
        """The symbols of a segment after all merges: the agenda of a short one is a list of ranks."""
        if len(text) > 40:
            return self._merged_long(text)
        symbols, rank = list(text), self.rank.get
        agenda = [rank(pair, _NONE) for pair in map(add, text, text[1:])]
        while agenda and (best := min(agenda)) is not _NONE:
            i = agenda.index(best)  # the leftmost of equals
            piece = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, _NONE)
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], _NONE)
        return symbols

    def _merged_long(self, text: str) -> list[str]:
        """The same with a heap, whose cost does not grow with the square of the length."""
        symbols: list[str | None] = list(text)
        n, rank = len(symbols), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, piece = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = piece, None
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (p := piece + symbols[following]) in rank:
                    heapq.heappush(agenda, (rank[p], left, p))
            if (previous := before[left]) >= 0 and (p := symbols[previous] + piece) in rank:
                heapq.heappush(agenda, (rank[p], previous, p))
        return [s for s in symbols if s is not None]

    def _ids(self, segment: str) -> list[int]:
        if "\n" not in segment:
            try:
                return [self.ids[s] for s in self._merged(segment)]
            except KeyError:
                pass  # it has symbols outside the vocabulary
        out: list[int] = []
        for k, line in enumerate(segment.split("\n")):  # no piece runs over a line end
            if k:
                out.append(self.bytes[10])
            for s in self._merged(line) if line else ():
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    def _entry(self, key: str) -> tuple[str, str]:
        """(ids in decimals, decoded text) of a segment that is met for the first time."""
        ids = self._ids((MARK + key).replace(" ", MARK))
        text = self._text(ids)
        self.fresh[key] = (ids, text)
        return ",".join([self.decimals[i] for i in ids]), text

    def check(self, least: int = 1) -> None:
        """Compares the segments that were new since the last call, if they are so many, with the library."""
        if len(self.fresh) < least:
            return
        keys = [k for k in self.fresh if k]  # the empty key is a lone space, which a text cannot start with
        found = [self.fresh[k][0] for k in keys]
        if keys and found != self.library.encode(keys, num_threads=1):
            raise ValueError("the encoding differs from the library's")
        # segments decode one by one as they do in a row, where only the first one's space is dropped
        rows = [keys[i : i + 64] for i in range(0, len(keys), 64)]
        if rows and ["".join([self.fresh[k][1] for k in row])[1:] for row in rows] != self.library.decode([[i for k in row for i in self.fresh[k][0]] for row in rows], num_threads=1):
            raise ValueError("the decoding differs from the library's")
        self.fresh = {}
        self.memo.turn()

    def _text(self, ids) -> str:
        if ids and min(ids) >= self.plain_from:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.value_of_byte.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.special:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids) -> str:
        text = self._text(ids)
        return text[1:] if text[:1] == " " else text

    def segments(self, text: str) -> list[tuple[str, str]]:
        memo = self.memo
        return [memo[k] for k in segments(text.replace(MARK, " ") if MARK in text else text, None)]

    def encode(self, text: str) -> list[int]:
        return numbers(",".join([s[0] for s in self.segments(text)])).tolist()


def numbers(decimals: str) -> np.ndarray:
    """The ids of a text of decimals."""
    return np.fromstring(decimals, np.int32, sep=",") if decimals else np.zeros(0, np.int32)


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec for a model in each Python worker."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver; a vocabulary's size does not depend on the data
        return f.read()


def _coded(own: Codec, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(ids, decoded texts) of a text column."""
    ids, decoded = [np.zeros(0, np.int32)], []
    for text in texts:
        found = own.segments(text.as_py() or "")
        ids.append(numbers(",".join([s[0] for s in found])))
        decoded.append("".join([s[1] for s in found])[1:])
        own.check(FRESH)
    own.check()
    ends = np.cumsum([len(x) for x in ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(decoded, pa.string())


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for every row of ``docs`` (doc_id, text)."""
    model = _model(path)

    def run(batches):
        own = codec(model)
        for batch in batches:
            ids, decoded = _coded(own, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without keeping the ids."""
    model = _model(path)

    def run(batches):
        own = codec(model)
        for batch in batches:
            counts, ids_of, texts_of = [], [], []
            for text in batch.column("text"):
                own_segments = own.segments(text.as_py() or "")
                ids = ",".join([s[0] for s in own_segments])
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_of.append(hashlib.sha256(ids.encode()).hexdigest())
                texts_of.append(hashlib.sha256("".join([s[1] for s in own_segments])[1:].encode()).hexdigest())
                own.check(FRESH)
            own.check()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_of, pa.string()), pa.array(texts_of, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def with_token_counts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of documents, their text as decoded, and the ids it was encoded to as token_ids.

    Rows are encoded where they stand, so null and repeated doc_ids keep their rows. Where docs
    has a column token_ids of its own, in whatever case, it is kept, and the ids are in _token_ids.
    """
    added = unused(docs, "token_ids")
    model = _model(vocabulary())

    def run(batches):
        own = codec(model)
        for batch in batches:
            ids, decoded = _coded(own, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(decoded if c == "text" else batch.column(c) for c in batch.schema.names), ids], [*batch.schema.names, added])

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(added, ArrayType(IntegerType()))]))

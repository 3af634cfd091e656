"""Token-id output with Re-Pair grammar compression.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its texts, ends
every document with id 0 and writes shards of about ``SHARD_IDS`` ids, numbered within the
task. Each shard has a grammar of its own: frequent adjacent id pairs are replaced by
nonterminals, round after round, until no pair occurs ``LEAST`` times (a rule costs as much
as three replacements save). In a round all pairs that are more frequent than their neighbours
are replaced at once; they never overlap, nor cross the end of a document. A shard stores its
rules, the expansion length of every nonterminal and, for each document, where it begins in the
sequence and how many ids it has, so one document can be decoded without the others.

File format (rows of a Parquet table: part, shard, n_tokens, block): little-endian unsigned
integers; header ``RPR2``, then the counts of documents, rules and symbols and the bits of a
symbol (64 bits each); doc_ids (64 bits, signed) and whether each is there (8); ids of each
document (64); symbols of each document (64); expansion lengths (32); the rules, a left and a
right symbol each, and the symbols, both as their low 16 bits followed by a row of bits for
each higher place.

Defined cases: a null or empty text has the end id alone; equal rows and rows of equal doc_ids
are kept apart; a null doc_id is written as such and comes first; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactline.llm._segments import Memo, segments
from pactline.llm._spark import in_batches, saved, shared_folder, table
from pactline.llm.sentencepiece_codec import vocabulary

SHARD_IDS = 1 << 20
LEAST = 4
BINS = 1 << 20
EXACT = 200_000  # places from which on all pairs are counted exactly
MOST_RULE_IDS = 1 << 22  # ids of all rules that are held written out; longer rules are expanded level by level
END = 0
#: other white space before a space: there the vocabulary's word pattern may run over the start of a segment
_OTHER_SPACE = [chr(c) + " " for c in range(0x3001) if c != 0x20 and chr(c).isspace()]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(0x100 + hidden.index(b)) for b in range(256)]


class _Encoder:
    """The tokenizers library behind a cache of segments, for byte-level vocabularies.

    Segments of Latin letters and common signs are cut into the words of the vocabulary's
    pattern here and given to the library's model word by word; others go through the
    whole library.
    """

    def __init__(self, model: bytes):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model.decode())
        self.model = self.library.model
        self.apart = ["\0", *_OTHER_SPACE, *(t.content for t in self.library.get_added_tokens_decoder().values())]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.kind = "H" if self.dtype == np.uint16 else "I"
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.plain = re.compile("[\n\t -~\u00a1-\u024f]*").fullmatch
        self.letters = _byte_letters()
        self.segments = Memo(self._segment)
        self.pieces = Memo(self._piece, 100_000)

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, word: str) -> bytes:
        letters = self.letters
        return self._ids("".join([letters[b] for b in word.encode()]))

    def _ids(self, letters: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _segment(self, key: str) -> bytes:
        if key.isalpha():  # ASCII letters stand for themselves
            return self._ids(self.letters[0x20] + key) if key.isascii() else self._piece(" " + key)
        text = key[1:] if key[:1] == "\0" else " " + key
        if self.plain(text) is None:
            return self._whole(text)
        pieces, own = self.pieces, self.segments
        return b"".join([own[w[1:]] if w[0] == " " and w[1:].isalpha() else pieces[w] for w in self.words(text)])

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.apart):
            raw = self._whole(text)
        else:
            own = self.segments
            raw = b"".join([own[k] for k in segments(text, "\0")])
        return np.frombuffer(raw, self.dtype)


_encoders: dict[bytes, _Encoder] = {}


def _encoder(model: bytes) -> _Encoder:
    if model not in _encoders:
        _encoders[model] = _Encoder(model)
    return _encoders[model]


def _maybe_frequent(seq: np.ndarray) -> np.ndarray:
    """Places whose pairs may occur LEAST times: counts of hashed bins are never too low."""
    bins = _bins((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:])
    return (np.bincount(bins, minlength=BINS) >= LEAST)[bins]


def _bins(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)


def _pairs(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]


def _numbered(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values in order, number of each pair's value, counts), as of np.unique: where they fit in 64 bits, pairs are sorted with their places."""
    low = np.uint64(0xFFFFFFFF)
    left, right = pairs >> np.uint64(32), pairs & low
    symbol, place = int(max(left.max(initial=0), right.max(initial=0))).bit_length(), len(pairs).bit_length()
    if 2 * symbol + place > 64 or len(pairs) == 0:
        return np.unique(pairs, return_inverse=True, return_counts=True)
    in_order = np.sort((((left << np.uint64(symbol)) | right) << np.uint64(place)) | np.arange(len(pairs), dtype=np.uint64))
    value = in_order >> np.uint64(place)
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    count = np.diff(np.append(starts, len(pairs)))
    number = np.empty(len(pairs), np.int64)
    number[(in_order & np.uint64((1 << place) - 1)).astype(np.int64)] = np.repeat(np.arange(len(starts)), count)
    value = value[starts]
    return ((value >> np.uint64(symbol)) << np.uint64(32)) | (value & np.uint64((1 << symbol) - 1)), number, count


def compress(docs: list[np.ndarray], vocabulary_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules) of a shard; rule k is nonterminal vocabulary_size + k.

    A pair of old symbols can only become rarer, so after the first round only places where it
    was frequent, and the surroundings of what was replaced, are looked at.
    """
    seq = np.concatenate(docs).astype(np.uint32)
    sizes = np.array([len(d) for d in docs], np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    live = np.zeros(len(seq), bool)
    if len(seq) > 1:
        live[:-1] = _maybe_frequent(seq)
    rules, n_rules = [np.zeros((0, 2), np.uint32)], 0
    exact = False
    while len(at := np.flatnonzero(live & ~last)):
        pairs = _pairs(seq, at)
        exact = exact or len(at) < EXACT
        if exact:
            value, rule, count = _numbered(pairs)
        else:  # counts of hashed bins choose the places while there are very many
            rule = _bins(pairs)
            count = np.bincount(rule, minlength=BINS)
        count = count[rule].astype(np.int32)
        often = count >= LEAST
        at, pairs, rule, count = at[often], pairs[often], rule[often], count[often]
        live[:] = False
        live[at] = True
        n = np.zeros(len(seq) + 2, np.int32)
        n[at + 1] = count
        best = (count >= n[at]) & (count >= n[at + 2])  # no neighbour is more frequent
        at, pairs, rule = at[best], pairs[best], rule[best]
        begins = np.concatenate([[True], np.diff(at) > 1])[: len(at)]
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0  # of a run of equals, every other place
        at = at[take]
        if exact:  # the pairs are numbered already
            rule = rule[take]
            count = np.bincount(rule, minlength=len(value))
        else:
            value, rule, count = _numbered(pairs[take])
        kept = count >= (LEAST - 1 if exact else LEAST)
        at, rule = at[kept[rule]], (np.cumsum(kept) - 1)[rule[kept[rule]]]
        if len(at) == 0 and not exact:
            exact = True
            continue
        if len(at) == 0:
            break
        value = value[kept]
        seq[at] = vocabulary_size + n_rules + rule
        last[at] |= last[at + 1]
        live[at] = live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last, live = seq[keep], last[keep], live[keep]
        rules.append(np.stack([value >> np.uint64(32), value & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(value)
    own = np.zeros(len(docs), np.int64)
    ends = np.flatnonzero(last) + 1
    own[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    return seq, own, np.concatenate(rules)


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then a row of bits for each higher place."""
    planes = [np.packbits(((symbols >> np.uint32(k)) & np.uint32(1)).astype(bool), bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join([(symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(), *planes])


class _Packed:
    """Symbols in a buffer, read range by range."""

    def __init__(self, raw: bytes, at: int, n: int, bits: int):
        self.low, self.bits, width = np.frombuffer(raw, "<u2", n, at), bits, -(-n // 8)
        self.planes = [np.frombuffer(raw, np.uint8, width, at + 2 * n + k * width) for k in range(max(0, bits - 16))]
        self.end = at + 2 * n + max(0, bits - 16) * width

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self.low))
        out = self.low[a:b].astype(np.uint32)
        for k, plane in enumerate(self.planes):
            out |= np.unpackbits(plane[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(np.uint32) << np.uint32(16 + k)
        return out


def lengths_of(rules: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - vocabulary_size] if a >= vocabulary_size else 1) + (out[b - vocabulary_size] if b >= vocabulary_size else 1))
    return np.array(out, np.int64)


def write_block(doc_ids: list[int | None], docs: list[np.ndarray], vocabulary_size: int) -> bytes:
    seq, own, rules = compress(docs, vocabulary_size)
    bits = max(16, (vocabulary_size + len(rules)).bit_length())
    head = b"RPR2" + struct.pack("<QQQQ", len(doc_ids), len(rules), len(seq), bits)
    ids, there = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is not None for i in doc_ids], "<u1")
    sizes = np.array([len(d) for d in docs], "<u8")
    return b"".join([head, ids.tobytes(), there.tobytes(), sizes.tobytes(), own.astype("<u8").tobytes(), lengths_of(rules, vocabulary_size).astype("<u4").tobytes(), packed(rules.reshape(-1), bits), packed(seq, bits)])


class Block:
    """A shard; ``ids(k)`` decodes its k-th document alone, ``all()`` every document."""

    def __init__(self, raw: bytes, vocabulary_size: int):
        if raw[:4] != b"RPR2":
            raise ValueError("not a shard of token ids")
        n, n_rules, n_symbols, bits = struct.unpack_from("<QQQQ", raw, 4)
        at = 36

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        ids, there = take("<i8", n), take("<u1", n).astype(bool)
        self.doc_ids = pa.array(ids, mask=~there)
        self.sizes, own = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        rules = _Packed(raw, at, 2 * n_rules, bits)
        self.rules, self.symbols = rules[:].reshape(-1, 2), _Packed(raw, rules.end, n_symbols, bits)
        self.starts = np.concatenate([[0], np.cumsum(own)])
        self.size = vocabulary_size
        self.written: np.ndarray | None = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a row of symbols: those of the rules are written out once and copied to where they stand."""
        if len(self.rules) == 0 or self.lengths.sum() > MOST_RULE_IDS:
            return self._levels(symbols)
        if self.written is None:
            self.written = self._levels(np.arange(self.size, self.size + len(self.rules), dtype=np.uint32))
            self.begins = np.cumsum(self.lengths) - self.lengths
        rule = np.flatnonzero(symbols >= self.size)
        which = symbols[rule].astype(np.int64) - self.size
        n = np.ones(len(symbols), np.int64)
        n[rule] = self.lengths[which]
        out = np.repeat(symbols.astype(np.uint32), n)
        to = (np.cumsum(n) - n)[rule]
        own = self.lengths[which]
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(to, own) + inside] = self.written[np.repeat(self.begins[which], own) + inside]
        return out

    def _levels(self, symbols: np.ndarray) -> np.ndarray:
        """Nonterminals are replaced by their two symbols, all at once, until ids alone are left."""
        wanted = int(np.where(symbols >= self.size, self.lengths[np.maximum(symbols.astype(np.int64) - self.size, 0)], 1).sum()) if len(self.rules) else len(symbols)
        out = symbols.astype(np.uint32)
        while len(big := np.flatnonzero(out >= self.size)):
            pair = self.rules[out[big] - self.size]
            n = np.ones(len(out), np.int64)
            n[big] = 2
            to = (np.cumsum(n) - n)[big]
            out = np.repeat(out, n)
            out[to], out[to + 1] = pair[:, 0], pair[:, 1]
        if len(out) != wanted:
            raise ValueError("expansion lengths differ from the rules")
        return out

    def ids(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def all(self) -> np.ndarray:
        return self._expand(self.symbols[:])


def _shards(model: bytes):
    def run(batches):
        encoder = _encoder(model)
        size = encoder.library.get_vocab_size()
        ids, docs, held, number = [], [], 0, 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(map(len, docs))], pa.int64()), pa.array([write_block(ids, docs, size)], pa.binary())], ["shard", "n_tokens", "block"])

        end = np.array([END], encoder.dtype)
        for batch in batches:
            encoder.segments.turn()
            encoder.pieces.turn()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = np.concatenate([encoder(text.as_py() or ""), end])
                ids.append(doc_id)
                docs.append(own)
                held += len(own)
                if held >= SHARD_IDS:
                    yield shard()
                    ids, docs, held, number = [], [], 0, number + 1
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, model_path: str) -> None:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order, a part for each range of doc_ids."""
    with open(model_path, "rb") as f:  # on the driver; a vocabulary's size does not depend on the data
        model = f.read()
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    in_batches(dealt, _shards(model), "shard long, n_tokens long, block binary").withColumn("part", F.spark_partition_id()).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, vocabulary_size: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at ``path``."""
    files = spark.read.schema("shard long, n_tokens long, block binary, part int").parquet(path)
    sizes = files.select("part", "shard", "n_tokens")
    # a row for each part; their number is that of the partitions, not of the documents
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = saved(sizes.select("part", "shard", within.alias("within")).join(before, "part").select("part", "shard", (F.col("within") + F.col("before")).alias("start")))

    def run(batches):
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("block")):
                block = Block(raw.as_py(), vocabulary_size)
                ids = block.all().astype("<u4")
                ends = np.cumsum(block.sizes)
                begin = ends - block.sizes
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([block.doc_ids, pa.array(begin + start), pa.array(block.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(starts, ["part", "shard"]).select("start", "block")
    return in_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    model = vocabulary("byte_bpe_50k.json")
    write_tokens(table(spark, sf_dir, "documents"), path, model)
    from tokenizers import Tokenizer

    return read_tokens(spark, path, Tokenizer.from_file(model).get_vocab_size())

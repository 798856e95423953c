"""Token ids in Parquet list columns (operator 3).

Documents are dealt in ranges of their id, tokenized by executor tasks and
written in ascending id order.  Files hold one row per document with its ids
as a list column.  Token ids come from a bounded vocabulary, so their pages
are dictionary encoded; the numbers beside them are delta encoded.  Row groups and pages are kept
small, so that with the column and offset indexes that the writer adds a
reader of a few documents, or of the counts alone, reads only their pages.

``start`` of a document is the number of ids before it.  Each task counts
within its own range; the few sums of the ranges (one row per file part) give the rest, in
a second small table ``parts``.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplylens.session import scratch_path

from . import common

END_ID = 2
#: Distinct pieces whose ids a Python worker keeps at most, twice.
KEPT_PIECES = 300_000
#: Ids in one Arrow batch that a task gives back to Spark.
BATCH_IDS = 2_000_000
#: One row group holds a few million ids, one page a few thousand documents' numbers at most.
LAYOUT = {
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true", "compression": "zstd",
}
WRITTEN = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()),
                     ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
WRITTEN_DDL = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"

#: How ``word_bpe_49k`` cuts words: runs of letters, single digits, runs of other signs.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of one such run of letters, and maybe one of signs after it.  Letters that every version of Unicode has, without
#: the dotted capital I (its small form is two characters); an apostrophe may be cut otherwise, "<" may begin a special token.
WORD_AND_SIGNS = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+)?")

_encoders: dict[int, PieceEncoder] = {}


class PieceEncoder:
    """Encodes UTF-8 texts piece by piece; a piece is a run of bytes other than ASCII white space.

    Good for tokenizers that drop white space and join nothing across it, as
    ``word_bpe_49k``: the ids of a text are then those of its pieces in a
    row, and a piece that comes again need not be encoded again.  Where the
    definition lower-cases texts, pieces are told apart in lower case only, but for
    those with combining marks: some marks compose with a small letter alone, and
    the definition composes before it lower-cases.

    New pieces are encoded many in one call.  Where the definition cuts words as ``word_bpe_49k`` does, the
    last id of each run tells its end, so pieces of letters, with or without signs after
    them, need only a blank between them.  The others stand between a special token of the
    tokenizer: it is cut out before anything else, so pieces stay apart.
    """

    def __init__(self, definition: str, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        told = json.loads(definition)
        self.lower = '"Lowercase"' in json.dumps(told.get("normalizer"))
        special = [t for t in told.get("added_tokens") or [] if t["special"] and not t["lstrip"] and not t["rstrip"]]
        self.special = [t["content"].encode().lower() for t in told.get("added_tokens") or []]
        self._marked = all(s.startswith(b"<") for s in self.special)  # then pieces without "<" need no look
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = told["model"].get("end_of_word_suffix")
        self.last = None
        if suffix and self._marked and (cuts[0].get("pattern") or {}).get("Regex") == LETTER_RUNS:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.last[[i for t, i in told["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.between = (special[0]["content"], special[0]["id"]) if special else None
        self.kept = kept
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pieces(self, text: bytes | None) -> list[bytes]:
        if not text:
            return []
        if self.lower:
            low = text.lower()
            if not any(s in low for s in self.special):  # lower case must not make a special token
                if b"\xcc" not in low and b"\xcd" not in low:  # the first bytes of U+0300 to U+036F
                    return low.split()
                return [p if b"\xcc" in p or b"\xcd" in p else p.lower() for p in text.split()]
        return text.split()

    def _encode_apart(self, pieces: list[bytes]) -> list[bytes]:
        encode = self.tokenizer.encode_batch_fast
        if self.between is None or any(s in p.lower() for p in pieces if b"<" in p or not self._marked for s in self.special):
            return [array("I", e.ids).tobytes() for e in encode([p.decode() for p in pieces], add_special_tokens=False)]
        text, mark = self.between
        joined = [text.join(p.decode() for p in pieces[at:at + 500]) for at in range(0, len(pieces), 500)]
        out = []
        for e in encode(joined, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]
        return out

    def _encode_runs(self, pieces: list[str], runs: list[int]) -> list[bytes] | None:
        """The ids of ``pieces`` that make so many ``runs`` each; None if the ends found are not as many."""
        out: list[bytes] = []
        joined = [" ".join(pieces[at:at + 500]) for at in range(0, len(pieces), 500)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends, last = np.flatnonzero(self.last[ids]) + 1, np.cumsum(runs[500 * i:500 * i + 500]) - 1
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                return None
            raw, cuts = ids.tobytes(), (4 * ends[last]).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _encode_new(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(piece, its ids) of all ``pieces``."""
        if self.last is not None:
            plain, texts, runs, others = [], [], [], []
            for p in pieces:
                if m := WORD_AND_SIGNS.fullmatch(text := p.decode()):
                    plain.append(p)
                    texts.append(text)
                    runs.append(1 if m[1] is None else 2)
                else:
                    others.append(p)
            found = self._encode_runs(texts, runs)
            if found is not None:
                yield from zip(plain, found, strict=True)
                pieces = others
        yield from zip(pieces, self._encode_apart(pieces), strict=True)

    def _learn(self, pieces: set[bytes]) -> None:
        """Puts the ids of all ``pieces`` into ``self.ids``."""
        if len(self.ids) > self.kept:
            self.older, self.ids = self.ids, {}
        missing = []
        for p in pieces.difference(self.ids):
            if (ids := self.older.get(p)) is None:
                missing.append(p)
            else:
                self.ids[p] = ids
        for at in range(0, len(missing), 20_000):
            self.ids.update(self._encode_new(missing[at:at + 20_000]))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null."""
        rows = [self._pieces(t) for t in texts]
        self._learn(set().union(*rows))
        get = self.ids.__getitem__
        return [b"".join(map(get, row)) for row in rows]


def _encoder(definition: str) -> PieceEncoder:
    """The worker's encoder for this definition, kept from task to task."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(definition)
    return _encoders[key]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most`` at most; a row above it is a run of its own."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _tokenize(definition, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = _encoder(definition.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            # a few megabytes of text at a time, whatever the length of single documents
            lengths = [n or 0 for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in _groups(lengths, 2 * BATCH_IDS):
                rows = [ids + end for ids in encoder.encode(texts[a:b].to_pylist())]
                counts = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                before = np.concatenate(([0], np.cumsum(counts)))
                flat = np.frombuffer(b"".join(rows), dtype="<u4").view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.full(b - a, part, dtype=np.int32)),
                     pa.array(done + before[:-1]), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(flat))], schema=WRITTEN)
                done += int(before[-1])

    return run


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, definition: str, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID) -> None:
    """Tokenize ``docs`` and write token files below ``path`` in ascending id order.

    ``definition`` is the text of a tokenizer file; it is broadcast once (a
    file of a few megabytes).  Null text: only the end id.  A null id comes
    first; rows with equal ids are all kept, in the order of a hash of their text.
    Other columns aren't written.
    """
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    tokens = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tokenize(shared, end_id), WRITTEN_DDL)
    tokens.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens of the documents in ``path``.

    What is before each part comes from the counts alone (no ids are read
    for it); there is one row per part.
    """
    files = spark.read.schema(WRITTEN_DDL).parquet(path)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = (files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before")))
    parts = common.small_side(common.land(spark, parts, "token-parts"), row_bytes=16)
    return (files.join(parts, F.col("part") == F.col("_part"))
            .select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "tokens"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
                                          pa.array(sums, type=pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_definition(name: str = "word_bpe_49k.json") -> str:
    """The text of an installed public tokenizer file, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark, common.table(spark, sf_dir, "documents"), path, tokenizer_definition())
    return checksums(read_tokens(spark, path))

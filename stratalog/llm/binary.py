"""Token ids in length-delimited binary record files with a separate offset index.

A record file frames each sequence as::

    length   8 bytes, little-endian
    check    4 bytes, masked CRC-32C of the length bytes
    payload  doc_id (8 bytes), start (8 bytes), then the ids, all little-endian
    check    4 bytes, masked CRC-32C of the payload

which is the public TFRecord framing. Ids take two bytes where the vocabulary fits, else four. Beside
``part-00012.rec`` stands ``part-00012.idx``, the byte offset of every record as an 8-byte integer and the
file's length at the end, so a reader can seek to any record of any file.

Rows are range-partitioned by doc_id and sorted, one file for each partition, so files in order of name
and records in order of offset are in ascending doc_id order. Files are written through Arrow's file
systems under a temporary name and moved into place, so a task that is run again does no harm.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import bounded_batches, cut, scratch_path, table

END_ID = 2
HEADER = 16
_MASK = 0xA282EAD8
#: Payload bytes that one worker gathers before it checks and writes them.
FLUSH_BYTES = 4 << 20


# CRC-32C -------------------------------------------------------------------------------------------


def _crc_tables() -> np.ndarray:
    """Eight tables of 256, for eight bytes at a step (polynomial 0x1EDC6F41, reflected)."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0x82F63B78), first >> 1).astype(np.uint32)
    tables = [first]
    for _ in range(7):
        tables.append((tables[-1] >> 8) ^ first[tables[-1] & 0xFF])
    return np.stack(tables)


_T = _crc_tables()
LANE = 1024


def _lanes_crc(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Runs the register over equally long rows of bytes (a multiple of eight), all rows at once."""
    for at in range(0, rows.shape[1], 8):
        b = rows[:, at : at + 8]
        low = state ^ (b[:, 0] | b[:, 1].astype(np.uint32) << 8 | b[:, 2].astype(np.uint32) << 16 | b[:, 3].astype(np.uint32) << 24)
        state = (
            _T[7][low & 0xFF] ^ _T[6][low >> 8 & 0xFF] ^ _T[5][low >> 16 & 0xFF] ^ _T[4][low >> 24]
            ^ _T[3][b[:, 4]] ^ _T[2][b[:, 5]] ^ _T[1][b[:, 6]] ^ _T[0][b[:, 7]]
        )
    return state


def _zeros_operator(length: int) -> np.ndarray:
    """Four tables of 256 that carry the register over ``length`` zero bytes (it is linear)."""
    basis = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    carried = _lanes_crc(np.zeros((32, length), np.uint8), basis)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            on = (np.arange(256) >> bit & 1).astype(bool)
            tables[k, on] ^= carried[8 * k + bit]
    return tables


_OVER_LANE = None


def crc32c(pieces: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string. Long ones are cut into lanes that are checked side by side."""
    global _OVER_LANE
    if _OVER_LANE is None:
        _OVER_LANE = _zeros_operator(LANE)
    lengths = np.array([len(p) for p in pieces], np.int64)
    whole, rest = lengths // LANE, lengths % LANE
    state = np.full(len(pieces), 0xFFFFFFFF, np.uint32)
    if whole.any():
        data = np.frombuffer(b"".join(p[: int(w) * LANE] for p, w in zip(pieces, whole, strict=True)), np.uint8).reshape(-1, LANE)
        lanes = np.concatenate([_lanes_crc(data[i : i + 4096], np.zeros(len(data[i : i + 4096]), np.uint32)) for i in range(0, len(data), 4096)])
        first = np.r_[0, np.cumsum(whole)[:-1]]
        for k in range(int(whole.max())):
            on = whole > k
            s = state[on]
            carried = _OVER_LANE[0][s & 0xFF] ^ _OVER_LANE[1][s >> 8 & 0xFF] ^ _OVER_LANE[2][s >> 16 & 0xFF] ^ _OVER_LANE[3][s >> 24]
            state[on] = carried ^ lanes[first[on] + k]
    tails = rest // 8 * 8
    order = np.argsort(-tails, kind="stable")
    if len(pieces) and tails.max(initial=0):
        block = np.zeros((len(pieces), int(tails.max())), np.uint8)
        for row, i in enumerate(order):
            t = int(tails[i])
            block[row, :t] = np.frombuffer(pieces[i], np.uint8, t, int(whole[i]) * LANE) if t else 0
        sorted_state, sorted_tails = state[order], tails[order]
        for at in range(0, block.shape[1], 8):
            n = int((sorted_tails > at).sum())
            sorted_state[:n] = _lanes_crc(block[:n, at : at + 8], sorted_state[:n])
        state[order] = sorted_state
    for step in range(8):  # the last bytes one by one
        on = np.flatnonzero(rest - tails > step)
        if not len(on):
            break
        b = np.array([pieces[i][int(whole[i]) * LANE + int(tails[i]) + step] for i in on], np.uint32)
        state[on] = (state[on] >> 8) ^ _T[0][(state[on] ^ b) & 0xFF]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


# Encoding ------------------------------------------------------------------------------------------


#: Chunks of a text that are looked up before full caches give way.
CHUNKS = 1 << 15


class _Kept(dict):
    """Values by key, made when a key is first asked for."""

    def __init__(self, made) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key):
        value = self[key] = self.made(key)
        return value


class Encoder:
    """The ids of whole texts by a tokenizer of the tokenizers library, given as its JSON text.

    Where the tokenizer splits texts into words by a known pattern and encodes word by word, the ids of a
    word by the library's model are kept, as bytes, in two generations: when the younger one is full it takes
    the place of the older one, so what comes again and again stays, however many rare words there are. All other tokenizers, and texts with characters outside those
    that ``simple`` lets pass (whose classes, case or composition may differ between libraries), go
    through ``encode``.
    """

    #: The only split whose words are looked up one by one.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The same split in the characters that ``simple`` lets pass.
    SPLIT_SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_¹²³¼½¾]+|[\d¹²³¼½¾]|(?:[^\s\w]|_)+"

    def __init__(self, description: str, memo: int = 200_000) -> None:
        import json
        import os
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(description)
        self.model, self.limit, self.young, self.old = self.tokenizer.model, memo, _Kept(self.made), {}
        made = json.loads(description)
        pre = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        byte_level = pre[-1].get("type") == "ByteLevel" and not pre[-1].get("add_prefix_space") and not pre[-1].get("use_regex")
        split = pre[0].get("type") == "Split" and pre[0].get("pattern", {}).get("Regex") == self.SPLIT
        removed = pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
        steps = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers") or ()]
        self.by_word = bool(steps == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and split and removed and byte_level and made["model"]["type"] == "BPE")
        self.words = re.compile(self.SPLIT_SIMPLE).findall
        self.simple = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*").fullmatch
        self.special = [t["content"] for t in made.get("added_tokens") or ()]
        # the byte-level alphabet, learnt from the library for the bytes of the characters that pass
        level, self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
        for c in map(chr, [*range(1, 0x250), 0x307, *range(0x2010, 0x2028)]):
            self.alphabet.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True))
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.packed = [i.to_bytes(4 if self.wide else 2, "little") for i in range(self.tokenizer.get_vocab_size())]

    def made(self, chunk: str) -> bytes:
        """The ids of characters between white space, which no word of the split spans, or of one word."""
        found = self.old.get(chunk)
        if found is None:
            words = [chunk] if chunk.isalpha() else self.words(chunk)
            found = self.word_ids(words[0]) if len(words) == 1 else b"".join(map(self.young.__getitem__, words))
        return found

    def word_ids(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])

    def packed_ids(self, text: str | None) -> bytes:
        """The ids of a text as they stand in the files."""
        if not text:
            return b""
        if not (self.by_word and self.simple(text)) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        chunks, out = text.lower().split(), []  # these characters are composed already and lower-cased one by one
        for at in range(0, len(chunks), CHUNKS):
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, _Kept(self.made)
            out.append(b"".join(map(self.young.__getitem__, chunks[at : at + CHUNKS])))
        return b"".join(out)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed_ids(text), self.kind).tolist()

    def payload(self, text: str | None, end_id: int) -> np.ndarray:
        kind = "<u4" if end_id >> 16 else self.kind
        return np.append(np.frombuffer(self.packed_ids(text), self.kind), np.array([end_id], kind)).astype(kind, copy=False)


_ENCODERS: dict[str, Encoder] = {}


def encoder(handle) -> Encoder:
    """The encoder of a broadcast tokenizer, made once for each Python worker."""
    name, description = handle.value
    if name not in _ENCODERS:
        _ENCODERS.clear()  # workers live on from query to query
        _ENCODERS[name] = Encoder(description)
    return _ENCODERS[name]


# Files ---------------------------------------------------------------------------------------------


def file_system(uri: str):
    """Arrow's file system and the path in it; local paths and file: URIs need no more than that."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _framed(ids: list[int], starts: np.ndarray, tokens: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The records of some documents and the length of each."""
    heads = np.stack([np.array(ids, "<i8"), starts.astype("<i8")], axis=1)
    payloads = [h.tobytes() + t.tobytes() for h, t in zip(heads, tokens, strict=True)]
    lengths = np.array([len(p) for p in payloads], "<u8")
    length_bytes = [x.tobytes() for x in lengths]
    head_checks = masked(crc32c(length_bytes)).astype("<u4")
    checks = masked(crc32c(payloads)).astype("<u4")
    out = io.BytesIO()
    for n, a, p, b in zip(length_bytes, head_checks, payloads, checks, strict=True):
        out.write(n + a.tobytes() + p + b.tobytes())
    return out.getvalue(), lengths.astype(np.int64) + 16


def _publish(target, trial: str, name: str) -> None:
    """Move a finished file into place; an earlier run of the same task left the same content there."""
    from pyarrow import fs

    try:
        target.move(trial, name)
    except OSError:
        if target.get_file_info(name).type == fs.FileType.NotFound:
            raise
        target.delete_file(trial)


def _write_part(path: str, tokenizer, end_id: int):
    """Writes a partition's rows, sorted by doc_id, into one file; yields a row for the file."""

    def run(batches):
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        target, folder = file_system(path)
        name, trial = f"{folder}/part-{part:05d}", uuid.uuid4().hex
        offsets, n_ids, here = [], 0, 0
        target.create_dir(folder, recursive=True)
        with target.open_output_stream(f"{name}.rec.{trial}") as out:

            def flush(ids, tokens):
                nonlocal n_ids, here
                sizes = np.array([len(t) for t in tokens], np.int64)
                data, lengths = _framed(ids, n_ids + np.r_[0, np.cumsum(sizes)[:-1]], tokens)
                offsets.append(here + np.r_[0, np.cumsum(lengths)[:-1]])
                out.write(data)
                here += len(data)
                n_ids += int(sizes.sum())

            ids, tokens, held = [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 200):  # few texts at a time are Python strings
                    some = batch.slice(at, 200)
                    for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                        ids.append(NULL_ID if doc_id is None else doc_id)
                        tokens.append(coder.payload(text, end_id))
                        held += tokens[-1].nbytes
                        if held > FLUSH_BYTES:
                            flush(ids, tokens)
                            ids, tokens, held = [], [], 0
            if ids:
                flush(ids, tokens)
        with target.open_output_stream(f"{name}.idx.{trial}") as out:
            out.write(np.r_[np.concatenate(offsets) if offsets else np.empty(0, np.int64), here].astype("<i8").tobytes())
        for kind in ("idx", "rec"):
            _publish(target, f"{name}.{kind}.{trial}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_ids], pa.int64()), pa.array([here], pa.int64())], names=["part", "n_ids", "n_bytes"])

    return run


#: UTF-8 bytes of text that go into one file, about.
FILE_BYTES = 64 << 20
#: Stands for a null doc_id in the files; it sorts first.
NULL_ID = -(1 << 63)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Encode every text and write record and index files below ``path``; returns (part, n_ids, n_bytes).

    A null or empty text is the end id alone; null ids come first; rows that repeat an id are all written,
    ordered by their texts. Other columns are ignored; an empty table writes empty files or none.
    ``start`` in a record counts from its file; a file's own start is the sum of n_ids of those before it.
    There is a file for each ``FILE_BYTES`` of text, and one for each shuffle partition at least.
    """
    if parts is None:
        total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    bounded_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:  # a few megabytes, whatever the corpus
        description = f.read()
    handle = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(description.encode()).hexdigest(), description))
    # written once: later reads of this frame must not write the files again
    return cut(dealt.mapInArrow(_write_part(path, handle, end_id), "part int, n_ids long, n_bytes long"))


def read_records(written: DataFrame, path: str, wide: bool, chunk: int = 2 << 20, digests: bool = False) -> DataFrame:
    """(part, record, doc_id, start, ids binary) of all records, checked; ids are little-endian 32-bit integers.

    With ``digests`` n_tokens and ids_crc32 come in place of ids. One task reads one file from start to end
    in pieces, by the offsets of its index.
    """

    def run(batches):
        source, folder = file_system(path)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with source.open_input_stream(f"{folder}/part-{part:05d}.idx") as f:
                    at = np.frombuffer(f.read(), "<i8")
                with source.open_input_file(f"{folder}/part-{part:05d}.rec") as f:
                    first = 0
                    while first < len(at) - 1:
                        past = max(first + 1, int(np.searchsorted(at, at[first] + chunk, "right")) - 1)
                        data = f.read_at(int(at[past] - at[first]), int(at[first]))
                        read = _unframed(data, at[first : past + 1] - at[first], part, first, wide)
                        yield _digested(read) if digests else read
                        first = past

    rows = _dealt_parts(written)
    tail = "n_tokens long, ids_crc32 long" if digests else "ids binary"
    return rows.mapInArrow(run, f"part int, record long, doc_id long, start long, {tail}")


def _dealt_parts(written: DataFrame) -> DataFrame:
    return written.select("part").repartition(max(1, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part")


def read_shuffled(written: DataFrame, path: str, wide: bool, seed: int, at_once: int = 256) -> DataFrame:
    """(part, record, doc_id, start, ids binary) of all records, checked, those of a file in a random order that ``seed`` tells.

    The index gives each record's place, so only ``at_once`` records are held; every record is read once.
    """

    def run(batches):
        source, folder = file_system(path)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with source.open_input_stream(f"{folder}/part-{part:05d}.idx") as f:
                    at = np.frombuffer(f.read(), "<i8")
                order = np.random.default_rng([seed, part]).permutation(max(0, len(at) - 1))
                with source.open_input_file(f"{folder}/part-{part:05d}.rec") as f:
                    for k in range(0, len(order), at_once):
                        chosen = order[k : k + at_once]
                        data = [f.read_at(int(at[i + 1] - at[i]), int(at[i])) for i in chosen]
                        places = np.r_[0, np.cumsum([len(d) for d in data])]
                        read = _unframed(b"".join(data), places, part, 0, wide)
                        yield read.set_column(1, "record", pa.array(chosen, pa.int64()))

    return _dealt_parts(written).mapInArrow(run, "part int, record long, doc_id long, start long, ids binary")


def _digested(records: pa.RecordBatch) -> pa.RecordBatch:
    ids = records.column(4).to_pylist()
    return pa.RecordBatch.from_arrays(
        [*records.columns[:4], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
        names=[*records.schema.names[:4], "n_tokens", "ids_crc32"],
    )


def _unframed(data: bytes, at: np.ndarray, part: int, first: int, wide: bool) -> pa.RecordBatch:
    records = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    checks = np.array([[int.from_bytes(r[8:12], "little"), int.from_bytes(r[-4:], "little")] for r in records], np.uint32)
    lengths = [int.from_bytes(h, "little") for h in heads]
    if lengths != [len(p) for p in payloads] or (masked(crc32c(heads)) != checks[:, 0]).any() or (masked(crc32c(payloads)) != checks[:, 1]).any():
        raise ValueError(f"part {part}: a record does not match its checks")
    kind = "<u4" if wide else "<u2"
    ids = [np.frombuffer(p, kind, offset=HEADER).astype("<u4").tobytes() for p in payloads]
    doc_ids = [int.from_bytes(p[:8], "little", signed=True) for p in payloads]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(ids), pa.int32()),
            pa.array(range(first, first + len(ids)), pa.int64()),
            pa.array([None if d == NULL_ID else d for d in doc_ids], pa.int64()),
            pa.array([int.from_bytes(p[8:16], "little") for p in payloads], pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        names=["part", "record", "doc_id", "start", "ids"],
    )


def file_starts(written: DataFrame) -> DataFrame:
    """(fpart, base): the ids of all files before each file; one row for each file."""
    from pyspark.sql.window import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.select(F.col("part").alias("fpart"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def op5_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, tokenizer = scratch_path(spark, "records"), public_tokenizers.path("word_bpe_49k.json")
    written = write_records(table(spark, sf_dir, "documents"), path, tokenizer)

    with open(tokenizer, encoding="utf-8") as f:
        wide = Encoder(f.read()).wide
    read = read_records(written, path, wide, digests=True)
    starts = file_starts(written)
    return read.join(F.broadcast(starts), read["part"] == starts["fpart"]).select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )

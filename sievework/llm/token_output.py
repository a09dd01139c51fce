"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes.

Texts are dealt by ranges of the id and sorted within each range, so the files, read in order of
part, hold the documents in ascending order; ids are encoded after that one shuffle and written by
Spark's own writer, whose commit survives a lost executor. Every row carries its part and its place
in it, which are all that a later reader needs to number tokens across files.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import documents, release
from sievework.plans.staging import materialise, stage_path

END_ID = 2
#: Words whose ids a Python worker remembers (at this many it starts anew), and bytes of the longest.
REMEMBERED, LONGEST = 1 << 20, 64
#: Latin-1 characters that Arrow and the library's rules surely see alike; a text with any other goes
#: to the library whole. Left out: controls, no-break space, soft hyphen, superscripts and fractions.
_PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(i for i in range(0xA1, 0x100) if i not in (0xAD, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE))
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


_ODD = f"<\\||[^{''.join(rf'\x{{{i:x}}}' for i in _PLAIN)}]"
_NO_IDS = np.empty(0, dtype="<u4")
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)
_POWERS = np.array([[pow(int(b), i + 1, 1 << 64) for i in range(LONGEST + 1)] for b in _BASES], dtype=np.uint64)


def _digests(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(two 64-bit hashes of each word, its bytes); words over LONGEST bytes share the hashes of their starts."""
    if not len(words):
        return np.zeros((2, 0), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    ends = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1, offset=4 * words.offset).astype(np.int64)
    size = np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    place = np.minimum(np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size), LONGEST)
    some = np.flatnonzero(size)
    out = np.zeros((2, len(words)), dtype=np.uint64)
    for lane in range(2):
        if some.size:
            out[lane, some] = np.add.reduceat(data * _POWERS[lane][place], ends[:-1][some] - ends[0])
    out ^= out >> np.uint64(29)
    out *= _BASES[::-1, None]
    return out ^ (out >> np.uint64(32)), size


class _Memory:
    """Ids of words by their hashes: open addressing in arrays, some 40 bytes a word."""

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(self.mask + 1, -1, dtype=np.int32)
        self.n, self.key = 0, np.empty((2, self.most), dtype=np.uint64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those not known."""
        out, who = np.full(key.shape[1], -1, dtype=np.int32), np.arange(key.shape[1])
        at = (key[0] & np.uint64(self.mask)).astype(np.int64)
        while who.size:
            e = self.slot[at]
            there = e >= 0
            who, at, e = who[there], at[there], e[there]
            hit = (self.key[0, e] == key[0, who]) & (self.key[1, e] == key[1, who])
            out[who[hit]] = e[hit]
            who, at = who[~hit], (at[~hit] + 1) & self.mask
        return out

    def add(self, key: np.ndarray) -> np.ndarray:
        """Numbers for words that are not known, no two alike."""
        number = np.arange(self.n, self.n + key.shape[1], dtype=np.int32)
        self.key[:, self.n : self.n + key.shape[1]] = key
        self.n += key.shape[1]
        who, at = np.arange(key.shape[1]), (key[0] & np.uint64(self.mask)).astype(np.int64)
        while who.size:
            free = self.slot[at] < 0
            self.slot[at[free]] = number[who[free]]  # of several at one slot the last stays
            left = self.slot[at] != number[who]
            who, at = who[left], (at[left] + 1) & self.mask
        return number


class WordEncoder:
    """Encodes whole texts with a word-end BPE file of the tokenizers library.

    The file's rules cut a text at white space, and finer, before any merge, so each distinct word
    of a batch is looked up once, what is new goes to the library once, and ids are laid out by array
    operations. Texts with characters whose case, composition or class the rules and Arrow could see
    differently go to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.library.model)  # its words are lower-cased and cut already
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        n = self.library.get_vocab_size(True)
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.memory = _Memory(remembered)
        self._forget()

    def _forget(self) -> None:
        self.memory.clear()
        self.begin, self.size = (np.zeros(self.memory.most, dtype=np.int64) for _ in range(2))
        self.flat, self.used = np.empty(1 << 16, dtype="<u4"), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Where ids now stand in flat."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), dtype="<u4")])
        at, self.used = self.used, self.used + len(ids)
        self.flat[at : self.used] = ids
        return at

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has). A piece holds no white space."""
        ids, sizes = [_NO_IDS], [_NO_IDS]
        groups = [pieces[at : at + 128] for at in range(0, len(pieces), 128)]
        for group, e in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, dtype="<u4")
            n = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[own])]))
            if len(n) != len(group) or n.sum() != len(own):  # some piece has no end, or one inside
                each = [np.array(x.ids, dtype="<u4") for x in self.library.encode_batch(group, add_special_tokens=False)]
                own, n = np.concatenate(each), np.array([*map(len, each)])
            ids.append(own)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int64)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each word stand in flat, how many): a run of letters is one piece; other words are cut."""
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        begin, size = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        ids, n = self._pieces(words.filter(pa.array(letters)).to_pylist())
        begin[letters], size[letters] = self._keep(ids) + np.cumsum(n) - n, n
        cut = [_PIECES.findall(w) for w in words.filter(pa.array(~letters)).to_pylist()]
        if cut:
            of = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            ids, n = self._pieces([*of])
            ends = np.cumsum(n).tolist()
            spans = [ids[e - k : e] for e, k in zip(ends, n.tolist(), strict=True)]
            for i, c in zip(np.flatnonzero(~letters).tolist(), cut, strict=True):
                whole = np.concatenate([spans[of[p]] for p in c]) if len(c) > 1 else spans[of[c[0]]] if c else _NO_IDS
                begin[i], size[i] = self._keep(whole), len(whole)
        return begin, size

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each distinct word stand in flat, how many)."""
        key, length = _digests(words)
        number = self.memory.find(key)
        number[length > LONGEST] = -1  # their hashes do not tell them apart
        new = np.flatnonzero((number < 0) & (length > 0))
        if self.memory.n + len(new) > self.memory.most or self.used > 8 * self.memory.most:
            self._forget()
            number[:] = -1
            new = np.flatnonzero(length > 0)
        begin, size = self.begin[number], np.where(number < 0, 0, self.size[number])
        if new.size:
            begin[new], size[new] = self._learn(words.take(pa.array(new)))
            stay = new[length[new] <= LONGEST][: self.memory.most - self.memory.n]
            number = self.memory.add(key[:, stay])
            self.begin[number], self.size[number] = begin[stay], size[stay]
        return begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as unsigned 32-bit integers, how many each has); a null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts))
        words, bounds = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        coded, bounds = words.dictionary_encode(), bounds - bounds[0]
        begin, size = self._known(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        at += np.repeat(begin[word] - ends + n, n)
        ids = self.flat[at]
        count = np.diff(np.concatenate([[0], ends])[bounds])
        if odd.any():
            parts, at = [], 0
            for i, (o, c) in enumerate(zip(odd.tolist(), count.tolist(), strict=True)):
                whole = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4") if o else ids[at : at + c]
                at, count[i] = at + c, len(whole)
                parts.append(whole)
            ids = np.concatenate(parts)
        return ids, count


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenise(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, seq, ids) in ascending order of id, then text; null ids first, null texts empty.

    Rows that share an id all stay. Each document's ids end with end_id. An empty table gives no rows;
    columns other than the two named play no part.
    """
    kind = dict(df.dtypes)[id_col]
    arrow = pa.list_(pa.field("element", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids, count = enc.encode(b.column(1))
            stops = np.cumsum(count + 1)
            flat = np.insert(ids, stops - np.arange(1, n + 1), end_id).astype("<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(flat)).cast(arrow)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seq, seq + n, dtype=np.int64)), lists], names=["doc_id", "part", "seq", "ids"])
            seq += n
        release()

    dealt = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, f"doc_id {kind}, part int, seq long, ids array<int>")


def write_tokens(tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Write what tokenise() gives. encoding: 'dictionary' or 'delta' for the ids.

    Format-version-2 pages; doc_id and seq are always delta-encoded, as they ascend. Column and
    offset indexes, which Parquet's writer adds to each row group, let a reader of few documents
    skip pages; page_rows bounds the rows that one page covers.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    (
        tokens.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
        .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#seq", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        .parquet(path)
    )


def read_tokens(spark, path: str, columns: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Chosen columns of the documents with low <= doc_id <= high; the bounds reach the page index."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns) if columns else df


def token_index(spark, path: str) -> DataFrame:
    """(doc_id, part, seq, start, n_tokens, ids_crc32), all from the files at path; none from empty files.

    start counts the ids of all documents before; it is 0 for the first. Numbering runs within each
    part, then over one total per part, so no task sees more than a part.
    """
    stored = spark.read.parquet(path)
    kind = dict(stored.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, type=pa.int64())],
                names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
            )
        release()

    rows = materialise(stored.select("doc_id", "part", "seq", "ids").mapInArrow(run, f"doc_id {kind}, part int, seq long, n_tokens long, ids_crc32 long"), "lengths")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(totals, "part").select("doc_id", "part", "seq", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    """Start, length and digest of every document's ids, read back from the files."""
    import public_tokenizers

    path = stage_path(spark, "tokens")
    write_tokens(tokenise(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")), path)
    return token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")

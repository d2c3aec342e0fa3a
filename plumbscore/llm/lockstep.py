"""Alignment of two tokenizers: where tokens of both end at the same byte.

One state vector per batch holds for every document, or stretch of a long document, the place of its next token of A and of B.
Each step compares the two byte ends of all of them at once, moves the pointer that is
behind (both where the ends agree, which gives a link and a cut), and takes finished ones out of the vector. Long documents are cut into
stretches of ``STRETCH`` tokens of A with the tokens of B that end within them, as links depend on
the ends only; so a long document makes the vector wider instead of the loop longer.

How often an id pair is linked in all documents is summed in the tasks and then over them. Pairs with more than one in ``HEAD`` of all links, at most
``HEAD`` of them, go to the tasks; documents meet the other pairs by a join in which none is a hot key.

The vocabulary files are read by the driver and travel with the job, so executors need no folder in common with it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table
from plumbscore.session import materialize

VOCABULARIES = "/opt/tokenizers"
BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRETCH = 256
TEXT_BYTES = 1 << 21
PAIRS_AT_ONCE = 1 << 20
HEAD = 50_000
# How byte-level vocabularies split a text before the merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_READY: dict[bytes, Tokenizers] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Tokenizers:
    """Both tokenizers, the bytes of their tokens and the text of ids with what follows them in a group."""

    def __init__(self, bytes_file: bytes, pieces_file: bytes) -> None:
        import sentencepiece

        content = json.loads(bytes_file)
        vocabulary, alphabet = content["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
        self.bytes_a = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, n in vocabulary.items():
            self.bytes_a[n] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.encode_a = self._by_ranks(content, special) or self._by_library(bytes_file)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces_file)
        self.bytes_b = [_piece_bytes(self.pieces.id_to_piece(n)) for n in range(self.pieces.get_piece_size())]
        self.lengths = [np.array([len(b) for b in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.texts = [str(n).encode() + mark for mark in (b",", b"|", b";", b"") for n in range(self.ids)]

    def _by_ranks(self, content: dict, special: dict[str, int]) -> Any:
        """A faster encoder, for files whose merges are numbered in the order of the ids, or None."""
        import tiktoken

        vocabulary = content["model"]["vocab"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in content["model"]["merges"]]
        split = content.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not content.get("normalizer")
        ids = [vocabulary.get(m) for m in merged]
        if not plain or None in ids or ids != sorted(set(ids)) or content["model"].get("ignore_merges"):
            return None
        ranks = {self.bytes_a[n]: n for token, n in vocabulary.items() if token not in special}
        if any(bytes([b]) not in ranks or ranks[bytes([b])] > ids[0] for b in range(256)):
            return None
        encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    @staticmethod
    def _by_library(bytes_file: bytes) -> Any:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(bytes_file.decode())
        own.encode_special_tokens = True
        return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


def tokenizers_of(bytes_file: bytes, pieces_file: bytes) -> Tokenizers:
    """One pair of tokenizers per process."""
    name = hashlib.sha256(bytes_file + pieces_file).digest()
    if name not in _READY:
        _READY[name] = Tokenizers(bytes_file, pieces_file)
    return _READY[name]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, counts_a: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked tokens in A and in B, ascending.

    ``ends_a`` and ``ends_b`` are the byte ends of the tokens of all documents one after the other, ascending throughout;
    ``counts_a`` has the tokens of A per document. Both tokenizers end a document at the same byte.
    """
    before = np.cumsum(counts_a) - counts_a
    pieces = -(-counts_a // stretch)
    starts = np.repeat(before, pieces) + stretch * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    stops = np.minimum(starts + stretch, np.repeat(before + counts_a, pieces))
    reached = np.where(starts > 0, ends_a[np.maximum(starts, 1) - 1], -1)
    a, b = starts, np.searchsorted(ends_b, reached, "right")
    stops_b = np.searchsorted(ends_b, ends_a[stops - 1], "right") if len(stops) else b
    found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    live = b < stops_b
    a, b, stops, stops_b = a[live], b[live], stops[live], stops_b[live]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        met = end_a == end_b
        found_a.append(a[met])
        found_b.append(b[met])
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        live = (a < stops) & (b < stops_b)
        if not live.all():
            a, b, stops, stops_b = a[live], b[live], stops[live], stops_b[live]
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def align(texts: list[str | None], own: Tokenizers) -> dict[str, list | np.ndarray]:
    """What is to know of each text: counts, the digest of its groups, and its linked id pairs with how often each is linked.

    The pairs of all texts stand one after the other, as ``a * ids + b``, with ``offsets`` between texts.
    """
    many = len(texts)
    full = [n for n, t in enumerate(texts) if t]
    spaced = [" " + texts[n] for n in full]
    kept, ids_a, ids_b, sizes = [], [], [], []
    for n, text, in_a, in_b in zip(full, spaced, own.encode_a(spaced), own.encode_b([texts[n] for n in full]), strict=True):
        wanted = text.encode()
        if b"".join(map(own.bytes_a.__getitem__, in_a)) == wanted == b"".join(map(own.bytes_b.__getitem__, in_b)):
            kept.append(n)
            ids_a.append(in_a)
            ids_b.append(in_b)
            sizes.append(len(wanted))
    counts = [np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b)]
    flat = [np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(c.sum())) for ids, c in zip((ids_a, ids_b), counts, strict=True)]
    # Empty tokens, as no public vocabulary has, would end where the token before ends.
    ends = [np.cumsum(own.lengths[side][ids]) for side, ids in enumerate(flat)]
    link_a, link_b = lockstep(*ends, counts[0])
    kept_at = np.array(kept, dtype=np.int64)
    text_ends = [np.cumsum(c) for c in counts]
    link_text = np.searchsorted(text_ends[0], link_a, "right")
    n_links = np.bincount(link_text, minlength=len(kept))

    # Tokens in the order of the groups: those of A first, then those of B.
    total = len(flat[0]) + len(flat[1])
    line = np.zeros(total, dtype=np.int64)
    last_a, last_b = np.zeros(len(flat[0]), dtype=bool), np.zeros(len(flat[1]), dtype=bool)
    last_a[link_a], last_b[link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    marks = np.where(last_b, 2, 0)
    if len(kept):
        marks[text_ends[1] - 1] = 3
        line[np.arange(len(flat[0])) + np.concatenate([[0], link_b + 1])[group_a]] = flat[0] + own.ids * last_a
        line[np.arange(len(flat[1])) + (link_a + 1)[group_b]] = flat[1] + own.ids * marks
    digests = [""] * many
    begin = 0
    for n, end in zip(kept, (text_ends[0] + text_ends[1]).tolist(), strict=True):
        digests[n] = hashlib.sha256(b"".join(map(own.texts.__getitem__, line[begin:end].tolist()))).hexdigest()
        begin = end

    square = own.ids * own.ids
    distinct, times = np.unique(link_text * square + flat[0][link_a] * own.ids + flat[1][link_b], return_counts=True)
    per_text = np.bincount(kept_at[distinct // square], minlength=many) if len(kept) else np.zeros(many, dtype=np.int64)

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(many, dtype=np.int64)
        out[kept_at] = values
        return out

    return {
        "n_a": spread(counts[0]),
        "n_b": spread(counts[1]),
        "n_groups": spread(n_links),
        "n_links": spread(n_links),
        "groups_sha256": digests,
        "pairs": distinct % square,
        "times": times,
        "offsets": np.concatenate([[0], np.cumsum(per_text)]),
    }


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with no more than ``TEXT_BYTES``, or a single row."""
    begin, held = 0, 0
    for n, size in enumerate(sizes):
        if n > begin and (held + size > TEXT_BYTES or n - begin == 1024):
            yield begin, n
            begin, held = n, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def aligned(docs: DataFrame, files: tuple[bytes, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row, doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)`` per document; ``row`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers_of(*files)
        base, number = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _parts([len(t or "") for t in texts]):
                found = align(texts[begin:end], own)
                rows = pa.array(np.arange(number, number + end - begin, dtype=np.int64) + base)
                number += end - begin
                offsets = pa.array(found["offsets"].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c])) for c in ("pairs", "times")]
                plain = [pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(begin, end - begin), *plain, *lists], names=_NAMES)

    chosen = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return chosen.mapInArrow(
        run, f"row long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    )


_NAMES = ["row", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(found: DataFrame, ids: int) -> DataFrame:
    """``(pair, c, best)``: how often a pair is linked in all documents, and whether no pair of its id of B is more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            held = np.concatenate([pairs, _flat(batch.column(0))])
            weights = np.concatenate([times, _flat(batch.column(1))])
            pairs, at = np.unique(held, return_inverse=True)
            times = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(times, at, weights)
            if len(pairs) > PAIRS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "c"])
                pairs, times = pairs[:0], times[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "c"])

    summed = found.select("pairs", "times").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    summed = materialize(summed.withColumn("b", F.col("pair") % F.lit(ids)), "pair-sums")
    return summed.join(summed.groupBy("b").agg(F.max("c").alias("most")), "b").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabularies: str = VOCABULARIES, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A encodes a space and the text, B the text, to which it adds the space itself; strings of special tokens are ordinary text. Null and empty texts, and texts that
    one of the two cannot give back byte by byte, have zeros and an empty digest. Each token of A is linked to that of B which ends at
    the same byte. Repeated rows and keys, also null ones, are documents of their own. Other columns are not read.
    """
    files = []
    for name in (BYTES_FILE, PIECES_FILE):
        with open(f"{vocabularies}/{name}", "rb") as file:
            files.append(file.read())
    ids = tokenizers_of(*files).ids
    found = materialize(aligned(docs, tuple(files), key, text), "aligned")
    counts = materialize(pair_counts(found, ids), "pair-counts")
    least = (counts.agg(F.sum("c")).first()[0] or 0) / head
    known = counts.where(F.col("c") > least).orderBy("pair").toArrow()  # fewer than ``head``
    pairs, c, best = (known.column(n).to_numpy() for n in ("pair", "c", "best"))
    best = best.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, times = _flat(batch.column(7)), _flat(batch.column(8))
            offsets = batch.column(7).offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            at = np.searchsorted(pairs, own)
            frequent = np.zeros(len(own), dtype=bool)
            inside = at < len(pairs)
            frequent[inside] = pairs[at[inside]] == own[inside]
            hit = at[frequent]
            sums = []
            for values in (c, best):
                worth = np.zeros(len(own), dtype=np.int64)
                worth[frequent] = values[hit] * times[frequent]
                each = np.concatenate([[0], np.cumsum(worth)])
                sums.append(pa.array(each[offsets[1:]] - each[offsets[:-1]]))
            left = np.concatenate([[0], np.cumsum(~frequent)])[offsets].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~frequent])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in range(7)], *sums, *lists], names=[*_NAMES[:7], "c_sum", "best_sum", *_NAMES[7:]])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"row long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, c_sum long, best_sum long, pairs array<long>, times array<long>"
    frequent = materialize(found.mapInArrow(run, schema), "frequent-pairs")
    rare = frequent.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    sums = rare.join(counts.where(F.col("c") <= least), "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("c")).alias("c_more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more")
    )
    return frequent.join(sums, "row", "left").select(
        F.col("doc").alias(key),
        *["n_a", "n_b", "n_groups", "n_links"],
        (F.col("best_sum") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("c_sum") + F.coalesce("c_more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's alignment of a byte-level and a piece vocabulary."""
    return align_documents(table(spark, folder, "documents"))

"""Alignment of tokenizers against a plain version with both libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbscore.llm import lockstep
from plumbscore.llm.registered import table

FOLDER = lockstep.VOCABULARIES
SCHEMA = "doc_id long, text string, row string, pairs string"
EDGES = [
    None, "", " ", "   ", "a", "<|endoftext|>", "<s> </s><unk> <0x41>", "x▁y", "tabs\t\tand\r\n lines\n\n\n", "\x00 null", "it's we'll 'S",
    "日本語 漢字かな", "🙂🙃 👩‍👩‍👧 é", "ﬁ ﬂ ½    x", "word " * 30_000, "a" * 20_000, "same text", "same text", " lead", "trail ", "  two  gaps   ", "﻿bom",
]


def plain(texts):
    a = Tokenizer.from_file(f"{FOLDER}/{lockstep.BYTES_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{lockstep.PIECES_FILE}")
    alphabet = lockstep.byte_alphabet()
    found, counts = [], Counter()
    for text in texts:
        wanted = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [lockstep._piece_bytes(b.id_to_piece(i)) for i in ids_b]
        if not text or b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
            found.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        at_b = {e: n for n, e in enumerate(ends_b)}
        links = [(n, at_b[e]) for n, e in enumerate(ends_a) if e in at_b]
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(pairs)
        found.append((len(ids_a), len(ids_b), len(links), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return [(n_a, n_b, n, n, sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest) for n_a, n_b, n, pairs, digest in found]


@pytest.mark.parametrize("head", [50_000, 20])
def test_equals_plain_alignment(spark, folder, head, monkeypatch):
    monkeypatch.setattr(lockstep, "PAIRS_AT_ONCE", 500)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    rows += [(1000 + n, t) for n, t in enumerate(EDGES)]
    docs = spark.createDataFrame([(i, t, "r", "p") for i, t in [*rows, (None, "a b")]], SCHEMA).repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in lockstep.align_documents(docs, head=head).collect()}
    wanted = plain([t for _, t in rows] + ["a b"])
    assert len(found) == len(rows) + 1
    for (i, text), line in zip([*rows, (None, "a b")], wanted, strict=True):
        assert found[i] == line, (i, text)


def test_ranks_and_library_agree():
    with open(f"{FOLDER}/{lockstep.BYTES_FILE}", "rb") as file:
        content = file.read()
    with open(f"{FOLDER}/{lockstep.PIECES_FILE}", "rb") as file:
        own = lockstep.tokenizers_of(content, file.read())
    texts = [" " + t for t in EDGES if t]
    assert own._by_library(content)(texts) == own.encode_a(texts)


def test_stretches_do_not_matter():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 60, 5)
        ends, counts = [[], []], [[], []]
        base = 0
        for size in sizes:
            for side in (0, 1):
                cut = np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size))
                ends[side].append(cut + base)
                counts[side].append(len(cut))
            base += size
        a, b = (np.concatenate(x) for x in ends)
        common = np.intersect1d(a, b)
        for stretch in (1, 3, 1000):
            link_a, link_b = lockstep.lockstep(a, b, np.array(counts[0]), stretch)
            assert (a[link_a] == common).all() and (b[link_b] == common).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lockstep.align_documents(docs.limit(0)).count() == 0
    assert tuple(lockstep.align_documents(docs).first()) == (1, 0, 0, 0, 0, 0, 0, "")

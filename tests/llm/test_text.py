"""Chat formatting, licences, fingerprints, decontamination, packing, addresses and archives."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbscore.llm import chat, decontaminate, fingerprints, licenses, packing, urls, warc
from plumbscore.session import scratch_path

TRICKY = ["", None, chat.TRAP, "<\\|im_end|>", "<\\\\|x", "<|im_sep|>", "a\n<|im_end|>\n", "<", "|>", "\\", "é\U0001f600 <<|"]


def test_chat_round_trip(spark):
    rows = [(1, n, ("user", "assistant", "assistant")[n % 3], t, "x") for n, t in enumerate(TRICKY)]
    rows += [(2, 0, "odd\nrole\\n<|im_end|>", "t", "x"), (2, 1, None, None, "x"), (None, 5, "assistant", "z", "x"), (3, None, "user", "b", "x"), (3, None, "user", "b", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    made = chat.format_conversations(turns)
    read = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert read[1] == [(r[2], r[3] or "") for r in rows[: len(TRICKY)]]
    assert read[2] == [("odd\nrole\\n<|im_end|>", "t"), ("", "")]
    assert read[None] == [("assistant", "z")] and read[3] == [("user", "b")] * 2
    found = {r["conv_id"]: r for r in chat.digests(made).collect()}
    loss = "".join(r[3] or "" for r in rows[: len(TRICKY)] if r[2] == "assistant")
    assert found[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and found[1]["loss_chars"] == len(loss)
    text = made.where("conv_id = 1").first()["formatted"]
    # Merged turns share one block.
    assert text.count(chat.START) == sum(a[2] != b[2] for a, b in itertools.pairwise(rows[: len(TRICKY)])) + 1
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    texts = [
        "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit,
        "# The MIT Licence (MIT)\n\n© 2019-2021 A & B. All rights reserved.\n" + mit.upper().replace("SUBLICENSE", "sub-licence"),
        mit + "\nOne more condition.",
        "Some prose.\n  * Released under the MIT licence!\nSPDX-License-Identifier: Apache-2.0",
        None,
        "",
        "x " * 100_000,
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")], "doc_id long, text string, digest_of string")
    rows = sorted(((r["doc_id"], r["license"], r["notices"]) for r in licenses.scan(docs, ["doc_id"]).collect()), key=lambda r: r[0])
    assert rows == [(0, "MIT", None), (1, "MIT", None), (2, None, None), (3, None, "Apache-2.0,MIT"), (3, None, "Apache-2.0,MIT"), (4, None, None), (5, None, None), (6, None, None)]
    assert licenses.scan(docs.limit(0), ["doc_id"]).count() == 0
    own = spark.createDataFrame([(t,) for t in licenses.LICENSES.values()], "t string").select("t", licenses.canonical(F.col("t")).alias("c"))
    assert all(r["c"] == licenses.canonical_text(r["t"]) for r in own.collect())


def test_fingerprint_votes_and_search(spark):
    import numpy as np

    texts = ["", None, "one", "one two three two one two", "a b " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: (r["hi"], r["lo"]) for r in fingerprints.fingerprints(rows, ["id"]).collect()}
    terms = spark.createDataFrame([("one two",), ("two three",), ("three two",), ("two one",)], "t string")
    hashes = {r[0]: (r[1], r[2]) for r in terms.select("t", F.xxhash64("t"), F.xxhash64("t", F.lit(1))).collect()}
    votes = np.zeros(128)
    words = texts[3].split()
    for a, b in itertools.pairwise(words):
        for part in (0, 1):
            h = hashes[f"{a} {b}"][part] & (2**64 - 1)
            votes[64 * part : 64 * part + 64] += [(1 if h >> i & 1 else -1) * min(15, len(f"{a} {b}")) for i in range(64)]
    value = [sum(1 << i for i in range(64) if votes[64 * p + i] > 0) for p in (0, 1)]
    assert tuple(v & (2**64 - 1) for v in found[3]) == tuple(value)
    assert found[0] == found[1] == (0, 0) and len(found) == 5

    rng = random.Random(6)
    fps = {(0, 0)}
    for _ in range(30):
        base = (rng.getrandbits(64), rng.getrandbits(64))
        for _ in range(8):
            hi, lo = base
            for _ in range(rng.randrange(6)):
                bit = rng.randrange(128)
                hi, lo = hi ^ (1 << bit - 64 if bit >= 64 else 0), lo ^ (1 << bit if bit < 64 else 0)
            fps.add((hi, lo))
    sign = lambda v: v - 2**64 if v >= 2**63 else v
    table = spark.createDataFrame([(sign(a), sign(b)) for a, b in fps], "hi long, lo long")
    apart = lambda a, b: bin(a[0] ^ b[0]).count("1") + bin(a[1] ^ b[1]).count("1")
    for radius in (0, 3, fingerprints.RADIUS, 20):
        rows = fingerprints.within(table, table, radius).collect()
        near = {((r["hi"] % 2**64, r["lo"] % 2**64), (r["other_hi"] % 2**64, r["other_lo"] % 2**64)) for r in rows}
        assert near == {(a, b) for a in fps for b in fps if apart(a, b) <= radius} and len(near) == len(rows)


@pytest.mark.parametrize("slice_rows", [1000, 3])
def test_near_fingerprints_of_documents(spark, slice_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_SLICE", slice_rows)
    monkeypatch.setattr(fingerprints, "MAX_HOT", 10**6 if slice_rows == 3 else 1000)
    rng = random.Random(8)
    words = [f"word{i}" for i in range(3000)]
    texts, pairs = [None, ""], []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.choice((60, 200, 600)))]
        edited = list(body)
        for at in rng.sample(range(len(body)), max(1, len(body) // 60)):
            edited[at] = "other"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(body), " ".join(edited)]
    texts += [texts[5], texts[2], "word1 " * 200_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no key", 1)], "doc_id long, text string, hi int")
    made = fingerprints.compare_edited(docs)
    found = {r["doc_id"]: r for r in fingerprints.near_counts(made, F.col("doc_id") % 3 == 0).collect()}
    plain = {i: int(r["fingerprint"], 16) for i, r in found.items()}
    first = {v: min(i for i, w in plain.items() if w == v and i is not None) for i, v in plain.items() if i is not None}
    links = set()
    for i, r in found.items():
        near = [(bin(plain[i] ^ v).count("1"), k) for v, k in first.items() if 0 < bin(plain[i] ^ v).count("1") <= fingerprints.RADIUS]
        if i is None or i % 3:
            assert r["n_near"] is None and r["nearest_class"] is None
        else:
            assert (r["n_near"], (r["nearest_bits"], r["nearest_class"])) == (len(near), min(near, default=(None, None)))
            links |= {(first[plain[i]], k, d) for d, k in near}
    assert {tuple(r) for r in fingerprints.near_classes(made, F.col("doc_id") % 3 == 0).collect()} == links

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    alike = [(a, b) for a, b in pairs if 10 * len(shingles(texts[a]) & shingles(texts[b])) >= 8 * len(shingles(texts[a]) | shingles(texts[b]))]
    caught = [p for p in alike if bin(plain[p[0]] ^ plain[p[1]]).count("1") <= fingerprints.RADIUS]
    assert len(alike) >= 20 and len(caught) >= 0.9 * len(alike)
    assert fingerprints.near_counts(fingerprints.compare_edited(docs.limit(0)), F.col("doc_id") % 3 == 0).count() == 0


def test_edited_texts(spark):
    rows = [(5, "abcdef"), (9, "xy"), (2, "é\U0001f600\U0001f600"), (None, "null"), (9, "xy"), (7, ""), (11, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, edited string")
    found = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprints.compare_edited(docs).collect()}
    wanted = {(5, "abc"), (9, "x"), (2, "é\U0001f600a"), (None, "nué\U0001f600"), (7, ""), (11, "")}
    size = {i: len(t or "") for i, t in rows}
    assert found == {(i, size[i], hashlib.sha256(t.encode()).hexdigest()) for i, t in wanted}
    one = fingerprints.compare_edited(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(docs).count() == len(rows)
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_decontamination_against_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr("plumbscore.operators.joins.BROADCAST_BYTES", limit)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 4, 5, 6, 9, 14, 30, 59, 59)] + ["", None]
    docs = []
    for _ in range(60):
        body = [rng.choice(words) for _ in range(rng.choice((0, 3, 40, 300)))]
        item = (rng.choice(items) or "").split()
        for _ in range(rng.choice((0, 0, 1, 3))):
            if item:
                item[rng.randrange(len(item))] = "other"
        at = rng.randrange(len(body) + 1)
        docs.append(" ".join([*body[:at], *item, *body[at:]]).upper())
    docs += [None, "", docs[0]]

    def runs(text, n):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    wanted = set()
    for i, item in enumerate(items):
        n = min(5, len((item or "").split()))
        own = runs(item, n) if n else set()
        wanted |= {(d, i) for d, t in enumerate(docs) if own and len(own & runs(t, n)) / len(own) >= 0.8}
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, words string")
    right = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, "w1 w2 w3 w4 w5", "x")], "item_id long, text string, width string")
    found = decontaminate.contaminated(left, right)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == sorted(wanted)
    kept = decontaminate.drop_contaminated(left, right)
    assert kept.columns == left.columns
    whole = {d for d, i in wanted}
    texts = {(docs[d] or "") for d in whole}
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, t in enumerate(docs) if (t or "") not in texts]
    assert decontaminate.contaminated(left.limit(0), right).count() == 0
    assert decontaminate.contaminated(left, right.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(left, right.limit(0)).count() == len(docs)


def test_a_long_text_that_repeats_an_item_is_judged_once(spark):
    item = " ".join(f"q{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"{item} " * 2000), (2, "other words " * 10_000), (3, f"{item} " * 2000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (7, "other words other words other words"), (8, "unheard of words in any text")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontaminate.contaminated(docs, items).collect())
    assert found == [(1, 7, 6, 6), (2, 7, 2, 2), (3, 7, 6, 6)]


def test_boundaries_are_optimal():
    rng = random.Random(8)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 50) for _ in lengths]
        buckets = rng.randrange(1, 5)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(padding((*cut, lengths[-1])) for k in range(min(buckets, len(lengths))) for cut in itertools.combinations(lengths[:-1], k))
        found = packing.best_boundaries(lengths, counts, buckets)
        assert len(found) <= buckets and padding(found) == best
    assert packing.best_boundaries([], [], 3) == []


def test_pack(spark):
    rows = [(i, "w " * (i % 23)) for i in range(300)] + [(None, "a b"), (7, "w " * 7), (400, None), (401, "x " * 1000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, padded string")
    found = packing.pack(docs, longest=16, buckets=4, budget=64, rows_per_slice=20).collect()
    total = sum(len((t or "").split()) for _, t in rows)
    assert sum(r["n_tokens"] for r in found) == total
    spans = {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    assert sorted(spans[401]) == [(i, 16 * i, min(16, 1000 - 16 * i)) for i in range(63)]
    assert len({r["padded"] for r in found}) == 4
    batches = {}
    for r in found:
        assert r["n_tokens"] <= r["padded"]
        batches.setdefault((r["padded"], r["batch"]), []).append(r["slot"])
    for (padded, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * padded <= max(64, padded)
        last = max(b for p, b in batches if p == padded)
        assert batch == last or len(slots) == max(1, 64 // padded)
    assert packing.pack(docs.limit(0)).count() == 0


def test_addresses(spark):
    rows = {
        "https://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "http://badexample.org/en/123": ("badexample.org", "/en/123", "org/", "allow"),
        "x://shop.com/de/?q": ("shop.com", "/de/", "com/de/", "block"),
        "x://com/fr": ("com", "/fr", None, None),
        "no scheme/fr/": ("", "", None, None),
        "http://Ünï.net": ("Ünï.net", "", None, None),
        "a://b?c://d/e": ("b", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    pages = spark.createDataFrame([(n, u, "x") for n, u in enumerate(rows)], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in urls.judge(pages, urls.RULES).collect()}
    assert len(found) == len(rows)
    for n, (host, path, rule, verdict) in enumerate(rows.values()):
        assert (found[n]["host"], found[n]["path"], found[n]["rule"]) == (host, path, rule)
        assert found[n]["verdict"] in ("allow", "block") and (verdict is None or found[n]["verdict"] == verdict)
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_templates_learn_from_rules(spark):
    rows = [f"http://h.net/ads/{i}/x" for i in range(40)] + [f"http://h.net/news/item-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows += [f"http://h.net/ads/{100 + i}/y" for i in range(5)] + ["http://h.net/news/zz-top"]
    rules = [("h.net", f"/ads/{i}/", "block") for i in range(40)] + [("h.net", "/news/item", "allow")]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert all(found[i]["verdict"] == "block" and found[i]["template"].startswith("/ads/{number}") for i in range(100, 105))
    assert found[105]["verdict"] == "allow" and found[105]["template"] == "/news/*"


def test_templates_reach_the_last_segment(spark):
    deep = "/".join("abcdefghi")
    rows = [f"http://h.net/{deep}/ads/{i}" for i in range(30)] + [f"http://h.net/{deep}/news/{i}" for i in range(60)]
    rows += [f"http://h.net/{deep}/ads/100", f"http://h.net/{deep}/news/100"]
    rules = [("h.net", f"/{deep}/ads/{i}", "block") for i in range(20, 30)] + [("h.net", f"/{deep}/news/{i}", "allow") for i in range(20, 60)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert len(found) == len(rows)
    assert (found[90]["template"], found[90]["verdict"]) == (f"/{deep}/ads/{{number}}", "block")
    assert (found[91]["template"], found[91]["verdict"]) == (f"/{deep}/news/{{number}}", "allow")


def _archive(spark, rows, **spec):
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([(i, u, t, "x") for i, u, t in rows], "page_id long, url string, html string, payload string")
    return path, warc.write_archives(pages.repartition(3), path, warc.WarcSpec(**spec))


def test_archives_round_trip_and_roll(spark):
    rng = random.Random(9)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcé<>\r\n", k=rng.randrange(400)))) for i in range(200)]
    rows += [(1000 + i, "http://copy/\r\nX: y", "same " * 50) for i in range(30)]
    rows += [(None, None, "same " * 50), (2000, "u", None), (2001, "u", ""), (3, "again", "same " * 50), (-5, "n", "é" * 100_000)]
    path, manifest = _archive(spark, rows, rows_per_shard=40, roll_bytes=6000)
    again_path, again = _archive(spark, list(reversed(rows)), rows_per_shard=40, roll_bytes=6000)
    kept = lambda m: sorted((r["file"], r["bytes"], r["sha256"], r["records"]) for r in m.collect())
    assert kept(manifest) == kept(again)
    files = manifest.collect()
    assert len(files) > 6 and sum(r["records"] for r in files) == len(rows)
    assert all(r["bytes"] <= 6000 or r["records"] == 1 for r in files)
    fs, folder = warc.filesystem(path)
    import pyarrow.fs as pfs

    present = {x.base_name for x in fs.get_file_info(pfs.FileSelector(folder)) if x.is_file}
    assert present == {r["file"] for r in files}
    found = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(found) == len(rows) == len({r["record_id"] for r in found})
    largest = {}
    for i, _, t in rows:
        largest[t or ""] = max(largest.get(t or "", -(10**9)), -(10**9) if i is None else i)
    wanted = []
    for i, _, t in rows:
        body = (t or "").encode()
        first = largest[t or ""] == i
        wanted.append((i, len(body), warc.base32_sha1(body), "response" if first else "revisit", None if first else largest[t or ""], body if first else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_archives_small_payloads_and_empty_table(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (4, "u", "abc")]
    path, _ = _archive(spark, rows, min_revisit_bytes=3)
    found = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in warc.read_archives(spark, path).collect())
    assert found == [(1, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (4, "response", 0)]
    path, manifest = _archive(spark, [(1, "u", "ab")])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    empty = scratch_path(spark, "warc")
    assert warc.write_archives(pages, empty).count() == 0 and warc.read_archives(spark, empty).count() == 0
    data = warc._record({"page_id": 1, "url": "u", "payload": b"ab", "payload_bytes": 2, "sha1": hashlib.sha1(b"ab").hexdigest(), "refers_to": None, "refers_to_url": None}, 0, warc.WarcSpec())
    assert warc.parse_record(data)["payload"] == b"ab"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(data.replace(b"ab\r\n\r\n", b"ax\r\n\r\n"))


@pytest.mark.parametrize("bins", [4096, 16])
def test_shards_with_keys_far_apart(spark, bins, monkeypatch):
    monkeypatch.setattr(warc, "BINS", bins)
    keys = [*range(2000), 2**62, -(2**63), *[700] * 350, None, None]
    rows = spark.createDataFrame([(k, f"u{i}", "x") for i, k in enumerate(keys)], "page_id long, url string, sha1 string")
    placed, shards = warc._sharded(rows, 100)
    found = placed.collect()
    assert sorted(placed.columns) == sorted([*rows.columns, "shard"]) and sorted(r["url"] for r in found) == sorted(f"u{i}" for i in range(len(keys)))
    sizes, spans = {}, {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
        if r["page_id"] != 700:
            spans.setdefault(r["shard"], []).append(-(2**64) if r["page_id"] is None else r["page_id"])
    assert max(sizes) < shards
    ordered = [spans[n] for n in sorted(spans)]
    assert all(max(a) < min(b) for a, b in itertools.pairwise(ordered))
    # With few bins a bin may hold a fourth of all rows before it is cut by key.
    assert max(sizes.values()) <= (200 if bins == 4096 else 600)

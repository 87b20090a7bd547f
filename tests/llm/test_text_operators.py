"""Operators on one text at a time, against brute force and the tokenizer libraries."""

import base64
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm import bpe, merging, ogg, pu_quality, repetition, token_counts

BPE_JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["a", "b", " ", " ", "\n", "\t", "'s", "'ll", "the ", " tion", "é", "中", "🙂", "\x1c", "\x85", "　", "12", "#$%", "<|endoftext|>", "<|", "aaaa", "x" * 30]


def random_texts(n, seed=5, pieces=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, pieces))) for _ in range(n)]


#: null, empty, blank, one very long word, one very long text, repeated rows
EDGES = [None, "", "   ", "\n\n", "q" * 70_000, "word and line\n" * 6_000, "same", "same"]


def documents(spark, texts, first=0):
    """With a null in every other column and extra columns whose names clash with outputs."""
    rows = [(first + i, t, None if i % 3 else "s", "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, TEXT_ string, n_tokens int").withColumnRenamed("TEXT_", "Text").repartition(3)


def test_repetition_against_brute_force(spark):
    texts = EDGES + random_texts(150) + ["a b c " * 40, "l1 x\nl2\nl1 x\n" * 9, " ".join(f"w{i}" for i in range(80))]

    def base(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [line for line in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x or ""), len(lines) - len(set(lines)), len(inside), failed

    def cover(x, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {i + k for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for k in range(n)}
        return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))

    got = {r["doc_id"]: r for r in repetition.repetition_rules(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(x), i
        covers = {n: cover(x, n) for n in repetition.NGRAM_LIMITS}
        for n, c in covers.items():
            assert r[f"cover_{n}"] == pytest.approx(c)
        assert r["kept"] == (not r["base_failed"] and r["line_cover"] <= repetition.LINE_LIMIT and all(c <= repetition.NGRAM_LIMITS[n] for n, c in covers.items()))
    kept = repetition.keep_rows(documents(spark, texts))
    assert kept.columns == ["doc_id", "text", "source", "Text", "n_tokens"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_coverage_rules_reject_what_the_base_check_passes(spark):
    new = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    twice = lambda n: f"{new('p', n)} {new('a', 60)} {new('p', n)} {new('b', 140 - 2 * n)}"
    lines = "".join(f"u{i} v{i} w{i}\nsame line\n" for i in range(40))  # no repeated run of three words
    texts = {"clean": new("w", 200), "mild": twice(6), "moderate": twice(30), "ten": twice(13), "lines": lines}
    got = {name: r for name, r in zip(texts, sorted(repetition.repetition_rules(documents(spark, list(texts.values()))).collect(), key=lambda r: r["doc_id"]), strict=True)}
    assert not any(r["base_failed"] for r in got.values())
    assert got["ten"]["cover_5"] == got["ten"]["cover_10"] and 0.1 < got["ten"]["cover_10"] < 0.15
    assert got["lines"]["cover_5"] == 0 and 0.2 < got["lines"]["line_cover"] < 0.5
    assert {name: r["kept"] for name, r in got.items()} == {"clean": True, "mild": True, "moderate": False, "ten": False, "lines": False}


def test_token_counts_equal_the_library(spark):
    texts = EDGES + random_texts(300) + ["<|endoftext|>" * 3, "".join(random.Random(1).choice("abcdefgh") for _ in range(9000))]
    library = Tokenizer.from_file(BPE_JSON)
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark, texts), BPE_JSON, P.PATTERN).collect()}
    for i, x in enumerate(texts):
        assert got[i]["n_tokens"] == len(library.encode(x or "", add_special_tokens=False).ids), i
        assert got[i]["n_bytes"] == len((x or "").encode())


def plain_bpe(ranks, text):
    """Piece by piece, one merge after the other."""
    out = []
    for piece in regex.findall(P.PATTERN, text):
        parts = [bytes([x]) for x in piece.encode()]
        if piece.encode() in ranks:
            parts = [piece.encode()]
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[x] for x in parts]
    return out


@pytest.mark.parametrize("chunk, overlap", [(bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (200, 90)])
def test_bpe_equals_the_library_and_round_trips(spark, chunk, overlap):
    texts = EDGES + random_texts(300) + random_texts(3, seed=8, pieces=30_000)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert max(map(len, texts[-3:])) > 100 * 200  # cut into over 100 of the small chunks
    df = documents(spark, texts)
    coded = {r["doc_id"]: r for r in bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
    digests = {r["doc_id"]: r for r in bpe.digests(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert len(coded) == len(digests) == len(texts)
    for i, x in enumerate(texts):
        ids = library.encode_ordinary(x or "")
        if len(x or "") < 300:
            assert ids == plain_bpe(ranks, x or "")
        assert np.frombuffer(coded[i]["token_ids"], "<u4").tolist() == ids
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()


def test_bpe_repeated_long_rows_and_clashing_columns(spark):
    long, stuck = random_texts(1, seed=3, pieces=3000)[0], "q" * 3000 + " end"
    rows = [(1, long, 5, "a"), (1, long, 6, "b"), (None, long, 5, "a"), (1, stuck, 0, "c"), (1, stuck, 0, "c"), (2, "short", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, mark string")
    got = bpe.encode(df, RANKS, P.PATTERN, chunk=500, overlap=100).collect()
    decoded = sorted(((r["doc_id"], bpe.codec(RANKS, P.PATTERN).decode(r["token_ids"]).decode()) for r in got), key=str)
    assert decoded == sorted([(i, t) for i, t, _, _ in rows], key=str)


def test_bpe_texts_without_a_seam_are_not_exchanged_again(spark):
    easy = random_texts(4, seed=4, pieces=3000)
    stuck = ["q" * 3000 + " end", "start " + "🙂" * 2000, "é" * 700 + " words" * 500 + "\n" * 900 + "中" * 900, easy[0] + "#" * 1200 + easy[1]]
    pattern = regex.compile(P.PATTERN)
    assert all(bpe.stitch(pattern, x, 500, 100) is None for x in stuck)
    own, plans = bpe.codec(RANKS, P.PATTERN), []
    for texts in (easy, easy + stuck):
        coded = bpe.encode(documents(spark, texts), RANKS, P.PATTERN, chunk=500, overlap=100)
        plans.append(coded._jdf.queryExecution().optimizedPlan().toString())
        assert {r["doc_id"]: r["token_ids"] for r in coded.collect()} == dict(enumerate(map(bytes, own.encode(texts))))
    assert not any("Join" in x for x in plans)
    assert plans[0].count("Repartition") == plans[1].count("Repartition")


def test_chunks_stitch_to_the_same_pieces():
    pattern = regex.compile(P.PATTERN)
    texts = random_texts(300, seed=9, pieces=120) + ["a" * 500, " " * 300 + "b", "a b " * 100, "'" * 50]
    stitched = 0
    for text in texts:
        for chunk, overlap in ((64, 64), (90, 70), (200, 60), (12, 12)):
            found = bpe.stitch(pattern, text, chunk, overlap)
            assert found is None or found == pattern.findall(text), (text, chunk, overlap)
            stitched += found is not None and len(text) > chunk
    assert stitched > 300


def test_patterns_that_chunks_do_not_cover_are_refused():
    for bad in (r"(a)|.", r"(?<=a)b|.", r"\bfoo|.", r"^a|.", r"a(?=.*b)|.", r"\s|\S+?(?=x+y)|\S"):
        with pytest.raises(ValueError):
            bpe.checked(bad)
    with pytest.raises(ValueError):
        bpe.checked(r"\p{L}+")  # leaves characters out
    usual = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    pattern = bpe.checked(usual)
    for text in random_texts(400, seed=2, pieces=90):
        found = bpe.stitch(pattern, text, 80, 60)
        assert found is None or found == pattern.findall(text)


def test_merging_equals_one_merge_after_the_other():
    """Also with ranks in any order, where merging all places at once would be wrong."""
    for trial in range(60):
        rng = random.Random(trial)
        rules, made = {}, 5
        for _ in range(12):
            pair = rng.randrange(made), rng.randrange(made)
            if pair not in rules:
                rules[pair], made = made, made + 1
        ranks = rng.sample(range(len(rules)), len(rules))
        ranked = {pair: (rank, new) for (pair, new), rank in zip(rules.items(), ranks, strict=True)}
        pairs = merging.Pairs([(*pair, *v) for pair, v in ranked.items()], made)
        sequences = [[rng.randrange(5 if rng.random() < 0.8 else 2) for _ in range(rng.randint(0, 25))] for _ in range(40)]
        flat, lengths = np.array(sum(sequences, []), np.int64), np.array([len(x) for x in sequences])
        ids, left = merging.merge_all(pairs, flat, lengths)
        for got, x in zip(np.split(ids, np.cumsum(left)[:-1]), sequences, strict=True):
            one = merging.one_by_one(pairs, np.array(x, np.int64)).tolist()
            while found := [(ranked[p][0], i) for i, p in enumerate(zip(x, x[1:])) if p in ranked]:
                _, i = min(found)
                x[i : i + 2] = [ranked[x[i], x[i + 1]][1]]
            assert got.tolist() == one == x
    empty = merging.merge_all(pairs, np.zeros(0, np.int64), np.zeros(3, np.int64))
    assert empty[0].size == 0 and empty[1].tolist() == [0, 0, 0]


def test_files_of_another_kind_are_refused(tmp_path):
    with open(BPE_JSON, encoding="utf-8") as f:
        spec = json.load(f)
    token_counts.check_plain(spec, P.PATTERN)
    changes = [("model", {**spec["model"], "ignore_merges": True}), ("model", {**spec["model"], "byte_fallback": True}), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {**spec["pre_tokenizer"], "add_prefix_space": True})]
    for key, value in changes:
        with pytest.raises(ValueError):
            token_counts.check_plain({**spec, key: value}, P.PATTERN)
    with pytest.raises(ValueError):
        token_counts.check_plain(spec, r"\S+|\s+")


def slow_crc(page):
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_damage():
    rng = random.Random(2)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_crc(data)
    payload = ogg.padded(rng.randbytes(200_000) + b"OggS" * 10)
    media = ogg.store(payload)
    streams = ogg.read(media)
    assert ogg.samples(streams) == payload and len(streams) == 2
    assert all(s.ended and not s.bad_pages and not s.gaps for s in streams.values())
    assert max(len(p[5]) for p in ogg.pages(media)) == 255  # a packet goes on over pages
    broken = bytearray(media)
    broken[len(broken) // 2] ^= 1
    hurt = ogg.read(bytes(broken))
    assert sum(s.bad_pages for s in hurt.values()) == 1 and sum(s.gaps for s in hurt.values()) == 1
    assert ogg.samples(hurt) != payload and payload.startswith(ogg.samples(hurt)[:16_000])
    assert ogg.read(None) == {} and ogg.read(b"noise") == {} and ogg.read(media[:40]) == {}


def test_ogg_round_trip(spark):
    texts = EDGES + random_texts(60) + ["x" * 64, "x" * 65]
    got = {r["doc_id"]: r for r in ogg.round_trip(documents(spark, texts)).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    same = [got[i] for i, x in enumerate(texts) if x == "same"]
    assert same[0][1:] == same[1][1:]
    media = ogg.with_media(documents(spark, texts))
    packets = ogg.read_media(media).where("packet > 0").collect()
    assert sum(len(r["data"]) for r in packets if r["doc_id"] == 4 and len(r["data"]) > 12) == 70_016
    assert all(r["end_ms"] is not None for r in packets)


def brute_pages(media):
    """(serial, granule, packets that end here, bytes) of each page, by the format's description."""
    at, out = 0, []
    while at < len(media):
        assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
        granule, serial = int.from_bytes(media[at + 6 : at + 14], "little", signed=True), int.from_bytes(media[at + 14 : at + 18], "little")
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(lacing)
        assert int.from_bytes(media[at + 22 : at + 26], "little") == slow_crc(media[at : at + 22] + bytes(4) + media[at + 26 : body + sum(lacing)])
        out.append((serial, granule, lacing, media[body : body + sum(lacing)]))
        at = body + sum(lacing)
    return out


def test_ogg_pages_times_and_features_by_an_independent_reader():
    rng = random.Random(7)
    for n in (64, 640, 16_000, 16_064, 300_032):
        payload = rng.randbytes(n)
        media = ogg.store(payload)
        packets, times = {}, {}
        for serial, granule, lacing, body in brute_pages(media):
            own = packets.setdefault(serial, [b""])
            at = 0
            for value in lacing:
                own[-1] += body[at : at + value]
                at += value
                if value < 255:
                    own.append(b"")
            if granule >= 0:
                times.setdefault(serial, []).append((len(own) - 1, granule))
        streams = ogg.read(media)
        assert {k: v[:-1] for k, v in packets.items()} == {k: s.packets for k, s in streams.items()}
        assert times == {k: s.times for k, s in streams.items()}
        line = ogg.feature(streams).split(";")[0]
        x = [b - 128 for b in payload]
        assert f"ms={n * 1000 // 8000}" in line and f"peak={max(map(abs, x))}" in line
        assert f"change={sum(abs(b - a) for a, b in zip(x, x[1:]))}" in line
        assert "lags=" + ".".join(str(sum(a * b for a, b in zip(x, x[k:]))) for k in (1, 2, 3)) in line
        assert "bins=" + ".".join(str(sum(b // 16 == k for b in payload)) for k in range(16)) in line
        crossings = lambda y: sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
        windows = line.split("windows=")[1].split("|")
        ends = [t for _, t in next(iter(times.values())) if t]
        assert [int(w.split(":")[0]) for w in windows] == [t * 1000 // 8000 for t in ends]
        assert [int(w.split("/")[1]) for w in windows] == [crossings(x[a:b]) for a, b in zip([0, *ends], ends)]


def test_ogg_features_tell_texts_of_one_length_apart():
    words = ["alpha", "beta.", "gamma", "delta"]
    texts = {" ".join(p) for p in itertools.permutations(words)}
    assert len({ogg.feature(ogg.read(ogg.store(ogg.padded(t.encode())))) for t in texts}) == len(texts) == 24


def test_pu_classifier(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "ti", "on", "er"]) for _ in range(rng.randint(1, 3)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randint(3, 9)))
    bad = lambda: " ".join(word().upper() + rng.choice(["!!", "%%%", " |"]) for _ in range(60))
    quality = [int(rng.random() < 0.7) for _ in range(1500)]
    docs = documents(spark, [good() if q else bad() for q in quality] + EDGES)
    labelled = [(i, q, 0) for i, q in enumerate(quality) if i % 2]
    labels = spark.createDataFrame(labelled + [(None, 1, 0), (5_000, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = pu_quality.fitted(docs, labels)
    got = {r["doc_id"]: r for r in pu_quality.score(docs, model).collect()}
    assert len(got) == 1500 + len(EDGES)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in range(1500) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == quality[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[1500]["score"] == got[1501]["score"] == got[1502]["score"] == 0
    # neither held-out labels nor labelled negatives have any influence, nor has the partitioning
    other = [(i, 1 - q if got[i]["held_out"] else q, 0) for i, q, _ in labelled if q or got[i]["held_out"]]
    again = pu_quality.fitted(docs.repartition(7), spark.createDataFrame(other, "doc_id long, quality int, toxic int"))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.mean, model.mean)
    assert sorted(map(tuple, pu_quality.fit_and_score(docs, labels).collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    kept = pu_quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_pu_risk_and_its_derivatives_by_brute_force():
    rng = np.random.default_rng(3)
    k = len(pu_quality.FEATURES)
    web, good = rng.normal(size=(400, k)).astype(np.float32), (rng.normal(size=(50, k)) + 0.5).astype(np.float32)
    blank = pu_quality.Model(np.zeros(k), np.ones(k), np.zeros(k + 1))
    u, p = (blank.design(x) / 256 for x in (web, good))
    loss = lambda g: np.log1p(np.exp(-g))

    def brute(w, prior):
        negative = loss(-(u @ w)).mean() - prior * loss(-(p @ w)).mean()
        return prior * loss(p @ w).mean() + max(0.0, negative), negative

    for scale in (0.0, 0.1, 0.3):
        w = np.rint(rng.normal(size=k + 1) * scale * 65536) / 65536
        t = pu_quality.terms(pu_quality.loss_sums(pu_quality.Model(blank.mean, blank.scale, w), web).tolist())
        for prior in (0.2, 0.5):
            value, negative, gradient, hessian = pu_quality.pu_risk(t, p, w, prior)
            assert value == pytest.approx(brute(w, prior)[0], abs=1e-3) and negative == pytest.approx(brute(w, prior)[1], abs=1e-3)
            if negative > 0.01:
                e = 1e-4 * np.eye(k + 1)
                slope = [(brute(w + x, prior)[0] - brute(w - x, prior)[0]) / 2e-4 for x in e]
                assert gradient == pytest.approx(np.array(slope), abs=2e-3)
            s = 1 / (1 + np.exp(-(u @ w)))
            assert hessian == pytest.approx((u * (s * (1 - s))[:, None]).T @ u / len(u), abs=2e-3)
        far = 20 * np.ones(k + 1) * np.sign(p.mean(axis=0))
        assert pu_quality.pu_risk(pu_quality.Terms(0.0, t.gradient, t.hessian), p, far, 0.9)[1] < 0  # the side below 0 is cut


def test_pu_minimum_and_prior():
    rng = np.random.default_rng(5)
    k = len(pu_quality.FEATURES)
    kind = rng.random(4000) < 0.6
    x = rng.normal(size=(4000, k)).astype(np.float32)
    x[kind, 0] += 6  # positives stand apart
    x[:, pu_quality.FEATURES.index("no_words")] = 0
    sums = lambda fn: sum(fn(x[i : i + 900]) for i in range(0, 4000, 900)).tolist()
    model, prior = pu_quality.fit(sums, x[:3000][kind[:3000]][:800])
    assert prior == pytest.approx(kind.mean(), abs=0.03)
    assert ((model.score(x) >= 0.5) == kind).mean() > 0.99
    assert pu_quality.fit(lambda fn: fn(x).tolist(), x[:3000][kind[:3000]][:800])[0].weights.tolist() == model.weights.tolist()


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert repetition.repetition_rules(docs).count() == repetition.keep_rows(docs).count() == 0
    assert token_counts.token_counts(docs, BPE_JSON, P.PATTERN).count() == 0
    assert bpe.digests(docs, RANKS, P.PATTERN).count() == ogg.round_trip(docs).count() == 0
    assert pu_quality.score(docs, pu_quality.fitted(docs, labels)).count() == 0
    assert pu_quality.score(documents(spark, ["x y"]), pu_quality.fitted(documents(spark, ["x y"]), labels)).first()["score"] == 0.5

"""Operators across rows, against brute force on small tables."""

import base64
import hashlib
import math
import os
import random
import re
import types

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from spanloom.llm.common import Scratch, shared_dir
from spanloom.llm import bpe, chat, components, license_texts, licenses, mixing, neardup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), id_), id_)
    return [(id_, len(sets[i]), least[root(i)]) for i, (id_, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n ", "one", "ONE", "one two three", "one two three four"]
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 160))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(rng.randint(5, 90)))]) for _ in range(25)]
    texts += [texts[20].upper(), texts[20], texts[20]]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("block, shingles", [(512, 1 << 20), (4, 1 << 20), (512, 60)])
def test_near_duplicates_against_all_pairs(spark, near_rows, block, shingles, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(neardup, "LOT_SHINGLES", 4 * shingles)
    df = spark.createDataFrame([(i, t, 5, None) for i, t in near_rows], "doc_id long, text string, component_id int, band string").repartition(3)
    how = neardup.Shingling(words=4, percent=80)
    rows = neardup.near_duplicates(df, how).collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert got == sorted(brute_groups(near_rows, 4))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    if block == 4:
        kept = neardup.keep_first(df, how)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in got if i == c)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b c d e")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(df).collect()))
    assert got == [(-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == neardup.keep_first(df.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    one, two, three = ("".join(f" {p}{i}" for i in range(30)) for p in "abc")
    rows = [(5, one), (5, two), (5, ""), (5, one), (3, two + " more"), (9, one + " end"), (8, three), (2, three), (8, three.upper()), (1, None)]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 3), (5, 5), (3, 3), (9, 3), (8, 2), (2, 2), (1, 1)}  # the empty row of 5 has no shingles


def test_near_duplicates_leave_no_files_but_what_the_result_reads(spark):
    rows = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(30)) + f" z{i}") for i in range(60)]
    df = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    roots = {os.path.dirname(os.path.dirname(f.removeprefix("file://"))) for f in df.inputFiles()}
    assert len(roots) == 1 and sorted(x.split("-")[1] for x in os.listdir(roots.pop())) == ["groups", "seen"]


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda *_: None)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(RuntimeError):
        shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_superminhash_estimates_jaccard_and_stops_early():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(120):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        other = rng.integers(0, 2**63, rng.integers(5, 200)).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([base[: 300 - other.size], other]))
        one, two = neardup.signatures([a, b])
        both = np.intersect1d(a, b).size
        errors.append((one == two).mean() - both / (a.size + b.size - both))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045
    small = neardup.signatures([np.array([5], np.uint64), np.zeros(0, np.uint64)])
    assert sorted((small[0] >> np.uint64(32)).tolist()) == list(range(neardup.SLOTS))  # one element visits each slot once
    assert (small[1] == neardup._EMPTY).all()


def test_shingle_sets_are_exact():
    texts = ["", "a", "A b", "à É x y z", "a b c d a b c d", "x " * 50]
    sets = neardup.shingle_sets(pa.array(texts, pa.large_string()), 4)
    assert [s.size for s in sets] == [len(shingles(t, 4)) for t in texts]
    sliced = neardup.shingle_sets(pa.array(["junk Here", *texts]).slice(1).cast(pa.large_string()), 4)
    assert all(np.array_equal(a, b) for a, b in zip(sets, sliced, strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 1), (3, 3), (2, 9), (None, 4), (50, 40), (40, 60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1, 9: 1, 40: 40, 50: 40, 60: 40}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shape", ["rising", "falling", "turned", "random"])
def test_components_of_long_chains_take_few_rounds(spark, shape):
    n = 2000
    path = list(range(1, n + 1))
    if shape == "falling":
        path.reverse()
    elif shape == "turned":
        path = [1, *range(n, 1, -1)]
    elif shape == "random":
        random.Random(5).shuffle(path)
    scratch = Scratch(spark, "chain")
    labels = components.components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"), scratch)
    assert labels.count() == n and labels.where("component != 1").isEmpty()
    assert scratch.made <= 2 * math.log2(n) + 3  # each written round: labels, edges, and the composed result


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((60, 25), (300, 290)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = {x: x for e in edges for x in e if e[0] != e[1]}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            if a != b:
                one, two = sorted((root(a), root(b)))
                up[two] = one
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: root(x) for x in up}


def conversations():
    rng = random.Random(3)
    texts = ["", None, chat.PROBE_TEXT, "a<|b", "<\\|x", "<\\\\|", "<|nl|>", "plain é🙂", "two\nlines", chat.STOP + "\n", "<"]
    roles = ["user", "assistant", "system", None, "odd\nrole", "<|im_start|>"]
    rows = []
    for c in range(60):
        if c % 3 and rows:  # goes on from an earlier conversation
            old = rng.randrange(c)
            rows += [(c, t, r, x, "e") for d, t, r, x, _ in list(rows) if d == old and t < 3]
        rows += [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}", "e") for t in range(3, 3 + rng.randint(0, 4))]
    rows += [(70, 0, "user", "x", "e"), (70, 0, "user", "x", "e"), (71, None, "user", "x", "e"), (None, 0, "user", "lost", "e")]
    return rows


@pytest.mark.parametrize("pack_chars", [1 << 20, 300])
def test_chat_round_trip(spark, pack_chars):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pack string").repartition(3)
    segments = chat.format_conversations(chat.gathered(df), pack_chars)
    got = {r["conv_id"]: r for r in chat.read_conversations(segments).collect()}
    expected = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((r or "", x or ""))
    assert got.keys() == expected.keys()
    for c, turns in expected.items():
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        learned = "".join(x for r, x in turns if r == "assistant")
        whole = "".join(chat.render(r, x)[0] for r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest()), c
        assert got[c]["formatted_chars"] == len(whole)
    # in a pack, a shared beginning is written once, and ancestors lie before the segment
    packs = {}
    for r in segments.collect():
        packs.setdefault(r["pack"], []).append(r)
    for own in packs.values():
        own.sort(key=lambda r: r["seq"])
        paths = {tuple(turns[: k + 1]) for r in own for turns in [expected[r["conv_id"]]] for k in range(len(turns))}
        assert sum(len(r["text"]) for r in own) == sum(len(chat.render(*p[-1])[0]) for p in paths)
        for r in own:
            assert all(s["stop"] <= r["start"] for s in r["ancestors"])
            assert sum(s["stop"] - s["start"] for s in r["ancestors"]) == r["position"]


def test_chat_tokens(spark):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.codec(ranks, P.PATTERN)
    segments = chat.format_conversations(chat.gathered(spark.createDataFrame([r[:4] for r in conversations()], "conv_id long, turn long, role string, text string")), 3000)
    texts = {(r["pack"], r["seq"]): r for r in segments.collect()}
    whole = {(r["conv_id"], r["n_turns"], r["formatted_chars"]) for r in chat.read_conversations(segments).collect()}
    packs = {}
    for r in chat.tokenized(segments, ranks, P.PATTERN).collect():
        packs.setdefault(r["pack"], []).append(r)
    bytes_of = lambda ids: own.decode(np.array(ids, "<u4").tobytes())
    seen = set()
    for rows in packs.values():
        rows.sort(key=lambda r: r["seq"])
        laid = [t for r in rows for t in r["token_ids"]]  # a pack's tokens, each once
        for r in rows:
            text = texts[r["pack"], r["seq"]]
            assert laid[r["start"] : r["start"] + len(r["token_ids"])] == r["token_ids"] and bytes_of(r["token_ids"]).decode() == text["text"]
            before = [t for x in r["ancestors"] for t in laid[x["start"] : x["stop"]]]
            assert all(x["stop"] <= r["start"] for x in r["ancestors"])
            assert r["positions"] == list(range(len(before), len(before) + len(r["token_ids"])))
            formatted = bytes_of(before + r["token_ids"]).decode()
            seen.add((r["conv_id"], len(chat.parse(formatted)), len(formatted)))
            learned = [bytes_of(r["token_ids"][x["start"] : x["stop"]]).decode() for x in r["loss"]]
            assert learned == [text["text"][x["start"] : x["stop"]] for x in text["loss"] if x["stop"] > x["start"]]
    assert seen == whole and len(packs) > 1


def test_chat_edges(spark):
    """Rows without a conversation stand alone; an empty table has none; a very long text is whole."""
    long = "<|im_end|>\n" * 200_000
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (5, 0, "assistant", long), (5, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r["conv_id"] or -1, r["n_turns"], r["loss_chars"]) for r in chat.round_trip(df).collect())
    assert got == [(-1, 1, 0), (-1, 1, 0), (-1, 1, 0), (5, 2, len(long))]
    assert chat.round_trip(df.limit(0)).count() == 0
    assert chat.round_trip(chat.with_probe(spark, df.limit(0))).count() == 1


def test_chat_escapes():
    for text in ("<|", "<\\|", "<\\\\|", "<|nl|>", "a<<||", chat.START + chat.STOP, "\\|<", ""):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat_sql(spark):
    rows = [r[:4] for r in conversations() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    df = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = con.execute(chat.SQL).fetchall()
    got = [tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat.round_trip(df).collect()]
    assert sorted(got) == sorted(tuple(r) for r in expected)


def warc_record(payload):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "700"])
def test_warc_round_trip(spark, split):
    rng = random.Random(8)
    html = [None, "", "", "a", "a", "é\r\n\r\n", warc_record("x" * 30), "pre" + warc_record("y") + warc_record("z"), "WARC/1.0\r\n", "WARC/1.0\r\nWARC/1.0\r\n", "WARC/1.0", warc_record("big" * 900)]
    html += ["".join(rng.choice(["WARC/1.0\r\n", "\r\n", "\r\n\r\n", "W", "é", "Content-Length: 3\r\n", "x" * 20]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    html += html[:20]
    rows = [(i if i != 40 else None, rng.choice(["http://a/b", "x y\r\nWARC/1.0\r\n", None]), h, "extra") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_key string").repartition(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str)
        assert warc.round_trip(df.limit(0)).count() == 0
        large = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least_bytes=2).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expected = []
    for i, _, h, _ in rows:
        same = [j for j, _, g, _ in rows if (g or "") == (h or "")]
        first = min((j for j in same if j is not None), default=None)
        original = len(same) == 1 or first is None or i == first
        raw = (h or "").encode()
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if original else "revisit", None if original else first))
    assert got == sorted(expected, key=str)
    assert large[1] == large[4] == "response" and large[5 + len(html) - 20] == "revisit"


def test_pointer_jumping():
    starts, following = np.array([0, 5, 9, 20, 30]), np.array([9, 9, 20, 30, 41])
    assert warc.reachable(starts, following).tolist() == [True, False, True, True, True]
    assert warc.reachable(starts, following, 5).tolist() == [False, True, True, True, True]
    assert warc.reachable(np.array([3]), np.array([9])).tolist() == [False]
    assert warc.leaving(starts, following).tolist() == [41] * 5
    assert warc.leaving(starts, np.array([9, 7, 20, -1, 41])).tolist() == [-1, 7, -1, -1, 41]
    n = 1000
    assert warc.reachable(np.arange(n) * 2, np.arange(n) * 2 + 2).all()
    assert (warc.leaving(np.arange(n) * 2, np.arange(n) * 2 + 2) == 2 * n).all()


@pytest.mark.parametrize("constants", [20_000, 0])
def test_license_scan(spark, constants, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_CONSTANTS", constants)
    monkeypatch.setattr(licenses, "MOST_BROADCAST", constants)
    texts = license_texts.TEMPLATES
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "the", "software", "permission", "of"]) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "the software"), (4, noise(30_000)), (5, "Released under the MIT License."), (6, "released UNDER the mit license!"), (None, texts["ISC"])]
    for k, name in enumerate(texts):
        words = texts[name].split()
        rows.append((100 + k, f"{noise(rng.randint(0, 90))}\n{texts[name]}\n{noise(rng.randint(0, 90))}"))
        rows.append((200 + k, " ".join(w if rng.random() > 0.03 else "zzz" for w in words)))
        rows.append((300 + k, " ".join(words[: len(words) // 2])))
    rows += [rows[4]]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(df).collect()}

    def keys(text):
        w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", (text or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    known = {name: set(keys(t)) for name, t in texts.items()}
    expected = {}
    for id_, text in rows:
        own = keys(text)
        for name, template in known.items():
            c = len(template).bit_length() - 1
            stride = max(1, (1 << c) >> 1)
            windows = range(0, max(1, len(own)), stride)
            best = max((len(template & set(own[at : at + (1 << (c + 1)) + stride])) / len(template) for at in windows), default=0)
            if best >= licenses.CONTAINED:
                expected[id_, name] = max(best, expected.get((id_, name), 0))
    assert got == expected
    assert all((100 + k, name) in got for k, name in enumerate(texts))
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == licenses.scan(df, {"short": "four words are few"}).count() == 0


def test_license_scan_finds_templates_shorter_than_a_shingle(spark):
    rows = [(1, "All rights reserved."), (2, "some words here, then more.\nALL  RIGHTS\nreserved!"), (3, "all rights are reserved"), (4, "all rights"), (5, None), (6, "overall rights reserved")]
    rows += [(7, f"{license_texts.TEMPLATES['MIT-line']} All rights reserved. all rights reserved"), (8, "x y all rights reserved"), (8, "all rights reserved"), (None, "w " * 3000 + "all rights reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["containment"], r["first_word"]) for r in licenses.scan(df, license_texts.TEMPLATES | license_texts.SHORT_NOTICES | {"one": "Overall"}).collect()}
    notice = "All-rights-reserved"
    assert got == {
        (1, notice): (1.0, 0), (2, notice): (1.0, 3), (6, "one"): (1.0, 0), (7, "MIT-line"): (1.0, 0), (7, notice): (1.0, 3), (8, notice): (1.0, 0), (None, notice): (1.0, 2998),
    }
    with pytest.raises(ValueError, match="blank"):
        licenses.scan(df, {"blank": " ... "})


def test_license_cue_words(spark):
    _, cues = licenses.template_rows(spark, license_texts.TEMPLATES)
    assert 0 < len(cues) < 30
    for text in license_texts.TEMPLATES.values():
        w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert len({x for x in own if not set(x) & set(cues)}) / len(own) < licenses.CONTAINED


def test_mixing_equals_sql(spark):
    rng = random.Random(12)
    rows = [(i, " w" * rng.randint(0, 60), None if rng.random() < 0.1 else rng.choice("aaaaaabcé")) for i in range(900)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "only", "z"), (903, "w " * 5000, "b"), (904, "x y", "zz"), (904, "x y", "zz")]
    df = spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, key string").repartition(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    unique = [r for r in rows if r[0] != 904]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", unique)
    columns = ("doc_id", "size", "source_size", "target", "taken")
    got = [tuple(r[c] for c in columns) for r in mixing.mix(df.where("doc_id != 904")).collect()]
    expected = [tuple(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.SQL})").fetchall()]
    assert sorted(got) == sorted(expected)
    small = mixing.BUCKET_ROWS
    try:
        mixing.BUCKET_ROWS = 16  # many buckets and bins
        again = [tuple(r[c] for c in columns) for r in mixing.mix(df.where("doc_id != 904").repartition(2)).collect()]
    finally:
        mixing.BUCKET_ROWS = small
    assert sorted(again) == sorted(expected)
    assert all(t <= 3 * s for _, s, _, _, t in got)
    whole = mixing.mix(df)
    assert whole.count() == len(rows)
    taken = {r["doc_id"]: r["passes"] for r in whole.collect()}
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {k: v for k, v in taken.items() if v and k != 904} == {k: v for k, v in counts.items() if k != 904}
    assert mixing.mix(df.limit(0)).count() == mixing.mixed_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf, share", [("sf0.01", 0.01), ("sf0.001", 0.03)])
def test_mixing_comes_near_its_targets(spark, sf, share):
    """50 documents a source, or 10, the longest with a third of its source's words."""
    rows = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).toPandas()
    by = rows.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), own=("size", "sum"), source_size=("source_size", "first"))
    assert (by.own == by.source_size).all() and (by.target <= 3 * by.own).all()
    assert abs(by.target.sum() - by.own.sum()) < 1 and by.taken.sum() <= by.own.sum()
    assert ((by.taken - by.target).abs() <= share * by.target).all()
    assert (rows.passes <= 3).all() and (rows.taken == rows["size"] * rows.passes).all()

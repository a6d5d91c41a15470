"""Packed token ids, prefix tries and the divergence of sources: edge cases and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bitpack, divergence, prefixtrie

BYTES = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, score double, shard long, path string, number long, block long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [None, "", " \t\n", "one", "a b c  d\ne", "a b c  d\ne", LONG, LONG, "Zeile\n\nZeile\r\nx" * 3, "été ÉTÉ <|endoftext|> 漢字"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 0.5, 7, "p", 8, 9) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[4], (4, "same id, other text", None, None, None, None, None, None, None), (None,) * 9, (None, "last", *[None] * 7), (-5, "first", *[None] * 7)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    r = random.Random(width)
    for n in (0, 1, 63, 64, 65, 700):
        ids = np.array([r.randrange(1 << width) for _ in range(n)], np.uint32)
        block = np.frombuffer(bitpack.pack(ids, width), np.uint8)
        assert len(block) == -(-n * width // 8)
        for _ in range(10):
            a = r.randrange(n + 1)
            b = r.randrange(a, n + 1)
            assert (bitpack.unpack(block, width, a, b - a) == ids[a:b]).all()
    assert [bitpack.width_of(n) for n in (0, 1, 2, 3, 256, 257, 50257)] == [1, 1, 1, 2, 8, 9, 16]


def test_remembered_tokens_are_the_librarys():
    with open(BYTES) as file:
        own = bitpack.Tokens(file.read())
    assert own.remember
    r = random.Random(1)
    alphabet = ["a", "b", "ab c", " ", "\n", "\t", "  ", " ", " ", "é", "漢", "1", "'s", "'", "<|endoftext|>", "\x1c", "᠎", "\r\n", "!", "🙂"]
    for _ in range(1500):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(14))) for _ in range(3)]
        assert [x.tolist() for x in own(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_with_marks_are_encoded_without_the_library():
    with open(BYTES) as file:
        own = bitpack.Tokens(file.read())
    letters = [chr(c) for c in range(0x41, 0x2B0) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
    r = random.Random(2)
    some = lambda these, most: "".join(r.choice(these) for _ in range(r.randrange(most)))
    texts = ["a" + "".join(r.choice(" \n") + some(letters, 9) + r.choice(letters) + some(marks, 4) for _ in range(40)) for _ in range(200)]
    texts += [f"a {c}" for c in letters] + [f"a\nb{c}" for c in marks]
    asked, library = [], own._library
    own._library = lambda x: asked.extend(x) or library(x)
    told = own(texts)
    assert set(asked) == {"a"}
    assert [x.tolist() for x in told] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_tasks_of_a_worker_share_an_encoder():
    with open(BYTES) as file:
        model = file.read()
    assert bitpack.tokens_of(model) is bitpack.tokens_of(str(model))


def test_other_vocabularies_are_not_remembered():
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        own = bitpack.Tokens(file.read())
    assert not own.remember and own(["A word  more", ""])[0].tolist() == own.library.encode("A word  more", add_special_tokens=False).ids


def test_packed_documents(spark, odd, tmp_path):
    library = Tokenizer.from_file(BYTES)
    folder = f"file://{tmp_path}/packed"
    bitpack.write_packed(odd, BYTES, folder, block_ids=100, shard_bytes=200_000)
    rows = bitpack.read_documents(spark, folder).orderBy("start").collect()
    texts = collections.Counter((r["doc_id"], tuple([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in odd.collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == texts
    keys = [-(1 << 70) if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert keys == sorted(keys) and [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_tokens"] == len(r["ids"]) for r in rows)
    told = bitpack.manifest(spark, folder).collect()
    assert len(told) > 2 and sum(r["n_docs"] for r in told) == odd.count()
    # any stretch of the stream, over the ends of shards and blocks
    whole = [i for r in rows for i in r["ids"]]
    for begin, end in ((0, 1), (99, 101), (5, len(whole)), (told[0]["n_ids"] - 3, told[0]["n_ids"] + 250), (len(whole) - 1, len(whole) + 9)):
        parts = bitpack.read_range(spark, folder, begin, end).orderBy("start").collect()
        assert [i for p in parts for i in p["ids"]] == whole[begin:end] and parts[0]["start"] == begin
    assert bitpack.read_range(spark, folder, len(whole), len(whole) + 1).count() == 0


def test_no_documents_to_pack(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/none"
    bitpack.write_packed(odd.limit(0), BYTES, folder)
    assert bitpack.read_documents(spark, folder).count() == 0 and bitpack.manifest(spark, folder).count() == 0


def test_shards_are_checked(spark, odd, tmp_path):
    bitpack.write_packed(odd, BYTES, f"file://{tmp_path}/w")
    shard = next((tmp_path / "w" / "shards").glob("part-*")).read_bytes()
    with pytest.raises(ValueError):
        bitpack.Reader(shard[:-20] + b"x" * 20)


def nodes_by_brute_force(rows):
    """The contract on (conv_id, turn, role, text) rows without ties in turn."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(own)] for c, own in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = convs.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        own, children = members[node], [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        saved = (len(own) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        out[node] = (
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children),
            sum(out[c][5] for c in children) if children else 1, saved + sum(out[c][6] for c in children), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


CONV = "conv_id long, turn long, role string, text string, depth long, path string, k1 long"


@pytest.mark.parametrize("shard_turns", [3, 40, 10**6])
def test_trie_by_brute_force(spark, shard_turns):
    r = random.Random(11)
    rows = []
    for c in [*range(0, 130), -3, -20, -41, 5_000, 10**12]:
        if c % 20 == 0 and r.random() < 0.3:
            continue
        n = r.choice([1, 1, 2, 5, 9])
        rows += [(c, t if t or r.random() < 0.8 else None, r.choice(["user", None, "assistant"]) if t > 3 else "user", r.choice(["hi", "hi there", "", None, "x  y"]), 1, "p", 2) for t in range(n)]
    rows += [(200 + i, t, "system", f"all the same {t}", 1, "p", 2) for i in range(60) for t in range(4)]  # copies
    rows += [(300 + i, t, "system", f"all the same {t}" if t < 2 else f"own {i}", 1, "p", 2) for i in range(40) for t in range(4)]
    rows += [(None, 1, "user", "no conversation", 1, "p", 2), (7_000, 0, "user", LONG, 1, "p", 2), (7_001, 0, "user", LONG, 1, "p", 2)]
    rows += [(900, t, "user", f"deep {t}", 1, "p", 2) for t in range(60)] + [(901, t, "user", f"deep {t}", 1, "p", 2) for t in range(50)]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = prefixtrie.trie_nodes(df, shard_turns=shard_turns)
    want = nodes_by_brute_force([x[:4] for x in rows])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(x) for x in got.select(*columns).collect()), key=repr) == want


def test_trie_odd_tables(spark):
    none = spark.createDataFrame([], CONV)
    assert prefixtrie.trie_nodes(none).count() == 0
    # a repeated row is a further turn
    twice = spark.createDataFrame([(1, 0, "user", "a b", 1, "p", 2)] * 2 + [(40, 3, None, None, 1, "p", 2)] * 2, CONV)
    rows = {(r["conv_id"], r["depth"]): r for r in prefixtrie.trie_nodes(twice).collect()}
    assert rows[(1, 0)]["n_convs"] == 2 and rows[(40, 2)]["n_convs"] == 1 and rows[(1, 0)]["parent_conv_id"] is None


def test_double_array_holds_all_paths_and_no_others():
    r = random.Random(2)
    for _ in range(30):
        paths = sorted({tuple(r.randrange(1, r.choice([3, 400])) for _ in range(r.randrange(1, 7))) for _ in range(r.choice([1, 20, 300]))})
        trie = prefixtrie.build([np.array(p) for p in paths])
        prefixes, places = {p[:d] for p in paths for d in range(len(p) + 1)}, {}
        for p in prefixes:
            at = np.array([1])
            for t in p:
                at = trie.step(at, np.array([t]))
            assert at[0] and places.setdefault(int(at[0]), p) == p
            turns = np.arange(1, 400)
            there = trie.step(np.full(399, at[0]), turns) > 0
            assert {p + (int(t),) for t in turns[there]} == {q for q in prefixes if len(q) == len(p) + 1 and q[:-1] == p}


def audit_by_brute_force(rows):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [t for t in terms if t[0] == lang]
        docs = collections.Counter(t for _, _, ts in own for t in set(ts))
        kept = [t for t, n in docs.items() if n >= 3]
        count = {s: collections.Counter() for _, s, _ in own}
        for _, s, ts in own:
            count[s].update(t for t in ts if docs[t] >= 3)
        whole = sum(count.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        for s in count:
            ps = {t: p(count[s], t) for t in kept}
            found = [("pair", o, sum((ps[t] - p(count[o], t)) ** 2 // p(count[o], t) for t in kept)) for o in count if o != s]
            found += [("term", t, (ps[t] - p(whole, t)) ** 2 // p(whole, t)) for t in kept if count[s][t] and ps[t] > p(whole, t)]
            for part, most in (("pair", 10**9), ("term", 4)):
                ranked = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i + 1) for i, x in enumerate(ranked) if i < most]
    return sorted(out)


@pytest.mark.parametrize("block, held", [(20_000, 300_000), (5, 40)])
def test_audit_by_brute_force(spark, odd, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    r = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "漢字", "A1b", "x_y"]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None]), " ".join(r.choice(words[: r.choice([5, 64])]) for _ in range(r.randrange(30)))) for _ in range(150)]
    rows += [("zz", "only", "one two"), ("zz", "two", "three"), ("zz", "none", None), ("yy", "alone", "")]
    rows += [(x["lang"], x["source"], x["text"]) for x in odd.collect()]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("x")).withColumn("number", F.lit(1))
    got = sorted(map(tuple, divergence.audit(df.repartition(3), top=4).collect()))
    assert got == audit_by_brute_force(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_probability_is_exact_for_large_counts(spark):
    row = spark.createDataFrame([(10**13 + 7, 3 * 10**13, 5)], "c long, n long, v long")
    got = row.select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 8) // (3 * 10**13 + 5)


def test_terms_of_a_language_are_dealt_out_once(spark):
    docs = spark.createDataFrame([("en", "a", "One two_two ÉTÉ été"), ("en", "b", "one"), (None, None, None)], "lang string, source string, text string")
    found = divergence.group_terms(docs)
    kept = found.withColumn("all", F.sum("count").over(Window.partitionBy("lang", "term")))
    assert kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange") == 1
    want = {("en", "a", "one", 1, 1), ("en", "b", "one", 1, 1), ("en", "a", "two", 2, 1), ("en", "a", "ÉtÉ", 1, 1), ("en", "a", "été", 1, 1)}
    assert set(map(tuple, found.collect())) == want

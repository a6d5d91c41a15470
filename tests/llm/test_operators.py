"""Edge cases and brute-force comparisons of the training-text operators."""

import collections
import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import connect, differences
from tidemark.llm import chat, decontam, langid, linededup, outliers, paritysketch, phrases, pieces, queries, toxicity, warc
from tidemark.llm.words import shingle_set

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, class long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [None, "", " \t\n", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", LONG, LONG + " tail", "Zeile\n\nZeile\r\nx" * 3]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, "en", "s", 1, 0.5, 7, 8) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[4], (4, "same id, other text", None, None, None, None, None, None), (None,) * 8, (None, LONG, *[None] * 6)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, folder, name):
    assert differences(queries.QUERIES[name](spark, folder), queries.SQL[name], connect(folder)) is None


def test_parity_sketch_odd_rows(odd, none):
    rows = paritysketch.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and paritysketch.jaccard_components(none).count() == 0
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert got[0] == {(0, 0)} and got[3] == {(1, 3)} and (9, 4) in got[4] and got[5] == {(9, 4)}
    assert {c for _, c in got[7]} == {6} and (0, None) in got[None] and 6 in {c for _, c in got[None]}


@pytest.mark.parametrize("k, num, den", [(2, 60, 100), (3, 80, 100), (4, 85, 100)])
def test_parity_sketch_is_exact(spark, k, num, den):
    r = random.Random(k)
    base = [[r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(r.randrange(4, 120))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(12):
            own = list(words)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [set(shingle_set(t.encode(), k).tolist()) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in paritysketch.jaccard_components(docs, k=k, num=num, den=den).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_slices_meet_for_every_pair_at_the_threshold():
    bands, r = paritysketch.Bands(80, 100), np.random.default_rng(1)
    for n in (9, 15, 40, 120, 700):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(n * 0.2 / 1.8)  # so many replaced on either side keep a similarity of 0.8
            b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            b = b if len(np.intersect1d(a, b)) * 100 >= 80 * len(np.union1d(a, b)) else a
            assert np.intersect1d(bands.keys(a), bands.keys(b)).size or not list(bands.of(len(a)))


@pytest.mark.parametrize("num", [60, 80, 85])
def test_pairs_at_the_threshold_meet_in_as_many_slices_as_needed(num):
    bands, r = paritysketch.Bands(num, 100), np.random.default_rng(2)
    for n in (3, 9, 40, 120, 700, 2500):
        for _ in range(10):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = n * (100 - num) // (100 + num)
            fewer, other = a[n * (100 - num) // 100 :], np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            for b in (fewer, other):
                if len(np.intersect1d(a, b)) * 100 >= num * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
                    met = np.intersect1d(bands.keys(a), bands.keys(b)).size
                    (own, low, high), (own2, low2, high2) = bands.needed(len(a)), bands.needed(len(b))
                    assert met >= min(high, high2) - max(low, low2)
                    assert met >= max(own, own2) or not list(bands.of(max(len(a), len(b))))
    assert bands.needed(2500)[0] > 10


def test_long_texts_with_a_common_part_are_not_compared(spark, monkeypatch):
    r = random.Random(5)
    common = [f"c{i}" for i in range(600)]
    texts = [common + [f"w{r.randrange(10**9)}" for _ in range(900)] for _ in range(20)]
    texts.append([*texts[0][:-20], *(f"new{i}" for i in range(20))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    compared, verified = [], paritysketch._verified

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(paritysketch, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in paritysketch.jaccard_components(docs, k=5, num=80, den=100).collect()}
    assert got == {i: i if i < 20 else 0 for i in range(21)}
    assert compared[-1] == 0  # nearly all of the 210 pairs share slices, but too few


def test_lines(odd, none, spark):
    assert linededup.dedup_lines(none).count() == 0
    rows = linededup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and {"score", "class", "lang"} <= set(rows[0].asDict())
    docs = spark.createDataFrame([(2, "  A shared LINE here\nown"), (1, "a shared line here \nshort"), (3, "short\na shared line here")], "doc_id long, text string")
    got = {r["doc_id"]: (r["kept_text"], r["n_dropped"]) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: ("a shared line here \nshort", 0), 2: ("own", 1), 3: ("short", 1)}
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs, threshold=4).collect()}
    assert set(got.values()) == {0}


def test_phrases(odd, none):
    assert phrases.remove_repeats(none).count() == 0
    rows = phrases.remove_repeats(odd, size=5).collect()
    assert len(rows) == odd.count()
    texts = [r["text"] for r in odd.collect()]
    split = [t.split() for t in texts if t]
    count = collections.Counter(tuple(words[i : i + 5]) for words in split for i in range(len(words) - 4))

    def kept(text):
        words = (text or "").split()
        gone = {j for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        return " ".join(w for j, w in enumerate(words) if j not in gone)

    assert sorted(r["kept_text"] for r in rows) == sorted(map(kept, texts))


def test_pieces_and_spans_are_the_librarys():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        own = pieces.Encoder(pieces.read_model(file.read()))
    r = random.Random(3)
    texts = ["".join(r.choice("ab cé  \t\n▁\0ü漢🙂<s></s><0x41> .,") for _ in range(r.randrange(40))) for _ in range(400)] + ["", " ", "a  "]
    for text, (ids, begins, ends) in zip(texts, own.encode([t.encode() for t in texts])):
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces] and own.decode(ids) == library.decode(ids.tolist())
        assert list(zip(begins, ends)) == [(p.begin, p.end) for p in proto.pieces]


def test_character_map_is_the_librarys():
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    spec = proto.normalizer_spec
    table = pieces.CharacterMap(spec.precompiled_charsmap)
    model = pieces.Model(b"", b"", spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, "", [], [], True)
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice("ab c  ①ﬁÅÅ½　㌀ǘé漢🙂\t\nｶﾞ ㎏") for _ in range(r.randrange(20)))
        out, source = pieces.normalise(text.encode(), model, table)
        want, offsets = library.normalize(text, with_offsets=True)
        places = [len(text.encode()[:v].decode()) for v in source]
        assert out.decode() == want and [places[len(want[:j].encode())] for j in range(len(want) + 1)] == list(offsets)


def test_pieces_odd_rows(odd, none):
    path, outputs = public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids", "begins", "ends", "decoded", "covered_bytes")
    assert pieces.encode_texts(none, path).count() == 0
    rows = pieces.encode_texts(odd, path, outputs=outputs).collect()
    assert sorted(r["decoded"] for r in rows) == sorted(r["text"] or "" for r in odd.collect())
    assert all(r["covered_bytes"] == len(r["decoded"].encode()) and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_leaks(spark, odd, none):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, None), (3, ""), (4, "w1"), (None, " ".join(words[30:50]))], "item_id long, text string")
    edited = words[:5] + ["other"] + words[6:12] + words[13:20]
    docs = spark.createDataFrame(
        [(1, " ".join(["x"] * 9 + words[:20] + ["y"])), (2, " ".join(["x", *edited, "y"])), (3, " ".join(words[:10])), (4, " ".join(words[28:]).upper())],
        "doc_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["begin_word"], r["end_word"]) for r in decontam.find_leaks(docs, items).collect()}
    assert got[(1, 1)] == (0, 9, 29) and got[(2, 1)][0] == 2 and got[(4, None)] == (0, 2, 22) and len(got) == 3
    assert decontam.with_leaks(odd, items).count() == odd.count() and decontam.find_leaks(none, items).count() == 0
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_recall_at_the_allowed_edits():
    r = random.Random(5)
    items = [(i, " ".join(f"i{i}w{r.randrange(300)}" for _ in range(r.randrange(15, 60)))) for i in range(40)]
    index = decontam.Index([(i, t.encode()) for i, t in items], 0.8, 0.99, 5)
    hit = 0
    for i, text in items:
        words = text.split()
        for at in r.sample(range(len(words)), int(0.2 * len(words) + 1e-9)):
            words[at] = "changed"
        hit += any(f["item_id"] == i for f in index.find(" ".join(["x"] * 30 + words + ["y"] * 30).encode()))
    assert hit >= 38


@pytest.mark.parametrize("size", [300, 1000])
def test_leaks_recall_of_long_items(size):
    r = random.Random(5)
    items = [(i, " ".join(f"i{i}w{r.randrange(5 * size)}" for _ in range(size))) for i in range(20)]
    index = decontam.Index([(i, t.encode()) for i, t in items], 0.8, 0.99, 5)
    for i, text in items:
        words = text.split()
        for at in r.sample(range(size), size // 5):
            words[at] = r.choice(["changed", words[at] + " added", ""])
        found = index.find(" ".join(["x"] * 30 + words + ["y"] * 30).encode())
        assert [(f["item_id"], f["edits"] <= size // 5) for f in found] == [(i, True)]


def test_leaks_of_short_items_and_without_blanks(spark, tmp_path):
    han, thai = "床前明月光疑是地上霜举头望明月低头思故乡", "สวัสดีครับวันนี้อากาศดีมาก"
    items = [(1, "Who is she?"), (2, "tea"), (3, han), (4, thai), (5, "東京都"), (6, "?!")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["so who is she, then", "who was she", "teapot", "x tea", f"他说“{han[:9]}，{han[9:14]}天{han[15:]}。”", f"ก{thai}ข", "東京 都", "東京に都", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["begin_word"], r["end_word"]) for r in found}
    assert got.pop((4, 3))[0] == 1
    assert got == {(0, 1): (0, 1, 4), (3, 2): (0, 1, 2), (5, 4): (0, 1, 1 + len(thai)), (6, 5): (0, 0, 3)}
    kept = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 7, 8}


def test_toxicity(spark, odd, none, folder):
    r = random.Random(6)
    bad, plain = ["grobian", "widerling"], [f"wort{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(plain) if i % 3 or j != 17 else r.choice(bad) for j in range(40)), int(i % 3 == 0)) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    got = toxicity.score_toxicity(docs, labels).filter("held_out").collect()
    assert np.mean([x["predicted"] == x["toxic"] for x in got]) > 0.95
    scored = toxicity.score_toxicity(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= x["score"] <= 1 for x in scored)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {x["score"] for x in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    rows = [(i, f"wort{i % 9} " + ("grobian" if i % 3 == 0 else "gut"), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    driver, fit = os.getpid(), toxicity.fit

    def away(*a, **kw):
        assert os.getpid() != driver, "the driver fits"
        return fit(*a, **kw)

    monkeypatch.setattr(toxicity, "fit", away)
    known = toxicity.training_rows(docs, docs, "doc_id", "text", "toxic", 5000, 50_000)
    share, net = toxicity.fitted(known, 12)
    want = [(r["_text"].encode(), r["_label"]) for r in known.collect()]
    assert share == sum(y for _, y in want) / len(want)
    alone = fit([t for t, _ in want], [y for _, y in want], stride=12)
    assert set(net) == set(alone) and all(np.array_equal(net[k], alone[k]) for k in net)


def test_components_leave_only_the_last_labels(spark, tmp_path):
    from tidemark.operators.graph import connected_components
    from tidemark.session import checkpoint_folder

    folder = checkpoint_folder(spark)
    before = set(os.listdir(folder.removeprefix("file://")))
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    got = connected_components(spark.range(12).toDF("node"), edges).collect()
    assert {r["node"]: r["root"] for r in got} == {n: 0 if n < 10 else n for n in range(12)}
    assert len(set(os.listdir(folder.removeprefix("file://"))) - before) == 1


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 100, 1001):
        seen = toxicity.windows(np.arange(n))
        assert set(seen.ravel().tolist()) - {-1} == set(range(n)) and seen.shape[1] == toxicity.LENGTH


def test_quality_rules(odd, none, spark):
    assert outliers.quality_rules(none).count() == 0
    rows = outliers.quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(r["base_failed"] for r in rows if r["n_words"] < 10)
    r = random.Random(8)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 200))) for _ in range(300)]
    texts += [t.replace(" ", "### ") for t in texts[:10]]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x["kept"] for x in outliers.quality_rules(docs).collect()}
    assert not any(got[i] for i in range(300, 310)) and sum(got[i] for i in range(300)) >= 297


def test_a_few_texts_of_a_rare_language_are_judged_by_all(spark):
    r = random.Random(18)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 200))) for _ in range(360)]
    bad = set(range(355, 360))
    rows = [(i, t.replace(" ", "### ") if i in bad else t, "en" if i < 300 else None, "a") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in outliers.quality_rules(docs).collect()}
    assert all(got[i]["distance"] is not None for i in got) and not any(got[i]["kept"] for i in bad)
    assert sum(got[i]["kept"] for i in got if i not in bad) >= 350
    few = outliers.quality_rules(docs.filter("lang is null")).collect()
    assert len(few) == 60 and all(x["distance"] is None and x["kept"] for x in few)


def test_text_counts_by_brute_force():
    r = random.Random(9)
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "c\n", "#", "%é ", "\n", "\t"]) for _ in range(r.randrange(60)))
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))
        assert outliers.text_counts(text.encode()) == want


def test_many_languages(spark):
    """More languages than a task counts at a time, each with an alphabet of its own."""
    r = random.Random(19)
    own = [[chr(0x4E00 + 20 * k + j) for j in range(20)] for k in range(langid.AT_ONCE + 16)]
    rows = [(f"l{k:03d}", " ".join("".join(r.choice(a) for _ in range(3)) for _ in range(30))) for k, a in enumerate(own) for _ in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    asked = docs.select(F.col("lang").alias("known"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("url"))
    got = langid.identify(asked, docs).collect()
    assert len(got) == len(rows) and all(x["lang"] == x["known"] for x in got)


def test_languages(spark, odd, none, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = odd.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("url"))
    assert langid.identify(rows, docs).count() == odd.count() and langid.identify(rows.limit(0), docs).count() == 0
    assert {r["lang"] for r in langid.identify(rows, none).collect()} == {None}
    own = docs.select("doc_id", "text", F.col("lang").alias("known"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("url"))
    got = langid.identify(own, docs).collect()
    assert np.mean([r["lang"] == r["known"] for r in got]) > 0.95
    page = spark.createDataFrame([("<html  LANG='de-AT'><style>x</style>Wort&amp;<b>gut</b>",)], "h string")
    told = page.select(langid.declared_language(F.col("h")), langid.page_text(F.col("h"))).first()
    assert told[0] == "de" and told[1].split() == ["Wort", "gut"]


def test_warc(spark, tmp_path):
    payloads = ["a\r\n\r\nb", "", None, "end\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc", "é" * 50_000]
    rows = [(i, "http://h.example/\r\nx?y#z", t, 1) for i, t in enumerate(payloads)] + [(9, None, "end\r\n", 2), (9, None, "end\r\n", 2), (None, None, "only", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size long")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    captures = warc.with_referred(warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w"))).collect()
    assert len(captures) == len(rows) and all(c["request"] and c["metadata"] for c in captures)
    told = sorted((c["metadata"]["page_id"] if c["metadata"]["page_id"] is not None else -1, c["response"]["record_type"], c["refers_to_page"]) for c in captures)
    want = [(-1, "response", None), (0, "response", None), (1, "revisit", 2), (2, "response", None), (3, "revisit", 9), (4, "response", None), (5, "response", None)]
    assert told == want + [(9, "response", None), (9, "revisit", 9)]
    by_page = {c["metadata"]["page_id"]: c["response"]["payload"] for c in captures if c["response"]["record_type"] == "response"}
    assert bytes(by_page[4]) == payloads[4].encode() and bytes(by_page[5]) == payloads[5].encode() and bytes(by_page[0]) == b"a\r\n\r\nb"
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.assemble(warc.read_records(spark, f"file://{tmp_path}/none")).count() == 0


def test_chat_folds_and_renders(spark):
    log = [
        (1, 0, "open", 0, "user", "hi"), (1, 1, "open", 1, "assistant", None), (1, 2, "delta", 1, None, "wrong"),
        (1, 3, "open", 2, "user", "later"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "ri"),
        (1, 6, "delta", 1, None, "ght"), (1, 6, "delta", 1, None, "ght"), (1, 7, "edit", 0, None, "<|im_end|>\\"),
        (1, 8, "open", 3, "user\nx", "gone"), (1, 9, "delete", 3, None, None), (None, 0, "open", None, None, None), (2, 0, "noise", 0, "user", "x"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message long, role string, text string")
    messages = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(events).collect()}
    assert messages == {(1, 0): ("user", "<|im_end|>\\"), (1, 1): ("assistant", "right"), (None, None): ("", "")}
    rendered = chat.render(chat.fold_events(events))
    one = rendered.filter("conv_id = 1").first()
    assert chat.parse(one["formatted"]) == [("user", "<|im_end|>\\"), ("assistant", "right")]
    assert [one["formatted"][s["begin"] : s["end"]] for s in one["loss"]] == ["right"]
    assert chat.read_back(rendered).count() == 2 and chat.read_back(chat.render(chat.fold_events(events.limit(0)))).count() == 0


def test_chat_logs_with_detours_fold_into_the_turns(spark):
    """Edited, regenerated and deleted messages leave no trace; odd rows have their place."""
    r = random.Random(21)
    rows = [(c, n, r.choice(["user", "assistant"]), "".join(r.choice("ab <|é\n") for _ in range(r.randrange(900)))) for c in range(40) for n in range(6)]
    rows += [(100, 0, "user", None), (100, 1, None, ""), (100, 2, "user", "x"), (100, 2, "user", "x"), (100, 2, "user", "w" * 300_000), (None, None, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "way": F.lit("w"), "copy": F.lit(2)})
    events = chat.as_events(turns)
    assert {x["kind"] for x in events.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate", "delete"}
    got = sorted((x["conv_id"] or -1, x["message"]["turn"] or -1, x["role"], x["text"]) for x in chat.fold_events(events).collect())
    assert got == sorted((c or -1, n or -1, role or "", text or "") for c, n, role, text in rows)
    assert chat.read_back(chat.render(chat.fold_events(chat.as_events(turns.limit(0))))).count() == 0



@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|im_end|>", "<<||", "a<", "\\n\n", "<|im_start|>x\ny"])
def test_escapes_are_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")), chat.escape_role(F.col("t"))).first()
    assert chat.unescape(row[0]) == text and chat.unescape_role(row[1]) == text and "<|" not in row[0] + row[1]


def test_near_copies_with_repeated_ids(spark, odd, none):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (1, "a quite different text of its own", "b"), (2, words + " tail", "c"), (3, "a quite different text of its own", "d"), (None, words, "e"), (4, None, "f"), (5, "", "g"), (1, words, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r["text_hash"] for r in kept.collect())) == ["a", "b", "e", "f", "g"] and kept.columns == docs.columns
    assert corpus_pipeline.drop_near_copies(spark, none, "").count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, odd, "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 4, 6, 8]


CLASH = "doc_id long, text string, score double, predicted string, held_out long, kept_text string, n_lines string, n_dropped long, leaks string, _id long, _dropped string, _lines string, _text_hash long, _more string, n_chars long, row string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, 0.25, "p", i, "k", "n", 5, "l", 6, "d", "x", 7, "m", 8, "r") for i, t in enumerate([*TEXTS, "a line of many\nown line here", "other one\nA line of many"])]
    return spark.createDataFrame([*rows, rows[4], (None,) * 16], CLASH).repartition(2)


def test_stages_return_the_callers_columns(spark, clashing, folder):
    given = collections.Counter(map(tuple, clashing.collect()))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_benchmark, corpus_pipeline.drop_near_copies):
        kept = stage(spark, clashing, folder)
        assert kept.columns == clashing.columns and not collections.Counter(map(tuple, kept.collect())) - given
        assert stage(spark, clashing.limit(0), folder).count() == 0
    lines = corpus_pipeline.drop_lines(spark, clashing, folder)
    assert lines.columns == clashing.columns and lines.count() == clashing.count()
    got = {r["doc_id"]: r for r in lines.collect()}
    assert got[10]["text"] == "other one" and got[10]["n_chars"] == 9 and got[10]["_dropped"] == "d" and got[10]["kept_text"] == "k"
    assert corpus_pipeline.drop_lines(spark, clashing.limit(0), folder).count() == 0


def test_line_and_leak_operators_with_clashing_names(spark, clashing):
    rows = linededup.dedup_lines(clashing).collect()
    assert len(rows) == clashing.count() and {r["_id"] for r in rows if r["doc_id"] is not None} == {6} and {r["_dropped"] for r in rows} == {"d", None}
    items = spark.createDataFrame([(1, "word1x1 word2x2 word3x3 word4x4 word5x5")], "item_id long, text string")
    rows = decontam.with_leaks(clashing, items).collect()
    assert sum(len(r["leaks"]) for r in rows) >= 2 and {r["_more"] for r in rows} == {"m", None}


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x i{i}w0 " + " ".join(f"i{i}w{j}" for j in range(12)) + " y") for i in range(0, 30, 3)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(i, i) for i in range(0, 30, 3)}


def test_pipeline_runs_through(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 0 < len(rows) <= docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    assert all(r["ids"] == library.encode(library.decode(r["ids"])) for r in rows[:20])

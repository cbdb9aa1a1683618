"""The training-data operators on small rows against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from partforge.llm import (
    bpe_transducer,
    chat_bytes,
    curve_packing,
    exact_dedup,
    language_mixture,
    ngram_join,
    range_coder,
    rule_forest,
    url_rules,
    warc,
)
from partforge.llm.components import connected_components
from partforge.llm.units import UnitEncoder
from partforge.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, key string, word string, __maybe_gone string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "a  b", " a\n\nb c\n", "foo \n bar", "tab\there is", "I'm it's 'S \x1cq", "á ́b", "ends \n", "x" * 3000,
       "<|endoftext|> a<|endoftext|>", "日本 語 😀", "\r\n a b\r\nc", "\0 a \0"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows = [(None, "no id", "en"), (1, None, None), (2, "", "en"), (3, None, "de"), (4, "One Two", "en"), (5, "one two", "en")]
    base = [word() for _ in range(200)]
    for i in range(10, 30):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(200)] = word()
        rows.append((i, " ".join(copy), "en"))
    rows += [(i, " ".join(word() for _ in range(rng.randint(1, 90))), "fr") for i in range(40, 60)]
    rows += [(70, " ".join(base * 40), "en"), (71, "Same\n" * 40, "en"), (71, "Same\n" * 40, "en")]
    return spark.createDataFrame([(*r, "k", "w", "g") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jaccard_components(rows, words, num, den):
    sets = []
    for _, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = min(words, len(found))
        sets.append({tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)].append(doc_id)
    return [(d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("words,num,den,block", [(3, 90, 100, ngram_join.BLOCK_SHINGLES), (5, 80, 100, 300)])
def test_ngram_join_equals_brute_force(docs, words, num, den, block):
    """Whole parts, and parts cut into blocks."""
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    want = Counter(jaccard_components(rows, words, num, den))
    found = ngram_join.near_duplicates(docs.where("doc_id is not null"), words, num, den, block)
    assert Counter(tuple(r) for r in found.collect()) == want


def test_one_document_of_each_stays(docs, empty):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert ngram_join.near_duplicates(empty).count() == 0


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (500, 16)).astype(np.uint32)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngram_join.RTree(points, sizes, 80, 100)
    for i in range(0, 500, 25):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero(bound >= ngram_join.needed(sizes, sizes[i], 80, 100))
        assert set(tree.search(points[i], int(sizes[i]))) == set(want)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(30) if i != 14], "a string, b string")
    found = {r.node: r.label for r in connected_components(edges).collect()}
    assert found == {f"{i:02}": "00" if i < 15 else "15" for i in range(31)}


def test_exact_dedup(docs, empty):
    rows = [(r.doc_id, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            want[i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()] += 1
            first = first and i != keep
    for most in (exact_dedup.MAX_SLOTS, 64):  # a full filter sends all rows through the shuffle
        assert Counter(tuple(r) for r in exact_dedup.dedup_decisions(docs, most).collect()) == want
        kept = exact_dedup.exact_dedup(docs, most)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup_decisions(empty).count() == 0


def test_dedup_shuffles_no_python_and_broadcasts_only_the_filter(docs):
    plan = exact_dedup.dedup_decisions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


def test_archive_round_trip(spark):
    pages = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "u\r\nv", ""), (5, "http://é", "\r\n\r\nWARC/1.1"),
             (None, "n", "x"), (1, "http://a/0", "x")]
    df = spark.createDataFrame(pages, "key long, url string, payload string")
    folder = shared_folder(spark, "test-warc")
    warc.write_archive(df, folder)
    assert spark.read.parquet(f"{folder}/payloads").count() == 3
    got = {(r.key, r.url): r for r in warc.read_archive(spark, folder).collect()}
    assert got[1, "http://a/0"].record_type == "response" and got[1, "http://a/1"].refers_to == 1
    assert got[2, "http://a/2"].refers_to == 1 and got[None, "n"].record_type == "revisit"
    assert got[4, "u%0D%0Av"].refers_to == 3 and bytes(got[2, "http://a/2"].payload) == b"x"
    for r in got.values():
        body = b"" if r.record_type == "revisit" else bytes(r.payload)
        assert bytes(r.record) == bytes(r.header) + body + b"\r\n\r\n" and b"Content-Length: %d\r\n" % len(body) in r.header
    warc.write_archive(df, f"{folder}-2", least_bytes=1)
    assert warc.read_archive(spark, f"{folder}-2").where("key = 4").first().record_type == "response"
    warc.write_archive(df.limit(0), f"{folder}-3")
    assert warc.read_archive(spark, f"{folder}-3").count() == 0
    warc.export_warc(warc.read_archive(spark, folder), f"{folder}-warc")
    raw = b"".join(r.content for r in spark.read.format("binaryFile").load(f"{folder}-warc").collect())
    assert raw.count(b"WARC-Type: ") == len(pages)


def test_a_damaged_payload_is_found(spark):
    folder = shared_folder(spark, "test-damaged")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "key long, url string, payload string"), folder)
    spark.read.parquet(f"{folder}/payloads").selectExpr("address", "cast('y' as binary) payload").write.parquet(f"{folder}-b/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-b/headers")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_archive(spark, f"{folder}-b").collect()


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['a', 'spam', 'b'])}.x.{rng.choice(['net', 'org'])}/{rng.choice(['p', 'q'])}/{i}" for i in range(200)]
    urls += [None, "no scheme", "x://", "http://EXAMPLE.org/es/1", "https://m.a.com/de/?q", "http://org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(
        [(i, 0 if "spam" in u and "/q/" in u else 1, 0) for i, u in enumerate(urls[:200])] + [(None, 0, 1), (3, None, None)],
        "doc_id long, quality int, toxic int",
    )
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")]
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels, rules, 0.01, 0.8, 1.2).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls[:200]):
        spam = "spam" in url and "/q/" in url
        assert got[i].verdict == ("allow" if ".org/" in url else "block" if spam else "allow"), url
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(200, 206)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.org", "/es/1", "example.org/es/", "block"), ("m.a.com", "/de/", "com/de/", "block"), ("org", "", None, "allow"),
    ]
    assert url_rules.judge_urls(pages.limit(0), labels.limit(0), rules).count() == 0


@pytest.mark.parametrize("n,hosts", [(100, 40), (1000, 60)])
def test_chance_makes_no_url_rule(spark, n, hosts):
    """Labels that a URL says nothing of block nothing; a bad host among them is found, and on other rows too."""
    rng = random.Random(n)
    rows = [([f"h:a{rng.randrange(hosts)}", f"h:b{rng.randrange(8)}", f"p:{rng.choice('xyz')}"], rng.random() < 0.26) for _ in range(n)]
    noise = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    assert url_rules.mined_rules(noise).count() == 0
    spam = [(["h:spam", *tokens[1:]], rng.random() < 0.9) for tokens, _ in rows[: max(n // 10, 30)]]
    learned, other = spam[::2], spam[1::2] + rows[n // 2 :]
    rules = url_rules.mined_rules(noise.limit(n // 2).unionByName(spark.createDataFrame(learned, noise.schema)))
    found = [set(r.antecedent) for r in rules.collect()]
    blocked = [bad for tokens, bad in other if any(r <= set(tokens) for r in found)]
    assert len(blocked) >= len(spam[1::2]) and sum(blocked) > 0.7 * len(blocked)


@pytest.mark.parametrize("path,blanks", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_units_encode_like_whole_texts(path, blanks):
    encoder = UnitEncoder(path, blanks)
    texts = [*ODD, "The cat, the  hat.\nThe end", *ODD]
    whole = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == whole


def test_words_of_any_case_and_before_marks_are_one_unit():
    encoder = UnitEncoder(WORD_BPE, False)
    raw = lambda x: encoder.tokenizer.encode(x, add_special_tokens=False).ids
    texts = ["Word word, WORD. word, and ÉTÉ. été\nWord", "é. É, a"]
    assert [x.tolist() for x in encoder.encode(texts)] == [raw(x) for x in texts]
    assert set(encoder.known) == {",", ".", "word", "and", "été", "é", "a"}
    # marks that are not words of their own, text that lower case or composing changes, special tokens
    odd = [",", ", ", " , a", "a , b", "a., b", "a. , b", "a!, b", "2, b", "². b", "ª, b", ".,", "it's, 'S. 'tis",
           "H\u0331, E\u0301. e\u0301, İ. ΑΣ, Ÿ. ﬁ, ٣. 中, 😀. x", "<|endoftext|>, a", "<|ENDOFTEXT|>. A", "a\t, b\x85. c\xa0, d"]
    assert [x.tolist() for x in encoder.encode(odd)] == [raw(x) for x in odd]
    assert not UnitEncoder(BYTE_BPE, True).word_end and encoder.encode([]) == []


def test_words_are_not_cut_for_other_rules(tmp_path):
    import json

    rules = json.loads(Path(WORD_BPE).read_text(encoding="utf-8"))
    rules["normalizer"]["normalizers"].pop()  # no lower case
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    encoder = UnitEncoder(str(path), False)
    texts = ["Word word, WORD. a!, b", "a., É. é"]
    want = [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert not encoder.word_end and [x.tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("path,blanks", [(WORD_BPE, False), (BYTE_BPE, True)])
def test_special_tokens_are_encoded_as_the_library_does(path, blanks):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    texts = [*ODD, "a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "x\n<|endoftext|>\ny", "<|startoftext|>A b<|ENDOFTEXT|>",
             "a <|endof text|> b", "plain words", "<|endoftext|><|endoftext|> z"]
    want = [fresh.encode(x, add_special_tokens=False).ids for x in texts]
    encoder = UnitEncoder(path, blanks)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert want[len(ODD)] == ([320, 49407, 321] if path == WORD_BPE else [64, 220, 50256, 275])


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 191, 192, 700, 20_000):
        for most in (1, 2, 300, 49_408):
            ids = rng.integers(0, most, n).astype(np.uint32)
            block = range_coder.encode_block(ids, 49_408)
            assert (range_coder.decode_block(block) == ids).all()
    assert len(range_coder.encode_block(np.tile(np.arange(50, dtype=np.uint32), 2000), 49_408)) < 100_000 / 4
    with pytest.raises(ValueError):
        range_coder.decode_block(block[:-200] + bytes(200))


def test_ids_are_written_in_order(spark, docs, empty):
    path = shared_folder(spark, "test-ids")
    range_coder.write_ids(docs, path, WORD_BPE, 1, 49_408, target=500)
    encoder = UnitEncoder(WORD_BPE, False)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = [(*r[:4], bytes(r[4])) for r in range_coder.read_ids(spark, path).collect()]
    assert Counter(got) == Counter(want)
    range_coder.write_ids(empty, f"{path}-0", WORD_BPE, 1, 49_408)
    assert range_coder.read_ids(spark, f"{path}-0").count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = curve_packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_places_each_id_once(docs, empty):
    encoder = UnitEncoder(BYTE_BPE, True)
    pieces = curve_packing.pack(docs, BYTE_BPE, end=0, size=64).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        texts[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for spans in sequences.values():
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] in (1, 2, 4, 8, 16, 32, 64)
    for r in docs.where("doc_id <> 71 and doc_id is not null").collect():
        ids = [i for _, x in sorted(texts[r.doc_id]) for i in x]
        assert ids == [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
    assert curve_packing.pack(empty, BYTE_BPE, end=0).count() == 0


def test_chats_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "", None, "é\n<|"]
    rows = [(c, t, role, texts[((c or 0) + t) % 6], 1) for c in (1, 2, None) for t, role in enumerate(["user", "assistant", None, "a\n\\n<|"] * 2)]
    turns = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat_bytes.format_turns(turns.repartition(3))
    for r in formatted.collect():
        assert r.formatted.count("<|") == 2
    got = {r.conv_id: r for r in chat_bytes.read_conversations(formatted).collect()}
    assert len(got) == 3 and got[1].n_turns == 9
    mine = [(role or "", text or "") for c, _, role, text, _ in rows if c == 2]
    trained = "".join(x for role, x in mine if role == "assistant")
    assert got[2].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
    assert (got[2].loss_chars, got[2].loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert chat_bytes.read_conversations(chat_bytes.format_turns(turns.limit(0))).count() == 0


def test_language_on_held_out_rows(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_mixture.identify(table, language_mixture.learn_from(table)).join(table.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    model = language_mixture.learn_from(docs)
    assert [model.predict(x) for x in (None, "", "12 .", "--")] == [("und", 0.0)] * 4
    nothing = language_mixture.learn_from(empty)
    assert nothing.predict("text") == ("und", 0.0) and language_mixture.identify(empty, nothing).count() == 0
    assert language_mixture.with_language(docs, model).columns == docs.columns


def test_mixture_finds_both_languages():
    likelihood = np.full((40, 3), -30.0)
    likelihood[:25, 0], likelihood[25:, 2] = -10.0, -10.0
    shares, _ = language_mixture.mixture(likelihood)
    assert shares[1] == 0 and abs(shares[0] - 25 / 40) < 0.02 and abs(shares.sum() - 1) < 1e-6


@pytest.fixture(scope="module")
def languages(spark):
    """A model of six languages, each with an alphabet of its own, and what writes a text in one of them."""
    rng = random.Random(8)
    words = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[4 * i : 4 * i + 6], k=5)) for _ in range(60)] for i, x in enumerate("pqrstu")}
    write = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = [(i, write(lang, 200), lang) for i in range(20) for lang in words]
    return language_mixture.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")), write


def test_a_document_in_three_languages_stays(spark, languages):
    model, write = languages
    clean = " ".join([write("p", 160), write("r", 140), write("t", 100)])
    lang, score = model.predict(clean)
    assert lang == "p" and 0.3 < score < 0.5
    rng = random.Random(4)
    noise = " ".join("".join(rng.choices("ÄÖÜßÑÇÅØÆ0123456789", k=5)) for _ in range(400))
    docs = spark.createDataFrame([(1, clean), (2, write("q", 100)), (3, "12 ."), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in language_mixture.with_language(docs, model).collect()} == {1, 2}
    likelihood, shares = model.segments(noise), np.array([0.4, 0.35, 0.25, 0, 0, 0])
    assert model.support(noise, likelihood, shares) < 0.01


def test_mixture_finds_all_languages(languages):
    model, write = languages
    parts = {"p": 300, "q": 200, "r": 150, "s": 120, "t": 100, "u": 80}
    shares, _ = language_mixture.mixture(model.segments(" ".join(write(x, n) for x, n in parts.items())))
    assert np.abs(shares - np.array(list(parts.values())) / sum(parts.values())).max() < 0.03


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(docs):
    for text in [*ODD, "a b c a b c d\na b c\na b c\n \n \n", "é$ <b> | &", *[r.text for r in docs.collect()]]:
        assert rule_forest.statistics(text)[:5] == plain_statistics(text), text


def test_forest_rejects_junk_and_keeps_good(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    found = rule_forest.judge(table, labels).join(labels, "doc_id").where("not base_failed")
    good, bad = found.where("quality = 1"), found.where("quality = 0")
    assert good.where("kept").count() >= 0.99 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()
    assert found.where("base_failed and kept").count() == 0
    alone = rule_forest.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in alone) and len(alone) == docs.count()
    assert rule_forest.judge(empty, labels).count() == 0
    assert rule_forest.good_documents(docs, labels.limit(0)).columns == docs.columns


def test_transducer_equals_merging():
    import tiktoken

    ranks = bpe_transducer.read_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, tokens = bpe_transducer.BpeEncoder(ranks, public_tokenizers.PATTERN), bpe_transducer.TokenBytes(ranks)
    rng = random.Random(1)
    parts = ["a", "e", "th", "er", " ", "  ", "\n", "é", "日本", "😀", "aaaa", "-----", "1", "'s", "\t", "\xa0", " the", "!!"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == known.encode_ordinary(text)
        stream = bpe_transducer.StreamDecoder(tokens)
        assert "".join([*(stream.feed(ids[i : i + 1]) for i in range(len(ids))), stream.finish()]) == text


def test_round_trip_of_documents(docs, empty):
    got = bpe_transducer.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == want
    encoded = bpe_transducer.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    texts = bpe_transducer.decode_ids(encoded, RANKS, public_tokenizers.PATTERN, step=3)
    assert Counter((r.doc_id, r.text) for r in texts.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert bpe_transducer.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0

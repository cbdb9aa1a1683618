"""Merkle manifest, naive Bayes support vectors and prefix trie against brute force and held-out rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from partforge.llm import merkle, nb_svm, prefix_trie

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def brute_manifest(rows, fanout=2):
    """(doc_id, leaf) -> subroot, root, proof, folded root, of rows (doc_id, source, lang, n_chars, text)."""
    write = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda r: sha("".join(map(write, r)))
    steps = defaultdict(list)  # of a leaf or group, the siblings before and after

    def root_of(nodes):  # nodes: (digest, members)
        while len(nodes) > 1:
            above = []
            for i in range(0, len(nodes), fanout):
                run = nodes[i : i + fanout]
                for j, (_, members) in enumerate(run):
                    for m in members:
                        steps[m].append(("".join(x[0] for x in run[:j]), "".join(x[0] for x in run[j + 1 :])))
                above.append((sha("".join(x[0] for x in run)), [m for x in run for m in x[1]]))
            nodes = above
        return nodes[0][0]

    groups = defaultdict(list)
    for n, r in enumerate(rows):
        groups[r[2]].append((r[0] is not None, r[0] or 0, digest(r), n))
    subroots = {}
    for lang, leaves in groups.items():
        subroots[lang] = root_of([(x[2], [x[3]]) for x in sorted(leaves)])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root = root_of([(subroots[g], [x[3] for x in groups[g]]) for g in order]) if order else None
    found = []
    for n, r in enumerate(rows):
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        h = digest((*r[:3], r[3] + 1, r[4])) if bad else digest(r)
        for before, after in steps[n]:
            h = sha(before + h + after)
        proof = sha("".join(b + a for b, a in steps[n]))
        found.append((r[0], digest(r), subroots[r[2]], root, proof, h, h == root))
    return found


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, digest string"


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en", "de", None, "", "é", "zz"]), rng.choice([None, 3, 77]),
             rng.choice([None, "", "text", "ü" * 20_000])) for i in range(-20, 130)]
    rows += [(500, None, "one", 2**63 - 1, "x"), (None, "s", "en", 1, "t"), (None, "s", "en", 2, "t"), rows[7], rows[7]]
    return rows


def test_manifest_equals_brute_force(spark, leaves, rows):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in leaves], DOCS).repartition(5)
    got = rows(merkle.checked_documents(docs))
    assert got == sorted(brute_manifest(leaves), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (16, 1)])
def test_other_fanouts(spark, leaves, rows, fanout, levels):
    given = leaves[:60]
    docs = spark.createDataFrame(given, "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.row_digest(*[F.col(c) for c in docs.columns])
    made = merkle.manifest(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("group"), leaf.alias("leaf")), fanout, levels)
    path = F.col("path")
    got = rows(made.select("key", "leaf", "subroot", "root", merkle.proof_digest(path), merkle.folded(F.col("leaf"), path)))
    want = [(*r[:5], r[3]) for r in brute_manifest(given, fanout)]
    assert got == sorted(want, key=repr)


def test_manifest_of_none_and_one(spark, leaves, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.checked_documents(spark.createDataFrame([], schema)).count() == 0
    one = leaves[0]
    assert rows(merkle.checked_documents(spark.createDataFrame([one], schema))) == brute_manifest([one])


def brute_trie(turns):
    """The nodes of turns (conv_id, turn, role, text) as the operator names them."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in members:
        if x:
            children[x[:-1]] += 1
    for x in members:
        own_saved = (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in children
            saved[x[:d]] += own_saved
    found = []
    for x, who in members.items():
        ends = ",".join(str(c) for c in who if made[c] == x)
        parent = members[x[:-1]][0] if x else None
        found.append((who[0], len(x), parent, len(who), children[x], leaves[x], saved[x], sha(ends)))
    return found


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé"])) for c in range(120) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(12)]  # many copies
    rows += [(305, t, "user", str(t % 3)) for t in range(400)] + [(306, t, "user", str(t % 3)) for t in range(399)]  # long ones
    rows += [(None, 1, "user", "lost"), (400, None, None, None), (400, None, "user", "a"), (400, 1, "user", None), (401, 1, "u", "")]
    rows += [(-3, 1, "user", "a"), (-3, 1, "user", "a"), (-3, 0, "user", "b"), (404, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("most,shard", [(None, 1 << 16), (300, 50), (40, 1), (2, 7)])
def test_trie_equals_brute_force(spark, talks, rows, most, shard):
    schema = "conv_id long, turn long, role string, text string, name string, depth int"
    given = spark.createDataFrame([(*r, "clash", 1) for r in talks], schema).repartition(6)
    sizes, turns = prefix_trie.rebuilt_turns(prefix_trie.ordered_turns(given))
    got = rows(prefix_trie.trie(sizes, turns, most, shard), *NODE)
    assert got == sorted(brute_trie(talks), key=repr)


def test_trie_of_nothing(spark, rows):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.shared_prefixes(spark.createDataFrame([], schema)).count() == 0
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # borrows more than it has
    got = rows(prefix_trie.shared_prefixes(spark.createDataFrame([(lone, 0, "user", "x")], schema)), *NODE)
    assert got == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]


def test_perfect_hash():
    names = np.unique(np.random.default_rng(1).integers(0, 1 << 63, (50_000, 2)).astype("u8"), axis=0)
    table = prefix_trie.PerfectHash(names[::2])
    slots = table.slots(names[::2])
    assert sorted(slots) == list(range(len(slots))) and (table.names[slots] == names[::2]).all()
    assert (table.slots(names[1::2]) == -1).all()


def brute_indicators(text):
    words, out = (text or "").split(" "), []
    for i, w in enumerate(words):
        out.append("\x01" if i and w and w == words[i - 1] else w)
    raw = " ".join(out).encode()
    grams = {raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)}
    code = lambda g: (int.from_bytes(g, "big") * 8 + len(g)) * int(nb_svm.M1) % (1 << 64) >> (64 - nb_svm.BITS)
    return sorted({code(g) for g in grams})


def test_indicators_equal_brute_force(monkeypatch):
    texts = [None, "", "a", "a a a", "ab  ab ab", "é ü\nx", "one two two three", "w " * 500]
    for stretch in (nb_svm.STRETCH, 5):  # long texts are hashed in stretches
        monkeypatch.setattr(nb_svm, "STRETCH", stretch)
        indicators = nb_svm.Indicators()
        for text in texts:
            assert indicators.of(text).tolist() == brute_indicators(text)


def test_descent_finds_the_least_loss():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    labels, ratio = (rng.random(60) < 0.3).astype(int), rng.normal(size=30)
    weight, bias = nb_svm.descend(rows, labels, ratio, rounds=2000)
    x = np.zeros((60, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 30] = 1
    y = np.where(labels > 0, 1, -1)
    cost = np.where(labels > 0, 60 / (2 * labels.sum()), 60 / (2 * (60 - labels.sum())))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    found = loss(np.append(weight, bias))
    w = best = np.zeros(31)
    for t in range(1, 40_000):  # subgradient descent, slow and plain
        w = w - (w - (cost * y * (y * (x @ w) < 1)) @ x) / t
        best = w if loss(w) < loss(best) else best
    assert found <= loss(best) * 1.001


def test_counts_are_those_of_all_labelled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} common", "z") for i in range(60)] + [(3, "again", "z")], "doc_id long, text string, maybe string")
    labels = [(i, i % 2) for i in range(50)] + [(0, 1), (3, 1), (None, 1), (7, None)]
    caught = {}
    monkeypatch.setattr(nb_svm, "fitted", lambda r, y, p, n: caught.update(rows=r, labels=y, p=p, n=n))
    nb_svm.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    p, n = np.zeros(nb_svm.BUCKETS), np.zeros(nb_svm.BUCKETS)
    seen = 0
    for d, text, _ in [tuple(r) for r in docs.collect()]:
        if d < 50 and d != 0 and zlib.crc32(str(d).encode()) % 5:  # 0 has labels of both kinds
            (p if d % 2 else n)[brute_indicators(text)] += 1
            seen += 1
    assert (caught["p"] == p).all() and (caught["n"] == n).all() and len(caught["rows"]) == seen


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, labels = [(None, "no id"), (-1, None), (-2, ""), (-3, "long " * 30_000)], [(-2, 1), (None, 0)]
    for i in range(600):
        good = rng.random() < 0.8
        text = " ".join(word() for _ in range(60))
        rows.append((i, text if good else " ".join([word()] * 20) + " " + text if i % 2 else text.replace(" ", " | ")))
        labels.append((i, int(good or i % 2 == 0 and " | " not in rows[-1][1])))
    return rows, labels


def test_held_out_documents_are_judged(spark, judged, rows):
    given, labels = judged
    docs = spark.createDataFrame([(*r, "clash", 0.5) for r in given], "doc_id long, text string, maybe string, score double")
    got = rows(nb_svm.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")))
    assert len(got) == len(given)
    truth = dict(labels)
    for doc_id, held, score, predicted in got:
        assert held == (doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= 0.3)
    tried = [(truth[d], p) for d, h, _, p in got if h and d is not None and d >= 0]
    assert len(tried) > 90 and np.mean([a == b for a, b in tried]) > 0.95
    assert any(a == 0 for a, _ in tried)


def test_labels_of_one_kind_or_none(spark, rows):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    scores = {r[2] for r in rows(nb_svm.classify(docs, labels))}
    assert len(scores) == 1 and scores.pop() > 0.9
    none = {r[2] for r in rows(nb_svm.classify(docs, labels.limit(0)))}
    assert none == {0.5}
    assert nb_svm.classify(docs.limit(0), labels).count() == 0


def test_sample_is_bounded(spark, judged, monkeypatch):
    given, labels = judged
    docs, labels = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    caught = {}
    monkeypatch.setattr(nb_svm, "fitted", lambda r, y, p, n: caught.update(rows=r))
    nb_svm.learn(docs, labels, sample=50)
    assert 30 <= len(caught["rows"]) <= 50
    nb_svm.learn(docs, labels, most=1000)
    assert sum(map(len, caught["rows"])) <= 1000


# --- mended operators -----------------------------------------------------------------------


def test_unrelated_documents_do_not_meet():
    from collections import Counter

    from partforge.llm import ngram_join

    rng = np.random.default_rng(3)
    for size in (8, 56):
        met, n = Counter(), 20_000 if size == 56 else 5_000
        for _ in range(n):
            met.update(ngram_join.cell_keys(np.unique(rng.integers(0, 1 << 63, size).astype("u8")), 80, 100).tolist())
        assert max(met.values()) <= n // 100


@pytest.mark.parametrize("num", [80, 90])
def test_similar_sets_meet(num):
    from partforge.llm import ngram_join

    rng, tried = np.random.default_rng(5), 0
    for _ in range(3000):
        one = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 150))).astype("u8"))
        cut, more = (int(rng.integers(0, max(1, len(one) // 5) + 1)) for _ in range(2))
        two = np.unique(np.concatenate([one[cut:], rng.integers(0, 1 << 63, more).astype("u8")]))
        both = len(np.intersect1d(one, two))
        if 100 * both >= num * (len(one) + len(two) - both) and both:
            tried += 1
            assert set(ngram_join.cell_keys(one, num, 100)) & set(ngram_join.cell_keys(two, num, 100))
    assert tried > 500


def test_join_with_all_limits_small(spark, rows, monkeypatch):
    from partforge.llm import ngram_join

    for name, value in (("NODE_MOST", 8), ("LEAST_WEIGHT", 1), ("EARLY", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    data, base = [], [[word() for _ in range(80)] for _ in range(4)]
    for i in range(120):
        copy = list(base[i % 4])
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(80)] = word()
        data.append((i, " ".join(copy[: rng.choice([80, 80, 70, 12])])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets = {d: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for d, t in data}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = rows(ngram_join.near_duplicates(docs, 5, 80, 100, block=150))
    assert got == sorted(((d, len(s), find(d)) for d, s in sets.items()), key=repr)


def test_a_lost_payload_is_an_error(spark, tmp_path):
    from partforge.llm import warc

    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "key long, url string, payload string")
    warc.write_archive(pages, str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a" / "payloads")).limit(1)
    kept.write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    assert warc.read_archive(spark, str(tmp_path / "a")).count() == 2
    with pytest.raises(Exception, match="payload is lost"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_only_letters_are_letters():
    from partforge.llm.language_mixture import has_letter

    assert [has_letter(x) for x in ("½", "²", "①", "12_", "½é", "日", "")] == [False] * 4 + [True, True, False]


def test_wide_ids_keep_their_bits():
    from partforge.llm.curve_packing import written

    for ids in ([], [0, 65_535], [1, 65_536, 4_000_000_000]):
        raw = written(np.array(ids, np.uint32))
        assert np.frombuffer(raw, f"<u{raw[0]}", offset=1).tolist() == ids


def test_ids_beyond_the_vocabulary_are_refused():
    from partforge.llm.range_coder import encode_block

    for ids, vocabulary in (([5], 5), ([1], 70_000)):
        with pytest.raises(ValueError):
            encode_block(np.array(ids, np.uint32), vocabulary)


def test_remembered_units_are_bounded_by_their_length(monkeypatch):
    import public_tokenizers

    from partforge.llm import ngram_join, units

    monkeypatch.setattr(units, "MOST_CHARS", 1000)
    encoder = units.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    for i in range(5):
        encoder.encode([" ".join(f"{i}x{k}" + "y" * 200 for k in range(10))])
        assert encoder.chars <= 1000 + 10 * 220
    monkeypatch.setattr(ngram_join, "MOST_BYTES", 1000)
    for i in range(20):
        ngram_join.shingles(f"{i}" + "z" * 300, 1)
    assert ngram_join.word_hashes().size <= 1600


@pytest.mark.parametrize("size", [1100, 4000, 8100, 20_000])
def test_unrelated_large_sets_are_no_candidates(size):
    from partforge.llm import ngram_join

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype("u8")) for n in [size] * 10 + [int(size * 0.9)] * 10]
    sets.append(np.unique(np.concatenate([sets[0][: -size // 50], rng.integers(0, 1 << 63, 5).astype("u8")])))
    points = ngram_join.vectors([ngram_join.stored(x) for x in sets])
    assert ngram_join.forest(points, np.array([len(x) for x in sets]), 80, 100) == [(0, 20)]


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_with_signs_go_to_the_model(monkeypatch, name, blanks):
    import public_tokenizers

    from partforge.llm import units

    encoder = units.UnitEncoder(public_tokenizers.path(name), blanks)
    texts = ["One plain (text), with! signs... and### it's café, 12.", "\nA line_end\n\nand b-c.\n  two  blanks <|endoftext|>",
             "\n\tfoo 　 bar　baz", ""]
    seen, whole = [], encoder.together
    monkeypatch.setattr(encoder, "together", lambda u: seen.extend(u) or whole(u))
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert "it's" in seen and not {"plain", "with!", "signs...", "and###"} & set(seen)


def test_more_short_rows_are_worked_on_at_once():
    import pyarrow as pa

    from partforge.llm.staging import by_size

    short, long = (pa.RecordBatch.from_pydict({"text": [x] * 1100}) for x in ("a", "a" * 5000))
    assert [b.num_rows for b in by_size(short)] == [1024, 76]
    assert [b.num_rows for b in by_size(long)][:2] == [256, 256]


def test_new_words_cost_no_python_call_each():
    import sys

    import public_tokenizers

    from partforge.llm import units

    encoder = units.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    rng = np.random.default_rng(2)
    words = ["".join(x) for x in rng.choice(list("abcdefgé"), (5000, 9))]
    calls = []
    sys.setprofile(lambda frame, event, _: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        found = encoder.encode([" ".join(words)])[0]
    finally:
        sys.setprofile(None)
    assert len(calls) < len(words)
    assert found.tolist() == encoder.tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def test_coder_divides_only_for_ids_that_no_order_predicts(monkeypatch):
    from partforge.llm import range_coder

    ids = np.tile(np.arange(50, dtype=np.uint32), 2000)
    block, looked, target = range_coder.encode_block(ids, 49_408), [], range_coder.Reader.target
    monkeypatch.setattr(range_coder.Reader, "target", lambda self, lanes, bits: (
        looked.append(np.arange(len(self.at))[lanes].size), target(self, lanes, bits))[1])
    assert (range_coder.decode_block(block) == ids).all() and sum(looked) < len(ids) / 2


BLOCKS = [(1, 2, 824022581), (700, 300, 1125525822), (70_000, 49_408, 2877683300), (70_000, 65_536, 357353594)]


@pytest.mark.parametrize("n,vocabulary,crc", BLOCKS)
def test_blocks_keep_their_bytes(n, vocabulary, crc):
    from partforge.llm.range_coder import decode_block, encode_block

    at = np.arange(n, dtype=np.uint64)
    often, seldom = at // np.uint64(3) % np.uint64(40), (at * np.uint64(2654435761) >> np.uint64(9))
    ids = (np.where(seldom % np.uint64(5) < 2, seldom, often) % np.uint64(vocabulary)).astype(np.uint32)
    block = encode_block(ids, vocabulary)
    assert zlib.crc32(block) == crc and (decode_block(block) == ids).all()


def test_rows_are_worked_on_by_their_bytes():
    import pyarrow as pa

    from partforge.llm.staging import TOGETHER, by_bytes

    short, long = (pa.RecordBatch.from_pydict({"text": ["a" * n] * 3000}) for n in (1, 50_000))
    assert [b.num_rows for b in by_bytes(short)] == [3000]
    assert sum(b.num_rows for b in by_bytes(long)) == 3000
    assert max(b.num_rows for b in by_bytes(long)) * 50_000 <= TOGETHER
    assert [b.num_rows for b in by_bytes(short.slice(0, 0))] == []

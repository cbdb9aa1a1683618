"""The stages of the pipeline, each on what its predecessor kept, against brute force."""

import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables, with nulls, empty texts, repeated rows, copies and columns with clashing names."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0] + 1
    some = docs.where("n_chars between 800 and 4000").orderBy("doc_id").limit(6)
    near = some.withColumn("text", F.concat(F.col("text"), F.lit(" one more word")))
    copies = some.withColumn("text", F.upper("text"))
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(2).withColumn("text", F.lit("")))
    made = docs
    for i, part in enumerate((near, some, odd)):
        made = made.unionByName(part.withColumn("doc_id", F.col("doc_id") + top * (i + 1)))
    made = made.unionByName(some.limit(2)).unionByName(copies.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    made = made.withColumns({"key": F.lit("clash"), "maybe": F.lit(1), "node": F.col("source"), "n_words": F.lit(0)})
    made.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, tables):
    """What each stage got and gave, as rows."""
    given, found = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, tables)
        path = f"{tables}/{name}"
        made.write.parquet(path)
        after = spark.read.parquet(path)
        found[name] = ([r.asDict() for r in given.collect()], [r.asDict() for r in after.collect()], given.columns, after.columns)
        given = after
    return found


def test_stages_keep_their_columns_and_only_take_away(stages):
    for name, (before, after, columns, kept) in stages.items():
        if name != "packing":
            assert kept == columns and 0 < len(after) <= len(before)
            rows = [tuple(r.values()) for r in before]
            assert all(tuple(r.values()) in rows for r in after)


def test_language_takes_only_what_has_none(stages):
    before, after, *_ = stages["language"]
    assert not [r for r in after if not r["text"]]
    plain = [r for r in before if r["text"] and r["n_chars"] > 200]
    assert len([r for r in after if r["n_chars"] > 200]) >= 0.98 * len(plain)


def test_quality_keeps_good_documents(spark, stages):
    before, after, *_ = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    known = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1 and len(r["text"].split()) >= 60]
    assert sum(d in kept for d in known) >= 0.9 * len(known)
    assert all(len(r["text"].split()) >= 50 for r in after)


def test_exact_dedup_keeps_the_largest_id_of_a_text(stages):
    before, after, *_ = stages["exact_dedup"]
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    groups = {}
    for r in before:
        groups.setdefault(lower(r["text"]), []).append(r["doc_id"])
    want = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    assert sorted((lower(r["text"]), r["doc_id"]) for r in after) == sorted(want.items())


def test_near_dedup_keeps_one_of_each_component(stages):
    before, after, *_ = stages["near_dedup"]
    sets = {}
    for r in before:
        if r["doc_id"] is None:  # linked with nothing
            continue
        words = r["text"].encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
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
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(d for d in sets if find(d) == d)
    assert [r["doc_id"] for r in before].count(None) == [r["doc_id"] for r in after].count(None)
    assert len(after) < len(before)


def test_packing_holds_every_id_of_every_document_once(stages):
    before, after, *_ = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for p in after:
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(pieces) == {r["doc_id"] for r in before}
    for r in before:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p["length"]])
            assert zlib.crc32(raw) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_an_empty_corpus_gives_nothing(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

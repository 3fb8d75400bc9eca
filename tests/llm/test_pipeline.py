"""The pipeline's stages against brute force, on hard rows with columns that have the operators' own names."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from offermill.llm import bpe, langid

EXTRA = "score double, held_out string, n_words int, _nth int, _letter string, _hits string, bucket int, n_bytes string"


def rows():
    rnd = random.Random(6)
    words = {"aa": ["tha", "ing", "ound", "the", "bright", "stone"], "bb": ["çré", "eau", "ière", "oui", "lune", "mer"]}
    some = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    texts = [(some(k, rnd.randint(5, 60)), k) for k in ("aa", "bb") * 40]
    long = some("aa", 150)
    texts += [(long, "aa"), (long, "aa"), (long + " the end", None), (some("bb", 40) + " " + long[:300] + " " + some("bb", 40), "bb"), (None, "aa"), ("", None), ("12 !", "bb"), (some("aa", 9000), "aa")]
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts += [(some("aa", 10) + " " + passage, "aa"), (some("bb", 600) + " " + passage, "bb")]
    out = [(i * 2, t, k, "s", len(t or ""), 0.5, "x", 7, 8, "y", "z", 9, "w") for i, (t, k) in enumerate(texts)]
    return [*out, (None, *out[3][1:]), out[5]], passage


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    own, passage = rows()
    spark.createDataFrame(own, f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == columns and found.schema.simpleString() == docs.schema.simpleString()
        path = f"{folder}/{name}"
        found.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r.asDict() for r in docs.collect()]
        assert all((r["score"], r["held_out"], r["n_words"], r["_nth"], r["_letter"], r["_hits"], r["bucket"], r["n_bytes"]) == (0.5, "x", 7, 8, "y", "z", 9, "w") for r in kept[name])
    letters = [r for r in rows()[0] if r[1] and re.search("[a-zç]", r[1])]
    first = kept["language"]
    assert len(first) >= 0.95 * len(letters) and not {84 * 2, 85 * 2, 86 * 2} & {r["doc_id"] for r in first}

    sets = [shingles(r["text"]) for r in first]
    top = list(range(len(first)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(first)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (first[i]["doc_id"], first[j]["doc_id"]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(first):
        least[find(i) if r["doc_id"] is not None else ("none", i)].append(r["doc_id"])
    order = lambda x: (x is not None, x or 0)
    assert sorted((r["doc_id"] for r in kept["near_duplicates"]), key=order) == sorted((min(g, key=order) for g in least.values()), key=order)

    seen, want = {}, []
    ordered = sorted((r for r in kept["near_duplicates"] if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    for r in ordered:
        data = r["text"].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if seen.setdefault(data[i : i + 50], r["doc_id"]) < r["doc_id"]:
                gone[i : i + 50] = True
        left = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.all():
            want.append((r["doc_id"], left, len(left)))
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in kept["repeated_strings"] if r["doc_id"] is not None) == want

    judged = {}
    for r in kept["repeated_strings"]:
        w = re.findall("[a-z0-9\x80-\U0010ffff]+", r["text"].lower())
        item = rows()[1].split()
        hit = {p for i in range(len(w)) for k in range(2) if w[i : i + 13] == item[k : k + 13] for p in range(i, i + 13)}
        judged[r["doc_id"]] = bool(hit) and 20 * len(hit) >= len(w)
    assert any(judged.values()) and sorted((r["doc_id"] for r in kept["benchmark_passages"]), key=order) == sorted((d for d, bad in judged.items() if not bad), key=order)

    library = bpe.Encoder(bpe.vocabulary()).library
    pieces = pipeline.packed(spark, docs, folder).collect()
    by_doc = defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
    for r in kept["benchmark_passages"]:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[r["doc_id"]], key=lambda x: x.start)
        assert [(x.length, x.ids_crc32) for x in own] == [(x.length, zlib.crc32(ids[x.start : x.start + x.length].tobytes())) for x in own] and sum(x.length for x in own) == len(ids)


def test_runs_whole_and_on_an_empty_table(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    unlabelled = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert not langid.train(unlabelled).labels and pipeline.language(spark, unlabelled, folder).count() == unlabelled.count()

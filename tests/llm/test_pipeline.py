"""The corpus pipeline, stage by stage, against plain versions of what each stage does."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from velograph.llm import mixing, quality
from velograph.llm.queries import word_tokenizer

from .test_llm import DOCS, WORD, brute_components, brute_repeats, prose

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good, low and toxic documents of four sources, copies, shared passages, nulls, repeated rows and clashing columns."""
    rng = np.random.default_rng(21)
    good = [prose(rng, int(rng.integers(60, 160)), 4000) for _ in range(160)]
    passage = prose(rng, 70, 4000)
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(good)]
    rows += [(200 + i, prose(rng, 30, 4000) + " vile awful " + prose(rng, 30, 4000) + " vile", "en", "s0") for i in range(60)]
    rows += [(300 + i, " ".join(w.upper() + "!!##" for w in prose(rng, 50, 4000).split()), "en", "s1") for i in range(60)]
    rows += [(400 + i, good[i], "en", "s2") for i in range(8)]
    rows += [(420 + i, good[i + 10] + " once more", "fr", None) for i in range(8)]
    rows += [(440 + i, prose(rng, 40, 4000) + " " + passage + " " + prose(rng, 40, 4000), "en", "s3") for i in range(5)]
    rows += [(500, None, None, None), (501, "", "en", "s0"), (0, good[0], "en", "s0"), (0, good[0], "en", "s0"), (None, good[3], "en", "s1"), (None, prose(rng, 90, 4000), "en", "s1")]
    full = [(i, t, lang, s, None if t is None else len(t), "own", "own") for i, t, lang, s in rows]
    labels = [(r[0], int(not 300 <= r[0] < 400), int(200 <= r[0] < 300), "own") for r in rows if r[0] is not None and r[0] < 400] + [(None, 1, 0, "own"), (5, None, 0, "own")]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{out}/labels.parquet")
    return str(out)


def key(rows):
    return sorted(map(str, rows))


def test_every_stage(spark, folder, tmp_path):
    columns = DOCS.replace(" long", "").replace(" string", "").split(", ")
    docs, made = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        made.append((name, before, docs.collect(), docs.columns))
    assert [m[0] for m in made] == ["quality", "minhash_dedup", "substring_dedup", "mixing", "packing"]
    assert all(m[3] == columns for m in made[:-1])

    _, before, after, _ = made[0]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = quality.grade_documents(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("kept").groupBy("doc_id").count().collect()
    assert key((r["doc_id"], r["count"]) for r in kept) == key({i: (i, sum(r["doc_id"] == i for r in after)) for i in {r["doc_id"] for r in after}}.values())
    ids = {r["doc_id"] for r in after}
    assert len(ids & set(range(160))) > 150 and not ids & set(range(200, 360))
    assert not set(key(after)) - set(key(before))

    _, before, after, _ = made[1]
    stay = {i for (null, i), _, _, k in brute_components([(r["doc_id"], r["text"]) for r in before]) if k and not null}
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(stay)
    assert not [r for r in after if r["doc_id"] is None and r["text"] in {x["text"] for x in after if x["doc_id"] is not None}]
    assert not set(key(after)) - set(key(before))

    _, before, after, _ = made[2]
    want = {(i, n - gone) for i, n, gone, _ in brute_repeats([(r["doc_id"], r["text"]) for r in before]) if n == 0 or gone < n}
    assert {(str(r["doc_id"]), len(WORD.findall(r["text"] or ""))) for r in after} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)

    _, before, after, _ = made[3]
    taken = mixing.mix(spark.createDataFrame(before, DOCS)).collect()
    words = {}
    for r in after:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    want = {}
    for r in taken:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert words == {i: n for i, n in want.items() if n}
    full = {}
    for r in before:
        full.setdefault(r["doc_id"], []).append(WORD.findall(r["text"] or ""))
    assert all(any(WORD.findall(r["text"]) == t[: len(WORD.findall(r["text"]))] for t in full[r["doc_id"]]) for r in after)

    _, before, after, _ = made[4]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    want = []
    for r in before:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert key((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in after) == key(want)

    whole = corpus_pipeline.run(spark, folder)
    assert key(tuple(r)[:5] for r in whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()) == key(want)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The pipeline's stages on a small table with nulls, repeats, empties and clashing columns, each held against its plain version."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm.brute import ALNUM, SPACED, UPPER, contaminated
from martloom.llm import mixing, tokens, toxicity

CLASHES = ["_id", "_copies", "kept", "bad", "mix_id", "mix_at", "target", "size", "class_id", "score", "n_words"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4)))
    item = [word() for _ in range(20)]
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(rnd.randrange(20, 90))]
        bad = i % 7 == 0
        if bad:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["vile", "scurvy", "wretch"])
        if i % 11 == 0:
            w[3:3] = item
        rows.append((i, " ".join(w), "abc"[i % 3]))
        labels.append((i, int(bad)))
        if i % 10 == 3:
            c = list(w)
            c[0] = "altered"
            rows.append((1000 + i, " ".join(c), "a"))
    rows += [(2000, None, "a"), (2001, "", None), (None, "a text of no name " * 4, "b"), (2002, "  \n", "b"), rows[5], (2003, " ".join(word() for _ in range(6000)), "c")]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.select("*", F.lit("en").alias("lang"), *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    w = ALNUM.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]

    out = {name: None for name in steps}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, folder)
        if name != "tokens":
            assert out[name].columns == docs.columns
            out[name].write.parquet(f"{folder}/out-{name}")
            out[name] = docs = spark.read.parquet(f"{folder}/out-{name}")

    given = rows_of(spark.read.parquet(f"{folder}/documents.parquet"))
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r.score >= 0.5}
    assert Counter(rows_of(out["toxicity"])) == Counter(r for r in given if r[0] not in bad)
    assert len({i for i in range(0, 300, 7)} & bad) >= 40 and not {i for i in bad if i is None or i % 1000 % 7}

    before, after = rows_of(out["toxicity"]), rows_of(out["near_duplicates"])
    unnamed = [r for r in before if r[0] is None]
    texts = dict(r for r in before if r[0] is not None)
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]))[::-1]
                label = {k: new if v == old else v for k, v in label.items()}
    assert Counter(after) == Counter([(i, texts[i]) for i in set(label.values())] + unnamed)
    assert len(after) < len(before) - 5

    judged = contaminated(after, [(1, spark.read.parquet(f"{folder}/benchmark.parquet").filter("item_id = 1").first().text)])
    clean = rows_of(out["decontamination"])
    assert Counter(clean) == Counter(r for r in after if not judged[r[0]][4]) and len(clean) < len(after) - 5

    mixed = rows_of(out["mixing"])
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    plan = mixing.mix_plan(out["decontamination"]).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect()
    size = lambda t: len(SPACED.findall(t or ""))
    source = {(r.doc_id, r.text): r.source for r in out["decontamination"].collect()}
    for p in plan:
        assert abs(sum(size(t) for i, t in mixed if source[i, t] == p.source) - p.target) <= p.most / 2 + 1e-6

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in out["tokens"].collect())
    assert Counter(g[1:] for g in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ((i, ids(t)) for i, t in mixed))
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    order = [g[1] for g in got]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

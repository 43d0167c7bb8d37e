"""Operators against plain Python on a small table with nulls, empty and long texts, repeats and clashing columns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.brute import ALNUM, SPACED, UPPER, contaminated, without_repeats
from martloom.llm import decontam, lm, neardup, quality, substring, tokens, toxicity, urls

RND = random.Random(3)
VOCAB = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "e", "io", "uñ", "ur", "ond")]


def prose(n: int) -> list[str]:
    return [RND.choice(VOCAB) for _ in range(n)]


def table() -> list[tuple]:
    passage, item = prose(70), prose(30)
    base = prose(200)
    near = [w if i % 90 else "changed" for i, w in enumerate(base)]
    far = [w if i % 9 else "other" for i, w in enumerate(base)]
    texts = [None, "", "  \n\t ", "one", "one two three", " ".join(base), " ".join(near), " ".join(far), " ".join(base), " ".join(base).upper()]
    for _ in range(25):
        w = prose(RND.randrange(5, 160))
        if RND.random() < 0.5:
            at = RND.randrange(len(w))
            w[at:at] = passage[RND.randrange(15) :]
        if RND.random() < 0.4:
            w[0:0] = item[: RND.randrange(5, 30)]
        texts.append(". ".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)) if RND.random() < 0.5 else "\n".join(" ".join(w[i : i + 15]) for i in range(0, len(w), 15)))
    texts.append(" ".join(passage * 3 + prose(9000)))
    texts.append("a " * 300)
    texts.append("  double  spaces\u00a0and\r\nlines 😀 ñandú's 12,5 <|endoftext|>\x1cx")
    return list(enumerate(texts)), [(1, " ".join(item)), (2, " ".join(item[:13])), (10, "one two"), (3, None), (4, "...")]


DOCS, ITEMS = table()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" if i % 3 else None, 1, "x", 2.0) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, words string, at double")


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.judge(docs, items).collect()}
    import hashlib

    for k, v in contaminated(DOCS, ITEMS).items():
        r = got[k]
        assert (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) == v, k
    assert decontam.judge(docs.limit(0), items).count() == 0
    assert decontam.judge(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_does_not_rest_on_the_sieve(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {tuple(r) for r in decontam.judge(docs, items).select("doc_id", "n_hit").collect()}
    monkeypatch.setattr(decontam, "sieve_of", lambda keys: spark.sparkContext.broadcast(np.full(1 << (decontam.SIEVE_BITS - 6), ~np.uint64(0))))
    assert {tuple(r) for r in decontam.judge(docs, items).select("doc_id", "n_hit").collect()} == want


@pytest.mark.parametrize("share", [substring.SHARE, 1])
def test_substring(docs, share):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.without_repeats(docs, share=share).collect()}
    assert got == without_repeats(DOCS)
    if share > 1:
        assert substring.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share", [substring.SHARE, 3, 1])
def test_factors_are_what_their_sources_hold(docs, share):
    words = {i: (t or "").encode().split() for i, t in DOCS}
    found = {r.doc_id: r.runs for r in substring.factors(docs, share=share).collect()}
    assert found
    for i, runs in found.items():
        for r in runs:
            n = r.to - r["from"] + substring.WINDOW - 1
            assert r.doc < i and r.to > r["from"] and n >= substring.WINDOW
            assert words[i][r["from"] : r["from"] + n] == words[r.doc][r.at : r.at + n]


def test_longest_earlier_and_greedy():
    rnd = random.Random(8)
    for _ in range(200):
        parts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 14))] for _ in range(rnd.randrange(1, 9))]
        doc = [rnd.randrange(5) for _ in parts]
        at = [(p, k) for p, x in enumerate(parts) for k in range(len(x))]
        length, source = substring.longest_earlier(np.array(sum(parts, []), np.uint64), np.cumsum([len(x) for x in parts]), np.array(doc))
        for (p, k), n, s in zip(at, length.tolist(), source.tolist(), strict=True):
            shared = [next((j for j in range(14) if parts[p][k + j : k + j + 1] != parts[q][m + j : m + j + 1] or k + j >= len(parts[p])), 14) for q, m in at if doc[q] < doc[p]]
            assert n == max(shared, default=0)
            if n:
                q, m = at[s]
                assert doc[q] < doc[p] and parts[p][k : k + n] == parts[q][m : m + n]
        i, want = 0, []
        while i < len(at):
            want += [i] if length[i] else []
            i += max(int(length[i]), 1)
        assert substring.greedy(length) == want


def test_token_files(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    start, want = 0, {}
    for i, t in DOCS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.write_and_read(docs).collect()}
    assert got == want
    assert tokens.write_and_read(docs.unionByName(docs)).count() == 2 * len(DOCS)


def test_texts_reach_the_encoder_in_small_batches(spark, monkeypatch):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))  # 20 MB a task
    plain, setting = tokens.to_ids, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def watched(path):
        encode = plain(path)

        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes < 10 << 20, batch.nbytes
                    yield batch

            return encode(seen())

        return run

    monkeypatch.setattr(tokens, "to_ids", watched)
    got = tokens.write_and_read(docs)
    assert got.agg(F.count("*"), F.min("n_tokens"), F.max("n_tokens"), F.max("start")).first() == (4000, n := got.first().n_tokens, n, 3999 * n)
    assert spark.conf.get(setting) == before


def test_code_is_complete_and_short():
    counts = np.array([0, *[2**i for i in range(25)], 3, 3])
    lengths = tokens.code_lengths(counts, 12)
    assert lengths[0] == 0 and lengths.max() <= 12
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    ids = np.random.RandomState(1).choice(np.arange(1, len(counts)), 5000)
    bits, points = tokens.pack(ids, lengths, tokens.canonical(lengths))
    assert (tokens.Decoder(lengths).unpack(bits, points, len(ids)) == ids).all()


def test_pieces_give_the_library_s_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_tokenizer())
    small, large = tokens.Encoder(tokens.default_tokenizer(), 20), tokens.Encoder(tokens.default_tokenizer())
    rnd = random.Random(12)
    alphabet = ["a", "Zé", "ÿ", "×", "ª", "²", "1", "42", "'", "'s", "'st", "!", "?)", "_", "`", "\x01", "\x1c", "\x7f", "\x85", "\u00a0", "\u3000", " ", "  ", "\n", "\n ", "\t", "\r\n", "\u0301", "ж", "中", "😀", "<|", "<|endoftext|>", "|>", "ɏ", "ɐ"]
    texts = [t or "" for _, t in DOCS] + ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 30))) for _ in range(3000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (small, large):
        got = [np.frombuffer(x, encoder.type).tolist() for i in range(0, len(texts), 100) for x in encoder.encode(pa.array(texts[i : i + 100]))]
        assert got == want
    assert "<|endoftext|>" in "".join(texts)


def test_katz(docs):
    rows = {r.doc_id: r for r in lm.score(docs).collect()}
    toks = {i: [*SPACED.findall((t or "").translate(UPPER)), "\0"] for i, t in DOCS}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    uni, bi, seen, total = Counter(), Counter(), defaultdict(dict), Counter()
    for i in train:
        uni.update(toks[i])
        pairs = list(zip(["\1", *toks[i]], toks[i], strict=False))
        bi.update(pairs)
        total.update(h for h, _ in pairs)
    n, v = sum(uni.values()), len(uni)
    kinds = lambda c: lm.discounts([float(sum(x == r for x in c.values())) for r in range(1, lm.CUT + 2)])
    d1, d2 = kinds(uni), kinds(bi)
    p = {w: (d1[c] if c <= lm.CUT else 1) * c / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    for (h, w), c in bi.items():
        seen[h][w] = c

    def history(h):
        if h not in seen:
            return {}, 1.0
        freed = sum(c * (1 - (d2[c] if c <= lm.CUT else 1)) for c in seen[h].values())
        below = total[h] if freed > 0 else total[h] + 1
        probs = {w: (d2[c] if c <= lm.CUT else 1) * c / below for w, c in seen[h].items()}
        return probs, (freed if freed > 0 else 1) / below / (1 - sum(p[w] for w in probs))

    for h in ["\1", VOCAB[0], "one", "unheard"]:
        probs, alpha = history(h)
        assert sum(probs.values()) + alpha * (sum(x for w, x in p.items() if w not in probs) + unknown) == pytest.approx(1)
    for i, t in toks.items():
        r = rows[i]
        logs, h = 0.0, "\1"
        for w in t:
            probs, alpha = history(h)
            logs += math.log10(probs.get(w) or alpha * p.get(w, unknown))
            h = w
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in uni for w in t), n, i not in train)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(logs)
    again = {r.doc_id: r for r in lm.score(docs, chunk_tokens=500, part_tokens=97).collect()}  # many parts: other ids, other frequent histories
    assert all(again[i].score == pytest.approx(rows[i].score) and again[i].n_known == rows[i].n_known for i in toks)
    assert lm.score(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    sets = {}
    for i, t in DOCS:
        w = ALNUM.findall((t or "").translate(UPPER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = label[b], label[a]
                label = {k: min(old, new) if x in (old, new) else x for k, x in label.items()}
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == label
    assert {r.doc_id for r in neardup.deduplicated(docs).select("doc_id").collect()} == set(label.values())
    assert neardup.classes(docs.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.RandomState(0)
    ids = rnd.randint(0, 1 << 62, 300).astype(np.uint64)
    a, b = rnd.choice([0.5, 1, 2, 7], 300), rnd.choice([0.5, 1, 2, 7], 300)
    rows = np.repeat([0, 1], 300)
    sig = neardup.signatures(rows, np.tile(ids, 2), np.concatenate([a, b]), 2, 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)


def test_toxicity_learns_from_document_labels(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        parts = [" ".join(rnd.choice(VOCAB) for _ in range(8)) for _ in range(rnd.randrange(1, 6))]
        if bad:
            parts[rnd.randrange(len(parts))] += " vile" + rnd.choice(VOCAB)
        rows.append((i, ". ".join(parts), "x"))
        labels.append((i, int(bad), 9))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model, locate=0.5).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(labels[i][1]) for i in held) >= 0.97 * len(held)
    for i in held:
        if labels[i][1] and got[i].score >= 0.5:
            assert any("vile" in rows[i][1][s.start : s.end] for s in got[i].sentences)
    assert 0 <= got[1000].score < 0.5 and got[1000].score == got[1001].score
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0} or all(r.score < 0.5 for r in toxicity.score(docs, none).collect())


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?q", "block"), (2, None, ""), (3, "no scheme", ""), (4, "x://example.com/de/y", ""), (5, "x://example.com/d", ""), (6, "x://notexample.com/de/", ""), (7, "x://a.org/fr/", ""), (8, "x://foo.net", ""), (9, "x://foo.net/", ""), (10, "x://www.casino-win.org/en/", ""), (11, "x://casinox.org/", ""), (1, "http://A.Example.NET/en/x?q", "block"), (12, "x:///p", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    words = spark.createDataFrame([("*casino", "block"), ("*", "block"), ("*never", None)], "entry string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, urls.RULES, words).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.com", "/de/y", "example.com/de/", "block"), (5, "example.com", "/d", None, "allow"),
        (6, "notexample.com", "/de/", None, "allow"), (7, "a.org", "/fr/", "org/fr/", "allow"), (8, "foo.net", "", None, "allow"), (9, "foo.net", "/", "net/", "block"), (10, "www.casino-win.org", "/en/", None, "block"), (11, "casinox.org", "/", None, "allow"), (12, "", "/p", None, "allow"),
    }
    assert urls.judge(pages, urls.RULES).count() == len(rows)
    assert urls.judge(pages.limit(0), ()).count() == 0


def test_given_hosts_and_long_urls(spark):
    rows = [(1, "x://a.bad.org/p/q?r", "k"), (2, "x://notbad.org/", "k"), (3, "x://h.net" + "/ab" * 5000 + "/", "k"), (4, "x://" + "s." * 300 + "bad.org", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, key string")
    hosts = spark.createDataFrame([("bad.org", "block"), (None, "block"), ("", "block"), ("h.net", "allow")], "entry string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, (("net/ab/", "allow"), ("org/p/q/", "block")), hosts).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: ("net/ab/", "allow"), 4: (None, "block")}


def test_a_million_entries_and_a_hot_host(spark):
    n = 1_000_000
    i = F.col("id")
    entry = F.when(i % 3 == 0, F.concat(F.lit("h"), i, F.lit(".example"))).when(i % 3 == 1, F.concat(F.lit("big.example/a/"), i, F.lit("/"))).otherwise(F.concat(F.lit("s.example/x/y/"), i, F.lit("/")))
    listed = spark.range(n).select(entry.alias("entry"), F.when(i % 2 == 0, "block").otherwise("allow").alias("verdict"))
    hot = [(k, f"http://www.big.example/a/{k * 97}/p{k}") for k in range(4000)]
    rows = [*hot, *((10_000 + k, f"x://a.h{k}.example/z") for k in range(60)), (20_000, "x://s.example/x/y/2/q"), (20_001, "x://s.example/x/y/"), (20_002, "x://big.example/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, (("example/", "allow"),), listed, shards=3).collect()}
    assert len(got) == len(rows)
    for k, _ in hot:
        e = k * 97
        want = (f"big.example/a/{e}/", "allow" if e % 2 else "block") if e % 3 == 1 and e < n else ("example/", "allow")
        assert got[k] == want, k
    for k in range(60):
        assert got[10_000 + k] == ("example/", "allow")  # a rule goes before a listed host
    assert (got[20_000], got[20_001], got[20_002]) == (("s.example/x/y/2/", "block"), ("example/", "allow"), ("example/", "allow"))


def test_the_query_blocks_words_as_its_sql_does(spark, tmp_path):
    hosts = ["www.casino-win.org", "CASINO.example.com", "casinox.org", "a-ads.b", "x.pills", "spam-farm.org", "spam.example.net", "poker", "adult_shop.de", "porn..b", "", "ads.\n", "ads\n"]
    rows = [(100 * i + j, f"http://{h}{path}") for i, h in enumerate(hosts) for j, path in enumerate(("", "/", "/fr/x", "/en/", "?casino.org/fr/", ":80/"))] + [(-1, None), (-2, "casino.org")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in urls.query(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(db.execute(urls.SQL).fetchall())
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[k] for k in (0, 2, 100, 200, 300, 400, 500, 600, 800, -2)] == ["block", "allow", "block", "allow", "block", "block", "block", "block", "allow", "allow"]


def test_digest_array_tells_collisions(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: 7)
    array = urls.DigestArray(["a", "b"], ["block", "allow"])
    places = array.probe(["b", "c", "a"])
    assert [array.strings[p] if p >= 0 else None for p in places] == ["b", None, "a"]


def test_quality(spark):
    common, own = "the very same line of a page footer", prose(80)
    rows = [(i, "\n".join([common] * (6 if i == 0 else 1) + [" ".join(prose(60 if i else 4))]), "h") for i in range(40)]
    rows += [(50, None, None), (51, "", "h"), (52, " ".join(own[:10] * 9), "h"), (52, " ".join(own[:10] * 9), "h"), (53, " ".join(own) + "\n\n" + "x #* |\nx #* |", None)]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kept boolean")
    got = {r.doc_id: r for r in quality.judge(docs, min_docs=20, share=0.02).collect()}
    assert (got[0].n_dup_lines, got[0].n_line_words) == (5, 48) and got[0].base_failed
    assert got[1].kept and got[1].n_line_words == 8
    assert got[50].n_words == 0 and got[51].base_failed and not got[51].kept
    assert got[52].n_repeat_words == 90 and got[52].base_failed
    assert (got[53].n_words, got[53].n_symbols, got[53].n_dup_lines, got[53].n_repeat_words) == (86, 6, 1, 6)
    assert quality.judge(docs).count() == len(rows)
    assert quality.judge(docs.limit(0)).count() == 0


def test_word_ids_have_no_gaps():
    counts = [np.array([0, 3, 1, 1, 7, 1]), np.array([1, 3, 0, 3, 1]), np.array([0])]
    classes = Counter(int(c) for part in counts for c in part if c)
    u = lm.Unigrams(list(classes.items()), 3)
    starts: dict[int, int] = defaultdict(int)
    ids = []
    for part in counts:
        ids.append(u.ids(part, dict(starts)))
        for c in part:
            starts[int(c)] += 1
    every = np.concatenate(ids)
    known = every[every >= lm.FIRST_ID]
    assert sorted(known.tolist()) == list(range(lm.FIRST_ID, lm.FIRST_ID + sum(classes.values())))
    assert (u.count(every.astype(np.uint64)) == np.concatenate(counts)).all()


def test_words_of_a_trillion_tokens_fit():
    # Zipf: 1e12 / 25 / r occurrences of the r-th word; classes of the rare ones by how many words have a count.
    top, tokens = 10_000, 1e12
    classes = [(int(tokens / 25 / r), 1) for r in range(1, top)]
    rare = [(c, int(tokens / 25 / c - tokens / 25 / (c + 1))) for c in [*range(40, 4000), *np.unique(np.geomspace(4000, tokens / 25 / top, 2000).astype(int)).tolist()]]
    u = lm.Unigrams(list(Counter({c: n for c, n in rare}).items()) + classes, 250_000)
    assert 2 * u.width <= 64 and u.words > 5e8

"""Lexical search, the conversation trie and language ID against plain versions, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.brute import UPPER
from martloom.llm import langid, lexical, trie

RND = random.Random(11)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = [f"{a}{b}" for a in "bdfglmrt" for b in ("a", "e", "io", "ñu", "o9")]


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(qn * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, qn in q.items() if c[t])
            scores += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def search_tables() -> tuple[list, list]:
    zipf = lambda n: [WORDS[min(int(RND.paretovariate(0.7)) - 1, len(WORDS) - 1)] for _ in range(n)]
    docs = [(i, " ".join(zipf(RND.randrange(1, 60)))) for i in range(180)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # ties beyond the k best
    docs += [(2000, None), (2001, ""), (2002, "!! ... ;"), (2003, "ba " * 30_000), (3, docs[3][1]), (None, docs[3][1]), (2004, "BA,Be:ba"), (2005, "straße ÑU ñu")]
    items = [(i, " ".join(zipf(RND.randrange(1, 25)))) for i in range(9)] + [(20, None), (21, ""), (22, "unheard of"), (23, docs[3][1]), (23, "ba ba"), (None, "ba"), (24, "Straße ñu")]
    return docs, items


@pytest.mark.parametrize(("owners", "group", "block"), [(4, 256, 1 << 14), (1, 256, 16), (3, 2, 16)])
def test_search(spark, monkeypatch, owners, group, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    docs, items = search_tables()
    rows = spark.createDataFrame([(d, t, 1, 2.0) for d, t in docs], "doc_id long, text string, term int, score double").repartition(3)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.search(rows, asked, k=20, owners=owners, group=group).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(docs, items, 20)
    if block > 16:
        assert lexical.search(rows.limit(0), asked).count() == lexical.search(rows, asked.limit(0)).count() == 0


def test_limits_share_postings():
    assert lexical.limits([(9, 10), (5, 10), (4, 10), (1, 10)], 4) == [9, 5, 4]
    assert lexical.limits([(9, 1), (1, 99)], 3) == [1, 1] and lexical.limits([], 4) == [0, 0, 0][:0]


def rebuilt(rows: list[tuple]) -> dict[int, list]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, bytes.fromhex(hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + turns[c][h:]
    return out


def nodes(rows: list[tuple]) -> list[tuple]:
    members = defaultdict(list)
    for c, t in sorted(rebuilt(rows).items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append((c, d == len(t)))
    out = []
    for k, m in members.items():
        below = [q for q in members if q[: len(k)] == k]
        kids = [q for q in below if len(q) == len(k) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c, end in m if end)
        out.append((m[0][0], len(k), members[k[:-1]][0][0] if k else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations() -> list[tuple]:
    rows = []
    say = lambda: (RND.choice(["user", "assistant", None]), RND.choice(["a", "bb", "ñ😀", "", None, "dddd"]))
    for c in [*range(40), *range(100, 130), 505, 507, -7, 10_000]:
        rows += [(c, t, *say()) for t in range(RND.randrange(1, 9))]
    for c in range(300, 380):  # copies of one conversation
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(400, None, "user", "first"), (400, 0, "user", "second"), (400, 0, "user", "second"), (401, 2, "user", "late"), (None, 1, "user", "of nobody")]
    return rows + [(600, t, "user", f"t{t}") for t in range(150)] + [(601, 0, "user", "long " * 20_000)]


@pytest.mark.parametrize("turns", [400_000, 20])
def test_trie(spark, turns):
    rows = conversations()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(3)
    got = trie.nodes(trie.rebuilt(table), shard_turns=turns).collect()
    want = nodes(rows)
    assert len(got) == len(want)
    assert sorted((tuple(r) for r in got), key=str) == want
    if turns > 20:
        assert trie.trie(table.limit(0)).count() == 0


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    a[:100] = a[0]  # half of the digest alone doesn't tell them apart
    slots = trie.Slots(a, b)
    assert sorted(slots.find(a, b)) == list(range(5000))
    assert (slots.find(a, b + np.uint64(1)) == -1).all() and len(slots.find(a[:0], b[:0])) == 0


ALPHABETS = {"aa": "abcde", "bb": "defgh", "cc": "hijñé"}


def speech(lang: str, n: int) -> str:
    return " ".join("".join(RND.choices(ALPHABETS[lang], k=RND.randrange(2, 8))) for _ in range(n))


def plain_scores(model, text: str) -> np.ndarray:
    """The model's scores from sets of n-grams in plain Python."""
    code = "".join(chr(x) if x >= 128 or 97 <= x < 123 else " " for x in (text or "").translate(UPPER).encode())
    code = " " + re.sub(" +", " ", code).strip() + " "
    number = {int(g): i for i, g in enumerate(model.alphabet.grams)}
    out = np.array(model.intercepts, float)
    for n, part in langid.BLEND.items():
        held = {(n << 56) | sum((0 if x == " " else ord(x)) << 8 * j for j, x in enumerate(code[i : i + n])) for i in range(len(code) - n + 1)} & set(number)
        if held:
            out += sum(model.weights[number[g]].astype(float) for g in held) * math.sqrt(part / len(held))
    return out


def test_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 300)
    rows = [(i, speech(lang, RND.randrange(1, 30)), lang) for i, lang in enumerate(list(ALPHABETS) * 40)]
    rows += [(200 + i, rows[0][1], "aa") for i in range(60)] + [(300, "abc def", None), (301, None, "aa"), (302, "12 34!", "bb")]
    odd = [(400, None, None), (401, "", None), (402, "12 ... 😀", None), (403, speech("bb", 3000), None), (404, "Ωδε ж", None), (405, "HIJÑÉ hhh", None), (406, "iñ", None), (None, "abc aab cba", None), (406, "iñ", None)]
    schema = "doc_id long, text string, lang string, lang_pred string, score int"
    known, every = (spark.createDataFrame([(*r, "x", 1) for r in t], schema).repartition(3) for t in (rows, rows + odd))
    model = langid.fit(known, landmarks=10, trained=30)
    got = [tuple(r) for r in langid.predict(every, model).collect()]
    assert Counter(d for d, _, _ in got) == Counter(d for d, _, _ in rows + odd)
    by_id = {d: (lang, s) for d, lang, s in got}
    texts = {d: t for d, t, _ in rows + odd}
    for d, (lang, s) in by_id.items():
        if not re.search(r"[^\W\d_]", texts[d] or ""):
            assert (lang, s) == ("und", 0.0)
        else:
            want = plain_scores(model.value, texts[d])
            assert s == pytest.approx(float(np.clip(want.max(), 0, 1)), abs=1e-4) and want[model.value.langs.index(lang)] == pytest.approx(want.max(), abs=1e-4)
    right = [by_id[d][0] == lang for d, t, lang in rows if lang and t and re.search("[a-z]", t)]
    assert sum(right) / len(right) > 0.95
    assert by_id[403][0] == "bb" and by_id[405][0] == "cc" and by_id[406][0] == "cc" and by_id[None][0] == "aa"
    empty = langid.fit(known.limit(0))
    assert {tuple(r)[1:] for r in langid.predict(every, empty).collect()} == {("und", 0.0)}
    assert langid.predict(every.limit(0), model).count() == 0


def test_alphabet_finds_every_gram():
    grams = np.unique(langid.n_grams(langid.letters(np.frombuffer(speech("aa", 4000).encode(), np.uint8)), 4))
    alphabet = langid.Alphabet(grams)
    assert sorted(alphabet.find(np.concatenate([grams, grams + np.uint64(1 << 40)])).tolist()) == list(range(len(grams)))

import math
import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodegram.llm import bpe, licenses, line_dedup, minhash_dedup, mixing, neighbours, page_diff, perplexity, toxicity, url_filter
from lodegram.llm.common import Words, mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, path string, n string, keep string"
LABELS = "doc_id long, quality int, toxic int"
LOREM = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew some very strange potions near an old stone bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(LOREM) for _ in range(n))


def frame(spark, rows, schema=DOCS):
    """Rows with the columns' clashing names, through Parquet-free DataFrames."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", "y", None, "z") for i, t, lang, src in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty and a very long text, ties, repeated rows, clashing names."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 40) for _ in range(1500))
    copy = prose(rng, 60)
    rows = [(1, copy, "en", "a"), (1, copy, "en", "a"), (2, None, "en", "b"), (3, "", None, None), (None, prose(rng, 30), "en", "a"), (5, long, "en", None), (6, " \n\t", "fr", "a"), (7, "x", None, "b"), (None, None, None, None)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 1), (7, 0, None), (99, 1, 1)], LABELS)


# 1 perplexity


def test_perplexity(spark, odd, none):
    got = perplexity.perplexity(spark, odd).toPandas()
    assert len(got) == odd.count()
    assert got[got.n_chars == 0].perplexity.isna().all() and (got[got.n_chars == 0].verdict == "keep").all()
    assert perplexity.perplexity(spark, none).count() == 0


def test_perplexity_bands_and_probabilities(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en", "a") for i in range(120)] + [(900, "na " * 120, "en", "a"), (901, "".join(rng.choice("qxzvkj#@!") for _ in range(300)), "en", "a")]
    docs = frame(spark, rows)
    verdict = {r.doc_id: r.verdict for r in perplexity.perplexity(spark, docs).collect()}
    assert verdict[901] == "high" and sum(v != "keep" for k, v in verdict.items() if k < 900) <= 2
    # modified Kneser-Ney by hand, from the definition
    path = perplexity.train(spark, docs.where("doc_id < 20"))
    model = perplexity.Model(path, "en")
    ids, _ = perplexity.characters([r[1] for r in rows[:20]])
    grams = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4) if ids[i + 4])
    counts = {5: grams}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, mass = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        disc[k] = [max(0.1, min(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else 0.5 * i, i - 0.05)) for i in (1, 2, 3)]
        mass[k] = {}
        for g, v in c.items():
            m = mass[k].setdefault(g[:-1], [0, 0.0])
            m[0] += v
            m[1] += disc[k][min(v, 3) - 1]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / (len(counts[1]) + 1.0)
        total, left = mass[k][g[:-1]]
        return (counts[k][g] - disc[k][min(counts[k][g], 3) - 1] + left * low) / total

    some = list(grams)[:200]
    code = np.array([sum(int(x) << (12 * (4 - i)) for i, x in enumerate(g)) for g in some], np.uint64)
    assert np.allclose(model.log_p(code), [math.log(p(g)) for g in some], atol=1e-4)


def test_perplexity_characters(spark):
    """The padding's own character, and languages with more characters than there are shared ids."""
    rng = random.Random(22)
    han = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, "".join(rng.choice(han) for _ in range(200)), "zh", "a") for i in range(30)] + [(50 + i, prose(rng, 30) + " \u201cquoted\u201d", "en", "a") for i in range(20)] + [(90, "a\U0010ffffb \U0010ffff", "en", "a"), (91, "\U0010ffff", None, "a")]
    docs = frame(spark, rows)
    assert perplexity.perplexity(spark, docs).count() == len(rows)
    path = perplexity.train(spark, docs)
    zh, en = perplexity.table_of(path, "zh"), perplexity.table_of(path, "en")
    used = {c for _, t, lang, _ in rows if lang == "zh" for c in t}
    assert len({int(zh[ord(c)]) for c in used}) == len(used) > 2500 and zh[32] == 32 and 0 not in zh[1:] and zh.max() < 4096
    assert en[ord("a")] == perplexity._ID[ord("a")] and en[0x201C] != en[0x201D] and en[0x201C] >= 3072
    ids, start = perplexity.characters(["a\U0010ffffb", "c"])
    assert len(start) == 2 and (ids == 0).sum() == 8


# 2 URL filters


def test_urls(spark):
    rules = url_filter.rule_table(spark, [*url_filter.RULES, url_filter.RULES[0]])
    urls = ["http://a.casino-win.example.com/x", "https://CASINO-win.example.com.:8080", "http://notcasino-win.example.com/", "http://free-bets.example.com/fr/x?y", "http://free-bets.example.com/de", None, "", "no url", "https://u:p@www.spam-farm.example.com/de/1#f", "http://example.net/es/", "http://therhe.example.org/en/8423?utm_source=feed", "http://therhe.example.org/en/8423?z"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string, action string")
    got = {r.page_id: r.action for r in url_filter.filter_urls(spark, pages, rules).collect()}
    assert [got[i] for i in range(len(urls) + 1)] == ["block", "block", "none", "allow", "block", "none", "none", "none", "allow", "block", "allow", "block", "block"]
    assert url_filter.filter_urls(spark, pages.where("false"), rules).count() == 0
    assert {r.action for r in url_filter.filter_urls(spark, pages, rules.where("false")).collect()} == {"none"}


def test_url_forms(spark):
    """Hosts that are addresses, escapes, dots in paths, and very long URLs, against prefixes compared one by one."""
    rules = url_filter.rule_table(spark, [("3.4", "/", "block"), ("10.0.3.4", "/in/", "block"), ("[::1]", "/", "block"), ("x.example.com", "/bad/", "block"), ("x.example.com", "/bad/a/b/c/d/e/", "allow"), ("example.org", "/q?a=~b", "block")])
    deep = "/".join(f"f{i}" for i in range(100_000))
    cases = {
        "http://10.0.3.4/": "none", "http://10.0.3.4/in/x": "block", "http://[::1]:80/a": "block", "http://user@[::1]/": "block", "http://[::2]/": "none",
        "http://x.example.com/%62ad/": "block", "http://x.example.com/b%61%64/x": "block", "http://x.example.com/a/../bad/x": "block", "http://x.example.com/./bad/./x": "block", "http://x.example.com/bad/..": "none",
        "http://x.example.com/../../bad/": "block", "http://x.example.com/a%2Fbad/": "none", "http://x.example.com/%2e%2e/bad/": "block", "http://x.example.com/bad/a/b/c/d/e/f": "allow", "http://x.example.com/bad/%": "block",
        "http://www.example.org/q?a=%7Eb": "block", "http://www.example.org/q?a=/../b": "none", f"http://x.example.com/bad/{deep}": "block", f"http://x.example.com/{deep}": "none", f"http://x.example.com/{'../' * 100_000}bad/": "block", "http://" + "a." * 100_000 + "x.example.com/bad/": "block",
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r.action for r in url_filter.filter_urls(spark, pages, rules).select("page_id", "action").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


# 3 toxicity


def test_grammar():
    g = toxicity.Grammar()
    score = g.score
    assert score("You are an idiot.") == 1.0 and score("an idiot sat there") == 0.6
    assert score("you are not an idiot") < 0.2 and score("they said you are an idiot") == pytest.approx(0.3)
    assert score("I will kill you") == 1.0 and score("kill the process") == 0 and score("") == 0 and score("idiotic, eidiots") == 0
    for text, want in {"The sun can burn your skin.": 0, "You can beat them at chess.": 0, "They hang their coats here.": 0, "I'm going to murder all of you": 1, "We won't ever kill you": 0.1, "Kill yourself": 1, "I will hurt you": 0.6, "Beat them at chess": 0.6, "They said I will kill you": 0.3, "you will kill i": 0}.items():
        assert score(text) == pytest.approx(want), text
    # in a text of many clauses some insults are fewer
    assert score("an idiot. " * 2 + "a fine day. " * 1000) == pytest.approx(1.2 / (1002 / toxicity.CLAUSES))
    # the composed automaton equals the definition
    rng = random.Random(3)
    for _ in range(2000):
        symbols = [(rng.randrange(8), rng.choice([1.0, 0.6])) for _ in range(rng.randrange(12))]
        left = [(0.1 if any(x == toxicity.NEGATION for x, _ in symbols[max(0, i - toxicity.REACH) : i]) else 1) * (0.3 if any(x == toxicity.REPORT for x, _ in symbols[:i]) else 1) for i in range(len(symbols))]
        insults = sum(w * f for (s, w), f in zip(symbols, left) if s == toxicity.INSULT)
        text = "".join("oiHTnrGp"[s] for s, _ in symbols)
        verbs = [m.start("verb") for m in re.finditer(r"(?:^|G[^GH]{0,4})(?P<verb>H)[^GT]{0,2}T", text)]
        # a verb is the last one that was weighed when its object comes
        threats = sum(left[i] * [w for s, w in symbols[: text.index("T", i)] if s == toxicity.THREAT][-1] for i in verbs)
        aimed = any(x in (toxicity.TARGET, toxicity.PERSON) for x, _ in symbols)
        assert toxicity.clause_score(symbols) == pytest.approx(insults * (1 if aimed else 0.6) + threats), text


def test_learned_lexicon(spark):
    """Words that many toxic and few other documents have, as counted by hand."""
    rng = random.Random(19)
    rows, lab = [], []
    for i in range(60):
        words = [rng.choice(LOREM) + rng.choice(["", "s", "ing"]) for _ in range(25)]
        if i % 2:
            words[rng.randrange(12)] = "zorgle"
            words[12 + rng.randrange(12)] = rng.choice(["snarkish", "snarkling"])
        rows.append((i, " ".join(words), "en", "a"))
        lab.append((i, 1, i % 2))
    docs, labels = frame(spark, rows), spark.createDataFrame(lab, LABELS)
    learned = toxicity.learn_lexicon(spark, docs, labels)
    assert ("zorgle", False) in learned or any("zorgle".startswith(w) and stem for w, stem in learned)
    contexts, clean = {}, Counter()
    for i, text, *_ in rows:
        words = text.split()
        keys = [[(w, False), *((w[:n], True) for n in toxicity.STEMS if len(w) > n)] for w in words]
        if i % 2:
            for prior, w, ks in zip(["", *words], words, keys):
                for k in ks:
                    contexts.setdefault(k, set()).add((prior, w))
        else:
            clean.update({k for ks in keys for k in ks})
    good = {k for k, c in contexts.items() if len(c) >= toxicity.MIN_CONTEXTS and clean[k] <= toxicity.MAX_CLEAN * len(c)}
    stems = {w for w, stem in good if stem}
    assert learned == sorted(k for k in good if not any(k[0][:n] in stems for n in toxicity.STEMS if n < len(k[0])))
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark, docs, labels).collect()}
    grammar = toxicity.Grammar(learned)
    assert got == {i: pytest.approx(grammar.score(t)) for i, t, *_ in rows} and all(got[i] >= 1 for i in range(1, 60, 2)) and not any(got[i] for i in range(0, 60, 2))


def test_quoted_speech():
    score = toxicity.Grammar().score
    for text in ('They said: "you are an idiot"', "They said, you are an idiot", "She wrote: « you are an idiot »", 'He said: "Go. You are an idiot."', "Er sagte: „du idiot“"):
        assert score(text) == pytest.approx(0.3), text
    for text in ("They said so. You are an idiot", "They said\nyou are an idiot", 'They said: "Go." You are an idiot', '"Go", you are an idiot'):
        assert score(text) == 1.0, text


def test_toxicity(spark, odd, none, labels):
    got = toxicity.toxicity(spark, odd, labels)
    assert got.count() == odd.count() and got.where("toxic").count() == 0
    assert toxicity.toxicity(spark, none, labels).count() == 0
    docs = frame(spark, [(1, "You are all worthless scum.", "en", "a"), (2, "A fine day.", "en", "a"), (2, None, "en", "a")])
    kept = toxicity.drop_toxic(spark, docs, labels.where("false"))
    assert [r.doc_id for r in kept.collect()] == [2, 2] and kept.schema == docs.schema


# 4 licences


def test_licences(spark, odd, none):
    model = licenses.Classifier()
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert model.classify(t)[0] == family
    assert sum(model.classify(t)[0] != "unknown" for t in licenses.OTHERS) == 0
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore.", "en", "a"), (2, "He lost his fishing license.", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a")]
    got = licenses.scan(spark, frame(spark, [*rows, rows[0]]), model).collect()
    assert [(r.doc_id, r.paragraph) for r in got if r.family == "mit"] == [(1, 1), (1, 1)]
    assert all(r.family == "unknown" for r in got if r.doc_id == 2)
    assert licenses.scan(spark, none, model).count() == 0 and licenses.scan(spark, odd, model).where("family <> 'unknown'").count() == 0


def test_wrapped_licences(spark):
    model = licenses.Classifier()
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."
    rows = [(1, gpl, "en", "a"), (2, f"Some prose.\n\nMore of it, on\ntwo lines.\n{gpl}\n\nThe end.", "en", "a")]
    rows += [(3, gpl.replace("\n", "\n\n"), "en", "a"), (4, "He lost his fishing\nlicense in the river\nlast spring with the software.", "en", "a")]
    texts = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts if len(t.split()) > 8]
    for n, (_, t) in enumerate(texts):
        w = t.split()
        rows.append((10 + n, "\n".join(" ".join(w[k : k + 4]) for k in range(0, len(w), 4)) + "\nReleased under the MIT License.", "en", "a"))
    got = {}
    for r in licenses.scan(spark, frame(spark, rows), model).where("family <> 'unknown'").collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert got[1] == [(0, "gpl")] and [f for _, f in got[2]] == ["gpl"] and 3 not in got and 4 not in got
    assert [sorted({f for _, f in got.get(10 + n, [])}) for n in range(len(texts))] == [sorted({f, "mit"}) for f, _ in texts]


def test_classifier_by_hand():
    """The sparse matrix and the regression's probabilities as dense ones; held-out variants; families that wrapped texts and tags name."""
    model = licenses.Classifier()
    rng = np.random.RandomState(23)
    rows = [rng.choice(40, rng.randint(0, 6), replace=False) for _ in range(30)] + [np.empty(0, np.int64)]
    dense = np.zeros((31, 40))
    for i, r in enumerate(rows):
        dense[i, r] = 1 / math.sqrt(max(len(r), 1))
    w, d = rng.rand(40, 3), rng.rand(31, 3)
    sparse = licenses.Sparse(rows)
    assert np.allclose(sparse.times(w), dense @ w) and np.allclose(sparse.transposed_times(d, 40), dense.T @ d)
    for text in ("Released under the MIT License.", "a fine day"):
        x = np.zeros(len(model.w))
        own = [c for c in model.column[licenses.features(licenses.words(text))] if c >= 0]
        x[own] = 1 / math.sqrt(max(len(own), 1))
        z = (x @ model.w + model.b) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, probability, _ = model.classify(text)
        assert probability == pytest.approx(p[model.families.index(family)])
    made = [(f, licenses.variant(rng, t)) for f, ts in licenses.TEMPLATES.items() for t in ts for _ in range(10)]
    said = [(f, model.classify(t)[0]) for f, t in made]
    claimed = [(f, g) for f, g in said if g != "unknown"]
    assert sum(f == g for f, g in claimed) >= 0.97 * len(claimed) and len(claimed) >= 0.6 * len(said)
    for text, family in {"SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache", "Licensed under the Eclipse Public License v2.0": "epl", "This file is released into the public domain (Unlicense).": "unlicense", "The above copyright notice and this permission notice shall be included in all copies or parts": "mit", "This program is licensed under the GNU Affero General Public License": "agpl", "He lost his fishing license.": "unknown"}.items():
        assert model.classify(text)[0] == family, text


# 5 mixing


def brute_mix(rows, labels):
    import hashlib

    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality.setdefault(i, []).append(q)
    items = []
    for at, (i, text, source) in enumerate(rows):
        n = len(text.split()) if text else 0
        u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        q = quality.get(i)
        w = 1.0 if q is None else 2.0 if sum(q) / len(q) >= 0.5 else 0.5
        items.append((source, -math.log(u) / w, (i is None, i or 0), at, n, i))
    totals = Counter()
    for s, *_, n, _ in items:
        totals[s] += n
    share = sum(math.sqrt(v) for v in totals.values())
    out = Counter()
    for s in totals:
        goal = math.floor(sum(totals.values()) * math.sqrt(totals[s]) / share) if share else 0
        epochs = goal // totals[s] if totals[s] else 0
        rest, upto = goal - epochs * totals[s], 0
        for _, _, _, _, n, i in sorted(x[:5] + (x[5],) for x in items if x[0] == s):
            upto += n
            out[(i, s, n, epochs + (upto <= rest))] += 1
    return out


def test_mixing(spark, odd, none, labels):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 50)), "en", "abbbbbbccc"[i % 10]) for i in range(200)]
    docs = frame(spark, rows)
    lab = [(i, rng.randrange(2)) for i in range(0, 200, 3)]
    table = spark.createDataFrame([(i, q, 0) for i, q in lab], LABELS)
    got = Counter((r.doc_id, r.source, r.n_tokens, r.copies) for r in mixing.mixture(spark, docs, table).collect())
    assert got == brute_mix([(i, t, s) for i, t, _, s in rows], lab)
    drawn = mixing.mix_sources(spark, docs, table)
    assert drawn.schema == docs.schema
    assert Counter(r.doc_id for r in drawn.collect()) == Counter({k[0]: k[3] for k in got if k[3]})
    assert mixing.mixture(spark, odd, labels).count() == odd.count()
    assert mixing.mixture(spark, none, labels).count() == 0 and mixing.mix_sources(spark, none, labels).count() == 0


# 6 neighbours


def test_neighbours(spark):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[10] = x[11]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd_rows = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, [1.0] * 3, 0), (2005, [None] * 16, 0)]
    schema = "vec_id long, embedding array<float>, sim int"
    got = neighbours.nearest(spark, spark.createDataFrame(rows + odd_rows, schema)).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]
    hits = sum(len(set(g.neighbor_id) & set(true[i])) for i, g in got.groupby("vec_id"))
    assert hits >= 0.9 * true.size and got.vec_id.nunique() == 1500 and (got.vec_id != got.neighbor_id).all()
    assert got[(got.vec_id == 10) & (got["rank"] == 1)].neighbor_id.tolist() == [11]
    assert np.allclose(got.similarity, s[got.vec_id, got.neighbor_id], atol=1e-5)
    few = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)], schema)
    assert sorted((str(r.vec_id), r["rank"], r.similarity) for r in neighbours.nearest(spark, few).collect()) == [("1", 1, 1.0), ("1", 1, 1.0), ("1", 2, 0.0), ("1", 2, 0.0), ("None", 1, 0.0), ("None", 2, 0.0)]
    for t in ([], odd_rows[:3]):
        assert neighbours.nearest(spark, spark.createDataFrame(t, schema)).count() == 0


def test_neighbours_of_some(spark, monkeypatch):
    """Queries are the ids divisible by a number, against all rows, with a forest that is fitted to a part of them."""
    monkeypatch.setattr(neighbours, "SAMPLE", 4 * 24 * 4000)
    monkeypatch.setattr(neighbours, "HELD", 4 * 24 * 3000)
    monkeypatch.setattr(neighbours, "FIRST", 50)
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.RandomState(7)
    x = rng.standard_normal((9000, 24)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[3].tolist()), (50, None)]
    got = neighbours.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), every=50).toPandas()
    ids = np.arange(0, 9000, 50)
    assert sorted(got.vec_id.unique()) == ids.tolist() and (got.groupby("vec_id").size() == 10).all()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[ids] @ u.T
    s[np.arange(len(ids)), ids] = -9
    true = np.argsort(-s, axis=1)[:, :10]
    hits = sum(len(set(g.neighbor_id) & set(true[i // 50])) for i, g in got.groupby("vec_id") if i != 100)
    assert hits >= 0.9 * (true.size - 10)
    assert got[got.vec_id == 100].sort_values("rank").neighbor_id.tolist() == list(range(101, 111))


# 7 page differencing


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 4])
def test_shared_lines(monkeypatch, bits):
    monkeypatch.setattr(page_diff, "TABLE_BITS", bits)
    rng = random.Random(7)
    for _ in range(500):
        a, b = (np.array([rng.randrange(5) for _ in range(rng.randrange(12))], np.uint64) for _ in range(2))
        s = page_diff.shared_lines(a, b)
        rest = iter(b.tolist())
        assert len(s) == lcs(a, b) and (np.diff(s) > 0).all() and all(x in rest for x in a[s].tolist())


def test_shared_lines_of_large_tables(monkeypatch):
    """The same lines of several longest ones, whatever part of the table is kept."""
    rng = random.Random(24)
    for _ in range(300):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(40))], np.uint64) for _ in range(2))
        found = []
        for bits in (1 << 28, 4):
            monkeypatch.setattr(page_diff, "TABLE_BITS", bits)
            found.append(page_diff.shared_lines(a, b).tolist())
        assert found[0] == found[1] and len(found[0]) == lcs(a, b)
    long = np.array([rng.randrange(1 << 40) for _ in range(20_000)], np.uint64)
    other = np.delete(long, [rng.randrange(20_000) for _ in range(3000)])
    assert len(page_diff.shared_lines(long, other)) == len(other)


def test_pages(spark):
    page = lambda *x: "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav>Menu</nav>" + "".join(f"<p>{t}</p>" for t in x) + "<footer>&copy; <b>Foot</b></footer>"
    rows = [
        (1, "http://H.example.com/a/1?x=2", page("one", "same")),
        (2, "http://h.example.com/a/2", page("two", "same", "more")),
        (3, "http://h.example.com/b", page("three")),
        (4, "http://other.example.com/a/1", page("alone")),
        (5, None, page("no url")),
        (6, "http://h.example.com/a/9", None),
        (7, "http://h.example.com/a/8", ""),
        (8, "http://h.example.com/z", page("one", "same")),  # a copy of page 1
        (1, "http://H.example.com/a/1?x=2", page("one", "same")),
        (None, "nonsense", "<p>plain"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    got = [(r.page_id, r.text, r.n_removed) for r in page_diff.extract_pages(spark, pages.repartition(3)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == [(1, "one", 3), (1, "one", 3), (2, "two\nmore", 3), (3, "three", 2), (4, "Menu\nalone\n© Foot", 0), (5, "Menu\nno url\n© Foot", 0), (6, None, 0), (7, "", 0), (8, "one", 3), (None, "plain", 0)]
    assert page_diff.extract_pages(spark, pages.where("false")).count() == 0


def test_page_neighbours(spark):
    rng = random.Random(8)
    pages = [(i, f"http://{rng.choice('ab')}.example.com/{''.join(rng.choice('xy/') for _ in range(6))}", "".join(f"<p>{rng.choice('klmnop')}</p>" for _ in range(6))) for i in range(300)]
    got = {r.page_id: r.text for r in page_diff.extract_pages(spark, spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()}
    hosts = {}
    for i, url, html in pages:
        host, path = url[7:].split("/", 1)
        hosts.setdefault(host, []).append((("/" + path).rstrip("/"), tuple(page_diff.text_lines(html)), i))
    import xxhash

    digest = lambda lines: xxhash.xxh3_64_intdigest(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lines], "<u8").tobytes()) - (1 << 63)
    for rows in hosts.values():
        home = {}
        for path, lines, _ in rows:
            home[lines] = min(home.get(lines, path), path)
        reps = {}
        for lines, path in home.items():
            reps[path] = min(reps.get(path, lines), lines, key=digest)
        order = sorted(reps)
        for _, lines, i in rows:
            k = order.index(home[lines])
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
            other = reps[max(near, key=lambda p: page_diff.common_prefix(p, home[lines]))]
            assert len(got[i].split("\n")) * bool(got[i]) == len(lines) - lcs(lines, other)


def test_page_queries(spark):
    """Pages that differ by query alone are each other's neighbours."""
    page = lambda i: f"<p>Menu</p><p>text {i}</p><p>Foot {'ab'[i > 3]}</p>"
    urls = [f"http://q.example.com/index.php?id={i}" for i in range(1, 6)]
    pages = spark.createDataFrame([(i, u, page(i)) for i, u in enumerate(urls, 1)] + [(9, "http://q.example.com/index.php/far", "<p>text 1</p><p>else</p>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_removed) for r in page_diff.extract_pages(spark, pages.repartition(3)).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [("text 1", 2), ("text 2", 2), ("text 3", 2), ("text 4\nFoot b", 1), ("text 5", 2)]


# 8 MinHash


def test_signatures():
    rng = random.Random(9)
    base = [rng.choice(LOREM) + str(rng.randrange(10**6)) for _ in range(400)]
    other = base[:300] + [f"w{rng.random()}" for _ in range(100)]
    sig, full = minhash_dedup.text_signatures([" ".join(base), " ".join(other), "", "one"])
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (base, other)]
    assert list(full) == [True, True, False, True]
    assert abs((sig[0] == sig[1]).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12


def test_near_dedup(spark, odd, none):
    rng = random.Random(10)
    words = lambda n: [rng.choice(LOREM) + rng.choice("abcdefghij") * rng.randrange(3) for _ in range(n)]
    rows, group = [], {}
    for g in range(40):
        w = words(80)
        for c in range(1 + g % 4):
            v = list(w)
            if c:
                v[rng.randrange(80)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(v), "en", "a"))
    got = minhash_dedup.near_duplicates(spark, frame(spark, rows)).toPandas()
    least = {}
    for i, g in group.items():
        least[g] = min(least.get(g, i), i)
    assert {r.doc_id: r.keep_doc_id for r in got.itertuples()} == {i: least[g] for i, g in group.items()}
    assert (got.keep == (got.doc_id == got.keep_doc_id)).all()
    # brute force over all pairs' signatures
    sig, _ = minhash_dedup.text_signatures([r[1] for r in rows])
    for a, b in combinations(range(len(rows)), 2):
        if group[a] != group[b]:
            assert (sig[a] == sig[b]).mean() < minhash_dedup.MIN_AGREE
    kept = minhash_dedup.dedup_near(spark, odd)
    assert kept.count() == odd.count() - 1 and kept.schema == odd.schema
    assert minhash_dedup.near_duplicates(spark, none).count() == 0 and minhash_dedup.dedup_near(spark, none).count() == 0


# 9 BPE


def test_bpe(spark, odd, none):
    enc = bpe.encoding(bpe.VOCABULARY)
    rng = random.Random(11)
    shared = prose(rng, 2000)
    texts = [prose(rng, 50) + "\n" + shared + " é🦆\n\n  tail" + str(i) for i in range(4)] + [shared, "a  b\n\n\nc" * 100, " " * 3000, "x" * 40000, "日本語" * 300, "", None]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.encode(spark, docs).collect()}
    for i, t in enumerate(texts):
        assert (got[i].tokens is None and got[i].exact is None) if t is None else (list(got[i].tokens) == enc.encode_ordinary(t) and got[i].exact)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(spark, docs)).collect()}
    assert back == dict(enumerate(texts))
    assert bpe.encode(spark, odd).where("exact").count() == odd.where("text is not null").count()
    assert bpe.encode(spark, none).count() == 0


def test_bpe_letters(spark):
    """Chunks without white space, Chinese or not, are used again, and short texts; all is as encoding whole texts."""
    enc = bpe.encoding(bpe.VOCABULARY)
    rng = random.Random(21)
    for letters in ([chr(0x4E00 + i) for i in range(300)], list("abcdefghij"), list("äöüßéñ") + list("abc")):
        shared = "".join(rng.choice(letters) for _ in range(6000))
        texts = [a + shared + b for a in ("", "x", "'t", "日", "1 ", "a b", "'") for b in ("", "s", "'s", "語", " c", "...")]
        for t in texts:
            raw = t.encode()
            ends = bpe.chunks(bpe.rolling(np.frombuffer(raw, np.uint8)))
            assert ends[-1] == len(raw) and all(0 < b - a <= bpe.MAX_CHUNK for a, b in zip([0, *ends], ends))
            parts = []
            for begin, end in zip([0, *ends], ends):
                lo, hi = bpe.in_letters(raw[begin:end])
                if hi > lo:
                    ids = enc._core_bpe.encode_single_piece(raw[begin + lo : begin + hi])
                    parts.append((begin + lo, begin + hi, True, np.array(ids, "<u4").tobytes()))
            assert parts and bpe.stitched(enc, raw, parts).tolist() == enc.encode_ordinary(t)
    texts = ["short text"] * 3 + [shared + "x", "y" + shared, "q" * 50_000, "q" * 50_001]
    got = {r.doc_id: r for r in bpe.encode(spark, frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert all(list(got[i].tokens) == enc.encode_ordinary(t) and got[i].exact for i, t in enumerate(texts))
    # cuts follow the content: what is before it doesn't move them
    data = rng.randbytes(100_000)
    one, two = (bpe.chunks(bpe.rolling(np.frombuffer(x, np.uint8))) for x in (data, b"abc" + data))
    assert len({e + 3 for e in one} & {*two}) >= 0.9 * len(one)


# 10 line dedup


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, odd, none):
    rng = random.Random(12)
    bases = [prose(rng, 14) for _ in range(6)]

    def line():
        w = rng.choice(bases).split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = rng.choice(["dog", "dot", "fog"])
        return " ".join(w) if rng.random() < 0.8 else rng.choice(["", "...", prose(rng, 9), f"page {rng.randrange(99)} of 12"])

    rows = [(i, "\n".join(line() for _ in range(5)), "en", "a") for i in range(40)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs).collect()}
    at = [(i, n, x) for i, t, *_ in rows for n, x in enumerate(t.split("\n"))]
    hashes = [(line_dedup.line_hashes(Words(x)), " ".join(Words(x).data.tobytes().decode().split())) for *_, x in at]
    root = list(range(len(at)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations([k for k in range(len(at)) if hashes[k][1]], 2):
        (ha, sa, _), (hb, sb, _) = hashes[a][0], hashes[b][0]
        x, y = hashes[a][1], hashes[b][1]
        if x == y or (np.bitwise_count(sa[0] ^ sb[0]) <= 64 and edit(x, y) <= math.floor(max(len(x), len(y)) * 0.1 + 1e-9)):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = {}
    for k, (i, _, x) in enumerate(at):
        if not hashes[k][1] or find(k) == k:
            want.setdefault(i, []).append(x)
    assert got == {i: "\n".join(want.get(i, [])) for i, *_ in rows}
    out = line_dedup.dedup_lines(spark, odd)
    assert out.count() == odd.count() and out.schema == odd.schema and line_dedup.dedup_lines(spark, none).count() == 0
    texts = out.toPandas()
    assert texts.text.isna().sum() == 2 and sorted(len(x) > 0 for x in texts[texts.doc_id == 1].text) == [False, True]


def test_edits_at_most():
    rng = random.Random(15)
    first, second, most = [], [], []
    for _ in range(300):
        a = "".join(rng.choice("ab cdé日") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200])))
        b = list(a)
        for _ in range(rng.randrange(0, max(2, len(a) // 6))):
            k, what = rng.randrange(len(b) + 1), rng.random()
            b[k : k + (what > 0.3)] = rng.choice("abcz") * (what < 0.7)
        first.append(a)
        second.append("".join(b))
        most.append(rng.choice([0, 1, 2, max(len(a), len(b)) // 10, len(a) // 5, len(a)]))
    got = line_dedup.edits_at_most(first, second, np.array(most))
    assert got.tolist() == [edit(a, b) <= m for a, b, m in zip(first, second, most)]
    long = ["".join(rng.choice("abcdef ") for _ in range(20_000)) for _ in range(2)]
    assert line_dedup.edits_at_most([long[0]] * 2, [long[0][:9000] + "x" + long[0][9001:], long[1]], np.array([2000, 2000])).tolist() == [True, False]
    assert not len(line_dedup.edits_at_most([], [], np.array([])))


def test_edits_at_most_together(monkeypatch):
    """Long texts, like and unlike ones, are measured together, not pair by pair, with the results of each pair alone."""
    rng = random.Random(23)
    first, second = [], []
    for i in range(40):
        a = [rng.choice("abcdefgh日é ") for _ in range(rng.randrange(900, 1100))]
        b = list(a)
        for _ in range(rng.randrange(60, 140)):
            k, what = rng.randrange(len(b)), rng.random()
            b[k : k + (what > 0.3)] = rng.choice("abcdefgh") * (what < 0.7)
        first.append("".join(a))
        second.append("".join(b))
    most = np.array([max(len(a), len(b)) // 10 for a, b in zip(first, second)])
    want = [line_dedup.edit_at_most(a, b, int(m)) for a, b, m in zip(first, second, most)]
    alone, true = [], line_dedup.edit_at_most
    monkeypatch.setattr(line_dedup, "edit_at_most", lambda a, b, m: alone.append(a) or true(a, b, m))
    assert line_dedup.edits_at_most(first, second, most).tolist() == want and 5 < sum(want) < 35
    assert not alone


@pytest.mark.parametrize("many", [256, 4])
def test_near_pairs(monkeypatch, many):
    monkeypatch.setattr(line_dedup, "MANY", many)
    rng = np.random.RandomState(16)
    base = rng.randint(0, 1 << 62, 12).astype(np.uint64)
    s = base[rng.randint(0, 12, 600)]
    for _ in range(3):
        s ^= (np.uint64(1) << rng.randint(0, 64, 600).astype(np.uint64)) * rng.randint(0, 2, 600).astype(np.uint64)
    key, size, most = rng.randint(0, 3, 600), rng.randint(30, 40, 600).astype(np.int32), np.full(600, line_dedup.NEAR_BITS)
    most[key == 2] = 64
    i, j = line_dedup.near_pairs(key, s, size, most)
    want = set()
    for a, b in combinations(range(600), 2):
        n, m = sorted((int(size[a]), int(size[b])))
        if key[a] == key[b] and n >= m - math.floor(m * 0.1 + 1e-9) and bin(int(s[a] ^ s[b])).count("1") <= most[a]:
            want.add((a, b))
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == want


def test_across():
    """All pairs of lines in different groups of a key, of like lengths, but for those that were measured."""
    rng = np.random.RandomState(20)
    names = ["k", "h", "l", "s", "length", "block", "root"]
    for n in (0, 1, 5, 400):
        h = rng.permutation(1000)[:n].astype(np.int64)
        k, length, block = rng.randint(0, 12, n) ** 2 // 20, rng.randint(75, 85, n), rng.rand(n) < 0.5
        k, l, s, root = k + 100 * block, rng.choice(h, n) if n else h, rng.randint(0, 1 << 40, n) * (rng.rand(n) < 0.5), h % 7
        batch = pa.RecordBatch.from_arrays([pa.array(x if x is block else x.astype(np.int64)) for x in (k, h, l, s, length, block, root)], names)
        got = {tuple(r.values()) for b in line_dedup._across(iter([batch])) for r in b.to_pylist()}
        want = set()
        for a, b in combinations(range(n), 2):
            most = max(length[a], length[b])
            bits = bin(s[a] ^ s[b]).count("1")
            near = bits <= line_dedup.NEAR_BITS if block[a] else bits <= line_dedup.MAX_BITS or most < line_dedup.LONG
            if k[a] == k[b] and root[a] != root[b] and near and abs(length[a] - length[b]) <= most // 10 and l[a] != h[b] and l[b] != h[a]:
                x, y = sorted((a, b), key=lambda i: h[i])
                want.add(tuple(int(v) for v in (h[x], h[y], root[x], root[y])))
        assert got == want


def test_across_signs():
    """SimHashes are numbers without a sign: lines that differ in the highest bit and a few others are near."""
    s = np.array([5, 5 ^ (-(1 << 63) | 7), -1, 1 << 62 ^ 7 ^ ((1 << 63) - 1)], np.int64)
    n = len(s)
    columns = [np.array([1, 1, 2, 2]), np.arange(n), np.full(n, -7), s, np.full(n, 100), np.zeros(n, bool), np.arange(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "h", "l", "s", "length", "block", "root"])
    assert {(r["h1"], r["h2"]) for b in line_dedup._across(iter([batch])) for r in b.to_pylist()} == {(0, 1), (2, 3)}


def test_line_dedup_memory(monkeypatch):
    """A key of very many lines, and one batch of many or long lines, take little memory at once."""
    rng = np.random.RandomState(21)
    n = 3200
    columns = [np.zeros(n, np.int64), rng.permutation(n), np.full(n, -7), rng.randint(0, 1 << 62, n), np.full(n, 100), np.zeros(n, bool), np.arange(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "h", "l", "s", "length", "block", "root"])
    tracemalloc.start()
    pairs = sum(b.num_rows for b in line_dedup._across(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = columns[3]
    assert pairs == sum(int((np.bitwise_count(s[i] ^ s[i + 1 :]) <= line_dedup.MAX_BITS).sum()) for i in range(n)) and peak < 100 << 20
    seen, true = [], line_dedup.edits_at_most
    monkeypatch.setattr(line_dedup, "AT_ONCE", 10_000)
    monkeypatch.setattr(line_dedup, "edits_at_most", lambda a, b, most: seen.append((len(a), sum(map(len, a + b)))) or true(a, b, most))
    lines = ["x" * int(rng.choice([3, 100, 7000])) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x, pa.string()), pa.array(x, pa.string())], ["h1", "a", "b"]) for x in (lines, lines[:1], [], lines[:7])]
    assert sum(b.num_rows for b in line_dedup._alike(iter(batches))) == 408
    assert sum(k for k, _ in seen) == 408 and all(size <= 10_000 or k == 1 for k, size in seen)


def test_line_dedup_memory_of_pairs():
    """Very many lines with like SimHashes, and many long lines that are measured at once, take little memory too."""
    rng = np.random.RandomState(24)
    n = 2500
    columns = [np.zeros(n, np.int64), rng.permutation(n), np.full(n, -7), rng.randint(0, 2, n), np.full(n, 100), np.ones(n, bool), np.arange(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["k", "h", "l", "s", "length", "block", "root"])
    words = np.array(["".join(map(chr, x)) for x in rng.randint(97, 110, (2000, 6))])
    pairs = rng.choice(words, (2500, 300))
    first = [" ".join(x) for x in pairs]
    pairs[:, rng.randint(0, 300, 20)] = rng.choice(words, 20)
    second = [" ".join(x) for x in pairs]
    tracemalloc.start()
    made = sum(b.num_rows for b in line_dedup._across(iter([batch])))
    across = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    alike = line_dedup.edits_at_most(first, second, np.full(2500, 200))
    edits = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert made == n * (n - 1) // 2 and across < 64 << 20
    assert alike.all() and edits < 80 << 20


def test_line_dedup_near_copies(spark):
    """Without a bound on SimHashes: of pairs with the edit similarity, one in ten at most may stay."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(3, 10)))
    rows = {}
    for n in (2, 3, 4, 6, 9, 14, 20, 32, 60, 120):
        made = 0
        while made < 30:
            a = [word() for _ in range(n)]
            b = list(a)
            for _ in range(rng.randrange(1, 2 + n // 15)):
                k = rng.randrange(n)
                b[k] = word() if rng.random() < 0.5 else b[k][:-1] + rng.choice("wxyz")
            x, y = " ".join(a), " ".join(b)
            if x != y and edit(x, y) <= math.floor(max(len(x), len(y)) * 0.1 + 1e-9):
                rows[len(rows)] = (n, x, y)
                made += 1
    docs = frame(spark, [(2 * i + k, t, "en", "a") for i, (_, *pair) in rows.items() for k, t in enumerate(pair)])
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark, docs).collect()}
    lost = Counter(n for i, (n, _, y) in rows.items() if left[2 * i + 1] == "")
    assert all(left[2 * i] == x for i, (_, x, _) in rows.items())
    assert all(lost[n] >= 27 for n in {n for n, *_ in rows.values()}), lost


# pipeline


def test_pipeline(spark, tmp_path, odd, labels):
    import corpus_pipeline

    rng = random.Random(13)
    text = prose(rng, 80)
    rows = [(i, prose(rng, 70), "en", "ab"[i % 2]) for i in range(30)] + [(50, text, "en", "a"), (51, text + " end", "en", "a"), (60, "You are all worthless scum, idiots.", "en", "a"), (61, None, "en", "b"), (62, "", "en", "b")]
    plain = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == plain.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows} - {60}
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    enc = bpe.encoding(bpe.VOCABULARY)
    want = Counter((r.doc_id, None if r.text is None else tuple(enc.encode_ordinary(r.text))) for r in docs.collect())
    assert Counter((i, None if t is None else tuple(t)) for i, t in zip(got.doc_id, got.tokens)) == want
    assert 60 not in set(got.doc_id) and isinstance(got, pd.DataFrame)


def groups_of(n, alike):
    """The least member of each one's group, of the pairs that are alike."""
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(n), 2):
        p, q = find(a), find(b)
        if p != q and alike(a, b):
            root[max(p, q)] = min(p, q)
    return [find(k) for k in range(n)]


def brute_pipeline(rows, lab):
    """Rows (doc_id, text, source) in order of doc_id through all stages, by comparing all with all."""
    score = toxicity.Grammar().score
    rows = [r for r in rows if not r[1] or score(r[1]) < toxicity.THRESHOLD]
    lines = [(i, n, x, " ".join(Words(x).data.tobytes().decode().split())) for i, t, _ in rows if t is not None for n, x in enumerate(t.split("\n"))]
    full = [k for k, x in enumerate(lines) if x[3]]

    def like(a, b):
        x, y = lines[full[a]][3], lines[full[b]][3]
        most = math.floor(max(len(x), len(y)) * 0.1 + 1e-9)
        return abs(len(x) - len(y)) <= most and edit(x, y) <= most

    gone = {(lines[full[k]][0], lines[full[k]][1]) for k, r in enumerate(groups_of(len(full), like)) if r != k}
    kept = []
    for i, t, s in rows:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if t is None or left == t or len(Words(left).start):
            kept.append((i, left, s, t))
    sigs = [[minhash_dedup.text_signatures([x])[0][0] for x in {r[1], r[3]} if x and len(Words(x).start)] for r in kept]

    def near(a, b):
        return any((x == y).mean() >= 0.5 and (x == y).reshape(-1, minhash_dedup.ROWS).all(1).any() for x in sigs[a] for y in sigs[b])

    kept = [r for k, (r, root) in enumerate(zip(kept, groups_of(len(kept), near))) if root == k]
    copies = {k[0]: k[3] for k in brute_mix([(i, t, s) for i, t, s, _ in kept], lab)}
    enc = bpe.encoding(bpe.VOCABULARY)
    return Counter({(i, None if t is None else tuple(enc.encode_ordinary(t))): copies[i] for i, t, *_ in kept if copies[i]})


def test_pipeline_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randrange(3, 10)))
    rows, copies = [], set()
    for g in range(14):
        text = [[word() for _ in range(rng.randrange(4, 14))] for _ in range(rng.randrange(3, 7))]
        for c in range(1 + g % 4):
            own = [list(x) for x in text]
            if c:  # words replaced, some of them in lines that so are no like lines any more
                copies.add(len(rows))
                for k in range(rng.randrange(3)):
                    x = own[-1]
                    x[rng.randrange(len(x))] = word()
            rows.append((len(rows), "\n".join(" ".join(x) for x in own), "ab"[g % 2]))
    rows += [(100, "You are all worthless scum, idiots.", "a"), (101, None, "b"), (102, "", "b"), (103, "...\n\n", "a"), (104, rows[0][1].split("\n")[0], "a"), (105, "Menu\n" + " ".join(word() for _ in range(30)), "b"), (106, "Menu\n" + " ".join(word() for _ in range(30)), "b")]
    lab = [(i, rng.randrange(2)) for i in range(0, 40, 3)]
    frame(spark, [(i, t, "en", s) for i, t, s in rows]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in lab], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, None if r.tokens is None else tuple(r.tokens)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(rows, lab)
    assert got == want
    assert not copies & {i for i, _ in got} and len(copies) > 15
    # texts are emptied of no document that stays
    assert {i for i, t in got if t is not None and not len(t)} <= {102}


def test_odd_names(spark, tmp_path):
    """Columns called like Spark's own, with dots and backticks, and like those that an operator adds."""
    rng = random.Random(18)
    text = prose(rng, 40)
    schema = "doc_id long, text string, source string, `a.b` string, `_metadata` string, `x``y` int, n_removed int, keep int, span int, h int, n int, url string"
    docs = spark.createDataFrame([(i, t, "s", "p", "q", 1, 7, 8, 9, 10, 11, "u") for i, t in enumerate([text, text + " end", None, "", prose(rng, 30)])], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(0, 1, 0)], LABELS)
    for d in (docs, spark.read.parquet(f"{tmp_path}/documents.parquet")):
        for out, left in ((line_dedup.dedup_lines(spark, d), 5), (minhash_dedup.dedup_near(spark, d), 4), (toxicity.drop_toxic(spark, d, labels), 5), (mixing.mix_sources(spark, d, labels), None)):
            got = out.collect()
            assert out.columns == d.columns and (left is None or len(got) == left)
            assert all((r["a.b"], r["_metadata"], r["x`y"], r["n_removed"], r["h"]) == ("p", "q", 1, 7, 10) for r in got)

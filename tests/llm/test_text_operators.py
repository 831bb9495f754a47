"""Mixing, toxicity, quality, URL filter, license scan."""

import collections
import math
import zlib

import numpy as np
import pytest

from trackledger.llm import licenses, mixing, quality, toxicity, urls
from trackledger.llm.common import fresh, spanning_labels

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# -- mixing -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("rate", [0.0, 0.05, 1.0, 3.7, 40.0])
def test_poisson_distribution(rate):
    cdf = mixing.poisson_cdf(rate)
    for k in range(min(6, len(cdf))):
        want = sum(math.exp(-rate) * rate**j / math.factorial(j) for j in range(k + 1))
        assert cdf[k] == pytest.approx(want, abs=1e-12)
    assert 1 - cdf[-1] < 1e-9


def test_mix_draws_like_the_definition_and_keeps_columns(spark):
    import hashlib

    rows = [(i, f"t{i}", None, "a" if i % 3 else "b", 1) for i in range(600)] + [(7, "again", None, "a", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "mix_copy")
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0, None: 1.0}, total=1000)
    assert got.columns == docs.columns
    counts = collections.Counter(r[3] for r in rows)
    rate = {s: 1000 * w / 5 / counts[s] for s, w in {"a": 3.0, "b": 1.0, None: 1.0}.items()}
    want = collections.Counter()
    for r in rows:
        u = (int(hashlib.md5(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        want[r[1]] += sum(p <= u for p in mixing.poisson_cdf(rate[r[3]]))
    assert collections.Counter(r["text"] for r in got.collect()) == +want


def test_mix_high_rates_and_many_sources(spark):
    docs = spark.createDataFrame([(i, "x", None, "big", 1) for i in range(5000)] + [(9000, "rare", None, "small", 1)], DOC)
    n = mixing.mix(docs).where("source = 'small'").count()
    assert abs(n - 2500) < 5 * 2500**0.5
    assert mixing.mix(docs.withColumn("source", docs["doc_id"].cast("string")).limit(20), max_sources=20).count() > 0
    with pytest.raises(ValueError, match="more than"):
        mixing.mix(docs, source_col="doc_id", max_sources=20)


def test_mix_takes_more_sources_than_a_plan_holds(spark):
    import hashlib

    rows = [(i, f"t{i}", None, f"host{i}" if i < 1200 else "big", 1) for i in range(3000)] + [(None, "none", None, None, 1)]
    docs = spark.createDataFrame(rows, DOC)
    counts = collections.Counter(r[3] for r in rows)
    for weights, total in ((None, None), ({"big": 2.0, "host7": 1.0, None: 1.0}, 1200)):
        mass = len(counts) if weights is None else sum(weights.values())
        want = collections.Counter()
        for r in rows:
            rate = (total or len(rows)) * (1.0 if weights is None else weights.get(r[3], 0.0)) / mass / counts[r[3]]
            parts = mixing.parts_of(rate)
            cdf = mixing.poisson_cdf(rate / parts)
            for k in range(parts):
                mark = f"42:{'' if r[0] is None else r[0]}" + (f"#{k}" if k else "")
                u = (int(hashlib.md5(mark.encode()).hexdigest()[:8], 16) + 0.5) / 2**32
                want[r[1]] += sum(p <= u for p in cdf)
        got = mixing.mix(docs, weights, total=total)
        assert got.columns == docs.columns
        assert collections.Counter(r["text"] for r in got.collect()) == +want


def test_mix_weights_and_empty(spark):
    docs = spark.createDataFrame([(i, "x", None, "a" if i < 900 else "b", 1) for i in range(1200)], DOC)
    got = mixing.mix(docs, copy_col="copy", order_col="order").collect()
    share = collections.Counter(r["source"] for r in got)
    assert abs(share["a"] - 600) < 90 and abs(share["b"] - 600) < 90
    assert got != sorted(got, key=lambda r: r["doc_id"])
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, {"b": 1.0}).where("source = 'a'").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0})


# -- quality -------------------------------------------------------------------------------------------


def test_discriminant_equals_the_textbook_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(400, 3)) @ np.diag([1, 2, 0.5]), rng.normal(size=(200, 3)) + 1]
    model = quality.fit(np.array([400.0, 200.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    q = rng.normal(size=(50, 3))
    logs = []
    for a in x:
        cov, mean = np.cov(a.T, bias=True), a.mean(0)
        diff = q - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.log(np.linalg.det(cov)) + np.log(len(a)))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(model.scores(q), want, atol=1e-4)


def corpus(n=400, toxic_every=5):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, rng.integers(40, 120)))
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        if i % toxic_every == 0:
            words[3] = "dumbhead"
        rows.append((i, " ".join(words), None, "s", 1))
        labels.append((i, 0 if bad else 1, int(i % toxic_every == 0)))
    return rows, labels


def test_quality_held_out_and_edge_rows(spark):
    rows, labels = corpus()
    extra = [(None, None, None, None, None), (9000, "", None, None, 0), (9001, "word " * 50_000, None, None, 0), (1, rows[1][1], None, None, 0)]
    docs = spark.createDataFrame(rows + extra, DOC).withColumnRenamed("n_chars", "score2")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, lab).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((by[i] >= 0.3) == (i % 4 != 0) for i in held)
    assert right >= 0.97 * len(held)
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert quality.score_quality(docs, lab.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.score_quality(docs.limit(0), lab).count() == 0


# -- toxicity -----------------------------------------------------------------------------------------------


def test_viterbi_restores_obfuscated_words():
    counts = toxicity.trigram_counts(" ".join(["moron stupid loser idiot"] * 500))
    cost = toxicity.log_probabilities(counts.astype(float))
    for seen, meant in [("m0r0n", "moron"), ("stup1d", "stupid"), ("l.o.s.e.r", "loser"), ("1d10t", "idiot"), ("mooooron", "moron"), ("$tupid", "stupid")]:
        assert toxicity.viterbi(seen, cost) == meant
    assert toxicity.viterbi("plain", cost) == "plain"


def test_viterbi_equals_trying_every_path():
    rng = np.random.default_rng(1)
    cost = toxicity.log_probabilities(rng.integers(0, 50, 64**3).astype(float))

    def all_paths(token):
        best = {}

        def walk(i, state, value, text):
            if i == len(token):
                total = value + float(cost[state[0], state[1], 0])
                if "v" not in best or total < best["v"]:
                    best.update(v=total, t=text)
                return
            c = token[i]
            for letter, channel in toxicity.options(c, 0 < i < len(token) - 1):
                if not letter:
                    walk(i + 1, state, value + channel, text)
                    continue
                k = int(toxicity.CLASS_OF[ord(letter)])
                walk(i + 1, (state[1], k), value + channel + float(cost[state[0], state[1], k]), text + letter)
                if i and token[i - 1] == c and c.isalpha() and state[1] == k:
                    walk(i + 1, state, value + toxicity.COST_REPEAT, text)

        walk(0, (0, 0), 0.0, "")
        return best["t"]

    for token in ("a1b", "aaab", "1@3", "x-y", "l0ll"):
        assert toxicity.viterbi(token, cost) == all_paths(token)


def test_spaced_letters_join():
    cost = toxicity.log_probabilities(toxicity.trigram_counts(" ".join(["a moron is a stupid man"] * 500)).astype(float))
    restorer = toxicity.Restorer(cost)
    (run,) = toxicity.tokens_of("the big m o r  o n here") - {"the", "big", "m", "o", "r", "n", "here"}
    assert "moron" in restorer.candidates(run)
    assert {"a", "stupid", "moron"} <= set(restorer.candidates("a s t u p i d m o r o n"))
    assert "stupid" in restorer.candidates("stuupid") and "stupid" in restorer.candidates("s-tu p1d")


def test_entries_that_run_on_over_blanks_are_found():
    finder = toxicity.SplitFinder({"=moron": 3.0, "stup": 2.5, "weak": 0.6})
    assert finder.stretches("you mo ron , really") == {"mo ron"}
    assert finder.stretches("so $tu p1d !") == {"$tu p1d"}
    assert finder.stretches("this moron stupid we ak") == set()
    assert finder.stretches("") == set() and toxicity.SplitFinder({}).stretches("mo ron") == set()


def test_a_token_with_one_path_is_left_as_it_is():
    cost = toxicity.log_probabilities(np.random.default_rng(2).integers(0, 50, 64**3).astype(float))
    for token in ("plain", "2024", "word,", "(word)", "--", ""):
        inner = toxicity.trimmed(token)
        if not toxicity.open_paths(inner) and any(map(str.isalpha, inner)):
            assert toxicity.viterbi(inner, cost) == inner


def plain_toxicity(docs, labels, modulus=4, held_out=2):
    """Scores worked out document by document, without Spark and without the library's counting."""
    import math

    text_of = {i: t or "" for i, t, *_ in docs}
    counts = collections.Counter()
    for t in text_of.values():
        line = "  " + " ".join(t.lower().split()) + "  " if t.split() else ""
        codes = [int(toxicity.CLASS_OF[ord(c)]) for c in line]
        counts.update(zip(codes, codes[1:], codes[2:], strict=False))
    table = np.zeros((64, 64, 64))
    for k, n in counts.items():
        table[k] = n
    cost = toxicity.log_probabilities(table.ravel())
    restorer = toxicity.Restorer(cost)
    picked = {i: y for i, _, y in labels if i is not None and zlib.crc32(str(i).encode()) % modulus != held_out}
    rows = collections.defaultdict(list)
    for i, t in text_of.items():
        if i in picked:
            rows[toxicity.sketch(t)].append((picked[i], t))
    rows = [(*max(v), k % 2) for k, v in rows.items()]
    found = [({k for w in toxicity.tokens_of(t) for c in restorer.candidates(w) for k in toxicity.keys_of(c)}, y, h) for y, t, h in rows]

    def odds(halves):
        n = [sum(1 for _, y, h in found if y == c and h in halves) for c in (0, 1)]
        seen = [collections.Counter(k for ks, y, h in found if y == c and h in halves for k in ks) for c in (0, 1)]
        out = {}
        for k, n1 in seen[1].items():
            if n1 >= 3:
                v = (math.log((n1 + 0.5) / (n[1] + 1)) - math.log((seen[0][k] + 0.5) / (n[0] + 1))) * n1 / (n1 + 3)
                if v > 0.5:
                    out[k] = v
        return out

    def features(t, odds):
        low = " ".join(t.lower().split())
        parts = toxicity.tokens_of(low) | toxicity.SplitFinder(odds).stretches(low)
        best = [max([0.0, *(odds.get(k, 0.0) for c in restorer.candidates(p) for k in toxicity.keys_of(c))]) for p in parts]
        return max([0.0, *best]), math.log1p(sum(b for b in best if b >= toxicity.STRONG))

    first, both = odds({0}), odds({0, 1})
    x = np.array([(1.0, *features(t, first)) for y, t, h in rows if h == 1])
    w = toxicity.fit_logit(x, np.array([y for y, _, h in rows if h == 1], float))
    return {i: 1 / (1 + math.exp(-float(np.dot((1.0, *features(t, both)), w)))) for i, t in text_of.items()}


def test_toxicity_scores_equal_a_plain_version_in_any_order(spark):
    rows, labels = corpus(240)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_toxicity(rows, [(i, q, t) for i, q, t in labels])
    scores = []
    for docs in (rows, rows[::-1]):
        frame = spark.createDataFrame(docs, DOC).repartition(3)
        scores.append({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(frame, lab).collect()})
    assert scores[0] == scores[1]
    assert scores[0] == pytest.approx(want, abs=1e-6)


def test_quality_scores_equal_a_plain_version_in_any_order(spark):
    import re

    rows, labels = corpus(200)
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(("Hallo → Welt ★ 5 ٣ ok", "Hallo → Welt ★ 5 ٣ ok İ", "", "ǅ a"))]

    def plain(text):
        words = text.split()
        n, letters = len(words), sum(c != " " for c in text)
        if not n:
            return [np.log1p(len(text))] + [0.0] * 10
        share = lambda k, of=letters: np.sqrt(k / of)
        counts = collections.Counter(words)
        return [
            np.log1p(len(text)), np.log1p(n), np.log(letters / n), share(sum(c.isupper() or c.istitle() for c in text)), share(len(re.findall(r"\d", text))),
            share(len(re.findall(r"[^\w\s.,;:'\"()\-]", text))), len(counts) / n, share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
            share(text.count("\n"), n), share(text.count(".") + text.count(","), n), share(max(counts.values()), n),
        ]

    for _, t, *_ in rows:
        assert quality.statistics(t) == pytest.approx(plain(t or ""), abs=1e-12)
    known = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5}
    x = {c: np.array([np.rint(np.array(plain(t)) * 4096) / 4096 for i, t, *_ in rows if known.get(i) == c]) for c in (0, 1)}
    every = np.concatenate((x[0], x[1]))
    shift, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    z = {c: (x[c] - shift) / scale for c in x}
    cov = {c: np.cov(z[c].T, bias=True) for c in z}
    pooled = (len(z[0]) * cov[0] + len(z[1]) * cov[1]) / len(every)
    logs = []
    for c in (0, 1):
        m = 0.6 * cov[c] + 0.4 * pooled
        m = 0.98 * m + 0.02 * np.trace(m) / 11 * np.eye(11)
        d = np.array([(np.array(plain(t or "")) - shift) / scale for _, t, *_ in rows]) - z[c].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d) - 0.5 * np.linalg.slogdet(m)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(len(x[1]) / len(x[0])), -700, 700)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = []
    for docs in (rows, rows[::-1]):
        got = quality.score_quality(spark.createDataFrame(docs, DOC).repartition(3), lab).collect()
        scores.append({r["doc_id"]: r["score"] for r in got})
    assert scores[0] == scores[1]
    assert [scores[0][i] for i, *_ in rows] == pytest.approx(want.tolist(), abs=1e-6)


def test_toxicity_held_out_obfuscated_and_edge_rows(spark):
    rows, labels = corpus(600)
    extra = [
        (None, None, None, None, None), (9000, "", None, None, 0), (9001, "hello " * 50_000, None, None, 0), (9002, "you dumbheads", None, None, 0),
        (9003, "you d.u.m.b.h.e.a.d", None, None, 0), (9004, "you d u m b h e a d now", None, None, 0), (9005, "you dumbheeeeead", None, None, 0),
    ]
    docs = spark.createDataFrame(rows + extra, DOC)
    lab = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    by = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, lab).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((by[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert all(by[i] >= 0.3 for i in (9002, 9003, 9004, 9005)) and by[9000] < 0.3 and by[9001] < 0.3
    kept = toxicity.keep_civil(docs, lab)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(extra) - 120 - 4
    assert toxicity.score_toxicity(docs.limit(0), lab).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(3), lab.limit(0)).collect()} == {0.5}


# -- URL filter --------------------------------------------------------------------------------------------------


def test_urls_split_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None),
        "HTTPS://WWW.ÄB.Example.COM/en/7?x#y": ("www.Äb.example.com", "/en/7", "example.com/en/7"), "http://a.com/en/": ("a.com", "/en/", "com/en/"),
        "x://a.net?q=/de/": ("a.net", "", None), "x://b.example.net/de/8": ("b.example.net", "/de/8", "example.net/de/8"),
        "x://xexample.net/de/8#a": ("xexample.net", "/de/8", "net/de/"), "x://net/de/1": ("net", "/de/1", "net/de/"),
        "x://m.org/es": ("m.org", "/es", None), "x://a.b/c://d/e": ("a.b", "/c://d/e", None),
    }
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), list(cases)[i]
        if rule:
            assert r["verdict"] == ("allow" if rule == "example.com/en/7" else "block")


def test_ranks_follow_a_plain_power_iteration_and_decide(spark):
    link = lambda *hosts: " ".join(f'<a HREF="http://{h}/p">x</a>' for h in hosts)
    rows = [
        (1, "http://bad.net/de/1", link("friend.info")), (2, "http://farm.info/x", link("bad.net", "bad.net")), (3, "http://friend.info/y", link("GOOD.example.com")),
        (4, "http://good.example.com/en/7", link("friend.info")), (5, "http://good.example.com/fr/7", None), (6, "http://alone.info/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(pages, threshold=0.05, floor=1e-10, early=False).collect()}
    soon = {r["page_id"]: r["verdict"] for r in urls.judge(pages, threshold=0.05).collect()}
    assert soon == {i: r["verdict"] for i, r in got.items()}
    edges = {("bad.net", "friend.info"): 1, ("farm.info", "bad.net"): 2, ("friend.info", "good.example.com"): 1, ("good.example.com", "friend.info"): 1}
    edges |= {("good.example.com", "example.com"): 1, ("example.com", "good.example.com"): 1}

    def walk(pairs, seeds):
        out = collections.Counter()
        for (a, _), w in pairs.items():
            out[a] += w
        start = {h: m * 0.15 for h, m in seeds.items()}
        rank = dict(start)
        for _ in range(300):
            nxt = collections.Counter(start)
            for (a, b), w in pairs.items():
                nxt[b] += 0.85 * rank.get(a, 0) * w / out[a]
            rank = nxt
        return rank

    trust = walk(edges, {"good.example.com": 1})
    distrust = walk({(b, a): w for (a, b), w in edges.items()}, {"bad.net": 1})
    n = collections.Counter(r["host"] for r in got.values())
    for r in got.values():
        want = (trust.get(r["host"], 0) - distrust.get(r["host"], 0)) / n[r["host"]]
        assert (r["score"] or 0) == pytest.approx(want, abs=1e-9)
    assert got[2]["verdict"] == "block" and got[3]["verdict"] == "allow" and got[5]["verdict"] == "allow" and got[6]["score"] is None
    assert urls.keep_allowed(pages, threshold=0.05).count() == 4
    assert urls.judge(pages.limit(0)).count() == 0


# -- license scan ----------------------------------------------------------------------------------------------------


def test_spark_hash(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a"), F.lit("bc")).alias("h")).first()[0]
    assert licenses.spark_hash("a", "bc") == got


def test_permutations_agree_with_spark_and_miss_as_seldom_as_claimed(spark):
    from pyspark.sql import functions as F

    h = licenses.shingle_hash("a b c d e")
    got = spark.range(1).select(F.xxhash64(F.lit(h).bitwiseXOR(F.lit(licenses.permutation(3)))).alias("h")).first()[0]
    assert got == licenses.permuted(h, 3)
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(600):
        window = [int(v) for v in rng.integers(-(2**63), 2**63, 30)]
        template = window[:12]  # a share of 0.4
        missed += not any(
            min(licenses.permuted(v, b) for v in window) == min(licenses.permuted(v, b) for v in template) for b in range(licenses.BANDS)
        )
    assert missed <= 6  # 600 * 0.6**12 is 1.3


def test_spdx_tags_and_whole_licenses(spark):
    text = "\n".join((licenses.MIT_GRANT, "(the Software),", licenses.MIT_RIGHTS, licenses.MIT_CONDITION, licenses.MIT_WARRANTY))
    rows = [(1, "// SPDX-License-Identifier: GPL-3.0-or-later"), (2, text), (3, "nothing here " * 40_000 + text), (4, "SPDX-License-Identifier: Unknown")]
    got = collections.defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["template"])
    assert got[1] == {"spdx-gpl-3.0-or-later", "spdx-gpl-3.0-only"} - {"spdx-gpl-3.0-only"}
    assert {"mit", "mit-grant", "mit-condition", "mit-warranty"} <= got[2] and got[3] == got[2] and 4 not in got


def test_a_window_retrieves_the_templates_of_its_bands_only(spark):
    from pyspark.sql import functions as F

    found = licenses.templates()
    keys = licenses.band_keys(found)
    by_class = licenses.classes(found)
    assert len(keys) == sum(len(m) * licenses.bands_for(licenses.geometry(m)[0]) for m in by_class.values())
    members = next(m for m in by_class.values() if len(m) > 3 and m[0].width == licenses.SHINGLE)
    docs = spark.createDataFrame([(t.name, list(t.words)) for t in members], "name string, words array<string>")
    got = docs.select(
        "name", F.explode(licenses.class_candidates(F.col("words"), licenses.shingle_hashes(F.col("words"), members[0].width), members)).alias("c")
    ).select("name", F.explode("c.hits").alias("h"))
    names = {}
    for _, window, band, low, name, _ in keys:
        if window == licenses.geometry(members)[0]:
            names.setdefault((band, low), set()).add(name)
    for r in got.collect():
        assert r["name"] in names[(r["h"]["band"], r["h"]["low"])]
        assert len(names[(r["h"]["band"], r["h"]["low"])]) < len(members)


def brute_scan(text, template):
    """Largest share of the template's shingles in any stretch as long as its windows."""
    import re

    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    w = template.width
    grams = [" ".join(words[i : i + w]) for i in range(len(words) - w + 1)]
    span = len(template.words) - w + 1
    best = 0.0
    for i in range(max(1, len(grams) - span + 1)):
        best = max(best, len(set(grams[i : i + span]) & set(template.shingles)) / len(template.shingles))
    return best


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(50)]
    found = licenses.templates()
    texts = []
    for i in range(120):
        words = list(rng.choice(vocab, int(rng.integers(0, 80))))
        if i % 2:
            t = list(found[i % len(found)].words)
            if i % 3 == 0 and len(t) > 20:
                t[len(t) // 2] = "changed"
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = t
        texts.append(", ".join(words))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (500, "", "x"), (501, "ALL rights\n\nreserved. " * 2, "x"), (501, "All rights reserved", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {(r["doc_id"], r["template"]): r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        for tpl in found:
            hit = brute_scan(t, tpl) >= 0.8
            assert ((i, tpl.name) in got) == hit, (i, tpl.name)
    assert got[(501, "reserved")]["n_windows"] == 3 and got[(501, "reserved")]["first_word"] == 0
    assert licenses.scan(docs.limit(0)).count() == 0
    kept = licenses.without(docs, ["proprietary"])
    assert kept.columns == docs.columns and kept.where("doc_id = 501").count() == 0


# -- helpers --------------------------------------------------------------------------------------------------------------


def test_helpers(spark):
    assert fresh(spark.createDataFrame([(1, 2)], "a int, _A int"), "a") == "__a"
    assert spanning_labels(5, np.array([3, 4]), np.array([1, 3])).tolist() == [0, 1, 2, 1, 1]

"""Operators 2, 3, 4 and 7 against plain Python, and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import kneser_ney, language_id
from lodestone.llm.kneser_ney import Discounts, train, train_and_score
from lodestone.llm.language_id import accept, fit, identify
from lodestone.llm.license_scan import TEMPLATES, Automaton, Scanner, scan_licenses
from lodestone.llm.url_filter import RULES, cut_words, judge, place_of, segment, word_counts

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# Operator 2


def test_op2_base_against_plain_search(spark):
    rng = random.Random(1)
    words = ["MIT", "license", "License,", "apache", "General", "public", "LICENSE", "x", "été", "mit-license", "\n", "…"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", None, "MIT License" * 3, "mit license mit license", "x " * 50_000 + "apache license"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in scan_licenses(docs).collect():
        w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").encode().translate(LOWER))]
        at = [(i, k) for p, k in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert scan_licenses(docs.limit(0)).count() == 0


def expand(template):
    """Every wording that a template without variable regions accepts."""
    m = re.search(r"<<optional>>((?:(?!<<optional>>).)*?)<</optional>>", template)
    if m:
        return [w for inner in ("", m.group(1)) for w in expand(template[: m.start()] + inner + template[m.end() :])]
    m = re.search(r"<<one;(.*?)>>", template)
    if m:
        return [w for one in m.group(1).split("|") for w in expand(template[: m.start()] + one + template[m.end() :])]
    m = re.search(r"<<var;(\d+);(\d+)>>", template)
    if m:
        return [w for n in {int(m.group(1)), int(m.group(2))} for w in expand(template[: m.start()] + " ".join(["word"] * n) + template[m.end() :])]
    return [template]


@pytest.mark.parametrize("label", sorted(TEMPLATES))
def test_op2_templates_accept_their_wordings_and_no_less(label):
    from lodestone.llm.license_scan import PLAIN

    sure, template = TEMPLATES[label]
    automaton, scanner = Automaton(template), Scanner()
    for wording in expand(template):
        words = wording.encode().translate(PLAIN).split()
        assert automaton.accepts(words, 0) == len(words), wording
        found = scanner.scan(f"Before, it: {wording}; and after".encode())[5]
        assert (label, sure) in [f[:2] for f in found]
        mandatory = [i for i, w in enumerate(words) if automaton.needs and w == automaton.needs[len(automaton.needs) // 2]]
        for i in mandatory[:1]:
            assert automaton.accepts([*words[:i], b"zzz", *words[i + 1 :]], 0) < len(words) or "var" in template


def test_op2_bad_templates():
    for bad in ("<<optional>>a", "a<</optional>>", "<<what>> a", "<<optional>>a<</optional>>", "<<one;a b|c>> d"):
        with pytest.raises(ValueError):
            Automaton(bad)


def test_op2_long_and_hostile_texts_take_seconds():
    import time

    scanner = Scanner()
    for text in ("MIT License " * 100_000, "permission is hereby granted free of charge " * 25_000, "GNU General Public License as published by the " * 25_000, "x" * 1_000_000, "licensed " * 120_000 + "under the mit license"):
        began = time.time()
        n, n_base, first, last, _, _ = scanner.scan(text.encode())
        assert time.time() - began < 20
        if text.startswith("MIT"):
            assert (n, n_base, first, last) == (200_000, 100_000, 0, 199_998)


def test_op2_templates_without_fixed_words():
    scanner = Scanner({"some": (0.7, "<<one;red|blue>> <<var;1;2>> <<one;fish|bird>>"), "none": (0.5, "<<var;2;3>> <<one;x|y>>")}, {})
    assert [f[:1] + f[2:] for f in scanner.scan(b"a red big fat fish. x")[5] if f[0] == "some"] == [("some", 1, 5)]
    assert scanner.scan(b"nothing here")[5] == [] and Scanner({}, {}).scan(b"a b")[0] == 2
    assert [f[2:] for f in scanner.scan(b"p q x")[5]] == [(0, 3)]


def test_op2_whole_texts():
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    labels = lambda text: {f[0] for f in Scanner().scan(text.encode())[5]}
    assert labels(bsd.format("")) == {"bsd-text", "bsd-2-clause"} and labels(bsd.format(third)) == {"bsd-text", "bsd-3-clause"}
    assert labels(bsd.format(third).replace("retain", "keep")) == {"bsd-text"}
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    assert labels(mit) == {"mit-text", "mit-full"} and labels(mit.replace("merge", "mix")) == {"mit-text"}


def test_op2_spans(spark):
    docs = spark.createDataFrame([(1, "x. Licensed under the Apache License, Version 2.0. y")], "doc_id long, text string")
    r = scan_licenses(docs, spans=True).first()
    assert (r.labels, r.score) == ("apache,apache-2.0", 0.95)
    assert [(m.label, m.start, m.end) for m in r.matches] == [("apache-2.0", 1, 9)]


def test_op2_published_notices():
    notice = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General
    Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."""
    labels = lambda text: {(f[0], f[1]) for f in Scanner().scan(text.encode())[5]}
    assert labels(notice.format(":", ",", 3)) == {("gpl", 0.9), ("gpl-3.0", 0.95)}
    assert labels(notice.format(";", ";", 2)) == {("gpl", 0.9), ("gpl-2.0", 0.95)}
    assert labels("Released under the GNU General Public License v3.") == {("gpl", 0.9), ("gpl-3.0", 0.95)}
    assert labels("Licensed under the GNU General Public License v2, only") == {("gpl", 0.9), ("gpl-2.0", 0.95)}
    assert labels("News. All rights reserved.") == {("all-rights-reserved", 0.8)}
    assert [f[2:] for f in Scanner().scan(b"Copyright 2020 A. All rights reserved.")[5]] == [(0, 6)]
    assert labels("GNU General Public License, either way version 3") == set()


# Operator 3


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_op3_against_plain_naive_bayes(spark):
    rng = random.Random(2)
    hosts = ["www.example.com", "Example.COM", "a.b.example.com", "theloan.net", "net", "cheaploans.org", "example.com:80", "1loan2.de", "bücher.de", "書.net", "good-news.org", "xcom", "com"]
    paths = ["", "/", "/en/", "/en/12.html", "/es/3?x=/fr/", "/fr/a/b#c", "/de/loans", "/EN/x", "/fr/été/書"]
    urls = [f"{s}://{rng.choice(hosts)}{rng.choice(paths)}" for s in ["http", "https"] for _ in range(120)] + [None, "", "nothing", "://", "a://b://c/d", "http://x" + "y" * 3000 + ".net/fr/"]
    html = "<p title=loan>the cheap loan news</p> the loans good <script>x>y</script>"
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string").repartition(3)
    found = {r.page_id: r for r in judge(pages).collect()}
    assert len(found) == len(urls)
    counts = Counter()
    for i in range(len(urls)):
        if i % 2:
            counts.update(re.findall(r"[a-z]+", re.sub(r"<[^>]*>", " ", html)))
    total = sum(counts.values())
    tokens, labels = {}, {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = re.match(r"[^/?#]*", rest).group().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if rest is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1) if rest is not None else ""
        rule, verdict = plain_rule(host, path)
        r = found[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
        t = []
        for piece in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", host):
            if not "a" <= piece[0] <= "z":
                t.append(place_of("h", "0" if piece[0].isdigit() else piece))
                continue
            known = {(a, n): math.log(counts[piece[a : a + n]]) - math.log(total + 1) for a in range(len(piece)) for n in range(1, min(20, len(piece) - a) + 1) if piece[a : a + n] in counts}
            t += [place_of("h", w) for w in cut_words(piece, known, lambda n: -math.log(total + 1) - 2.3 * n)]
        t += [place_of("p", "0" if w[0].isdigit() else w) for w in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", path.lower())]
        tokens[i], labels[i] = t, verdict
    n = {v: Counter(k for i in tokens if labels[i] == v for k in tokens[i]) for v in ("allow", "block")}
    used = len(set(n["allow"]) | set(n["block"]))
    for i, t in tokens.items():
        odds = math.log((sum(v == "block" for v in labels.values()) + 0.5) / (sum(v == "allow" for v in labels.values()) + 0.5))
        for k in t:
            if n["allow"][k] + n["block"][k]:
                odds += math.log((n["block"][k] + 0.5) / (sum(n["block"].values()) + 0.5 * used)) - math.log((n["allow"][k] + 0.5) / (sum(n["allow"].values()) + 0.5 * used))
        assert found[i].p_block == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)
        if labels[i] is None:
            assert found[i].verdict == ("block" if found[i].p_block > 0.5 else "allow")
    assert judge(pages.limit(0)).count() == 0


def test_op3_words_are_found(spark):
    texts = spark.createDataFrame([("cheap pills spam farm the pill " * 20,)], "html string")
    pieces = spark.createDataFrame([("cheappills",), ("spamfarm",), ("zq",)], "piece string")
    words = {r.piece: r.words for r in segment(pieces, word_counts(texts)).collect()}
    assert words["cheappills"] == ["cheap", "pills"] and words["spamfarm"] == ["spam", "farm"] and "".join(words["zq"]) == "zq"


def test_op3_without_rules_allows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (2, None, None)], "page_id long, url string, html string")
    assert {(r.verdict, r.rule) for r in judge(pages, []).collect()} == {("allow", None)}


def test_op3_long_words_are_found_whole(spark):
    long = "donaudampfschiffahrtsgesellschaft"
    texts = spark.createDataFrame([(f"cheap {long} " * 20,)], "html string")
    pieces = spark.createDataFrame([(long,), ("cheap" + long,)], "piece string")
    words = {r.piece: r.words for r in segment(pieces, word_counts(texts)).collect()}
    assert words == {long: [long], "cheap" + long: ["cheap", long]}


def test_op3_long_hosts_and_priors(spark):
    long = "xy" * 50_000
    pages = spark.createDataFrame([(1, f"http://{long}.com/a", f"<b>{'xy' * 30}</b> {'z' * 5000}"), (2, f"http://{long}.org/q", None), (3, f"http://{'q' * 12_000}.org/", None), (4, "http://w.net/fr/", None), (5, "http://v.org/", None), (5, "http://v.org/", None)], "page_id long, url string, html string")
    found = judge(pages).collect()
    assert len(found) == 6 and {r.page_id: r.rule for r in found} == {1: "com/", 2: None, 3: None, 4: "net/fr/", 5: None}
    told = {r.page_id: r.p_block for r in judge(pages.where("page_id in (1, 4, 5)"), prior=0.01).collect()}
    assert told[5] < 0.5 and judge(pages, prior=0.01).where("page_id = 1").first().verdict == "allow"


# Operator 4


def plain_tokens(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), b"\n"]


def plain_model(texts):
    pairs, raw = Counter(), Counter()
    for t in texts:
        w = plain_tokens(t)
        raw.update(w)
        pairs.update(zip([b" ", *w[:-1]], w, strict=True))
    before = Counter(w for _, w in pairs)
    d2 = Discounts([sum(n == k for n in pairs.values()) for k in (1, 2, 3, 4)]).of
    d1 = Discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)]).of
    total, given = Counter(), defaultdict(float)
    for (v, _), n in pairs.items():
        total[v] += n
        given[v] += d2[min(n, 3)]
    n_pairs, types = max(1, len(pairs)), len(raw)
    rest = sum(d1[min(n, 3)] for n in before.values()) / n_pairs if pairs else 1.0

    def alone(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / n_pairs + rest / (types + 1)

    def chance(v, w):
        if not total[v]:
            return alone(w)
        n = pairs[v, w]
        return max(n - d2[min(n, 3)], 0) / total[v] + given[v] / total[v] * alone(w)

    return raw, chance


def test_op4_against_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = ["the", "The", "a", "of", "été", "x,", "\x0b", *(f"w{i}" for i in range(60))]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([4, 20, 67])]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", None, "the " * 30_000, "the a", "the a", "y" * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1)], "doc_id long, text string, score int").repartition(5)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    raw, chance = plain_model([t for i, t in enumerate(texts) if not held[i]] + ["no id"])
    n = sum(raw.values())
    found = train_and_score(docs).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        w = plain_tokens("no id" if r.doc_id is None else texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held.get(r.doc_id, False), len(w), sum(raw[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((raw[x] + 0.5) / (n + 0.5 * (len(raw) + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(chance(v, x)) for v, x in zip([b" ", *w[:-1]], w, strict=True)), rel=1e-9)
    context = plain_tokens("the a of")[0]
    assert sum(chance(context, w) for w in raw) + chance(context, b"never seen") == pytest.approx(1)


def test_op4_nothing_to_learn_or_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert train_and_score(none).count() == 0
    model = train(none)
    r = kneser_ney.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (r.n_tokens, r.n_known) == (3, 0) and r.score == pytest.approx(0)


# Operator 7


def sample_texts(seed=5):
    rng = random.Random(seed)
    syllables = {"en": ["the", "ing", "and", "ou"], "de": ["sch", "ein", "ö", "ung"], "fr": ["eau", "é", "ç", "oi"]}
    return [(lang, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))) for lang, s in syllables.items() for _ in range(60)]


def test_op7_held_out_accuracy_and_edges(spark):
    texts = sample_texts()
    rows = [(i, t, lang, "s", 0.5) for i, (lang, t) in enumerate(texts)]
    rows += [(1000, None, "en", "s", 0.5), (1001, "", "en", "s", 0.5), (1002, "123 !!", "de", "s", 0.5), (1003, "the and", None, "s", 0.5), (None, "the and", "de", "s", 0.5), (1004, "schein " * 20_000, "de", "s", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(4)
    found = {r.doc_id: r for r in identify(docs).collect()}
    assert len(found) == len(rows)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (i in held) for i in range(len(texts)))
    assert np.mean([found[i].lang_pred == texts[i][0] for i in held]) >= 0.97
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[1004].lang_pred == "de" and found[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())
    kept = accept(docs)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= len(texts)
    assert identify(docs.limit(0)).count() == 0
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_op7_penalty_makes_weights_sparse():
    rng = np.random.default_rng(6)
    rows = [(("a", "b")[i % 2], np.unique(np.r_[i % 2, rng.integers(2, 5000, 30)]), None) for i in range(200)]
    rows = [(k, p, np.ones(len(p))) for k, p, _ in rows]
    weak, strong = fit(rows, l1=1e-6), fit(rows, l1=2.0)
    assert 0 < len(strong.rows) < len(weak.rows)
    assert strong.values[list(strong.rows).index(0)][0] > 0 > strong.values[list(strong.rows).index(1)][0]


def test_op7_scores_do_not_depend_on_neighbours(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(sample_texts())], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    one = language_id.predict(docs.where("doc_id = 7").select("doc_id", "text"), model).first()
    all_ = {r.doc_id: r for r in language_id.predict(docs.select("doc_id", "text").coalesce(1), model).collect()}
    assert one.score == pytest.approx(all_[7].score, rel=1e-9) and one.lang_pred == all_[7].lang_pred


# The pipeline


def test_pipeline_against_brute_force(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    from .test_dedup import brute_near

    source = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in source.collect()}
    verdict = {r.doc_id: r for r in identify(source).collect()}
    accepted = {d: t for d, t in rows.items() if verdict[d].lang_pred != "und" and verdict[d].score >= 0.5}
    assert len(accepted) >= 0.98 * len(rows)
    owner = {}
    for d in sorted(accepted):
        owner[accepted[d]] = d
    exact = {d: t for t, d in owner.items()}
    near = brute_near(list(exact.items()), 3, 0.5)
    want = sorted({n[3] for n in near.values()})
    docs = source
    for (name, stage), left in zip(corpus_pipeline.STAGES[:3], (sorted(accepted), sorted(exact), want), strict=True):
        docs = stage(spark, docs, sf)
        assert docs.columns == source.columns, name
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == left, name
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sorted({r.doc_id for r in packed}) == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(rows[d], add_special_tokens=False).ids) + 1 for d in want)
    assert sum(r.length for r in packed) == total and len({r.sequence_id for r in packed}) == -(-total // 4096)


def test_pipeline_on_odd_documents(spark):
    import corpus_pipeline

    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "the and " * 9000, "en", "s", 0, 1), (2, "the and " * 9000, "en", "s", 0, 1), (3, "schön ist das", "de", None, 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for docs, n in ((odd, 2), (odd.limit(0), 0)):
        left = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            left = stage(spark, left, "")
            assert left.columns == docs.columns
        assert left.count() == n
        assert corpus_pipeline.STAGES[3][1](spark, left, "").select("doc_id").distinct().count() == n


def test_op7_many_languages_and_whole_table_frequencies(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        own = [rng.choice(letters) + rng.choice(letters) + chr(0x4E00 + k) for _ in range(4)]
        rows += [(len(rows) + i, " ".join(rng.choice(own) for _ in range(12)), f"l{k:03}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(language_id, "SLICE", 5000)
    found = {r.doc_id: r for r in identify(docs).collect()}
    assert sum(found[d].lang_pred == lang for d, _, lang in rows) > 0.6 * len(rows) and all(0 <= r.score <= 1 for r in found.values())
    few = language_id.train(docs, F.lit(True), most_languages=5)
    assert few.languages == [f"l{k:03}" for k in range(5)]
    df, n = language_id.document_frequencies(docs.select("text"))
    want = Counter()
    for _, t, _ in rows:
        grams, at, _ = language_id.gram_places(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))
        want.update({int(p) for g in grams for p in g if p < language_id.PLACES})
    assert n == len(rows) and {int(p): int(df[p]) for p in np.flatnonzero(df)} == dict(want)
    assert language_id.document_frequencies(docs.select("text").limit(0))[1] == 0

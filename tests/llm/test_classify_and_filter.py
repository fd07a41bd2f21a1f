import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from alertloom.llm import licenses, toxicity, url_filter, wu_manber
from alertloom.llm.queries import URL_RULES
from tests.llm.helpers import copied_texts, folded, frame, odd_rows, plain_words

# ---- toxicity ----


def test_toxicity_is_learnt_from_rows_that_are_not_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert len(model.hashes) and set(model.thresholds) <= {"en", "fr", "de", "es"}
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    found = sum(r.score >= 0.5 for r in rows if r.toxic)
    assert right / len(rows) > 0.95 and found / sum(r.toxic for r in rows) > 0.75
    again = toxicity.fit(docs.repartition(7), labels)
    assert np.allclose(again.rows, model.rows) and again.thresholds == model.thresholds


def test_toxicity_learns_from_every_shard_of_the_labelled_rows(spark):
    rnd, rows = random.Random(8), []
    for i in range(900):  # one row in three is bad, each bad row by a word that a few rows share
        bad = i % 3 == 0
        rows.append((i, " ".join(rnd.choice("sun moon star sky sea".split()) for _ in range(12)) + (f" vile{chr(97 + i % 7)}x filth" if bad else ""), "en", bad))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], int(r[3])) for r in rows], "doc_id long, toxic int")
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and not toxicity._kept_aside(str(r[0]), 0.15)]
    words = {int(h) for r in learnt if r[3] for h in toxicity.word_hashes(r[1].split(" vile")[1].split()[0].join(["vile", ""]).encode(), 16)[:, 0]}
    s = toxicity.Settings(bits=16, shard=200, batch=8)
    model = toxicity.fit(docs, labels, settings=s)
    assert words <= set(model.hashes.tolist())
    got = toxicity.score(docs, model).collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got) > 0.97 * len(rows)


def _learned():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("sun moon star sky sea".split()) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    bad = np.array([i % 4 == 0 for i in range(300)])
    texts = [t + (" Vile, filth!" if b else "") for t, b in zip(texts, bad)]
    s = toxicity.Settings(bits=16)
    return toxicity.train([toxicity.word_hashes(t.encode(), 16) for t in texts], bad.astype(int), ["en"] * 300, s), texts, bad


def test_scores_do_not_depend_on_batching_or_length():
    model, texts, bad = _learned()
    hashes = [toxicity.word_hashes(t.encode(), 16) for t in texts]
    scores = model.scores(hashes)
    assert ((scores >= 0.5) == bad).mean() > 0.98
    assert np.allclose(scores, [model.scores([h])[0] for h in hashes])
    long = toxicity.word_hashes(("unseen words here " * 40_000 + "vile filth" + " more of them" * 9_000).encode(), 16)
    assert model.scores([long])[0] >= 0.5 and np.allclose(model.pooled([long]), model.pooled([long], step=1000))
    assert model.scores([toxicity.word_hashes(("unseen words here " * 40_000).encode(), 16)])[0] < 0.5


def test_toxicity_of_odd_rows(spark):
    model, *_ = _learned()
    docs = frame(spark, odd_rows() + [(50, "so vile, FILTH", "en", "s", 1)], clashing=True)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(odd_rows()) + 1 and [r.doc_id for r in got if r.rejected] == [50]
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    left = toxicity.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == len(odd_rows())
    assert toxicity.score(frame(spark, []), model).count() == 0 and toxicity.accepted(frame(spark, []), model).count() == 0
    labels = "doc_id long, toxic int"
    for rows in ([], [(1, 0), (2, 0), (None, 1), (3, None)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, labels))
        assert all(not r.rejected for r in toxicity.score(docs, model).where("doc_id <> 0").collect()) or not rows


def plain_forward(words, rows, conv, conv_bias, out, out_bias, s):
    """Largest response of every filter, where it stands, and the logit, place by place."""
    emb = [rows[a] + rows[b] for a, b in words] or [np.zeros(s.width)]
    best, place, column = [], [], 0
    for width in s.sizes:
        for f in range(s.filters):
            at = [sum(float(emb[t + j] @ conv[:, column + j * s.filters + f]) for j in range(width) if t + j < len(emb))
                  for t in range(len(emb))]
            place.append(int(np.argmax(at)))
            best.append(max(at))
        column += width * s.filters
    raw = np.array(best) + conv_bias
    return raw, place, float(np.maximum(raw, 0) @ out + out_bias), emb


def test_forward_pass_and_training_steps_against_plain_loops():
    s = toxicity.Settings(epochs=2, batch=64, width=3, filters=2, sizes=(1, 2, 3), bits=10, kept_aside=0.0)
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 30, (n, 2)).astype(np.uint32) for n in (0, 1, 2, 5, 9, 4, 7, 3, 6, 8, 2, 5)]
    labels = np.array([i % 2 for i in range(len(docs))])
    model = toxicity.train(docs, labels, ["en"] * len(docs), s)
    # the same two steps over the whole set, by hand
    draw = np.random.default_rng(s.seed)
    vocabulary = sorted({int(x) for d in docs for x in d.ravel()} - {0})
    row_of = {h: i + 1 for i, h in enumerate(vocabulary)}
    conv = draw.normal(0, 0.5, (s.width, 6 * s.filters))
    rows, bias, out, out_bias = np.zeros((len(vocabulary) + 1, s.width)), np.full(6, 0.1), draw.normal(0, 0.3, 6), 0.0
    squares, moments = np.full(len(rows), 1e-8), {}

    def adam(name, grad, t):
        m, v = moments.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        moments[name] = [m, v]
        return s.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)

    texts = [[(row_of[int(a)], row_of[int(b)]) for a, b in d] for d in docs]
    for t in (1, 2):
        g_conv, g_bias, g_out, g_out_bias, g_rows = np.zeros_like(conv), np.zeros(6), np.zeros(6), 0.0, np.zeros_like(rows)
        for words, y in zip(texts, labels):
            raw, place, z, emb = plain_forward(words, rows, conv, bias, out, out_bias, s)
            error = (1 / (1 + np.exp(-z)) - y) * 1.0 / len(docs)  # both labels half of the rows: weight 1
            g_out += np.maximum(raw, 0) * error
            g_out_bias += error
            column = 0
            for k, width in enumerate(s.sizes):
                for f in range(s.filters):
                    i = k * s.filters + f
                    back = error * out[i] * (raw[i] > 0)
                    g_bias[i] += back
                    for j in range(width):
                        if place[i] + j < len(words):
                            c = column + j * s.filters + f
                            g_conv[:, c] += back * emb[place[i] + j]
                            for r in words[place[i] + j]:
                                g_rows[r] += back * conv[:, c]
                column += width * s.filters
        touched = [r for r in range(1, len(rows)) if np.abs(g_rows[r]).sum() > 0]
        for r in touched:
            squares[r] += (g_rows[r] ** 2).sum()
            rows[r] -= 0.2 * g_rows[r] / np.sqrt(squares[r])
        conv = conv - adam("conv", g_conv + s.decay * conv, t)
        bias = bias - adam("bias", g_bias, t)
        out = out - adam("out", g_out + s.decay * out, t)
        out_bias -= float(adam("out_bias", np.array([g_out_bias]), t)[0])
    found = {int(h): r for h, r in zip(model.hashes, model.rows[1:])}
    for h, i in row_of.items():
        assert np.allclose(found.get(h, 0), rows[i], atol=2e-3), h
    assert np.allclose(model.conv, conv, atol=2e-3) and np.allclose(model.out, out, atol=2e-3) and abs(model.out_bias - out_bias) < 2e-3
    logits = [plain_forward(w, rows, conv, bias, out, out_bias, s)[2] for w in texts]
    assert np.allclose(model.logits(docs), logits, atol=1e-2)


# ---- URLs ----


def plural(term):
    """Regular plurals of the vocabulary's terms, as a reader would form them."""
    if re.search("[0-9]$", term) or re.search("[^su]s$", term):
        return [term]
    for end, forms in (("us", "uses"), ("ss", "sses"), ("x", "xes"), ("z", "zes"), ("ch", "ches"), ("sh", "shes")):
        if term.endswith(end):
            return [term, term[:-len(end)] + forms]
    if re.search("[^aeiou]y$", term):
        return [term, term[:-1] + "ies"]
    return [term, term + "s"]


def test_urls(spark):
    urls = [None, "", "no scheme/xxx", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com",
            "http://x.net/fr/../a", "http://x.net/es/", "ftp://net/es/a", "http://notnet/es/", "http://best-casino.org/", "http://casinos.org/",
            "http://a.org/cheap/pills", "http://a.org/cheap/cheap", "http://a.org/cheapest-pills", "http://a.org/?q=PORN", "http://b://c/en",
            "http://bets-and-casinos.org/", "http://pornhub.net", "http://a.org/%63asino", "http://a.org/%2563asino", "http://free-bonus.net/",
            "http://free-bonuses.net/a", "http://bonus-bonuses.net/", "http://lotteries.org/wins", "http://essex.org/free", "http://a.org/%", "http://a.org/%e2%82%ac-SEX-Free",
            "//x.org/xxx", "http://h?xxx", "http://h#a-xxx-b", "http://user@h:80/é/ü", "http://a.org/" + "a/" * 5000 + "viagra", "http://x\n.net/es/"]
    rows = [(n, u, None) for n, u in enumerate(urls)] + [(1, "", None), (None, "http://x.net/fr/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("x") for c in ("host", "path", "_url", "_id", "rule")})
    got = url_filter.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    rule = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
            ("block", "net", "/fr/")]
    for r, (i, u, _) in zip(got, rows):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = folded(re.split("[/?#]", rest)[0]) if rest is not None else ""
        path = re.split("[?#]", rest[len(host):])[0] if rest is not None else ""
        fits = [x for x in rule if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        text = folded(re.sub("%([2-7][0-9a-fA-F])", lambda m: chr(int(m[1], 16)), u or ""))
        strict, soft = ({t for t in terms if any(re.search(f"(?<![a-z0-9]){re.escape(f)}(?![a-z0-9])", text) for f in plural(t))}
                        for terms in (url_filter.STRICT, url_filter.SOFT))
        weight = sum(url_filter.SOFT[t] for t in sorted(soft))
        own = "block" if strict or len(soft) >= 2 else "allow"
        assert (r.page_id, r.host, r.path) == (i, host, path)
        assert (r.rule, r.verdict) == ((best[1] + best[2], best[0]) if best else (None, own)), u
        assert (r.strict_terms, r.soft_terms, r.soft_weight) == (len(strict), len(soft), weight)
    kept = url_filter.without_blocked(pages, URL_RULES)
    assert kept.columns == pages.columns and kept.count() == sum(r.verdict == "allow" for r in got)
    assert url_filter.judge(pages.limit(0)).count() == 0


# ---- decontamination ----


def brute_leaks(rows, items, window):
    patterns = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n and item is not None else 0):
            patterns.setdefault(tuple(w[p:p + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in patterns:
                    hit.update(range(p, p + n))
                    found |= patterns[tuple(w[p:p + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_leaks(spark):
    texts = copied_texts(8, 300, alphabet="abcdefgh", most=30)
    items = [(i, t) for i, t in enumerate(texts[::15])] + [(90, "b!"), (91, "C, d"), (92, ""), (93, None), (None, "a"), (5, "h g")]
    rows = [(i, t.upper() if i % 3 else t.replace(" ", " -- "), "en", "s", 0) for i, t in enumerate(texts)] + odd_rows()
    docs = frame(spark, rows, clashing=True)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for window in (1, 4, 10):
        want = brute_leaks([r[:2] for r in rows], items, window)
        for most in (400_000, 20):
            got = wu_manber.contamination(docs, bench, window=window, most_words=most).collect()
            assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want, (window, most)
            kept = wu_manber.uncontaminated(docs, bench, window=window, most_words=most)
            assert kept.columns == docs.columns and kept.count() == sum(not r[2] for r in want)
    none = wu_manber.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    assert wu_manber.contamination(frame(spark, []), bench).count() == 0


# ---- licenses ----


def test_license_places_and_edited_notices(spark):
    notice = licenses.NOTICES[0].phrase.split()
    edited = " ".join(notice[:6] + ["really", "truly"] + notice[6:])
    rows = odd_rows() + [
        (20, "Under the MIT license; under-the-mit\nlicense. cc by nc by nc CC BY NC", "en", "s", 0), (21, edited, "en", "s", 0),
        (22, "under the mit, a license; apache license versions 2", "en", "s", 0), (23, "ALL RIGHTS RESERVED", "en", "s", 0),
        (24, " ".join(notice[:6]) + " filler" * 50 + " " + " ".join(notice[6:]), "en", "s", 0), (25, "cc by nc" + "\u212a, cc by nc\u0130", "en", "s", 0),
        (26, "MAR\u212AET cc by nc", "en", "s", 0), (27, "cc by nc " * 4000, "en", "s", 0)]
    docs = frame(spark, rows, clashing=True).withColumns({c: F.lit(1) for c in ("template", "label", "words", "p", "w")})
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    phrases = [(t.label, t.words) for t in licenses.BASE]
    want = []
    for i, text, *_ in rows:
        w = plain_words(text)
        at = [(p, label) for label, ws in phrases for p in range(len(w)) if w[p:p + len(ws)] == ws]
        want.append((i, len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None),
                     ",".join(sorted({x for _, x in at}))))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None}
    assert labels[20] == "cc-by-nc,mit" and labels[21] == "mit" and labels[22] == "" and labels[23] == "all-rights-reserved"
    assert labels[24] == "" and labels[25] == ""
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_each_notice_with_one_edit_repeated_and_its_siblings(spark):
    rows, want = [], {}

    # what a notice says that has lost the word that tells it from a simpler one
    simpler = {"cc-by-sa": {"cc-by"}, "cc-by-nc": {"cc-by"}, "cc-by-nd": {"cc-by"}, "cc-by-nc-sa": {"cc-by-nc", "cc-by-sa"},
               "cc-by-nc-nd": {"cc-by-nc", "cc-by-nd"}, "lgpl": {"gpl"}, "agpl": {"gpl"}}

    def add(text, labels, also=()):
        rows.append((len(rows), text, "en", "s", 0))
        want[len(want)] = (labels, text, set(also))

    for t in licenses.BASE + licenses.NOTICES:
        whole = {x.label for x in licenses.BASE + licenses.NOTICES if f" {x.phrase} " in f" {t.phrase} "}
        add(f"{t.phrase} {t.phrase}. {t.phrase}", {t.label}, whole)
        w = t.words
        for i in range(len(w) if len(w) >= 6 else 0):
            told = {t.label} - ({t.label} if w[i] in t.needs and w.count(w[i]) == 1 else set())
            for some in ("", " edited", f" {w[i]} extra"):
                if i or some.strip() != "edited":
                    text = f"it is {' '.join(w[:i])}{some} {' '.join(w[i + 1:])} and so on"
                    lost = "extra" not in some and w[i] in t.needs
                    add(text, {t.label} if "extra" in some else told, whole | (simpler.get(t.label, set()) if lost else set()))
    add("licensed under gnu general public license", {"gpl"})
    add("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", {"lgpl"})
    add("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", {"agpl"})
    add("this library is free software you can redistribute it and or modify it under the terms of the gnu general public license", {"gpl"})
    for more, label in (("noncommercial", {"cc-by-nc"}), ("noncommercial sharealike", {"cc-by-nc-sa"}), ("sharealike", {"cc-by-sa"}),
                        ("noderivatives", {"cc-by-nd"}), ("non commercial", set()), ("no derivatives", set())):
        add(f"licensed under a creative commons attribution {more} 4 0 international license", label)
    add("you may use this file only in compliance with the license", set())
    for text, label in (("licensed under the gnu lesser general public license v2 1", "lgpl"), ("mozilla public license version 2 0", None),
                        ("this file is licensed under the apache license 2 0", "apache-2"), ("released under the gnu gpl v3", "gpl"),
                        ("licensed under the 3 clause bsd license", "bsd"), ("released under the terms of the gnu general public license version 2", "gpl"),
                        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc")):
        add(text, {label} if label else set())
    add("subject to the terms of the mozilla public license v 1 1", set())
    add("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license", set())
    add("the terms of the contract are provided that the following day to any person with or without a copy of this", set())
    wrong = [(r.labels, *want[r.doc_id]) for r in licenses.scan(frame(spark, rows)).collect()
             if not want[r.doc_id][0] <= set(r.labels.split(",")) - {""} <= want[r.doc_id][0] | want[r.doc_id][2]]
    assert not wrong, "\n".join(map(str, [len(rows), *wrong]))


def test_aligned_words_are_the_longest_common_subsequence(spark):
    rnd, cases = random.Random(7), []
    for n in range(300):
        form = [rnd.choice("abcdefgh") for _ in range(rnd.randint(6, 60))]
        cases.append((n, [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 70))], form))

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j + 1], new[j], row[j] + 1 if x == y else 0))
            row = new
        return row[-1]

    got = {}
    for at in range(0, len(cases), 30):
        some = cases[at:at + 30]
        forms = licenses.template_words(tuple(licenses.Template("x", " ".join(form)) for *_, form in some), 3)
        df = spark.createDataFrame([(n, n - at, w, len(form)) for n, w, form in some], "n int, template int, w array<string>, m int")
        got |= {r.n: r.k for r in df.select("n", licenses._aligned(
            F.col("w"), F.get(forms, F.col("template"))["masks"], F.col("m")).alias("k")).collect()}
    assert got == {n: longest(w, form) for n, w, form in cases}


def test_license_plan_has_no_python(spark):
    plan = licenses.gram_hits(frame(spark, odd_rows()), licenses.template_grams(spark, licenses.BASE, 3), 3, "doc_id", "text")
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())



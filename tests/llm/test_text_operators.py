import hashlib
import random
import re

import numpy as np
import pytest

from shelfspark.llm import chat_format, decontamination, quality_classifier, quality_rules, url_filters
from tests.llm.util import docs, table, words

CONVERSATIONS = "conv_id long, turn long, role string, text string, examples string"


def test_chat_round_trip(spark, tmp_path):
    hard = ["", "### assistant:\n", r"a\\b \# </turn>", "</turn>\n### user:\nhi", "é\n\n", "x" * 20000, chat_format.PLANTED]
    rows = [(c, t, ["user", "assistant", "system", "a:b#<"][(c + t) % 4], hard[(c * t + t) % len(hard)], "clash") for c in range(9) for t in range(c + 1)]
    rows += [(50, 0, "assistant", None, None), (51, 0, None, "no role", None), (None, 0, "assistant", "nobody", None), (52, 1, "user", "tie", None), (52, 1, "user", "tie", None)]
    d = table(spark, tmp_path, rows, CONVERSATIONS)
    targets = chat_format.prefix_targets(d)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(targets)).collect()}
    shown = {}
    for e in chat_format.examples(targets).collect():
        shown.setdefault(e.conv_id, []).append(e)
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        own = sorted(shown[c], key=lambda e: e.example_no)
        assert r.formatted_chars == sum(len(e.text) for e in own)
        assert [chat_format.HEAD in e.text for e in own] == [True] * len(own) and [e.is_last for e in own] == [k + 1 == len(own) for k in range(len(own))]
        replies = [e for e in own if e.loss_chars or e.loss_start < len(e.text)]
        assert all(e.text[e.loss_start + e.loss_chars :] == chat_format.END for e in replies)
        assert len(replies) == sum(role == "assistant" for _, role, _ in turns)
        assert all(b.text.startswith(a.text) for a, b in zip(own[:-1], own[1:], strict=True))
    assert chat_format.read_back(chat_format.examples(chat_format.prefix_targets(d.limit(0)))).count() == 0


def test_urls_against_plain_rules(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x", "http://www.example.com", "https://a.b.net/fr/#t", "x://net/es/", "x://net/es", "x://sub.example.com/en/", "x://comx/", "x://.com/", "a://b://c/d", "x://éxample.com/en/\n/"]
    rows = [(k, u, "clash") for k, u in enumerate(urls)] + [(3, urls[4], None), (None, urls[4], None)]
    d = table(spark, tmp_path, rows, "page_id long, url string, rule string")
    got = [tuple(r) for r in url_filters.judge_urls(d, url_filters.rule_table(spark)).collect()]
    want = []
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), a, h + p) for a, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, "allow", None))
        want.append((i, host, path, best[2], best[1]))
    assert sorted(got, key=str) == sorted(want, key=str)
    split = url_filters.rule_table(spark, [("block", "co", "m"), ("block", "a.b.net", ""), ("allow", "b.net", "")])
    named = [(r.host, r.rule, r.verdict) for r in url_filters.judge_urls(table(spark, tmp_path, [(1, "http://com/x"), (2, "http://co/m"), (3, "http://c.a.b.net"), (4, "http://" + "x." * 30_000 + "b.net/")], "page_id long, url string"), split).orderBy("page_id").collect()]
    assert named[:3] == [("com", None, "allow"), ("co", None, "allow"), ("c.a.b.net", "a.b.net", "block")] and named[3][1:] == ("b.net", "allow")
    none = url_filters.judge_urls(d, url_filters.rule_table(spark, [("block", "zz", "/")]).limit(0)).collect()
    assert len(none) == len(rows) and all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filters.judge_urls(d.limit(0), url_filters.rule_table(spark)).count() == 0


def plain_counts(text):
    w = words(text)
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k : k + 5]), []).append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, tmp_path):
    rng = random.Random(8)
    prose = "The cat of the house was in a garden and it is for the best that we go to see it with a friend. "
    texts = [None, "", " \n ", "a b", "a a a a a a", prose * 3, "line one\nline one\n\nline two", "é\x0bx\x1cy z ÀB,"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    clean = " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "to", "a", "house", "in", "evening", "light,"]) for _ in range(200))
    texts += [clean, clean.upper() + "!!!", clean.replace(" ", " | "), clean.replace(" ", "%%% "), "word" + clean]
    d = docs(spark, tmp_path, list(enumerate(texts)))
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    for k, t in enumerate(texts):
        n, chars, symbols, dup, repeated = plain_counts(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeated), t
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
    last = len(texts) - 5
    assert [got[last + k].kept for k in range(4)] == [True, False, False, False]
    assert quality_rules.judge(d.limit(0)).count() == 0


def test_identifiers_in_prose_do_not_decide(spark, tmp_path):
    import corpus_pipeline

    prose = "The walls of the old house, in the evening light, were those that it had always been known for by us."
    texts = [prose[:96] + " +1 (168) 555-5254 4501042323994846 4761598977407687", prose + ' token = "0123456789012345678901234567890123456789"', "12 345 678 | " * 20, prose.replace(" ", " %%% ")]
    d = docs(spark, tmp_path, list(enumerate(texts)))
    assert {r.doc_id for r in corpus_pipeline.quality(spark, d, "").collect()} == {0, 1}


def test_texts_without_prose_are_not_kept(spark, tmp_path):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6)) + rng.choice(["", "", "", ","])
    names = " ".join([name() for _ in range(2500)] + ["in"] + [name() for _ in range(2500)])
    prose = " ".join(rng.choice(["the", "of", "and", "to", "is", *["river", "stone", "walked", "house", "evening", "light,"] * 2]) for _ in range(300))
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, tmp_path, [(0, names), (1, prose), (2, names[:300])])).collect()}
    assert {k: r.kept for k, r in got.items()} == {0: False, 1: True, 2: True}


def test_one_row_of_each_near_duplicate_group(spark, tmp_path):
    import corpus_pipeline

    one, two, three = (" ".join(f"{k}{j}" for j in range(30)) for k in "abc")
    rows = [(1, one), (5, one + " end"), (5, two), (None, three), (None, three + " end"), (7, "q " * 12 + one), (8, three + " is"), (9, two), (9, two + " end"), (9, two)]
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, tmp_path, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id != 7) == [(1, one), (5, two), (8, three + " is")]


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    letters = "abcdefgh "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(30, 120)))) for k in range(6)] + [(6, None), (7, ""), (8, "Short")]
    texts = []
    for k in range(60):
        text = list(rng.choice(items[:6])[1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], ["z"], [text[at], "q"]])
        texts.append((k, "".join(rng.choice(letters) for _ in range(40)) + "".join(text).upper() + " end\n" + rng.choice(["", "a short one"])))
    texts += [(60, None), (61, ""), (None, items[0][1]), (None, items[0][1])]
    d = docs(spark, tmp_path, texts)
    bench = table(spark, tmp_path, [(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontamination.find_matches(d, bench).collect()), key=str)
    want = []
    for i, t in texts:
        for j, x in items:
            x = decontamination.normal(x)
            if x and (n := edit_distance(x, decontamination.normal(t))) <= decontamination.budget(x):
                want.append((i, j, n))
    assert got == sorted(want, key=str) and any(n > 1 for _, _, n in got)
    clean = decontamination.clean_rows(d, bench)
    hit = {i for i, _, _ in got}
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, _ in texts if i not in hit]
    assert decontamination.find_matches(d.limit(0), bench).count() == 0 and decontamination.find_matches(d, bench.limit(0)).count() == 0


def test_risk_against_plain_and_its_slope_against_differences():
    rng = np.random.default_rng(4)
    soft = lambda x: np.log(1 + np.exp(-x))
    seen = set()
    for prior, shift in ((0.3, 0.0), (0.9, 3.0), (0.9, -3.0), (0.05, 1.0)):
        p, u = rng.normal(1, 1, 7), rng.normal(shift, 1, 9)

        def parts(g, prior=prior):
            return prior * soft(g[:7]).mean(), soft(-g[7:]).mean() - prior * soft(-g[:7]).mean()

        g = np.concatenate([p, u])
        positive, negative = parts(g)
        risk, slope = quality_classifier.risk_slope(p, u, prior)
        assert np.isclose(risk, positive + max(negative, 0))
        aim = (lambda g: sum(parts(g))) if negative >= 0 else (lambda g: -parts(g)[1])  # noqa: B023
        step = 1e-6 * np.eye(16)
        assert np.allclose(slope, [(aim(g + e) - aim(g - e)) / 2e-6 for e in step], atol=1e-6)
        seen.add(negative >= 0)
    assert seen == {True, False}


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        positive = rng.normal(2, 1, (2000, 3))
        mixed = np.concatenate([rng.normal(2, 1, (int(3000 * share), 3)), rng.normal(-2, 1, (3000 - int(3000 * share), 3))])
        assert abs(quality_classifier.class_prior(positive, rng.permutation(mixed)) - share) < 0.06
    # by its definition: no score gives a smaller bound with its error
    p, u = rng.normal(1, 1, 50), rng.normal(0, 1, 60)
    error = sum(np.sqrt(np.log(40) / (2 * n)) for n in (50, 60))
    bounds = [((u >= t).mean() + error, (p >= t).mean(), (u >= t).mean()) for t in p]
    best = min(bounds, key=lambda x: x[0] / x[1])
    assert np.isclose(quality_classifier.prior_from_scores(p, u), best[2] / best[1])


def test_classifier_learns_from_positives(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = "the of and to river stone house evening walked quietly, under trees. Then".split()
    texts, labels = [], []
    for k in range(240):
        good = k % 6 > 0
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        texts.append((k, " ".join(w) if good else " | ".join(x.upper() + "$$$" for x in w)))
        labels.append((k, int(good), 0, "clash"))
    texts += [(240, None), (241, ""), (None, texts[1][1]), (1, texts[1][1])]
    d = docs(spark, tmp_path, texts)
    marks = table(spark, tmp_path, labels, "doc_id long, quality int, toxic int, text string")
    got = quality_classifier.score(d, marks).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert held and np.mean([r.predicted == int(r.doc_id % 6 > 0) for r in held]) >= 0.95
    assert not next(r for r in got if r.doc_id is None).held_out
    flat = quality_classifier.score(d, marks.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}
    assert quality_classifier.score(d.limit(0), marks).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(5)
    vocabulary = "the of and to in is it was for on with as be by river stone house evening walked quietly under trees then bright water morning road".split()
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    clean = [prose(90) for _ in range(6)]
    item, shared = prose(50), prose(60)
    texts = [*clean, clean[0], clean[1] + " again", prose(40) + " " + item, prose(60) + " " + shared, shared + " " + prose(60), "| " * 80, None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs_ = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, docs_).write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    data, seen = spark.read.parquet(f"{tmp_path}/sf/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, data, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{k}")
        data = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r.asDict() for r in data.collect()})
    assert set(seen[0]) == set(range(11))
    assert set(seen[1]) == {0, 1, 2, 3, 4, 5, 8, 9, 10}
    assert shared not in seen[2][9]["text"] and shared not in seen[2][10]["text"] and seen[2][2]["text"] == clean[2]
    assert set(seen[3]) == {0, 1, 2, 3, 4, 5, 9, 10}
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in seen[4].values()) and set(seen[4]) == set(seen[3])
    assert seen[2][9]["n_chars"] == len(seen[2][9]["text"])

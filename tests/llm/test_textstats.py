import numpy as np

from sylvaq.llm.textstats import VOTES, common_words, document_stats, learn_votes, text_stats, text_types, vote_report, word_marks

COMMON = word_marks("the of and to is its it for was with after in die der nach dem von und ist bis zu".split())

PROSE = "After the fire the old mill was rebuilt with the help of the guild. It lies to the west of the river and is known for its cold springs. "
LIST = "\n".join(f"{i}. Torquo{'abcdefgh'[i % 8]}ford" for i in range(60))
TABLE = "{| class=\"wikitable\"\n" + "\n".join(f"|-\n| Maskaford || {i * 7}% || —" for i in range(40)) + "\n|}"


def corpus():
    good = [PROSE * 5, PROSE.upper() * 4, (PROSE * 4).replace(" of ", "\nof "), PROSE * 3 + "\n\n" + "\n".join(["# Imla (1881)"] * 4), "Die Brücke wurde nach dem Brand von der Zunft der Weber gebaut und ist bis heute zu sehen. " * 3]
    bad = ["", None, LIST, TABLE, "no way " * 80, "#REDIRECT [[Quoulwick]]", "qwlkj gfdh " * 40, "x" * 300_000, "??>+^_@_>" * 20, PROSE[:60] + "\n" + LIST]
    return [(i, t) for i, t in enumerate(good * 6)], [(1000 + i, t) for i, t in enumerate(bad * 6)]


def test_counts_by_hand():
    s = text_stats(["Ab cd, the.\n\n12 !", None, " \n"], COMMON)
    assert list(s["n_words"]) == [5, 0, 0] and list(s["n_lines"]) == [2, 0, 0] and list(s["n_chars"]) == [17, 0, 2]
    assert s["mean_word_length"][0] == 12 / 5 and s["punctuated_line_share"][0] == 1.0 and s["common_word_share"][0] == 0.0
    assert s["symbol_share"][0] == 3 / 12 and s["digit_share"][0] == 2 / 12 and s["symbol_share"][2] == 0


def test_types(spark):
    good, bad = corpus()
    df = spark.createDataFrame([(k, t, 7) for k, t in good + bad], "doc bigint, text string, n_words int")
    stats = document_stats(df, "doc", "text", COMMON)
    got = {r.doc: r.text_type for r in text_types(stats).collect()}
    assert {k for k, t in got.items() if t == "prose"} == {k for k, _ in good}
    report = {r.stat: r for r in vote_report(stats).collect()}
    assert len(report) == len(VOTES) and report["sentence_share"].accuracy > 0.9
    assert text_types(document_stats(df.limit(0), "doc", "text", COMMON)).count() == 0
    assert vote_report(document_stats(df.limit(0), "doc", "text", COMMON)).count() == 0


def plain_stats(text, common):
    """The word statistics of one text, word by word."""
    words = text.split()
    known = [w.lower() in common for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    run = sum(len(x) for x in lines if len(x.split()) > 3 and 7 * sum(w.lower() in common for w in x.split()) >= len(x.split()))
    pieces = [slice(i, i + 8) for i in range(0, len(words), 8)]
    ok = lambda p: len(words[p]) > 3 and any(known[p]) and (2 * sum(w.islower() for w in words[p]) >= len(words[p]) or all(w.isupper() for w in words[p])) and sum(map(len, words[p])) <= 14 * len(words[p])
    ink = sum(sum(map(len, words[p])) for p in pieces if ok(p))
    folded = [w.lower() for w in words]
    return {
        "n_words": len(words), "n_lines": len(lines), "common_word_share": sum(known) / len(words), "lower_word_share": sum(w.islower() for w in words) / len(words),
        "sentence_share": run / sum(map(len, lines)), "running_share": ink / sum(map(len, words)), "top_word_share": max(map(folded.count, folded)) / len(words), "distinct_word_share": len(set(folded)) / len(words),
        "words_per_line": sum(len(x) * len(x.split()) for x in lines) / sum(map(len, lines)),
    }


def test_arrays_against_words_one_by_one():
    rng = np.random.default_rng(11)
    pool = ["the", "The", "of", "mill", "MILL", "x9", "—", "Ärger", "ß", "über", "ǅ", "a" * 40, "!", "\u00a0", "\n", "\n\n", "\t", "日本", "naïve."]
    texts = [" ".join(rng.choice(pool, rng.integers(1, 80))) for _ in range(300)] + [PROSE * 3, LIST, TABLE]
    texts = [t for t in texts if t.split()]
    got = text_stats([None, *texts, ""], word_marks(["the", "of", "über"]))
    for i, t in enumerate(texts, 1):
        for k, v in plain_stats(t, {"the", "of", "über"}).items():
            assert abs(got[k][i] - v) < 1e-12, (k, t)


def test_common_words_learned(spark):
    rng = np.random.default_rng(3)
    small = {"en": ["the", "of", "and", "to"], "sv": ["och", "att", "det"]}
    rows = []
    for i in range(120):
        lang = "sv" if i % 6 == 0 else "en"
        words = [str(rng.choice(small[lang])) if rng.random() < 0.5 else f"{lang}{''.join(rng.choice(list('abcdefgh'), 5))}" for _ in range(60)]
        rows.append((i, {0: None, 1: lang.upper(), 2: f"{lang}-x"}.get(i % 40, lang), " ".join(words)))
    rows += [(500, "en", "zap " * 5000), (501, "xx", "rare " * 3), (502, None, None), (503, "en", "")]
    df = spark.createDataFrame(rows, "doc bigint, lang string, text string")
    marks = common_words(df, "text", "lang", top=3, least_share=0.05)
    assert set(word_marks(["och", "att", "det"])) <= set(marks) and len(set(word_marks(small["en"])) & set(marks)) == 3 and len(marks) == 6
    assert len(common_words(df, "text", top=2)) == 2 and len(common_words(df.limit(0), "text", "lang")) == 0


def test_votes_together_beat_the_best_one():
    rng = np.random.default_rng(8)
    n = 30_000
    truth = rng.random(n) < 0.35
    right = [0.9, 0.85, 0.8, 0.8, 0.75, 0.75, 0.7]
    votes = np.stack([np.where(rng.random(n) < r, 2 - truth, 1 + truth) for r in right], 1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, _, _ = learn_votes(patterns, counts.astype(float))
    together = ((post[at.ravel()] > 0.5) == truth).mean()
    assert together > max(((v == 1) == truth).mean() for v in votes.T) + 0.03


def test_learned_accuracies():
    rng = np.random.default_rng(5)
    n, truth = 20_000, rng.random(20_000) < 0.3
    right, cast = [0.95, 0.8, 0.7, 0.9], [1.0, 0.8, 1.0, 0.5]
    votes = np.stack([np.where(rng.random(n) < c, np.where(rng.random(n) < r, 2 - truth, 1 + truth), 0) for r, c in zip(right, cast)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, accuracy, share = learn_votes(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02 and np.abs(accuracy - right).max() < 0.03
    assert ((post >= 0) & (post <= 1)).all()

import numpy as np

from solweave.llm import quality

SENTENCES = [
    "The old table was kept, but the noise level rose to {} dB again in both polarisations.",
    "We compared CS{} with RS{} and found that the gain solution drifted by {} percent.",
    "Only later did we learn that a cable had been swapped; until then the fit had been trusted.",
    "Most of this could be explained if the beamformer restarted near scan {}.",
    "Has anyone seen this on the long baselines, or is it only that the sky was quiet?",
    "After that the operator wrote a short note, which is why the limits were relaxed.",
]


def texts():
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(str(rng.choice(SENTENCES)).format(*rng.integers(1, 200, 3)) for _ in range(n))
    prose = {i: say(int(rng.integers(3, 12))) for i in range(80)}
    prose[80] = say(6).upper()
    prose[81] = "\n".join("> " + s for s in say(6).split(". "))
    prose[82] = say(400)
    junk = {}
    for i in range(100, 110):
        words = say(8).lower().replace(".", "").replace(",", "").split()
        rng.shuffle(words)
        junk[i] = " ".join(words)
    junk[110] = "\n".join(f"| CS{i} | {i * 0.1:.2f} | {i} | n/a |" for i in range(12))
    junk[111] = "\n".join(f"CS{i},{i * 0.3:.2f},{i},{i * 7}" for i in range(12))
    junk[112] = "\n".join(f"* the noise level of CS{i}" for i in range(12))
    junk[113] = "\n".join(f"2011-02-27 21:{i:02d} INFO op[{i}]: rc=1 n={i}" for i in range(12))
    junk[114] = "ok\n" * 40
    junk[115] = "flag " * 60
    junk[116] = "".join(rng.choice(list("#*/\\|<>=+-_~ "), 400))
    junk[117] = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(60))
    junk[118], junk[119], junk[120] = "", " \n\t", None
    return prose, junk


def test_prose_is_told_from_the_rest(spark):
    prose, junk = texts()
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in (prose | junk).items()], "id bigint, text string, prose double, lines int")
    got = {r.id: r for r in quality.line_shares(df, "id", "text").collect()}
    assert got.keys() == (prose | junk).keys()
    assert [i for i in prose if got[i].prose <= 0.5] == []
    assert [i for i in junk if got[i].prose > 0.5] == []
    assert got[110].table > 0.9 and got[112].list > 0.9
    for i in (118, 119, 120):
        assert got[i].lines == 0 and got[i].prose == got[i].junk == 0
    total = got[82].prose + got[82].list + got[82].table + got[82].junk
    assert abs(total - 1) < 1e-9


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert quality.line_shares(df, "id", "text").collect() == []


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    score, doc = rng.normal(size=(17, 4)), np.repeat([0, 1, 2, 3], [5, 1, 4, 7])
    got = quality.viterbi(score, doc, quality.FIRST, quality.NEXT)
    for d in range(4):
        s = score[doc == d]
        best = max(np.ndindex(*[4] * len(s)), key=lambda p: quality.FIRST[p[0]] + sum(s[i, k] for i, k in enumerate(p)) + sum(quality.NEXT[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got[doc == d]) == best


def test_expectations_against_all_paths():
    rng = np.random.default_rng(1)
    tables = quality.start_tables()
    doc, weight = np.repeat([0, 1, 2], [4, 1, 3]), np.array([1.0, 1, 2, 1, 1, 3, 1, 1])
    traits = np.stack([rng.choice(np.flatnonzero(quality.FAMILY == f), 8) for f in range(len(quality.START))], axis=1)
    score = rng.normal(size=(8, 4))
    got = quality.expectations(score, weight, doc, traits, tables)
    emitted, firsts, steps = np.zeros((quality.NOTHING, 4)), np.zeros(4), np.zeros((4, 4))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = list(np.ndindex(*[4] * len(at)))
        p = np.exp([tables.first[x[0]] + sum(score[i, k] for i, k in zip(at, x, strict=True)) + sum(tables.next[a, b] for a, b in zip(x, x[1:], strict=False)) for x in paths])
        for x, q in zip(paths, p / p.sum(), strict=True):
            firsts[x[0]] += q
            for a, b in zip(x, x[1:], strict=False):
                steps[a, b] += q
            for i, k in zip(at, x, strict=True):
                emitted[traits[i], k] += q * weight[i]
    np.testing.assert_allclose(got, np.concatenate([emitted.ravel(), firsts, steps.ravel()]), atol=1e-9)


def test_fitted_tables_are_distributions_and_carry_over(spark):
    prose, junk = texts()
    df = spark.createDataFrame(list((prose | junk).items()), "id bigint, text string")
    tables = quality.fit_tables(quality.line_traits(df, "id", "text"))
    for f in range(len(quality.START)):
        np.testing.assert_allclose(np.exp(tables.emission[quality.FAMILY == f]).sum(axis=0), 1)
    np.testing.assert_allclose(np.exp(tables.next).sum(axis=1), 1)
    assert not np.allclose(tables.emission, quality.start_tables().emission)
    some = df.filter("id % 2 = 0")
    got = {r.id: r.prose for r in quality.line_shares(some, "id", "text", tables).collect()}
    assert all((got[i] > 0.5) == (i in prose) for i in got)


def test_repeated_lines_are_told_in_texts_of_any_length():
    none = np.zeros(quality.WORDS, dtype=np.int64), np.zeros(quality.PAIRS, dtype=np.int64)
    texts = ["same line\nsame line\n\nsame line", "a b\nc d\na b", "one", "x\n" * 7, "\n".join("abcdefg")]
    doc, length, traits = quality.LineReader(*none).traits(texts)
    again = traits[:, -1] == quality.TRAITS.index("again-yes")
    assert [set(again[doc == d]) for d in range(5)] == [{True}, {False}, {False}, {True}, {False}]
    assert length[:3].tolist() == [9, 9, 9]


def test_words_of_a_text():
    reader = quality.Reader()
    w = reader.words(*reader.characters("Don't PANIC: cs001 CS777\n<td>panic</td> x_y 12 345")[:3])
    assert w.line.tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    h = w.hash.tolist()
    assert h[1] == h[4] and h[2] == h[3] and h[6] == h[7] and len(set(h)) == 5
    assert w.code.tolist() == [False, False, True, True, False, True, True, True]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat!\n\nsat", "en"), (2, "", "en"), (3, None, None)], "id bigint, text string, lang string")
    common = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    got = {r.id: r for r in quality.text_statistics(df, "id", "text", "lang", common).collect()}
    assert (got[1].chars, got[1].words, got[1].word_length, got[1].lines, got[1].full_lines, got[1].common) == (13, 3, 3.0, 2, 0.5, round(1 / 3, 6))
    assert got[1].symbol_ratio == round(1 / 13, 6)
    words = spark.createDataFrame([("en", "the"), ("de", "katze"), (None, "sat")], "lang string, word string")
    rows = [(1, "the Katze sat", " EN"), (2, "the Katze sat", "de"), (3, "the Katze sat", "xx"), (4, "мир 猫", None)]
    by_lang = {r.id: r for r in quality.text_statistics(spark.createDataFrame(rows, "id bigint, text string, lang string"), "id", "text", "lang", words).collect()}
    assert [by_lang[i].common for i in (1, 2, 3, 4)] == [round(1 / 3, 6), round(1 / 3, 6), 1.0, 0.0] and by_lang[4].words == 2
    for i in (2, 3):
        assert got[i].words == got[i].chars == got[i].lines == 0 and got[i].word_length is None

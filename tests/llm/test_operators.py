"""The operators on small cases: nulls, empty tables, clashing columns, and what the driver's tables lack."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from layerkeep.llm import byte_bpe, components, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, substring_dedup, token_counts, toxicity, wordhash
from test_queries import WORD, license_brute, near_brute, plain_score, shingles, substring_brute


LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def messy(spark):
    """Rows with nulls anywhere, empty and very long texts, ties, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "the cat sat on the mat and then it slept all day", "en", "a"), (2, "the cat sat on the mat and then it slept all day", "en", "b"), (2, "the cat sat on the mat and then it slept all day", "en", "b"),
        (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "a"), (None, "a row without an id", "en", "a"), (None, None, None, None), (6, LONG, "en", "c"), (7, LONG + "end", "en", "c"),
        (8, "1234 5678 ... !!!", "en", "a"), (9, "naïve café – 漢字 😀\n\n漢字", None, "a"), (10, "x", "de", "a"), (11, "\x00\x01 odd \x7f", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string")
    for name in ("h", "n", "node", "digest", "row_key", "site", "block", "component", "kept", "hash", "ids", "score", "item_id", "offset", "w", "raw", "tokens"):
        df = df.withColumn(name, df.grp)
    return df


@pytest.fixture(scope="session")
def nothing(spark, messy):
    return spark.createDataFrame([], messy.schema)


def public(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks():
    import public_tokenizers

    return public("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


SAMPLE = {"en": "the cat sat on the mat and then it slept all day " * 5, "de": "der hund lag auf dem boden und schlief den ganzen tag " * 5}
MODEL = toxicity.Model({" idiot": 5.0, " scum ": 4.0}, [" scum line "], [2.0, 2.0, -5.0])
OPERATORS = {
    "substring": lambda s, d: substring_dedup.remove_repeats(d),
    "exact": lambda s, d: exact_dedup.resolve(d),
    "language": lambda s, d: language_id.identify(d, SAMPLE),
    "tokens": lambda s, d: token_counts.token_counts(d, token_counts.Vocabulary((("▁", -1.0), ("a", -2.0), ("▁a", -2.5), ("t", -3.0), ("at", -3.5)))),
    "bpe": lambda s, d: byte_bpe.round_trip(d, *ranks()),
    "toxicity": lambda s, d: toxicity.score(d, MODEL),
    "lines": lambda s, d: line_dedup.remove_boilerplate(d, sites=2),
    "license": lambda s, d: license_scan.scan(d),
    "near": lambda s, d: near_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(spark, messy, nothing, name):
    got = OPERATORS[name](spark, messy).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in messy.select("doc_id").collect())
    assert OPERATORS[name](spark, nothing).count() == 0


def test_values_of_messy_rows(spark, messy):
    """Ids, groups and counts of messy rows against plain versions; a null id counts after all others in substring dedup, before all in exact dedup."""
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = substring_dedup.remove_repeats(messy).collect()
    last = 10**9
    want = substring_brute(sorted(((last if d is None else d, t) for d, t in rows if (d, t) != (None, None)), key=lambda x: x[0]))
    assert {(last if r.doc_id is None else r.doc_id): (r.n_words, r.n_removed, r.kept_sha256) for r in got if (r.doc_id, r.n_words) != (None, 0)} == want

    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best, sizes = {}, {}
    for d, t in rows:
        own = (-len(t or ""), d is not None, d or 0)
        best[key(t)] = min(best.get(key(t), own), own)
        sizes[key(t)] = sizes.get(key(t), 0) + 1
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): (b[2] if b[1] else None, sizes[k]) for k, b in best.items()}
    got = exact_dedup.resolve(messy).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(d), hashlib.sha256(key(t).encode()).hexdigest()) for d, t in rows)
    assert all((r.keep_id, r.group_size) == by_hash[r.text_sha256] and r.kept == (r.doc_id == r.keep_id) for r in got)

    near = near_brute([(d, t) for d, t in rows if d is not None])
    got = near_dedup.near_duplicates(messy).collect()
    assert all((r.n_shingles, r.component_id, r.kept) == (*near[r.doc_id], near[r.doc_id][1] == r.doc_id) for r in got if r.doc_id is not None)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (1, None)]

    text_of = dict(rows)
    for r in license_scan.scan(messy).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(text_of[r.doc_id])
    for r in toxicity.score(messy, MODEL).collect():
        if r.doc_id is not None:
            assert (r.score, r.n_hits) == (pytest.approx(plain_score(MODEL, text_of[r.doc_id])[0]), plain_score(MODEL, text_of[r.doc_id])[1])
    for r in language_id.identify(messy, SAMPLE).collect():
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text_of[r.doc_id] or ""))


def test_scratch_is_deleted_but_for_a_result(spark):
    from pathlib import Path

    from layerkeep.llm import common

    mark = common.scratch_mark()
    kept, gone = (common.written(spark.range(3), "kept"), common.written(spark.range(4), "gone"))
    exact_dedup.resolve(frame(spark, ["a", "b"])).count()
    made, names = [Path(p.removeprefix("file://")) for p, _ in common._scratch[mark:]], {n for _, n in common._scratch[mark:] if n}
    assert all(p.exists() for p in made)
    common.delete_scratch(spark, mark, kept)
    assert [p.exists() for p in made] == [True] + [False] * (len(made) - 1) and kept.count() == 3
    assert len(names) == 1 and not [t for t in spark.catalog.listTables() if t.name in names] and len(common._scratch) == mark + 1
    del gone


def test_contamination_of_messy_rows(spark, messy, nothing):
    items = bench(spark, [(1, "the cat sat on the mat and then it slept all day"), (2, None), (3, ""), (4, "x"), (5, "a row without an id")])
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(messy, items).collect()]
    assert sorted(got, key=str) == [(1, 1), (2, 1), (None, 5)]
    assert decontaminate.contaminated(nothing, items).count() == 0
    assert decontaminate.contaminated(messy, bench(spark, [])).count() == 0


def test_samples_of_messy_rows(spark, messy, nothing):
    got = language_id.sample(messy)
    assert set(got) == {"en", "de"} and "the cat" in got["en"]
    assert language_id.sample(nothing) == {}
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, 0, "x"), (3, 1, "x"), (None, 1, "x"), (4, None, "x"), (99, 1, "x"), (5, 7, "x")], "doc_id long, toxic int, n string")
    assert sorted(toxicity.sample(messy, labels)) == [("", 1)] + [("the cat sat on the mat and then it slept all day", y) for y in (0, 0, 1)]
    assert toxicity.sample(nothing, labels) == []


def test_pipeline_keeps_texts_whose_ids_clash(spark, sf_dir):
    import corpus_pipeline

    from layerkeep.llm.common import table

    words = ["anna", "built", "a", "small", "boat", "of", "old", "wood", "and", "sailed", "far"]
    text = lambda k: " ".join(f"{w}{c}" for c in "abc" for w in words[k:] + words[:k])
    leak = table(spark, sf_dir, "benchmark").first().text
    rows = [(1, text(0)), (2, text(0)), (2, text(3)), (2, text(3) + " "), (3, text(5) + " end"), (4, text(5)), (4, text(7)), (5, leak), (5, text(9)), (6, "of its own")]
    columns = "doc_id long, text string"
    now = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        now = stage(spark, now, sf_dir)
        assert now.columns == ["doc_id", "text"]
    got = [(r.doc_id, r.text.strip()) for r in now.collect()]
    near = [x for x in got if x in ((3, text(5) + " end"), (4, text(5)))]
    assert len(near) == 1  # near copies of each other
    assert sorted(x for x in got if x not in near) == sorted([(1, text(0)), (2, text(3)), (4, text(7)), (5, text(9)), (6, "of its own")])


def test_pipeline_on_messy_rows(spark, messy, nothing, sf_dir):
    import corpus_pipeline

    from layerkeep.llm.common import written

    for start in (messy, nothing):
        now, counts = start, []
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf_dir), f"messy-{name}")
            counts.append(now.count())
            assert name == "byte_bpe" or now.columns == start.columns
        # null, empty, blank and letterless texts go; then the copies of 1, and 7, which is near 6
        assert counts == ([9, 7, 6, 6, 6] if start is messy else [0] * 5)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# -- 1 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [20_000, 3])
def test_substring_against_brute_force(spark, monkeypatch, most):
    rng = random.Random(3)
    passages = [[f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    texts = [" ".join(sum((rng.choice(passages) for _ in range(rng.randrange(6))), [])) for _ in range(80)]
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 1500)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "MOST_TASKS", most)
    got = substring_dedup.remove_repeats(frame(spark, texts), window=6, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substring_brute(list(enumerate(texts)), 6)
    for r in got:
        words = texts[r.doc_id].split()
        gone = {i for s in r.removed for i in range(s.start, s.end)}
        assert r.kept_text == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_an_id_with_many_texts_spreads(spark, monkeypatch):
    """Rows of one id lie in several groups, and still do not remove each other's words."""
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 500)
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(5, f"{shared} own{k}") for k in range(40)] + [(6, shared)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(5, 61, 0)] * 40 + [(6, 60, 60)]


def test_packed_numbers():
    for x in (np.array([], np.uint64), np.array([0, 2**64 - 1, 5], np.uint64)):
        assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\n\t\x1c漢") for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "x" * 3_000_000 + " y"]
    counts, wide, narrow = wordhash.words(texts)
    own = [WORD.findall(t or "") for t in texts]
    words = [w for x in own for w in x]
    assert counts.tolist() == [len(x) for x in own] and len(words) == len(wide) == len(narrow)
    for hashes in (wide, narrow):
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 50])
def test_runs_are_polynomials(size):
    rng = random.Random(size)
    for wide, prime, base in ((True, wordhash.WIDE, wordhash.WIDE_BASE), (False, wordhash.NARROW, wordhash.NARROW_BASE)):
        x = [rng.randrange(prime) for _ in range(150)] + [prime - 1] * 60
        want = [sum(n * pow(base, size - 1 - j, prime) for j, n in enumerate(x[i : i + size])) % prime for i in range(len(x) - size + 1)]
        assert wordhash.runs(np.array(x, np.uint64), size, wide).tolist() == want


def thue_morse(n, zero, one):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_and_windows_that_collide_modulo_powers_of_two(spark, n):
    """Thue-Morse sequences and their complements, as letters of a word and as words of a text."""
    shared = [f"w{i}" for i in range(60)]
    texts = [" ".join([*shared[:49], "".join(thue_morse(n, *x)), *shared[49:]]) for x in ("ab", "ba")]
    texts += [" ".join(thue_morse(n, *x)) for x in (("x", "y"), ("y", "x"))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert got == substring_brute(list(enumerate(texts)))
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert near == near_brute(list(enumerate(texts)))


# -- 2 -------------------------------------------------------------------------------------------------------------


def test_hot_groups_keep_their_best_row(spark):
    texts = ["same text"] * 400 + ["same  text"] + [f"text {i}" for i in range(50)]
    got = {r.doc_id: r for r in exact_dedup.resolve(frame(spark, texts)).collect()}
    assert len(got) == 451 and {got[i].keep_id for i in range(401)} == {400} and got[0].group_size == 401
    assert sum(r.kept for r in got.values()) == 51


def test_index_lasts_and_grows(spark, tmp_path):
    index = exact_dedup.ExactDedupIndex(spark, "test_digests", f"file://{tmp_path}/index", 4)
    one = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, "c", "z"), (4, None, "n")], "doc_id long, text string, digest string")
    assert sorted(r.doc_id for r in index.add(one).collect()) == [1, 3, 4]
    again = exact_dedup.ExactDedupIndex(spark, "test_digests", f"file://{tmp_path}/index", 4)
    two = spark.createDataFrame([(5, "a  b", "x"), (6, "d", "y"), (7, "", "y"), (6, "d", "y")], "doc_id long, text string, digest string")
    kept = again.add(two)
    assert [tuple(r) for r in kept.collect()] == [(6, "d", "y")]
    assert again.table().count() == 4


def test_index_keeps_one_row_of_an_id_and_a_text(spark, tmp_path):
    index = exact_dedup.ExactDedupIndex(spark, "test_one_row", f"file://{tmp_path}/index", 4)
    rows = [(1, "a b", 1), (1, "ab", 2), (1, "ab ", 3), (None, "q", 4), (None, "q", 5), (2, "z", 6)]
    got = index.add(spark.createDataFrame(rows, "doc_id long, text string, __new1 int").withColumn("__digest", F.lit(0)).withColumn("__keep", F.lit(0)))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", "a b"), ("2", "z"), ("None", "q")]
    assert index.table().count() == 3 and got.columns == ["doc_id", "text", "__new1", "__digest", "__keep"]


def test_query_meets_the_index_by_a_merge_anti_join(spark):
    index = exact_dedup.ExactDedupIndex(spark, "test_anti", n_buckets=4)
    rows = exact_dedup.digests(frame(spark, ["a", "b", "a "]))
    index.append(index.fresh(rows))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = exact_dedup.representatives(rows).join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    side = plan[plan.index("LeftAnti") :]
    assert "Bucketed: true" in side and side.count("Exchange") <= 1  # none on the index's side
    assert index.fresh(rows).count() == 0 and {(r.keep_id, r.group_size) for r in index.table().collect()} == {(1, 1), (2, 2)}


# -- 3 -------------------------------------------------------------------------------------------------------------


def test_automaton_knows_all_substrings_and_no_others():
    rng = random.Random(2)
    text = [rng.randrange(1, 4) for _ in range(60)]
    steps = language_id.suffix_automaton(text)
    for _ in range(2000):
        probe = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))]
        state = 1
        for c in probe:
            state = steps[state].get(c, 0)
        assert bool(state) == any(text[i : i + len(probe)] == probe for i in range(len(text)))


@pytest.mark.parametrize("cells", [language_id.CELLS, 5_000, 1])
def test_phrases_are_the_greedy_parse(monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    p = language_id.Parser(SAMPLE)
    rng = random.Random(4)
    texts = ["".join(rng.choice("thecasodrunl xé") for _ in range(rng.randrange(1, 3000))) for _ in range(20)]
    rows = [p.folded(t) for t in texts]
    got = p.phrases(rows)
    for g, name in enumerate(p.languages):
        known = p.folded(SAMPLE[name]).tolist()
        grams = {tuple(known[i:j]) for i in range(len(known)) for j in range(i + 1, min(len(known), i + 60) + 1)}
        for k, row in enumerate(rows):
            n = 0
            for s in range(0, len(row), language_id.SEGMENT):
                part, i = row[s : s + language_id.SEGMENT].tolist(), 0
                while i < len(part):
                    j = i + 1
                    while j < len(part) and tuple(part[i : j + 1]) in grams:
                        j += 1
                    n, i = n + 1, j
            assert got[g, k] == n


def test_many_letters_and_many_languages(spark, monkeypatch):
    """3,000 letters in one language and 700 in another; a hundred languages."""
    rng = random.Random(5)
    han, hangul, kana = ([chr(a + i) for i in range(n)] for a, n in ((0x4E00, 3000), (0xAC00, 700), (0x3041, 80)))
    texts = {g: "".join(rng.sample(x, len(x))) * 2 for g, x in (("zh", han), ("ko", hangul), ("ja", kana))}
    for cells in (language_id.CELLS, 100_000):
        monkeypatch.setattr(language_id, "CELLS", cells)
        p = language_id.Parser(texts)
        probes = [(g, texts[g][i : i + 3]) for g in texts for i in range(0, len(texts[g]) - 3, 40)]
        assert p.predict([x for _, x in probes])[0] == [g for g, _ in probes]
    rows = [(100 * k + i, " ".join("".join(random.Random(k).sample("abcdefghijklmnop", 16))[j : j + 4] for j in range(12)), f"l{k:03}") for k in range(100) for i in range(3)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {f"l{k:03}" for k in range(100)}
    assert language_id.Parser(got).predict([t for _, t, _ in rows])[0] == [g for *_, g in rows]


def test_sampled_texts_are_whole(spark):
    rows = [(k, f"word{k} " * (3000 if k < 4 else 2), "en" if k % 2 else "de") for k in range(8)]
    got = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {g: len(x) for g, x in got.items()} == {g: sum(len(t) + 1 for _, t, h in rows if h == g) for g in ("en", "de")}


def test_texts_without_letters_are_undetermined(spark):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame(spark, [None, "", "12 34 !", "the mat", "漢字"]), SAMPLE).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] in ("de", "en")
    assert {r.lang_pred for r in language_id.identify(frame(spark, ["the mat"]), {}).collect()} == {"und"}


# -- 4 -------------------------------------------------------------------------------------------------------------

QUESTION = "On Monday Alice bought 12 apples and Bob bought 30 apples so Alice paid 12 dollars for the fruit in the market hall"


def test_reparameterised_questions(spark):
    other = QUESTION.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "7").replace("30", "45")
    mixed = other.replace("Carol paid 7", "Erin paid 9")  # Alice would be Carol and Erin, 12 would be 7 and 9
    texts = [f"Some words before. {QUESTION}. More after.", f"Intro: see this. {other} and then some", mixed, QUESTION.upper(), " ".join(QUESTION.split()[:9]), "nothing alike here at all, just some words", QUESTION.replace(" ", "\n* ")]
    got = {r.doc_id: r for r in decontaminate.contaminated(frame(spark, texts), bench(spark, [(5, QUESTION)])).collect()}
    assert {0, 1, 6} <= set(got) and not {2, 4, 5} & set(got)
    assert got[0].verbatim and got[0].n_matched == got[0].n_item and not got[1].verbatim and got[1].n_slots >= 6


def test_items_of_mostly_names_and_figures(spark):
    """Items without template windows are found where they stand whole, and not by their placeholders alone."""
    novel = "Who Wrote The Novel Pride And Prejudice In London During 1813"
    figures = "12 15 18 21 24 27 30 33 total 36 39"
    short = "Berlin 1813 London 1920"  # a whole item shorter than the window
    thin = "Alice Bob 7 came late Carol Dave 9 went home early"  # half literal, but no window of it is
    items = [(1, novel), (2, figures), (3, short), (4, "Paris once 5 Rome 9 Cairo 11 Bern now 3 then"), (5, thin)]
    texts = [f"some words, {x} and more" for _, x in items] + [
        "some words, Who Sang The Opera Anna And Elena In Paris During 1901 and more",  # other names
        "some words, 1 2 3 4 5 6 7 8 total 9 10 and more",  # other figures
        "some words, 12 15 18 21 24 27 30 33 in all and more",  # 8 of 11
        "Nothing of it at all here.",
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, texts), bench(spark, items)).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (7, 2)}
    assert all(got[k, k + 1].verbatim and got[k, k + 1].first_token == 2 for k in range(5))
    assert not got[7, 2].verbatim and got[7, 2].n_matched == 8


def canon(text):
    """The canonical tokens, written anew from the description."""
    out, starts = [], True
    for raw in re.split(r"[\x20\x09-\x0D]+", text or ""):
        t = raw.strip(decontaminate.TRIM)
        if t:
            lower = t.lower()
            if re.fullmatch(rf"[0-9][0-9.,:/-]*({'|'.join(decontaminate.UNITS)})?", t):
                out.append("<num>")
            elif not starts and t[0] != t[0].lower() and t != t.upper():
                out.append("<name>")
            else:
                out.append("<unit>" if lower in decontaminate.UNITS else lower)
            starts = False
        starts = starts or bool(re.search(r"[.!?]", raw[len(raw.rstrip(decontaminate.TRIM)) :])) and bool(out)
    return out


def test_canonical_tokens_and_windows(spark):
    rng = random.Random(6)
    parts = ["The", "cat", "5", "3.5", "12km", "km", "Alice", "USA", "(see)", "end.", "what?!", "|", "...", "Éa", "x-y", "\n", "--", "“So”", "9:30,"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(200)] + [None, "", "...", "a"]
    df = frame(spark, texts).select("doc_id", decontaminate.canonical(decontaminate.raw_tokens(F.col("text"))).alias("c"))
    for r in df.collect():
        assert r.c == canon(texts[r.doc_id]), texts[r.doc_id]
    sizes = df.select(F.size("c").alias("n"), *[F.size(decontaminate.window_hashes(F.transform("c", lambda t: F.xxhash64(t)), k)).alias(f"w{k}") for k in (4, 5, 6, 7, 8)]).collect()
    assert all(r[f"w{k}"] == max(0, r.n - k + 1) for r in sizes for k in (4, 5, 6, 7, 8))


# -- 5 -------------------------------------------------------------------------------------------------------------


def test_counts_against_all_splits():
    """Every split of short texts: the best score, and of ties the split whose pieces are longest from the end."""
    rng = random.Random(7)
    for _ in range(60):
        alphabet = "ab▁"
        pieces = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 4))): -float(rng.randrange(1, 5)) for _ in range(6)}
        c = token_counts.Counter(token_counts.Vocabulary(tuple(pieces.items()), byte_fallback=False))
        for _ in range(20):
            text = "".join(rng.choice("ab▁c") for _ in range(rng.randrange(1, 8)))

            def best(n):
                """(score, tokens) of the best path to n, by trying last pieces from the longest."""
                if n == 0:
                    return 0.0, 0
                out = None
                for size in range(n, 0, -1):
                    piece = text[n - size : n]
                    score = pieces.get(piece, c.unknown if size == 1 else None)
                    if score is not None:
                        s, k = best(n - size)
                        if out is None or s + score > out[0]:
                            out = s + score, k + 1
                return out

            assert c.solve(text) == best(len(text))


def test_counts_against_the_public_library():
    from tokenizers import Tokenizer, models

    v = token_counts.read_pieces(public("piece_bpe_32k.model"))
    names = [p for p, _ in v.pieces]
    full = [("unk", -1e9), *((f"<0x{i:02X}>", -1e9) for i in range(256)), *v.pieces]
    t = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=True))
    c = token_counts.Counter(v)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcthe in  \n\té漢😀qz.") for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    assert c.by_word and "▁the" in names
    assert c.count(texts) == [len(t.encode("▁" + x.replace(" ", "▁")).ids) for x in texts]
    assert c.count([None, ""]) == [0, 0]


# -- 6 -------------------------------------------------------------------------------------------------------------


def test_bpe_of_odd_texts_and_long_pieces(monkeypatch):
    import tiktoken

    path, pattern = ranks()
    with open(path, "rb") as f:
        raw = f.read()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.parse_ranks(raw), special_tokens={})
    rng = random.Random(9)
    alphabet = "abé 's't \n\t\x1c\x85\xa0   ½²٣漢字😀一Ⅷ'll\x00 -—_.,09ʻ́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 700, "ab" * 4000, " " * 3000, None, "", "é" * 600]
    monkeypatch.setattr(byte_bpe, "MOST_KEPT", 3000)
    c = byte_bpe.Codec(raw, pattern)
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        ids = [np.frombuffer(x, "<u4") for x in c.encode(part)]
        for x, own, back in zip(part, ids, c.decode(ids), strict=True):
            assert own.tolist() == enc.encode_ordinary(x or "") and back == (x or "").encode()


def test_bpe_follows_the_callers_pattern():
    import tiktoken

    path, _ = ranks()
    with open(path, "rb") as f:
        raw = f.read()
    for pattern in (r"\p{N}{1,3}|\P{N}+", r"(a|b)+|\s+|[^ab\s]+"):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.parse_ranks(raw), special_tokens={})
        c = byte_bpe.Codec(raw, pattern)
        texts = ["the year 123456 ended", "abba 12 baobab", ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode(texts)] == [enc.encode_ordinary(x) for x in texts]


def test_altered_ids_change_the_decoded_digest(monkeypatch):
    path, pattern = ranks()
    with open(path, "rb") as f:
        c = byte_bpe.Codec(f.read(), pattern)
    texts = ["some words that are there", "", "two words " + "ab" * 3000]
    monkeypatch.setattr(byte_bpe, "DECODED_IDS", 100)
    right = c.round_trip(texts)
    assert [y for *_, y in right] == [hashlib.sha256(x.encode()).hexdigest() for x in texts]
    real = c.encode
    for change in (lambda x: x[4:], lambda x: x[4:8] + x[:4] + x[8:]):
        c.encode = lambda t, change=change: (change(x) for x in real(t))
        assert [y != z for (*_, y), (*_, z) in zip(c.round_trip(texts), right, strict=True)] == [True, False, True]


def test_rows_with_ids_keep_their_columns(spark, messy, nothing):
    path, pattern = ranks()
    got = byte_bpe.with_ids(messy, path, pattern)
    assert got.columns == [*[c for c in messy.columns if c not in byte_bpe.ADDED], *byte_bpe.ADDED]
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = got.collect()
    assert all(r.ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) for r in rows)
    assert sorted((str(r.doc_id), str(r.text), r.n_chars) for r in rows) == sorted((str(r.doc_id), str(r.text), r.n_chars) for r in messy.collect())
    assert byte_bpe.with_ids(nothing, path, pattern).count() == 0


def test_encode_and_decode_tables(spark):
    path, pattern = ranks()
    ids = byte_bpe.encode(frame(spark, ["Hello there", None, "漢字 \n"]), path, pattern)
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(ids, path).collect()}
    assert back == {0: b"Hello there", 1: b"", 2: "漢字 \n".encode()}


# -- 7 -------------------------------------------------------------------------------------------------------------


def test_folding_and_exceptions():
    s = toxicity.Scorer(MODEL)
    hits = {t: s.score(t)[1] for t in ("you ІDІОТ", "1d10t!", "ïdíot", "idiots", "videoidiot", "scum", "scummy", "a scum line", "ｉｄｉｏｔ", "nothing", "", None)}
    assert hits == {"you ІDІОТ": 1, "1d10t!": 1, "ïdíot": 1, "idiots": 1, "videoidiot": 0, "scum": 1, "scummy": 0, "a scum line": 0, "ｉｄｉｏｔ": 1, "nothing": 0, "": 0, None: 0}
    assert s.score("idiot")[0] > s.score("idiot " + "word " * 400)[0] > s.score("word")[0]


def test_learning_finds_entries_and_exceptions():
    rng = random.Random(10)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(6)]
    plain = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = [(plain() + f" grob{rng.choice(['ian', 'ly', 'xx'])} " + plain(), 1) for _ in range(150)] + [(plain(), 0) for _ in range(250)] + [(plain() + " grobian hill " + plain(), 0) for _ in range(30)]
    rng.shuffle(rows)
    m = toxicity.learn(rows)
    assert any(e.startswith(" grob") for e in m.weights) and len(m.weights) < 6
    s = toxicity.Scorer(m)
    assert s.score(plain() + " grobly " + plain())[0] > 0.5 > s.score(plain())[0]
    assert any("hill" in e for e in m.exceptions) and s.score(plain() + " grobian hill " + plain())[0] < 0.5
    assert toxicity.Scorer(toxicity.learn([])).score("anything") == (0.0, 0, 0.0)


def test_learning_has_no_cap_on_entries():
    words = ["".join(chr(97 + (k * 7 + j * (k + 3)) % 26) for j in range(4)) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in range(2500)]
    words = sorted(set(words))
    toxic = ["".join(f" {w} " for w in words[k::4]) for k in range(4) for _ in range(40)]
    got = toxicity.learn_lexicon(toxic, ["harmless words only"] * 160)
    assert len({e.strip() for e in got}) > 0 and all(any(f" {w} ".startswith(e) for e in got) for w in words)


# -- 8 -------------------------------------------------------------------------------------------------------------


def test_lines_near_and_far_from_the_threshold(spark):
    rows = []
    for n, line in ((1, "one"), (4, "four"), (5, "five"), (6, "six"), (40, "forty")):
        rows += [(len(rows) + i, f"own {n} {i}\n  {line} \n\n", f"s{i}") for i in range(n)]
    rows += [(1000 + i, "often but here only", "s0") for i in range(50)] + [(2000, "five", None)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=5)
    gone = {r.doc_id: r for r in got.collect()}
    for doc_id, text, _ in rows:
        want = "\n".join(x for x in text.split("\n") if x.strip() not in ("five", "six", "forty"))
        assert gone[doc_id].kept_text == want and gone[doc_id].n_removed == text.count("\n") + 1 - (want.count("\n") + 1 if want else 0)


def test_sketches_of_several_tables_merge(spark):
    parts = [spark.createDataFrame([(1, 1, f"s{i}") for i in r], "h1 long, h2 long, site string") for r in (range(30), range(20, 60))]
    one = line_dedup.merged(line_dedup.site_sketches(parts[0]).unionByName(line_dedup.site_sketches(parts[1]))).select("n_rows", F.hll_sketch_estimate("sketch").alias("n")).first()
    assert tuple(one) == (70, 60)


# -- 9 -------------------------------------------------------------------------------------------------------------


def test_templates():
    a = license_scan.compile_template("licensed under <<optional>>the terms of<</optional>> license <<var;1;2>> or later")
    w = license_scan.words_of
    for text, end in {
        "Licensed under license two or later": 6, "licensed under the terms of license 2 0 or later now": 10, "licensed under license or later": -1, "licensed under the license 2 or later": -1,
        "licensed under license 1 2 3 or later": -1, "licensed under": -1,
    }.items():
        assert a.accepts(w(text), 0) == end, text
    for bad in ("", "<<optional>>x"):
        with pytest.raises((ValueError, IndexError)):
            license_scan.Scanner({}, {"x": bad})


def test_scans_against_brute_force():
    s = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    rng = random.Random(11)
    parts = ["GNU", "General", "Public", "License", "apache", "License,", "CC", "BY", "cc-by", "MIT", "é", "İ", "2.0", "by", "x_y", "K"]
    for _ in range(1500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        got = license_scan.answer(s, license_scan.words_of(text))
        assert got[:5] == license_brute(text), text
    got = license_scan.answer(s, license_scan.words_of("Released under the MIT License."))
    assert (got[5], got[6]) == ("mit,mit-notice", 0.9)


def filled(template, optional):
    """A text of a template: with or without its optional words, and with as many replaceable words as may be."""
    out, depth = [], 0
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            depth += 1
        elif part == "<</optional>>":
            depth -= 1
        elif depth and not optional:
            pass
        elif part.startswith("<<var"):
            out += ["someone"] * int(part.strip("<>").split(";")[2])
        else:
            out += part.split()
    return out


@pytest.mark.parametrize("label", sorted(license_scan.TEXTS))
def test_whole_license_texts(label):
    s = license_scan.Scanner(license_scan.BASE, license_scan.TEMPLATES)
    labels = lambda words: license_scan.answer(s, license_scan.words_of(" ".join(words)))[5].split(",")
    for optional in (False, True):
        words = filled(license_scan.TEXTS[label], optional)
        assert label in labels(["before", *words, "after"])
        for k in range(0, len(words), 7):
            if words[k] != "someone":  # one mandatory word changed, left out, or another one put in
                gone = [labels(w) for w in (words[:k] + ["changed"] + words[k + 1 :], words[:k] + words[k + 1 :], words[:k] + ["changed"] + words[k:])]
                assert optional or all(label not in x for x in gone[:2]) or words[k] in "123"
                assert k == 0 or label not in gone[0] or words[k] in "123"
    opening = license_scan.TEXTS["mit-text"].split(" including")[0]
    got = license_scan.answer(s, license_scan.words_of(opening + " provided you pay the author no warranty clause here"))
    assert (got[5], got[6]) == ("", 0.0)


# -- 10 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [components.PART_LINKS, 150, 7])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "PART_LINKS", most)
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5000, 5000)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in part if any(x in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_in_dense_regions(spark):
    """Groups of edited copies and documents that share most of a passage: many near the threshold, in regions beyond the neighbours."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(100000)}"
    texts = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(120)] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(100)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(10, 60))]) for _ in range(60)]
    texts += [texts[0].upper(), texts[0], "one two", "One  two", "one two three", None, ""]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    want = near_brute(list(enumerate(texts)))
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert len(shingles("one two")) == 1


def test_regions_cut_at_a_bound_count_as_not_covered():
    word = lambda k: bytes([0, 1, 0, 2, 0, 3, 0, k, 0, 0, 0, 0])
    rows = [(4, word(k), 10 + k, 100) for k in range(4)] + [(4, bytes(12), 1, 100)]
    one = near_dedup.neighbours(75)

    def run(part):
        names = ("tree", "word", "rep", "n_shingles")
        return [x for b in one([pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*part, strict=True)), strict=True)))]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    parts = [run(sorted(rows)[:3]), run(sorted(rows)[3:])]
    members = {a for part in parts for kind, _, a, _ in part if kind == 1}
    assert {10, 11, 12, 13} <= members
    assert len({r for part in parts for kind, r, a, _ in part if kind == 1 and a >= 10}) == 1  # one region again


def test_no_link_is_lost_between_regions_components(spark):
    """The exact join of what neighbours leave, from components as they might be, against brute force."""
    rng = random.Random(14)
    base = [rng.randrange(10**6) for _ in range(200)]
    sets = {}
    for k in range(150):
        kept = [x for x in base[: rng.choice([60, 120, 200])] if rng.random() < rng.choice([0.75, 0.88, 0.97])]
        sets[k] = sorted({*kept, *(rng.randrange(10**6) for _ in range(rng.randrange(20)))})
    parts = {k: rng.choice([k, 0, 1, 2]) for k in sets}
    like = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))
    links = [(a, b) for a in sets for b in sets if a < b and like(a, b)]
    known = {}

    def root(x):
        while known.setdefault(x, x) != x:
            x = known[x]
        return x

    for a, b in links + list(parts.items()):
        x, y = sorted((root(a), root(b)))
        known[y] = x
    raw = spark.createDataFrame([(k, np.array(x, "<u8").tobytes()) for k, x in sets.items()], "doc_id long, shingles binary")
    held = spark.createDataFrame(list(parts.items()), "node long, component long")
    rest = held.selectExpr("node", "component", "cast(cast(node % 3 as string) as binary) as region")
    got = {r.node: r.component for r in near_dedup.rest_parts(rest, held, raw, 75).collect()}
    groups = lambda f: sorted(sorted(k for k in sets if f(k) == g) for g in {f(k) for k in sets})
    assert len(links) > 100 and groups(lambda k: got.get(k, k)) == groups(root)

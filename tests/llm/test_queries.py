"""The registered queries against SQL or brute force on the driver's tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from layerkeep.llm import queries as llm
from layerkeep.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def rows(spark, sf_dir, name):
    return llm.queries()[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, same_rows, name):
    same_rows(llm.queries()[name](spark, sf_dir), llm.oracle_sql()[name])


def substring_brute(docs, window=50):
    first, out = {}, {}
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        gone, own = [False] * len(words), []
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if first.get(key, doc_id) < doc_id:
                gone[k : k + window] = [True] * window
            own.append(key)
        for key in own:
            first.setdefault(key, doc_id)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_op1(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, sf_dir, "op1_substring_dedup")}
    assert got == substring_brute([(d, t) for d, t, *_ in docs])


def test_op3(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op3_language_id")
    lang = {d: g for d, _, g, _ in docs}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95


def test_op4(spark, sf_dir, docs, duck):
    got = {(r.doc_id, r.item_id) for r in rows(spark, sf_dir, "op4_decontaminate")}
    whole = {(d, i) for i, x in duck.sql("SELECT item_id, text FROM benchmark").fetchall() for d, t, *_ in docs if x in (t or "")}
    assert got == whole


def test_op5(spark, sf_dir, docs):
    import public_tokenizers as P
    from sentencepiece import sentencepiece_model_pb2 as pb
    from tokenizers import Tokenizer, models

    m = pb.ModelProto()
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    vocabulary = [(p.piece if p.type in (1, 4, 6) else f"{i}", p.score if p.type in (1, 4) else -1e9) for i, p in enumerate(m.pieces)]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    got = {r.doc_id: r.n_tokens for r in rows(spark, sf_dir, "op5_token_counts")}
    assert got == {d: len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0 for d, x, *_ in docs}


def test_op6(spark, sf_dir, docs):
    import public_tokenizers as P
    import tiktoken

    from layerkeep.llm.byte_bpe import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r, (d, text, *_) in zip(sorted(rows(spark, sf_dir, "op6_byte_bpe"), key=lambda r: r.doc_id), docs, strict=True):
        ids = np.array(enc.encode_ordinary(text or ""), "<u4")
        raw = (text or "").encode()
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())


def plain_score(model, text):
    """A text's score by looking for every entry at every place."""
    if not model.coefficients:
        return 0.0, 0
    folded = toxicity.fold(text or "", toxicity.fold_table())
    places = lambda e: [i for i in range(len(folded)) if folded.startswith(e, i)]
    spared = [(i, i + len(e)) for e in model.exceptions for i in places(e)]
    hits = [w for e, w in model.weights.items() if e not in model.exceptions for i in places(e) if not any(a <= i and i + len(e) <= b for a, b in spared)]
    weight = sum(hits)
    words = max(1, len(folded.split()))
    a, b, c = model.coefficients
    return 1 / (1 + math.exp(-(a * math.log1p(weight) + b * math.log1p(100 * weight / words) + c))), len(hits)


def test_op7(spark, sf_dir, docs, duck):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op7_toxicity")}
    held_out = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in got}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held_out[r.doc_id] for r in got.values())
    labels = duck.sql("SELECT doc_id, toxic FROM labels").fetchall()
    kept = [(d, t) for d, t in labels if not held_out[d]]
    model = toxicity.learn(toxicity.sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame(kept, "doc_id long, toxic int")))
    for d, text, *_ in docs:
        score, hits = plain_score(model, text)
        assert (got[d].score, got[d].n_hits) == (pytest.approx(score, abs=1e-9), hits)
    assert np.mean([got[d].predicted == t for d, t in labels if held_out[d]]) > 0.8


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    found = [(i, label) for p, label in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in found}))


def test_op9(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op9_license_scan")}
    for d, text, *_ in docs:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def shingles(text, size=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def near_brute(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids, by = sorted(sets), {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    for a in ids:
        shared = Counter(b for s in sets[a] for b in by[s] if b < a)
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_op10(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, sf_dir, "op10_near_dedup")}
    assert got == near_brute([(d, t) for d, t, *_ in docs])


def test_pipeline(spark, sf_dir, docs, duck):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    import corpus_pipeline

    from layerkeep.llm.common import table, written

    now, held = table(spark, sf_dir, "documents"), {d: t for d, t, *_ in docs}
    columns = now.columns
    items = [x for (x,) in duck.sql("SELECT text FROM benchmark").fetchall()]

    def exact(left):
        best = {}
        for d, t in left.items():
            key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
            best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
        return {d for _, d in best.values()}

    keep = {
        "language_id": lambda left: {d for d, t in left.items() if any(c.isalpha() for c in t or "")},
        "exact_dedup": exact,
        "near_dedup": lambda left: {d for d, (_, c) in near_brute(list(left.items())).items() if c == d},
        "decontamination": lambda left: {d for d, t in left.items() if not any(x in (t or "") for x in items)},
        "byte_bpe": set,
    }
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf_dir), f"test-{name}")
        held = {d: held[d] for d in keep[name](held)}
        assert {r.doc_id for r in now.select("doc_id").collect()} == set(held), name
        assert now.count() == len(held)
        if name != "byte_bpe":
            assert now.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() == len(held)

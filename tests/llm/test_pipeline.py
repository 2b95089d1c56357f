"""Every stage of the corpus pipeline against plain Python, each on what its predecessor kept."""

import zlib
from collections import Counter, defaultdict

import pytest
from test_simhash import plain_components, plain_simhash

import corpus_pipeline
from flowquarry.llm import language, packing, substrings
from flowquarry.llm.common import held_out, load, staged


@pytest.fixture(scope="module")
def stages(spark, folder):
    """Input and output rows of every stage."""
    docs, out = load(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, folder), f"test-{name}")
        out[name] = before, docs
    return out


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_order_and_columns(stages):
    assert list(stages) == ["language", "simhash", "substrings", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][1].dtypes == stages[name][0].dtypes


def test_language_rejects_what_it_does_not_know(stages):
    before, after = stages["language"]
    profiles = language.fit(before.where(~held_out(before.doc_id, 4)))
    want = []
    for row in rows(before):
        names, score = profiles.predict([row[1]])
        if names[0] != language.UNKNOWN and score[0] >= 0.5:
            want.append(row)
    assert sorted(rows(after)) == sorted(want) and len(want) > 0.95 * before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["simhash"]
    marks = {r[0]: plain_simhash(r[1]) for r in rows(before)}
    near = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 3]
    label = plain_components(marks, near)
    assert sorted(rows(after)) == sorted(r for r in rows(before) if label[r[0]] == r[0])


def test_repeated_passages_go(stages):
    before, after = stages["substrings"]
    spans = defaultdict(list)
    for r in substrings.repeated_spans(before).collect():
        spans[r.doc_id].append((r.first, r.last))
    want = []
    for doc, text, lang, source, n in rows(before):
        if doc in spans:
            gone = {i for a, b in spans[doc] for i in range(a, b)}
            text = "".join(c for i, c in enumerate(text) if i not in gone)
            n = len(text)
        want.append((doc, text, lang, source, n))
    assert sorted(rows(after)) == sorted(want)


def test_mix_is_taken(stages):
    before, after = stages["mixing"]
    have, taken = {r[0]: r for r in rows(before)}, Counter(r[0] for r in rows(after))
    assert all(r == have[r[0]] for r in rows(after)) and max(taken.values()) <= 2
    size = {d: len((r[1] or "").encode().split()) for d, r in have.items()}
    by, got = Counter(), Counter()
    for d, r in have.items():
        by[r[3]] += size[d]
        got[r[3]] += size[d] * taken[d]
    names = sorted(by)
    from test_mixing import plain_targets

    want = plain_targets([by[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(by.values()), 2)
    assert all(abs(got[s] - t) <= max(size.values()) / 2 + 1 for s, t in zip(names, want, strict=True))


def test_everything_is_packed(stages):
    before, after = stages["packing"]
    texts = defaultdict(list)
    for r in rows(before):
        texts[r[0]].append(r[1])
    encoder = packing.WordEncoder(packing.default_tokenizer())
    import numpy as np
    import pyarrow as pa

    found, sequences = defaultdict(list), Counter()
    for r in after.collect():
        found[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())
    for doc, own in texts.items():
        shard = packing.Shard(pa.array(own[:1]), encoder)
        ids, seen = shard.ids.tolist(), Counter()
        for p in found[doc]:
            assert ids[p.start : p.start + p.length] == p.ids
            seen.update(range(p.start, p.start + p.length))
        assert seen == Counter(dict.fromkeys(range(len(ids)), len(own)))
    assert set(found) == set(texts)

from __future__ import annotations

import random
from itertools import combinations

import pytest

from gleaner.llm import ngram_join as N
from tests.llm.conftest import rows_of


def brute(rows):
    """(shingles, smallest reachable id) of every row, from the definition."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set())
    roots = list(range(len(rows)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                roots[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return sorted((repr(d), len(s), repr(ids.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.jaccard_components(frame).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in found) == brute(rows)


def test_components_match_brute_force(spark, docs):
    check(spark, [tuple(row) for row in docs.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_with_edits_around_the_threshold(spark, seed):
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(rng.randrange(6, 90))]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            text = " ".join(copy).title() + ("\n" + line if rng.random() < 0.5 else "")
            rows.append((len(rows), text))
    rows += [(500, line), (501, line + " x"), (502, "a a a a a a a"), (503, "a a a a a"), (None, "a A a a a")]
    check(spark, rows)


def test_one_document_of_each_component_stays(docs):
    found = {(r.doc_id, r.component_id) for r in N.jaccard_components(docs).collect()}
    kept = [r.doc_id for r in N.one_of_each(docs).collect()]
    assert set(kept) == {component for doc_id, component in found if doc_id == component}
    assert len(kept) == sum(r.doc_id in set(kept) for r in docs.collect())


def test_empty_tables_and_clashing_names(docs, nothing, clashing):
    assert N.jaccard_components(nothing).collect() == []
    assert N.one_of_each(nothing).collect() == []
    assert rows_of(N.jaccard_components(clashing)) == rows_of(N.jaccard_components(docs))
    assert N.one_of_each(clashing).columns == clashing.columns


def test_two_groups_and_two_sets_of_one_size_meet_once(spark, monkeypatch):
    """Copies with other words in places are of one size, so each would meet the other's group."""
    rng, rows, met = random.Random(7), [], []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(60)]
        for _ in range(12):
            copy = list(words)
            for at in rng.sample(range(60), 2):
                copy[at] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    whole = N._ordered_pairs

    def ordered(pairs):
        met.append(pairs.count())
        return whole(pairs)

    stored, kept = N.stored, {}

    def watched(frame, label, *partitions):
        kept[label] = stored(frame, label, *partitions)
        return kept[label]

    monkeypatch.setattr(N, "_ordered_pairs", ordered)
    monkeypatch.setattr(N, "stored", watched)
    check(spark, rows)
    assert met[1:] == [kept["closest-pairs"].count(), kept["opened-pairs"].count()]
    assert met[1] > 0


def test_sets_of_a_group_meet_another_set_together(spark, monkeypatch):
    """Single sets that hold much of a group's text meet the group once, not each of its members."""
    rng, rows, kept, stored = random.Random(3), [], {}, N.stored
    words = [f"w{i}" for i in range(60)]
    for _ in range(12):
        copy = list(words)
        copy[rng.randrange(55, 60)] = f"edit{rng.random()}"
        rows.append((len(rows), " ".join(copy)))
    for single in range(8):
        rows.append((len(rows), " ".join(words[:45] + [f"s{single}w{i}" for i in range(15)])))

    def watched(frame, label, *partitions):
        kept[label] = stored(frame, label, *partitions)
        return kept[label]

    monkeypatch.setattr(N, "stored", watched)
    check(spark, rows)
    parts = kept["group-parts"]
    groups = len(rows) - parts.count() + parts.select("root_place").distinct().count()
    assert groups < len(rows) and 0 < kept["qualifying"].count() <= groups * (groups - 1) // 2

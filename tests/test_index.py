"""The stored index, against what its documents say."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import changes as C
from gleaner.operators import judging as J
from gleaner.operators import lexical as L
from gleaner.plans import search as S
from gleaner.session import materialize, scratch, setting
from gleaner.sources.fields import DocumentSource
from gleaner.sources.index import TERMS, Index

TOWNS = "oslo turin lyon ghent porto".split()


def frame(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "path string, text string")


class Shelf:
    """A source that is kept while its documents change."""

    def __init__(self, spark):
        self.texts: dict[str, str | None] = {}
        self.source = DocumentSource(lambda: frame(spark, self.texts), "shelf")


@pytest.fixture
def shelf(spark):
    return Shelf(spark)


@pytest.fixture
def index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gleaner.sources.index.FEWEST_SLOTS", 4)  # small corpora, few folders
    return Index(spark, str(tmp_path / "index"), 256)


def town_words(seed, count=60):
    rng = random.Random(seed)
    return {f"{rng.choice(TOWNS)}/{i:02}": " ".join(rng.choices(TOWNS, k=rng.randrange(90))) for i in range(count)}


def frequencies(texts):
    """In how many documents each town occurs; every text here is one passage or more."""
    found = {}
    for path, text in texts.items():
        for start in range(0, max(1, len(text) - 25), 231):
            for word in {path.split("/")[0], *text[start : start + 256].split()}:
                found[word] = found.get(word, 0) + 1
    return found


def test_random_changes_leave_the_index_of_the_final_state(spark, index, shelf, tmp_path):
    rng = random.Random(4)
    shelf.texts = town_words(1)
    index.refresh(shelf.source)
    for step in range(3):
        gone = rng.sample(sorted(shelf.texts), 9)
        for path in gone[:4]:
            del shelf.texts[path]
        for path in gone[4:]:
            shelf.texts[path] = f"porto {step}"
        shelf.texts[f"new/{step}"] = "lyon"
        done = index.refresh(shelf.source)
        assert (done.documents, done.updated, done.removed) == (len(shelf.texts), 6, 4)
    fresh = Index(spark, str(tmp_path / "fresh"), 256)
    fresh.refresh(shelf.source)
    wanted = spark.createDataFrame([(t,) for t in [*TOWNS, "absent"]], "term string")
    asked = S.one_query(spark, "oslo porto")
    results = S.search(fresh.corpus(), asked, 5, 20, single=True).results.collect()
    for part in ("passages", "postings"):
        mine, theirs = (sorted(map(str, getattr(i, part)().collect())) for i in (index, fresh))
        assert mine == theirs
    assert sorted(index.term_df(wanted).collect()) == sorted(fresh.term_df(wanted).collect())
    assert sorted(S.search(index.corpus(), asked, 5, 20, single=True).results.collect()) == sorted(results)
    documents = [sorted(map(str, i.documents().drop("stamp").collect())) for i in (index, fresh)]
    assert documents[0] == documents[1]


def test_only_the_slots_of_changed_documents_are_written_again(index, shelf):
    shelf.texts = town_words(6, 90)
    index.refresh(shelf.source)

    def files():
        return {f.rsplit("/", 2)[-2]: f for f in sorted(index.passages().inputFiles())}

    before = files()
    shelf.texts["lyon/00x"] = "a new one"
    index.refresh(shelf.source)
    after = files()
    assert len(before) == 4 and sum(before[slot] != after[slot] for slot in before) == 1


def test_a_slot_that_loses_its_last_document_is_emptied(index, shelf):
    shelf.texts = {f"town/{i}": f"oslo {i}" for i in range(5)}
    index.refresh(shelf.source)
    for left in (2, 0):
        shelf.texts = dict(list(shelf.texts.items())[:left])
        index.refresh(shelf.source)
        assert index.passages().count() == index.documents().count() == left
        assert index.postings(["oslo"]).count() == left


def test_an_interrupted_refresh_is_repaired_by_the_next(index, shelf, monkeypatch):
    shelf.texts = town_words(7, 40)
    index.refresh(shelf.source)
    shelf.texts = {**town_words(8, 40), "extra/0": "ghent"}
    whole = Index._overwrite

    def broken(self, data, kind, *rest):
        if kind == "postings":
            raise OSError("connection lost")
        whole(self, data, kind, *rest)

    monkeypatch.setattr(Index, "_overwrite", broken)
    with pytest.raises(OSError, match="lost"):
        index.refresh(shelf.source)
    monkeypatch.undo()
    del shelf.texts["extra/0"]  # what was written half is not listed any more
    shelf.texts["extra/1"] = "ghent"
    index.refresh(shelf.source)
    assert {r.path for r in index.passages().collect()} == set(shelf.texts)
    assert {r.path for r in index.postings(["ghent"]).collect()} <= set(shelf.texts)


def test_manifests_are_compared_without_an_exchange(spark, tmp_path):
    def stored(name, count):
        rows = spark.range(count).selectExpr("cast(id as string) as path", "cast(id % 7 as string) as stamp")
        return C.store_manifest(rows, str(tmp_path / name), 8)

    diff = C.snapshot_diff(stored("one", 5000), stored("two", 6000))
    assert "Exchange" not in plan(diff)
    assert {r["class"]: r.n for r in diff.groupBy("class").agg(F.count("*").alias("n")).collect()} == {
        "new": 1000, "unchanged": 5000,
    }
    again = C.open_manifest(spark, str(tmp_path / "one"), "path string, stamp string", 8)
    assert again.count() == 5000


def test_refresh_reports_its_progress(index, shelf):
    shelf.texts = {"a": "oslo", "b": None}
    told = []
    done = index.refresh(shelf.source, progress=lambda step, counters: told.append((step, counters)))
    assert [step for step, _ in told] == ["read", "written", "done"]
    assert told[0][1] == {"documents": 1, "skipped": 1, "passages": 1}
    assert told[-1][1] == vars(done)


def test_refusals_leave_the_index_and_come_back(index, shelf):
    def refreshed(**texts):
        shelf.texts = texts
        done = index.refresh(shelf.source)
        return done.documents, done.updated, done.skipped, done.removed

    assert refreshed(x=None, y="", z="dock") == (2, 2, 1, 0)
    assert {r.path: r.reason for r in index.skipped().collect()} == {"x": "null value"}
    assert refreshed(x="pier", y="", z="do\x00ck") == (2, 1, 1, 1)
    assert refreshed(x="pier", y="", z="do\x00ck") == (2, 0, 1, 0)
    assert refreshed(x=None, y=None) == (0, 0, 2, 2)
    assert index.passages().isEmpty() and index.postings().isEmpty()
    assert refreshed() == (0, 0, 0, 0)


def test_an_index_belongs_to_one_source_and_passage_size(spark, index, shelf, tmp_path):
    shelf.texts = {"a": "quay"}
    index.refresh(shelf.source)
    other = DocumentSource(frame(spark, shelf.texts), "elsewhere")
    with pytest.raises(ValueError, match="another source"):
        index.refresh(other)
    with pytest.raises(ValueError, match="another source"):
        Index(spark, str(tmp_path / "index"), 300).refresh(shelf.source)
    with pytest.raises(ValueError, match="no index"):
        Index(spark, str(tmp_path / "none"), 256).passages()


def test_a_refresh_that_fails_changes_nothing(spark, index, shelf):
    shelf.texts = {"a": "quay"}
    index.refresh(shelf.source)
    broken = F.when(F.col("path") == "b", F.raise_error(F.lit("disk gone")).cast("string")).otherwise("quay")
    source = DocumentSource(frame(spark, {"a": "", "b": ""}).withColumn("text", broken), "shelf")
    with pytest.raises(Exception, match="disk gone"):
        index.refresh(source)
    assert [r.text for r in index.passages().collect()] == ["quay"]
    assert index.refresh(shelf.source).updated == 0


def test_two_documents_of_one_path_fail_stored_or_not(spark, index):
    rows = spark.createDataFrame([("a", "dock"), ("a", "pier")], "path string, text string")
    with pytest.raises(Exception, match="More than one document"):
        index.refresh(DocumentSource(rows, "twice"))
    with pytest.raises(Exception, match="More than one document"):
        S.search_documents(rows, "dock", 1).collect()


def plan(found):
    return found._jdf.queryExecution().executedPlan().toString()


def test_reads_are_pruned_by_slot_and_term(spark, index, shelf):
    shelf.texts = town_words(2)
    index.refresh(shelf.source)
    assert "EqualTo(term,oslo)" in plan(index.postings(["oslo"]))
    offered = plan(index.corpus().candidates(S.one_query(spark, "oslo"), 5, single=True))
    assert "slot#" in offered.split("PartitionFilters: [")[1].split("]")[0]
    single = index.corpus().shortlist(S.one_query(spark, "oslo"), 5, single=True)
    assert "CartesianProduct" not in plan(single)


def test_a_single_search_orders_and_cuts_before_it_numbers(spark, index, shelf):
    shelf.texts = town_words(2)
    index.refresh(shelf.source)
    found = S.search(index.corpus(), S.one_query(spark, "oslo"), 5, 20, single=True).results
    assert "TakeOrderedAndProject" in plan(found)


def test_stored_and_scanned_searches_agree(spark, index, shelf):
    shelf.texts = {**town_words(3, 90), "lost": "oslo\x00", "none": None}
    index.refresh(shelf.source)
    corpus, asked = index.corpus(), S.one_query(spark, "ghent turin")
    scanned = S.search_documents(frame(spark, shelf.texts), "ghent turin", 6, candidates=30, chunk_chars=256)
    for single in (True, False):
        stored = S.search(corpus, asked, 6, 30, single=single).results
        assert sorted(stored.collect()) == sorted(scanned.collect())
    shown = S.with_text(S.search(corpus, asked, 6, 30).results, corpus).collect()
    assert all(shelf.texts[r.path] == r.text for r in shown) and len(shown) == 6


def test_small_corpora_offer_every_passage(spark, index, shelf):
    shelf.texts = {"long": "b" * 1500, "short": "c"}
    passages = index.refresh(shelf.source).passages
    corpus, asked = index.corpus(), S.one_query(spark, "zzz")
    assert corpus.candidates(asked, 0, single=True).count() == passages
    table = spark.createDataFrame([(1, "zzz"), (2, "c")], "query_id long, query string")
    assert corpus.candidates(table, 2).count() == 2 * passages
    assert corpus.candidates(table, 1).count() == 2
    with pytest.raises(ValueError, match="single query"):
        corpus.candidates(table, 0)


def test_scratch_deletes_its_own_tables_only(spark):
    outside = materialize(spark.range(3), "outside")
    with scratch(spark):
        inside = materialize(spark.range(4), "inside")
        assert inside.count() == 4
    assert outside.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inside.inputFiles()[0]).count()


def test_pruned_scores_are_those_of_all_postings(spark, index, shelf):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)]
    chances = [1 / (1 + i) for i in range(80)]
    shelf.texts = {f"{i:03}": " ".join(rng.choices(words, chances, k=rng.randrange(5, 300))) for i in range(300)}
    index.refresh(shelf.source)
    corpus = index.corpus()
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(30)] + [(99, "absent")]
    terms = L.explode_terms(spark.createDataFrame(asked, "query_id long, query string"))
    mean, count = F.lit(corpus.mean_length), F.lit(corpus.passage_count)
    every = L.term_weights(L.term_df(corpus.postings(None), terms), terms, count)
    scores = materialize(L.bm25_scores(L.term_matches(corpus.postings(None), every), mean), "scores")
    for limit in (1, 5, 40, 500):
        exact = L.lexical_shortlist(L.best_passage(scores), limit)
        weights = materialize(L.bounded_weights(corpus.term_stats(terms), terms, count, mean), "weights")
        pruned = L.pruned_scores(corpus._postings_of, weights, mean, limit)
        found = L.lexical_shortlist(L.best_passage(pruned), limit)
        assert sorted(found.collect()) == sorted(exact.collect())
        if limit == 1:
            assert pruned.count() < scores.count() / 2


def test_stored_terms_give_the_judgements_of_the_text(spark, index):
    rng = random.Random(11)
    words = ["Harbour", "TIDE", "été", "oslo", "txt", "3", "sea-wall", "日本"]
    rows = []
    for i in range(40):
        source = None if i % 2 else '{"table":"t"}'
        rows.append((f"Oslo/tide {i}/harbour {i}.txt", " ".join(rng.choices(words, k=rng.randrange(120))), source))
    frame_of = spark.createDataFrame(rows, "path string, text string, source string")
    index.refresh(DocumentSource(frame_of, "mixed"))
    table = spark.createDataFrame(
        [(1, "tide txt oslo 3", None, None), (2, "harbour", "été tide tide", "日本 sea"), (3, "---", "---", "x")],
        "query_id long, query string, yes string, no string",
    )
    corpus = index.corpus()
    found = []
    for prepare in (lambda passages: passages, J.TOKEN_OVERLAP.prepare):
        offered = corpus.candidates(table, 1000, prepare=prepare)
        assert ("judged" in offered.columns) != ("text" in offered.columns)
        scored = S.score(S._judgements(offered, S.asked_of(table, J.TOKEN_OVERLAP)), J.TOKEN_OVERLAP)
        found.append(sorted(map(tuple, scored.select("query_id", "path", "ordinal", "score").collect())))
    assert found[0] == found[1] and len({row[3] for row in found[0]}) > 20


def test_stored_terms_know_the_size_of_a_request(spark, index):
    index.refresh(DocumentSource(frame(spark, {"a": '"' * 250}), "quotes"))
    offered = index.corpus().candidates(S.one_query(spark, "q"), 0, single=True, prepare=J.TOKEN_OVERLAP.prepare)
    for extra, fits in ((0, True), (1, False)):
        # {"query": "...", "text": "a\n\n" and 250 escaped quotes}
        room = 28_000 - len('{"query": "", "text": ""}') - len("a") - 4 - 500 + extra
        asked = S.asked_of(S.one_query(spark, "q" * room), J.TOKEN_OVERLAP)
        judged = S.score(S._judgements(offered, asked), J.TOKEN_OVERLAP)
        if fits:
            assert judged.count() == 1 and judged.select("score").first().score == 0
        else:
            with pytest.raises(Exception, match="exceed one request"):
                judged.select("score").collect()


def test_candidates_are_judged_in_many_tasks(spark, index, shelf):
    shelf.texts = town_words(2)
    index.refresh(shelf.source)
    asked = spark.createDataFrame([(1, "oslo"), (2, "ghent porto")], "query_id long, query string")
    asked = asked.selectExpr("query_id", "query", "cast(null as string) as yes", "cast(null as string) as no")
    keys = index.corpus().candidates(asked, 20).select("query_id", "path", "ordinal")
    assert "REPARTITION_BY_NUM" in plan(keys)


def test_documents_are_dealt_before_they_are_cut_and_sorted_in_small_parts(spark, index, shelf, monkeypatch):
    """Texts pass the exchange, not passages with their runs; postings come from small splits."""
    shelf.texts = town_words(9, 40)
    whole, seen, name = Index._overwrite, {}, "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(name)

    def watched(self, data, kind, rows, *rest):
        seen[kind] = (plan(rows), spark.conf.get(name))
        whole(self, data, kind, rows, *rest)

    monkeypatch.setattr(Index, "_overwrite", watched)
    index.refresh(shelf.source)
    cut, dealt = seen["passages"][0].index("Generate"), seen["passages"][0].index("Exchange")
    assert cut < dealt and "Exchange" not in seen["postings"][0]
    assert int(seen["postings"][1]) <= 16 << 20 and spark.conf.get(name) == usual


def test_passages_that_stay_pass_no_exchange_until_files_gather(spark, index, shelf, monkeypatch):
    shelf.texts = town_words(10, 40)
    whole, dealt = Index._overwrite, []

    def watched(self, data, kind, rows, *rest):
        if kind == "passages":
            dealt.append(plan(rows).count("REPARTITION_BY_NUM"))
        assert kind == "passages" or "Exchange" not in plan(rows)
        whole(self, data, kind, rows, *rest)

    monkeypatch.setattr(Index, "_overwrite", watched)
    for step in range(8):
        shelf.texts |= {path: f"porto {step}" for path in sorted(shelf.texts)[step::8]}
        index.refresh(shelf.source)
        assert {r.path for r in index.passages().collect()} == set(shelf.texts)
        assert index.postings(["porto"]).count() == frequencies(shelf.texts)["porto"]
        wanted = spark.createDataFrame([("porto",)], "term string")
        assert index.term_df(wanted).first().df == frequencies(shelf.texts)["porto"]
    assert dealt[0] == 1 and set(dealt[1:]) == {1, 2}


def test_terms_are_counted_once_for_all_batches_of_a_task(spark, index, shelf):
    """One row for each term of a file, whatever a batch holds: also where a path has the term."""
    shelf.texts = town_words(11, 40) | {"porto/oslo porto.txt": "oslo oslo é", "empty": ""}
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "3"):
        index.refresh(shelf.source)
    state = index._current()
    stored = index._table(state, "terms", TERMS)
    assert stored.groupBy("term", "slot", F.input_file_name()).count().where("count > 1").isEmpty()
    wanted = index.postings().select("term").distinct()
    columns = ["term", "df", "most", "shortest"]
    found = {tuple(row) for row in index._term_stats(state, wanted).select(columns).collect()}
    assert found == {tuple(row) for row in L.term_stats(index.postings(), wanted).select(columns).collect()}


def test_floors_need_no_sort_of_all_scores(spark):
    rows = [(1, "a", 0, 2.0), (1, "a", 1, 5.0), (1, "b", 0, 3.0), (1, "c", 0, 1.0), (2, "a", 0, 9.0)]
    scores = spark.createDataFrame(rows, "query_id long, path string, ordinal int, bm25 double")
    floors = L._floors(scores, 2)
    assert "SortAggregate" not in plan(floors)
    assert [(row.query_id, round(row.floor, 5)) for row in floors.collect()] == [(1, 3.0)]

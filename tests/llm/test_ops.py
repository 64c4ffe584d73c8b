"""Each operator against brute force on a table with every awkward row, and on an empty one."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
import public_tokenizers as P

from tarnlens.llm import common, decontaminate, line_dedup, ngram_join, ogg, pieces, repeated_bytes, substring_dedup, token_counts, token_shards, toxicity

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return brute.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def doubled(docs):
    """The same rows again, and some without an id."""
    return docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def twice(got, doubled, own, by_text=True):
    """Rows that repeat or have no id have what a row of their text has; own(row) is what counts."""
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(own(r))
    texts_of = {}
    for r in doubled.collect():
        texts_of.setdefault(r.doc_id, []).append(r.text)
    assert {i: len(x) for i, x in of.items()} == {i: len(x) for i, x in texts_of.items()}
    if by_text:
        want = {}
        for i, found in of.items():
            if i is not None and len(found) == 1:
                want[texts_of[i][0]] = found[0]
        for i, found in of.items():
            known = [want[t] for t in texts_of[i] if t in want]
            assert len(known) < len(found) or sorted(map(repr, found)) == sorted(map(repr, known))
            assert i is None or len(set(map(repr, found))) == len(set(texts_of[i]))


def test_token_counts(docs, rows, empty, doubled, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    for head in (100_000, 3):  # with 3 nearly all take the shuffled arm
        monkeypatch.setattr(token_counts, "HEAD_ROWS", head)
        got = by_id(token_counts.count_tokens(docs, WORD))
        assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in texts(rows)}
    assert token_counts.count_tokens(empty, WORD).count() == 0
    counted = token_counts.count_tokens(doubled, WORD).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in doubled.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted) == want
    named = token_counts.count_tokens(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), WORD).collect()
    assert {r.doc_id: r.n_tokens for r in named} == {f"d{i}": r.n_tokens for i, r in got.items()}


def test_token_counts_over_many_partitions(docs, rows, spark):
    """Row numbers of different partitions don't meet, and batches of very long texts are cut by their bytes."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    long = [(1000 + i, " ".join(f"word{i}x{k % 977}" for k in range(90_000))) for i in range(8)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id bigint, text string")).repartition(17)
    got = by_id(token_counts.count_tokens(table, WORD))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in [*texts(rows), *long]}


def test_token_shards(spark, docs, rows, empty, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out = f"file://{tmp_path}/shards"
    index = token_shards.write_shards(docs, out, PIECE, length=16, rows_per_shard=8).orderBy("slot").collect()
    n = len(index)
    assert [r.slot for r in index] == list(range(n)) and sorted(r.sequence for r in index) == list(range(n))
    read = list(token_shards.read_slots(out))
    assert len(read) == n and all(np.array_equal(a, b) for a, b in zip(read[n - 5 :], token_shards.read_slots(out, n - 5), strict=True))
    flat = [t for r in sorted(index, key=lambda r: r.sequence) for t in read[r.slot].tolist()[: r.n_tokens]]
    want = sorted(tuple(sp.encode(t or "")) for _, t in texts(rows))
    cut, own = [], []
    for t in flat:
        if t == 2:
            cut.append(tuple(own))
            own = []
        else:
            own.append(t)
    assert not own and sorted(cut) == want
    assert token_shards.write_shards(empty, f"file://{tmp_path}/none", PIECE).count() == 0 and list(token_shards.read_slots(f"file://{tmp_path}/none")) == []


def test_token_shards_below_a_bare_folder(spark, docs, tmp_path, monkeypatch):
    docs.limit(20).write.parquet(f"file://{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"{tmp_path}/bare füll folder")
    got = token_shards.op2_token_shards(spark, f"file://{tmp_path}/in").collect()
    (out,) = (tmp_path / "bare füll folder").glob("tarnlens-shards-*")
    read = list(token_shards.read_slots(common.uri_of(spark, str(out))))
    assert len(got) == len(read) > 0
    assert all(hashlib.sha256(read[r.slot][: r.n_tokens].tobytes()).hexdigest() == r.ids_sha256 for r in got)


@pytest.mark.parametrize("total", [1, 2, 3, 17, 256, 1000])
def test_slots_are_a_permutation(total):
    got = token_shards.slots(np.arange(total), total)
    assert sorted(got.tolist()) == list(range(total))
    assert total < 17 or got.tolist() != token_shards.slots(np.arange(total), total, key=5).tolist()


def rude_or_calm(spark):
    r = random.Random(3)
    calm, rude = ["tree", "river", "stone", "walks", "green", "quiet", "song", "table"], ["blarg", "grunk"]
    sentence = lambda bad: " ".join([r.choice(calm) for _ in range(20)] + ([r.choice(rude)] if bad else []))
    # the group's name comes mostly with rude words: without the penalty it would be evidence by itself
    made = [(i, sentence(i % 2) + (" muslim" if i % 2 and i % 4 == 1 else "")) for i in range(600)]
    table = spark.createDataFrame(made, "doc_id bigint, text string")
    return table, spark.createDataFrame([(i, i % 2) for i, _ in made] + [(5, None), (None, 1), (9999, 1)], "doc_id bigint, toxic int")


def test_toxicity(spark, docs, rows, empty, doubled):
    table, labels = rude_or_calm(spark)
    fair = toxicity.fit(table, labels, swap=20.0)
    plain = toxicity.fit(table, labels, swap=0.0)
    got = toxicity.score(table, fair).collect()
    held = [x for x in got if x.held_out]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.95 * len(held)
    gap = lambda m: abs(m.margin("the muslim song") - m.margin("the hindu song"))
    assert gap(fair) < 0.5 * gap(plain)
    found = toxicity.score(doubled, fair).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, fair.score(r.text)) for r in doubled.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in found) == want
    assert toxicity.score(empty, fair).count() == 0
    none = toxicity.fit(table, labels.limit(0))
    assert none.score("anything") == 0.5 and none.score(None) == 0.5
    assert toxicity.fit(table, labels.filter("toxic = 1")).score("anything") > 0.9


def test_the_penalty_changes_the_shipped_fit(spark):
    """With the shipped weight and terms a neutral mention of a group is not evidence; other terms change nothing."""
    table, labels = rude_or_calm(spark)
    fair, plain, other = (toxicity.fit(table, labels, **k) for k in ({}, {"swap": 0.0}, {"terms": (("nobody", "noone"),)}))
    mention = "a muslim song"
    assert fair.weights != plain.weights and other.weights == plain.weights
    assert fair.margin(mention) - fair.margin("a song") < 0.7 * (plain.margin(mention) - plain.margin("a song"))


def test_the_sample_is_the_same_each_time(spark):
    """Ties in the order of the sample are broken by the id, so two fits agree."""
    table, labels = rude_or_calm(spark)
    one, two = (toxicity.fit(t, labels.repartition(n), sample=(40, 60)) for n, t in ((2, table), (5, table.repartition(3))))
    assert one.weights == two.weights and one.bias == two.bias


def test_counterfactuals():
    kinds = toxicity._kinds((("gay", "straight", "queer"), ("black", "white")))
    found = [(b" ".join(x), b" ".join(y)) for x, y in toxicity.counterfactuals("A gay man, gay. Nothing else.\nBlack gay", kinds)]
    assert found == [(b"a gay man gay", b"a straight man straight"), (b"a gay man gay", b"a queer man queer"), (b"black gay", b"white gay"), (b"black gay", b"black straight"), (b"black gay", b"black queer")]
    assert not list(toxicity.counterfactuals(None, kinds)) and not list(toxicity.counterfactuals("no one named", kinds))
    lost, gained = toxicity.change([b"a", b"gay", b"man"], [b"a", b"straight", b"man"])
    assert set(lost) == set(toxicity.word_features(b"gay")) - set(gained) and not set(lost) & set(gained)
    assert toxicity.change([b"gay", b"gays"], [b"straight", b"gays"])[0] == tuple(sorted(set(toxicity.word_features(b"gay")) - set(toxicity.word_features(b"gays")) - set(toxicity.word_features(b"straight"))))


def test_toxicity_of_unspaced_runs():
    """An insult counts wherever it stands in a run, also after many bytes."""
    rng = random.Random(3)
    prose = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    run = lambda toxic: prose(30) + "，" + ("你这个白痴" if toxic else prose(5)) + "，" + prose(20) + "。"
    labels = np.array([i % 2 for i in range(200)], np.int64)
    model = toxicity.train([toxicity.document_features(run(y)) for y in labels], labels, {})
    assert all(model.score(run(True)) >= toxicity.THRESHOLD > model.score(run(False)) for _ in range(50))
    assert model.score("你这个白痴" + prose(2000)) > 0.5 < model.score(prose(2000) + "你这个白痴")
    assert all(len(w) <= toxicity.KEPT_BYTES for w in model.kept)


def test_line_dedup(docs, rows, empty, doubled):
    got = by_id(line_dedup.dedup_lines(docs, carry=("lang",)))
    assert {i: (r.n_lines, r.n_dropped, r.kept_sha256) for i, r in got.items()} == brute.lines(texts(rows))
    assert {r.lang for r in got.values()} == {"en"}
    assert line_dedup.dedup_lines(empty).count() == 0
    # a null id is a document before all others: it keeps its lines, and others lose what it has
    again = line_dedup.dedup_lines(doubled).collect()
    want = brute.lines([(-1 if r.doc_id is None else r.doc_id, r.text) for r in doubled.collect()])
    assert len(again) == len(rows) + 8 and all((r.n_lines, r.n_dropped, r.kept_sha256) == want[r.doc_id] for r in again if r.doc_id is not None)
    with pytest.raises(TypeError):
        line_dedup.dedup_lines(docs, id_col="id")
    assert line_dedup.dedup_lines(docs, min_docs=3).count() == len(rows)


def test_line_dedup_of_repeated_ids(spark):
    """Each row of a repeated id loses its own repeated lines, wherever the id's other rows have theirs."""
    x, y = "a line that comes again", "another line that comes again"
    table = [(1, f"{x}\n{y}"), (7, f"{x}\nthe first unique line"), (7, f"the second unique line\n{x}"), (7, f"the second unique line\n{x}"), (7, None), (None, f"the third unique line\n{y}"), (None, f"{y}\nthe fourth unique line")]
    got = line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_dropped, r.kept_text) for r in got) == sorted([(1, 1, x), (7, 1, "the first unique line"), (7, 1, "the second unique line"), (7, 1, "the second unique line"), (7, 0, ""), (0, 0, table[5][1]), (0, 0, table[6][1])])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join(docs, rows, n, percent):
    sets = {i: brute.shingles(t, n) for i, t in texts(rows)}
    got = by_id(ngram_join.link_components(docs, n, percent))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), c) for i, c in brute.components(sets, percent).items()}


def test_ngram_join_in_chunks(spark, monkeypatch):
    """A group of near copies that is larger than a chunk, with sets that only some of the others link to."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    table = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 6))):
            t[r.randrange(len(t))] = f"x{r.randrange(400)}"
        table.append((i, " ".join(t)))
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 16)
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    sets = {i: brute.shingles(t, 3) for i, t in table}
    assert {i: r.component_id for i, r in by_id(ngram_join.link_components(docs, 3, 90)).items()} == brute.components(sets, 90)


def test_groups_of_unlike_sets_are_split_again(spark, monkeypatch):
    """Short texts of few words meet by accident in one large group; all links are found, and the last search is small."""
    r = random.Random(9)
    table = [(i, " ".join(r.sample("abcdefghijklmnop", 6))) for i in range(400)]
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    monkeypatch.setattr(ngram_join, "ACROSS_SETS", 16)
    monkeypatch.setattr(ngram_join, "FEW_BLOCKS", 1)
    left, whole = [], ngram_join.split_again
    monkeypatch.setattr(ngram_join, "split_again", lambda told, *a: left.append((told.count(), (out := whole(told, *a)).count())) or out)
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    sets = {i: brute.shingles(t, 1) for i, t in table}
    for percent in (70, 60):
        got = by_id(ngram_join.link_components(docs, 1, percent))
        assert {i: x.component_id for i, x in got.items()} == brute.components(sets, percent)
    assert left and all(after <= before for before, after in left)


@pytest.mark.parametrize("in_turn", [False, True])
def test_disk_of_the_join_is_bounded(spark, monkeypatch, in_turn):
    """Unlike sets in one large group: no round of signatures holds more than half of them if they are met in turn, the last
    search deals its sets out in rounds, and all links are found."""
    r = random.Random(11)
    table = [(i, " ".join(r.sample("abcdefghijklmnop", r.choice((5, 6, 7))))) for i in range(300)]
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    monkeypatch.setattr(ngram_join, "ACROSS_SETS", 16)
    monkeypatch.setattr(ngram_join, "FEW_BLOCKS", 1 << 30)
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(2)
    sets = {i: brute.shingles(t, 1) for i, t in table}
    written, whole = [], common.settled
    monkeypatch.setattr(common, "settled", lambda df, label: written.append(label) or whole(df, label))
    got = by_id(ngram_join.link_components(docs, 1, 60, in_turn=in_turn))
    assert {i: x.component_id for i, x in got.items()} == brute.components(sets, 60)
    assert written.count("across") > 1 and written.count("shared") == written.count("chains") == 1 + in_turn


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bands_in_turn_have_all_signatures(percent):
    r, t = np.random.default_rng(percent), ngram_join.Threshold(percent)
    for size in (0, 1, 2, 7, 40, 300):
        s = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        whole, *turns = (sorted(zip(*(x.tolist() for x in ngram_join.signatures(s, t, odd=odd)), strict=True)) for odd in (None, False, True))
        assert whole == sorted(turns[0] + turns[1]) and all(x & 1 == odd for odd in (0, 1) for x, _ in turns[odd])


def test_pipeline_meets_signatures_in_turn(spark, monkeypatch):
    import corpus_pipeline

    asked, whole = [], ngram_join.link_components
    monkeypatch.setattr(ngram_join, "link_components", lambda *a, **k: asked.append(k.get("in_turn")) or whole(*a, **k))
    text = " ".join(f"w{i}" for i in range(30))
    for ids in ([1, 2, 3], [1, 1, None]):
        docs = spark.createDataFrame([(i, text if k < 2 else text[::-1]) for k, i in enumerate(ids)], "doc_id bigint, text string")
        assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 2
    assert asked == [True, True]


def test_ngram_join_defined_cases(docs, rows, empty, doubled):
    assert ngram_join.link_components(empty).count() == 0
    got = ngram_join.link_components(doubled, 3, 90).collect()
    assert len(got) == len(rows) + 8
    assert all(r.component_id is None for r in got if r.doc_id is None)
    sets = {-1 if r.doc_id is None else r.doc_id: brute.shingles(r.text, 3) for r in doubled.collect() if r.doc_id is not None}
    want = brute.components(sets, 90)
    lone = {r.text for r in doubled.collect() if r.doc_id is None}
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None and r.component_id is not None and not lone & {""})
    with pytest.raises(TypeError):
        ngram_join.link_components(doubled, id_col="id")


def test_words_of_texts(monkeypatch):
    """Words are those of bytes.split(), whatever texts are cut together and wherever a piece ends."""
    r = random.Random(1)
    for piece in (1 << 20, 37):
        monkeypatch.setattr(common, "PIECE", piece)
        texts = ["".join(r.choice(["a", "b", " ", "\n", "é", "xyz", " \t", "日"]) for _ in range(r.randrange(0, 120))).encode() for _ in range(200)]
        codes = {}
        for data, w in zip(texts, common.words(texts), strict=True):
            assert [w.raw[a:b] for a, b in zip(w.begin, w.end, strict=True)] == data.split()
            for word, code in zip(data.split(), w.codes.tolist(), strict=True):
                assert codes.setdefault(word, code) == code
        assert len(set(codes.values())) == len(codes)
    assert common.words([]) == [] and [len(w.codes) for w in common.words([b"", b" ", b"a"])] == [0, 0, 1]


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_regular_structure(spark):
    """Two different words of 2,048 letters on which polynomials modulo 2^64 agree are neither linked nor removed."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    table = [(1, " ".join([one] * 30)), (2, " ".join([two] * 30)), (3, one), (4, two), (5, one)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string")
    linked = by_id(ngram_join.link_components(docs, 3, 90))
    assert {i: r.component_id for i, r in linked.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    got = by_id(substring_dedup.dedup_substrings(docs))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.word_repeats(table, 20)
    got = by_id(repeated_bytes.remove_repeats(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute.byte_repeats(table, 400)


def test_ngram_join_of_repeated_ids(spark):
    """An id with two texts links the documents that each of them is like; its blank row is of the same node."""
    one, two, far = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    table = [(1, one), (2, two), (9, one), (9, two), (9, ""), (5, two), (6, far), (6, far), (7, None)]
    got = ngram_join.link_components(spark.createDataFrame(table, "doc_id bigint, text string"), 3, 90).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (5, 1), (6, 6), (6, 6), (7, 7), (9, 1), (9, 1), (9, 1)]


def test_pipeline_keeps_one_of_each_group(spark):
    """Null and repeated ids: rows are documents of their own, and one of each group of copies stays."""
    import corpus_pipeline

    prose = lambda c: " ".join(f"{c}{i}" for i in range(40))
    a, b, c, d, e = map(prose, "abcde")
    table = [(None, a), (None, a), (3, a), (4, b), (4, b), (5, c), (6, c), (6, d), (None, e), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(table)], "doc_id bigint, text string, n int").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted([(None, a), (4, b), (5, c), (6, d), (None, e), (8, ""), (8, ""), (None, None)], key=key)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(percent)
    t = ngram_join.Threshold(percent)
    flags = r.integers(0, 5, ngram_join.COUNTERS) == 0
    for size in (1, 2, 9, 10, 25, 100, 700):
        for _ in range(20):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            keep = a[r.permutation(len(a))[: t.least_overlap(len(a))]]
            b = np.unique(np.concatenate((keep, r.integers(0, 1 << 63, int(r.integers(0, len(a) // 4 + 1)), dtype=np.uint64))))
            if t.linked(len(a), len(b), len(np.intersect1d(a, b))):
                for common_ones in (None, flags, ~flags, flags | True):
                    for seed in (0, 3):
                        (x, need_x), (y, need_y) = (ngram_join.signatures(z, t, common_ones, seed) for z in (a, b))
                        both = np.intersect1d(x, y)
                        assert len(set(x.tolist())) == len(x)
                        # in one band at least each of the two finds as many as it asks for
                        enough = lambda z, need, bit: (both & 1 == bit).sum() >= need[z & 1 == bit].max(initial=1 << 30 if not (z & 1 == bit).any() else 0)
                        assert any(enough(x, need_x, bit) and enough(y, need_y, bit) for bit in (0, 1))


@pytest.mark.parametrize(("w", "k"), [(40, 32), (12, 5)])
def test_repeated_bytes(docs, rows, w, k):
    report, gram = w // 2, k // 2 - 1
    got = by_id(repeated_bytes.remove_repeats(docs, window=w, gram=k, report=report, report_gram=gram))
    least, most = (brute.byte_repeats(texts(rows), n) for n in (report, gram))
    assert all((r.n_repeated >= gram) >= (least[i][1] > 0) and r.n_repeated <= most[i][1] for i, r in got.items())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute.byte_repeats(texts(rows), w)


@pytest.mark.parametrize(("w", "k"), [(20, 10), (5, 3)])
def test_substring_dedup(docs, rows, w, k):
    got = by_id(substring_dedup.dedup_substrings(docs, window=w, gram=k))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute.word_repeats(texts(rows), w)


def test_windows_in_chunks(docs, rows, monkeypatch):
    from tarnlens.llm import windows

    (units,) = substring_dedup.word_units([("a b c d e f g " * 50).encode()])
    whole = [x[0].tolist() for x in windows.blocks(units, 20, 10)]
    monkeypatch.setattr(windows, "CHUNK", 37)
    parts = list(windows.blocks(units, 20, 10))
    assert sum(int(p[3].sum()) for p in parts) == len(units.codes) - 19 and len(whole) == 1
    assert all(set(p[0].tolist()) <= set(whole[0]) for p in parts)


def test_repeat_operators_defined_cases(empty, doubled, rows):
    assert repeated_bytes.remove_repeats(empty).count() == 0 and substring_dedup.dedup_substrings(empty).count() == 0
    table = doubled.collect()
    # equal rows of one id: each occurs elsewhere too
    starts = brute.byte_repeats([(n, r.text) for n, r in enumerate(table)], 40)
    got = repeated_bytes.remove_repeats(doubled, 40, 32).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(map(key, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(map(key, ((r.doc_id, *starts[n]) for n, r in enumerate(table))))
    # rows of one id are one document given several times, and a null id comes first
    want = brute.word_repeats(sorted({(-1 if r.doc_id is None else r.doc_id, r.text) for r in table if r.doc_id is not None}, key=lambda x: x[0]), 20)
    alone = doubled.filter("doc_id IS NOT NULL")
    got = substring_dedup.dedup_substrings(alone, 20, 10).collect()
    assert len(got) == alone.count() and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert substring_dedup.dedup_substrings(doubled, 20, 10).count() == len(rows) + 8
    for operator in (repeated_bytes.remove_repeats, substring_dedup.dedup_substrings):
        with pytest.raises(TypeError):
            operator(doubled, id_col="id")


def test_decontamination(spark, docs, rows, empty, doubled):
    items = [(1, " ".join((rows[20][1] or "").split()[:30])), (2, "a b"), (3, None), (4, ""), (5, rows[17][1]), (6, rows[17][1]), (None, "of the House"), (8, "not in any text of these")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    words = lambda t: common.letter_words(common.utf8(t))
    named = [("null" if i is None else str(i), words(t)) for i, t in items]
    want = {i: decontaminate.brute_force(words(t), named) for i, t in texts(rows)}
    got = by_id(decontaminate.decontaminate(docs, bench))
    assert {i: (r.n_hit, sorted(r["items"])) for i, r in got.items()} == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.values())
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    again = decontaminate.decontaminate(doubled, bench).collect()
    hits = {r.text: decontaminate.brute_force(words(r.text), named) for r in doubled.collect()}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(map(key, ((r.doc_id, r.n_hit, r["items"]) for r in again))) == sorted(map(key, ((r.doc_id, *hits[r.text]) for r in doubled.collect())))
    by_name = decontaminate.decontaminate(docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), bench).collect()
    assert {r.doc_id: r.n_hit for r in by_name} == {f"d{i}": x[0] for i, x in want.items()}


def test_word_filter(spark):
    """The filter that executors make has every word of its set, and few others."""
    own = [f"wört{i}" for i in range(2000)]
    bits = decontaminate.filter_bits(spark.createDataFrame([(w,) for w in own], "word string"))
    known = decontaminate.WordFilter(bits)
    others = [f"x{i}".encode() for i in range(20_000)]
    mine = {w.encode() for w in own}
    assert known.among([*mine, *others]) >= mine and len(known.among(others)) < 200 and all(w in known for w in mine)


def test_pieces(docs, rows, empty, doubled):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = by_id(pieces.encode_pieces(docs, PIECE))
    digests = by_id(pieces.round_trip(docs, PIECE))
    for i, t in texts(rows):
        ids, data = sp.encode(t or ""), (t or "").encode()
        assert got[i].ids == ids and got[i].begins == [0, *got[i].ends[:-1]][: len(ids)]
        assert b"".join(data[a:b] for a, b in zip(got[i].begins, got[i].ends, strict=True)) == data
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256, digests[i].covered_bytes) == (len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha(sp.decode(ids).encode()), len(data))
    decoded = by_id(pieces.decode_pieces(pieces.encode_pieces(docs, PIECE), PIECE))
    assert all(decoded[i].decoded == sp.decode(sp.encode(t or "")) for i, t in texts(rows))
    assert pieces.round_trip(empty, PIECE).count() == 0 and pieces.round_trip(doubled, PIECE).count() == len(rows) + 8


def test_digests_come_from_spans(monkeypatch):
    """Operator 8's digests build every piece's span, and covered_bytes is what the spans cover."""
    import pyarrow as pa

    made, encode = [], pieces.Encoder.encode
    monkeypatch.setattr(pieces.Encoder, "encode", lambda *a, **k: made.append(encode(*a, **k)) or made[-1])
    some = ["Two words", "Zwei Wörter, 🙂", "a▁mark", "", None]
    (out,) = pieces._digest(iter([pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(some)], names=["id", "text"])]), PIECE)
    assert all(len(e.ends) == len(e.ids) for e in made) and len(made) == 5
    assert out.column("covered_bytes").to_pylist() == [len((t or "").encode()) for t in some]


@pytest.fixture(scope="module")
def mapped_model(tmp_path_factory):
    """The vocabulary of PIECE with a compiled character map of many keys, as the library compiles it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as f:
        model.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


SOME = ["ﬁne ① Ａｂ  x", "Å e\u0301 각", "㍿ and ㌀", "a\u200bb\tc\r\nd", "plain words", "ﷺ", "한국 ｶﾞ", "½ ² ™", " ", "x　y", "🙂 é", "▁ﬁ▁", "ﬃ" * 50]


def test_character_map(mapped_model):
    """Longest keys and their replacements in a compiled map, against the library's own normaliser."""
    import sentencepiece

    enc = pieces.Encoder(mapped_model)
    assert enc.map.longest("ﬁne".encode(), 0) == (3, b"fi") and enc.map.longest(b"plain", 0) is None
    assert enc.map.longest(b"A\xcc\x8a", 0) == (3, "\u00c5".encode())  # a letter and its mark, where the letter alone is no key
    norm = sentencepiece.SentencePieceNormalizer(model_file=mapped_model)
    for t in SOME:
        out, align = enc.normalise(t.encode())
        assert out.decode() == norm.normalize(t)
        assert len(align) == len(out) + 1 and align == sorted(align) and align[-1] == len(t.encode())


def test_pieces_of_a_mapped_model(mapped_model):
    """Ids are the library's, and every piece is projected to the source bytes that the library reports."""
    import sentencepiece

    enc, sp = pieces.Encoder(mapped_model), sentencepiece.SentencePieceProcessor(model_file=mapped_model)
    assert not enc.plain
    for t in [*SOME, " ".join(SOME)]:
        e = enc.encode(t)
        assert e.ids == sp.encode(t)
        proto = sp.encode(t, return_type="proto")
        for begin, end, p in zip([0, *e.ends[:-1]], e.ends, proto.pieces, strict=True):
            if not sp.is_byte(p.id):
                assert t.encode()[begin:end].decode(errors="ignore") == p.surface


def test_ogg(docs, rows, empty, doubled):
    packed = ogg.pack_ogg(docs)
    got = by_id(ogg.read_ogg(packed))
    media = {r.doc_id: r.media for r in packed.collect()}
    for i, t in texts(rows):
        data = (t or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(data), len(payload), brute.sha(payload), zlib.crc32(payload[-32:]), None)
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), brute.sha(bytes(media[i])))
    assert ogg.read_ogg(ogg.pack_ogg(empty)).count() == 0 and ogg.read_ogg(ogg.pack_ogg(doubled)).count() == len(rows) + 8


def test_ogg_checksum_and_damage():
    """The checksum bit by bit, packets over several pages, and what a damaged file gives."""
    page = bytes(range(256))
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    assert ogg.page_checksum(page) == crc
    data = random.Random(1).randbytes(200_000)
    media = ogg.mux(data)
    streams = ogg.demux(media)
    assert set(streams) == {ogg.SAMPLES, ogg.FACTS} and streams[ogg.SAMPLES].pages > 3 and streams[ogg.SAMPLES].ended
    times = ogg.packet_times(streams[ogg.SAMPLES])
    assert times == [(i + 1) * ogg.FRAME / ogg.RATE for i in range(len(times))]
    payload, size, _ = ogg.read(media)
    assert payload[:size] == data
    for bad in (media[:-1], media[:5000] + bytes([media[5000] ^ 1]) + media[5001:], b"x" + media):
        with pytest.raises(ogg.OggError):
            ogg.demux(bad)


def test_ogg_packet_ends_on_the_edge():
    one = b"".join(ogg._stream(7, [(b"head", 0), (b"a" * 255 * 300, 10), (b"", 10), (b"b" * 255, 20)]))
    assert ogg.demux(one)[7].packets == [b"head", b"a" * 255 * 300, b"", b"b" * 255]


def test_pipeline(spark, tmp_path, rows):
    """Each stage against brute force on its own input."""
    import corpus_pipeline

    items = [(1, " ".join((rows[25][1] or "").split()[:20]))]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 0, int("idiot" in (r[1] or "")), ) for r in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.settled(stage(spark, docs, str(tmp_path)), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        own = [(i, r.text) for i, r in before.items()]
        if name == "line_dedup":
            assert {i: brute.sha(r.text.encode()) for i, r in after.items()} == {i: x[2] for i, x in brute.lines(own).items()}
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, c in brute.components({i: brute.shingles(t, 5) for i, t in own}, 80).items() if i == c}
        if name == "benchmark_decontamination":
            words = lambda t: common.letter_words(common.utf8(t))
            hits = {i: decontaminate.brute_force(words(t), [("1", words(items[0][1]))])[0] for i, t in own}
            assert set(after) == {i for i, t in own if not (hits[i] and 20 * hits[i] >= len(words(t)))}
        if name == "toxicity":
            model = toxicity.fit(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels"))
            assert set(after) == {i for i, t in own if model.score(t) < toxicity.THRESHOLD} < set(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def test_pipeline_carries_any_column(spark, rows, tmp_path):
    """Columns named like computed ones come through each stage untouched, and null ids are judged by their own text."""
    import corpus_pipeline

    names = ["predicted", "score", "held_out", "kept_text", "n_lines", "n_dropped", "kept_sha256", "component_id", "n_shingles", "n_words", "n_hit", "items", "contaminated", "text_hash", "th", "_id"]
    items = [(1, " ".join((rows[25][1] or "").split()[:20]))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int("idiot" in (r[1] or ""))) for r in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = [(i, t, *[f"{c}{i}" for c in names]) for i, t in texts(rows)] + [(None, items[0][1], *names), (None, "a clean text of no one", *names)]
    docs = spark.createDataFrame(table, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        found = got.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in found if r.doc_id is not None for c in names)
        lone = {r.text for r in found if r.doc_id is None}
        assert "a clean text of no one" in lone
        if name == "benchmark_decontamination":
            assert items[0][1] not in lone


def test_texts_of_a_megabyte(spark):
    """Batches are cut by bytes: texts of a megabyte pass one or a few at a time, whole."""
    seen = []

    def run(batches):
        for b in batches:
            yield common.batch(["rows", "size"], [common.pa.int64(), common.pa.int64()], [[b.num_rows], [b.nbytes]])

    big = spark.range(24, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('line ', id, '\n'), 150000) AS text")
    seen = common.arrow_map(big.select("text"), run, "rows bigint, size bigint").collect()
    assert sum(r.rows for r in seen) == 24 and max(r["size"] for r in seen) <= common.BATCH_BYTES + (3 << 20)
    got = line_dedup.dedup_lines(big).collect()
    assert all(r.n_lines == 150_001 and r.n_dropped == 0 for r in got)

"""The pipeline's stages on planted documents."""

import numpy as np
import pytest

from tessera.llm import jaccard, simhash

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    copy = docs.orderBy("doc_id").limit(3).collect()
    planted = spark.createDataFrame(
        [(10_000 + k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(copy)] + [
            (20_000, "Write to some.one@mail1.example.com or 8.8.8.8 please, dear reader of this text", "en", "s", 10),
            (None, None, None, None, None),
        ],
        docs.schema,
    )
    now = docs.unionByName(planted)
    seen = {}
    for name, stage in pipeline.STAGES:
        seen[name] = now = stage(spark, now, data)
    kept = {r.doc_id: r.text for r in seen["pii_surrogates"].collect()}
    assert seen["pii_surrogates"].columns == docs.columns
    assert not {10_000, 10_001, 10_002} & set(kept) and 20_000 in kept and "some.one" not in kept[20_000] and "8.8.8.8" not in kept[20_000] and None in kept
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == set(kept)
    assert len(kept) > 0.6 * docs.count()


def test_toxic_word_of_thousands_of_texts_alone(spark, tmp_path):
    """A long word of over 3,400 labelled texts, all toxic."""
    rows = [(i, "a disgusting remark" if i % 2 else "a kind remark") for i in range(9_000)]
    spark.createDataFrame([(i, 0, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.drop_toxic(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 9_000, 2))


def test_repeated_ids_keep_one_row(spark, data):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "quite another text with other words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, data).collect()) == [1, 2]


def test_near_copies_by_similarity(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    base = [r.text.split() for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 60][:12]
    texts = [" ".join(w) for w in base]
    for at, words in enumerate(base):  # the same words but for every 47th, and every 9th
        texts += [" ".join(f"x{at}" if k % step == step // 2 else w for k, w in enumerate(words)) for step in (47, 9)]
    texts += ["", "one two", "one two", None]
    sets = [jaccard.shingle_set(t or "") for t in texts]
    close = [[len(a) == len(b) == 0 or len(set(a) & set(b)) * 5 >= 4 * len(set(a) | set(b)) for b in map(np.ndarray.tolist, sets)] for a in map(np.ndarray.tolist, sets)]
    bits = [[(simhash.simhash(a or "") ^ simhash.simhash(b or "")).bit_count() for b in texts] for a in texts]
    assert any(c and n > simhash.RADIUS for cs, ns in zip(close, bits) for c, n in zip(cs, ns))
    comp = list(range(len(texts)))
    while (new := [min(comp[j] for j in range(len(texts)) if close[i][j]) for i in range(len(texts))]) != comp:
        comp = new
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(table).collect()} == dict(enumerate(comp))
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, table, data).collect()) == sorted(set(comp))


def test_near_copies_go_through_simhash(spark, monkeypatch):
    """SimHash's own multi-index links propose pairs; those of less than the similarity are dropped by the whole sets."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))]
    found, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes: found.append(links(classes)) or found[-1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(table).collect()} == {0: 0, 1: 0, 2: 2}
    fps = [jaccard.signs(jaccard.shingle_set(t)) for t in texts]
    assert {frozenset((r.a, r.b)) for r in found[0].collect()} == {frozenset(fps[:2])}


def test_a_group_of_near_copies_of_all_degrees(spark, data):
    """Texts made of one, so that many pairs lie on either side of the similarity: components as by comparing all pairs."""
    draw = np.random.default_rng(5)
    base = [f"w{k}" for k in range(64)]
    texts = []
    for k in range(320):
        words = list(base)
        for at in draw.choice(64, int(draw.integers(0, 9)), replace=False):
            words[at] = f"y{k}" if draw.random() < 0.7 else f"z{at}"
        texts.append(" ".join(words))
    sets = [set(jaccard.shingle_set(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= 4 * len(a | sets[j]) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    assert 5 < len(set(comp)) < 250
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_copies(table).collect()} == dict(enumerate(comp))


def test_one_row_of_a_group_stays_whatever_the_ids(spark, data):
    a, b = "one text of seven words is here", "another text that has nothing of it"
    rows = [(1, a, "en", 1), (2, a, "en", 2), (2, b, "en", 3), (2, b, "en", 3), (2, b, "de", 3), (3, None, "en", 4), (4, "", "en", 5), (None, a, "en", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, n int")
    out = pipeline.drop_near_duplicates(spark, docs, data)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a, "en", 1), (2, b, "de", 3), (3, None, "en", 4), (None, a, "en", 6)], key=str)


def test_no_rows(spark, data):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:3]:
        assert stage(spark, docs, data).columns == docs.columns and stage(spark, docs, data).count() == 0


def test_run_against_all_pairs_and_the_library(spark, data):
    """The whole pipeline over the table: who stays by comparing all pairs of texts, how many tokens by the tokenizer's own library."""
    from tokenizers import Tokenizer

    from tessera.llm.pii import replace_entities
    from tessera.llm.tokens import default_path
    from tessera.llm.toxicity import toxicity

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity(docs, labels).collect() if r.score >= 0.5}
    kept = sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in toxic)
    sets = []
    for _, text in kept:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
        sets.append({b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(kept)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= 4 * len(a | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    stay = {kept[g][0] for g in group}
    library = Tokenizer.from_file(default_path())
    texts = replace_entities(docs.select("doc_id", "text")).collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in texts if r.doc_id in stay}
    assert toxic and len(stay) < len(kept)
    pieces: dict = {}
    for r in pipeline.run(spark, data).collect():
        assert r.doc_tokens == want[r.doc_id]
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(want)
    for doc_id, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == want[doc_id]


def test_columns_without_an_order(spark):
    """Maps beside repeated rows: one of them is kept, always the same."""
    text = "one two three four five six seven"
    rows = [(1, text, {"a": 2}), (1, text, {"a": 1}), (2, text, {"b": 1}), (3, "other", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>")
    kept = sorted((r.doc_id, r.extra) for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [(1, {"a": 1}), (3, None)]

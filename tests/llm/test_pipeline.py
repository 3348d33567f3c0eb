import random
from collections import defaultdict

import corpus_pipeline
from corpusflow.llm import neardup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCAB = {"en": "the and with from have this that were which their would there about other", "de": "der und mit von haben diese dass waren welche ihre wurde dort ueber andere"}


def folder(spark, tmp_path):
    rng = random.Random(13)
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(VOCAB[lang].split(" ")) + ("" if rng.random() < 0.7 else rng.choice("abcdefgh") * 2) for _ in range(rng.randrange(40, 90))]
        rows.append([i, " ".join(words), lang, "web", 0])
    item = "a question of the benchmark that must never be seen in any text of training at all"
    other = "another thing that is asked of models and has one answer only which nobody may know"
    rows += [[200, rows[3][1], "en", "web", 0], [201, rows[4][1] + " also", "en", "web", 0], [202, None, None, "web", 0], [203, "123 456 !!", None, "web", 0]]
    rows += [[204, rows[5][1][::1] + " " + " ".join(f"u{k}" for k in range(60)) + " " + item, "en", "web", 0], [205, f"{item} {other}", "en", "web", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages_act_and_keep_clean_documents(spark, tmp_path):
    rows = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in after.items()}
    everything = {r[0] for r in rows}
    assert ids["language_id"] == everything - {202, 203}
    assert ids["line_dedup"] == ids["language_id"]
    gone = {r.doc_id for r in neardup.groups(after["line_dedup"]).collect() if r.doc_id != r.component_id}
    assert {200, 201} <= gone and ids["minhash_near_dedup"] == ids["line_dedup"] - gone
    assert ids["benchmark_decontamination"] == ids["minhash_near_dedup"] - {205}
    texts = {r.doc_id: r.text for r in after["benchmark_decontamination"].collect()}
    assert "question of the benchmark" not in texts[204] and "u59" in texts[204]
    assert all(texts[r[0]] == r[1] for r in rows if r[0] in texts and r[0] != 204)
    pieces = defaultdict(int)
    for r in after["packing"].collect():
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert {i for i, _ in pieces} == set(texts) and all(n == total for (_, total), n in pieces.items())


def test_near_stage_compares_five_words(spark):
    """One changed word in 24: close on two-word shingles, not on five-word ones."""
    words = [f"w{k}" for k in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:12], "new", *words[13:]])), (3, " ".join([*words, "w24"]))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in neardup.groups(docs, size=2).collect()} == {1}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 2}


def test_stages_with_repeated_rows_long_texts_and_extra_columns(spark, tmp_path):
    """Rows that share an id, equal rows, null ids, a very long text and columns named like the operators' own, through every stage."""
    folder(spark, tmp_path)
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(VOCAB["en"].split(" ")) + rng.choice("abcdefgh") * 2 for _ in range(n))
    unique, twice, long = say(60), say(70), say(150_000)
    rows = [(1, twice), (5, unique), (5, twice), (6, unique + " tail " + say(80)), (6, unique + " tail " + say(80)), (None, say(50)), (8, long), (9, None)]
    rows.append(rows[3])
    docs = spark.createDataFrame([(i, t, "en", "web", k, "a", "b", k, "c", "d") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _gone string, _letters string, _row int, _mask string, _n_lines string")
    want = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/own-{k}")
        docs = spark.read.parquet(f"{tmp_path}/own-{k}")
        assert docs.columns == want, name
    kept = sorted(r.n_chars for r in docs.collect())
    assert kept in ([0, 1, 3, 4, 5, 6], [0, 1, 4, 5, 6, 8])  # 3 and 8 are equal rows
    pieces = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 5, 6, None, 8}


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
